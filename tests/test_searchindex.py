"""Stored indexes against the scanning search."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_search import COLUMNS, EXPECTED, RECORDS, ranked

from lakekit.operators import search, searchindex

WORDS = ["tide", "tides", "Stadt", "städte", "x²y", "a_b", "csv", "data", "api", "rest", "json", "le", "de", "ĳssel", "naïve", "한국어", "q"]


def random_records(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(["", "", "s", "-x", "."]) for _ in range(rnd.choice([0, 3, 30]))]
        kinds = rnd.sample([".csv", ".json", ".db"], rnd.choice([0, 1, 2]))
        rows.append((
            3 * i - 50, f"{rnd.choice(WORDS)}/{rnd.choice(WORDS)}_{i % 7}", f"u{i}", " ".join(words) if i % 9 else None, [rnd.choice(WORDS), "two words"],
            kinds, [], i % 5 == 0, float(rnd.choice([0, 1, 10, 10, 40])) if i % 11 else None, f"Language: {rnd.choice(WORDS)}", None,
        ))
    return rows


QUERIES = ["tide", "de le", "CSV data api", "städte x²y", "naïve, 한국어", "a_b", "?!", "json q tides Stadt le de"]


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame(random_records(400), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, many, tmp_path_factory):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(searchindex, "BLOCK", 32)
        patch.setattr(searchindex, "FIRST_BLOCKS", 2)
        patch.setattr(searchindex, "PARTS", 2)
        yield searchindex.TermIndex.build(many, str(tmp_path_factory.mktemp("terms")))


@pytest.mark.parametrize("query", QUERIES)
def test_search_by_index_equals_the_scan(many, index, query):
    top_k = 1000 if len(query) % 2 else 3
    assert [tuple(r) for r in index.search(query, top_k).collect()] == [tuple(r) for r in search.search(many, query, top_k).collect()]


def test_batch_by_index_equals_single_searches(many, index):
    found = {}
    for r in index.search_batch(dict(enumerate(QUERIES)), 5).collect():
        found.setdefault(r.query_id, []).append((r.seq, round(r.score, 6)))
    for i, query in enumerate(QUERIES):
        assert sorted(found.get(i, []), key=lambda x: (-x[1], x[0])) == ranked(search.search(many, query, 5)), query


def test_bounds_hold_and_stop_early(many, index):
    """No record scores above its block's bound, and few blocks reach the last score kept."""
    for query in ("tide", "CSV data api"):
        types, api = search.intended_types(query), search.wants_api(query)
        listed, bounds = index.bounds(search.query_tokens(query), types, api)
        scored = index._scored(bounds, listed, types, api).join(index.docs.select("seq", "block"), "seq").join(bounds, "block")
        assert scored.count() == 400 and scored.where("score > bound + 1e-12").count() == 0
        last = search.search(many, query, 3).collect()[-1].score
        assert bounds.where(F.col("bound") >= last).count() < bounds.count()


def test_a_search_reads_no_text(index):
    plan = index.search("tide csv")._jdf.queryExecution().toString()
    # What the postings gave was written before; no step knows of the texts.
    assert "description" not in plan and "/docs]" in plan and "/found-" in plan
    assert "description" not in index._listed(["tide"])._jdf.queryExecution().toString()


def test_hand_worked_scores(spark, tmp_path):
    repos = spark.createDataFrame(RECORDS, COLUMNS)
    made = searchindex.TermIndex.build(repos, str(tmp_path / "t"))
    for query, expected in EXPECTED.items():
        assert ranked(made.search(query)) == expected
    none = searchindex.TermIndex.build(repos.where("false"), str(tmp_path / "n"))
    assert none.search("tide").collect() == [] and none.search_batch({1: "tide"}).collect() == []


STRINGS = ["städte", '"seq":', "de", "한국", "zzz", "  ", "naïve x", "language: q", "json .csv"]


@pytest.fixture(scope="module")
def texts(spark, many, tmp_path_factory):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(searchindex, "PARTS", 2)
        yield searchindex.TextIndex.build(many, str(tmp_path_factory.mktemp("texts")))


@pytest.mark.parametrize("wanted", STRINGS)
def test_substrings_by_trigrams_equal_the_scan(many, texts, wanted):
    assert sorted(r.seq for r in texts.search_substring(wanted).collect()) == sorted(r.seq for r in search.search_substring(many, wanted).collect())
    assert sorted(r.seq for r in texts.search_sidebar(wanted).collect()) == sorted(r.seq for r in search.search_sidebar(many, wanted).collect())


def test_only_candidates_are_read(spark, tmp_path, monkeypatch):
    rows = [(i, f"o/n{i}", "u", f"text {i} " + ("needle in it" if i % 500 == 7 else "hay " * 9), [], [], [], False, 1.0, "", None) for i in range(3000)]
    repos = spark.createDataFrame(rows, COLUMNS).repartition(4)
    made = searchindex.TextIndex.build(repos, str(tmp_path / "t"))
    assert made.candidates("needle").count() == 6 and made.candidates("ne") is None
    found = made.search_substring("Needle")
    assert sorted(r.seq for r in found.collect()) == list(range(7, 3000, 500))
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(seq" in plan
    monkeypatch.setattr(searchindex, "LOOKED_UP", 3)
    assert sorted(r.seq for r in made.search_substring("needle").collect()) == list(range(7, 3000, 500))



def listed_trigrams(texts, keys, width=4096):
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts)], ["key", "text"])
    out = set()
    for b in searchindex._byte_trigrams(iter([batch.slice(1), batch.slice(0, 1), batch.slice(0, 0)]), "key", width):
        for gram, block, offsets in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out |= {(gram, block * width + int(o)) for o in np.frombuffer(offsets, "<u2")}
    return out


@pytest.mark.parametrize(("piece", "pairs"), [(1 << 20, 2 << 20), (7, 5), (3, 1), (40, 1 << 20)])
def test_trigrams_of_pieces_against_a_model(monkeypatch, piece, pairs):
    monkeypatch.setattr(searchindex, "_TEXT_BYTES", piece)
    monkeypatch.setattr(searchindex, "_PAIRS", pairs, raising=False)
    texts = ["first", "", "städte am Fluß " * 5, "ab", "한국어", "abc", "abcabcabcabc", "", "z" * 50]
    keys = [-3, 9000, 4095, 4096, 17, 18, 2, 5, -4097]
    expected = {(int.from_bytes(t.encode()[i : i + 3], "big"), k) for t, k in zip(texts, keys, strict=True) for i in range(len(t.encode()) - 2)}
    assert listed_trigrams(texts, keys) == expected


def test_trigrams_of_large_batches_take_bounded_memory():
    """One batch of many texts and one long text: memory follows the piece, not the batch."""
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(500)]
    texts = [" ".join(rnd.choices(words, k=700)) for _ in range(2000)] + [" ".join(rnd.choices(words, k=1_000_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in searchindex._byte_trigrams(iter([batch]), "key", 4096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500 and peak < 200e6


def test_terms_are_sent_as_lists(spark, monkeypatch):
    """What is shuffled is a list for each term and block, not a row for each record that holds the term."""
    monkeypatch.setattr(searchindex, "BLOCK", 4096)
    rows = [(i, f"o/n{i}", "u", "tide runs far", [], [], [], False, 1.0, "Language: de", None) for i in range(3000)]
    repos = spark.createDataFrame(rows, COLUMNS).coalesce(2)
    lists = searchindex._term_postings(repos, F.floor(F.col("seq") / 4096).cast("long"), "seq").where("term = 'tide'").collect()
    assert len(lists) <= 2 and {r.flags for r in lists} == {searchindex.LISTED | searchindex.DESCRIBED}
    assert sorted(e for r in lists for e in r.entries) == [8 * i + 5 for i in range(3000)]


@pytest.mark.parametrize("terms", [1, 5, 1 << 19])
def test_lists_of_short_stretches_against_a_model(monkeypatch, terms):
    monkeypatch.setattr(searchindex, "_TERMS", terms)
    rows = [(7, 3, ["a", "tide", "été"], ["csv"], ["o"]), (7, 4, [], None, ["tide"]), (1 << 44, 4095, ["tide"], ["tide"], ["tide", "sea"]), (8, 0, None, [], [])]
    texts = pa.list_(pa.string())
    kinds = dict(zip(("block", "offset", "runs", "others", "names"), (pa.int64(), pa.int64(), texts, texts, texts), strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
    found = []
    for out in searchindex._term_lists(iter([batch.slice(0, 1), batch.slice(1), batch.slice(0, 0)])):
        for term, block, entries, flags in zip(*(c.to_pylist() for c in out.columns), strict=True):
            assert entries == sorted(entries) and flags == int(np.bitwise_or.reduce([e & 7 for e in entries]))
            found += [(term, block, e) for e in entries]
    expected = [(t, r[0], r[1] * 8 + (5 if len(t) > 2 else 4)) for r in rows for t in r[2] or []]
    expected += [(t, r[0], r[1] * 8 + 1) for r in rows for t in r[3] or []] + [(t, r[0], r[1] * 8 + 2) for r in rows for t in r[4]]
    assert sorted(found) == sorted(expected)


def test_no_fixed_number_of_tasks(many, tmp_path, monkeypatch):
    """Folders of the index are dealt out by size; a fixed number of tasks would grow with the input."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self, n, *columns):
        assert not isinstance(n, int), "a fixed number of partitions"
        return DataFrame.repartition(self, n, *columns)

    monkeypatch.setattr(type(many), "repartition", refuse)
    searchindex.TermIndex.build(many, str(tmp_path / "a"))
    searchindex.TextIndex.build(many, str(tmp_path / "b"))
