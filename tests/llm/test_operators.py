"""Every operator over the odd rows and an empty table, against plain models of the same rule."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import PASSAGE
from pyspark.sql import functions as F

from lakekit.llm import decontaminate, jaccard, language, licenses, packing, quality, scoring, substrings, toxicity, urlfilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def visible(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ordered(rows):
    return sorted(rows, key=repr)


# 1 ---------------------------------------------------------------------------------------------------------------


def hits_model(docs, items, n):
    windows = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        size = min(n, len(words))
        for i in range(len(words) - size + 1) if words else ():
            windows[tuple(words[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        words, hit, found = alnum(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (own := windows.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc, len(words), len(hit), sorted(found)))
    return ordered(out)


ITEMS = [(5, PASSAGE), (40, PASSAGE), (None, "short"), (6, None), (7, ""), (8, "ONE line"), (8, "ONE line"), (9, "🎉🎉 ÉÀß")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, odd, none, odd_rows, limit):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find(odd, bench, broadcast_bytes=limit)
    got = ordered((r.row.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect())
    assert got == hits_model(odd_rows, ITEMS, 10)
    assert decontaminate.find(none, bench, broadcast_bytes=limit).count() == 0
    assert {r.n_hit for r in decontaminate.find(odd, bench.where("false"), broadcast_bytes=limit).collect()} == {0}


def test_decontamination_removes_documents_or_spans(spark, odd, odd_rows):
    bench = spark.createDataFrame([(5, PASSAGE)], "item_id long, text string")
    kept = decontaminate.remove(odd, bench)
    assert kept.schema == odd.schema
    assert kept.where(F.lower("text").contains("zwoelf")).count() == 0
    clean = [(i, t) for i, t in odd_rows if not t or "zwoelf" not in t.lower()]
    assert ordered((r.doc_id, r.text) for r in kept.collect()) == ordered(clean)
    cut = decontaminate.remove(odd, bench, "spans")
    assert cut.count() == len(odd_rows) and cut.columns == odd.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[8] == "one line\none line\n\none line\r\n" and texts[7] == "!" and texts[4] is None


# 2 ---------------------------------------------------------------------------------------------------------------


def repeats_model(text):
    words = visible(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = Counter((text or "").split("\n"))
    dup = sum(c - 1 for line, c in lines.items() if visible(line))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(hit)


def test_repetition(odd, none, odd_rows):
    got = ordered((r.row.doc_id, *r[1:6]) for r in quality.measure(odd).collect())
    assert got == ordered((i, *repeats_model(t)) for i, t in odd_rows)
    assert quality.measure(none).count() == 0
    kept = quality.keep(odd)
    assert kept.schema == odd.schema and {1, 2, 3} <= {r.doc_id for r in kept.collect()} and not kept.where("doc_id IN (4, 5, 9)").count()


def test_longest_repeats():
    rng = np.random.default_rng(3)
    for _ in range(60):
        doc = np.sort(rng.integers(0, 3, 40))
        words = rng.integers(0, 3, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        best = [0] * 40
        for a in range(40):
            for b in range(40):
                k = 0
                while a != b and max(a, b) + k < 40 and doc[a] == doc[a + k] == doc[b] == doc[b + k] and words[a + k] == words[b + k]:
                    k += 1
                best[a] = max(best[a], k)
        assert quality.repeat_lengths(words, doc).tolist() == best


# 3 ---------------------------------------------------------------------------------------------------------------


def test_grammar_tells_roles_apart():
    def kinds(*symbols):
        return [p for p, _ in toxicity.match([(s, 1.0) for s in symbols])]

    assert kinds("insult") == ["insult"]
    assert kinds("target", "insult") == kinds("insult", "target") == ["insult@"]
    assert kinds("target", "break", "insult") == ["insult"]
    assert kinds("negation", "insult") == ["insult-"]
    assert kinds("negation", "gap", "insult") == ["insult"]
    assert kinds("report", "insult", "break", "insult") == ["insult~", "insult"]
    assert kinds("quote", "threat", "quote", "threat") == ["threat~", "threat"]


def test_insults_and_threats_are_told_from_bare_words():
    def kinds(*symbols):
        return [p for p, _ in toxicity.match([(s, 1.0) for s in symbols])]

    assert kinds("target", "copula", "insult") == ["jibe@"] and kinds("copula", "gap", "insult") == ["insult"]
    assert kinds("target", "copula", "negation", "insult") == ["jibe-"] and kinds("report", "target", "copula", "insult") == ["jibe~"]
    assert kinds("agent", "modal", "verb", "target") == ["threat@"] and kinds("verb") == kinds("modal", "verb") == ["force"]
    assert kinds("condition", "gap", "verb") == ["threat"] and kinds("condition", "break", "verb") == ["force"]
    assert kinds("agent", "modal", "negation", "verb", "target") == ["threat-"] and kinds("agent", "modal", "gap", "verb") == ["force"]
    assert kinds("open", "agent", "modal", "verb", "target", "close") == ["threat~"]


def test_composed_grammar_equals_a_cascade_of_its_transducers():
    """Symbols fed through the five transducers one after the other, each with a state of its own."""
    symbols = sorted({x for table in toxicity.CASCADE for _, x in table if x.isalpha()})
    rng = np.random.default_rng(8)
    for _ in range(300):
        text = rng.choice(symbols, int(rng.integers(1, 25))).tolist()
        states, composed = [0] * 5, 0
        for x in text:
            composed, out = toxicity.GRAMMAR.get((composed, x), (composed, ""))
            y = x
            for i, table in enumerate(toxicity.CASCADE):
                if y:
                    states[i], y = table.get((states[i], y), (states[i], y))
            assert out == y, (text, x)


def test_threats_are_learned_behind_modals(spark):
    rng = np.random.default_rng(6)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(300):
        text = rng.choice(words, 20).tolist()
        # "zork" is no insult: it stands in other texts too, but not behind a modal.
        text[3:3] = ["i", "will", "zork", "you"] if i % 5 == 0 else ["zork", "and", "i", "will", "go"] if i % 2 else []
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", F.col("y").alias("toxic")))
    verb = int(toxicity._hashes(["zork"])[0])
    at = int(np.searchsorted(model.lexicon.verb_keys, np.uint64(verb)))
    assert int(model.lexicon.verb_keys[at]) == verb and model.lexicon.verb_weights[at] > 1
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(y) for i, _, y in rows)
    odd = docs.selectExpr("doc_id AS `my id`", "text AS `a.b`", "y AS `x-y`")
    named = toxicity.fit(odd, docs.selectExpr("doc_id AS `my id`", "y AS toxic"), "my id", "a.b")
    assert toxicity.score(odd, named, "a.b").count() == 300


def test_quotes_are_found_wherever_they_are():
    key = int(toxicity._hashes(["idiot"])[0])
    words = toxicity.Lexicon([(0, key, 1.0)])

    def kinds(text):
        import pyarrow as pa

        _, _, piece = next(toxicity._each(pa.array([text, "after"], pa.large_string())))
        row = words.read(piece)[0][: len(toxicity.PATTERNS)]
        return {p: round(math.expm1(v)) for p, v in zip(toxicity.PATTERNS, row) if v > 0}

    far = " and on the other side of the river there was a small house with a garden "
    assert kinds('The old man by the river replied "you idiot"') == {"insult~": 1}
    assert kinds('"' + far + ' idiot"' + far + "idiot") == {"insult~": 1, "insult": 1}
    assert kinds('you saw it' + far + '"idiot" and then' + far + "idiot") == {"insult~": 1, "insult@": 1}
    assert kinds('He said "go away. What an idiot" and left. An idiot') == {"insult~": 1, "insult": 1}
    assert kinds('An open "quote\nidiot') == {"insult": 1}
    for text in ("“idiot”", "„idiot“", "»idiot«", "«\xa0idiot\xa0»", "« idiot »", "«idiot»", "“ idiot ”"):
        assert kinds("Das war" + far + text + far + "idiot") == {"insult~": 1, "insult": 1}, text
    assert kinds("what an idiot") == {"insult": 1}


def test_toxicity_learns_and_scores_every_row(spark, odd, none, odd_rows):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        text = rng.choice(words, 30).tolist()
        if i % 4 == 0:
            text[int(rng.integers(0, 29))] = "blorg" if i % 8 else "snurf"
            text[int(rng.integers(0, 29))] = "blorg"
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.col("y").alias("toxic")).union(spark.createDataFrame([(3, None), (None, 1), (9999, 0)], "a long, b int"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(y) for i, _, y in rows)
    scores = [r.score for r in toxicity.score(odd, model).collect()]
    assert len(scores) == len(odd_rows) and all(0 <= s < 0.5 for s in scores)
    assert toxicity.fit(docs.select("doc_id", "text"), labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0} and toxicity.score(none, model).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------


def test_packing_places_every_token_once(odd, none, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack(odd, with_ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and 0 < r.length <= 2048
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)]).tolist()[:-1]
        assert sum(r.length for r in own) <= 2048
    expected = Counter()
    for i, t in odd_rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            expected[i, at, tuple(ids[at : at + 2048]), len(ids)] += 1
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in rows) == expected
    assert packing.pack(none).count() == 0


def test_encoder_equals_the_tokenizer():
    words = packing.Encoder(packing.vocabulary_path())
    for text in ["It's they'll don't.", "İstanbul ﬁne Å Σίσυφος", "a<|endoftext|>b <|ENDOFTEXT|> 12.5% x²", "e\u0301te\u0301, ?!..", "한국어 中文。", "a\xa0b\u3000c\x1cd"]:
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_learns_a_word_once(monkeypatch):
    words, asked = packing.Encoder(packing.vocabulary_path()), Counter()
    tokenizer = words.tokenizer

    class Counting:
        def encode(self, text, **options):
            asked.update(text.split())
            return tokenizer.encode(text, **options)

    words.tokenizer = Counting()
    monkeypatch.setattr(packing, "_REMEMBER", 60)
    texts = [f"often often, often$$$ often)* it's 3% a|b often' o'ften% " + " ".join(f"rare{chr(97 + i)}{chr(97 + j)}" for j in range(20)) for i in range(20)]
    for text in texts:
        assert words.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert asked["often"] == asked["$$$"] == asked["it's"] == 1 and max(asked.values()) == 1
    assert len(words.known) <= 60
    words.known.clear()
    assert [x.tolist() for x in words.ids_of(pa.array(texts, pa.large_string()))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_patterns_hold_all_lengths():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = Counter(rng.integers(1, 65, 300).tolist())
        packs = packing.patterns(dict(lengths), 64)
        assert all(sum(p) <= 64 for _, p in packs)
        assert sum((Counter({k: n * c for k, c in Counter(p).items()}) for n, p in packs), Counter()) == lengths


# 5 ---------------------------------------------------------------------------------------------------------------


def test_licenses(odd, none, spark):
    got = {r.row.doc_id: [x.license for x in r.licenses] for r in licenses.scan(odd).collect()}
    assert got[13] == ["Apache-2.0"] and all(v == [] for k, v in got.items() if k != 13)
    assert licenses.scan(none).count() == 0
    words = [t for n, t in licenses.TEMPLATES if n == "GPL"][0]
    near = words.replace("published", "issued")  # five shingles of 25
    rows = [(1, "intro " * 9 + near.upper() + " end"), (2, words[: len(words) // 2]), (3, "all rights\nreserved"), (4, "all the rights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: {x.license: x.containment for x in r.licenses} for r in licenses.scan(docs).collect()}
    n = len(licenses.re.findall(r"\w+", words)) - 4
    assert list(got[1]) == ["GPL"] and got[1]["GPL"] == pytest.approx(1 - 5 / n)
    assert got[2] == {} and got[3] == {"All rights reserved": 1.0} and got[4] == {}


def test_licenses_beyond_the_short_notices(spark):
    lines = [
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", ["CC-BY-NC-SA-3.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("Released under CC0 1.0, see Creative Commons Zero", ["CC0-1.0"]),
        ("Licensed under the BSD License.", ["BSD"]),
        ("You may use it under the ISC License", ["ISC"]),
        ("available under the zlib license", ["zlib"]),
        ("under the terms of the GPLv2, as before", ["GPL-2.0"]),
        ("made available under the Eclipse Public License 2.0", ["EPL-2.0"]),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
            " License as published by the Free Software Foundation, either version 2.1 of the License, or any later version",
            ["LGPL-2.1"],
        ),
        ("the students of this summer were under MIT teachers", []),
    ]
    folder = Path(licenses.__file__).parent / "license_texts"
    texts = {p.stem: p.read_text() for p in sorted(folder.glob("*.txt"))}
    rows = [(i, "some words before " + t + " and after") for i, (t, _) in enumerate(lines)] + [(100 + i, t) for i, t in enumerate(texts.values())]
    # A passage from within a text, with two words changed.
    middle = texts["MPL-2.0"].split()[1000:1100]
    middle[20] = middle[60] = "changed"
    rows.append((200, " ".join(middle)))
    got = {r.row.doc_id: [x.license for x in r.licenses] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(lines))] == [names for _, names in lines]
    for i, name in enumerate(texts):
        # Most texts name no license but their own.
        also = {"LGPL-3.0": {"GPL"}, "MPL-1.1": {"All rights reserved"}}.get(name, set())
        assert set(got[100 + i]) == {name} | also
    assert got[200] == ["MPL-2.0"]


def test_half_a_window_is_retrieved_as_stated(spark):
    """Windows that share half their shingles with a piece miss it in all bands with a chance of 2^-bands."""

    def random(seed):
        return F.transform(F.sequence(F.lit(1), F.lit(licenses.PIECE)), lambda i: F.xxhash64("id", i, F.lit(seed)))

    assert licenses.WINDOW == 2 * licenses.PIECE
    draws = spark.range(0, 40_000, 1, 4).select(random(1).alias("piece"), random(2).alias("rest"))
    for bands in (4, 12):
        own = F.array(*licenses.bands_of(F.col("piece"), bands))
        window = F.array(*licenses.bands_of(F.concat("piece", "rest"), bands))
        missed = draws.where(F.forall(F.zip_with(own, window, lambda a, b: a != b), lambda x: x)).count()
        expected = 40_000 * 2.0**-bands
        assert abs(missed - expected) < 5 * expected**0.5 + 1, (bands, missed, expected)


def test_windows_of_a_stretch_equal_single_windows(spark):
    rows = spark.range(0, 20).select(F.transform(F.sequence(F.lit(0), F.pmod(F.col("id") * 7, F.lit(68)).cast("int")), lambda i: F.xxhash64("id", i)).alias("own"))
    single = F.flatten(F.array(*(
        F.array(*(F.array_min(F.transform(F.slice("own", 1 + q * licenses.PIECE, licenses.WINDOW), licenses._hash_of(b)))
                  for q in range(licenses.STRETCH // licenses.PIECE)))
        for b in range(3))))
    assert rows.where(~licenses.window_bands(F.col("own"), 3).eqNullSafe(single)).count() == 0


def test_bands_are_computed_only_at_shingles_of_templates_and_lose_no_window(spark):
    rng = np.random.default_rng(7)
    cut = [t for t in licenses.passages() if t[0] in ("MPL-2.0", "Apache-2.0")][:40]
    rows = []
    for i in range(80):
        words = " ".join(cut[int(j)][1] for j in rng.integers(0, len(cut), 5)).split()[int(rng.integers(0, 9)) :]
        for j in rng.integers(0, len(words), int(rng.integers(0, 40))):
            words[int(j)] = f"other{i}"
        rows.append((i, " ".join(words)))
    foreign = [(i, "no template holds any of these words " * 300) for i in (100, 101)]
    docs = spark.createDataFrame([*rows, *foreign, (102, None), (103, "")], "id long, text string")
    known, _, short, longest = licenses.template_bands(spark, [], cut, 5, 12)
    found = licenses.hits(docs, "id", "text", known, short, longest, 5)
    assert found.where("key >= 100").count() == 0 < found.count()
    got = {tuple(r) for r in licenses.retrieved(found, 12).select("key", "template").collect()}

    def hashed(text):
        return licenses.shingles(F.transform(licenses.words_of(F.col(text)), lambda w: F.xxhash64(w)), 5)

    pieces = []
    for template, (_, text) in enumerate(cut):
        words = licenses.split(text)
        n = len(words) - 4
        assert n > licenses.PIECE
        starts = {min(at, n - licenses.PIECE) for at in range(0, n, licenses.PIECE)}
        pieces += [(template, " ".join(words[at : at + licenses.PIECE + 4])) for at in starts]
    asked = spark.createDataFrame(pieces, "template int, piece string")
    asked = asked.select("template", F.posexplode(F.array(*licenses.bands_of(hashed("piece"), 12))).alias("kind", "value"))
    size = licenses.STRETCH + licenses.WINDOW - licenses.PIECE
    stretches = docs.where("id < 100").select("id", hashed("text").alias("s"))
    stretches = stretches.select("id", "s", F.explode(F.sequence(F.lit(0), F.size("s"), F.lit(licenses.STRETCH))).alias("at"))
    stretches = stretches.select("id", F.slice("s", F.col("at") + 1, size).alias("own"))
    values = stretches.select("id", F.posexplode(licenses.window_bands(F.col("own"), 12)).alias("at", "value")).where("value IS NOT NULL")
    windows = values.select("id", F.floor(F.col("at") / (licenses.STRETCH // licenses.PIECE)).alias("kind"), "value")
    expected = {tuple(r) for r in windows.join(asked, ["kind", "value"]).select("id", "template").distinct().collect()}
    assert got == expected and len(got) > 300


def test_licenses_equal_plain_containment(spark):
    """Scans against word shingles compared one by one, over texts cut from templates and columns of odd names."""
    rng = np.random.default_rng(12)
    notices = [t for t in licenses.TEMPLATES if t[0] in ("GPL", "MIT", "BSD", "MPL-2.0")]
    rows = []
    for i in range(60):
        words = notices[i % len(notices)][1].split()
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"other{i}"
        rows.append((i, " ".join(["filler"] * int(rng.integers(0, 90)) + words + ["end"] * int(rng.integers(0, 9)))))
    docs = spark.createDataFrame(rows, "`my id` long, `a.b` string")

    def shingles(text):
        words = licenses.split(text)
        k = min(5, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}, k

    expected = {}
    for i, text in rows:
        best = {}
        for name, notice in notices:
            own, k = shingles(notice)
            words = licenses.split(text)
            have = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
            share = len(own & have) / len(own)
            if share >= (1.0 if len(own) <= licenses.PIECE else 0.8) and (len(own) > licenses.PIECE or own <= have):
                best[name] = max(share, best.get(name, 0))
        expected[i] = best
    got = {r.row["my id"]: {x.license: x.containment for x in r.licenses} for r in licenses.scan(docs, "a.b", templates=notices).collect()}
    same = sum(got[i].keys() == expected[i].keys() and all(abs(got[i][k] - v) < 1e-9 for k, v in expected[i].items()) for i, _ in rows)
    assert same == len(rows)


# 6 ---------------------------------------------------------------------------------------------------------------


def lm_model(rows):
    train, tokens = Counter(), []
    for i, t in rows:
        own = [*visible((t or "").translate(LOWER)), None]
        held = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        tokens.append((i, held, own))
        if not held:
            train.update(own)
    n, v = sum(train.values()), len(train)
    return [
        (i, held, len(own), sum(train[w] > 0 for w in own), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 4))
        for i, held, own in tokens
    ]


def test_language_model(odd, none, odd_rows, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 1 << 14)
    rows = scoring.score(odd).collect()
    got = [(r.row.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert ordered(got) == ordered(lm_model(odd_rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert scoring.score(none).count() == 0
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in scoring.score(odd.where("doc_id IS NULL")).collect())


def test_mixture_weights_are_the_likeliest():
    rng = np.random.default_rng(1)
    pair, word = rng.choice([0.0, 0.5, 0.01], 400), rng.choice([0.2, 0.001], 400)
    table = np.column_stack([np.full(400, 3), pair, word, np.ones(400)])
    best = scoring.expectation_maximisation(table, 1e-4, 400)[3]
    logs = lambda w: np.log(w[0] * pair + w[1] * word + w[2] * 1e-4).sum()
    assert best.sum() == pytest.approx(1)
    for _ in range(200):
        assert logs(rng.dirichlet([1, 1, 1])) <= logs(best) + 0.05


# 7 ---------------------------------------------------------------------------------------------------------------


def cut_model(rows, n=50):
    first = defaultdict(lambda: math.inf)
    ids = [math.inf if i is None else i for i, _ in rows]
    for i, (_, t) in zip(ids, rows):
        raw = (t or "").encode()
        for k in {raw[a : a + n] for a in range(len(raw) - n + 1)}:
            first[k] = min(first[k], i)
    out = []
    for i, (doc, t) in zip(ids, rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - n + 1):
            if first[raw[a : a + n]] < i:
                gone[a : a + n] = b"\1" * n
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_strings(odd, none, odd_rows, monkeypatch, small):
    if small:
        for name, size in (("BLOCK_BYTES", 1 << 14), ("ANCHOR_BUCKET_BYTES", 1 << 13), ("CONTEXT_BUCKET_BYTES", 1 << 12), ("SORT_BYTES", 1 << 9), ("_STRIDE", 1 << 9)):
            monkeypatch.setattr(substrings, name, size)
    got = ordered((r.row.doc_id, *r[1:5]) for r in substrings.repeated(odd).collect())
    assert got == cut_model(odd_rows)
    assert substrings.repeated(none).count() == 0


def test_cut_texts(odd):
    left = substrings.remove_repeats(odd)
    assert left.columns == odd.columns
    texts = defaultdict(list)
    for r in left.collect():
        texts[r.doc_id].append(r.text)
    assert 2 not in texts and texts[4] == [None] and texts[5] == [""] and PASSAGE in texts[-3][0] and PASSAGE not in texts[9][0]


# 8 ---------------------------------------------------------------------------------------------------------------


def test_language(spark, odd, none, odd_rows):
    rng = np.random.default_rng(4)
    kinds = {"en": "the and ing tion of that", "de": "der und ung keit sch ein", "es": "el que ción los ado mente", "xx": "qaq wuw zoz jij"}
    rows = [(i, " ".join(rng.choice(kinds[lang].split(), 30)), lang) for i, lang in enumerate([*kinds] * 60)]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "the and of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=100)
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows if i < 900)
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] == "en"
    rows = language.predict(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert {r.row.doc_id for r in rows if r.lang_pred == "und"} == {4, 5, 6, None}
    assert language.predict(none, model).count() == 0
    assert language.fit(docs.where("lang IS NULL")) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    single = language.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language.predict(docs.where("doc_id < 900"), single).collect()} == {"de"}


# 9 ---------------------------------------------------------------------------------------------------------------


def verdict_model(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return url, host, path, best[1], best[2]


def test_urls(spark):
    rules = [*urlfilter.RULES, ("b.example.com", "/en/x", "block"), ("org", "", "block"), (None, "/", "block"), ("de", None, "allow")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "x://a.b.example.com/en/xy", "http://example.com/en/", "http://notexample.com/en/"]
    urls += ["https://a.net/es/x", "https://a.net/fr", "ftp://org?x/y", "http://u@x.org:80/://z", "http://..com//", "http://é.com/ü/", "http://example.com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for limit in (100, 0):
        got = urlfilter.judge(pages, table, broadcast_rules=limit).collect()
        plain = [r for r in rules if None not in r]
        assert ordered((r.row.url, *r[1:]) for r in got) == ordered(verdict_model(u, plain) for u in urls)
    assert urlfilter.judge(pages.where("false"), table).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, table.where("false")).collect()} == {"allow"}


# 10 --------------------------------------------------------------------------------------------------------------


def classes_model(rows, threshold=0.8):
    def grams(text):
        words = alnum(text)
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])

    sets = [grams(t) for _, t in rows]
    near = [[a != b and bool(x) and len(x & y) >= threshold * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    out = []
    for a, (doc, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(near[todo.pop()]):
                if b not in seen:
                    seen.add(int(b))
                    todo.append(int(b))
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((doc, min(ids, default=None), len(seen), sum(near[a])))
    return ordered(out)


@pytest.mark.parametrize("small", [False, True])
def test_similar_documents(spark, odd, none, odd_rows, monkeypatch, small):
    rows = list(odd_rows)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(200)]
    for i in range(40):
        words = list(base)
        for _ in range(int(rng.integers(0, 8))):
            words[int(rng.integers(0, 200))] = f"v{rng.integers(0, 1000)}"
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    if small:
        for name, size in (("BLOCK_BYTES", 1 << 14), ("NODE_SHARE", 5), ("SET_SHARE", 4), ("NODE_BUCKET_ROWS", 20), ("SET_BUCKET_BYTES", 1 << 14), ("_RARE", 3)):
            monkeypatch.setattr(jaccard, name, size)
    got = ordered((r.row.doc_id, r.class_id, r.class_size, r.n_links) for r in jaccard.join_similar(docs).collect())
    assert got == classes_model(rows)
    if small:
        kept = jaccard.keep_one(odd)
        assert kept.columns == odd.columns
        ids = [r.doc_id for r in kept.collect()]
        # Of the copies of BODY, id 1 stays; of the two null ids left, one is a null text and one a text of its own.
        assert sorted(i for i in ids if i is not None) == [-3, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12, 13] and ids.count(None) == 2
        twice = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 2), (None, "g h i j k l", 3), (None, "g h i j k l", 3)], "doc_id long, text string, h int")
        assert sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one(twice).collect()) == [(0, "g h i j k l"), (7, "a b c d e f")]
    else:
        assert jaccard.join_similar(none).count() == 0


def test_prefixes_reach_the_recall():
    d = jaccard.prefix_depth(0.8, 20, 6, 0.99999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.99999 > 1 - (1 - 0.8 ** (d + 1)) ** 20


def test_sets_stop_at_depths_of_their_own():
    """Every set reaches the recall, with short prefixes where few others are met and long ones in crowded trees."""
    rng = np.random.default_rng(2)
    sizes = np.cumsum(rng.integers(0, 50, (200, 20, 3)), axis=2) + 1
    sizes[0] = 1
    sizes[1, :10] = [1, 1, 1]
    sizes[1, 10:] = [1, 1000, 2000]
    chosen = jaccard.choose_levels(sizes, 0.8, 5, 0.99999)
    missed = np.prod(1 - 0.8 ** (5.0 - chosen), axis=1)
    assert (missed <= 1e-5).all() and (missed > 1e-7).all()
    assert (chosen[1, :10] == 2).all() and chosen[1, 10:].sum() < 20
    assert len({tuple(sorted(c)) for c in chosen}) > 3 and chosen.min() == 0 and chosen.max() == 2
    # One step less in any tree would miss the recall for some set, so prefixes are no shorter than need be.
    for row in chosen[2:]:
        tree = np.argmax(row)
        assert np.prod(1 - 0.8 ** (5.0 - np.where(np.arange(20) == tree, row - 2, row))) > 1e-5


def test_recall_of_the_forest_by_depth():
    """Measured on signatures of pairs at the threshold: longest prefixes miss some, the chosen ones none."""
    rng = np.random.default_rng(4)
    n, trees, depth = 2000, 20, 5
    same = rng.random((n, trees, depth)) < 0.8
    common = np.cumprod(same, axis=2).sum(axis=2)
    recall = {d: (common >= d).any(axis=1).mean() for d in (5, 4, 3)}
    assert 0.99 < recall[5] < 1 and recall[5] <= recall[4] <= recall[3] == 1
    chosen = jaccard.choose_levels(np.cumsum(rng.integers(0, 9, (n, trees, 3)), axis=2) + 1, 0.8, depth, 0.99999)
    assert (common >= depth - chosen).any(axis=1).all()
