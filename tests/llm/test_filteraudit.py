"""Operator 13 against a plain walk through every order."""

import re
from itertools import permutations

import numpy as np
import pytest
from llm_rows import BODY

from lakekit.llm import filteraudit

LONG = " ".join(f"w{i}" for i in range(220))
TEXTS = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "de"), (2, LONG, "fr"), (3, LONG + " #", "en"), (4, LONG + " #", "en"), (5, "AB " * 250, "en"),
    (6, "AB " * 250, None), (7, None, ""), (8, "", "en"), (9, "a" * 40000, "en"), (10, "x y " * 60000, "de"), (11, LONG.replace("w1 ", "W1 "), "de"),
    (None, LONG, "en"), (None, "alone", "en"), (None, None, None), (12, BODY + "|", "en"), (0, BODY + "|", "de"), (13, "\x85 \x1f   É", "en"),
    (14, "AAA b", "en"), (15, "A" * 3 + "b" * 97, "en"), (16, "A" * 4 + "b" * 96, "en"), (17, "a a", "en"), (18, "a a a", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 0, None), (None, 1, 1), (14, 1, 1), (99, 1, 1), (12, 1, 0)]
SCHEMA = "doc_id long, text string, lang string, id string, failed string, part string, possible string, digest string, n string"


def failing(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and i > least[t],
        }
        yield i, lang or "", {k for k, v in fails.items() if v}


def model(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    docs, out, shares = list(failing(rows)), [], {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                again = sum(x in f for _, f in own) - len(gone)
                only = sum(f == {x} for _, f in own)
                shares[part, x] = shares.get((part, x), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), again, only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def found(df):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in df.select(*names).collect())


def frames(spark, rows=TEXTS, labels=LABELS):
    docs = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(*r, "x", "y") for r in labels], "doc_id long, quality int, toxic int, good string, id string")


@pytest.mark.parametrize("size", [None, 0])
def test_audit_equals_a_walk_through_every_order(spark, monkeypatch, size):
    if size is not None:
        # A sketch so small that it clears nothing.
        monkeypatch.setattr(filteraudit, "SKETCH_BYTES", 0)
        monkeypatch.setattr(filteraudit, "SHARE_BITS", 3)
        monkeypatch.setattr(filteraudit, "_GATHER", 1)
    docs, labels = frames(spark)
    known = filteraudit.counts(filteraudit.failed_filters(docs), labels)
    assert found(filteraudit.interactions(known)) == model(TEXTS, LABELS)


def test_flags_of_every_document(spark):
    docs, _ = frames(spark)
    got = sorted(((r.id, r.part, r.failed) for r in filteraudit.failed_filters(docs).collect()), key=repr)
    assert got == sorted(((i, p, sum(1 << "ABCDE".index(x) for x in f)) for i, p, f in failing(TEXTS)), key=repr)


def test_empty_tables_and_odd_names(spark):
    docs, labels = frames(spark)
    none = filteraudit.failed_filters(docs.where("false"))
    assert none.collect() == [] and found(filteraudit.interactions(filteraudit.counts(none, labels))) == []
    known = filteraudit.counts(filteraudit.failed_filters(docs), labels.where("false"))
    assert found(filteraudit.interactions(known)) == model(TEXTS, [])
    odd = docs.selectExpr("doc_id AS `my id`", "text AS `a.b`", "lang AS `x-y`")
    flags = filteraudit.failed_filters(odd, "my id", "a.b", "x-y")
    assert flags.count() == len(TEXTS)


def test_sketch_clears_single_texts_and_no_others(spark):
    rows = [(f"text {i}",) for i in range(5000)] + [(f"text {i}",) for i in range(0, 5000, 50)] + [("hot",)] * 3000
    texts = spark.createDataFrame(rows, "text string").repartition(7)
    possible = filteraudit.possible_repeats(spark, filteraudit.sketch(texts))
    kept = [r.text for r in texts.where(possible(*filteraudit._hashes(texts.text))).collect()]
    repeated = {f"text {i}" for i in range(0, 5000, 50)} | {"hot"}
    assert repeated <= set(kept) and kept.count("hot") == 3000
    # Three probes at one text for eight cells or more let few single texts pass.
    assert len(set(kept) - repeated) < 0.05 * 4900


def test_any_number_of_letters(spark):
    known = spark.createDataFrame([("p", 3, 5, 1, 2), ("p", 0, 7, 0, 0)], "part string, failed int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in filteraudit.interactions(known, "XY").collect()}
    assert len(rows) == 4 and rows["XY", 1].removed == 5 and rows["XY", 2].redundant == 5 and rows["YX", 2].shapley == 5
    assert np.sum([r.kept for r in rows.values()]) == 28
