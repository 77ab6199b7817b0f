"""The pipeline, stage by stage, against plain models over the small driver tables."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import classes_model, hits_model, repeats_model, visible

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")


def passes(text):
    n, _, _, _, repeated = repeats_model(text)
    words = visible(text)
    long = Counter(tuple(words[i : i + 101]) for i in range(len(words) - 100))
    return n >= 10 and 100 * repeated <= 20 * n and max(long.values(), default=0) < 2


def cut(docs, n=50):
    first = defaultdict(lambda: math.inf)
    for i, t in docs:
        raw = t.encode()
        for k in {raw[a : a + n] for a in range(len(raw) - n + 1)}:
            first[k] = min(first[k], i)
    for i, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - n + 1):
            if first[raw[a : a + n]] < i:
                gone[a : a + n] = b"\1" * n
        if raw and all(gone):
            continue
        yield i, bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")


def test_every_stage(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from lakekit.llm.packing import vocabulary_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    def among(rows, ids):
        return [x for x in rows if x[0] in ids]

    models = [
        lambda d: [x for x in d if passes(x[1])],
        lambda d: among(d, {c[1] for c in classes_model(d)}),
        lambda d: list(cut(d)),
        lambda d: among(d, {h[0] for h in hits_model(d, items, 10) if not h[2]}),
    ]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = []
    for (_, stage), model in zip(corpus_pipeline.STAGES, models, strict=False):
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        plain = model(plain)
        assert docs.columns == names
        rows = docs.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(plain)
        sizes.append(len(rows))
    assert all(r.n_chars == len(r.text) for r in rows) and len(set(sizes)) > 2
    tokenizer = Tokenizer.from_file(vocabulary_path())
    expected = Counter()
    for i, t in plain:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            expected[i, at, zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in packed) == expected


def test_run_hands_each_stage_what_the_last_one_kept(spark, monkeypatch):
    import corpus_pipeline

    stages = [corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[-1]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    kept = stages[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    expected = stages[1][1](spark, kept, SF)
    pieces = lambda df: sorted((r.doc_id, r.start, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, SF)) == pieces(expected)
