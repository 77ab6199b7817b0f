"""Operator 11 against the library's own encoder, over odd rows and random texts."""

import hashlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import BODY
from pyspark.sql import types as T

from lakekit.llm import bytebpe


def library():
    return bytebpe._encoding(bytebpe.ranks_path(), bytebpe.words_pattern())


def model(rows):
    return sorted(((i, library().encode_ordinary(t or "")) for i, t in rows), key=repr)


def found(df):
    return sorted(((r[0], r.ids) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_ids_equal_the_library(odd, none, odd_rows, monkeypatch, small):
    if small:
        # Many blocks, a bucket for each, few blocks to a group, and texts beyond a block.
        for name, value in (("BLOCK_BYTES", 500), ("BLOCK_ROWS", 2), ("GROUP", 3), ("BLOCKS_PER_BUCKET", 1), ("_LONG", 400)):
            monkeypatch.setattr(bytebpe, name, value)
    encoded = bytebpe.encode(odd)
    assert found(encoded) == model(odd_rows)
    texts = sorted(((r.doc_id, bytes(r.bytes)) for r in bytebpe.decode(encoded).collect()), key=repr)
    assert texts == sorted(((i, (t or "").encode()) for i, t in odd_rows), key=repr)
    assert bytebpe.encode(none).collect() == [] and bytebpe.decode(bytebpe.encode(none)).collect() == []


def test_names_and_kinds_of_columns(spark):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("my id", "a.b", "ids", "block")])
    rows = spark.createDataFrame([("x", "Hello world", "1", "2"), (None, None, None, None), ("x", "", "", "")], schema)
    encoded = bytebpe.encode(rows, doc_id="my id", text="a.b")
    assert encoded.columns == ["my id", "ids"]
    assert found(encoded) == model([("x", "Hello world"), (None, None), ("x", "")])
    assert sorted(bytes(r["bytes"]) for r in bytebpe.decode(encoded, doc_id="my id").collect()) == [b"", b"", b"Hello world"]


def test_decoding_takes_any_lists(spark):
    rows = spark.createDataFrame([(1, [0, 50255, 0]), (2, []), (3, None)], "doc_id int, ids array<int>")
    table = {i: t for t, i in bytebpe.read_ranks(bytebpe.ranks_path()).items()}
    got = {r.doc_id: r.bytes for r in bytebpe.decode(rows).collect()}
    assert bytes(got[1]) == table[0] + table[50255] + table[0] and bytes(got[2]) == b"" and got[3] is None
    for wrong in ([50256], [-1]):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bytebpe.decode(spark.createDataFrame([(1, wrong)], "doc_id int, ids array<int>")).collect()


def test_blocks_are_cut_and_shuffled_once(odd):
    plan = bytebpe.encode(odd)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_alone_as_in_their_text(text):
    words = regex.findall(bytebpe.words_pattern(), text)
    assert "".join(words) == text
    assert [i for w in words for i in library().encode_ordinary(w)] == library().encode_ordinary(text)


def test_query_over_a_table(spark, tmp_path):
    rows = [(i, BODY[: 7 * i]) for i in range(40)] + [(50, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in bytebpe.op11_byte_bpe(spark, str(tmp_path)).collect())
    expected = []
    for i, ids in model(rows):
        text = dict(rows)[i] or ""
        digests = (hashlib.sha256(x).hexdigest() for x in (np.array(ids, dtype="<u4").tobytes(), text.encode()))
        expected.append((i, len(ids), *digests))
    assert got == sorted(expected)
