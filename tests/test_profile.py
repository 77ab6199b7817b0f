import random
import re

import pytest
from pyspark.sql import functions as F

from lakekit.functions import text
from lakekit.operators import browse, profile
from lakekit.operators.ordering import first_per_key

CELLS = ["1", "-2.5", " 3 ", "1e3", "1d", "NaN", "0x1p3", "1_0", "", " ", " ", "abc", "2024-01-01", "12:30", "10.0.0.1", ".5", "5.", "+7", "x1", "1\t"]


def number(cell):
    """A decimal number the way Python reads it, without underscores, nan and inf."""
    if "_" in cell or cell.strip().lower().lstrip("+-") in ("nan", "inf", "infinity"):
        return None
    try:
        return float(cell)
    except ValueError:
        return None


def number_like(cell):
    """At least one digit, and nothing but digits, dots and dashes."""
    return bool(re.fullmatch(r"[.\-]*[0-9][0-9.\-]*", cell))


@pytest.mark.parametrize("cell", CELLS)
def test_number_and_blank(spark, cell):
    row = spark.createDataFrame([(cell,)], "c string").select(
        text.to_number(F.col("c")), text.is_blank(F.col("c")), text.is_number_like(F.col("c"))
    ).first()
    assert tuple(row) == (number(cell), cell.strip() == "", number_like(cell))


def random_rows(seed, n=60, width=4):
    rng = random.Random(seed)
    pools = [CELLS, ["1", "2.5", "3", "x"], ["", " ", "a"], ["7", "8.25", "-1"]]
    return [tuple(rng.choice(pools[i % 4]) for i in range(width)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_column_stats_against_a_model(spark, seed):
    data = random_rows(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "k int, a string, b string, c string, d string")
    names = ["a", "b", "c", "d"]
    found = profile.column_stats(df, names).collect()
    assert found == profile.column_stats_from(profile.long_measures(df, names)).orderBy("position").collect()
    for i, r in enumerate(sorted(found, key=lambda r: r.position)):
        cells = [row[i] for row in data]
        filled = [c for c in cells if c.strip()]
        numbers = [number(c) for c in filled if number(c) is not None]
        assert r.null_ratio == round((len(cells) - len(filled)) / len(cells), 3)
        assert r.numeric == (bool(numbers) and len(numbers) > len(filled) * 0.5)
        if r.numeric:
            assert r["count"] == len(numbers)
            assert r.mean == pytest.approx(round(sum(numbers) / len(numbers), 3), abs=0.0011)
            assert (r.min, r.max) == (round(min(numbers), 3), round(max(numbers), 3))


def test_typed_and_text_statistics_agree(spark):
    df = spark.range(500).select(
        "id", (F.col("id") * 0.37).alias("x"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("gaps")
    )
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    assert profile.column_stats(df).collect() == profile.column_stats(as_text).collect()


@pytest.mark.parametrize(
    "cells, guess, nullable",
    [
        (["1", "22", "", "-"], "string", True),
        (["1", "22", ""], "int", True),
        (["1", "22"] * 5 + ["x", ""], "int", False),
        (["1.5", "2", " "], "float", True),
        (["1.5-2", "3"], "float", False),
        (["2024-01-01", "1-2"], "date", False),
        (["1-2", "2024-01-01"], "string", False),
        (["", "2024-01-01", "5"], "date", True),
        (["a", "1"], "string", False),
        (["", " "], "string", True),
        ([None, "7"], "int", True),
    ],
)
def test_type_guess(spark, cells, guess, nullable):
    df = spark.createDataFrame(list(enumerate(cells)), "k int, c string").repartition(3)
    found = profile.infer_types(df, "k", ["c"]).first()
    assert (found.type_guess, found.nullable) == (guess, nullable)


@pytest.mark.parametrize("pool", [["3", "20", "1.5", "-4"], ["b", "a", "", "C"], ["1", "a"], ["2024-01-01", "1"], ["1", ""]])
@pytest.mark.parametrize("descending", [False, True])
def test_adaptive_sort_against_a_model(spark, pool, descending):
    rng = random.Random(len(pool))
    data = [(i, rng.choice(pool)) for i in range(40)]
    df = spark.createDataFrame(data, "k int, c string").repartition(4)
    cells = [c for _, c in data]
    if all(number_like(c) and number(c) is not None for c in cells):
        expected = sorted(data, key=lambda r: float(r[1]), reverse=descending)
    elif not any(number_like(c) for c in cells):
        expected = sorted(data, key=lambda r: r[1], reverse=descending)
    else:
        expected = data
    assert [tuple(r) for r in browse.rows_sort(df, "c", "k", descending).collect()] == expected


def test_filter_page_preview(spark):
    df = spark.createDataFrame([(i, f"Name{i}" if i % 2 else None) for i in range(30)], "k int, c string")
    assert browse.rows_filter(df, "c", "NAME1").count() == 6
    assert browse.rows_filter(df, "unknown", "x").count() == 30
    assert tuple(browse.rows_totals(df, "c", "name1").first()) == (30, 6)
    page = browse.rows_page(df.orderBy("k"), limit=5, offset=10)
    assert [r.k for r in page.collect()] == [10, 11, 12, 13, 14]
    shown = browse.preview(df, "k", rows=10).collect()
    assert len(shown) == 10 and shown[0].truncated and shown[0].total_rows == 10
    placed = browse.number_sorted(df.withColumn("c", F.col("k").cast("string")), "c", "k", "place", descending=True)
    assert sorted((r.place, r.k) for r in placed.collect()) == [(i + 1, 29 - i) for i in range(30)]


def test_chart_series_drops_pairs(spark):
    df = spark.createDataFrame([(0, "a", "1"), (1, "b", "n/a"), (2, None, "3kg")], "k int, x string, y string")
    assert [tuple(r) for r in browse.chart_series(df, "x", "y", "k").collect()] == [(0, "a", 1.0), (2, "", 3.0)]


def test_wide_tables_are_measured_in_parts(spark, monkeypatch):
    df = spark.range(20).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(7)])
    whole = profile.column_stats(df).collect()
    monkeypatch.setattr(profile, "WIDE_COLUMNS", 3)
    assert profile.column_stats(df).orderBy("position").collect() == whole


def test_content_preview(spark):
    df = spark.createDataFrame([("a.json", ".json", 9, '{"a":"é"}'), ("b.json", ".json", 2, "{x"), ("c.bin", ".bin", 2048, "z")],
                               "path string, suffix string, size bigint, content string")
    found = [tuple(r) for r in browse.content_preview(df, 12, indent_json=True).collect()]
    assert found == [("a.json", "json", '{\n  "a": "é"', None), ("b.json", "json", "{x", None), ("c.bin", "binary", None, "2.0 KB")]


def test_guesses_for_many_tables(spark):
    one = spark.createDataFrame([(-20, "x"), (-3, "1")], "k int, v string")
    two = spark.createDataFrame([("b", "2.5"), ("a", "1")], "k string, v string")
    tables = {"one": (one, "k"), "two": (two, "k"), "bad": (two, "missing")}
    found = {(r.table, r["column"]): (r.type_guess, r.error) for r in profile.infer_types_batch(tables).collect()}
    assert found[("one", "v")] == ("string", None) and found[("two", "v")] == ("float", None)
    assert "missing" in found[("bad", None)][1]


@pytest.mark.parametrize("seed", range(3))
def test_date_columns_of_short_records_against_a_model(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(80):
        cells = [rng.choice(["2024-01-01", "2024-01-01 ", "2024-1-1", ""] if rng.random() < 0.35 else ["2024-05-06"]) for _ in range(3)]
        size = rng.choice([0, 1, 2, 3, 3, 4]) if seed else 3
        data.append((i, *[c if j < size else None for j, c in enumerate(cells)], size))
    df = spark.createDataFrame(data, f"_row int, a string, b string, c string, {profile.CELLS} int").repartition(3)
    expected = []
    for j, name in enumerate("abc"):
        cells = [r[j + 1] for r in data if r[4] > j][:20]
        dates = sum(bool(re.match(r"^\d{4}-\d{2}-\d{2}$", c.strip())) for c in cells)
        if len(cells) >= 3 and dates / len(cells) >= 0.7:
            expected.append(name)
    assert sorted(r["column"] for r in profile.date_columns(df).collect()) == expected


def test_whole_columns_on_request(spark):
    data = [(i, str(i), "2024-01-01" if i < 20 else "later") for i in range(60)]
    data[40] = (40, "", "later")
    data[50] = (50, "1.5", None)
    df = spark.createDataFrame(data, "k int, n string, d string").repartition(3)
    assert [r["column"] for r in profile.date_columns(df, "k").collect()] == ["d"]
    assert profile.date_columns(df, "k", rows=None).collect() == []
    found = {r["column"]: (r.type_guess, r.nullable) for r in profile.infer_types(df, "k", ["n", "d"], rows=None).collect()}
    assert found == {"n": ("float", True), "d": ("string", True)}
    two = spark.createDataFrame([("b", "2")], "k string, n string")
    many = profile.infer_types_batch({"one": (df, "k"), "two": (two, "k"), "bad": (two, "missing")}, rows=None).collect()
    found = {(r.table, r["column"]): r.type_guess for r in many}
    assert found[("one", "n")] == "float" and found[("two", "n")] == "int" and found[("bad", None)] is None


def test_many_rows_per_key(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id").repartition(5)
    found = first_per_key(df, ["k"], [F.col("id")], 1500)
    assert sorted(r.id for r in found.collect()) == list(range(3000))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k int, c string")
    stats = profile.column_stats(empty).collect()
    assert [(r.total_rows, r.null_ratio, r.numeric) for r in stats] == [(0, 0.0, False)] * 2
    assert profile.chart_suggestion(empty, "q").first().chart_type == "table"


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1536, 1024**2, 1024**5, 1024**6]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint").select(text.human_size(F.col("s")))
    assert [r[0] for r in df.collect()] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 PB", "1024.0 PB"]
