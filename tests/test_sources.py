import json
import time

import pytest
from pyspark.sql import functions as F

from lakekit.catalog import Catalog
from lakekit.operators import profile
from lakekit.sources import api, csv, files, sinks, tables

RAGGED = b'\xef\xbb\xbfa,b,c\r\n1,2,3\r\n1,2\r\n\r\n1,2,3,4\r\n"x\ny", ,z\r\n"q""q",,\xff\r\n'


def test_raw_csv_keeps_every_record(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_bytes(RAGGED)
    raw = csv.read_raw_csv(spark, str(path), multi_line=True)
    assert raw.columns == ["a", "b", "c", csv.CELLS, csv.ROW]
    found = [tuple(r) for r in raw.orderBy(csv.ROW).drop(csv.ROW).collect()]
    assert found == [
        ("1", "2", "3", 3),
        ("1", "2", None, 2),
        ("1", "2", "3", 4),
        ("x\ny", " ", "z", 3),
        ('q"q', None, "�", 3),
        (None, None, None, 0),
    ]
    profiled = profile.csv_profile(raw).orderBy("position").collect()
    assert [(r.total_rows, r.inconsistent_rows) for r in profiled] == [(6, 3)] * 3
    assert [r.null_ratio for r in profiled] == [0.0, 0.333, 0.0]


def test_count_of_wrong_records_needs_no_data_column(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b,c\n1,2,3\n1,2\n\n1,2,3,4\n")
    raw = csv.read_raw_csv(spark, str(path))
    counted = {r[csv.CELLS]: r["count"] for r in raw.groupBy(csv.CELLS).count().collect()}
    assert counted == {3: 1, 2: 1, 0: 1, 4: 1}


def test_profile_of_csv_files(spark, tmp_path):
    gauges = tmp_path / "gauges.csv"
    gauges.write_text("day,height,gauge\n2031-05-01,310,west\n2031-05-02,,west\n2031-05-03,290,east\nlater,305,east\n")
    raw = csv.read_raw_csv(spark, str(gauges))
    found = {r.column: r for r in profile.csv_profile(raw).collect()}
    assert list(found) == ["day", "height", "gauge"]
    assert found["height"].total_rows == 4 and found["height"].inconsistent_rows == 0
    assert found["height"].null_ratio == 0.25
    # Three days in four cells are enough.
    assert [r.column for r in profile.date_columns(raw).collect()] == ["day"]
    uneven = tmp_path / "uneven.csv"
    uneven.write_text("x,y\n1,2\n1\n5,6\n")
    assert profile.csv_profile(csv.read_raw_csv(spark, str(uneven))).first().inconsistent_rows == 1


def test_directory_of_csv_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a-b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in" / "deep" / "c.csv").write_text("x\n1\n2\n")
    catalog = Catalog(spark)
    assert catalog.ingest_csv_directory(str(tmp_path / "in")) == 2
    assert {r.table: r.rows for r in catalog.list_tables().collect()} == {"a_b": 1, "c": 2}
    assert catalog.table_schema("a_b") == [{"name": "x", "type": "int"}, {"name": "y", "type": "int"}]
    assert catalog.table_schema("nothing") is None
    assert catalog.schema_context().startswith("Table 'a_b' (1 rows): x (int), y (int)")
    assert list(csv.csv_tables(spark, str(tmp_path / "in"), recursive=False)) == ["a_b"]
    assert list(csv.csv_tables(spark, str(tmp_path / "in"), pattern="c*.csv")) == ["c"]
    (tmp_path / "in" / "deep" / "a-b.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        csv.csv_tables(spark, str(tmp_path / "in"))


def test_metadata_folder(spark, tmp_path):
    def write(name, **fields):
        (tmp_path / f"{name}.json").write_text(json.dumps(fields, indent=1))

    write("b", repo_name="b", repo_url="u/b", mirror_name="m", quality_score=3.5, tags=["x"], other=1)
    write("a", repo_name="a", repo_url="u/a", mirror_name="m")
    write("c", repo_name="c")
    (tmp_path / "bad.json").write_text("{invalid")
    found = tables.read_metadata(spark, str(tmp_path)).select("slug", "quality_score", "tags", "stars").collect()
    assert [tuple(r) for r in found] == [("b", 3.5, ["x"], 0), ("a", 0.0, [], 0)]


def test_payload_shapes(spark):
    shapes = [
        '[{"id":1},{"id":2}]',
        '{"data":[],"items":[{"id":8}]}',
        '{"data":[{"id":3}],"items":[{"id":9}]}',
        '{"results":[]}',
        '{"results":[{"id":4}]}',
        '{"id":5}',
        "[]",
        "not json",
        '{"data":null,"items":[{"id":6}]}',
    ]
    df = spark.createDataFrame(list(enumerate(shapes)), "k int, body string")
    found = api.payload_rows(df, "body", ["k"]).select("k", F.try_variant_get("item", "$.id", "int")).collect()
    assert sorted(map(tuple, found)) == [(0, 1), (0, 2), (2, 3), (4, 4), (5, 5)]


def test_inventory(spark):
    df = spark.createDataFrame(
        [("p/A.CSV", 2048), ("p/.git/config.txt", 1), ("p/.gitignore", 10), ("p/x.tar.gz", 5)], "path string, size bigint"
    )
    found = {r.path: (r.suffix, r.size_human, r.preview) for r in files.inventory(df).collect()}
    assert found == {
        "p/A.CSV": (".csv", "2.0 KB", True),
        "p/.gitignore": ("", "10.0 B", False),
        "p/x.tar.gz": (".gz", "5.0 B", False),
    }


def test_batch_convert_is_incremental(spark, tmp_path):
    source, target = tmp_path / "src", tmp_path / "out"
    (source / "sub dir").mkdir(parents=True)
    (source / "a.csv").write_text("x,y\n1,2\n")
    (source / "sub dir" / "b+c.csv").write_text("x,y\n3,4\n5,6\n")
    (source / "c.csv").write_text("z\nq\n")
    first = sinks.batch_convert(spark, str(source), str(target))
    assert (first["converted"], first["skipped"], first["failed"]) == (3, 0, 0)
    assert sinks.batch_convert(spark, str(source), str(target))["skipped"] == 3
    time.sleep(1.1)
    (source / "a.csv").write_text("x,y\n7,8\n")
    again = sinks.batch_convert(spark, str(source), str(target), delete_original=True)
    assert (again["converted"], again["skipped"]) == (1, 2)
    assert not (source / "a.csv").exists() and (source / "c.csv").exists()
    folder = [f for f in sinks.child_names(spark, str(target)) if "x" in spark.read.parquet(f"{target}/{f}").columns][0]
    found = spark.read.parquet(f"{target}/{folder}").select("source", "x", "y").collect()
    assert sorted(map(tuple, found)) == [("a", 7, 8), ("sub dir/b+c", 3, 4), ("sub dir/b+c", 5, 6)]


def test_exports_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"q', "x")], "k int, s string, t string")
    sinks.export_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, csv.read_csv(spark, str(tmp_path / "c"), schema=df.schema).collect())) == [(1, "a,b", None), (2, 'q"q', "x")]
    sinks.export_json(df, str(tmp_path / "j"), "s", "A,")
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"k":1,"s":"a,b","t":null}'
    repos = spark.createDataFrame(
        [("b", "n/b", "u/b", None), ("a", "n/a", "u/a", "MIT")], "slug string, repo_name string, repo_url string, license string"
    )
    sinks.license_report(repos, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "| 1 | [n/a](u/a) | MIT | u/a |" in text and "| 2 | [n/b](u/b) | Unknown | u/b |" in text
    assert "**1/2** datasets have a detected license." in text


def test_conversion_loses_no_row(spark, tmp_path):
    source, target = tmp_path / "src" / "src", tmp_path / "out"
    source.mkdir(parents=True)
    put = lambda name, text: (source / name).write_text(text)
    put("breaks.csv", 'id,note\n1,"two\nlines"\n2,plain\n')
    put("semi.csv", 'id;u\n1;"a;b"\n2;c\n')
    put("tabs.csv", "id\tu\n1\t2,5\n")
    put("codes.csv", "id,u\n007,x\n")
    put("words.csv", "id,u\nA07,x\n")
    put("long.csv", "id,u\n1,2\n1,2,3\n")
    put("short.csv", "id,u\n1,2\n1\n")
    put("open.csv", 'id,u\n1,"2\n3,4\n')
    put("empty.csv", "")
    put("lines.json", '{"a":1}\n{"a":2}\n{"a":3}\n')
    put("array.json", '[{"a":1},\n {"a":2}]')
    put("one.json", '{\n "a": 5\n}')
    put("bad.json", '{"a":1}\n{"a":\n')
    stats = sinks.batch_convert(spark, str(source), str(target), "*.{csv,json}", delete_original=True)
    left = {p.name for p in source.iterdir() if not p.name.startswith(".")}
    assert left == {"long.csv", "short.csv", "open.csv", "empty.csv", "bad.json"}, stats
    # A file of no bytes is not even listed.
    assert (stats["converted"], stats["failed"]) == (8, 4)
    assert {f["file"]: f["rows"] for f in stats["files"] if f["status"] == "converted"} == {
        "breaks.csv": 2, "semi.csv": 2, "tabs.csv": 1, "codes.csv": 1, "words.csv": 1, "lines.json": 3, "array.json": 2, "one.json": 1,
    }
    found = {}
    for folder in sinks.child_names(spark, str(target)):
        for row in spark.read.parquet(f"{target}/{folder}").collect():
            found.setdefault(row["source"], []).append(tuple(row)[:-1])
    assert sorted(found["breaks"]) == [(1, "two\nlines"), (2, "plain")]
    assert sorted(found["semi"]) == [(1, "a;b"), (2, "c")] and found["tabs"] == [(1, "2,5")]
    assert found["codes"] == [(7, "x")] and found["words"] == [("A07", "x")]
    assert sorted(found["lines"]) == [(1,), (2,), (3,)] and sorted(found["array"]) == [(1,), (2,)]
    assert tables.read_json(spark, str(source / "bad.json"), lines=True).count() == 2


def test_csv_dialect_is_found(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2\n")
    assert csv.read_csv(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "j.json").write_text('{"a":1}\n{"a":2}\n')
    assert tables.read_json(spark, str(tmp_path / "j.json")).count() == 2


def test_directory_whose_name_repeats(spark, tmp_path):
    root = tmp_path / "data" / "x" / "data"
    root.mkdir(parents=True)
    (root / "a.csv").write_text("x\n1\n")
    assert list(csv.csv_tables(spark, str(root), recursive=False)) == ["a"]
