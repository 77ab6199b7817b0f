"""CSV with line breaks inside quotes, damaged files, and the types of many files."""

import csv as python_csv
import io
import random
import tracemalloc
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakekit.catalog import Catalog
from lakekit.operators import profile
from lakekit.sources import csv, inspect, records, sinks

CELLS = ["a", "x,y", 'he said "hi"', "l1\nl2", 'l1\r\nl2\n\n"q"\n,', "", " ", '5" pipe', "é ü", "'"]


@pytest.fixture
def splits(spark):
    """Cut files into splits of a few bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in keys}

    def cut(size, batch=10_000):
        for key, value in zip(keys, (size, 1, batch), strict=True):
            spark.conf.set(key, value)

    yield cut
    for key, value in before.items():
        spark.conf.set(key, value)


def random_file(seed, rows, path):
    rnd, out, found = random.Random(seed), io.StringIO(), []
    writer = python_csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"]))
    for _ in range(rows):
        row = [rnd.choice(CELLS) for _ in range(3)]
        writer.writerow(row)
        found.append(row)
    text = out.getvalue()
    # The last line may lack its end.
    path.write_text(text.rstrip("\r\n") if seed % 2 and not text.rstrip("\r\n").endswith('"\r') else text, newline="")
    return found


@pytest.mark.parametrize(("size", "batch", "broadcast"), [(40, 7, True), (300, 3, False), (10**6, 10_000, True)])
def test_records_equal_the_standard_reader_wherever_splits_begin(spark, splits, tmp_path, monkeypatch, size, batch, broadcast):
    splits(size, batch)
    if not broadcast:
        monkeypatch.setattr(records, "BROADCAST_SPLITS", 0)
    wanted = {f"f {i}+%.csv": random_file(i * size, n, tmp_path / f"f {i}+%.csv") for i, n in enumerate((0, 1, 30, 90))}
    found, files = records.quoted_records(spark, str(tmp_path))
    names = {r.file: r.path.rsplit("/", 1)[1] for r in records.file_names(spark, str(tmp_path)).collect()}
    got = {name: [] for name in wanted}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got[names[r.file]].append((r.header, next(python_csv.reader(io.StringIO(r.record, newline="")), [])))
    for name, rows in wanted.items():
        assert [cells for _, cells in got[name]] == [r if r != [""] else [] for r in rows]
        assert [header for header, _ in got[name]] == [i == 0 for i in range(len(rows))]
    assert not any(r.unclosed for r in files.collect())


def test_a_quote_inside_a_cell_opens_nothing(spark, splits, tmp_path):
    splits(16)
    (tmp_path / "t.csv").write_text('size,n\n5" pipe,1\n"2"" rod",2\n3" x 4",3\n')
    found = csv.read_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, found.collect())) == [('2" rod', 2), ('3" x 4"', 3), ('5" pipe', 1)]
    assert not csv.has_quoted_breaks(spark, str(tmp_path / "t.csv"))


def test_typed_table_of_quoted_line_breaks_in_many_tasks(spark, splits, tmp_path):
    rows = [(i, f'line {i}\n"quoted", and\r\n\nmore' if i % 3 else "plain", i / 4) for i in range(200)]
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part in range(2):
        with open(folder / f"part-{part}.csv", "w", newline="", encoding="utf-8-sig") as out:
            writer = python_csv.writer(out)
            writer.writerow(["id", "note", "share"])
            writer.writerows(rows[part::2])
    splits(500)
    table = csv.read_csv(spark, str(folder))
    assert [f.dataType.simpleString() for f in table.schema] == ["int", "string", "double"]
    assert sorted(map(tuple, table.collect())) == rows
    plan = table._jdf.queryExecution().toString()
    assert "wholetext" not in plan.lower() and "multiline" not in plan.lower().replace("(multiline,true)", "")
    assert table.rdd.getNumPartitions() > 10
    assert Catalog(spark).ingest_csv("t", str(folder)) == 200
    # Columns are read by the schema given, and all text without inference.
    assert csv.read_csv(spark, str(folder), "id bigint, note string, share float").select("id").distinct().count() == 200
    assert dict(csv.read_csv(spark, str(folder), infer=False).dtypes)["id"] == "string"
    raw = csv.read_raw_csv(spark, str(folder), multi_line=True).orderBy(csv.ROW)
    assert [r.id for r in raw.collect()] == [str(r[0]) for part in range(2) for r in rows[part::2]]


@pytest.mark.parametrize("breaks", [False, True])
def test_damaged_records_raise_or_are_left_out(spark, tmp_path, breaks):
    cell = '"a\nb"' if breaks else '"a b"'
    path, target = str(tmp_path / "d.csv"), str(tmp_path / "out")
    (tmp_path / "d.csv").write_text(f"id,u\n1,{cell}\n1,2,3\n4\n\n5,6\n")
    with pytest.raises(Exception, match="(?i)damaged|malformed"):
        csv.read_csv(spark, path).collect()
    assert sorted(r.id for r in csv.read_csv(spark, path, damaged="drop").collect()) == [1, 5]
    assert sorted(r.id for r in csv.read_csv(spark, path, damaged="keep").collect()) == [1, 1, 4, 5]
    schema = csv.read_csv(spark, path, damaged="keep").schema
    assert sorted(r.record for r in csv.damaged_records(spark, path, schema, breaks, ",").collect()) == ["1,2,3", "4"]
    with pytest.raises(ValueError, match="2 damaged records"):
        sinks.csv_to_parquet(spark, path, target)
    assert not (tmp_path / "out").exists()
    sinks.csv_to_parquet(spark, path, target, damaged="drop")
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(ValueError, match="damaged is one of"):
        csv.read_csv(spark, path, damaged="lose")


def test_an_unclosed_quote_raises(spark, tmp_path):
    (tmp_path / "o.csv").write_text('id,u\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="never closed"):
        csv.read_csv(spark, str(tmp_path / "o.csv"))


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"a\nb",c\n')
    table = csv.read_csv(spark, str(tmp_path / "h.csv"))
    assert table.columns == ["a\nb", "c"] and table.count() == 0
    assert csv.column_names(["x", None, "X", "y", ""]) == ["x0", "_c1", "X2", "y", "_c4"]


def test_json_conversion_keeps_damage_out(spark, tmp_path):
    path, target = str(tmp_path / "j.json"), str(tmp_path / "out")
    (tmp_path / "j.json").write_text('{"a":1}\n{"a":\n{"a":3}\n')
    with pytest.raises(ValueError, match="1 damaged values"):
        sinks.json_to_parquet(spark, path, target)
    with pytest.raises(ValueError, match="1 damaged values"):
        sinks.json_to_parquet(spark, path, target, schema="a int")
    assert not (tmp_path / "out").exists()
    sinks.json_to_parquet(spark, path, target, damaged="drop")
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1,), (3,)]
    (tmp_path / "n.json").write_text("[1, 2]")
    with pytest.raises(ValueError, match="no JSON objects"):
        sinks.json_to_parquet(spark, str(tmp_path / "n.json"), target)


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    result = work()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, jobs


def many_files(folder, n):
    folder.mkdir()
    for i in range(n):
        kind = i % 5
        text = {
            0: f"id,name\n{i},x\n{2**40 if i % 10 else 3},y\n",
            1: f"a{i};b;c\n1,5;2024-01-0{i % 9 + 1};true\n;2024-02-01;FALSE\n",
            2: f'k{i}\tv\n1\t"two\nlines"\n2.5\tx\n',
            3: '{"n":1,"s":"x","in":{"z":[1,2.5]}}\n{"n":2.5,"t":null}\n',
            4: f'[{{"id":{i},"x y":"1"}},\n {{"id":null,"x y":2}}]',
        }[kind]
        (folder / f"f{i}.{'json' if kind > 2 else 'csv'}").write_text(text)


def test_types_of_many_files_take_the_same_few_jobs(spark, tmp_path):
    found = {}
    for n in (5, 40):
        folder = tmp_path / str(n)
        many_files(folder, n)
        paths = [r.path for r in records.file_names(spark, str(folder)).collect()]
        found[n] = jobs_of(spark, lambda paths=paths: inspect.inspect_files(spark, paths))
    # Adaptive plans start a job for each stage, and Spark lists more than 32 paths in jobs of their own.
    assert found[40][1] - found[5][1] <= 5 and found[40][1] < 60
    forms = {p.rsplit("/f", 1)[1]: f for p, f in found[40][0].items()}
    assert len(forms) == 40 and not any(f.error for f in forms.values())

    def kinds(name):
        return [(f.name, f.dataType.simpleString()) for f in forms[name].schema]

    assert kinds("0.csv") == [("id", "int"), ("name", "string")] and kinds("5.csv") == [("id", "bigint"), ("name", "string")]
    assert kinds("11.csv") == [("a11", "string"), ("b", "date"), ("c", "boolean")] and forms["11.csv"].delimiter == ";"
    assert kinds("2.csv") == [("k2", "double"), ("v", "string")] and forms["2.csv"].whole and not forms["0.csv"].whole
    assert kinds("3.json") == [("in", "struct<z:array<double>>"), ("n", "double"), ("s", "string"), ("t", "string")]
    assert kinds("4.json") == [("id", "bigint"), ("x y", "string")] and forms["4.json"].whole


def test_inspection_tells_damage(spark, tmp_path):
    texts = {
        "long.csv": "a,b\n1,2\n1,2,3\n", "short.csv": "a,b\n1\n", "open.csv": 'a,b\n1,"x\n', "blank.csv": "\n \n", "ok.csv": "\n\na\n\n7\n\n",
        "bad.json": '{"a":1}\n{"a"\n', "list.json": "[1,2]", "mixed.json": '{"a":1}\n[2]\n', "none.csv": "a,b\n", "nulls.csv": "a,b\n,1\n,2\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    paths = [r.path for r in records.file_names(spark, str(tmp_path)).collect()]
    forms = {p.rsplit("/", 1)[1]: f for p, f in inspect.inspect_files(spark, paths).items()}
    errors = {n: f.error for n, f in forms.items()}
    assert errors == {
        "long.csv": "1 damaged records", "short.csv": "1 damaged records", "open.csv": "a quote is never closed", "blank.csv": "no readable records",
        "ok.csv": None, "bad.json": "damaged JSON", "list.json": "no JSON objects", "mixed.json": "damaged JSON", "none.csv": None, "nulls.csv": None,
    }
    assert forms["ok.csv"].schema.simpleString() == "struct<a:int>"
    assert inspect.merged_schema([forms["none.csv"].schema, forms["nulls.csv"].schema]).simpleString() == "struct<a:string,b:int>"
    assert inspect.merged_schema([forms["ok.csv"].schema, forms["none.csv"].schema]) is None
    assert inspect.inspect_files(spark, []) == {}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("OBJECT<`a b`: BIGINT, c: OBJECT<d: ARRAY<DECIMAL(21,1)>>, e: VOID>", "struct<a b:bigint,c:struct<d:array<double>>,e:string>"),
        ("OBJECT<`VOID: x`: VARIANT, `DECIMAL(3,1)`: DECIMAL(20,0), f: BOOLEAN>", "struct<VOID: x:string,DECIMAL(3,1):decimal(20,0),f:boolean>"),
    ],
)
def test_types_of_json_values(spark, text, kind):
    assert inspect.variant_type(text).simpleString() == kind


def test_directory_of_part_files_and_damaged_tables(spark, tmp_path):
    root = tmp_path / "in"
    (root / "deep" / "t.csv").mkdir(parents=True)
    for i, rows in enumerate(("1,\n2,\n", "3.5,2024-01-01\n", "")):
        (root / "deep" / "t.csv" / f"part-{i}.csv").write_text("x,d\n" + rows)
    (root / "bad.csv").write_text("a,b\n1\n")
    (root / "breaks.csv").write_text('a,b\n1,"x\ny"\n')
    tables = inspect.read_csv_directory(spark, str(root))
    assert sorted(tables) == ["breaks", "t"] and dict(tables["t"].dtypes) == {"x": "double", "d": "date"}
    assert sorted(r.x for r in tables["t"].collect()) == [1.0, 2.0, 3.5] and tables["breaks"].first().b == "x\ny"
    texts = inspect.read_csv_directory(spark, str(root), as_text=True)
    assert dict(texts["t"].dtypes) == {"x": "string", "d": "string"}
    assert profile.column_stats(tables["t"]).count() == 2
    assert tables["t"].agg(F.sum("x")).first()[0] == 6.5


def test_memory_of_python_follows_a_piece_and_not_the_batch():
    """One batch of 32 MB of quoted lines goes through each step, and every record comes out."""
    n, line = 4000, '"' + "é, " * 2000 + '",7'
    numbers = {c: pa.array([v] * n, pa.int64()) for c, v in {"file": 1, "start": 0, "first_id": 0, "id": 0, "head": 0, "tail": n, "width": 2}.items()}
    columns = numbers | {"value": pa.array([line] * n), "record": pa.array([line] * n), "delimiter": pa.array([","] * n)}
    steps = {
        "walked": (lambda it: records._summary(it, ","), ("value", "file", "start", "id"), 1),
        "cut": (lambda it: records._cut(it, ","), ("value", "file", "start", "head", "tail"), n),
        "cells": (inspect._cell_rows, ("file", "start", "record", "delimiter", "width"), 2 * n),
    }
    for name, (step, taken, rows) in steps.items():
        batch = pa.RecordBatch.from_arrays([columns[c] for c in taken], list(taken))
        tracemalloc.start()
        assert sum(b.num_rows for b in step(iter([batch]))) == rows, name
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12e6, (name, peak)
