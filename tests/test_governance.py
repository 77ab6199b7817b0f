import re

import pytest
from pyspark.sql import functions as F

from lakekit.functions.fixed import LICENSE_REGEXES, PII_WORDS, README_API_REGEXES
from lakekit.operators import corpus, governance, quality
from lakekit.lake import lake_file_records, lake_projects

PROJECT = [
    ("p", "README.md", "Tide gauges of two harbours."),
    ("p", "LICENSE", "Terms: the MIT License applies."),
    ("p", "data.csv", "gauge,height\nwest,310\neast,290\n"),
    ("q", "COPYING", "GNU General Public"),
    ("q", "LICENSE.md", "nothing known"),
    ("q", "docs/LICENSE", "BSD License"),
    ("q", "docs/openapi.yml", "x"),
    ("q", "src/a.py", "x = 1"),
    ("q", "src/b.py", "x ="),
    ("q", "meta.json", '{"a": NaN}'),
    ("q", "bad.json", "{invalid"),
    ("q", "doc.xml", "<a><b/><b/></a>"),
    ("q", "ReadMe.adoc", "See https://x.org/API/v1 " + "x" * 600),
    ("r", "blank.csv", "\nname\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    data = [(r, f"{r}/{n}", n.split("/")[-1], "." + n.rsplit(".", 1)[-1] if "." in n else "", len(t.encode()), t) for r, n, t in PROJECT]
    return spark.createDataFrame(data, "repo string, path string, name string, suffix string, size bigint, content string")


def test_license_of_projects(files):
    found = {r.repo: (r.license, r.license_file_path) for r in governance.license_by_repo(files).collect()}
    assert found == {"p": ("MIT", "LICENSE"), "q": (None, "LICENSE.md")}


def license_model(content):
    for kind, regexes in LICENSE_REGEXES.items():
        if any(re.search(r, content, re.IGNORECASE) for r in regexes):
            return kind
    return None


LICENSE_TEXTS = [
    "mit   license", "MIT\nLicense", "MITLicense", "Apache License\nVersion 2.0", "Apache License, Version 2.0", "gplV3", "GPLv4",
    "cc0 1.0", "CC0 1x0", "dedicate this to the public domain", "dedicate\npublic domain", "bsd\tlicense",
    "Redistribution and use in source and binary forms", "MIT License", "Lıcensed under the Apache Lİcense", "x" * 1999 + "MIT License",
]


def test_license_texts_against_the_patterns(spark):
    df = spark.createDataFrame([(t,) for t in LICENSE_TEXTS], "t string").select(
        governance.license_of(F.col("t")), governance.license_of(F.col("t"), 2000)
    )
    assert [tuple(r) for r in df.collect()] == [(license_model(t), license_model(t[:2000])) for t in LICENSE_TEXTS]


def test_personal_data_columns(spark):
    names = ["id", "email_address", "PHONE", "last_name", "ip_address", "unzipped", "e-mail", "Tax_ID", "date", "value"]
    df = spark.createDataFrame([("t", n) for n in names], "dataset string, column string")
    found = {(r["column"], r.pii_kind) for r in governance.pii_columns(df).collect()}
    expected = {(n, k) for n in names for k, words in PII_WORDS.items() if re.search("|".join(words), n, re.IGNORECASE)}
    assert found == expected
    assert ("ip_address", "address") in found and ("email_address", "address") in found
    summary = governance.pii_by_file(df, ["dataset"]).first()
    assert (summary.pii_flagged, summary.findings) == (True, len(expected))
    assert summary.pii_fields == "address,email,ip,name,phone,ssn"


def test_readme_patterns(spark):
    texts = ["see /api/v2", "/api/x", "GraphQL", "rest   api", "http://x/apis", "http://x api", "Endpoint", "nothing", "restapi"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(governance.mentions_api(F.col("t")))
    assert [r[0] for r in df.collect()] == [bool(re.search("|".join(README_API_REGEXES), t, re.IGNORECASE)) for t in texts]


def test_csv_headers(spark):
    df = spark.createDataFrame([("p", "p/a.csv", ".csv", '﻿"a,1",b,"q""q"\n1,2,3')], "repo string, path string, suffix string, content string")
    assert [r["column"] for r in governance.csv_headers(df).orderBy("position").collect()] == ["a,1", "b", 'q"q']


def test_api_docs(files):
    found = {r.repo: (r.api_docs_found, r.readme_mentions_api) for r in governance.api_docs(files).collect()}
    assert found == {"p": (False, False), "q": (True, True), "r": (False, False)}


def test_quality_of_projects(files):
    found = {r.repo: r for r in quality.repo_quality(files).collect()}
    # One data file 1.5, valid CSV 2, name starts with data 3, license 2.
    assert found["p"].quality_score == 8.5 and found["p"].license == "MIT" and found["p"].data_types == [".csv"]
    # Three data files 4.5, API docs 10, README 5 + 3, XML 1, one Python and one JSON file 1.
    assert found["q"].quality_score == 24.5 and found["q"].license is None and found["q"].license_file_path is None
    # A CSV whose first line is blank has no header.
    assert found["r"].quality_score == 1.5


def test_summary_lists_five_files(spark):
    data = [("p", f"p/f{i}.csv", f"f{i}.csv", ".csv", 3, "a\n1") for i in range(8)]
    df = spark.createDataFrame(data, "repo string, path string, name string, suffix string, size bigint, content string")
    facts = spark.createDataFrame([("p", "", 7)], "repo string, language string, stars bigint")
    text = quality.structure_summary(df, quality.repo_quality(df), facts).first().structure_summary
    assert text == (
        "Language: unknown | Stars: 7 | Data types: .csv | Data files (8): f0.csv, f1.csv, f2.csv, f3.csv, f4.csv"
        " | Quality score: 28.0/50 | Total files: 8"
    )


def test_lake_build(files):
    projects = lake_projects(files)
    assert {r.repo for r in projects.collect()} == {"p", "q"}
    records = {r.name: r for r in lake_file_records(files, projects).collect()}
    assert set(records) == {"data.csv", "meta.json", "bad.json", "doc.xml"}
    assert not records["data.csv"].pii_flagged
    assert records["data.csv"].storage_path.endswith("_data.csv")


def test_syntax_checks(spark):
    texts = ['{"key":"value","list":[1,2,3]}', "{invalid", "[1] x", "NaN", "-Infinity", '{"a":1,"a":2}', "", " null ", "﻿{}", "1.", '"x', "tru", "5"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    import json

    def ok(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert [r[0] for r in df.select(corpus.json_valid(F.col("t"))).collect()] == [ok(t) for t in texts] + [None]
    report = corpus.xml_report(spark.createDataFrame([(1, "<a><b/><b/></a>"), (2, "<a>")], "k int, x string"), "x", ["k"])
    first, second = report.orderBy("k").collect()
    assert (first.valid, first.root_tag, first.unique_elements, first.error) == (True, "a", 2, None)
    assert second.valid is False and second.root_tag is None and second.error


def test_candidates(spark):
    results = spark.createDataFrame(
        [(0, "u1", 5), (1, "u1", 50), (2, "u1", 60), (3, "u2", 99), (4, "u3", 20)], "seq int, repo_url string, stars int"
    )
    blacklist = spark.createDataFrame([("u2",), ("s2",)], "repo_url string")
    seeds = spark.createDataFrame([("u1", 1), ("s2", 2)], "repo_url string, stars int")
    found = quality.candidate_select(results, blacklist, seeds, 10)
    assert sorted((r.origin, r.repo_url, r.stars) for r in found.collect()) == [("search", "u1", 50), ("search", "u3", 20), ("seed", "u1", 1)]


def test_headers_of_any_width(spark):
    wide = ",".join(f'"col ""{i}"", x"' for i in range(20_000))
    rows = [("r", "r/w.csv", ".csv", wide + "\n1"), ("r", "r/o.csv", ".csv", 'a,,"b,c",\n'), ("r", "r/e.csv", ".csv", "")]
    found = governance.csv_headers(spark.createDataFrame(rows, "repo string, path string, suffix string, content string"))
    names = {}
    for r in found.orderBy("path", "position").collect():
        names.setdefault(r["path"], []).append(r["column"])
    assert names["r/w.csv"] == [f'col "{i}", x' for i in range(20_000)]
    assert names["r/o.csv"] == ["a", "", "b,c", ""] and names["r/e.csv"] == [""]


def test_xml_documents(spark):
    good = {
        "<a><b/><b/></a>": ("a", 2), "<?xml version='1.0'?>\n<r x='1'><c>t</c></r>": ("r", 2), "  <a/>": ("a", 1),
        "<!-- <z> --><a/>": ("a", 1), "<a><![CDATA[<z>]]></a>": ("a", 1), "<a>x<b>y</b>z</a>\n<!-- t -->": ("a", 2),
        "<n:a xmlns:n='u'><n:b/></n:a>": ("n:a", 2), "<!DOCTYPE a [<!ELEMENT a ANY>]><a/>": ("a", 1),
    }
    bad = ["<a>", "text", "", "<a></b>", "<a/><b/>", "<a/> x", "x <a/>", "<a b=1/>", "<a>&nope;</a>", "<html><br></html>"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "x string")
    found = {r.x: tuple(r)[1:] for r in corpus.xml_report(df, "x", ["x"]).collect()}
    assert {t: found[t] for t in good} == {t: (True, *v, None) for t, v in good.items()}
    assert all(found[t][:3] == (False, None, 0) for t in bad) and found[None] == (None, None, None, None)
