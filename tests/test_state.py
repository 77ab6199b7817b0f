import random

import pytest
from pyspark.sql import functions as F

from lakekit.operators import health, merge
from lakekit.operators.ordering import number_rows
from lakekit.streaming import incremental


def health_model(events):
    state = {}
    for entity, _, ok, latency in sorted(events, key=lambda e: e[1]):
        score, wins, losses, alive, last = state.get(entity, (10.0, 0, 0, True, None))
        if ok:
            state[entity] = (min(score + 0.5, 20.0), wins + 1, losses, True, latency if latency > 0 else last)
        else:
            score = max(score - 2.0, 0.0)
            state[entity] = (score, wins, losses + 1, alive and score >= 1, last)
    return sorted((e, s, w, f, a, t) for e, (s, w, f, a, t) in state.items())


def random_events(seed, n=800):
    """Events of a few entities; the first holds more than a third of them."""
    rng = random.Random(seed)
    return [
        (0 if rng.random() < 0.4 else rng.randint(1, 12), i, rng.random() < rng.choice([0.3, 0.8]), rng.choice([-1.0, 0.0, 5.5, 7.25]))
        for i in range(n)
    ]


EVENTS = "entity int, seq int, ok boolean, latency double"


@pytest.mark.parametrize("seed", range(4))
def test_health_against_a_model(spark, seed):
    events = random_events(seed)
    df = spark.createDataFrame(events, EVENTS).repartition(5)
    found = health.health_score(df, "entity", ["seq"], "ok", "latency").collect()
    assert sorted(tuple(r) for r in found) == health_model(events)


def test_a_busy_entity_is_cut_over_tasks(spark):
    df = spark.range(20000).select(F.lit(1).alias("entity"), F.col("id").alias("seq"), (F.col("id") % 7 != 0).alias("ok"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chunks = health.health_chunks(df, "entity", ["seq"], "ok").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 2 <= len(chunks) <= 4
    assert sum(c.successes + c.failures for c in chunks) == 20000


def test_health_stats_and_sample(spark):
    scores = spark.createDataFrame(
        [(1, 20.0, True), (2, 20.0, True), (3, 0.0, False), (4, 5.5, True)], "entity int, score double, alive boolean"
    )
    assert tuple(health.health_stats(scores, "entity").first()) == (4, 3, 1, 15.2, 1)
    picks = [r.entity for r in health.weighted_sample(scores, "entity", 3, "s").collect()]
    assert sorted(picks) == [1, 2, 4]
    assert picks == [r.entity for r in health.weighted_sample(scores.repartition(3), "entity", 3, "s").collect()]
    firsts = [health.weighted_sample(scores, "entity", 1, str(i)).first().entity for i in range(25)]
    assert firsts.count(4) < 13
    rest = scores.withColumn("score", F.when(F.col("entity") == 4, 5.5).otherwise(0.0))
    assert health.weighted_sample(rest, "entity", 3).first().entity == 4
    zero = scores.withColumn("score", F.lit(0.0))
    assert len(health.weighted_sample(zero, "entity", 3).collect()) == 3


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    assert sorted((r.n, r.v) for r in number_rows(df, [F.col("v")], "n").collect()) == [(i + 1, i) for i in range(1000)]


def test_content_store(spark):
    df = spark.createDataFrame(
        [("r", "r/a.csv", "a.csv", ".csv", 1, "x"), ("s", "s/a.csv", "a.csv", ".csv", 1, "x"), ("s", "s/b.txt", "b.txt", ".txt", 1, "x")],
        "repo string, path string, name string, suffix string, size bigint, content string",
    )
    assert sorted((r.name, r.copies) for r in merge.cas_dedup(df).collect()) == [("a.csv", 2), ("b.txt", 1)]
    one = merge.cas_dedup(df, by_name=False).first()
    assert (one.copies, one.storage_path) == (3, f"raw/{one.sha256[:2]}/{one.sha256}_a.csv")
    targets = {r.target_path for r in merge.flat_layout(df).collect()}
    assert targets == {"data/structured/csv/r_a.csv", "data/structured/csv/s_a.csv", "data/structured/unstructured/raw/s_b.txt"}


def test_merges(spark):
    table = spark.createDataFrame([("a", "old", 1.0, None, "t0", "id-a"), ("b", "keep", 2.0, "MIT", "t0", "id-b")],
                                  "repo_url string, repo_name string, quality_score double, license string, updated_at string, uuid string")
    batch = spark.createDataFrame(
        [(1, "a", "new", 5.0, "GPL", "t1"), (2, "c", "first", 1.0, None, "t2"), (3, "c", "second", 9.0, "BSD", "t3")],
        "seq int, repo_url string, repo_name string, quality_score double, license string, updated_at string",
    )
    found = {r.repo_url: r for r in merge.upsert(table, batch).collect()}
    assert (found["a"].repo_name, found["a"].quality_score, found["a"].license, found["a"].uuid) == ("old", 5.0, "GPL", "id-a")
    assert (found["b"].repo_name, found["b"].updated_at, found["b"].uuid) == ("keep", "t0", "id-b")
    assert (found["c"].repo_name, found["c"].quality_score, found["c"].license) == ("first", 9.0, "BSD")
    assert len(found["c"].uuid) == 36
    added = merge.insert_ignore(table, batch, ["repo_url"], "seq").collect()
    assert [(r.repo_url, r.repo_name) for r in added] == [("c", "first")]
    merged = merge.merge_rows(table.drop("uuid"), batch, ["repo_url"], "seq").collect()
    assert sorted((r.repo_url, r.repo_name) for r in merged) == [("a", "new"), ("b", "keep"), ("c", "second")]


def arrive(spark, store, tmp_path, df, parts=3):
    """Feed ``df`` to a table in stretches of ``seq``, one run of the stream each."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    size = df.count() // parts + 1
    for part in range(parts):
        df.filter(F.floor(F.col("seq") / size) == part).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        store.start(stream, checkpoint).awaitTermination()


@pytest.mark.parametrize("compact_every", [2, 50])
def test_running_health_equals_batch(spark, tmp_path, compact_every):
    events = random_events(9, 300)
    store = incremental.RunningHealth(spark, str(tmp_path / "t"), "entity", ["seq"], "ok", "latency", compact_every=compact_every)
    arrive(spark, store, tmp_path, spark.createDataFrame(events, EVENTS))
    assert sorted(tuple(r) for r in store.result().collect()) == health_model(events)


def test_tables_equal_batch_and_replay_changes_nothing(spark, tmp_path, rows):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 20), float(rng.randint(0, 9)), rng.choice("FOP")) for i in range(200)]
    df = spark.createDataFrame(data, "seq int, key int, score double, license string")
    better = incremental.BestPerKey(spark, str(tmp_path / "better"), "key", "score", "seq", compact_every=3)
    upserts = incremental.Upserts(spark, str(tmp_path / "ups"), "key", "seq", ["score", "license"], compact_every=3)
    first = incremental.FirstPerKey(spark, str(tmp_path / "first"), ["key", "license"], "seq")
    batches = [df.filter((F.col("seq") >= i * 50) & (F.col("seq") < (i + 1) * 50)) for i in range(4)]
    for store in (better, upserts, first):
        assert store.result() is None
        for i, batch in enumerate(batches):
            store.apply(batch, i)
        before = rows(store.result())
        store.apply(batches[3], 3)
        store.apply(batches[1], 1)
        assert rows(store.result()) == before
    assert better.log.base_id() == 2 and better.log.batch_ids() == [3]
    assert rows(better.result().select("key", "seq")) == rows(merge.store_if_better(df, "key", "score", "seq").select("key", "seq"))
    expected = {}
    for seq, key, score, license_ in data:
        expected[key] = (expected.get(key, (seq,))[0], score, license_)
    assert {r.key: (r.seq, r.score, r.license) for r in upserts.result().collect()} == expected
    assert first.result().count() == len({(k, c) for _, k, _, c in data})


def test_new_files_are_converted_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,a\n2,b\n")

    def run():
        incremental.convert_new_files(spark, source, target, checkpoint, "x int, y string").awaitTermination()
        return spark.read.parquet(target).count()

    assert (run(), run()) == (2, 2)
    (tmp_path / "in" / "b.csv").write_text("x,y\n3,c\n")
    assert (run(), run()) == (3, 3)
