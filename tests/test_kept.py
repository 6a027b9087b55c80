"""Snapshots, clustered tables, keyed states, compaction: what a reader sees at every step."""

import random
import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswell.functions.compat import dedup_key
from presswell.operators import dedup, views
from presswell.plans import kept, warehouse
from presswell.schemas import ARTICLES, align
from presswell.sources import adapter, shared, sinks
from presswell.sources.snapshots import Conflict, Snapshots
from presswell.streaming import rollups

AT = datetime(2026, 1, 1)


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=str)


def random_articles(spark, seed, many=60):
    """Articles of few keys, with nulls and ties in what they are scored by."""
    rng = random.Random(seed)
    rows = []
    for i in range(many):
        rows.append((f"d{i}", rng.choice(["", "l1", "l2", "l3", "l4"]), rng.choice(["telegram:a", "rss:b", "c"]), rng.choice(["", "x" * 500, "y" * 500]), rng.choice(["en", "unknown"]),
                     rng.choice([None, AT + timedelta(hours=rng.randrange(30))]), rng.choice([None, 0.0, 0.5, -1.0]), rng.choice(["", "pos"]), rng.choice(["a; b", "", "b"]),
                     rng.choice(["", "20260101T000000Z", "20260102T000000Z"]), rng.choice(["o1", "o2"])))
    df = spark.createDataFrame(rows, "id string, link string, source string, clean_text string, lang string, published_at timestamp_ntz, sentiment_score double, "
                               "sentiment_label string, keywords string, batch_id string, ingest_object_name string")
    return align(df, ARTICLES)


# ---- snapshots ----------------------------------------------------------------

def test_a_load_that_dies_at_any_step_leaves_the_old_rows(spark, small, tmp_path, monkeypatch):
    house, rows = sinks.Warehouse(spark, f"file://{tmp_path}/w"), adapter.articles(spark, small).limit(6)
    assert house.load(rows.limit(4), "a", "b1", AT) == 4
    for step in ("stage", "read", "commit"):
        kept_step = getattr(Snapshots, step)

        def dies(self, *args, step=step, kept_step=kept_step, **more):
            if step == "commit":
                raise RuntimeError("killed")
            kept_step(self, *args, **more)
            raise RuntimeError("killed")

        monkeypatch.setattr(Snapshots, step, dies)
        with pytest.raises(RuntimeError, match="killed"):
            house.load(rows, "a", "b1", AT, force=True)
        monkeypatch.undo()
        assert house.articles().count() == 4 and [r["rows_loaded"] for r in house.load_log().collect()] == [4]
    assert house.load(rows, "a", "b1", AT, force=True) == 6 and house.articles().count() == 6
    # What the dead loads staged goes; what is seen, and was by the version before, stays.
    assert house.store.vacuum() == 3 and house.articles().count() == 6 and house.articles(1).count() == 4
    assert house.store.vacuum(keep=1) == 1 and house.articles().count() == 6


def test_batches_without_a_name_and_empty_reloads(spark, small, tmp_path):
    house, rows = sinks.Warehouse(spark, f"file://{tmp_path}/w"), adapter.articles(spark, small).limit(5)
    assert house.load(rows, "a", "", AT) == 5 and house.load(rows, "b", "", AT) == 5 and house.load(rows, "b", "", AT) == 0
    assert house.load(rows.limit(0), "a", "", AT, force=True) == 0
    assert {r["ingest_object_name"] for r in house.articles().collect()} == {"b"} and house.load(rows, "a", "", AT) == 0
    assert sorted((r["object_name"], r["rows_loaded"]) for r in house.load_log().collect()) == [("a", 0), ("a", 5), ("b", 5)]
    assert house.delete_batch("") and house.articles().count() == 0 and not house.delete_batch("")


def test_writers_of_one_version(spark, tmp_path):
    one, two = Snapshots(spark, f"file://{tmp_path}/s"), Snapshots(spark, f"file://{tmp_path}/s")
    assert one.version() == 0 and one.parts() == [] and one.tag("x") is None and one.vacuum() == 0
    part = {"table": "t", "path": one.stage(spark.range(3))}
    assert one.commit(lambda parts: [*parts, part], x=7) == 1 and two.tag("x") == 7
    other = {"table": "t", "path": two.stage(spark.range(2))}
    with pytest.raises(Conflict):
        two.commit(lambda parts: [*parts, other], seen=0)
    assert two.commit(lambda parts: [*parts, other]) == 2  # made again on what is there
    assert one.read(one.parts("t"), spark.range(1).schema).count() == 5 and one.read(one.parts("t", 1), spark.range(1).schema).count() == 3
    assert one.read([], spark.range(1).schema).count() == 0 and one.parts("u") == []


# ---- clustered tables ---------------------------------------------------------

def test_dedup_of_a_clustered_table_shuffles_nothing(spark, small, tmp_path):
    rows = adapter.articles(spark, small)
    table = sinks.clustered_table(rows.withColumn("dedup_key", dedup_key()), f"t_{uuid.uuid4().hex}", f"file://{tmp_path}/t", buckets=4)
    found = dedup.by_enrichment(table).select(*kept.SHOWN)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan, plan
    assert rows_of(found) == rows_of(dedup.by_enrichment(rows).select(*kept.SHOWN))
    assert len(list((tmp_path / "t").glob("part-*"))) <= 4


# ---- keyed states -------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_merge_to_the_dedup_of_all(spark, seed):
    rows = random_articles(spark, seed)
    want = dedup.by_enrichment(rows)
    parts = [dedup.states(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i)) for i in range(3)]
    for order in ((0, 1, 2), (2, 0, 1)):
        got = dedup.winners(dedup.merged_states(dedup.merged_states(parts[order[0]], parts[order[1]]), parts[order[2]]))
        assert rows_of(got, *want.columns) == rows_of(want)
    assert dedup.states(rows.limit(0)).count() == 0


def test_rollups_of_null_hours_and_recurring_keys(spark, tmp_path):
    rows, root = random_articles(spark, 4, 90), f"file://{tmp_path}"
    rows.repartition(3, "id").write.parquet(f"{root}/gold")
    for _ in range(2):
        rollups.maintain(spark, f"{root}/gold", f"{root}/out", f"{root}/state", files=1, buckets=4)
    best = dedup.by_enrichment(rows)
    assert rows.where("published_at IS NULL").count() > 0
    for name, build in rollups.COUNTS.items():
        want = views.sentiment_of_values(build(best)) if name == "sentiment" else build(best)
        assert rows_of(rollups.maintained(spark, f"{root}/out", name), *want.columns) == rows_of(want)
    assert rows_of(views.sentiment_of_values(views.sentiment_values(best))) == rows_of(views.sentiment_merged(views.sentiment_state(best)))
    store = Snapshots(spark, f"{root}/out")
    assert rows_of(rollups.current_view(store), *best.columns) == rows_of(best)


def test_a_batch_comes_twice_and_reads_only_its_own_buckets(spark, tmp_path):
    rows, store = random_articles(spark, 5), Snapshots(spark, f"file://{tmp_path}/s")
    rollups.apply_batch(store, rows.where("link <> 'l1'"), 0, ("articles",), buckets=16)
    before = {p["bucket"]: p["path"] for p in store.parts("state")}
    one = rows.where("link = 'l1'")
    rollups.apply_batch(store, one, 1, ("articles",), buckets=16)
    version, after = store.version(), {p["bucket"]: p["path"] for p in store.parts("state")}
    own = {r["b"] for r in one.withColumn("dedup_key", dedup_key()).select(rollups._bucket(16).alias("b")).collect()}
    assert {b for b in after if before.get(b) != after[b]} == own and set(before) <= set(after)
    rollups.apply_batch(store, one, 1, ("articles",), buckets=16)  # as after a failure behind the commit
    rollups.apply_batch(store, one, 0, ("articles",), buckets=16)
    assert store.version() == version
    rollups.apply_batch(store, one.limit(0), 2, ("articles",), buckets=16)
    want = views.articles_by_hour(dedup.by_enrichment(rows))
    assert rows_of(rollups.maintained(spark, store.root, "articles"), *want.columns) == rows_of(want)


def test_view_follows_loads_reloads_and_deletes(spark, tmp_path):
    house, store = sinks.Warehouse(spark, f"file://{tmp_path}/w"), Snapshots(spark, f"file://{tmp_path}/v")
    names = ("articles", "keywords")

    def same():
        version = rollups.refresh_view(house, store, names, buckets=4)
        want = dedup.by_enrichment(house.articles())
        assert version == house.store.version() and rows_of(rollups.current_view(store), *want.columns) == rows_of(want)
        for name in names:
            counts = rollups.COUNTS[name](want)
            assert rows_of(rollups.maintained(spark, store.root, name), *counts.columns) == rows_of(counts)

    house.load(random_articles(spark, 6, 30), "a", "20260101T000000Z", AT)
    house.load(random_articles(spark, 7, 30), "b", "", AT)
    same()
    house.load(random_articles(spark, 8, 10), "a", "20260101T000000Z", AT, force=True)
    same()
    house.load(random_articles(spark, 9, 10), "c", "20260105T000000Z", AT)
    house.load(random_articles(spark, 9, 10).limit(0), "b", "", AT, force=True)
    same()
    house.delete_batch("20260101T000000Z")
    same()
    assert rollups.refresh_view(house, store, names, buckets=4) == house.store.version()


# ---- compaction ---------------------------------------------------------------

def test_states_without_texts_are_those_of_the_articles(spark, small, tmp_path):
    rows, views = align(adapter.articles(spark, small), ARTICLES), []
    for name, without in (("whole", ()), ("bare", rollups.BODIES)):
        store = Snapshots(spark, f"{tmp_path}/{name}")
        for i in range(2):
            rollups.apply_batch(store, rows.where(F.pmod(F.xxhash64("id", "ingest_object_name"), F.lit(2)) == i), i, (), buckets=2, without=without)
        views.append(rollups.current_view(store, without=without))
    whole, bare = views
    assert not set(rollups.BODIES) & set(bare.columns) and set(whole.columns) - set(bare.columns) == set(rollups.BODIES)
    assert bare.exceptAll(whole.select(*bare.columns)).isEmpty() and whole.select(*bare.columns).exceptAll(bare).isEmpty()


def test_the_kept_table_has_no_text_twice(spark, small):
    d = warehouse.current(spark, small)
    whole = dedup.by_enrichment(adapter.articles(spark, small)).select(*d.columns)
    assert "raw_text" not in d.columns and rows_of(d) == rows_of(whole)
    stored = spark.read.parquet(*d.inputFiles())
    assert "nlp_text" not in stored.columns and "clean_text" in stored.columns


def test_compaction_folds_months_and_keeps_what_came_meanwhile(spark, tmp_path, monkeypatch):
    rows, store = random_articles(spark, 10), Snapshots(spark, f"file://{tmp_path}/c")
    states = [views.sentiment_state(rows.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i)) for i in range(4)]
    for state in states[:3]:
        rollups.append(store, "s", state)
    schema, want = states[0].schema, views.sentiment_merged(views.sentiment_state(rows))
    months = {p["month"] for p in store.parts("s")}
    fold = rollups.folded

    def meanwhile(partials):
        monkeypatch.undo()
        rollups.append(store, "s", states[3])
        return fold(partials)

    monkeypatch.setattr(rollups, "folded", meanwhile)
    assert rollups.compact(store, "s", schema) == len(months) and "__HIVE_DEFAULT_PARTITION__" in months
    read = lambda: rows_of(views.sentiment_merged(store.read(store.parts("s"), schema)))
    near = lambda rs: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rs]
    assert near(read()) == near(rows_of(want)) and max(sum(p["month"] == m for p in store.parts("s")) for m in months) == 2
    assert rollups.compact(store, "s", schema) > 0 and rollups.compact(store, "s", schema) == 0
    assert near(read()) == near(rows_of(want)) and len(store.parts("s")) == len({p["month"] for p in store.parts("s")})


def test_kept_results_follow_their_sources(spark, tmp_path):
    path, built = f"file://{tmp_path}/t", []
    spark.range(3).write.parquet(path)

    def build():
        built.append(1)
        return spark.read.parquet(path)

    assert shared.kept(spark, "x", [path], build).count() == shared.kept(spark, "x", [path], build).count() == 3 and len(built) == 1
    spark.range(4).write.mode("append").parquet(path)
    assert shared.kept(spark, "x", [path], build).count() == 7 and len(built) == 2


def test_a_written_step_leaves_no_shuffle_files(spark):
    def shuffled() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name, None)
    step = shared.materialize(spark.range(100_000).groupBy((F.col("id") % 5003).alias("k")).agg(F.count(F.lit(1)).alias("n")), "step")
    till = time.monotonic() + 20
    while shuffled() > before and time.monotonic() < till:
        time.sleep(0.2)
    assert shuffled() <= before
    assert step.agg(F.sum("n")).first()[0] == 100_000
    assert spark.conf.get(name, None) == setting
