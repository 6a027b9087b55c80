"""Loading, dedup and rollups: invariants and the branches of the scores."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from presswell.operators import dedup, views
from presswell.operators.etl import gold, silver
from presswell.operators.quality import gold_gate, missing_columns, validate_silver
from presswell.plans.warehouse import current
from presswell.schemas import ARTICLES, align
from presswell.sources import adapter, readers
from presswell.sources.sinks import Warehouse, markdown, new_objects
from presswell.streaming import rollups


def article(**own):
    row = dict(id="1", link="", source="x", lang="", clean_text="", batch_id="", ingest_object_name="o", sentiment_label="", keyphrases="",
               entities_persons_canon="", persons_actions="", actions_verbs="", sentiment_score=None)
    return row | own


def articles(spark, *rows):
    schema = ", ".join(f"{k} {'double' if k == 'sentiment_score' else 'string'}" for k in article())
    df = spark.createDataFrame([tuple(article(**r).values()) for r in rows], schema)
    return align(df, ARTICLES).withColumn("published_at", F.expr("timestamp_ntz '2024-01-01 00:00:00'"))


def winner(spark, *rows):
    return dedup.by_enrichment(articles(spark, *[{"link": "k"} | r for r in rows])).first()


def test_source_kind_beats_length(spark):
    assert winner(spark, dict(id="a", source="x", clean_text="z" * 500), dict(id="b", source="telegram:c"))["id"] == "b"


def test_body_threshold(spark):
    assert winner(spark, dict(id="a", clean_text="z" * 399, lang="ru"), dict(id="b", clean_text="z" * 400))["id"] == "b"


def test_sentiment_comes_from_the_best_row_that_has_one(spark):
    row = winner(spark, dict(id="a", clean_text="zz"), dict(id="b", clean_text="z", sentiment_score=0.5))
    assert (row["id"], row["sentiment_score"]) == ("a", 0.5)


def test_batch_names(spark):
    from presswell.functions.compat import loaded_at
    names = ["", "2026-02-01T16:32:46Z", "x_20260201T163246Z", "articles_20260201.json", "20260201"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, batch_id string").select("i", loaded_at().alias("t")).orderBy("i")
    epoch, at = datetime(1970, 1, 1), datetime(2026, 2, 1, 16, 32, 46)
    assert [r["t"] for r in df.collect()] == [epoch, at, at, epoch, epoch]


def test_dedup_is_idempotent_and_complete(spark, small):
    a = adapter.articles(spark, small)
    once = dedup.by_enrichment(a)
    assert once.count() == once.select("dedup_key").distinct().count() == a.select(dedup.dedup_key()).distinct().count()
    assert dedup.by_enrichment(once.drop("dedup_key", "source_type", "best_clean_len")).count() == once.count()
    assert views.batch_survival(a, once).agg(F.sum("winners")).first()[0] == once.count()


def test_second_load_is_a_no_op(spark, small, tmp_path):
    store, rows = Warehouse(spark, f"file://{tmp_path}/w"), adapter.articles(spark, small)
    at = datetime(2024, 1, 1)
    assert store.load(rows, "a.parquet", "b1", at) == rows.count()
    assert store.load(rows, "a.parquet", "b1", at) == 0
    assert store.load(rows.limit(3), "a.parquet", "b1", at, force=True) == 3
    assert store.articles().count() == 3 and store.load_log().count() == 2
    assert new_objects(rows, store.load_log()).count() == rows.count()


def test_rollups_by_stream_and_by_refresh(spark, small, tmp_path):
    a = align(adapter.articles(spark, small), ARTICLES)
    root = f"file://{tmp_path}"
    current(spark, small).transform(lambda d: align(d, ARTICLES)).repartition(2).write.parquet(f"{root}/gold")
    for _ in range(2):
        rollups.append_partials(spark, f"{root}/gold", f"{root}/out", f"{root}/state")
    want = views.articles_by_hour(dedup.by_enrichment(a))
    got = rollups.merged(spark.read.parquet(f"{root}/out/articles"), "articles")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == want.count()
    old, new = a.where("id < 'd5'"), a.where("id >= 'd5'")
    fresh = rollups.refresh_hours(old, views.articles_by_hour(dedup.by_enrichment(old)), new)
    assert sorted(map(tuple, fresh.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_raw_to_gold(spark, tmp_path):
    body = "First sentence here. Second sentence there. " * 10
    path = tmp_path / "raw.json"
    import json
    rows = [dict(id="a1", title="T1", link="https://example.com/one", source="example.com", published_at="2024-01-01T00:00:00Z", raw_text=body),
            dict(id="a2", title="T2", link="https://example.com/two", source="example.com", published_at="2024-01-01T00:00:00Z", raw_text=body)]
    path.write_text(json.dumps(rows))
    (tmp_path / "bundle.json").write_text(json.dumps({"batch_id": "b", "items": rows}))
    raw = readers.read_raw(spark, f"file://{path}")
    assert raw.count() == readers.read_raw(spark, f"file://{tmp_path}/bundle.json").count() == 2
    found = gold(silver(raw))
    got = found.orderBy("id").collect()
    assert [r["id"] for r in got] == ["a1", "a2"] and got[0]["source"] == "rss:example.com" and got[0]["keyphrases"] and got[0]["lang"] == "en"
    empty = gold(silver(raw.where("false")))
    assert empty.count() == 0 and empty.columns == found.columns
    assert validate_silver(silver(raw)) == 0 and missing_columns(found, ("nope",)) == ["nope"]
    assert gold_gate(found).where("metric = 'rows' AND NOT passed").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>http://x/1</link><description>d</description></item><item><description>z</description></item></channel></rss>")
    feed = readers.read_feed(spark, f"file://{tmp_path}/feed.xml", "x").collect()
    assert [(r["id"], r["raw_text"]) for r in feed] == [("http://x/1", "d")]
    (tmp_path / "words.txt").write_text("# c\n Foo \nfoo\n\nbar\n")
    assert sorted(r["term"] for r in readers.read_words(spark, f"file://{tmp_path}/words.txt").collect()) == ["bar", "foo"]
    assert readers.latest(spark, f"file://{tmp_path}", "*.txt").endswith("words.txt")


def test_report(spark, small):
    d = current(spark, small)
    text = markdown("Daily", views.report_summary(d).first().asDict(), {"Sources": views.report_sources(d, 3)})
    assert text.startswith("# Daily") and "| source | n |" in text


def test_unknown_suffix(spark):
    import pytest
    with pytest.raises(ValueError):
        readers.read(spark, f"/tmp/{uuid.uuid4().hex}.txt")


def test_two_objects_of_one_batch(spark, small, tmp_path):
    store, rows = Warehouse(spark, f"file://{tmp_path}/w"), adapter.articles(spark, small).limit(8)
    at = datetime(2024, 1, 1)
    assert store.load(rows.limit(5), "a.parquet", "20260201", at) == 5 and store.load(rows.limit(3), "b.parquet", "20260201", at) == 3
    assert store.articles().count() == 8 and store.load(rows.limit(2), "b.parquet", "20260201", at, force=True) == 2
    assert store.articles().count() == 7 and {r["batch_id"] for r in store.articles().select("batch_id").collect()} == {"20260201"}
    assert store.delete_batch("20260201") and not store.delete_batch("20260201")
    runs = adapter.ingestion_coverage(spark, small).limit(4)
    assert store.append_coverage(runs) and store.append_coverage(runs) and store.coverage().count() == 8
    assert not store.append_coverage(runs.withColumn("duration_ms", F.raise_error(F.lit("no"))))


def test_gold_of_shared_ids(spark):
    body = "First sentence here. Second sentence of Anna Smith there. " * 10
    rows = [("same", f"T{i}", f"https://example.com/{i}", "example.com", "2024-01-01T00:00:00Z", body + str(i)) for i in range(3)]
    raw = spark.createDataFrame(rows, "id string, title string, link string, source string, published_at string, raw_text string")
    got = gold(silver(raw)).collect()
    assert len(got) == 3 and {r["id"] for r in got} == {"same"} and all(r["persons"] and r["num_persons"] == 2 or r["num_persons"] >= 1 for r in got)
    assert {r["text_length_chars"] for r in got} == {len(f"T0. {body}0")} and all(r["sentiment_ok"] == 0 and r["sentiment_source"] == "empty" for r in got)


def test_batch_names_in_other_forms(spark):
    from presswell.functions.compat import loaded_at
    names = ["20260201T163246Z", "2026-02-01 16:32:46", "2026-02-01T16:32:46.123Z", "20260201163246"]
    df = spark.createDataFrame([(n,) for n in names], "batch_id string").select(loaded_at().alias("t"))
    assert {r["t"] for r in df.collect()} == {datetime(2026, 2, 1, 16, 32, 46)}


def test_dedup_prunes_before_the_shuffle(spark, small):
    plan = dedup.by_enrichment(adapter.articles(spark, small)).select("dedup_key", "sentiment_score", "id")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "partial_max_by" in plan


def test_rollups_of_recurring_keys(spark, small, tmp_path):
    a, root = align(adapter.articles(spark, small), ARTICLES), f"file://{tmp_path}"
    a.repartition(3, "id").write.parquet(f"{root}/gold")
    rollups.maintain(spark, f"{root}/gold", f"{root}/out", f"{root}/state", ("articles",), files=1)
    rollups.maintain(spark, f"{root}/gold", f"{root}/out", f"{root}/state", ("articles",), files=1)
    want = views.articles_by_hour(dedup.by_enrichment(a))
    got = rollups.maintained(spark, f"{root}/out", "articles")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_feeds_and_settings(spark, tmp_path):
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>A</title><link rel="self" href="http://x/s"/><link href="http://x/1"/>'
                                       "<updated>2024-01-01T00:00:00Z</updated><summary>s</summary></entry></feed>")
    got = readers.read_feed(spark, f"file://{tmp_path}/atom.xml", "x").collect()
    assert [(r["id"], r["link"], r["published_at"], r["raw_text"]) for r in got] == [("e1", "http://x/1", "2024-01-01T00:00:00Z", "s")]
    (tmp_path / "page.xml").write_text("<!doctype html><html><body>no feed</body></html>")
    assert readers.read_feed(spark, f"file://{tmp_path}/page.xml", "x").count() == 0
    (tmp_path / "s.yaml").write_text("sources:\n  rss:\n    - {name: a, url: u, enabled: true}\n    - {name: b, url: v, enabled: false}\n")
    settings = readers.read_settings(f"{tmp_path}/s.yaml")
    assert [f["name"] for f in readers.feeds(settings)] == ["a"] and [f["name"] for f in readers.feeds(settings, ("b",))] == ["b"]
    assert readers.read_settings(f"{tmp_path}/none.yaml") == {} and readers.channels(["# c", " @one ", "two", "", "one"], "@zero, two") == ["zero", "two", "one"]


def test_small_readers_and_writers(spark, small, tmp_path):
    import pytest

    from presswell.functions.records import report_key
    from presswell.operators import quality
    from presswell.sources import sinks
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert readers.footer(spark, f"{small}/documents.parquet") == (docs.columns, docs.count())
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    paths, rows = readers.preview(spark, f"file://{tmp_path}", "*.jsonl", rows=1)
    assert len(paths) == 1 and rows.count() == 1
    text = sinks.tsv(spark.createDataFrame([("a\tb", None)], "x string, y string"))
    assert text == "a\\tb\t\\N\n" and readers.read_tsv("a\tb\n") == [["a", "b"]]
    assert sinks.json_lines(spark.range(1)).first()[0] == '{"id":0}'
    assert sinks.gold_paths(["x/a_clean.json"], None) == ["data/gold/a_processed.parquet"] and sinks.gold_paths(["a", "b"], "out") == ["out/a_processed.parquet", "out/b_processed.parquet"]
    with pytest.raises(ValueError):
        sinks.gold_paths(["a", "b"], "o.parquet")
    assert sinks.raw_key("s", datetime(2024, 1, 2, 3, 4, 5)) == "raw/2024-01-02/s/articles_20240102_030405.json"
    assert report_key("2025-12-10 17:54:26", "2025-12-10 18:54:26", 1) == "reports/daily/last_hours=1/dt_from=2025-12-10T175426/dt_to=2025-12-10T185426/report.md"
    stamped = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 2, 1),)], "at timestamp_ntz")
    sinks.write_months(stamped, f"file://{tmp_path}/m", "at")
    sinks.write_months(stamped.limit(1), f"file://{tmp_path}/m", "at")
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.is_dir()) == ["month=202401", "month=202402"]
    sinks.create_views({"some_view": stamped})
    assert spark.sql("SELECT count(*) FROM some_view").first()[0] == 2 and sinks.rebuild_table(stamped, f"file://{tmp_path}/t").count() == 2
    gold_rows = spark.createDataFrame([("i", "t", "l", "p", "s", "c", "", "k")], ", ".join(f"{c} string" for c in quality.GOLD_COLUMNS))
    assert quality.validate_gold(gold_rows) == (0, {"empty_summary": 1.0, "empty_keywords": 0.0}) and quality.validate_gold(gold_rows, 2)[0] == 1
    assert quality.validate_gold(gold_rows.drop("id"))[0] == 1 and quality.precheck_silver(gold_rows) and not quality.precheck_silver(gold_rows.drop("title"))
    assert quality.gold_non_empty(gold_rows) and quality.missing_settings({"A": "x", "B": " "}, ("A", "B", "C")) == ["B", "C"]
    assert views.between(adapter.articles(spark, small), datetime(2024, 1, 1), datetime(2024, 1, 1)).count() == 0


def test_names_weigh_in_summaries():
    from presswell.operators.summary import summarize
    words = lambda i, cs: " ".join(f"{chr(97 + i)}{c}{c}{c}" for c in cs)
    parts = [f"{i} {words(i, 'abcde')} closing." for i in range(8)]
    parts[6] = f"6 Anna Smith {words(6, 'abc')} closing."
    parts[7] = f"7 Anna Smith {words(7, 'abc')} closing."
    body = " ".join(parts)
    assert "Anna" not in summarize(body, bonus=0.0)
    assert summarize(body, bonus=9.0, repeat=0.0).count("Anna") == 2 and summarize(body, bonus=9.0, repeat=99.0).count("Anna") == 1
