"""Names in texts, dictionaries, JSON arrays by ranges, footers: against slow versions."""

import json
import math
import random
import re
import sys
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswell.functions import records as R
from presswell.operators import gazetteer, quality, terms
from presswell.operators import summary as summaries
from presswell.sources import arrays, footers, readers, sinks

NAMES = [("p", "Ким"), ("p", "Иван  Ким "), ("p", "Анна-Мария Ёж"), ("o", "a.b"), ("o", "(x) y"), ("p", "Лия Река"), ("o", "$"), ("o", ""), ("o", None), (None, "\\E z")]
PARTS = ["ким", "кима", "Кимоно", "иван", "Иван ким", "анна-мария", "ёж", "ежа", "a.b", "a.bc", "(x) y", "рекая", "река", "_ким", "x", "y", "\\E z", "kiḿ"]


def slow_tags(text):
    s, out = (text or "").lower().replace("ё", "е"), {}
    for kind, name in NAMES:
        name = (name or "").strip().lower().replace("ё", "е")
        if not re.search(r"\w", name):
            continue
        forms, words = [name], name.split()
        if len(words) > 1:
            forms += [words[-1]] + ([] if words[-1][-1] in "ая" else [words[-1] + "а", words[-1] + "я"])
        at = [m.start() for f in dict.fromkeys(forms) for m in re.finditer(rf"(?<![^\W])(?={re.escape(f)}(?!\w))", s)]
        if at:
            out[(kind, name)] = (len(at), min(at))
    return out


@pytest.mark.parametrize("chars", [10**6, 0])
def test_gazetteer(spark, chars):
    rng = random.Random(3)
    texts = [None, ""] + ["".join(rng.choice(PARTS) + rng.choice([" ", "  ", ".", "-", "_", "🙂", " "]) for _ in range(rng.randrange(12))) for _ in range(150)]
    df, names = spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame(NAMES * 2, "kind string, name string")
    got = {(r["id"], r["kind"], r["name"]): (r["n"], r["first"]) for r in gazetteer.tagged(df, "id", "t", names, chars).collect()}
    assert got == {(i, *k): v for i, t in enumerate(texts) for k, v in slow_tags(t).items()}
    assert gazetteer.tagged(df, "id", "t", names.limit(0), chars).count() == 0 == gazetteer.tagged(df.limit(0), "id", "t", names, chars).count()


def test_forms_are_counted_in_their_texts(spark):
    df = spark.createDataFrame([(1, "ким " * 1000 + "вера кобылаш"), (2, "кобылаш. " * 50), (3, "никто")], "id int, t string")
    names = spark.createDataFrame([("person", f"{n} кобылаш") for n in ("вера", "анна", "иван")] + [("person", "ким"), ("org", "ким")], "kind string, name string")
    forms = gazetteer.patterns(names)
    assert {tuple(r) for r in gazetteer._form_counts(df, "id", "t", forms).collect()} == {(1, "ким", 1000, 0), (1, "вера кобылаш", 1, 4000), (1, "кобылаш", 1, 4005), (2, "кобылаш", 50, 0)}
    counted = gazetteer._gram_counts(df, "id", "t", gazetteer._beginnings(forms))
    assert {tuple(r) for r in counted.select("id", "gram", "n", "at").collect()} == {(1, "ким", 1000, 0), (1, "вера кобылаш", 1, 4000), (1, "кобылаш", 1, 4005), (2, "кобылаш", 50, 0)}


@pytest.mark.parametrize("chars", [10**6, 0])
def test_names_are_put_together_where_they_are_found(spark, monkeypatch, chars):
    rng = random.Random(5)
    texts = [(i % 40 or None, " ".join(rng.choice(PARTS + ["ким", "."]) for _ in range(rng.randrange(1, 14)))) for i in range(120)]
    df = spark.createDataFrame(texts, "id long, t string").repartition(7)
    own = NAMES + [("p", f"{n} Ким") for n in ("вера", "анна", "(x) y")] + [("o", "Ким .")]
    monkeypatch.setattr(sys.modules[__name__], "NAMES", own)
    names, want = spark.createDataFrame(own, "kind string, name string"), {}
    for i, t in texts:
        for k, (n, first) in slow_tags(t).items():
            had = want.get((i, *k), (0, first))
            want[(i, *k)] = had[0] + n, min(had[1], first)
    monkeypatch.setattr(gazetteer, "AUTOMATON_CHARS", 20)
    monkeypatch.setattr(gazetteer, "LOT_CHARS", 400)
    found = gazetteer.tagged(df, "id", "t", names, chars)
    assert {(r["id"], r["kind"], r["name"]): (r["n"], r["first"]) for r in found.collect()} == want
    assert found.count() == len(want)
    # What is found passes no shuffle.
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert 0 <= plan.index("MapInArrow") < plan.index("Exchange")


def test_named(spark):
    rows = [("кимоно", "ким", False), ("-ким.", "ким", True), ("у кима", "ким", False), ("у кобылаша", "вера кобылаш", True), ("реки", "лия река", False), ("a\\eb", "\\e", False), ("a \\E q", "\\E q", True)]
    df = spark.createDataFrame(rows, "s string, n string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", gazetteer.named(F.col("s"), F.col("n"))).collect())


def test_terms_of_texts_without_lang_or_source(spark):
    body = "word other " * 40
    rows = [(None, None, None, body), (None, "", "RSS", body), ("EN", " A ", "rss", body), ("en", "a", "rss", "third " * 80)]
    stats = terms.tf_df(spark.createDataFrame(rows, "lang string, source string, source_type string, clean_text string"), "source", "source_type", "lang")
    got = {tuple(r) for r in stats.collect()}
    assert got == {("other", "other", "unknown", "word", 40, 1, 1.0), ("other", "other", "unknown", "other", 40, 1, 1.0), ("rss", "rss", "unknown", "word", 40, 1, 1.0),
                   ("rss", "rss", "unknown", "other", 40, 1, 1.0), ("a", "rss", "en", "word", 40, 1, 0.5), ("a", "rss", "en", "other", 40, 1, 0.5), ("a", "rss", "en", "third", 80, 1, 0.5)}


@pytest.mark.parametrize("chars", [10**6, -1])
def test_lemmas(spark, chars):
    docs = spark.createDataFrame([(1, "Ёжики бегали, Ёжик бегал."), (2, None), (3, "... 12"), (4, "бегали бегали")], "id int, t string")
    lemmas = spark.createDataFrame([("ежики", "ежик"), ("бегали", "бегать"), ("бегали", "бегун"), (None, "x"), ("бегал", "бегать")], "form string, lemma string")
    got = {r["id"]: r["t"] for r in terms.lemmatized(docs, "id", "t", lemmas, chars).collect()}
    assert got == {1: "ежик бегать ежик бегать", 2: "", 3: "", 4: "бегать бегать"}


def test_mined_sources(spark):
    rows = [("gazeta.ru", "", "", "rss:gazeta.ru", "rss"), ("", "", "https://www.Site.com/x", "rss:site.com", "rss"), ("name", None, "http://a.b/c", "rss:name", "rss"),
            ("telegram:Chan", "json", None, "telegram:chan", "telegram"), (" X ", "Telegram", "", "telegram:x", "telegram"), (None, None, None, "other", "other"), ("name", "", "http://localhost/", "name", "other")]
    df = spark.createDataFrame(rows, "s string, k string, l string, source string, kind string")
    assert all(tuple(r["m"]) == (r["source"], r["kind"]) for r in df.withColumn("m", R.mined_source(F.col("s"), F.col("k"), F.col("l"))).collect())


# ---- files --------------------------------------------------------------------

def noise(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "🙂", "a", "\n"]) for _ in range(rng.randrange(14)))


@pytest.mark.parametrize(("level", "indent"), [(1, None), (1, 2), (2, None)])
def test_json_arrays_by_ranges(spark, tmp_path, level, indent):
    rng = random.Random(level)
    rows = [{"id": i, "t": noise(rng), "more": {"x": [noise(rng), {"y": noise(rng)}]}} for i in range(120)] + [{"id": 120, "t": "\\" * 50, "more": None}]
    whole = rows if level == 1 else {"before": ["}{", noise(rng)], "items": rows, "after": '"'}
    (tmp_path / "a.json").write_text(json.dumps(whole, ensure_ascii=False, indent=indent))
    (tmp_path / "b.json").write_text("[]" if level == 1 else '{"items": []}')
    (tmp_path / "c.json").write_text("")
    for size in (1 << 20, 997, 60, 7):
        got = arrays.read_array(spark, f"file://{tmp_path}", "id int, t string, more struct<x: array<string>>", level, size, "*.json").select("id", "t").collect()
        assert sorted(map(tuple, got)) == [(r["id"], r["t"]) for r in rows]
    (tmp_path / "d.json").write_text('[{"id": 1}, {"id": 2')
    with pytest.raises(Exception, match="ends inside a record"):
        arrays.read_array(spark, f"file://{tmp_path}/d.json", "id int").collect()


def test_written_arrays_are_arrays(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f'"{i}\n') for i in range(20)], "id int, t string").repartition(3)
    arrays.write_arrays(df, f"file://{tmp_path}/w")
    arrays.write_arrays(df.limit(0), f"file://{tmp_path}/n")
    read = [r for p in (tmp_path / "w").glob("part-*") for r in json.loads(p.read_text())]
    assert sorted((r["id"], r["t"]) for r in read) == sorted(map(tuple, df.collect())) and all(p.read_text() in ("", "[]\n") for p in (tmp_path / "n").glob("part-*"))
    assert arrays.read_array(spark, f"file://{tmp_path}/w", "id int, t string", glob="part-*").count() == 20


def test_footers(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    spark.createDataFrame([("a", 1), ("a", 2)], "s string, n int").coalesce(1).write.parquet(path)
    assert {(r["column"], r["rows"], r["nulls"], r["low"], r["high"]) for r in footers.footers(spark, path).collect()} == {("s", 2, 0, "a", "a"), ("n", 2, 0, "1", "2")}
    assert footers.is_constant(spark, path, "s", "a") and not footers.is_constant(spark, path, "s", "b") and footers.not_constant(spark, path, "s", "a").count() == 0
    spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int").coalesce(1).write.mode("append").parquet(path)
    (wrong,) = footers.not_constant(spark, path, "s", "a").collect()
    assert wrong["proven"] and (wrong["low"], wrong["high"], wrong["row_group"]) == ("a", "b", 0) and not footers.is_constant(spark, path, "s", "a")
    nulls = f"file://{tmp_path}/n"
    spark.createDataFrame([("a",), (None,)], "s string").coalesce(1).write.parquet(nulls)
    assert not footers.is_constant(spark, nulls, "s", "a")
    # Without statistics only a scan can tell.
    import pyarrow as pa
    import pyarrow.parquet as pq
    (tmp_path / "q").mkdir()
    pq.write_table(pa.table({"s": ["a", "a"]}), tmp_path / "q" / "x.parquet", write_statistics=False)
    (doubt,) = footers.not_constant(spark, f"file://{tmp_path}/q", "s", "a").collect()
    assert not doubt["proven"] and footers.is_constant(spark, f"file://{tmp_path}/q", "s", "a") and not footers.is_constant(spark, f"file://{tmp_path}/q", "s", "b")


def test_csv_and_reports(spark, tmp_path):
    rows = [(1, 'a "quoted", b'), (2, None)]
    sinks.write_csv(spark.createDataFrame(rows, "n int, t string"), f"file://{tmp_path}/x.csv")
    assert sorted(map(tuple, readers.read(spark, f"file://{tmp_path}/x.csv", "n int, t string").collect())) == rows
    key = sinks.store_report(spark, f"file://{tmp_path}/s", "# é\n", datetime(2026, 1, 2, 3, 4, 5), 24, "abc")
    assert key == "reports/dt=2026-01-02/run_id=20260102_030405/daily_report.md" and (tmp_path / "s" / key).read_text() == "# é\n"
    facts = json.loads((tmp_path / "s" / key).with_name("metadata.json").read_text())
    assert facts["report_object_key"] == key and facts["last_hours"] == "24" and facts["git_commit"] == "abc" and facts["uploaded_at"] == "2026-01-02T03:04:05Z"


def test_settings():
    groups = (("ADMIN_USER", "ADMIN_PASSWORD"), ("WWW_USER",))
    good = {"A": "1", "B": "1", "PORT": "8123", "ADMIN_USER": "u", "ADMIN_PASSWORD": "p"}
    assert quality.setting_faults(good, ("A", "PORT"), (("A", "B"),), ("PORT",), groups) == []
    bad = {"A": "FILL_ME", "B": "2", "PORT": "70000", "ADMIN_USER": "u"}
    assert quality.setting_faults(bad, ("A", "C"), (("A", "B"),), ("PORT",), groups) == [
        "missing: C", "missing: ADMIN_PASSWORD", "placeholder: A", "different: A, B", "no port: PORT"]
    assert quality.setting_faults({}, (), one_of=groups) == ["missing: one of ADMIN_USER, WWW_USER"]


# ---- summaries ----------------------------------------------------------------

def slow_summary(text):
    """The summary by dense vectors and plain loops."""
    folded = re.sub(r"\s+", " ", (text or "").strip())
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9])", folded) if p.strip()]
    word = re.compile(r"[A-Za-zА-Яа-яЁё]{2,}")
    parts = [p for p in parts if len(p) >= 25 and len(word.findall(p)) >= 5 and sum(c in "!?:;…" for c in p) < max(4, len(p) // 25)] or parts
    if len(parts) <= 3:
        return " ".join(parts)[:700].strip()
    bags = []
    for p in parts:
        ws = [w.replace("ё", "е") for w in word.findall(p.lower())]
        ws = [w for w in ws if w not in summaries._STOPS]
        bags.append(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
    n, df, total = len(parts), {}, {}
    for bag in bags:
        for g in set(bag):
            df[g] = df.get(g, 0) + 1
        for g in bag:
            total[g] = total.get(g, 0) + 1
    known = sorted((g for g in df if df[g] <= 0.95 * n), key=lambda g: (-total[g], g))[:4000]
    rows = []
    for bag in bags:
        row = [bag.count(g) * (math.log((1 + n) / (1 + df[g])) + 1) if g in set(bag) else 0.0 for g in known]
        norm = math.sqrt(sum(x * x for x in row))
        rows.append([x / norm if norm else 0.0 for x in row])
    if not any(map(any, rows)):
        return " ".join(parts[:3])[:700].strip()
    score = [sum(r) * (1.0 - 0.3 * i / (n - 1)) for i, r in enumerate(rows)]
    names = summaries._names(text, 6)
    hits = [sum(x in p.lower().replace("ё", "е") for x in names) for p in parts]
    if max(hits):
        mean = sum(score) / n
        score = [s + 0.25 * (mean + 1e-9) * h / max(hits) for s, h in zip(score, hits)]
    chosen, used = [], set()
    for _ in range(3):
        best = None
        for i in range(n):
            if i in chosen:
                continue
            near = max((sum(a * b for a, b in zip(rows[i], rows[j])) for j in chosen), default=0.0)
            gain = score[i] - 0.7 * near - 0.15 * sum(x in used for x in summaries._names(parts[i], 5))
            if best is None or gain > best[0] + 1e-9 or (abs(gain - best[0]) <= 1e-9 and score[i] > score[best[1]] + 1e-9):
                best = (gain, i)
        chosen.append(best[1])
        used |= set(summaries._names(parts[best[1]], 5))
    return " ".join(parts[i] for i in sorted(chosen))[:700].strip()


def test_summaries_of_the_test_tables(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 6000").select("text", summaries.summary("text").alias("s")).collect()
    assert len(rows) > 100 and sum(r["s"] != slow_summary(r["text"]) for r in rows) == 0


def test_few_small_files_are_dealt_out_and_many_are_not(spark, tmp_path):
    from presswell.sources.readers import spread

    rows, cores = spark.range(1000).withColumn("t", F.col("id").cast("string")), spark.sparkContext.defaultParallelism
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    rows.coalesce(1).write.parquet(one)
    rows.repartition(cores).write.parquet(many)
    dealt = spread(spark.read.parquet(one), "id")
    assert dealt.rdd.getNumPartitions() == cores
    assert sorted(r["t"] for r in dealt.collect()) == sorted(r["t"] for r in rows.collect())
    assert spread(rows, "id") is rows
    stored = spark.read.parquet(many)
    assert spread(stored, "id") is stored


def test_frequencies_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y", "x"]), (2, "a", ["x"]), (3, None, ["y"]), (4, "a", []), (5, "a", None)], "id int, lang string, ws array<string>")
    found = terms.frequencies(rows, "ws", "lang")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.collect()} == {("a", "x", 3, 2), ("a", "y", 1, 1), (None, "y", 1, 1)}


def test_long_runs_are_counted_only_where_short_ones_are_frequent(spark):
    """The most frequent terms are those of a count of all runs; rare runs are never counted."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * 2 if rng.random() < 0.7 else f"w{''.join(rng.choices('xyz', k=9))}" for _ in range(60)) for _ in range(40)]
    rows = spark.createDataFrame([(t.split(),) for t in texts], "ws array<string>")
    runs = [" ".join(ws[i : i + k]) for t in texts for ws in [t.split()] for k in (1, 2, 3) for i in range(len(ws) - k + 1)]
    every = Counter(runs)
    for most, limit in ((20, 34.0), (60, 1000.0), (100_000, 34.0)):
        found = {r["term"]: r["tf"] for r in terms.common_runs(rows, most, limit).collect()}
        assert all(every[t] == n for t, n in found.items())
        possible = sorted((-n, t) for t, n in every.items() if sum(f" {t} " in f" {x} " for x in texts) <= limit)[:most]
        assert {t for _, t in possible} <= set(found)
        assert most == 100_000 or len(found) < len(every) / 5


def test_keywords_are_those_of_a_count_of_all_runs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("kmnprs") * 3 for _ in range(rng.randrange(30))) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = {r["id"]: r["keywords"] for r in terms.tfidf_keywords(docs, "id", "t", max_df=0.5, max_features=25).collect()}
    grams = [Counter(" ".join(ws[i : i + k]) for ws in [(t or "").split()] for k in (1, 2, 3) for i in range(len(ws) - k + 1)) for t in texts]
    n, tf, df = len(texts), sum(grams, Counter()), Counter(g for c in grams for g in c)
    kept = sorted((-tf[g], g) for g in tf if df[g] <= 0.5 * n)[:25]
    for i, own in enumerate(grams):
        weight = {g: own[g] * (math.log((1 + n) / (1 + df[g])) + 1) for _, g in kept if g in own}
        norm = sum(w * w for w in weight.values()) ** 0.5
        best = sorted(weight, key=lambda g: (-round(weight[g] / norm, 9), g))[:8]
        ranked = sorted(best, key=lambda g: (-len(g.split()), -len(g), best.index(g)))
        assert found[i] == "; ".join(g for g in ranked if not any(s != g and f" {g} " in f" {s} " for s in ranked))


def test_source_terms_reads_its_statistics_once(spark):
    rows = [("telegram", "en", "a", 50, 0.5), ("telegram", "en", "b", 50, 0.4), ("rss", "en", "a", 5, 0.01), ("rss", "de", "b", 5, 0.9)]
    stats = spark.createDataFrame(rows, "source_type string, lang string, term string, tf long, df_ratio double")
    tagged = stats.withColumn("term", F.concat("term", F.lit(""))).withColumn("tf", F.col("tf") + 0 * F.monotonically_increasing_id())
    found = terms.source_terms(tagged, "telegram", "rss", "en")
    assert [(r["term"], r["tf_lo"]) for r in found.collect()] == [("a", 5), ("b", 0)]
    assert "monotonically" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_counted_along_with_their_terms(spark):
    rows = [("a", "one two " * 20), ("a", "two " * 30), ("a", "1 " * 60), ("b", "one " * 30), ("b", None)]
    docs = spark.createDataFrame(rows, "lang string, clean_text string").withColumn("clean_text", F.concat("clean_text", F.substring(F.uuid(), 1, 0)))
    found = terms.tf_df(docs, "lang", min_chars=10)
    assert {tuple(r) for r in found.collect()} == {("a", "one", 20, 1, 0.5), ("a", "two", 50, 2, 1.0), ("b", "one", 30, 1, 1.0)}
    assert "uuid" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_sentences_with_a_name_are_taken_apart(spark):
    rows = [(1, "Ann Lee said it. Nobody said it. Lee went, said.  Leeds said", "Ann Lee;Lea"), (2, "Bob said", None), (3, None, "Bob"), (4, "bob-b said. bob said", "Bob")]
    docs = spark.createDataFrame(rows, "id int, t string, p string")
    found = summaries.actions_near(docs, "id", "t", "p", lambda w: F.when(w.isin("said", "went"), w))
    assert {tuple(r) for r in found.collect()} == {(1, "ann lee", "said,went"), (4, "bob", "said")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Contains(s" in plan
