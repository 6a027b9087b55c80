"""DuckDB SQL of the warehouse queries, written apart from the Spark plans."""

from __future__ import annotations

from presswell.plans.registry import ORACLES

_ARTICLES = r"""
articles AS (
  WITH s AS (SELECT doc_id, max(quality - toxic)::DOUBLE AS sentiment_score FROM labels GROUP BY doc_id),
  b AS (
    SELECT d.*, sentiment_score, unnest(CASE WHEN doc_id % 50 = 0 THEN [false, true] ELSE [false] END) AS again, regexp_extract_all(lower(text), '[a-z]{4,}') AS k, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS c,
           trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS clean_text, left(split_part(text, chr(10), 1), 80) AS title
    FROM documents AS d LEFT JOIN s USING (doc_id))
  SELECT 'd' || doc_id AS id, '' AS uid, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS channel, title,
    CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'https://' || source || '.example.com/' || md5(text) END AS link,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 97) AS published_at,
    CASE doc_id % 3 WHEN 0 THEN 'telegram:' WHEN 1 THEN 'rss:' ELSE '' END || source AS source,
    text AS raw_text, clean_text, trim(title || '. ' || clean_text) AS nlp_text, left(clean_text, 200) AS summary,
    array_to_string(k[1:8], '; ') AS keywords, length(clean_text) AS text_length_chars,
    len(regexp_extract_all(text, '[.!?]')) AS num_sentences, len(k[1:8]) AS num_keywords,
    CASE WHEN again THEN 'articles_20240109T000000Z' ELSE CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '2024-01-0' || (doc_id % 5 + 1) || 'T00:00:00Z'
      WHEN 2 THEN 'articles_2024010' || (doc_id % 5 + 1) || 'T000000Z' ELSE 'articles_' || doc_id % 3 || '.json' END END AS batch_id,
    CASE WHEN again THEN 'gold_again.parquet' ELSE 'gold_' || doc_id % 7 || '.parquet' END AS ingest_object_name,
    array_to_string(c[1:3], '; ') AS entities_persons, array_to_string(c[4:5], '; ') AS entities_orgs, array_to_string(c[6:7], '|') AS entities_geo,
    CASE WHEN len(c) >= 2 AND len(k) >= 3 THEN c[1] || ':' || k[1] || ' , ' || k[2] || '|' || c[2] || ': ' || k[3]
      WHEN len(c) >= 1 THEN c[1] ELSE '' END AS persons_actions,
    array_to_string(k[3:5], ';') AS actions_verbs, (doc_id % 13 = 0)::INT AS is_digest,
    lower(array_to_string(c[1:3], ';')) AS entities_persons_canon, lower(array_to_string(c[4:5], ';')) AS entities_orgs_canon,
    lower(array_to_string(c[6:7], ';')) AS entities_geo_canon, CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE lang END AS lang,
    array_to_string(k[9:12], ';') AS keyphrases,
    CASE WHEN sentiment_score > 0 THEN 'pos' WHEN sentiment_score < 0 THEN 'neg' WHEN sentiment_score = 0 THEN 'neu' ELSE '' END AS sentiment_label,
    sentiment_score,
    coalesce(nullif(CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'https://' || source || '.example.com/' || md5(text) END, ''), 'd' || doc_id) AS dedup_key,
    length(clean_text) AS clean_len
  FROM b)
"""
_DEDUP = r""",
d AS (
  WITH r AS (
    SELECT *, CASE WHEN source LIKE 'telegram:%' THEN 'telegram' WHEN source LIKE 'rss:%' THEN 'rss' ELSE 'unknown' END AS source_type,
      CASE WHEN source LIKE 'telegram:%' THEN 3 WHEN source LIKE 'rss:%' THEN 2 ELSE 1 END AS rank,
      sentiment_label <> 'neu' OR coalesce(sentiment_score, 0) <> 0 AS felt,
      CASE WHEN batch_id LIKE '20%' THEN strptime(batch_id, '%Y-%m-%dT%H:%M:%SZ')
        WHEN regexp_matches(batch_id, '[0-9]{8}T[0-9]{6}Z') THEN strptime(regexp_extract(batch_id, '([0-9]{8}T[0-9]{6}Z)', 1), '%Y%m%dT%H%M%SZ')
        ELSE TIMESTAMP '1970-01-01' END AS loaded_at
    FROM articles),
  q AS (SELECT *, row(rank, clean_len >= 400, clean_len, lang <> 'unknown' OR keyphrases <> '' OR felt, entities_persons_canon <> '', felt,
                      persons_actions <> '' OR actions_verbs <> '', loaded_at, published_at, id, ingest_object_name) AS score FROM r),
  w AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY score DESC) AS n FROM q),
  f AS (SELECT dedup_key, arg_max(sentiment_score, score) AS known FROM q WHERE sentiment_score IS NOT NULL GROUP BY dedup_key)
  SELECT w.* EXCLUDE (sentiment_score, n, score), known AS sentiment_score, clean_len AS best_clean_len FROM w LEFT JOIN f USING (dedup_key) WHERE n = 1)
"""
_LOADS = r""",
loads AS (SELECT * FROM (VALUES ('gold_0.parquet', TIMESTAMP '2024-01-01 12:00:00'), ('gold_1.parquet', TIMESTAMP '2024-01-02 12:00:00'),
  ('gold_2.parquet', TIMESTAMP '2024-01-05 12:00:00'), ('gold_3.parquet', TIMESTAMP '2024-01-04 12:00:00'), ('gold_4.parquet', TIMESTAMP '2024-01-05 12:00:00'))
  AS t(object_name, loaded)),
byload AS (SELECT a.*, row(clean_len >= 40, clean_len, coalesce(loaded, TIMESTAMP '1970-01-01') = (SELECT max(loaded) FROM loads), published_at,
             coalesce(loaded, TIMESTAMP '1970-01-01'), id, ingest_object_name) AS score
           FROM articles AS a LEFT JOIN loads ON ingest_object_name = object_name)
"""
_COVERAGE = r"""
cov AS (SELECT 'b' || event_id AS batch_id, event_type AS source_type, 'u' || user_id % 50 AS source, ts - to_seconds(event_id % 60) AS run_started_at,
  ts AS run_finished_at, event_id % 60 * 1000 AS duration_ms, event_id % 100 AS items_found, event_id % 90 AS items_saved,
  CASE WHEN event_id % 5 <> 0 THEN ts - INTERVAL 20 DAY END AS min_published_at, CASE WHEN event_id % 7 <> 0 THEN ts - to_days((event_id % 30)::INT) END AS max_published_at,
  CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'error' END AS status, '' AS error_message, 'raw/' || event_id || '.json' AS raw_object_name FROM events),
last AS (SELECT c.* EXCLUDE (min_published_at, max_published_at),
  first_value(min_published_at IGNORE NULLS) OVER o AS min_published_at, first_value(max_published_at IGNORE NULLS) OVER o AS max_published_at
  FROM cov AS c WINDOW o AS (PARTITION BY source_type, source ORDER BY run_finished_at DESC, batch_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  QUALIFY row_number() OVER (PARTITION BY source_type, source ORDER BY run_finished_at DESC, batch_id DESC) = 1)
"""


def _a(sql: str) -> str:
    return f"WITH {_ARTICLES} {sql}"


def _d(sql: str) -> str:
    return f"WITH {_ARTICLES}{_DEDUP} {sql}"


_BODY = "count(*) FILTER (WHERE clean_len >= 40)"
_SHORT = "count(*) FILTER (WHERE clean_len < 40)"
_BATCH = "CASE WHEN batch_id = '' THEN ingest_object_name ELSE batch_id END AS batch_key"
_HOUR = "date_trunc('hour', published_at)"
_STOP = "('стать известно', 'стать', 'известно', 'назвать', 'рассказать', 'объяснить', 'раскрыть', 'новый')"
_TOPIC_STOP = "('стать известно', 'назвать', 'рассказать', 'объяснить', 'раскрыть', 'новый')"


def _items(column: str, keep: str, name: str, mark: str = ";") -> str:
    split = f"string_split({column}, ';')" if mark == ";" else f"string_split_regex({column}, '[;|]')"
    return f"(SELECT {keep}, lower(trim(x)) AS {name} FROM (SELECT *, unnest({split}) AS x FROM d) WHERE trim(x) <> '')"


_KW = f"(SELECT *, lower(trim(x)) AS kw FROM (SELECT *, unnest(string_split(keywords, ';')) AS x FROM d WHERE is_digest = 0) WHERE length(trim(x)) > 2)"
_PAIRS = r"""(SELECT * FROM (SELECT *, lower(trim(string_split(pair, ':')[1])) AS person, lower(trim(unnest(string_split(coalesce(string_split(pair, ':')[2], ''), ',')))) AS verb
  FROM (SELECT *, unnest(string_split(persons_actions, '|')) AS pair FROM d WHERE persons_actions <> '')) WHERE verb <> '')"""
_ARTICLE = "published_at, source, id, title, link, ingest_object_name, batch_id"
_WINDOW = "FROM d WHERE published_at >= (SELECT max(published_at) FROM d) - INTERVAL 24 HOUR"


def _entities(persons: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {_HOUR} AS ts_hour, source, lang, '{kind}' AS entity_type, unnest(string_split({column}, ';')) AS e FROM d"
        for kind, column in (("persons", persons), ("orgs", "entities_orgs"), ("geo", "entities_geo")))
    return f"SELECT ts_hour, source, lang, entity_type, lower(trim(e)) AS entity, count(*) AS cnt FROM ({parts}) WHERE trim(e) <> '' GROUP BY ALL"


_EMPTY_IDS = "count(*) FILTER (WHERE {0} = '') AS empty_{0}, round(count(*) FILTER (WHERE {0} = '') / count(*), 3) AS share_empty_{0}"
_SURVIVAL = f"""SELECT l.*, coalesce(winners, 0) AS winners, round(coalesce(winners, 0) / rows_loaded, 3) AS share_winners FROM
  (SELECT {_BATCH}, count(*) AS rows_loaded, {_BODY} AS has_body_rows, {_SHORT} AS title_only_rows, min(published_at) AS min_dt, max(published_at) AS max_dt
   FROM articles GROUP BY ALL) AS l LEFT JOIN (SELECT {_BATCH}, count(*) AS winners FROM d GROUP BY ALL) USING (batch_key)"""

ORACLES |= {
    "w03_dedup_v1": _a(f"{_LOADS} SELECT dedup_key, id, title, published_at, source, batch_id, ingest_object_name, keywords, clean_len AS best_clean_len FROM byload QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY score DESC) = 1"),
    "w04_dedup_v2": _a(f"""{_LOADS}, known AS (SELECT dedup_key, arg_max(sentiment_score, score) AS s FROM byload WHERE sentiment_score IS NOT NULL GROUP BY ALL)
      SELECT dedup_key, id, source, lang, keyphrases, sentiment_label, s AS sentiment_score, clean_len AS best_clean_len FROM byload LEFT JOIN known USING (dedup_key)
      QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY score DESC) = 1"""),
    "w05_dedup_v3": _d("SELECT dedup_key, id, source, source_type, published_at, lang, sentiment_label, sentiment_score, batch_id, entities_orgs_canon, entities_geo_canon, best_clean_len FROM d"),
    "w06_dedup_legacy": _a("""SELECT dedup_key, arg_max(id, s) AS id, max(published_at) AS published_at, arg_max(source, s) AS source, max(text_length_chars) AS text_length_chars,
      max(num_sentences) AS num_sentences, max(clean_len) AS best_clean_len FROM (SELECT *, row(clean_len, published_at, id, ingest_object_name) AS s FROM articles) GROUP BY dedup_key"""),
    "w07_coverage_latest": f"""WITH {_COVERAGE} SELECT *, (max_published_at IS NULL OR max_published_at < TIMESTAMP '2024-01-01')::INT AS is_stale,
      CASE WHEN max_published_at >= TIMESTAMP '2024-01-01' THEN date_diff('minute', max_published_at, TIMESTAMP '2024-01-15') END AS lag_minutes FROM last""",
    "v45_coverage_latest_plain": f"WITH {_COVERAGE} SELECT * FROM last",
    "v03_health_overview": _a("SELECT count(*) AS rows, min(published_at) AS min_dt, max(published_at) AS max_dt, count(*) FILTER (WHERE published_at < TIMESTAMP '2000-01-01') AS bad_dates FROM articles"),
    "v04_health_by_source": _a("SELECT source, count(*) AS cnt FROM articles GROUP BY source"),
    "v05_health_ids": _a(f"SELECT count(*) AS total, {_EMPTY_IDS.format('ingest_object_name')}, {_EMPTY_IDS.format('batch_id')} FROM articles"),
    "v06_content_quality": _a(f"SELECT count(*) AS total, {_BODY} AS has_body, {_SHORT} AS title_only, round({_BODY} / count(*), 3) AS share_has_body FROM articles"),
    "v07_title_only_examples": _a("SELECT id, title, link, published_at, source FROM articles WHERE clean_len < 40 ORDER BY published_at DESC, id LIMIT 10"),
    "v08_quality_by_batch": _a(f"SELECT {_BATCH}, count(*) AS total, {_BODY} AS has_body, {_SHORT} AS title_only, round({_BODY} / count(*), 3) AS share_has_body FROM articles GROUP BY ALL"),
    "v09_top_keywords_all": _d(f"SELECT kw, count(*) AS cnt FROM {_KW} WHERE kw NOT IN {_STOP} GROUP BY kw ORDER BY cnt DESC, kw LIMIT 30"),
    "v10_top_keywords_last_batch": _d(f"SELECT batch_id, kw, count(*) AS cnt FROM {_KW} WHERE kw NOT IN {_STOP} AND batch_id = (SELECT max(batch_id) FROM articles WHERE batch_id <> '') GROUP BY ALL ORDER BY cnt DESC, kw LIMIT 30"),
    "v11_entities_by_hour": _d(_entities("entities_persons_canon")),
    "v12_sentiment_by_hour": _d(f"SELECT {_HOUR} AS ts_hour, source, lang, count(*) AS cnt, avg(sentiment_score) AS sentiment_avg, quantile_cont(sentiment_score, 0.5) AS sentiment_p50 FROM d GROUP BY ALL"),
    "v13_topics_by_hour": _d(f"SELECT {_HOUR} AS hour, kw, count(*) AS cnt FROM {_KW} WHERE kw NOT IN {_TOPIC_STOP} GROUP BY ALL ORDER BY hour DESC, cnt DESC, kw LIMIT 50"),
    "v14_batches": _a(f"SELECT {_BATCH}, count(*) AS rows_loaded, {_BODY} AS has_body, {_SHORT} AS title_only, round({_BODY} / count(*), 3) AS share_has_body, min(published_at) AS min_dt, max(published_at) AS max_dt FROM articles GROUP BY ALL"),
    "v15_batch_survival": _d(_SURVIVAL),
    "v16_batch_internal_dupes": _a(f"""SELECT batch_key, sum(cnt)::BIGINT AS rows, count(*) AS uniq_keys, (sum(cnt) - count(*))::BIGINT AS duplicate_rows, count(*) FILTER (WHERE cnt > 1) AS duplicate_keys
      FROM (SELECT {_BATCH}, dedup_key, count(*) AS cnt FROM articles GROUP BY ALL) GROUP BY batch_key"""),
    "v17_batch_top_dupes": _a(f"SELECT {_BATCH}, dedup_key, count(*) AS c FROM articles GROUP BY ALL HAVING c > 1 ORDER BY c DESC, batch_key, dedup_key LIMIT 50"),
    "v32a_session_facts": "SELECT * FROM (VALUES ('ch_now', '2024-01-15 00:00:00'), ('ch_timezone', 'UTC')) AS t(kind, value)",
    "v32b_articles_total": _a("SELECT 'articles_total' AS kind, count(*) AS value FROM articles"),
    "v32b_articles_dedup_total": _d("SELECT 'articles_dedup_total' AS kind, count(*) AS value FROM d"),
    "v32c_top_sources_dedup": _d("SELECT 'top_sources_dedup' AS kind, source, count(*) AS cnt FROM d GROUP BY source ORDER BY cnt DESC, source LIMIT 30"),
    "v32d_lang_dedup": _d("SELECT 'lang_dedup' AS kind, lang, count(*) AS cnt FROM d GROUP BY lang ORDER BY cnt DESC, lang LIMIT 30"),
    "v32e_raw_status_columns": "SELECT 'raw_status_columns' AS kind, 'status' AS column_name, 'string' AS column_type",
    "v32f_dedup_last_24h": _d("SELECT 'dedup_last_24h' AS kind, count(*) AS value FROM d WHERE published_at >= TIMESTAMP '2024-01-01'"),
    "v32f_dedup_last_7d": _d("SELECT 'dedup_last_7d' AS kind, count(*) AS value FROM d WHERE published_at >= TIMESTAMP '2024-01-08'"),
    "v32f_dedup_last_30d": _d("SELECT 'dedup_last_30d' AS kind, count(*) AS value FROM d WHERE published_at >= TIMESTAMP '2023-12-16'"),
    "v32g_dedup_max_published_at": _d("SELECT 'dedup_max_published_at' AS kind, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS value FROM d"),
    "v33_persons_actions_flat": _d(f"SELECT {_ARTICLE}, person, verb FROM {_PAIRS} WHERE person <> ''"),
    "v34_persons_actions_narrow": _d(f"SELECT published_at AS ts, source, person, verb FROM {_PAIRS} WHERE contains(pair, ':')"),
    "v35_actions_verbs_flat": _d(f"SELECT * FROM {_items('actions_verbs', _ARTICLE, 'verb')}"),
    "v39a_bi_articles_by_hour": _d(f"SELECT {_HOUR} AS ts_hour, source, lang, count(*) AS cnt FROM d GROUP BY ALL"),
    "v39b_bi_keywords_by_hour": _d(f"SELECT {_HOUR} AS ts_hour, source, lang, keyword, count(*) AS cnt FROM {_items('keywords', 'published_at, source, lang', 'keyword')} GROUP BY ALL"),
    "v39c_bi_entities_by_hour": _d(_entities("entities_persons")),
    "v39d_bi_sentiment_merged": _d(f"SELECT {_HOUR} AS ts_hour, source, lang, count(*) AS cnt, avg(sentiment_score) AS sentiment_avg, quantile_disc(sentiment_score, 0.5) AS sentiment_p50 FROM d GROUP BY ALL"),
    "v43_sources_hourly_ts": _d(f"SELECT {_HOUR} AS ts_hour, source, count(*) AS articles FROM d GROUP BY ALL"),
    "v44_report_summary": _d(f"SELECT count(*) AS articles, count(DISTINCT source) AS sources, min(published_at) AS min_dt, max(published_at) AS max_dt, round(avg(text_length_chars), 1) AS avg_len_chars, round(avg(num_sentences), 2) AS avg_sentences, round(avg(num_keywords), 2) AS avg_keywords {_WINDOW}"),
    "v44_report_sources": _d(f"SELECT source, count(*) AS n {_WINDOW} GROUP BY source ORDER BY n DESC, source LIMIT 30"),
    "v44_report_hourly": _d(f"SELECT {_HOUR} AS hour, count(*) AS n {_WINDOW} GROUP BY hour"),
    "v44_report_keywords": _d(f"SELECT trim(kw) AS kw, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(keywords), '[,;|\\n]+')) AS kw {_WINDOW}) WHERE length(trim(kw)) > 1 GROUP BY ALL ORDER BY n DESC, kw LIMIT 30"),
}
for _key, _item, _column, _rows in (("persons_actions", "person", None, "actions_rows"), ("actions_verbs", "verb", "actions_verbs", "verb_rows")):
    _flat = f"(SELECT * FROM {_PAIRS} WHERE person <> '')" if _column is None else _items(_column, _ARTICLE, "verb")
    ORACLES[f"v36_{_key}_hourly"] = _d(f"SELECT {_HOUR} AS ts_hour, {_item}, count(*) AS {_rows}, count(DISTINCT id) AS articles FROM {_flat} GROUP BY ALL")
    ORACLES[f"v37_{_key}_events"] = _d(f"SELECT published_at::DATE AS dt, {_item}, count(*) AS {_rows}, count(DISTINCT id) AS articles FROM {_flat} GROUP BY ALL")
for _key, _column, _name in (("a_keywords", "keywords", "keyword"), ("b_keyphrases", "keyphrases", "keyphrase"), ("c_entities_persons", "entities_persons_canon", "person"),
                             ("d_entities_orgs", "entities_orgs_canon", "org"), ("e_entities_geo", "entities_geo_canon", "geo")):
    ORACLES[f"v38{_key}_flat"] = _d(f"SELECT published_at AS ts, source, {_name} FROM {_items(_column, 'published_at, source', _name)}")
for _key, _column, _name in (("geo", "entities_geo", "geo"), ("keywords", "keyphrases", "keyword")):
    _found = _items(_column, "published_at, source, link, title", _name, ";|")
    ORACLES[f"v41_{_key}_events"] = _d(f"SELECT * FROM {_found}")
    ORACLES[f"v42_{_key}_hourly"] = _d(f"SELECT {_HOUR} AS dt, source, {_name}, count(*) AS mentions FROM {_found} GROUP BY ALL")
    ORACLES[f"v43_{_key}_hourly_ts"] = _d(f"SELECT {_HOUR} AS ts_hour, source, {_name}, count(*) AS mentions FROM {_found} GROUP BY ALL")

_SHOWN = {"id": ("id", ("id",), ("source", "title")), "source_link": ("link", ("source", "link"), ("title",)),
          "source_title_time": (None, ("source", "title", "published_at"), ()), "dedup_key": ("dedup_key", ("dedup_key",), ("source", "title"))}


def _clean(column: str) -> str:
    return column if column == "published_at" else f"regexp_replace({column}, '[\\t\\r\\n]', ' ', 'g') AS {column}"


for _layer, _table, _with, _start in (("raw", "articles", _a, (18, 25)), ("dedup", "d", _d, (22, 29))):
    for _n, _how in enumerate(h for h in _SHOWN if _layer == "raw" or h != "source_title_time"):
        _named, _keys, _more = _SHOWN[_how]
        _last = ", max(published_at) AS max_published_at" if _named else ""
        _groups = (f"SELECT {', '.join(_keys)}, count(*) AS cnt{''.join(f', min({m}) AS {m}' for m in _more)}{_last} FROM {_table}"
                   f"{f" WHERE {_named} <> ''" if _named else ''} GROUP BY {', '.join(_keys)} HAVING count(*) > 1")
        _order = f"cnt DESC{', max_published_at DESC' if _named else ''}, {', '.join(_keys)}"
        ORACLES[f"v{_start[0] + _n}_{_layer}_dupe_{_how}"] = _with(
            f"SELECT '{_layer}_dupe_{_how}' AS kind, {', '.join(map(_clean, (*_keys, *_more)))}, cnt{', max_published_at' if _named else ''} FROM ({_groups} ORDER BY {_order} LIMIT 50)")
        ORACLES[f"v{_start[1] + _n}_{_layer}_dupe_{_how}_total"] = _with(f"SELECT '{_layer}_dupe_{_how}_total' AS kind, count(*) AS value FROM ({_groups})")
