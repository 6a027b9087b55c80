"""Raw to silver to gold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.functions import records as R
from presswell.functions.compat import items, text
from presswell.operators import dedup
from presswell.operators.summary import VerbHook, no_verbs, persons_actions, spoken, summary
from presswell.operators.terms import canon_persons, tfidf_keywords
from presswell.sources.shared import materialize


def silver(raw: DataFrame) -> DataFrame:
    """Raw records with an id, a source in one form, its type and a clean text."""
    col = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    name = R.source_name(col("source"), col("channel"), col("link"))
    fallback = F.concat(F.lit("raw_"), F.md5(F.concat_ws("|", text(col("title")), text(col("raw_text")))))
    return raw.withColumns({
        "id": R.raw_id(col("id"), col("uid"), col("link"), fallback=fallback), "source": name, "source_type": R.source_type(name),
        "clean_text": R.clean_html(F.coalesce(F.nullif(col("body"), F.lit("")), col("raw_text"))),
        "body_status": text(col("body_status")),
    })


def gold(
    found: DataFrame, published: bool = True, verbs: VerbHook = no_verbs, tagger=None, lemma=None, keep: Callable[[DataFrame], DataFrame] = lambda df: materialize(df, "gold-rows"),
) -> DataFrame:
    """Silver rows once each, of sufficient quality, with metrics and NLP columns.

    Rows keep their identity by what they are de-duplicated by, as ids may
    repeat.  ``keep`` writes the rows that all later steps read, so that the
    steps before run once.  ``verbs``, ``tagger`` and ``lemma`` are hooks;
    verbs of speech count as one, and those that say nothing are left out.
    """
    rows = found.withColumn("published_at", R.published_at(F.col("published_at"))) if published else found
    uid = F.col("uid") if "uid" in rows.columns else F.lit("")
    rows = rows.withColumn("id", R.gold_id(F.col("id"), uid, F.col("link"), F.col("source"), F.col("title"), F.col("published_at")))
    rows = dedup.within_batch(rows).where(R.passes_quality(F.col("body_status"), F.col("clean_text")))
    rows = rows.withColumns({"_row": F.md5(dedup.batch_dedup_key()), "nlp_text": F.trim(F.concat(text("title"), F.lit(". "), text("clean_text")))})
    rows = rows.withColumns({"_names": R.entities(F.col("nlp_text"), tagger), "lang": R.language(F.col("nlp_text")), "summary": summary("nlp_text")})
    kinds = ("persons", "orgs", "geo")
    rows = rows.withColumns({f"entities_{k}": F.array_join(F.col(f"_names.{k}"), "; ") for k in kinds} | {f"num_{k}": F.size(F.col(f"_names.{k}")) for k in kinds})
    rows = keep(rows.drop("_names"))
    rows = rows.join(tfidf_keywords(rows.select("_row", "nlp_text"), "_row", "nlp_text", lemma=lemma), "_row")
    canon = canon_persons(rows.select("_row", "entities_persons"), "_row", "entities_persons").withColumnRenamed("persons", "entities_persons_canon")
    rows = rows.join(canon, "_row").withColumns({
        "entities_orgs_canon": R.canon_orgs(F.col("entities_orgs")), "entities_geo_canon": R.canon_geo(F.col("entities_geo")),
        "_persons": R.without_lone_surnames(F.col("entities_persons_canon"))})
    rows = rows.join(persons_actions(rows.select("_row", "nlp_text", "_persons"), "_row", "nlp_text", "_persons", spoken(verbs)), "_row")
    phrases = R.merged_phrases(R.keyphrases(F.col("nlp_text"), F.col("lang"), lemma=lemma), F.col("keywords"))
    filled = F.trim("nlp_text") != ""
    rows = rows.withColumns({
        "persons": F.col("entities_persons_canon"), "geo": F.col("entities_geo_canon"),
        "text_length_chars": F.length("nlp_text").cast("long"), "num_sentences": F.size(R.sentences(F.col("nlp_text"))).cast("long"),
        "num_keywords": F.size(items("keywords")).cast("long"), "keyphrases": phrases, "keyphrases_ok": filled.cast("int"),
        "_felt": R.sentiment(F.col("summary"), F.col("nlp_text"), F.col("source_type") == "telegram")})
    rows = rows.withColumn("keyphrases_n", F.size(items("keyphrases")))
    return rows.withColumns({f"sentiment_{n}": F.col(f"_felt.{n}") for n in ("label", "score", "ok", "source", "input_len", "confidence")}).drop("_row", "_persons", "_felt")
