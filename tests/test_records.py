"""Text functions on hand-computed rows."""

import time
from datetime import datetime

import compare
import pytest
from pyspark.sql import functions as F

from presswell.functions import records as R
from presswell.operators.summary import listed_verbs, persons_actions, summarize
from presswell.operators.terms import canon_persons, tfidf_keywords
from presswell.plans import kept, text, warehouse, warehouse_oracles  # noqa: F401  they fill the registry
from presswell.plans.registry import ORACLES, QUERIES


def apply(spark, build, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string").withColumn("y", build(F.col("x")))
    return [r["y"] for r in df.orderBy("i").collect()]


def value(spark, build, x):
    return apply(spark, build, x)[0]


CASES = {
    "html": (R.clean_html, {"<p>A&nbsp;b <b>c</b> .</p><script>x<1</script>": "A b c.", "a  b\n!": "a b!", "": "", None: "", "x &amp;lt; y": "x &lt; y"}),
    "domain": (R.domain, {"https://www.Ria.ru/x": "ria.ru", "nothing": "", None: "", "http://a.b:80/": "a.b:80"}),
    "language": (R.language, {"слово " * 4: "ru", "word " * 4: "en", "short": "unknown", "": "unknown", None: "unknown", "слово word " * 8: "mixed"}),
    "normalized": (R.normalized, {"Ёлка @me #tag https://t.me/x utm_source amp z": "елка z", None: ""}),
    "geo": (R.canon_geo, {"РФ; Россия;Евросоюз": "россия;ес", "": "", None: "", "Ёлки (город)": "елки"}),
    "orgs": (R.canon_orgs, {"ООО «Ромашка»; Банк; газета ru": "ромашка;газета.ru", "Министерство обороны РФ": "минобороны", "городской": "", None: ""}),
    "label": (lambda c: R.sentiment_label(R.lexicon_score(c)), {"это успех": "pos", "не успех": "neg", "не очень большой успех": "pos", "дом": "neu", "": "", None: ""}),
    "title": (R.telegram_title, {"\n  first\nsecond": "first", "": "Telegram post", None: "Telegram post", "x" * 130: "x" * 120 + "…"}),
    "phrases": (lambda c: F.array_join(R.keyphrases(c, F.lit("en")), ";"), {"the red fox of art": "red fox;art", "of the": "", "a bc de": "", None: "", "art party": "art party"}),
    "sentences": (lambda c: F.size(R.sentences(c)), {"One. Two! three? 4 is.": 3, "": 0, None: 0}),
}


@pytest.mark.parametrize("name", CASES)
def test_text_function(spark, name):
    build, cases = CASES[name]
    assert apply(spark, build, *cases) == list(cases.values())


def test_white_space_of_any_script(spark):
    odd = ["", " ", "\u2003a\u00a0", "a", " a  b\n", "\n\n a\tb \U0001f642\u3000", "\x85a\u2028b\x85", " " * 30_000, "a" + " " * 30_000 + "b", "x\r\ny z"]
    assert apply(spark, R.strip, *odd, None) == [x.strip() for x in odd] + [None]
    assert apply(spark, R.squeeze, *odd, None) == [" ".join(x.split()) for x in odd] + [None]


@pytest.mark.parametrize("build", [R.language, lambda c: R.language_reason(c, F.lit("en")), lambda c: R.coarse_language(c, F.lit(None)), lambda c: R.sentiment(c, c)["label"]])
def test_letters_are_counted_once(spark, build):
    plan = spark.range(1).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).select(build(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count(p) for p in ("[^A-z]", "[а-яa-zё]+", r"(.*\S)")) <= 8


def test_published_at(spark):
    got = apply(spark, R.published_at, "2024-01-01T00:00:00Z", "Mon, 01 Jan 2024 00:00:00 GMT", "01 Jan 2024 03:00:00 +0300", "1999-12-31T00:00:00Z", "soon", "", None)
    assert got == [datetime(2024, 1, 1, 3)] * 3 + [None] * 4


def test_tfidf_fallback_and_nesting(spark):
    two = spark.createDataFrame([(1, "alpha alpha beta"), (2, None)], "id int, text string")
    assert {r["id"]: r["keywords"] for r in tfidf_keywords(two, "id", "text").collect()} == {1: "alpha; beta", 2: ""}
    five = spark.createDataFrame([(i, "common word" + f" only{'abcde'[i]}") for i in range(5)], "id int, text string")
    got = {r["id"]: r["keywords"] for r in tfidf_keywords(five, "id", "text").collect()}
    assert got[0] == "common word onlya"


def test_persons_over_the_batch(spark):
    rows = [(1, "Иван Петров;Петрова"), (2, "Петров"), (3, "Ивановы;РФ"), (4, None)]
    got = {r["id"]: r["persons"] for r in canon_persons(spark.createDataFrame(rows, "id int, p string"), "id", "p").collect()}
    assert got == {1: "иван петров", 2: "иван петров", 3: "", 4: ""}


def test_actions(spark):
    df = spark.createDataFrame([(1, "Ann said it. Ann went and said. Bob went.", "Ann;Bob"), (2, None, None)], "id int, t string, p string")
    got = {r["id"]: (r[1], r[2]) for r in persons_actions(df, "id", "t", "p", listed_verbs("said", "went")).collect()}
    assert got == {1: ("ann:said,went|bob:went", "said;went"), 2: ("", "")}


def test_summary_weighs_a_long_text_as_a_whole():
    tail = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}"
    long = [f"Alpha beta gamma delta epsilon number{tail(i)} here." for i in range(450)]
    # Two are the longest; by blocks of 400 only the last is weighed against 50 others.
    long[380] = "Seven rare words stand only within this single sentence."
    long[430] = "Other quite uncommon terms appear inside that closing line."
    assert summarize(" ".join(long)) == " ".join([long[0], long[380], long[430]])


def test_the_words_of_a_long_text_are_counted_once():
    def seconds(many):
        text = " ".join(f"Word{i}a {' '.join(f'w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + j)}' for j in range(12))}." for i in range(many))
        begin = time.process_time()
        assert len(summarize(text).split(". ")) == 3
        return time.process_time() - begin

    # In proportion; a copy of all words for each sentence took more than three times as long for each doubling.
    seconds(50)
    assert seconds(2000) < 8 * seconds(500)


def test_summary():
    long = "Alpha beta gamma delta epsilon words. " * 1 + "Zeta eta theta iota kappa lambda. " + "Mu nu xi omicron pi rho sigma. " + "Tau upsilon phi chi psi omega one."
    assert summarize(None) == summarize("") == ""
    assert summarize("One short.") == "One short."
    assert len(summarize(long).split(". ")) == 3
    assert len(summarize("Alpha beta gamma delta epsilon words here. " * 5000)) <= 700


def test_character_references(spark):
    raw = "&#8212;&copy;&#x27;&amp;lt; &notaname; &eacute &#150; &#0; &#99999999; a < b then c > d <b>x</b><!-- c > d --> y"
    assert value(spark, R.clean_html, raw) == "—©'&lt; &notaname; é – \ufffd \ufffd a < b then c > d x y"


def test_references_that_are_cut_off(spark, tmp_path):
    pages = [(1, "u", "<title>a&amp;b &amp</title><p>c &am"), (2, "u", "x &eacute;&copy y &amp")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert compare.differences(QUERIES["f01_clean_html"](spark, str(tmp_path)), ORACLES["f01_clean_html"], compare.connect(str(tmp_path))) == ""
    assert value(spark, R.clean_html, "a &amp b") == "a & b"


def test_entities(spark):
    got = value(spark, R.capitalised, "В Москве Президент Иван Петров и Ёлкин. Елкин ушёл. The Court said. McDonald Иван  Петров.")
    assert got == ["Москве Президент Иван", "Петров", "Елкин", "The Court", "Иван Петров"]
    tagger = lambda c: F.struct(F.array(F.lit("Анна Ли"), F.lit("Президент")).alias("persons"), F.array(F.lit("ООН")).alias("orgs"), F.array().cast("array<string>").alias("geo"))
    found = value(spark, lambda c: R.entities(c, tagger), "Анна Ли и Пётр")
    assert (found["persons"], found["orgs"], found["geo"]) == (["Анна Ли", "Петр"], ["ООН"], [])
    assert value(spark, R.entities, "") ["persons"] == []


def test_lone_surnames(spark):
    assert value(spark, R.without_lone_surnames, "иван петров; петрова;сидоров;Иван Петров") == "иван петров;сидоров;Иван Петров"
    assert value(spark, R.without_lone_surnames, None) == ""


def test_sentiment_gate(spark):
    long = "прекрасно отлично " + "слово " * 25
    felt = lambda s, b, telegram: value(spark, lambda c: R.sentiment(F.lit(s), c, F.lit(telegram)), b)
    assert felt("", long, False)["label"] == "pos" and felt("", long, True)["source"] == "transformers_missing"
    assert (felt(long, "x", False)["ok"], felt("прекрасно", long, False)["ok"], felt("", "", False)["source"]) == (1, 0, "empty")


def test_keyphrases_leave_noise_out(spark):
    got = value(spark, lambda c: R.keyphrases(c, F.lit("en")), "news said the report of interview market prices")
    assert got == ["interview market prices"]
    assert value(spark, lambda c: R.keyphrases(c, F.lit("en"), lemma=None), "news said") == []
    # Runs of four and two words; noise and short words; other languages have no stop words and keep runs of noise.
    assert value(spark, lambda c: R.keyphrases(c, F.lit("en")), "alpha beta gamma delta of epsilon eta of news report said of ab cd") == ["alpha beta gamma", "beta gamma delta", "epsilon eta"]
    assert value(spark, lambda c: R.keyphrases(c, F.lit(None).cast("string")), "news report") == ["news report"]
    assert value(spark, lambda c: R.keyphrases(c, F.lit("de"), most=1), "news of report") == ["news of report"]


def test_site_bodies():
    from presswell.functions import bodies
    line = "A sentence that is long enough to count as one. " * 5
    page = f"<html><script>x</script><div class='a topic-body__content'><p>{line}<p>{line}</div><article><p>other</p></article></html>"
    assert bodies.body(page, "lenta") == f"{line.strip()}\n{line.strip()}"
    assert bodies.body(f"<div class=article__text>{line}</div>", "ria") == line.strip() and bodies.body("<p>short</p>", "ria") == ""
    assert bodies.body(f"<article><ul><li>{line}</li><li>tiny</li></ul></article>", "tass") == line.strip()
    assert bodies.body(f"<p>{line}</p><p>short</p>", "") == line.strip() and bodies.body(None, "") == ""
    assert len(bodies.body("<p>" + "word " * 30_000 + "</p><p>" + line + "</p>", "")) < 160_000


def test_extractor_of_host(spark):
    got = [value(spark, R.extractor, u) for u in ("https://lenta.ru/a", "https://m.ria.ru/b", "http://tass.ru", "https://example.com", None)]
    assert got == ["lenta", "ria", "tass", "", ""]
