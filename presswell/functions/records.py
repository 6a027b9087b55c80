"""Record and text functions as native column expressions."""

from __future__ import annotations

from html.entities import html5
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswell.functions import constants as K
from presswell.functions.compat import once, text


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    # To the last character that is none, so that the text itself is not looked at one by one.
    return F.regexp_extract(c, r"(?Us)^\s*+(.*\S)", 1)


def squeeze(c: Column) -> Column:
    # Single spaces stay, as they are most of the matches otherwise.
    return strip(F.regexp_replace(c, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


#: Named references with their ';', and those that are known without one.
_NAMED = {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
_OLD_NAMES = sorted(n for n in html5 if not n.endswith(";"))
#: Numbers that stand for characters of the Windows code page.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore")}
_REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"


def _character(reference: Column) -> Column:
    """The character of one reference; the reference itself if there is none."""
    literal = lambda d: F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))
    name = F.regexp_replace(reference, "^&|;$", "")
    number = F.when(name.rlike("^#[0-9]{1,9}$"), F.substr(name, F.lit(2)).try_cast("bigint")).when(
        name.rlike("^#[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("bigint"))
    point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    invalid = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    numbered = F.coalesce(F.try_element_at(literal(_WINDOWS), number.cast("int")), F.when(invalid, "\ufffd").otherwise(point))
    named = F.when(reference.endswith(";") | name.isin(*_OLD_NAMES), F.try_element_at(literal(_NAMED), name))
    return F.coalesce(F.when(name.startswith("#"), F.when(number.isNotNull(), numbered).otherwise("\ufffd")).otherwise(named), reference)


def unescape(c: Column, bare: bool = True) -> Column:
    """Character references, named and numbered, as characters, in one pass.

    ``bare`` takes those without a ';' too, where HTML knows them.
    """
    reference = _REFERENCE if bare else _REFERENCE.removesuffix("?")

    def joined(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(reference), F.lit(0)), _character)
        return once(found, lambda fs: F.array_join(F.transform(F.split(t, reference), lambda p, i: F.concat(p, F.coalesce(F.get(fs, i), F.lit("")))), ""))

    return F.when(F.contains(c, F.lit("&")), joined(c)).otherwise(c)


def clean_html(c: Column, bare: bool = True) -> Column:
    """Text of a fragment of HTML; plain text only has its white space put right.

    A '<' begins a tag only before a letter, '/', '!' or '?'.  Without ``bare``
    a reference that no ';' ends, as where a text was cut off, stays as it is.
    """
    raw = text(c)
    plain = F.regexp_replace(F.regexp_replace(raw, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " "), "(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>", " ")
    cleaned = unescape(F.when(F.contains(raw, F.lit("<")) & F.contains(raw, F.lit(">")), plain).otherwise(raw), bare)
    return squeeze(F.regexp_replace(cleaned, r"(?U)\s+([,.!?;:])", "$1"))


def paragraphs(html: Column, least: int = 60, bare: bool = True) -> Column:
    """Texts of the paragraphs of at least ``least`` characters, a line each."""
    found = F.transform(F.regexp_extract_all(text(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: clean_html(p, bare))
    return F.array_join(F.filter(found, lambda p: F.length(p) >= least), "\n")


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(text(F.try_parse_url(url, F.lit("AUTHORITY")))), r"^www\.", "")


def extractor(url: Column) -> Column:
    """Which site's rules find the body of a page; '' for the general ones."""
    host = F.lower(text(F.try_parse_url(url, F.lit("AUTHORITY"))))
    return (F.when(F.contains(host, F.lit("lenta.ru")), "lenta").when(host.endswith("ria.ru") | F.contains(host, F.lit(".ria.ru")), "ria")
            .when(host.endswith("tass.ru") | F.contains(host, F.lit(".tass.ru")), "tass").otherwise(""))


def body_status(body: Column, link: Column, rss: Column, html: Column, extracted: Column, least: int = 400) -> Column:
    """State of an enriched record, from what was there and what was fetched."""
    return (
        F.when(F.length(strip(text(body))) > 0, "already_present").when(strip(text(link)) == "", F.when(F.length(text(rss)) >= least, "ok_rss").otherwise("no_link"))
        .when(html.isNull(), "fetch_failed").when(text(extracted) == "", "parsed_empty").when(F.length(extracted) < least, "too_short").otherwise("ok")
    )


def source_type(source: Column) -> Column:
    s = F.lower(strip(text(source)))
    return F.when(s.startswith("telegram:"), "telegram").when(s.startswith("rss:"), "rss").otherwise("other")


def mined_source(source: Column, kind: Column, link: Column) -> Column:
    """Struct (source, source_type) under which terms are counted.

    A stated type of rss or telegram holds, then the prefix; else a source with
    a dot is a domain, and a link to a domain makes it rss too.  Without a source
    the link's domain, or the type, stands in.
    """
    s, stated, host = F.lower(strip(text(source))), F.lower(strip(text(kind))), text(domain(link))
    first = F.when(stated.isin("rss", "telegram"), stated).otherwise(source_type(s))
    linked = F.contains(host, F.lit("."))
    found = F.when(first != "other", first).when(F.contains(s, F.lit(".")) | linked, "rss").otherwise("other")
    by_link = (first == "other") & ~F.contains(s, F.lit(".")) & linked
    name = F.when(s != "", s).when(by_link, host).otherwise(found)
    prefixed = F.when((found == "other") | name.startswith(F.concat(found, F.lit(":"))), name).otherwise(F.concat(found, F.lit(":"), name))
    return F.struct(prefixed.alias("source"), found.alias("source_type"))


def source_name(source: Column, channel: Column, link: Column) -> Column:
    """telegram:<channel>, rss:<domain>, or what there is."""
    s = strip(text(source))
    known = F.lower(s).rlike("^(telegram|rss):.")
    host = domain(link)
    telegram = F.concat(F.lit("telegram:"), F.regexp_replace(F.lower(strip(text(channel))), "^@", ""))
    return (
        F.when(known, F.concat(F.lower(F.split_part(s, F.lit(":"), F.lit(1))), F.lit(":"), F.regexp_replace(s, "^[^:]*:", "")))
        .when(strip(text(channel)) != "", telegram).when(host == "t.me", F.concat(F.lit("telegram:"), F.lower(text(F.try_parse_url(link, F.lit("PATH"))))))
        .when(host != "", F.concat(F.lit("rss:"), host)).when(s.rlike(r"^[\w-]+(\.[\w-]+)+$"), F.concat(F.lit("rss:"), F.lower(s))).otherwise(s)
    )


def raw_id(*candidates: Column, fallback: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(text(c)), F.lit("")) for c in candidates], fallback)


def gold_id(id_: Column, uid: Column, link: Column, source: Column, title: Column, published: Column) -> Column:
    """The id, the uid, or a digest of the link, or of source, title and time."""
    rest = F.concat_ws("|", text(source), text(title), F.coalesce(published.cast("string"), F.lit("")))
    first = [F.nullif(strip(text(c)), F.lit("")) for c in (id_, uid)]
    return F.coalesce(*first, F.when(strip(text(link)) != "", F.md5(strip(link))), F.md5(rest))


def published_at(raw: Column, zone: str = "Europe/Moscow") -> Column:
    """Wall-clock time in ``zone`` of an ISO 8601 or RFC 2822 time; null before 2000."""
    s = strip(text(raw))
    mail = F.regexp_replace(F.regexp_replace(s, r"^\w{3}, ", ""), " (GMT|UTC|UT)$", " +0000")
    parsed = F.coalesce(F.try_to_timestamp(F.nullif(s, F.lit(""))), F.try_to_timestamp(F.nullif(mail, F.lit("")), F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.when(parsed >= F.lit("2000-01-01 00:00:00").cast("timestamp"), F.from_utc_timestamp(parsed, zone)).cast("timestamp_ntz")


def sentences(c: Column) -> Column:
    """Sentences that end in . ! ? before a capital or a digit."""
    parts = F.split(squeeze(text(c)), r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def tokens(c: Column, pattern: str = r"[A-Za-zА-Яа-яЁё]{2,}") -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(pattern), F.lit(0))


def normalized(c: Column) -> Column:
    """Lower case, ё as е, without links, mentions, tags and technical words."""
    t = F.replace(F.lower(text(c)), F.lit("ё"), F.lit("е"))
    for pattern in (r"https?://\S+|www\.\S+", r"@[\w_]+", r"#[\w_]+", r"\b(amp|utm_[a-z_]+|t\.me|telegram)\b"):
        t = F.regexp_replace(t, pattern, " ")
    return squeeze(t)


def language(c: Column) -> Column:
    """ru, en, mixed or unknown by the letters' scripts."""
    def judged(letters: Column) -> Column:
        cyr, lat = letters["cyr"], letters["lat"]
        total = cyr + lat
        between = lambda x: (10 * x >= 3 * total) & (10 * x <= 7 * total)
        return (
            F.when((total >= 40) & between(cyr) & between(lat), "mixed").when(total < 15, "unknown")
            .when(cyr >= 2 * lat, "ru").when(lat >= 2 * cyr, "en").otherwise("unknown")
        )

    # White space is no letter of either script.
    count = lambda others: F.length(F.regexp_replace(text(c), others, ""))
    return once(F.struct(count("[^Ѐ-ԯ]+").alias("cyr"), count("[^A-z]+").alias("lat")), judged)


def coarse_language(c: Column, known: Column) -> Column:
    """A known ru or en, or else the script of which there are 20 letters and twice the other's."""
    given, t = F.lower(strip(text(known))), text(c)
    letters = F.struct(F.length(F.regexp_replace(t, "[^А-яЁё]+", "")).alias("cyr"), F.length(F.regexp_replace(t, "[^A-z]+", "")).alias("lat"))
    at_least = lambda a, b: a >= F.greatest(F.lit(20), 2 * b)
    judged = lambda x: F.when(at_least(x["cyr"], x["lat"]), "ru").when(at_least(x["lat"], x["cyr"]), "en").otherwise("unknown")
    return F.when(given.isin("ru", "en"), given).otherwise(once(letters, judged))


def language_reason(c: Column, lang: Column) -> Column:
    """Why a language is unknown."""
    rest = F.when(language(c) == "mixed", "mixed_script").when(lang == "unknown", "unknown").otherwise("ok")
    return once(F.length(strip(text(c))), lambda n: F.when(n == 0, "empty").when(n < 20, "short_text").otherwise(rest))


def telegram_title(c: Column, missing: str = "Telegram post") -> Column:
    """First line with text, at most 120 characters."""
    first = F.try_element_at(F.filter(F.transform(F.split(text(c), "\n"), strip), lambda x: x != ""), F.lit(1))
    return F.when(first.isNull(), missing).when(F.length(first) > 120, F.concat(F.rtrim(F.substring(first, 1, 120)), F.lit("…"))).otherwise(first)


def report_key(start: str, end: str, hours: int) -> str:
    """The one key of a window's report, so that a repeated run overwrites it."""
    part = lambda t: "".join(c for c in t.strip().replace(" ", "T") if c.isdigit() or c in "T-")
    return f"reports/daily/last_hours={hours}/dt_from={part(start)}/dt_to={part(end)}/report.md"


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text(c))), r"[^a-z0-9._-]+", "-")


def file_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(text(c), r"[^\w\-.]", "_"), 1, 140)


def valid_channel(c: Column) -> Column:
    return text(c).rlike("^@?[A-Za-z0-9_]{3,32}$")


def valid_feed(c: Column) -> Column:
    return text(c).rlike("^https?://[^ ]+$")


def passes_quality(status: Column, clean: Column) -> Column:
    return ~F.trim(text(status)).isin(*K.EXCLUDED_BODY_STATUS) & (F.length(text(clean)) >= K.MIN_CLEAN_CHARS)


# ---- entities -------------------------------------------------------------

def _clean_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.replace(F.lower(text(c)), F.lit("ё"), F.lit("е")), r"\s*\([^)]*\)", ""))


def _lookup(c: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def _name_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-zА-Яа-яЁё-]+"), F.lit(0))


def _each(c: Column, canon) -> Column:
    names = F.transform(F.filter(F.transform(F.split(text(c), ";"), strip), lambda x: x != ""), canon)
    return F.array_join(F.array_distinct(F.filter(names, lambda x: x != "")), ";")


def canon_geo(c: Column) -> Column:
    """Places of a ';' list, cleaned, with their synonyms, in order, once each."""
    return _each(c, lambda x: _lookup(F.array_join(_name_tokens(_clean_name(x)), " "), K.GEO_SYNONYMS))


def canon_orgs(c: Column) -> Column:
    """Organisations of a ';' list without quotes, legal forms and general tails."""
    def one(x: Column) -> Column:
        s = F.regexp_replace(_clean_name(x), '["“”„«»]', "")
        s = strip(F.regexp_replace(s, rf"^({K.ORG_LEGAL})\s+|\s+({K.ORG_LEGAL})$", ""))
        s = squeeze(F.regexp_replace(s, rf"\s+({K.ORG_TAIL})$", ""))
        s = F.array_join(_name_tokens(s), " ")
        s = F.regexp_replace(s, rf"(^|.* )([a-zа-я-]+) ({'|'.join(K.DOMAINS)})$", "$1$2.$3")
        single = ~F.contains(s, F.lit(" "))
        noise = single & (s.isin(*K.ORG_SINGLE_STOP) | s.rlike(rf"^.+({K.ORG_ADJECTIVE})$"))
        ministry = s.rlike("министерство обороны|министерство оборона") & s.rlike(r"(^| )(рф|россия|российск[а-я]*)( |$)")
        return _lookup(F.when(noise, "").when(ministry, "минобороны").otherwise(s), K.ORG_SYNONYMS)

    return _each(c, one)


_CAPITALISED = "(?:[А-ЯЁ][а-яё]+|[A-Z][a-z]+)"


def _folded(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def first_of_each(names: Column) -> Column:
    """The names in order, of those that agree but for case and ё the first."""
    same = lambda ns: once(F.transform(ns, _folded), lambda ks: F.filter(ns, lambda _, i: F.array_position(ks, F.get(ks, i)) == i + 1))
    return once(names, same)


def entity_name(c: Column) -> Column:
    """A name without marks, ё as е."""
    return squeeze(F.regexp_replace(F.translate(text(c), "ёЁ", "еЕ"), "[^0-9A-Za-zА-Яа-яЁё\\- ]+", " "))


def capitalised(c: Column, most: int = 10) -> Column:
    """Runs of one to three capitalised words, once each, without titles and sentence starts."""
    found = F.regexp_extract_all(text(c), F.lit(rf"(?U)\b{_CAPITALISED}(?:\s+{_CAPITALISED}){{0,2}}\b"), F.lit(0))
    names = F.filter(F.transform(found, entity_name), lambda x: (x != "") & ~F.lower(x).isin(*K.ENTITY_SINGLE)
                     & ~_folded(F.split_part(x, F.lit(" "), F.lit(1))).isin(*K.ENTITY_BAD_START))
    return F.slice(first_of_each(names), 1, most)


def entities(c: Column, tagger=None, most: int = 10) -> Column:
    """struct(persons, orgs, geo): what a tagger finds, and capitalised runs as persons.

    ``tagger`` takes the text to a struct of three arrays of names; without one
    all runs count as persons.
    """
    runs = capitalised(c, most)
    if tagger is None:
        none = F.array().cast("array<string>")
        return F.struct(runs.alias("persons"), none.alias("orgs"), none.alias("geo"))
    clean = lambda names: F.slice(first_of_each(F.filter(F.transform(names, entity_name), lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(*K.ENTITY_SINGLE))), 1, most)
    found = tagger(c)
    persons = once(clean(found["persons"]), lambda ps: F.when(F.size(ps) > 0, F.slice(first_of_each(F.concat(ps, runs)), 1, most)).otherwise(runs))
    return F.struct(persons.alias("persons"), clean(found["orgs"]).alias("orgs"), clean(found["geo"]).alias("geo"))


def without_lone_surnames(c: Column) -> Column:
    """A ';' list of persons without lone surnames that a full name of the list has, in either case form."""
    base = lambda x: once(_folded(x), lambda l: F.when((F.length(l) > 2) & l.rlike("[ая]$"), F.regexp_replace(l, "[ая]$", "")).otherwise(l))  # noqa: E731, E741
    names = F.array_distinct(F.filter(F.transform(F.split(text(c), ";"), strip), lambda x: x != ""))

    def kept(ns: Column) -> Column:
        full = F.transform(F.filter(ns, lambda n: F.contains(n, F.lit(" "))), lambda n: F.element_at(F.split(n, " "), -1))
        lasts = F.concat(full, F.transform(full, base))
        return once(lasts, lambda ls: F.filter(ns, lambda n: F.contains(n, F.lit(" ")) | ~(F.array_contains(ls, n) | F.array_contains(ls, base(n)))))

    return F.array_join(once(names, kept), ";")


# ---- key phrases and sentiment ----------------------------------------------

def keyphrases(c: Column, lang: Column, most: int = 30, longest: int = 3, lemma=None, domain: list[str] | None = None) -> Column:
    """Phrases of one to three words without stop words.

    A phrase inside a longer one is left out; the longest come first, then by
    alphabet.  Frequency plays no part in the order, so nothing is counted.
    Between stop words, runs of ``longest`` words are looked at, and where there
    are fewer all of them: a shorter phrase lies inside one of these, and is no
    better than it, so it would be left out.  ``lemma`` takes a word to its base
    form; ``domain`` adds Russian stop words.
    """
    words = F.regexp_extract_all(F.lower(text(c)), F.lit("[A-Za-zА-Яа-яЁё-]+"), F.lit(0))
    if lemma is not None:
        words = F.transform(words, lambda w: F.when(lang == "ru", lemma(w)).otherwise(w))
    listed = F.coalesce(lang.isin("ru", "en"), F.lit(False))
    stops = lambda w: F.when(lang == "ru", w.isin(*K.STOP_RU, *(domain or []))).when(lang == "en", w.isin(*K.STOP_EN)).otherwise(F.lit(False))

    def widest(ws: Column) -> Column:
        """The run of words from each place: of full width, or a whole shorter run; else null."""
        def one(w: Column, i: Column) -> Column:
            # A stop word is null in place, and so is all that reaches across it.
            joined = [F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(ws, i + k))]) if n > 1 else w for n in range(longest, 0, -1)]
            return F.coalesce(joined[0], F.when(F.get(ws, i - 1).isNull(), F.coalesce(*joined[1:]))) if longest > 1 else w

        return F.array_distinct(F.array_compact(F.transform(ws, one)))

    def useless(p: Column) -> Column:
        """Whether all words are short, or all only make noise."""
        noise = F.forall(F.split(p, " "), lambda w: w.isin(*K.DOMAIN_TERMS)) & (listed | ~F.contains(p, F.lit(" ")))
        return ~p.rlike("[^ ]{3}") | noise | p.isin(*K.GENERIC_SINGLE)

    return _longest_first(once(F.transform(words, lambda w: F.when(~stops(w), w)), widest), most, useless)


def _longest_first(phrases: Column, most: int, useless) -> Column:
    """The first ``most`` useful ones by length, then alphabet, that no longer one contains.

    A containing phrase comes earlier, and is itself kept or inside a kept one,
    so each phrase is only compared with those kept so far.
    """
    ranked = F.sort_array(F.transform(phrases, lambda p: F.struct((-F.length(p)).alias("size"), p.alias("p"))))
    passed = lambda kept, p: (F.size(kept) >= most) | F.exists(kept, lambda q: F.contains(q, p)) | useless(p)
    return F.aggregate(ranked, F.array().cast("array<string>"), lambda kept, r: F.when(passed(kept, r["p"]), kept).otherwise(F.concat(kept, F.array(r["p"]))))


def merged_phrases(phrases: Column, keywords: Column, most: int = 15) -> Column:
    """Key phrases, then keywords, once each, as a ';' list."""
    more = F.filter(F.transform(F.split(text(keywords), ";"), lambda x: F.lower(strip(x))), lambda x: x != "")
    return F.array_join(F.slice(F.array_distinct(F.concat(phrases, more)), 1, most), ";")


def lexicon_score(c: Column) -> Column:
    """Sum of lexicon hits over three, within -1 and 1; null without a word.

    A hit counts the other way if one of the two words before it negates.
    """
    words = F.regexp_extract_all(F.lower(text(c)), F.lit("[а-яa-zё]+"), F.lit(0))

    def total(ws: Column) -> Column:
        negated = lambda i: F.coalesce(F.get(ws, i - 1).isin(*K.NEGATORS), F.lit(False)) | F.coalesce(F.get(ws, i - 2).isin(*K.NEGATORS), F.lit(False))
        value = lambda w: F.when(w.isin(*K.POSITIVE), 1).when(w.isin(*K.NEGATIVE), -1).otherwise(0)
        hits = F.transform(ws, lambda w, i: F.when(negated(i), -value(w)).otherwise(value(w)))
        summed = F.aggregate(hits, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(ws) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), summed / F.lit(3.0))))

    return once(words, total)


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.15, "pos").when(score < -0.15, "neg").when(score.isNotNull(), "neu").otherwise("")


def sentiment(summary: Column, body: Column, telegram: Column | None = None, least_chars: int = 120, least_words: int = 8, least_confidence: float = 0.2) -> Column:
    """struct(label, score, ok, source, input_len, confidence) of the summary, or else the text.

    Short inputs have none.  The lexicon's confidence is the score's size, and a
    tenth for neutral ones, so that neutral results are not accepted.  Where
    ``telegram`` holds, only a trained model would do, and there is none.
    """
    given = strip(text(summary)) != ""
    forced = F.lit(False) if telegram is None else F.coalesce(telegram, F.lit(False))

    def felt(base: Column) -> Column:
        source = F.when(given, "summary").when(base != "", "text").otherwise("empty")
        words = F.size(F.regexp_extract_all(F.lower(base), F.lit("[а-яa-zё]+"), F.lit(0)))
        short = (F.length(squeeze(base)) < least_chars) | (words < least_words)

        def judged(x: Column) -> Column:
            score, label = x["score"], sentiment_label(x["score"])
            confidence = F.when(label == "neu", 0.1).otherwise(F.least(F.lit(1.0), F.abs(score)))
            value = F.when(label == "neu", 0.0).otherwise(score)
            counts = ~x["short"] & ~forced
            ok = F.coalesce(counts & (confidence >= least_confidence), F.lit(False))
            why = F.when(base == "", source).when(x["short"], "empty").when(forced, "transformers_missing").otherwise("lexicon")
            return F.struct(
                F.when(ok, label).otherwise("").alias("label"), F.when(ok, value).alias("score"), ok.cast("int").alias("ok"), why.alias("source"),
                F.length(base).alias("input_len"), F.when(counts & (base != ""), confidence).alias("confidence"))

        return once(F.struct(lexicon_score(base).alias("score"), short.alias("short")), judged)

    return once(sentiment_input(summary, body), felt)


def sentiment_input(summary: Column, body: Column, least: int = 120, most: int = 1500) -> Column:
    """The summary, or else a long enough text, cut to ``most`` characters."""
    long_enough = once(strip(text(body)), lambda b: F.when(F.length(b) >= least, F.substring(b, 1, most)).otherwise(""))
    return once(strip(text(summary)), lambda s: F.when(s != "", F.substring(s, 1, most)).otherwise(long_enough))


def preview(title: Column, *fields: Column, most: int = 200) -> Column:
    """The longest field that is not the title, shortened."""
    t = strip(text(title))
    sized = F.array(*[F.struct(F.when(strip(text(f)) == t, -1).otherwise(F.length(strip(text(f)))).alias("n"), strip(text(f)).alias("s")) for f in fields])
    best = F.array_max(sized)["s"]
    return F.when(F.length(best) > most, F.concat(F.rtrim(F.substring(best, 1, most - 1)), F.lit("…"))).otherwise(best)
