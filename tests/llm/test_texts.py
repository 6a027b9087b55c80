"""Fill-in-the-middle, WARC archives, phrase mining, long pieces: brute force, round trips, odd rows."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from presswell.llm import bpe, fim, phrases, warc

MIXED = ["", None, "a", "ab cd", "🙂a🙂🙂b", "é<P>x", "a<M>", "<<S>", "\n\nab\n", "a\U0001f600", "a\r\n b", "x<P", "\x85 a"]


def noise(rng, alphabet, size):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))


# ---- fill in the middle -----------------------------------------------------

@pytest.mark.parametrize(("grammar", "units"), [
    (fim.LETTERS, r"[A-Za-z]+|[^A-Za-z]"), (fim.WORDS, r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), (fim.LINES, r"[^\n]*\n|[^\n]+"), (fim.CHARACTERS, r"[\s\S]"),
    (fim.Grammar(runs=("A-Z", "0-9")), r"[A-Z]+|[0-9]+|[^A-Z0-9]"),
])
def test_units(spark, grammar, units):
    rng = random.Random(1)
    texts = MIXED + [noise(rng, "abA0 9\n🙂é.<>PSM\t", 40) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, own in df.select("text", fim.units(F.col("text"), grammar)).collect():
        assert own == re.findall(units, text or "")


def slow_transform(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fim_is_the_slow_one_and_goes_back(spark, odd):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(MIXED + [noise(rng, "ab A.\n🙂é<PSM>", 60) for _ in range(400)])] + [(2**60 + 1, "big id"), (None, "no id")]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string")
    for df in (plain, odd):
        got = Counter(tuple(r) for r in fim.digests(df).collect())
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = Counter()
        for r in df.collect():
            n, form, prefix, middle, output = slow_transform(r["doc_id"], r["text"])
            want[(r["doc_id"], n, form, prefix, middle, sha(output), sha(r["text"] or ""))] += 1
        assert got == want
    assert {r[2] for r in got} <= {"plain", "psm", "spm"}


def test_fim_keeps_columns_and_takes_other_marks(spark, odd):
    df = odd.withColumn("form", F.lit("mine"))
    got = fim.transformed(df, fim.LINES, seed=7, rate=100, spm_rate=50, marks=("<|p|>", "<|s|>", "<|m|>"))
    assert got.columns[: len(df.columns)] == df.columns and {"_form", "_n", "prefix", "middle", "suffix", "output"} <= set(got.columns)
    back = got.select("text", fim.restored(F.col("output"), F.col("_form"), ("<|p|>", "<|s|>", "<|m|>")).alias("back"), "_form").collect()
    assert all(r["back"] == (r["text"] or "") for r in back) and {r["_form"] for r in back} > {"psm"}
    assert fim.transformed(df.limit(0)).count() == 0 and fim.digests(odd.limit(0)).count() == 0


# ---- WARC -------------------------------------------------------------------

PAGES = [
    (5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (2, "http://b", None), (8, "http://c", ""), (None, "http://n", "same"), (None, "http://n", "alone"),
    (7, "http://d/\r\nX: y", "é🙂\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "u", "z" * 300_000), (6, "u", "z" * 300_000), (4, "u", "z" * 300_000), (2**60 + 1, "u", "last"),
]


def slow_records(pages, least=0):
    groups = defaultdict(list)
    for number, _, html in pages:
        groups[html or ""].append(number)
    out = Counter()
    for number, _, html in pages:
        body = (html or "").encode()
        known = [n for n in groups[html or ""] if n is not None]
        first = min(known) if known else None
        again = len(body) >= least and first is not None and number != first
        out[(number, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None)] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_warc_goes_round(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "1 AS id", "'y' AS payload").repartition(3)
    got = warc.archived(pages, least=least, path=f"file://{tmp_path}/w").collect()
    assert all(r["intact"] for r in got)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == slow_records(PAGES, least)
    # Every member is a record by itself, at the place that the index tells, and the file is one gzip file.
    for name in {r["archive"] for r in got}:
        raw = open(name.removeprefix("file:").removeprefix("//"), "rb").read()
        own = sorted((r["offset"], r["length"]) for r in got if r["archive"] == name)
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) == len(raw)
        assert b"".join(gzip.decompress(raw[a : a + n]) for a, n in own) == gzip.decompress(raw)
        assert all(gzip.decompress(raw[a : a + n]).startswith(b"WARC/1.1\r\n") and gzip.decompress(raw[a : a + n]).endswith(b"\r\n\r\n") for a, n in own)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, f"file://{tmp_path}/w/archives").where("record_type = 'response'").collect()}
    assert {p for p in payloads.values()} == {(h or "").encode() for _, _, h in PAGES}


def test_warc_of_no_rows_and_of_bytes(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archived(none).count() == 0
    raw = bytes(range(256)) * 3
    some = spark.createDataFrame([(1, "u", raw)], "page_id bigint, url string, html binary")
    assert warc.archived(some, path=f"file://{tmp_path}/b").first()["intact"]
    assert bytes(warc.read(spark, f"file://{tmp_path}/b/archives").first()["payload"]) == raw


def record_bytes(body, more=""):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_normaliser_takes_streams_and_members_and_refuses_cut_ones(spark, tmp_path):
    source, rng = tmp_path / "in", random.Random(3)
    source.mkdir()
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) for _ in range(40)] + [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n"]
    whole = [record_bytes(b) for b in bodies]
    (source / "one.warc.gz").write_bytes(gzip.compress(b"".join(whole)))
    (source / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    (source / "none.warc.gz").write_bytes(gzip.compress(b""))
    made = {r["archive"].rpartition("/")[2]: r["records"] for r in warc.normalise(spark, f"file://{source}", f"file://{tmp_path}/out").collect()}
    assert made == {"one.warc.gz": len(bodies), "many.warc.gz": len(bodies), "none.warc.gz": 0}
    assert (tmp_path / "out/one.warc.gz").read_bytes() == (tmp_path / "out/many.warc.gz").read_bytes()
    assert gzip.decompress((tmp_path / "out/one.warc.gz").read_bytes()) == b"".join(whole)
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    for bad in (gzip.compress(b"".join(whole))[:-9], gzip.compress(whole[0][:-20]), gzip.compress(b"no record\r\n\r\n"), gzip.compress(whole[0] + b"WARC/1.1\r\n")):
        (tmp_path / "bad.gz").write_bytes(bad)
        with pytest.raises(ValueError, match="ends inside|no record"):
            warc.normalised_file(f"file://{tmp_path}/bad.gz", f"file://{tmp_path}/out/bad.warc.gz")


# ---- phrases ----------------------------------------------------------------

def slow_counts(texts, depth):
    found = Counter()
    for text in texts:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            found[""] += len(ws)
            for n in range(1, depth + 1):
                found.update(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return found


def slow_collocations(texts, least, longest, covered, most):
    f = slow_counts(texts, longest)
    candidates = {p for p, a in f.items() if " " in p and a >= least}
    rows = []
    for p in candidates:
        ws, a = p.split(" "), f[p]
        if any(f" {p} " in f" {q} " and 100 * f[q] >= covered * a for q in candidates if len(q) > len(p)):
            continue
        cuts = [(1_000_000 * a * a // (f[" ".join(ws[:k])] * f[" ".join(ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        rows.append((-score, -a, p.encode(), p, a, f[" ".join(ws[:k])], f[" ".join(ws[k:])]))
    return [(i + 1, p, a, lo, r, f[""], -s) for i, (s, _, _, p, a, lo, r) in enumerate(sorted(rows)[:most])]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_shard_counts(depth):
    rng = random.Random(depth)
    texts = [None, "", "  ", "A é b\x0bç", "a" * 9000, "x " * 3000] + [noise(rng, "ab AB.\n\t\x85 ,", 70) for _ in range(60)]
    got = Counter()
    for names, counts in phrases.shard_counts(pa.array(texts), depth):
        for name, count in zip(names.to_pylist(), counts.tolist()):
            assert name not in got
            got[name] = count
    assert got == slow_counts(texts, depth)
    assert list(phrases.shard_counts(pa.array([None, "."]), depth)) == []


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    ids = np.append(rng.integers(0, 4, 300), 0).astype(np.int32)
    order = phrases.suffix_order(ids, 8)
    keys = [tuple(ids[i : i + 8]) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(301))
    lcp, _ = phrases.shared_prefixes(ids, order, 8)
    for x, y, got in zip(keys, keys[1:], lcp[1:]):
        same = 0
        while same < min(len(x), len(y)) and x[same] == y[same] != 0:
            same += 1
        assert got == same


@pytest.mark.parametrize(("least", "longest", "covered", "most"), [(2, 3, 50, 2000), (3, 5, 80, 40), (2, 2, 50, 7)])
def test_collocations(spark, monkeypatch, least, longest, covered, most):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    rng = random.Random(least)
    words = [f"w{i}" for i in range(9)] + ["É", "the", "The"]
    rows = [(rng.choice(["en", None, "a\nb", ""]), " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randrange(40)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, least, longest, covered, most).collect())
    want = []
    for lang in {x for x, _ in rows}:
        own = slow_collocations([t for x, t in rows if x == lang], least, longest, covered, most)
        want += [("und" if lang is None else lang, *row) for row in own]
    assert got == sorted(want)


@pytest.mark.parametrize("most_bits", [15, 27])
def test_long_phrases_by_marked_pairs(spark, monkeypatch, most_bits):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
    monkeypatch.setattr(phrases, "BATCH", 7)
    rng = random.Random(5)
    rows = [(rng.choice(["en", None]), noise(rng, ["a ", "b ", "c", "dd ", ", ", "é "] + [f"r{i} " for i in range(20)], 80)) for _ in range(150)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(df, 4, 5, most_bits).collect()}
    want = {}
    for lang in ("en", None):
        want |= {(lang or "und", p): n for p, n in slow_counts([t for x, t in rows if x == lang], 4).items() if n >= 5 or p == ""}
    assert got == want


def test_collocations_of_odd_rows_and_large_counts(spark, odd, monkeypatch):
    monkeypatch.setattr(phrases, "phrase_counts", lambda docs, depth, least: docs.sparkSession.createDataFrame(
        [("en", "", 10**16), ("en", "a", 10**15), ("en", "b", 999_999_999_999_999), ("en", "a b", 999_999_999_999_998)], "lang string, phrase string, f bigint"))
    r = phrases.collocations(odd).first()
    assert r["score"] == 10**6 * 999_999_999_999_998**2 // (10**15 * 999_999_999_999_999) and (r["l"], r["r"], r["n"]) == (10**15, 999_999_999_999_999, 10**16)
    monkeypatch.undo()
    got = phrases.collocations(odd.repartition(3), least=2).collect()
    assert {r["lang"] for r in got} == {"en"} and any(r["phrase"] == "x x x" and r["a"] == 29_998 for r in got)
    assert phrases.collocations(odd.limit(0)).count() == 0


# ---- long pieces of byte-level BPE --------------------------------------------

def test_long_pieces_by_windows(monkeypatch):
    """Windows of any length are joined to what the library gives; unbroken letters of tens of thousands too."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "a", "ab", ["the", "ing", "tion", "re"], "=", "AaB", [chr(c) for c in range(0x4E00, 0x4F00)], ["abc"]]
    text = lambda kind, n: "".join(rng.choice(kind) for _ in range(n))
    for step in (2, 3, 7, 64):
        monkeypatch.setattr(bpe, "STEP", step)
        own = bpe.Codec(ranks, public_tokenizers.PATTERN)
        texts = [text(kind, rng.randrange(1, 60 * step)) for kind in kinds for _ in range(4)]
        got = [(i, d) for ids, decoded in own.batch(pa.array(texts)) for i, d in zip(ids.to_pylist(), decoded.to_pylist())]
        assert got == [(library.encode_ordinary(t), t.encode()) for t in texts]
    long = text(kinds[0], 50_000)
    ((ids, decoded),) = own.batch(pa.array([long]))
    assert ids[0].as_py() == library.encode_ordinary(long) and decoded[0].as_py() == long.encode()
