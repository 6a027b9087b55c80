"""The other operators: odd rows, brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter
from datetime import datetime

import base64

import compare
import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from presswell.llm import bpe, merkle, mixing, queries, quality_rules, rulefit, sharding, simhash, substring, toxicity, urllist


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_oracle(spark, small, name):
    assert compare.differences(queries.QUERIES[name](spark, small), queries.ORACLES[name], compare.connect(small)) == ""


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# ---- quality rules ----------------------------------------------------------

def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "x " * 50, "#a *b\n#a *b\n\n#a *b", "\n".join("ab cd ef gh ij" for _ in range(3)), "🙂 é\x0bz|"]
    texts += [" ".join(rng.choice("abc") + rng.choice("\n ") for _ in range(60)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.statistics(df).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}


def test_quality_rules_are_the_oracle_where_cutoffs_fire(spark):
    """On ten thousand documents strata have enough good ones for cutoffs, and these reject rows."""
    large = "/root/testdata/sf0.1"
    found = queries.op2_quality_rules(spark, large)
    assert found.where("NOT kept AND NOT base_failed").count() > 100
    assert compare.differences(found, queries.ORACLES["op2_quality_rules"], compare.connect(large)) == ""


def test_quality_cutoffs_keep_the_risk(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(16000):
        good = i % 4 != 0
        symbols = "" if good and rng.random() > 0.0005 else " ##### $$$$$ %%%%%"
        rows.append((i, " ".join(f"word{rng.randrange(10**6)}" for _ in range(30)) + symbols, "en" if i % 2 else None))
        marks.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels).collect()}
    good = [kept[i] for i, q, _ in marks if q]
    bad = [kept[i] for i, q, _ in marks if not q]
    assert 1 - sum(good) / len(good) <= 0.02 and sum(bad) / len(bad) < 0.1


def test_quality_of_odd_rows(spark, odd, labels):
    got = quality_rules.judged(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(not r["kept"] for r in got if r["base_failed"]) and all(r["base_failed"] for r in got if r["n_words"] < 10)
    assert quality_rules.judged(odd.limit(0), labels).count() == 0 and quality_rules.judged(odd, labels.limit(0)).count() == odd.count()


# ---- mixing -----------------------------------------------------------------

def slow_targets(sizes, repeat=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > repeat * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(repeat * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, odd):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 40), None if i % 11 == 0 else f"s{i % 3}" if i % 7 else f"t{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for df in (docs, odd):
        got = mixing.mix(df).collect()
        sizes = {}
        for r in df.collect():
            sizes[r["source"]] = sizes.get(r["source"], 0) + n_words(r["text"])
        want = slow_targets(sizes)
        taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in sizes}
        assert len(got) == df.count()
        for s in sizes:
            assert abs(next(r["target"] for r in got if r["source"] == s) - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= 1.001
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns
        words = {}
        for r in mixed.collect():
            words[r["source"]] = words.get(r["source"], 0) + n_words(r["text"])
        assert all(abs(words.get(s, 0) - taken[s]) <= 0 for s in sizes)
    assert mixing.mix(odd.limit(0)).count() == mixing.mixed_documents(odd.limit(0)).count() == 0


# ---- sharding ---------------------------------------------------------------

def test_sharding(spark, odd):
    rows = [(7, "same text")] * 500 + [(i, "x" * (i % 50)) for i in range(1000)] + [(2000, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.shards(docs, 1000).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault((r["depth"], r["prefix"]), []).append(r)
    for (depth, prefix), own in shards.items():
        assert sum(r["bytes"] for r in own) == own[0]["shard_bytes"] and len(own) == own[0]["shard_rows"]
        assert own[0]["shard_bytes"] <= 1000 or len(own) == 1
        parent = [r for k, rs in shards.items() if k[0] >= depth and k[1] >> (k[0] - depth + 1) == prefix >> 1 for r in rs]
        assert depth == 0 or sum(r["bytes"] for r in parent) > 1000
    assert sharding.shards(odd, 100).count() == odd.count() and sharding.shards(odd.limit(0), 100).count() == 0
    assert sharding.directory(sharding.shards(docs, 1000)).count() == len(shards)


# ---- fingerprints -----------------------------------------------------------

def test_merkle_rows(spark, odd):
    got = merkle.compared(odd).collect()
    assert len(got) == odd.count()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect() if r["doc_id"] is not None), key=lambda x: -x[0])
    ids = [i for i, _ in docs]
    by_id = {r["doc_id"]: r for r in got}
    for i, text in docs:
        following = [t for j, t in docs if j < i][:1]
        if following and ids.count(i) == 1 and ids.count(i - 1) == 1:
            new = merkle.edit(text, following[0])
            assert by_id[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and by_id[i]["edited_fingerprint"] == merkle.fingerprint(new)
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and merkle.compared(odd.limit(0)).count() == 0
    one = merkle.compared(odd.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 24


def test_merkle_edits():
    rng = random.Random(7)
    lines = [" ".join(f"w{rng.randrange(1000)}" for _ in range(12)) for _ in range(60)]
    new = [*lines[:20], "an edited line", *lines[21:40], "one more", *lines[40:]]
    a, b = "\n".join(lines), "\n".join(new)
    assert merkle.edited_paragraphs(a, a) == [] and merkle.edited_paragraphs(a, b) == [(20, 21, 20, 21), (40, 40, 40, 41)]
    assert merkle.fingerprint(a) != merkle.fingerprint(b) and merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) > 0.85
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(None)) == 1.0 and merkle.likeness(merkle.fingerprint(" "), merkle.fingerprint("")) == 0.0


# ---- BPE --------------------------------------------------------------------

def test_bpe_like_the_library(spark, odd, small):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["ab" * 900 + " é" * 300, "<|endoftext|>", "  \n\n x ", "🙂" * 200, "z" * 3000, "it's 1234567 ok"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    docs = docs.union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 100", "text"))
    got = bpe.encode(docs, path, public_tokenizers.PATTERN).join(docs.withColumnRenamed("text", "t"), "doc_id")
    for r in got.where("doc_id > 2").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["t"] or "")
        assert r["decoded_sha256"] == hashlib.sha256((r["t"] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) // 4
    assert bpe.encode(odd, path, public_tokenizers.PATTERN).count() == odd.count() and bpe.encode(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


# ---- classifiers ------------------------------------------------------------

def accuracy(spark, classify, label, parts, hold):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == hold) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    positive, negative = ([r["score"] for r in held if r[label] == k] for k in (1, 0))
    return np.mean([[a > b for b in negative] for a in positive])


def test_quality_classifier_held_out(spark):
    assert accuracy(spark, rulefit.classify, "quality", 3, 1) > 0.95


def test_toxicity_held_out(spark):
    assert accuracy(spark, toxicity.classify, "toxic", 4, 2) > 0.85


@pytest.mark.parametrize("classify", [rulefit.classify, toxicity.classify])
def test_classifiers_of_odd_rows(spark, odd, labels, classify):
    got = classify(odd, labels)
    assert got.count() == odd.count() and got.where("score IS NULL OR isnan(score) OR score < 0 OR score > 1").isEmpty()
    assert classify(odd.limit(0), labels).count() == 0 and classify(odd, labels.limit(0)).count() == odd.count()
    assert rulefit.keep_good(odd, labels).columns == odd.columns


def test_compiled_rules_score_as_numpy(spark):
    rng = np.random.default_rng(8)
    x, y = rng.random((600, len(rulefit.STATISTICS))), rng.random(600) < 0.5
    y = ((x[:, 3] > 0.6) & (x[:, 5] < 0.7) | (x[:, 1] > 0.9)).astype(float)
    model = rulefit.lasso(rulefit.tree_rules(x, y), x, y)
    assert ((model.probabilities(x) > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(rulefit.STATISTICS)).select(F.struct("*").alias("s"))
    got = [r[0] for r in df.select(model.score("s")).collect()]
    assert np.allclose(got, model.probabilities(x[:50]))


def test_network_gradients():
    rng = np.random.default_rng(9)
    net = toxicity.Network(1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(5, 3, toxicity.INPUTS)), np.ones((5, 3), bool), np.array([0.0, 1, 0])
    mask[3:, 1] = False
    loss = lambda: np.mean(np.log1p(np.exp(-(2 * y - 1) * net.forward(x @ net.p["xf"], x @ net.p["xb"], mask)[0])))
    grads = net.gradients(x, mask, y)
    for name, w in net.p.items():
        at, kept = (0,) * w.ndim, w.flat[0]
        w[at] = kept + 1e-4
        up = loss()
        w[at] = kept - 1e-4
        slope, w[at] = (up - loss()) / 2e-4, kept
        assert abs(slope - grads[name][at]) < 1e-4


def test_toxicity_windows_cover_the_text():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        last = toxicity.STRIDE * (toxicity._windows(n) - 1)
        assert last + toxicity.WINDOW >= n and (last == 0 or last < n)


# ---- URL lists --------------------------------------------------------------

def test_url_list(spark):
    changes = spark.createDataFrame([
        ("Bad.com", "2024-01-10", "add"), ("bad.com", "2024-01-20", "add"), ("bad.com", "2024-02-01", "remove"), ("bad.com", "2024-02-01", "add"),
        ("ok.com/x/", "2024-01-01", "add"), ("early.com", "2024-01-05", "remove"), (None, "2024-01-01", "add"), ("y.com", None, "add"),
    ], "entry string, day string, action string")
    urls = [
        ("http://BAD.com/a", 9, False), ("http://bad.com/a", 10, True), ("https://u:p@sub.bad.com:8080?q", 31, True), ("http://bad.com./", 31, True),
        ("http://notbad.com/", 15, False), ("http://ok.com/x", 2, True), ("http://ok.com/X/y?z", 2, True), ("http://ok.com/xy", 2, False),
        ("http://early.com", 9, False), (None, 5, False), ("no url", 5, False), ("", 5, False),
    ]
    rows = [(u, datetime(2024, 1, day), b, 1) for u, day, b in urls] + [("http://bad.com/a", datetime(2024, 2, 1), False, 2)] * 2 + [("http://bad.com/a", None, False, 3)]
    captures = spark.createDataFrame(rows, "url string, fetched_at timestamp, want boolean, day int")
    got = urllist.judged(captures, changes)
    assert got.count() == len(rows) and got.where("want <> blocked").isEmpty()
    assert urllist.judged(captures.limit(0), changes).count() == 0
    assert urllist.judged(captures, changes.limit(0)).where("blocked").isEmpty()


def test_clashing_names_of_captures(spark):
    captures = spark.createDataFrame([("http://bad.com/", datetime(2024, 1, 15), "h", 1)], "url string, fetched_at timestamp, host string, blocked int")
    changes = spark.createDataFrame([("bad.com", "2024-01-10", "add")], "entry string, day string, action string")
    row = urllist.judged(captures, changes).first()
    assert (row["host"], row["blocked"], row["_host"], row["_blocked"], row["entry"]) == ("h", 1, "bad.com", True, "bad.com")


# ---- all operators on odd tables ---------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALL = {
    "op1": lambda d, _: substring.repeated_passages(d), "op2": lambda d, labels: quality_rules.judged(d, labels), "op3": lambda d, _: merkle.compared(d),
    "op4": lambda d, _: mixing.mix(d), "op5": lambda d, _: sharding.shards(d, 100), "op6": lambda d, _: bpe.encode(d, PATH, public_tokenizers.PATTERN),
    "op7": lambda d, labels: rulefit.classify(d, labels), "op8": lambda d, _: simhash.near_duplicates(d), "op10": lambda d, labels: toxicity.classify(d, labels),
}
BIG = 9007199254740993


@pytest.mark.parametrize("name", sorted(ALL))
def test_exact_ids_and_repeated_ones(spark, twice, labels, name):
    got = ALL[name](twice.repartition(1), labels).collect()
    ids = sorted((r["doc_id"] for r in got), key=lambda i: (i is None, i))
    want = [7, 9, 9, 9, BIG, BIG + 2, None]
    if name == "op1":
        assert {(r["doc_id"], r["source_doc_id"], r["start_word"], r["end_word"]) for r in got} == {(9, 7, 160, 240), (BIG, 7, 0, 80), (BIG + 2, 7, 0, 80)}
    else:
        assert ids == want
    assert ALL[name](twice.limit(0), labels).count() == 0


def test_cuts_keep_to_their_text(spark, twice):
    left = {(r["doc_id"], len(r["text"].split())) for r in substring.cut_passages(twice).collect()}
    assert left == {(7, 80), (9, 160), (9, 1), (None, 2)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, small, odd, twice, name, stage):
    for docs in (odd, twice):
        got = stage(spark, docs, small)
        assert got.columns == docs.columns or name == "byte_bpe"
        assert got.count() <= 3 * docs.count() and stage(spark, docs.limit(0), small).count() == 0


def test_bpe_of_any_white_space_and_length(spark):
    rng = random.Random(11)
    with open(PATH, "rb") as file:
        raw = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    alphabet = "abcdefgh ABC'  \n\t.,!é日本\u2028\u3000\x1c\x85\x0b½²٣🙂stremvld"
    texts = ["", " ", "\n", "a\nb", " a", "\nab\n", "a  b", "a\n\nb", "x\x1cy z", "a \x1cb", None] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (63, 64, 65, 66, 300, 3000)] + ["aab" * 700, "=-" * 500, "a" * 4000]
    own = bpe.Codec(ranks, public_tokenizers.PATTERN, 200)  # remembers little, so that it starts over
    for lot in (texts[:300], texts[300:]):
        got = [x for ids, text in own.batch(pa.array(lot, pa.string())) for x in zip(ids.to_pylist(), text.to_pylist())]
        assert got == [(library.encode_ordinary(t or ""), (t or "").encode()) for t in lot]


def slow_leaves(text):
    out = []
    for line in (text or "").encode().split(b"\n"):
        run = []
        for word in line.split():
            run.append(xxhash.xxh64_intdigest(word))
            if run[-1] % 16 == 0:
                out.append(tuple(run))
                run = []
        if run:
            out.append(tuple(run))
    return Counter(out)


def test_merkle_likeness_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in merkle.compared(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        for near, other in (("near_edited", edited), ("near_next", following)):
            a, b = slow_leaves(text), slow_leaves(other)
            total = sum(len(r) * n for r, n in (a + b).items())
            want = 1.0 if text == other else 2 * sum(len(r) * n for r, n in (a & b).items()) / total if total else 0.0
            assert abs(got[i][near] - want) < 1e-9
        lines, new = text.split("\n"), edited.split("\n")
        first = next((k for k, (x, y) in enumerate(zip(lines, new)) if x != y), min(len(lines), len(new)))
        assert got[i]["edited_from"] == (None if text == edited else first)


def test_queue_by_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(120)] + [(5, "w w", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + n_words(text)
    target, entries = slow_targets(sizes), []
    for source in sizes:
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n_words(t)) for i, t, s in rows if s == source)
        served, goal = 0, int(target[source])
        for _ in range(3):
            for _, i, size in own:
                # The word at which the target is reached ends a part of its own.
                for part in ([goal - served, size - goal + served] if served < goal < served + size else [size]):
                    served += part
                    entries.append((served / target[source], i, source, part))
    budget, taken = sum(int(t) for t in target.values()), Counter()
    for _, i, source, part in sorted(entries, key=lambda e: e[0]):
        taken[i, source] += min(part, budget)
        budget -= min(part, budget)
    got = Counter()
    for r in mixing.mix(docs).collect():
        got[r["doc_id"], r["source"]] += r["taken"]
    assert +got == +taken


def test_windows_scored_one_by_one():
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice(["good", "bad", "so", "fine", "awful", "x"], n)) for n in (1, 5, 40, 70, 200)] + ["", None]
    scorer = toxicity.learn(texts, np.array([0, 1, 0, 1, 0, 0, 1]))
    net, h = scorer.network.p, toxicity.HIDDEN
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def states(x, d):
        out, state = [], np.zeros(h)
        for row in x if d == "f" else x[::-1]:
            gates = logistic(row @ net[f"x{d}"][:, : 2 * h] + state @ net[f"u{d}"])
            candidate = np.tanh(row @ net[f"x{d}"][:, 2 * h :] + (gates[h:] * state) @ net[f"n{d}"])
            state = state + gates[:h] * (candidate - state)
            out.append(state)
        return np.array(out if d == "f" else out[::-1])

    for text in texts:
        words = (text or "").encode().lower().split()
        logits = []
        for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            x = scorer.inputs.of(words[start : start + toxicity.WINDOW]).astype(float)
            x = x if len(x) else np.zeros((1, toxicity.INPUTS))
            s = np.concatenate([states(x, "f"), states(x, "b")], 1)
            weights = np.exp(np.tanh(s @ net["att"]) @ net["q"])
            logits.append(float((weights / weights.sum() * s).sum(0) @ net["out"][:, 0] + net["bias"][0]))
        if words:
            assert abs(max(logits) - scorer.logits([text])[0]) < 1e-3


@pytest.mark.parametrize("classify, label, parts, hold", [(rulefit.classify, "quality", 3, 1), (toxicity.classify, "toxic", 4, 2)])
def test_held_out_labels_change_nothing(spark, small, classify, label, parts, hold):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % parts == hold
    flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    scores = lambda known: {r["doc_id"]: r["score"] for r in classify(docs, known).collect()}
    assert scores(labels) == scores(flipped)
