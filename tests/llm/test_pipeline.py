"""The pipeline: contracts of its stages, and each stage against brute force on its own input."""

import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from presswell.llm import rulefit, simhash
from presswell.llm.common import table
from presswell.llm.graph import forest


@pytest.fixture(scope="module")
def steps(spark, small):
    """The rows that enter each stage, and at last those that leave the pipeline."""
    docs = table(spark, small, "documents")
    kinds, out = docs.dtypes, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        assert name == "byte_bpe" or docs.dtypes == kinds and not docs.isEmpty(), name
        out.append(docs.collect())
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_classifier(spark, small, steps):
    model = rulefit.fit(table(spark, small, "documents"), table(spark, small, "labels"), rulefit.fold("doc_id", 3) != 1)
    scores = model.probabilities(np.array([rulefit.statistics(r["text"]) for r in steps[0]]))
    assert Counter(steps[1]) == Counter(r for r, s in zip(steps[0], scores) if s >= 0.5)


def test_simhash_near_dedup(steps):
    fps = np.array([simhash.fingerprint(r["text"]) for r in steps[1]], np.uint64)
    ids = np.array([r["doc_id"] for r in steps[1]])
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    smallest = dict(zip(*(x.tolist() for x in forest(ids[a], ids[b]))))
    assert Counter(steps[2]) == Counter(r for r in steps[1] if smallest[r["doc_id"]] == r["doc_id"])


def test_substring_dedup(steps):
    """No run of 50 words that an earlier document has is left, and the other words are."""
    seen, after = {}, {r["doc_id"]: r for r in steps[3]}
    for r in sorted(steps[2], key=lambda r: r["doc_id"]):
        own = words(r["text"])
        runs = [tuple(own[k : k + 50]) for k in range(len(own) - 49)]
        left = words(after[r["doc_id"]]["text"]) if r["doc_id"] in after else []
        old = {run for run in runs if run in seen}
        assert not old & {tuple(left[k : k + 50]) for k in range(len(left) - 49)}
        for run in runs:
            seen.setdefault(run, r["doc_id"])
        if left != own:
            # Near passages go as well, but only words of shingles that an earlier document has, or beside them.
            assert len(own) - len(left) >= 50 or not left
        else:
            assert after[r["doc_id"]]["text"] == r["text"]
    assert {r["doc_id"] for r in steps[3]} <= {r["doc_id"] for r in steps[2]}


def test_source_mixing(steps):
    sizes, given = Counter(), {}
    for r in steps[3]:
        sizes[r["source"]] += len(words(r["text"]))
        given[r["doc_id"]] = words(r["text"])
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, free, target = float(sum(sizes.values())), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or set(free)
    taken, times = Counter(), Counter()
    for r in steps[4]:
        taken[r["source"]] += len(words(r["text"]))
        times[r["doc_id"]] += len(words(r["text"]))
        assert words(r["text"]) == given[r["doc_id"]][: len(words(r["text"]))]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes) and all(n <= 3 * len(given[i]) for i, n in times.items())


def test_byte_bpe(steps):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in steps[4]:
        ids = np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()
        want[r["doc_id"], hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in steps[5]) == want


def test_whole_run(spark, small, steps):
    assert Counter(corpus_pipeline.run(spark, small).collect()) == Counter(steps[5])


def test_clean_documents_survive(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = corpus_pipeline.quality_classifier(spark, docs, small)
    assert kept.join(good.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * good.count()
