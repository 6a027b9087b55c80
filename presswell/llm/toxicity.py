"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters with word inputs and character inputs: the log-odds that the
training documents give the word and its runs of five characters, and a random
projection of the word.  Two gated recurrent networks read a window in either
direction, attention pools their states and a logistic output scores the
window.  Windows overlap by half and cover the whole text; a document's score is
its highest window's, calibrated on the training documents.  All is numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 32, 16
HIDDEN, RANDOM = 8, 4
WORD_SLOTS, GRAM_BITS = 1 << 17, 18
INPUTS = 4 + RANDOM
#: Labelled documents that are learned from, at most; chosen by hash of doc_id.
SAMPLE_ROWS = 8_000
#: Documents that the prior of a key's shares counts as.
PRIOR = 4.0
#: Training documents whose highest window calibrates the scores, at most.
CALIBRATED = 1_500
#: Steps of training, at least.
LEAST_STEPS = 200
_EDGE = b".,;:!?\"'()[]{}<>|#*$%&-_"
#: Words, and different words, that are scored as one block.
BLOCK_WORDS, REMEMBERED = 2_000_000, 200_000


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _word_slots(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(WORD_SLOTS)


def _gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the runs of five bytes of the edged words, and where each word's begin."""
    raw = np.frombuffer(b"^" + b"$$$$^".join(words) + b"$$$$", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    code = raw[:-4].copy()
    for k in range(1, 5):
        code |= raw[k : len(raw) - 4 + k] << np.uint64(8 * k)
    # The four runs that begin in the marks after a word belong to none.
    own = np.ones(len(code), bool)
    ends = np.cumsum(sizes + 4)[:-1]
    for k in range(1, 5):
        own[ends - k] = False
    return (code[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS), np.cumsum(sizes) - sizes


class Inputs:
    """Input vectors of words from the counts of labelled documents."""

    def __init__(self, texts: list[str | None], toxic: np.ndarray, seed: int = 0) -> None:
        self.words, self.grams = np.zeros((2, WORD_SLOTS), np.float32), np.zeros((2, 1 << GRAM_BITS), np.float32)
        for text, label in zip(texts, toxic.astype(int)):
            if distinct := list({w.strip(_EDGE) for w in set(_words(text))}):
                self.words[label, np.unique(_word_slots(distinct))] += 1
                self.grams[label, np.unique(_gram_slots(distinct)[0])] += 1
        self.total = np.array([(toxic == 0).sum(), (toxic == 1).sum()], np.float32)
        self.random = np.random.default_rng(seed).normal(0, 0.3, (1024, RANDOM)).astype(np.float32)

    def _odds(self, counts: np.ndarray, slots: np.ndarray, own: int | None) -> np.ndarray:
        """Half the log ratio of a key's document shares, shrunk by a prior."""
        found, total = counts[:, slots], self.total.copy()
        if own is not None:
            found[own] -= 1
            total[own] -= 1
        prior = np.maximum(total / max(1.0, total.sum()), 1e-3)[:, None]
        ratio = (np.maximum(found, 0) + PRIOR * prior) / prior
        return np.clip(np.log(ratio[1] / ratio[0]) / 2, -3, 3)

    def of(self, words: list[bytes], own: int | None = None) -> np.ndarray:
        """(n, INPUTS) for n words: word inputs, then character inputs.

        ``own`` is the label of the counted text that the words are from; it is
        left out of the counts, so that a text meets its words as new ones.
        """
        if not words:
            return np.zeros((0, INPUTS), np.float32)
        words = [w.strip(_EDGE) for w in words]
        slot, (grams, starts) = _word_slots(words), _gram_slots(words)
        many = np.diff(np.append(starts, len(grams)))[:, None]
        odds = self._odds(self.grams, grams, own)
        return np.concatenate([
            self._odds(self.words, slot, own)[:, None], np.maximum.reduceat(odds, starts)[:, None], np.add.reduceat(odds, starts)[:, None] / many,
            np.ones((len(words), 1)), self.random[slot % np.uint64(1024)],
        ], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The trained parameters and both passes over a batch of windows."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        rand = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": rand(INPUTS, 3 * h), f"u{d}": rand(h, 2 * h), f"n{d}": rand(h, h)}
        self.p |= {"att": rand(2 * h, h), "q": rand(h, 1), "out": rand(2 * h, 1), "bias": np.zeros(1, np.float32)}
        # Log-odds reach the first candidate state from the start.
        for d in "fb":
            self.p[f"x{d}"][:3, 2 * h] = 0.5
        self.p["out"][[0, h]] = 1.0

    def _read(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (T, B, H) for projected inputs x (T, B, 3H), and what each step made."""
        h, u, n = HIDDEN, self.p[f"u{d}"], self.p[f"n{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        states, steps = np.empty((*x.shape[:2], h), np.float32), []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            gates = _sigmoid(x[t, :, : 2 * h] + state @ u)
            z, r = gates[:, :h], gates[:, h:]
            mixed = r * state
            c = np.tanh(x[t, :, 2 * h :] + mixed @ n)
            steps.append((t, state, gates, mixed, c))
            state = state + z * (c - state)
            states[t] = state
        return states, steps

    def forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of windows; mask (T, B) is false at padding."""
        (sf, kf), (sb, kb) = self._read(xf, "f"), self._read(xb, "b")
        s = np.concatenate([sf, sb], 2)
        a = np.tanh(s @ self.p["att"])
        e = np.where(mask, (a @ self.p["q"])[..., 0], np.float32(-30))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * s).sum(0)
        return (pooled @ self.p["out"])[:, 0] + self.p["bias"][0], (s, a, w, pooled, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss for inputs x (T, B, INPUTS)."""
        h, p = HIDDEN, self.p
        logit, (s, a, w, pooled, kf, kb) = self.forward(x @ p["xf"], x @ p["xb"], mask)
        error = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)[:, None]
        g = {"out": pooled.T @ error, "bias": error.sum(0)}
        d_pooled = error @ p["out"].T
        d_w = (s * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_a = d_e[..., None] * p["q"][:, 0] * (1 - a * a)
        g["q"] = np.einsum("tbh,tb->h", a, d_e)[:, None]
        g["att"] = np.einsum("tbi,tbj->ij", s, d_a)
        d_s = w[..., None] * d_pooled + d_a @ p["att"].T
        for d, steps, part in (("f", kf, d_s[..., :h]), ("b", kb, d_s[..., h:])):
            u, n = p[f"u{d}"], p[f"n{d}"]
            gu, gn, d_x, d_state = np.zeros_like(u), np.zeros_like(n), np.empty((*x.shape[:2], 3 * h), np.float32), 0.0
            for t, state, gates, mixed, c in reversed(steps):
                z, r = gates[:, :h], gates[:, h:]
                total = part[t] + d_state
                d_c = total * z * (1 - c * c)
                d_mixed = d_c @ n.T
                d_gates = np.concatenate([total * (c - state), d_mixed * state], 1) * gates * (1 - gates)
                gn += mixed.T @ d_c
                gu += state.T @ d_gates
                d_x[t, :, : 2 * h], d_x[t, :, 2 * h :] = d_gates, d_c
                d_state = total * (1 - z) + d_mixed * r + d_gates @ u.T
            g[f"u{d}"], g[f"n{d}"], g[f"x{d}"] = gu, gn, np.einsum("tbi,tbj->ij", x, d_x)
        return g

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over shuffled batches; x (N, T, INPUTS), mask (N, T)."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(y)))):
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                own, step = order[k : k + batch], step + 1
                for name, g in self.gradients(x[own].transpose(1, 0, 2), mask[own].T, y[own]).items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g * g - v[name])
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


class _Numbers(dict):
    """Words in order of appearance, each with its number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Scorer:
    """Calibrated document scores; small enough to broadcast (about 2 MB)."""

    def __init__(self, inputs: Inputs, network: Network, scale: float = 1.0, shift: float = 0.0) -> None:
        self.inputs, self.network, self.scale, self.shift = inputs, network, scale, shift

    def highest(self, ids: list[np.ndarray], vectors: np.ndarray, many: int, block: int = 1024) -> np.ndarray:
        """Highest window logit of each text; ``ids`` are rows of ``vectors``."""
        p, tops = self.network.p, np.full(many, -np.inf, np.float32)
        # The last row is padding.
        table = np.concatenate([vectors, np.zeros((1, INPUTS), np.float32)]) @ np.concatenate([p["xf"], p["xb"]], 1)
        flat = np.concatenate([*ids, [len(vectors)]]).astype(np.int32)
        sizes = np.array([len(x) for x in ids])
        first, windows = np.cumsum(sizes) - sizes, np.array([_windows(n) for n in sizes.tolist()])
        owner = np.repeat(np.arange(many), windows)
        start = first[owner] + STRIDE * (np.arange(windows.sum()) - (np.cumsum(windows) - windows)[owner])
        end = (first + sizes)[owner]
        for k in range(0, len(owner), block):
            place = start[None, k : k + block] + np.arange(WINDOW)[:, None]
            mask = place < end[None, k : k + block]
            x = table[flat[np.where(mask, place, len(flat) - 1)]]
            logit, _ = self.network.forward(x[..., : 3 * HIDDEN], x[..., 3 * HIDDEN :], mask)
            np.maximum.at(tops, owner[k : k + block], logit)
        return tops

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Highest window logit of each whole text."""
        out, known, ids, at = [], _Numbers(), [], 0
        for text in texts:
            words = _words(text)
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            at += len(words)
            if at > BLOCK_WORDS or len(known) > REMEMBERED:
                out.append(self.highest(ids, self.inputs.of(list(known)), len(ids)))
                known, ids, at = _Numbers(), [], 0
        if ids:
            out.append(self.highest(ids, self.inputs.of(list(known)), len(ids)))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(texts).astype(float) + self.shift)


def _windows(n: int) -> int:
    """Windows that cover n words; an empty text has one of padding."""
    return 1 + max(0, -(-(n - WINDOW) // STRIDE))


def learn(texts: list[str | None], toxic: np.ndarray, seed: int = 0) -> Scorer:
    """Train on whole labelled texts.

    Of each text the window with the highest log-odds counts with the text's
    label, and of clean texts one more at random.  Words are met with their own
    text left out of the counts, as they will be in new texts.
    """
    inputs, network, rng = Inputs(texts, toxic, seed), Network(seed), np.random.default_rng(seed)
    xs, ms, ys, kept = [], [], [], []
    for text, label in zip(texts, toxic.astype(int)):
        vectors = inputs.of(_words(text), label)
        odds = vectors[:, 0] + vectors[:, 1]
        starts = STRIDE * np.arange(_windows(len(vectors)))
        best = int(starts[int(np.argmax([odds[s : s + WINDOW].max(initial=-9) for s in starts]))])
        for s in sorted({best, int(rng.choice(starts))} if label == 0 else {best}):
            x = np.zeros((WINDOW, INPUTS), np.float32)
            x[: len(vectors[s : s + WINDOW])] = vectors[s : s + WINDOW]
            xs.append(x)
            ms.append(np.arange(WINDOW) < len(vectors) - s)
            ys.append(float(label))
        if len(kept) < CALIBRATED:
            kept.append(vectors)
    if ys and toxic.any() and not toxic.all():
        network.train(np.stack(xs), np.stack(ms), np.array(ys, np.float32), seed=seed)
    scorer = Scorer(inputs, network)
    if kept:
        logit = scorer.highest([np.arange(len(v)) + n for v, n in zip(kept, np.cumsum([0, *map(len, kept)]).tolist())], np.concatenate(kept), len(kept))
        scorer.scale, scorer.shift = _calibrate(logit.astype(float), toxic[: len(kept)].astype(float))
    return scorer


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton's method with a ridge."""
    x = np.stack([logit, np.ones(len(logit))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learn_from, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Learn from at most ``sample_rows`` labelled documents where ``learn_from``.

    The sample is the smallest MD5 of doc_id; it is broadcast, as its size is
    bounded.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn_from)
        .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_label"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample_rows)
    )
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id")).select("_id", "_label", "text").toPandas()
    # By hash of the id, so that the first texts, which calibrate, are a sample of all.
    got = got.assign(_key=got["_id"].map(lambda i: hashlib.md5(str(i).encode()).hexdigest())).sort_values(["_key", "_id", "text"], kind="stable")
    return learn(got["text"].tolist(), (got["_label"] == 1).to_numpy(int))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Labels of held-out ids (CRC-32 of the id modulo 4 is 2) are never learned
    from.  Null and empty texts score as one window of padding, and all windows
    of a text of any length are scored; a null doc_id is not held out; rows may
    repeat; extra columns are ignored; an empty table gives an empty result.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fold != 2))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.value.scores(part.tolist()), dtype=float)

    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), score.asNondeterministic()("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
