"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; its node hashes its bytes.  A section ends after a
paragraph whose hash ends in three zero bits, so that an edit moves boundaries
only where it is.  Section nodes hash their paragraphs' nodes and the root
hashes the sections' nodes.  Below a paragraph are its leaves, runs of words
that end where a word's hash ends in four zero bits.

A fingerprint is the root, the number of words, and the tree below with its
nodes cut to 32 bits.  Roots test equality; walking down two trees along the
branches that differ locates edits and leaves the leaves that only one has.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.common import materialize, mix64, word_hashes

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
#: Hex digits of a node below the root.
NODE = 8


def paragraphs(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def tree(text: str | None) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The root and the sections as (node, paragraph nodes)."""
    nodes = [hashlib.sha256(b"p" + p).digest() for p in paragraphs(text)]
    sections, own = [], []
    for i, node in enumerate(nodes):
        own.append(node)
        if node[-1] & 7 == 0 or i + 1 == len(nodes):
            sections.append((hashlib.sha256(b"s" + b"".join(own)).digest(), own))
            own = []
    return hashlib.sha256(b"r" + b"".join(s for s, _ in sections)).digest(), sections


def edited_paragraphs(old: str | None, new: str | None) -> list[tuple[int, int, int, int]]:
    """(old_from, old_to, new_from, new_to): the runs of paragraphs that differ.

    Sections with equal nodes are passed over as a whole; only the paragraphs
    of differing sections are compared.
    """
    (root_a, a), (root_b, b) = tree(old), tree(new)
    if root_a == root_b:
        return []
    start = lambda sections: np.concatenate([[0], np.cumsum([len(p) for _, p in sections])]).tolist()
    at_a, at_b, out = start(a), start(b), []
    for kind, i, j, k, m in SequenceMatcher(None, [s for s, _ in a], [s for s, _ in b], autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        left, right = [p for _, ps in a[i:j] for p in ps], [p for _, ps in b[k:m] for p in ps]
        for what, w, x, y, z in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
            if what != "equal":
                out.append((at_a[i] + w, at_a[i] + x, at_b[k] + y, at_b[k] + z))
    return out


def leaves(text: str | None) -> list[list[tuple[int, int]]]:
    """For each paragraph the (hash, words) of its runs of words."""
    lines = [line.split() for line in paragraphs(text)]
    words = [w for line in lines for w in line]
    if not words:
        return [[] for _ in lines]
    h = word_hashes(words)
    sizes = np.array([len(line) for line in lines])
    ends = h & np.uint64(15) == 0
    ends[np.cumsum(sizes[sizes > 0]) - 1] = True
    starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    many = np.diff(np.append(starts, len(h)))
    inside = np.arange(len(h)) - np.repeat(starts, many)
    values = mix64(np.add.reduceat(mix64(h) * _POWERS[inside & 63], starts)) >> np.uint64(32)
    all_leaves = list(zip(values.tolist(), many.tolist()))
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])).tolist()
    return [all_leaves[a:b] for a, b in zip(cuts, cuts[1:])]


def fingerprint(text: str | None) -> str:
    """``root:words:sections``; equal texts have equal fingerprints.

    Sections are separated by '/'.  A section is its node and, each after a
    ',', its paragraphs; a paragraph is its node and, each after a '.', its
    leaves; a leaf is its node and its number of words, in hex.
    """
    root, sections = tree(text)
    below = leaves(text)
    at, out = 0, []
    for node, own in sections:
        parts = [node.hex()[:NODE]]
        for paragraph, runs in zip(own, below[at : at + len(own)]):
            parts.append(".".join([paragraph.hex()[:NODE], *[f"{v:08x}{n:x}" for v, n in runs]]))
        at += len(own)
        out.append(",".join(parts))
    return f"{root.hex()}:{sum(n for runs in below for _, n in runs)}:{'/'.join(out)}"


def _apart(a: list[str], b: list[str], name: Callable[[str], str]) -> tuple[list[str], list[str]]:
    """The branches of either that the other does not have."""
    left, right = Counter(map(name, a)), Counter(map(name, b))
    spare_a, spare_b = left - right, right - left
    out = []
    for items, spare in ((a, spare_a), (b, spare_b)):
        own = []
        for x in items if spare else []:
            if spare[name(x)] > 0:
                spare[name(x)] -= 1
                own.append(x)
        out.append(own)
    return out[0], out[1]


def likeness(a: str, b: str) -> float:
    """Share of the words that lie in leaves which both fingerprints have, 0 to 1.

    Only branches whose nodes differ are walked down: sections, then their
    paragraphs, then leaves.  Branches are matched wherever they stand.
    """
    (root_a, words_a, own_a), (root_b, words_b, own_b) = a.split(":"), b.split(":")
    if root_a == root_b:
        return 1.0
    total = int(words_a) + int(words_b)
    if not total:
        return 0.0
    node = lambda x: x[:NODE]
    left, right = _apart(own_a.split("/"), own_b.split("/"), node)
    left, right = _apart([p for s in left for p in s.split(",")[1:]], [p for s in right for p in s.split(",")[1:]], node)
    left, right = _apart([x for p in left for x in p.split(".")[1:]], [x for p in right for x in p.split(".")[1:]], lambda x: x)
    lost = sum(int(x[NODE:], 16) for x in left) + sum(int(x[NODE:], 16) for x in right)
    return (total - lost) / total


def first_edit(a: str, b: str) -> int | None:
    """The number of the first paragraph that differs, found along differing branches; None if equal."""
    if a[:64] == b[:64]:
        return None
    left, right = (x.split(":")[2].split("/") for x in (a, b))
    at = 0
    for x, y in zip(left, right):
        if x[:NODE] != y[:NODE]:
            for p, q in zip(x.split(",")[1:], y.split(",")[1:]):
                if p[:NODE] != q[:NODE]:
                    break
                at += 1
            break
        at += x.count(",")
    return at


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_from bigint"


def _result(doc_id: str | None, text: str, own: str, following: str, other: str) -> tuple:
    new = edit(text, following)
    changed = own if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, other), first_edit(own, changed)


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, an edited text's, and how alike they are.

    The edited text has its last half (rounded down) replaced by the start of
    the next document by descending doc_id; after the last comes the first.
    ``edited_from`` numbers the first paragraph (from 0) that the edit changed,
    null if none.  Rows of equal doc_id follow one another by text, null
    doc_ids come last; a null text is empty; texts of any length are
    fingerprinted whole.  One row per input row; extra columns are ignored; an
    empty table gives an empty result.

    Rows are dealt out by range and each task walks its range once, holding two
    texts.  The first and last row of each range meet afterwards.
    """
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_id, last = TaskContext.get().partitionId(), None
        for part in parts:
            rows, ends = [], []
            for doc_id, text in zip(part["doc_id"].tolist(), part["text"].tolist()):
                own = fingerprint(text)
                if last is None:
                    ends.append((doc_id, text, 1))
                else:
                    rows.append(_result(*last, text, own))
                last = (doc_id, text, own)
            yield _frame(rows, ends, part_id, names)
        if last is not None:
            yield _frame([], [(last[0], last[1], 2)], part_id, names)

    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    # Ids cross over as text: beside nulls, numbers would turn into floats.
    walked = materialize(ordered.select(F.col("doc_id").cast("string"), "text").mapInPandas(walk, _RESULT + ", end_text string, end_kind int, part int"), "fingerprints")
    # Only the numbers of the parts, one per task, are put in order; the texts join by them.
    firsts = walked.where("end_kind = 1").select("part", F.col("end_text").alias("following"))
    parts = firsts.select("part")
    turn = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), parts.agg(F.min("part")).scalar()).alias("next"))
    firsts = turn.join(firsts.withColumnRenamed("part", "next"), "next").select("part", "following")
    ends = walked.where("end_kind = 2").select("part", "doc_id", "end_text").join(firsts, "part").select("doc_id", "end_text", "following")

    def close(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [_result(i, t, fingerprint(t), f, fingerprint(f)) for i, t, f in zip(part["doc_id"], part["end_text"], part["following"])]
            yield _typed(pd.DataFrame(rows, columns=names))

    found = walked.where("end_kind = 0").select(*names).union(ends.mapInPandas(close, _RESULT))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.astype({"n_chars": "Int64", "near_edited": float, "near_next": float, "edited_from": "Int64"})


def _frame(rows: list, ends: list, part: int, names: list[str]) -> pd.DataFrame:
    full = [(*r, None, 0, part) for r in rows] + [(i, *[None] * (len(names) - 1), t, k, part) for i, t, k in ends]
    return _typed(pd.DataFrame(full, columns=[*names, "end_text", "end_kind", "part"]))
