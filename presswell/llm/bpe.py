"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

A text is cut into words, and each different word by the tokenizer's pattern
into pieces.  The pieces of a lot become lists of byte tokens.  A recursive
query joins their token-position rows to the merge table and contracts each
piece's leftmost pair of minimum rank until none is left; a long piece does so in
windows that overlap and are joined at a token that both have.  An ordered
aggregation then decodes the ids to bytes.  A Python worker remembers words and
pieces in Arrow arrays, up to a bound, over the batches it is given.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.llm.common import give_back

#: Different words, and pieces, that a worker remembers (about 50 bytes each).
REMEMBERED = 750_000
#: Characters of a lot of texts; pieces and bytes of one query.
LOT_CHARS, AT_ONCE, AT_ONCE_BYTES = 6_000_000, 50_000, 2_000_000
#: Bytes from one window of a long piece to the next; a window is of two steps.
STEP = 64
#: From so many tokens on a piece contracts all places of its minimum rank in one round.
MANY_TOKENS = 64

_ENCODE = f"""
WITH RECURSIVE t(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM words
  UNION ALL
  SELECT w, toks FROM (
    WITH p AS (SELECT w, len(toks) > {MANY_TOKENS} AS long, unnest(toks) AS a, unnest(toks[2:]) AS b, generate_subscripts(toks, 1) AS i FROM t),
         h AS (SELECT w, long, i, c, alone FROM p JOIN merges USING (a, b)),
         m AS (SELECT w, long, min(c::BIGINT << 32 | i) AS best FROM h GROUP BY w, long),
         -- Equal ranks in a row overlap: of such a run every other one is taken, the first included.
         n AS (SELECT w, i, c, alone, row_number() OVER (PARTITION BY w ORDER BY i) AS n FROM h JOIN m USING (w) WHERE m.long AND c = best >> 32),
         r AS (SELECT w, i, c, alone, n, row_number() OVER (PARTITION BY w, i - n ORDER BY i) AS k FROM n),
         g AS (SELECT w, i, c FROM r WHERE CASE WHEN alone THEN n = 1 ELSE k % 2 = 1 END)
    SELECT w, toks[:(best & 4294967295) - 1] || [(best >> 32)::INT] || toks[(best & 4294967295) + 2:] AS toks FROM m JOIN t USING (w) WHERE NOT long
    UNION ALL
    SELECT p.w, list(coalesce(g.c, p.a) ORDER BY p.i) AS toks
    FROM p SEMI JOIN m ON p.w = m.w LEFT JOIN g ON p.w = g.w AND p.i = g.i ANTI JOIN g AS gone ON p.w = gone.w AND p.i = gone.i + 1
    WHERE p.long GROUP BY p.w))
SELECT w, toks FROM t
"""
#: One ordered aggregation decodes a whole lot; it is cut by the bytes of each piece.
_DECODE = """
SELECT string_agg(s, '' ORDER BY w << 32 | i) AS decoded
FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tokens) JOIN vocabulary USING (tok)
"""
_SIZES = "SELECT w, sum(length(s))::INT AS size FROM (SELECT w, unnest(toks) AS tok FROM tokens) JOIN vocabulary USING (tok) GROUP BY w ORDER BY w"


def _stitched(windows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray | None, list[tuple[int, int]]]:
    """(ids, spans) of windows (begin, end, ids, places of the tokens' ends): no ids, and wider spans, if any two cannot be joined."""
    parts, spans, begin = [], [windows[0][:2]], 0
    for (_, _, ids, at), (s, e, _, other) in zip(windows, windows[1:]):
        # Tokens at the same place in both, by where they begin and end.
        mine, theirs = np.searchsorted(at, s), 0
        x, y = (at[mine:-1] << 32) | at[mine + 1 :], (other[:-1] << 32) | other[1:]
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if len(i):
            k = len(i) // 2
            parts.append(ids[begin : mine + i[k]])
            begin = theirs + j[k]
            spans.append((s, e))
        else:
            spans[-1] = (spans[-1][0], e)
            begin = 0
    if len(spans) < len(windows):
        return None, spans
    return np.concatenate([*parts, windows[-1][2][begin:]]), spans


class Memory:
    """Keys with their ids and decoded bytes, as Arrow arrays; starts over from the last lot's when full."""

    def __init__(self, make: Callable[[pa.Array], tuple[pa.Array, pa.Array]], most: int) -> None:
        self.make, self.most = make, most
        self.keys, self.ids, self.decoded = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())

    def of(self, keys: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded) of different keys, in their order."""
        at = np.array(pc.fill_null(pc.index_in(keys, value_set=self.keys), -1))
        unknown = at < 0
        if unknown.any():
            new = keys.filter(pa.array(unknown))
            ids, decoded = self.make(new)
            if len(self.keys) + len(new) > self.most:
                known = pa.array(at[~unknown])
                self.keys, self.ids, self.decoded = (x.take(known) for x in (self.keys, self.ids, self.decoded))
                at[~unknown] = np.arange(len(known))
            at[unknown] = len(self.keys) + np.arange(len(new))
            self.keys, self.ids, self.decoded = (pa.concat_arrays(x) for x in ((self.keys, new), (self.ids, ids), (self.decoded, decoded)))
        return self.ids.take(pa.array(at)), self.decoded.take(pa.array(at))


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _joined(ids: pa.Array, decoded: pa.Array, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Runs of entries, from each end to the next, put together."""
    return (
        pa.ListArray.from_arrays(pa.array(np.asarray(ids.offsets)[ends], pa.int32()), ids.values),
        pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(_offsets(decoded)[ends].astype(np.int32)), decoded.buffers()[2]]),
    )


def _offsets(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]


def safe_merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """(left, right, merged, alone): ids of all merges.

    After a merge to ``c`` a new pair could have a rank below c's, but only if
    a longer word of lower rank takes c with a neighbour x, and x's pair with
    c's own part was not contracted before, as it has a higher rank or none.
    Such merges are ``alone``: after one of them all ranks are looked at anew.
    Of all others, all places that do not overlap may be contracted at once.
    """
    splits = {w: [(w[:i], w[i:]) for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks] for w in ranks}
    alone, none = set(), 1 << 40
    for word, rank in ranks.items():
        for x, y in splits[word]:
            if rank < ranks[y] and (x == y or any(ranks.get(x + a, none) > ranks[y] for a, _ in splits[y])):
                alone.add(y)
            if rank < ranks[x] and (x == y or any(ranks.get(b + y, none) > ranks[x] for _, b in splits[x])):
                alone.add(x)
    return [(ranks[a], ranks[b], c, word in alone) for word, c in ranks.items() for a, b in splits[word]]


class Codec:
    """Encodes texts by ranks; a rank is the id of its bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.ranks, self.pattern, self.spaced = ranks, regex.compile(pattern), regex.compile(r"\s*\S+|\s+")
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(w) for w in ranks]
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        a, b, c, alone = zip(*safe_merges(ranks))
        self.con.register("_m", pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "c": pa.array(c, pa.int32()), "alone": alone}))
        # Bytes as the characters of the same numbers, which text functions take.
        self.con.register("_v", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "s": [w.decode("latin-1") for w in ranks]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM _m; CREATE TABLE vocabulary AS SELECT * FROM _v")
        self.words, self.pieces = Memory(self._words, remembered), Memory(self._pieces, remembered)

    def _words(self, keys: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Cut words by the pattern; equal pieces are encoded once."""
        cut = [self.pattern.findall(_unit(k)) for k in keys.to_pylist()]
        ends = np.cumsum([0, *map(len, cut)])
        coded = pa.array([p for own in cut for p in own], pa.string()).dictionary_encode()
        ids, decoded = self.pieces.of(coded.dictionary)
        return _joined(ids.take(coded.indices), decoded.take(coded.indices), ends)

    def _pieces(self, keys: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Encode pieces; one that is in the vocabulary as a whole is its own token."""
        raw = [p.encode() for p in keys.to_pylist()]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))  # long ones, which take many rounds, together
        found, lot, size = [], [], 0
        for i in order:
            lot.append(i)
            size += len(raw[i])
            if len(lot) >= AT_ONCE or size >= AT_ONCE_BYTES:
                found.append(self._query([raw[i] for i in lot]))
                lot, size = [], 0
        if lot:
            found.append(self._query([raw[i] for i in lot]))
        back = pa.array(np.argsort(np.array(order, np.int64), kind="stable"))
        return tuple(pa.concat_arrays([f[k] for f in found]).take(back) for k in (0, 1))

    def _query(self, raw: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded) of pieces: of all in one query, and then of the windows of long ones."""
        long = [i for i, r in enumerate(raw) if len(r) > 2 * STEP and r not in self.ranks]
        if not long:
            return self._decoded(self._contracted(raw))
        apart = set(long)
        short = self._contracted([b"" if i in apart else r for i, r in enumerate(raw)])
        joined = dict(zip(long, self._joined_windows([raw[i] for i in long])))
        values, ends = np.asarray(short.values), np.asarray(short.offsets)
        lists = [joined[i] if i in apart else values[ends[i] : ends[i + 1]] for i in range(len(raw))]
        return self._decoded(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.int32())))

    def _contracted(self, raw: list[bytes]) -> pa.ListArray:
        """Ids of pieces, by one recursive query."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        tokens = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        whole = np.array([self.ranks.get(r, -1) for r in raw], np.int64)
        keep = np.repeat(whole < 0, sizes)
        keep[(np.cumsum(sizes) - 1)[whole >= 0]] = True
        tokens[(np.cumsum(sizes) - 1)[whole >= 0]] = whole[whole >= 0]
        ends = np.cumsum(np.append(0, np.where(whole < 0, sizes, 1)))
        self.con.register("words", pa.table({"w": np.arange(len(raw)), "toks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens[keep], pa.int32()))}))
        return _whole(self.con.sql(f"SELECT toks FROM ({_ENCODE}) ORDER BY w").to_arrow_table()["toks"]).cast(pa.list_(pa.int32()))

    def _decoded(self, ids: pa.ListArray) -> tuple[pa.Array, pa.Array]:
        """ids, and the bytes they stand for."""
        self.con.register("_t", pa.table({"w": np.arange(len(ids)), "toks": ids}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE tokens AS SELECT * FROM _t")
        decoded = (self.con.execute(_DECODE).fetchall()[0][0] or "").encode("latin-1")
        sizes = np.zeros(len(ids), np.int64)
        found = self.con.sql(_SIZES).to_arrow_table()
        sizes[np.asarray(_whole(found["w"]))] = np.asarray(_whole(found["size"]))
        return ids, pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(decoded)])

    def _joined_windows(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of long pieces, from windows that overlap by half.

        A row of tokens is what a piece contracts to if each two neighbours are
        what their bytes contract to, and so are all neighbours in a window.  Two
        windows that have one token in common at its place can be joined there.
        Where they have none, both become one window.
        """
        spans = [[(s, min(s + 2 * STEP, len(r))) for s in range(0, len(r) - STEP, STEP)] for r in raw]
        known: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        out: list[np.ndarray | None] = [None] * len(raw)
        while True:
            asked = [(i, s, e) for i, own in enumerate(spans) if out[i] is None for s, e in own if (i, s, e) not in known]
            lots = np.cumsum([e - s for _, s, e in asked]) // AT_ONCE_BYTES
            for lot in np.unique(lots):
                some = [asked[k] for k in np.flatnonzero(lots == lot)]
                ids = self._contracted([raw[i][s:e] for i, s, e in some])
                values, ends = np.asarray(ids.values), np.asarray(ids.offsets)
                for k, (i, s, e) in enumerate(some):
                    own = values[ends[k] : ends[k + 1]]
                    known[i, s, e] = own, s + np.append(0, np.cumsum(self.lengths[own]))
            for i, own in enumerate(spans):
                if out[i] is None:
                    out[i], spans[i] = _stitched([(s, e, *known[i, s, e]) for s, e in own])
            if all(o is not None for o in out):
                return out

    def batch(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        """(ids, decoded) of lots of texts, in their order; a null text is empty."""
        chars = np.asarray(pc.fill_null(pc.utf8_length(texts), 0), np.int64)
        lot = np.cumsum(chars) // LOT_CHARS
        starts = np.flatnonzero(np.diff(lot, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(chars))):
            yield self._lot(texts[int(a) : int(b)].fill_null(""))

    def _lot(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        odd = np.array(pc.match_substring_regex(texts, r"^$|^[ \n]|[ \n]$|[ \n][ \n]"))
        words, ends = _by_spaces(texts.filter(pa.array(~odd)))
        strange = np.zeros(len(words.dictionary), bool)
        maybe = np.flatnonzero(pc.match_substring_regex(words.dictionary, f"{_WHITE}$|^[ \n]?{_WHITE}"))
        strange[maybe] = [not _regular(words.dictionary[int(i)].as_py()) for i in maybe]
        if strange.any():
            odd[np.flatnonzero(~odd)[np.logical_or.reduceat(strange[np.asarray(words.indices)], ends[:-1])]] = True
            words, ends = _by_spaces(texts.filter(pa.array(~odd)))
        found = [self._of_words(words, ends)]
        if odd.any():
            cut = [[" " + u for u in self.spaced.findall(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
            found.append(self._of_words(pa.array([u for own in cut for u in own], pa.string()).dictionary_encode(), np.cumsum([0, *map(len, cut)])))
        back = pa.array(np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), kind="stable"))
        return tuple(pa.concat_arrays([f[k] for f in found]).take(back) for k in (0, 1)) if len(found) > 1 else found[0]

    def _of_words(self, words: pa.DictionaryArray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
        ids, decoded = self.words.of(words.dictionary)
        return _joined(ids.take(words.indices), decoded.take(words.indices), ends)


#: White space of any script, as Arrow's patterns know it.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _by_spaces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words that single spaces and line ends separate, without the space,
    and where each text's words end."""
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    words, ends = cut.values, np.asarray(cut.offsets)
    first = np.zeros(len(words), bool)
    first[ends[:-1]] = True
    marked = pc.binary_join_element_wise(pa.scalar(" "), words.filter(pa.array(first)), "")
    return pc.replace_with_mask(words, pa.array(first), marked).dictionary_encode(), ends


def _regular(word: str) -> bool:
    """Whether no white space but a line end in front is at either end."""
    body = word[1:] if word[0] in "\n " else word
    return not body[0].isspace() and not body[-1].isspace()


def _unit(key: str) -> str:
    """What a word stands for: with a space before it, unless it begins with a
    line end; a space in front marks one that stands for itself."""
    return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key


#: A worker's codecs, by the hash of their ranks and pattern.
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256), one row per input row.

    ``ranks_path`` is a vocabulary of base64 bytes and ranks that the driver
    reads and broadcasts (under 1 MB); special tokens are ordinary text.  No
    match of ``pattern`` may look behind or go on from another character to
    white space, as holds for the patterns of this family.  ``ids`` holds
    little-endian unsigned 32-bit integers.  ``decoded_sha256`` is of the bytes
    that the ids decode to.  A null text is empty and has no tokens; texts may have
    any length; a long piece is contracted by windows, which give the same ids; a null doc_id stays null; rows may
    repeat; extra columns are ignored; an empty table gives an empty result.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for part in parts:
            at = 0
            for ids, decoded in own.batch(part.column("text")):
                n = len(ids)
                ends = _offsets(ids)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends - ends[0]).astype(np.int32) * 4), pa.py_buffer(np.asarray(ids.values)[ends[0] : ends[-1]].astype("<u4").tobytes())])
                digest = lambda values: pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id")[at : at + n], pa.array(np.diff(ends).astype(np.int64)), raw, digest(raw), digest(decoded)],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
                at += n
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string"
    )
