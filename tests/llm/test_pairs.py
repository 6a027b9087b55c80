"""SimHash and passages against brute force; odd rows; crowded anchors."""

import inspect
import random
import time
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from presswell.llm import simhash, substring
from presswell.llm.common import batches_of
from presswell.llm.graph import connected_components, forest


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", "One", "one two", "A b C d É é", "x " * 9000, "ß ẞ\x0bK K"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute_components(fps, ids):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    return dict(zip(*(x.tolist() for x in forest(ids[a], ids[b]))))


@pytest.mark.parametrize("crowded, block", [(64, 1024), (2, 3)])
def test_links_connect_what_brute_force_connects(spark, crowded, block):
    rng = random.Random(1)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        fps.append(rng.getrandbits(64))
        for _ in range(12):
            fp = rng.choice(fps[-6:])
            for _ in range(rng.randint(1, 4)):
                fp ^= 1 << rng.randrange(64)
            fps.append(fp)
    fps = sorted({simhash._signed(f) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = [(r["a"], r["b"]) for r in simhash.anchor_links(df, 3, crowded, block).collect()]
    got = dict(zip(*(x.tolist() for x in forest(np.array([a for a, _ in links]), np.array([b for _, b in links])))))
    values = np.array(fps, np.int64)
    want = brute_components(values.view(np.uint64), values)
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_of_test_data(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas()
    want = brute_components(np.array([int(x, 16) for x in got["fingerprint"]], np.uint64), got["doc_id"].to_numpy())
    assert [want[i] for i in got["doc_id"]] == got["component_id"].tolist()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_components_in_rounds(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    own = [(a, b) for a, b in edges if a != b]
    want = dict(zip(*(x.tolist() for x in forest(np.array([a for a, _ in own]), np.array([b for _, b in own])))))
    for bound in (1_000_000, 3):
        got = {r["node"]: r["root"] for r in connected_components(df, bound).collect()}
        name = {}
        assert len(got) == len(want)
        assert all(name.setdefault(got[n], want[n]) == want[n] for n in want) and len(set(name.values())) == len(name)


def test_simhash_of_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got.to_dict("records") if r["doc_id"] == r["doc_id"]}
    assert by_id[2]["component_id"] == 1 and by_id[4]["component_id"] == by_id[7]["component_id"] == 3 and by_id[3]["fingerprint"] == "0" * 16
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "6", "8", "None", "None"]
    assert simhash.near_duplicates(odd.limit(0)).count() == simhash.keep_one(odd.limit(0)).count() == 0


def slow_windows(values, length):
    found = set()
    for i in range(len(values)):
        for j in range(i + length - 1, len(values)):
            c = i + int(np.argmin(values[i : j + 1]))
            left = max((k + 1 for k in range(c) if values[k] <= values[c]), default=0)
            right = min((k - 1 for k in range(c + 1, len(values)) if values[k] < values[c]), default=len(values) - 1)
            found.add((left, c, right))
    return found


@pytest.mark.parametrize("size, high, length", [(5, 9, 6), (40, 4, 3), (60, 10**9, 5), (120, 10**9, 46)])
def test_compact_windows(size, high, length):
    values = np.random.default_rng(size).integers(0, high, size).astype(np.uint64)
    assert set(map(tuple, substring.compact_windows(values, length).tolist())) == slow_windows(values, length)


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(3)
    passage, quote = prose(rng, 60), prose(rng, 30)
    edited = [*passage[:30], "changed", *passage[31:]]
    rows = [
        (1, [*prose(rng, 90), *passage, *prose(rng, 40)]), (2, [*passage, *prose(rng, 70)]), (3, [*prose(rng, 200), *edited]),
        (4, [*prose(rng, 20), *quote, *prose(rng, 90)]), (5, [*prose(rng, 50), *quote, *prose(rng, 50)]), (6, prose(rng, 300)),
    ]
    rows += [(k, [*prose(rng, 5), *passage, *prose(rng, 5)]) for k in range(10, 40)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")
    got = substring.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {2, 3, *range(10, 40)}
    assert all(r["source_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 for r in got)
    two = next(r for r in got if r["doc_id"] == 2)
    assert (two["start_word"], two["end_word"], two["source_doc_id"], two["source_start"], two["similarity"]) == (0, 60, 1, 90, 1.0)
    left = {r["doc_id"]: r["text"].split() for r in substring.cut_passages(docs).collect()}
    assert left[2] == rows[1][1][60:] and left[1] == rows[0][1] and left[6] == rows[5][1] and len(left[10]) == 10


def planted(spark, groups):
    """Each group's passages in random context; ids count up within a group from a hundred times its number."""
    rng = random.Random(5)
    rows = [(100 * g + k, " ".join([*prose(rng, 90), *words, *prose(rng, 90)])) for g, passages in enumerate(groups) for k, words in enumerate(passages)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def test_exact_passages_after_partial_quotes(spark):
    rng, groups = random.Random(6), []
    for g in range(40):
        passage = prose(rng, 50)
        edited = [w if i % 7 else "changed" for i, w in enumerate(passage)]
        groups.append([passage[:49], passage[1:], passage[3:48], edited, passage, passage[:49], passage[2:], edited, passage])
    found = {(r["doc_id"], r["source_doc_id"]) for r in substring.repeated_passages(planted(spark, groups)).collect()}
    assert {(100 * g + 8, 100 * g + 4) for g in range(40)} <= found


@pytest.mark.parametrize("change", ["insert", "delete"])
def test_near_passages_with_a_shifted_rest(spark, change):
    rng, groups = random.Random(7), []
    for g in range(60):
        passage = prose(rng, 50)
        edited = [*passage[:25], "changed", *passage[25:]]
        groups.append([passage, edited] if change == "insert" else [passage[:25] + passage[26:], passage])
    got = {r["doc_id"] for r in substring.repeated_passages(planted(spark, groups)).collect()}
    assert got <= {100 * g + 1 for g in range(60)}
    assert len(got) >= 54


def test_crowded_passages(spark):
    """A passage of very many documents is dealt out in parts, and found in each but the first."""
    rng = random.Random(9)
    docs = planted(spark, [[prose(rng, 55)] * 90, [prose(rng, 55)] * 2, [prose(rng, 55)]])
    got = substring.repeated_passages(docs, crowd=8).collect()
    assert {r["doc_id"] for r in got} == {*range(1, 90), 101} and all(r["source_doc_id"] < r["doc_id"] for r in got)


@pytest.mark.parametrize("crowd", [4096, 4])
def test_near_passages_between_others_of_their_keys(spark, crowd):
    """A passage that is alike neither to the first of its keys nor to the one before, but to one between."""
    rng, groups = random.Random(11), []
    for g in range(20):
        passage, near = prose(rng, 60), None
        near = [*passage[:30], "changed", *passage[31:]]
        edited = [[f"edit{k}" if i in at else w for i, w in enumerate(passage)] for k in range(24) for at in [{rng.randint(8, 16), rng.randint(26, 34), rng.randint(43, 51)}]]
        groups.append([*edited[:12], near, *edited[12:], passage])
    docs = planted(spark, groups)
    found = {(r["doc_id"], r["source_doc_id"]) for r in substring.repeated_passages(docs, crowd=crowd).collect()}
    assert len({(100 * g + 25, 100 * g + 12) for g in range(20)} & found) >= 17


def test_pairs_by_tokens_against_brute_force(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(substring, "PAIRS_AT_ONCE", 50)
    rng, rows = random.Random(12), []
    for key in range(3):
        for d in range(30):
            ts = np.array(sorted(rng.sample(range(40), rng.randint(1, 15))), np.int64)
            rows.append((key, 0, d, 0, ts))
            if d % 3 == 0:
                rows.append((key, 0, d, rng.randint(2, 5), ts))
    want = {(d, key, e, len({*ts} & {*us})) for key, _, d, least, ts in rows if least for k, _, e, no, us in rows
            if k == key and not no and e < d and len({*ts} & {*us}) >= least}
    table = pd.DataFrame(rows, columns=["key", "part", "d", "least", "ts"])
    table = table.assign(last=table["least"] == 0).sort_values(["key", "part", "last", "d"]).drop(columns="last")
    got = [tuple(r) for part in substring._alike(iter([table[:40], table[40:77], table[77:]])) for r in part.itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) == want


def family(rng, n, edits):
    """Regions of 110 tokens, each with edits of its own: five tokens changed at so many places."""
    base, out = rng.integers(0, 2**40, 110), []
    for _ in range(n):
        own = base.copy()
        for at in rng.permutation(11)[:edits] * 10 + rng.integers(0, 5):
            own[at : at + 5] = rng.integers(0, 2**40, len(own[at : at + 5]))
        out.append(own)
    return out


def asked(rows):
    table = pd.DataFrame([(0, 0, d, least, ts) for least in (36, 0) for d, ts in enumerate(rows)], columns=["key", "part", "d", "least", "ts"])
    return {(r.d, r.e) for part in substring._alike(iter([table]), 46, 0.8) for r in part.itertuples()}


def test_pairs_of_a_family_that_are_not_alike():
    """Near copies with edits of their own share many tokens, but only what could be alike is told of, so that their number does not grow with the square."""
    rng = np.random.default_rng(14)
    for n in (40, 80):
        rows = family(rng, n, 7)
        plain = pd.DataFrame([(0, 0, d, least, np.unique(ts)) for least in (36, 0) for d, ts in enumerate(rows)], columns=["key", "part", "d", "least", "ts"])
        assert sum(map(len, substring._alike(iter([plain])))) > n * n / 3
        near = rows[3].copy()
        near[50:55] = rng.integers(0, 2**40, 5)
        found = asked([*rows, near])
        assert (n, 3) in found and len(found) <= n / 4


def test_passages_around_a_long_edit_are_asked_for(monkeypatch):
    """Whatever has a passage by ``matched_spans`` could be alike, also where no run of the least length is."""
    rng, alike, told = np.random.default_rng(15), 0, 0
    for i in range(400):
        if i == 200:
            monkeypatch.setattr(substring, "PAIRS_AT_ONCE", 100)
        base = rng.integers(0, 2**40, 80).astype(np.uint64)
        other = base.copy()
        for _ in range(rng.integers(1, 4)):
            at, many = rng.integers(0, 75), rng.integers(1, 9)
            other[at : at + many] = rng.integers(0, 2**40, len(other[at : at + many]))
        if i % 3 == 0:
            other = np.delete(other, slice(30, 30 + rng.integers(1, 6)))
        is_alike = bool(substring.matched_spans(base, other, 46, 0.8))
        asks = substring._could_be_alike(base, [other, np.concatenate([other[:20], other[:20] + np.uint64(1), other[20:40]])], 46, 0.8).tolist()
        assert not asks[1] and (asks[0] or not is_alike)
        alike, told = alike + is_alike, told + asks[0]
    assert 100 < alike <= told < 400
    edited = base[:67].copy()
    edited[31:38] = rng.integers(0, 2**40, 7)
    other, tail = (rng.integers(0, 2**40, 30).astype(np.uint64) for _ in range(2))
    tail = np.concatenate([tail, base[67:], tail[::-1]])
    spans = substring.matched_spans(np.concatenate([base[:67], other, tail]), np.concatenate([edited, other[::-1] + np.uint64(1), tail]), 46, 0.8)
    assert (0, 67, 0, 67) in {s[:4] for s in spans} and substring._could_be_alike(base[:67], [edited], 46, 0.8).all()


def test_spans_of_repeated_beginnings():
    rng = np.random.default_rng(8)
    word = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    tokens = lambda *parts: substring.shingle_hashes(np.concatenate(parts), 5)
    for size, early in ((94, slice(0, 49)), (50, slice(0, 10)), (50, slice(40, 50)), (94, slice(45, 94))):
        passage = word(size)
        source = tokens(word(30), passage[early], word(200), passage, word(30), passage[early], word(9))
        spans = substring.matched_spans(tokens(word(60), passage, word(20)), source, 46, 0.8)
        at = 230 + len(passage[early])
        assert (60, 60 + size - 4, at, at + size - 4, 1.0) in spans
    line = np.tile(word(3), 2000)
    assert substring.matched_spans(tokens(word(60), line), tokens(word(9), line), 46, 0.8)[0][4] == 1.0
    assert substring.matched_spans(word(60), word(60), 46, 0.8) == []


def test_few_members_and_many_replicas(spark):
    """Beside an anchor with few members lies a crowd: its replicas are cut by their own number, and no link is lost."""
    rng = random.Random(13)
    base = rng.getrandbits(64)
    word = lambda bits: base ^ sum(1 << b for b in bits)
    # One half is common to all; the other halves differ in many bits, but for a few planted pairs.
    fps = {base ^ (rng.getrandbits(31) << 32) ^ (1 << rng.randrange(31)) for _ in range(400)} | {base ^ (rng.getrandbits(31) << 32) for _ in range(12)}
    fps |= {word(bits) for bits in ((40,), (40, 41), (50, 3), (51, 4, 5))}
    signed = [simhash._signed(x) for x in sorted(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {tuple(sorted(p)) for r in simhash.anchor_links(df, 3, 5, 16).collect() for p in [(r["a"], r["b"])]}
    want = {(x, y) for i, x in enumerate(signed) for y in signed[i + 1 :] if bin((x ^ y) & (2**64 - 1)).count("1") <= 3}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def groups(links):
        for x in signed:
            root[x] = x
        for x, y in links:
            root[find(x)] = find(y)
        return sorted(sorted(x for x in signed if find(x) == r) for r in {find(x) for x in signed})

    assert groups(want) == groups(got) and got <= {tuple(sorted((x, y))) for g in groups(want) for x in g for y in g}


def test_chains_are_those_of_all_pairs():
    """Each run follows the best of all runs before it, as when all are compared."""
    rng = random.Random(11)
    for _ in range(60):
        rows, taken = [], {}
        for _ in range(60):
            p, d, n = rng.randrange(300), rng.randrange(-60, 60), rng.randrange(8, 40)
            # Runs of one diagonal are apart.
            if p + d >= 0 and all(p + n < x or y < p for x, y in taken.setdefault(d, [])):
                taken[d].append((p, p + n))
                rows.append((p, p + d, n))
        rows.sort()
        best = [0] * len(rows)
        for i, (p, q, _) in enumerate(rows):
            for j in range(i):
                pj, qj, nj = rows[j]
                part = min(nj, p - pj, q - qj)
                if part > 0 and p - pj - part <= substring.SLACK and q - qj - part <= substring.SLACK:
                    best[i] = max(best[i], best[j] + part)
        for chain in substring._chains(rows, 0):
            total = sum(min(x[2], y[0] - x[0], y[1] - x[1]) for x, y in zip(chain, chain[1:]))
            assert total == best[rows.index(chain[-1])]


def test_repetitive_texts_are_verified_whole():
    """Thousands of words of one phrase, with other words between: no cap, no passage, and the one there is."""
    rng = np.random.default_rng(12)
    word = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for size, repeats in ((30, 230), (20, 300), (40, 60)):
        phrase, passage = word(size), word(64)
        near = passage.copy()
        near[31] = word(1)[0]
        filled = lambda: np.concatenate([x for _ in range(repeats) for x in (phrase, word(1))])  # noqa: E731, B023
        tokens = lambda *parts: substring.shingle_hashes(np.concatenate(parts), 5)
        began = time.perf_counter()
        assert substring.matched_spans(tokens(filled()), tokens(filled()), 46, 0.8) == []
        ((a0, a1, b0, b1, j),) = substring.matched_spans(tokens(filled(), passage), tokens(near, filled()), 46, 0.8)
        assert (a1 - a0, b0, b1) == (60, 0, 60) and a0 == repeats * (size + 1) and 0.8 <= j < 1
        assert time.perf_counter() - began < 20


def test_passages_of_test_data(spark, small):
    """Every run of 50 words that an earlier document has is inside a found passage."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {}
    for r in substring.repeated_passages(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    seen = {}
    for r in docs.orderBy("doc_id").collect():
        words = r["text"].encode().split()
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        for k, run in enumerate(runs):
            if seen.get(run, r["doc_id"]) != r["doc_id"]:
                assert any(s <= k and k + 50 <= e for s, e in found[r["doc_id"]])
        for run in runs:
            seen.setdefault(run, r["doc_id"])


def test_passages_of_odd_rows(spark, odd):
    got = substring.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["source_doc_id"], r["whole"]) for r in got} == {(2, 1, True)}
    left = substring.cut_passages(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert substring.repeated_passages(odd.limit(0)).count() == substring.cut_passages(odd.limit(0)).count() == 0


def test_without():
    assert substring.without("  a b\n\nc d ", [(1, 2)]) == "  a c d "
    assert substring.without("a b", [(0, 2)]) is None and substring.without("a  b", []) == "a  b" and substring.without(None, [(0, 1)]) is None


def test_workers_take_few_texts_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda parts: (pd.DataFrame({"n": [len(part)]}) for part in parts)
    with pytest.raises(ValueError), batches_of(spark, 7):
        assert max(r["n"] for r in spark.range(100).mapInPandas(sizes, "n long").collect()) <= 7
        raise ValueError
    assert spark.conf.get(name) == before
    assert "with batches_of(" in inspect.getsource(substring._passages)
