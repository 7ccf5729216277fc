"""Centroid clusters, prefix trie and decontamination against brute force, with odd rows, ties and empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwire.llm import decontaminate, fm_index, pivot_clusters, prefix_trie

LONG = "filler text " * 20_000


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# clusters


def plain_clusters(vectors, k, rounds, scale):
    kept = [(i, np.floor(scale * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in vectors]
    key = lambda p: (hashlib.sha256(f"1:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1].tolist())
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        done = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, m) in zip(kept, done) if m == n]
            if mine:
                cents[n] = sum(mine) // len(mine)
    done = assign()
    inertia = defaultdict(int)
    for d, n in done:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, done)), key=repr)


def test_clusters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, [0.0] * 8), (901, [-1.5] * 8)]  # repeated row, null id
    odd = [(1000, None), (1001, []), (1002, [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [float("nan")] * 8), (1005, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string").repartition(5)
    for k in (1, 4, 16):
        got = rows_of(pivot_clusters.cluster(df, clusters=k, rounds=3, dim=8, scale=16))
        assert got == plain_clusters(rows, k, 3, 16)


def test_clusters_of_few_equal_large_and_no_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [0.5, -0.25]) for i in range(4)], shape)
    got = pivot_clusters.cluster(same, dim=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 4  # ties: smaller number
    large = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1e30, 1.0])], shape)
    got = {r.vec_id: r.cluster for r in pivot_clusters.cluster(large, dim=2).collect()}
    assert got == {1: 0, 2: None}
    assert pivot_clusters.cluster(same.limit(0), dim=2).collect() == []
    assert pivot_clusters.cluster(spark.createDataFrame([(1, None)], shape), dim=2).collect() == []


def test_pivots_leave_out_centroids_without_losing_the_nearest():
    rng = np.random.default_rng(2)
    pivots = rng.integers(-64, 64, size=(16, 64))
    rows = pivots[rng.integers(0, 16, 2000)] + rng.integers(-12, 12, size=(2000, 64))
    centroids = pivots + rng.integers(-2, 3, size=pivots.shape)
    centroids[9] = centroids[4]
    who, best, taken = pivot_clusters.nearest(rows, pivot_clusters.squared(rows, pivots), centroids, pivots)
    every = pivot_clusters.squared(rows, centroids)
    assert (best == every.min(axis=1)).all() and (who == every.argmin(axis=1)).all()
    assert taken < 0.3 * every.size


# trie


def plain_trie(rows, rebuilt=True):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in turns.items()}
    members = defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = []
    for node, m in members.items():
        ends = sorted(c for c in m if len(turns[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], sha))
    return sorted(out, key=repr)


SHAPE = "conv_id long, turn long, role string, text string, depth string, key string"


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(11)
    rows = []
    for c in range(260):
        if c % 37 == 20:
            continue  # some first conversations are missing
        size = 1 + int(rng.integers(0, 5))
        path = [int(rng.integers(0, 2)) for _ in range(size)] if c % 3 else [1, 0, 1]
        rows += [(c, d, ("user", "assistant", None)[(d + c // 200) % 3], f"turn {d} says {'x ' * p}{path[: d + 1]}") for d, p in enumerate(path)]
    rows += [(301, None, "user", None), (301, 0, None, ""), (301, 0, "user", "tie"), (301, 0, "user", "a tie"), (301, 0, "user", "tie")]
    rows += [(302, t, "user", f"long talk {t // 3}") for t in range(700)] + [(303, 1, "user", LONG), (None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("shard_turns", [3, 40, 1 << 18])
def test_trie_is_that_of_brute_force_whatever_the_shards(spark, talks, shard_turns):
    df = spark.createDataFrame([(*r, "x", "y") for r in talks], SHAPE).repartition(6)
    assert rows_of(prefix_trie.conversation_trie(df, shard_turns)) == plain_trie(talks)


def test_trie_of_nothing_and_of_turnless_paths(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SHAPE)).collect() == []
    paths = spark.createDataFrame([(5, b"", []), (2, b"", [])], "conv_id long, key binary, words array<int>")
    got = prefix_trie.trie(paths).collect()
    assert [tuple(r) for r in got] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,5").hexdigest())]


def test_ids_of_a_crowded_end_are_hashed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_SPAN", 3)
    ids = [7, 0, 12, 5, 100, 99, 4, 1]
    paths = spark.createDataFrame([(c, b"k" * 16, [4]) for c in ids], "conv_id long, key binary, words array<int>").repartition(3)
    top = {r.depth: r for r in prefix_trie.trie(paths).collect()}[1]
    assert (top.conv_id, top.n_convs, top.saved_tokens) == (0, 8, 28)
    assert top.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


@pytest.mark.parametrize("block", [2, 8, 64])
def test_closing_parentheses_are_found_across_blocks(block):
    rng = np.random.default_rng(block)
    depth = [0]
    for _ in range(3000):
        depth.append(int(rng.integers(1, depth[-1] + 2)))
    depth = np.array(depth)
    parens = prefix_trie.Parens(depth, block)
    close, stack = np.zeros(len(depth), dtype=np.int64), []
    node = 0
    for at, bit in enumerate(parens.bits):
        if bit:
            stack.append(node)
            node += 1
        else:
            close[stack.pop()] = at
    assert (parens.find_close(batch=500) == close).all()


# decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(text, items, width=10):
    words, hit, found = plain_words(text), set(), set()
    for item, other in items:
        w = plain_words(other)
        for at in range(max(1, len(w) - width + 1)) if w else []:
            phrase = w[at : at + width]
            for s in range(len(words) - len(phrase) + 1):
                if words[s : s + len(phrase)] == phrase:
                    hit |= set(range(s, s + len(phrase)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, then sleeps all day."), (2, "Over the lazy dog, then sleeps all day. And eats 7 apples a day!"),
    (30, "short item"), (4, "ünïcode 日本 words"), (5, None), (6, "..."), (None, "no id here"), (1, "second text of item one"), (7, "a a a"),
]
TEXTS = [
    None, "", " \n", "nothing to see", "SHORT item and short-item, short\x00item, short item", "short", "item short item short",
    "x the QUICK brown fox jumps over the lazy dog then sleeps all day and eats 7 apples a day no", "the quick brown fox jumps over the lazy",
    "dog then sleeps all day", "ÜNÏCODE 日本 words; ünïcode 日本 words", "a a a a a b a a", "a a", "second text of item one " * 3, "no id here?",
    LONG + "the quick brown fox jumps over the lazy dog then " + LONG, "short", "item",
]


@pytest.mark.parametrize("sizes", [(1 << 17, 1 << 20), (4, 1 << 20), (1 << 17, 1), (7, 20)])
def test_leaks_are_those_of_brute_force_whatever_the_blocks_and_shards(spark, sizes):
    rows = [(i % 15, t, "x", None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, words string").repartition(3)
    bench = spark.createDataFrame([(i, t, "y") for i, t in ITEMS], "item_id long, text string, phrase string")
    found = decontaminate.find(df, bench, block=sizes[0], shard_words=sizes[1])
    assert found.columns == ["doc_id", "text", "n_words", "words", "leaks"]
    got = found.withColumn("clean", decontaminate.cut()).collect()
    assert len(got) == len(rows)
    for r in got:
        n_words, n_hit, items = plain_leaks(r.text, ITEMS)
        assert (r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) == (n_words, n_hit, items), r.text
        inside = "".join(r.text[s.start : s.end] + " " for s in r.leaks.spans)
        assert len(plain_words(inside)) == n_hit
        if r.text is None:
            assert r.clean is None
        else:
            assert len(r.clean) == len(r.text) - sum(s.end - s.start for s in r.leaks.spans)
            assert not (n_hit and r.text.startswith("x the") and "quick" in r.clean.lower())


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "short item"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find(docs.limit(0), bench).collect() == []
    got = decontaminate.find(docs, bench.limit(0)).collect()
    assert [(r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) for r in got] == [(2, 0, []), (0, 0, [])]
    assert decontaminate.find(docs.withColumn("leaks", F.lit(1)), bench, keep=["doc_id"]).columns == ["doc_id", "leaks"]


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    sigma = (3, 5, 40, 1000)[seed]
    text = np.append(rng.integers(0, sigma, 4000) * (rng.random(4000) > 0.1), 0)
    text[1000:1400] = text[2000:2400]
    index = fm_index.FMIndex(text, sigma, sample=7)
    full = text.tolist()
    for length in (1, 3, 12):
        at = rng.integers(0, 3900, 50)
        patterns = np.array([text[a : a + length] for a in at if (text[a : a + length] > 0).all()] + [rng.integers(1, sigma, length)])
        low, high = index.ranges(patterns)
        for p, a, b in zip(patterns.tolist(), low, high):
            want = [s for s in range(len(full) - length) if full[s : s + length] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
