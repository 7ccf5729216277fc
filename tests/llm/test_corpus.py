"""Operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import json
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import oracle
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from plantwire.llm import boilerplate, caps, catalog, covering, graph, host_trust, mixing, near_copies, pieces, pii, quality, simhash, token_files, tool_calls
from plantwire.llm.staging import Stages

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end."
TEXTS = [None, "", " \n\t ", "one", "One two", "the same text here twice", "the same text here twice", LONG, "ünï cödé 日本 \U0001d518 a,b. c", "▁ x  y\n\nz"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id and columns whose names operators use."""
    rows = [(i, t, "s", "n", True, 1.0) for i, t in enumerate(TEXTS)] + [(3, "one", None, "n", None, None), (None, "one", "s", None, False, 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, kept boolean, rate double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def smallest(nodes, linked):
    """Smallest member of each node's component."""
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {n: root(n) for n in nodes}


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 150), (160, 161), (161, 160)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "t")).collect()
    want = smallest({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("crowded", [2048, 2])
def test_simhash(docs, crowded):
    texts = texts_of(docs)
    prints = {i: plain_print(t) for i, t in texts.items()}
    linked = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3]
    got = simhash.near_duplicates(docs, crowded).collect()
    assert {r.doc_id: (r.print % (1 << 64), r.component_id) for r in got} == {i: (prints[i], c) for i, c in smallest(prints, linked).items()}


def test_covering_is_complete():
    rng = np.random.default_rng(3)
    for masks in simhash.covering_masks(2):
        for _ in range(300):
            bits = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not bits & m for m in masks)


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r.component_id for r in got if r.print == 0} == {0}
    assert {r.component_id for r in got if r.print % (1 << 64) == plain_print("one")} == {3}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and ids[None] == 1 and ids[6] == 0 and ids[5] == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_agree_with_brute_force(spark, docs, block):
    rng, texts = np.random.default_rng(6), texts_of(docs)
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        for n in range(4):  # each copy has a few words changed
            texts[100_000 + 10 * k + n] = " ".join(words)
            for at in rng.integers(0, len(words), max(1, len(words) // 80)):
                words[at] = f"x{rng.integers(0, 5000)}"

    def shingles(text):
        words = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}

    sets = {i: shingles(t) for i, t in texts.items()}
    linked = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in linked if (plain_print(texts[i]) ^ plain_print(texts[j])).bit_count() > 3]
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [r.doc_id for r in near_copies.drop_near_duplicates(rows, block).select("doc_id").collect()]
    assert far and sorted(got) == sorted(set(smallest(sets, linked).values()))


def test_linked_sets_of_large_groups(spark):
    rng = np.random.default_rng(4)
    first, sets, group = rng.integers(-(1 << 62), 1 << 62, (4, 60)), [], []
    for k, texts in enumerate((60, 50, 40, 3)):
        for n in range(texts):  # families with members at the limit, some apart, and some of other sizes
            changed = rng.choice(60, (2, 5, 12)[n % 3], replace=False)
            made = first[k].copy()
            made[changed] = rng.integers(-(1 << 62), 1 << 62, len(changed))
            sets.append(np.unique(made[: 60 - 15 * (n % 5 == 0)]))
            group.append(k % 3)
    schema = "group long, node long, shingles array<long>"
    rows = spark.createDataFrame([(g, n, s.tolist()) for n, (g, s) in enumerate(zip(group, sets))], schema)
    plain = {n: {n} for n in range(len(sets))}
    for a, b in combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if group[a] == group[b] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) and plain[a] is not plain[b]:
            plain[a] |= plain[b]
            for n in plain[b]:
                plain[n] = plain[a]
    for block in (4, 16, 1024):
        found = near_copies._linked(rows, Stages(spark, "t"), block)
        label = list(range(len(sets)))
        for r in found.collect():
            low, high = sorted((label[r.u], label[r.v]))
            label = [low if x == high else x for x in label]
        assert {n: {m for m in plain if label[m] == label[n]} for n in plain} == plain


def test_large_family_is_not_copied_for_each_block(spark, monkeypatch):
    texts = [(g, n, [g * 1000 + i for i in range(100)] + [-1 - n]) for g in range(2) for n in range(g * 1000, g * 1000 + 160 - 80 * g)]
    rows, seen = spark.createDataFrame(texts, "group long, node long, shingles array<long>"), []
    write = Stages.write
    monkeypatch.setattr(Stages, "write", lambda self, df, name: (out := write(self, df, name)) and (seen.append(out.count()) if name == "ends" else None) or out)
    found = near_copies._linked(rows, Stages(spark, "t"), 8)
    assert {r.u // 1000 for r in found.collect()} == {0, 1}
    assert seen[0] < 30  # all pairs of 30 blocks would be 20 * 19 + 10 * 9


def test_thinned_ties_keep_the_components():
    draw = np.random.default_rng(6).integers(0, 300, (4000, 2))
    kept = pd.concat(near_copies._thinned(iter([pd.DataFrame(draw[at : at + 900], columns=["u", "v"]) for at in range(0, 4000, 900)])))
    assert len(kept) == len(np.unique(draw)) - 1 and {tuple(sorted(p)) for p in kept.to_numpy().tolist()} <= {tuple(sorted(p)) for p in draw.tolist()}


def test_near_copies_of_repeated_ids(spark):
    one, two = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, one), (1, two), (1, one), (2, one + " more"), (3, two)]
    got = near_copies.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, one), (1, two)]


def set_with(rng, size, common):
    """Two sets of ``size`` hashes with so many in common."""
    both = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
    return both[:size], np.concatenate([both[:common], both[size:]])


@pytest.mark.parametrize("size", [27, 180])
def test_covering_tables_meet_near_copies(size):
    rng, met, tied = np.random.default_rng(size), 0, 0
    for _ in range(500):
        a, b = (near_copies.fingerprints(s) for s in set_with(rng, size, size * 8 // 9))  # similarity 0.8
        met += any(not int(x) & m for x in a ^ b for m in near_copies._KEPT_BITS)
        tied += np.bitwise_count(a ^ b)[: near_copies.CHECKED].sum() <= near_copies.NEAR
    assert met >= 495 and tied >= 498
    both = set_with(rng, 700, 0)[0]
    plain = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > 700) for hashes in near_copies.mixed(both).T]
    assert near_copies.fingerprints(both).tolist() == plain


def test_covering_of_a_part_is_complete():
    for radius in (1, 2):
        masks = covering.masks(range(5, 5 + near_copies.PART), radius)
        for bits in combinations(range(64), radius):
            assert any(not sum(1 << b for b in bits) & m for m in masks)


@pytest.mark.parametrize("crowded", [30, 1 << 16])
def test_ties_of_the_near_copy_stage(spark, crowded):
    """Candidates are the pairs of a bucket whose checked prints are near, whatever the size of the bucket."""
    rng, rows = np.random.default_rng(8), []
    for k in range(12):
        first = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        for n in range(60 if k == 0 else 4):
            copy = first.copy()
            copy[rng.integers(0, 200, 9)] = rng.integers(0, 1 << 63, 9, dtype=np.uint64)
            rows.append(near_copies.fingerprints(copy))
    meet = lambda a, b: any(not int(x) & m for x in a ^ b for m in near_copies._KEPT_BITS)
    near = lambda a, b: np.bitwise_count(a ^ b)[: near_copies.CHECKED].sum() <= near_copies.NEAR
    linked = [(i, j) for i, j in combinations(range(len(rows)), 2) if near(rows[i], rows[j]) and meet(rows[i], rows[j])]
    classes = spark.createDataFrame([(i, r.view(np.int64).tolist()) for i, r in enumerate(rows)], "node long, prints array<long>").repartition(3)
    ties = [(r.u, r.v) for r in near_copies._candidates(classes, Stages(spark, "t"), crowded).collect()]
    assert linked and all(near(rows[u], rows[v]) for u, v in ties)
    assert smallest(range(len(rows)), ties) == smallest(range(len(rows)), linked)


def test_ties_of_a_bucket_are_fewer_than_its_texts():
    """Groups of up to 120 near prints in one bucket, chains of near prints, and prints near to none."""
    rng, rows = np.random.default_rng(12), []
    for bucket, size in enumerate([2, 3, 40, 120, 1, 90]):
        first = rng.integers(-(1 << 62), 1 << 62, near_copies.CHECKED)
        for n in range(size):
            prints = first ^ (rng.integers(0, 1 << 62, near_copies.CHECKED) & rng.integers(0, 1 << 62, near_copies.CHECKED) if n % 7 == 6 else 1 << n % 60)
            rows.append([bucket, 1000 + 7919 * len(rows) % 997, *prints])
            first = prints if bucket == 5 and n % 7 != 6 else first
    rows = np.array(rows, dtype=np.int64)
    near = lambda a, b: np.bitwise_count(rows[a, 2:] ^ rows[b, 2:]).sum() <= near_copies.NEAR
    pairs = [(a, b) for a, b in combinations(range(len(rows)), 2) if rows[a, 0] == rows[b, 0] and near(a, b)]
    for crowded in (1 << 16, 128):
        got = near_copies._tied(rows, crowded)
        at = {int(node): k for k, node in enumerate(rows[:, 1])}
        ties = [(at[u], at[v]) for u, v in zip(got["u"], got["v"])]
        assert {tuple(sorted(t)) for t in ties} <= set(pairs)
        want = smallest(range(len(rows)), pairs)
        assert smallest(range(len(rows)), ties) == want and len(ties) == len(rows) - len(set(want.values())) < len(pairs) // 10


def test_url_filters(spark):
    urls = [
        "http://A.Example.org/es/x", "https://example.org/en/15?q", "https://x.example.org/fr", "http://b.com/de/#a", "http://b.com/fr/1", "http://b.com/x",
        "http://notorg/x", "no scheme", None, "http://net.net", "http://sub.b.com/y",
    ]
    html = '<a class="k" href="//other.net/p">x</a><a href="/rel">y</a>'
    rows = [(i, u, html if i == 3 else None, 9) for i, u in enumerate(urls)]
    got = {r.page_id: r for r in host_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string, trust int")).collect()}
    assert [got[i].rule for i in range(11)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", None, None, None, None, None, None]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "block", "allow"]
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/x") and (got[7].host, got[7].path, got[8].host) == ("", "", "")
    assert got[9].verdict == got[7].verdict == "allow"
    assert host_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_spread_is_personalised_pagerank(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2))})
    edges = spark.createDataFrame([("k", str(a), str(b), 1.0 + a) for a, b in pairs], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("k", "1", 3.0), ("k", "4", 1.0)], "kind string, host string, weight double")
    m = np.zeros((12, 12))
    for a, b in pairs:
        m[b, a] += 1.0 + a
    for a in range(12):
        m[a, a] += m[:, a].sum() == 0
    m /= m.sum(axis=0)
    seed = np.zeros(12)
    seed[[1, 4]] = 0.75, 0.25
    want = np.linalg.solve(np.eye(12) - 0.85 * m, 0.15 * seed)
    got = {int(r.host): r.score for r in host_trust.spread(edges, seeds, Stages(spark, "t"), tolerance=1e-7).collect()}
    assert all(abs(got.get(k, 0.0) - want[k]) < 1e-5 for k in range(12))


def test_weakly_linked_hosts_are_judged(spark):
    chain, link = ["b.com", "x1.net", "x2.net", "x3.net"], '<a href="//{}/">x</a>'
    rows = [(0, "http://b.com/de/", None)] + [(k, f"http://{chain[k]}/", link.format(chain[k - 1])) for k in (1, 2, 3)]
    rows += [(10 + k, f"http://y{k}.net/", link.format(chain[k]) * 2000) for k in range(3)]  # take nearly all distrust
    got = {r.page_id: r for r in host_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {r.verdict for r in got.values()} == {"block"} and got[3].distrust < 5e-10


def test_small_scores_converge(spark):
    names = [f"h{k}" for k in range(30)]
    edges = spark.createDataFrame([("k", a, b, 1.0) for a, b in zip(names, names[1:])] + [("k", "big", "big", 1.0)], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("k", "big", 1e9), ("k", "h0", 1.0)], "kind string, host string, weight double")
    got = {r.host: r.score * (1e9 + 1) for r in host_trust.spread(edges, seeds, Stages(spark, "t")).collect()}
    want = {h: 0.15 * 0.85**k for k, h in enumerate(names[:-1])} | {names[-1]: 0.85**29}
    assert all(abs(got.get(h, 0.0) - x) <= 2e-3 * x for h, x in want.items())


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "search", '{"query":"q","limit":2}'), (1, 1, "b", "search", '{"limit":2,"query":"$a"}'), (1, 2, "c", "translate", '{"text":"$b","to":"$a"}'),
        (1, 3, "d", "count", '{"text":"$e"}'), (1, 4, "e", "count", '{"text":"$d"}'), (1, 5, "f", "rank", "{}"), (1, 6, "g", "search", '{"query":1,"limit":2}'),
        (1, 7, "h", "search", "oops"), (1, 8, "i", "count", '{"text":"x","more":1}'), (1, 9, "a", "count", '{"text":"again"}'), (2, 0, "a", "count", '{"text":"$a"}'),
        (None, 0, "a", "count", "{}"), (3, 0, "z", "search", None), (1, 10, "j", "count", '{"words":true,"text":"$zz"}'),
    ]
    results = [(1, 1, "a", "ra"), (1, 2, "a", "later"), (1, 0, "b", "early"), (1, 3, "c", "rc"), (4, 0, "x", "lone")]
    got = tool_calls.link(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), tool_calls.TOOLS,
    )
    rows = {(r.conv_id, r.call_id): r for r in got.collect()}
    assert {k: r.status for k, r in rows.items()} == {
        (1, "a"): "ok", (1, "b"): "result_first", (1, "c"): "ok", (1, "d"): "circular", (1, "e"): "circular", (1, "f"): "unknown_tool", (1, "g"): "bad_arguments",
        (1, "h"): "bad_arguments", (1, "i"): "bad_arguments", (2, "a"): "circular", (3, "z"): "bad_arguments", (4, "x"): "orphan_result", (1, "j"): "no_result",
    }
    assert [rows[1, k].level for k in "abc"] == [0, 1, 2] and rows[1, "d"].level is None
    assert (rows[1, "a"].n_calls, rows[1, "a"].n_results) == (2, 2)
    assert rows[1, "g"].problem == "query is no string" and rows[1, "i"].problem == "unknown argument"
    assert json.loads(rows[1, "b"].message) == {"arguments": {"limit": 2, "query": "$a"}, "id": "b", "level": 1, "name": "search", "result": "early", "status": "result_first"}
    assert '{"arguments":{"limit":2,"query":"$a"},"id":"b",' in rows[1, "b"].message and json.loads(rows[1, "h"].message)["arguments"] == {"text": "oops"}
    placed = sorted((r.position, r.level, r.turn, r.call_id) for r in rows.values() if r.conv_id == 1 and r.position)
    assert [p[0] for p in placed] == list(range(1, len(placed) + 1)) and [p[1:] for p in placed] == sorted(p[1:] for p in placed)
    assert all((r.position is None) == (r.level is None) for r in rows.values())
    none = tool_calls.calls_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert tool_calls.link(*none, tool_calls.TOOLS).count() == 0


def plain_links(calls, results):
    """Status, level and position of every call of conversations, by brute force."""
    first, answers, out = {}, {}, {}
    for conv, turn, call, name, arguments in sorted(calls, key=lambda c: (c[1], c[3], c[4] or "")):
        first.setdefault((conv, call), (turn, name, arguments))
    for conv, turn, call, content in sorted(results, key=lambda r: (r[1], r[3])):
        answers.setdefault((conv, call), turn)
    tools = {t.name: t for t in tool_calls.TOOLS}
    kinds = {"string": str, "integer": int, "boolean": bool}

    def bad(name, arguments):
        try:
            value = json.loads(arguments)
        except ValueError:
            return True
        tool = tools[name]
        return not isinstance(value, dict) or bool(set(value) - set(tool.arguments)) or any(k not in value for k in tool.required) or any(
            k in value and type(value[k]) is not kinds[t] for k, t in tool.arguments.items())

    def level(key, behind):
        refs = {(key[0], r) for r in re.findall(r'"\$([^"\\]+)"', first[key][2] or "")} & set(first)
        if key in behind:
            return None
        below = [level(r, behind | {key}) for r in refs]
        return None if None in below else 1 + max(below, default=-1)

    for key, (turn, name, arguments) in first.items():
        at = level(key, frozenset())
        status = "unknown_tool" if name not in tools else "bad_arguments" if bad(name, arguments) else "circular" if at is None else (
            "no_result" if key not in answers else "result_first" if answers[key] <= turn else "ok")
        out[key] = [status, at, None]
    for conv in {c for c, _ in out}:
        order = sorted((at, first[conv, call][0], call) for (c, call), (_, at, _) in out.items() if c == conv and at is not None)
        for n, (_, _, call) in enumerate(order):
            out[conv, call][2] = n + 1
    return {k: tuple(v) for k, v in out.items()} | {k: ("orphan_result", None, None) for k in answers if k not in first}


def test_tool_calls_of_all_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    rows += [(900, t, "user", "again " * 30_000) for t in range(0, 40, 2)] + [(900, 1, "assistant", "x"), (900, 1, "assistant", "x"), (901, 0, "assistant", None), (901, 0, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash")).withColumn("name", F.lit(1))
    calls, results = tool_calls.calls_of(table)
    got = {(r.conv_id, r.call_id): (r.status, r.level, r.position) for r in tool_calls.link(calls.withColumn("position", F.lit(0)), results, tool_calls.TOOLS).collect()}
    assert got == plain_links([tuple(r) for r in calls.collect()], [(r[0], r[1], r[2], r[3] or "") for r in results.collect()])


def test_quality_features(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, text in texts_of(docs).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        times = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.kept and r.base_failed)


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).withColumnRenamed("quality", "p").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = rows.filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in rows}
    assert share[1] > 0.98 and share[0] < 0.1


def test_quality_odd(odd):
    got = quality.judge(odd).collect()
    assert len(got) == len(TEXTS) + 2 and not any(r.kept for r in got)
    assert max(r.n_repeat_words for r in got) == 30_000
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert quality.judge(odd.limit(0)).count() == 0


def test_token_files(spark, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    stages = Stages(spark, "t")
    token_files.write(odd, stages.path("a"), stages.path("b"))
    got = token_files.digests(spark, stages.path("a")).orderBy("start").collect()
    texts = sorted([(i, t) for i, t in enumerate(TEXTS)] + [(3, "one")], key=lambda x: x[0])
    start = 0
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    for r, (_, t) in zip(got, texts, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: len(r.ids) for r in token_files.read(spark, stages.path("a")).collect()} == {r.doc_id: r.n_tokens for r in got}
    token_files.write(odd.limit(0), stages.path("c"), stages.path("d"))
    assert token_files.digests(spark, stages.path("c")).count() == 0


def test_variable_length_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(ranks), n) == ranks).all()


def test_words_get_the_tokens_of_their_text():
    path = public_tokenizers.path(token_files.TOKENIZER)
    tokenizer, mine = Tokenizer.from_file(path), token_files._Encoder(path)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abAB .,'sSΣσéÉ́0<|>endoftext\n\x1c!İ"), int(n))) for n in rng.integers(0, 40, 500)] + ["A<|ENDOFTEXT|>.b", "x<|endoftext|>."]
    assert [list(x) for x in mine.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_latin_words_are_handed_over_as_they_stand():
    """Letters of Latin-1 need no normalising; others, marks and upper case go the long way. Words known already are not learnt again."""
    path = public_tokenizers.path(token_files.TOKENIZER)
    tokenizer, mine = Tokenizer.from_file(path), token_files._Encoder(path)
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xBF, 0x100), 0x101, 0x130, 0x301, 0x1C5]]
    texts = [" ".join("".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(60)) + " rechçà große naïve ÷ é÷é" for _ in range(40)]
    for _ in range(2):
        assert [list(x) for x in mine.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    handed = []
    mine = token_files._Encoder(path)
    whole, mine.tokenizer = mine.tokenizer, type("Spy", (), {"model": mine.tokenizer.model, "encode_batch_fast": lambda _, words, **k: handed.extend(words) or whole.encode_batch_fast(words, **k)})()
    mine.encode(["rechçà große naïve plain Été", " é÷é "])
    assert sorted(handed) == sorted(["É".lower().upper() + "té", "é÷é"])


@pytest.mark.parametrize("block", [512, 3])
def test_caps(spark, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((5, 16))
    rows = [(k, [float(x) for x in (base[k % 5] + 0.15 * rng.standard_normal(16) * (k % 3 > 0)).astype(np.float32)]) for k in range(60)]
    dead = [(100, None), (101, [0.0] * 16), (102, [1.0, None] + [0.0] * 14), (103, [float("nan")] * 16), (104, [])]
    more = [(None, rows[0][1]), (5, rows[0][1]), (200, [1.0] * 3), (201, [2.0] * 3)]
    got = caps.near_duplicates(spark.createDataFrame(rows + dead + more, "vec_id long, embedding array<float>"), block=block).collect()
    live = [(i, np.array(v, dtype=float) / np.linalg.norm(v)) for i, v in rows + more]
    want = [(i, int(sum(m != k and len(v) == len(w) and v @ w >= 0.9 for m, (_, w) in enumerate(live)))) for k, (i, v) in enumerate(live)]
    assert sorted(map(str, ((r.vec_id, r.n_links) for r in got if r.vec_id not in dict(dead)))) == sorted(map(str, want))
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id in dict(dead)) and len(got) == 69
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [10**6, 2 * 10**7, 10**8])
def test_code_finds_pairs_whatever_the_number_of_vectors(n):
    code, rng = caps.choose_code(n, 64), np.random.default_rng(8)
    a, b = rng.standard_normal((2, 200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    shared = np.array([np.intersect1d(*caps.filters(np.array(pair), code)).size for pair in zip(a, b, strict=True)])
    assert (shared > 0).mean() >= 0.97 and 20 < shared.mean() < 60


def test_line_dedup(spark, odd):
    pages = [(i, f"top line\nunique {i}\n\nbottom", "h") for i in range(8)] + [(20 + i, f"only {i}\ntop line", "g") for i in range(4)] + [(30, None, None)]
    got = {r.doc_id: r for r in boilerplate.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, text string, source string")).collect()}
    assert got[3].text == "unique 3\n" and got[3].n_dropped == 2 and got[21].text == "only 1" and got[30].text is None  # four pages are enough
    copies = [(i, "copied\npage", "h") for i in range(50)]
    kept = boilerplate.drop_boilerplate(spark.createDataFrame(copies, "doc_id long, text string, source string")).collect()
    assert {r.text for r in kept} == {"copied\npage"}
    out = boilerplate.drop_boilerplate(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count()
    assert boilerplate.drop_boilerplate(odd.limit(0)).count() == 0


def test_pii(spark, odd):
    text = "a@b.c_d@e.fr x 1.2.3.4 300.1.1.1 card 4111 1111 1111 1111 +1 (202) 555-0100. IBAN DE89370400440532013000 call 202-555-0199 é\U0001d518 z@y.zz"
    found = pii.find(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, pii_ip int"))
    got = {k.name: [text[s.start : s.end] for s in found.first()[f"pii_{k.name}"]] for k in pii.BASE + pii.MORE}
    assert got == {
        "email": ["a@b.c", "_d@e.fr", "z@y.zz"], "ip": ["1.2.3.4"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (202) 555-0100"],
        "iban": ["DE89370400440532013000"], "short_card": [], "local_phone": ["202-555-0199"],
    }
    assert pii.mask(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text.startswith("<email><email> x <ip> 300.1.1.1 card <card> <phone>.")
    many = spark.createDataFrame([(1, "1 " * 40_000), (2, "a" * 100_000 + "@"), (3, "+1" + "." * 50_000)], "doc_id long, text string")
    assert pii.find(many).select(*[F.size(f"pii_{k.name}").alias(k.name) for k in pii.BASE]).groupBy().sum().first() == (0, 0, 0, 0)
    assert pii.find(odd).count() == odd.count() and pii.mask(odd).columns == odd.columns


def plain_added_spans(text):
    """Added kinds by brute force: (kind, start, end, score)."""
    out = []
    for kind in pii.MORE:
        for m in re.finditer(kind.pattern, text or ""):
            digits = re.sub("[^0-9]+", "", m[0])
            if kind.name == "iban":
                moved = m[0].replace(" ", "")[4:] + m[0].replace(" ", "")[:4]
                valid = int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
            elif kind.name == "short_card":
                doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
                valid = 13 <= len(digits) <= 15 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
            else:
                valid = True
            before = text[max(0, m.start() - pii.CONTEXT) : m.start()].lower()
            score = kind.score + pii.NEAR * bool(re.search(kind.words, before)) - pii.AWAY * bool(re.search(kind.against, before))
            score = round(min(1.0, max(0.0, score)), 3)
            if valid and score >= pii.THRESHOLD:
                out.append((kind.name, m.start(), m.end(), score))
    return out


def test_added_kinds_and_scores(spark, docs):
    iban, card, phone = "DE89370400440532013000", "3782 822463 10005", "202-555-0199"
    crafted = [f"{w} {x}" for w in ("", "iban", "our account is", "example", "example iban", "card", "card order", "phone", "invoice", "call " + "x" * 50) for x in (iban, card, phone)]
    texts = [t for t in texts_of(docs).values() if t] + crafted + [f"call {phone} or {phone}, card {card}; {iban} " * 5, "1" * 5000, None]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for k in pii.MORE for s in r[f"pii_{k.name}"]] for r in rows}
    assert got == {i: plain_added_spans(t) for i, t in enumerate(texts)}
    scores = {(s[0], s[3]) for spans in got.values() for s in spans}
    assert {("iban", 0.6), ("iban", 1.0), ("short_card", 0.7), ("local_phone", 0.7)} <= scores
    assert all(s.score == 1.0 for r in rows for k in pii.BASE for s in r[f"pii_{k.name}"])


def test_pii_account_number_before_capitals_and_digits(spark):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"]
    tails = [" BIC COBADEFFXXX", " BY MAY", " 2024", ". X", ""]
    texts = [f"IBAN {n}{t}" for n in numbers for t in tails] + ["NO12 DE89370400440532013000 A", "DE89370400440532013001 BIC", "DE89370400440532013000X"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.pii_iban] for r in found}
    assert got == dict(enumerate([[n] for n in numbers for _ in tails] + [["DE89370400440532013000"], [], []]))


def test_pieces_agree_with_their_library():
    path = public_tokenizers.path(pieces.MODEL)
    model, library = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh  \n.,!éü▁01中)\"-"), int(n))) for n in rng.integers(0, 60, 1500)] + [t for t in TEXTS if t]
    texts += [" " * 40 + "q", "the" * 50, "...,,.", "\x00"]
    got = model.encode(texts)
    assert [list(x) for x in got] == [library.encode(t) for t in texts]
    assert [model.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_pieces_odd(odd):
    got = pieces.decode(pieces.encode(odd, out="rate"), ids="rate", out="back").collect()
    assert len(got) == len(TEXTS) + 2 and all(r.back == (r.text or "").replace("▁", " ") for r in got)
    assert pieces.encode(odd.limit(0)).count() == 0


def test_mixing(spark, docs, odd):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rates = mixing.rates(docs, catalog.domains(spark, sf), mixing.TARGETS)
    sums = rates.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[k]) / F.sum("n_tokens") for k in range(3)]).first()
    assert all(abs(got - want) < 0.01 for got, want in zip(sums, (0.99, 0.0, 0.01), strict=True))
    toxic = rates.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic").agg(F.avg(F.col("posterior")[2])).collect()
    assert dict(map(tuple, toxic))[1] > 0.8 > 0.1 > dict(map(tuple, toxic))[0]
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix(odd, none, {"a": 0.5, "b": 0.5})
    assert got.columns == odd.columns and got.count() == odd.count()
    assert mixing.rates(odd.limit(0), none, {"a": 1.0}).count() == 0


def test_mixing_meets_targets_after_the_stages_before(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    docs = Stages(spark, "t").write(docs, "fourth")
    rates = mixing.rates(docs, catalog.domains(spark, sf), mixing.TARGETS)
    sums = rates.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[k]) / F.sum("n_tokens") for k in range(3)]).first()
    assert all(abs(got - want) <= slack for got, want, slack in zip(sums, (0.99, 0.0, 0.01), (0.011, 0.0022, 0.00011), strict=True))


def plain_rates(posteriors, steps):
    rate = np.ones(len(posteriors))
    for step in steps:
        rate = np.maximum(0, rate - np.array(posteriors) @ np.array(step))
    return rate


@pytest.mark.parametrize("seed", range(3))
def test_mixing_meets_targets_that_long_plain_descent_meets(spark, seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(size=(400, 3)) * 3 + np.array([2.0, -1.0, -2.0])
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    n = rng.integers(1, 500, 400)
    goal = np.array([[0.8, 0.05, 0.15], [0.97, 0.02, 0.01], [0.3, 0.3, 0.4]][seed])
    steps = mixing.fit_steps(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posterior array<double>"), goal.tolist())
    rate = plain_rates(p, steps)
    shares = (n * rate) @ p / n.sum()
    assert (rate >= 0).all() and (np.abs(shares - goal) <= 1e-3 * goal).all()
    plain = np.ones(400)  # least squares by many short steps, without a metric
    for _ in range(200_000):
        plain = np.maximum(0, plain - 0.9 * p @ ((n * plain) @ p / n.sum() - goal))
    assert (np.abs((n * plain) @ p / n.sum() - goal) <= 1e-3 * goal).all()
    assert (n * (rate - 1) ** 2).sum() <= 1.5 * (n * (plain - 1) ** 2).sum()  # and it does not change rates much more


def test_mixing_reports_targets_out_of_reach(spark):
    rows = [(10, [1.0, 0.0, 0.0]), (30, [0.4, 0.6, 0.0])]
    with pytest.warns(UserWarning, match="cannot be met"):
        steps = mixing.fit_steps(spark.createDataFrame(rows, "n_tokens long, posterior array<double>"), [0.5, 0.3, 0.2])
    rate = plain_rates([p for _, p in rows], steps)
    shares = [sum(n * r * p[k] for r, (n, p) in zip(rate, rows, strict=True)) / 40 for k in range(2)]
    assert abs(shares[0] - 0.5) < 0.0055 and abs(shares[1] - 0.3) < 0.0033


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    ok, note = oracle.compare(spark, oracle.connect(SF), SF, name, catalog.QUERIES[name], catalog.SQL[name])
    assert ok, note


def test_pipeline(spark):
    got = entry.queries()["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    rows = got.collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert rows and all(r.token_ids == library.encode(r.text) for r in rows)
    prints = {r.doc_id: plain_print(r.text) for r in rows}
    assert all((prints[a] ^ prints[b]).bit_count() > 3 for a in prints for b in prints if a < b)


def test_columns_with_names_that_operators_use_stay(spark):
    names = ["_text", "_spans", "_text_key", "_host", "_drop", "_kept", "n_lines", "n_dropped", "_row", "rate", "copies", "domain", "hash", "kept", "group"]
    syllables = ["ba", "de", "ki", "lo", "mu", "na", "po", "ri", "so", "tu"]
    word = lambda n: "".join(syllables[int(d)] for d in str(100 + n))
    body = lambda i: ".\n".join(" ".join(word(90 * i + 9 * k + j) for j in range(9)) for k in range(8))
    texts = ["menu | home\n" + body(i) + f" mail to a{i}@b.org now." for i in range(5)] + [None, "", "menu | home\n" + "long " * 20_000]
    rows = [(i % 7, t, "en", "s", 1, *[f"{n}-{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    none = spark.createDataFrame([], "doc_id long, domain string")
    results = [
        pii.find(docs), pii.mask(docs), near_copies.drop_near_duplicates(docs), boilerplate.drop_boilerplate(docs, counts=False),
        quality.keep_good(docs), mixing.mix(docs, none, {"a": 1.0}),
    ]
    for got in results:
        assert got.columns[: len(docs.columns)] == docs.columns
        kept = got.collect()
        assert kept and all(r[n] == f"{n}-{r._row.split('-')[1]}" for r in kept for n in names)
    assert not any("menu" in (r.text or "") for r in results[3].collect())
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == results[0].columns[: len(docs.columns)] and stage(spark, docs.limit(0), SF).count() == 0
