"""Neighbour similarity without emitting all pairs of a group.

The neighbour sets stay in long form (ip, peer). Devices with equal sets are handled
once with a multiplicity; peers that very many devices share are handled by counts of
classes; only rare peers are joined to find pairs. Where many different sets share a peer,
blocks of sets meet, and a pair of blocks gives sums or a spanning forest instead of its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import connected_components, stage

#: Sets in a block, and the peers that they have in all.
BLOCK = 1024
BLOCK_PEERS = 1 << 19


def neighbor_sets(conns: DataFrame) -> DataFrame:
    """Distinct (ip, peer), both directions."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip"), F.col("dst_ip").alias("peer")),
            F.struct(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("peer")),
        )
    )
    return conns.select("src_ip", "dst_ip").distinct().select(ends.alias("e")).select("e.*").distinct()


def jaccard_similarity(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of given pairs (a, b); two devices without peers count as equal."""
    degree = sets.groupBy("ip").agg(F.count("*").alias("n"))
    shared = (
        pairs.select("a", "b").distinct()
        .join(sets.select(F.col("ip").alias("a"), "peer"), "a")
        .join(sets.select(F.col("ip").alias("b"), "peer"), ["b", "peer"])
        .groupBy("a", "b").agg(F.count("*").alias("common"))
    )
    rows = (
        pairs.select("a", "b").distinct().join(shared, ["a", "b"], "left")
        .join(degree.select(F.col("ip").alias("a"), F.col("n").alias("na")), "a", "left")
        .join(degree.select(F.col("ip").alias("b"), F.col("n").alias("nb")), "b", "left")
        .na.fill(0, ["common", "na", "nb"])
    )
    union = F.col("na") + F.col("nb") - F.col("common")
    return rows.select("a", "b", F.when(union == 0, 1.0).otherwise(F.col("common") / union).alias("similarity"))


def _signatures(sets: DataFrame) -> DataFrame:
    """Order-free fingerprint of each neighbour set: ip, sig, n."""
    return sets.groupBy("ip").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("peer")).alias("_x"),
        F.sum(F.xxhash64(F.lit("s"), "peer").cast("decimal(20,0)")).alias("_s"),
    ).select("ip", "n", F.concat_ws("/", "n", "_x", "_s").alias("sig"))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of values that each set of ``a`` has in common with each of ``b``.

    A value that many sets of both sides hold is a column of two matrices that are multiplied;
    the pairs of sets that share any other value are counted one by one.
    """
    out = np.zeros(len(a) * len(b))
    va, vb = (np.concatenate([np.asarray(s, dtype=np.int64) for s in x] or [np.zeros(0, dtype=np.int64)]) for x in (a, b))
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    both = np.intersect1d(va, vb)
    ca, cb = (np.searchsorted(both, v) for v in (va, vb))
    ina, inb = (np.isin(v, both) for v in (va, vb))
    ra, ca, rb, cb = ra[ina], ca[ina], rb[inb], cb[inb]
    fa, fb = (np.bincount(c, minlength=len(both)) for c in (ca, cb))
    dense = 30 * fa * fb > out.size
    place = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 4096):
        sides = []
        for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            mine = dense[c] & (place[c] >= at) & (place[c] < at + 4096)
            table = np.zeros((n, min(4096, int(dense.sum()) - at)), dtype=np.float32)
            table[r[mine], place[c[mine]] - at] = 1
            sides.append(table)
        out += (sides[0] @ sides[1].T).ravel()
    ra, ca = ra[~dense[ca]], ca[~dense[ca]]
    order = np.argsort(cb, kind="stable")
    rb, starts = rb[order], np.cumsum(fb) - fb
    ends = np.cumsum(fb[ca])
    for at in range(0, int(ends[-1]) if len(ends) else 0, 1 << 22):
        # pairs number ``at`` and on: the token of ``a`` whose turn it is, and its partner's number
        pair = np.arange(at, min(at + (1 << 22), int(ends[-1])))
        token = np.searchsorted(ends, pair, side="right")
        partner = starts[ca[token]] + pair - (ends[token] - fb[ca[token]])
        out += np.bincount(ra[token] * len(b) + rb[partner], minlength=out.size)
    return out.reshape(len(a), len(b))


def jaccard_values(a: pd.DataFrame, b: pd.DataFrame, column: str) -> np.ndarray:
    """Jaccard similarity of each set of ``a`` and of ``b``, from their sizes ``n`` and peers; two empty ones are equal."""
    common = common_counts(a[column].tolist(), b[column].tolist())
    union = a["n"].to_numpy(dtype=float)[:, None] + b["n"].to_numpy(dtype=float)[None, :] - common
    return np.where(union == 0, 1.0, common / np.where(union == 0, 1.0, union))


def _sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Weighted sums of similarity and numbers of pairs for the parts that meet in a pair of blocks."""
    a, b = rows[rows["block"] == rows["i"]], rows[rows["block"] == rows["j"]]
    (of_a, parts_a), (of_b, parts_b) = (pd.factorize(x["part"]) for x in (a, b))
    ma, mb = a["m"].to_numpy(dtype=np.int64), b["m"].to_numpy(dtype=np.int64)
    by_a, by_b = np.zeros((len(parts_a), len(a))), np.zeros((len(b), len(parts_b)))
    by_a[of_a, np.arange(len(a))], by_b[np.arange(len(b)), of_b] = ma, mb
    total = by_a @ jaccard_values(a, b, "h") @ by_b
    na, nb = (np.array([int(m[of == k].sum()) for k in range(len(parts))], dtype=object) for m, of, parts in ((ma, of_a, parts_a), (mb, of_b, parts_b)))
    once = rows["i"].iloc[0] == rows["j"].iloc[0]  # a block by itself has each pair of parts in both orders
    found = [
        (rows["grp"].iloc[0], min(p, q), max(p, q), float(total[x, y]), int(na[x] * nb[y]))
        for x, p in enumerate(parts_a) for y, q in enumerate(parts_b) if p < q or (p > q and not once)
    ]
    return pd.DataFrame(found, columns=["grp", "part_a", "part_b", "total", "pairs"])


def _class_sums(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sums over pairs of classes (grp, part, n, h, m) of two parts: grp, part_a, part_b, total, pairs, in several rows.

    Classes of a group are dealt to blocks, those of a large part to blocks of its own, and each
    pair of blocks that may hold two parts is one task's work, so a group is never in one place.
    """
    peers = F.size("h")
    sizes = classes.filter("grp IS NOT NULL AND part IS NOT NULL").groupBy("grp", "part").agg(F.count("*").alias("c"), F.sum(peers).alias("t"))
    need = F.ceil(F.greatest(F.col("c") / block, F.col("t") / BLOCK_PEERS)).cast("bigint")
    sizes = sizes.withColumn("own", need).withColumn("large", F.greatest(F.col("c") / block, F.col("t") / BLOCK_PEERS) > 0.5)
    bins = sizes.filter("NOT large").groupBy("grp").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).select("grp", need.alias("bins"))
    sizes = stage(sizes.join(bins, "grp", "left").select("grp", "part", "own", "large", "bins"), "parts")
    name = F.when(F.col("large"), F.concat_ws("/", F.lit("p"), "k", "part")).otherwise(
        F.concat_ws("/", F.lit("b"), F.pmod(F.xxhash64("part"), F.col("bins")))
    )
    blocks = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("large"), F.col("own") - 1).otherwise(0))))
    blocks = blocks.select("grp", name.alias("block"), F.when(F.col("large"), F.col("part")).alias("only")).distinct()
    i = blocks.select("grp", F.col("block").alias("i"), F.col("only").alias("_i"))
    j = blocks.select("grp", F.col("block").alias("j"), F.col("only").alias("_j"))
    met = i.join(j, "grp").filter("i <= j AND NOT coalesce(_i = _j, false)").select("grp", "i", "j")
    ends = met.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    k = F.when(F.col("large"), F.pmod(F.xxhash64("n", "h"), F.col("own"))).otherwise(0)
    dealt = classes.join(sizes, ["grp", "part"]).withColumn("k", k).select("grp", name.alias("block"), "part", "n", "h", "m")
    kinds = dict(classes.dtypes)
    return dealt.join(ends, ["grp", "block"]).groupBy("grp", "i", "j").applyInPandas(
        _sums, f"grp {kinds['grp']}, part_a {kinds['part']}, part_b {kinds['part']}, total double, pairs bigint"
    )


def average_group_similarity(groups: DataFrame, sets: DataFrame, hot: int = 200, block: int = BLOCK) -> DataFrame:
    """Mean Jaccard over all pairs of members of two parts of a group, exactly.

    ``groups``: grp, part, ip. Returns grp, part_a, part_b (a < b), similarity.

    Peers that more than ``hot`` members of a group share are *hot*. Two members that
    share no other peer have a similarity that depends only on their hot peers and set
    sizes, so such members fall into few classes and the sum runs over class pairs with
    multiplicities, block by block (``block`` only says how large those are). Members that share
    a rare peer are found by joining on it, at most ``hot`` per peer, and replace the class value
    by the true one.
    """
    members = groups.join(_signatures(sets), "ip", "left").select(
        "grp", "part", "ip", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("sig", F.lit("-")).alias("sig")
    )
    sized = stage(
        members.groupBy("grp", "part", "sig", "n").agg(F.count("*").alias("m"), F.min("ip").alias("ip")), "signatures"
    )
    tokens = sized.join(sets, "ip").select("grp", "part", "sig", "n", "m", "peer")
    weight = tokens.groupBy("grp", "peer").agg(F.sum("m").alias("_w"))
    tokens = stage(
        tokens.join(weight, ["grp", "peer"]).withColumn("hot", F.col("_w") > hot).drop("_w"), "tokens"
    )
    hot_part = (
        tokens.filter("hot").groupBy("grp", "part", "sig")
        .agg(F.array_sort(F.collect_set(F.xxhash64("peer"))).alias("h"))
    )
    empty = F.array().cast("array<bigint>")
    full = sized.drop("ip").join(hot_part, ["grp", "part", "sig"], "left").withColumn("h", F.coalesce("h", empty))
    classes = full.groupBy("grp", "part", "n", "h").agg(F.sum("m").alias("m"))

    def side(table: DataFrame, tag: str, *keys: str) -> DataFrame:
        return table.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in table.columns if c not in keys])

    def value(common):
        union = F.col("n_a") + F.col("n_b") - common
        return F.when(union == 0, 1.0).otherwise(common / union)

    hot_common = F.size(F.array_intersect("h_a", "h_b"))
    base = _class_sums(stage(classes, "classes"), block).groupBy("grp", "part_a", "part_b").agg(
        F.sum("total").alias("total"), F.sum("pairs").alias("pairs")
    )
    rare = tokens.filter("NOT hot").select("grp", "peer", "part", "sig")
    shared = (
        side(rare, "a", "grp", "peer").join(side(rare, "b", "grp", "peer"), ["grp", "peer"])
        .filter("part_a < part_b")
        .groupBy("grp", "part_a", "sig_a", "part_b", "sig_b").agg(F.count("*").alias("rare_common"))
    )
    fixed = (
        shared.join(side(full, "a", "grp"), ["grp", "part_a", "sig_a"])
        .join(side(full, "b", "grp"), ["grp", "part_b", "sig_b"])
        .groupBy("grp", "part_a", "part_b")
        .agg(F.sum(F.col("m_a") * F.col("m_b") * (value(hot_common + F.col("rare_common")) - value(hot_common)))
             .alias("extra"))
    )
    return base.join(fixed, ["grp", "part_a", "part_b"], "left").select(
        "grp", "part_a", "part_b",
        ((F.col("total") + F.coalesce("extra", F.lit(0.0))) / F.col("pairs")).alias("similarity"),
    )


#: Modulus of the sketch's hash functions, a prime, so that any two peers swap ranks as often as not.
SKETCH_PRIME = (1 << 31) - 1


def sketch_factors(hashes: int) -> list[tuple[int, int]]:
    """Factor and offset of each hash function, by a rule any engine can follow."""
    return [(1 + (i * i * 40503 + i * 2654435) % (SKETCH_PRIME - 1), (i * 1640531527 + 12345) % SKETCH_PRIME) for i in range(1, hashes + 1)]


def minhash_sketch(sets: DataFrame, hashes: int) -> DataFrame:
    """Smallest hash of each member's peers for every hash function: ip, i, v.

    Two members have the same v with a probability equal to their Jaccard similarity. The
    smallest is taken before the shuffle, so a device with very many peers is no large group.
    """
    number = F.conv(F.substring(F.md5("peer"), 1, 7), 16, 10).cast("bigint")
    functions = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in sketch_factors(hashes)])
    hashed = sets.select("ip", number.alias("x")).select(
        "ip", F.posexplode(F.transform(functions, lambda f: (f["a"] * F.col("x") + f["b"]) % SKETCH_PRIME)).alias("i", "h")
    )
    return hashed.groupBy("ip", "i").agg(F.min("h").alias("v"))


def sketched_group_similarity(groups: DataFrame, sets: DataFrame, hashes: int = 256) -> DataFrame:
    """Mean Jaccard over all pairs of members of two parts of a group, estimated without pairs.

    ``groups``: grp, part, ip. Returns grp, part_a, part_b (a < b), similarity. For one hash
    function the share of pairs with equal smallest hash is the sum over hash values of the
    members of one part times those of the other; its mean over the functions estimates the
    mean similarity with a standard error of at most 0.5 / sqrt(hashes). The work is linear in
    the members: ``hashes`` rows each, however large their group. Members without peers are
    alike among themselves and unlike all others. Parts of a group meet in the result only.
    """
    values = groups.select("grp", "part", "ip").join(minhash_sketch(sets, hashes), "ip", "left")
    every = F.sequence(F.lit(0), F.lit(hashes - 1))
    values = values.withColumn("i", F.explode(F.when(F.col("i").isNull(), every).otherwise(F.array("i"))))
    counted = stage(values.groupBy("grp", "i", F.coalesce("v", F.lit(-1)).alias("v"), "part").agg(F.count("*").alias("m")), "sketches")
    size = groups.groupBy("grp", "part").agg(F.countDistinct("ip").alias("m"))

    def meet(table: DataFrame, *keys: str) -> DataFrame:
        a = table.select(*keys, F.col("part").alias("part_a"), F.col("m").alias("m_a"))
        b = table.select(*keys, F.col("part").alias("part_b"), F.col("m").alias("m_b"))
        return a.join(b, list(keys)).filter("part_a < part_b")

    both = meet(counted, "grp", "i", "v").groupBy("grp", "part_a", "part_b").agg(F.sum(F.col("m_a") * F.col("m_b")).alias("equal"))
    return meet(size, "grp").join(both, ["grp", "part_a", "part_b"], "left").select(
        "grp", "part_a", "part_b", (F.coalesce("equal", F.lit(0)) / (F.col("m_a") * F.col("m_b") * hashes)).alias("similarity")
    )


def similar_pairs(ips: DataFrame, sets: DataFrame, min_sim: float = 0.6, crowd: int = 1000) -> DataFrame:
    """Pairs of distinct neighbour sets with similarity above ``min_sim``: (a, b) by the
    smallest address of each set, and their similarity."""
    candidates = candidate_pairs(ips, sets, min_sim, crowd)
    return jaccard_similarity(sets, candidates).filter(F.col("similarity") > min_sim)


def candidate_pairs(ips: DataFrame, sets: DataFrame, min_sim: float = 0.6, crowd: int = 1000) -> DataFrame:
    """Pairs (a, b) among which all pairs of distinct sets more similar than ``min_sim`` are.

    Devices with equal sets are one set. Two sets can only be that similar if they share one of
    their rarest peers (prefix filter), their sizes lie within that ratio, and enough peers of each
    are no rarer than the first one they share (position filter). Sizes are cut in bands of that
    ratio, which the join matches on, and the other two are conditions of the join, so that sets
    that cannot be alike never become rows. A peer in more than ``crowd`` prefixes of a band deals
    its sets over salts on one side and copies those of the other side to all salts, so that none of
    its groups is large. Callers verify what is left on the full sets.
    """
    prefix = _prefixes(ips, sets, min_sim)
    return _meet(prefix, prefix, min_sim, crowd)


def _prefixes(ips: DataFrame, sets: DataFrame, min_sim: float) -> DataFrame:
    """Rarest peers of each distinct set by which it can be found: ip, n, peer, rest, band."""
    from pyspark.sql.window import Window

    sig = _signatures(sets.join(ips.select("ip"), "ip", "left_semi"))
    lead = stage(sig.groupBy("sig", "n").agg(F.min("ip").alias("ip")), "leads")
    tokens = lead.join(sets, "ip").select("ip", "n", "peer")
    freq = tokens.groupBy("peer").agg(F.count("*").alias("f"))
    tokens = stage(tokens.join(freq, "peer"), "prefix")

    # Peers of a set in order of rarity, by frequency class rather than one by one.
    per_class = tokens.groupBy("ip", "n", "f").agg(F.count("*").alias("c"))
    before = Window.partitionBy("ip").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("n") - F.ceil(F.col("n") * F.lit(min_sim)) + 1
    chosen = (
        per_class.withColumn("b", F.coalesce(F.sum("c").over(before), F.lit(0))).filter(F.col("b") < length)
        .select("ip", "f", "b")
    )
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / min_sim)))
    # ``rest``: peers of the set from this frequency class on, all that two sets whose rarest common peer it is can share
    prefix = tokens.join(chosen, ["ip", "f"]).select("ip", "n", "peer", (F.col("n") - F.col("b")).alias("rest"), band.alias("band"))
    return stage(prefix, "prefixes")


def _meet(first: DataFrame, second: DataFrame, min_sim: float, crowd: int) -> DataFrame:
    """Candidate pairs of sets whose prefix rows are in ``first`` with those in ``second`` of their own band or the one above."""
    crowds = first.groupBy("peer", "band").agg(F.ceil(F.count("*") / crowd).cast("int").alias("salts"))
    first = stage(first.join(crowds, ["peer", "band"]), "dealt")
    # a set meets those of its own band, of which it is the larger address, and all of the band below
    met = crowds.select(F.col("peer").alias("pb"), F.col("band").alias("bb"), F.col("salts").alias("copies"))
    b = second.select(
        F.col("ip").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("peer").alias("pb"), F.col("band").alias("own"),
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("bb"),
    )
    b = b.join(met, ["pb", "bb"]).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    a = first.select(
        F.col("ip").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("peer").alias("pa"), F.col("band").alias("ba"),
        F.pmod(F.xxhash64("ip"), F.col("salts")).cast("int").alias("sa"),
    )
    return a.join(b, F.expr(
        "pa = pb AND ba = bb AND sa = sb AND (own > ba OR a < b) "
        f"AND least(na, nb) > {min_sim}D * greatest(na, nb) AND least(ra, rb) * {1 + min_sim}D > {min_sim}D * (na + nb) - 1e-9D"
    )).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the graph that a matrix of links between rows and columns makes."""
    edges, rows, columns = [], np.ones(near.shape[0], dtype=bool), np.ones(near.shape[1], dtype=bool)
    turned = np.ascontiguousarray(near.T)
    for start in range(len(rows)):
        if not rows[start]:
            continue
        rows[start], todo = False, [(start, True)]
        while todo:
            at, is_row = todo.pop()
            left = columns if is_row else rows
            found = np.flatnonzero((near if is_row else turned)[at] & left)
            left[found] = False
            edges += [(at, int(k)) if is_row else (int(k), at) for k in found]
            todo += [(int(k), not is_row) for k in found]
    return edges


def _link_blocks(min_sim: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["block"] == rows["i"]], rows[rows["block"] == rows["j"]]
        edges = np.array(_forest(jaccard_values(a, b, "peers") > min_sim), dtype=np.int64).reshape(-1, 2)
        found = pd.DataFrame({"a": a["ip"].to_numpy()[edges[:, 0]], "b": b["ip"].to_numpy()[edges[:, 1]]})
        return found[found["a"] != found["b"]]

    return run


def similar_links(ips: DataFrame, sets: DataFrame, min_sim: float = 0.6, crowd: int = 100, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct sets more similar than ``min_sim``, enough of them that all such pairs are linked by chains.

    Peers in the prefixes of up to ``crowd`` sets of a band and the one above give their pairs, which
    are verified. The sets that meet under other peers are dealt to blocks, by their rarest such peer
    as far as those are small, and blocks that meet under some peer are compared on the full sets.
    Such a pair of blocks gives a spanning forest of its links, so fewer rows than it has sets.
    """
    prefix = _prefixes(ips, sets, min_sim)
    met = prefix.withColumn("bb", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    full = stage(met.groupBy("peer", "bb").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("peer", "bb"), "crowds")
    apart = prefix.join(full.withColumnRenamed("bb", "band"), ["peer", "band"], "left_anti")
    candidates = _meet(apart, prefix, min_sim, crowd)
    links = jaccard_similarity(sets, candidates).filter(F.col("similarity") > min_sim).select("a", "b")
    if full.isEmpty():
        return links
    inside = stage(met.join(full, ["peer", "bb"]), "crowded")
    need = F.ceil(F.greatest(F.col("c") / block, F.col("t") / BLOCK_PEERS)).cast("bigint")
    placed = inside.groupBy("ip", "n", "band").agg(F.max_by("peer", F.struct("rest", "peer")).alias("lead"))
    per_lead = placed.groupBy("band", "lead").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    bins = per_lead.groupBy("band").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).select("band", need.alias("bins"))
    number = F.pmod(F.xxhash64("lead") + F.pmod(F.xxhash64("ip"), F.col("own")), F.col("bins"))
    placed = placed.join(per_lead.select("band", "lead", need.alias("own")), ["band", "lead"]).join(bins, "band")
    placed = stage(placed.select("ip", "n", "band", F.concat_ws("/", "band", number).alias("block")), "placed")
    seen = inside.select("ip", "peer", "bb").join(placed, "ip").select("peer", "bb", "band", "block").distinct()
    i = seen.filter("band = bb").select("peer", "bb", F.col("block").alias("i"))
    j = seen.select("peer", "bb", F.col("block").alias("j"), F.col("band").alias("_j"))
    pairs = stage(i.join(j, ["peer", "bb"]).filter("_j > bb OR i <= j").select("i", "j").distinct(), "block-pairs")
    ends = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    held = placed.join(sets.filter("peer IS NOT NULL"), "ip").groupBy("ip", "n", "block").agg(F.collect_list(F.xxhash64("peer")).alias("peers"))
    more = held.join(ends, "block").groupBy("i", "j").applyInPandas(_link_blocks(min_sim), "a string, b string")
    return links.unionByName(more)


def communities(ips: DataFrame, sets: DataFrame, min_sim: float = 0.6) -> DataFrame:
    """Community (smallest member) of each address in ``ips``.

    Components of the graph of pairs more similar than ``min_sim``; independent of any
    order. Addresses with equal neighbour sets are always together, and addresses
    without peers form one community.
    """
    known = ips.select("ip").distinct()
    sig = stage(known.join(_signatures(sets), "ip", "left").withColumn("sig", F.coalesce("sig", F.lit("-"))), "sig")
    lead = sig.groupBy("sig").agg(F.min("ip").alias("lead"))
    pairs = similar_links(known, sets, min_sim)
    parts = connected_components(lead.select(F.col("lead").alias("id")), pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return (
        sig.join(lead, "sig").join(parts, F.col("lead") == F.col("id"))
        .select("ip", F.col("component").alias("community"))
    )
