"""Prefix trie of conversations as balanced parentheses per shard.

A conversation becomes the row of its turns' digests, 16 bytes a turn, so that sorting these keys
sorts the trie depth first. Distinct keys are dealt to shards by range. A shard writes its part of
the trie as balanced parentheses; a range min-max tree over blocks of the excess finds the closing
parenthesis of each node, ranks of leaf pairs count leaves, and cumulative arrays in preorder give
members and savings of each subtree.

Only nodes on the first or the last path of a shard, its spines, can lie in other shards too. All
others are complete. Spine nodes are merged by their digest: what a shard knows about its complete
nodes is added up, then what the merged spine nodes hold themselves is passed up each path, every
node by one path only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stages

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
#: Turns of distinct conversations in one shard, about.
SHARD_TURNS = 1 << 18
#: Conversation numbers that one joined piece of ids may span.
ID_SPAN = 4096
SHARED = 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parens:
    """Balanced parentheses of a tree given by the depths of its nodes in preorder (root: 0)."""

    def __init__(self, depth: np.ndarray, block: int = 64):
        closes = np.concatenate([[0], depth[:-1] - depth[1:] + 1])
        self.open = np.arange(len(depth)) + np.cumsum(closes)
        self.bits = np.zeros(2 * len(depth), dtype=np.int8)
        self.bits[self.open] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int32) - 1, dtype=np.int32)
        self.block = block
        padded = np.full(-(-len(self.excess) // block) * block, np.iinfo(np.int32).max, dtype=np.int32)
        padded[: len(self.excess)] = self.excess
        self.cells = padded.reshape(-1, block)
        self.low = [self.cells.min(axis=1)]
        while len(self.low[-1]) > 1:
            last = self.low[-1]
            if len(last) % 2:
                last = self.low[-1] = np.append(last, np.iinfo(np.int32).max)
            self.low.append(np.minimum(last[::2], last[1::2]))

    def find_close(self, batch: int = 1 << 14) -> np.ndarray:
        """Position of the closing parenthesis of every node."""
        return np.concatenate([self._close(self.open[i : i + batch]) for i in range(0, len(self.open), batch)])

    def _close(self, at: np.ndarray) -> np.ndarray:
        target = self.excess[at] - 1
        node = at // self.block
        hit = (self.cells[node] <= target[:, None]) & (np.arange(self.block) > (at % self.block)[:, None])
        out = node * self.block + hit.argmax(axis=1)
        far = np.flatnonzero(~hit.any(axis=1))
        node, target = node[far], target[far]
        height = np.full(len(far), -1)
        for level, low in enumerate(self.low[:-1]):  # up, to the first later block range that goes low enough
            climbing = np.flatnonzero(height < 0)
            right = node[climbing] ^ 1
            there = (node[climbing] % 2 == 0) & (low[right] <= target[climbing])
            height[climbing[there]] = level
            node[climbing[there]] += 1
            node[climbing[~there]] //= 2
        for level in range(len(self.low) - 2, 0, -1):  # down to its first such block
            down = np.flatnonzero(height >= level)
            node[down] = 2 * node[down] + (self.low[level - 1][2 * node[down]] > target[down])
        out[far] = node * self.block + (self.cells[node] <= target[:, None]).argmax(axis=1)
        return out

    def leaf_ranks(self) -> np.ndarray:
        """Number of leaf pairs that open before each position."""
        pair = np.append((self.bits[:-1] == 1) & (self.bits[1:] == 0), False)
        return np.concatenate([[0], np.cumsum(pair)])


def _common(a: bytes, b: bytes) -> int:
    """Number of leading digests that two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // DIGEST


def _names(key: bytes) -> list[bytes]:
    """Digest of every prefix of a key, the empty one included."""
    h, out = hashlib.sha256(), []
    for at in range(0, len(key) + 1, DIGEST):
        out.append(h.digest())
        h.update(key[at : at + DIGEST])
    return out


_ROWS = (
    "shard int, path int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
_FIELDS = [f.split() for f in _ROWS.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])


def _rows(n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard: complete ones, and the occurrences of spine nodes on its two outer paths."""
    depth, parent, end_at = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], []
    words, count, lowest, digest = [np.zeros(1, dtype=np.int64)], [], [], []
    first = last = None
    stack, n = [0], 1
    for batch in batches:
        spent = batch["words"].flatten().to_numpy(zero_copy_only=False)
        at = 0
        for key in batch["key"].to_pylist():
            size = len(key) // DIGEST
            same = 0 if last is None else _common(last, key)
            new = np.arange(n, n + size - same)
            depth.append(np.arange(same + 1, size + 1))
            parent.append(np.concatenate([[stack[same]], new[:-1]]) if len(new) else new)
            words.append(spent[at + same : at + size])
            del stack[same + 1 :]
            stack += new.tolist()
            end_at.append(stack[-1])
            n += len(new)
            at += size
            first, last = key if first is None else first, key
        count += batch["n_ends"].to_pylist()
        lowest += batch["conv_id"].to_pylist()
        digest += batch["ends"].to_pylist()
    if last is None:
        return
    depth, parent, words = np.concatenate(depth), np.concatenate(parent), np.concatenate(words).astype(np.int64)
    end_at = np.array(end_at)
    ends, low, sha = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, None, dtype=object)
    ends[end_at], low[end_at], sha[end_at] = count, lowest, digest
    low = low.tolist()
    for node in range(n - 1, 0, -1):  # a parent comes before its children
        if low[node] < low[up := parent[node]]:
            low[up] = low[node]
    low = np.array(low)

    parens = Parens(depth)
    close, ranks = parens.find_close(), parens.leaf_ranks()
    until = np.arange(n) + (close - parens.open + 1) // 2
    members = np.concatenate([[0], np.cumsum(ends)])
    n_convs = members[until] - members[:-1]
    left, right = np.arange(len(first) // DIGEST + 1), np.array(stack)
    whole = np.ones(n, dtype=bool)
    whole[left] = whole[right] = False
    gain = np.concatenate([[0], np.cumsum(np.where(whole, (n_convs - 1) * words, 0))])
    saved = gain[until] - gain[:-1]
    n_all = np.bincount(parent[1:], minlength=n)
    spine_leaf = np.concatenate([[0], np.cumsum(~whole & (n_all == 0))])
    leaves = ranks[close] - ranks[parens.open] - (spine_leaf[until] - spine_leaf[:-1])
    kids = np.bincount(parent[1:][whole[1:]], minlength=n)

    shard = TaskContext.get().partitionId()
    names = dict(zip(left.tolist(), _names(first))) | dict(zip(right.tolist(), _names(last)))
    done = np.flatnonzero(whole)
    for at in range(0, len(done), 1 << 16):
        i = done[at : at + (1 << 16)]
        up = parent[i]
        yield _rows(
            len(i), shard=np.full(len(i), shard), conv_id=low[i], depth=depth[i], n_convs=n_convs[i], n_children=kids[i], n_leaves=leaves[i],
            parent_conv_id=pa.array(low[up], mask=~whole[up]), parent=[None if whole[p] else names[p] for p in up.tolist()],
            saved_tokens=saved[i], ends=[s or NO_ENDS for s in sha[i]],
        )
    for path, nodes, key in ((2 * shard, left, first), (2 * shard + 1, right, last)):
        if path % 2 and first == last:
            continue
        told = np.isin(nodes, left) if path % 2 else np.zeros(len(nodes), dtype=bool)  # by the left path
        some = lambda values: np.where(told, 0, values[nodes])
        chain = _names(key)
        yield _rows(
            len(nodes), shard=np.full(len(nodes), shard), path=np.full(len(nodes), path), node=chain, parent=[None, *chain[:-1]], depth=depth[nodes],
            conv_id=pa.array(low[nodes], mask=told), n_convs=some(n_convs), n_children=some(kids), n_leaves=some(leaves), saved_tokens=some(saved),
            words=words[nodes], ends=[None if t else s for t, s in zip(told, sha[nodes])],
        )


def _merged_spines(spines: DataFrame) -> DataFrame:
    """Spine nodes with the sums of all shards: node, parent and the columns of the result."""
    total = spines.groupBy("node").agg(
        F.min("path").alias("owner"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("ends").alias("ends"),
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    more = total.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    total = (
        total.join(more, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
        .withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("gain", (F.col("n_convs") - 1) * F.col("words"))
    )
    up = Window.partitionBy("path").orderBy(F.col("depth").desc())  # one path of one shard
    # a node's own share joins its owner's row only, so that the root, which is on every path, is no large group
    share = total.select("node", F.col("owner").alias("path"), "leaf", "gain")
    own = spines.select("path", "depth", "node").join(share, ["path", "node"], "left")
    passed = own.select("node", *[F.sum(F.coalesce(c, F.lit(0))).over(up).alias(c) for c in ("leaf", "gain")])
    passed = passed.groupBy("node").agg(F.sum("leaf").alias("more_leaves"), F.sum("gain").alias("more_saved"))
    total = total.join(passed, "node").withColumn("n_leaves", F.col("n_leaves") + F.col("more_leaves")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("more_saved"))
    above = total.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return total.join(above, "parent", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))


def paths(convs: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, key (digests of its turns in order) and words of each turn.

    Turns go by ``turn`` (null first), equal ones by digest. Texts stay where they are read: only
    digests are shuffled. A conversation's digests form one row, 20 bytes a turn, so a conversation
    may have some 50 million turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = convs.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    both = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return both.select("conv_id", key.alias("key"), F.col("turns.words").alias("words"))


def spliced(own: DataFrame, group: int = SHARED) -> DataFrame:
    """Paths whose first h turns come from the first conversation of their group of ``group`` numbers.

    h is the crc32 of the decimal number modulo 4; fewer or no such turns give fewer or none.
    """
    base = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.expr(f"substring(key, 1, {3 * DIGEST})").alias("head"), F.slice("words", 1, 3).alias("head_words")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(base, "base", "left")
    key = F.concat(F.coalesce(F.expr(f"substring(head, 1, {DIGEST} * h)"), F.lit(b"")), F.expr(f"substring(key, {DIGEST} * h + 1)"))
    words = F.concat(F.coalesce(F.expr("slice(head_words, 1, h)"), F.array().cast("array<int>")), F.expr("slice(words, h + 1, greatest(size(words), 1))"))
    return joined.select("conv_id", key.alias("key"), words.alias("words"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys with the hash of their members' numbers, from sorted pieces of them.

    SHA-256 runs over one key's numbers in order, so its pieces pass through one hasher, one at a time.
    """
    at = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if at is not None and at["name"] == row["name"]:
                at["sha"].update(b",")
                at["n_ends"] += row["n_ends"]
                at["conv_id"] = min(at["conv_id"], row["conv_id"])
            else:
                if at is not None:
                    out.append(at)
                at = row | {"sha": hashlib.sha256()}
            at["sha"].update(row["ids"].encode())
        yield _finished(out)
    if at is not None:
        yield _finished([at])


def _finished(rows: list[dict]) -> pa.RecordBatch:
    shape = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int32())), ("n_ends", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    return pa.RecordBatch.from_pylist([r | {"ends": r["sha"].hexdigest()} for r in rows], schema=shape)


def _distinct(rows: DataFrame) -> DataFrame:
    """Each key once: key, words, n_ends, conv_id (smallest member), ends (hash of all members' numbers)."""
    numbers: Column = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    # collect_list: a piece spans ID_SPAN numbers, each with one row
    pieces = rows.groupBy(F.sha2("key", 256).alias("name"), F.floor(F.col("conv_id") / ID_SPAN).alias("piece")).agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.count("*").alias("n_ends"), F.min("conv_id").alias("conv_id"), numbers.alias("ids")
    )
    return pieces.repartition("name").sortWithinPartitions("name", "piece").mapInArrow(_ends, "key binary, words array<int>, n_ends long, conv_id long, ends string")


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of paths (see ``paths``), one row each.

    Returns conv_id (smallest member), depth, parent_conv_id (root: null), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens (sum of
    (members - 1) x words of the last turn over the subtree) and ends_sha256 (hash of the numbers
    of members that end here, ascending, comma-joined). A path without turns is a member of the
    root. No paths give no rows. ``shard_turns`` says how many turns of distinct paths a shard gets.
    """
    spark, stages = rows.sparkSession, Stages(rows.sparkSession, "trie")
    keys = stages.write(_distinct(rows), "keys")
    turns = keys.agg(F.sum(F.length("key") / DIGEST)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -int(-turns // shard_turns))
    nodes = stages.write(keys.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(_shard, _ROWS), "nodes")
    spines = nodes.filter("path IS NOT NULL")
    merged = stages.write(_merged_spines(spines), "spines")
    near = spines.select("shard", "node").distinct().join(merged.select("node", F.col("conv_id").alias("above")), "node")
    whole = nodes.filter("path IS NULL").join(near.withColumnRenamed("node", "parent"), ["shard", "parent"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(columns).unionByName(merged.select(columns))


def conversation_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Trie of the rebuilt conversations: their first turns come from the first of each twenty.

    ``convs``: conv_id, turn, role, text; other columns are ignored, whatever their names. Rows
    without conv_id are left out, null roles and texts count as empty, repeated rows are turns of
    their own, turns with equal numbers go by digest. Long texts are hashed where they are read.
    An empty table gives no rows, not even a root.
    """
    stages = Stages(convs.sparkSession, "paths")
    own = stages.write(paths(convs), "own")
    return trie(spliced(own), shard_turns)


ORACLE = f"""WITH numbered AS (
  SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(r)) AS p, sha256(r) AS sha, words
  FROM (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS r,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (
  SELECT c, xor(list_reduce(flatten([[4294967295]] || [[unicode(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for d in string_split(c::VARCHAR, '')]),
    lambda a, e: xor(xor(a, e) >> 1, CASE WHEN xor(a, e) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM numbered)),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS p, sha, words FROM (
    SELECT ids.c, 0 AS own, p, sha, words FROM ids JOIN numbered AS b ON b.c = ids.c - ids.c % {SHARED} AND p <= h
    UNION ALL SELECT ids.c, 1, p, sha, words FROM ids JOIN numbered AS b ON b.c = ids.c AND p > h)),
prefixes AS (
  SELECT c, '' AS path, 0 AS words FROM ids
  UNION ALL SELECT c, string_agg(sha, '') OVER (PARTITION BY c ORDER BY p) AS path, words FROM rebuilt),
nodes AS (
  SELECT path, CASE WHEN path <> '' THEN left(path, length(path) - 64) END AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words
  FROM prefixes GROUP BY path),
kids AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
ends AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM (
    SELECT c, arg_max(path, length(path)) AS path FROM prefixes GROUP BY c) GROUP BY path),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, coalesce(ends_sha256, sha256('')) AS ends_sha256
  FROM nodes LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)),
sums AS (
  SELECT left(path, 64 * i) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, length(path) // 64 + 1)) AS i FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, length(f.path) // 64 AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes AS f JOIN sums USING (path) LEFT JOIN nodes AS p ON f.parent = p.path"""
