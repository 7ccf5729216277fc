"""Near-duplicate documents: SimHash fingerprints linked by covering locality-sensitive hashing.

Bits of a fingerprint get non-zero vectors of four binary digits. Table ``t`` (1..15)
hashes the bits whose vector has an odd product with ``t``. Any three vectors leave some
``t`` with which all their products are even, so two fingerprints that differ in three bits
or fewer agree on every bit of that table: no link is missed. A table whose bucket holds too
many fingerprints is hashed again by fifteen tables over the bits it left out, which keeps
the guarantee and, after three levels, bounds a bucket by the few bits that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import covering, graph
from .near_copies import drop_near_duplicates  # noqa: F401
from .staging import Stages

RADIUS = 3
TABLES = 15
CROWDED = 2048
LEVELS = 3
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Fingerprint of a text as unsigned 64-bit number; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def covering_masks(levels: int = LEVELS) -> list[list[int]]:
    """Bit masks of each level; table ``15 * t + k`` of a level refines table ``t`` of the one before."""
    out, above = [], [0]
    for _ in range(levels):
        masks = []
        for mask in above:
            free = [i for i in range(64) if not mask >> i & 1]
            masks += [mask | more for more in covering.masks(free, RADIUS)]
        out.append(masks)
        above = masks
    return out


def _forest(prints: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one bucket."""
    edges, left = [], np.ones(len(prints), dtype=bool)
    for start in range(len(prints)):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            at = todo.pop()
            near = np.flatnonzero(left & (np.bitwise_count(prints ^ prints[at]) <= RADIUS))
            left[near] = False
            edges += [(int(nodes[i]), int(nodes[at])) for i in near]
            todo += near.tolist()
    return edges


def _link_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        edges = []
        for prints, nodes in zip(batch["prints"], batch["nodes"], strict=True):
            if len(prints) == 2:
                if ((int(prints[0]) ^ int(prints[1])) & 0xFFFFFFFFFFFFFFFF).bit_count() <= RADIUS:
                    edges.append((int(nodes[0]), int(nodes[1])))
            else:
                edges += _forest(np.asarray(prints, dtype=np.int64).view(np.uint64), np.asarray(nodes))
        yield pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def _links(classes: DataFrame, stages: Stages, crowded: int) -> DataFrame:
    """Edges (u, v) between fingerprint classes (print, node) whose closure is that of all links."""
    rows, found = classes.withColumn("table", F.lit(0)), None
    for level, masks in enumerate(covering_masks()):
        table = F.col("table") * TABLES + F.col("k")
        rows = (
            rows.select("print", "node", "table", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("k"))
            .select("print", "node", table.alias("table"))
            .withColumn("key", F.col("print").bitwiseAND(F.element_at(F.lit([covering.signed(m) for m in masks]), F.col("table") + 1)))
        )
        shared = stages.write(rows.groupBy("table", "key").agg(F.count("*").alias("size")).filter("size > 1"), f"buckets-{level}")
        last = level == LEVELS - 1
        small = rows.join(shared if last else shared.filter(F.col("size") <= crowded), ["table", "key"])
        # collect_list: a bucket holds ``crowded`` fingerprints at most, on the last level 2 to the number of bits left out
        edges = (
            small.groupBy("table", "key").agg(F.collect_list(F.struct("print", "node")).alias("members"))
            .select(F.col("members.print").alias("prints"), F.col("members.node").alias("nodes"))
            .mapInPandas(_link_buckets, "u long, v long")
        )
        edges = stages.write(edges, f"links-{level}")
        found = edges if found is None else found.unionByName(edges)
        full = shared.filter(F.col("size") > crowded)
        if last or full.isEmpty():
            return found
        rows = rows.join(full, ["table", "key"]).select("print", "node", "table")
    return found


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Groups of documents whose fingerprints are linked by chains of three differing bits or fewer.

    ``docs``: doc_id, text; other columns are ignored. Returns doc_id, print (signed 64-bit
    fingerprint) and component_id, one row for each input row. A null text counts as empty;
    texts without words have fingerprint zero and are linked like any other. Rows that
    repeat a doc_id each get their own fingerprint. A null doc_id gets the group of its text
    but never names one, unless the group has no other id (then component_id is null).
    An empty table gives no rows. ``crowded`` only says when a bucket is split.
    """
    stages = Stages(docs.sparkSession, "simhash")
    prints = stages.write(docs.select("doc_id", _fingerprints("text").alias("print")), "prints")
    classes = stages.write(prints.groupBy("print").agg(F.min("doc_id").alias("node")), "classes")
    groups = graph.components(_links(classes.filter("node IS NOT NULL"), stages, crowded), stages)
    named = stages.write(
        classes.join(groups, "node", "left").select(F.col("print"), F.coalesce("component", "node").alias("component_id")), "groups"
    )
    return prints.join(named, "print").select("doc_id", "print", "component_id")
