"""Near-duplicate vectors by spherical-cap filters from random product codes.

A rotated vector is cut in two halves, and each half has a code of random directions; several
rotations are used. A filter is a pair of code words, one for each half, and its direction is
their concatenation. A vector belongs to every filter whose direction it meets by more than a
threshold, and list decoding finds those without looking at all pairs of words: only words that
can still reach the threshold with the best word of the other half are combined. Vectors that
share a filter are compared in double precision, in blocks. A pair counts in its smallest
common filter only.

The code grows with the number of vectors so that filters keep their mean size, and the
threshold follows from the number of filters that two linked vectors should share on average,
by the caps of the sphere itself; rotations are added where too many pairs would share none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .staging import Stages

COSINE = 0.9
#: Filters that two vectors at the least cosine share on average, over all rotations.
SHARED = 28.0
#: Independent rotations, each with a code of its own; they even out how many filters a vector meets.
ROTATIONS = 4
#: Part of random pairs at the least cosine that may share no filter, and how many pairs it is measured on.
MISSED = 0.01
PAIRS = 300
#: Vectors of a filter on average.
MEAN_SIZE = 64
#: Vectors in one block; larger filters are compared block by block, each pair of blocks in its own row.
BLOCK = 512


@dataclass(frozen=True)
class Code:
    """Size of the half codes and least product of a vector with a filter's direction."""

    dim: int
    words: int
    least: float
    rotations: int = ROTATIONS
    seed: int = 7


def _cap(dim: int, least: np.ndarray) -> np.ndarray:
    """Part of the sphere whose product with a fixed direction is ``least`` or more."""
    if dim < 2:
        return np.where(least <= -1, 1.0, np.where(least <= 1, 0.5, 0.0))
    angle = np.linspace(0, math.pi, 200_001)
    dense = np.sin(angle) ** (dim - 2)
    area = np.concatenate([[0.0], np.cumsum((dense[1:] + dense[:-1]) / 2)])
    return np.where(least > 1, 0.0, np.interp(np.arccos(np.clip(least, -1, 1)), angle, area / area[-1]))


def _both(dim: int, least: float, cosine: float) -> float:
    """Part of the sphere that meets both of two directions of product ``cosine`` by ``least`` or more."""
    if dim < 2 or cosine >= 1:
        return float(_cap(dim, np.array(least)))
    if dim == 2:
        return max(0.0, math.acos(least) - math.acos(cosine) / 2) / math.pi
    angle = np.linspace(0, math.acos(least), 4001)[1:]
    x, side = np.cos(angle), np.sin(angle)
    inner = _cap(dim - 1, (least - cosine * x) / (math.sqrt(1 - cosine * cosine) * side))
    turn = np.linspace(0, math.pi, 20_001)
    return float(np.trapezoid(inner * side ** (dim - 2), angle) / np.trapezoid(np.sin(turn) ** (dim - 2), turn))


def _missed(code: Code, cosine: float, pairs: int = PAIRS) -> float:
    """Part of ``pairs`` random pairs at ``cosine`` that share no filter of the code."""
    rng = np.random.default_rng(code.seed + 1)
    a, b = rng.standard_normal((2, pairs, code.dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b
    return float(np.mean([not np.intersect1d(*filters(np.array(pair), code)).size for pair in zip(a, b, strict=True)]))


def choose_code(n: int, dim: int, cosine: float = COSINE, shared: float = SHARED, mean_size: int = MEAN_SIZE) -> Code:
    """Code for ``n`` vectors: filters hold about ``mean_size`` of them, linked pairs share ``shared`` filters.

    Probabilities are those of the sphere of ``dim`` dimensions. As pairs differ in how many filters they
    share, rotations are added until no more than MISSED of random pairs at ``cosine`` share none.
    """
    part = min(0.5, mean_size / max(n, 1))
    low, high = 0.0, 1.0
    for _ in range(60):
        z = (low + high) / 2
        low, high = (z, high) if _cap(dim, np.array(z)) > part else (low, z)
    least = min(low, 0.6)  # few dimensions know no high caps
    words = math.ceil(math.sqrt(shared / ROTATIONS / _both(dim, least, cosine)))
    code = Code(dim, words, least)
    while dim > 3 and cosine < 1 and _missed(code, cosine) > MISSED:
        code = replace(code, rotations=code.rotations + 2)
    return code


@lru_cache(maxsize=2)
def _directions(code: Code) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per rotation, the words of both halves as directions in the unrotated space, at half a unit vector's length."""
    rng = np.random.default_rng(code.seed)
    out, half = [], code.dim // 2
    for _ in range(code.rotations):
        rotation = np.linalg.qr(rng.standard_normal((code.dim, code.dim)))[0]
        halves = []
        for basis in (rotation[:, :half], rotation[:, half:]):
            words = rng.standard_normal((code.words, basis.shape[1]))
            words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-300)
            halves.append(basis @ words.T * math.sqrt(basis.shape[1] / code.dim))
        out.append((halves[0], halves[1]))
    return out


def filters(vectors: np.ndarray, code: Code) -> list[np.ndarray]:
    """Sorted filter numbers of each unit vector, by list decoding."""
    found: list[list[np.ndarray]] = [[] for _ in vectors]
    for turn, (first, second) in enumerate(_directions(code)):
        for mine, x, y in zip(found, vectors @ first, vectors @ second, strict=True):
            left = np.flatnonzero(x >= code.least - y.max())
            right = np.flatnonzero(y >= code.least - x.max())
            i, j = np.nonzero(x[left, None] + y[right] >= code.least)
            mine.append(np.sort(left[i] * code.words + right[j]) + turn * code.words**2)
    return [np.concatenate(mine) for mine in found]


def _unit(values) -> np.ndarray | None:
    """Unit vector in double precision; None for null, zero or non-finite vectors."""
    if values is None:
        return None
    v = np.array([np.nan if x is None else x for x in values], dtype=np.float64) if not isinstance(values, np.ndarray) else values.astype(np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # neither overflow nor underflow in the length
    return v / np.linalg.norm(v)


def _tag(code: Code):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = np.array([_unit(v) for v in batch["vector"]]).reshape(-1, code.dim)
            for at in range(0, len(units), 2000):
                ids = batch["node"].to_numpy()[at : at + 2000]
                found = filters(units[at : at + 2000], code)
                sizes = [len(f) for f in found]
                yield pd.DataFrame({
                    "filter": np.concatenate(found) if found else np.zeros(0, dtype=np.int64),
                    "node": np.repeat(ids, sizes),
                })

    return run


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        units = [_unit(v) for v in batch["vector"]]
        batch["dim"] = np.array([0 if u is None else len(u) for u in units], dtype=np.int32)
        batch["vector"] = [None if u is None else v for u, v in zip(units, batch["vector"])]
        yield batch


def _compare(code: Code, cosine: float):
    """Links within a block or between two blocks of a filter, as counts and as edges of a spanning forest."""

    def links(filter_id: int, left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
        sides = [left] if right is None else [left, right]
        if not all(len(side) for side in sides):
            return np.zeros((0, 2), dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
        ids = [np.array([r["node"] for r in side]) for side in sides]
        units = [np.array([_unit(r["vector"]) for r in side]) for side in sides]
        near = units[0] @ units[-1].T >= cosine
        if right is None:
            near &= ~np.tri(len(near), dtype=bool)
        if not near.any():
            return np.zeros((0, 2), dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
        # pairs that share a smaller filter are left to it
        rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        smaller = [[f[f < filter_id] for f in filters(u[k], code)] for u, k in zip((units[0], units[-1]), (rows, cols))]
        names = np.unique(np.concatenate([f for side in smaller for f in side]))
        if len(names):
            marks = []
            for side in smaller:
                m = np.zeros((len(side), len(names)), dtype=np.float32)
                for line, f in zip(m, side, strict=True):
                    line[np.searchsorted(names, f)] = 1
                marks.append(m)
            near[np.ix_(rows, cols)] &= marks[0] @ marks[1].T == 0
        i, j = np.nonzero(near)
        rows = [np.array([r["size"] for r in side], dtype=np.float64) for side in sides]
        ends = np.concatenate([ids[0], ids[-1]])
        count = np.concatenate([near @ rows[-1], rows[0] @ near]).astype(np.int64)
        return np.column_stack([ends, count])[count > 0], _forest(ids[0][i], ids[-1][j])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for f, left, right in zip(batch["filter"], batch["left"], batch["right"], strict=True):
                parts += [(x, edge) for x, edge in zip(links(f, left, right), (False, True)) if len(x)]
            found = np.concatenate([x for x, _ in parts]) if parts else np.zeros((0, 2), dtype=np.int64)
            yield pd.DataFrame({"u": found[:, 0], "v": found[:, 1], "edge": np.repeat([e for _, e in parts] or [False], [len(x) for x, _ in parts] or [0])})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, kept = list(range(len(nodes))), []
    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.column_stack([a[kept], b[kept]]) if kept else np.zeros((0, 2), dtype=np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shared: float = SHARED, block: int = BLOCK) -> DataFrame:
    """Links and groups of vectors by cosine of at least ``cosine``.

    ``vectors``: vec_id, embedding (array of numbers); other columns are ignored. Returns
    vec_id, n_links (other rows linked directly), component_id (smallest vec_id that links
    reach, itself included) and kept (vec_id = component_id), one row for each input row.
    Rows of equal vectors are one class: they link with each other and share their links.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing;
    vectors of different lengths neither. Rows that repeat a vec_id count as other vectors. A
    row without vec_id counts as a link of others, never names a group and is never kept. An
    empty table gives no rows. ``shared`` sets how many filters two vectors at exactly ``cosine``
    share on average, closer ones share more; a link that shares none is missed. ``block`` only
    says how large filters are split.
    """
    stages = Stages(vectors.sparkSession, "caps")
    number = "float" if "array<float>" in dict(vectors.dtypes)["embedding"] else "double"
    rows = stages.write(
        vectors.select("vec_id", F.col("embedding").cast(f"array<{number}>").alias("vector"))
        .mapInPandas(_clean, f"vec_id long, vector array<{number}>, dim int"),
        "rows",
    )
    # equal vectors meet by their bytes; -0.0 and 0.0 are the same number
    key = F.transform("vector", lambda x: x + F.lit(0.0).cast(number))
    keyed = rows.withColumn("key", F.sha2(F.to_json(F.struct(key.alias("v"))), 256))
    good = keyed.filter("dim > 0")
    classes = stages.write(
        good.groupBy("key").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"), F.any_value("vector").alias("vector"), F.any_value("dim").alias("dim"))
        .withColumn("node", F.xxhash64("key")),
        "classes",
    )
    counts = groups = None
    for dim, n in [tuple(r) for r in classes.groupBy("dim").agg(F.count("*")).collect()]:
        some = classes.filter(F.col("dim") == dim)
        found = _links(some, choose_code(n, dim, cosine, shared), cosine, block, stages, f"{dim}")
        counts = found if counts is None else counts.unionByName(found)
    ends = classes.select("node", "size", "first", "key")
    if counts is not None:
        direct = counts.filter("NOT edge").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("links"))
        edges = counts.filter("edge").select("u", "v")
        groups = graph.components(edges, stages)
        named = groups.join(ends, "node").groupBy("component").agg(F.min("first").alias("component_id"))
        ends = ends.join(direct, "node", "left").join(groups, "node", "left").join(named, "component", "left")
    else:
        ends = ends.withColumns({"links": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    ends = stages.write(
        ends.select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")
        ),
        "ends",
    )
    linked = keyed.filter("dim > 0").select("vec_id", "key").join(ends, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, code: Code, cosine: float, block: int, stages: Stages, name: str) -> DataFrame:
    """Counts (u: node, v: linked rows of other classes) and edges (u, v) among classes of one dimension."""
    tagged = stages.write(classes.select("node", "vector").mapInPandas(_tag(code), "filter long, node long"), f"tags-{name}")
    sizes = tagged.groupBy("filter").agg(F.count("*").alias("members")).filter("members > 1")
    # blocks of a filter: members are dealt by hash, so no filter is ever in one task as a whole
    blocks = F.ceil(F.col("members") / block).cast("int")
    spread = tagged.join(sizes, "filter").select(
        "filter", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int").alias("at")
    )
    # pair of blocks (i <= j) that a member takes part in: as left side in (at, j), as right side in (i, at)
    pairs = spread.select(
        "filter", "node", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "filter", "node", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") <= F.col("other")).alias("is_left")
    )
    member = F.struct("node", "size", "vector")
    met = (
        pairs.join(classes.select("node", "size", "vector"), "node")
        .groupBy("filter", "i", "j")
        .agg(F.collect_list(F.when(F.col("is_left"), member)).alias("left"), F.collect_list(F.when(~F.col("is_left"), member)).alias("right"))
        .withColumn("right", F.when(F.col("i") < F.col("j"), F.col("right")))
    )
    return stages.write(met.select("filter", "left", "right").mapInPandas(_compare(code, cosine), "u long, v long, edge boolean"), f"links-{name}")
