"""Centroid clustering with a LAESA pivot table: exact integer distances only where pivots cannot exclude a centroid.

Components become integers. Each vector's squared distances to a few fixed pivots are stored
once, beside the vector. In every round the difference between a vector's and a centroid's
distance to a pivot bounds their own distance from below, and the largest such difference over
all pivots is the bound. Centroids are tried from the smallest bound up; those whose bound
exceeds the best distance so far are left out, the others get their exact distance. The pivots
are the starting centroids, so the bounds are tight as long as centroids move little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .staging import Stages

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Larger components could push a squared distance of 64 dimensions beyond a long.
LIMIT = 1 << 21
#: Share of a distance that a bound gives up, far above the rounding error of its square roots.
_SLACK = 1e-9


def usable(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector has ``dim`` components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row to every point; memory for one point at a time."""
    out = np.empty((len(rows), len(points)), dtype=np.int64)
    for k, point in enumerate(points):
        gap = rows - point
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and the number of exact distances taken."""
    away, between = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(squared(centroids, pivots).astype(np.float64))
    bound = np.zeros((len(rows), len(centroids)))
    for p in range(len(pivots)):
        at, to = away[:, p, None], between[None, :, p]
        np.maximum(bound, np.abs(at - to) - _SLACK * (1 + at + to), out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best, who = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(centroids))
    left, taken = np.arange(len(rows)), 0
    for step in range(len(centroids)):
        centroid = order[left, step]
        open_ = bound[left, centroid] <= best[left]
        left, centroid = left[open_], centroid[open_]
        if not len(left):
            break
        gap = rows[left] - centroids[centroid]
        exact = np.einsum("ij,ij->i", gap, gap)
        better = (exact < best[left]) | ((exact == best[left]) & (centroid < who[left]))
        best[left[better]], who[left[better]] = exact[better], centroid[better]
        taken += len(left)
    return who, best, taken


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _with_pivots(pivots: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = squared(_matrix(batch["q"], pivots.shape[1]), pivots)
            ends = np.arange(len(far) + 1, dtype=np.int32) * len(pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, far.ravel())], [*batch.schema.names, "to_pivots"])

    return add


def _sums(pivots: np.ndarray, centroids: np.ndarray):
    """Per task and cluster: number of vectors and sum of every component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch["q"], centroids.shape[1])
            who, _, _ = nearest(rows, _matrix(batch["to_pivots"], len(pivots)), centroids, pivots)
            size += np.bincount(who, minlength=len(centroids))
            order = np.argsort(who, kind="stable")
            found, first = np.unique(who[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(rows[order], first, axis=0)
        found = np.flatnonzero(size)
        ends = np.arange(len(found) + 1, dtype=np.int32) * centroids.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(size[found]), pa.ListArray.from_arrays(ends, total[found].ravel())], ["cluster", "n", "total"]
        )

    return add


def _assign(pivots: np.ndarray, centroids: np.ndarray, width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, far, _ = nearest(_matrix(batch["q"], width), _matrix(batch["to_pivots"], len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(who, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    return add


def _moved(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round. Spark adds the tasks' sums; clusters x dimensions rows reach the driver."""
    parts = table.mapInArrow(_sums(pivots, centroids), "cluster int, n long, total array<long>")
    wide = "decimal(38,0)"
    rows = (
        parts.select("cluster", "n", F.posexplode("total").alias("dim", "part"))
        .groupBy("cluster", "dim").agg(F.sum(F.col("part").cast(wide)).alias("total"), F.sum("n").alias("n")).collect()
    )
    after = centroids.copy()
    for r in rows:
        after[r.cluster, r.dim] = int(r.total) // r.n
    return after


def cluster(
    vectors: DataFrame, vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE
) -> DataFrame:
    """Clusters of the usable vectors after ``rounds`` rounds and a last assignment.

    ``vectors``: vec_id and the column ``vector``; other columns are ignored, whatever their
    names. Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256, one row for each usable vector. Start: the ``clusters`` vectors with the
    smallest sha256 of ``1:<vec_id>`` (a null id counts as empty text), equal ids in the order
    of their components; fewer vectors give fewer clusters. Ties go to the smaller number, an
    empty cluster keeps its centroid. Null vectors, other lengths and vectors with null or
    non-finite components are left out; a component beyond ``LIMIT`` gives a row with nulls,
    as its squared distances need not fit a long. Repeated rows count each. An empty table
    gives no rows.
    """
    spark, stages = vectors.sparkSession, Stages(vectors.sparkSession, "clusters")
    kept = vectors.select("vec_id", F.col(vector).alias("v")).filter(usable(F.col("v"), dim))
    fits = F.forall("v", lambda x: F.abs(x.cast("double")) <= LIMIT)
    small = kept.filter(fits).select("vec_id", integers(F.col("v"), scale).alias("q"))
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = small.select(key.alias("key"), "q").orderBy("key", "q").limit(clusters).collect()
    centroids = pivots = np.array([r.q for r in start], dtype=np.int64).reshape(-1, dim)
    if len(pivots):
        shape = StructType([*small.schema.fields, StructField("to_pivots", spark.range(0).select(F.array("id")).schema[0].dataType)])
        table = stages.write(small.mapInArrow(_with_pivots(pivots), shape), "pivots")
        for _ in range(rounds):
            centroids = _moved(table, pivots, centroids)
        shape = f"vec_id {small.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
        done = stages.write(table.mapInArrow(_assign(pivots, centroids, dim), shape), "assigned")
        stages.drop("pivots")
    else:
        done = small.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0)
    # one row for each cluster
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = sum(int(r.total) for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shape = StructType([StructField("cluster", done.schema["cluster"].dataType), *[StructField(n, LongType()) for n in ("cluster_inertia", "inertia")], StructField("centroid_sha256", StringType())])
    long = lambda n: n if n < 1 << 63 else None
    about = spark.createDataFrame([(r.cluster, long(int(r.total)), long(inertia), digest[r.cluster]) for r in sums], shape)
    found = done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", *shape.names[1:])
    none = [F.lit(None).cast(found.schema[n].dataType).alias(n) for n in found.columns[1:]]
    return found.unionByName(kept.filter(~fits).select("vec_id", *none))


def _oracle() -> str:
    """DuckDB SQL of the same rows, all distances taken."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': d, 'k': k}}) AS m FROM (
    SELECT rid, vec_id, q, k, list_sum([(q[i] - c[i]) * (q[i] - c[i]) for i in range(1, {DIM + 1})])::BIGINT AS d FROM kept, c{r}) GROUP BY rid)""")
        if r < ROUNDS:
            rounds.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(any_value(moved), any_value(c)) AS c FROM c{r} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM (
      SELECT m.k AS k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) AS t(i) GROUP BY 1, 2) GROUP BY k
  ) USING (k) GROUP BY k)""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS k, q AS c FROM kept ORDER BY k LIMIT {CLUSTERS}),
{", ".join(rounds)}
SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON m.k = k"""


ORACLE = _oracle()
