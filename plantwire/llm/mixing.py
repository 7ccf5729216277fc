"""Mixing to target weights with soft domain membership.

A classifier fitted on labelled documents gives each document a probability per domain. Then
non-negative rates per document are sought whose expected token totals by domain meet the
targets: least squares on the totals by projected gradient from rates of one. A step moves every
rate against its gradient, which is its posterior times one number per domain, and cuts it off
at zero; the numbers come from one distributed sum over the distinct posteriors. The gradient is
taken in the metric of the rates that are not cut off, so that rare domains settle as fast as
common ones. A document's rate follows from its posterior and the numbers of all steps. All work
on documents is done by DataFrame functions.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stages

#: Wanted share of tokens by domain. The classifier sees a little of ``low`` in most clean documents.
TARGETS = {"clean": 0.988, "low": 0.002, "toxic": 0.01}
#: The classifier is fitted on so many labelled documents at most, the first by a hash of their id.
SAMPLE_ROWS = 5000
BUCKETS = 1 << 16
FEATURES = 1024
#: A share may miss its target by so much of it; one whose target is zero by so much of all tokens.
TOLERANCE = 1e-3
#: Steps after which the rates are written, so that plans stay short.
WRITTEN = 8
_PAGE = 256


def _words(text: str) -> Column:
    """Lower-cased words of a text; the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:]+")


def _buckets(words: Column) -> Column:
    """Hashed words."""
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(BUCKETS - 1))


def _numbers(values, kind: str) -> Column:
    """An array constant that reaches the plan as one literal."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


@dataclass
class Classifier:
    """Softmax regression over the presence of selected hashed words."""

    domains: list[str]
    chosen: np.ndarray
    weights: np.ndarray  # (features + 1) x domains, the last row is the bias

    def posterior(self, words: Column) -> Column:
        """Array of probabilities in the order of ``domains`` for an array of words."""
        hits = F.array_intersect(_buckets(words), _numbers(self.chosen, "bigint"))
        # weights by pages of buckets: few entries to search, and no table of all buckets in the plan
        pages: list[list[dict]] = [[] for _ in range(BUCKETS // _PAGE)]
        for bucket, row in zip(self.chosen.tolist(), self.weights[:-1].tolist()):
            pages[bucket // _PAGE].append({"b": bucket, "w": [float(f"{x:.6g}") for x in row]})
        table = F.from_json(F.lit(json.dumps(pages)), "array<array<struct<b: bigint, w: array<double>>>>")
        place = lambda b: F.element_at(table, F.shiftright(b, _PAGE.bit_length() - 1).cast("int") + 1)
        found = F.transform(hits, lambda b: F.element_at(F.filter(place(b), lambda e: e["b"] == b), 1)["w"])

        def score(k: int, rows: Column) -> Column:
            return F.aggregate(rows, F.lit(float(self.weights[-1, k])), lambda a, w: a + F.element_at(w, k + 1))

        scores = F.element_at(F.transform(F.array(found), lambda h: F.array(*[score(k, h) for k in range(len(self.domains))])), 1)
        powers = F.element_at(F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))), 1)
        total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return F.element_at(F.transform(F.array(powers), lambda e: F.transform(e, lambda x: F.round(x / total(e), 6))), 1)


def _fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a softmax regression by accelerated gradient descent from zero."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    goal = np.eye(classes, dtype=x.dtype)[y]
    v = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(30):  # largest eigenvalue of x'x by power iteration
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v))
        v /= top
    step = 1.0 / (0.5 * top / len(x) + ridge)
    w = ahead = np.zeros((x.shape[1], classes), dtype=x.dtype)
    for k in range(rounds):
        z = x @ ahead
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ (p - goal) / len(x) + ridge * ahead)
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def classify(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Classifier of the ``domains`` from documents of the table ``labelled`` (doc_id, domain).

    It sees ``sample_rows`` labelled documents at most; their counts by hashed word and domain
    choose the FEATURES words that tell domains apart best (chi-square), and the presence of
    those is what comes to the driver. Rows with null or other domains are left out, a doc_id
    with several labels takes the smallest. Without labelled documents all domains are equal.
    """
    stages = Stages(docs.sparkSession, "classifier")
    named = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = stages.write(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "labels")
    rows = stages.write(
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # sample_rows rows at most
        .select("domain", F.array_distinct(_buckets(_words("text"))).alias("buckets")),
        "sample",
    )
    counts = {r[0]: r[1] for r in rows.groupBy("domain").agg(F.count("*")).collect()}
    if not counts:
        return Classifier(domains, np.zeros(0, dtype=np.int64), np.zeros((1, len(domains))))
    n = sum(counts.values())
    held = rows.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket", "domain").agg(F.count("*").alias("held"))
    share = F.create_map(*[x for d, c in counts.items() for x in (F.lit(d), F.lit(c / n))])
    of = held.groupBy("bucket").agg(
        F.sum("held").alias("all"), F.sum(F.pow("held", F.lit(2)) / F.element_at(share, F.col("domain"))).alias("square")
    )
    # sum over domains of (held - expected) ** 2 / expected, with expected = share * all
    chosen = [r[0] for r in of.orderBy((F.col("square") / F.col("all") - F.col("all")).desc(), "bucket").limit(FEATURES).collect()]
    chosen = np.array(sorted(chosen), dtype=np.int64)
    seen = rows.select("domain", F.array_intersect("buckets", _numbers(chosen, "bigint")).alias("hits")).collect()
    seen.sort(key=lambda r: (r[0], sorted(r[1])))
    x = np.zeros((len(seen), len(chosen)), dtype=np.float32)
    for row, r in zip(x, seen, strict=True):
        row[np.searchsorted(chosen, np.array(r[1], dtype=np.int64))] = 1
    y = np.array([domains.index(r[0]) for r in seen])
    return Classifier(domains, chosen, _fit_softmax(x, y, len(domains)).astype(float))


def _rate(posterior: Column, steps: list[list[float]], rate: Column | None = None) -> Column:
    """Rate of a document after the steps, from ``rate`` or 1, never under zero."""
    rate = F.lit(1.0) if rate is None else rate
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(F.element_at(posterior, k + 1) * F.lit(x) for k, x in enumerate(step)))
    return rate


def fit_steps(scored: DataFrame, targets: list[float], stages: Stages | None = None) -> list[list[float]]:
    """Steps of the projected gradient after which the rates of ``scored`` (n_tokens, posterior) meet ``targets``.

    Targets are shares of all tokens. A step is one number per domain; a rate falls by its posterior times these
    and is cut off at zero. Steps end when every target is met within TOLERANCE, or when no step, however short,
    brings the totals nearer in the metric of all rows: then a warning names the targets that cannot be met.
    """
    k = len(targets)
    stages = stages or Stages(scored.sparkSession, "rates")
    total = scored.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return []
    goal = np.array(targets, dtype=float)
    slack = TOLERANCE * np.where(goal > 0, goal, 1.0)
    p = [F.element_at("posterior", i + 1) for i in range(k)]

    def sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Totals less the targets, and the products of posteriors over rows whose rate is not cut off."""
        got = rows.agg(
            *[F.sum(F.col("n_tokens") * F.col("rate") * x) for x in p],
            *[F.sum(F.when(F.col("rate") > 0, F.col("n_tokens") * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)],
        ).first()
        got = np.array(got, dtype=float) / total
        return got[:k] - goal, got[k:].reshape(k, k)

    rows = scored.select("n_tokens", "posterior", F.lit(1.0).alias("rate"))
    miss, curve = sums(rows)
    metric, steps, since, length = np.linalg.pinv(curve, rcond=1e-9, hermitian=True), [], 0, 1.0
    while (np.abs(miss) > slack).any() and length > 1e-4:
        step = (length * np.linalg.pinv(curve, rcond=1e-9, hermitian=True) @ miss).tolist()
        tried = rows.withColumn("rate", _rate(F.col("posterior"), [*steps[since:], step], F.col("rate")))
        new_miss, new_curve = sums(tried)
        if new_miss @ metric @ new_miss >= (1 - 1e-6) * (miss @ metric @ miss):
            length /= 2
            continue
        steps.append(step)
        miss, curve, length = new_miss, new_curve, min(1.0, 2 * length)
        if len(steps) - since == WRITTEN:
            rows, since = stages.write(tried, f"rates-{len(steps)}"), len(steps)
    unmet = {i: round(float(goal[i] + miss[i]), 6) for i in np.flatnonzero(np.abs(miss) > slack)}
    if unmet:
        warnings.warn(f"targets {targets} cannot be met: shares by place of domain {unmet}", stacklevel=2)
    return steps


def _copies(rate: Column, hash_: Column) -> Column:
    """Whole part of the rate, plus one if a draw in [0, 1) from the document's hash is under the rest."""
    draw = F.pmod(hash_, F.lit(1 << 53)) / float(1 << 53)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def _scored(docs: DataFrame, model: Classifier, *carry: Column) -> DataFrame:
    """``carry``, a hash of the document, n_tokens and posterior; the words are split once."""
    names = docs.select(*carry).columns

    def member(w: Column) -> Column:
        n = F.size(w) - (w[0] == "").cast("int") - (F.element_at(w, -1) == "").cast("int")
        return F.struct(F.greatest(n, F.lit(0)).cast("long").alias("n_tokens"), model.posterior(w).alias("posterior"))

    both = F.transform(F.array(_words("text")), member)
    return docs.select(*carry, F.xxhash64("doc_id", "text").alias("hash"), F.element_at(both, 1).alias("_both")).select(*names, "hash", "_both.*")


def _merged(scored: DataFrame, stages: Stages) -> DataFrame:
    """Tokens of each distinct posterior: all that the rates depend on, so that a step reads few rows."""
    return stages.write(scored.groupBy("posterior").agg(F.sum("n_tokens").alias("n_tokens")), "merged")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Posterior, rate and number of copies of every document.

    ``docs``: doc_id, text; other columns are ignored. ``labelled``: doc_id, domain.
    ``targets``: share of all tokens of ``docs`` by domain. Returns doc_id, n_tokens (words),
    posterior (array in the order of the sorted domains), rate (0 or more) and copies (whole
    part of the rate, plus one if a draw from the document's hash says so), one row for each
    input row. A null or empty text has no tokens and the posterior of no words. A domain that
    no document belongs to cannot be filled, which a warning says; the others still meet their
    shares. Empty: no rows.
    """
    domains = sorted(targets)
    model = classify(docs, labelled, domains)
    stages = Stages(docs.sparkSession, "mixing")
    scored = stages.write(_scored(docs, model, F.col("doc_id")), "scored")
    steps = fit_steps(_merged(scored, stages), [targets[d] for d in domains], stages)
    rated = scored.withColumn("rate", F.round(_rate(F.col("posterior"), steps), 6))
    return rated.select("doc_id", "n_tokens", "posterior", "rate", _copies(F.col("rate"), F.col("hash")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Documents, each row as often as ``rates`` says, with all their columns, whatever their names.

    Posteriors are computed again beside the text, so that no text is shuffled or written.
    """
    domains = sorted(targets)
    model = classify(docs, labelled, domains)
    stages = Stages(docs.sparkSession, "mixing")
    steps = fit_steps(_merged(_scored(docs, model), stages), [targets[d] for d in domains], stages)
    # bound in one expression: a column of posteriors would be computed again wherever it is used
    rate = F.transform(F.array(_words("text")), lambda w: F.transform(F.array(model.posterior(w)), lambda p: F.round(_rate(p, steps), 6))[0])
    copies = F.transform(rate, lambda r: _copies(r, F.col("_hash")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", F.xxhash64("doc_id", "text").alias("_hash"))
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), copies[0].cast("int")))).select("_row.*")
