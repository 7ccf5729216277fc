"""Line deduplication by site: lines found on more than a given share of a host's pages go.

Only DataFrame functions are used. Lines travel as two 64-bit hashes, never as text. The lines
over the ratio on one host number less than its mean lines per page divided by the ratio, so
they fit one array per host, and documents meet them by a join on the host that Spark may
broadcast or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stages, fresh

RATIO = 0.1
#: A line of a single page is that page's own, whatever its share of a small host.
MIN_PAGES = 2

_HASH = "struct(xxhash64(x) AS a, xxhash64('line', x) AS b)"


def _lines(text: str) -> Column:
    """Lines of a text that hold more than blanks."""
    return F.expr(rf"filter(split({text}, '\n'), x -> trim(x) <> '')")


def boilerplate(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """Per host, the hashes of lines on more than ``ratio`` of its pages: (_host, _drop).

    Pages are the distinct texts of a host, so that copies of one page count once.
    """
    pages = docs.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"),
        F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("page"), "text").alias("b")).alias("page"),
        "text",
    )
    totals = pages.select("_host", "page").distinct().groupBy("_host").agg(F.count("*").alias("total"))
    lines = pages.select("_host", "page", _lines("text").alias("lines")).select(
        "_host", "page", F.explode(F.expr(f"array_distinct(transform(lines, x -> {_HASH}))")).alias("line")
    )
    found = lines.distinct().groupBy("_host", "line").agg(F.count("*").alias("pages"))
    often = found.filter(F.col("pages") >= min_pages).join(totals, "_host").filter(F.col("pages") > ratio * F.col("total"))
    return often.groupBy("_host").agg(F.sort_array(F.collect_list("line")).alias("_drop"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """Documents without the lines that more than ``ratio`` of their host's pages hold.

    ``docs`` has text and the ``host`` column; all columns stay, and n_lines (lines with more
    than blanks) and n_dropped (such lines taken out) are added, replacing columns of these
    names, unless ``counts`` is false. Blank lines stay as they are.
    A line is its exact text between line feeds. A line of fewer than ``min_pages`` pages stays.
    Null hosts count as the host of empty name. A null text stays null with
    zero lines; a text that loses every line becomes empty or blank, and its row stays. Repeated
    rows all stay, very long texts are handled whole. An empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "boilerplate")
    drops = stages.write(boilerplate(docs, host, ratio, min_pages), "lines")
    site, gone, kept = (fresh(n, docs) for n in ("_host", "_drop", "_kept"))
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    rows = (
        docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(site, F.coalesce(F.col(host).cast("string"), F.lit("")))
        .join(drops.toDF(site, gone), site, "left")
    )
    keep = F.expr(
        rf"filter(split(text, '\n'), x -> {gone} IS NULL OR trim(x) = '' OR NOT array_contains({gone}, {_HASH}))"
    )
    rows = rows.withColumn(kept, keep)
    text = [F.array_join(kept, "\n").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns]
    if not counts:
        return rows.select(*text)
    before, after = F.size(_lines("text")), F.expr(f"size(filter({kept}, x -> trim(x) <> ''))")
    none = F.col("text").isNull()
    return rows.select(
        *text, F.when(none, 0).otherwise(before).cast("long").alias("n_lines"), F.when(none, 0).otherwise(before - after).cast("long").alias("n_dropped"),
    )


#: DuckDB form of the operator over ``documents``, with text digests instead of texts.
ORACLE = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS host FROM documents),
p AS (SELECT DISTINCT host, text FROM d),
totals AS (SELECT host, count(*) AS total FROM p GROUP BY host),
often AS (
  SELECT host, line FROM (
    SELECT host, line, count(*) AS pages FROM (
      SELECT host, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''))) AS line FROM p
    ) GROUP BY host, line
  ) JOIN totals USING (host) WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * total),
drops AS (SELECT host, list(line) AS gone FROM often GROUP BY host),
k AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS before,
    CASE WHEN gone IS NULL THEN string_split(text, chr(10)) ELSE
      list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(gone, x)) END AS after
  FROM d LEFT JOIN drops USING (host))
SELECT doc_id, coalesce(len(list_filter(before, lambda x: trim(x, ' ') <> '')), 0) AS n_lines,
  coalesce(len(before) - len(after), 0) AS n_dropped, length(array_to_string(after, chr(10))) AS n_chars,
  md5(array_to_string(after, chr(10))) AS text_md5
FROM k
"""
