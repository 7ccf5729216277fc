"""Registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, caps, decontaminate, host_trust, mixing, pieces, pii, pivot_clusters, prefix_trie, quality, simhash, token_files, tool_calls
from .staging import Stages

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"
    )


@query("op7_line_dedup", boilerplate.ORACLE)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = boilerplate.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs), out="decoded")
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return both.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"),
        (F.col("decoded") == plain).alias("restored"),
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain of each labelled document: toxic, else low, else clean."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    return table(spark, sf_dir, "labels").select("doc_id", kind.alias("domain"))


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.rates(table(spark, sf_dir, "documents"), domains(spark, sf_dir), mixing.TARGETS)
    shares = [F.col("posterior")[k].alias(f"p_{domain}") for k, domain in enumerate(sorted(mixing.TARGETS))]
    return rates.select("doc_id", "n_tokens", *shares, "rate", "copies")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), stages.path("set"), stages.path("encoded"))
    stages.drop("encoded")
    return token_files.digests(spark, stages.path("set"))


@query("op6_embedding_dedup")
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in pii.BASE],
        F.sha2(pii.joined(pii.BASE), 256).alias("base_sha256"), pii.joined(pii.BASE + pii.MORE).alias("spans"),
    )


@query("pii_base_spans", pii.oracle())
def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8_pii, which SQL can express."""
    return op8_pii(spark, sf_dir).drop("spans")


@query("op2_url_filters")
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge(table(spark, sf_dir, "pages"))


@query("op3_tool_calls")
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.TOOLS)


@query("op11_centroid_clusters", pivot_clusters.ORACLE)
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_prefix_trie", prefix_trie.ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_decontamination", decontaminate.ORACLE)
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col("leaks.items")
    return found.select(
        "doc_id", "leaks.n_words", "leaks.n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("leaks.n_hit") > 0).alias("contaminated"),
    )
