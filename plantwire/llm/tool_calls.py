"""Tool calls in conversations: linked with their results, ordered, validated, serialised.

Calls and results meet by a join on conversation and call id. A call may refer to results of
other calls by string arguments of the form ``$<call id>``; the level of a call is the length
of the longest chain of such references behind it, so ordering a conversation by level, turn
and id is a topological order. Only DataFrame functions are used, and nothing of a
conversation is gathered: every call is a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stages

#: JSON type names and how the types of parsed values begin.
_TYPES = {
    "string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY",
}


@dataclass(frozen=True)
class Tool:
    """Name and arguments of a tool: type by argument, and those that must be given."""

    name: str
    arguments: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def _problem(tool: Tool) -> Column:
    """First reason why the parsed arguments do not suit the tool; null if they do."""
    checks = [(F.col("value").isNull(), "arguments are no JSON"), (~F.schema_of_variant("value").startswith("OBJECT"), "arguments are no object")]
    for name in sorted(tool.required):
        checks.append((F.try_variant_get("value", f"$.{name}", "variant").isNull(), f"{name} is missing"))
    for name, kind in sorted(tool.arguments.items()):
        given = F.try_variant_get("value", f"$.{name}", "variant")
        checks.append((given.isNotNull() & ~F.schema_of_variant(given).rlike(_TYPES[kind]), f"{name} is no {kind}"))
    known = F.array(*[F.lit(n) for n in sorted(tool.arguments)]) if tool.arguments else F.array().cast("array<string>")
    checks.append((F.size(F.array_except(F.json_object_keys(F.to_json("value")), known)) > 0, "unknown argument"))
    reason = F.when(checks[0][0], checks[0][1])
    for condition, text in checks[1:]:
        reason = reason.when(condition, text)
    return reason


def levels(calls: DataFrame, stages: Stages) -> DataFrame:
    """(conv_id, call_id, level) of calls that no circle of references is behind; level 0 refers to nothing.

    ``calls``: conv_id, call_id, refs (ids referred to; unknown ones and the call itself count as nothing
    and as a circle). Each round settles the calls whose references are settled, so the number of rounds
    is the length of the longest chain, and a round reads only edges of calls that are still open.
    """
    keys = ["conv_id", "call_id"]
    ids = calls.select(*keys)
    edges = stages.write(
        calls.select(*keys, F.explode(F.array_distinct("refs")).alias("ref"))
        .join(ids.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"]).select("conv_id", "call_id", "ref"),
        "edges-0",
    )
    done = stages.write(ids.join(edges, keys, "left_anti").withColumn("level", F.lit(0)), "levels-0")
    every, turn = done, 0
    while not edges.isEmpty():
        turn += 1
        settled = every.select("conv_id", F.col("call_id").alias("ref"), "level")
        state = edges.join(settled, ["conv_id", "ref"], "left").groupBy(*keys).agg(
            F.count_if(F.col("level").isNull()).alias("open"), (F.max("level") + 1).alias("level")
        )
        fresh = stages.write(state.filter("open = 0").select(*keys, "level"), f"levels-{turn}")
        if fresh.isEmpty():
            break
        every = every.unionByName(fresh)
        edges = stages.write(edges.join(fresh.select(*keys), keys, "left_anti"), f"edges-{turn}")
        stages.drop(f"edges-{turn - 1}")
    return every


#: Turns of one conversation and level in a bucket of positions.
_TURNS = 1024


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position``: place of the call in its conversation by level, turn and id, from 1.

    Rows without a level have none. Places are counted inside buckets of turns, and buckets by their
    counts, so that a conversation with very many calls is no single group.
    """
    bucket = ["conv_id", "level", "_bucket"]
    placed = rows.filter("level IS NOT NULL").select(
        "conv_id", "call_id", "level", F.coalesce("turn", F.lit(-1)).alias("_turn"), F.floor(F.coalesce("turn", F.lit(-1)) / _TURNS).alias("_bucket")
    )
    running = Window.partitionBy("conv_id").orderBy("level", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*bucket).agg(F.count("*").alias("_n")).select(*bucket, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*bucket).orderBy("_turn", "call_id")
    placed = placed.withColumn("_i", F.row_number().over(inside)).join(before, bucket)
    return rows.join(placed.select("conv_id", "call_id", (F.col("_before") + F.col("_i")).alias("position")), ["conv_id", "call_id"], "left")


def link(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """One row for each (conv_id, call_id) of calls or results, with its message in canonical JSON.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text); ``results``: conv_id, turn,
    call_id, content; other columns are ignored. The first call by turn with an id counts, and the
    first result by turn; ``n_calls`` and ``n_results`` tell of more (ties by the smaller texts).
    Returns conv_id, call_id, turn (of the call, of a lone result its own), name, level (null
    behind circles and for lone results), status (orphan_result, unknown_tool, bad_arguments,
    circular, result_first, no_result or ok, the first that holds), problem (why the arguments are
    bad), n_calls, n_results, position (of the call in its conversation in topological order, null
    where level is) and message: sorted keys, no blanks, the arguments as an object, absent values left
    out; arguments that are no JSON stand as ``{"text":...}``. Rows with null conv_id or call_id take
    no part. Null arguments are no JSON. Very long arguments and results are handled whole. Empty
    tables give no rows.
    """
    stages = Stages(calls.sparkSession, "tool-calls")
    keys, named = ["conv_id", "call_id"], "conv_id IS NOT NULL AND call_id IS NOT NULL"
    first = calls.filter(named).groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    refs = F.regexp_extract_all(F.coalesce("c.arguments", F.lit("")), F.lit(r'"\$([^"\\]+)"'), 1)
    first = stages.write(first.select(*keys, "c.*", "n_calls", refs.alias("refs")), "calls")
    answer = results.filter(named).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    rows = (
        positions(first.drop("refs").join(levels(first, stages), keys, "left"))
        .join(answer, keys, "full")
        .withColumn("value", F.try_parse_json("arguments"))
    )
    problem = F.lit(None).cast("string")
    for tool in tools:
        problem = F.when(F.col("name") == tool.name, _problem(tool)).otherwise(problem)
    rows = rows.withColumn("problem", problem)
    known = F.coalesce(F.col("name").isin([t.name for t in tools]), F.lit(False))
    status = (
        F.when(F.col("n_calls").isNull(), "orphan_result").when(~known, "unknown_tool").when(F.col("problem").isNotNull(), "bad_arguments")
        .when(F.col("level").isNull(), "circular").when(F.col("r.turn") <= F.col("turn"), "result_first")
        .when(F.col("n_results").isNull(), "no_result").otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    # names in order, and objects inside are sorted by the parser
    given = F.coalesce("value", F.when(F.col("arguments").isNotNull(), F.parse_json(F.to_json(F.struct(F.col("arguments").alias("text"))))))
    message = F.to_json(
        F.struct(
            given.alias("arguments"), F.col("call_id").alias("id"),
            "level", "name", "problem", F.col("r.content").alias("result"), "status",
        )
    )
    return rows.select(
        *keys, F.coalesce("turn", "r.turn").alias("turn"), "name", "level", "status", "problem",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "position", message.alias("message"),
    )


TOOLS = [
    Tool("search", {"query": "string", "limit": "integer", "after": "string"}, ("query", "limit")),
    Tool("translate", {"text": "string", "to": "string", "after": "string"}, ("text", "to")),
    Tool("count", {"text": "string", "words": "boolean", "after": "string"}, ("text",)),
]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations (conv_id, turn, role, text) stand for.

    Each user turn calls one of four tools (one is not known) with its text; some arguments are of
    a wrong type or absent, and most calls wait for the call two turns before. Each assistant
    turn is the result of the call one turn before.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    pick = F.pmod(F.xxhash64("text"), F.lit(16))
    after = F.when((F.col("turn") >= 2) & (F.col("turn") % 8 >= 2), F.concat(F.lit("$c"), (F.col("turn") - 2).cast("string"))).alias("after")
    limit = (F.col("turn") + 1).cast("int")
    arguments = (
        F.when(pick < 5, F.to_json(F.struct(F.col("text").alias("query"), limit.alias("limit"), after)))
        .when(pick == 5, F.to_json(F.struct(F.col("text").alias("query"), limit.cast("string").alias("limit"), after)))
        .when(pick < 10, F.to_json(F.struct(F.when(pick < 9, "en").alias("to"), F.col("text").alias("text"), after)))
        .when(pick < 15, F.to_json(F.struct(after, (pick < 13).alias("words"), F.col("text").alias("text"))))
        .otherwise(F.col("text"))
    )
    name = F.when(pick < 6, "search").when(pick < 10, "translate").when(pick < 14, "count").when(pick == 14, "rank").otherwise("count")
    calls = rows.filter("role = 'user'").select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), name.alias("name"), arguments.alias("arguments")
    )
    results = rows.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results
