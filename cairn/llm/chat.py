"""Tool-call linking for chat data.

Calls and results are hash-joined by identifier (a shuffled hash join of unique
identifiers, so no conversation, however long, lands in one task). Calls that
wait for another call are put in topological order: their depth is found by
pointer doubling (after k rounds each call points 2**k calls back, so a chain of
n takes log2 n joins), and a range sort by depth numbers them. Arguments are
parsed to variants, validated against a schema by tool name and written back,
within the message, as canonical JSON (sorted keys at every depth, no blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, stash

#: name -> field -> (type as schema_of_variant names it, required[, most characters])
Schemas = dict[str, dict[str, tuple]]


def canonical(json: Column) -> Column:
    """The JSON with sorted keys; null where it does not parse."""
    return F.to_json(F.try_parse_json(json))


def schema_errors(name: Column, json: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments: unknown tool, bad JSON, missing or mistyped fields."""
    value = F.try_parse_json(json)
    out = F.when(F.coalesce(name.isin(*schemas), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("unknown tool")))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for key, (kind, required, *most) in sorted(fields.items()):
            got = F.try_variant_get(value, f"$.{key}", "variant")
            missing = got.isNull() | F.coalesce(F.is_variant_null(got), F.lit(False))
            found = F.schema_of_variant(got)
            check = F.when(missing, F.lit(f"missing {key}" if required else None)).when(found != kind, F.concat(F.lit(f"{key} is "), found))
            for limit in most:
                check = check.when(F.char_length(F.try_variant_get(value, f"$.{key}", "string")) > limit, F.lit(f"{key} is over {limit} characters"))
            checks.append(check)
        bad = F.when(value.isNull(), F.array(F.lit("bad JSON"))).otherwise(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
        out = F.when(name == tool, bad).otherwise(out)
    return out


def call_depth(calls: DataFrame) -> DataFrame:
    """``(call_id, depth)`` for unique ``call_id`` with ``after`` (a call id or null).

    Depth 0 waits for nothing (or for a call that is not there); a call in or
    behind a cycle has a null depth.
    """
    spark = calls.sparkSession
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    start = calls.join(known.hint("shuffle_hash"), "after", "left").select("call_id", F.when(F.col("there"), F.col("after")).alias("far"), F.when(F.col("there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"))
    at, path = stash(start, "depth")
    n, reach = at.count(), 1
    while reach <= n and at.where("far is not null").limit(1).count():
        jump = at.select(F.col("call_id").alias("far"), F.col("far").alias("next"), F.col("depth").alias("more"))
        new = at.join(jump.hint("shuffle_hash"), "far", "left").select("call_id", F.col("next").alias("far"), (F.col("depth") + F.coalesce("more", F.lit(0).cast("long"))).alias("depth"))
        old, (at, path) = path, stash(new, "depth")
        drop(spark, old)
        reach *= 2
    return at.select("call_id", F.when(F.col("far").isNull(), F.col("depth")).alias("depth"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0: a range sort, then the sizes of the ranges before."""
    place = rows.orderBy(*order).withColumn("range_no", F.spark_partition_id()).withColumn("in_range", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    place, _ = stash(place, "ordered")
    sizes = place.groupBy("range_no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(sizes.select("range_no", before.alias("first")))  # a row a range
    return place.join(firsts, "range_no").withColumn(name, F.col("first") + F.col("in_range")).drop("range_no", "in_range", "first")


def least_of(*columns: str) -> Column:
    """The least row over ``columns`` as one struct, nulls last in each: values of one row stay together."""
    return F.min(F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Full join of ``calls(call_id, name, arguments, after[, thread])`` and ``results(call_id, content)``.

    Per identifier: counts of calls and results, ``status`` (linked, pending,
    orphan), ``depth``, ``position`` (topological: behind the call it waits for;
    by depth, thread and identifier, then calls of cycles, then orphans), ``errors``,
    and ``message``, the canonical JSON with the arguments as a nested value (null
    where they do not parse; ``raw_arguments`` then holds the text).

    Calls that share an identifier are one: the least of them as a whole stands, by
    name, arguments, after, with nulls last; of results the least content. Null
    identifiers link with nothing and are dropped. Empty tables and other columns
    are fine; very long arguments are parsed whole.
    """
    if "thread" not in calls.columns:
        calls = calls.withColumn("thread", F.lit(None).cast("string"))
    one = calls.where("call_id is not null").groupBy("call_id").agg(least_of("name", "arguments", "after", "thread").alias("call"), F.count("*").alias("n_calls"))
    one, _ = stash(one.select("call_id", "call.name", "call.arguments", "call.after", "call.thread", "n_calls"), "calls")
    back = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    rows = one.join(call_depth(one).hint("shuffle_hash"), "call_id").join(back.hint("shuffle_hash"), "call_id", "full")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    errors = F.when(F.col("n_calls").isNull(), F.array().cast("array<string>")).otherwise(schema_errors(F.col("name"), F.col("arguments"), schemas))
    value = F.try_parse_json("arguments")
    raw = F.when(value.isNull(), F.col("arguments"))
    rows = rows.select("call_id", "name", "after", "thread", "content", canonical(F.col("arguments")).alias("arguments"), raw.alias("raw_arguments"), F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), status.alias("status"), "depth", errors.alias("errors"))
    rows = numbered(rows, [F.col("status") == "orphan", F.col("depth").asc_nulls_last(), F.col("thread").asc_nulls_last(), F.col("call_id")], "position")
    body = F.to_json(F.struct("after", F.parse_json("arguments").alias("arguments"), "call_id", "content", "depth", "name", "raw_arguments", "status"), {"ignoreNullFields": "true"})
    return rows.withColumn("valid", (F.col("n_calls") > 0) & (F.size("errors") == 0)).withColumn("message", body)


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from plain turns ``(conv_id, turn, role, text)``.

    A user turn asks for ``reply`` and a system turn for ``configure``; the
    assistant turn right after is the result. A call waits for the one two turns
    before it in its conversation, if that is there.
    """
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    rows = turns.where("conv_id is not null and turn is not null")
    asked = rows.where(F.col("role").isin("user", "system"))
    name = F.when(F.col("role") == "user", "reply").otherwise("configure")
    calls = asked.select(ident(0).alias("call_id"), name.alias("name"), F.to_json(F.struct(F.col("text").alias("query"), "turn")).alias("arguments"), ident(2).alias("after"), F.col("conv_id").cast("string").alias("thread"))
    return calls, rows.where("role = 'assistant'").select(ident(1).alias("call_id"), F.col("text").alias("content"))


#: Arguments of the calls read from turns; a question of over 320 characters is an error.
TURN_SCHEMAS: Schemas = {"reply": {"query": ("STRING", True, 320), "turn": ("BIGINT", True)}, "configure": {"query": ("STRING", True), "turn": ("BIGINT", False)}}
