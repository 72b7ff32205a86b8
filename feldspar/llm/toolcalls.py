"""Chat formatting: tool calls linked to their results, put in dependency order, validated and written as
canonical JSON.  DataFrame functions only.

Calls and results meet in a shuffled hash join on the call's identifier, whose hash tables hold a row for each identifier; of several results of one identifier a call's record has
the earliest (by turn, then content) and their number, and further_results() gives the others, a row each with its rank.  A call names any number of calls that it comes after; its position is
the length of the longest chain up to it.  Calls with one predecessor are followed by pointer doubling, so that a chain of n calls
takes log2(n) joins; calls with several are then placed in rounds, as many as stand behind one another.  No
conversation is gathered in one task.  Arguments are parsed to variants and checked against a schema for each tool.
Canonical JSON has sorted keys and no white space.

Rules: a call without identifier is never linked and has position 0.  Of several calls of one identifier each gets
its own row and the same result; the identifier comes after all that they name.  Calls on a cycle or behind one have a
null position and the error `cycle`.  A predecessor that doesn't exist counts as none.  Results without a call get a row of
kind `result`.  Turns that are neither call nor result (system turns, other roles) give no row.  Null and empty arguments are invalid; a missing or null argument is an error only where it is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kind, pick, remove, written

#: For each tool its arguments: (variant type, required, may be empty).
Schemas = dict[str, dict[str, tuple[str, bool, bool]]]
CHAT: Schemas = {"reply": {"prompt": ("STRING", True, False), "turn": ("BIGINT", True, True)}}


def positions(nodes: DataFrame) -> DataFrame:
    """Of id and after (an array): id and position, the longest way from an id that comes after none, null on cycles and behind them."""
    pairs = nodes.where("id is not null").select("id", F.explode_outer("after").alias("after"))
    known = pairs.select(F.col("id").alias("after"), F.col("id").alias("at")).distinct()
    pairs = pairs.join(known, "after", "left").select("id", "at")
    ends = pairs.groupBy("id").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    single = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    # base: the id without or with several predecessors to which single ones lead back
    now = written(ends.select("id", F.when(single, F.col("low")).alias("at"), F.when(~single, F.col("id")).alias("base"), single.cast("long").alias("position"), F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("many")), "chain")
    total, reach = now.count(), 1
    while now.where("at is not null").limit(1).count() and reach < 2 * total:
        step = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("base").alias("found"), F.col("position").alias("more"))
        new = now.join(step, "at", "left").select("id", F.col("next").alias("at"), F.coalesce("base", "found").alias("base"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"), "many")
        new = written(new, "chain")
        remove(now)
        now, reach = new, reach * 2
    if not now.where("many").limit(1).count():
        return now.select("id", F.when(F.col("at").isNull(), F.col("position")).alias("position"))
    return now.join(_levels(pairs, now), "base", "left").select("id", (F.col("level") + F.col("position")).alias("position"))


def _levels(pairs: DataFrame, now: DataFrame) -> DataFrame:
    """base and level of the ids without or with several predecessors.  In each round those whose predecessors are all placed
    get their level; what is left when a round places none is on a cycle or behind one."""
    spot = now.select(F.col("id").alias("at"), "base", F.when(F.col("at").isNull(), F.col("position") + 1).alias("weight"))
    open_ = pairs.join(now.where("many").select("id"), "id").join(spot, "at").groupBy("id", "base").agg(F.max("weight").alias("weight"))
    open_ = written(open_.withColumn("way", F.lit(None).cast("long")), "ways")
    front = written(now.where("base = id and not many").select("base", F.lit(0).cast("long").alias("level")), "levels")
    levels, old = [front], open_
    while True:
        ways = open_.join(front.withColumnRenamed("level", "new"), "base", "left").select("id", "base", "weight", F.coalesce("way", F.col("new") + F.col("weight")).alias("way"))
        ways = written(ways, "ways")
        remove(old)
        front = written(ways.groupBy("id").agg(F.max("way").alias("level"), F.count_if(F.col("way").isNull()).alias("n")).where("n = 0").select(F.col("id").alias("base"), "level"), "levels")
        if not front.limit(1).count():
            remove(ways, front)
            break
        levels.append(front)
        open_, old = ways.join(front.select(F.col("base").alias("id")), "id", "left_anti"), ways
        if len(levels) == 32:  # few tables in the plan
            whole = written(_union(levels), "levels")
            remove(*[t for t in levels if t is not front])
            levels = [whole]
    return _union(levels)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call, as an array of strings."""
    found = [F.when(arguments.isNull(), F.lit("arguments: not JSON")), F.when(name.isNull() | ~name.isin(*schemas), F.lit("name: unknown"))]
    given = F.try_variant_get(arguments, "$", "map<string,variant>")
    found.append(F.when(arguments.isNotNull() & given.isNull(), F.lit("arguments: not an object")))
    for tool, fields in schemas.items():
        mine = (name == tool) & given.isNotNull()
        for field, (kind, required, empty) in fields.items():
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            type_ = F.schema_of_variant(value)
            absent = value.isNull() | (type_ == "VOID")
            if required:
                found.append(F.when(mine & absent, F.lit(f"{field}: missing")))
            found.append(F.when(mine & ~absent & (type_ != kind), F.lit(f"{field}: not {kind}")))
            if not empty:
                found.append(F.when(mine & (type_ == "STRING") & (F.try_variant_get(arguments, f"$.{field}", "string") == ""), F.lit(f"{field}: empty")))
        extra = F.array_except(F.map_keys(given), F.array(*[F.lit(f) for f in fields]))
        found.append(F.when(mine & (F.size(extra) > 0), F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
    return F.array_compact(F.array(*found))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON text), after (an identifier or an array of them).  results: conv_id, turn, call_id, content.
    One row for each call and for each result without one: kind, conv_id, turn, call_id, name, linked, n_results, position, valid, record."""
    calls = pick(calls, "conv_id", "turn", "call_id", "name", "arguments", "after")
    if kind(calls, "after") == "string":
        calls = calls.withColumn("after", F.array("after"))
    results = pick(results, "conv_id", "turn", "call_id", "content")
    first = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(F.col("turn").alias("result_turn"), F.col("content").alias("result"))).alias("r"), F.count(F.lit(1)).alias("n_results"))
    place = positions(calls.select(F.col("call_id").alias("id"), "after"))
    rows = calls.withColumn("arguments", F.try_parse_json("arguments")).join(first.hint("shuffle_hash"), "call_id", "left").join(place.withColumnRenamed("id", "call_id").hint("shuffle_hash"), "call_id", "left")
    cycle = F.col("call_id").isNotNull() & F.col("position").isNull()
    wrong = F.concat(errors(F.col("name"), F.col("arguments"), schemas), F.when(cycle, F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("errors", wrong).withColumn("position", F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("position")))
    record = F.struct("arguments", "call_id", "conv_id", "errors", "name", "position", F.col("r.result").alias("result"), F.col("r.result_turn").alias("result_turn"), "turn")
    made = rows.select(
        F.lit("call").alias("kind"), "conv_id", "turn", "call_id", "name", F.col("n_results").isNotNull().alias("linked"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "position",
        (F.size("errors") == 0).alias("valid"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"),
    )
    alone = results.join(calls.select(F.col("call_id").alias("id")).where("id is not null").distinct().hint("shuffle_hash"), F.col("call_id") == F.col("id"), "left_anti")
    record = F.struct("call_id", "conv_id", F.col("content").alias("result"), "turn")
    return made.unionByName(
        alone.select(
            F.lit("result").alias("kind"), "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("linked"), F.lit(1).cast("long").alias("n_results"), F.lit(None).cast("long").alias("position"),
            F.lit(False).alias("valid"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"),
        )
    )


def further_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that link_calls leaves out of its records: of each identifier with a call all but the earliest, with the same
    columns; the record has the rank by turn, content and conversation.  Ranks are counted in ranges of that order, so that an
    identifier with very many results is dealt over many tasks."""
    calls, results = pick(calls, "call_id"), pick(results, "conv_id", "turn", "call_id", "content")
    many = results.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results")).where("n_results > 1").join(calls, "call_id", "left_semi")
    order = ["turn", "content", "conv_id"]
    dealt = written(results.join(many, "call_id").repartitionByRange("call_id", *order).withColumn("part", F.spark_partition_id()), "results")
    earlier = Window.partitionBy("call_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("call_id", "part").agg(F.count(F.lit(1)).alias("n")).select("call_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("call_id", "part").orderBy(*order))
    ranked = dealt.withColumn("own", own).join(before, ["call_id", "part"]).withColumn("rank", F.col("own") + F.col("before")).where("rank > 1")
    record = F.struct("call_id", "conv_id", "rank", F.col("content").alias("result"), "turn")
    return ranked.select(
        F.lit("result").alias("kind"), "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(True).alias("linked"), "n_results", F.lit(None).cast("long").alias("position"),
        F.lit(False).alias("valid"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"),
    )


_CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: variant>>>"
_RESULT = "struct<tool_call_id: string, content: string>"


def chat_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of conv_id, turn, role, text.  A user's turn calls the tool `reply`, after the user's
    turn before the last; the assistant's next turn is its result.  The assistant's messages that are JSON with tool_calls (not an empty
    array), and those of role tool with tool_call_id, are the calls and results that they say; JSON of a user is what the user said."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    said = rows.withColumns({"c": F.when((F.col("role") == "assistant") & F.col("text").startswith("{"), F.from_json("text", _CALLS)), "r": F.when((F.col("role") == "tool") & F.col("text").startswith("{"), F.from_json("text", _RESULT))})

    def id_(back: int) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))

    plain = F.col("c.tool_calls").isNull() | (F.size("c.tool_calls") == 0)
    asked = said.where((F.col("role") == "user") & plain).select("conv_id", "turn", id_(0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.array(id_(2)).alias("after"))
    called = said.where("c.tool_calls is not null").select("conv_id", "turn", F.explode("c.tool_calls").alias("t")).select("conv_id", "turn", F.col("t.id").alias("call_id"), "t.name", "t.arguments", F.coalesce(F.try_variant_get("t.after", "$", "array<string>"), F.array(F.try_variant_get("t.after", "$", "string"))).alias("after"))
    answered = said.where((F.col("role") == "assistant") & plain).select("conv_id", "turn", id_(1).alias("call_id"), F.col("text").alias("content"))
    returned = said.where("r.tool_call_id is not null").select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), "r.content")
    return asked.unionByName(called), answered.unionByName(returned)


def op7_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_calls(calls, results, CHAT).unionByName(further_results(calls, results))


QUERIES = {"op7_toolcalls": op7_toolcalls}
ORACLE_SQL = {
    "op7_toolcalls": """
with recursive c as (
  select conv_id, turn, conv_id || ':' || turn as call_id, conv_id || ':' || (turn - 2) as after, text from conversations where role = 'user'),
r as (select conv_id, turn, conv_id || ':' || (turn - 1) as call_id, text from conversations where role = 'assistant'),
first as (
  select call_id, count(*) as n_results, min(turn) as result_turn, min(text) as result from r where call_id is not null group by call_id),
place as (
  select call_id, 0::bigint as position from c where after is null or after not in (select call_id from c where call_id is not null)
  union all select c.call_id, position + 1 from c join place on c.after = place.call_id),
rows as (
  select c.*, n_results, result_turn, result, coalesce(position, 0) as position,
    list_filter([case when text is null then 'prompt: missing' when text = '' then 'prompt: empty' end, case when turn is null then 'turn: missing' end], lambda x: x is not null) as errors
  from c left join first using (call_id) left join (select distinct * from place) using (call_id))
select 'call' as kind, conv_id, turn, call_id, 'reply' as name, n_results is not null as linked, coalesce(n_results, 0)::bigint as n_results, position, len(errors) = 0 as valid,
  '{"arguments":{' || concat_ws(',', '"prompt":' || to_json(text)::varchar, '"turn":' || turn) || '},"call_id":' || coalesce(to_json(call_id)::varchar, 'null') || ',"conv_id":' || coalesce(conv_id::varchar, 'null')
  || ',"errors":' || to_json(errors)::varchar || ',"name":"reply","position":' || position || ',"result":' || coalesce(to_json(result)::varchar, 'null') || ',"result_turn":' || coalesce(result_turn::varchar, 'null')
  || ',"turn":' || coalesce(turn::varchar, 'null') || '}' as record
from rows
union all
select 'result', conv_id, turn, call_id, null, false, 1, null, false,
  '{"call_id":' || coalesce(to_json(call_id)::varchar, 'null') || ',"conv_id":' || coalesce(conv_id::varchar, 'null') || ',"result":' || coalesce(to_json(text)::varchar, 'null') || ',"turn":' || coalesce(turn::varchar, 'null') || '}'
from r where call_id is null or call_id not in (select call_id from c where call_id is not null)
"""
}
