"""Chat formatting by linking tool calls with their results.

A call is an entry of `tool_calls` in an assistant message that is a JSON object, a result is a message of
role tool that names its `tool_call_id`.  In plain chat a user turn is a call of `reply`, and the assistant
turn right after it is the result.  Calls and results are reduced to one row per identifier and hash-joined.
A call may name a call that has to come first (`after`); chains are followed by doubling steps, so a chain of n calls
takes log n joins.  Arguments are checked against the schema of the tool, and every link becomes one line
of canonical JSON: keys in order, no blanks, numbers in one form.  Only column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored

#: Field, allowed JSON types, whether it is required.
SCHEMAS = {"reply": (("prompt", ("string",), True),)}

#: Names of JSON types by how Spark describes the type of a value.
KINDS = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}


def json_type(value: Column) -> Column:
    """The JSON type of a variant; null where there is none."""
    described = F.schema_of_variant(value)
    named = reduce(lambda c, k: c.when(described == k, KINDS[k]), list(KINDS)[1:], F.when(described == "STRING", "string"))
    named = named.when(described.startswith("DECIMAL"), "number").when(described.startswith("OBJECT"), "object").when(described.startswith("ARRAY"), "array")
    return F.when(value.isNotNull(), named)


def problems(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """What is wrong with a call's arguments, as a sorted list; empty if they fit the schema of the tool."""
    keys = F.coalesce(F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>")), F.array().cast("array<string>"))
    whole = json_type(arguments)
    checks = F.when(F.coalesce(whole, F.lit("")) != "object", F.array(F.lit("arguments: not an object")))
    for tool, fields in schemas.items():
        found = []
        for field, kinds, required in fields:
            kind = json_type(F.try_variant_get(arguments, f"$.{field}", "variant"))
            missing = F.lit(f"{field}: missing") if required else F.lit(None).cast("string")
            found.append(F.when(kind.isNull(), missing).when(~kind.isin(*kinds), F.concat(F.lit(f"{field}: "), kind)))
        extra = F.transform(F.array_except(keys, F.array(*(F.lit(f) for f, _, _ in fields))), lambda k: F.concat(k, F.lit(": unexpected")))
        checks = checks.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*found)), extra)))
    return checks.otherwise(F.array(F.lit("unknown tool")))


def calls_of(messages: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, name, arguments (a variant), after: explicit calls, and user turns as calls of reply."""
    parsed = messages.withColumn("json", F.try_parse_json("text"))
    listed = parsed.filter("role = 'assistant'").withColumn("call", F.explode(F.try_variant_get("json", "$.tool_calls", "array<variant>")))
    text = lambda path: F.try_variant_get("call", path, "string")
    explicit = listed.select("conv_id", text("$.id").alias("call_id"), "turn", text("$.name").alias("name"), F.try_variant_get("call", "$.arguments", "variant").alias("arguments"), text("$.after").alias("after"))
    prompt = F.parse_json(F.to_json(F.struct(F.col("text").alias("prompt"))))
    plain = messages.filter("role = 'user'").select("conv_id", F.concat(F.lit("turn-"), F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), prompt.alias("arguments"), F.lit(None).cast("string").alias("after"))
    return explicit.union(plain)


def results_of(messages: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, content: tool messages, and plain assistant turns as results of the turn before."""
    parsed = messages.withColumn("json", F.try_parse_json("text"))
    tool = parsed.filter("role = 'tool'").select(
        "conv_id", F.try_variant_get("json", "$.tool_call_id", "string").alias("call_id"), "turn", F.coalesce(F.to_json(F.try_variant_get("json", "$.content", "variant")), F.to_json(F.struct(F.col("text").alias("text")))).alias("content")
    )
    calling = F.try_variant_get("json", "$.tool_calls", "array<variant>").isNotNull()
    plain = parsed.filter((F.col("role") == "assistant") & ~calling).select("conv_id", F.concat(F.lit("turn-"), F.col("turn") - 1).alias("call_id"), "turn", F.to_json(F.struct(F.col("text").alias("text"))).alias("content"))
    return tool.union(plain)


def one_each(rows: DataFrame, prefix: str, values: list[str]) -> DataFrame:
    """One row per conversation and identifier: the earliest, by content among those of one turn, and their number."""
    first = F.min(F.struct(F.col("turn").isNull().alias("late"), "turn", *values)).alias("first")
    grouped = rows.groupBy("conv_id", "call_id").agg(first, F.count("*").alias("n"))
    return grouped.select(F.col("conv_id").alias(f"{prefix}_conv"), F.col("call_id").alias(f"{prefix}_id"), F.col("first.turn").alias(f"{prefix}_turn"), *(F.col(f"first.{v}").alias(v) for v in values), F.col("n").alias(f"{prefix}s"))


def ordered(linked: DataFrame) -> DataFrame:
    """linked with order_turn and depth: sorted by (order_turn, depth, call_turn) a call comes behind the one it names in `after`.

    Calls on a cycle, or behind one, have depth -1 and keep their own turn.
    """
    base = linked.select("conv_id", "call_id", F.col("after").alias("at"), F.coalesce("call_turn", "result_turn").alias("order_turn"), F.when(F.col("after").isNull(), 0).otherwise(1).alias("depth"))
    if linked.filter("after IS NOT NULL").isEmpty():
        return linked.withColumns({"order_turn": F.coalesce("call_turn", "result_turn"), "depth": F.lit(0)})
    steps, rounds, most = stored(base, "steps"), 0, linked.count()
    while rounds <= most.bit_length() and not steps.filter("at IS NOT NULL").isEmpty():
        ahead = steps.select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id"), F.col("at").alias("a_at"), F.col("order_turn").alias("a_turn"), F.col("depth").alias("a_depth"))
        same = F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("at") == F.col("a_id"))
        steps = stored(
            steps.join(ahead, same, "left").select(
                "conv_id", "call_id", F.col("a_at").alias("at"), F.greatest("order_turn", F.coalesce("a_turn", "order_turn")).alias("order_turn"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth")
            ),
            "steps",
        )
        rounds += 1
    final = steps.select(F.col("conv_id").alias("s_conv"), F.col("call_id").alias("s_id"), F.col("at").alias("open"), F.col("order_turn").alias("s_turn"), F.col("depth").alias("s_depth"))
    joined = linked.join(final, F.col("conv_id").eqNullSafe(F.col("s_conv")) & F.col("call_id").eqNullSafe(F.col("s_id")))
    cyclic = F.col("open").isNotNull()
    return joined.withColumns({"order_turn": F.when(cyclic, F.coalesce("call_turn", "result_turn")).otherwise(F.col("s_turn")), "depth": F.when(cyclic, -1).otherwise(F.col("s_depth"))}).drop("s_conv", "s_id", "open", "s_turn", "s_depth")


def format_chats(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call or result without a call, in an order that puts calls before what needs them.

    messages needs conv_id, turn, role and text; other columns are ignored, messages of other roles are neither
    call nor result.  Repeated identifiers in a conversation are one row with the earliest call and result and
    their numbers.  status is linked, unanswered, orphan (a result alone) or early (a result before its call).
    A null text is a call without its prompt, or a result without text; rows with null conv_id are one
    conversation.  An empty table gives no rows.
    """
    needed = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    calls = calls_of(needed).withColumn("arguments", F.to_json("arguments"))
    calls = one_each(calls, "call", ["name", "arguments", "after"])
    results = one_each(results_of(needed), "result", ["content"])
    same = F.col("call_conv").eqNullSafe(F.col("result_conv")) & F.col("call_id").eqNullSafe(F.col("result_id"))
    both = calls.hint("shuffle_hash").join(results, same, "full")
    both = both.select(
        F.when(F.col("calls").isNotNull(), F.col("call_conv")).otherwise(F.col("result_conv")).alias("conv_id"),
        F.when(F.col("calls").isNotNull(), F.col("call_id")).otherwise(F.col("result_id")).alias("call_id"),
        "name", "arguments", "after", "content", "call_turn", "result_turn",
        F.coalesce("calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("results", F.lit(0)).cast("long").alias("n_results"),
    )
    status = F.when(F.col("n_results") == 0, "unanswered").when(F.col("n_calls") == 0, "orphan").when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    variant = F.try_parse_json("arguments")
    found = F.when(F.col("n_calls") > 0, problems(F.coalesce("name", F.lit("")), variant, schemas)).otherwise(F.array().cast("array<string>"))
    record = F.to_json(F.struct(variant.alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.try_parse_json("content").alias("result")))
    done = ordered(stored(both, "links")).withColumns({"status": status, "found": found, "record": record})
    return done.select(
        "conv_id", "call_id", "order_turn", "depth", "call_turn", "result_turn", "n_calls", "n_results", "status",
        (F.size("found") == 0).alias("valid"), F.array_join("found", "; ").alias("problems"), "record",
    )


def every_message(messages: DataFrame) -> DataFrame:
    """Every message in turn order, nothing merged: one row per call, result and message without a link.

    A row is placed by (conv_id, turn, part).  System messages, messages of other roles, and what an assistant or tool
    message holds beside its calls or result are rows of kind message and status unlinked.  Each call and result
    of an identifier is a row of its own, with the numbers and the status of the identifier as in format_chats.
    """
    needed = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    parsed = needed.withColumn("json", F.when(F.col("role").isin("assistant", "tool"), F.try_parse_json("text")))
    parsed = parsed.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("json", "$.tool_calls", "array<variant>")))
    fields = F.try_variant_get("json", "$", "map<string,variant>")
    content = F.to_json(F.try_variant_get("json", "$.content", "variant"))
    answers = (F.col("role") == "tool") & content.isNotNull()
    said = F.when(F.col("calls").isNotNull(), F.map_filter(fields, lambda k, _: k != "tool_calls")).when(answers, F.map_filter(fields, lambda k, _: ~k.isin("tool_call_id", "content")))
    reply = lambda turn: F.concat(F.lit("turn-"), turn)

    def piece(kind: str, call_id: Column, record: Column) -> Column:
        return F.struct(F.lit(0).alias("part"), F.lit(kind).alias("kind"), call_id.cast("string").alias("call_id"), record.alias("record"))

    def result(call_id: Column, value: Column) -> Column:
        return piece("result", call_id, F.to_json(F.struct(call_id.alias("id"), F.try_parse_json(value).alias("result"))))

    text = F.to_json(F.struct(F.col("text").alias("text")))
    prompt = F.struct(F.struct(F.col("text").alias("prompt")).alias("arguments"), reply(F.col("turn")).alias("id"), F.lit("reply").alias("name"))
    own = F.when(F.col("role") == "user", piece("call", reply(F.col("turn")), F.to_json(prompt)))
    own = own.when(F.col("role") == "tool", result(F.try_variant_get("json", "$.tool_call_id", "string"), F.coalesce(content, text)))
    own = own.when((F.col("role") == "assistant") & F.col("calls").isNull(), result(reply(F.col("turn") - 1), text))
    own = own.when(F.col("role").isin("user", "tool", "assistant"), None).otherwise(piece("message", F.lit(None), text))
    beside = F.when((F.size(said) > 0) | (F.size("calls") == 0), piece("message", F.lit(None), F.to_json(said)))
    listed = F.transform(
        "calls", lambda c, i: F.struct((i + 1).alias("part"), F.lit("call").alias("kind"), F.try_variant_get(c, "$.id", "string").alias("call_id"), F.to_json(c).alias("record"))
    )
    pieces = F.concat(F.array_compact(F.array(own, beside)), F.coalesce(listed, F.array().cast("array<struct<part:int,kind:string,call_id:string,record:string>>")))
    rows = stored(parsed.withColumn("x", F.explode(pieces)).select("conv_id", "turn", "role", "x.*"), "messages")

    turn_of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("turn")))
    number = lambda kind: F.count(F.when(F.col("kind") == kind, True))
    linkable = rows.filter("kind <> 'message'")
    links = linkable.groupBy(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_id")).agg(
        turn_of("call").alias("call_turn"), turn_of("result").alias("result_turn"), number("call").alias("n_calls"), number("result").alias("n_results")
    )
    status = F.when(F.col("n_results") == 0, "unanswered").when(F.col("n_calls") == 0, "orphan").when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    same = F.col("conv_id").eqNullSafe(F.col("l_conv")) & F.col("call_id").eqNullSafe(F.col("l_id"))
    columns = ["conv_id", "turn", "part", "role", "kind", "call_id", "n_calls", "n_results", "status", "record"]
    alone = rows.filter("kind = 'message'").withColumns({"n_calls": F.lit(0).cast("long"), "n_results": F.lit(0).cast("long"), "status": F.lit("unlinked")})
    return linkable.join(links, same).withColumn("status", status).select(columns).unionByName(alone.select(columns))
