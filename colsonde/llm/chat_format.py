"""Chat formatting with tool calls linked to their results; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colsonde.llm import common

_CALLS = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"

#: The default tools: (name, argument, type, required, the values it may have or None for any).
TOOLS = (
    ("search", "query", "string", True, None),
    ("search", "limit", "integer", False, None),
    ("search", "filter", "object", False, None),
    ("search", "filter.lang", "string", False, ("en", "de", "fr", "es")),
    ("search", "sources", "string[]", False, None),
    ("calculate", "expression", "string", True, None),
    ("weather", "city", "string", True, None),
    ("weather", "days", "integer", False, None),
)


def tool_table(spark, tools=TOOLS) -> DataFrame:
    """(name, arg, type, required, choices): arguments of nested objects have dotted names."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    listed = lambda c: "null" if c is None else f"array({', '.join(map(text, c))})"
    rows = ", ".join(f"({text(name)}, {text(arg)}, '{kind}', {str(required).lower()}, cast({listed(choices)} AS array<string>))" for name, arg, kind, required, choices in tools)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS tools(name, arg, type, required, choices)")


def _messages(conversations: DataFrame) -> DataFrame:
    """One row a distinct message, named by __m; __conv tells conversations apart, null ids each on their own."""
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), common.text_of().alias("text"))
    rows = rows.withColumn("__sha", F.sha2("text", 256))
    own = F.when(F.col("conv_id").isNull(), F.to_json(F.struct("turn", "role", "__sha")))
    rows = rows.withColumn("__conv", F.struct(F.col("conv_id").alias("id"), own.alias("own")))
    rows = rows.withColumn("__m", F.sha2(F.to_json(F.struct("__conv", "turn", "role", "__sha")), 256)).dropDuplicates(["__m"])
    linking = F.ltrim("text").startswith("{") & (F.col("text").contains('"tool_calls"') | F.col("text").contains('"tool_call_id"'))
    rows = rows.withColumn("__p", F.when(linking & F.col("role").isin("assistant", "tool"), F.from_json("text", _CALLS)))
    rows = rows.withColumn("__calls", F.when(F.size("__p.tool_calls") > 0, F.col("__p.tool_calls")))
    return rows.withColumn("__link", F.when(F.col("role") == "tool", F.col("__p.tool_call_id"))).withColumn(
        "content", F.when(F.col("__calls").isNotNull(), F.col("__p.content")).when(F.col("__link").isNotNull(), F.coalesce("__p.content", F.lit(""))).otherwise(F.col("text"))
    ).drop("__p")


def _number(x: Column) -> Column:
    """A JSON number in the one form of its value: whole ones as digits, others as shortest decimals."""
    plain = F.regexp_replace(x, "^-0$", "0")
    d = x.try_cast("double")
    size = F.abs(d)
    java = F.lower(d.cast("string"))
    short = F.regexp_replace(F.regexp_replace(java, r"\.0(e|$)", "$1"), r"e(\d)", "e+$1")
    middle = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,22)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = d.cast("decimal(38,0)").cast("string")
    return (
        F.when(x.rlike(r"^-?\d+$"), plain)
        .when(size == 0, "0")
        .when((size < 1e21) & (size % 1 == 0), whole)
        .when((size >= 1e-6) & (size < 1e15), middle)
        .otherwise(F.coalesce(short, x))
    )


def canonical(text: Column) -> Column:
    """JSON text of a variant (keys sorted, no white space) with its numbers in one form each."""
    pieces = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|[^"\d-]+'), F.lit(0))
    one = lambda x: F.when(x.rlike(r"^-?\d"), _number(x)).otherwise(x)
    return F.when(text.rlike(r"\d"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _fits(value: Column, type_: Column) -> Column:
    """Whether a variant is of a type: string, integer, number, boolean, object, array, or lists of the first three."""
    kind = F.schema_of_variant(value)
    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"
    whole = F.to_json(value).try_cast("double")
    return F.coalesce(
        F.when(type_ == "string", kind == "STRING")
        .when(type_ == "integer", kind.rlike(number) & (whole % 1 == 0))
        .when(type_ == "number", kind.rlike(number))
        .when(type_ == "boolean", kind == "BOOLEAN")
        .when(type_ == "object", kind.startswith("OBJECT"))
        .when(type_ == "array", kind.startswith("ARRAY"))
        .when(type_ == "string[]", kind.isin("ARRAY<STRING>", "ARRAY<VOID>"))
        .when(type_ == "integer[]", kind.isin("ARRAY<BIGINT>", "ARRAY<VOID>"))
        .when(type_ == "number[]", kind.rlike(r"^ARRAY<(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))>$")),
        F.lit(False),
    )


def _checked_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row a call: (__m, n, id, name, arguments canonical or as given, valid)."""
    calls = messages.where("__calls IS NOT NULL").select("__m", F.posexplode("__calls").alias("n", "call"))
    calls = calls.select("__m", "n", F.col("call.id").alias("id"), F.col("call.name").alias("name"), F.coalesce("call.arguments", F.lit("{}")).alias("given"))
    calls = calls.withColumn("__v", F.try_parse_json("given"))
    calls = calls.withColumn("__is_object", F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)))
    given = F.json_object_keys(F.when(F.col("__is_object"), F.to_json("__v")))
    known = tools.groupBy("name").agg(F.collect_list(F.struct("arg", "type", "required", "choices")).alias("__schema"))
    joined = calls.withColumn("__given", F.coalesce(given, F.array().cast("array<string>"))).join(known, "name", "left")

    def fits(a):
        path = lambda arg: F.concat(F.lit("$['"), F.replace(arg, F.lit("."), F.lit("']['")), F.lit("']"))
        value = F.try_variant_get("__v", path(a["arg"]), "variant")
        chosen = a["choices"].isNull() | F.coalesce(F.array_contains(a["choices"], F.try_variant_get("__v", path(a["arg"]), "string")), F.lit(False))
        return F.when(value.isNotNull(), _fits(value, a["type"]) & chosen).otherwise(~a["required"])

    names = F.transform("__schema", lambda a: F.split_part(a["arg"], F.lit("."), F.lit(1)))
    valid = F.col("__schema").isNotNull() & F.col("__is_object") & F.forall("__schema", fits) & (F.size(F.array_except("__given", names)) == 0)
    arguments = F.when(F.col("__v").isNotNull(), canonical(F.to_json("__v"))).otherwise(F.col("given"))
    return joined.select("__m", "n", "id", "name", arguments.alias("arguments"), F.coalesce(valid, F.lit(False)).alias("valid"))


def _ranged(df: DataFrame, label: str, *order) -> DataFrame:
    """``df`` in ranges of an order, however large a key: __pid numbers them, and is settled with the rows."""
    return common.settle(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), label)


def _answered(messages: DataFrame) -> DataFrame:
    """(__m, parent): each result's message and the message whose call it answers.

    Calls and results are hash-joined by conversation and identifier: a result answers the last
    call of its identifier that stands before it or in its turn, or else the first after. A hot
    identifier is split into ranges, over which the last call so far is carried.
    """
    cols = ["__conv", "id", "turn", "kind", "role", "__sha", "__m"]
    calls = messages.where("__calls IS NOT NULL").select("*", F.explode("__calls.id").alias("id"), F.lit(0).alias("kind")).where("id IS NOT NULL").select(cols).distinct()
    results = messages.where("__link IS NOT NULL").select("*", F.col("__link").alias("id"), F.lit(1).alias("kind")).select(cols)
    events = _ranged(calls.unionByName(results), "chat-events", *cols[:-1])
    order = F.struct("turn", "role", "__sha")
    here = Window.partitionBy("__pid", "__conv", "id").orderBy("turn", "kind", "role", "__sha").rowsBetween(Window.unboundedPreceding, 0)
    call = F.when(F.col("kind") == 0, F.col("__m"))
    found = events.withColumn("local", F.last(call, ignorenulls=True).over(here)).where("kind = 1")
    per = events.where("kind = 0").groupBy("__conv", "id", "__pid").agg(F.max_by("__m", order).alias("last"), F.min(F.struct(order.alias("o"), "__m")).alias("first"))
    pids = events.groupBy("__conv", "id", "__pid").agg(F.lit(1).alias("one")).join(per, ["__conv", "id", "__pid"], "left")
    upto = Window.partitionBy("__conv", "id").orderBy("__pid")
    carried = pids.select(
        "__conv", "id", "__pid", F.last("last", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.min("first").over(Window.partitionBy("__conv", "id")).alias("first"),
    )
    parent = F.coalesce("local", "carried", "first.__m")
    return found.join(carried, ["__conv", "id", "__pid"]).select("__m", parent.alias("parent")).where("parent IS NOT NULL")


def _chains(messages: DataFrame, answered: DataFrame) -> DataFrame:
    """(__m, place, depth, cyclic) of messages that answer a call or are answered.

    ``place`` is the largest turn along the chain of messages whose calls led to this one, and
    ``depth`` the chain's length, both by pointer jumping. Messages on a cycle (each answers a
    call of the next) lose their link for the order.
    """
    turns = messages.select("__m", "turn")
    links = answered.where("__m <> parent")
    nodes = links.select("__m").unionByName(links.select(F.col("parent").alias("__m"))).distinct().join(turns, "__m").join(links, "__m", "left")
    start = common.settle(nodes.select("__m", F.col("parent").alias("up"), F.col("turn").alias("place"), F.col("parent").isNotNull().cast("int").alias("depth")), "chat-links")

    def resolved(state: DataFrame) -> tuple[DataFrame, int]:
        before, left = None, state.where("up IS NOT NULL").count()
        while left and left != before:
            a, b = state.alias("a"), state.alias("b")
            state = common.settle(a.join(b, F.col("a.up") == F.col("b.__m"), "left").select(
                "a.__m", F.col("b.up").alias("up"), F.greatest("a.place", "b.place").alias("place"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth")), "chat-links")
            before, left = left, state.where("up IS NOT NULL").count()
        return state, left

    state, left = resolved(start)
    if not left:
        return state.select("__m", "place", "depth", F.lit(False).alias("cyclic"))
    # Jumps were at least as many as any chain is long, so what they end at lies on cycles.
    cycle = state.where("up IS NOT NULL").select(F.col("up").alias("__m")).distinct().withColumn("cyclic", F.lit(True))
    cycle = common.settle(cycle, "chat-cycles")
    cut = start.join(cycle, "__m", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    free = cut.select("__m", F.when(~F.col("cyclic"), F.col("up")).alias("up"), "place", F.when(F.col("cyclic"), 0).otherwise(F.col("depth")).alias("depth"))
    state, _ = resolved(common.settle(free, "chat-links"))
    return state.select("__m", "place", "depth").join(cycle, "__m", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def format_chats(conversations: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One row a message of a conversation, numbered in topological order, as canonical JSON.

    A text of role ``assistant`` or ``tool`` that is an object with ``tool_calls`` (id, name,
    arguments) makes calls; one of role ``tool`` with ``tool_call_id`` (and content) is a result.
    A result answers the last call of its identifier in its conversation before it or in its
    turn, else the first after. Messages keep the order of their turns, except that none comes
    before the message whose call it answers, nor before that one's own, and so on; of messages
    that answer each other in a cycle, none moves. Results without a call are orphans.

    Arguments are checked against ``tools`` (name, arg, type, required, choices; see
    :func:`tool_table`): a call is invalid if its tool or an argument is unknown, a required one is
    missing, or a value is not of its type or choices. 3.0 is an integer. Names in ``tools`` must
    not hold quotes.

    Columns: conv_id, seq (from 0 within the conversation), turn, n_calls, n_invalid, linked,
    orphan, cyclic, message: an object, keys sorted, no white space, null fields left out;
    arguments are JSON text of the same kind, whole numbers as digits and others as shortest
    decimals, or the text as given if it is no JSON (or names a key twice).
    Rows are written in the order of conv_id and seq as JSON lines. Rows of one conversation
    spread over tasks: it may be of any length. Exact repeats of a message are one message; null
    texts and roles are ''; null turns come first; rows of null conv_id are conversations of
    their own; further columns are left out; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    tools = tool_table(spark) if tools is None else tools
    messages = common.settle(_messages(conversations), "chat-messages")
    linking = messages.where("__calls IS NOT NULL OR __link IS NOT NULL")
    calls = _checked_calls(linking, tools).groupBy("__m").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "arguments", "id", "name"))), lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))).alias("tool_calls"),
        F.count(F.lit(1)).alias("n_calls"), F.count_if(~F.col("valid")).alias("n_invalid"),
    )
    answered = common.settle(_answered(linking), "chat-answered")
    chains = _chains(linking, answered)
    more = linking.select("__m").join(calls, "__m", "left").join(answered.select("__m", F.lit(True).alias("linked")), "__m", "left").join(chains, "__m", "left")
    joined = messages.join(more, "__m", "left")
    placed = joined.select(
        "__conv", "conv_id", F.when(F.col("depth") > 0, F.col("place")).otherwise(F.col("turn")).alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"), "turn", "role", "__sha",
        F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"), F.coalesce("n_invalid", F.lit(0)).cast("bigint").alias("n_invalid"),
        F.coalesce("linked", F.lit(False)).alias("linked"), (F.col("__link").isNotNull() & F.col("linked").isNull()).alias("orphan"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.to_json(F.struct("content", "role", F.col("__link").alias("tool_call_id"), "tool_calls")).alias("message"),
    )
    order = ["place", "depth", "turn", "role", "__sha"]
    ranged = _ranged(placed, "chat-ranges", "__conv", *order)
    counts = ranged.groupBy("__conv", "__pid").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__conv").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # Of use for conversations that lie across a border, so there are fewer rows than ranges.
    shifts = counts.select("__conv", "__pid", F.sum("n").over(earlier).alias("shift")).where("shift IS NOT NULL")
    within = F.row_number().over(Window.partitionBy("__conv", "__pid").orderBy(*order)) - 1
    out = ranged.withColumn("within", within).join(shifts, ["__conv", "__pid"], "left")
    seq = (F.col("within") + F.coalesce("shift", F.lit(0))).cast("bigint")
    return out.select("conv_id", seq.alias("seq"), "turn", "n_calls", "n_invalid", "linked", "orphan", "cyclic", "message")


def digest(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations)


def _sql() -> str:
    """Links by correlated aggregates, chains by recursion; arguments are taken to be written canonically below their first level."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    tools = ", ".join(f"({text(n)}, {text(a)}, '{t}', {r}, {'NULL' if c is None else '[' + ', '.join(map(text, c)) + ']'})" for n, a, t, r, c in TOOLS)
    least = "-9223372036854775808"
    field = lambda name, value: f"'\"{name}\":' || to_json({value})::VARCHAR"
    return f"""
WITH RECURSIVE raw AS (SELECT DISTINCT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
m AS (SELECT *, sha256(text) AS sha, CASE WHEN conv_id IS NULL THEN concat(turn, '/', role, '/', sha256(text)) ELSE '' END AS own,
      row_number() OVER (ORDER BY turn NULLS FIRST, role, sha256(text), conv_id) AS k,
      role IN ('assistant', 'tool') AND ltrim(text) LIKE '{{%' AND (contains(text, '"tool_calls"') OR contains(text, '"tool_call_id"')) AND json_valid(text) AS js FROM raw),
p AS (SELECT *, CASE WHEN js AND json_array_length(text, '$.tool_calls') > 0 THEN json_extract(text, '$.tool_calls') END AS calls,
      CASE WHEN js AND role = 'tool' THEN json_extract_string(text, '$.tool_call_id') END AS link FROM m),
c AS (SELECT k, conv_id, own, turn, n, json_extract_string(calls, '$[' || n || '].id') AS id, json_extract_string(calls, '$[' || n || '].name') AS name,
      coalesce(json_extract_string(calls, '$[' || n || '].arguments'), '{{}}') AS given
      FROM (SELECT *, unnest(range(json_array_length(calls)::BIGINT)) AS n FROM p WHERE calls IS NOT NULL)),
tools(name, arg, type, required, choices) AS (VALUES {tools}),
a AS (SELECT *, CASE WHEN json_valid(given) THEN json_type(given) ELSE '' END = 'OBJECT' AS is_object, CASE WHEN json_valid(given) AND json_type(given) = 'OBJECT' THEN given ELSE '{{}}' END AS v FROM c),
f AS (SELECT a.k, a.n, bool_and(CASE WHEN json_extract(v, '$.' || arg) IS NULL THEN NOT required ELSE (CASE type
        WHEN 'string' THEN json_type(v, '$.' || arg) = 'VARCHAR' WHEN 'object' THEN json_type(v, '$.' || arg) = 'OBJECT'
        WHEN 'integer' THEN json_type(v, '$.' || arg) IN ('BIGINT', 'UBIGINT') OR (json_type(v, '$.' || arg) = 'DOUBLE' AND json_extract_string(v, '$.' || arg)::DOUBLE % 1 = 0)
        WHEN 'string[]' THEN json_type(v, '$.' || arg) = 'ARRAY' AND list_bool_and(list_transform(TRY_CAST(json_extract(v, '$.' || arg) AS JSON[]), lambda x: json_type(x) = 'VARCHAR')) IS NOT false END)
        AND (choices IS NULL OR list_contains(choices, json_extract_string(v, '$.' || arg))) END)
        AND bool_and(list_contains((SELECT list(split_part(t.arg, '.', 1)) FROM tools t WHERE t.name = a.name), key) IS NOT false) AS fits
      FROM a JOIN tools ON a.name = tools.name LEFT JOIN (SELECT k, n, unnest(json_keys(v)) AS key FROM a) g ON g.k = a.k AND g.n = a.n GROUP BY a.k, a.n),
j AS (SELECT a.k, count(*) AS n_calls, count(*) FILTER (NOT (is_object AND coalesce(fits, false))) AS n_invalid,
      '[' || string_agg('{{' || array_to_string(list_filter([{field("arguments", "CASE WHEN is_object THEN '{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda x: to_json(x)::VARCHAR || ':' || json_extract(v, '$.' || x)::VARCHAR), ',') || '}' ELSE given END")},
        {field("id", "a.id")}, {field("name", "a.name")}], lambda x: x IS NOT NULL), ',') || '}}', ',' ORDER BY a.n) || ']' AS tool_calls
      FROM a LEFT JOIN f ON a.k = f.k AND a.n = f.n GROUP BY a.k),
par AS (SELECT r.k, coalesce(max(c.k) FILTER (coalesce(c.turn, {least}) <= coalesce(r.turn, {least})), min(c.k)) AS p
      FROM p r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.own = r.own AND c.id = r.link GROUP BY r.k),
around AS (SELECT k, p, [k] AS seen FROM par WHERE k <> p UNION ALL
      SELECT w.k, par.p, list_append(seen, w.p) FROM around w JOIN par ON par.k = w.p AND par.k <> par.p WHERE NOT list_contains(seen, w.p)),
cyc AS (SELECT DISTINCT k FROM around WHERE k = p),
free AS (SELECT * FROM par WHERE k <> p AND k NOT IN (SELECT k FROM cyc)),
up AS (SELECT free.k, p, turn AS place, 1 AS depth FROM free JOIN m ON m.k = free.k UNION ALL
      SELECT up.k, free.p, greatest(place, turn), depth + 1 FROM up JOIN m ON m.k = up.p JOIN free ON free.k = up.p),
ends AS (SELECT up.k, greatest(place, turn) AS place, depth FROM up JOIN m ON m.k = up.p WHERE up.p NOT IN (SELECT k FROM free))
SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id, own ORDER BY CASE WHEN depth IS NULL THEN turn ELSE place END NULLS FIRST, coalesce(depth, 0), turn NULLS FIRST, role, sha) - 1 AS seq, turn,
  coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_invalid, 0)::BIGINT AS n_invalid, par.p IS NOT NULL AS linked, link IS NOT NULL AND par.p IS NULL AS orphan, cyc.k IS NOT NULL AS cyclic,
  '{{' || array_to_string(list_filter([{field("content", "CASE WHEN calls IS NOT NULL THEN json_extract_string(text, '$.content') WHEN link IS NOT NULL THEN coalesce(json_extract_string(text, '$.content'), '') ELSE text END")},
    {field("role", "role")}, {field("tool_call_id", "link")}, '"tool_calls":' || tool_calls], lambda x: x IS NOT NULL), ',') || '}}' AS message
FROM p LEFT JOIN j ON j.k = p.k LEFT JOIN par ON par.k = p.k LEFT JOIN cyc ON cyc.k = p.k LEFT JOIN ends ON ends.k = p.k
"""


SQL = _sql()
