"""Tool-call linking, in DataFrame functions alone.

Calls (conv_id, turn, call_id, name, arguments, depends_on) and results (call_id, turn, content)
are joined by identifier. Calls are ordered so that each comes after those it depends on:
level 0 depends on nothing, level n on some call of level n - 1; positions in a conversation go by
(level, turn, call_id). Chains of single dependencies are followed by pointer doubling, levels of calls
with several dependencies rise one round at a time. Calls and their first results meet by a shuffled
hash join. Arguments are parsed as variants and checked against schemas (tool, arg, type, required), types
``string integer number boolean array object`` and ``array<..>`` of the first four. Calls are serialised as canonical JSON: sorted
keys, no white space, no nulls.

Defined cases: several results of a call: the first by (turn, content) is linked, n_results
counts all. Several calls of one call_id: each is linked and ordered; the error names it. A call
of a null id links with nothing. Dependencies that are null, absent, or the call itself don't
order, but are errors; calls on a cycle, or after one, have no level and come last. Unknown
tools, arguments that are no JSON object (null too), missing, unknown or ill-typed ones are
errors. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: JSON kinds, as variants name them, of each schema type.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
KINDS |= {f"array<{k}>": [f"ARRAY<{name}>" for name in [*KINDS[k], "VOID"]] for k in ("string", "integer", "number", "boolean")}
#: Turns of one group of the positions' count.
TURNS = 1_000


def chains(scratch: Scratch, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(call_id, anchor, steps): for every id the nearest call, up its only dependencies, that has none or several,
    by pointer doubling: rounds grow with the logarithm of the longest chain. Ids on or after a cycle have no row."""
    up = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    single = up.filter("n = 1").select("call_id", F.col("dep").alias("anchor"), F.lit(1).alias("steps"))
    ends = scratch.keep(ids.join(single, "call_id", "left_anti").select("call_id"), "ends")
    x = single.join(ends.select(F.col("call_id").alias("anchor"), F.lit(True).alias("done")), "anchor", "left").select("call_id", "anchor", "steps", F.coalesce("done", F.lit(False)).alias("done"))
    x = scratch.keep(x, "jumps")
    reach, longest = 1, x.count()  # a chain has no more steps than there are calls on chains
    while reach <= longest and not x.filter("not done").isEmpty():
        far = x.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("further"), F.col("steps").alias("more"), F.col("done").alias("there"))
        x = scratch.keep(x.filter("done").union(x.filter("not done").join(far, "anchor").select("call_id", "further", F.col("steps") + F.col("more"), "there")), "jumps")
        reach *= 2
    return ends.select("call_id", F.col("call_id").alias("anchor"), F.lit(0).alias("steps")).union(x.filter("done").select("call_id", "anchor", "steps"))


def levels(scratch: Scratch, calls: DataFrame) -> DataFrame:
    """(call_id, level) of every id; null level on or after a cycle. Chains of single dependencies are contracted
    first; rounds then go over the calls with several."""
    ids = scratch.keep(calls.filter("call_id is not null").select("call_id").distinct(), "ids")
    edges = calls.filter("call_id is not null").select("call_id", F.explode("depends_on").alias("dep")).filter("dep is not null and dep != call_id").distinct()
    edges = scratch.keep(edges.join(ids.withColumnRenamed("call_id", "dep"), "dep", "left_semi").select("call_id", "dep"), "edges")
    anchored = scratch.keep(chains(scratch, edges, ids), "anchored")
    several = edges.groupBy("call_id").agg(F.count("*").alias("n")).filter("n > 1").select("call_id")
    open_ = scratch.keep(edges.join(several, "call_id").join(anchored.withColumnRenamed("call_id", "dep"), "dep", "left").select("call_id", "anchor", "steps"), "open")
    done = scratch.keep(ids.join(edges, "call_id", "left_anti").select("call_id", F.lit(0).alias("level")), "done")
    fresh = done
    while not open_.isEmpty() and not fresh.isEmpty():
        met = open_.join(done.withColumnRenamed("call_id", "anchor"), "anchor", "left")
        ready = met.groupBy("call_id").agg(F.max(F.col("level") + F.col("steps") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("missing")).filter("missing = 0").select("call_id", "level")
        fresh = scratch.keep(ready, "ready")
        done = done.union(fresh)
        open_ = scratch.keep(open_.join(fresh, "call_id", "left_anti"), "open")
    found = anchored.join(done.select(F.col("call_id").alias("anchor"), "level"), "anchor").select("call_id", (F.col("level") + F.col("steps")).alias("level"))
    return ids.join(found, "call_id", "left")


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Columns parsed (variant) and errors added."""
    rules = schemas.groupBy("tool").agg(F.map_from_entries(F.collect_set(F.struct("arg", "type"))).alias("types"), F.sort_array(F.collect_set(F.when(F.col("required"), F.col("arg")))).alias("needed"))
    x = calls.join(rules, calls["name"] == rules["tool"], "left").withColumn("parsed", F.try_parse_json("arguments"))
    x = x.withColumn("is_object", F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False)))
    x = x.withColumn("given", F.when(F.col("is_object"), F.map_entries(F.expr("cast(parsed as map<string, variant>)"))).otherwise(F.expr("cast(array() as array<struct<key string, value variant>>)")))
    kinds = F.create_map(*[v for k, names in KINDS.items() for v in (F.lit(k), F.array(*map(F.lit, names)))])

    def fault(e):
        wanted = F.try_element_at(F.col("types"), e["key"])
        whole = F.schema_of_variant(e["value"])
        fits = F.arrays_overlap(F.try_element_at(kinds, wanted), F.array(whole, F.regexp_extract(whole, "^[A-Z]+", 0)))
        return F.when(wanted.isNull(), F.concat(F.lit("unknown argument "), e["key"])).when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("argument "), e["key"], F.lit(" is not "), wanted))

    missing = F.transform(F.array_except("needed", F.transform("given", lambda e: e["key"])), lambda a: F.concat(F.lit("missing argument "), a))
    wrong = F.filter(F.transform("given", fault), lambda m: m.isNotNull())
    errors = F.when(F.col("types").isNull(), F.array(F.lit("unknown tool"))).when(~F.col("is_object"), F.array(F.lit("arguments are no object"))).otherwise(F.sort_array(F.concat(missing, wrong)))
    return x.withColumn("errors", errors).drop("types", "needed", "given", "tool", "is_object")


def link_tool_calls(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, level, position, n_results, valid, errors, message) per call."""
    scratch = Scratch(spark, "tools")
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("depends_on", F.expr("cast(array() as array<string>)")).alias("depends_on"))
    found = results.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "content")).alias("first"))
    known = levels(scratch, calls)
    copies = calls.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("copies"))
    deps = calls.filter("call_id is not null").select("call_id", F.explode("depends_on").alias("dep")).distinct()
    lost = deps.join(known.select(F.col("call_id").alias("dep")), "dep", "left_anti").union(deps.filter("dep = call_id").select("dep", "call_id")).groupBy("call_id").agg(F.count("*").alias("lost"))
    x = checked(calls, schemas).join(known.join(copies, "call_id").join(lost, "call_id", "left"), "call_id", "left").join(found.hint("shuffle_hash"), "call_id", "left")
    extra = F.array_compact(F.array(F.when(F.col("call_id").isNull(), F.lit("no id")), F.when(F.col("copies") > 1, F.lit("repeated id")), F.when(F.col("lost") > 0, F.lit("unknown dependency")), F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), F.lit("cyclic dependency")), F.when(F.col("n_results").isNull(), F.lit("no result"))))
    x = x.withColumn("errors", F.concat("errors", extra))
    x = x.withColumns({"rank": F.coalesce("level", F.lit(2**31 - 1)), "span": F.coalesce(F.expr(f"turn div {TURNS}"), F.lit(0))})
    groups = calls.select("conv_id", "turn", "call_id").join(known, "call_id", "left").withColumns({"rank": F.coalesce("level", F.lit(2**31 - 1)), "span": F.coalesce(F.expr(f"turn div {TURNS}"), F.lit(0))}).groupBy("conv_id", "rank", "span").count()
    before = Window.partitionBy("conv_id").orderBy("rank", "span").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("conv_id").alias("c"), F.col("rank").alias("r"), F.col("span").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("conv_id", "rank", "span").orderBy("turn", "call_id", "name", "arguments")
    x = x.withColumn("at", F.row_number().over(own)).join(groups, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("rank") == F.col("r")) & (F.col("span") == F.col("s")))
    message = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.sort_array("depends_on").alias("depends_on"), F.col("call_id").alias("id"), "name", F.col("first.content").alias("result")))
    return x.select("conv_id", "turn", "call_id", "level", (F.col("base") + F.col("at") - 1).alias("position"), F.coalesce("n_results", F.lit(0)).alias("n_results"), (F.size("errors") == 0).alias("valid"), F.concat_ws("; ", "errors").alias("errors"), message.alias("message"))


SCHEMAS = [("search", "limit", "integer", True), ("search", "query", "string", True), ("translate", "query", "string", True), ("translate", "to", "string", False), ("count", "query", "string", True), ("count", "exact", "boolean", True)]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that conversations stand for: a user's turn asks a tool, with its
    whole text in the arguments, and hangs on an earlier one of the user's, at about half its number; the next turn, if the
    assistant's, is the result."""
    x = conversations.select("conv_id", "turn", "role", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    half = F.concat_ws("-", F.col("conv_id").cast("string"), F.expr("cast(turn div 4 * 2 + turn % 2 as string)"))
    name = F.get(F.array(*map(F.lit, ["search", "translate", "count", "draw"])), n % 4)
    limit = F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit('"many"')).otherwise((n % 50).cast("string"))
    extra = F.when(n % 4 == 0, F.concat(F.lit('"limit": '), limit, F.lit(", "))).when(n % 4 == 2, F.concat(F.lit('"exact": '), (n % 5 == 0).cast("string"), F.lit(" , ")))
    quoted = F.expr("substring(to_json(array(coalesce(text, ''))), 2, length(to_json(array(coalesce(text, '')))) - 2)")
    arguments = F.when(n % 13 == 0, F.col("text")).otherwise(F.concat(F.lit("{ "), F.coalesce(extra, F.lit("")), F.lit('"query" : '), quoted, F.lit("}")))
    calls = x.filter("role = 'user'").select("conv_id", "turn", ident.alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") > 1, F.array(half)).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    asked = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = x.filter("role = 'assistant'").select(asked.alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = x.sparkSession.createDataFrame(SCHEMAS, "tool string, arg string, type string, required boolean")
    return calls, results, schemas
