"""From buckets of candidates to connected components, without listing all pairs of a bucket.

Rows (bucket, id) say that ids of a bucket may be alike. ``link_buckets`` compares every id of a
bucket with its hub, the least id there, and joins what is alike. Pairs whose two ends are by then
in one component need no look: no further link could change a component. What is left, rows of
buckets that still hold several components, is compared pair by pair in small buckets, in large
ones by rounds with more hubs and then pair by pair, in blocks. No pair is verified twice.
So every link between components is found, while a bucket of near copies costs its size, not its
square. Ids are dealt by hash, so the least id is a random one, and the buckets of a group of copies
share their hub.

The largest MOST_HOT buckets of more than HOT_ROWS rows are hot: any other holds less than a MOST_HOT-th
part of all rows. They are found in the rows of every SAMPLE-th id by hash, which decides on tasks
only, never on results; they are salted, and the hubs of their parts compared with one another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

HOT_ROWS = 4_000
MOST_HOT = 1 << 14
SAMPLE = 32
#: Buckets up to this size are compared pair by pair once their first hub is done; others by as many hubs a round.
SMALL, HUBS = 16, 8
#: Rows of a block of the last comparison.
BLOCK_ROWS = 1_024
#: Open buckets of an id that its rows may carry along, to take a pair in one of its buckets only.
CARRIED = 64

#: A predicate on two rows, each given as a function from names to columns.
Admit = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component) of every id with a link (a, b); component is some id of the component.

    Contraction: each vertex goes to the least of itself and its neighbours, links then join these,
    until none is left. In odd rounds the least id counts (so stars collapse at once), in even ones the
    least hash (so chains of rising ids shrink by a constant factor). The minimum is taken before the
    shuffle, and both joins are plain, so adaptive execution splits a vertex of very many links.
    """
    edges = scratch.keep(links.select("a", "b"), "edges")
    steps: list[DataFrame] = []
    while True:
        mark = lambda c: F.struct((F.xxhash64(c, F.lit(len(steps))) if len(steps) % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("id"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(mark("b")).alias("near")).select(F.col("a").alias("id"), F.least("near", mark("a"))["id"].alias("root"))
        step = scratch.keep(step, "step")
        p, q = (step.select(F.col("id").alias(s), F.col("root").alias(f"r{s}")) for s in "ab")
        left = scratch.keep(edges.join(p, "a").join(q, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        scratch.drop(edges)
        steps.append(step)
        edges = left
        if edges.isEmpty():
            break
    label = steps[-1]
    for step in reversed(steps[:-1]):
        on = label.select(F.col("id").alias("root"), F.col("root").alias("further"))
        label = step.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"))
    if len(steps) == 1:
        return label.withColumnRenamed("root", "component")
    out = scratch.keep(label.withColumnRenamed("root", "component"), "label")
    scratch.drop(edges, *steps)
    return out


def salt_hot(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, bool]:
    """Columns salt and salts of rows whose bucket is hot, and whether there are any."""
    some = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SAMPLE)) == 0).groupBy("bucket").count()
    least = HOT_ROWS // SAMPLE
    hot = some.filter(F.col("count") > least).orderBy(F.desc("count")).limit(MOST_HOT).collect()
    if not hot:
        return rows, False
    table = spark.createDataFrame([(r.bucket, r["count"] // least + 1) for r in hot], "bucket long, salts int")  # at most MOST_HOT rows
    x = rows.join(F.broadcast(table), "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return x.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(99)), F.col("salts")).cast("int")), True


def with_hubs(rows: DataFrame, attrs: Sequence[str], admit: Admit | None, salted: bool) -> DataFrame:
    """Rows (bucket, id, attrs) with the hub of their bucket (and salt), ok where the pair with it may be
    alike, and salts; lone rows go. One shuffle and one sort; a bucket's rows spill, if they are many."""
    at = Window.partitionBy("bucket", *(["salt"] if salted else [])).orderBy("id")
    own = F.struct("id", *attrs)
    x = rows.withColumns({"h": F.first(own).over(at.rowsBetween(Window.unboundedPreceding, 0)), "p": F.lag("id").over(at), "q": F.lead("id").over(at)})
    x = x.filter("p is not null or q is not null" + (" or salts > 1" if salted else ""))
    ok = F.col("id") != F.col("h.id")
    if admit is not None:
        ok &= admit(F.col, lambda c: F.col(f"h.{c}"))
    return x.select("bucket", "id", *attrs, F.col("h.id").alias("hub"), ok.alias("ok"), *(["salts"] if salted else []))


def with_others(rows: DataFrame) -> DataFrame:
    """Rows with all buckets of their id (others), null for those of more than CARRIED; narrow rows and one shuffle, by id."""
    at = Window.partitionBy("id")
    x = rows.withColumn("others", F.row_number().over(at.orderBy("bucket")))
    x = x.withColumn("others", F.collect_list(F.when(F.col("others") <= CARRIED + 1, F.col("bucket"))).over(at))
    return x.withColumn("others", F.when(F.size("others") <= CARRIED, F.col("others")))


def side(alias: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{alias}.{c}")


def all_pairs(rows: DataFrame, admit: Admit, blocks: bool = False) -> DataFrame:
    """Pairs (a, b) of a bucket in different components. Buckets of one block meet themselves, so both sides of the join
    are one shuffle. With ``blocks``, larger ones go block by block: a block holds about BLOCK_ROWS rows
    of a bucket (held), and a row is copied once for each block of its bucket. A pair that shares several
    buckets comes from the least of them, unless an id has too many to carry (others is null)."""
    x = rows.filter(f"held < {BLOCK_ROWS}").drop("held") if blocks else rows.drop("held")
    out = pairs_of(x.alias("x"), x.alias("y"), F.col("x.bucket") == F.col("y.bucket"), admit)
    if not blocks:
        return out
    number = F.expr(f"held div {BLOCK_ROWS} + 1")
    x = rows.filter(f"held >= {BLOCK_ROWS}").withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), number)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)))
    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    return out.union(pairs_of(x.alias("x"), x.alias("y"), met, admit))


def pairs_of(u: DataFrame, v: DataFrame, met: Column, admit: Admit) -> DataFrame:
    out = u.join(v, met).filter("x.id < y.id and x.component != y.component")
    once = F.coalesce(F.array_min(F.array_intersect("x.others", "y.others")) == F.col("x.bucket"), F.lit(True))
    return out.filter(admit(side("x"), side("y")) & once).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def hub_pairs(rows: DataFrame, columns: Sequence[str], admit: Admit, seed: int) -> DataFrame:
    """Pairs (a, b) of HUBS ids of each bucket with its ids of other components."""
    own = F.struct("id", "component", *columns)
    best = rows.groupBy("bucket").agg(*(F.min(F.struct(F.xxhash64("id", F.lit(HUBS * seed + k)).alias("first"), own.alias("row"))).alias(f"h{k}") for k in range(HUBS)))
    hubs = best.select("bucket", F.explode(F.array_distinct(F.array(*(f"h{k}.row" for k in range(HUBS))))).alias("row")).select("bucket", "row.*")
    out = rows.alias("x").join(hubs.alias("y"), F.col("x.bucket") == F.col("y.bucket")).filter("x.component != y.component").filter(admit(side("x"), side("y")))
    return out.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def link_buckets(spark: SparkSession, scratch: Scratch, buckets: DataFrame, narrow: Callable[[DataFrame], DataFrame], close: Admit, verify: Callable[[DataFrame], DataFrame], attrs: Sequence[str] = (), admit: Admit | None = None, rounds: int = 2) -> DataFrame:
    """(id, component) of every id with a link; ``buckets``: (bucket long, id long, attrs), an id once a bucket.

    verify(pairs (a, b) with a < b, each once) returns those that are alike. admit may refuse a pair of a
    bucket by its attrs, close a pair by the columns that narrow(ids) gives to ids (once, for all ids that
    share a bucket). Both must be sound: never refuse a pair that verify would return.
    """
    rows, salted = salt_hot(spark, buckets)
    live = scratch.keep(with_hubs(rows, attrs, admit, salted), "live")
    held = narrow(live.select("id").distinct())
    columns = [c for c in held.columns if c != "id"]
    pairs = live.filter("ok").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    if salted:
        hubs = live.filter("salts > 1").select("bucket", "hub").distinct()
        top = hubs.groupBy("bucket").agg(F.min("hub").alias("top"))
        pairs = pairs.union(hubs.join(top, "bucket").filter("hub != top").select("top", "hub"))
    p, q = (held.select(*(F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in held.columns)) for s in "ab")
    near = pairs.distinct().join(p, "a").join(q, "b").filter(close(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    tried = scratch.keep(near.select("a", "b"), "tried")
    label = components(scratch, scratch.keep(verify(tried), "links"))
    both = close if admit is None else lambda x, y: admit(x, y) & close(x, y)
    # a pair with the bucket's hub was compared or refused
    later = lambda x, y: both(x, y) & (x("id") != y("hub")) & (y("id") != x("hub"))
    named = live.join(label, "id", "left").select("bucket", "id", "hub", *attrs, F.coalesce("component", "id").alias("component"))
    spent = [live]
    for k in range(1, rounds + 2):
        mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held")).filter("low < high").select("bucket", "held")
        rest = scratch.keep(with_others(named.join(mixed, "bucket")).join(held, "id"), "rest")
        scratch.drop(*spent)
        spent = [rest]
        if k <= rounds:
            new = all_pairs(rest.filter(f"held <= {SMALL}"), later).union(hub_pairs(rest.filter(f"held > {SMALL}"), ["hub", *attrs, *columns], later, k))
        else:
            new = all_pairs(rest, later, True)
        new = scratch.keep(new.distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        tried = tried.union(new)
        large = rest.filter(f"held > {SMALL}") if k <= rounds else rest.limit(0)
        names = ["bucket", "id", "hub", *attrs]
        if new.isEmpty():
            named = large.select(*names, "component")
        else:
            p, q = (label.select(F.col("id").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
            between = verify(new).join(p, "a", "left").join(q, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            joined = components(scratch, between).select(F.col("id").alias("component"), F.col("component").alias("new"))
            told = label.join(joined, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
            label = scratch.keep(told.union(joined.join(label, joined["component"] == label["id"], "left_anti").select("component", "new")), "label")
            named = large.join(joined, "component", "left").select(*names, F.coalesce("new", "component").alias("component"))
        if large.isEmpty():
            break
    return label
