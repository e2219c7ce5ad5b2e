"""Mixing sources to target weights, in DataFrame functions alone.

Each source's words, in the order of its documents, are cut in blocks of a fixed length. A source
takes as many slots as its target holds mean blocks. How many of these each output shard gets is a
multinomial draw (``draw_counts``: one pseudorandom draw a slot, counted by shard and source; shards
have about SHARD_SLOTS slots), so totals by source are exact. A shard's slots are numbered from the
prefix sums of these counts, and slot k of a source maps to a block through a keyed Feistel
permutation of the source's blocks, with another key after each round through them. As targets stop
at twice the source's size, no block is taken more than twice. Slots and blocks are joined by source
and index; the joined rows are the mixed corpus by shard, and what is taken of a document is the sum
over its rows.

Sources by code point, null last, have the weights 3, 1, 2, repeating. Targets: 1.5 times all
words, by weight; those above twice their source's size stop there and the rest is shared again,
which in order of size over weight has a closed form.

Null text has no words; documents without words take none. Rows of equal doc_id are documents of
their own. Extra columns are ignored; empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block at most; a source of few words has blocks of a thousandth of them.
BLOCK_WORDS = 128
#: Documents of a group for prefix sums, slots of a shard, slots that one row expands to.
GROUP_ROWS = 5_000
SHARD_SLOTS = 4_096
CHUNK_SLOTS = 4_096


def source_plan(sized: DataFrame) -> DataFrame:
    """One row per source: place, docs, source_size, target, block (words), blocks, slots."""
    x = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    x = x.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row a source
    x = x.withColumn("weight", F.get(F.array([F.lit(w) for w in WEIGHTS]), F.col("place") % len(WEIGHTS)))
    cap = F.lit(MOST) * F.col("source_size")
    by_ratio = Window.orderBy(cap / F.col("weight"), "place")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    x = x.withColumns({"level": level, "ratio": cap / F.col("weight")})
    x = x.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place"))).over(every))
    x = x.withColumn("target", F.when(F.col("level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("level") * F.col("weight"))))
    x = x.withColumn("block", F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.expr("source_size div 1000"))).cast("long"))
    x = x.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    slots = F.when(F.col("blocks") == 0, 0).otherwise(F.least(F.lit(MOST) * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size"))))
    return x.select("source", "place", "docs", "source_size", "target", "block", "blocks", slots.cast("long").alias("slots"))


def permuted(x, a, b, key, text: bool = False):
    """x in 0 .. a * b - 1 under the permutation of ``key``: a Feistel network of four rounds over the places
    x div b and x mod b, each round adding a keyed hash of one to the other. For columns, or as SQL text."""

    def added(part, other, k, size):
        if text:
            return f"(({part} + CAST('0x' || left(md5({other} || ':' || {key} || ':{k}'), 8) AS BIGINT)) % {size})"
        return (part + F.conv(F.substring(F.md5(F.concat_ws(":", other, key, F.lit(k))), 1, 8), 16, 10).cast("long")) % size

    left, right = (f"({x} // {b})", f"({x} % {b})") if text else (F.floor(x / b), x % b)
    for k in (0, 2):
        left = added(left, right, k, a)
        right = added(right, left, k + 1, b)
    return f"({left} * {b} + {right})" if text else left * b + right


def draw_counts(plan: DataFrame, seed: int = 0) -> DataFrame:
    """(place, shard, blocks, first, count): how many slots of each shard a source gets, a multinomial draw
    of the source's slots over the shards, and how many it has in the shards before."""
    chunks = plan.filter("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {CHUNK_SLOTS}"))))
    chunks = chunks.repartition("place", "chunk")
    shards = -(-(plan.agg(F.sum("slots")).first()[0] or 0) // SHARD_SLOTS) or 1
    draw = F.explode(F.sequence(F.col("chunk") * CHUNK_SLOTS, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK_SLOTS) - 1))
    drawn = chunks.select("place", "blocks", draw.alias("draw")).groupBy("place", "blocks", F.pmod(F.xxhash64("place", "draw", F.lit(seed)), F.lit(shards)).alias("shard")).agg(F.count("*").alias("count"))
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    out = drawn.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return out.repartition(min(10_000, shards // 32 + 1), "place", "shard")  # few rows, each of many slots


def draw_slots(counts: DataFrame, seed: int = 0) -> DataFrame:
    """(place, slot, shard, index): the slots of every shard and source, from the counts drawn, each with
    its block. Values that fall beyond the source's blocks are permuted again until they don't."""
    x = counts.select("place", "shard", "blocks", F.explode(F.expr("sequence(first, first + count - 1)")).alias("slot"))
    x = x.withColumn("a", F.ceil(F.sqrt("blocks"))).withColumns({"b": F.expr("(blocks + a - 1) div a"), "key": F.col("place") * 7919 + F.expr("slot div blocks") * 104_729 + seed})
    once = lambda v: permuted(v, F.col("a"), F.col("b"), F.col("key"))
    x = x.withColumn("v", once(F.col("slot") % F.col("blocks")))
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), F.expr("a * b - blocks")), F.col("v"), lambda v, _: F.when(v < F.col("blocks"), v).otherwise(once(v)))
    return x.select("place", "slot", "shard", F.when(F.col("v") < F.col("blocks"), F.col("v")).otherwise(walk).alias("index"))


def document_blocks(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(place, index, source, row, doc_id, start, words): the words, from the start-th on, that each document has in each block of its source.

    Documents go in order of the digest of id and text, in parts by its remainder; more than GROUP_ROWS rows
    alike come last, in parts by row, as their order doesn't matter."""
    x = sized.join(plan.select(F.col("source").alias("named"), "place", "docs", "block"), F.col("source").eqNullSafe(F.col("named")))
    many = sized.groupBy("source", "digest").agg(F.count("*").alias("alike")).filter(f"alike > {GROUP_ROWS}").select(F.col("source").alias("s"), F.col("digest").alias("d"), "alike")
    x = x.join(many, F.col("source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("d")), "left")
    hot = F.col("alike").isNotNull()
    x = x.withColumns({"hot": hot, "group": F.when(hot, F.col("digest")), "part": F.when(hot, F.pmod(F.col("row"), F.expr(f"alike div {GROUP_ROWS}"))).otherwise(F.col("digest") % F.expr(f"docs div {GROUP_ROWS} + 1"))})
    part = ["place", "hot", "group", "part"]
    parts = x.groupBy(*part).agg(F.sum("size").alias("words"))
    base = F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("hot", "group", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy(*part).orderBy("digest", "row").rowsBetween(Window.unboundedPreceding, 0)
    bases = parts.select(*(F.col(c).alias(f"_{c}") for c in part), base.alias("base"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "group" else F.col(c) == F.col(f"_{c}") for c in part]
    x = x.withColumn("stop", F.sum("size").over(within)).join(bases, same)
    x = x.filter("size > 0").withColumns({"stop": F.col("stop") + F.col("base"), "start": F.col("stop") + F.col("base") - F.col("size")})
    x = x.withColumn("index", F.explode(F.sequence(F.expr("start div block"), F.expr("(stop - 1) div block"))))
    first = F.greatest("start", F.col("index") * F.col("block"))
    words = F.least("stop", (F.col("index") + 1) * F.col("block")) - first
    return x.select("place", "index", "source", "row", "doc_id", (first - F.col("start")).alias("start"), words.alias("words"))


def mix_tables(spark: SparkSession, docs: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sizes and rows, the plan, and the mix as in ``mix_shards``."""
    scratch = Scratch(spark, "mix")
    digest = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("digest"), *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")] if keep else []))
    sized = scratch.keep(x.withColumn("row", F.monotonically_increasing_id()), "sized")
    plan = scratch.keep(source_plan(sized), "plan")
    slots = draw_slots(draw_counts(plan, seed), seed)
    mixed = slots.hint("merge").join(document_blocks(sized, plan), ["place", "index"])
    return sized, plan, scratch.keep(mixed.select("shard", "slot", "source", "index", "row", "doc_id", "start", "words"), "mixed")


def mix_shards(spark: SparkSession, docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: (shard, slot, source, index, row, doc_id, start, words), one row for each
    document that a slot's block holds words of; ``row`` tells documents of equal doc_id apart."""
    return mix_tables(spark, docs, seed)[2]


def shard_counts(mixed: DataFrame) -> DataFrame:
    """(shard, source, slots, words) of the mix."""
    slots = mixed.groupBy("shard", "source", "slot").agg(F.sum("words").alias("words"))
    return slots.groupBy("shard", "source").agg(F.count("*").alias("slots"), F.sum("words").alias("words"))


def mixed_rows(spark: SparkSession, docs: DataFrame, seed: int, keep: tuple[str, ...]) -> DataFrame:
    """(row, place, docs, doc_id, size, source_size, target, taken) per document, and ``kept``."""
    sized, plan, mixed = mix_tables(spark, docs, seed, keep)
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    out = sized.join(plan.select(F.col("source").alias("named"), "place", "docs", "source_size", "target"), F.col("source").eqNullSafe(F.col("named"))).join(taken, "row", "left")
    return out.select("row", "place", "docs", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), *(["kept"] if keep else []))


def mix_documents(spark: SparkSession, docs: DataFrame, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document, and a struct ``kept`` of the columns ``keep``."""
    return mixed_rows(spark, docs, seed, keep).drop("row", "place", "docs")


def copy_documents(spark: SparkSession, docs: DataFrame, seed: int = 0) -> DataFrame:
    """Whole documents in place of the blocks taken: every document as often as copies says, 0 to MOST times.

    Copies are taken / size, rounded up or down so that the running sum over a part of a source, in
    order of size, rounds to the same; a part's words are then less than its largest document off.
    """
    x = mixed_rows(spark, docs, seed, tuple(docs.columns)).filter("size > 0")
    x = x.withColumn("part", F.pmod(F.xxhash64("row"), F.expr(f"docs div {GROUP_ROWS} + 1")))
    along = Window.partitionBy("place", "part").orderBy("size", "doc_id", "row")
    x = x.withColumn("upto", F.floor(F.sum(F.col("taken") / F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, 0)) + 0.5))
    x = x.withColumn("copies", (F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0))).cast("int"))
    return x.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("kept.*")
