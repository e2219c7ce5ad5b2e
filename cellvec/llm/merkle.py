"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, in SQL functions alone.

Sections are what two line feeds in a row separate, paragraphs what one does. A paragraph is cut in
leaves by content: after each word (what single spaces separate) whose MD5 starts with 0 to 3, so an
edit changes the leaves that it touches and moves no other. A leaf's node is the SHA-256 of its text,
each higher node that of the nodes below it; every level has a letter before it. Every split can be
undone, so equal roots mean equal texts, and nodes that differ at equal positions locate the edits
(``differing``).

A fingerprint is the root, 64 hex digits, followed by the SKETCH least of the leaves' nodes cut to 8
digits (distinct, in order): all leaves of most texts, a fair sample of those of long ones. Likeness
comes from two fingerprints alone: equal roots 1; else, of the SKETCH least leaves of both together,
the share that both have, which is the Jaccard likeness of the leaf sets where these are small.

Null text counts as empty. Rows of equal doc_id are documents of their own, ordered by the text's MD5.
Null ids come last. A lone document is its own next. A text needs some ten times its size in memory
while its leaves are hashed. Extra columns are ignored; empty table: no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKETCH = 128
#: First digits of the MD5 of words that end a leaf.
ENDS = ("0", "1", "2", "3")
#: Documents of a bucket of the order by id; most buckets, ranges, and ids with buckets of their own.
BUCKET_ROWS, BUCKETS, RANGES, HEAVY = 2_000, 65_536, 500, 500


def node(kind: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), content), 256)


def leaves(paragraph: Column) -> Column:
    """The paragraph's leaves; U+0001, which marks the cuts, is escaped first."""
    plain = F.replace(F.replace(paragraph, F.lit("\2"), F.lit("\2\4")), F.lit("\1"), F.lit("\2\3"))
    marked = F.transform(F.split(plain, " ", -1), lambda w: F.when(F.substring(F.md5(w), 1, 1).isin(*ENDS), F.concat(w, F.lit("\1"))).otherwise(w))
    return F.split(F.array_join(marked, " "), "\1", -1)


def leaf_nodes(text: Column) -> Column:
    """Nodes of all leaves by section and paragraph; leaves without text (after a last cut) stay, as ''."""
    leaf = lambda t: F.when(t == "", F.lit("")).otherwise(node("l", t))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(leaves(p), leaf)))


def tree(nodes: Column) -> Column:
    """Sections (node, paragraphs: nodes) from ``leaf_nodes``."""
    paragraphs = lambda s: F.transform(s, lambda p: node("p", F.array_join(p, ",")))
    return F.transform(F.transform(nodes, paragraphs), lambda ps: F.struct(node("s", F.array_join(ps, "")).alias("node"), ps.alias("paragraphs")))


def fingerprint(nodes: Column) -> Column:
    """Root and sketch from ``leaf_nodes``."""
    root = node("r", F.array_join(F.transform(tree(nodes), lambda s: s["node"]), ""))
    short = F.transform(F.filter(F.flatten(F.flatten(nodes)), lambda n: n != ""), lambda n: F.substring(n, 1, 8))
    return F.concat(root, F.array_join(F.slice(F.array_sort(F.array_distinct(short)), 1, SKETCH), ""))


def likeness(x: Column, y: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    a, b = (F.regexp_extract_all(F.substring(v, 65, 8 * SKETCH), F.lit(".{8}"), 0) for v in (x, y))
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.substring(x, 1, 64) == F.substring(y, 1, 64), 1.0).otherwise(F.coalesce(F.try_divide(shared, F.size(least)), F.lit(0.0)))


def differing(x: Column, y: Column) -> Column:
    """Positions of the sections, and of the paragraphs in them, whose nodes differ: the branches of two
    trees (``tree``) that a search from the roots follows."""

    def inside(p, q, i):
        other = F.zip_with(F.coalesce(p["paragraphs"], F.array().cast("array<string>")), F.coalesce(q["paragraphs"], F.array().cast("array<string>")), lambda u, v: ~u.eqNullSafe(v))
        paragraphs = F.filter(F.transform(other, lambda f, j: F.when(f, j)), lambda j: j.isNotNull())
        return F.when(~p["node"].eqNullSafe(q["node"]), F.struct(i.alias("section"), paragraphs.alias("paragraphs")))

    pairs = F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.filter(F.transform(pairs, lambda t, i: inside(t.p, t.q, i)), lambda t: t.isNotNull())


def bucket_column(x: DataFrame) -> Column:
    """A document's bucket in the order by (doc_id, null first, digest), for rows (doc_id, digest).

    Buckets are cut at quantiles of doc_id and evenly between these; ids of many rows, and rows without
    id, have buckets of their own, cut by digest. There are about BUCKETS at most, of BUCKET_ROWS rows or
    an even share."""
    ids = x.filter("doc_id is not null")
    about = ids.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / RANGES for i in range(RANGES + 1)], 10 * RANGES).alias("q")).first()
    missing = x.filter("doc_id is null").count()
    rows = max(BUCKET_ROWS, -(-(about.n + missing) // BUCKETS))
    heavy = {r.doc_id: r["count"] for r in ids.groupBy("doc_id").count().filter(F.col("count") > max(rows, about.n // HEAVY)).collect()}  # at most HEAVY
    edges = sorted({*(about.q or []), *heavy, *(i + 1 for i in heavy if i + 1 < 2**63)})
    even = about.n // (rows * max(1, len(set(about.q or [])))) + 1
    parts = [missing // rows + 1, *(heavy[e] // rows + 1 if e in heavy else even for e in edges)]
    base = [0, *accumulate(parts)]
    edge, count, first = (F.array(*(F.lit(v).cast("long") for v in values)) for values in ([-(2**63), *edges], parts, base))
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.lit(1), F.size(F.filter(edge, lambda e: e <= F.col("doc_id"))) - 1))
    low, high = F.get(edge, at), F.coalesce(F.get(edge, at + 1), F.col("doc_id"))
    spread = (F.col("doc_id").cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double") + 1)
    digest = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / 2**32
    alone = F.col("doc_id").isNull() | F.col("doc_id").isin(*heavy) if heavy else F.col("doc_id").isNull()
    part = F.least(F.floor(F.when(alone, digest).otherwise(F.greatest(F.lit(0.0), spread)) * F.get(count, at)), F.get(count, at) - 1)
    return F.get(first, at) + part


def fingerprint_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its edited text, whose last half comes from the next
    document by descending doc_id, with the likenesses of both pairs.

    Texts are shuffled once, by buckets of the order, with their fingerprints; the first document of
    each bucket goes to the bucket above as well, as its last one's next.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    x = x.withColumn("bucket", bucket_column(x.select("doc_id", "digest")))
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "digest")
    heads = x.groupBy("bucket").agg(F.max(order).alias("head"))
    up = Window.orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(up), F.first("bucket").over(up)).alias("above")
    heads = heads.select(above, F.col("head.doc_id").alias("head_id"), F.col("head.digest").alias("head_digest"))  # at most some BUCKETS rows
    last = x.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("digest") == F.col("head_digest"))).dropDuplicates(["above"])
    rows = x.select("bucket", "doc_id", "digest", "text", F.lit(False).alias("over")).union(last.select("above", "doc_id", "digest", "text", F.lit(True)))
    rows = rows.withColumn("nodes", leaf_nodes(F.col("text"))).select("bucket", "doc_id", "digest", "text", "over", fingerprint(F.col("nodes")).alias("fingerprint"))
    down = Window.partitionBy("bucket").orderBy("over", F.desc_nulls_last("doc_id"), F.desc("digest"))
    x = rows.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(down)).filter("not over").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next.text, cast(n_chars div 2 as int)))")
    x = x.select("doc_id", "n_chars", "fingerprint", F.col("next.fingerprint").alias("following"), edited.alias("edited"))
    x = x.select("*", F.sha2("edited", 256).alias("edited_sha256"), leaf_nodes(F.col("edited")).alias("nodes")).withColumn("edited_fingerprint", fingerprint(F.col("nodes")))
    near = {f"near_{c}": F.round(likeness(F.col("fingerprint"), F.col(other)), 6) for c, other in (("edited", "edited_fingerprint"), ("next", "following"))}
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *(v.alias(k) for k, v in near.items()))
