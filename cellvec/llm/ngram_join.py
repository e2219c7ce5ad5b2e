"""Jaccard self-join of documents on word shingles: rare-first prefix filtering.

1. Counts of all shingles by cell (2**22 counts over all documents) give one global order, rare
   first; ties by hash.
2. Each document's shingles in that order; a document of n shingles indexes its first
   n - ceil(0.8 n) + 1. Two documents that link share one of these. Documents of equal word
   sequences are one class from here on.
3. Documents of a prefix shingle are candidates, less those that the length and the positional
   filter refuse. Candidates become components as in ``linking``.
4. Each pair is verified once. First the suffix filter bounds the two sets' difference from below
   by ranges of the hashes: each range in which one set has an odd count and the other an even
   one holds at least one shingle of one set only. Then the exact overlap.

Words are runs of characters other than 0x20 and 0x09-0x0D, A-Z lowered. A document of fewer
words than a shingle has its whole sequence as its one shingle; without words or text its set is
empty and links with nothing. Shingles are 64-bit hashes. Rows with a null doc_id are documents
too: they link as any, but their id is no candidate for component_id unless all are null. Rows
of equal doc_id are documents of their own. Extra columns are ignored. Empty table: no rows. Texts are
worked on in blocks of half a MB, a longer text by itself, in some 60 times its size of memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import Bitmap, cell_of, count_cells
from .linking import link_buckets
from .memory import freeing
from .scratch import Scratch
from .texthash import blocks, flat, lists, overlap, sequence_digests, shingles, signed, words

WIDTH = 5
#: Similarity in percent.
ALIKE = 80
ORDER_BITS = 22
#: Parities of a set's counts in hash ranges, as 64-bit numbers.
SIGNS = 8


def least_overlap(n: int, alike: int) -> int:
    return (alike * n + 99) // 100


def each_set(batch: pa.RecordBatch, width: int):
    """Blocks of a batch with their texts' shingle sets and digests."""
    for block in blocks(batch, "text"):
        h, first = words(*flat(block.column("text")))
        yield block, list(shingles(h, first, width)), sequence_digests(h, first)


def shingle_counts(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    def hashes(batch):
        for _, sets, _ in each_set(batch, width):
            yield np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    return count_cells(docs.select("text"), hashes, bits)


def prefixes(spark: SparkSession, docs: DataFrame, counts: np.ndarray, width: int, alike: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, doc_id, d1, d2, n, prefix in order, signs): digests of the word sequence, set size, parities by hash range."""
    table = spark.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))
    bits = int(np.log2(len(counts)))

    def index(batches):
        for batch in batches:
            for block, sets, (d1, d2) in each_set(batch, width):
                prefix, signs = [], []
                for s in sets:
                    order = np.argsort(table.value[cell_of(s, bits)], kind="stable")
                    prefix.append(signed(s[order[: len(s) - least_overlap(len(s), alike) + 1]]) if len(s) else s.view(np.int64))
                    signs.append(np.packbits(np.bincount(cell_of(s, 9), minlength=64 * SIGNS).astype(np.uint8) & 1).view(np.int64))
                n = np.array([len(s) for s in sets], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), block.column("doc_id"), pa.array(signed(d1)), pa.array(signed(d2)), pa.array(n), lists(prefix, pa.int64()), lists(signs, pa.int64())], names=[*keep, "doc_id", "d1", "d2", "n", "prefix", "signs"])

    kinds = "".join(f"`{c}` {kind}, " for c, kind in docs.select(*keep).dtypes)
    return docs.mapInArrow(freeing(index), kinds + "doc_id long, d1 long, d2 long, n int, prefix array<long>, signs array<long>")


def wanted_texts(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """(d1, d2, text) of the texts whose d1 the bitmap has; a text may come more than once."""

    def fetch(batches):
        for batch in batches:
            for block in blocks(batch, "text"):
                d1, d2 = sequence_digests(*words(*flat(block.column("text"))))
                keep = np.flatnonzero(wanted.has(d1))
                _, once = np.unique(d1[keep], return_index=True)
                keep = keep[once]
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(d1[keep])), pa.array(signed(d2[keep])), block.column("text").take(pa.array(keep))], names=["d1", "d2", "text"])

    return docs.select("text").mapInArrow(freeing(fetch), "d1 long, d2 long, text string")


def alike_texts(pairs: DataFrame, width: int, alike: int) -> DataFrame:
    """Pairs (a, b) of (a, b, x, y) whose texts' sets have 100 * overlap >= alike * union."""

    def compare(batches):
        last, own = None, None  # a hub's text comes with all its pairs, one after the other
        for batch in (c for a in batches for b in blocks(a, "y") for c in blocks(b, "x")):
            keep = []
            for a, x, q in zip(batch.column("a").to_pylist(), batch.column("x"), shingles(*words(*flat(batch.column("y"))), width), strict=True):
                if a != last:
                    last, own = a, next(shingles(*words(*flat(pa.array([x.as_py()]))), width))
                common = overlap(own, q)
                keep.append((100 + alike) * common >= alike * (len(own) + len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(freeing(compare), "a long, b long")


def link_documents(spark: SparkSession, docs: DataFrame, width: int = WIDTH, alike: int = ALIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document, component_id the least doc_id linked."""
    return link_rows(spark, docs, width, alike).select("doc_id", "n_shingles", "component_id")


def link_rows(spark: SparkSession, docs: DataFrame, width: int = WIDTH, alike: int = ALIKE, keep: tuple[str, ...] = ()) -> DataFrame:
    """As link_documents, with the columns ``keep`` and ``component``, which differs between components
    whose least doc_ids are equal or null; null for texts without words, which are linked to none."""
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = scratch.keep(prefixes(spark, docs, shingle_counts(docs.select("doc_id", "text"), width, ORDER_BITS), width, alike, keep), "index")
    classes = index.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("signs").alias("signs"))
    whole = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    index, old = scratch.keep(index.drop("prefix", "signs"), "documents"), index
    classes = scratch.keep(whole.drop("prefix"), "classes")
    scratch.drop(old)
    buckets = whole.select("id", F.col("n").alias("size"), F.posexplode("prefix").alias("at", "bucket")).select("bucket", "id", "size", "at")

    def admit(x, y):
        least, most = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
        common = F.least(x("at"), y("at")) + F.least(x("size") - x("at"), y("size") - y("at"))
        return (100 * least >= alike * most) & ((100 + alike) * common >= alike * (least + most))

    def close(x, y):
        apart = sum((F.bit_count(x(f"s{k}").bitwiseXOR(y(f"s{k}"))) for k in range(SIGNS)), F.lit(0))
        return F.lit(100 + alike) * apart <= F.lit(100 - alike) * (x("n") + y("n"))

    def narrow(ids):
        scratch.drop(whole)  # buckets are written by now, and prefixes are most of what lies on disk
        signs = classes.select("id", "n", *(F.get("signs", F.lit(k)).alias(f"s{k}") for k in range(SIGNS)))
        return scratch.keep(signs.join(ids, "id", "left_semi"), "signs")

    def verify(pairs):
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        need = scratch.keep(classes.select("id", "d1", "d2").join(ids, "id", "left_semi").select("d1", "d2", "id"), "need")
        texts = need.join(wanted_texts(docs, Bitmap(need, "d1")), ["d1", "d2"]).groupBy("d1", "d2").agg(F.first("id").alias("id"), F.first("text").alias("text"))
        texts = scratch.keep(texts.select("id", "text"), "texts")
        x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        links = scratch.keep(alike_texts(pairs.join(y, "b").join(x, "a"), width, alike), "links")
        scratch.drop(need, texts)
        return links

    label = link_buckets(spark, scratch, buckets, narrow, close, verify, ("size", "at"), admit)
    named = classes.select("id", "d1", "d2", "least").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(groups, "component").select("d1", "d2", "component_id", "component")
    full, empty = index.filter("n > 0"), index.filter("n = 0")
    out = full.join(named, ["d1", "d2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "component", *keep)
    return out.union(empty.select("doc_id", F.lit(0).cast("long"), F.col("doc_id"), F.lit(None).cast("long"), *keep))
