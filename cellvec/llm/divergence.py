"""Source divergence audit: how far the sources of a language differ in the terms they use.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lowered. A language keeps the
terms of ``least_docs`` documents or more. Null text, lang and source count as ''. Repeated rows and ids
count as documents of their own. A group without terms has counts of 0; a language without kept terms
has distances of 0 and no terms. Extra columns are ignored; empty table: no rows. A very long text
needs some 20 times its size in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runs import by_text, runs
from .scratch import Scratch
from .texthash import blocks

LEAST_DOCS, TOP = 30, 50
#: Bytes of text whose counts are summed at once.
BLOCK = 8 << 20
#: A language's few totals are repeated so often, so that its terms meet them in as many tasks.
SALTS = 64


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of all characters beyond ASCII."""
    low = data | 0x20
    return (data >= 0x80) | ((low >= 0x61) & (low <= 0x7A))


def groups_of() -> list[F.Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that hold the term; sums of a block leave each task,
    and are summed again before they are dealt by term."""

    def count(batches):
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                number, terms, first = runs(block.column("text"), letters)
                text, term, times = by_text(number, first, len(terms))
                group, pairs = np.zeros(block.num_rows, np.int64), {}
                for k, pair in enumerate(zip(block.column("lang").to_pylist(), block.column("source").to_pylist(), strict=True)):
                    group[k] = pairs.setdefault(pair, len(pairs))
                both, place = np.unique(group[text] * max(len(terms), 1) + term, return_inverse=True)
                lang, source = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
                of = both // max(len(terms), 1)
                n = np.bincount(place, times, len(both)).astype(np.int64)
                d = np.bincount(place, minlength=len(both))
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), terms.take(pa.array(both % max(len(terms), 1))).cast(pa.string()), pa.array(n), pa.array(d)], names=["lang", "source", "term", "n", "d"])

    x = docs.select(*groups_of(), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(count, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def meet(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """Rows of terms with the one row of their language, dealt by salts: a language may hold most terms."""
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    many = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return terms.withColumn("salt", salt).join(many, ["lang", "salt"]).drop("salt")


def pairs_of(column: str, f) -> F.Column:
    """f(a, b) of all pairs of an array's entries, a before b."""
    return F.flatten(F.transform(column, lambda a, i: F.transform(F.slice(column, i + 2, F.size(column)), lambda b: f(a, b))))


def term_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, counts) of the kept terms, and (lang, sources): counts are in the order of sources. One row of
    either holds as many entries as a language has sources."""
    langs = docs.select(*groups_of()).distinct().groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by")).filter(F.col("d") >= least_docs)
    counts = F.transform("sources", lambda s: F.coalesce(F.try_element_at("by", s), F.lit(0)))
    return meet(kept, langs).select("lang", "term", counts.alias("counts")), langs


def shares(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """terms with p, the smoothed shares in billionths by source, and q, that of the language; exact whole numbers."""
    x = meet(terms, langs)
    share = lambda c, n: f"1L + (CAST({c} + 5 AS DECIMAL(20, 0)) * 1000000000BD) div (CAST({n} AS DECIMAL(20, 0)) + 5 * v)"
    x = x.withColumns({"p": F.expr(f"zip_with(counts, totals, (c, n) -> {share('c', 'n')})"), "count": F.expr("aggregate(counts, 0L, (t, c) -> t + c)"), "total": F.expr("aggregate(totals, 0L, (t, c) -> t + c)")})
    return x.withColumn("q", F.expr(share("count", "total"))).select("lang", "term", "sources", "counts", "p", "q")


def audit_sources(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: the distance of each source to each other one of its
    language, summed over terms; part term: the ``top`` terms that a source has more of than its language.

    The term vectors are written once, as totals must be known before shares; each emits one number per pair of
    sources, and these are summed before they leave a task."""
    scratch = Scratch(spark, "divergence")
    terms, langs = term_vectors(docs, least_docs)
    terms, langs = scratch.keep(terms, "terms"), scratch.keep(langs, "langs")
    sums = terms.select("lang", F.posexplode("counts").alias("at", "c")).groupBy("lang", "at").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    totals = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda t: t["n"]).alias("totals"), F.max("v").alias("v"))
    langs = scratch.keep(langs.join(totals, "lang", "left"), "totals")  # one row a language
    priced = shares(terms, langs.filter("v is not null"))

    far = priced.select("lang", F.posexplode(pairs_of("p", lambda a, b: F.abs(a - b))).alias("pair", "f")).groupBy("lang", "pair").agg(F.sum("f").alias("value"))
    every = langs.select("lang", F.posexplode(pairs_of("sources", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pair", "s"))
    both = every.join(far, ["lang", "pair"], "left").select("lang", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.coalesce("value", F.lit(0)).alias("value"))
    pairs = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    more = priced.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "counts", "p")).alias("e")).filter("e.counts > 0 and e.p > q")
    more = more.select("lang", F.col("e.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("e.p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(more.withColumn("rank", rank).filter(F.col("rank") <= top))
