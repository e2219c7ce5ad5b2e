"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Null and empty texts have length 0. Repeated rows and ids each count. Extra columns are ignored; empty
table: no rows. A very long text needs some 20 times its size in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import freeing
from .scratch import Scratch
from .texthash import blocks
from .tokens import forget, token_ids, vocabulary_path

#: Lengths of one block of the suffix sums.
SPAN = 1024


def token_lengths(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Encoded length of every text, without special tokens."""
    path = ranks_path or vocabulary_path()

    def measure(batches):
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(token_ids(block.column(0), path)[1]).astype(np.int64))], names=["length"])
        forget(path)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(freeing(measure), "length long")


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """One row per length L that occurs, which serves as context limit L:

    n_docs of that length; docs_at_least and tokens_at_least over documents of L or more;
    total_docs, total_tokens; truncated_tokens, the sum of min(length, L); share_within, the part
    of documents of L or less, so the q-quantile is the least L with share_within >= q.

    Documents shrink to lengths before the only sorts; sums run by spans of lengths and then over
    the spans, so no task holds the whole histogram but its spans. The histogram is written once,
    as it is read twice and its texts should not be encoded twice.
    """
    histogram = Scratch(lengths.sparkSession, "lengths").keep(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "histogram").withColumn("span", F.floor(F.col("length") / SPAN))
    spans = histogram.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select("span", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    own = Window.partitionBy("span").orderBy(F.desc("length"))
    x = histogram.join(F.broadcast(spans), "span")  # one row for every 1024 tokens of the longest text
    at_least, tokens = F.sum("n_docs").over(own) + F.col("later_d"), F.sum(F.col("n_docs") * F.col("length")).over(own) + F.col("later_t")
    x = x.select("length", "n_docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"), "total_docs", "total_tokens")
    return x.withColumns({"truncated_tokens": F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"), "share_within": (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")})


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Truncated totals for any limits (column ``limit``), which need not occur as lengths: from
    the least length at or above each limit, everything at or above it is cut to the limit.

    Limits and lengths are sorted together, by spans; a span's last limits take the first length of
    the spans after it. Beyond all lengths nothing is cut."""
    total = sums.agg(F.max("total_tokens").alias("t")).first().t or 0
    rows = sums.select(F.col("length").alias("value"), F.struct("docs_at_least", "tokens_at_least").alias("s"), F.lit(None).cast("long").alias("limit"))
    asked = limits.select(F.col("limit").cast("long").alias("value"), F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.col("limit").cast("long").alias("limit"))
    x = rows.union(asked).withColumn("span", F.floor(F.col("value") / SPAN))
    onward = Window.partitionBy("span").orderBy("value", F.col("limit").isNull()).rowsBetween(0, Window.unboundedFollowing)
    later = Window.orderBy("span").rowsBetween(1, Window.unboundedFollowing)
    heads = x.groupBy("span").agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("value"))).alias("head"))
    heads = heads.select("span", F.first("head", ignorenulls=True).over(later).alias("after"))  # one row a span
    x = x.withColumn("own", F.first("s", ignorenulls=True).over(onward)).filter("limit is not null").join(heads, "span").withColumn("s", F.coalesce("own", "after"))
    docs, tokens = F.coalesce("s.docs_at_least", F.lit(0)), F.coalesce("s.tokens_at_least", F.lit(0))
    return x.select("limit", (F.lit(total) - tokens + F.col("limit") * docs).alias("truncated_tokens"), docs.alias("docs_at_least"))
