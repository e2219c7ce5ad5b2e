"""Places of rows in the order of their group, for groups of any size: rows are dealt by ranges, counted in each, and the
counts of the ranges before are added. No group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import keep


def places(df: DataFrame, group: list[str], order: list[str | Column], weight: str | None = None) -> DataFrame:
    """df with ``before``, what comes before a row in its group (rows, or the sum of their weights), and ``total``, that of
    the group. Rows that are alike in ``order`` come as they happen to; the result is a written table's, so it stays
    the same however often it is read. Groups that are null are groups of their own."""
    by = [*(F.col(g) for g in group), *(F.col(o) if isinstance(o, str) else o for o in order), F.monotonically_increasing_id()]
    names = [f"_{k}" for k in range(len(by))]
    x = df.withColumns(dict(zip(names, by, strict=True))).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    x = keep(x.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "places")
    parts = x.groupBy(*group, "_part").agg(F.sum(weight if weight else F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*group))})  # a row for each range and group in it
    parts = parts.withColumnsRenamed({g: f"_g{k}" for k, g in enumerate(group)}).withColumnRenamed("_part", "_p")
    same = [x[g].eqNullSafe(parts[f"_g{k}"]) for k, g in enumerate(group)]
    y = x.join(parts, [x["_part"] == parts["_p"], *same])
    own = F.col("_at") - F.col("_first")
    if weight:
        own = F.coalesce(F.sum(weight).over(Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return y.withColumn("before", F.col("_before") + own).select(*df.columns, "before", "total")


def quantiles(values: DataFrame, group: list[str], wanted: dict[str, float], column: str = "value", accuracy: int = 1000) -> DataFrame:
    """(*group, and one column for each of ``wanted``): exact quantiles, between neighbours by their distance.

    A sketch of each group gives the range around each quantile; what is below the range is counted, and only the few
    values in it are put in order. Where a range misses its rank the whole group is taken. Nulls don't count."""
    x = values.select(*group, F.col(column).cast("double").alias("_v")).filter("_v is not null")
    names, near = list(wanted), 2 / accuracy
    ends = [e for q in wanted.values() for e in (max(0.0, q - near), min(1.0, q + near))]
    s = x.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, accuracy * 10).alias("_a"))
    columns = {}
    for k, q in enumerate(wanted.values()):
        columns |= {f"_lo{k}": F.when(F.lit(q - near <= 0), F.col("_min")).otherwise(F.col("_a")[2 * k]), f"_hi{k}": F.when(F.lit(q + near >= 1), F.col("_max")).otherwise(F.col("_a")[2 * k + 1])}
    s = keep(s.withColumns(columns).drop("_a"), "ranges")  # a row a group
    found = keep(within(x, s, group, wanted), "quantiles")
    missed = found.filter(" or ".join(f"`{n}` is null" for n in names))
    if not missed.isEmpty():
        again = s.join(missed.select(*group), group).withColumns({f"_{e}{k}": F.col(f"_{m}") for k in range(len(names)) for e, m in (("lo", "min"), ("hi", "max"))})
        found = found.join(missed.select(*group), group, "left_anti").unionByName(keep(within(x, again, group, wanted), "quantiles"))
    return found


def within(x: DataFrame, ranges: DataFrame, group: list[str], wanted: dict[str, float]) -> DataFrame:
    """Quantiles whose ranks lie in the ranges (_lo0, _hi0, ..) of their group; null for the others."""
    y = x.join(ranges, group)
    n = len(wanted)
    below = y.groupBy(*group).agg(F.first("_n").alias("_n"), *(F.count_if(F.col("_v") < F.col(f"_lo{k}")).alias(f"_below{k}") for k in range(n)))
    mine = F.array_compact(F.array(*(F.when(F.col("_v").between(F.col(f"_lo{k}"), F.col(f"_hi{k}")), F.lit(k)) for k in range(n))))
    inner = y.select(*group, "_v", F.explode(mine).alias("_k")).groupBy(*group, "_k", "_v").agg(F.count("*").alias("_m"))
    inner = inner.withColumn("_until", F.sum("_m").over(Window.partitionBy(*group, "_k").orderBy("_v")))  # the values of a narrow range
    z = inner.join(below, group)
    out = []
    for k, (name, q) in enumerate(wanted.items()):
        rank = F.col("_n") - 1
        lower, upper = F.floor(rank * q), F.ceil(rank * q)
        at = lambda r, k=k: F.min(F.when((F.col("_k") == k) & (F.col(f"_below{k}") <= r) & (F.col(f"_below{k}") + F.col("_until") > r), F.col("_v")))
        out += [at(lower).alias(f"_l{k}"), at(upper).alias(f"_u{k}"), F.first(rank * q - lower).alias(f"_f{k}")]
    z = z.groupBy(*group).agg(*out)
    return z.select(*group, *((F.col(f"_l{k}") + (F.col(f"_u{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}")).alias(name) for k, name in enumerate(wanted)))
