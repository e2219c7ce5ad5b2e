"""Near copies among embeddings by iterative quantisation and multi-index Hamming tables.

1. Rotations that make sign codes balanced and near to the vectors are learned on a bounded sample
   (SAMPLE vectors of least hash), of vectors scaled to length 1 less a share of their mean. The share is
   the largest of SHIFTS under which pairs at the threshold (each sample vector and one turned away from
   it by that angle) differ in hardly more bits than without: all of it where vectors lie around 0, less
   where one direction dominates and the rest of two near vectors need not be alike.
2. The code is cut in tables of ``s`` bits, s about log2 of the number of vectors + 2. Each vector
   enters every table under its key and the s keys one bit away, so two vectors whose parts
   differ in at most two bits share a key. The number of tables is set so that the sample's pairs at the
   threshold meet with probability RECALL or more by the binomial law; pairs beyond it more often.
3. Vectors of a key whose codes are no farther apart than the sample's pairs at the threshold become
   candidates, and components as in ``linking``, each pair reranked by the cosine of the original
   vectors in double precision.
4. Links lie within components and are counted exactly there, in blocks of vectors: blocks whose centres
   and radii leave no doubt count or don't as a whole; the vectors of other pairs of blocks are compared.

Vectors that are null, empty or zero, or that hold null or non-finite components, link with
nothing. So do vectors of different lengths with each other. Equal vectors are one class; rows
of equal vec_id are vectors of their own. Extra columns are ignored; empty table: no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linking import link_buckets
from .scratch import Scratch
from .texthash import PLACES, lists, mix, signed

COSINE = 0.9
SAMPLE = 4096
RECALL = 0.97
SHIFTS = (1.0, 0.5, 0.0)
MOST_TABLES = 200
GROUP = 512


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """A rotation R with sign(x R) near to x R: alternate between the codes and the best rotation."""
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
        r = u @ v
    return r


def turned(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit row one at exactly this cosine, in a random direction."""
    away = np.random.default_rng(0).normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    norm = np.sqrt((away * away).sum(axis=1, keepdims=True))
    return cosine * x + (1 - cosine * cosine) ** 0.5 * away / np.where(norm > 0, norm, 1)


def differing_shares(x: np.ndarray, cosine: float, shift: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """The share of bits in which each row's code differs from that of the row turned away."""
    y = turned(x, cosine)
    return np.mean([((x - shift) @ r >= 0) != ((y - shift) @ r >= 0) for r in rotations], axis=(0, 2))


def choose_shift(x: np.ndarray, cosine: float) -> np.ndarray:
    mean = x.mean(axis=0)
    shares = {s: float(differing_shares(x, cosine, s * mean, [learn_rotation(x - s * mean, 0)]).mean()) for s in SHIFTS}
    return next(s for s in SHIFTS if shares[s] <= 1.1 * shares[0.0]) * mean


def table_plan(n: int, shares: np.ndarray, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors, when pairs at the threshold differ in these shares of bits."""
    bits = int(np.clip(round(np.log2(max(2, n))) + 2, 8, 60))
    meet = sum(comb(bits, k) * shares**k * (1 - shares) ** (bits - k) for k in range(3))
    tables = 1
    while np.mean(1 - (1 - meet) ** tables) < recall and tables < MOST_TABLES:
        tables += 1
    return bits, tables


def unit_rows(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of length 1, zeros appended up to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy().astype(float)
    peak = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(peak > 0, peak, 1)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def code_rows(vectors: DataFrame, spark: SparkSession, rotations: list[np.ndarray], shift: np.ndarray, bits: int, tables: int) -> DataFrame:
    """(id, keys, c0 ..): a vector's keys in all tables, and its code as 32-bit numbers."""
    held = spark.sparkContext.broadcast((rotations, shift))
    width = rotations[0].shape[0]
    whole = -(-len(rotations) * width // 32)
    flips = np.concatenate(([0], 1 << np.arange(bits))).astype(np.uint64)

    def encode(batches):
        for big in batches:
            for i in range(0, big.num_rows, 2048):
                batch = big.slice(i, 2048)
                x = unit_rows(batch.column("v"), width) - held.value[1]
                signs = np.concatenate([x @ r >= 0 for r in held.value[0]], axis=1)
                packed = np.zeros((len(x), whole * 4), dtype=np.uint8)
                raw = np.packbits(signs, axis=1)
                packed[:, : raw.shape[1]] = raw
                weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                parts = (signs[:, : bits * tables].reshape(len(x), tables, bits) * weights).sum(axis=2, dtype=np.uint64)
                keys = (parts[:, :, None] ^ flips) * PLACES[0] + np.arange(tables, dtype=np.uint64)[:, None] * PLACES[1]
                keys = mix(keys.reshape(len(x), -1) + batch.column("size").to_numpy().astype(np.uint64)[:, None] * PLACES[2])
                code = packed.view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(list(signed(keys)), pa.int64()), *(pa.array(code[:, k]) for k in range(whole))], names=["id", "keys", *(f"c{k}" for k in range(whole))])

    return vectors.select("id", "v", F.size("v").alias("size")).mapInArrow(encode, "id long, keys array<long>" + "".join(f", c{k} int" for k in range(whole)))


def cosine_column(x: str, y: str):
    def total(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)

    return total(x, y) / F.sqrt(total(x, x)) / F.sqrt(total(y, y))


def count_links(members: DataFrame, cosine: float) -> DataFrame:
    """(id, links): rows of linked classes, from (id, component, v, n, place): n rows of each class.

    A component is cut in blocks of about GROUP vectors, by place (a few bits of the code) and hash. A block's
    centre and radius (the largest angle to it) decide most pairs of blocks; each other pair is a group of its
    own, so no task holds the vectors of more than two blocks. ``members`` is read several times."""
    limit = float(np.arccos(cosine))
    sizes = members.groupBy("component", "place").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    x = members.join(sizes, ["component", "place"]).withColumn("block", F.shiftleft(F.pmod(F.xxhash64("id"), F.col("blocks")), 8) + F.col("place")).drop("blocks", "place")

    def describe(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        column = t.column("v").combine_chunks()
        u = unit_rows(column, int(np.diff(column.offsets.to_numpy()).max()))
        centre = u.mean(axis=0)
        centre /= np.sqrt(centre @ centre) or 1.0
        radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
        return pa.table({"component": t.column("component")[:1], "block": t.column("block")[:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "rows": pa.array([int(t.column("n").to_numpy().sum())], pa.int64())})

    about = x.groupBy("component", "block").applyInArrow(describe, "component long, block long, centre array<double>, radius double, rows long")
    a, b = (about.select("component", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "centre", "radius", "rows"))) for s in "ab")
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    apart = F.when(F.col("block_a") == F.col("block_b"), 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))
    reach = F.col("radius_a") + F.col("radius_b")
    pairs = a.join(b, "component").select("component", "block_a", "block_b", "rows_b", (apart + reach <= limit - 1e-6).alias("all"), (apart - reach > limit + 1e-6).alias("none"))
    surely = pairs.filter("all").groupBy("component", F.col("block_a").alias("block")).agg(F.sum("rows_b").alias("sure"), F.max(F.col("block_a") == F.col("block_b")).alias("own"))
    asked = pairs.filter("not `all` and not `none` and block_a <= block_b").select("component", F.col("block_a").alias("low"), F.col("block_b").alias("high"))
    asked = asked.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))

    def count(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        column = t.column("v").combine_chunks()
        u = unit_rows(column, int(np.diff(column.offsets.to_numpy()).max()))
        own, low, high = (t.column(c).to_numpy() for c in ("block", "low", "high"))
        n = t.column("n").to_numpy()
        near = (u @ u.T) >= cosine
        same = own[:, None] == own[None, :]
        near &= same if low[0] == high[0] else ~same
        np.fill_diagonal(near, False)
        return pa.table({"id": t.column("id"), "links": pa.array((near * n[None, :]).sum(axis=1).astype(np.int64))})

    compared = x.join(asked, ["component", "block"]).groupBy("component", "low", "high").applyInArrow(count, "id long, links long")
    whole = x.join(surely, ["component", "block"]).select("id", (F.col("sure") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("links"))
    return compared.union(whole).groupBy("id").agg(F.sum("links").alias("links"))


def link_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False))) & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    whole = rows.filter("sound").withColumn("v", F.transform("v", lambda e: e + 0.0))
    classes = whole.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    sample = classes.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()
    widths = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if widths.n:
        width = widths.width
        x = unit_rows(pa.array([r.v for r in sample], pa.list_(pa.float64())), width)
        shift = choose_shift(x, cosine)
        first = learn_rotation(x - shift, 0)
        bits, tables = table_plan(widths.n, differing_shares(x, cosine, shift, [first]))
        rotations = [first, *(learn_rotation(x - shift, seed) for seed in range(1, -(-bits * tables // width)))]
        most = int(np.ceil(differing_shares(x, cosine, shift, rotations).max() * 1.05 * len(rotations) * width))
        codes = scratch.keep(code_rows(classes, spark, rotations, shift, bits, tables), "codes")
        attrs = [c for c in codes.columns if c[0] == "c"]

        def close(x, y):
            return sum((F.bit_count(x(a).bitwiseXOR(y(a)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) for a in attrs), F.lit(0)) <= most

        narrow = classes.select("id", "v")

        def verify(pairs):
            x, y = narrow.select(F.col("id").alias("a"), F.col("v").alias("x")), narrow.select(F.col("id").alias("b"), F.col("v").alias("y"))
            return pairs.join(x, "a").join(y, "b").filter(F.size("x") == F.size("y")).filter(cosine_column("x", "y") >= cosine).select("a", "b")

        buckets = codes.select(F.explode("keys").alias("bucket"), "id")
        label = link_buckets(spark, scratch, buckets, lambda ids: codes.select("id", *attrs), close, verify)
        places = codes.select("id", F.shiftrightunsigned("c0", 26).alias("place"))
    else:
        label = spark.createDataFrame([], "id long, component long")
        places = spark.createDataFrame([], "id long, place int")
    linked = scratch.keep(classes.join(label, "id").join(places, "id").select("id", "component", "v", "n", "least", "place"), "linked")
    groups = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    extra = linked.join(groups, "component").select("id", "component_id").join(count_links(linked.select("id", "component", "v", "n", "place"), cosine), "id")
    found = classes.join(extra, "id", "left").select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = whole.join(found, F.col("v") == F.col("w")).select("vec_id", "n_links", "component_id")
    out = out.union(rows.filter("not sound").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
