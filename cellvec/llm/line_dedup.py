"""Fuzzy line de-duplication by MinHash.

Lines are what line feeds separate. A line's set is its distinct runs of SHINGLE characters (the
whole line, if shorter). Its signature is one permutation hashing: the least hash in each of
BANDS * ROWS ranges; an empty range takes the value of another one, chosen by a hash of the
range. Lines that agree in all rows of a band are candidates: at similarity 0.8 a pair agrees in
some band with probability 1 - (1 - 0.8**5)**12 = 0.99. Candidates are verified by the exact
Jaccard similarity of their sets and joined to components (``linking``). Of each component the
first line stays, by (doc_id, document, line number), nulls last.

Lines without a character other than white space always stay and link with nothing. Null text
has no lines. Rows of equal doc_id and text are one document and keep the same lines. Equal lines
are one class from the first shuffle on. Columns of any name pass through ``dedup_lines`` and are
ignored elsewhere; empty table: no rows. A text longer than a block of BLOCK bytes is a block of its
own; a block needs some 100 times its size in memory.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .cells import Bitmap, cell_of, only
from .linking import link_buckets
from .memory import freeing
from .scratch import Scratch
from .texthash import BASE, BASE_INVERSE, PLACES, blocks, flat, lists, mix, overlap, powers, signed

SHINGLE = 8
BANDS, ROWS = 12, 5
BINS = BANDS * ROWS
ALIKE = 80
SIGNS = 8
BLOCK = 1 << 19
#: Lines gone from a text up to which SQL functions cut it.
FEW = 1_000
#: Hashes of lines that a task remembers, so as not to work on equal lines again.
SEEN = 1 << 18
NONE = np.uint64(2**64 - 1)
#: Bytes as numbers above 0, and those that are no white space.
BYTES = np.arange(1, 257, dtype=np.uint64)
SOLID = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Lines:
    """The lines of a block of texts as bytes; digests of all and, from code points, signatures and sets of some. Each is
    computed when asked for."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = flat(texts)
        feed = np.flatnonzero(self.data == 10)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        self.start = np.sort(np.concatenate((offsets[filled], feed + 1)))
        self.stop = np.sort(np.concatenate((feed, offsets[filled + 1])))
        self.text = np.repeat(filled, np.searchsorted(feed, offsets[filled + 1]) - np.searchsorted(feed, offsets[filled]) + 1)

    @property
    def number(self) -> np.ndarray:
        return np.arange(len(self.text)) - np.searchsorted(self.text, self.text)

    @cached_property
    def blank(self) -> np.ndarray:
        solid = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(SOLID[self.data], out=solid[1:])
        return solid[self.stop] == solid[self.start]

    @cached_property
    def d1(self) -> np.ndarray:
        return self.digest(BASE, BASE_INVERSE)

    @cached_property
    def d2(self) -> np.ndarray:
        return self.digest(int(PLACES[9]), pow(int(PLACES[9]), -1, 1 << 64))

    def digest(self, base: int, inverse: int) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.multiply(BYTES[self.data], powers(base, n)[:n], out=total[1:])
        np.cumsum(total, out=total)
        return mix((total[self.stop] - total[self.start]) * powers(inverse, n)[self.start] + (self.stop - self.start).astype(np.uint64))

    def string(self, i: int) -> str:
        return self.data[self.start[i] : self.stop[i]].tobytes().decode("utf-8")

    @cached_property
    def code(self) -> np.ndarray:
        return np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The first code point of each line, and the one behind its last."""
        if len(self.code) == len(self.data):
            return self.start, self.stop
        heads = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return heads[self.start], heads[self.stop]

    def signatures(self, some: np.ndarray) -> np.ndarray:
        """BINS values for each of the lines ``some``, none of them blank."""
        h, (start, stop) = self.runs(), self.ends
        length = stop[some] - start[some]
        n = np.maximum(length - SHINGLE + 1, 0)
        line = np.repeat(np.arange(len(some)), n)
        ends = np.cumsum(n)
        value = h[np.repeat(start[some] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        out = np.full(len(some) * BINS, NONE, dtype=np.uint64)
        np.minimum.at(out, line * BINS + self.bin(value), value)
        short = np.flatnonzero(n == 0)
        value = self.d1[some[short]] if len(short) else value[:0]
        out[short * BINS + self.bin(value)] = value
        return fill_empty(out.reshape(-1, BINS))

    def sets(self, some: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct hashes of the runs of SHINGLE characters of the lines ``some``."""
        h, (start, stop) = self.runs(), self.ends
        out = []
        for i in some.tolist():
            a, b = start[i], stop[i]
            s = np.sort(h[a : b - SHINGLE + 1]) if b - a >= SHINGLE else self.d1[i : i + 1]
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        return out

    def whole_sets(self) -> list[np.ndarray]:
        """``sets`` of texts that are one line each."""
        return self.sets(np.arange(len(self.start)))

    def runs(self) -> np.ndarray:
        """A hash of the SHINGLE characters from each character on."""
        h, width = self.code, 1
        while width < SHINGLE:
            h = h[: len(h) - width] * PLACES[width] + h[width:] if len(h) > width else h[:0]
            width *= 2
        return mix(h)

    @staticmethod
    def bin(value: np.ndarray) -> np.ndarray:
        return (((value >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)


def fill_empty(grid: np.ndarray) -> np.ndarray:
    """Empty ranges take another range's value; which, depends on the range and on which are empty."""
    was = grid.copy()
    line, place = np.nonzero(was == NONE)
    for attempt in range(1, 100):
        if not len(line):
            return grid
        source = (mix(np.arange(BINS, dtype=np.uint64) * PLACES[8] + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)[place]
        found = was[line, source]
        good = found != NONE
        grid[line[good], place[good]] = found[good]
        line, place = line[~good], place[~good]
    some = np.argmax(was[line] != NONE, axis=1)
    grid[line, place] = was[line, some]
    return grid


def band_keys(grid: np.ndarray) -> np.ndarray:
    """A 32-bit key for each band of each line."""
    parts = grid.reshape(-1, BANDS, ROWS)
    return (mix((parts * PLACES[:ROWS]).sum(axis=2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unseen(hashes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the first of each hash that is not in ``seen``, which takes them in; it starts anew when full."""
    values, first = np.unique(hashes, return_index=True)
    fresh = [i for h, i in zip(values.tolist(), first.tolist(), strict=True) if h not in seen]
    if len(seen) > SEEN:
        seen.clear()
    seen.update(hashes[fresh].tolist())
    return np.array(fresh, dtype=np.int64)


def line_index(docs: DataFrame) -> DataFrame:
    """Every non-blank line: (doc_id, document, line, d1, d2), and the band keys of the first of a task's equal lines."""

    def index(batches):
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                x = Lines(block.column("text"))
                full = np.flatnonzero(~x.blank)
                if not len(full):
                    continue
                once = unseen(x.d1[full], seen)
                bands = [np.zeros(0, np.int32)] * len(full)
                for i, k in zip(once.tolist(), band_keys(x.signatures(full[once])), strict=True):
                    bands[i] = k
                text = pa.array(x.text[full])
                own = [block.column(c).take(text) for c in ("doc_id", "document")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(x.number[full].astype(np.int32)), pa.array(signed(x.d1[full])), pa.array(signed(x.d2[full])), lists(bands, pa.int32())], names=["doc_id", "document", "line", "d1", "d2", "bands"])

    return docs.mapInArrow(freeing(index), "doc_id long, document long, line int, d1 long, d2 long, bands array<int>")


def line_sets(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """(d1, d2, n, s0 .., string) of the lines that the bitmap has, once a task: the size of a line's set, the
    parities of its hashes' counts in 64 * SIGNS cells, and its text."""

    def fetch(batches):
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                x = Lines(block.column("text"))
                hit = np.flatnonzero(wanted.has(x.d1) & ~x.blank)
                hit = hit[unseen(x.d1[hit], seen)]
                if len(hit):
                    strings = pa.array([x.string(i) for i in hit])
                    sets = Lines(strings).whole_sets()
                    n = np.array([len(s) for s in sets])
                    cell = cell_of(np.concatenate(sets), 6 + int(np.log2(SIGNS))) + np.repeat(np.arange(len(hit)), n) * 64 * SIGNS
                    odd = np.packbits((np.bincount(cell, minlength=64 * SIGNS * len(hit)) & 1).astype(np.uint8).reshape(len(hit), -1), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(x.d1[hit])), pa.array(signed(x.d2[hit])), pa.array(n, pa.int32()), *(pa.array(odd[:, k]) for k in range(SIGNS)), strings], names=["d1", "d2", "n", *(f"s{k}" for k in range(SIGNS)), "string"])

    return docs.select("text").mapInArrow(freeing(fetch), "d1 long, d2 long, n int" + "".join(f", s{k} long" for k in range(SIGNS)) + ", string string")


def alike_lines(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of (a, b, x, y) whose lines' sets have 100 * overlap >= ALIKE * union."""

    def compare(batches):
        for batch in (c for a in batches for b in blocks(a, "y", BLOCK) for c in blocks(b, "x", BLOCK)):
            if batch.num_rows:
                column = batch.column("x").dictionary_encode()  # a hub's line comes with all its pairs
                own = Lines(column.dictionary).whole_sets()
                x, y = (own[i] for i in column.indices.to_pylist()), Lines(batch.column("y")).whole_sets()
                sizes = [(len(p), len(q), overlap(p, q)) for p, q in zip(x, y, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array([100 * c >= ALIKE * (p + q - c) for p, q, c in sizes], pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(freeing(compare), "a long, b long")


def may_be_alike(x, y):
    """Each cell of odd count in one set and even in the other holds a shingle of one set only."""
    apart = sum((F.bit_count(x(f"s{k}").bitwiseXOR(y(f"s{k}"))) for k in range(SIGNS)), F.lit(0))
    return F.lit(100 + ALIKE) * apart <= F.lit(100 - ALIKE) * (x("n") + y("n"))


def link_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every non-blank line: (doc_id, document, line), the first line of its component
    (first_doc_id, first_document, first_line), and kept: whether it is that line."""
    scratch = Scratch(spark, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("document", F.xxhash64("text"))
    index = scratch.keep(line_index(docs), "index")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "document", "line")
    classes = index.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max("bands").alias("bands"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("id", F.posexplode("bands").alias("band", "key")).select(F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("bucket"), "id")
    held: list[DataFrame] = []

    def narrow(ids):
        need = scratch.keep(classes.select("id", "d1", "d2").join(ids, "id", "left_semi").select("d1", "d2", "id"), "need")
        sets = need.join(line_sets(docs, Bitmap(need, "d1")), ["d1", "d2"])
        columns = ["id", "n", *(f"s{k}" for k in range(SIGNS)), "string"]
        sets = scratch.keep(sets.groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in columns)).select(*columns), "sets")
        held.append(sets.select("id", "string"))
        return sets.drop("string")

    def verify(pairs):
        texts = only(held[0], "id", pairs.select(F.explode(F.array("a", "b")).alias("id")))
        x, y = texts.select(F.col("id").alias("a"), F.col("string").alias("x")), texts.select(F.col("id").alias("b"), F.col("string").alias("y"))
        return alike_lines(pairs.join(y, "b").join(x, "a"))

    label = link_buckets(spark, scratch, buckets, narrow, may_be_alike, verify)
    named = classes.select("id", "d1", "d2", "first").join(label, "id", "left")
    groups = named.filter("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(groups, "component", "left").select("d1", "d2", F.coalesce("least", "first").alias("least"))
    out = index.select("doc_id", "document", "line", "d1", "d2").join(named, ["d1", "d2"])
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("document") == F.col("least.document")) & (F.col("line") == F.col("least.line"))
    return out.select("doc_id", "document", "line", F.col("least.doc_id").alias("first_doc_id"), F.col("least.document").alias("first_document"), F.col("least.line").alias("first_line"), kept.alias("kept"))


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Each text without the lines of the numbers ``gone``; null stays null."""
    return pd.Series([None if t is None else "\n".join(np.delete(np.array(t.split("\n"), dtype=object), g)) for t, g in zip(text, gone, strict=True)], dtype=object)


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that are not kept. Documents that had a line and have none left go;
    texts without such lines stay as they are. A column n_chars follows the text."""
    gone = link_lines(spark, docs).filter("not kept").groupBy("doc_id", "document").agg(F.collect_set("line").alias("gone"))
    row = F.col("row")
    text = row.getField("text").cast("string")
    keyed = docs.select(F.struct("*").alias("row")).withColumns({"own_id": row.getField("doc_id").cast("long"), "own_text": F.xxhash64(text)})
    x = keyed.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_text") == F.col("document")), "left")
    few = F.size("gone") <= FEW
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    rest = without_lines(F.when(~few, text), F.when(~few, F.col("gone")))  # else lines times lines gone are looked at
    x = x.select("row", F.col("gone").isNotNull().alias("cut"), F.when(few, kept).otherwise(rest).alias("new"))
    x = x.filter("not cut or trim(both ' \t\r\n\u000b\f' from new) != ''")
    changed = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return x.select(*(F.when(F.col("cut"), changed[c]).otherwise(row.getField(c)).alias(c) if c in changed else row.getField(c).alias(c) for c in docs.columns))
