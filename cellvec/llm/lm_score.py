"""Stupid-backoff scores with counts over the whole corpus, each document left out of its own.

The count tables are partitioned by hash, and n-grams join them by hash; but rows of one n-gram each
(some 13 bytes, for 540 million of document and n-gram on 1 GB of input) would shuffle over 6 times
the input each way. So documents are dealt to blocks of about BLOCK_BYTES of text. A block counts its n-grams once and
sends (hash, count), sorted and cut by hash ranges, to the count tables: one row per block, length and
range, which holds that block's part as two compressed columns, so n-grams travel as a few bytes
and not as rows of their own. A range adds up its parts and returns to each block, in the order
of its hashes and without them, the counts that other blocks have. Blocks then meet these by a
join on the block (its texts' shuffle is read twice, made once), count their n-grams again, look
up the exploded ones and sum by document. Ranges and blocks grow in number with the corpus, not
in size.

Words as in the n-gram join (A-Z lowered). With counts c of all documents but the scored one,
S(w | context) = c(context w) / c(context) if the former is above 0, else BACKOFF times
S(w | shorter context); at last c(w) / words, or 1 / (words + 1) for a word met nowhere else.

Null and empty texts score 0. Rows of equal doc_id, or of none, are documents of their own, dealt to
blocks by their place in the table, which must read in the same order again. Extra columns are
ignored; empty table: no rows. N-grams are hashes of 52 bits or more, as the corpus needs. A block needs some 15 times its text in
memory, and so does one text larger than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texthash import PLACES, blocks, flat, mix, words

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 12 << 20
RANGE_GRAMS = 1 << 20
SLICE_BYTES = 1 << 20
#: Bits of a hash beyond the logarithm of the corpus' n-grams, and the least: a chance of 2**-24 at most to meet another.
SPARE_BITS, LEAST_BITS = 24, 52
ALL = np.uint64(2**64 - 1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, slice by slice, which keeps the arrays over bytes small."""
    hashes, first = [], [np.zeros(1, np.int64)]
    for part in blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE_BYTES):
        h, at = words(*flat(part.column(0)))
        hashes.append(h)
        first.append(at[1:] + first[-1][-1])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(first)


def grams(h: np.ndarray, first: np.ndarray, order: int, kept: np.uint64 = ALL) -> Iterator[np.ndarray]:
    """For n = 1 .. order the hash of the n-gram that ends at each word, less the bits not ``kept``; 0 where a text's first words have none."""
    depth = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    total = h * PLACES[0]
    yield mix(total + PLACES[10]) & kept
    for n in range(2, order + 1):
        total[n - 1 :] += h[: max(0, len(h) - n + 1)] * PLACES[n - 1]
        g = mix(total + PLACES[10] * np.array([n], dtype=np.uint64)) & kept
        g[depth < n - 1] = 0
        yield g


def small_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, block, text), texts compressed for the way."""

    def press(batches):
        for batch in batches:
            held = [zstandard.compress((t or "").encode(), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), pa.array(held, pa.binary())], names=["doc_id", "block", "text"])

    return docs.select("doc_id", "block", "text").mapInArrow(press, "doc_id long, block long, text binary")


def block_texts(table: pa.Table) -> pa.Array:
    return pa.array([zstandard.decompress(t.as_py()).decode() for t in table.column("text")], pa.large_string())


def pressed(numbers: np.ndarray) -> bytes:
    """Numbers as one compressed string, first all lowest bytes, then all second ones and so on."""
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpressed(held: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(held), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def edges_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of hashes starts in sorted ones, and the end."""
    return np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(h)])


def runs_of(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a block's n-grams and their counts; and for each n-gram, in the order of ``at``, its
    place among these and how often its own text holds it."""
    at = np.argsort(g, kind="stable")  # texts stay in order within an n-gram
    at = at[np.count_nonzero(g == 0) :]
    s, d = g[at], doc[at]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    apart = new.copy()
    apart[1:] |= d[1:] != d[:-1]
    starts, parts = np.flatnonzero(new), np.flatnonzero(apart)
    own = np.repeat(np.diff(np.append(parts, len(s))), np.diff(np.append(parts, len(s))))
    return s[starts], np.diff(np.append(starts, len(s))), at, np.cumsum(new) - 1, own


def score_block(h: np.ndarray, first: np.ndarray, order: int, others: Callable[[int, np.ndarray], np.ndarray], corpus_words: int, kept: np.uint64 = ALL) -> tuple[np.ndarray, np.ndarray]:
    """Words and log score of each text. others(n, hashes) gives the counts of a block's n-grams in other blocks."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    counts, there = [], []
    for k, g in enumerate(grams(h, first, order, kept)):
        known, held, at, which, own = runs_of(g, doc)
        left = np.zeros(len(g), np.int64)
        left[at] = (held + others(k + 1, known))[which] - own
        counts.append(left)
        there.append(g != 0)
    score, done = np.zeros(len(doc)), np.zeros(len(doc), dtype=bool)
    for k in range(order - 1, 0, -1):
        context = np.zeros_like(counts[0])
        context[1:] = counts[k - 1][:-1]
        hit = ~done & (counts[k] > 0)
        score[hit] += np.log(counts[k][hit] / context[hit])
        done |= hit
        score[~done & there[k]] += np.log(BACKOFF)
    rest = ~done
    single, total = counts[0][rest], (corpus_words - n)[doc][rest]
    score[rest] += np.log(np.where(single > 0, single / np.maximum(1, total), 1.0 / (total + 1)))
    return n, np.bincount(doc, weights=score, minlength=len(n))


def score_documents(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score) per document."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = x.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    total_bytes, corpus_words = size.bytes or 0, size.words or 0
    n_blocks = total_bytes // BLOCK_BYTES + 1
    bits = max(0, int(np.ceil(np.log2(max(1, corpus_words / RANGE_GRAMS)))))
    bits_kept = int(np.clip(np.ceil(np.log2(max(1, corpus_words * order))) + SPARE_BITS, LEAST_BITS, 64))
    kept = np.uint64(2**64 - 2 ** (64 - bits_kept))
    x = x.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_blocks)))  # rows alike go to many blocks

    x = small_texts(x)

    def send(table: pa.Table) -> pa.Table:
        h, first = word_hashes(block_texts(table))
        block, ranges, hashes, counts = table.column("block")[0].as_py(), [], [], []
        for n, g in enumerate(grams(h, first, order, kept), 1):
            known, held = np.unique(g[g != 0], return_counts=True)
            edges = edges_of(known, bits)
            for r in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[r], edges[r + 1])
                ranges.append((n << 48) + r)
                hashes.append(pressed(np.diff(known[part], prepend=np.uint64(0))))
                counts.append(pressed(held[part].astype(np.uint32)))
        return pa.table({"range": pa.array(ranges, pa.int64()), "block": pa.array([block] * len(ranges), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpressed(b, np.uint64), dtype=np.uint64) for b in table.column("hashes").to_pylist()]
        n = np.concatenate([unpressed(b, np.uint32) for b in table.column("counts").to_pylist()]).astype(np.int64)
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        others = np.bincount(which, weights=n).astype(np.int64)[which] - n
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"block": table.column("block"), "range": table.column("range"), "others": pa.array([pressed(o) for o in np.split(others, ends[:-1])], pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        h, first = word_hashes(block_texts(left))
        held = dict(zip(right.column("range").to_pylist(), right.column("others"), strict=True))

        def others(n: int, known: np.ndarray) -> np.ndarray:
            out, edges = np.zeros(len(known), np.int64), edges_of(known, bits)
            for r in np.flatnonzero(np.diff(edges)).tolist():
                out[edges[r] : edges[r + 1]] = unpressed(held[(n << 48) + r].as_py(), np.int64)
            return out

        n, s = score_block(h, first, order, others, corpus_words, kept)
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "log_score": pa.array(s)})

    sent = x.groupBy("block").applyInArrow(send, "range long, block long, hashes binary, counts binary")
    totals = sent.groupBy("range").applyInArrow(add, "block long, range long, others binary")
    return x.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score double")
