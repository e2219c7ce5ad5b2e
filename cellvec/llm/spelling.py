"""Spelling variants: words one edit apart, each with the near word that it is most likely a variant of.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered; a run whose crc32 with its document's id 97
divides has lost one character (as a typist would). Words of five characters and three occurrences count.
Null texts have no words; a null id reads as ''. Repeated rows count each; extra columns are ignored; empty table:
no rows. A very long run is a word as any other; a very long text needs some 20 times its size in memory.

Near words are found by a positional q-gram index. A word within one edit of a longer or as long one has all grams
of the longer in common with it but q, at the same place or one before, so the rarest gram they share is among the
first q + 1 of the longer and the first q of the shorter, in any order of the grams. The index holds each word under
its rarest grams, with their place and the length of the longer word. The words of one key, held together, merge the
postings of their grams under limits of length and place; pairs that enough grams lead to are compared. A key of
more than ``BUCKET`` words is dealt by pairs of its parts.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import count_cells
from .runs import by_text, runs
from .scratch import Scratch
from .texthash import blocks, mix

LEAST_LENGTH, LEAST_TIMES, LOSS = 5, 3, 97
#: Bytes of text whose words are counted at once.
BLOCK = 8 << 20
#: Words of a bucket, of which more are dealt by pairs of parts of this size.
BUCKET = 4096


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of a run: a-z, A-Z and both bytes of U+00C0 to U+00FF."""
    low = data | 0x20
    lead = data == 0xC3
    out = (low >= 0x61) & (low <= 0x7A) | lead
    out[1:] |= lead[:-1]
    return out


CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def crc_after(starts: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts with the crc32 ``starts`` and then of data[begin : begin + length], for all at once."""
    out = ~starts
    order = np.argsort(-length, kind="stable")
    sizes = length[order]
    state, at = out[order], begin[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, side="left"))  # those longer than k
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    out[order] = state
    return ~out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every run, with its loss, of five characters or more; sums of a block leave each task."""

    def count(batches):
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                number, words, first = runs(block.column("text"), letters)
                size = pa.compute.utf8_length(words).to_numpy()
                long = size[number] >= LEAST_LENGTH if len(words) else np.zeros(0, bool)
                first = np.concatenate(([0], np.cumsum(long)))[first]
                text, word, times = by_text(number[long], first, len(words))
                _, offsets, data = words.buffers()
                at = np.frombuffer(offsets, np.int64)
                data = np.frombuffer(data or b"", np.uint8)
                heads = np.array([zlib.crc32(f"{i}:".encode()) for i in block.column("doc_id").to_pylist()], dtype=np.uint32)
                h = crc_after(heads[text], data, at[word], at[word + 1] - at[word])
                lost = h % LOSS == 0
                whole = np.bincount(word[~lost], times[~lost], len(words)).astype(np.int64)
                shorter: Counter = Counter()
                for w, x, n in zip(word[lost].tolist(), h[lost].tolist(), times[lost].tolist(), strict=True):
                    k = x % int(size[w])
                    t = words[w].as_py()
                    shorter[t[:k] + t[k + 1 :]] += n
                used = np.flatnonzero(whole)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(used)).cast(pa.string()), pa.array(whole[used])], names=["word", "n"])
                if shorter:
                    yield pa.RecordBatch.from_arrays([pa.array(list(shorter), pa.string()), pa.array(list(shorter.values()), pa.int64())], names=["word", "n"])

    x = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(count, "word string, n long").filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))


def width(longer):
    """q of pairs whose longer word has so many characters: half of them at most, so that one gram at least stays whole."""
    return np.minimum(longer // 2, 7)


def letters_of(words: list[str], longer: int) -> np.ndarray:
    """Code points, below 256, of words of up to ``longer`` characters, one row each."""
    return np.frombuffer("".join(w.ljust(longer, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), longer)


def gram_hashes(code: np.ndarray, longer: int) -> np.ndarray:
    """64-bit hashes of the grams of words of one length (rows of code points) among words of up to ``longer`` characters."""
    q = int(width(longer))
    places = code.shape[1] - q + 1
    out = np.full((len(code), places), longer, dtype=np.uint64)
    for k in range(q):
        out = out * np.uint64(0x100000001B3) + code[:, k : k + places].astype(np.uint64)
    return mix(out)


def by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the array, code points) of the words of each length."""
    size = pa.compute.utf8_length(words).to_numpy()
    text = words.to_pylist()
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        for i in range(0, len(some), max(1, BLOCK // (64 * n))):
            part = some[i : i + max(1, BLOCK // (64 * n))]
            yield n, part, letters_of([text[k] for k in part.tolist()], n)


def gram_counts(words: DataFrame) -> np.ndarray:
    """Counts of grams by the first bits of their hashes: a table that is bounded (2**22 cells), as any order of the
    grams gives the same pairs."""
    bits = int(np.clip(np.ceil(np.log2(max(1, words.count()) * 16)), 12, 22))

    def hashes(batch):
        for n, _, code in by_length(batch.column(0)):
            for longer in (n, n + 1):
                yield gram_hashes(code, longer).reshape(-1)

    return count_cells(words.select("word"), hashes, bits)


def keys(code: np.ndarray, longer: int, rarity: np.ndarray) -> np.ndarray:
    """Keys of the index for words of one length, one row each: their rarest grams (equal ones by place), with place and
    length. A gram of a word that lacks a character may stand one place later in the longer one."""
    h = gram_hashes(code, longer)
    q, short = int(width(longer)), code.shape[1] < longer
    bits = int(len(rarity)).bit_length() - 1
    at = np.broadcast_to(np.arange(h.shape[1]), h.shape)
    order = np.lexsort((at, h, rarity[(h >> np.uint64(64 - bits)).astype(np.int64)]), axis=1)[:, : q + 1 - short]
    rare, at = np.take_along_axis(h, order, axis=1), order.astype(np.uint64)
    later = [at, at + np.uint64(1)] if short else [at]
    return np.concatenate([mix(rare + p * np.uint64(0x9E3779B97F4A7C15)) for p in later], axis=1).view(np.int64)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes a into b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))  # noqa: B905  the shorter ends first
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def merged(bucket: list[str], longer: int) -> Iterator[tuple[int, int]]:
    """Index pairs (j before i) of the near words of a small bucket, to which enough common grams lead by a heap."""
    q = int(width(longer))
    least = longer - 2 * q + 1
    postings: dict[str, list[tuple[int, int]]] = {}
    for i, word in enumerate(bucket):
        own = [word[k : k + q] for k in range(len(word) - q + 1)]
        found = [[j for j, at in postings.get(g, ()) if abs(at - p) <= 1] for p, g in enumerate(own)]  # limit of position
        for j, same in groupby(heapq.merge(*(f for f in found if f))):
            if sum(1 for _ in same) >= least and (len(word) == longer or len(bucket[j]) == longer) and one_edit(word, bucket[j]):
                yield j, i
        for p, g in enumerate(own):
            postings.setdefault(g, []).append((i, p))


def merged_at_once(bucket: list[str], longer: int, items: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """As ``merged``, for a large bucket: the postings of many words' grams are laid behind each other and merged by one
    stable sort, some ``items`` at once."""
    q, n = int(width(longer)), len(bucket)
    least = longer - 2 * q + 1
    size = np.fromiter(map(len, bucket), np.int64, n)
    code = letters_of(bucket, longer).astype(np.int64)
    gram = sum(code[:, k : longer - q + 1 + k] << (8 * k) for k in range(q))  # characters are below 256
    places = gram.shape[1]
    gram[size < longer, -1] = -1  # not whole
    word, place = np.repeat(np.arange(n), places), np.tile(np.arange(places), n)
    flat = gram.reshape(-1)
    order = np.argsort(flat, kind="stable")
    word_of, place_of, sorted_ = word[order], place[order], flat[order]
    begin = np.searchsorted(sorted_, flat, side="left")
    times = np.where(flat < 0, 0, np.searchsorted(sorted_, flat, side="right") - begin)
    ends = np.cumsum(times)
    i = 0
    while i < len(flat):
        k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + items, side="right")))
        k = min(len(flat), -(-k // places) * places)  # whole words
        own = times[i:k]
        at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[i:k], own)
        probe = np.repeat(np.arange(i, k), own)
        a, b = word[probe], word_of[at]
        good = (b < a) & (np.abs(place[probe] - place_of[at]) <= 1) & ((size[a] == longer) | (size[b] == longer))
        both = np.sort(a[good] * n + b[good], kind="stable")
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        many = first[np.diff(np.concatenate((first, [len(both)]))) >= least]
        found = both[many]
        for c in range(0, len(found), max(1, items // longer)):
            a, b = np.divmod(found[c : c + max(1, items // longer)], n)
            near = one_edits(code, size, longer, a, b)
            yield from zip(b[near].tolist(), a[near].tolist(), strict=True)
        i = k


def one_edits(code: np.ndarray, size: np.ndarray, longer: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``one_edit`` of words a and b (rows of ``code``, one at least of ``longer`` characters), for many at once."""
    same = size[a] == size[b]
    a, b = np.where(size[a] == longer, a, b), np.where(size[a] == longer, b, a)  # the longer first
    equal = code[a] == code[b]
    moved = code[a, 1:] == code[b, :-1]
    before = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
    after = np.logical_and.accumulate(moved[:, ::-1], axis=1).sum(axis=1)
    return np.where(same, equal.sum(axis=1) == longer - 1, before + after >= longer - 1)


def near_words(spark: SparkSession, words: DataFrame, scratch: Scratch, most: int = BUCKET) -> DataFrame:
    """(word, n, other, m) of all near words (word, n), both ways. ``words`` should be a written table."""
    rarity = spark.sparkContext.broadcast(gram_counts(words))

    def deal(batches):
        for batch in batches:
            for size, rows, code in by_length(batch.column("word")):
                for longer in (size, size + 1):
                    key = keys(code, longer, rarity.value)
                    of = pa.array(np.repeat(rows, key.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.full(key.size, longer, np.int32)), batch.column("word").take(of), batch.column("n").take(of)], names=["key", "longer", "word", "n"])

    x = scratch.keep(words.mapInArrow(deal, "key long, longer int, word string, n long"), "index")
    large = scratch.keep(x.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "large")
    alone = {"part": F.lit(0), "apart": F.lit(False)}
    if large.isEmpty():
        x = x.withColumns(alone)
    else:  # each part meets each other part, and itself
        hot = x.join(large, "key").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        hot = hot.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("apart", F.col("part") != F.col("with"))
        hot = hot.withColumn("key", F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))).select(*x.columns, *alone)
        x = x.join(large, "key", "left_anti").withColumns(alone).unionByName(hot)
    near = x.repartition("key").sortWithinPartitions("key", "longer", "apart").mapInArrow(near_in_order, "word string, n long, other string, m long")
    near = scratch.keep(near.distinct(), "near")
    return near.union(near.select("other", "m", "word", "n"))


#: Words of a bucket from which its postings are merged at once.
MANY = 5


def near_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows that come sorted by key of the index; the words of one key are held at a time."""
    rest = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        change = np.zeros(max(0, held.num_rows - 1), dtype=bool)
        for name in ("key", "longer", "apart"):
            v = held.column(name).to_numpy()
            change |= v[1:] != v[:-1]
        ends = np.flatnonzero(change) + 1
        rest = held.slice(ends[-1] if len(ends) else 0)
        yield near_pairs(held, np.concatenate(([0], ends)).astype(np.int64))
    if rest is not None and rest.num_rows:
        yield near_pairs(rest, np.array([0, rest.num_rows]))


def near_pairs(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    """Near pairs of each bucket, from one of ``ends`` to the next; a pair that some buckets have comes once."""
    out = set()
    word, n, part = (rows.column(c).to_pylist() for c in ("word", "n", "part"))
    longers, apart = rows.column("longer").to_numpy(), rows.column("apart").to_numpy()
    whole = np.concatenate(([0], np.cumsum(pa.compute.utf8_length(rows.column("word")).to_numpy() == longers)))
    some = np.flatnonzero((np.diff(ends) > 1) & (whole[ends[1:]] > whole[ends[:-1]]))  # words that lack a character alone don't meet here
    for begin, end in zip(ends[some].tolist(), ends[some + 1].tolist(), strict=True):
        for j, i in (merged if end - begin < MANY else merged_at_once)(word[begin:end], int(longers[begin])):
            i, j = begin + i, begin + j
            if not (apart[i] and part[i] == part[j]):
                out.add((word[i], n[i], word[j], n[j]) if word[i] < word[j] else (word[j], n[j], word[i], n[i]))
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "other", "m"])


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. A form has twice the occurrences of its word at least,
    so chains are short, and each round doubles the steps taken; there are as many rounds as a chain's length has bits."""
    x = scratch.keep(forms.select("word", F.col("form").alias("root")), "root")
    while True:
        after = x.select(F.col("word").alias("root"), F.col("root").alias("after"))
        step = scratch.keep(x.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "root")
        x = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return x


def group_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    scratch = Scratch(spark, "spelling")
    words = scratch.keep(word_counts(docs).filter(F.col("n") >= LEAST_TIMES), "words")
    near = near_words(spark, words, scratch)
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    good = -F.col("best.m") >= 2 * F.col("n")
    near = scratch.keep(near.select("word", "n_near", F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "forms")
    x = words.join(near, "word", "left").join(roots(near.filter("form is not null"), scratch), "word", "left")
    return x.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
