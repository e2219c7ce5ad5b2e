"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, copies
and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellvec.llm import lengths, line_dedup, linking, lm_score, merkle, mixing, ngram_join, packing, tokens, tool_calls, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket int, n int"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["é漢", "Dog"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(25)]
    out = list(enumerate(base))
    for i, t in enumerate(base[:6]):
        w = t.split()
        w[3] = "other"
        out.append((100 + i, " ".join(w)))
        w[-1] = "last"
        out.append((200 + i, "\n".join([" ".join(w[:30]), " ".join(w[30:])])))
    out += [(300, base[0].upper()), (301, base[0]), (302, None), (303, ""), (304, " \n\t "), (305, "one two"), (306, "ONE  two"), (307, " ".join(rng.choices(words, k=9000))), (None, base[1]), (5, base[5]), (5, base[5]), (308, "line\n\nline\nline <|endoftext|>")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 4}" if k % 5 else None, 0, "x", 1, 2) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets(width=5):
    out = []
    for i, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def least_linked(n, links, ids):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for k in range(n):
        groups.setdefault(find(k), []).append(ids[k])
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(n)]


def test_token_ids_are_those_of_the_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    alphabet = list("ab  \n\t'sé1٣  漢😀!?._\r\x0b\x1c\x85\xa0") + ["<|endoftext|>"]
    some = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)] + [x or "" for _, x in texts()]
    ids, at = tokens.token_ids(pa.array([*some, None]), tokens.vocabulary_path())
    want = [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(some))] == want and at[-1] == at[-2]


def test_packing(spark, docs, empty):
    got = packing.pack_documents(spark, docs).toPandas()
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts():
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % 1024 + 1
        for piece, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if piece == 0 else a + 1024
            want.append((-1 if i is None else i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    have = got.fillna({"doc_id": -1})
    assert sorted(map(tuple, have[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).values.tolist())) == sorted(want)
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.cumsum() - got.length).loc[got.index].eq(got.offset).all() and by.length.sum().max() <= 1024
    assert by.ngroups <= -(-got.length.sum() // 1024) + 1
    assert packing.pack_documents(spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 40, 30_000])
def test_packing_plan_holds_every_piece(n):
    h = np.bincount(np.random.default_rng(n).integers(1, 1025, n), minlength=1025)
    used = packing.plan(h)
    held = np.zeros(1025, dtype=int)
    for lengths_, times in used.items():
        assert sum(lengths_) <= 1024
        for v in lengths_:
            held[v] += times
    assert (held == h).all() and sum(used.values()) <= 1.02 * (h @ np.arange(1025)) / 1024 + 2


def test_ngram_join(spark, docs, empty):
    every = sets()
    links = [(a, b) for a in range(len(every)) for b in range(a) if every[a][1] and every[b][1] and 100 * len(every[a][1] & every[b][1]) >= 80 * len(every[a][1] | every[b][1])]
    least = least_linked(len(every), links, [i for i, _ in every])
    key = lambda t: tuple(-1 if v is None else v for v in t)
    got = sorted(key(r) for r in ngram_join.link_documents(spark, docs).collect())
    assert got == sorted(key((i, len(s), least[k] if s else i)) for k, (i, s) in enumerate(every))
    assert ngram_join.link_documents(spark, empty).count() == 0


def line_set(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def lines_of(rows):
    """(doc_id, document's place, line, text) of distinct (doc_id, text), without blank lines."""
    return [(i, t, k, x) for i, t in {(i, t): 0 for i, t in rows if t is not None} for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\n\x0b\x0c")]


def line_groups(rows):
    """For each of ``rows`` as of lines_of the key of its component's first line."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))
    place = {k: n for n, k in enumerate(order)}
    shingled = [line_set(r[3]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b])]
    return [order[k] for k in least_linked(len(rows), links, [place[k] for k in range(len(rows))])]


def test_line_dedup(spark, docs, empty):
    rows = lines_of(texts())
    want = sorted((str(r[0]), r[2], str(rows[g][0]), rows[g][2], g == k) for k, (r, g) in enumerate(zip(rows, line_groups(rows), strict=True)))
    got = line_dedup.link_lines(spark, docs)
    assert sorted((str(r.doc_id), r.line, str(r.first_doc_id), r.first_line, r.kept) for r in got.dropDuplicates(["doc_id", "document", "line"]).collect()) == want
    cut = line_dedup.dedup_lines(spark, docs.withColumnsRenamed({"id": "_cut", "bucket": "gone", "n": "a.b"}))
    assert cut.columns == [*docs.columns[:5], "_cut", "gone", "a.b"]
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert kept[0] == texts()[0][1] and 301 not in kept and 304 in kept and kept[308] == "line\n\nline <|endoftext|>"
    assert line_dedup.dedup_lines(spark, empty).count() == 0


def test_line_dedup_recall_and_families(spark):
    """Near lines of Jaccard 0.80 to 0.9 are found; a family of lines that are alike in chains and a template whose
    lines are not alike are told apart as brute force does."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz  "
    line = lambda n: "".join(rng.choices(letters, k=n)).strip() or "x"
    rows = []
    for i in range(220):
        x = line(rng.randint(60, 400))
        y = list(x)
        for _ in range(max(1, len(x) // 100)):
            y[rng.randrange(len(y))] = "Z"
        rows += [(i, x), (1000 + i, "".join(y))]
    head = line(120)
    rows += [(2000 + i, head + line(90)) for i in range(60)]  # alike by less than 0.8
    chain = line(300)
    for i in range(40):
        chain = chain[6:] + line(6).ljust(6, "q")
        rows.append((3000 + i, chain))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    every = lines_of(rows)
    want = {every[k][0]: every[g][0] for k, g in enumerate(line_groups(every))}
    got = {r.doc_id: r.first_doc_id for r in line_dedup.link_lines(spark, docs).collect()}
    apart = [i for i in want if i < 2000 and got[i] != want[i]]
    assert len(apart) <= 0.02 * 440 and all(got[i] == want[i] for i in want if i >= 2000)


def near_vectors(spark, rows):
    return vectors.link_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, component long, v int").repartition(3)).toPandas()


@pytest.mark.parametrize("offset", [0.0, 0.6])
def test_vectors(spark, offset):
    """Links, components and kept against brute force, where all cosines are clear of the threshold: a large group of
    near copies, a chain, copies, equal vec_ids; also where vectors lie off 0."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32)) + offset
    group = base[0] + 0.02 * rng.normal(size=(600, 32))
    chain = [base[1] / np.linalg.norm(base[1])]
    for _ in range(15):
        away = rng.normal(size=32)
        for c in chain:
            away -= (away @ c) * c / (c @ c)
        chain.append(0.97 * chain[-1] + (1 - 0.97**2) ** 0.5 * away / np.linalg.norm(away))
    x = np.concatenate([base, group, chain[1:], base[5:7]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = u @ u.T
    clear = ~((cos > 0.8) & (cos < 0.93)).any(axis=1) | (np.arange(len(x)) < 2)
    ids = [int(i) for i in rng.permutation(len(x))]
    ids[3] = ids[4]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] + [1.0] * 31), (9003, [None] + [1.0] * 31), (9004, []), (9005, [1.0, 2.0]), (9005, [1.0, 2.0])]
    got = near_vectors(spark, [(i, [float(v) for v in r], 0, 0) for i, r in zip(ids, x)] + [(i, v, 0, 0) for i, v in odd])
    near = cos >= 0.9
    least = least_linked(len(x), list(zip(*np.nonzero(np.triu(near, 1)))), ids)
    want = {(ids[k], int(near[k].sum()) - 1, least[k], ids[k] == least[k]) for k in range(len(x)) if clear[k]}
    have = {tuple(r) for r in got[["vec_id", "n_links", "component_id", "kept"]].itertuples(index=False)}
    assert len(want - have) <= 0.002 * len(x)
    rest = got[got.vec_id >= 9000]
    assert rest.kept.all() and list(rest.sort_values("vec_id").n_links) == [0, 0, 0, 0, 0, 1, 1]


def test_vectors_recall_at_the_threshold(spark):
    """Pairs of cosine 0.90 to 0.92: no less than nine tenths are found, and none below 0.9 is linked."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.concatenate([vectors.turned(x[k : k + 1], c) for k, c in enumerate(rng.uniform(0.901, 0.92, 600))] + [vectors.turned(x[600:], 0.89)])
    rows = [(i, [float(v) for v in r], 0, 0) for i, r in enumerate(np.concatenate([x, y]))]
    got = near_vectors(spark, rows).set_index("vec_id").n_links.sort_index()
    assert (got.loc[:599] == 1).mean() >= 0.9 and (got.loc[600:799] == 0).all()
    assert vectors.link_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["an", "the", "or", "ti", "sh", "on", "er"], k=3))
    bad = ["zglorb", "vraxxle", "quimbst"]
    rows, labels = [], []
    for i in range(600):
        t = [word() for _ in range(80)]
        if i % 4 == 0:
            for _ in range(6):
                t[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(labels[:400] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(spark, docs, train).toPandas()
    held = got[got.doc_id.between(400, 599)]
    right = (held.score >= 0.7) == (held.doc_id % 4 == 0)
    assert right.mean() > 0.95 and len(got) == len(rows) and got.score.between(0, 1).all()
    assert toxicity.score_toxicity(spark, docs, train.limit(0)).filter("score = 0").count() == len(rows)


def test_mixing(spark, docs, empty):
    got = mixing.mix_documents(spark, docs, keep=("source", "n")).select("*", "kept.source").toPandas()
    assert (got.taken <= 2 * got["size"]).all() and got["size"].sum() == got.groupby("source", dropna=False).source_size.first().sum()
    by = got.groupby("source", dropna=False)
    assert by.target.first().sum() == pytest.approx(1.5 * got["size"].sum())
    assert (abs(by.taken.sum() - by.target.first()) <= 0.01 * by.target.first() + 3).all()
    assert mixing.mix_documents(spark, empty).count() == 0


def test_merkle(spark, docs, empty):
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in merkle.fingerprint_edits(spark, docs).collect()}
    order = sorted(texts(), key=lambda r: (-10**9 if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest()), reverse=True)
    want = set()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        want.add((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert got == want and merkle.fingerprint_edits(spark, empty).count() == 0
    from pyspark.sql import functions as F

    x = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nX"), ("a", "a"), ("a\n\nb", "a")], "x string, y string")
    trees = x.select(*(merkle.tree(merkle.leaf_nodes(F.col(c))).alias(c) for c in "xy")).select(merkle.differing(F.col("x"), F.col("y")).alias("d")).collect()
    assert [[(e.section, e.paragraphs) for e in r.d] for r in trees] == [[(1, [1])], [], [(1, [0])]]


def test_fingerprints(spark):
    """Fingerprints against a plain tree; likeness of small edits stays near 1 wherever they are; equal texts alone have equal ones."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    words = [rng.choice(["alpha", "be", "gam", "delta", "e", "zeta"]) + str(rng.randrange(300)) for _ in range(900)]
    line = " ".join(words[:400])
    many = " ".join(words)
    texts_ = ["", "a", "a\1b", "a \2b", "\n\n\n", line, "x" + line, "x " + line, line + ".", line.replace(words[200], "other", 1), many, "Q" + many, "\n".join([" ".join(words[:50])] * 20), "x" + "\n".join([" ".join(words[:50])] * 20), " ".join(words[::-1])]

    def nodes(t):
        out = []
        for section in t.split("\n\n"):
            out.append([])
            for p in section.split("\n"):
                p = p.replace("\2", "\2\4").replace("\1", "\2\3")
                p = " ".join(w + "\1" if hashlib.md5(w.encode()).hexdigest()[0] in "0123" else w for w in p.split(" "))
                out[-1].append([hashlib.sha256(b"l" + x.encode()).hexdigest() if x else "" for x in p.split("\1")])
        return out

    sha = lambda k, v: hashlib.sha256((k + v).encode()).hexdigest()
    want = []
    for t in texts_:
        n = nodes(t)
        root = sha("r", "".join(sha("s", "".join(sha("p", ",".join(p)) for p in s)) for s in n))
        want.append(root + "".join(sorted({x[:8] for s in n for p in s for x in p if x})[: merkle.SKETCH]))
    x = spark.createDataFrame(list(enumerate(texts_)), "i int, t string").withColumn("n", merkle.leaf_nodes(F.col("t"))).select("i", merkle.fingerprint(F.col("n")).alias("f"))
    got = [r.f for r in x.orderBy("i").collect()]
    assert got == want and len(set(got)) == len(texts_)
    a, b = x.select(F.col("i").alias("a"), F.col("f").alias("x")), x.select(F.col("i").alias("b"), F.col("f").alias("y"))
    like = {(r.a, r.b): r.v for r in a.join(b, F.col("a") <= F.col("b")).select("a", "b", merkle.likeness(F.col("x"), F.col("y")).alias("v")).collect()}
    for (i, j), v in like.items():
        p, q = ([g[64:][k : k + 8] for k in range(0, len(g) - 64, 8)] for g in (got[i], got[j]))
        least = sorted({*p, *q})[: merkle.SKETCH]
        assert v == pytest.approx(1.0 if i == j else len({*p} & {*q} & {*least}) / len(least) if least else 0.0)
    assert min(like[5, k] for k in (6, 7, 8, 9)) > 0.95 and like[10, 11] > 0.95 and like[12, 13] > 0.8 and like[10, 14] < 0.9


def test_fingerprints_of_hot_ids(spark, monkeypatch):
    """The next document where ids are null, equal or clustered, in many small buckets."""
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 7)
    rows = [(None, f"n{k}") for k in range(60)] + [(5, f"f{k}") for k in range(80)] + [(5, "same")] * 3 + [(10**12 + k, f"b{k}") for k in range(50)] + [(k * 10**9, f"s{k}") for k in range(40)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, bucket string, over int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
    want = sorted((str(i), hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    got = merkle.fingerprint_edits(spark, docs)
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got.collect()) == want


def test_lm_scores_of_a_tiny_corpus(spark, docs, empty):
    x = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, "z"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm_score.score_documents(spark, x).collect()}
    ln = np.log
    assert got[2] == (2, pytest.approx(ln(2 / 5) + ln(2 / 2))) and got[3] == (1, pytest.approx(ln(1 / 7))) and got[4] == (0, 0)
    assert lm_score.score_documents(spark, docs, order=3).count() == len(texts()) and lm_score.score_documents(spark, empty).count() == 0


def test_lm_scores_against_brute_force(spark, monkeypatch):
    """Order 3 over many blocks and ranges; copies without id are documents of their own, each left out of its counts."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm_score, "RANGE_GRAMS", 50)
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("abcdeF") for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(None, "a b c d e")] * 5 + [(3, None), (4, "one")]
    grams = [[[tuple((t or "").lower().split()[i : i + n]) for i in range(len((t or "").split()) - n + 1)] for n in (1, 2, 3)] for _, t in rows]
    total = [Counter(g for d in grams for g in d[n]) for n in range(3)]
    want = []
    for (i, _), d in zip(rows, grams, strict=True):
        own, words, score = [Counter(x) for x in d], len(d[0]), 0.0
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        rest = len([g for x in grams for g in x[0]]) - words
        for k in range(words):
            for n in (3, 2, 1):
                if k - n + 1 < 0:
                    continue
                g = d[n - 1][k - n + 1]
                if left(g) > 0:
                    score += np.log(left(g) / (left(g[:-1]) if n > 1 else rest))
                    break
                score += np.log(0.4) if n > 1 else np.log(1 / (rest + 1))
        want.append((str(i), words, round(score, 6)))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in lm_score.score_documents(spark, docs).collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 5, 97, 1000])
def test_slots_are_permuted(spark, n):
    counts = spark.createDataFrame([(3, 0, n, 0, n // 2), (3, 1, n, n // 2, n - n // 2), (3, 2, n, n, n)], "place int, shard long, blocks long, first long, count long").filter("count > 0")
    got = mixing.draw_slots(counts).orderBy("slot").collect()
    once, again = [r["index"] for r in got[:n]], [r["index"] for r in got[n:]]
    assert sorted(once) == sorted(again) == list(range(n))
    assert n < 90 or (once != again and len({b - a for a, b in zip(once, once[1:])}) > n // 4)
    assert got[0].shard in (0, 1)


def test_mixing_and_packing_of_rows_alike(spark, monkeypatch):
    """Many equal rows, without id: groups are split, and every word and piece is still there once."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    rng = random.Random(1)
    rows = [(None, "same text here", "a")] * 300 + [(k, " ".join(["w"] * rng.randint(1, 60)), rng.choice("ab")) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_documents(spark, docs, keep=("source",)).select("*", "kept.source").toPandas()
    assert len(got) == 500 and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source")
    assert (abs(by.taken.sum() - by.target.first()) <= 0.01 * by.target.first() + 3).all()
    packed = packing.pack_documents(spark, docs).toPandas().sort_values(["sequence_id", "offset"])
    assert len(packed) == 500 and packed.doc_id.isna().sum() == 300
    sums = packed.groupby("sequence_id").length
    assert (sums.cumsum() - packed.length == packed.offset).all() and sums.sum().max() <= 1024 and sums.ngroups <= -(-packed.length.sum() // 1024) + 1


def test_length_histogram(spark, docs, empty):
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(enc.encode(t or "", add_special_tokens=False).ids) for _, t in texts()]
    for r in lengths.suffix_sums(lengths.token_lengths(docs)).collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == (n.count(r.length), sum(v >= r.length for v in n), sum(v for v in n if v >= r.length), sum(min(v, r.length) for v in n))
    sums = lengths.suffix_sums(lengths.token_lengths(docs))
    at = lengths.at_limits(sums, spark.createDataFrame([(7,), (0,), (n[0],), (5000,), (10**6,)], "limit long")).collect()
    assert {r.limit: (r.truncated_tokens, r.docs_at_least) for r in at} == {k: (sum(min(v, k) for v in n), sum(v >= k for v in n)) for k in (7, 0, n[0], 5000, 10**6)}
    assert lengths.suffix_sums(lengths.token_lengths(empty)).count() == 0


def test_tool_calls(spark):
    import json

    calls = [(1, 0, "a", "search", '{ "limit": 3, "query": "é\\n" }', ["c"]), (1, 1, "b", "search", '{"query": 1}', ["a", "zz"]), (1, 2, "c", "nope", "{}", None), (1, 3, "d", "count", "[1]", ["e"]), (1, 4, "e", "count", None, ["d"]), (2, 0, None, "count", '{"query":"x","exact":true}', None), (2, 1, "b", "search", '{"query": 1}', ["a"])]
    results = [("a", 5, "late"), ("a", 2, "first"), ("x", 1, "none")]
    frame = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "tool string, arg string, type string, required boolean")
    got = {(r.conv_id, r.turn): r for r in tool_calls.link_tool_calls(spark, frame, spark.createDataFrame(results, "call_id string, turn long, content string"), schemas).collect()}
    assert len(got) == len(calls)
    assert {k: r.level for k, r in got.items()} == {(1, 0): 1, (1, 1): 2, (1, 2): 0, (1, 3): None, (1, 4): None, (2, 0): None, (2, 1): 2}
    assert got[1, 0].valid and got[1, 0].n_results == 2
    assert got[1, 0].message == json.dumps({"arguments": {"limit": 3, "query": "é\n"}, "depends_on": ["c"], "id": "a", "name": "search", "result": "first"}, ensure_ascii=False, separators=(",", ":"))
    assert "argument query is not string" in got[1, 1].errors and "missing argument limit" in got[1, 1].errors and "unknown dependency" in got[1, 1].errors and "repeated id" in got[1, 1].errors
    assert "cyclic" in got[1, 3].errors and "no object" in got[1, 3].errors and "unknown tool" in got[1, 2].errors
    assert sorted(r.position for k, r in got.items() if k[0] == 1) == [0, 1, 2, 3, 4]


def test_tool_calls_against_brute_force(spark):
    """Levels, positions and links of random calls: long chains, several dependencies, cycles, lost and null ones."""
    rng = random.Random(10)
    calls, results = [], []
    for i in range(300):  # a chain, longer than rounds could be
        calls.append((0, i, f"c{i}", "count", '{"query":"x","exact":true}', [f"c{i - 1}"] if i else None))
    for conv in (1, 2):
        for i in range(80):
            deps = [f"{conv}-{rng.randrange(i)}" for _ in range(rng.randint(0, 3))] if i else []
            calls.append((conv, rng.randrange(9), f"{conv}-{i}", "count", '{"query":"x","exact":true}', deps + rng.choice([[], [], ["lost"], [None]])))
    calls += [(3, k, f"y{k}", "count", None, [f"y{(k + 1) % 3}"]) for k in range(3)] + [(3, 5, "after", "count", "{}", ["y0", "1-0"]), (None, None, "n", None, None, None)]
    for c in calls:
        results += [(c[2], t, f"r{t}") for t in rng.sample(range(5), rng.randint(0, 2))]
    levels, known = {}, {c[2]: [d for d in c[5] or [] if d] for c in calls}
    for _ in range(len(calls)):
        for c, deps in known.items():
            inner = [d for d in deps if d in known]
            if all(d in levels for d in inner):
                levels[c] = 1 + max((levels[d] for d in inner), default=-1)
        if len(levels) == len(known) - 4:
            break
    order = sorted((c for c in calls if c[0] is not None), key=lambda c: (c[0], levels.get(c[2], 2**31), c[1], c[2]))
    place, want = {}, {}
    for c in order:
        place[c[0]] = place.get(c[0], -1) + 1
        own = sorted(r[1:] for r in results if r[0] == c[2])
        want[c[2]] = (levels.get(c[2]), place[c[0]], len(own), own[0][1] if own else None)
    frame = spark.createDataFrame([(*c, 1) for c in calls], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, level int").repartition(3)
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "tool string, arg string, type string, required boolean")
    link = lambda f: tool_calls.link_tool_calls(spark, f, spark.createDataFrame(results, "call_id string, turn long, content string"), schemas)
    import json

    got = {r.call_id: (r.level, r.position, r.n_results, json.loads(r.message).get("result")) for r in link(frame).collect()}
    assert got.pop("n")[0] == 0 and got == want
    assert link(frame.limit(0)).count() == 0


def test_calls_of_conversations(spark):
    rows = [(1, 0, "user", "hi \"there\""), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 4, "user", "x" * 30), (2, 0, "system", "s")]
    calls, results, schemas = tool_calls.calls_of(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, call_id int"))
    got = {r.call_id: r for r in calls.collect()}
    assert set(got) == {"1-0", "1-2", "1-4"} and got["1-4"].depends_on == ["1-2"] and got["1-0"].depends_on == []
    assert [(r.call_id, r.content) for r in results.collect()] == [("1-0", "yes")]
    assert tool_calls.link_tool_calls(spark, calls, results, schemas).count() == 3


@pytest.mark.parametrize("kind, value, fits", [("array<string>", '["a"]', True), ("array<string>", "[1]", False), ("array<integer>", "[]", True), ("number", "1.5", True), ("object", '{"a": 1}', True)])
def test_argument_kinds(spark, kind, value, fits):
    call = spark.createDataFrame([(1, 0, "a", "t", f'{{"x": {value}}}', None)], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    got = tool_calls.link_tool_calls(spark, call, spark.createDataFrame([("a", 1, "r")], "call_id string, turn long, content string"), spark.createDataFrame([("t", "x", kind, True)], "tool string, arg string, type string, required boolean")).first()
    assert got.valid == fits


def test_mixing_stage_by_source(spark):
    """Copies of whole documents hold each source's target up to its largest document, in and out of one part."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(300, 900)), f"s{min(k, 6)}") for i, k in enumerate(rng.randrange(10) for _ in range(1000))]
    docs = spark.createDataFrame([*rows, (None, "a b", "s0"), (2000, None, "s1")], "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix_documents(spark, docs, keep=("source",)).select("*", "kept.source").toPandas().groupby("source").agg(target=("target", "first"), size=("size", "sum"), most=("size", "max"))
    out = corpus_pipeline.mix_sources(spark, docs, "").toPandas()
    assert list(out.columns) == docs.columns and out.groupby("doc_id").size().max() <= 2
    words = out.assign(words=out.text.str.split().str.len()).groupby("source").words.sum()
    assert (plan.target < plan["size"]).any() and (plan.target > 1.2 * plan["size"]).any()
    assert (abs(words - plan.target) <= plan.most + 0.01 * plan.target).all()


def test_mixed_shards(spark, docs, empty, monkeypatch):
    """Every slot holds its whole block once, in one shard; shards and documents add up to what is taken."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 512)
    got = mixing.mix_shards(spark, docs).toPandas()
    per = mixing.mix_documents(spark, docs, keep=("source",)).select("*", "kept.source").toPandas()
    size = per.fillna({"source": "none"}).groupby("source")["size"].sum()
    got["source"] = got.source.fillna("none")
    held = {i: max(len((t or "").split()) for j, t in texts() if j == i) for i, _ in texts()}
    assert all(0 <= r.start and r.words > 0 and r.start + r.words <= held[None if np.isnan(r.doc_id) else int(r.doc_id)] for r in got.itertuples())
    slots = got.groupby(["source", "slot"]).agg(shards=("shard", "nunique"), blocks=("index", "nunique"), index=("index", "first"), words=("words", "sum")).reset_index()
    assert (slots.shards == 1).all() and (slots.blocks == 1).all()
    for source, s in slots.groupby("source"):
        block = min(mixing.BLOCK_WORDS, max(1, size[source] // 1000))
        n = -(-size[source] // block)
        assert (s.words == np.minimum(block, size[source] - s["index"] * block)).all()
        assert sorted(s.slot) == list(range(len(s))) and s["index"].value_counts().between(len(s) // n, -(-len(s) // n)).all()
    assert got.words.sum() == per.taken.sum()
    assert sorted(got.groupby("row").words.sum()) == sorted(per.taken[per.taken > 0])
    counts = mixing.shard_counts(mixing.mix_shards(spark, docs)).toPandas().fillna({"source": "none"})
    n_shards = -(-len(slots) // 512)
    assert n_shards > 3 and counts.shard.nunique() == n_shards and counts.slots.sum() == len(slots) and counts.words.sum() == got.words.sum()
    for _, c in counts.groupby("source"):  # multinomial: six standard deviations
        mean = c.slots.sum() / n_shards
        assert (abs(c.slots - mean) <= 6 * mean**0.5 + 1).all()
    assert counts.slots.nunique() > 1 and mixing.mix_shards(spark, empty).count() == 0


@pytest.mark.parametrize("n_toxic, at", [(1, 40), (2, 40), (5, 40), (8, 4_000)])
def test_toxicity_of_few_or_long_texts(spark, n_toxic, at):
    """Few toxic labels still teach, also where the passage comes after 16,384 characters."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["an", "the", "or", "ti", "sh", "on", "er"], k=3))
    bad = "zglorb vraxxle quimbst zglorbian vraxxled"
    text = lambda toxic, n: " ".join([word() for _ in range(n)] + [bad] * toxic + [word() for _ in range(10)])
    rows = [(i, text(i < n_toxic, at if i < n_toxic else 40)) for i in range(40)] + [(100 + i, text(i < 10, 40)) for i in range(20)]
    docs = spark.createDataFrame([*rows, (200, None), (201, "")], "doc_id long, text string")
    train = spark.createDataFrame([(i, int(i < n_toxic)) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(spark, docs, train).toPandas().set_index("doc_id").score
    assert got.loc[range(100, 110)].min() > got.loc[range(110, 120)].max()


def test_one_repeated_id_leaves_room_for_the_other_label(spark):
    """A labelled id with very many rows must not push all others out of the sample."""
    rows = [(k, f"fine words of text {k} about weather and trains") for k in range(8)] + [(100, f"bad nasty words {k % 3}") for k in range(200)] + [(101, "nasty bad words again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k >= 100)) for k in [*range(8), 100, 101]], "doc_id long, toxic int")
    model, share = toxicity.fit_toxicity(docs, labels, 5)
    assert model is not None and share == pytest.approx(0.2)
    scores = [r.score for r in toxicity.score_toxicity(spark, docs, labels, 5).collect()]
    assert len(scores) == len(rows) and len({round(s, 6) for s in scores}) > 1


def test_texts_with_strong_words_are_caught():
    """Of held-out texts that hold words only toxic ones hold, most score 0.7 or more; texts of ordinary labels seldom do."""
    folder = "/root/testdata/sf0.1"
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).dropna().merge(pd.read_parquet(f"{folder}/labels.parquet"), "left", on="doc_id")
    train = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    toxic, ordinary = (docs[train & (docs.toxic == y)].text.tolist()[:3000] for y in (1, 0))
    *held, weights = toxicity.fit(toxic, ordinary, len(toxic) / (len(toxic) + len(ordinary)))
    model = toxicity.Scorer(*held, weights)
    caught = lambda texts: (model.scores(np.array([model.saved(t) for t in texts])) >= toxicity.THRESHOLD).mean()
    marked = docs.text.str.contains("trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron", case=False)
    assert caught(docs[~train & marked].text) > 0.75
    assert caught(docs[~train & (docs.toxic == 0)].text.iloc[:300]) < 0.03


def test_lines_are_hashed_as_bytes_alone():
    """Lines are told apart without code points, which only signatures and sets need; those of some lines are those of the block."""
    x = line_dedup.Lines(pa.array(["é\nüß longer line here\n \t\n", None, "", "日本語のとても長い行です\nabc", "abc"]))
    assert x.text.tolist() == [0, 0, 0, 0, 3, 3, 4] and x.number.tolist() == [0, 1, 2, 3, 0, 1, 0]
    assert x.blank.tolist() == [False, False, True, True, False, False, False]
    assert x.d1[5] == x.d1[6] and len(set(x.d1[~x.blank].tolist())) == 4 and "code" not in vars(x) and "d2" not in vars(x)
    full = np.flatnonzero(~x.blank)
    alone = line_dedup.Lines(pa.array([x.string(i) for i in full])).whole_sets()
    assert [s.tolist() for s in alone] == [s.tolist() for s in x.sets(full)] and [len(s) for s in alone] == [1, 12, 5, 1, 1]


def test_pairs_of_a_bucket_come_from_one_shuffle(spark, monkeypatch):
    """Each pair of two components once, however many buckets it shares; rows go to their bucket once, not once a side."""
    monkeypatch.setattr(linking, "CARRIED", 3)
    rng = random.Random(2)
    rows = sorted({(rng.randrange(12), rng.randrange(40)) for _ in range(150)})
    many = Counter(b for b, _ in rows)
    x = spark.createDataFrame([(b, i, i % 7, many[b]) for b, i in rows], "bucket long, id long, component long, held long")
    x = linking.with_others(x)
    own = {i: sorted(b for b, j in rows if j == i) for _, i in rows}
    assert all((sorted(r.others) if r.others is not None else None) == (own[r.id] if len(own[r.id]) <= 3 else None) for r in x.collect())
    want = {(i, j) for b, i in rows for c, j in rows if b == c and i < j and i % 7 != j % 7}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for size in (1024, 4):
            monkeypatch.setattr(linking, "BLOCK_ROWS", size)
            out = linking.all_pairs(x, lambda p, q: F.lit(True), True).collect()
            assert {(r.a, r.b) for r in out} == want
            few = [(r.a, r.b) for r in out if len(own[r.a]) <= 3 and len(own[r.b]) <= 3]
            assert len(few) == len(set(few))
        once = linking.all_pairs(x, lambda p, q: F.lit(True))
        assert {(r.a, r.b) for r in once.collect()} == want
        assert "ReusedExchange" in once._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
