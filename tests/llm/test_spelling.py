"""Spelling variants against plain comparison of all words, with accents, repeats, long runs, nulls and hot keys."""

import random
import re
import zlib
from collections import Counter

import pytest

from cellvec.llm import spelling
from cellvec.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, word string, n long, key long, part int"


def rows():
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdeéß÷", k=rng.randint(4, 9))) for _ in range(60)] + ["banana", "bananas", "ananan", "aaaaa", "aaaaaa", "aaaaaaa", "z" * 3000, "z" * 3001]
    near = []
    for w in base:
        k = rng.randrange(len(w))
        near += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k + 1 :], w[:k] + "x" + w[k:]]
    words = base + near
    out = [(k, " ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in rng.choices(8 * base[:-2] + near[:-6] if k else words, k=80)) + ", e-a 12") for k in range(60)]
    out += [(500 + k, "harbour harbour " + "harbor " * (k % 2) + "arbor" * (k % 6 == 0)) for k in range(40)]
    out += [(700, " ".join(3 * words)), (None, out[3][1]), (5, out[5][1]), (5, out[5][1]), (800, None), (801, ""), (802, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ 漢字漢字漢字 ÀÉÎÕÜ")]
    return [(i, t, "en", "w", 1, 2, 3) for i, t in out]


def by_hand(data):
    count = Counter()
    for doc, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    words = sorted(w for w, n in count.items() if len(w) >= 5 and n >= 3)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and edits(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def edits(a, b):
    """Exactly one, by the table of distances."""
    if len(a) > 100:  # by every deletion
        less = lambda x: {x[:k] + x[k + 1 :] for k in range(len(x))}
        return b in less(a) or a in less(b) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1] == 1


def test_as_by_hand(spark):
    got = spelling.group_variants(spark, spark.createDataFrame(rows(), SCHEMA).repartition(4))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, got.collect()), key=lambda r: r[0])
    assert got == by_hand(rows()) and sum(r[1] is not None for r in got) > 12 and any(r[1] != r[2] for r in got if r[1])


@pytest.mark.parametrize("most", [3, 10_000])
def test_dense_words_and_hot_keys(spark, most):
    """All words of a small alphabet: many share each key, which is dealt by pairs of parts."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=n)) for n in (5, 6, 7) for _ in range(90)})
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long").repartition(3)
    got = sorted((r.word, r.other, r.n, r.m) for r in spelling.near_words(spark, df, Scratch(spark, "t"), most).collect())
    n = {w: k + 1 for k, w in enumerate(words)}
    assert got == sorted((a, b, n[a], n[b]) for a in words for b in words if abs(len(a) - len(b)) <= 1 and edits(a, b))


def test_both_merges_agree():
    rng = random.Random(1)
    for _ in range(60):
        longer = rng.randint(5, 16)
        words = sorted({"".join(rng.choices("abé", k=rng.choice([longer, longer - 1]))) for _ in range(30)})
        near = {(j, i) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if longer in (len(a), len(b)) and edits(a, b)}
        assert set(spelling.merged(words, longer)) == near == set(spelling.merged_at_once(words, longer, 64))


def test_empty(spark):
    assert spelling.group_variants(spark, spark.createDataFrame([], SCHEMA)).count() == 0
