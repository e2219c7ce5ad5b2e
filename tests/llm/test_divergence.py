"""The audit of sources against plain counting, with nulls, clashing columns, rare terms and empty tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cellvec.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, value long, salt int"


def rows():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefg" for b in ["x", "Y", "é", "ß", "漢", ""]]
    out = []
    for k in range(160):
        lang = rng.choice(["en", "de", None])
        text = " ".join(rng.choices(words[: 20 if k % 3 else 42], k=rng.randint(0, 40)))
        out.append((k, rng.choice([text, text + "\n9a_b×c 7"]), lang, rng.choice(["s1", "S0", "é", None])))
    return [*out, out[0], out[0], (900, None, "en", "silent"), (901, "", "fr", "a"), (902, "one two", "fr", "b"), (903, "x", "it", "alone"), (904, "word " * 30000, "en", "s1")]


def by_hand(docs, least, top):
    terms, groups = [], defaultdict(list)
    for _, text, lang, source in docs:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""] += found
        terms += [(lang or "", t) for t in set(found)]
    kept = defaultdict(list)
    for (lang, t), n in Counter(terms).items():
        if n >= least:
            kept[lang].append(t)
    out = []
    for lang in {g[0] for g in groups}:
        def shares(found):
            c = Counter(found)
            n = sum(c[t] for t in kept[lang])
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}, c

        own = {s: shares(found) for (g, s), found in groups.items() if g == lang}
        whole = shares([t for (g, _), found in groups.items() if g == lang for t in found])[0]
        for s, (p, c) in own.items():
            pairs = [(sum(abs(p[t] - own[o][0][t]) for t in kept[lang]), o) for o in own if o != s]
            more = [(p[t] - whole[t], t) for t in kept[lang] if c[t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", more, top)):
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(30, 50), (5, 3), (1000, 50)])
def test_as_by_hand(spark, least, top):
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows()], SCHEMA).repartition(5)
    got = divergence.audit_sources(spark, docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, got.collect()))
    assert got == by_hand(rows(), least, top) and len(got) > 20


def test_empty(spark):
    assert divergence.audit_sources(spark, spark.createDataFrame([], SCHEMA)).count() == 0
