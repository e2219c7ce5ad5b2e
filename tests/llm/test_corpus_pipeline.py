"""The corpus pipeline on small tables, with repeated and null ids."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from cellvec.llm import mixing, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_component(spark):
    rng = random.Random(3)
    text = lambda n=80: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    near = lambda t: t + " end"
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [
        (1, a), (2, near(a)), (3, a.upper()),  # the least id
        (4, b), (4, b), (4, near(b)),  # rows of one id, two of them equal
        (None, c), (None, near(c)), (None, c),  # null ids alone
        (7, d), (None, near(d)),  # an id before null
        (9, near(a)), (9, e),  # of two rows of one id only one is a copy
        (1, f),  # two components whose least ids are equal
        (20, ""), (20, ""), (None, None), (21, " \n"),  # no words
    ]
    rows += [(100 + k, text()) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in got.collect())
    (second,) = [t for i, t in got if i == 4]
    (third,) = [t for i, t in got if i is None and t]
    assert second in (b, near(b)) and third in (c, near(c))
    want = [(1, a), (4, second), (None, third), (7, d), (9, e), (1, f), *rows[14:]]
    assert got == Counter(want)
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


def test_run(spark, tmp_path):
    """Line copies and cut documents go, one of each group stays, and packing holds what mixing kept."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(90000)}" for _ in range(n)]
    own = {k: text(rng.randint(60, 90)) for k in range(80)}
    rows = [(k, " ".join(t), f"s{k % 3}") for k, t in own.items()]
    rows += [(200 + k, " ".join(own[k]), "s0") for k in range(10)]  # their only line came before
    for k in range(80, 84):  # the same words, in lines that are not alike
        own[k] = text(120)
        rows += [(k, " ".join(own[k]), "s1"), (200 + k, "\n".join(" ".join(own[k][j : j + 10]) for j in range(0, 120, 10)), "s1")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        seen.append(sorted(r.doc_id for r in kept.collect()))
    assert seen[0] == sorted(i for i, _, _ in rows)
    assert seen[1] == [*range(84), *range(280, 284)] and seen[2] == list(range(84))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    plan = mixing.mix_documents(spark, kept).toPandas()
    copies = packed[packed.piece == 0].doc_id.value_counts() if "piece" in packed else packed.doc_id.value_counts()
    assert set(copies.index) <= set(range(84)) and copies.max() <= 2
    words = sum(len(own[i]) * n for i, n in copies.items())
    assert words == pytest.approx(plan.drop_duplicates("source_size").target.sum(), abs=3 * 120)


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    """Columns of any name pass through; so do tables without rows. Toxic documents go, clean ones stay."""
    rng = random.Random(5)
    text = lambda bad: " ".join([f"w{rng.randrange(400)}" for _ in range(50)] + ["zglorb vraxxle quimbst"] * bad + [f"w{rng.randrange(400)}" for _ in range(20)])
    rows = [(k, text(k % 4 == 0), "en", f"s{k % 3}", 0) for k in range(240)] + [(None, None, None, None, None), (500, "", "en", None, 0), (501, text(0) * 300, "en", "s1", 0)]
    names = ["_toxicity", "row", "key", "gone", "kept", "a.b", "size", "bucket", "cut"]
    docs = spark.createDataFrame([(*r, *range(9)) for r in rows], SCHEMA + "".join(f", `{n}` int" for n in names)).repartition(3)
    spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    left = {r.doc_id for r in kept}
    assert kept[0].__fields__ == docs.columns and sum(k % 4 == 0 for k in range(160, 240) if k in left) <= 2
    assert {k for k in range(240) if k % 4} | {None, 500, 501} <= left
    few = docs.filter("doc_id is null or doc_id % 40 < 3")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, few, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() > 0
        assert all(tuple(r)[5:] == tuple(range(9)) for r in out.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_tables_that_nothing_reads_go(spark, monkeypatch):
    """Of the stages' tables the last stays; the n-gram join gives its tables of prefixes back before pairs are compared."""
    from cellvec.llm import ngram_join, scratch

    there, drop = [], scratch.Scratch.drop
    monkeypatch.setattr(scratch.Scratch, "drop", lambda self, *tables: (there.extend(t._scratch_path.rsplit("-", 1)[1] for t in tables), drop(self, *tables)))
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3} h i") for i in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(spark, docs).collect()}
    assert got == {i: i % 3 for i in range(12)}
    assert there.index("index") < there.index("classes") < there.index("edges")
    there.clear()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*((n, lambda spark, docs, sf_dir: docs) for n in ("one", "two", "three")), ("last", lambda spark, docs, sf_dir: docs)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert there == ["one", "two"]
