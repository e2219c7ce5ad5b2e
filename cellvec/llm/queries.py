"""One query per operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import audit_sources
from .lengths import suffix_sums, token_lengths
from .line_dedup import link_lines
from .lm_score import score_documents
from .merkle import ENDS, SKETCH, fingerprint_edits
from .mixing import BLOCK_WORDS, GROUP_ROWS, mix_documents, mix_shards, permuted
from .ngram_join import link_documents
from .packing import pack_documents
from .pii import find_personal
from .spelling import group_variants
from .tool_calls import calls_of, link_tool_calls
from .toxicity import THRESHOLD, score_toxicity
from .vectors import link_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column) -> F.Column:
    return F.crc32(column.cast("string")) % 3 == 1


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(spark, *calls_of(table(spark, sf_dir, "conversations")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_lines(spark, table(spark, sf_dir, "documents")).drop("document", "first_document")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = score_documents(spark, table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).otherwise(0.0).alias("mean_log_score"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark, table(spark, sf_dir, "embeddings"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    x = score_toxicity(spark, table(spark, sf_dir, "documents"), train)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(token_lengths(table(spark, sf_dir, "documents")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark, table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shards(spark, table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark, table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark, table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark, table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pattern_packing": op1,
        "op2_tool_call_linking": op2,
        "op3_fuzzy_line_dedup": op3,
        "op4_stupid_backoff": op4,
        "op5_itq_near_dedup": op5,
        "op6_compression_toxicity": op6,
        "op7_length_histogram": op7,
        "op8_ngram_jaccard_join": op8,
        "op9_source_mixing": op9,
        "op9_mixed_shards": op9_shards,
        "op10_merkle_fingerprints": op10,
        "op11_spelling_variants": op11,
        "op12_personal_data": op12,
        "op13_source_divergence": op13,
    }


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
t AS (SELECT r, unnest(w) AS w3, unnest(list_concat([NULL], w[:-2])[:len(w)]) AS w2, unnest(list_concat([NULL, NULL], w[:-3])[:len(w)]) AS w1 FROM d),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
c1 AS (SELECT w3 AS w, count(*) AS c FROM t GROUP BY 1),
o1 AS (SELECT r, w3 AS w, count(*) AS c FROM t GROUP BY 1, 2),
c2 AS (SELECT w2 AS v, w3 AS w, count(*) AS c FROM t WHERE w2 IS NOT NULL GROUP BY 1, 2),
o2 AS (SELECT r, w2 AS v, w3 AS w, count(*) AS c FROM t WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
c3 AS (SELECT w1 AS u, w2 AS v, w3 AS w, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
o3 AS (SELECT r, w1 AS u, w2 AS v, w3 AS w, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY 1, 2, 3, 4),
l1 AS (SELECT o1.r, o1.w, c1.c - o1.c AS n FROM o1 JOIN c1 USING (w)),
l2 AS (SELECT o2.r, o2.v, o2.w, c2.c - o2.c AS n FROM o2 JOIN c2 ON o2.v = c2.v AND o2.w = c2.w),
l3 AS (SELECT o3.r, o3.u, o3.v, o3.w, c3.c - o3.c AS n FROM o3 JOIN c3 ON o3.u = c3.u AND o3.v = c3.v AND o3.w = c3.w),
own AS (SELECT r, count(*) AS n FROM t GROUP BY 1),
s AS (
  SELECT t.r, t.w1, t.w2, l3.n AS b3, x2.n AS x2, b2.n AS b2, x1.n AS x1, y.n AS y, total.n - own.n AS others
  FROM t JOIN own ON own.r = t.r CROSS JOIN total
  JOIN l1 y ON y.r = t.r AND y.w = t.w3
  LEFT JOIN l1 x1 ON x1.r = t.r AND x1.w = t.w2
  LEFT JOIN l2 b2 ON b2.r = t.r AND b2.v = t.w2 AND b2.w = t.w3
  LEFT JOIN l2 x2 ON x2.r = t.r AND x2.v = t.w1 AND x2.w = t.w2
  LEFT JOIN l3 ON l3.r = t.r AND l3.u = t.w1 AND l3.v = t.w2 AND l3.w = t.w3),
k AS (SELECT r, CASE WHEN b2 > 0 THEN ln(b2 / CAST(x1 AS DOUBLE)) ELSE CASE WHEN w2 IS NULL THEN 0 ELSE ln(0.4e0) END + CASE WHEN y > 0 THEN ln(y / greatest(others, 1)) ELSE ln(1 / (others + 1)) END END AS low, w1, b3, x2 FROM s),
e AS (SELECT r, sum(CASE WHEN b3 > 0 THEN ln(b3 / CAST(x2 AS DOUBLE)) ELSE CASE WHEN w1 IS NULL THEN 0 ELSE ln(0.4e0) END + low END) AS v, count(*) AS n FROM k GROUP BY 1)
SELECT doc_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_words, CASE WHEN e.n > 0 THEN round(e.v / e.n, 6) ELSE 0e0 END AS mean_log_score
FROM d LEFT JOIN e ON e.r = d.r
"""


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({WORDS.format("text")}), 0) AS BIGINT) AS size, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 15) AS BIGINT) AS digest, row_number() OVER () AS r FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, count(*) AS docs FROM d GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM a),
c AS (SELECT *, [3, 1, 2][1 + place % 3] AS w FROM b),
l AS (SELECT *, (1.5e0 * sum(total) OVER () - coalesce(sum(2 * total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, 2e0 * total / w AS ratio FROM c WINDOW o AS (ORDER BY 2e0 * total / w, place)),
m AS (SELECT min_by(level, (ratio, place)) AS level FROM l WHERE level <= ratio),
p AS (SELECT l.source, place, docs, total, CASE WHEN m.level IS NULL THEN 2e0 * total ELSE least(2e0 * total, m.level * w) END AS target, least({BLOCK_WORDS}, greatest(1, total // 1000)) AS block FROM l CROSS JOIN m),
q AS (SELECT *, ceil(CAST(total AS DOUBLE) / block)::BIGINT AS blocks FROM p),
k AS (SELECT *, CASE WHEN blocks = 0 THEN 0 ELSE least(2 * blocks, round(target * blocks / total))::BIGINT END AS slots FROM q),
s AS (SELECT place, blocks, ceil(sqrt(blocks))::BIGINT AS a, unnest(range(slots)) AS slot FROM k),
t AS (SELECT *, (blocks + a - 1) // a AS b, place * 7919 + (slot // blocks) * 104729 AS key FROM s),
i AS (SELECT place, list_reduce(list_concat([{permuted("(slot % blocks)", "a", "b", "key", text=True)}], range(a * b - blocks)), lambda v, j: CASE WHEN v < blocks THEN v ELSE {permuted("v", "a", "b", "key", text=True)} END) AS idx FROM t),
n AS (SELECT place, idx, count(*) AS times FROM i GROUP BY 1, 2),
h AS (SELECT d.*, k.place, k.block, k.total, k.target, count(*) OVER (PARTITION BY k.place, digest) > {GROUP_ROWS} AS hot, digest % (k.docs // {GROUP_ROWS} + 1) AS part FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
x AS (SELECT *, CAST(sum(size) OVER (PARTITION BY place ORDER BY hot, CASE WHEN hot THEN 0 ELSE part END, digest, r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM h),
y AS (SELECT r, place, stop, size, block, unnest(range((stop - size) // block, (stop - 1) // block + 1)) AS idx FROM x WHERE size > 0),
z AS (SELECT r, sum((least(stop, (y.idx + 1) * block) - greatest(stop - size, y.idx * block)) * times) AS taken FROM y JOIN n ON y.place = n.place AND y.idx = n.idx GROUP BY 1)
SELECT doc_id, size, total AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM x LEFT JOIN z USING (r)
"""

PLAIN = "replace(replace({0}, chr(2), chr(2) || chr(4)), chr(1), chr(2) || chr(3))"
ENDED = f"left(md5(w), 1) IN ({', '.join(repr(c) for c in ENDS)})"
LEAVES = f"string_split(array_to_string(list_transform(string_split({PLAIN.format('p')}, ' '), lambda w: CASE WHEN {ENDED} THEN w || chr(1) ELSE w END), ' '), chr(1))"
NODES = f"list_transform(string_split({{0}}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform({LEAVES}, lambda t: CASE WHEN t = '' THEN '' ELSE sha256('l' || t) END)))"
ROOT = "sha256('r' || array_to_string(list_transform({0}, lambda s: sha256('s' || array_to_string(list_transform(s, lambda p: sha256('p' || array_to_string(p, ','))), ''))), ''))"
LEAST = f"list_distinct(list_transform(list_filter(flatten(flatten({{0}})), lambda n: n <> ''), lambda n: left(n, 8)))"
SKETCHED = f"list_sort({LEAST})[:{SKETCH}]"
UNITED = f"list_sort(list_distinct(list_concat({{0}}, {{1}})))[:{SKETCH}]"
LIKENESS = f"CASE WHEN {{0}}r = {{1}}r THEN 1e0 WHEN len({{0}}k) + len({{1}}k) = 0 THEN 0e0 ELSE round(len(list_intersect({UNITED.format('{0}k', '{1}k')}, list_intersect({{0}}k, {{1}}k))) / CAST(len({UNITED.format('{0}k', '{1}k')}) AS DOUBLE), 6) END"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS x FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, md5(t) DESC)),
e AS (SELECT *, length(t) AS m, left(t, length(t) - length(t) // 2) || left(x, length(t) // 2) AS u FROM n),
g AS (SELECT *, {NODES.format("t")} AS a, {NODES.format("u")} AS b, {NODES.format("x")} AS c FROM e),
h AS (SELECT *, {ROOT.format("a")} AS ar, {ROOT.format("b")} AS br, {ROOT.format("c")} AS cr, {SKETCHED.format("a")} AS ak, {SKETCHED.format("b")} AS bk, {SKETCHED.format("c")} AS ck FROM g)
SELECT doc_id, CAST(m AS BIGINT) AS n_chars, sha256(u) AS edited_sha256, ar || array_to_string(ak, '') AS fingerprint, br || array_to_string(bk, '') AS edited_fingerprint,
  {LIKENESS.format("h.a", "h.b")} AS near_edited, {LIKENESS.format("h.a", "h.c")} AS near_next
FROM h
"""


#: crc32 by bytes, near words by deleted characters, roots by recursion.
OP11_SQL = r"""
WITH RECURSIVE c AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT doc_id, w, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM t WHERE length(w) >= 5 GROUP BY 1, 2),
h AS (SELECT w, times, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda v, b: xor(v >> 8, tab[(xor(v, b) & 255) + 1])), 4294967295) AS h FROM o CROSS JOIN c),
l AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM l WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON v.word = d.less UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON v.word = d.less),
e AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN e USING (word)),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
s AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f LEFT JOIN s USING (word)
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
w AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM w JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM w GROUP BY 1, 2) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY o.value DESC, item) AS INT) AS rank FROM o QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_stupid_backoff": OP4_SQL, "op9_source_mixing": OP9_SQL, "op10_merkle_fingerprints": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op13_source_divergence": OP13_SQL}
