"""Thin queries over the operators of this subpackage, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, jaccard, licenses, line_rules, lm_scoring, mixing, quality, substring, token_counts
from .store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=4, threshold=0.85)
    return found.members.select("doc_id", "n_shingles", "component_id")


def op1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op1_ngram_jaccard``, with the number of links of each document."""
    found = jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=4, threshold=0.85)
    return found.counted.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    scratch = Scratch(spark, "op2")
    stats = scratch.write(quality.with_statistics(docs, ["doc_id"]).withColumn("held_out", F.coalesce(fold == 2, F.lit(False))))
    model = quality.fit_on(stats.filter(~F.col("held_out")), labels, "quality")
    scored = stats.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target model counts the texts that are labelled as good, the background model all texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    # labels grow with the documents: the same join at every size
    return lm_scoring.score_by_words(docs.join(good.hint("merge"), "doc_id", "left"), F.col("_quality") == 1)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.clean_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 3))::INT AS bin
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS w FROM s),
r AS (  -- sources in the order in which rising water reaches their caps
  SELECT *, sum(3 * source_size) OVER o AS cap_upto, sum(w) OVER o AS w_upto,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
  FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT *, (total - (cap_upto - 3 * source_size))::DOUBLE / (w_all - (w_upto - w))::DOUBLE AS lvl FROM r),
pick AS (  -- the first source whose cap the remaining level doesn't pass: from there on all share it
  SELECT lvl, cap_upto - 3 * source_size AS below FROM lv WHERE lvl * w <= 3 * source_size
  ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT w.source, w.source_size,
             CASE WHEN (SELECT lvl FROM pick) * w.w > 3 * w.source_size THEN (3 * w.source_size)::DOUBLE
                  ELSE coalesce((SELECT lvl FROM pick) * w.w, 3 * w.source_size) END AS target FROM w),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3)::INT END AS whole FROM t),
b AS (SELECT source, bin, sum(size) AS words, row_number() OVER (PARTITION BY source ORDER BY bin) AS k FROM d GROUP BY source, bin),
f(source, k, upto, bin, taken) AS (  -- bin by bin: one goes in if that brings the sum nearer to what is wanted
  SELECT source, 0::BIGINT, 0::BIGINT, -1, false FROM p WHERE whole < 3 AND target - whole * source_size > 0
  UNION ALL
  SELECT f.source, b.k, (upto + CASE WHEN upto + words / 2 <= target - whole * source_size THEN words ELSE 0 END)::BIGINT, b.bin, upto + words / 2 <= target - whole * source_size
  FROM f JOIN b ON b.source IS NOT DISTINCT FROM f.source AND b.k = f.k + 1 JOIN p ON p.source IS NOT DISTINCT FROM f.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + coalesce(f.taken, false)::INT))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.bin = f.bin
"""

_W = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE v = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""

OP1_LINKS_SQL = OP1_SQL.replace("SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,", "SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links,")

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM m, range(5) AS o(j) WHERE m.n > 1 GROUP BY doc_id),
x AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_W}')) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
b AS (SELECT doc_id, sum(n) AS lost FROM x WHERE n > 0 AND (
      (n >= 8 AND NOT regexp_matches(line, '[.!?;:…。！？]'))
      OR 100 * len(regexp_extract_all(line, '[^\x20\x09-\x0D]*[#*$%&<>~^]{{2,}}[^\x20\x09-\x0D]*')) > 30 * n
      OR 100 * len(regexp_extract_all(line, '!!')) > 50 * n
      OR 100 * len(list_filter(regexp_extract_all(line, '{_W}'), lambda z: z IN ('|', '»', '›', '·', '•'))) > 20 * n
      OR (n <= 25 AND regexp_matches(line, '(?i){"|".join(line_rules.BOILERPLATE)}'))) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda z: length(z))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      (len(list_filter(lines, lambda z: regexp_matches(z, '{_W}'))) - len(list_distinct(list_filter(lines, lambda z: regexp_matches(z, '{_W}')))))::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(b.lost, 0) AS lost FROM d LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= 50 * n_words AS kept FROM v
"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, i + j AS place FROM m, range(50) AS o(j) WHERE first < doc_id),
k AS (SELECT doc_id, place, w[place] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM d)),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.place = k.place) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id != b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(v, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a WHERE r.c < l.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE a = v.vec_id) AS n_links, (SELECT min(c) FROM r WHERE r.v = v.vec_id) AS component_id,
       (SELECT min(c) FROM r WHERE r.v = v.vec_id) = v.vec_id AS kept FROM v
"""

def _op4_sql() -> str:
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {lists(p.split())})" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', {lists(sorted(set(t.split())))})" for label, t in licenses.TEMPLATES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
p(label, ws) AS (VALUES {phrases}), q(label, ws) AS (VALUES {templates}),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE t LIKE '%license%' OR t LIKE '%cc%'),
a AS (SELECT doc_id, i - 1 AS i, label FROM i, p WHERE w[i:i + len(ws) - 1] = ws),
b AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi FROM a GROUP BY doc_id),
y AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: regexp_extract_all(x, '{word}')) AS ls FROM w),
k AS (SELECT doc_id, ls, m, unnest(range(1, len(ls) - m + 2)) AS i FROM y, range(1, {licenses.LINES} + 1) AS o(m)),
l AS (SELECT doc_id, m, list_distinct(flatten(ls[i:i + m - 1])) AS ws, len(flatten(ls[i:i + m - 1])) AS n_words FROM k),
m AS (SELECT doc_id, label, len(list_intersect(q.ws, l.ws)) AS n, len(q.ws) AS size FROM l, q WHERE len(l.ws) >= ceil(0.9 * len(q.ws) - 1e-9) AND (m = 1 OR n_words <= {licenses.WRAPPED_WORDS} * len(q.ws))),
f AS (SELECT doc_id, label, n::DOUBLE / size AS c FROM m WHERE n >= ceil(0.9 * size - 1e-9)),
x AS (SELECT doc_id, max(c) AS best FROM f GROUP BY doc_id),
g AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM a GROUP BY doc_id),
h AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM a UNION ALL SELECT doc_id, label FROM f) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(g.s, '') AS base_labels, coalesce(h.s, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(x.best, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_quality": op2_quality, "op3_bpe_codec": op3_bpe_codec, "op4_licenses": op4_licenses, "op5_lm_scoring": op5_lm_scoring, "op6_token_counts": op6_token_counts, "op7_embeddings": op7_embeddings, "op8_mixing": op8_mixing, "op9_line_rules": op9_line_rules, "op10_substring": op10_substring, "op1_links": op1_links}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op4_licenses": _op4_sql(), "op7_embeddings": OP7_SQL, "op8_mixing": OP8_SQL, "op9_line_rules": OP9_SQL, "op10_substring": OP10_SQL, "op1_links": OP1_LINKS_SQL}
