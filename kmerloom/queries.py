"""Driver queries for the library's operators, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import seq as S
from .operators import audit, graph, kmers, mapping, metrics, modes, packed, polish, resolve, runs
from .operators import reads as R
from .plans import views as V
from .sources import sinks

K = 31

_LET, _BAS = V.LETTERS, V.AS_BASES
SEQS = f"seqs AS (SELECT doc_id AS id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LET}', '{_BAS}') AS seq FROM documents)"
REFS = f"refs AS (SELECT item_id AS id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LET}', '{_BAS}') AS seq FROM benchmark)"
NOISY = f"noisy AS (SELECT doc_id AS id, translate(regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9.,;:!?-]', '', 'g')), '[^a-z]', 'N', 'g'), '{_LET}', '{_BAS}') AS seq FROM documents)"
CONTIGS = "contigs AS (SELECT id, seq AS sequence, (id % 40) / 4.0 + 0.5 AS mean_coverage, greatest(length(seq) - 30, 1) AS kmers_count FROM seqs WHERE seq != '')"
QUALS = """cut AS (SELECT id, unnest(range(0, length(seq), 120)) AS pos, seq FROM noisy WHERE seq != ''),
quals AS (SELECT id, pos, substr(seq, pos + 1, 120) AS seq, translate(substr(substr(seq, pos + 1, 120), 3) || 'GA', 'ACGTN', 'I?5+#') AS qual FROM cut)"""
IVS = """ivs AS (SELECT event_id, event_type AS chrom, (epoch_us(ts) // 1000000) % 1000000 AS start,
(epoch_us(ts) // 1000000) % 1000000 + floor(value)::BIGINT AS "end" FROM events)"""


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTNacgtn', 'TGCANTGCAN'))"


def _kmers(name: str, source: str, k: int, seq: str = "seq") -> str:
    return f"""{name}_w AS (SELECT id, unnest(range(0, length({seq}) - {k} + 1)) AS pos, {seq} AS s FROM {source}),
{name}_k AS (SELECT id, pos, substr(s, pos + 1, {k}) AS kmer FROM {name}_w),
{name} AS (SELECT id, pos, kmer, least(kmer, {_rc('kmer')}) AS canon FROM {name}_k WHERE NOT regexp_matches(kmer, '[^ACGT]'))"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.seqs(spark, sf_dir, "benchmark", "item_id")


# K-mers


@query(f"WITH {SEQS}, {_kmers('w', 'seqs', K)}, c AS (SELECT canon, count(*) AS cnt FROM w GROUP BY canon) SELECT cnt, count(*) AS n_kmers FROM c GROUP BY cnt")
def kmer_spectrum(spark, sf_dir):
    return kmers.spectrum(kmers.count_packed(V.seqs(spark, sf_dir), K))


@query(f"WITH {SEQS}, {_kmers('w', 'seqs', 21)} SELECT canon AS kmer, count(*) AS cnt FROM w GROUP BY canon HAVING count(*) >= 2")
def kmers_seen_twice(spark, sf_dir):
    return kmers.count_kmers(V.seqs(spark, sf_dir), 21, least=2)


@query(f"WITH {REFS}, {_kmers('w', 'refs', 55)} SELECT canon AS kmer, count(*) AS cnt FROM w GROUP BY canon")
def kmers_wide(spark, sf_dir):
    return kmers.count_kmers(_refs(spark, sf_dir), 55)


@query(f"""WITH {SEQS}, {REFS}, {_kmers('w', 'seqs', K)}, {_kmers('p', 'refs', K)},
a AS (SELECT canon, count(*) AS cnt FROM w GROUP BY canon UNION ALL SELECT canon, 50 * count(*) FROM p GROUP BY canon),
t AS (SELECT canon, sum(cnt)::BIGINT AS cnt FROM a GROUP BY canon) SELECT cnt, count(*) AS n_kmers FROM t GROUP BY cnt""")
def prior_boost(spark, sf_dir):
    priors = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    return kmers.spectrum(kmers.boost_priors(kmers.count_packed(V.seqs(spark, sf_dir), K), priors, K, 5.0))


@query(f"""WITH {SEQS}, {_kmers('w', 'seqs', K)}, c AS (SELECT canon FROM w GROUP BY canon HAVING count(*) >= 2)
SELECT id, count(*) AS n_solid FROM w WHERE canon IN (SELECT canon FROM c) GROUP BY id""")
def solid_membership(spark, sf_dir):
    return runs.members(V.seqs(spark, sf_dir), K, 2)


@query(f"""WITH {SEQS}, {_kmers('w', 'seqs', K)}, c AS (SELECT canon, count(*) AS cnt FROM w GROUP BY canon HAVING count(*) >= 3)
SELECT id, round(avg(coalesce(cnt, 2)), 6) AS mean_coverage FROM w LEFT JOIN c USING (canon) GROUP BY id""")
def kmer_coverage(spark, sf_dir):
    s = V.seqs(spark, sf_dir)
    counts = kmers.solid(kmers.count_packed(s, K), 3)
    return kmers.mean_coverage(s, counts, K, seq="seq").select("id", F.round("mean_coverage", 6).alias("mean_coverage"))


@query(f"""WITH RECURSIVE {SEQS}, {_kmers('w', 'seqs', K)}, c AS (SELECT count(*) AS cnt FROM w GROUP BY canon), n AS (SELECT count(*) AS n FROM c),
t AS (SELECT cnt AS top FROM (SELECT cnt, row_number() OVER (ORDER BY cnt) - 1 AS r FROM c), n WHERE r = n * 95 // 100),
m AS (SELECT greatest(least(top // 4, 35), 10) AS most FROM t), h AS (SELECT x AS c, (SELECT count(*) FROM c WHERE cnt = x) AS h FROM m, range(2, 36) AS q(x) WHERE x <= most),
f(c, valley, low, found) AS (SELECT 1::BIGINT, 2::BIGINT, 1000000000000::BIGINT, false UNION ALL
  SELECT h.c, CASE WHEN h <= low THEN h.c ELSE valley END, least(h, low), h > 2 * low AND h.c > valley + 2 FROM f JOIN h ON h.c = f.c + 1 WHERE NOT found)
SELECT CASE WHEN n <= 100 OR top < 30 THEN 2 ELSE coalesce((SELECT max(valley) FROM f WHERE found), 2) END::INT AS cutoff FROM n, t""")
def solid_cutoff(spark, sf_dir):
    return spark.createDataFrame([(kmers.solid_cutoff(kmers.count_packed(V.seqs(spark, sf_dir), K)),)], "cutoff int")


def _canon(x: str) -> str:
    return f"least({x}, {_rc(x)})"


# A step makes the next change of each sequence: of the first window that has one, the substitution that gains most.
_CORRECTION = f"""solid AS MATERIALIZED (SELECT canon AS s FROM w GROUP BY canon HAVING count(*) >= 2),
f(id, seq, since, changed) AS (SELECT id, seq, 0::BIGINT, 0::BIGINT FROM refs UNION ALL
SELECT id, left(seq, i + o) || b || substr(seq, i + o + 2), i + 1, changed + 1 FROM (
  WITH win AS (SELECT id, seq, since, changed, i, substr(seq, i + 1, 21) AS x FROM (SELECT *, unnest(range(0, length(seq) - 20)) AS i FROM f)),
  known AS (SELECT win.*, s IS NOT NULL AS ok FROM win LEFT JOIN solid ON s = {_canon('x')}),
  tried AS (SELECT id, seq, since, changed, i, o, b, left(x, o) || b || substr(x, o + 2) AS y FROM (SELECT *, unnest(range(0, 21)) AS o FROM known WHERE NOT ok AND i >= since), (VALUES ('A'), ('C'), ('G'), ('T')) AS v(b) WHERE b != substr(x, o + 1, 1)),
  good AS (SELECT tried.* FROM tried JOIN solid ON s = {_canon('y')}),
  spread AS (SELECT *, unnest(range(greatest(0, i + o - 20), least(i + o, length(seq) - 21) + 1)) AS j FROM good),
  near AS (SELECT spread.*, substr(left(seq, i + o) || b || substr(seq, i + o + 2), j + 1, 21) AS z FROM spread),
  gain AS (SELECT near.id, near.seq, near.since, near.changed, near.i, o, b, count(s) - sum(known.ok::INT) AS gain FROM near LEFT JOIN solid ON s = {_canon('z')} JOIN known ON known.id = near.id AND known.i = near.j GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, gain DESC, o, b) AS n FROM gain WHERE gain > 0)
  SELECT * FROM best WHERE n = 1))"""


@query(f"WITH RECURSIVE {SEQS}, {REFS}, {_kmers('w', 'seqs', 21)}, {_CORRECTION} SELECT id, arg_max(seq, changed) AS seq, max(changed) AS changed FROM f GROUP BY id")
def corrected_reads(spark, sf_dir):
    """Benchmark sequences against the solid k-mers of the documents."""
    return kmers.correct_reads(_refs(spark, sf_dir), kmers.seen_twice(kmers.count_packed(V.seqs(spark, sf_dir), 21)), 21)


@query(f"WITH {NOISY} SELECT id, md5(regexp_replace(seq, '[^ACGT]', '', 'g')) AS bases, length(regexp_replace(seq, '[^ACGT]', '', 'g'))::INT AS n_bases, ceil(length(regexp_replace(seq, '[^ACGT]', '', 'g')) / 4)::INT AS n_bytes FROM noisy")
def packed_reads(spark, sf_dir):
    two = packed.pack_reads(V.noisy_seqs(spark, sf_dir)).withColumn("n_bytes", F.length("packed")).withColumn("size", F.col("n_bases"))
    return packed.unpack_reads(two).select("id", F.md5("seq").alias("bases"), F.col("size").alias("n_bases"), "n_bytes")


@query(f"WITH {REFS}, {_kmers('w', 'refs', 15)} SELECT id, pos, substr(kmer, 2) || 'G' AS to_right, 'T' || left(kmer, 14) AS to_left, left(kmer, 1) || right(kmer, 1) AS ends FROM w")
def kmers_extended(spark, sf_dir):
    w = kmers.kmer_rows(_refs(spark, sf_dir), 15, ["id"])
    return w.select("id", F.col("pos").cast("long").alias("pos"), S.extend_right("kmer", F.lit("G")).alias("to_right"), S.prepend_left("kmer", F.lit("T")).alias("to_left"), F.concat(S.first_base("kmer"), S.last_base("kmer")).alias("ends"))


@query(f"""WITH {SEQS}, {REFS}, {_kmers('w', 'seqs', 32)}, {_kmers('p', 'refs', 32)}, r AS (SELECT DISTINCT canon FROM p)
SELECT w.id, count(*) AS total, sum((r.canon IS NULL)::INT)::BIGINT AS missing FROM w LEFT JOIN r USING (canon) GROUP BY w.id""")
def missing_kmers(spark, sf_dir):
    return resolve.novelty(V.contigs(spark, sf_dir), _refs(spark, sf_dir).withColumnRenamed("seq", "sequence"), 32)


# Graph

_SOLID21 = f"{SEQS}, {_kmers('w', 'seqs', 21)}, c AS (SELECT canon AS kmer, count(*) AS cnt FROM w GROUP BY canon HAVING count(*) >= 2)"


@query(f"""WITH {_SOLID21}, nodes AS (SELECT kmer AS node FROM c UNION SELECT {_rc('kmer')} FROM c),
e AS (SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON substr(a.node, 2) = substr(b.node, 1, 20)),
o AS (SELECT src, count(*) AS out_degree FROM e GROUP BY src) SELECT out_degree, count(*) AS n_nodes FROM o GROUP BY out_degree""")
def adjacency_degrees(spark, sf_dir):
    return graph.out_degrees(kmers.seen_twice(kmers.count_packed(V.seqs(spark, sf_dir), 21)), 21)


@query()
def unitigs(spark, sf_dir):
    return graph.unitigs_of(V.seqs(spark, sf_dir), K, 2)


@query()
def simplified_contigs(spark, sf_dir):
    raw = graph.unitigs_of(V.seqs(spark, sf_dir), K, 2)
    return graph.simplify(raw, K, min_coverage=2.5, min_length=60)


_SIDES = f"sides AS (SELECT id, false AS rc, sequence AS s FROM contigs UNION ALL SELECT id, true, {_rc('sequence')} FROM contigs)"


@query(f"""WITH {SEQS}, {CONTIGS}, {_SIDES} SELECT a.id AS src, a.rc AS src_rc, b.id AS dst, b.rc AS dst_rc FROM sides a JOIN sides b
ON right(a.s, 10) = left(b.s, 10) WHERE length(a.s) >= 10 AND length(b.s) >= 10""")
def contig_overlaps(spark, sf_dir):
    return graph.overlaps(V.contigs(spark, sf_dir), 11)


@query(f"WITH {SEQS}, {CONTIGS} SELECT id FROM contigs WHERE NOT (length(sequence) < 1000 AND mean_coverage < 5)")
def tips_clipped(spark, sf_dir):
    return graph.clip_tips(V.contigs(spark, sf_dir), 500, 5.0).select("id")


_END = f"least(left(sequence, 10) || ':' || right(sequence, 10), {_rc('right(sequence, 10)')} || ':' || {_rc('left(sequence, 10)')})"


@query(f"""WITH {SEQS}, {CONTIGS}, e AS (SELECT *, CASE WHEN length(sequence) >= 10 THEN {_END} ELSE '#' || id END AS key FROM contigs),
r AS (SELECT *, row_number() OVER w AS n, first(length(sequence)) OVER w AS blen, first(mean_coverage) OVER w AS bcov FROM e
      WINDOW w AS (PARTITION BY key ORDER BY mean_coverage DESC, length(sequence) DESC, id))
SELECT id FROM r WHERE n = 1 OR NOT (abs(length(sequence) - blen) <= 22 OR bcov / greatest(mean_coverage, 0.1) >= 2)""")
def bubbles_popped(spark, sf_dir):
    return graph.pop_bubbles(V.contigs(spark, sf_dir), 11).select("id")


@query(f"""WITH {SEQS}, {CONTIGS} SELECT row_number() OVER (ORDER BY length(sequence) DESC, sequence, mean_coverage DESC, kmers_count) - 1 AS id, length(sequence)::INT AS len
FROM contigs WHERE length(sequence) >= 500""")
def renumbered(spark, sf_dir):
    return graph.length_filter(V.contigs(spark, sf_dir), 500).select("id", F.length("sequence").alias("len"))


@query("""WITH n AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS r, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT v AS median FROM n WHERE r = n // 2""")
def upper_median(spark, sf_dir):
    v = graph.upper_median(V.table(spark, sf_dir, "documents"), "n_chars")
    return spark.createDataFrame([(v,)], "median long")


# Mapping

_ANCH = f"{SEQS}, {REFS}, {_kmers('w', 'refs', 21)}, one AS (SELECT canon, min(id) AS contig, min(pos) AS cpos, bool_or(kmer != canon) AS flipped FROM w GROUP BY canon HAVING count(*) = 1)"


@query(f"WITH {REFS}, {_kmers('w', 'refs', 21)}, one AS (SELECT canon, min(id) AS contig FROM w GROUP BY canon HAVING count(*) = 1) SELECT contig, count(*) AS n_anchors FROM one GROUP BY contig")
def anchors_strict(spark, sf_dir):
    c = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    return mapping.unique_anchors(c, 21).groupBy("contig").agg(F.count("*").alias("n_anchors"))


@query(f"WITH {REFS}, {_kmers('w', 'refs', 21)}, one AS (SELECT canon, min(id) AS contig FROM w GROUP BY canon HAVING count(DISTINCT id) = 1) SELECT contig, count(*) AS n_anchors FROM one GROUP BY contig")
def anchors_per_contig(spark, sf_dir):
    c = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    return mapping.unique_anchors(c, 21, per_contig=True).groupBy("contig").agg(F.count("*").alias("n_anchors"))


_READS = """reads AS (SELECT id * 1000000 + p AS rid, substr(seq, p + 1, 100) AS seq FROM (SELECT id, seq, unnest(range(0, length(seq) - 99, 20)) AS p FROM seqs WHERE length(seq) >= 100)),
probe AS (SELECT rid, unnest(list_distinct(list_append(range(0, 80, 8), 79))) AS pos, seq FROM reads),
hit AS (SELECT rid, pos, substr(seq, pos + 1, 21) AS kmer FROM probe),
met AS (SELECT rid, contig, pos, cpos, (kmer != canon) = flipped AS same FROM (SELECT *, least(kmer, """ + _rc("kmer") + """) AS canon FROM hit) JOIN one USING (canon))"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reads(spark, sf_dir).select((F.col("id") * 1_000_000 + F.col("pos")).alias("read_id"), "seq")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    return mapping.map_reads(_reads(spark, sf_dir), mapping.unique_anchors(c, 21), 21)


@query(f"WITH {_ANCH}, {_READS} SELECT rid AS read_id, arg_min(contig, pos) AS contig, arg_min(cpos, pos)::INT AS contig_pos, min(pos)::INT AS read_pos, arg_min(same, pos) AS same_strand FROM met GROUP BY rid")
def mapped_reads(spark, sf_dir):
    return _mapped(spark, sf_dir)


@query("""WITH l AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS support FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY support DESC, dst) AS n FROM l)
SELECT src, max(CASE WHEN n = 1 THEN dst END) AS best, max(CASE WHEN n = 1 THEN support END) AS best_support, coalesce(max(CASE WHEN n = 2 THEN support END), 0) AS second_support FROM r GROUP BY src""")
def support_ratios(spark, sf_dir):
    links = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("support"))
    return mapping.best_two(links)


@query("""WITH p AS (SELECT l_partkey % 97 AS c1, l_suppkey % 97 AS c2 FROM lineitem),
s AS (SELECT c1 AS src, c2 AS dst FROM p WHERE c1 != c2 UNION ALL SELECT c2, c1 FROM p WHERE c1 != c2) SELECT src, dst, count(*) AS support FROM s GROUP BY src, dst""")
def link_support(spark, sf_dir):
    pairs = V.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 97).alias("c1"), (F.col("l_suppkey") % 97).alias("c2"))
    return mapping.paired_links(pairs)


@query("""WITH k AS (SELECT l_orderkey AS barcode, l_suppkey AS contig, count(*) AS n FROM lineitem GROUP BY ALL),
f AS (SELECT barcode FROM k GROUP BY barcode HAVING sum(n) >= 2 AND count(*) BETWEEN 2 AND 20), g AS (SELECT barcode, contig FROM k JOIN f USING (barcode))
SELECT a.contig AS u, b.contig AS v, count(*) AS support FROM g a JOIN g b ON a.barcode = b.barcode AND a.contig < b.contig GROUP BY ALL HAVING count(*) >= 3""")
def barcode_support(spark, sf_dir):
    return mapping.barcode_links(V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("barcode"), F.col("l_suppkey").alias("contig")))


@query("""WITH s AS (SELECT abs(l_partkey - l_suppkey) + 100 AS span FROM lineitem WHERE l_partkey != l_suppkey),
m AS (SELECT span, row_number() OVER (ORDER BY span) - 1 AS r, count(*) OVER () AS n FROM s WHERE span <= 30000), d AS (SELECT span AS med FROM m WHERE r = n // 2)
SELECT round(avg(span), 4) AS mean, round(stddev_pop(span), 4) AS deviation FROM s, d WHERE span <= 30000 AND span BETWEEN greatest(0.2 * med, 50) AND least(3 * med, 30000)""")
def insert_sizes(spark, sf_dir):
    p1, p2 = F.col("l_partkey"), F.col("l_suppkey")
    pairs = V.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("c1"), F.lit(0).alias("c2"), p1.alias("p1"), p2.alias("p2"), (F.abs(p1 - p2) + 100).alias("span"))
    mean, deviation = mapping.insert_size(pairs)
    return spark.createDataFrame([(round(mean, 4), round(deviation, 4))], "mean double, deviation double")


@query(f"WITH {REFS}, {_kmers('w', 'refs', 9)}, o AS (SELECT canon, min(id) AS contig, arg_min(pos, pos) AS first FROM w GROUP BY canon HAVING count(DISTINCT id) = 1) SELECT contig, count(*) AS n_anchors, sum(first)::BIGINT AS places FROM o GROUP BY contig")
def anchors_polisher(spark, sf_dir):
    """Below 11 bases: k-mers of one contig with their first place."""
    c = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    return mapping.polisher_anchors(c, 9).groupBy("contig").agg(F.count("*").alias("n_anchors"), F.sum("pos").alias("places"))


@query(f"""WITH {_ANCH}, {_READS}, p AS (SELECT rid, arg_min(contig, pos) AS contig, arg_min(cpos, pos) AS cpos FROM met GROUP BY rid),
q AS (SELECT rid // 40 AS pair_id, rid % 40 AS m, contig, cpos FROM p)
SELECT a.pair_id, a.contig AS c1, a.cpos::INT AS p1, b.contig AS c2, b.cpos::INT AS p2, (abs(a.cpos - b.cpos) + 100)::INT AS span FROM q a JOIN q b ON a.pair_id = b.pair_id AND a.m = 0 AND b.m = 20""")
def mates_placed(spark, sf_dir):
    """Windows of a text that follow one another as mates."""
    r = _reads(spark, sf_dir).select("read_id", F.floor(F.col("read_id") / 40).alias("pair_id"), F.when(F.col("read_id") % 40 == 0, 1).otherwise(2).alias("mate"), "seq")
    c = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    return mapping.mate_pairs(mapping.map_reads(r, mapping.unique_anchors(c, 21), 21), r)


@query(f"""WITH {SEQS}, {REFS}, {_kmers('p', 'refs', 15)}, l AS (SELECT id, seq FROM seqs WHERE length(seq) >= 500), {_kmers('w', 'l', 15)}, n AS (SELECT count(*) AS n FROM refs),
s AS (SELECT canon FROM p GROUP BY canon HAVING count(*) <= 5 OR (SELECT n FROM n) <= 10), d AS (SELECT DISTINCT canon, id AS contig, kmer != canon AS f FROM p SEMI JOIN s USING (canon)),
h AS (SELECT DISTINCT w.id AS read_id, contig, (kmer != canon) != f AS rc, pos FROM w JOIN d USING (canon) WHERE pos % 5 = 0),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY read_id, contig, rc ORDER BY pos) <= 1500 THEN 0 ELSE 1 END AS new FROM h),
j AS (SELECT *, sum(new) OVER (PARTITION BY read_id, contig, rc ORDER BY pos) AS g FROM g)
SELECT read_id, contig, rc, min(pos)::INT AS first_pos, (max(pos) + 15)::INT AS last_pos, count(*) AS hits FROM j GROUP BY read_id, contig, rc, g""")
def seed_anchors(spark, sf_dir):
    """Where the long texts touch the benchmark sequences."""
    c = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    out = mapping.seed_anchors(V.seqs(spark, sf_dir).withColumnRenamed("id", "read_id"), c, 31)
    return out.withColumnsRenamed({"start": "first_pos", "end": "last_pos"})


@query("""WITH s AS (SELECT l_partkey AS u, l_suppkey AS v, count(*) AS support FROM lineitem GROUP BY ALL) SELECT row_number() OVER (ORDER BY support DESC, u, v) - 1 AS place, u, v, support FROM s""")
def links_by_support(spark, sf_dir):
    links = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")).agg(F.count("*").alias("support"))
    return resolve.by_support(links)


# The polisher looks up windows at multiples of 21 div 2 + 1 only, the first that meets an anchor decides, and votes outside the contig are dropped.
_VOTES = _ANCH + """, reads AS (SELECT id * 1000000 + p AS rid, substr(seq, p + 1, 100) AS seq FROM (SELECT id, seq, unnest(range(0, length(seq) - 99, 20)) AS p FROM seqs WHERE length(seq) >= 100)),
probe AS (SELECT rid, unnest(range(0, 80, 11)) AS pos, seq FROM reads), hit AS (SELECT rid, pos, seq, substr(seq, pos + 1, 21) AS kmer FROM probe),
met AS (SELECT rid, seq, contig, pos, cpos, (kmer != canon) = flipped AS same FROM (SELECT *, least(kmer, """ + _rc("kmer") + """) AS canon FROM hit) JOIN one USING (canon)),
first AS (SELECT rid, any_value(seq) AS seq, arg_min(contig, pos) AS contig, arg_min(cpos, pos) AS cpos, min(pos) AS pos, arg_min(same, pos) AS same FROM met GROUP BY rid),
laid AS (SELECT contig, CASE WHEN same THEN cpos - pos + i ELSE cpos + 20 + pos - i END AS pos, CASE WHEN same THEN substr(seq, i + 1, 1) ELSE translate(substr(seq, i + 1, 1), 'ACGT', 'TGCA') END AS b FROM (SELECT *, unnest(range(0, 100)) AS i FROM first)),
votes AS (SELECT contig, pos, sum((b = 'A')::INT)::BIGINT AS a, sum((b = 'C')::INT)::BIGINT AS c, sum((b = 'G')::INT)::BIGINT AS g, sum((b = 'T')::INT)::BIGINT AS t
FROM laid JOIN refs ON refs.id = contig WHERE pos >= 0 AND pos < length(refs.seq) GROUP BY contig, pos)"""


@query(f"WITH {_VOTES} SELECT contig, pos::INT AS pos, a, c, g, t FROM votes")
def pileup(spark, sf_dir):
    return polish.pileup(polish.lay_reads(_reads(spark, sf_dir), _refs(spark, sf_dir).withColumnRenamed("seq", "sequence"), 21))


def _polished(name: str, least: int, share: float) -> str:
    return f"""{name}_x AS (SELECT id, i AS pos, substr(seq, i + 1, 1) AS old, greatest(a, c, g, t) AS top, a + c + g + t AS total, CASE WHEN a >= greatest(c, g, t) THEN 'A' WHEN c >= greatest(g, t) THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END AS b
FROM (SELECT id, seq, unnest(range(0, length(seq))) AS i FROM broken) LEFT JOIN votes ON votes.contig = id AND votes.pos = i),
{name} AS (SELECT id, string_agg(CASE WHEN old != 'N' AND total >= {least} AND top / total >= {share} THEN b ELSE old END, '' ORDER BY pos) AS s, sum((old != 'N' AND total >= {least} AND top / total >= {share} AND b != old)::INT)::BIGINT AS changed FROM {name}_x GROUP BY id)"""


_BROKEN = r"broken AS (SELECT id, regexp_replace(seq, '(.{25})[ACGT](.{9})[ACGT]', '\1N\2R', 'g') AS seq FROM refs)"


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark sequences with an N and an R in every 36 bases."""
    return _refs(spark, sf_dir).select("id", F.regexp_replace("seq", "(.{25})[ACGT](.{9})[ACGT]", "$1N$2R").alias("sequence"))


# Votes come from the whole sequences, so that contigs with N and R can be compared place by place.
@query(f"WITH {_VOTES}, {_BROKEN}, {_polished('p', 5, 0.8)} SELECT id, md5(s) AS sequence, changed FROM p")
def polished(spark, sf_dir):
    votes = polish.pileup(polish.lay_reads(_reads(spark, sf_dir), _refs(spark, sf_dir).withColumnRenamed("seq", "sequence"), 21))
    return polish.consensus(_breaks(spark, sf_dir), votes).withColumn("sequence", F.md5("sequence"))


@query(f"WITH {_VOTES}, {_BROKEN}, {_polished('p', 12, 0.85)} SELECT id, md5(s) AS sequence, changed FROM p")
def polished_carefully(spark, sf_dir):
    """Careful, with a least support above the careful one."""
    votes = polish.pileup(polish.lay_reads(_reads(spark, sf_dir), _refs(spark, sf_dir).withColumnRenamed("seq", "sequence"), 21))
    return polish.consensus(_breaks(spark, sf_dir), votes, careful=True, min_support=12).withColumn("sequence", F.md5("sequence"))


def _contig_links(spark: SparkSession, sf_dir: str, contigs: DataFrame) -> DataFrame:
    """(src, dst, support): keys of lineitem dealt over all contigs, in the order of their ids."""
    ids = graph.numbered(contigs.select("id"), ["id"], name="place")
    n = max(contigs.count(), 1)
    links = V.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % n).alias("p"), (F.col("l_suppkey") % n).alias("q")).agg(F.count("*").alias("support"))
    ends = [ids.select(F.col("place").alias(at), F.col("id").alias(name)) for at, name in (("p", "src"), ("q", "dst"))]
    return links.join(ends[0], "p").join(ends[1], "q").filter("src != dst").select("src", "dst", "support")


@query()
def scaffolds(spark, sf_dir):
    c = _refs(spark, sf_dir).select("id", F.col("seq").alias("sequence"), F.lit(10.0).alias("mean_coverage"), F.lit(1).cast("long").alias("kmers_count"))
    return resolve.build_scaffolds(c, _contig_links(spark, sf_dir, c))

# Repeat resolution: from the 3' end of each contig, on contigs with overlaps of 5 bases.
_CHOICE = f"""{SEQS}, {CONTIGS}, link AS (SELECT l_orderkey AS src, l_suppkey AS dst, count(*) AS support FROM lineitem GROUP BY ALL),
e0 AS (SELECT a.id AS src, b.id AS dst, false AS rc FROM contigs a JOIN contigs b ON right(a.sequence, 5) = left(b.sequence, 5) AND a.id != b.id WHERE length(a.sequence) >= 5 AND length(b.sequence) >= 5
  UNION ALL SELECT a.id, b.id, true FROM contigs a JOIN contigs b ON right(a.sequence, 5) = {_rc('right(b.sequence, 5)')} AND a.id != b.id WHERE length(a.sequence) >= 5 AND length(b.sequence) >= 5),
e1 AS (SELECT e0.*, coalesce(support, 0) AS s, count(*) OVER (PARTITION BY e0.src) AS n_out, count(*) OVER (PARTITION BY e0.dst) AS n_in FROM e0 LEFT JOIN link USING (src, dst)),
e2 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst, rc) AS r, coalesce(lead(s) OVER (PARTITION BY src ORDER BY s DESC, dst, rc), 0) AS second FROM e1),
e3 AS (SELECT * FROM e2 WHERE (n_out = 1 AND (n_in = 1 OR s >= 3)) OR (n_out > 1 AND r = 1 AND s >= 3 AND s / greatest(second, 1) >= 2.5)),
e4 AS (SELECT *, count(*) OVER (PARTITION BY dst) AS n, row_number() OVER (PARTITION BY dst ORDER BY s DESC, src) AS q, coalesce(lead(s) OVER (PARTITION BY dst ORDER BY s DESC, src), 0) AS next FROM e3),
e5 AS (SELECT src, dst, rc FROM e4 WHERE n = 1 OR (q = 1 AND s >= 3 AND (next = 0 OR s / next >= 2.5)))"""


@query(f"WITH {_CHOICE} SELECT src, dst, rc AS dst_rc FROM e5 WHERE src NOT IN (SELECT dst FROM e5 WHERE rc)")
def chosen_successors(spark, sf_dir):
    links = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("support"))
    return resolve.choose_successors(V.contigs(spark, sf_dir), links, 6)


@query(f"""WITH RECURSIVE {SEQS}, {CONTIGS}, l AS (SELECT DISTINCT a.id AS u, b.id AS v FROM contigs a JOIN contigs b ON right(a.sequence, 8) = left(b.sequence, 8) WHERE length(a.sequence) >= 8 AND length(b.sequence) >= 8),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r(node, c) AS (SELECT u, u FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node WHERE r.c < e.v) SELECT node, min(c) AS component FROM r GROUP BY node""")
def contig_components(spark, sf_dir):
    """Contigs that overlaps of 8 bases on the same strand join."""
    e = graph.overlaps(V.contigs(spark, sf_dir), 9).filter("NOT src_rc AND NOT dst_rc")
    return graph.components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))


# Sequences and reads


@query(f"WITH {SEQS} SELECT id, md5({_rc('seq')}) AS rc, md5(least(seq, {_rc('seq')})) AS canon, {_rc('seq')} < seq AS flipped FROM seqs")
def strands(spark, sf_dir):
    return V.seqs(spark, sf_dir).select("id", F.md5(S.revcomp("seq")).alias("rc"), F.md5(S.canonical("seq")).alias("canon"), S.is_flipped("seq").alias("flipped"))


@query(f"WITH {NOISY} SELECT id, length(regexp_replace(seq, '[^GC]', '', 'g'))::INT AS gc, length(regexp_replace(seq, '[^ACGT]', '', 'g'))::INT AS acgt, length(seq)::INT AS len FROM noisy")
def base_counts(spark, sf_dir):
    return V.noisy_seqs(spark, sf_dir).select("id", S.gc_count("seq").alias("gc"), S.acgt_count("seq").alias("acgt"), F.length("seq").alias("len"))


@query(f"""WITH {SEQS} SELECT id, coalesce(sum((substr(seq, i, 1) != substr({_rc('seq')}, i, 1))::INT), 0)::INT AS distance
FROM (SELECT id, seq, unnest(range(1, greatest(length(seq), 1) + 1)) AS i FROM seqs) GROUP BY id""")
def strand_distance(spark, sf_dir):
    return V.seqs(spark, sf_dir).select("id", S.hamming("seq", S.revcomp("seq")).alias("distance"))


@query(f"""WITH {REFS}, {_kmers('w', 'refs', 15)}, d AS (SELECT id, pos, kmer, unnest(range(0, 15)) AS i FROM w)
SELECT id, pos::INT AS pos, sum(((strpos('ACGT', substr(kmer, i + 1, 1)) - 1)::BIGINT << (2 * (14 - i))::BIGINT))::BIGINT AS code FROM d GROUP BY id, pos""")
def kmer_codes(spark, sf_dir):
    return kmers.kmer_rows(_refs(spark, sf_dir), 15, ["id"]).select("id", "pos", S.encode_kmer("kmer").alias("code"))


@query(f"WITH {NOISY}, t AS (SELECT id, regexp_replace(seq, '^[^ACGTacgt]+|[^ACGTacgt]+$', '', 'g') AS s FROM noisy), r AS (SELECT id, list_filter(regexp_split_to_array(s, '[^ACGTacgt]+'), lambda x: length(x) >= 21) AS runs FROM t) SELECT id, len(runs)::INT AS n_runs, coalesce(list_sum(list_transform(runs, lambda x: length(x))), 0)::BIGINT AS bases FROM r")
def clean_runs(spark, sf_dir):
    runs = S.clean_runs(S.trim_ambiguous_ends("seq"))
    return V.noisy_seqs(spark, sf_dir).select("id", F.size(runs).alias("n_runs"), F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("bases"))


@query(f"""WITH {NOISY}, t AS (SELECT id // 2 AS pair_id, id % 2 AS m, regexp_replace(seq, '^[^ACGTacgt]+|[^ACGTacgt]+$', '', 'g') AS s FROM noisy),
p AS (SELECT pair_id, bool_and(length(s) >= 21 AND NOT regexp_matches(s, '[^ACGT]')) AND count(*) = 2 AS clean FROM t GROUP BY pair_id),
q AS (SELECT t.*, clean, list_filter(regexp_split_to_array(s, '[^ACGTacgt]+'), lambda x: length(x) >= 21) AS runs FROM t JOIN p USING (pair_id)),
o AS (SELECT CASE WHEN clean THEN (m + 1)::INT WHEN len(runs) > 0 THEN 3 ELSE 0 END AS block, CASE WHEN clean OR len(runs) = 0 THEN [s] ELSE runs END AS parts FROM q WHERE s != '')
SELECT block, sum(len(parts))::BIGINT AS n_reads, sum(list_sum(list_transform(parts, lambda x: length(x))))::BIGINT AS bases FROM o GROUP BY block""")
def routed_reads(spark, sf_dir):
    pairs = R.deinterleave(V.noisy_seqs(spark, sf_dir).select(F.col("id").alias("ordinal"), "seq"))
    return R.route(pairs).groupBy("block").agg(F.count("*").alias("n_reads"), F.sum(F.length("seq").cast("long")).alias("bases"))


_Q = "list_transform(range(1, length(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33)"


@query(f"WITH {NOISY}, {QUALS}, q AS (SELECT id, pos, {_Q} AS q FROM quals) SELECT id, pos::INT AS pos, coalesce(list_max(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN q[i] >= 20 THEN i ELSE 0 END)), 0)::INT AS kept FROM q")
def quality_ends(spark, sf_dir):
    return V.quals(spark, sf_dir).select("id", "pos", S.quality_end("qual", 20).alias("kept"))


@query(f"""WITH {NOISY}, {QUALS}, q AS (SELECT id, pos, {_Q} AS q FROM quals)
SELECT id, pos::INT AS pos, coalesce(list_max(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN q[i] >= 20 AND (i < 4 OR q[i] + q[i-1] + q[i-2] + q[i-3] >= 80) THEN i ELSE 0 END)), 0)::INT AS kept FROM q""")
def window_ends(spark, sf_dir):
    return V.quals(spark, sf_dir).select("id", "pos", S.window_end("qual", 4, 20).alias("kept"))


@query(f"""WITH {NOISY}, {QUALS}, q AS (SELECT seq, {_Q} AS q FROM quals), f AS (SELECT CASE WHEN length(seq) < 30 THEN 'too_short' WHEN length(seq) - length(replace(seq, 'N', '')) > 3 THEN 'too_many_ns'
WHEN list_sum(q) < 0.75 * 30 * len(q) THEN 'low_quality' ELSE 'pass' END AS fate FROM q) SELECT fate, count(*) AS n_reads FROM f GROUP BY fate""")
def read_fates(spark, sf_dir):
    return R.drop_reasons(V.quals(spark, sf_dir).withColumn("fate", S.read_fate("seq", "qual", min_quality=30)))


@query(f"""WITH {NOISY}, {QUALS}, q AS (SELECT seq, {_Q} AS q FROM quals) SELECT count(*) AS n_reads, sum(length(seq))::BIGINT AS n_bases, sum(len(list_filter(q, lambda x: x >= 20)))::BIGINT AS q20,
sum(len(list_filter(q, lambda x: x >= 30)))::BIGINT AS q30, sum(length(regexp_replace(seq, '[^GC]', '', 'g')))::BIGINT AS gc FROM q""")
def read_totals(spark, sf_dir):
    return R.read_totals(V.quals(spark, sf_dir))


@query(f"WITH {NOISY}, {QUALS} SELECT id, pos::INT AS pos, (CASE WHEN length(seq) - length(regexp_replace(seq, 'G+$', '')) >= 2 THEN length(regexp_replace(seq, 'G+$', '')) ELSE length(seq) END)::INT AS kept FROM quals")
def poly_g_ends(spark, sf_dir):
    return V.quals(spark, sf_dir).select("id", "pos", S.poly_g_end("seq", 2).alias("kept"))


@query(f"WITH {NOISY}, {QUALS} SELECT CASE WHEN min(ascii(c)) < 59 THEN 33 WHEN max(ascii(c)) > 74 THEN 64 ELSE 33 END::INT AS phred FROM (SELECT unnest(string_split(qual, '')) AS c FROM quals) WHERE c != '' AND ascii(c) >= 33")
def phred(spark, sf_dir):
    return spark.createDataFrame([(R.detect_phred(V.quals(spark, sf_dir)),)], "phred int")


_BASES12 = f"left(translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LET}', '{_BAS}'), 40)"
_HEADERS = f"""heads AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'BX:Z:' || coalesce(source, '') || '-1' WHEN 1 THEN 'x BC:Z:' || left({_BASES12}, 16) || '-12' WHEN 2 THEN '#' || left({_BASES12}, 10) || '/1 BX:Y:no'
WHEN 3 THEN 'r#' || coalesce(source, '') || '-a' WHEN 4 THEN 'BX:Z:' || {_BASES12} || ' #else' ELSE 'none' END AS head, doc_id % 6 AS kind, source, {_BASES12} AS b FROM documents),
codes AS (SELECT doc_id, nullif(CASE kind WHEN 0 THEN coalesce(source, '') WHEN 1 THEN left(b, 16) WHEN 2 THEN left(b, 10) WHEN 3 THEN coalesce(source, '') || '-a' WHEN 4 THEN b END, '') AS barcode FROM heads)"""


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, head): headers of all shapes that can hold a barcode, and of one without."""
    d = V.table(spark, sf_dir, "documents")
    b = F.left(F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), V.LETTERS, V.AS_BASES), F.lit(40))
    name, kind = F.coalesce("source", F.lit("")), F.col("doc_id") % 6
    shapes = [F.concat(F.lit("BX:Z:"), name, F.lit("-1")), F.concat(F.lit("x BC:Z:"), F.left(b, F.lit(16)), F.lit("-12")), F.concat(F.lit("#"), F.left(b, F.lit(10)), F.lit("/1 BX:Y:no")), F.concat(F.lit("r#"), name, F.lit("-a")), F.concat(F.lit("BX:Z:"), b, F.lit(" #else"))]
    head = F.lit("none")
    for i, shape in enumerate(shapes):
        head = F.when(kind == i, shape).otherwise(head)
    return d.select("doc_id", head.alias("head"))


@query(f"WITH {_HEADERS} SELECT doc_id, barcode FROM codes")
def barcodes(spark, sf_dir):
    return _headers(spark, sf_dir).select("doc_id", S.header_barcode("head").alias("barcode"))


# 64-bit numbers as text, as SQL has them unsigned: bases in two bits each, all else by FNV-1a.
@query(f"""WITH {_HEADERS}, n AS (SELECT doc_id, barcode, CASE WHEN regexp_matches(barcode, '^[ACGTacgt]{{1,32}}$')
THEN list_reduce([0::HUGEINT] || list_transform(range(1, length(barcode) + 1), lambda i: (strpos('ACGT', upper(substr(barcode, i, 1))) - 1)::HUGEINT), lambda a, x: (a * 4 + x) % 18446744073709551616::HUGEINT)
WHEN barcode IS NOT NULL THEN list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1, length(barcode) + 1), lambda i: ascii(substr(barcode, i, 1))::HUGEINT), lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) END AS v FROM codes)
SELECT doc_id, (CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END)::BIGINT AS code FROM n""")
def barcode_numbers(spark, sf_dir):
    return _headers(spark, sf_dir).select("doc_id", S.barcode_number(S.header_barcode("head")).alias("code"))


@query(f"WITH {NOISY}, {QUALS} SELECT id, pos::INT AS pos, (length(seq) - length(regexp_replace(seq, '^N+', '')) + 1)::INT AS first, length(regexp_replace(seq, '^N+|N+$', '', 'g'))::INT AS kept FROM quals")
def poly_n_ends(spark, sf_dir):
    start, size = S.poly_n_bounds("seq")
    return V.quals(spark, sf_dir).select("id", "pos", start.alias("first"), size.alias("kept"))


_ADAPTERS = ("ACGTTGCAGTAC", "CATGACGTTA")


def _adapter_sql(adapter: str, least: int) -> str:
    m = len(adapter)
    differ = "list_sum(list_transform(range(1, {w} + 1), lambda j: (substr(seq, x + j, 1) != substr('" + adapter + "', j, 1))::INT))"
    tail = f"list_min(list_filter(range(greatest(length(seq) - {m}, 0), length(seq) - {least} + 1), lambda x: {differ.format(w='(length(seq) - x)')} <= greatest((length(seq) - x) // 10, (length(seq) - x >= 12)::INT)))"
    inside = f"list_min(list_filter(range(0, length(seq) - {m} + 1), lambda x: {differ.format(w=m)} <= {max(m // 10, 1)}))"
    return f"{tail}, {inside}"


@query(f"WITH {NOISY}, {QUALS} SELECT id, pos::INT AS pos, least({', '.join(_adapter_sql(a, 4) for a in _ADAPTERS)})::BIGINT AS cut_at FROM quals")
def adapter_cuts(spark, sf_dir):
    return V.quals(spark, sf_dir).select("id", "pos", S.adapter_start("seq", list(_ADAPTERS), 4).cast("long").alias("cut_at"))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) SELECT doc_id FROM o WHERE o < 100")
def first_reads(spark, sf_dir):
    return R.first_reads(graph.numbered(V.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], name="ordinal"), 100).select("doc_id")


# Mates by neighbouring pieces of a text; a read whose mate is dropped counts as too short.
@query(f"""WITH {NOISY}, {QUALS}, q AS (SELECT id * 100000 + pos // 240 AS pair_id, seq, {_Q} AS q FROM quals),
f AS (SELECT pair_id, CASE WHEN length(seq) < 30 THEN 'too_short' WHEN length(seq) - length(replace(seq, 'N', '')) > 3 THEN 'too_many_ns' WHEN list_sum(q) < 0.75 * 30 * len(q) THEN 'low_quality' ELSE 'pass' END AS fate FROM q),
g AS (SELECT fate, count(*) FILTER (fate = 'pass') OVER (PARTITION BY pair_id) AS passed FROM f)
SELECT CASE WHEN fate = 'pass' AND passed = 1 THEN 'too_short' ELSE fate END AS fate, count(*) AS n_reads FROM g GROUP BY ALL""")
def pair_fates(spark, sf_dir):
    reads = V.quals(spark, sf_dir).select((F.col("id") * 100_000 + F.floor(F.col("pos") / 240)).alias("pair_id"), "seq", "qual")
    return R.drop_reasons(R.drop_singletons(R.routed(reads.withColumn("fate", S.read_fate("seq", "qual", min_quality=30)))))


@query("""WITH n AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS o FROM documents), a AS (SELECT o, text FROM n WHERE lang = 'en'), b AS (SELECT o, text FROM n WHERE lang = 'de')
SELECT o AS pair_id, md5(a.text) AS r1, md5(b.text) AS r2 FROM a FULL JOIN b USING (o)""")
def paired_files(spark, sf_dir):
    """Texts of two languages as two files of mates; the longer one's tail has none."""
    d = V.table(spark, sf_dir, "documents")
    sides = [graph.numbered(d.filter(F.col("lang") == x).select("doc_id", F.md5("text").alias("seq")), ["doc_id"], name="ordinal") for x in ("en", "de")]
    return R.pair_files(*sides)


@query()
def preprocessed_reads(spark, sf_dir):
    cfg = R.QcConfig(adapters=("ACGTTGCAGTAC",), min_overlap=8, window_quality=18)
    return R.drop_reasons(R.preprocess(V.quals(spark, sf_dir), cfg))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents), s AS (SELECT *, greatest(n // 64, 1) AS step FROM o)
SELECT doc_id FROM s WHERE ordinal % step = 0 AND ordinal // step < 64""")
def sampled_reads(spark, sf_dir):
    d = graph.numbered(V.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], name="ordinal")
    return R.systematic_sample(d, 64).select("doc_id")


# Metrics


def _nx(f: float) -> str:
    return f"""WITH {SEQS}, {CONTIGS}, o AS (SELECT length(sequence) AS l, row_number() OVER w AS r, sum(length(sequence)) OVER w AS upto, sum(length(sequence)) OVER () AS total FROM contigs
WINDOW w AS (ORDER BY length(sequence) DESC, id ROWS UNBOUNDED PRECEDING)) SELECT max(l)::BIGINT AS nx, min(r)::BIGINT AS lx FROM o WHERE upto >= floor(total * {f} + 0.5)"""


@query(_nx(0.5))
def n50(spark, sf_dir):
    return metrics.nx_lx(V.contigs(spark, sf_dir), 0.5)


@query(_nx(0.9))
def n90(spark, sf_dir):
    return metrics.nx_lx(V.contigs(spark, sf_dir), 0.9)


@query(f"""WITH {SEQS}, {CONTIGS}, {REFS}, h AS (SELECT (sum(length(seq)) + 1) // 2 AS half FROM refs), o AS (SELECT length(sequence) AS l, row_number() OVER w AS r, sum(length(sequence)) OVER w AS upto FROM contigs
WINDOW w AS (ORDER BY length(sequence) DESC, id ROWS UNBOUNDED PRECEDING)) SELECT coalesce(max(l), 0)::BIGINT AS ng50, coalesce(min(r), 0)::BIGINT AS lg50 FROM o, h WHERE upto >= half""")
def ng50(spark, sf_dir):
    total = _refs(spark, sf_dir).agg(F.sum(F.length("seq"))).first()[0]
    return metrics.ng50(V.contigs(spark, sf_dir), total)


@query(f"""WITH {SEQS}, {CONTIGS}, s AS (SELECT count(*) AS n, sum(length(sequence))::BIGINT AS total, max(length(sequence)) AS longest, sum(length(regexp_replace(sequence, '[^GC]', '', 'g'))) AS gc, sum(length(regexp_replace(sequence, '[^ACGT]', '', 'g'))) AS acgt FROM contigs),
o AS (SELECT length(sequence) AS l, row_number() OVER w AS r, sum(length(sequence)) OVER w AS upto FROM contigs WINDOW w AS (ORDER BY length(sequence) DESC, id ROWS UNBOUNDED PRECEDING))
SELECT n AS n_contigs, total AS total_length, longest::BIGINT AS longest, (SELECT max(l) FROM o WHERE upto >= (total + 1) // 2)::BIGINT AS n50, (SELECT min(r) FROM o WHERE upto >= (total + 1) // 2)::BIGINT AS l50, round(100.0 * gc / acgt, 6) AS gc FROM s""")
def assembly_stats(spark, sf_dir):
    return metrics.assembly_stats(V.contigs(spark, sf_dir)).withColumn("gc", F.round("gc", 6))


@query(f"""WITH {NOISY}, c AS (SELECT seq FROM noisy WHERE length(seq) >= 200) SELECT count(*) AS n_contigs, sum(length(seq))::BIGINT AS total_length,
round(100.0 * sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / sum(length(seq)), 6) AS gc, round(100000.0 * sum(length(regexp_replace(seq, '[^N]', '', 'g'))) / sum(length(seq)), 6) AS n_per_100k FROM c""")
def composition(spark, sf_dir):
    return metrics.composition(V.noisy_seqs(spark, sf_dir), seq="seq").withColumns({c: F.round(c, 6) for c in ("gc", "n_per_100k")})


@query(f"""WITH {SEQS}, t AS (SELECT unnest([500, 1000, 5000, 10000, 50000])::BIGINT AS threshold) SELECT threshold, count(length(seq)) AS n_contigs, coalesce(sum(length(seq)), 0)::BIGINT AS total_length FROM t LEFT JOIN seqs ON length(seq) >= threshold GROUP BY threshold""")
def length_bins(spark, sf_dir):
    return metrics.length_bins(V.contigs(spark, sf_dir))


@query(f"""WITH {SEQS}, {REFS}, l AS (SELECT id, seq FROM seqs WHERE length(seq) >= 200), {_kmers('w', 'l', K)}, {_kmers('p', 'refs', K)}, r AS (SELECT DISTINCT canon FROM p),
o AS (SELECT w.canon, count(*) AS n, any_value(r.canon) IS NOT NULL AS hit FROM w LEFT JOIN r ON w.canon = r.canon GROUP BY w.canon)
SELECT round(100.0 * sum(hit::INT) / (SELECT count(*) FROM r), 6) AS genome_fraction, round(sum(CASE WHEN hit THEN n END) / sum(hit::INT), 6) AS duplication_ratio,
round(100000.0 * (sum(CASE WHEN NOT hit THEN n ELSE 0 END)::BIGINT // {K}) / (SELECT sum(length(seq)) FROM l), 6) AS mismatches_per_100k FROM o""")
def reference_metrics(spark, sf_dir):
    ref = _refs(spark, sf_dir).withColumnRenamed("seq", "sequence")
    out = metrics.reference_metrics(V.contigs(spark, sf_dir), ref)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


# Modes


@query(f"WITH {SEQS}, {CONTIGS} SELECT id FROM contigs WHERE length(sequence) >= 500 AND mean_coverage >= 2")
def meta_contigs(spark, sf_dir):
    return modes.meta_filter(V.contigs(spark, sf_dir)).select("id")


@query(f"WITH {SEQS}, {CONTIGS} SELECT id FROM contigs WHERE length(sequence) >= 200 AND mean_coverage >= 1.5")
def transcripts(spark, sf_dir):
    return modes.rna_filter(V.contigs(spark, sf_dir)).select("id")


@query(f"WITH {SEQS}, {CONTIGS} SELECT id, least(mean_coverage, 8)::DOUBLE AS mean_coverage FROM contigs WHERE mean_coverage >= 2")
def single_cell(spark, sf_dir):
    return modes.single_cell_normalize(V.contigs(spark, sf_dir), cap=8.0).select("id", "mean_coverage")


@query(f"""WITH {SEQS}, {CONTIGS}, m AS (SELECT mean_coverage AS med FROM (SELECT mean_coverage, row_number() OVER (ORDER BY mean_coverage) - 1 AS r, count(*) OVER () AS n FROM contigs) WHERE r = n // 2)
SELECT id, length(sequence) >= 300 AND ((length(sequence) <= 450000 AND len(list_filter(range(10, least(10, length(sequence) // 2) + 1), lambda o: left(sequence, o) = right(sequence, o))) > 0)
OR (length(sequence) <= 350000 AND mean_coverage >= 1.8 * greatest(med, 1))) AS plasmid FROM contigs, m""")
def plasmids(spark, sf_dir):
    return modes.plasmid_split(V.contigs(spark, sf_dir), 11).select("id", "plasmid")


@query(f"""WITH {SEQS}, {CONTIGS}, e AS (SELECT *, CASE WHEN length(sequence) >= 10 THEN {_END} END AS key, least(sequence, {_rc('sequence')}) AS canon FROM contigs),
g AS (SELECT *, count(key) OVER p AS n, max(length(sequence)) OVER p AS hi, min(length(sequence)) OVER p AS lo, max(mean_coverage) OVER p AS chi, min(mean_coverage) OVER p AS clo, min(canon) OVER p != max(canon) OVER p AS differ,
      row_number() OVER (PARTITION BY key ORDER BY mean_coverage, length(sequence), id DESC) AS r FROM e WINDOW p AS (PARTITION BY key))
SELECT id, coalesce(n = 2 AND differ AND (hi - lo) / hi <= 0.3 AND chi <= 2.5 * clo AND r = 1, false) AS haplotig FROM g""")
def haplotigs(spark, sf_dir):
    return modes.phase_haplotigs(V.contigs(spark, sf_dir), 11).select("id", "haplotig")


# Audits


@query(f"""WITH {SEQS}, {REFS}, {_kmers('l', 'refs', 25)}, {_kmers('w', 'seqs', 25)}, h AS (SELECT DISTINCT id AS contig, canon FROM w), c AS (SELECT l.id AS locus, contig, count(*) AS covered FROM l JOIN h USING (canon) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY covered DESC, contig) AS n FROM c)
SELECT refs.id AS locus, contig AS best_contig, coalesce(covered, 0) AS covered, greatest(length(seq) - 24, 0)::BIGINT AS positions FROM refs LEFT JOIN b ON refs.id = b.locus AND n = 1""")
def locus_recovery(spark, sf_dir):
    return audit.locus_recovery(_refs(spark, sf_dir), V.contigs(spark, sf_dir), 25).drop("percent")


@query(f"""WITH {SEQS}, {REFS}, {_kmers('l', 'refs', K)}, {_kmers('w', 'seqs', K)}, c AS (SELECT l.id, count(DISTINCT pos) AS covered FROM l WHERE canon IN (SELECT canon FROM w) GROUP BY l.id)
SELECT id AS locus, coalesce(covered, 0) AS covered, CASE WHEN 100.0 * coalesce(covered, 0) / greatest(length(seq) - 30, 1) >= 99 THEN 'INTACT' WHEN 100.0 * coalesce(covered, 0) / greatest(length(seq) - 30, 1) >= 50 THEN 'FRAGMENTED' ELSE 'ABSENT' END AS status FROM refs LEFT JOIN c USING (id)""")
def positional_recovery(spark, sf_dir):
    out = audit.positional_recovery(_refs(spark, sf_dir), V.contigs(spark, sf_dir), K)
    return out.select("locus", "covered", audit.recovery_class(F.col("percent"), 99, 50, ("INTACT", "FRAGMENTED", "ABSENT")).alias("status"))


@query(f"WITH {SEQS}, {REFS}, {_kmers('l', 'refs', K)}, {_kmers('w', 'seqs', K)}, h AS (SELECT DISTINCT w.id FROM w WHERE canon IN (SELECT canon FROM l)) SELECT (SELECT count(DISTINCT id) FROM seqs) AS n_reads, count(*) AS n_matching FROM h")
def identity_rate(spark, sf_dir):
    return audit.identity_rate(V.seqs(spark, sf_dir), _refs(spark, sf_dir)).drop("percent")


@query(f"""WITH {SEQS}, {REFS}, {_kmers('l', 'refs', K)}, {_kmers('w', 'seqs', K)}, f AS (SELECT canon, min(id) AS o FROM l GROUP BY canon) SELECT w.id, 'item' || min(o) AS species FROM w JOIN f USING (canon) WHERE pos % 10 = 0 GROUP BY w.id""")
def species_of_reads(spark, sf_dir):
    refs = _refs(spark, sf_dir).select(F.col("id").alias("order"), F.concat(F.lit("item"), F.col("id").cast("string")).alias("species"), "seq")
    return audit.assign_species(V.seqs(spark, sf_dir), refs)


@query("WITH p AS (SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS mixed FROM lineitem GROUP BY 1) SELECT count(*) AS n_contigs, sum(mixed::INT)::BIGINT AS n_mixed, round(100.0 * (count(*) - sum(mixed::INT)) / count(*), 6) AS purity FROM p")
def species_purity(spark, sf_dir):
    a = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contig"), F.col("l_returnflag").alias("species"))
    return audit.species_purity(a).withColumn("purity", F.round("purity", 6))


_UNION = IVS + """, m AS (SELECT chrom, start, "end", max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ivs),
g AS (SELECT *, sum(CASE WHEN upto IS NULL OR start > upto THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM g GROUP BY chrom, g)"""


@query(f'WITH {_UNION} SELECT chrom, start AS first_pos, "end" AS last_pos FROM u')
def interval_union(spark, sf_dir):
    return audit.interval_union(V.intervals(spark, sf_dir)).toDF("chrom", "first_pos", "last_pos")


@query(f'WITH {_UNION} SELECT chrom, sum("end" - start + 1)::BIGINT AS covered FROM u GROUP BY chrom')
def covered_bases(spark, sf_dir):
    return audit.covered_bases(V.intervals(spark, sf_dir))


# The whole table with itself.
_PAIRS = """a.chrom = b.chrom AND a.event_id != b.event_id AND a.start <= b."end" AND b.start <= a."end\""""


@query(f"WITH {IVS} SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM ivs a JOIN ivs b ON {_PAIRS} AND a.event_id < b.event_id")
def interval_overlaps(spark, sf_dir):
    v = V.intervals(spark, sf_dir)
    return audit.overlap_join(v, v, width=256).filter("l_event_id < r_event_id").select("l_event_id", "r_event_id")


@query(f"""WITH {IVS} SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM ivs a JOIN ivs b ON a.chrom = b.chrom AND a.event_id != b.event_id
AND b.start <= a.start - 30 AND b."end" >= a."end" + 30""")
def interval_containment(spark, sf_dir):
    v = V.intervals(spark, sf_dir)
    return audit.contained(v, v, width=256).filter("l_event_id != r_event_id").select("l_event_id", "r_event_id")


@query(f"""WITH {IVS} SELECT a.event_id, coalesce(max(CASE WHEN b.event_id IS NOT NULL THEN least(a."end", b."end") - greatest(a.start, b.start) + 1 END), 0)::BIGINT AS overlap
FROM ivs a LEFT JOIN ivs b ON {_PAIRS} GROUP BY a.event_id""")
def longest_overlap(spark, sf_dir):
    v = V.intervals(spark, sf_dir)
    both = audit.overlap_join(v, v, width=256).filter("l_event_id != r_event_id")
    size = F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1
    best = both.groupBy(F.col("l_event_id").alias("event_id")).agg(F.max(size).alias("overlap"))
    return v.select("event_id").join(best, "event_id", "left").select("event_id", F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))


@query(f"""WITH {IVS}, p AS (SELECT a.event_id AS gene, max(least(a."end", b."end") - greatest(a.start, b.start) + 1) AS n, bool_or(b.start <= a.start - 30 AND b."end" >= a."end" + 30) AS spanned
FROM ivs a JOIN ivs b ON {_PAIRS} GROUP BY a.event_id), f AS (SELECT event_id AS gene, coalesce(spanned, false) AS spanned, 100.0 * coalesce(n, 0) / ("end" - start + 1) AS x FROM ivs LEFT JOIN p ON p.gene = ivs.event_id)
SELECT gene, spanned, round(x, 6)::DOUBLE AS percent, CASE WHEN x >= 99 THEN '>=99' WHEN x >= 95 THEN '>=95' WHEN x >= 50 THEN '>=50' ELSE '<50' END AS bucket FROM f""")
def gene_span(spark, sf_dir):
    """Each event as a gene, against all other events as alignments."""
    v = V.intervals(spark, sf_dir)
    genes, others = v.withColumnRenamed("event_id", "gene"), v.withColumnRenamed("event_id", "other")
    return audit.gene_span(genes, others, "gene", width=256, distinct_from="other").withColumn("percent", F.round("percent", 6))


@query(f"""WITH {IVS}, p AS (SELECT a.event_id AS cen, b.event_id AS contig, a.start - b.start AS l, b."end" - a."end" AS r FROM ivs a JOIN ivs b ON a.chrom = b.chrom AND a.event_id != b.event_id AND b.start <= a.start AND b."end" >= a."end"),
q AS (SELECT *, row_number() OVER (PARTITION BY cen ORDER BY least(l, r) DESC, l + r DESC, contig) AS n FROM p)
SELECT event_id AS cen, CASE WHEN l IS NULL THEN 'SPLIT' WHEN least(l, r) >= 20 THEN 'INTACT' ELSE 'MARGINAL' END AS status, coalesce(l, 0)::BIGINT AS left_flank, coalesce(r, 0)::BIGINT AS right_flank, contig FROM ivs LEFT JOIN q ON cen = event_id AND n = 1""")
def centromere_synteny(spark, sf_dir):
    v = V.intervals(spark, sf_dir)
    return audit.centromere_synteny(v.withColumnRenamed("event_id", "cen"), v.withColumnRenamed("event_id", "contig"), "cen", flank=20, width=256, distinct_from="contig")


@query(f"""WITH {_UNION}, n AS (SELECT chrom, max("end") AS size FROM ivs GROUP BY chrom), c AS (SELECT chrom, sum("end" - start + 1)::BIGINT AS covered FROM u GROUP BY chrom)
SELECT chrom, covered, size AS length, round(100.0 * covered / size, 6) AS percent FROM n JOIN c USING (chrom)""")
def breadth(spark, sf_dir):
    v = V.intervals(spark, sf_dir)
    return audit.breadth(v, v.groupBy("chrom").agg(F.max("end").alias("length"))).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {SEQS}, {REFS}, {_kmers('l', 'refs', 25)}, {_kmers('w', 'seqs', 25)}, a AS (SELECT DISTINCT canon FROM w JOIN documents ON doc_id = id WHERE lang = 'en'), b AS (SELECT DISTINCT canon FROM w JOIN documents ON doc_id = id WHERE lang IS DISTINCT FROM 'en'),
c AS (SELECT id, sum((canon IN (SELECT canon FROM a))::INT)::BIGINT AS x, sum((canon IN (SELECT canon FROM b))::INT)::BIGINT AS y FROM l GROUP BY id), n AS (SELECT id, greatest(length(seq) - 24, 0)::BIGINT AS positions FROM refs)
SELECT id AS locus, positions, coalesce(x, 0)::BIGINT AS in_plasmids, coalesce(y, 0)::BIGINT AS in_chromosomes, round(100.0 * coalesce(x, 0) / greatest(positions, 1), 6) AS plasmid_percent, round(100.0 * coalesce(y, 0) / greatest(positions, 1), 6) AS chromosome_percent FROM n LEFT JOIN c USING (id)""")
def replicon_recovery(spark, sf_dir):
    """Benchmark sequences as replicons, English texts as plasmids, all others as chromosomes."""
    lang = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("_en"))
    c = V.contigs(spark, sf_dir).join(lang, "id")
    out = audit.replicon_recovery(_refs(spark, sf_dir), c.filter("_en"), c.filter("NOT _en"))
    return out.withColumns({x: F.round(x, 6) for x in ("plasmid_percent", "chromosome_percent")})


_PARTS = """parts AS (SELECT id AS operon, 'left' AS part, substr(seq, 1, 90) AS seq FROM refs UNION ALL SELECT id, 'inside', substr(seq, 91, 90) FROM refs UNION ALL SELECT id, 'right', substr(seq, 181, 90) FROM refs),
keyed AS (SELECT operon || ':' || part AS id, seq FROM parts)"""


@query(f"""WITH {SEQS}, {REFS}, {_PARTS}, {_kmers('l', 'keyed', 15)}, {_kmers('w', 'seqs', 15)}, h AS (SELECT split_part(l.id, ':', 1)::BIGINT AS operon, split_part(l.id, ':', 2) AS part, w.id AS contig FROM l JOIN w USING (canon) WHERE l.pos % 5 = 0),
c AS (SELECT operon, contig, count(*) FILTER (part = 'left') AS l, count(*) FILTER (part = 'inside') AS i, count(*) FILTER (part = 'right') AS r FROM h GROUP BY ALL),
o AS (SELECT operon, min(contig) FILTER (l >= 3 AND r >= 3) AS bridge, arg_max(contig, i * 1000000000 - contig) AS most FROM c WHERE i > 0 GROUP BY operon)
SELECT refs.id AS operon, CASE WHEN bridge IS NOT NULL THEN 'BRIDGED' WHEN most IS NOT NULL THEN 'PARTIAL' ELSE 'UNCOVERED' END AS status, coalesce(bridge, most) AS contig FROM refs LEFT JOIN o ON operon = refs.id""")
def operon_bridging(spark, sf_dir):
    r = _refs(spark, sf_dir)
    cuts = {"left": 1, "inside": 91, "right": 181}
    flanks = r.select(F.col("id").alias("operon"), F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.substring("seq", at, 90).alias("seq")) for p, at in cuts.items()))))
    return audit.operon_bridging(flanks, V.contigs(spark, sf_dir), k=15, every=5)


@query(f"""WITH {SEQS}, {CONTIGS}, c AS (SELECT round(mean_coverage, 2)::DOUBLE AS cov FROM contigs), o AS (SELECT cov, row_number() OVER (ORDER BY cov) - 1 AS r, count(*) OVER () AS n FROM c)
SELECT min(cov) AS low, max(CASE WHEN r = n // 2 THEN cov END) AS median, max(CASE WHEN r = floor(n * 0.95)::BIGINT THEN cov END) AS p95, max(cov) AS high, round(max(cov) / greatest(min(cov), 0.1), 6) AS fold FROM o""")
def coverage_dynamics(spark, sf_dir):
    headers = V.contigs(spark, sf_dir).select(F.concat(F.lit(">contig_1_len_9_cov_"), F.round("mean_coverage", 2).cast("double").cast("string"), F.lit("_x")).alias("header"))
    return audit.coverage_dynamics(headers).withColumn("fold", F.round("fold", 6))


# Sinks


@query(f"WITH {SEQS}, {CONTIGS}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM contigs) SELECT n::INT AS ordinal, '>contig_' || n || '_len_' || length(sequence) || '_cov_' || printf('%.1f', mean_coverage::DOUBLE) AS header, md5(sequence) AS body FROM n")
def fasta_records(spark, sf_dir):
    r = sinks.fasta_records(V.contigs(spark, sf_dir).withColumn("mean_coverage", F.col("mean_coverage").cast("double")))
    return r.select("ordinal", F.substring_index("value", "\n", 1).alias("header"), F.md5(F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n", ""), "\n", "")).alias("body"))


@query(f"""WITH {SEQS}, {CONTIGS}, {_SIDES}, e AS (SELECT a.id AS a, CASE WHEN a.rc THEN '-' ELSE '+' END AS x, b.id AS b, CASE WHEN b.rc THEN '-' ELSE '+' END AS y FROM sides a JOIN sides b ON right(a.s, 10) = left(b.s, 10) WHERE length(a.s) >= 10 AND length(b.s) >= 10),
f AS (SELECT *, CASE WHEN y = '-' THEN '+' ELSE '-' END AS my, CASE WHEN x = '-' THEN '+' ELSE '-' END AS mx FROM e)
SELECT DISTINCT CASE WHEN (a, x, b, y) <= (b, my, a, mx) THEN 'L' || chr(9) || a || chr(9) || x || chr(9) || b || chr(9) || y || chr(9) || '10M' ELSE 'L' || chr(9) || b || chr(9) || my || chr(9) || a || chr(9) || mx || chr(9) || '10M' END AS value FROM f""")
def gfa_links(spark, sf_dir):
    return sinks.gfa_lines(V.contigs(spark, sf_dir), 11).filter(F.col("value").startswith("L")).select("value")


@query(f"WITH {SEQS}, {CONTIGS} SELECT 'S' || chr(9) || id || chr(9) || sequence || chr(9) || 'LN:i:' || length(sequence) || chr(9) || 'cv:f:' || printf('%.1f', mean_coverage::DOUBLE) || chr(9) || 'RC:f:' || printf('%.1f', mean_coverage::DOUBLE) AS value FROM contigs")
def gfa_segments(spark, sf_dir):
    c = V.contigs(spark, sf_dir).withColumn("mean_coverage", F.col("mean_coverage").cast("double"))
    return sinks.gfa_lines(c, 11).filter(F.col("value").startswith("S")).select("value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
