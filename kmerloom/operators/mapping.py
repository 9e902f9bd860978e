"""Anchor indexes, read mapping, links and insert sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .graph import cut, upper_median
from .packed import kmer_codes


def unique_anchors(contigs: DataFrame, k: int, per_contig: bool = False, key: str = "id", seq: str = "sequence") -> DataFrame:
    """(canon, contig, pos, flipped): packed k-mers that name a place.

    Strict: those that come once over all places.  ``per_contig``: those of one contig only,
    where repeats within it are allowed and the first place counts.
    """
    rows = kmer_codes(contigs, k, [key], seq).select("canon", F.col(key).alias("contig"), "pos", "flipped")
    first = F.min(F.struct("contig", "pos", "flipped")).alias("p")
    if per_contig:
        found = rows.groupBy("canon").agg(first, F.max("contig").alias("_hi")).filter(F.col("p.contig") == F.col("_hi"))
    else:
        found = rows.groupBy("canon").agg(first, F.count("*").alias("_n")).filter("_n = 1")
    return found.select("canon", "p.contig", "p.pos", "p.flipped")


def polisher_anchors(contigs: DataFrame, k: int) -> DataFrame:
    """Strict anchors from k = 11 on; of shorter ones those of one contig with their first place."""
    return unique_anchors(contigs, k, per_contig=k < 11)


def probes(reads: DataFrame, k: int, keep: list[str], seq: str = "seq", step: int | None = None) -> DataFrame:
    """(keep, pos, canon, flipped): windows that are looked up for each read.

    Every ``step``-th window only; without a step, an eighth of the windows (every 1st to
    8th) and the last one.
    """
    return kmer_codes(reads, k, keep, seq, probe=(step or 0, step is None))


def map_reads(reads: DataFrame, anchors: DataFrame, k: int, key: str = "read_id", seq: str = "seq", step: int | None = None) -> DataFrame:
    """(key, contig, contig_pos, read_pos, same_strand): the first probe that meets an anchor."""
    places = anchors.select("canon", "contig", F.col("pos").alias("contig_pos"), F.col("flipped").alias("_turned"))
    hits = probes(reads, k, [key], seq, step).join(places, "canon")
    first = F.min(F.struct(F.col("pos").alias("read_pos"), "contig", "contig_pos", (F.col("flipped") == F.col("_turned")).alias("same_strand"))).alias("p")
    return hits.groupBy(key).agg(first).select(key, "p.contig", "p.contig_pos", "p.read_pos", "p.same_strand")


def mate_pairs(mapped: DataFrame, reads: DataFrame) -> DataFrame:
    """(pair_id, c1, p1, c2, p2, span): pairs of which both mates are mapped; span with the second mate's length.

    ``reads(read_id, pair_id, mate, seq)``.
    """
    placed = mapped.join(reads.select("read_id", "pair_id", "mate", F.length("seq").alias("len")), "read_id")
    one = placed.filter("mate = 1").select("pair_id", F.col("contig").alias("c1"), F.col("contig_pos").alias("p1"))
    two = placed.filter("mate = 2").select("pair_id", F.col("contig").alias("c2"), F.col("contig_pos").alias("p2"), "len")
    return one.join(two, "pair_id").withColumn("span", F.abs(F.col("p1") - F.col("p2")) + F.col("len")).drop("len")


def paired_links(pairs: DataFrame) -> DataFrame:
    """(src, dst, support): pairs between contigs, in both directions."""
    across = pairs.filter("c1 != c2")
    there = across.select(F.col("c1").alias("src"), F.col("c2").alias("dst"))
    back = across.select(F.col("c2").alias("src"), F.col("c1").alias("dst"))
    return there.unionByName(back).groupBy("src", "dst").agg(F.count("*").alias("support"))


def insert_size(pairs: DataFrame) -> tuple[float, float]:
    """Mean and population deviation of the spans within a contig, without outliers.

    Spans lie in 1 .. 30000 with mates apart; kept are those between a fifth of the median
    (50 at least) and three times it.  (300, 50) without any, (median, 50) if none is kept.
    """
    spans = pairs.filter("c1 = c2 AND p1 != p2 AND span <= 30000").select(F.col("span").cast("double").alias("span"))
    median = upper_median(spans, "span")
    if median is None:
        return 300.0, 50.0
    kept = spans.filter(F.col("span").between(max(0.2 * median, 50.0), min(3 * median, 30000.0)))
    mean, deviation = kept.agg(F.avg("span"), F.stddev_pop("span")).first()
    return (median, 50.0) if mean is None else (mean, deviation)


def barcode_links(mapped: DataFrame, least_reads: int = 2, most_contigs: int = 20, least_shared: int = 3) -> DataFrame:
    """(u, v, support): contig pairs that share barcodes.

    ``mapped(barcode, contig)``: a row for each read.  Barcodes with ``least_reads`` reads
    and 2 to ``most_contigs`` contigs count; pairs need ``least_shared`` of them.
    """
    known = mapped.filter("barcode IS NOT NULL").groupBy("barcode", "contig").agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("barcode")
    kept = known.withColumn("reads", F.sum("n").over(w)).withColumn("contigs", F.count("*").over(w))
    kept = kept.filter((F.col("reads") >= least_reads) & F.col("contigs").between(2, most_contigs)).select("barcode", "contig")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(b, (F.col("a.barcode") == F.col("b.barcode")) & (F.col("a.contig") < F.col("b.contig")))
    return pairs.groupBy(F.col("a.contig").alias("u"), F.col("b.contig").alias("v")).agg(F.count("*").alias("support")).filter(F.col("support") >= least_shared)


def best_two(links: DataFrame) -> DataFrame:
    """(src, best, best_support, second_support): the strongest link of each source; ties go to the smaller target."""
    w = W.Window.partitionBy("src").orderBy(F.desc("support"), "dst")
    ranked = links.withColumn("n", F.row_number().over(w))
    return ranked.groupBy("src").agg(
        F.max(F.when(F.col("n") == 1, F.col("dst"))).alias("best"), F.max(F.when(F.col("n") == 1, F.col("support"))).alias("best_support"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("support"))), F.lit(0)).alias("second_support")
    )


def seed_anchors(reads: DataFrame, contigs: DataFrame, k: int, gap: int = 1500, key: str = "read_id") -> DataFrame:
    """(key, contig, rc, start, end, hits): where long reads touch contigs.

    Seeds of clamp(k, 4, 15) bases are taken from reads every few bases.  With over 10
    contigs, seeds at more than 5 places are dropped.  Hits on one contig and strand form
    one anchor until the next is more than ``gap`` bases on; anchors that are too short or
    have too few hits go.
    """
    n_contigs = contigs.count()
    seed = min(max(k, 4), 15)
    step = min(5, max(seed // 3, 1))
    places = kmer_codes(contigs, seed, ["id"], "sequence").select("canon", F.col("id").alias("contig"), "flipped").groupBy("canon").agg(F.collect_set(F.struct("contig", "flipped")).alias("at"), F.count("*").alias("n"))
    if n_contigs > 10:
        places = places.filter("n <= 5")
    places = places.select("canon", F.explode("at").alias("a")).select("canon", "a.contig", F.col("a.flipped").alias("_turned"))
    least_len = max(500, 2 * seed) if n_contigs > 3 else 2 * seed
    own = kmer_codes(reads.filter(F.length("seq") >= least_len), seed, [key], "seq", every=step)
    hits = own.join(places, "canon").select(key, "contig", (F.col("flipped") != F.col("_turned")).alias("rc"), "pos").distinct()
    w = W.Window.partitionBy(key, "contig", "rc").orderBy("pos")
    marked = hits.withColumn("_new", F.coalesce((F.col("pos") - F.lag("pos").over(w) > gap).cast("int"), F.lit(1)))
    grouped = marked.withColumn("_g", F.sum("_new").over(w)).groupBy(key, "contig", "rc", "_g")
    return grouped.agg(F.min("pos").alias("start"), (F.max("pos") + seed).alias("end"), F.count("*").alias("hits")).drop("_g")


__all__ = ["barcode_links", "best_two", "cut", "insert_size", "map_reads", "mate_pairs", "paired_links", "polisher_anchors", "probes", "seed_anchors", "unique_anchors"]
