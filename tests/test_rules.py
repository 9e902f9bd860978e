"""Rules of single operators against plain Python: rescue, polishing ends, reports, barcodes, writers."""

import json
import random

from kmerloom.functions import seq as S
from kmerloom.operators import audit, polish, resolve
from kmerloom.operators import reads as R
from kmerloom.plans.assemble import evaluate, polish_contigs, qc
from kmerloom.sources import fastx, sinks
from pyspark.sql import functions as F

CONTIG = "id long, sequence string, mean_coverage double, kmers_count long"


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def canon(s, k):
    return [min(s[i : i + k], rc(s[i : i + k])) for i in range(len(s) - k + 1)]


def test_rescue_equals_the_pass_in_order(spark):
    rng = random.Random(1)
    pool = [dna(800, 20 + i) for i in range(4)]
    final = [pool[0]]
    rows = []
    for i in range(25):
        src = rng.choice(pool)
        at = rng.randrange(300)
        rows.append((i, src[at : at + rng.randint(280, 450)], rng.choice([1.0, 5.0, 9.0]), 1))
    known, want = set(canon(final[0], 21)), []
    for i, s, c, _ in reversed(rows):
        if len(s) >= 300 and c >= 5:
            own = canon(s, 21)
            if 2 * sum(x not in known for x in own) >= len(own):
                known.update(own)
                want.append(i)
    out = resolve.rescue(spark.createDataFrame([(f,) for f in final], "sequence string"), spark.createDataFrame(rows, CONTIG), 21, 5.0)
    assert sorted(r.id for r in out.collect()) == sorted(want)
    assert 0 < len(want) < 20


def test_votes_stay_inside_and_windows_are_probed_by_steps(spark):
    g = dna(120, 3)
    c = spark.createDataFrame([(0, g, 1.0, 1)], CONTIG)
    over = spark.createDataFrame([(1, g[90:] + "ACGTACGTAC"), (2, "TTTT" + g[:40]), (3, rc(g[80:] + "GG"))], "read_id long, seq string")
    votes = polish.pileup(polish.lay_reads(over, c, 21))
    assert {r.pos for r in votes.collect()} <= set(range(120))
    assert votes.agg(F.sum(F.col("a") + F.col("c") + F.col("g") + F.col("t"))).first()[0] == 30 + 40 + 40
    # 30 bases: windows at 0 only (the step is 11, the last one at 9 is not looked up)
    late = spark.createDataFrame([(1, "T" * 9 + g[50:71])], "read_id long, seq string")
    assert polish.pileup(polish.lay_reads(late, c, 21)).count() == 0


def test_careful_polishing_takes_the_larger_support_and_changes_all_but_n(spark):
    g = dna(60, 4)
    broken = g[:20] + "R" + g[21:30] + "N" + g[31:]
    c = spark.createDataFrame([(0, g, 1.0, 1)], CONTIG)
    reads = spark.createDataFrame([(i, g) for i in range(10)], "read_id long, seq string")
    votes = polish.pileup(polish.lay_reads(reads, c, 21))
    fixed = lambda **o: polish.consensus(spark.createDataFrame([(0, broken, 1.0, 1)], CONTIG), votes, **o).first()
    assert (fixed().sequence, fixed().changed) == (g[:30] + "N" + g[31:], 1)
    assert fixed(careful=True, min_support=12).changed == 0
    assert fixed(careful=True, min_support=3).changed == 1
    wrong = g[:40] + ("A" if g[40] != "A" else "C") + g[41:]
    one = spark.createDataFrame([(0, wrong)], "id long, sequence string")
    assert polish_contigs(one, reads, 21, min_support=12, careful=True).first().changed == 0
    assert polish_contigs(one, reads, 21, min_support=10, careful=True).first().sequence == g


def test_one_decimal_rounds_the_exact_value(spark):
    values = [0.05, 0.25, 0.35, 2.25, 2.35, 10.0, 0.0, 123.45]
    df = spark.createDataFrame([(i, "ACGT", v, 1) for i, v in enumerate(values)], CONTIG)
    heads = [r.value.split("\n")[0].split("_cov_")[1] for r in sinks.fasta_records(df).orderBy("ordinal").collect()]
    assert heads == ["0.1", "0.2", "0.3", "2.2", "2.4", "10.0", "0.0", "123.5"]
    lines = {r.value.split("\t")[1]: r.value.split("\t")[4:] for r in sinks.gfa_lines(df, 3).filter("value LIKE 'S%'").collect()}
    assert lines["3"] == ["cv:f:2.2", "RC:f:2.2"]


def test_scaffold_records_and_trusted_contigs(spark, tmp_path):
    c = spark.createDataFrame([(5, "ACGT" * 30, 2.25, 1), (2, "GG", 1.0, 1)], CONTIG)
    sinks.write_scaffolds(c, str(tmp_path / "s.fa"))
    assert open(tmp_path / "s.fa").read().split("\n")[0:3] == [">scaffold_1_len_2_cov_1.0", "GG", ">scaffold_2_len_120_cov_2.2"]
    assert sorted(r.sequence for r in fastx.scan_trusted(spark, str(tmp_path / "s.fa")).collect()) == ["ACGT" * 30, "GG"]


def test_evaluation_report(spark):
    g = dna(1300, 5)
    c = spark.createDataFrame([(0, g[:700], 1.0, 1), (1, g[700:1250] + "N" * 20, 1.0, 1), (2, g[:50], 1.0, 1)], CONTIG)
    found = json.loads(sinks.evaluation_json(evaluate(c, spark.createDataFrame([(g,)], "seq string")), "c.fa", "r.fa"))
    assert found["metrics"]["total_contigs"] == 2
    assert found["metrics"]["max_contig_length"] == 700
    assert found["metrics"]["total_ns"] == 20
    assert found["length_bins"][0] == {"min_length": 500, "contigs": 2, "total_bp": 1270}
    assert [b["min_length"] for b in found["length_bins"]] == [500, 1000, 5000, 10000, 50000]
    assert found["reference"]["length"] == 1300
    assert (found["reference"]["ng50"], found["reference"]["lg50"]) == (700, 1)
    assert "reference" not in json.loads(sinks.evaluation_json(evaluate(c), "c.fa"))


def test_qc_report_counts_mates_that_go_too(spark):
    good, bad = ("ACGTT" * 12, "I" * 60), ("N" * 60, "I" * 60)
    rows = [(0, 1, *good), (0, 2, *bad), (1, 1, *good), (1, 2, *good), (2, 1, *bad), (2, 2, *bad)]
    reads = spark.createDataFrame(rows, "pair_id long, mate int, seq string, qual string")
    kept, report = qc(reads)
    assert (kept.count(), report.first().dropped_too_short) == (3, 3)
    alone, report = qc(reads, keep_singletons=False)
    assert (alone.count(), report.first().dropped_too_short) == (2, 4)
    found = json.loads(sinks.qc_json(report))
    assert found["trimming"]["dropped_too_short"] == 4
    assert found["clean"]["survival_rate_pct"] == 33.33
    assert found["detected_phred"] == "Phred+33"


def fnv(s):
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


def test_barcodes_as_numbers(spark):
    codes = ["ACGT", "acgt", "T" * 32, "T" * 31, "A" * 33, "hello", "é-x", "A", "", None, "ACGN"]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, b string")
    got = {r.id: r.n for r in df.select("id", S.barcode_number("b").alias("n")).collect()}
    for i, b in enumerate(codes):
        if not b:
            want = None
        elif len(b) <= 32 and not set(b.upper()) - set("ACGT"):
            want = sum("ACGT".index(x) << (2 * (len(b) - 1 - j)) for j, x in enumerate(b.upper()))
        else:
            want = fnv(b)
        assert got[i] == (want if want is None or want < 2**63 else want - 2**64), b


def test_adapters_equal_a_plain_search(spark):
    rng = random.Random(6)
    adapters, least = ["ACGTTGCAGTACCA", "CATGACGT", "AC"], 4

    def cut(read):
        read, places = read.upper(), []
        for a in (x for x in adapters if len(x) >= least):
            differ = lambda at, n: sum(read[at + i] != a[i] for i in range(n))  # noqa: B023, E731
            tail = [at for at in range(max(len(read) - len(a), 0), len(read) - least + 1) if differ(at, len(read) - at) <= max((len(read) - at) // 10, int(len(read) - at >= 12))]
            whole = [at for at in range(len(read) - len(a) + 1) if differ(at, len(a)) <= max(len(a) // 10, 1)]
            places += tail[:1] + whole[:1]
        return min(places, default=None)

    reads = [None, "", "ACG"]
    for _ in range(300):
        r = "".join(rng.choice("ACGTn") for _ in range(rng.randrange(40)))
        a = rng.choice(adapters)
        a = a[: rng.randint(1, len(a))] if rng.random() < 0.6 else a
        reads.append(r + a + ("" if rng.random() < 0.6 else r[:9]))
    df = spark.createDataFrame(list(enumerate(reads)), "id long, seq string")
    got = {r.id: r.at for r in df.select("id", S.adapter_start("seq", adapters, least).alias("at")).collect()}
    assert got == {i: cut(r or "") for i, r in enumerate(reads)}


def test_unpaired_files_come_after_the_pairs(spark):
    two = fastx.in_memory(spark, ["A", "C"], ["G", "T"])
    more = fastx.append_unpaired(two, spark.createDataFrame([(0, "AA"), (1, "CC")], "ordinal long, seq string"))
    assert sorted((r.pair_id, r.r1, r.r2) for r in more.collect()) == [(0, "A", "G"), (1, "C", "T"), (2, "AA", None), (3, "CC", None)]
    assert R.first_reads(spark.createDataFrame([(i,) for i in range(9)], "ordinal long"), 4).count() == 4


def test_annotation_tables(spark, tmp_path):
    (tmp_path / "g.gff").write_text("# head\nchr1\tx\tgene\t5\t90\t.\t+\t.\tID=g1;Name=abc;\nchr1\tx\tCDS\t5\t90\t.\t+\t0\tID=c1\n")
    r = fastx.scan_gff(spark, str(tmp_path / "g.gff")).collect()
    assert [(x.chrom, x.start, x.end, x.attributes["Name"]) for x in r] == [("chr1", 5, 90, "abc")]
    (tmp_path / "a.tsv").write_text("S1\tE1\tS2\tE2\tref\tcontig\tidy\n100\t10\t1\t91\tchr1\tc1\t99.5\nCONTIG\tc1\t91\tcorrect\n")
    r = fastx.scan_alignments(spark, str(tmp_path / "a.tsv")).collect()
    assert [(x.start, x.end, x.chrom, x.contig, x.identity) for x in r] == [(10, 100, "chr1", "c1", 99.5)]


def test_spans_need_their_flanks(spark):
    genes = spark.createDataFrame([(1, "a", 100, 199), (2, "a", 500, 599)], "gene long, chrom string, start long, end long")
    al = spark.createDataFrame([("c1", "a", 70, 229), ("c2", "a", 480, 700)], "contig string, chrom string, start long, end long")
    got = {r.gene: (r.spanned, r.percent) for r in audit.gene_span(genes, al, "gene").collect()}
    assert got == {1: (True, 100.0), 2: (False, 100.0)}
    cen = {r.gene: (r.status, r.left_flank, r.right_flank, r.contig) for r in audit.centromere_synteny(genes, al, "gene", flank=30).collect()}
    assert cen == {1: ("INTACT", 30, 30, "c1"), 2: ("MARGINAL", 20, 101, "c2")}
