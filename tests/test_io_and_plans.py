import gzip
import random

import pytest
from kmerloom.operators import audit, metrics
from kmerloom.operators import reads as R
from kmerloom.plans.assemble import AssemblerConfig, assemble, evaluate, polish_contigs, qc
from kmerloom.sources import fastx, sinks

CONTIG = "id long, sequence string, mean_coverage double, kmers_count long"


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_fastx_scan(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@read1 BX:Z:ACGT-1\nACGTACGT\n+\nIIIIIIII\n\n@read2\nTTTT\n+x\n!!!!\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">seq1\nACGT\nACGT\n>none\n>seq2\nnnA1\n")
    (tmp_path / "c.fq").write_text("")
    rows = fastx.scan(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fa.gz"), str(tmp_path / "c.fq")).orderBy("file", "ordinal").collect()
    assert [(r.id, r.seq, r.qual) for r in rows] == [("read1 BX:Z:ACGT-1", "ACGTACGT", "IIIIIIII"), ("read2", "TTTT", "!!!!"), ("seq1", "ACGTACGT", None), ("seq2", "nnA1", None)]
    kept = fastx.scan(spark, str(tmp_path / "b.fa.gz"), keep_empty=True, letters_only=True).orderBy("ordinal").collect()
    assert [r.seq for r in kept] == ["ACGTACGT", "", "NNA"]
    assert [r.barcode for r in fastx.scan_linked(spark, str(tmp_path / "a.fq")).orderBy("ordinal").collect()] == ["ACGT", None]
    assert [r.seq for r in fastx.scan_quality(spark, str(tmp_path / "a.fq"), min_length=5).collect()] == ["ACGTACGT"]


@pytest.mark.parametrize("text", ["@r\nACGT\nIIII\n+\n", "@r\nACGT\n+\nIII\n", "@r\nACGT\n", "hello\n"])
def test_bad_files(text, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text(text)
    with pytest.raises(fastx.FormatError):
        list(fastx.read_file(str(path)))
    if text.count("\n") == 2:
        assert list(fastx.read_file(str(path), {"mode": "lenient"})) == []


def test_pairing(spark):
    a, b = fastx.in_memory(spark, ["A", "C", "G"]), fastx.in_memory(spark, ["A", "C", "G"], ["T", "T"])
    assert a.filter("r2 IS NULL").count() == 3
    assert sorted((r.pair_id, r.r1, r.r2) for r in b.collect()) == [(0, "A", "T"), (1, "C", "T"), (2, "G", None)]
    i = fastx.in_memory(spark, ["A", "T", "C", "G", "GG"], interleaved=True)
    assert sorted((r.pair_id, r.r1, r.r2) for r in i.collect()) == [(0, "A", "T"), (1, "C", "G"), (2, "GG", None)]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([(0, "GGCTACGT", 15.5, 4), (1, "ACGTCCTA", 25.0, 4)], CONTIG)
    path = str(tmp_path / "out" / "c.fa")
    sinks.write_contigs(c, path)
    assert open(path).read() == ">contig_1_len_8_cov_15.5\nGGCTACGT\n>contig_2_len_8_cov_25.0\nACGTCCTA\n"
    sinks.write_polished(c, path)
    assert open(path).read().startswith(">NODE_1_length_8_cov_10.0\n")
    long_ = spark.createDataFrame([(0, "A" * 170, 1.0, 1)], CONTIG)
    assert [len(x) for x in sinks.fasta_records(long_).first().value.split("\n")[1:]] == [80, 80, 10]
    sinks.write_gfa(c, 5, path)
    lines = open(path).read().splitlines()
    assert lines[0].startswith("H\t")
    assert "L\t0\t+\t1\t+\t4M" in lines
    with pytest.raises(ValueError):
        sinks.gfa_lines(c, 1)
    reads = spark.createDataFrame([(0, "r", "AC", "II")], "ordinal long, id string, seq string, qual string")
    sinks.write_fastq(reads, str(tmp_path / "r.fq.gz"))
    assert gzip.open(tmp_path / "r.fq.gz", "rt").read() == "@r\nAC\n+\nII\n"
    with pytest.raises(ValueError):
        sinks.guard_paths([path], [path])


def test_nx_and_bins(spark):
    c = spark.createDataFrame([(i, "A" * n, 1.0, 1) for i, n in enumerate((500, 300, 200))], CONTIG)
    assert tuple(metrics.nx_lx(c, 0.5).first()) == (500, 1)
    assert tuple(metrics.nx_lx(c, 0.75).first()) == (300, 2)
    assert tuple(metrics.nx_lx(c.limit(0), 0.5).first()) == (0, 0)
    assert tuple(metrics.ng50(c, 5000).first()) == (0, 0)
    rng = random.Random(3)
    for _ in range(3):
        sizes = [rng.choice([5, 7, 9, 12]) for _ in range(rng.randint(1, 12))]
        d = spark.createDataFrame([(i, "A" * n, 1.0, 1) for i, n in enumerate(sizes)], CONTIG)
        for f in (0.5, 0.9):
            upto, target = 0, int(sum(sizes) * f + 0.5)
            for rank, n in enumerate(sorted(sizes, reverse=True), 1):
                upto += n
                if upto >= target:
                    break
            assert tuple(metrics.nx_lx(d, f).first()) == (n, rank)


def test_evaluate(spark):
    g = dna(600, 1)
    c = spark.createDataFrame([(0, g[:400], 1.0, 1), (1, rc(g[350:]), 1.0, 1)], CONTIG)
    row = evaluate(c, spark.createDataFrame([(g,)], "seq string")).first()
    assert row.n_contigs == 2
    assert row.genome_fraction == pytest.approx(100.0)
    assert row.mismatches_per_100k == 0
    assert row.n50 == 400


def test_intervals_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(80)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, chrom string, start long, end long")
    covered = {c: len({p for _, x, s, e in rows if x == c for p in range(s, e + 1)}) for c in "ab"}
    spans = audit.interval_union(df).collect()
    assert all(sum(min(e, r.end) - max(s, r.start) >= 0 for r in spans if r.chrom == x) == 1 for _, x, s, e in rows)
    touching = {c: sum(r.end - r.start + 1 for r in spans if r.chrom == c) for c in "ab"}
    assert touching == covered == {r.chrom: r.covered for r in audit.covered_bases(df).collect()}
    left, right = rows[:60], rows[60:]
    pairs = {(r.l_event_id, r.r_event_id) for r in audit.overlap_join(df.filter("event_id < 60"), df.filter("event_id >= 60"), width=32).collect()}
    assert pairs == {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}


def test_qc_report(spark):
    reads = spark.createDataFrame([(0, 1, "ACGTT" * 12, "I" * 60), (0, 2, "N" * 60, "I" * 60), (1, 1, "ACGTT" * 12, "I" * 60), (1, 2, "GATTC" * 12, "I" * 60)], "pair_id long, mate int, seq string, qual string")
    clean, report = qc(reads)
    r = report.first()
    assert (r.raw_n_reads, r.clean_n_reads, r.dropped_too_short) == (4, 3, 1)
    assert sorted((x.pair_id, x.route) for x in clean.collect()) == [(0, "singleton"), (1, "paired"), (1, "paired")]
    assert R.drop_reasons(clean).count() == 1


def test_assembly_of_a_genome(spark):
    g = dna(900, 42)
    pairs = [(i, g[s : s + 100], rc(g[s + 150 : s + 250])) for i, s in enumerate(range(0, 650, 5))]
    df = spark.createDataFrame(pairs, "pair_id long, r1 string, r2 string")
    result = assemble(df, AssemblerConfig(k=21, min_coverage=2.0, min_length=100))
    contigs = [r.sequence for r in result.contigs.collect()]
    assert len(contigs) == 1
    assert len(contigs[0]) >= 780  # the ends are thinly covered
    assert contigs[0] in g or contigs[0] in rc(g)
    assert result.stats().first().n_contigs == 1
    broken = spark.createDataFrame([(0, g[:300] + ("A" if g[300] != "A" else "C") + g[301:])], "id long, sequence string")
    votes = df.selectExpr("pair_id AS read_id", "r1 AS seq")
    assert polish_contigs(broken, votes, 21, min_support=2).first().sequence == g


def test_config():
    for bad in ({"k": 20}, {"multik": (21, 21)}, {"mode": "x"}):
        with pytest.raises(ValueError):
            AssemblerConfig(**bad)
