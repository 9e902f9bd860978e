"""Assemblies of small genomes in every mode and with every library, from pairs to results."""

import random

import pytest
from kmerloom.plans.assemble import AssemblerConfig, assemble


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def reads(genome, step=4, size=80, insert=200, start=0):
    return [(start + i, genome[a : a + size], rc(genome[a + insert - size : a + insert])) for i, a in enumerate(range(0, len(genome) - insert + 1, step))]


def pairs(spark, *rows):
    flat = [r for part in rows for r in part]
    return spark.createDataFrame([(i, a, b) for i, (_, a, b) in enumerate(flat)], "pair_id long, r1 string, r2 string")


def seqs(df):
    return sorted((r.sequence for r in df.collect()), key=lambda s: (-len(s), s))


def within(found, genome):
    return all(s in genome or rc(s) in genome for s in found)


CONFIG = {"k": 21, "min_coverage": 2.0, "min_length": 100}


def test_several_k_and_rescue(spark):
    well, thin = dna(700, 1), dna(500, 2)
    # windows of 31 come once where those of 21 come twice, so only the first step sees the second genome
    few = [(i, thin[a : a + 40], None) for i, a in enumerate(range(0, 461, 12))]
    result = assemble(pairs(spark, reads(well), few), AssemblerConfig(multik=(21, 31), min_coverage=2.0, min_length=100))
    found = seqs(result.contigs)
    assert within(found, well + "#" + thin)
    assert sum(len(s) for s in found if s in well or rc(s) in well) >= 600
    assert result.k == 31
    assert [r.id for r in result.contigs.orderBy("id").collect()] == list(range(len(found)))
    with pytest.raises(ValueError):
        AssemblerConfig(multik=(31, 21))


def test_meta_keeps_what_is_covered(spark):
    a, b = dna(600, 3), dna(600, 4)
    result = assemble(pairs(spark, reads(a, 2), reads(b, 9)), AssemblerConfig(**CONFIG | {"min_length": 300}, mode="meta"))
    assert all(r.mean_coverage >= 2 and len(r.sequence) >= 300 for r in result.contigs.collect())
    assert within(seqs(result.contigs), a + "#" + b)


def test_single_cells_cap_their_coverage(spark):
    g = dna(500, 5)
    result = assemble(pairs(spark, reads(g, 3)), AssemblerConfig(**CONFIG, mode="sc"))
    assert within(seqs(result.contigs), g)
    assert all(r.mean_coverage <= 500 for r in result.contigs.collect())


def test_rna_keeps_transcripts(spark):
    shared, a, b = dna(220, 6), dna(220, 7), dna(220, 8)
    result = assemble(pairs(spark, reads(a + shared, 3), reads(b + shared, 3)), AssemblerConfig(**CONFIG, mode="rna"))
    found = seqs(result.contigs)
    assert found
    assert all(len(s) >= 200 for s in found)
    assert within(found, a + shared + "#" + b + shared)


def test_plasmids_are_split_off(spark):
    chromosome, ring = dna(900, 9), dna(400, 10)
    result = assemble(pairs(spark, reads(chromosome, 6), reads(ring + ring[:300], 2)), AssemblerConfig(**CONFIG, mode="plasmid"))
    plasmids = seqs(result.plasmids)
    assert plasmids
    assert all(s in ring * 3 or rc(s) in ring * 3 for s in plasmids)
    assert all(s in chromosome or rc(s) in chromosome for s in seqs(result.contigs))


def test_diploid_takes_one_allele_as_haplotig(spark):
    left, right, x = dna(300, 11), dna(300, 12), dna(60, 13)
    y = x[:30] + ("A" if x[30] != "A" else "C") + x[31:]
    result = assemble(pairs(spark, reads(left + x + right, 3), reads(left + y + right, 4)), AssemblerConfig(**CONFIG, mode="diploid"))
    both = seqs(result.contigs) + seqs(result.haplotigs)
    assert within(both, "#".join((left + x + right, left + y + right)))


def test_long_reads_join_what_is_not_covered(spark):
    g = dna(2600, 14)
    short = reads(g[:1200], 4) + reads(g[1300:], 4)
    alone = assemble(pairs(spark, short), AssemblerConfig(**CONFIG))
    assert len(seqs(alone.contigs)) == 2
    long_ = spark.createDataFrame([(i, g[i : 2500 + i]) for i in range(6)], "read_id long, seq string")
    result = assemble(pairs(spark, short), AssemblerConfig(**CONFIG, polish=False), long_reads=long_)
    found = seqs(result.contigs)
    assert len(found) == 1
    assert "N" in found[0]
    assert within(found[0].replace("N", " ").split(), g)


def test_linked_reads_and_mate_pairs_order_contigs(spark):
    a, b = dna(700, 15), dna(700, 16)
    short = pairs(spark, reads(a), reads(b))
    linked = spark.createDataFrame([(10 * c + i, f"BC{c}", (a if i < 2 else b)[100 + 40 * c + 60 * (i % 2) : 180 + 40 * c + 60 * (i % 2)]) for c in range(6) for i in range(4)], "read_id long, barcode string, seq string")
    joined = assemble(short, AssemblerConfig(**CONFIG, polish=False), linked_reads=linked)
    assert any("N" * 100 in s for s in seqs(joined.contigs))
    far = spark.createDataFrame([(i, a[300 + 10 * i : 380 + 10 * i], rc(b[100 + 10 * i : 180 + 10 * i])) for i in range(12)], "pair_id long, r1 string, r2 string")
    mated = assemble(short, AssemblerConfig(**CONFIG, polish=False), mate_pairs=far)
    assert len(seqs(mated.contigs)) == 2
    assert any("N" * 50 in s for s in seqs(mated.scaffolds))


def test_careful_corrects_reads_and_trusts_contigs(spark):
    g = dna(500, 17)
    rows = [(i, a[:40] + ("A" if a[40] != "A" else "C") + a[41:] if i % 7 == 0 else a, b) for i, a, b in reads(g, 3)]
    trusted = spark.createDataFrame([(0, g[:200])], "id long, sequence string")
    result = assemble(pairs(spark, rows), AssemblerConfig(**CONFIG, careful=True), trusted=trusted)
    found = seqs(result.contigs)
    assert within(found, g)
    assert len(found[0]) >= 440
