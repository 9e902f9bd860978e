import random
from collections import Counter

import pytest
from kmerloom.operators import graph, kmers, mapping, modes, resolve
from kmerloom.operators.polish import polish

CONTIG = "id long, sequence string, mean_coverage double, kmers_count long"


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def contigs(spark, *rows):
    return spark.createDataFrame([(i, s, float(c), max(len(s) - 4, 1)) for i, (s, c) in enumerate(rows)], CONTIG)


def seqs(df):
    return sorted(min(r.sequence, rc(r.sequence)) for r in df.collect())


def same(found, *expected):
    return found == sorted(min(e, rc(e)) for e in expected)


def random_dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def brute_counts(reads, k):
    out = Counter()
    for r in reads:
        for i in range(len(r) - k + 1):
            w = r[i : i + k].upper()
            if not set(w) - set("ACGT"):
                out[min(w, rc(w))] += 1
    return out


def brute_unitigs(counts, k):
    nodes = set(counts) | {rc(x) for x in counts}
    step = lambda x: [x[1:] + b for b in "ACGT" if x[1:] + b in nodes]
    back = lambda x: [b + x[:-1] for b in "ACGT" if b + x[:-1] in nodes]
    after = {x: y[0] for x in nodes if len(y := step(x)) == 1 and len(back(y[0])) == 1 and y[0] not in (x, rc(x))}
    before = {y: x for x, y in after.items()}
    out, seen = set(), set()
    for start in sorted(nodes, key=lambda x: (x in before, min(x, rc(x)), x)):
        if start in seen or (start in before and rc(start) in seen):
            continue
        path, here = [start], start
        seen.add(start)
        while here in after and after[here] not in seen:
            here = after[here]
            seen.add(here)
            path.append(here)
        s = path[0] + "".join(p[-1] for p in path[1:])
        out.add(min(s, rc(s)))
    return out


def test_packed_counts_equal_string_counts(spark):
    rng = random.Random(2)
    reads = ["".join(rng.choice("ACGTNacgt") for _ in range(rng.randrange(0, 90))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(r,) for r in reads], "seq string")
    for k in (1, 2, 5, 12, 31):
        want = brute_counts([r or "" for r in reads], k)
        as_code = {int(x.translate(str.maketrans("ACGT", "0123")), 4): n for x, n in want.items()}
        assert {r.kmer: r.cnt for r in kmers.count_packed(df, k).collect()} == as_code
        assert {r.kmer: r.cnt for r in kmers.count_kmers(df, k).collect()} == want


def test_list_rank_with_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("y", "x"), ("x", "z"), ("z", "y"), ("p", "q"), ("q", "p")]
    nodes = spark.createDataFrame([(x,) for x in "abcdexyzpq"], "node string")
    got = {r.node: (r.head, r.rank) for r in graph.list_rank(nodes, spark.createDataFrame(links, "prev string, node string")).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "e": ("e", 0), "x": ("x", 0), "z": ("x", 1), "y": ("x", 2), "p": ("p", 0), "q": ("p", 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_unitigs_equal_brute_force(spark, seed):
    k, genome = 7, random_dna(260, seed)
    reads = [genome, rc(genome[40:180]), random_dna(60, seed + 10)]
    counts = kmers.count_kmers(spark.createDataFrame([(r,) for r in reads], "seq string"), k)
    got = seqs(graph.unitigs(counts, k))
    assert got == sorted(brute_unitigs(brute_counts(reads, k), k))


def test_isolated_cycle(spark):
    circle = random_dna(80, 9)
    k = 11
    reads = [circle + circle[: k - 1]]
    out = graph.unitigs(kmers.count_kmers(spark.createDataFrame([(r,) for r in reads], "seq string"), k), k).collect()
    assert len(out) == 1
    assert len(out[0].sequence) == 80 + k - 1


def test_clean_up_goldens(spark):
    c = spark.createDataFrame([(0, "A" * 30, 4.0, 10), (1, "A" * 100, 4.0, 80), (2, "A" * 30, 25.0, 10), (3, "A" * 30, 1.0, 10)], CONTIG)
    assert [r.id for r in graph.clip_tips(c, 21, 10.0).orderBy("id").collect()] == [1, 2]
    b = contigs(spark, ("ACGTAAAATGCA", 50), ("ACGTTTTATGCA", 2), ("GGGGCCCCAAAA", 20))
    assert [r.id for r in graph.pop_bubbles(b, 5).orderBy("id").collect()] == [0, 2]
    s = contigs(spark, ("TTTAACGT", 10), ("ACGTCCAT", 10), ("CCATGAAA", 10))
    assert same(seqs(graph.stitch(s, 5)), "TTTAACGTCCATGAAA")


def test_correction_goldens(spark):
    for k, truth, broken in ((5, "ACGTACGTACGT", "ACGGACGTACGT"), (15, "GATTACATAGGATACAGGATACCAGATTAGACATAGACAG", None)):
        if broken is None:
            broken = truth[:20] + ("T" if truth[20] == "A" else "A") + truth[21:]
        solid = kmers.count_kmers(spark.createDataFrame([(truth,)], "seq string"), k)
        reads = spark.createDataFrame([(1, broken)], "id long, seq string")
        for limit in (10**6, 0):
            row = kmers.correct_reads(reads, solid, k, broadcast_kmers=limit).first()
            assert (row.seq, row.changed) == (truth, 1)


def test_paired_resolution_golden(spark):
    c = contigs(spark, ("TTTTACGT", 20), ("ACGTAAAACGCG", 20), ("ACGTTTTATTTA", 20))
    links = spark.createDataFrame([(0, 1, 10), (0, 2, 1)], "src long, dst long, support long")
    out = resolve.resolve_repeats(c, links, 5)
    got = [r.sequence for r in out.collect()]
    assert len(got) == 2
    assert "TTTTACGTAAAACGCG" in got


def test_gap_goldens():
    assert resolve.close_gap("ACGTACGTACGT", "ACGTGGGGGG", [], 5) == "ACGTACGTACGTGGGGGG"
    read = "ACGTACGTAGAATTGCATGCATG"
    assert resolve.close_gap("ACGTACGTAG", "TGCATGCATG", [read, read], 5) == read
    assert resolve.close_gap("ACGTACGTAG", "TGCATGCATG", [read], 5) is None


def test_scaffold_goldens(spark):
    c = contigs(spark, ("ACGTACGT", 20), ("TGCATGCA", 20))
    links = spark.createDataFrame([(0, 1, 3), (1, 0, 3)], "src long, dst long, support long")
    assert [r.sequence for r in resolve.build_scaffolds(c, links, gap=5).collect()] == ["ACGTACGTNNNNNTGCATGCA"]
    assert resolve.scaffold_order([0, 1, 2], [(0, 1, 10), (0, 2, 9), (1, 0, 10), (2, 0, 9)]) == [[0], [1], [2]]
    assert resolve.scaffold_order([0, 1, 2], [(0, 1, 10), (0, 2, 8), (1, 0, 10), (2, 0, 8)]) == [[0, 1], [2]]
    assert resolve.scaffold_order([0, 1], [(0, 1, 2), (1, 0, 2)]) == [[0], [1]]
    two = spark.createDataFrame([(0, 1, 2)], "u long, v long, support long")
    assert [r.sequence for r in resolve.linked_scaffolds(c, two).collect()] == ["ACGTACGT" + "N" * 100 + "TGCATGCA"]


def test_long_read_golden(spark):
    c = contigs(spark, ("GGCTACGT", 20), ("ACGTCCTA", 20))
    reads = spark.createDataFrame([(i, "GGCTACGTCCTA") for i in range(3)], "read_id long, seq string")
    assert same(seqs(resolve.bridge_long_reads(c, reads, 5)), "GGCTACGTCCTA")


def test_long_reads_cross_a_repeat_twice(spark):
    a, b, c, d = (random_dna(1600, s) for s in (111, 222, 333, 444))
    r = random_dna(2000, 999)
    k = 21
    rows = [(a + r[: k - 1], 20), (r[-(k - 1) :] + b, 20), (c + r[: k - 1], 20), (r[-(k - 1) :] + d, 20), (r, 40)]
    reads = [a + r + b] * 4 + [rc(c + r + d)] * 4
    out = [x.sequence for x in resolve.bridge_long_reads(contigs(spark, *rows), spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"), k).collect()]
    assert any(a + r + b in x or rc(a + r + b) in x for x in out)
    assert any(c + r + d in x or rc(c + r + d) in x for x in out)


def test_polish_golden(spark):
    c = contigs(spark, ("ACGTTA", 10))
    reads = spark.createDataFrame([(i, "ACGTCA") for i in range(3)], "read_id long, seq string")
    assert polish(c, reads, 3, min_support=1).first().sequence == "ACGTCA"


def test_insert_size(spark):
    genome = random_dna(15_000, 4)
    reads = [(2 * i + m, i, m + 1, genome[500 * i + 5000 * m : 500 * i + 5000 * m + 100]) for i in range(10) for m in (0, 1)]
    df = spark.createDataFrame(reads, "read_id long, pair_id long, mate int, seq string")
    c = contigs(spark, (genome, 20))
    at = mapping.map_reads(df, mapping.unique_anchors(c, 31), 31)
    mean, _ = mapping.insert_size(mapping.mate_pairs(at, df))
    assert 4500 < mean < 5500
    assert mapping.insert_size(mapping.mate_pairs(at.limit(0), df)) == (300.0, 50.0)


def test_modes(spark):
    c = spark.createDataFrame([(0, "A" * 1000, 1.5, 1), (1, "C" * 1000, 3.0, 1), (2, "G" * 100, 10.0, 1)], CONTIG)
    assert [r.id for r in modes.meta_filter(c, 500).collect()] == [1]
    n = spark.createDataFrame([(0, "A", 1000.0, 1), (1, "C", 2.0, 1), (2, "G", 10.0, 1)], CONTIG)
    assert {r.id: r.mean_coverage for r in modes.single_cell_normalize(n, 5.0).collect()} == {0: 500.0, 2: 10.0}
    d = contigs(spark, ("ACGTAAAATGCA", 32), ("ACGTTTTATGCA", 28), ("GGGGCCCCAAAA", 30))
    assert {r.id: r.haplotig for r in modes.phase_haplotigs(d, 5).collect()} == {0: False, 1: True, 2: False}
    e = contigs(spark, ("ACGTAAAATGCA", 100), ("ACGTTTTATGCA", 10))
    assert not any(r.haplotig for r in modes.phase_haplotigs(e, 5).collect())
    ring = random_dna(400, 3)
    p = contigs(spark, (ring + ring[:20], 10), (random_dna(1000, 5), 10), (random_dna(500, 6), 30), (random_dna(900, 7), 10))
    assert {r.id: r.plasmid for r in modes.plasmid_split(p, 21).collect()} == {0: True, 1: False, 2: True, 3: False}
