import random

import pytest
from kmerloom.functions import seq as S
from kmerloom.operators import reads as R
from kmerloom.plans.assemble import validate_k
from pyspark.sql import functions as F


def value(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.select(expr.alias("x")).first().x


def py_rc(s):
    return s.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_reverse_complement(spark):
    for s, e in (("ACGT", "ACGT"), ("AAAA", "TTTT"), ("ACGT" * 16 + "A", "T" + "ACGT" * 16), ("acgtn", "NACGT")):
        assert value(spark, S.revcomp("s"), s=s) == e


def test_kmer_functions(spark):
    rng = random.Random(1)
    for k in (1, 5, 21, 31):
        s = "".join(rng.choice("ACGT") for _ in range(k))
        code = int(s.translate(str.maketrans("ACGT", "0123")), 4)
        assert value(spark, S.encode_kmer("s"), s=s) == code
        assert value(spark, S.decode_kmer("c", k), c=code) == s
        assert value(spark, S.canonical("s"), s=s) == min(s, py_rc(s))
        assert value(spark, S.is_flipped("s"), s=s) == (py_rc(s) < s)
        assert value(spark, S.extend_right("s", F.lit("C")), s=s) == s[1:] + "C"
        assert value(spark, S.prepend_left("s", F.lit("G")), s=s) == "G" + s[:-1]
    assert value(spark, S.encode_kmer("s"), s="ACGN") is None
    a, b = "ACGTACGTACGTACGT", "ACCTACATACGAACGT"
    assert value(spark, S.hamming("a", "b"), a=a, b=b) == 3
    assert value(spark, S.hamming_packed(S.encode_kmer("a"), S.encode_kmer("b")), a=a, b=b) == 3
    assert value(spark, S.kmers("s", 3), s="ACGNTTa") == ["ACG", "TTA"]
    assert value(spark, S.kmers("s", 3), s="AC") == []


def test_trims(spark):
    for s, e in (("NNNACGT", "ACGT"), ("ACGTNNN", "ACGT"), ("NNACGTNN", "ACGT"), ("NNNNN", "")):
        assert value(spark, S.trim_ambiguous_ends("s"), s=s) == e
    assert value(spark, S.poly_g_end("s"), s="ACGTGGGGGG") == 4
    assert value(spark, S.poly_g_end("s"), s="ACGTGGGG") == 8
    assert value(spark, S.poly_g_end("s", 0), s="ACGTGGGGGG") == 10
    assert value(spark, S.quality_end("q", 10), q="IIIIIII!!!") == 7
    assert value(spark, S.window_end("q", 4, 15), q="IIIIIIII$$$$") == 8
    assert value(spark, S.adapter_start("s", ["AGATCGGAAGAGCACACGTCTGAA"], 10), s="GATTACAGATCGGAAGAGCACACGTCTGAA") == 6
    assert value(spark, S.read_fate("s", "q", 20), s="ACGTACGTACGTACGTACGT", q="I" * 20) == "pass"
    assert value(spark, S.read_fate("s", "q", 20), s="ACGT", q="IIII") == "too_short"


def test_window_trim_follows_the_loop(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        q = [rng.choice([2, 10, 15, 20, 40]) for _ in range(rng.randrange(0, 14))]
        end = len(q)
        while end and q[end - 1] < 15:
            end -= 1
        while end >= 4 and sum(q[end - 4 : end]) < 60:
            end -= 1
            while end and q[end - 1] < 15:
                end -= 1
        rows.append(("".join(chr(33 + x) for x in q), end))
    df = spark.createDataFrame(rows, "q string, e int")
    assert df.filter(S.window_end("q", 4, 15) != F.col("e")).count() == 0


def test_phred_and_barcodes(spark):
    for q, e in (("IIII!!!!IIII", 33), ("bcdefghh", 64)):
        assert R.detect_phred(spark.createDataFrame([(q,)], ["qual"])) == e
    for h, e in (("r1 BX:Z:ACGTACGT-1", "ACGTACGT"), ("r BC:Z:TGCATGCA", "TGCATGCA"), ("id#ACGTACGT/1", "ACGTACGT"), ("plain", None)):
        assert value(spark, S.header_barcode("h"), h=h) == e


def test_routing(spark):
    a, b = "ACGTA" * 6, "TTGCA" * 5
    pairs = [(0, a, b), (1, a + "NN", "N" + b), (2, "A" * 22 + "NNN" + "C" * 22, b), (3, a, b), (4, "ACNNGT", None)]
    out = R.route(spark.createDataFrame(pairs, "pair_id long, r1 string, r2 string")).collect()
    assert sum(r.block == R.CLEAN_1 for r in out) == 3
    assert sum(r.block in (1, 2, 3) for r in out) == 9
    assert [r.seq for r in out if r.block == R.SIDECAR] == ["ACNNGT"]


def test_k_limits():
    assert validate_k(31) == 31
    for bad in (9, 32, 129):
        with pytest.raises(ValueError):
            validate_k(bad)
