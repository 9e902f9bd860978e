"""Runs of windows give the counts of single windows."""

import random
from collections import Counter

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pytest
from kmerloom.operators import kmers, packed, runs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def sequences(seed):
    rng = random.Random(seed)
    some = ["".join(rng.choice("ACGT") for _ in range(rng.choice((0, 10, 31, 40, 900)))) for _ in range(40)]
    return [*some, *some[:20], rc(some[3]), "A" * 2000, "ACGT" * 300, "AC" * 90 + "N" + "AC" * 90, None, ""]


def canon(s, k):
    return [min(w, rc(w)) for i in range(len(s or "") - k + 1) if not set(w := s[i : i + k]) - set("ACGT")]


@pytest.mark.parametrize("k", [16, 21, 31, 32, 55, 128])
def test_counts_and_members(spark, k):
    rows = [(None if i == 7 else i // 2, s) for i, s in enumerate(sequences(k))]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    want = Counter(w for _, s in rows for w in canon(s, k))
    got = packed.decoded(kmers.count_packed(df, k), k).collect()
    assert len(got) == len(want)
    assert {r.kmer: r.cnt for r in got} == want
    solid = Counter()
    for i, s in rows:
        solid[i] += sum(want[w] >= 2 for w in canon(s, k))
    found = runs.members(df, k, 2).collect()
    assert {r.id: r.n_solid for r in found} == +solid
    assert len(found) == len(+solid)


@pytest.mark.parametrize("k", [21, 55])
def test_several_passes_and_pieces(monkeypatch, k):
    texts = sequences(k)
    held = []
    for b in packed.blocks(pa.array(texts), k, 2000):  # long ones in pieces
        place, size, _, codes = runs._runs(b, k)
        bases = codes[runs._spans(place, size + k - 1)]
        bases = np.append(bases, [0] * (-len(bases) % 4)).reshape(-1, 4)
        held.append(runs.Held(size, np.cumsum(size + k - 1) - (size + k - 1), (bases @ np.array([64, 16, 4, 1])).astype(np.uint8)))
    want = Counter(w for s in texts for w in canon(s, k))
    monkeypatch.setattr(runs, "MOST", 3000)
    monkeypatch.setattr(runs, "SPELLED", 300)
    monkeypatch.setattr(runs, "TOGETHER", 700)
    got = Counter()
    for _, passes, words, n in runs._counts(held, k, 1):
        assert passes > 1
        assert (words[:-1, 0] <= words[1:, 0]).all()
        got.update(dict(zip(packed.strings(packed.letters(words, k)).to_pylist(), n.tolist(), strict=True)))
    assert got == want
    windows = np.concatenate([w for _, _, w in runs._spelled(held, k)])
    some = next(w for _, _, w, _ in runs._counts(held, k, 2))
    known = {w.tobytes() for w in some}
    assert runs._among(windows, some).tolist() == [w.tobytes() in known for w in windows]


def test_solid_membership_deals_no_single_windows(spark):
    assert "Join" not in entry.queries()["solid_membership"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    seqs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.translate(F.upper("text"), "ACGT BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))
    sent = runs.dealt(seqs, 31).agg(F.sum(F.length("sizes") + F.length("bases")).alias("bytes")).first().bytes
    n = packed.kmer_codes(seqs, 31).count()
    assert 0 < sent < 1.5 * n  # a packed k-mer has 8
