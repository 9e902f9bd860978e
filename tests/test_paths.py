"""Unitigs from pieces of paths: the same as k-mer by k-mer, without a table of k-mers."""

import random

import __spark_entry__ as entry
import pytest
from kmerloom.operators import graph, kmers, paths
from kmerloom.plans import views
from test_graph import brute_counts, brute_unitigs, random_dna, rc

SF = "/root/testdata/sf0.001"


def reads(k, seed):
    rng = random.Random(seed)
    genome, circle = random_dna(400, seed), random_dna(90, seed + 1)
    bubble = genome[:150] + ("A" if genome[150] != "A" else "C") + genome[151:250]
    some = [genome, rc(genome[100:300]), bubble, circle + circle[: k - 1], "A" * 70, "ACAT" * 40, genome[:60] + "N" + genome[70:200]]
    return [*some, *(genome[i : i + 90].lower() for i in rng.sample(range(300), 5)), None, ""]


def rows(df):
    return sorted((r.sequence, r.mean_coverage, r.kmers_count) for r in df.collect())


@pytest.mark.parametrize(("k", "few"), [(17, 100_000), (31, 100_000), (31, 2), (33, 2)])
def test_joined_pieces_equal_brute_force(spark, monkeypatch, k, few):
    monkeypatch.setattr(paths, "FEW", few)
    texts = reads(k, k)
    df = spark.createDataFrame([(r,) for r in texts], "seq string").repartition(3)
    counts = brute_counts([r or "" for r in texts], k)
    got = rows(graph.unitigs_of(df, k, 1))
    # a cycle may be spelled from another of its k-mers by the brute force
    line = lambda found: sorted(s for s in found if s[: k - 1] != s[1 - k :])
    want = brute_unitigs(counts, k)
    assert line(s for s, _, _ in got) == line(want)
    assert sorted(len(s) for s, _, _ in got) == sorted(map(len, want))
    for s, mean, n in got:
        own = [counts[min(s[i : i + k], rc(s[i : i + k]))] for i in range(n)]
        assert mean == sum(own) / n


def test_palindromes_and_shares(spark, monkeypatch):
    half, k = random_dna(60, 4), 16
    df = spark.createDataFrame([(half + rc(half),), (random_dna(300, 5),)], "seq string")
    got = rows(graph.unitigs_of(df, k, 1))
    # the way back over the other strand belongs to the path, each k-mer of either strand once
    assert (half + rc(half), 105) in {(s, n) for s, _, n in got} | {(rc(s), n) for s, _, n in got}
    assert rows(graph.unitigs(kmers.count_packed(df, k), k)) == got
    held = []
    seen = paths._pieces
    monkeypatch.setattr(paths, "_pieces", lambda *a: held.append(len(a[0])) or seen(*a))
    monkeypatch.setattr(paths, "AT_ONCE", 20)
    import numpy as np
    from kmerloom.operators import packed

    at, fwd, rev = packed.windows(np.frombuffer((half + rc(half)).encode(), np.uint8), np.array([0, 120]), k)
    words = packed.smaller(fwd, rev)[0]
    words = words[packed._distinct(words)[0]]
    left, right = paths.buckets(words, k)
    batches = []
    for bucket in sorted({*left.tolist(), *right.tolist()}):
        own = (left == bucket) | (right == bucket)
        batches += paths.pieces(words[own], np.ones(int(own.sum()), np.int64), k, bucket)
    assert max(held) < len(words)
    parts = spark.createDataFrame([r for b in batches for r in zip(*b.to_pydict().values(), strict=True)], paths.schema(k))
    assert [(min(r.sequence, rc(r.sequence)), r.kmers_count) for r in paths.spelled(paths.joined(parts, k), k).collect()] == [(min(half + rc(half), rc(half + rc(half))), 105)]


@pytest.mark.parametrize("query", ["unitigs", "simplified_contigs"])
def test_no_table_of_kmers_is_cut(spark, monkeypatch, query):
    sizes = []
    cut = graph.cut

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    found = entry.queries()[query](spark, SF).count()
    solid = kmers.seen_twice(kmers.count_packed(views.seqs(spark, SF), 31)).count()
    assert found
    assert max(sizes) < solid / 3


def test_only_joined_contigs_are_ranked(spark, monkeypatch):
    ranked = []
    rank = graph.list_rank
    monkeypatch.setattr(graph, "list_rank", lambda nodes, links: ranked.append(nodes.count()) or rank(nodes, links))
    pair = random_dna(60, 1)
    texts = [pair[:34], pair[30:], *(random_dna(50, i) for i in range(2, 30))]
    df = spark.createDataFrame([(i, s, 2.0, len(s) - 4) for i, s in enumerate(texts)], "id long, sequence string, mean_coverage double, kmers_count long")
    k = 5
    starts = [x[: k - 1] for t in texts for x in (t, rc(t))]
    own = {pair[30:34], rc(pair[30:34])}
    keep = [i for i, t in enumerate(texts) if i < 2 or not {t[: k - 1], t[1 - k :], rc(t)[: k - 1], rc(t)[1 - k :]} & own]
    assert starts.count(pair[30:34]) >= 1
    out = graph.stitch(df.filter(df.id.isin(keep)), k)
    found = [r.sequence for r in out.collect()]
    assert min(pair, rc(pair)) in {min(s, rc(s)) for s in found} or any(pair in s or rc(pair) in s for s in found)
    assert ranked[0] < 2 * len(keep)
