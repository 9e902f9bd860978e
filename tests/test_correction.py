import random

import numpy as np
import pyarrow as pa
import pytest
from kmerloom.operators import graph, kmers, packed


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def model(read, k, solid):
    """The rule by plain loops: a window that isn't solid, all substitutions in it, the largest gain of solid windows over the place."""
    seq, changed = list(read), 0

    def is_solid(chars):
        w = "".join(chars).upper()
        return not set(w) - set("ACGT") and min(w, rc(w)) in solid

    for i in range(len(seq) - k + 1):
        window = seq[i : i + k]
        if set("".join(window).upper()) - set("ACGT") or is_solid(window):
            continue
        best, most = None, 0
        for pos in range(i, i + k):
            over = [s for s in range(max(0, pos - k + 1), min(pos, len(seq) - k) + 1) if s != i]
            before = sum(is_solid(seq[s : s + k]) for s in over)
            for base in "ACGT":
                if base == seq[pos].upper():
                    continue
                tried = seq[:pos] + [base] + seq[pos + 1 :]
                if not is_solid(tried[i : i + k]):
                    continue
                gain = max(1 + sum(is_solid(tried[s : s + k]) for s in over) - before, 0)
                if gain > most:
                    best, most = (pos, base), gain
        if best:
            seq[best[0]] = best[1]
            changed += 1
    return "".join(seq), changed


@pytest.mark.parametrize(("k", "seed"), [(5, 1), (9, 2), (21, 3), (33, 4)])
def test_both_plans_equal_the_rule(spark, k, seed):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(150 if k < 9 else 400))
    known = {min(w, rc(w)) for i in range(len(genome) - k + 1) for w in [genome[i : i + k]] if rng.random() < 0.97}
    rows = []
    for i in range(60):
        at = rng.randrange(len(genome) - 100)
        read = list(genome[at : at + rng.randint(k - 2, 100)])
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            read[rng.randrange(len(read))] = rng.choice("ACGTN")
        read = "".join(read) if i % 3 else rc("".join(read).replace("N", "A"))
        if i % 4 == 0:
            read = "".join(c.lower() if rng.random() < 0.5 else c for c in read)
        rows.append((None if i % 20 == 7 else i // 2, read))
    rows += [(900, None), (901, ""), (902, "ACG"), (903, "N" * 60), (904, "r" * 50)]
    want = sorted(repr((i, *((None, 0) if s is None else model(s, k, known)))) for i, s in rows)
    assert sum(model(s, k, known)[1] for _, s in rows if s) > 20
    solid = spark.createDataFrame([(x,) for x in sorted(known)], "kmer string")
    reads = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    for limit in (10**6, 0):
        got = kmers.correct_reads(reads, solid, k, broadcast_kmers=limit).collect()
        assert sorted(repr((r.id, r.seq, r.changed)) for r in got) == want


def test_lists_are_ranked_alike_on_one_task_and_on_many(spark):
    rng = random.Random(6)
    names = list(range(300))
    rng.shuffle(names)
    links, at = [], 0
    while at < 280:
        n = rng.randint(1, 40)
        part = names[at : at + n]
        links += list(zip(part, part[1:], strict=False))
        if rng.random() < 0.4 and n > 1:
            links.append((part[-1], part[0]))
        at += n
    nodes, steps = spark.createDataFrame([(x,) for x in names], "node long"), spark.createDataFrame(links, "prev long, node long")
    here, there = (sorted(tuple(r) for r in graph.list_rank(nodes, steps, local_nodes=x).select("node", "head", "rank").collect()) for x in (1000, 0))
    assert here == there
    assert len(here) == 300


def test_numbers_follow_the_order_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(50), f"s{rng.randrange(1000)}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, id long").repartition(7)
    out = graph.numbered(df, ["a"], ["a", "b", "id"], name="place", start=1).collect()
    assert [(r.a, r.b, r.id) for r in sorted(out, key=lambda r: r.place)] == sorted(rows)
    assert sorted(r.place for r in out) == list(range(1, 501))


@pytest.mark.parametrize("k", [1, 4, 31, 32, 33, 64, 96, 127])
def test_packed_kmers_equal_strings(k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTNacgt") if rng.random() < 0.03 else rng.choice("ACGT") for _ in range(rng.randrange(0, 500))) for _ in range(12)] + ["", None, "ACGT"]
    got = []
    for b in packed.blocks(pa.array(seqs), k, size=170):
        at, fwd, rev = packed.windows(b.buf, b.offs, k)
        canon, flipped = packed.smaller(fwd, rev)
        assert (packed.turned(fwd, k) == rev).all()
        column = packed.to_arrow(canon, k)
        assert (packed.from_arrow(column, k) == canon).all()
        assert packed.from_arrow(column.slice(len(column) // 2), k).tolist() == canon[len(column) // 2 :].tolist()
        own = np.searchsorted(b.offs, at, "right") - 1
        texts = packed.strings(packed.letters(canon, k)).to_pylist()
        got += [(int(b.rows[o]), int(a - b.offs[o] + b.base[o]), t, bool(f)) for o, a, t, f in zip(own, at, texts, flipped, strict=True)]
    want = [(i, j, min(w, rc(w)), rc(w) < w) for i, s in enumerate(seqs) for j in range(len(s or "") - k + 1) for w in [s[j : j + k].upper()] if not set(w) - set("ACGT")]
    assert sorted(got) == want
    # order as strings
    words = packed.repacked(np.array([list(t.encode()) for _, _, t, _ in want[:200]], np.uint8).reshape(-1, k), k)
    keys = packed.to_arrow(words, k).to_pylist()
    assert sorted(range(len(keys)), key=keys.__getitem__) == sorted(range(len(keys)), key=lambda i: want[i][2])


def test_neighbours_are_all_single_substitutions():
    for k in (3, 31, 40):
        s = "".join(random.Random(k).choice("ACGT") for _ in range(k))
        _, fwd, rev = packed.windows(np.frombuffer(s.encode(), np.uint8), np.array([0, k]), k)
        got = set(packed.strings(packed.letters(packed.neighbours(fwd, rev, k), k)).to_pylist())
        assert got == {min(x, rc(x)) for j in range(k) for b in "ACGT" if b != s[j] for x in [s[:j] + b + s[j + 1 :]]}


def test_reads_pack_and_unpack(spark):
    rows = [(1, "ACGTACGTA"), (2, "acgNNt"), (3, ""), (4, None)]
    two = packed.pack_reads(spark.createDataFrame(rows, "id long, seq string"))
    assert [len(r.packed) for r in two.orderBy("id").collect()] == [3, 1, 0, 0]
    assert [r.seq for r in packed.unpack_reads(two).orderBy("id").collect()] == ["ACGTACGTA", "ACGT", "", ""]


def test_the_cutoff_needs_a_valley(spark):
    def cutoff(bins):
        return kmers.solid_cutoff(spark.createDataFrame([(i, c) for i, c in enumerate(c for c, n in bins.items() for _ in range(n))], "kmer long, cnt long"))

    assert cutoff({2: 50, 3: 20, 4: 5, 5: 8, 6: 9, 7: 20, 8: 30, 40: 100}) == 4
    assert cutoff({2: 50, 3: 20, 4: 5, 5: 4, 8: 30, 40: 100}) == 2  # empty bins move the valley on to the end of the search
    assert cutoff({2: 50, 3: 20, 4: 5, 40: 100}) == 2  # falls and stays low
    assert cutoff({2: 5, 40: 10}) == 2
    assert kmers.solid_cutoff(None, 10.0) == 3
