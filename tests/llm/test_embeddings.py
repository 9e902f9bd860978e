import numpy as np
import brute
from kmerloom.llm.embeddings import calibrate, near_duplicates


def expected(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    at = brute.components([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], at[i], at[i] == i) for i, _ in rows}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, **options).collect()}


def test_equals_brute_force_over_several_chunks(spark):
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.standard_normal((40, 32))
    for i in range(900):
        v = centres[i % 40] + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.15, 0.2, 2.0])
        rows.append((i * 2 + 5, np.float32(v).tolist()))
    want, got = expected(rows), run(spark, rows, chunk_rows=100)
    links = sum(w[0] for w in want.values())
    assert links > 1000
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.99 * links
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert sum(got[i] != want[i] for i in want) <= 10


def test_edges_of_input(spark):
    a, b = [1.0, 2.0, 3.0, 0.0], [0.0, -1.0, 0.5, 4.0]
    rows = [(9, a), (2, a), (5, [2.0, 4.0, 6.0, 0.0]), (7, b), (1, None), (3, []), (4, [0.0] * 4), (6, [1.0, None, 2.0, 3.0]), (8, [float("nan")] * 4), (10, [float("inf"), 1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0])]
    got = run(spark, rows)
    assert got == {9: (2, 2, False), 2: (2, 2, True), 5: (2, 2, False), 7: (0, 7, True)} | {i: (0, i, True) for i in (1, 3, 4, 6, 8, 10, 11)}
    assert run(spark, []) == {}


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(5)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.05]), (3, [0.0, 1.0]), (4, [2.0]), (5, [3.0]), (6, [-1.0])]
    for i, dim in enumerate([3] * 30 + [48] * 40 + [200] * 30):
        base = np.random.default_rng(dim + i % 5).standard_normal(dim)
        rows.append((10 + i, np.float32(base + 0.05 * rng.standard_normal(dim)).tolist()))
    assert run(spark, rows, chunk_rows=8) == expected(rows)


def test_one_projection_in_common_does_not_fill_a_chunk(spark):
    # all first projections are nearly one number, which cuts by value alone could not part
    first = calibrate(16, 0.95).directions[:, 0]
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        v = rng.standard_normal(16)
        v = v - (v @ first) * first
        v = v / np.linalg.norm(v) + 0.5 * first
        rows.append((i, v.tolist()))
    rows += [(5000 + i, rows[i][1]) for i in range(20)]
    got, want = run(spark, rows, chunk_rows=500), expected(rows)
    links = sum(w[0] for w in want.values())
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.99 * links
    assert all(got[i][0] <= want[i][0] for i in want)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 7), (1, [1.0, 2.0], 7), (2, [1.0, 2.0], 8), (None, [1.0, 2.0], 9)], "vec_id long, embedding array<float>, n_links int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
