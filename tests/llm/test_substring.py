import random

import brute
import pytest
from kmerloom.llm.substring import COVERS, cover_for, dedup_substrings

SCHEMA = "doc_id long, text string"


def found(spark, rows, **options):
    out = dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()}


def test_covers_have_every_difference():
    for p, d in COVERS.items():
        assert {(a - b) % p for a in d for b in d} == set(range(p))
    assert cover_for(50)[0] == 31
    assert cover_for(5)[0] == 3


@pytest.mark.parametrize(("seed", "min_words"), [(1, 50), (2, 20), (3, 5), (4, 8)])
def test_equals_brute_force(spark, seed, min_words):
    rows = brute.near_copies(300, seed)
    assert found(spark, rows, min_words=min_words) == brute.substring(rows, min_words)


def test_passages_at_any_offset_and_of_just_the_length(spark):
    rng = random.Random(7)
    word = lambda: f"x{rng.randrange(10**9)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80)]
    rows = []
    for i in range(200):
        w = [word() for _ in range(rng.randrange(70))]
        p = passages[i % 4]
        rows.append((i, " ".join(w + p + [word() for _ in range(rng.randrange(70))])))
    expected = brute.substring(rows, 50)
    assert found(spark, rows, min_words=50) == expected
    assert sum(e[1] for e in expected.values()) > 0


def test_edges_of_input(spark):
    long_ = " ".join(f"a{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long_), (5, long_), (5, long_), (6, "the " * 200), (7, "the " * 200), (None, long_), (8, "few words")]
    out = dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in out}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (60, 0), 5: (60, 60), 6: (200, 0), 7: (200, 200), None: (60, 0), 8: (2, 0)}
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "k", 9)], "doc_id long, text string, kept_text string, n_words int")
    assert dedup_substrings(df).first().asDict() == {"doc_id": 1, "text": "a b", "n_words": 2, "n_removed": 0, "kept_text": "a b"}
