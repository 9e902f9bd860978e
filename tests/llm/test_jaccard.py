import brute
import pytest
from kmerloom.llm.jaccard import ngram_jaccard_join

SCHEMA = "doc_id long, text string"


def found(spark, rows, **options):
    out = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), **options).members
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}


@pytest.mark.parametrize(("seed", "width", "threshold", "num", "den"), [(1, 4, 0.85, 85, 100), (2, 5, 0.8, 4, 5), (3, 1, 0.8, 4, 5), (4, 3, 0.6, 3, 5)])
def test_equals_brute_force(spark, seed, width, threshold, num, den):
    rows = brute.near_copies(400, seed, vocabulary=60 if width == 1 else 400)
    assert found(spark, rows, width=width, threshold=threshold) == brute.jaccard(rows, width, num, den)


def test_chain_of_links_is_one_component(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(100 - k, " ".join(base[: 60 - k] + [f"n{j}" for j in range(k)])) for k in range(0, 30, 3)]
    assert found(spark, rows, width=4, threshold=0.85) == brute.jaccard(rows, 4, 85, 100)


def test_edges_of_input(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (6, "one two"), (7, "É a b c"), (8, "é a b c")]
    out = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), width=4, threshold=0.85).members.collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 8)}
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).members.count() == 0


def test_repeated_keys_long_texts_and_clashing_columns(spark):
    long_ = " ".join(f"v{i % 5000}x{i}" for i in range(60_000))
    rows = [(1, "a b c d e", 1), (1, "p q r s t u", 2), (2, "p q r s t u", 3), (3, "a b c d e", 4), (4, long_, 5), (5, long_ + " end", 6)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "x", n) for i, t, n in order], "doc_id long, text string, component_id string, n int")
        out = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, width=4, threshold=0.85).members.collect()}
        assert out == {(1, 2, 1), (1, 3, 1), (2, 3, 2), (3, 2, 1), (4, 59_997, 4), (5, 59_998, 4)}
