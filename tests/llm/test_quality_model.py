import random
import re

import brute
import numpy as np
import pytest
from kmerloom.llm import quality

DOCS = "doc_id long, text string"


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["Alpha", "beta.", "GAMMA", "x1", "###", "a|b", "é!", "日本,", "the", "the", "?", "12:30"]
    out = ["".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return [*out, "", " ", None, "word", "y " * 50_000]


def model_of(text):
    """The statistics by plain Python."""
    raw = (text or "").encode()
    words = [w.encode() for w in brute.words(text)]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    count = lambda f: sum(map(f, raw))
    some_b, some_w = max(len(raw), 1), max(len(words), 1)
    letters = count(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
    upper = count(lambda c: 65 <= c <= 90)
    return {
        "n_words": len(words), "word_length": sum(map(len, words)) / some_w, "upper_share": upper / max(letters, 1), "letter_share": letters / some_b,
        "digit_share": count(lambda c: 48 <= c <= 57) / some_b, "symbol_share": count(lambda c: c in b"#*$%&<>~^_=+{}[]\\/@") / some_b, "bar_share": raw.count(b"|") / some_b,
        "mark_share": count(lambda c: c in b"!?") / some_b, "stop_share": count(lambda c: c in b".,;:") / some_b, "space_share": len(re.findall(rb"[\x20\x09-\x0d]", raw)) / some_b,
        "line_words": len(words) / (raw.count(b"\n") + 1), "echo_share": sum(a == b for a, b in zip(low, low[1:], strict=False)) / some_w, "distinct_share": len(set(low)) / some_w,
        "capital_share": sum(65 <= w[0] <= 90 for w in words) / some_w, "stopped_words": sum(w[-1] in b".,;:" for w in words) / some_w,
    }


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts(200, 1)))
    found = quality.with_statistics(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()
    assert len(found) == len(rows)
    for r in found:
        want = model_of(rows[r.doc_id][1])
        assert set(want) == set(quality.STATISTICS)
        for name, v in want.items():
            assert r[name] == pytest.approx(v, abs=1e-12), (r.doc_id, name)
    assert quality.with_statistics(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(quality.STATISTICS))).round(2)
    y = ((x[:, 0] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    y[rng.random(n) < 0.05] = 0
    return x, y


def test_stump_is_the_best_of_all_splits():
    x, y = sample(120, 2)
    cuts = [np.unique(x[:, j]) for j in range(x.shape[1])]
    grad, hess = 0.5 - y, np.full(len(y), 0.25)
    gain, j, at = quality._stump(x, grad, hess, np.arange(len(y)), cuts, 10)

    def value(rows):
        return grad[rows].sum() ** 2 / (hess[rows].sum() + 1)

    every = [value(x[:, c] <= t) + value(x[:, c] > t) - value(np.ones(len(y), bool)) for c in range(x.shape[1]) for t in cuts[c] if min((x[:, c] <= t).sum(), (x[:, c] > t).sum()) >= 10]
    assert gain == pytest.approx(max(every))
    assert value(x[:, j] <= at) + value(x[:, j] > at) - value(np.ones(len(y), bool)) == pytest.approx(gain)


def test_rules_are_paths_and_every_row_takes_a_step():
    x, y = sample(400, 3)
    rules = quality.tree_rules(x, y, trees=1)
    assert all(1 <= len(r) <= 3 for r in rules)
    roots = {r for r in rules if len(r) == 1}
    assert len(roots) == 2
    # each longer path goes on from one that is there too
    assert all(any(set(p) < set(r) and len(p) == len(r) - 1 for p in rules) for r in rules if len(r) > 1)
    # a node that can't be split is a leaf: its rows still move, so later trees look elsewhere
    lone = np.zeros((60, x.shape[1]))
    lone[:15, 0] = 1
    z = np.r_[np.ones(15), np.zeros(45)]
    z[20:32] = 1
    lone[20:32, 1] = 1
    two = quality.tree_rules(lone, z, trees=2)
    assert any(name == quality.STATISTICS[1] for r in two for name, _, _ in r)


def test_lasso_meets_its_optimality_conditions():
    x, y = sample(500, 4)
    rules = quality.tree_rules(x, y, trees=4)
    fires = np.stack([quality._fires(x, r) for r in rules], 1).astype(np.float64)
    penalty = 5e-3
    b, w = quality.lasso_weights(fires, y, penalty, 20_000)
    p = 1 / (1 + np.exp(-(fires @ w + b)))
    slope = fires.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-5
    assert (np.abs(slope[w == 0]) <= penalty + 1e-5).all()
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5)
    assert 0 < (w != 0).sum() < len(w)


def test_compiled_score_equals_the_rules(spark):
    x, y = sample(300, 5)
    model = quality.fit(x, y)
    assert len(model.rules) > 2
    names = ", ".join(f"{s} double" for s in quality.STATISTICS)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"doc_id long, {names}")
    got = {r.doc_id: r.s for r in df.select("doc_id", model.score().alias("s")).collect()}
    total = model.intercept + sum(v * quality._fires(x, r) for r, v in model.rules)
    assert [got[i] for i in range(len(x))] == pytest.approx((1 / (1 + np.exp(-total))).tolist())


def test_repeated_rows_teach_once_and_clashing_columns(spark):
    rows = [(i, "good words here." if i % 2 else "### | !!") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one = quality.with_statistics(spark.createDataFrame(rows, DOCS), ["doc_id"])
    many = quality.with_statistics(spark.createDataFrame(rows + rows[:7] * 5, DOCS), ["doc_id"])
    assert quality.fit_on(one, labels, "quality") == quality.fit_on(many, labels, "quality")
    clash = spark.createDataFrame([(1, "a b", 99.0)], "doc_id long, text string, n_words double")
    assert quality.with_statistics(clash, ["doc_id", "n_words"]).select("doc_id", "n_words").first() == (1, 2.0)
