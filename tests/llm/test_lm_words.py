from collections import Counter
from math import log

import brute
import pytest
from kmerloom.llm import lm_scoring
from pyspark.sql import functions as F


@pytest.mark.parametrize("run", [lm_scoring.RUN, 300])
def test_word_losses_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(lm_scoring, "RUN", run)
    rows = [(i, t) for i, t in brute.near_copies(120, 7)] + [(500, None), (501, ""), (502, " \n"), (503, "é 日本 é"), (None, "a b a b"), (504, "a b a b"), (504, "a b a b")]
    good = {i for i, _ in rows if i is not None and i % 3 == 0}
    out = lm_scoring.score_by_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id").isin(*good)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in out) == sorted((i is None, i or 0, len(brute.words(t))) for i, t in rows)

    def model(ids):
        one, two = Counter(), Counter()
        for i, t in rows:
            if ids is None or i in ids:
                w = ["<s>", *brute.words(t)] if brute.words(t) else []
                one.update(w)
                two.update(zip(w, w[1:]))
        total = sum(n for w, n in one.items() if w != "<s>")
        return lambda a, b: -log((two[a, b] + 8 * (one[b] + 1) / (total + size)) / (one[a] + 8))

    size = len({w for _, t in rows for w in brute.words(t)})
    target, background, texts = model(good), model(None), dict(rows)
    for r in out:
        w = ["<s>", *brute.words(texts[r.doc_id])]
        for found, loss in ((r.loss_target, target), (r.loss_background, background)):
            assert found == pytest.approx(sum(map(loss, w, w[1:])) / max(len(w) - 1, 1), abs=1e-9)


def test_word_order_tells_target_from_background(spark):
    rows = [(i, "red fox " * 20 if i < 5 else "fox red " * 20) for i in range(10)] + [(20, "blue red fox blue"), (21, "blue fox red blue")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.ce_difference for r in lm_scoring.score_by_words(df, F.col("doc_id") < 5).collect()}
    assert out[0] < out[5]
    empty = lm_scoring.score_by_words(df.limit(0), F.col("doc_id") < 5)
    assert empty.count() == 0
