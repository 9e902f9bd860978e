from itertools import combinations

import brute
import pytest
from kmerloom.llm import jaccard


def expected(rows, width, num, den):
    sets = {}
    for i, text in rows:
        w = brute.words(brute.ascii_lower(text))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sets, pairs


@pytest.mark.parametrize("block", [jaccard.BLOCK, 7])
def test_no_link_is_lost_inside_components(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    # 60 distinct edits of one text that all match one another, some twice, among other near copies
    base = [f"t{i}" for i in range(200)]
    rows = [(5000 + i, " ".join(base[: 100 + i] + ["edit"] + base[101 + i :])) for i in range(60)]
    rows += [(6000 + i, rows[i][1]) for i in range(10)] + brute.near_copies(300, 5) + [(7000, None), (7001, "")]
    out = jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=4, threshold=0.85)
    sets, pairs = expected(rows, 4, 85, 100)
    want = dict.fromkeys(sets, 0)
    for a, b in pairs:
        want[a], want[b] = want[a] + 1, want[b] + 1
    assert {r.doc_id: r.n_links for r in out.counted.collect()} == want
    at = {r.doc_id: r.class_id for r in out.members.collect()}
    links = sorted((r.a, r.b, r.overlap) for r in out.links.collect())
    classes = {tuple(sorted((at[a], at[b]))) for a, b in pairs if at[a] != at[b]}
    assert links == sorted((a, b, len(sets[a] & sets[b])) for a, b in classes)
    assert len([x for x in links if x[0] >= 5000]) == 60 * 59 // 2
