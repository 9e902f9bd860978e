"""What queries carry through their plans, beside what they return."""

import random
import re
from collections import Counter

import __spark_entry__ as entry
import pytest
from kmerloom.operators import resolve

SF = "/root/testdata/sf0.001"


def test_adapter_cuts_sends_pieces_not_texts_to_python(spark):
    plan = entry.queries()["adapter_cuts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    kept = re.search(r"Generate .*, \[([^\]]*)\], false", plan).group(1)
    assert re.sub(r"#\w+", "", kept) == "id"  # the text isn't repeated for each of its pieces
    assert "substring" not in re.search(r"ArrowEvalPython.*", plan).group(0)


def plain_successors(contigs, links, k, least, ratio):
    """The rule over all ways out."""
    turn = str.maketrans("ACGT", "TGCA")
    sides = [(i, rc, s.translate(turn)[::-1] if rc else s) for i, s in contigs if len(s) >= k - 1 for rc in (False, True)]
    e = [(a, b, rc) for a, arc, s in sides if not arc for b, rc, t in sides if a != b and s[len(s) - k + 1 :] == t[: k - 1]]
    n_out, n_in = Counter(a for a, _, _ in e), Counter(b for _, b, _ in e)
    support = {x: links.get(x[:2], 0) for x in e}

    def clear(group):
        best, *rest = sorted(group, key=lambda x: -support[x])
        second = support[rest[0]] if rest else 0
        return best if support[best] >= least and support[best] >= ratio * second else None

    taken = []
    for a in n_out:
        own = sorted(x for x in e if x[0] == a)
        if len(own) == 1:
            taken += [x for x in own if n_in[x[1]] == 1 or support[x] >= least]
        elif (best := clear(own)) is not None:
            taken.append(best)
    out = []
    for b in {x[1] for x in taken}:
        into = sorted(x for x in taken if x[1] == b)
        out += into if len(into) == 1 else [x for x in [clear(into)] if x is not None]
    back = {b for _, b, rc in out if rc}
    return sorted(x for x in out if x[0] not in back)


@pytest.mark.parametrize("k", [3, 4, 6])
def test_successors_without_a_row_for_each_way(spark, monkeypatch, k):
    rng = random.Random(k)
    contigs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice((1, 4, 9, 12))))) for i in range(60)]
    links = {(rng.randrange(60), rng.randrange(60)): rng.choice((1, 3, 4, 9)) for _ in range(900)}
    df = spark.createDataFrame([(i, s, 1.0, 1) for i, s in contigs], resolve.CONTIG)
    given = spark.createDataFrame([(*x, n) for x, n in links.items()], "src long, dst long, support long")
    # their number grows with the square of the contigs
    monkeypatch.setattr(resolve, "overlaps", lambda *_: pytest.fail("all ways are made"))
    got = sorted(tuple(r) for r in resolve.choose_successors(df, given, k).collect())
    want = plain_successors(contigs, links, k, 3, 2.5)
    assert got == want
    assert want
