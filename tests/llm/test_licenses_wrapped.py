import random
import re

import brute
from kmerloom.llm import licenses

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(rows, most):
    """{(doc, first line, lines, template)} over all windows of lines whose ends hold a word of some template."""
    vocabulary = {w for _, t in licenses.TEMPLATES for w in t.split()}
    want = set()
    for i, text in rows:
        lines = [WORD.findall(brute.ascii_lower(x)) for x in (text or "").split("\n")]
        for at in range(len(lines)):
            for m in range(1, most + 1):
                if at + m > len(lines) or not vocabulary & set(lines[at]) or not vocabulary & set(lines[at + m - 1]):
                    continue
                words = [w for x in lines[at : at + m] for w in x]
                for n, (_, template) in enumerate(licenses.TEMPLATES):
                    s = set(template.split())
                    if len(s & set(words)) >= 0.9 * len(s) - 1e-9 and (m == 1 or len(words) <= licenses.WRAPPED_WORDS * len(s)):
                        want.add((i, at, m, n))
    return want


def wrap(words, width, rng):
    out, line = [], []
    for w in words:
        line.append(w)
        if len(line) >= width + rng.randint(-1, 1):
            out.append(" ".join(line))
            line = []
    return "\n".join([*out, " ".join(line)])


def test_wrapped_notices_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(3, 150):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        words = ["intro"] * rng.randint(0, 9) + [w for w in words if rng.random() < rng.choice([1, 0.95, 0.8])] + ["more"] * rng.randint(0, 9)
        rows.append((i, "Some text.\n\n" + wrap(words, rng.choice([4, 8, 12]), rng).title() + "\nThe end of it."))
    out = licenses.template_blocks(spark.createDataFrame(rows, DOCS), lines=licenses.LINES).collect()
    want = expected(rows, licenses.LINES)
    assert {(r.doc_id, r.line, r.lines, r.template) for r in out} == want
    assert len({i for i, _, m, _ in want if m > 1}) > 60
    assert all(r.block == "\n".join(dict(rows)[r.doc_id].split("\n")[r.line : r.line + r.lines]) for r in out)


def test_words_strewn_over_a_page_are_no_notice(spark):
    words = dict(licenses.TEMPLATES)["bsd"].split()
    page = "\n".join(f"{w} " + "and so it goes on with other words here " * 3 for w in words)
    notice = "Copyright someone.\n" + wrap(words, 8, random.Random(1))
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame([(1, page), (2, notice), (3, "x " * 100_000 + "\n" + notice)], DOCS)).collect()}
    assert got == {1: "", 2: "bsd", 3: "bsd"}


def test_rows_that_repeat_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "MIT license", "x"), (1, "MIT license", "y"), (None, "apache license", "z")], "doc_id long, text string, labels string")
    out = sorted((r.doc_id or 0, r.n_base, r.labels) for r in licenses.scan_licenses(df).collect())
    assert out == [(0, 1, "apache"), (1, 1, "mit"), (1, 1, "mit")]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert licenses.template_blocks(df.limit(0)).count() == 0
