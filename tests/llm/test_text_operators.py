import hashlib
import random
import re

import brute
import pytest
from kmerloom.llm import bpe, licenses, line_rules, lm_scoring, mixing, quality, textbuf, token_counts
from kmerloom.llm.queries import tokenizer_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
ALPHABET = "aAbetThei \n\t  'sl0123é日本▁🙂!!.,ßÉ\x1c\x85"


def odd_texts(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", None, " ", "a" * 3000, "the cat " * 500, "x<|endoftext|>y", "<s>hi</s>"]


def test_words_equal_the_pattern():
    import pyarrow as pa

    texts = odd_texts(300, 1)
    i = 0
    for lo, hi, buf, offs in textbuf.chunks(pa.array(texts), 200):
        starts, ends, bounds = textbuf.words(buf, offs)
        raw = buf.tobytes()
        for d in range(hi - lo):
            assert [raw[s:e].decode() for s, e in zip(starts[bounds[d] : bounds[d + 1]], ends[bounds[d] : bounds[d + 1]], strict=True)] == brute.words(texts[i])
            i += 1
    assert i == len(texts)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = list(enumerate(odd_texts(400, 2)))
    out = bpe.encode_documents(spark.createDataFrame(rows, DOCS), path, with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(odd_texts(600, 3)))
    out = token_counts.count_tokens(spark.createDataFrame(rows, DOCS), path, limit=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out} == {i: (len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in rows}


def test_whole_tokens_are_proved():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    counter, library = token_counts.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for piece in list(counter.plain.whole)[::97]:
        if piece.startswith("▁") and not piece.startswith("▁▁"):
            assert len(library.encode(piece[1:])) == 1


def test_water_filling():
    sizes, weights = {"a": 100, "b": 10, "c": 90}, {"a": 1, "b": 2, "c": 3}
    t = mixing.water_fill(sizes, weights, 200, 3)
    assert t["b"] == 30
    assert t["a"] == pytest.approx(42.5)
    assert t["c"] == pytest.approx(127.5)
    assert mixing.water_fill({}, {}, 0, 3) == {}
    assert mixing.cycle_weights(["b", None, "a", "c"]) == {"a": 1, "b": 2, "c": 3, None: 1}


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None]), None if i % 50 == 0 else "w " * rng.randint(0, 30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    out = mixing.mix_sources(df)
    again = {(r.doc_id, r.copies) for r in mixing.mix_sources(df.repartition(7)).collect()}
    found = out.collect()
    assert {(r.doc_id, r.copies) for r in found} == again
    assert max(r.copies for r in found) <= 3
    for s in {r.source for r in found}:
        own = [r for r in found if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 0.01 * own[0].target + 60
    assert mixing.repeat_rows(out).count() == sum(r.copies for r in found)
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_line_rules_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = ["alpha", "beta.", "###", "a|b", "x$", "|", "é", "gamma!!", "delta"]
    rows = [(i, None if i % 40 == 0 else "".join(rng.choice(vocab[: rng.choice([2, 4, 9])]) + rng.choice([" ", " ", "\n", "\t", "\r\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    out = line_rules.clean_lines(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit(1))).collect()
    assert len(out) == len(rows)
    for r in out:
        t = dict(rows)[r.doc_id] or ""
        w = brute.words(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_line_rules_verdicts(spark):
    clean = "This is a quiet sentence about nothing at all.\nAnd here is another one, which ends as it should."
    menu = "home | news | sport | shop | help | about | login | more\n" * 3
    shout = "BUY!! THIS!! NOW!! IT!! IS!! CHEAP!! AND!! GOOD!! FOR!! YOU!! ALL!!"
    junk = "the&&& word*** is### not%%% clean$$$ at&&& all*** in### this%%% line$$$ here&&&"
    rows = list(enumerate([clean, menu, shout, junk, clean + "\nAccept cookies and privacy policy"]))
    kept = {r.doc_id: r.kept for r in line_rules.clean_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_license_phrases_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["GNU", "general", "Public", "license", "apache", "MIT", "cc", "by", "-", "é", ",", "\n", "x1"]
    rows = [(i, None if i % 30 == 0 else " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(500)]
    rows += [(900, "MIT license"), (901, "mIT-License apache License"), (902, "mitlicense"), (903, "émit license")]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(t))
        at = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert got[i] == (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_license_templates_equal_brute_force(spark):
    rng = random.Random(7)
    templates = licenses.TEMPLATES
    rows = []
    for i in range(300):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(templates)[1].split()
            rng.shuffle(w)
            keep = rng.choice([1.0, 0.95, 0.8, 0.5])
            lines.append(" ".join(x for x in w + ["noise"] * rng.randint(0, 3) if rng.random() < keep))
        rows.append((i, "\n".join(lines)))
    got = {(r.doc_id, r.line, r.template) for r in licenses.template_blocks(spark.createDataFrame(rows, DOCS)).collect()}
    want = set()
    for i, t in rows:
        for j, line in enumerate(t.split("\n")):
            have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(line)))
            for n, (_, template) in enumerate(templates):
                s = set(template.split())
                if len(s & have) >= 0.9 * len(s) - 1e-9:
                    want.add((i, j, n))
    assert got == want
    assert len(want) > 50


def test_quality_learns_and_scores(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        good = i % 3 > 0
        text = " ".join(words) + "." if good else rng.choice([" | ".join(words), "!! ".join(w.upper() for w in words), " ".join(w + "$$$" for w in words), " ".join([words[0]] * 40)])
        rows.append((i, text))
        if i < 400:
            labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 200_000)]
    stats = quality.with_statistics(spark.createDataFrame(rows, DOCS), ["doc_id"])
    model = quality.fit_on(stats, spark.createDataFrame(labels + [(5, None)], "doc_id long, quality int"), "quality")
    scored = {r.doc_id: r.s for r in stats.select("doc_id", model.score().alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    assert len(scored) == len(rows)
    held = [(scored[i] >= 0.7) == (i % 3 > 0) for i in range(400, 600)]
    assert sum(held) / len(held) > 0.97
    none = quality.fit_on(stats, spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert stats.select(none.score().alias("s")).distinct().count() == 1


def test_lm_losses_equal_brute_force(spark):
    from math import log

    texts = {1: b"abcabc", 2: b"abd", 3: b"", 4: "é".encode()}
    good = {1}
    rows = [(i, t.decode()) for i, t in texts.items()] + [(5, None)]
    df = spark.createDataFrame(rows, DOCS)
    counts = lm_scoring.trigram_counts(df, F.col("doc_id").isin(*good))
    out = {r.doc_id: r for r in lm_scoring.score_documents(df, lm_scoring.fit(counts, 8.0)).collect()}

    def loss(ids, text):
        tri = {}
        for i in ids:
            padded = b"\0\0" + texts[i]
            for j in range(2, len(padded)):
                tri[padded[j - 2 : j + 1]] = tri.get(padded[j - 2 : j + 1], 0) + 1
        total = 0.0
        padded = b"\0\0" + text
        for j in range(2, len(padded)):
            a, b, c = padded[j - 2], padded[j - 1], padded[j]
            s = lambda f: sum(n for k, n in tri.items() if f(k))
            p1 = (s(lambda k: k[2] == c) + 1) / (s(lambda k: True) + 256)
            p2 = (s(lambda k: k[1:] == bytes([b, c])) + 8 * p1) / (s(lambda k: k[1] == b) + 8)
            total -= log((tri.get(bytes([a, b, c]), 0) + 8 * p2) / (s(lambda k: k[:2] == bytes([a, b])) + 8))
        return total / max(len(text), 1)

    for i, t in texts.items():
        assert out[i].n_tokens == len(t)
        assert out[i].loss_target == pytest.approx(loss(good, t), abs=1e-5)
        assert out[i].loss_background == pytest.approx(loss(texts, t), abs=1e-5)
    assert out[5].n_tokens == 0
    assert out[1].ce_difference < out[2].ce_difference


def test_a_long_document_does_not_keep_others_out(spark):
    # the target asks for a part of the words only; one document has most of them
    rows = [(i, "a", "w " * (600 if i == 0 else 10)) for i in range(41)] + [(100 + i, "b", "w " * 10) for i in range(500)]
    for seed in ("x", "y", "z"):
        out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=lambda s: {"a": 1, "b": 20}, seed=seed).collect()
        own = [r for r in out if r.source == "a"]
        assert own[0].target < 600
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 10
