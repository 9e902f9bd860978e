"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import brute
import corpus_pipeline
import pytest
from kmerloom.llm import bpe, line_rules, lm_scoring, mixing, substring, token_counts
from kmerloom.llm.queries import tokenizer_path
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997}x{i // 997}" for i in range(200_000))
ROWS = [(1, "a short text, nothing more."), (1, "a short text, nothing more."), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (None, "no key here at all.")]
#: names that the operators add or use on their way
CLASH = ("n_tokens", "n_words", "size", "target", "copies", "kept", "n_bytes", "ids_sha256", "loss_target", "ce_difference", "n_removed", "kept_text", "id", "n", "a", "b", "token", "_label", "component_id")


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(i, t, "en", ["a", None][(i or 0) % 2]) for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in CLASH})


def codec(df):
    return bpe.encode_documents(df, tokenizer_path("byte_bpe_50k.json"))


def counts(df):
    return token_counts.count_tokens(df, tokenizer_path("piece_bpe_32k.model"))


def words(df):
    return lm_scoring.score_by_words(df, F.col("doc_id") == 1)


def lines(df):
    return line_rules.clean_lines(df)


def passages(df):
    return substring.dedup_substrings(df)


@pytest.mark.parametrize("op", [codec, counts, words, lines, passages, mixing.mix_sources])
def test_every_row_has_its_result(op, table):
    out = op(table).collect()
    assert len(out) == len(ROWS)
    key = lambda r: str(r.doc_id)
    assert sorted(map(key, out)) == sorted(str(i) for i, _ in ROWS)
    one = [r for r in out if r.doc_id == 1]
    assert one[0] == one[1]
    assert op(table.limit(0)).count() == 0
    by = {r.doc_id: r for r in out}
    n = len(brute.words(LONG))
    if op is codec:
        assert by[2].n_tokens == by[3].n_tokens == 0
        assert by[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
        assert by[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    if op is counts:
        assert (by[2].n_tokens, by[3].n_bytes, by[5].n_bytes, by[5].over_limit) == (0, 0, len(LONG), True)
    if op is words:
        assert [by[i].n_tokens for i in (2, 3, 4, 5)] == [0, 0, 0, n]
        assert by[2].loss_target == by[2].ce_difference == 0
    if op is lines:
        assert [by[i].n_words for i in (2, 3, 4, 5)] == [0, 0, 0, n]
        assert by[2].base_failed
        assert not by[2].kept
    if op is passages:
        assert [(by[i].n_words, by[i].n_removed) for i in (2, 3, 4, 5)] == [(0, 0), (0, 0), (0, 0), (n, 0)]
    if op is mixing.mix_sources:
        assert [by[i]["size"] for i in (2, 3, 4, 5)] == [0, 0, 0, n]
        assert by[5].source_size == sum(len(brute.words(t)) for i, t in ROWS if (i or 0) % 2)


def test_long_passages_in_long_texts_go(spark):
    rows = [(1, LONG), (2, "start " + LONG + " end"), (3, LONG[: len(LONG) // 2])]
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(brute.words(LONG))
    assert out[1][:2] == (n, 0)
    assert out[2] == (n + 2, n, "start end")
    assert out[3][0] - out[3][1] <= 1


def test_words_of_one_character_in_bounded_memory(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    codes = bpe.load(path)
    for text in ("=" * 300_000, "ha" * 100_000, "-= " * 60_000, "\x01" * 50_000, "é" * 80_000):
        assert codes.ids(text) == library.encode(text, add_special_tokens=False).ids
    assert not any(len(w) > bpe.LONG_WORD for w in codes.cache)


def test_a_long_run_takes_little_memory():
    import subprocess
    import sys

    code = f"""
import resource
from kmerloom.llm import bpe
codes = bpe.TrieBpe({tokenizer_path("byte_bpe_50k.json")!r})
pieces, table = next(iter(codes.encode([chr(61) * 4_000_000])))
assert sum(table[p].count(",") + 1 for p in pieces) == 62_500
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_rows(spark, table, tmp_path, at):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (77, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, table, str(tmp_path))
    got = out.collect()
    if at < 4:
        assert out.columns == corpus_pipeline.COLUMNS
        assert {(r.doc_id, r.text) for r in got} <= set(ROWS)
    if name == "ngram_jaccard_join":
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "5", "None"]
    if name == "substring_dedup":
        assert len(got) == len(ROWS)
    if name == "bpe_codec":
        assert len(got) == len(ROWS)
    assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_of_a_repeated_id_the_first_row_in_order_stays(spark, tmp_path):
    rows = [(1, "beta text that is the second of two", "en", "s", 9), (1, "alpha text that is the first of them", "en", "s", 9), (2, "other words altogether stand in here", "en", "s", 9)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        out = corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()
        assert sorted((r.doc_id, r.text[:5]) for r in out) == [(1, "alpha"), (2, "other")]
