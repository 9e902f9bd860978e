import hashlib

import brute
import corpus_pipeline
from kmerloom.llm import mixing, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240):
    rows = []
    for i, text in brute.near_copies(n, 11):
        text = None if text is None else text.strip() + "."
        rows.append((i, text, "en", ["a", "b", None][i % 3], None if text is None else len(text)))
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["ngram_jaccard_join"](spark, docs, str(tmp_path)).collect()
    at = brute.jaccard([(r[0], r[1]) for r in rows], 5, 4, 5)
    assert sorted(r.doc_id for r in once) == sorted(i for i, (_, c) in at.items() if c == i)
    kept = spark.createDataFrame(once, COLUMNS)
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, kept, str(tmp_path)).collect()}
    model = brute.substring([(r.doc_id, r.text) for r in once], 50)
    assert set(cut) == {i for i, (n, gone, _) in model.items() if not n or gone < n}
    for i, r in cut.items():
        assert r.text == (model[i][2] if model[i][1] else dict((x.doc_id, x.text) for x in once)[i])
    after = spark.createDataFrame(list(cut.values()), COLUMNS)
    mixed = stages["source_mixing"](spark, after, str(tmp_path))
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(after).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c}
    coded = stages["bpe_codec"](spark, mixed, str(tmp_path)).collect()
    assert len(coded) == sum(got.values())
    assert all(r.decoded_sha256 == hashlib.sha256((cut[r.doc_id].text or "").encode()).hexdigest() for r in coded)


def test_run_on_files(spark, tmp_path):
    rows = corpus(90)
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_classifier_stage_returns_documents(spark, tmp_path):
    rows = corpus(60)
    spark.createDataFrame([(r[0], int(r[0] % 2), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, COLUMNS)
    out = corpus_pipeline.classify(spark, docs, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    assert quality.with_statistics(docs, ["doc_id"]).count() == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
