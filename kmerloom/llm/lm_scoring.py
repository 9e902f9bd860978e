"""Documents scored by the cross-entropy difference of two n-gram models.

The background model counts every text of the corpus, the target model those of them
that are marked as wanted.  Both have the same vocabulary, so their per-token losses can
be compared token by token, and counts are exact over the whole corpus.

``score_by_words`` has bigram models over the words of all texts.  Their counts are never
gathered: each run of texts sends its distinct n-grams, added up, to buckets by hash, and
gets their counts over the corpus back.  ``trigram_counts``, ``fit`` and
``score_documents`` have byte trigrams, a table of 256**3 entries at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .arrowmap import tidy
from .planes import from_planes, to_planes
from .store import Scratch, batch_rows

PAD = 0  # two of these stand before every text


def _padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with two pad bytes before each, and the places of their own bytes."""
    n = len(offs) - 1
    at = np.arange(len(buf)) + 2 * (np.repeat(np.arange(n), np.diff(offs)) + 1)
    out = np.full(len(buf) + 2 * n, PAD, np.uint8)
    out[at] = buf
    return out, at


def _codes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every byte of the texts: itself and the two before it, as one number."""
    padded, at = _padded(buf, offs)
    wide = padded.astype(np.uint32)
    return (wide[at - 2] << 16) | (wide[at - 1] << 8) | wide[at]


def _tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(np.concatenate((first, [len(codes)]))).astype(np.int64)
    keys, where = np.unique(codes, return_inverse=True)
    return keys, np.bincount(where, counts, len(keys)).astype(np.int64)


def trigram_counts(docs: DataFrame, wanted: Column, text: str = "text") -> DataFrame:
    """code, n_background, n_target over all texts; each task adds up its own first.

    ``wanted`` is a condition on ``docs``; null is false.  Rows count as often as they stand there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {True: (np.zeros(0, np.uint32), np.zeros(0, np.int64)), False: (np.zeros(0, np.uint32), np.zeros(0, np.int64))}
        for batch in batches:
            marks = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in textbuf.chunks(batch.column(0)):
                codes = _codes(buf, offs)
                mark = np.repeat(marks[lo:hi], np.diff(offs))
                for side in (True, False):
                    keys, counts = _tally(codes[mark == side])
                    own[side] = _tally(np.concatenate((own[side][0], keys)), np.concatenate((own[side][1], counts)))
        keys = np.union1d(own[True][0], own[False][0])
        both = {s: np.zeros(len(keys), np.int64) for s in own}
        for s, (k, n) in own.items():
            both[s][np.searchsorted(keys, k)] = n
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(both[True] + both[False]), pa.array(both[True])], names=["code", "n_background", "n_target"])

    parts = docs.select(text, wanted.alias("_wanted")).mapInArrow(tidy(run), "code long, n_background long, n_target long")
    return parts.groupBy("code").agg(F.sum("n_background").alias("n_background"), F.sum("n_target").alias("n_target"))


@dataclass
class Models:
    """Losses (nats) of both models for every trigram of the corpus, in a cube over the bytes that occur."""

    rank: np.ndarray
    target: np.ndarray
    background: np.ndarray


def _losses(codes: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Trigrams smoothed by bigrams, those by unigrams, those by the uniform distribution."""
    c3 = counts.astype(np.float64)
    ctx, mid, out = codes >> 8, codes & 0xFFFF, codes & 0xFF
    n2ctx = np.bincount(ctx, c3, 1 << 16)  # how often a pair stands before another byte
    n2 = np.bincount(mid, c3, 1 << 16)
    n1ctx = np.bincount(mid >> 8, c3, 256)
    n1 = np.bincount(out, c3, 256)
    p1 = (n1 + 1) / (n1.sum() + 256)
    p2 = (n2[mid] + prior * p1[out]) / (n1ctx[mid >> 8] + prior)
    p3 = (c3 + prior * p2) / (n2ctx[ctx] + prior)
    return -np.log(p3)


def fit(counts: DataFrame, prior: float = 8.0) -> Models:
    """Both models of a table of counts, which has 256**3 rows at most (in text far fewer).

    Without any wanted text the target model is uniform.
    """
    found = counts.toArrow().sort_by("code")
    codes = found.column("code").to_numpy().astype(np.int64)
    used = np.unique(np.concatenate([(codes >> 16) & 255, (codes >> 8) & 255, codes & 255])) if len(codes) else np.zeros(1, np.int64)
    rank = np.zeros(256, np.int64)
    rank[used] = np.arange(len(used))
    m = len(used)
    where = (rank[(codes >> 16) & 255] * m + rank[(codes >> 8) & 255]) * m + rank[codes & 255]
    cubes = []
    for name in ("n_target", "n_background"):
        cube = np.zeros(m**3, np.float32)
        cube[where] = _losses(codes, found.column(name).to_numpy(), prior)
        cubes.append(cube)
    return Models(rank, *cubes)


def score_documents(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Mean loss per token under both models, and their difference, for every text.

    Returns key, n_tokens (bytes), loss_target, loss_background and ce_difference
    (target minus background: the lower, the more like the wanted texts).  A null or empty
    text has no tokens and losses 0; repeated rows give repeated rows.  ``models`` must come
    from counts that cover the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, T.LongType() if n == "n_tokens" else T.DoubleType()) for n in ("n_tokens", "loss_target", "loss_background", "ce_difference"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own, out = shared.value, to_arrow_schema(schema)
        m = int(own.rank.max()) + 1
        for batch in batches:
            for lo, hi, buf, offs in textbuf.chunks(batch.column(1)):
                padded, at = _padded(buf, offs)
                r = own.rank[padded]
                where = (r[at - 2] * m + r[at - 1]) * m + r[at]
                n = np.diff(offs)
                mean = []
                for cube in (own.target, own.background):
                    upto = np.concatenate(([0.0], np.cumsum(cube[where], dtype=np.float64)))
                    mean.append((upto[offs[1:]] - upto[offs[:-1]]) / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(out[0].type), pa.array(n.astype(np.int64)), *(pa.array(x) for x in (*mean, mean[0] - mean[1]))], schema=out)

    return docs.select(key, text).mapInArrow(tidy(run), schema)


START = np.uint64(0)  # stands before the first word of every text
RUN = 4 << 20  # bytes of text that send their n-grams together
BUCKET = 16 << 20  # bytes of text whose n-grams meet in a bucket


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, marks, bytes and offsets of consecutive texts, ``limit`` bytes together (or one text, if that is longer)."""
    held, size = [], 0

    def joined() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        keys, marks, bufs, lengths = zip(*held, strict=True)
        return pa.concat_arrays(keys), np.concatenate(marks), np.concatenate(bufs), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))

    for batch in batches:
        marks = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in textbuf.chunks(batch.column(1), min(limit, textbuf.CHUNK)):
            if held and size + len(buf) > limit:
                yield joined()
                held, size = [], 0
            held.append((batch.column(0).slice(lo, hi - lo), marks[lo:hi], buf, np.diff(offs)))
            size += len(buf)
    if held:
        yield joined()


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words (even) and of the pairs that end in them (odd), and the number of words of each text."""
    starts, ends, bounds = textbuf.words(buf, offs)
    word = textbuf.word_hashes(buf, starts, ends) & ~np.uint64(1)
    with np.errstate(over="ignore"):
        pair = textbuf.mix(word + textbuf.mix(_before(word, bounds, START) + np.uint64(1))) | np.uint64(1)
    return word, pair, np.diff(bounds)


def _before(words: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """What stands before each word of its text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[bounds[:-1][np.diff(bounds) > 0]] = start
    return out


def score_by_words(docs: DataFrame, wanted: Column, key: str = "doc_id", text: str = "text", prior: float = 8.0) -> DataFrame:
    """Mean loss (nats) per word under both word bigram models, and their difference, for every text.

    Words are runs of bytes outside 0x20 and 0x09-0x0D; the vocabulary is all words of all
    texts.  Bigrams are smoothed by unigrams, those by the uniform distribution; without any
    wanted text the target model is uniform.  A word at the end of a text counts as context
    too: that share belongs to the end, which is not scored.  ``wanted`` is a condition on
    ``docs``; null is false.  Returns key, n_tokens (words), loss_target, loss_background and
    ce_difference (target minus background: the lower, the more like the wanted texts).  A
    text without words has losses 0; repeated rows count, and come out, as often as they
    stand there.  A null key stays null, an empty table gives an empty one, a text of any
    length is scored whole, and columns that neither key, text nor ``wanted`` name are not
    read.  N-grams are compared by 63-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    limit, key_type = RUN, docs.schema[key].dataType
    packed_schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("keys", T.ArrayType(key_type)), *(T.StructField(n, T.BinaryType()) for n in ("marks", "lengths", "text")), T.StructField("n_bytes", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(packed_schema)
        for i, (keys, marks, buf, offs) in enumerate(_runs(batches, limit)):
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(out.field("keys").type)
            row = {"run": (TaskContext.get().partitionId() << 32) + i, "marks": marks.tobytes(), "lengths": to_planes(np.diff(offs)), "text": pa.compress(pa.py_buffer(np.ascontiguousarray(buf)), "zstd", asbytes=True), "n_bytes": len(buf)}
            yield pa.RecordBatch.from_arrays([lists if f.name == "keys" else pa.array([row[f.name]], f.type) for f in out], schema=out)

    def unpack(text: pa.Scalar, lengths: pa.Scalar, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of a run in order, START first, the places of its words and pairs among them, and words of each text."""
        offs = np.concatenate(([0], np.cumsum(from_planes(lengths, np.int64))))
        texts = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.decompress(text.as_buffer(), n_bytes, "zstd"))
        word, pair, sizes = (np.concatenate(x) for x in zip(*(_grams(*chunk[2:]) for chunk in textbuf.chunks(texts)), strict=True))
        codes, at = np.unique(np.concatenate(([START], word, pair)), return_inverse=True)
        return codes, at[1 : len(word) + 1], at[len(word) + 1 :], sizes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                run, text, lengths, marks, n_bytes = (batch.column(n)[r] for n in ("run", "text", "lengths", "marks", "n_bytes"))
                codes, words, pairs, sizes = unpack(text, lengths, n_bytes.as_py())
                marks = np.frombuffer(marks.as_buffer(), bool)
                mark = np.repeat(marks, sizes)
                tally = [np.bincount(np.concatenate((words[m], pairs[m])), minlength=len(codes)).astype(np.uint32) for m in (slice(None), mark)]
                tally[0][0], tally[1][0] = np.count_nonzero(sizes), np.count_nonzero(sizes[marks])
                cut = np.searchsorted(codes >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)).tolist() + [len(codes)]
                some = [b for b in range(1 << bits) if cut[b] < cut[b + 1]]
                parts = [[to_planes(np.diff(codes[cut[b] : cut[b + 1]], prepend=np.uint64(0))) for b in some], *([to_planes(t[cut[b] : cut[b + 1]]) for b in some] for t in tally)]
                # words of the run, told once
                told = [[n] + [0] * (len(some) - 1) for n in (len(words), int(mark.sum()))]
                yield pa.RecordBatch.from_arrays([pa.array([run.as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in parts), *(pa.array(x, pa.int64()) for x in told)], names=["run", "bucket", "codes", "background", "target", "n_words", "n_wanted"])

    def reply(bucket: pa.Table) -> pa.Table:
        """Adds up what all runs sent to one bucket; each gets the counts of its own n-grams."""
        parts = [np.cumsum(from_planes(c, np.uint64), dtype=np.uint64) for c in bucket.column("codes")]
        codes, at = np.unique(np.concatenate(parts), return_inverse=True)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        out = {n: bucket.column(n) for n in ("run", "bucket", "n_words", "n_wanted")}
        for name in ("background", "target"):
            sums = np.bincount(at, np.concatenate([from_planes(c, np.uint32) for c in bucket.column(name)])).astype(np.int64)
            out[name] = pa.array([to_planes(p) for p in np.split(sums[at], ends)], pa.binary())
        distinct = int(np.count_nonzero(codes & np.uint64(1) == 0))
        out["n_distinct"] = pa.array([distinct] + [0] * (len(parts) - 1), pa.int64())
        return pa.table(out)

    runs = scratch.write(docs.select(key, text, wanted.alias("_wanted")).mapInArrow(tidy(pack), packed_schema))
    size = runs.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(8, ceil(log2(max(size, 1) / BUCKET)))
    scratch.reclaim()
    with batch_rows(spark, 4):  # a row holds a run
        sent = runs.drop("keys").mapInArrow(tidy(send), "run long, bucket int, codes binary, background binary, target binary, n_words long, n_wanted long")
        replies = scratch.write(sent.groupBy("bucket").applyInArrow(reply, "run long, bucket int, n_words long, n_wanted long, background binary, target binary, n_distinct long"))
    n_words, n_wanted, vocabulary = (int(x or 0) for x in replies.agg(F.sum("n_words"), F.sum("n_wanted"), F.sum("n_distinct")).first())
    vocabulary = max(vocabulary - 1, 1)  # without START
    scratch.reclaim()
    schema = T.StructType([T.StructField(key, key_type), *(T.StructField(n, T.LongType() if n == "n_tokens" else T.DoubleType()) for n in ("n_tokens", "loss_target", "loss_background", "ce_difference"))])

    def score(run: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        run = run.sort_by("bucket")  # its texts, then its counts in the order of the codes
        _, words, pairs, sizes = unpack(run.column("text")[0], run.column("lengths")[0], run.column("n_bytes")[0].as_py())
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        before = _before(words, bounds, 0)
        mean = []
        for name, total in (("target", n_wanted), ("background", n_words)):
            counts = np.concatenate([from_planes(c, np.int64) for c in run.column(name)[1:]])
            p1 = (counts[words] + 1) / (total + vocabulary)
            loss = np.log(counts[before] + prior) - np.log(counts[pairs] + prior * p1)
            upto = np.concatenate(([0.0], np.cumsum(loss)))
            mean.append((upto[bounds[1:]] - upto[bounds[:-1]]) / np.maximum(sizes, 1))
        return pa.Table.from_arrays([run.column("keys")[0].values.cast(out[0].type), pa.array(sizes), *(pa.array(x) for x in (*mean, mean[0] - mean[1]))], schema=out)

    both = runs.drop("marks").withColumn("bucket", F.lit(-1)).unionByName(replies.select("run", "bucket", "background", "target"), allowMissingColumns=True)
    return both.groupBy("run").applyInArrow(score, schema)
