"""Substring dedup with difference-cover anchors.

A difference cover modulo P is a set of residues whose differences give every residue.
So if the same words stand at word i of one document and at word j of another, some
k < P puts both i + k and j + k at cover positions.  Hashing the windows of
``min_words`` - P + 1 words at cover positions only is therefore enough: any common
passage of ``min_words`` holds one such anchor that both documents share.  Each shared
anchor is extended to the windows of ``min_words`` around it, and those alone are
compared in full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .arrowmap import tidy
from .store import Scratch

#: Perfect difference sets; every non-zero residue is a difference exactly once.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}

WHOLE = -1  # position of the anchor that stands for a whole document


def cover_for(min_words: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves anchors of three eighths of the length or more."""
    modulus = max(p for p in COVERS if p == 1 or 8 * p <= 5 * min_words)
    return modulus, COVERS[modulus]


def _anchors(docs: DataFrame, min_words: int) -> DataFrame:
    modulus, cover = cover_for(min_words)
    width = min_words - modulus + 1
    at_cover = np.isin(np.arange(modulus), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, buf, offs in textbuf.chunks(batch.column(1)):
                starts, ends, bounds = textbuf.words(buf, offs)
                hashes = textbuf.word_hashes(buf, starts, ends)
                n = np.diff(bounds)
                first, doc = textbuf.window_starts(bounds, width)
                pos = first - bounds[doc]
                keep = at_cover[pos % modulus] & (n[doc] >= min_words)
                first, doc, pos = first[keep], doc[keep], pos[keep]
                long_ = np.flatnonzero(n >= min_words)
                whole = textbuf.mix(textbuf.window_hashes(hashes, bounds[long_], n[long_]) ^ np.uint64(0xA5A5A5A55A5A5A5A))
                token = np.concatenate((textbuf.window_hashes(hashes, first, width), whole)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(ids[lo + np.concatenate((doc, long_))]), pa.array(np.concatenate((pos, np.full(len(long_), WHOLE))).astype(np.int32))], names=["token", "id", "pos"])

    return docs.mapInArrow(tidy(run), "token long, id long, pos int")


def _shared(texts: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(id, pos) of the anchors that stand in two documents or more; of whole documents, all but the first.

    Which anchors are shared is an aggregate that tasks combine before the shuffle, so a
    passage that very many documents have is one row of each task.  The anchors are then
    made again and joined to that table, a join whose hot keys Spark can split.
    """
    both = _anchors(texts, min_words).groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    known = scratch.write(both.filter("first < last").select("token", "first"))
    scratch.reclaim()
    return _anchors(texts, min_words).join(known, "token").filter((F.col("pos") != WHOLE) | (F.col("id") != F.col("first"))).select("id", "pos")


def _spread(positions: np.ndarray, size: int, before: int, after: int) -> np.ndarray:
    """Marks position - before .. position + after for every position."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, np.clip(positions - before, 0, size), 1)
    np.add.at(step, np.clip(positions + after + 1, 0, size), -1)
    return np.cumsum(step)[:size] > 0


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """Full-length windows around the shared anchors of (id, text, anchors)."""
    modulus, _ = cover_for(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors = batch.column(0).to_numpy(), batch.column(2)
            at, offsets = anchors.values.to_numpy(), anchors.offsets.to_numpy()
            for lo, hi, buf, offs in textbuf.chunks(batch.column(1)):
                starts, ends, bounds = textbuf.words(buf, offs)
                hashes = textbuf.word_hashes(buf, starts, ends)
                n = np.diff(bounds)
                own = at[offsets[lo] : offsets[hi]].astype(np.int64)
                doc = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
                # an anchor at p lies in the windows that start from p - modulus + 1 on, in its own document
                low = np.maximum(bounds[doc] + own - modulus + 1, bounds[doc])
                high = np.minimum(bounds[doc] + own, bounds[doc] + n[doc] - min_words)
                step = np.zeros(len(hashes) + 2, np.int64)
                some = low <= high
                np.add.at(step, low[some], 1)
                np.add.at(step, high[some] + 1, -1)
                first = np.flatnonzero(np.cumsum(step) > 0)
                of = np.searchsorted(bounds, first, "right") - 1
                tokens = textbuf.window_hashes(hashes, first, min_words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(ids[lo + of]), pa.array((first - bounds[of]).astype(np.int32))], names=["token", "id", "pos"])

    return docs.mapInArrow(tidy(run), "token long, id long, pos int")


def repeated_windows(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(id, starts): where windows start whose words also start in a document with a smaller id.

    A start of -1 says that the whole document repeats an earlier one.
    """
    texts = docs.filter("id IS NOT NULL")
    shared = scratch.write(_shared(texts, min_words, scratch))
    scratch.reclaim()
    # of whole documents that are equal, all but the one with the smallest id are settled already
    copies = shared.filter(F.col("pos") == WHOLE).select("id").distinct()
    places = shared.filter(F.col("pos") != WHOLE)
    found = places.groupBy("id").agg(F.collect_list("pos").alias("anchors")).join(copies, "id", "left_anti")
    windows = scratch.write(_windows(texts.join(found, "id").select("id", "text", "anchors"), min_words))
    scratch.reclaim()
    # written first: a join of two plain tables is one whose hot keys Spark can split
    first = scratch.write(windows.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("token", "first"))
    scratch.reclaim()
    later = windows.join(first, "token").filter("id > first").select("id", "pos")
    starts = later.groupBy("id").agg(F.collect_set("pos").alias("starts"))
    return scratch.write(starts.unionByName(copies.select("id", F.array(F.lit(WHOLE)).alias("starts"))))


def dedup_substrings(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Finds passages of ``min_words`` or more words that an earlier document has too.

    Adds n_words, n_removed and kept_text to the columns of ``docs``: every word is removed
    that a window of ``min_words`` words covers whose words also start a window in a document
    with a smaller key; kept_text has the others, joined by one space.  Windows are judged on
    the input, so passages removed here still count as earlier ones for later documents, and
    a passage that repeats within one document only stays.

    Words are runs of characters outside 0x20 and 0x09-0x0D.  Null and empty texts have no
    words and an empty kept_text; a document shorter than ``min_words`` loses nothing, nor
    does one with a null key.  Keys are integers and name one text each; rows that repeat
    are treated alike.  Columns named like the added ones are replaced.  An empty table stays
    empty, and a text of any length is taken as a whole.  Windows are compared by 64-bit hashes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    docs = docs.drop(*(c for c in ("n_words", "n_removed", "kept_text", "_starts") if c not in (key, text)))
    starts = repeated_windows(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), min_words, scratch)
    starts = starts.select(F.col("id").alias("_id"), F.col("starts").alias("_starts"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    text_at, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, n_removed, kept = [], [], []
                for raw, found in zip(part.column(text_at).fill_null("").cast(pa.binary()).to_pylist(), part.column(width).to_pylist(), strict=True):
                    words = raw.split()
                    n_words.append(len(words))
                    if found is not None:
                        gone = np.ones(len(words), bool) if WHOLE in found else _spread(np.array(found), len(words), 0, min_words - 1)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                arrays = [*part.columns[:width], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    joined = docs.join(starts, docs[key].cast("long") == F.col("_id"), "left").select(*(docs[c] for c in docs.columns), "_starts")
    return joined.mapInArrow(tidy(run), schema)
