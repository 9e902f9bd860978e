"""K-mers counted where they meet, from runs of windows instead of single windows.

A run is a stretch of consecutive windows of a sequence whose minimizers (of the canonical
words of ``WORD_BASES`` in a window the one with the smallest hash) lie in one bucket.  Both
strands of a k-mer have the same minimizer, so all instances of a k-mer meet in its bucket.
Between tasks a run goes as its bases, two bits each: about a byte a window where a window by
itself takes eight and the overhead of a row.  A task spells the windows of some buckets
again and counts them in memory, in as many passes over their hashes as keep it bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed

WORD_BASES = 11
LEAST_K = 16  # shorter k-mers repeat within a block so often that their counts are fewer bytes than runs
BUCKETS = 2048
LONGEST = 255  # windows of a run, whose number is a byte
SPELLED = 1 << 15  # windows that are spelled at once, in a processor's cache
TOGETHER = 1 << 20  # windows that are sorted or looked up at once
MARKS = 20
MOST = 1 << 23  # windows that a pass holds; more are counted in several

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _buckets(codes: np.ndarray, k: int) -> np.ndarray:
    """The bucket of the window at each place."""
    word = min(WORD_BASES, k)
    fwd, rev = packed._rolled(codes, word)
    low = (_mixed(np.minimum(fwd, rev)) >> U(32)).astype(np.uint32)
    width, size, n = k - word + 1, 1, len(codes) - k + 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return (np.minimum(low[:n], low[width - size : width - size + n]) % np.uint32(BUCKETS)).astype(np.int16)


def _runs(b: packed.Block, k: int, by_ends: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, number of windows and bucket of each run of a block, ordered by bucket; and the codes of its bases.

    With ``by_ends`` a window is in the buckets of its first and of its last k - 1 bases, once if they are one.
    """
    codes = packed.CODE[b.buf]
    n = len(codes) - k + 1
    if n <= 0:
        return *(np.zeros(0, np.int64) for _ in range(3)), codes
    bad = np.concatenate(([0], np.cumsum(codes == 4)))
    ends = np.repeat(b.offs[1:], np.diff(b.offs))[:n]
    at = np.flatnonzero((bad[k:] == bad[:-k]) & (np.arange(n) + k <= ends))
    codes &= 3
    if by_ends:
        return *_shared_runs(at, _buckets(codes, k - 1)), codes
    bucket = _buckets(codes, k)[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(fresh)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(since % LONGEST == 0)
    size = np.diff(np.append(first, len(at)))
    order = np.argsort(bucket[first], kind="stable")
    return at[first][order], size[order], bucket[first][order], codes


def _shared_runs(at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_runs``, from the places of the windows and the bucket of the k - 1 bases at each place."""
    left, right = bucket[at], bucket[at + 1]
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1] + 1
    # where the bucket changes within a window, it ends one run and begins another
    begins, turns = np.flatnonzero(fresh), np.flatnonzero(left != right)
    first = np.concatenate((begins, turns))
    of = np.concatenate((left[begins], right[turns]))
    turn = np.repeat([0, 1], [len(begins), len(turns)])
    order = np.argsort(2 * first + turn, kind="stable")
    first, of, turn = first[order], of[order], turn[order]
    size = np.append(first[1:] + turn[1:], len(at)) - first
    pieces = -(-size // LONGEST)
    since = LONGEST * _spans(np.zeros(len(size), np.int64), pieces)
    own = np.repeat(np.arange(len(size)), pieces)
    first, size, of = first[own] + since, np.minimum(size[own] - since, LONGEST), of[own]
    order = np.argsort(of, kind="stable")
    return at[first][order], size[order], of[order]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def dealt(seqs: DataFrame, k: int, keep: str | None = None, seq: str = "seq", by_ends: bool = False) -> DataFrame:
    """(bucket, sizes, bases, keys): the runs of each bucket in a block as one row, dealt over tasks by bucket and ordered by it.

    sizes has a byte for each run, bases four bases a byte; keys, with ``keep``, that column
    for each run.  ``by_ends`` as for ``_runs``.
    """
    fields = [T.StructField("bucket", T.IntegerType()), T.StructField("sizes", T.BinaryType()), T.StructField("bases", T.BinaryType())]
    if keep is not None:
        fields.append(T.StructField("keys", T.ArrayType(seqs.schema[keep].dataType)))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for b in packed.blocks(batch.column(0), k):
                place, size, bucket, codes = _runs(b, k, by_ends)
                if not len(place):
                    continue
                first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                bounds = np.append(first, len(place))
                bases = size + k - 1
                # the last run of a bucket goes on to a whole byte
                bases[bounds[1:] - 1] += -np.add.reduceat(bases, first) % 4
                taken = codes[np.minimum(_spans(place, bases), len(codes) - 1)]
                taken = (taken[0::4] << 6) | (taken[1::4] << 4) | (taken[2::4] << 2) | taken[3::4]
                upto = np.concatenate(([0], np.cumsum(np.add.reduceat(bases, first) // 4)))
                binary = lambda data, offs: pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                arrays = [pa.array(bucket[first].astype(np.int32)), binary(size.astype(np.uint8), bounds), binary(taken, upto)]
                if keep is not None:
                    row = b.rows[np.searchsorted(b.offs, place, "right") - 1]
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), batch.column(1).take(pa.array(row))).cast(out.field("keys").type))
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    rows = seqs.select(seq, *([keep] if keep is not None else [])).mapInArrow(run, schema)
    return rows.repartition("bucket").sortWithinPartitions("bucket")


@dataclass
class Held:
    """Runs of some buckets: windows and first base of each, the bases in bytes, the key of each."""

    sizes: np.ndarray
    start: np.ndarray
    bases: np.ndarray
    keys: pa.Array | None = None
    bucket: int | None = None  # of the first


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _runs_of(batch: pa.RecordBatch, k: int, lo: int, hi: int) -> Held:
    """The runs of the rows from ``lo`` to ``hi``."""
    of, at = (_offsets(batch.column(i))[lo : hi + 1] for i in (1, 2))
    sizes, bases = (np.frombuffer(batch.column(i + 1).buffers()[2], np.uint8)[x[0] : x[-1]] for i, x in enumerate((of, at)))
    sizes = sizes.astype(np.int64)
    start = np.cumsum(sizes + k - 1) - (sizes + k - 1)
    start += np.repeat(4 * (at[:-1] - at[0]) - start[of[:-1] - of[0]], np.diff(of))  # each row begins with a byte
    return Held(sizes, start, bases, batch.column(3).slice(lo, hi - lo).flatten() if batch.num_columns > 3 else None, batch.column(0)[lo].as_py() if hi > lo else None)


def _held(batches: Iterator[pa.RecordBatch], k: int, together: int | None = None) -> Iterator[list[Held]]:
    """All runs of a bucket together, of several buckets while they are small (``together``; 1: never)."""
    together = TOGETHER if together is None else together
    held: list[Held] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        lo = 0
        upto = np.concatenate(([0], np.cumsum(_runs_of(batch, k, 0, batch.num_rows).sizes)))[_offsets(batch.column(1)) - _offsets(batch.column(1))[0]]
        for at in first.tolist():
            if (at or bucket[0] != last) and n + upto[at] - upto[lo] >= together:
                if at > lo:
                    held.append(_runs_of(batch, k, lo, at))
                yield held
                held, n, lo = [], 0, at
        held.append(_runs_of(batch, k, lo, batch.num_rows))
        n, last = n + int(upto[-1] - upto[lo]), bucket[-1]
    if held:
        yield held


FOUR = ((np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3).astype(np.uint8)


def _spelled(held: list[Held], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Canonical windows of the runs, about ``SPELLED`` at once: the number of runs before, the run of each window from there on, the windows."""
    done, widths = 0, packed._widths(k)
    for h in held:
        upto = np.cumsum(h.sizes)
        lo = 0
        while lo < len(upto):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SPELLED, "right")))
            sizes, start = h.sizes[lo:hi], h.start[lo:hi]
            byte = int(start[0]) // 4
            codes = FOUR[h.bases[byte : (int(start[-1] + sizes[-1]) + k + 2) // 4]].reshape(-1)
            at = _spans(start - 4 * byte, sizes)
            rolled = {w: packed._rolled(codes, w) for w in set(widths)}
            if len(widths) == 1:
                fwd, rev = rolled[k]
                words = np.minimum(fwd, rev)[at].reshape(-1, 1)
            else:
                before = np.cumsum([0, *widths])
                fwd = np.stack([rolled[w][0][at + b] for w, b in zip(widths, before, strict=False)], 1)
                rev = np.stack([rolled[w][1][at + k - b - w] for w, b in zip(widths, before, strict=False)], 1)
                words = packed.smaller(fwd, rev)[0]
            yield done + lo, np.repeat(np.arange(len(sizes)), sizes), words
            lo = hi
        done += len(h.sizes)


def _together(held: list[Held], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``_spelled``, about ``TOGETHER`` at once."""
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    n = 0
    for part in _spelled(held, k):
        parts.append(part)
        n += len(part[1])
        if n >= TOGETHER:
            yield parts[0][0], np.concatenate([p[1] + (p[0] - parts[0][0]) for p in parts]), np.concatenate([p[2] for p in parts])
            parts, n = [], 0
    if parts:
        yield parts[0][0], np.concatenate([p[1] + (p[0] - parts[0][0]) for p in parts]), np.concatenate([p[2] for p in parts])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-mers, in order, and the sums of their counts."""
    words, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort([words[:, i] for i in range(words.shape[1])][::-1])
    words, n = words[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]).any(1)))) if len(words) else np.zeros(0, np.int64)
    return words[first], np.add.reduceat(n, first) if len(first) else n


def _tally(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if words.shape[1] == 1:
        found, n = np.unique(words[:, 0], return_counts=True)
        return found.reshape(-1, 1), n
    first, n = packed._distinct(words)
    return words[first], n


def _share(words: np.ndarray, i: int, of: int) -> np.ndarray | slice:
    if of == 1:
        return slice(None)
    mixed = words[:, 0]
    for c in range(1, words.shape[1]):
        mixed = _mixed(mixed) ^ words[:, c]
    return np.flatnonzero(_mixed(mixed) % U(of) == U(i))


def _counts(held: list[Held], k: int, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pass, number of passes, the k-mers of the pass that come ``least`` times or more, in order, and how often."""
    passes = -(-sum(int(h.sizes.sum()) for h in held) // MOST)
    for i in range(passes):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[np.ndarray] = []
        for _, _, words in _spelled(held, k):
            waiting.append(words[_share(words, i, passes)])
            if sum(map(len, waiting)) >= TOGETHER:
                parts.append(_tally(np.concatenate(waiting)))
                waiting = []
                if sum(len(p[1]) for p in parts) > MOST:
                    parts = [_added(parts)]
        if waiting:
            parts.append(_tally(np.concatenate(waiting)))
        words, n = _added(parts) if len(parts) > 1 else parts[0]
        yield i, passes, words[n >= least], n[n >= least]


def _among(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the words are known; these are in order and distinct."""
    if not len(known):
        return np.zeros(len(words), bool)
    if words.shape[1] == 1:
        # most that are unknown are seen by a table of hashes
        mark = lambda x: (x * U(0x9E3779B97F4A7C15)) >> U(64 - MARKS)
        marked = np.zeros(1 << MARKS, bool)
        marked[mark(known[:, 0])] = True
        some = np.flatnonzero(marked[mark(words[:, 0])])
        at = np.minimum(np.searchsorted(known[:, 0], words[some, 0]), len(known) - 1)
        out = np.zeros(len(words), bool)
        out[some] = known[at, 0] == words[some, 0]
        return out
    both = np.concatenate((known, words))
    order = np.lexsort([np.arange(len(both)), *[both[:, i] for i in range(both.shape[1])][::-1]])
    fresh = np.concatenate(([True], (both[order][1:] != both[order][:-1]).any(1)))
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(both)), 0))]
    out = np.empty(len(both), bool)
    out[order] = first < len(known)
    return out[len(known) :]


def counts(seqs: DataFrame, k: int, seq: str = "seq", least: int = 1) -> DataFrame:
    """(kmer, cnt long): canonical k-mers, packed, that come ``least`` times or more."""
    schema = T.StructType([T.StructField("kmer", packed.key_type(k)), T.StructField("cnt", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, k):
            for _, _, words, n in _counts(held, k, least):
                yield pa.RecordBatch.from_arrays([packed.to_arrow(words, k), pa.array(n.astype(np.int64))], names=["kmer", "cnt"])

    return dealt(seqs, k, None, seq).mapInArrow(run, schema)


def members(seqs: DataFrame, k: int, least: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, n_solid): how many windows of each sequence hold a k-mer that comes ``least`` times or more in all of them; those without any are left out."""
    schema = T.StructType([T.StructField("key", seqs.schema[key].dataType), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for held in _held(batches, k):
            found = np.zeros(sum(len(h.sizes) for h in held), np.int64)
            for i, passes, solid, _ in _counts(held, k, least):
                for done, run_of, words in _together(held, k):
                    some = _share(words, i, passes)
                    hits = np.bincount(run_of[some][_among(words[some], solid)])
                    found[done : done + len(hits)] += hits
            met = pa.array(found > 0)
            keys = pa.concat_arrays([h.keys for h in held]).filter(met)
            sums = pa.table({"key": keys, "n": pa.array(found).filter(met)}).group_by("key").aggregate([("n", "sum")])
            yield from sums.select(["key", "n_sum"]).rename_columns(["key", "n"]).cast(out).to_batches(1 << 16)

    rows = dealt(seqs, k, key, seq).mapInArrow(run, schema)
    return rows.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("n_solid"))
