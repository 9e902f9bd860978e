"""K-mers of Arrow string columns as numbers, two bits a base, with numpy.

A k-mer of 31 bases or less is one long.  A longer one is a binary value of one to four
big-endian words of 32 bases each, the last with what is left.  Either sorts as its string
does.  Long sequences are taken in pieces, so memory is bounded whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NARROW = 31
WORD = 32
CHUNK = 1 << 20

CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    CODE[_b] = CODE[_b + 32] = _i
LETTERS = np.frombuffer(b"ACGT", np.uint8)

U = np.uint64


def check_k(k: int) -> int:
    if not 1 <= k <= 128:
        raise ValueError(f"k-mers have 1 to 128 bases, not {k}")
    return k


def key_type(k: int) -> T.DataType:
    return T.LongType() if check_k(k) <= NARROW else T.BinaryType()


def _widths(k: int) -> list[int]:
    return [k] if k <= NARROW else [min(WORD, k - at) for at in range(0, k, WORD)]


def _rolled(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of codes (32 at most) as a number, forward and as reverse complement, by doubling."""
    fwd, rev, size = codes.astype(U), 3 - codes.astype(U), 1
    out_f = out_r = None
    done, left = 0, width
    while True:
        if left & size:
            if not done:
                out_f, out_r = fwd, rev
            else:
                n = len(out_f) - size
                out_f = (out_f[:n] << U(2 * size)) | fwd[done : done + n]
                out_r = (rev[done : done + n] << U(2 * done)) | out_r[:n]
            done += size
            left -= size
            if not left:
                return out_f, out_r
        n = len(fwd) - size
        fwd, rev = (fwd[:n] << U(2 * size)) | fwd[size : size + n], (rev[size : size + n] << U(2 * size)) | rev[:n]
        size *= 2


def windows(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``buf`` of all windows of one sequence that hold ACGT only, and their words, forward and turned (n x words)."""
    n = len(buf) - k + 1
    m = len(_widths(k))
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros((0, m), U), np.zeros((0, m), U)
    codes = CODE[buf]
    bad = np.concatenate(([0], np.cumsum(codes == 4)))
    ends = np.repeat(offs[1:], np.diff(offs))[:n]
    at = np.flatnonzero((bad[k:] == bad[:-k]) & (np.arange(n) + k <= ends))
    codes &= 3
    fwd, rev, lo = np.empty((len(at), m), U), np.empty((len(at), m), U), 0
    rolled = {w: _rolled(codes, w) for w in set(_widths(k))}
    for i, w in enumerate(_widths(k)):
        fwd[:, i] = rolled[w][0][at + lo]
        rev[:, i] = rolled[w][1][at + k - lo - w]
        lo += w
    return at, fwd, rev


def smaller(fwd: np.ndarray, rev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical ones, and where they are the turned ones; a tie is forward."""
    flipped, equal = np.zeros(len(fwd), bool), np.ones(len(fwd), bool)
    for i in range(fwd.shape[1]):
        flipped |= equal & (rev[:, i] < fwd[:, i])
        equal &= rev[:, i] == fwd[:, i]
    return np.where(flipped[:, None], rev, fwd), flipped


def to_arrow(words: np.ndarray, k: int) -> pa.Array:
    if k <= NARROW:
        return pa.array(np.ascontiguousarray(words[:, 0]).view(np.int64))
    size = 8 * words.shape[1]
    offs = np.arange(0, (len(words) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(words.astype(">u8")))])


def from_arrow(column: pa.Array, k: int) -> np.ndarray:
    if k <= NARROW:
        return column.to_numpy().view(U).reshape(-1, 1)
    m = len(_widths(k))
    if not len(column):
        return np.zeros((0, m), U)
    at = column.offset * 8 * m  # all values have one length
    return np.frombuffer(column.buffers()[2], ">u8", len(column) * m, at).reshape(-1, m).astype(U)


def letters(words: np.ndarray, k: int) -> np.ndarray:
    """The bases of each (n x k)."""
    out, lo = np.empty((len(words), k), np.uint8), 0
    for i, w in enumerate(_widths(k)):
        for j in range(w):
            out[:, lo + j] = LETTERS[((words[:, i] >> U(2 * (w - 1 - j))) & U(3)).astype(np.uint8)]
        lo += w
    return out


def strings(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as strings."""
    n, k = rows.shape
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def repacked(text: np.ndarray, k: int) -> np.ndarray:
    """Rows of k bases as packed k-mers."""
    flat, at, lo = CODE[np.ascontiguousarray(text)].reshape(-1), np.arange(len(text)) * k, 0
    out = np.zeros((len(text), len(_widths(k))), U)
    for i, w in enumerate(_widths(k)):
        if len(text) and w:
            out[:, i] = _rolled(flat, w)[0][at + lo]
        lo += w
    return out


def turned(words: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed k-mers."""
    return repacked(LETTERS[3 - CODE[letters(words, k)][:, ::-1]], k)


def neighbours(fwd: np.ndarray, rev: np.ndarray, k: int) -> np.ndarray:
    """Canonical forms of all k-mers that differ from one of these in one base."""
    out = []
    widths = _widths(k)
    place = [(p, 2 * (w - 1 - j)) for p, w in enumerate(widths) for j in range(w)]
    for j in range(k):
        (p, a), (q, b) = place[j], place[k - 1 - j]
        for x in (1, 2, 3):  # a change of a base flips the same bits of its complement
            f, r = fwd.copy(), rev.copy()
            f[:, p] ^= U(x << a)
            r[:, q] ^= U(x << b)
            out.append(smaller(f, r)[0])
    return np.concatenate(out) if out else fwd[:0]


@dataclass
class Block:
    """Consecutive sequences, or a piece of a long one."""

    rows: np.ndarray  # the row of each
    base: np.ndarray  # where in its row each begins
    buf: np.ndarray
    offs: np.ndarray


def blocks(column: pa.Array, k: int, size: int = CHUNK) -> Iterator[Block]:
    """A string column in blocks of about ``size`` bytes; pieces of one sequence overlap in k - 1 bases."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        if offs[lo + 1] - offs[lo] > size:
            for at in range(int(offs[lo]), int(offs[lo + 1]) - k + 1, size):
                piece = buf[at : min(at + size + k - 1, int(offs[lo + 1]))]
                yield Block(np.array([lo]), np.array([at - offs[lo]]), piece, np.array([0, len(piece)]))
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        over = np.flatnonzero(np.diff(offs[lo : hi + 1]) > size)
        hi = lo + int(over[0]) if len(over) else min(hi, n)
        yield Block(np.arange(lo, hi), np.zeros(hi - lo, np.int64), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def _kept(batch: pa.RecordBatch, keep: int, out: pa.Schema, rows: np.ndarray) -> list[pa.Array]:
    at = pa.array(rows)
    return [batch.column(i + 1).take(at).cast(out[i].type) for i in range(keep)]


def kmer_codes(seqs: DataFrame, k: int, keep: list[str] | None = None, seq: str = "seq", every: int = 1, probe: tuple[int, bool] | None = None) -> DataFrame:
    """One row for each valid window: the ``keep`` columns, pos (from 0), canon and flipped.

    ``every`` takes windows at multiples only.  ``probe`` is (step, last) and takes every
    ``step``-th window, or an eighth of the windows (1 to 8) with step 0, and the last one
    too if ``last``.  Null and shorter sequences give none.
    """
    keep = keep or []
    schema = T.StructType([*(seqs.schema[c] for c in keep), T.StructField("pos", T.IntegerType()), T.StructField("canon", key_type(k)), T.StructField("flipped", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(0).fill_null("")
            size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else []
            for b in blocks(column, k):
                at, fwd, rev = windows(b.buf, b.offs, k)
                own = np.searchsorted(b.offs, at, "right") - 1
                pos, row = at - b.offs[own] + b.base[own], b.rows[own]
                if every > 1:
                    some = pos % every == 0
                elif probe is not None:
                    span = size[row].astype(np.int64) - k
                    some = pos % (probe[0] or np.clip(span // 8, 1, 8)) == 0
                    some |= probe[1] & (pos == span)
                else:
                    some = slice(None)
                pos, row = pos[some], row[some]
                canon, flipped = smaller(fwd[some], rev[some])
                yield pa.RecordBatch.from_arrays([*_kept(batch, len(keep), out, row), pa.array(pos.astype(np.int32)), to_arrow(canon, k), pa.array(flipped)], schema=out)

    return seqs.select(seq, *keep).mapInArrow(run, schema)


def _distinct(words: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct (row, k-mer) and how often each comes."""
    by = [words[:, i] for i in range(words.shape[1])][::-1]
    order = np.lexsort([*by, row] if row is not None else by)
    w = words[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]).any(1)
    if row is not None:
        fresh[1:] |= row[order][1:] != row[order][:-1]
    at = np.flatnonzero(fresh)
    return order[at], np.diff(np.append(at, len(w)))


def kmer_tallies(seqs: DataFrame, k: int, keep: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keep, canon, n): canonical k-mers of each row and how often they come, counted within each block.

    Without ``keep`` they are counted over whole blocks.  A k-mer of a long sequence may come
    in several rows, which a sum brings together.
    """
    keep = keep or []
    schema = T.StructType([*(seqs.schema[c] for c in keep), T.StructField("canon", key_type(k)), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for b in blocks(batch.column(0), k):
                at, fwd, rev = windows(b.buf, b.offs, k)
                canon = smaller(fwd, rev)[0]
                row = b.rows[np.searchsorted(b.offs, at, "right") - 1] if keep else None
                if row is None and canon.shape[1] == 1:
                    words, n = np.unique(canon[:, 0], return_counts=True)
                    words = words.reshape(-1, 1)
                else:
                    first, n = _distinct(canon, row)
                    words, row = canon[first], None if row is None else row[first]
                yield pa.RecordBatch.from_arrays([*(_kept(batch, len(keep), out, row) if keep else []), to_arrow(words, k), pa.array(n.astype(np.int64))], schema=out)

    return seqs.select(seq, *keep).mapInArrow(run, schema)


def _mapped(df: DataFrame, column: str, schema: T.StructType, fn) -> DataFrame:
    """The table with one column made anew, a batch at a time."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            arrays = [fn(c) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, k: int, column: str = "kmer") -> DataFrame:
    """Packed k-mers as strings."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == column else f for f in df.schema])
    return _mapped(df, column, schema, lambda c: strings(letters(from_arrow(c, k), k)))


def encoded(df: DataFrame, k: int, column: str = "kmer") -> DataFrame:
    """Strings of k bases as packed k-mers."""
    schema = T.StructType([T.StructField(f.name, key_type(k)) if f.name == column else f for f in df.schema])

    def fn(c: pa.Array) -> pa.Array:
        parts = [windows(b.buf, b.offs, k)[1] for b in blocks(c, k)]
        return to_arrow(np.concatenate(parts) if parts else np.zeros((0, len(_widths(k))), U), k)

    return _mapped(df, column, schema, fn)


def pack_bases(seq: str) -> bytes:
    """Four bases a byte, the first one highest; what is not ACGT is left out."""
    codes = CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    codes = codes[codes < 4]
    codes = np.concatenate((codes, np.zeros(-len(codes) % 4, np.uint8))).reshape(-1, 4)
    return (codes @ np.array([64, 16, 4, 1], np.uint8)).astype(np.uint8).tobytes()


def unpack_bases(packed: bytes, length: int) -> str:
    """The bases of what ``pack_bases`` made."""
    b = np.frombuffer(packed, np.uint8)[:, None]
    return LETTERS[(b >> np.array([6, 4, 2, 0], np.uint8)) & 3].reshape(-1)[:length].tobytes().decode()


def pack_reads(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """The table with ``seq`` as (packed, n_bases); only ACGT are kept."""
    rest = [f for f in reads.schema if f.name != seq]
    schema = T.StructType([*rest, T.StructField("packed", T.BinaryType()), T.StructField("n_bases", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(len(rest)).fill_null("").to_pylist()
            sizes = [sum(t.count(c) for c in "ACGTacgt") for t in texts]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[: len(rest)], out, strict=False)), pa.array([pack_bases(t) for t in texts], pa.binary()), pa.array(sizes, pa.int32())], schema=out)

    return reads.select(*(f.name for f in rest), seq).mapInArrow(run, schema)


def unpack_reads(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """The table of ``pack_reads`` with its sequences, in upper case."""
    rest = [f for f in reads.schema if f.name not in ("packed", "n_bases")]
    schema = T.StructType([*rest, T.StructField(seq, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts = [unpack_bases(p, n) for p, n in zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[: len(rest)], out, strict=False)), pa.array(texts, pa.string())], schema=out)

    return reads.select(*(f.name for f in rest), "packed", "n_bases").mapInArrow(run, schema)
