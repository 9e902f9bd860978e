"""Near-duplicate embeddings by collision counting on one-dimensional projections.

Unit vectors are projected on ``PROJECTIONS`` seeded orthonormal directions, and every
projection of a block of vectors is sorted.  The window centred on a query is a stretch of
ranks of that order, and each vector in it has collided with the query once.  Window and
least count of collisions are calibrated on pairs that stand at just the threshold, so that
a share ``recall`` of such pairs reaches the count; pairs that do are verified exactly.

The first projection also cuts the vectors into chunks of about equal size.  Two chunks meet
in one task if their ranges come within a window that practically no pair exceeds.  There are
eight chunks until one would hold more than ``CHUNK_ROWS`` (or ``CHUNK_FLOATS`` numbers), so
up to there the rows that are dealt grow with the vectors, and beyond with their square.  The
links of a task leave it as counts for each vector and a forest of edges, so a group of
copies of any size costs rows in proportion to its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .arrowmap import tidy
from .graph import connected_components
from .store import Scratch

PROJECTIONS = 24
CHUNK_ROWS = 16384
CHUNK_FLOATS = 1 << 23
CHUNKS = 8
BLOCK = 1024  # rows whose projections are sorted together
JITTER = 1e-9  # parts equal projections, so that any number of them can be cut


@dataclass
class Calibration:
    directions: np.ndarray  # one a column
    window: float
    least: int
    reach: float  # how far the first projections of a pair may be apart


@lru_cache(maxsize=64)
def calibrate(dim: int, threshold: float, recall: float = 0.9995, projections: int = PROJECTIONS, spread: float = 2.0, pairs: int = 20_000, seed: int = 7) -> Calibration:
    """Window and count for pairs of unit vectors with a cosine of ``threshold``.

    The difference of such a pair has a fixed length and, under random directions, any
    direction, so pairs drawn at random stand for all.
    """
    rng = np.random.default_rng(seed)
    m = min(projections, dim)
    directions, _ = np.linalg.qr(rng.standard_normal((dim, m)))
    length = np.sqrt(max(2 - 2 * threshold, 0))
    # the shares of a random unit vector in m orthonormal directions
    own = rng.standard_normal((pairs, m))
    rest = rng.chisquare(dim - m, pairs) if dim > m else 0.0
    shift = np.abs(length * own / np.sqrt((own**2).sum(1) + rest)[:, None])
    window = spread * length / np.sqrt(dim) + 1e-9
    counts = np.sort((shift <= window).sum(1))
    least = int(counts[int((1 - recall) * pairs)])
    return Calibration(directions, float(window), least, float(min(np.quantile(shift, 0.99995), length) + 2 * JITTER))


def _sorted_block(proj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every projection of a block in order, and the rank of each row in it; a projection a row."""
    order = np.argsort(proj, axis=0, kind="stable").T
    ranks = np.empty(order.shape, np.uint16)
    np.put_along_axis(ranks, order, np.arange(order.shape[1], dtype=np.uint16)[None, :], 1)
    return np.ascontiguousarray(np.take_along_axis(proj.T, order, 1)), ranks


def _collide(queries: np.ndarray, block: tuple[np.ndarray, np.ndarray], cal: Calibration) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows of the block that are in one another's windows often enough."""
    values, ranks = block
    m, window = len(values), np.float32(cal.window)
    spare = m - cal.least
    low = np.stack([np.searchsorted(values[j], queries[:, j] - window, "left") for j in range(m)]).astype(np.uint16)
    wide = np.stack([np.searchsorted(values[j], queries[:, j] + window, "right") for j in range(m)]).astype(np.uint16) - low
    misses = np.zeros((len(queries), ranks.shape[1]), np.int8)
    dense = min(m, 14)
    for j in range(dense):  # a rank before the window wraps round to a large number
        misses += (ranks[j][None, :] - low[j][:, None]) >= wide[j][:, None]
    a, b = np.nonzero(misses <= spare)
    left = misses[a, b]
    for j in range(dense, m):
        left = left + ((ranks[j][b] - low[j][a]) >= wide[j][a])
        keep = left <= spare
        a, b, left = a[keep], b[keep], left[keep]
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, by rounds of minimum and pointer jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _units(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of one length as unit vectors."""
    v = column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)
    v = v / np.abs(v).max(1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", embedding: str = "embedding", recall: float = 0.9995, chunk_rows: int = CHUNK_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Links between vectors with a cosine of ``threshold`` or more, in double precision.

    Returns key, n_links (other vectors linked directly), component_id (smallest key
    reachable by links) and kept (key = component_id).  No pair below the threshold is
    linked; of those above, a share of ``recall`` is found at least.  Vectors that are null,
    empty, zero or hold null or non-finite components are linked with nothing; vectors of
    different length have no cosine, and those of each length are searched among themselves.
    Equal vectors are linked with one another and go through the search once.  Keys are
    integers; a null key stays alone, and rows that repeat a key count as copies of it.  An
    empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    classes = scratch.write(plain.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            dims = np.diff(column.offsets.to_numpy())
            p = np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                p[at] = _units(column, at, dim) @ calibrate(dim, threshold, recall).directions[:, 0]
            p += JITTER * (textbuf.mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(11)) / 2.0**53
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(p)], names=["rep", "size", "v", "dim", "p"])

    placed = scratch.write(classes.select("rep", "size", "v").mapInArrow(tidy(place), "rep long, size long, v array<double>, dim int, p double"))
    found = dict(placed.groupBy("dim").count().collect())  # a row for each length of a vector

    def chunks_of(dim: int, n: int) -> int:
        most = max(1, min(chunk_rows, CHUNK_FLOATS // dim))
        return 1 if n <= min(most, BLOCK) else max(CHUNKS, -(-n // most))

    most = max((chunks_of(*x) for x in found.items()), default=1)
    cuts = {dim: np.zeros(0) for dim in found}
    if most > 1:
        by_rank = placed.groupBy("dim").agg(F.percentile_approx("p", [i / most for i in range(1, most)], max(10_000, 20 * most)))
        for dim, ladder in by_rank.collect():
            n = chunks_of(dim, found[dim])
            cuts[dim] = np.unique([ladder[most * i // n - 1] for i in range(1, n)])
    bounds = spark.sparkContext.broadcast(cuts)  # a number for each chunk

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to every pair of chunks that its own chunk is in and that it can reach."""
        for batch in batches:
            dims, p = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                at, cut, reach = np.flatnonzero(dims == dim), bounds.value[dim], calibrate(dim, threshold, recall).reach
                own = np.searchsorted(cut, p[at], "right")
                low, high = np.searchsorted(cut, p[at] - reach, "left"), np.searchsorted(cut, p[at] + reach, "right")
                again = np.repeat(np.arange(len(at)), high - low + 1)
                other = np.arange(len(again)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[again]
                own = own[again]
                for lo in range(0, len(again), 4096):
                    part = slice(lo, lo + 4096)
                    taken = batch.take(pa.array(at[again[part]]))
                    ends = [np.minimum(own[part], other[part]), np.maximum(own[part], other[part])]
                    yield pa.RecordBatch.from_arrays([taken.column(3), *(pa.array(e.astype(np.int32)) for e in ends), pa.array(own[part] > other[part]), *taken.columns[:3]], names=["dim", "c", "d", "second", "rep", "size", "v"])

    def link(table: pa.Table) -> pa.Table:
        dim, same = table.column("dim")[0].as_py(), table.column("c")[0] == table.column("d")[0]
        cal = calibrate(dim, threshold, recall)
        rep, size, second = (table.column(c).to_numpy() for c in ("rep", "size", "second"))
        order = np.lexsort((rep, second))
        rep, size, second = rep[order], size[order], second[order]
        unit = _units(table.column("v").combine_chunks(), order, dim)
        proj = (unit @ cal.directions).astype(np.float32)
        split = int((~second).sum())
        left, right = np.arange(split), np.arange(len(rep)) if same else np.arange(split, len(rep))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for to in range(0, len(right), BLOCK):
            y = right[to : to + BLOCK]
            block = _sorted_block(proj[y])
            for at in range(0, min(to + BLOCK, len(left)) if same else len(left), BLOCK):
                x = left[at : at + BLOCK]
                a, b = _collide(proj[x], block, cal)
                a, b = x[a], y[b]
                if same:
                    a, b = a[a < b], b[a < b]
                for k in range(0, len(a), 1 << 15):
                    i, j = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                    near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                    found_a.append(i[near])
                    found_b.append(j[near])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        links = np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
        root = _roots(len(rep), a, b)
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[root[some]]})

    pairs = placed.select("rep", "size", "v", "dim", "p").mapInArrow(tidy(deal), "dim int, c int, d int, second boolean, rep long, size long, v array<double>")
    links = scratch.write(pairs.groupBy("dim", "c", "d").applyInArrow(link, "rep long, links long, root long"))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    known = classes.select("v", "size", "rep").join(counts, "rep", "left").join(components.withColumnRenamed("v", "_v"), F.col("rep") == F.col("_v"), "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = plain.filter("v IS NOT NULL").join(known, "v").select("id", "n_links", "component_id")
    alone = plain.filter("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
