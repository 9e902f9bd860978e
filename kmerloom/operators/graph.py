"""The de Bruijn graph and its clean-up as joins, windows and list ranking."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import seq as S
from . import packed, paths, runs
from .kmers import _keyed, count_packed, mean_coverage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session may go without."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_SCOPES: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, so a lost executor costs only its own tasks.

    A table rather than a checkpoint: its plan starts without the constraints that an
    iteration would otherwise carry on and multiply.  It goes with its ``scope``, else with
    the driver.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_remove, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator:
    """Removes the tables that were cut inside when it ends, but for those given to what it yields."""
    _SCOPES.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        df = df if hasattr(df, "_cut_path") else cut(df)
        kept.append(df._cut_path)
        return df

    try:
        yield keep
    finally:
        paths = _SCOPES.pop()
        for path in paths:
            if path not in kept:
                _remove(spark, path)
        for path in kept:
            if _SCOPES:
                _SCOPES[-1].append(path)
            else:
                atexit.register(_remove, spark, path)


def numbered(df: DataFrame, by: list, then: list | None = None, name: str = "id", start: int = 0) -> DataFrame:
    """The rows with their number in an order, from ``start`` on, without a task that sees them all.

    Ranges of ``by`` are dealt to tasks and sorted there by ``then`` (which refines ``by``);
    each row's number is its place in its range after the rows of those before.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*(then or by)).withColumn("_place", F.monotonically_increasing_id())
    rows = cut(ranged).withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    # a row for each range
    ahead = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"))
    out = rows.join(F.broadcast(ahead), "_range").withColumn("_n", (F.col("_ahead") + F.col("_place") + start).cast("long"))
    return out.drop("_range", "_place", "_ahead", *([name] if name in df.columns else [])).withColumnRenamed("_n", name)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has gone first
        return


LOCAL_NODES = 4_000_000  # so many are ranked in one task, in some hundred MB; more stay distributed


def _ranked(node: pa.Array, prev: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The head (its row) and the rank of each node, by pointer doubling over arrays; a cycle is cut before its smallest node."""
    both = pa.concat_arrays([node, prev]).dictionary_encode()
    code = both.indices.fill_null(-1).to_numpy()
    row_of = np.full(len(both.dictionary), -1, np.int64)
    row_of[code[: len(node)]] = np.arange(len(node))
    before = np.where(code[len(node) :] >= 0, row_of[code[len(node) :]], -1)
    place = np.empty(len(node), np.int64)
    place[pc.sort_indices(node).to_numpy()] = np.arange(len(node))

    def doubled(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.where(before < 0, np.arange(len(before)), before)
        rank, low = (before >= 0).astype(np.int64), np.minimum(place, place[at])
        for _ in range(max(len(before), 2).bit_length()):
            rank, low, at = rank + rank[at], np.minimum(low, low[at]), at[at]
        return at, rank, low

    at, rank, low = doubled(before)
    looped = before[at] >= 0
    if looped.any():
        before = np.where(looped & (place == low), -1, before)
        at, rank, _ = doubled(before)
    return at, rank


def list_rank(nodes: DataFrame, links: DataFrame, max_rounds: int = 64, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(node, head, rank) of every node in its list.

    ``nodes(node)``, each once; ``links(prev, node)``: each node is at most once on either
    side.  Up to ``local_nodes`` nodes are ranked in one task.  More stay distributed: by
    pointer doubling a list of n takes about log2(n) rounds of one join.  A cycle has no
    head; it is cut before its smallest node.  Both ways give the same.
    """
    start = cut(nodes.join(links, "node", "left").select("node", "prev"))
    if start.limit(local_nodes + 1).count() <= local_nodes:
        kind = nodes.schema["node"].dataType
        schema = T.StructType([T.StructField("node", kind), T.StructField("head", kind), T.StructField("rank", T.LongType())])

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held:
                return
            node, prev = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            head, far = _ranked(node, prev)
            out = pa.table({"node": node, "head": node.take(pa.array(head)), "rank": far})
            yield from out.to_batches(1 << 16)

        return start.coalesce(1).mapInArrow(rank, schema)
    return _list_rank(start, links, max_rounds)


def _list_rank(start: DataFrame, links: DataFrame, max_rounds: int) -> DataFrame:
    start = start.select("node", F.col("prev").alias("anc"), F.least("node", F.coalesce("prev", "node")).alias("low"))
    heads = start.filter("anc IS NULL").select("node", "anc", F.lit(0).cast("long").alias("dist"), "low")
    state = start.filter("anc IS NOT NULL").select("node", "anc", F.lit(1).cast("long").alias("dist"), "low")
    left = state.count()
    open_ = left
    for done in range(1, max_rounds + 1):
        if not open_:
            break
        up = heads.unionByName(state).select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"))
        moved = state.join(up, "anc").select("node", F.coalesce("anc2", "anc").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), F.col("anc2").isNotNull().alias("_open"))
        moved = cut(moved)
        open_ = moved.filter("_open").count()
        if done > 1:
            _remove(start.sparkSession, last)
        last = moved._cut_path
        state = moved.drop("_open")
        # after 2**done steps whoever is on a list has reached its head; the others go round
        if 2**done > left:
            break
    first = heads.select(F.col("node").alias("head"))
    reached = state.join(first, F.col("anc") == F.col("head"), "left_semi").select("node", F.col("anc").alias("head"), F.col("dist").alias("rank"))
    out = heads.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("rank")).unionByName(reached)
    if not open_:
        return out
    looped = cut(state.join(first, F.col("anc") == F.col("head"), "left_anti"))
    if looped.isEmpty():
        return out
    inner = links.join(looped.select("node", "low"), "node").filter("node != low").select("prev", "node")
    again = cut(looped.select("node").join(inner, "node", "left").select("node", "prev"))
    return out.unionByName(_list_rank(again, inner, max_rounds))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (u, v): the smallest node reachable.

    Each round a node takes the smallest label of its neighbours, then the label of its label,
    so rounds are about the logarithm of the longest way.
    """
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u IS NOT NULL AND v IS NOT NULL").distinct())
    state = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(state.select(F.col("node").alias("v"), F.col("component").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        moved = cut(state.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "other").alias("component")))
        up = moved.select(F.col("node").alias("component"), F.col("component").alias("above"))
        after = cut(moved.join(up, "component").select("node", "was", F.least("component", "above").alias("component")))
        _remove(edges.sparkSession, state._cut_path)
        _remove(edges.sparkSession, moved._cut_path)
        state = after
        if after.filter("was != component").isEmpty():
            return after.select("node", "component")


# K-mer graph


def oriented(kmers: DataFrame, k: int) -> DataFrame:
    """(node, turned, canon, prefix, suffix, base, others): both strands of packed canonical k-mers.

    prefix and suffix are the packed k - 1 bases at either end, base the last one; other
    columns come along.  A palindrome is one node.
    """
    kmers = _keyed(kmers, k)
    rest = [f for f in kmers.schema if f.name != "kmer"]
    key, end = packed.key_type(k), packed.key_type(max(k - 1, 1))
    fields = [T.StructField("node", key), T.StructField("turned", key), T.StructField("canon", key), T.StructField("prefix", end), T.StructField("suffix", end), T.StructField("base", T.StringType())]
    schema = T.StructType([*fields, *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            fwd = packed.from_arrow(batch.column(0), k)
            rev = packed.turned(fwd, k)
            own = np.arange(len(fwd))
            second = np.flatnonzero((fwd != rev).any(1))
            node, turned, own = np.concatenate((fwd, rev[second])), np.concatenate((rev, fwd[second])), np.concatenate((own, second))
            text = packed.letters(node, k)
            base = packed.strings(np.ascontiguousarray(text[:, -1:]))
            arrays = [packed.to_arrow(node, k), packed.to_arrow(turned, k), packed.to_arrow(fwd[own], k)]
            arrays += [packed.to_arrow(packed.repacked(text[:, cut_], k - 1), k - 1) for cut_ in (slice(0, k - 1), slice(1, k))]
            arrays += [base, *(c.take(pa.array(own)) for c in batch.columns[1:])]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(arrays, out, strict=True)], schema=out)

    return kmers.select("kmer", *(f.name for f in rest)).mapInArrow(run, schema)


def junctions(nodes: DataFrame) -> DataFrame:
    """(over, n_in, n_out, src, src_turned, dst): how many nodes end and begin with the same k - 1 bases, and one of each.

    All that end so lead to all that begin so, so these counts are the degrees of them all,
    and no edge has to be made to know them.
    """
    none = F.lit(None).cast(nodes.schema["node"].dataType)
    ends = nodes.select(F.col("suffix").alias("over"), F.col("node").alias("src"), F.col("turned").alias("src_turned"), none.alias("dst"))
    starts = nodes.select(F.col("prefix").alias("over"), none.alias("src"), none.alias("src_turned"), F.col("node").alias("dst"))
    return ends.unionByName(starts).groupBy("over").agg(F.count("src").alias("n_in"), F.count("dst").alias("n_out"), F.min("src").alias("src"), F.min("src_turned").alias("src_turned"), F.min("dst").alias("dst"))


def adjacency(kmers: DataFrame, k: int) -> DataFrame:
    """(src, dst): oriented packed k-mers of the set that overlap in k - 1 bases.

    ``kmers(kmer)`` holds canonical forms; both strands of each are nodes.
    """
    nodes = oriented(kmers.select("kmer"), k)
    left = nodes.select(F.col("node").alias("src"), F.col("suffix").alias("over"))
    right = nodes.select(F.col("node").alias("dst"), F.col("prefix").alias("over"))
    return left.join(right, "over").select("src", "dst")


def out_degrees(kmers: DataFrame, k: int) -> DataFrame:
    """(out_degree, n_nodes): how many oriented k-mers have how many successors; those without any are left out."""
    at = junctions(oriented(kmers.select("kmer"), k)).filter("n_in > 0 AND n_out > 0")
    return at.groupBy(F.col("n_out").alias("out_degree")).agg(F.sum("n_in").alias("n_nodes"))


def unambiguous(nodes: DataFrame) -> DataFrame:
    """(prev, node): edges that are the only one out of their source and the only one into their target, but for those from a node to itself or to its own other strand."""
    sole = junctions(nodes).filter("n_in = 1 AND n_out = 1 AND src != dst AND dst != src_turned")
    return sole.select(F.col("src").alias("prev"), F.col("dst").alias("node"))


RANGE_BASES = 64


def _number(seqs: DataFrame) -> DataFrame:
    """ids from 0 in the order of length (longest first), then sequence."""
    size = F.negate(F.length("sequence"))
    out = numbered(seqs.select("sequence", "mean_coverage", "kmers_count"), [size, F.left("sequence", F.lit(RANGE_BASES))], [size, "sequence", F.desc("mean_coverage"), "kmers_count"])
    return out.select("id", "sequence", "mean_coverage", "kmers_count")


def unitigs(counts: DataFrame, k: int) -> DataFrame:
    """Maximal unambiguous paths of solid k-mers as (id, sequence, mean_coverage, kmers_count).

    ``counts(kmer, cnt)`` holds canonical forms, packed or as strings.  Each k-mer is in one
    unitig; of the two strands of a unitig the smaller sequence stays.  An isolated cycle
    starts at its smallest k-mer.  A unitig's sequence becomes one value, so it must fit in memory.
    """
    return _unitigs(paths.of_counts(_keyed(counts.select("kmer", "cnt"), k), k), k)


def unitigs_of(seqs: DataFrame, k: int, least: int, seq: str = "seq") -> DataFrame:
    """The ``unitigs`` of the k-mers that come ``least`` times or more; they are counted where they are joined."""
    if k < runs.LEAST_K:
        return unitigs(count_packed(seqs, k, seq).filter(F.col("cnt") >= least), k)
    return _unitigs(paths.of_reads(seqs, k, least, seq), k)


def _unitigs(pieces: DataFrame, k: int) -> DataFrame:
    with scope(pieces.sparkSession) as keep:
        return keep(_number(cut(paths.spelled(paths.joined(pieces, k), k))))


# Unitig graph


def overlaps(contigs: DataFrame, k: int) -> DataFrame:
    """(src, src_rc, dst, dst_rc): oriented contigs where the last k - 1 bases of one begin the other."""
    s = contigs.filter(F.length("sequence") >= k - 1)
    sides = s.select("id", F.lit(False).alias("rc"), "sequence").unionByName(s.select("id", F.lit(True).alias("rc"), S.revcomp("sequence").alias("sequence")))
    left = sides.select(F.col("id").alias("src"), F.col("rc").alias("src_rc"), F.right("sequence", F.lit(k - 1)).alias("over"))
    right = sides.select(F.col("id").alias("dst"), F.col("rc").alias("dst_rc"), F.left("sequence", F.lit(k - 1)).alias("over"))
    return left.join(right, "over").select("src", "src_rc", "dst", "dst_rc")


def clip_tips(contigs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Without contigs that are shorter than 2k and covered less than the threshold; where they stand doesn't matter."""
    return contigs.filter(~((F.length("sequence") < 2 * k) & (F.col("mean_coverage") < threshold)))


def end_key(k: int) -> Column:
    """The same for contigs between the same two ends, on either strand."""
    s = F.col("sequence")
    p, q = F.left(s, F.lit(k - 1)), F.right(s, F.lit(k - 1))
    there, back = F.concat_ws(":", p, q), F.concat_ws(":", S.revcomp(q), S.revcomp(p))
    return F.least(there, back)


def pop_bubbles(contigs: DataFrame, k: int, rna: bool = False) -> DataFrame:
    """Of contigs between the same ends the best stays: highest coverage, longest, first.

    Another goes if its length is within 2k of the best's or its coverage is half or less;
    in RNA mode only if its coverage is below 1.5 and its length within 1.
    """
    w = W.Window.partitionBy("_key").orderBy(F.desc("mean_coverage"), F.desc(F.length("sequence")), "id")
    c = contigs.withColumn("_key", F.when(F.length("sequence") >= k - 1, end_key(k)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))))
    c = c.withColumn("_n", F.row_number().over(w)).withColumn("_len", F.first(F.length("sequence")).over(w)).withColumn("_cov", F.first("mean_coverage").over(w))
    apart = F.abs(F.length("sequence") - F.col("_len"))
    if rna:
        goes = (F.col("mean_coverage") < 1.5) & (apart <= 1)
    else:
        goes = (apart <= 2 * k) | (F.col("_cov") / F.greatest("mean_coverage", F.lit(0.1)) >= 2.0)
    return c.filter((F.col("_n") == 1) | ~goes).drop("_key", "_n", "_len", "_cov")


def _sole_overlaps(contigs: DataFrame, k: int) -> DataFrame:
    """(prev, node): overlaps of k - 1 bases that are the only one of both sides to another contig; node is 2 id, or 2 id + 1 for the other strand.

    The ends meet over their canonical k - 1 bases, so no overlap of several is made.
    """
    node, p, q = F.col("id").cast("long") * 2, F.left("sequence", F.lit(k - 1)), F.right("sequence", F.lit(k - 1))
    end = lambda own, shown, n, ends: F.when(shown, F.struct(own.alias("over"), n.alias("node"), F.lit(ends).alias("ends")))
    s = contigs.filter(F.length("sequence") >= k - 1).select(node.alias("node"), p.alias("p"), S.revcomp(p).alias("rp"), q.alias("q"), S.revcomp(q).alias("rq"))
    p, rp, q, rq, n = (F.col(x) for x in ("p", "rp", "q", "rq", "node"))
    ends = s.select(F.explode(F.array(end(p, p <= rp, n, False), end(rp, rp <= p, n + 1, True), end(q, q <= rq, n, True), end(rq, rq <= q, n + 1, False))).alias("e")).filter("e IS NOT NULL").select("e.*")
    met = ends.groupBy("over").agg(F.collect_list(F.when(F.col("ends"), F.col("node"))).alias("s"), F.collect_list(F.when(~F.col("ends"), F.col("node"))).alias("d"))
    # a contig that overlaps itself is no choice; it has two ends here at most, so with a third there may be a sole other
    met = met.filter("size(s) BETWEEN 1 AND 3 AND size(d) BETWEEN 1 AND 3").select("over", "s", "d", F.explode("s").alias("prev")).select("over", "s", "d", "prev", F.explode("d").alias("node"))
    others = lambda side, own: F.size(F.filter(side, lambda x: F.shiftright(x, 1) != F.shiftright(own, 1)))
    sole = met.filter((F.shiftright("prev", 1) != F.shiftright("node", 1)) & (others("d", F.col("prev")) == 1) & (others("s", F.col("node")) == 1))
    # a palindrome has the other strand's already
    return sole.select(F.explode(F.array(F.struct("prev", "node"), F.when(F.col("over") != S.revcomp("over"), F.struct(F.expr("node ^ 1").alias("prev"), F.expr("prev ^ 1").alias("node"))))).alias("e")).filter("e IS NOT NULL").select("e.*")


def stitch(contigs: DataFrame, k: int) -> DataFrame:
    """Joins contigs over their sole overlaps of k - 1 bases; coverage is weighted by k-mers.

    All joins of a chain happen at once by list ranking; no contig is joined to itself.  Only
    contigs that are joined go through that.
    """
    contigs = cut(contigs)
    links = cut(_sole_overlaps(contigs, k))
    nodes = cut(links.select(F.col("prev").alias("node")).unionByName(links.select("node")).distinct())
    ranked = list_rank(nodes, links).withColumn("id", F.shiftright("node", 1))
    weighted = F.col("mean_coverage") * F.col("kmers_count")
    sides = ranked.join(contigs, "id").withColumn("s", F.when(F.col("node") % 2 == 1, S.revcomp("sequence")).otherwise(F.col("sequence")))
    parts = sides.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("rank", "s"))).alias("parts"), (F.sum(weighted) / F.sum("kmers_count")).alias("mean_coverage"), F.sum("kmers_count").alias("kmers_count"), F.min("id").alias("_least"))
    tails = F.array_join(F.transform(F.slice("parts", 2, 1 << 30), lambda p: F.substring(p["s"], k, 1 << 30)), "")
    spelled = parts.select(F.concat(F.col("parts")[0]["s"], tails).alias("sequence"), "mean_coverage", "kmers_count", "_least")
    # of the two strands of a chain the smaller stays; a contig on its own stays as it is
    best = spelled.groupBy("_least").agg(F.min("sequence").alias("sequence"), F.first("mean_coverage").alias("mean_coverage"), F.first("kmers_count").alias("kmers_count"))
    alone = contigs.join(nodes.select(F.shiftright("node", 1).alias("id")).distinct(), "id", "left_anti").withColumn("mean_coverage", weighted / F.col("kmers_count"))
    both = [x.select("sequence", "mean_coverage", F.col("kmers_count").cast("long").alias("kmers_count")) for x in (alone, best)]
    return _number(both[0].unionByName(both[1]))


def upper_median(df: DataFrame, column: str) -> float | None:
    """The value at 0-based rank n div 2 of the sorted column, without interpolation."""
    counted = df.groupBy(column).agg(F.count("*").alias("_n"))
    w = W.Window.orderBy(column).rowsBetween(W.Window.unboundedPreceding, 0)
    total = df.agg(F.count(column)).first()[0]
    row = counted.filter(F.col(column).isNotNull()).withColumn("_upto", F.sum("_n").over(w)).filter(F.col("_upto") > total // 2).orderBy(column).first()
    return None if row is None else row[0]


def simplify(contigs: DataFrame, k: int, min_coverage: float = 5.0, min_length: int = 0, rna: bool = False, max_rounds: int = 8) -> DataFrame:
    """Tips, bubbles and stitching until the number of contigs stays, then the length filter; ids anew."""
    current = contigs if hasattr(contigs, "_cut_path") else cut(contigs)
    n = current.count()
    for _ in range(max_rounds):
        if not n:
            break
        median = upper_median(current, "mean_coverage")
        threshold = min(min_coverage, 2.0) if rna else max(0.15 * median, min_coverage)
        with scope(contigs.sparkSession) as keep:
            current = keep(stitch(pop_bubbles(clip_tips(current, k, threshold), k, rna), k))
        after = current.count()
        if after == n:
            break
        n = after
    return length_filter(current, min_length)


def length_filter(contigs: DataFrame, min_length: int) -> DataFrame:
    """Contigs of ``min_length`` or more, renumbered from the longest on."""
    return _number(contigs.filter(F.length("sequence") >= min_length))


__all__ = ["adjacency", "clip_tips", "components", "cut", "end_key", "length_filter", "list_rank", "mean_coverage", "numbered", "out_degrees", "overlaps", "pop_bubbles", "scope", "simplify", "stitch", "unambiguous", "unitigs", "unitigs_of", "upper_median"]
