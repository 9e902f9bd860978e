"""N-gram Jaccard join by T-occurrence search.

A document is a set of shingles, each of which names an inverted list.  If two documents
have a Jaccard similarity of t or more, they share at least T = ceil(t n) of the n shingles
of either.  DivideSkip splits the lists of a document in two.  All shingles stand in one
global order, rare ones first; the last T - l of a document's, whose lists are long, are left
out, and its other n - T + l are merged.  Two documents that match have l or more of the
merged lists in common, with the l of the smaller one.  The merge counts in how many lists
each pair meets, pairs that reach l are candidates, and these are probed by binary search,
shingle by shingle in whole sorted sets, and stay if they reach the required overlap.

The order is that of a sketch: how many documents have any shingle of the same bucket, of
``BUCKETS`` whatever the input, over all documents.  Shared buckets only make the order a bit
coarser; it is the same for every document, which is all that the count of lists rests on.
So a passage that many documents share makes no short list, only near copies do.

Groups of copies stay linear.  Equal sets are one class.  A first pass only links each
class to the head and the hub of each short list (stars), and a second pass only looks at pairs
whose components still differ, so nothing that could join two components is left out
and the pairs within one are not made for them.  Pairs whose parity maps prove too many
differences are passed over in both.  A hub of very many copies is dealt over tasks with its
set sent to each.  The links themselves all lie within components: who asks for them or for
their number has all pairs of classes of each component compared, dealt over tasks in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .arrowmap import tidy
from .graph import connected_components
from .planes import from_planes, to_planes
from .store import Scratch, batch_rows


def _shingles(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the text of each; a text with fewer words has its whole sequence."""
    starts, ends, bounds = textbuf.words(buf, offs)
    hashes = textbuf.word_hashes(buf, starts, ends)
    first, doc = textbuf.window_starts(bounds, width)
    full = textbuf.window_hashes(hashes, first, width)
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < width))
    whole = textbuf.window_hashes(hashes, bounds[short], n[short])
    return np.concatenate((full, whole)), np.concatenate((doc, short))


def _shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in the order of their hash, and n + 1 bounds."""
    h, doc = _shingles(textbuf.lower(buf), offs, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(offs)))


BUCKETS = 1 << 20
_SEGMENTS = 64
_SLOTS = 256


def _common(n: np.ndarray | Column, num: int, den: int, integer, least) -> tuple:
    """Of n shingles those that a match may lack, and l, the merged lists that a match has at least; both rise with n."""
    lacks = integer((den - num) * n / den)
    return lacks, least(1 + integer((lacks + 1) / 4), n - lacks)


def _frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """How common the shingles of each bucket are, in eighths of a power of two; one byte for each of ``BUCKETS``.

    A task sends its whole sketch as ``_SEGMENTS`` rows; these are added up over at most
    ``_SLOTS`` tasks' shares at first and then as a whole, so no group grows with the input.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buf, offs in textbuf.chunks(batch.column(0)):
                seen += np.bincount((_shingle_sets(buf, offs, width)[0] >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        slot = TaskContext.get().partitionId() % _SLOTS
        yield pa.RecordBatch.from_arrays([pa.array(range(_SEGMENTS), pa.int32()), pa.array([slot] * _SEGMENTS, pa.int32()), pa.array([to_planes(x) for x in np.split(seen, _SEGMENTS)], pa.binary())], names=["segment", "slot", "seen"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([from_planes(x) for x in group.column("seen")], axis=0)
        return pa.table({"segment": group.column("segment")[:1], "slot": pa.array([0], pa.int32()), "seen": pa.array([to_planes(total)], pa.binary())})

    schema = "segment int, slot int, seen binary"
    shares = docs.select("text").mapInArrow(tidy(tally), schema).groupBy("segment", "slot").applyInArrow(add, schema)
    total = sorted((r.segment, from_planes(pa.scalar(r.seen))) for r in shares.groupBy("segment").applyInArrow(add, schema).collect())
    seen = np.concatenate([x for _, x in total]) if total else np.zeros(BUCKETS, np.int64)
    return np.minimum(np.round(8 * np.log2(1 + seen)), 255).astype(np.uint8)


MAP_LONGS = 8
MAPS = [f"m{i}" for i in range(MAP_LONGS)]


def _parity_maps(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * MAP_LONGS for each set, in which every shingle flips the bit of its hash.

    Bits in which two maps differ are shingles of one set only, so there are at most as
    many as differences: a lower bound on these that costs a few machine words.
    """
    width = 64 * MAP_LONGS
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = doc * width + (h & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=(len(bounds) - 1) * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, width), axis=1).view(np.int64).reshape(-1, MAP_LONGS)


@dataclass
class JaccardJoin:
    """What the join found; all tables are distributed.

    members: key, n_shingles, class_id (smallest key with the same set), component_id
    links: a < b, overlap for every two classes that match; made when it is read
    counted: members and n_links, the number of other documents that match (those of the same class
        too; 0 for a null key); made when it is read, without rows for pairs
    """

    members: DataFrame
    links: DataFrame
    counted: DataFrame


CROWD = 64  # pairs of one document that a task takes at most
BLOCK = 512  # classes of a component that are compared with as many others in one task
_COLUMNS = 4096


def _overlaps(values: np.ndarray, offs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared values of each row of ``left`` with each of ``right`` (rows of sets), as products of incidence matrices."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    _, column = np.unique(values, return_inverse=True)
    place = np.full((2, len(offs) - 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    seen = [np.bincount(column[p[row] >= 0], minlength=int(column.max(initial=-1)) + 1) for p in place]
    shared = (seen[0] > 0) & (seen[1] > 0)
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared.sum()), _COLUMNS):
        at = slice(*np.searchsorted(column, (lo, lo + _COLUMNS)))
        sides = []
        for p, rows in zip(place, (left, right), strict=True):
            side = np.zeros((len(rows), min(_COLUMNS, int(shared.sum()) - lo)), np.float32)
            mine = p[row[at]] >= 0
            side[p[row[at]][mine], column[at][mine] - lo] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def ngram_jaccard_join(docs: DataFrame, width: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> JaccardJoin:
    """Components of documents whose word ``width``-gram sets have a Jaccard similarity of ``threshold`` or more.

    Words are runs of characters outside 0x20 and 0x09-0x0D, with A-Z in lower case.  A
    document with fewer words than ``width`` has its whole sequence as its one shingle.  A
    null text or one without words has an empty set, is linked with nothing and is a
    component of its own.  Rows with the same key are one document to the links, and if
    their texts differ, the smallest set (then the smallest hash) stands for all of them; a
    null key stays unlinked unless its set equals that of another.  An empty table gives
    empty results, a text of any length is taken as a whole, and columns beside key and text
    are not read, whatever their names.  Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    t = Fraction(str(threshold))
    num, den = t.numerator, t.denominator
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    shared = spark.sparkContext.broadcast(_frequencies(docs, width))  # BUCKETS bytes

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = shared.value
        for batch in batches:
            for lo, hi, buf, offs in textbuf.chunks(batch.column(1)):
                h, bounds = _shingle_sets(buf, offs, width)
                n = np.diff(bounds)
                keys = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    upto = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(textbuf.mix(h ^ np.uint64(salt)), out=upto[1:])
                    keys.append((upto[bounds[1:]] - upto[bounds[:-1]]).view(np.int64))
                lacks, least = _common(n, num, den, lambda x: np.floor(x).astype(np.int64), np.minimum)
                # a set that no other than its equal can match needs no list
                merged = np.where(n * den // num > n, np.minimum(lacks + least, n), 0)
                doc = np.repeat(np.arange(len(n)), n)
                rare = np.argsort((doc << 8) | order_of[(h >> np.uint64(44)).astype(np.int64)], kind="stable")
                names = h[rare][np.arange(len(h)) - bounds[doc] < merged[doc]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(merged))).astype(np.int32)), pa.array(names.view(np.int64)))
                maps = _parity_maps(h, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, keys), pa.array(n.astype(np.int64)), lists, *(pa.array(maps[:, i]) for i in range(MAP_LONGS))], names=["id", "ka", "kb", "n", "short", *MAPS])

    feats = scratch.write(docs.mapInArrow(tidy(features), "id long, ka long, kb long, n long, short array<long>, " + ", ".join(f"{m} long" for m in MAPS)))
    # of a key with several texts the smallest set stands for all of its rows
    own = F.struct("n", "ka", "kb")
    several = feats.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(own).alias("one"), F.max(own).alias("last")).filter("one != last").select(F.col("id").alias("_id"), F.col("one.ka").alias("_ka"), F.col("one.kb").alias("_kb"))
    several = scratch.write(several)
    settled = lambda df: df.join(several, F.col("id") == F.col("_id"), "left").filter("_id IS NULL OR (ka = _ka AND kb = _kb)").drop("_id", "_ka", "_kb")
    filled = settled(feats.filter("n > 0 AND id IS NOT NULL"))
    classes = scratch.write(filled.groupBy("ka", "kb").agg(F.min("id").alias("class_id")))
    reps = filled.join(classes.select(F.col("class_id").alias("id")), "id", "left_semi")

    # Short lists, each streamed in order of size: only lists of two or more are kept, with the head of each stretch that it can match.
    def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = head = head_n = None
        held: tuple | None = None  # a lone first row
        for batch in batches:
            tok, rep, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(tok):
                continue
            lead = 0
            if held is not None and held[0] == tok[0]:
                tok, rep, n = (np.concatenate(([x], y)) for x, y in zip(held, (tok, rep, n), strict=True))
            elif token is not None and held is None and token == tok[0]:
                lead = 1  # goes on a list whose head is known
            first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            ends = np.concatenate((first[1:], [len(tok)]))
            heads, head_ns = np.repeat(rep[first], ends - first), np.repeat(n[first], ends - first)
            if lead:
                heads[: ends[0]], head_ns[: ends[0]] = head, head_n
            late = np.unique(np.searchsorted(first, np.flatnonzero(den * head_ns < num * n), "right") - 1)
            for r in late.tolist():  # sizes that outgrow the head start the next stretch
                at, end = int(first[r]), int(ends[r])
                while at < end:
                    beyond = at + int(np.searchsorted(n[at:end] * num > den * head_ns[at], True))
                    if beyond < end:
                        heads[beyond:end], head_ns[beyond:end] = rep[beyond], n[beyond]
                    at = beyond
            keep = np.repeat(ends - first > 1, ends - first)
            if lead:
                keep[: ends[0]] = True
            token, head, head_n = tok[-1], heads[-1], head_ns[-1]
            lone = ends[-1] - first[-1] == 1 and not (lead and len(first) == 1)
            held = (tok[-1], rep[-1], n[-1]) if lone else None
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (tok, rep, n, heads, head_ns)], names=["token", "rep", "n", "head", "head_n"])

    entries = reps.select(F.col("id").alias("rep"), "n", F.explode("short").alias("token")).select("token", "rep", "n")
    entries = entries.repartition("token").sortWithinPartitions("token", "n", "rep")
    lists = scratch.write(entries.mapInArrow(tidy(lists_of), "token long, rep long, n long, head long, head_n long"))
    small = scratch.write(feats.drop("short", *MAPS))
    maps = scratch.write(reps.select(F.col("id").alias("rep"), *MAPS).join(lists.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"]))
    scratch.drop(feats)
    feats = small
    scratch.reclaim()

    # in how many merged lists both must stand, by the smaller set
    hits = lambda n: F.col("hits") >= _common(n, num, den, F.floor, F.least)[1]
    # Whole sets, only of what stands in as many lists as its smallest match would need; sorted by hash for the probes.
    busy = lists.groupBy("rep").agg(F.count("*").alias("hits"), F.first("n").alias("n")).filter(hits(F.floor(num * F.col("n") / den))).select("rep")
    busy = scratch.write(busy)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in textbuf.chunks(batch.column(1)):
                h, bounds = _shingle_sets(buf, offs, width)
                lists_ = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                key_of = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    upto = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(textbuf.mix(h ^ np.uint64(salt)), out=upto[1:])
                    key_of.append((upto[bounds[1:]] - upto[bounds[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, key_of), lists_], names=["rep", "ka", "kb", "tokens"])

    wanted = busy.select(F.col("rep").alias("id"))
    sets = docs.join(wanted, "id", "left_semi").mapInArrow(tidy(sets_of), "rep long, ka long, kb long, tokens array<long>")
    sets = sets.join(several, F.col("rep") == F.col("_id"), "left").filter("_id IS NULL OR (ka = _ka AND kb = _kb)")
    sets = scratch.write(sets.select("rep", "tokens").dropDuplicates(["rep"]))
    scratch.reclaim()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for i in (2, 3):
                column = batch.column(i)
                offs = column.offsets.to_numpy()
                sides.append((column.values.to_numpy().view(np.uint64), offs))
            (va, oa), (vb, ob) = sides
            overlap = np.zeros(batch.num_rows, np.int64)
            for r in range(batch.num_rows):
                a, b = va[oa[r] : oa[r + 1]], vb[ob[r] : ob[r + 1]]
                if len(a) > len(b):
                    a, b = b, a
                if len(a):
                    overlap[r] = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
            total = np.diff(oa) + np.diff(ob)
            keep = (num + den) * overlap >= num * total
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(overlap[keep])], names=["a", "b", "overlap"])

    def attach(pairs: DataFrame, side: DataFrame) -> DataFrame:
        """Pairs (a, b) with the columns of ``side`` for either end; an end of many pairs is dealt over tasks."""
        written = pairs
        for end, other in (("a", "b"), ("b", "a")):
            crowd = written.groupBy(end).agg(F.ceil(F.count("*") / CROWD).alias("_parts")).filter("_parts > 1")
            salted = pairs.join(crowd, end, "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1)))).drop("_parts")
            spread = side.withColumnRenamed("rep", end).join(crowd, end, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
            named = [F.col(c).alias(f"{c}_{end}") for c in side.columns if c != "rep"]
            pairs = salted.join(spread.select(end, "_salt", *named), [end, "_salt"]).drop("_salt")
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        both = attach(pairs, sets).select("a", "b", "tokens_a", "tokens_b")
        with batch_rows(spark, 128):  # a row holds two whole sets
            return scratch.write(both.mapInArrow(tidy(probe), "a long, b long, overlap long"))

    # Two stars for each list: its head, and its hub, the member that stands in the longest lists.  An original is the
    # hub of its copies, even where these are too far from one another.
    sizes = lists.groupBy("token").agg(F.count("*").alias("size"))
    central = lists.join(sizes, "token").groupBy("rep").agg(F.sum("size").alias("central"), F.first("n").alias("n"))
    hubs = lists.select("token", "rep").join(central, "rep").groupBy("token").agg(F.max(F.struct("central", F.negate("rep").alias("r"), "n")).alias("h"))
    spokes = lists.join(hubs, "token").select("rep", (-F.col("h.r")).alias("head"), F.least("n", "h.n").alias("n"))
    spokes = spokes.unionByName(lists.select("rep", "head", F.col("head_n").alias("n"))).filter("rep != head")
    tried = spokes.groupBy(F.col("rep").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("hits"), F.first("n").alias("n"))
    # either stands for some of the lists only, so a third of what a match has is enough here; the second pass settles the rest
    tried = tried.withColumn("hits", 3 * F.col("hits")).filter(hits(F.col("n"))).select("a", "b")
    sized = maps.join(busy, "rep", "left_semi").join(lists.select("rep", "n").distinct(), "rep")
    tried = attach(scratch.write(tried), sized)

    def near(n_x: Column, n_y: Column, x: str, y: str) -> Column:
        """Differences that the parity maps prove are no more than a match can have."""
        proved = sum((F.bit_count(F.col(x.format(m)).bitwiseXOR(F.col(y.format(m)))) for m in MAPS), F.lit(0))
        return (num + den) * proved <= (den - num) * (n_x + n_y)

    tried = scratch.write(tried.filter(near(F.col("n_a"), F.col("n_b"), "{}_a", "{}_b")).select("a", "b"))
    stars = verified(tried)
    edges = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    first = scratch.write(connected_components(edges(stars), scratch))

    # Second pass: lists that still hold more than one component.
    placed = lists.select("token", "rep", "n").join(busy, "rep", "left_semi").join(first.select(F.col("v").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    open_ = scratch.write(placed.join(split, "token", "left_semi").join(maps, "rep"))
    x, y = open_.alias("x"), open_.alias("y")
    fits = (F.col("x.component") < F.col("y.component")) & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
    fits &= near(F.col("x.n"), F.col("y.n"), "x.{}", "y.{}")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits).groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    pairs = pairs.agg(F.count("*").alias("hits"), F.first(F.least("x.n", "y.n")).alias("n")).filter(hits(F.col("n"))).select("a", "b")
    known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    scratch.reclaim()
    across = verified(scratch.write(pairs.join(known, ["a", "b"], "left_anti")))
    joined = first.select("v", "component")
    if not across.isEmpty():
        place = joined.select("v", "component")
        ends = edges(across)
        for end in ("u", "v"):
            at = place.select(F.col("v").alias(end), F.col("component").alias("_c"))
            ends = ends.join(at, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        merged = scratch.write(connected_components(ends, scratch))
        # a component of the first pass moves on with its smallest member; single classes come in here
        moved = joined.join(merged.select(F.col("v").alias("component"), F.col("component").alias("_m")), "component", "left").select("v", F.coalesce("_m", "component").alias("component"))
        joined = scratch.write(moved.unionByName(merged.join(joined.select("v"), "v", "left_anti")))
    members = feats.join(several, F.col("id") == F.col("_id"), "left")
    members = members.select("id", F.coalesce("_ka", "ka").alias("ka"), F.coalesce("_kb", "kb").alias("kb"), F.col("n").alias("n_shingles")).join(classes, ["ka", "kb"], "left")
    members = members.withColumn("class_id", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "id")).otherwise(F.col("id")))
    members = members.join(joined.select(F.col("v").alias("class_id"), "component"), "class_id", "left")
    members = members.select(F.col("id").alias(key), "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))

    # Links: classes of a component in blocks by hash, and every two blocks together.
    sizes = settled(feats.filter("n > 0 AND id IS NOT NULL")).select("id", "ka", "kb").distinct().groupBy("ka", "kb").agg(F.count("*").alias("size"))
    sizes = sizes.join(classes, ["ka", "kb"]).select("class_id", "size")
    blocks = joined.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = joined.select(F.col("v").alias("rep"), "component").join(blocks, "component")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.join(sets, "rep").join(sizes.withColumnRenamed("class_id", "rep"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "rep", "block", "size", "tokens")

    def matches(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of both sides, whether each two match, and the overlaps; within one block each pair once."""
        tokens = group.column("tokens").combine_chunks()
        tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
        offs = tokens.offsets.to_numpy()
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        block = group.column("block").to_numpy()
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        overlap = _overlaps(tokens.values.to_numpy()[offs[0] : offs[-1]].view(np.uint64), offs - offs[0], left, right)
        n = np.diff(offs)
        match = (num + den) * overlap >= num * (n[left][:, None] + n[right][None, :])
        return left, right, np.triu(match, 1) if p == q else match, overlap

    def pairs_of(group: pa.Table) -> pa.Table:
        left, right, match, overlap = matches(group)
        x, y = np.nonzero(match)
        rep = group.column("rep").to_numpy()
        a, b = rep[left[x]], rep[right[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "overlap": overlap[x, y]})

    def counts_of(group: pa.Table) -> pa.Table:
        left, right, match, _ = matches(group)
        rep, size = group.column("rep").to_numpy(), group.column("size").to_numpy()
        return pa.table({"class_id": np.concatenate((rep[left], rep[right])), "linked": np.concatenate((match @ size[right], size[left] @ match))})

    together = dealt.groupBy("component", "p", "q")
    links = together.applyInArrow(pairs_of, "a long, b long, overlap long")
    linked = together.applyInArrow(counts_of, "class_id long, linked long").groupBy("class_id").agg(F.sum("linked").alias("linked"))
    counted = members.join(sizes, "class_id", "left").join(linked, "class_id", "left")
    n_links = F.when(F.col(key).isNull() | (F.col("n_shingles") == 0), F.lit(0)).otherwise(F.col("size") - 1 + F.coalesce("linked", F.lit(0)))
    return JaccardJoin(members, links, counted.select(*members.columns, n_links.cast("long").alias("n_links")))
