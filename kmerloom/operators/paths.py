"""Unambiguous paths of k-mers, made where the k-mers around a junction meet.

A junction is the k - 1 bases between two k-mers.  A k-mer is in the bucket of the junction
at either end, so all k-mers at a junction meet in its bucket and its degrees are known there.
A bucket gives the pieces of paths over its own junctions.  Where a path goes on in another
bucket, its piece there begins with the same k-mer, and over that k-mer they are joined.

A piece has its bases, one strand of two; the kind of its left and right end; the canonical
k-mer of an open end, and whether the piece has its other strand; and the counts of its k-mers
and their number, each once for each of its ends that lies in the bucket, so that joined
pieces hold everything twice.  A palindrome ends a path, which goes back from there
over its other strand; it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seq as S
from . import packed, runs

U = np.uint64

CLOSED, OPEN, MIRROR, LOOP = 0, 1, 2, 3  # kinds of ends; a cycle has LOOP at both and its first k - 1 bases again at its end
AT_ONCE = 1 << 20  # k-mers of a bucket whose junctions are looked at together; more take several passes over shares of the junctions
SPELLED = 1 << 13  # k-mers that are spelled at once
SENT = 1 << 14  # pieces in a batch


def schema(k: int) -> T.StructType:
    key = packed.key_type(k)
    kinds = {"bases": T.StringType(), "l": T.ByteType(), "r": T.ByteType(), "a": key, "a_turned": T.BooleanType(), "b": key, "b_turned": T.BooleanType(), "cnt": T.LongType(), "n": T.LongType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _turned(words: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed k-mers."""
    if k > packed.WORD:
        return packed.turned(words, k)
    x = ~words
    x = ((x >> U(2)) & U(0x3333333333333333)) | ((x & U(0x3333333333333333)) << U(2))
    x = ((x >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) | ((x & U(0x0F0F0F0F0F0F0F0F)) << U(4))
    return x.byteswap() >> U(64 - 2 * k)


def _ends(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last k - 1 bases of packed k-mers."""
    if k == 1:
        none = np.zeros((len(words), 1), U)
        return none, none
    if k <= packed.WORD:
        return words >> U(2), words & U((1 << (2 * (k - 1))) - 1)
    text = packed.letters(words, k)
    return packed.repacked(text[:, :-1], k - 1), packed.repacked(text[:, 1:], k - 1)


def buckets(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the first and of the last k - 1 bases of packed k-mers."""
    left, right = np.zeros(len(words), np.int16), np.zeros(len(words), np.int16)
    if k == 1:
        return left, right
    word = min(runs.WORD_BASES, k - 1)
    for lo in range(0, len(words), SPELLED):
        some = words[lo : lo + SPELLED]
        if k > packed.WORD:
            of = runs._buckets(packed.CODE[packed.letters(some, k)].reshape(-1), k - 1)
            at = np.arange(len(some)) * k
            left[lo : lo + SPELLED], right[lo : lo + SPELLED] = of[at], of[at + 1]
            continue
        # as there, but all k-mers by one of their words at a time
        fwd, rev, mask = some[:, 0], _turned(some, k)[:, 0], U((1 << (2 * word)) - 1)
        at = lambda i: (runs._mixed(np.minimum((fwd >> U(2 * (k - word - i))) & mask, (rev >> U(2 * i)) & mask)) >> U(32)).astype(np.uint32)  # noqa: B023, E731
        first, last = at(0), at(k - word)
        for i in range(1, k - word):
            low = at(i)
            first, last = np.minimum(first, low), np.minimum(last, low)
        left[lo : lo + SPELLED], right[lo : lo + SPELLED] = first % np.uint32(runs.BUCKETS), last % np.uint32(runs.BUCKETS)
    return left, right


def _numbers(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers for equal words, from 0, and how many there are."""
    if words.shape[1] == 1:
        found, number = np.unique(words[:, 0], return_inverse=True)
        return number, len(found)
    order = np.lexsort([words[:, i] for i in range(words.shape[1])][::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, int(fresh.sum())


def _ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head and rank of each node, and whether it is in a cycle, which is cut before its smallest node."""
    own = np.arange(len(before))

    def doubled(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.where(before < 0, own, before)
        rank, low = (before >= 0).astype(np.int64), np.minimum(own, at)
        for _ in range(max(len(before), 2).bit_length()):
            if (before[at] < 0).all():
                break
            rank, low, at = rank + rank[at], np.minimum(low, low[at]), at[at]
        return at, rank, low

    at, rank, low = doubled(before)
    looped = before[at] >= 0
    if looped.any():
        at, rank, _ = doubled(np.where(looped & (own == low), -1, before))
    return at, rank, looped


def pieces(words: np.ndarray, cnt: np.ndarray, k: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """The pieces over the junctions of a bucket, from all k-mers (distinct, canonical) that have one there."""
    of = np.stack(buckets(words, k), 1) == bucket
    shares = -(-len(words) // AT_ONCE)
    if shares <= 1:
        yield from _pieces(words, cnt, k, of)
        return
    share = np.empty(of.shape, np.int32)
    for side, x in enumerate(_ends(words, k)):
        x = packed.smaller(x, _turned(x, k - 1))[0] if k > 1 else x
        mixed = x[:, 0]
        for c in range(1, x.shape[1]):
            mixed = runs._mixed(mixed) ^ x[:, c]
        share[:, side] = runs._mixed(mixed) % U(shares)
    for i in range(shares):
        own = of & (share == i)
        some = own.any(1)
        yield from _pieces(words[some], cnt[some], k, own[some])


def _pieces(words: np.ndarray, cnt: np.ndarray, k: int, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pieces over those ends (first, last) of the k-mers that are ``own``."""
    n = len(words)
    if not n:
        return
    back = _turned(words, k)
    # node 2 i is a k-mer, node 2 i + 1 its other strand
    node = np.stack((words, back), 1).reshape(2 * n, -1)
    left = np.stack((own[:, 0], own[:, 1]), 1).reshape(-1)
    right = np.stack((own[:, 1], own[:, 0]), 1).reshape(-1)
    twice = np.flatnonzero((words == back).all(1))
    # a palindrome is entered as the one and left as the other
    right[2 * twice] = left[2 * twice + 1] = False
    first, last = _ends(node, k)
    src, dst = np.flatnonzero(right), np.flatnonzero(left)
    number, many = _numbers(np.concatenate((last[src], first[dst])))
    a, b = number[: len(src)], number[len(src) :]
    src_of, dst_of = np.zeros(many, np.int64), np.zeros(many, np.int64)
    src_of[a], dst_of[b] = src, dst
    sole = (np.bincount(a, minlength=many) == 1) & (np.bincount(b, minlength=many) == 1) & (src_of != dst_of) & (src_of != dst_of ^ 1)
    before = np.full(2 * n, -1, np.int64)
    before[dst_of[sole]] = src_of[sole]
    head, rank, looped = _ranked(before)
    order = np.lexsort((rank, head))
    begin = np.flatnonzero(rank[order] == 0)
    size = np.diff(np.append(begin, 2 * n))
    h, t = order[begin], order[begin + size - 1]
    # of the two strands of a path one stays: a cycle's head is its smallest node
    kept = np.where(looped[h], h % 2 == 0, h < t ^ 1)
    begin, size, h, t = begin[kept], size[kept], h[kept], t[kept]
    kind = lambda at, side: np.where(looped[at], LOOP, np.where(side[at], CLOSED, np.where(np.isin(at >> 1, twice), MIRROR, OPEN))).astype(np.int8)
    l, r = kind(h, left), kind(t, right)  # noqa: E741
    weight = left.astype(np.int64) + right
    for lo in range(0, len(h), SENT):
        part = slice(lo, lo + SENT)
        many = size[part]
        nodes = order[runs._spans(begin[part], many)]
        start = np.cumsum(many + k - 1) - (many + k - 1)
        text = np.empty(int((many + k - 1).sum()), np.uint8)
        text[start[:, None] + np.arange(k - 1)] = packed.letters(node[h[part]], k)[:, : k - 1]
        text[runs._spans(start + k - 1, many)] = packed.LETTERS[(node[nodes, -1] & U(3)).astype(np.uint8)]
        offs = np.append(start, len(text)).astype(np.int32)
        bases = pa.Array.from_buffers(pa.string(), len(many), [None, pa.py_buffer(offs), pa.py_buffer(text)])
        at = np.cumsum(many) - many
        sums = [np.add.reduceat(x, at) for x in (cnt[nodes >> 1] * weight[nodes], weight[nodes])]
        keys = []
        for node_of, kinds in ((h[part], l[part]), (t[part], r[part])):
            shown = pa.array(kinds == OPEN)
            keys += [pc.if_else(shown, packed.to_arrow(words[node_of >> 1], k), None), pc.if_else(shown, pa.array(node_of % 2 == 1), None)]
        yield pa.RecordBatch.from_arrays([bases, pa.array(l[part]), pa.array(r[part]), *keys, *(pa.array(x) for x in sums)], names=schema(k).names)


def of_reads(seqs: DataFrame, k: int, least: int, seq: str = "seq") -> DataFrame:
    """The pieces of the k-mers that come ``least`` times or more, counted where they are joined; k is ``runs.LEAST_K`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs._held(batches, k, 1):
            found = [(words, n) for _, _, words, n in runs._counts(held, k, least)]
            if found:
                yield from pieces(np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found]).astype(np.int64), k, held[0].bucket)

    return runs.dealt(seqs, k, None, seq, by_ends=True).mapInArrow(run, schema(k))


def of_counts(counts: DataFrame, k: int) -> DataFrame:
    """The pieces of ``counts(kmer, cnt)``, packed canonical k-mers, each once."""
    rows_of = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kmer", packed.key_type(k)), T.StructField("cnt", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = buckets(packed.from_arrow(batch.column(0), k), k)
            both = np.flatnonzero(left != right)
            rows = pa.array(np.concatenate((np.arange(len(left)), both)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((left, right[both])).astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], names=rows_of.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            words = np.concatenate([packed.from_arrow(b.column(1), k) for b in held])
            yield from pieces(words, np.concatenate([b.column(2).to_numpy() for b in held]), k, last)

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for at, end in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
                if held and bucket[at] != last:
                    yield from done()
                    held = []
                held.append(batch.slice(at, end - at))
                last = int(bucket[at])
        if held:
            yield from done()

    rows = counts.select("kmer", F.col("cnt").cast("long").alias("cnt")).mapInArrow(deal, rows_of)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema(k))


# Joining pieces

FEW = 100_000  # open pieces that are ranked instead of joined pair by pair


def _closed() -> Column:
    return (F.col("l") != OPEN) & (F.col("r") != OPEN)


def _facing(turned: Column) -> list[Column]:
    """The columns of a piece, of its other strand where ``turned``."""
    swap = lambda own, other, name: F.when(turned, other).otherwise(own).alias(name)
    c = F.col
    ends = [swap(c(x), c(y), x) for x, y in (("l", "r"), ("r", "l"), ("a", "b"), ("b", "a"))] + [swap(c(x), ~c(y), x) for x, y in (("a_turned", "b_turned"), ("b_turned", "a_turned"))]
    return [swap(c("bases"), S.revcomp("bases"), "bases"), *ends, c("cnt"), c("n")]


def _unlooped(df: DataFrame, k: int, loop: Column) -> DataFrame:
    """Pieces that meet themselves (``loop``), whose first k-mer is also their last, as cycles."""
    df = df.withColumn("_loop", loop)
    ends = {"l": F.lit(LOOP).cast("byte"), "r": F.lit(LOOP).cast("byte"), "bases": F.expr("left(bases, length(bases) - 1)")}
    return df.select(*(F.when(~F.col("_loop"), F.col(f)).otherwise(ends.get(f, F.lit(None))).alias(f) if f not in ("cnt", "n") else F.col(f) for f in schema(k).names))


def _met(open_: DataFrame, k: int, turn: int) -> DataFrame:
    """Open pieces after those that choose the same end are joined; each chooses the open end whose k-mer's hash is smaller.

    A third of the ends go in a round, whatever the length of a path.
    """
    a, b = F.col("a"), F.col("b")
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), c)
    p = open_.withColumn("_left", a.isNotNull() & (b.isNull() | (rank(a) <= rank(b))))
    p = p.withColumn("_key", F.when(F.col("_left"), a).otherwise(b)).withColumn("_turn", F.when(F.col("_left"), F.col("a_turned")).otherwise(F.col("b_turned")))
    # turned so that the end's k-mer is canonical: it ends what comes before and begins what comes after
    side = p.repartition("_key").select("_key", (F.col("_left") == F.col("_turn")).alias("_first"), F.struct(*_facing(F.col("_turn"))).alias("p"))
    both = side.groupBy("_key").agg(F.first(F.when(F.col("_first"), F.col("p")), True).alias("x"), F.first(F.when(~F.col("_first"), F.col("p")), True).alias("y"))
    x, y = F.col("x"), F.col("y")
    paired, one = x.isNotNull() & y.isNotNull(), F.coalesce(x, y)
    both_of = {"bases": F.concat(x["bases"], F.substring(y["bases"], k + 1, 1 << 30)), "cnt": x["cnt"] + y["cnt"], "n": x["n"] + y["n"]}
    both_of |= {c: x[c] for c in ("l", "a", "a_turned")} | {c: y[c] for c in ("r", "b", "b_turned")}
    out = both.select(*(F.when(paired, both_of[c]).otherwise(one[c]).alias(c) for c in schema(k).names))
    return _unlooped(out, k, F.coalesce((F.col("a") == F.col("b")) & (F.col("a_turned") == F.col("b_turned")), F.lit(False)))


def _chained(open_: DataFrame, k: int) -> DataFrame:
    """Open pieces joined at all their ends, by list ranking."""
    from .graph import cut, list_rank

    p = cut(open_.withColumn("id", F.monotonically_increasing_id() * 2))
    # (k-mer, node, whether it ends the node) for canonical k-mers; node id + 1 is the other strand
    left = p.filter("a IS NOT NULL").select(F.col("a").alias("key"), (F.col("id") + F.col("a_turned").cast("long")).alias("node"), F.col("a_turned").alias("ends"))
    right = p.filter("b IS NOT NULL").select(F.col("b").alias("key"), (F.col("id") + F.col("b_turned").cast("long")).alias("node"), (~F.col("b_turned")).alias("ends"))
    met = left.unionByName(right).groupBy("key").agg(F.max(F.when(F.col("ends"), F.col("node"))).alias("prev"), F.max(F.when(~F.col("ends"), F.col("node"))).alias("node"))
    links = cut(met.select("prev", "node").unionByName(met.select(F.expr("node ^ 1").alias("prev"), F.expr("prev ^ 1").alias("node"))))
    nodes = p.select(F.explode(F.array("id", F.col("id") + 1)).alias("node"))
    ranked = cut(list_rank(nodes, links))
    loops = ranked.select("head").distinct().join(links.select(F.col("node").alias("head")), "head").withColumn("_loop", F.lit(True))
    # of the two strands of a path one stays; a cycle's head is its smallest node
    ends = ranked.groupBy("head").agg(F.max_by("node", "rank").alias("tail")).join(loops, "head", "left")
    kept = ends.filter(F.when(F.col("_loop"), F.col("head") % 2 == 0).otherwise(F.col("head") < F.expr("tail ^ 1"))).select("head", F.coalesce("_loop", F.lit(False)).alias("_loop"))
    own = ranked.join(kept, "head").withColumn("id", F.expr("node - node % 2")).join(p, "id")
    parts = own.select("head", "_loop", "rank", *_facing(F.col("node") % 2 == 1))
    whole = parts.groupBy("head", "_loop").agg(F.sort_array(F.collect_list(F.struct("rank", "bases"))).alias("parts"), F.min_by("l", "rank").alias("l"), F.max_by("r", "rank").alias("r"), F.sum("cnt").alias("cnt"), F.sum("n").alias("n"))
    tail = F.array_join(F.transform(F.slice("parts", 2, 1 << 30), lambda x: F.substring(x["bases"], k + 1, 1 << 30)), "")
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema(k) if f.name[0] in "ab" and f.name != "bases"}  # no end is open
    return _unlooped(whole.withColumns({"bases": F.concat(F.col("parts")[0]["bases"], tail), **none}), k, F.col("_loop"))


def joined(parts: DataFrame, k: int, few: int | None = None) -> DataFrame:
    """Whole paths from their pieces: none has an open end."""
    from .graph import _remove, cut

    few = FEW if few is None else few
    now = cut(parts)
    whole = [now.filter(_closed())]
    open_, turn = now.filter(~_closed()), 0
    last = None
    while (left := open_.limit(few + 1).count()) > few:
        turn += 1
        now = cut(_met(open_, k, turn))
        if last is not None:
            _remove(parts.sparkSession, last)
        # what is whole by now stays
        whole.append(cut(now.filter(_closed())))
        open_, last = now.filter(~_closed()), now._cut_path
    if left:
        whole.append(_chained(open_, k))
    out = whole[0]
    for df in whole[1:]:
        out = out.unionByName(df)
    return out


def _smallest_turn(text: str, k: int) -> str:
    """A cycle's bases from its smallest k-mer on, the smaller strand."""
    n = len(text) - k + 1
    out = []
    for s in (text, text.translate(str.maketrans("ACGT", "TGCA"))[::-1]):
        at = min(range(n), key=lambda i: s[i : i + k])
        out.append((s[:n] * 2)[at : at + n])
        out[-1] += (out[-1] * (k // n + 1))[: k - 1]
    return min(y for x in out for y in (x, x.translate(str.maketrans("ACGT", "TGCA"))[::-1]))


def spelled(paths: DataFrame, k: int) -> DataFrame:
    """(sequence, mean_coverage, kmers_count) of whole paths, the smaller of both strands; a cycle starts at its smallest k-mer."""
    back = (F.col("l") == MIRROR) | (F.col("r") == MIRROR)
    facing = F.when(F.col("r") == MIRROR, F.col("bases")).otherwise(S.revcomp("bases"))
    there = F.when(back, F.concat(facing, F.substring(S.revcomp(facing), k + 1, 1 << 30))).otherwise(F.col("bases"))
    ring = (F.col("l") == MIRROR) & (F.col("r") == MIRROR)
    p = paths.withColumns({"_t": there, "_ring": ring | (F.col("l") == LOOP), "_back": back, "_two": ring})
    p = p.withColumn("bases", F.when(F.col("_two"), F.expr("left(_t, length(_t) - 1)")).otherwise(F.col("_t")))
    turn = F.udf(lambda s: _smallest_turn(s, k), "string")
    rest = ["cnt", "n", "_back"]
    flat = p.filter(~F.col("_ring")).select(F.least("bases", S.revcomp("bases")).alias("sequence"), *rest)
    rings = p.filter("_ring").select(turn("bases").alias("sequence"), *rest)
    out = flat.unionByName(rings)
    return out.select("sequence", (F.col("cnt") / F.col("n")).alias("mean_coverage"), F.when(F.col("_back"), F.col("n")).otherwise(F.expr("n div 2")).cast("long").alias("kmers_count"))
