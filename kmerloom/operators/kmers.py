"""K-mer enumeration, counting, and the choice of the solid ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seq as S
from . import packed, runs


def kmer_rows(seqs: DataFrame, k: int, keep: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """One row for each valid window: the ``keep`` columns, pos (from 0), kmer and its canonical form as strings.

    Windows with an ambiguous base are left out, null and shorter sequences give none.
    ``packed.kmer_codes`` has the same in an eighth of the bytes, for what is joined or counted.
    """
    keep = keep or []
    schema = T.StructType([*(seqs.schema[c] for c in keep), T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType()), T.StructField("canon", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(0).fill_null("")
            for b in packed.blocks(column, k, 1 << 15):
                at, fwd, rev = packed.windows(b.buf, b.offs, k)
                own = np.searchsorted(b.offs, at, "right") - 1
                texts = [packed.strings(packed.letters(x, k)) for x in (fwd, packed.smaller(fwd, rev)[0])]
                kept = [batch.column(i + 1).take(pa.array(b.rows[own])).cast(out[i].type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array((at - b.offs[own] + b.base[own]).astype(np.int32)), *texts], schema=out)

    return seqs.select(seq, *keep).mapInArrow(run, schema)


def count_packed(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, cnt long): canonical k-mers, two bits a base (see ``packed``).

    From ``runs.LEAST_K`` bases on runs of windows are dealt and counted where they meet.
    Shorter ones are counted within each piece of an Arrow batch before the shuffle; the sums
    use Spark's partial aggregation.
    """
    if k >= runs.LEAST_K:
        return runs.counts(seqs, k, seq)
    return packed.kmer_tallies(seqs, k, seq=seq).groupBy(F.col("canon").alias("kmer")).agg(F.sum("n").alias("cnt"))


def count_kmers(seqs: DataFrame, k: int, seq: str = "seq", least: int = 1) -> DataFrame:
    """(kmer string, cnt long): canonical k-mers that come ``least`` times or more; only these are spelled out."""
    counts = count_packed(seqs, k, seq)
    return packed.decoded(counts.filter(F.col("cnt") >= least) if least > 1 else counts, k)


def seen_twice(counts: DataFrame) -> DataFrame:
    """K-mers that come twice or more; exact, where a filter of bits would let some more through."""
    return counts.filter("cnt >= 2")


def spectrum(counts: DataFrame) -> DataFrame:
    """(cnt, n_kmers): how many k-mers come how often."""
    return counts.groupBy("cnt").agg(F.count("*").alias("n_kmers"))


def _keyed(kmers: DataFrame, k: int) -> DataFrame:
    """K-mers in packed form, whatever form they come in."""
    return packed.encoded(kmers, k) if isinstance(kmers.schema["kmer"].dataType, T.StringType) else kmers


def boost_priors(counts: DataFrame, priors: DataFrame, k: int, min_coverage: float, seq: str = "sequence") -> DataFrame:
    """Packed counts with those of trusted sequences on top, each instance weighted by 4 * int(min_coverage), 50 at least."""
    weight = max(4 * int(min_coverage), 50)
    more = packed.kmer_tallies(priors, k, seq=seq).select(F.col("canon").alias("kmer"), (F.col("n") * weight).alias("cnt"))
    return _keyed(counts.select("kmer", "cnt"), k).unionByName(more).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def solid_cutoff(counts: DataFrame, min_coverage: float = 5.0) -> int:
    """Least count of a solid k-mer.

    Above a wanted coverage of 5 it follows from that.  Else, from 100 k-mers on and if the
    count at rank n * 95 / 100 is 30 or more, it is the valley of the histogram before the
    main peak; otherwise, or if the histogram doesn't rise again, 2.  Only the histogram, whose size depends on depth, is collected.
    """
    if min_coverage > 5:
        return int(max(0.35 * min_coverage, 2.0))
    bins = sorted((int(r[0]), int(r[1])) for r in spectrum(counts).collect())
    total = sum(n for _, n in bins)
    if total <= 100:
        return 2
    rank, top = total * 95 // 100, 0
    for value, n in bins:
        if rank < n:
            top = value
            break
        rank -= n
    if top < 30:
        return 2
    histogram = dict(bins)
    valley, low = 2, None
    for c in range(2, min(max(top // 4, 10), 35) + 1):
        h = histogram.get(c, 0)
        if low is None or h <= low:
            valley, low = c, h
        elif h > 2 * low and c > valley + 2:
            return valley
    return 2


def solid(counts: DataFrame, cutoff: int) -> DataFrame:
    return counts.filter(F.col("cnt") >= cutoff)


def solid_instances(seqs: DataFrame, solid_kmers: DataFrame, k: int, keep: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keep, pos, canon, flipped): k-mer instances whose canonical form, packed, is solid."""
    rows = packed.kmer_codes(seqs, k, keep, seq)
    return rows.join(_keyed(solid_kmers.select("kmer"), k).select(F.col("kmer").alias("canon")), "canon", "left_semi")


def solid_tallies(seqs: DataFrame, solid_kmers: DataFrame, k: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, n_solid): how many k-mer instances of each sequence are solid; those without any are left out."""
    own = packed.kmer_tallies(seqs, k, [key], seq)
    met = own.join(_keyed(solid_kmers.select("kmer"), k).select(F.col("kmer").alias("canon")), "canon", "left_semi")
    return met.groupBy(key).agg(F.sum("n").alias("n_solid"))


def mean_coverage(seqs: DataFrame, counts: DataFrame, k: int, key: str = "id", seq: str = "sequence") -> DataFrame:
    """(key, mean_coverage): mean count over a sequence's k-mers; one that is unknown counts 2."""
    rows = packed.kmer_tallies(seqs, k, [key], seq)
    known = rows.join(_keyed(counts.select("kmer", "cnt"), k).withColumnRenamed("kmer", "canon"), "canon", "left")
    return known.groupBy(key).agg((F.sum(F.coalesce("cnt", F.lit(2)) * F.col("n")) / F.sum("n")).alias("mean_coverage"))


# Error correction


BROADCAST_KMERS = 250_000  # a set of so many solid k-mers is sent to all tasks; a larger one is joined


def correct_read(read: str, k: int, is_solid, start: int = 0, once: bool = False) -> tuple[str, int, int]:
    """A read after single substitutions that make its windows solid, left to right, their number, and the window to go on from.

    A window that holds ACGT only and isn't solid is looked at: every substitution within it
    that makes it solid counts the solid windows over its place, after and before.  The one
    that gains the most wins if it gains any, the first of equals by place, then by base.
    Windows with another character are never solid and never looked at, so such characters
    stay; letters that aren't substituted keep their case.  ``is_solid`` is asked for
    windows of either strand in upper case.
    """
    bases, changed = read.upper(), 0
    n = len(bases) - k + 1
    if k < 1 or n < 1:
        return read, 0, 0
    kept = list(read)
    wrong = np.cumsum([0, *(c not in S.BASES for c in bases)])
    valid = (wrong[k:] == wrong[:-k]).tolist()
    solid = [v and is_solid(bases[i : i + k]) for i, v in enumerate(valid)]
    for at in range(start, n):
        if not valid[at] or solid[at]:
            continue
        window, best, most = bases[at : at + k], None, 0
        for offset, old in enumerate(window):
            pos = at + offset
            first, last = max(0, pos - k + 1), min(n - 1, pos)
            for base in S.BASES:
                if base == old or not is_solid(window[:offset] + base + window[offset + 1 :]):
                    continue
                near = bases[first:pos] + base + bases[pos + 1 : last + k]
                gain = sum(1 for i in range(first, last + 1) if valid[i] and is_solid(near[i - first : i - first + k])) - sum(solid[first : last + 1])
                if gain > most:
                    best, most = (pos, base), gain
        if best is not None:
            pos, base = best
            kept[pos] = base
            bases = bases[:pos] + base + bases[pos + 1 :]
            for i in range(max(0, pos - k + 1), min(n - 1, pos) + 1):
                solid[i] = valid[i] and is_solid(bases[i : i + k])
            changed += 1
            if once:
                return "".join(kept), changed, at + 1
    return "".join(kept), changed, n


def both_strands(kmers) -> frozenset[str]:
    """Canonical k-mers and their reverse complements."""
    turn = str.maketrans("ACGT", "TGCA")
    return frozenset(x for k in kmers for x in (k, k.translate(turn)[::-1]))


def _near(seqs: list, solid: list, start: list, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each read that has a window to look at, the packed k-mers one substitution from the windows around it."""
    for row, (text, own, at) in enumerate(zip(seqs, solid, start, strict=True)):
        buf = np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8)
        place, fwd, rev = packed.windows(buf, np.array([0, len(buf)]), k)
        canon = packed.smaller(fwd, rev)[0]
        known = {x.tobytes() for x in packed.from_arrow(pa.array([] if own is None else own, packed_arrow(k)), k)}
        open_ = np.array([p >= at and c.tobytes() not in known for p, c in zip(place.tolist(), canon, strict=True)], bool)
        if open_.any():
            wide = np.zeros(len(buf) + 1, np.int64)
            np.add.at(wide, np.maximum(place[open_] - k + 1, 0), 1)
            np.add.at(wide, np.minimum(place[open_] + k, len(buf)), -1)
            some = np.cumsum(wide)[place] > 0
            near = packed.neighbours(fwd[some], rev[some], k)
            yield row, near[packed._distinct(near)[0]]


def packed_arrow(k: int) -> pa.DataType:
    return pa.int64() if k <= packed.NARROW else pa.binary()


def correct_reads(reads: DataFrame, solid_kmers: DataFrame, k: int, key: str = "id", seq: str = "seq", broadcast_kmers: int = BROADCAST_KMERS) -> DataFrame:
    """(key, seq, changed): reads after error correction by ``correct_read``.

    A solid set of ``broadcast_kmers`` at most goes to every task.  A larger one stays
    distributed: a round joins the windows of the open reads to it, then the k-mers that are
    one substitution from windows around one that isn't solid, makes the next change of each
    read and goes on behind it, until no read changes.  Both give the same reads.  Null reads
    and those shorter than k stay as they are; repeated keys and null keys do no harm.
    """
    from .graph import cut

    spark, kind = reads.sparkSession, reads.schema[key].dataType.simpleString()
    solid = _keyed(solid_kmers.select("kmer"), k).distinct()
    if solid.limit(broadcast_kmers + 1).count() <= broadcast_kmers:
        shared = spark.sparkContext.broadcast(both_strands(r[0] for r in packed.decoded(solid, k).collect()))

        def whole(batches):
            known = shared.value.__contains__
            for pdf in batches:
                done = [correct_read(s, k, known) if s is not None else (None, 0, 0) for s in pdf[seq]]
                yield pdf.assign(**{seq: [d[0] for d in done], "changed": [d[1] for d in done]})

        return reads.select(key, seq).mapInPandas(whole, f"`{key}` {kind}, `{seq}` string, changed long")

    solid = cut(solid.withColumnRenamed("kmer", "canon"))
    key_sql = packed.key_type(k).simpleString()
    schema = f"`{key}` {kind}, `{seq}` string, changed long, _at long, _row long"
    pending = cut(reads.select(key, seq, F.lit(0).cast("long").alias("changed"), F.lit(0).cast("long").alias("_at"), F.monotonically_increasing_id().alias("_row")))
    finished: list[DataFrame] = []

    def near(batches):
        for pdf in batches:
            rows, codes = [], []
            for row, found in _near(list(pdf[seq]), list(pdf["_own"]), list(pdf["_at"]), k):
                rows += [pdf["_row"].iloc[row]] * len(found)
                codes += packed.to_arrow(found, k).to_pylist()
            yield pd.DataFrame({"_row": pd.Series(rows, dtype="int64"), "canon": pd.Series(codes, dtype="int64" if k <= packed.NARROW else object)})

    def step(batches):
        for pdf in batches:
            done = []
            for s, at, own, more in zip(pdf[seq], pdf["_at"], pdf["_own"], pdf["_more"], strict=True):
                codes = [*(own if own is not None else []), *(more if more is not None else [])]
                words = packed.from_arrow(pa.array(codes, packed_arrow(k)), k)
                known = both_strands(packed.strings(packed.letters(words, k)).to_pylist()).__contains__
                done.append(correct_read(s, k, known, int(at), True))
            yield pdf.drop(columns=["_own", "_more"]).assign(**{seq: [d[0] for d in done], "changed": pdf["changed"] + [d[1] for d in done], "_at": [d[2] for d in done]})

    while True:
        own = packed.kmer_tallies(pending, k, ["_row"], seq).select("_row", "canon").distinct().join(solid, "canon", "left_semi")
        held = cut(pending.join(own.groupBy("_row").agg(F.collect_list("canon").alias("_own")), "_row", "left"))
        wanted = held.select("_row", seq, "_at", "_own").mapInPandas(near, f"_row long, canon {key_sql}")
        more = wanted.join(solid, "canon", "left_semi").groupBy("_row").agg(F.collect_list("canon").alias("_more"))
        both = cut(held.join(more, "_row", "left").select(key, seq, "changed", "_at", "_row", "_own", "_more"))
        # a read without any solid neighbour can't change
        finished.append(both.filter("_more IS NULL").select(key, seq, "changed"))
        tried = cut(both.filter("_more IS NOT NULL").mapInPandas(step, schema))
        length = F.length(seq) - k + 1
        finished.append(tried.filter(F.col("_at") >= length).select(key, seq, "changed"))
        pending = tried.filter(F.col("_at") < length)
        if pending.isEmpty():
            break
    out = finished[0]
    for df in finished[1:]:
        out = out.unionByName(df)
    return out
