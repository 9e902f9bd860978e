"""Consensus polishing: reads vote on the bases of contigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seq as S
from . import packed
from .mapping import map_reads, polisher_anchors

BLOCK = 4096  # places of a contig that are tallied and compared together
SPREAD = 4  # tasks that share the reads of a block
VOTES = "contig long, pos int, a long, c long, g long, t long"


def lay_reads(reads: DataFrame, contigs: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(contig, length, start, s): the mapped reads in the contig's direction, laid without gaps at their first anchor.

    Windows at multiples of k div 2 + 1 are looked up.  ``start`` may lie before the contig
    and a read may reach beyond its end, which ``length`` tells.
    """
    at = map_reads(reads, polisher_anchors(contigs, k), k, key, step=k // 2 + 1)
    placed = reads.select(key, F.upper("seq").alias("seq")).join(at, key).join(contigs.select(F.col("id").alias("contig"), F.length("sequence").alias("length")), "contig")
    n = F.length("seq")
    # on the other strand, the window at read_pos starts at n - k - read_pos of the reverse complement
    start = F.when(F.col("same_strand"), F.col("contig_pos") - F.col("read_pos")).otherwise(F.col("contig_pos") - (n - k - F.col("read_pos")))
    return placed.select(F.col("contig").cast("long").alias("contig"), "length", start.alias("start"), F.when(F.col("same_strand"), F.col("seq")).otherwise(S.revcomp("seq")).alias("s"))


def pileup(laid: DataFrame) -> DataFrame:
    """(contig, pos, a, c, g, t): votes for each place of a contig that has any.

    Reads that start in one block of a contig meet in a few tasks, which add up their votes
    before they leave; bases other than ACGT and those outside the contig don't vote.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contig, length, start = (batch.column(i).to_numpy() for i in range(3))
            for b in packed.blocks(batch.column(3), 1):
                of = np.repeat(b.rows, np.diff(b.offs))
                pos = start[of] + np.arange(len(b.buf)) - np.repeat(b.offs[:-1], np.diff(b.offs)) + np.repeat(b.base, np.diff(b.offs))
                code = packed.CODE[b.buf]
                some = (code < 4) & (pos >= 0) & (pos < length[of])
                names, at = np.unique(contig[of[some]], return_inverse=True)
                # a contig's number among those of the piece, the place and the base in one key
                key, n = np.unique((at.astype(np.int64) << 34) | (pos[some].astype(np.int64) << 2) | code[some], return_counts=True)
                place, row = np.unique(key >> 2, return_inverse=True)
                votes = np.zeros((len(place), 4), np.int64)
                votes[row, key & 3] = n
                yield pa.RecordBatch.from_arrays([pa.array(names[place >> 32]), pa.array((place & ((1 << 32) - 1)).astype(np.int32)), *(pa.array(votes[:, i]) for i in range(4))], names=["contig", "pos", "a", "c", "g", "t"])

    dealt = laid.withColumn("_b", F.floor(F.col("start") / BLOCK)).withColumn("_s", F.pmod(F.xxhash64("s", "start"), F.lit(SPREAD)))
    dealt = dealt.repartition("contig", "_b", "_s").sortWithinPartitions("contig", "start").select("contig", "length", "start", "s")
    return dealt.mapInArrow(tally, VOTES).groupBy("contig", "pos").agg(*(F.sum(b).alias(b) for b in "acgt"))


def consensus(contigs: DataFrame, votes: DataFrame, careful: bool = False, min_support: int = 5, dominance: float | None = None) -> DataFrame:
    """Contigs with the bases that won, and ``changed``, their number.

    A place changes if it has ``min_support`` votes (careful: 8 at least) and the leading base
    has ``dominance`` of them (0.80, careful 0.85); the smaller of tied bases leads.  N and n
    stay, any other character may change.
    """
    least = max(min_support, 8) if careful else min_support
    share = dominance if dominance is not None else (0.85 if careful else 0.80)
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    top = F.greatest("a", "c", "g", "t")
    winner = F.when(F.col("a") == top, "A").when(F.col("c") == top, "C").when(F.col("g") == top, "G").otherwise("T")
    won = votes.filter((total > 0) & (total >= least) & (top / total >= share)).select("contig", "pos", F.ascii(winner).alias("base"), F.floor(F.col("pos") / BLOCK).alias("block"))
    n = F.length("sequence")
    cut = contigs.filter(n > 0).select(F.col("id").cast("long").alias("contig"), "sequence", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / BLOCK))).alias("block"))
    cut = cut.select("contig", "block", F.substring("sequence", (F.col("block") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("old"))

    def differ(left: pa.Table, right: pa.Table) -> pa.Table:
        """Places of one block, BLOCK at most, where the winner isn't what stands there."""
        pos, base = left.column("pos").to_numpy(), left.column("base").to_numpy()
        if not right.num_rows or not len(pos):
            return pa.table({"contig": pa.array([], pa.int64()), "pos": pa.array([], pa.int32()), "base": pa.array([], pa.int32())})
        old = np.frombuffer(right.column("old")[0].as_py().upper().encode("latin-1", "replace"), np.uint8)
        here = pos % BLOCK
        some = (here < len(old)) & (old[np.minimum(here, len(old) - 1)] != base)
        some &= old[np.minimum(here, len(old) - 1)] != ord("N")
        return pa.table({"contig": left.column("contig").combine_chunks().filter(pa.array(some)), "pos": pos[some], "base": base[some].astype(np.int32)})

    edits = won.groupBy("contig", "block").cogroup(cut.groupBy("contig", "block")).applyInArrow(differ, "contig long, pos int, base int")
    lists = edits.groupBy(F.col("contig").alias("_contig")).agg(F.collect_list("pos").alias("_pos"), F.collect_list("base").alias("_base"))
    rest = [f for f in contigs.schema if f.name not in ("changed",)]
    schema = T.StructType([*rest, T.StructField("changed", T.LongType())])
    at = [f.name for f in rest].index("sequence")

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts, changed = [], []
            for text, pos, base in zip(batch.column(at).to_pylist(), batch.column(len(rest)), batch.column(len(rest) + 1), strict=True):
                if text is not None and pos.is_valid:
                    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8).copy()
                    raw[pos.values.to_numpy()] = base.values.to_numpy()
                    text = raw.tobytes().decode("latin-1")
                texts.append(text)
                changed.append(len(pos.values) if pos.is_valid else 0)
            arrays = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(rest)])]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip([*arrays, pa.array(changed, pa.int64())], out, strict=True)], schema=out)

    joined = contigs.select(*(f.name for f in rest)).join(lists, F.col("id") == F.col("_contig"), "left")
    return joined.select(*(f.name for f in rest), "_pos", "_base").mapInArrow(splice, schema)


def polish(contigs: DataFrame, reads: DataFrame, k: int = 21, careful: bool = False, min_support: int = 5, dominance: float | None = None, key: str = "read_id") -> DataFrame:
    """Lays the reads, counts the votes and spells the consensus."""
    return consensus(contigs, pileup(lay_reads(reads, contigs, k, key)), careful, min_support, dominance)
