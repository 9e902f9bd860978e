"""Mixing sources to target weights by capped water-filling.

Each source's target is its share of a budget by weight, clamped at ``max_epochs``
times its size; what the clamp frees goes to the other sources by weight until no
target is above its clamp.  A document is then taken a whole number of times plus,
for the fraction that remains, once more if it is among those that fill it in a seeded order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters outside 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle_weights(sources: Iterable[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights repeating over the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def water_fill(sizes: dict, weights: dict, budget: float, max_epochs: float) -> dict:
    """Targets that share ``budget`` by weight, none above ``max_epochs`` times its size."""
    caps = {s: max_epochs * n for s, n in sizes.items()}
    open_, target = dict(weights), {}
    left = budget
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > caps[s]]
        if not over:
            return target | {s: level * w for s, w in open_.items()}
        for s in over:
            target[s] = float(caps[s])
            left -= caps[s]
            del open_[s]
    return target


def mix_sources(
    docs: DataFrame,
    weights: Callable[[Iterable[str | None]], dict] = cycle_weights,
    max_epochs: int = 3,
    budget_ratio: float = 1.0,
    seed: str = "mix",
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Adds size, source_size, target and copies to every document.

    ``copies`` (0 to max_epochs) says how often the mix takes the document.  Sources,
    of which there are few, are the only thing that the driver sees.  The seeded order
    is that of md5(seed, key) in ``BINS`` bins.  Of each source the bins are gone through in
    this order, and one whose extra copies bring the sum nearer to the fraction that the
    target asks for is taken, so a very long document that doesn't fit is passed over and
    later ones fill what is left.  A rerun takes the same documents, whatever the
    partitions, and a source misses its target by about half of its smallest bins.

    Null texts and texts without words have size 0 and still get copies; a null source
    is a source of its own; rows that repeat are taken alike; an empty table stays empty;
    texts are counted whole, however long.
    Columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    docs = docs.drop("size", "source_size", "target", "copies", "_bin", "_whole", "_bits", "_source")
    binned = docs.withColumns({"size": word_count(F.col(text)), "_bin": F.conv(F.substring(code, 1, 3), 16, 10).cast("int")})
    bins = binned.groupBy(F.col(source).alias("_source"), "_bin").agg(F.sum("size").alias("_words"))
    # at most BINS rows a source from here on
    bins = bins.persist()
    sizes = {r[0]: int(r[1]) for r in bins.groupBy("_source").agg(F.sum("_words")).collect()}
    total = sum(sizes.values())
    targets = water_fill(sizes, weights(sizes), total * budget_ratio if budget_ratio != 1 else total, max_epochs)
    rows = [(s, n, float(targets[s]), min(int(targets[s] // n) if n else 0, max_epochs)) for s, n in sizes.items()]
    kind = T.StructType([T.StructField("_source", docs.schema[source].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_whole", T.IntegerType())])
    plan = spark.createDataFrame(rows, kind)
    wanted = F.when(F.col("_whole") < max_epochs, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(0.0)
    full = T.StructType([*kind.fields, T.StructField("_bits", T.ArrayType(T.LongType()))])
    own = bins.withColumnRenamed("_source", "_s").join(plan.withColumn("_wanted", wanted), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s")

    def fill(group: pa.Table) -> pa.Table:
        """The bins of one source, BINS at most, in order; those that are taken as bits."""
        group = group.sort_by("_bin")
        goal, filled, taken = group.column("_wanted")[0].as_py(), 0, np.zeros(BINS, np.uint8)
        for at, size in zip(group.column("_bin").to_pylist(), group.column("_words").to_pylist(), strict=True):
            if goal > 0 and filled + size / 2 <= goal:
                filled += size
                taken[at] = 1
        bits = np.packbits(taken, bitorder="little").view(np.int64).tolist()
        return pa.table({**{f.name: group.column(f.name)[:1] for f in kind}, "_bits": pa.array([bits], pa.list_(pa.int64()))})

    plan = own.groupBy("_source").applyInArrow(fill, full)
    # a row of some hundred bytes for each source
    out = binned.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, F.col(source).eqNullSafe(F.col("_source")))
    extra = F.getbit(F.element_at("_bits", (F.floor(F.col("_bin") / 64) + 1).cast("int")), F.pmod("_bin", F.lit(64)))
    return out.withColumn("copies", F.col("_whole") + extra.cast("int")).drop("_source", "_bin", "_whole", "_bits")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as its copies say."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_copy")
