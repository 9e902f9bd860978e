"""Repeats, gaps and scaffolds: evidence as joins, order as a greedy pass over small link tables."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import seq as S
from .graph import _number, components, cut, list_rank, numbered, overlaps, upper_median
from .mapping import seed_anchors
from .packed import kmer_tallies
from .reads import systematic_sample

_COMPLEMENT = str.maketrans("ACGTacgt", "TGCATGCA")
CONTIG = "id long, sequence string, mean_coverage double, kmers_count long"


def rc(seq: str) -> str:
    return seq.upper().translate(_COMPLEMENT)[::-1]


# Paired-end repeat resolution


def _candidates(contigs: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(src, dst, dst_rc, support, n_out, n_in): the ways out of 3' ends that can be chosen.

    These are the lone ones and those with a link; of several without any none is ever
    clear.  The degrees count all of them by the k - 1 bases that contigs end and begin
    with, so the ways themselves, whose number grows with the square of the contigs, are
    not made.
    """
    s = contigs.filter((F.length("sequence") >= k - 1) & F.col("id").isNotNull())
    tips = cut(s.select("id", F.left("sequence", F.lit(k - 1)).alias("first"), F.right("sequence", F.lit(k - 1)).alias("last")))
    ends = tips.select(F.col("id").alias("src"), F.col("last").alias("over"))
    starts = tips.select(F.col("id").alias("dst"), F.lit(False).alias("dst_rc"), F.col("first").alias("over"))
    starts = starts.unionByName(tips.select(F.col("id").alias("dst"), F.lit(True).alias("dst_rc"), S.revcomp("last").alias("over")))

    def degrees(of: DataFrame, others: DataFrame, name: str, other: str) -> DataFrame:
        """The rows with how many of the others meet them, but for those of the same contig."""
        met = others.groupBy("over").agg(F.count("*").alias("_all"))
        own = others.groupBy(F.col(other).alias(name), "over").agg(F.count("*").alias("_own"))
        return of.join(met, "over").join(own, [name, "over"], "left").withColumn("_n", F.col("_all") - F.coalesce("_own", F.lit(0))).drop("_all", "_own")

    ways = cut(degrees(ends, starts, "src", "dst").filter("_n > 0"))
    n_out = ways.groupBy("src").agg(F.sum("_n").alias("n_out"))
    n_in = degrees(starts, ends, "dst", "src").groupBy("dst").agg(F.sum("_n").alias("n_in"))
    links = links.select("src", "dst", "support")
    lone = ways.join(n_out.filter("n_out = 1"), "src").join(starts, "over").filter("src != dst").select("src", "dst", "dst_rc", "n_out")
    lone = lone.join(links, ["src", "dst"], "left").select("src", "dst", "dst_rc", "support", "n_out")
    linked = links.join(ways.join(n_out.filter("n_out > 1"), "src"), "src").join(starts, ["dst", "over"]).filter("src != dst").select("src", "dst", "dst_rc", "support", "n_out")
    return lone.unionByName(linked).join(n_in, "dst").withColumn("support", F.coalesce("support", F.lit(0)))


def choose_successors(contigs: DataFrame, links: DataFrame, k: int, min_support: int = 3, ratio: float = 2.5) -> DataFrame:
    """(src, dst, dst_rc): where each contig goes on from its 3' end, at most one way out and one in.

    A lone successor that nothing else leads to is taken as it is, one that others lead to
    too with ``min_support`` pairs.  Of several the best needs that support and ``ratio``
    times that of the second.  Of several that lead to one contig the same rule picks one.
    A contig that is entered by its 3' end has no way out there.  ``ratio`` is above 0.
    """
    if ratio <= 0:
        raise ValueError(f"a ratio is above 0, not {ratio}")
    e, into = _candidates(contigs, links, k), W.Window.partitionBy("dst")

    def ranked(df: DataFrame, by: str, other: list[str]) -> DataFrame:
        w = W.Window.partitionBy(by).orderBy(F.desc("support"), *other)
        df = df.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("support").over(w), F.lit(0)))
        return df.withColumn("_clear", (F.col("_r") == 1) & (F.col("support") >= min_support) & ((F.col("_next") == 0) | (F.col("support") >= ratio * F.col("_next"))))

    e = ranked(e, "src", ["dst", "dst_rc"])
    alone = (F.col("n_out") == 1) & ((F.col("n_in") == 1) | (F.col("support") >= min_support))
    several = (F.col("n_out") > 1) & F.col("_clear") & ((F.col("_next") > 0) | (F.col("support") >= max(min_support, ratio)))
    taken = e.filter(alone | several).select("src", "dst", "dst_rc", "support")
    taken = ranked(taken.withColumn("_n", F.count("*").over(into)), "dst", ["src"]).filter("_n = 1 OR _clear").select("src", "dst", "dst_rc")
    taken = cut(taken)
    backwards = taken.filter("dst_rc").select(F.col("dst").alias("src"))
    return taken.join(backwards, "src", "left_anti")


def resolve_repeats(contigs: DataFrame, links: DataFrame, k: int, min_support: int = 3, ratio: float = 2.5) -> DataFrame:
    """Contigs spelled along the chosen successors; coverage is weighted by the bases that each part adds."""
    contigs = cut(contigs)
    branching = overlaps(contigs, k).filter("NOT src_rc AND src != dst").groupBy("src").count().filter("count > 1")
    if k < 2 or branching.isEmpty():
        return contigs
    steps = choose_successors(contigs, links, k, min_support, ratio)
    ranked = list_rank(contigs.select(F.col("id").alias("node")), steps.select(F.col("src").alias("prev"), F.col("dst").alias("node")))
    entered = steps.select(F.col("dst").alias("node"), "dst_rc")
    parts = ranked.join(entered, "node", "left").join(contigs.withColumnRenamed("id", "node"), "node")
    turned = F.coalesce("dst_rc", F.lit(False)) & (F.col("rank") > 0)
    whole = F.when(turned, S.revcomp("sequence")).otherwise(F.col("sequence"))
    piece = F.when(F.col("rank") == 0, whole).otherwise(F.substring(whole, F.lit(k), F.length("sequence")))
    added = parts.select("head", "rank", piece.alias("s"), (F.col("mean_coverage") * F.length(piece)).alias("w"), "mean_coverage")
    spelled = added.groupBy("head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), "").alias("sequence"), F.sum("w").alias("w"))
    n = F.length("sequence")
    return _number(spelled.select("sequence", (F.col("w") / n).alias("mean_coverage"), F.greatest(n - (k - 1), F.lit(0)).cast("long").alias("kmers_count")))


# Gaps


def close_gap(left: str, right: str, reads: list[str], k: int = 21, max_gap: int = 2000) -> str | None:
    """Both sequences joined, or None.

    By an overlap of k - 1 to max(k, 31) bases, the longest first; else by a walk over the
    k-mers that reads hold twice or more, from the left end to the right start.  Reads that
    hold an end only in reverse are turned.  A walk stops at a tie (the second step has over
    half the count of the first), at a cycle and after ``max_gap`` bases.
    """
    for over in range(min(max(k, 31), len(left), len(right)), max(k - 1, 1) - 1, -1):
        if left.endswith(right[:over]):
            return left + right[over:]
    if not reads or not 0 < k <= 32 or min(len(left), len(right)) < k:
        return None
    here, goal = left[-k:], right[:k]
    if set(here + goal) - set("ACGT"):
        return None
    ends, turned_ends = {here, goal}, {rc(here), rc(goal)}
    counts: Counter[str] = Counter()
    for read in reads:
        own = [read[i : i + k] for i in range(len(read) - k + 1)]
        if not ends.intersection(own) and turned_ends.intersection(own):
            read = rc(read)
            own = [read[i : i + k] for i in range(len(read) - k + 1)]
        counts.update(own)
    walked, seen = "", {here}
    while here != goal:
        steps = sorted(((counts[here[1:] + b], b) for b in S.BASES if counts[here[1:] + b] >= 2), key=lambda s: -s[0])
        if len(walked) == max_gap or not steps or (len(steps) > 1 and 2 * steps[1][0] > steps[0][0]):
            return None
        here = here[1:] + steps[0][1]
        if here in seen:
            return None
        seen.add(here)
        walked += steps[0][1]
    return left + walked[: len(walked) - k] + right if len(walked) >= k else left + right[k - len(walked) :]


# Scaffolds


def scaffold_order(ids: list[int], links: list[tuple[int, int, int]], min_links: int = 3, ratio: float = 1.25) -> list[list[int]]:
    """Chains of contigs: from each unused one on along its strongest link to an unused one.

    A link needs ``min_links`` pairs and ``ratio`` times the support of the second; ties go
    to the smaller id.  One pass in the order of ids, as each choice depends on those before.
    """
    to: dict[int, list[tuple[int, int]]] = {}
    for src, dst, support in links:
        if support > 0:
            to.setdefault(src, []).append((-support, dst))
    for options in to.values():
        options.sort()
    used: set[int] = set()
    chains = []
    for i in ids:
        if i in used:
            continue
        chain, here = [i], i
        used.add(i)
        while True:
            open_ = [(s, d) for s, d in to.get(here, ()) if d not in used]
            if not open_ or -open_[0][0] < min_links or (len(open_) > 1 and open_[0][0] / open_[1][0] < ratio):
                break
            here = open_[0][1]
            used.add(here)
            chain.append(here)
        chains.append(chain)
    return chains


LOCAL_LINKS = 1_000_000  # so many are put in order on the driver; of more, each component in a task
PLAN = "chain long, rank long, id long"


def _rows(chains: list[list[int]]) -> list[tuple[int, int, int]]:
    return [(chain[0], i, x) for chain in chains for i, x in enumerate(chain)]


def _plan(contigs: DataFrame, links: DataFrame, order, local_links: int) -> DataFrame:
    """(chain, rank, id) of every contig; ``order(ids, links)`` makes chains of the contigs that links (u, v, support) join.

    What is chosen in one component of the links doesn't depend on any other, so many links
    are dealt to tasks by component; a contig without links is a chain of its own.
    """
    spark = contigs.sparkSession
    links = cut(links.select("u", "v", "support"))
    if links.limit(local_links + 1).count() <= local_links:
        found = [tuple(r) for r in links.collect()]
        ids = sorted({x for u, v, _ in found for x in (u, v)})
        plan = spark.createDataFrame(_rows(order(ids, found)), PLAN)
    else:
        at = components(links)

        def per(pdf: pd.DataFrame) -> pd.DataFrame:
            found = list(pdf[["u", "v", "support"]].itertuples(index=False, name=None))
            ids = sorted({x for u, v, _ in found for x in (u, v)})
            return pd.DataFrame(_rows(order(ids, found)), columns=["chain", "rank", "id"])

        plan = links.join(at.withColumnRenamed("node", "u"), "u").groupBy("component").applyInPandas(per, PLAN)
    plan = cut(plan)
    alone = contigs.select("id").join(plan.select("id"), "id", "left_anti")
    return plan.join(contigs.select("id"), "id", "left_semi").select("chain", "rank", "id").unionByName(alone.select(F.col("id").alias("chain"), F.lit(0).cast("long").alias("rank"), "id"))


def _spell(contigs: DataFrame, plan: DataFrame, join) -> DataFrame:
    """Chains to sequences; ``join(list of sequences)`` spells one in the task that holds it."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        n = pdf["sequence"].str.len()
        cov = float((pdf["mean_coverage"] * n).sum() / n.sum()) if n.sum() else 10.0
        return pd.DataFrame({"id": [0], "sequence": [join(list(pdf["sequence"]))], "mean_coverage": [cov], "kmers_count": [int(pdf["kmers_count"].sum())]})

    return _number(contigs.join(plan, "id").groupBy("chain").applyInPandas(fold, CONTIG))


def build_scaffolds(contigs: DataFrame, links: DataFrame, reads: DataFrame | None = None, min_links: int = 3, gap: int = 50, k: int = 21, pool: int = 8192, ratio: float = 1.25, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Contigs chained by their pairs; a gap is closed by overlap or reads, or holds ``gap`` Ns.

    Links are put in order on the driver up to ``local_links``, by component in tasks beyond;
    both choose alike.  ``reads`` holds (ordinal, seq); ``pool`` of them at most, every n-th,
    are sent to the tasks that close gaps.
    """
    if contigs.limit(2).count() < 2:
        return _number(contigs)
    # a weaker link is never taken, nor strong enough to make another one doubtful
    strong = links.filter(F.col("support") * ratio > min_links).select(F.col("src").alias("u"), F.col("dst").alias("v"), "support")
    plan = _plan(contigs, strong, lambda ids, found: scaffold_order(ids, found, min_links, ratio), local_links)
    sample: list[str] = []
    if reads is not None:
        sample = [r[0] for r in systematic_sample(reads, pool).orderBy("ordinal").select("seq").collect()]
    shared = contigs.sparkSession.sparkContext.broadcast(sample)

    def join(parts: list[str]) -> str:
        out = parts[0]
        for p in parts[1:]:
            out = close_gap(out, p, shared.value, k) or out + "N" * gap + p
        return out

    return _spell(contigs, plan, join)


def linked_order(ids: list[int], links: list[tuple[int, int, int]]) -> list[list[int]]:
    """Chains by links (u, v, support), those with the most support first: one neighbour on either side, no chain closes."""
    right: dict[int, int] = {}
    left: dict[int, int] = {}
    of: dict[int, int] = {}

    def root(x: int) -> int:
        while of.setdefault(x, x) != x:
            of[x] = x = of[of[x]]
        return x

    for u, v, _ in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        for a, b in ((u, v), (v, u)):
            if root(a) != root(b) and a not in right and b not in left:
                right[a], left[b] = b, a
                of[root(a)] = root(b)
                break
    chains = []
    for i in ids:
        if i in left:
            continue
        chain = [i]
        while chain[-1] in right:
            chain.append(right[chain[-1]])
        chains.append(chain)
    return chains


def linked_scaffolds(contigs: DataFrame, links: DataFrame, gap: int = 100, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Contigs chained by shared barcodes (u, v, support), strongest pairs first, with ``gap`` Ns between.

    Each contig has one neighbour on either side and no chain closes; strands stay as they are.
    """
    if links.isEmpty():
        return contigs
    return _spell(contigs, _plan(contigs, links, linked_order, local_links), lambda parts: ("N" * gap).join(parts))


# Long reads


@dataclass(frozen=True)
class LongReadConfig:
    min_support: int = 3
    flank_length: int = 500
    gap: int = 20
    dominance: float = 0.70


def merge_anchors(anchors: list[tuple], gap: int = 1500) -> list[list]:
    """Anchors (start, contig, rc, end, hits) in order; neighbours of one contig within ``gap`` become one.

    The strand is that of the last part with more hits than all before.
    """
    out: list[list] = []
    for start, contig, turned, end, hits in sorted(anchors):
        last = out[-1] if out else None
        if last is not None and last[1] == contig and start - last[3] <= gap:
            if hits > last[4]:
                last[2] = turned
            last[3], last[4] = max(last[3], end), last[4] + hits
        else:
            out.append([start, contig, turned, end, hits])
    return out


def pair_flanks(anchors: list[list], unique: set[int]) -> list[tuple[int, int, str]]:
    """(u, v, way) for each unique flank and the next one: u <= v, the way from u to v as text."""
    found = []
    for i, (_, a, a_rc, _, _) in enumerate(anchors):
        if a not in unique:
            continue
        between: list[tuple[int, bool]] = []
        for _, b, b_rc, _, _ in anchors[i + 1 :]:
            if b == a:
                break
            if b in unique:
                way = [(a, a_rc), *between, (b, b_rc)]
                if a > b:
                    way = [(c, not t) for c, t in reversed(way)]
                found.append((way[0][0], way[-1][0], " ".join(f"{c}{'-' if t else '+'}" for c, t in way)))
                break
            if not between or between[-1][0] != b:
                between.append((b, b_rc))
    return found


def flank_bridges(reads: DataFrame, contigs: DataFrame, k: int, config: LongReadConfig = LongReadConfig(), key: str = "read_id") -> DataFrame:
    """(u, v, way, n): how many long reads go from one unique flank to the next in each way."""
    n = contigs.count()
    seed = min(max(k, 4), 15)
    median = upper_median(contigs, "mean_coverage") or 0.0
    lone = (F.length("sequence") >= config.flank_length) & (F.col("mean_coverage") < 1.8 * median) if n > 3 else F.lit(True)
    unique = contigs.select(F.col("id").alias("contig"), lone.alias("unique"))
    span = max(150, 2 * seed) if n > 3 else seed
    a = seed_anchors(reads, contigs, k, key=key).join(unique, "contig")
    least = F.when(F.col("unique"), span).otherwise(max(span // 2, seed))
    a = a.filter((F.col("hits") >= min(config.min_support, 3)) & (F.col("end") - F.col("start") >= least))

    def per_read(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[["start", "contig", "rc", "end", "hits"]].itertuples(index=False)]
        merged = merge_anchors([(s, c, bool(t), e - seed, h) for s, c, t, e, h in rows])
        return pd.DataFrame(pair_flanks(merged, set(pdf.loc[pdf["unique"], "contig"])), columns=["u", "v", "way"])

    # a group is the anchors of one read
    return a.groupBy(key).applyInPandas(per_read, "u long, v long, way string").groupBy("u", "v", "way").agg(F.count("*").alias("n"))


def chain_bridges(bridges: list[tuple[int, int, str, int]], strict: bool, config: LongReadConfig = LongReadConfig()) -> list[list[tuple[int, bool]]]:
    """Paths of (contig, turned) from bridges, those with the most reads first; each end of a flank is used once."""
    totals: Counter = Counter()
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for u, v, way, n in bridges:
        totals[u, v] += n
        if (u, v) not in best or (n, best[u, v][1]) > (best[u, v][0], way):
            best[u, v] = (n, way)
    partner: dict[tuple[int, str], tuple[tuple[int, str], list[tuple[int, bool]]]] = {}
    of: dict[int, int] = {}

    def root(x: int) -> int:
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for (u, v), total in sorted(totals.items(), key=lambda t: (-t[1], t[0])):
        n, way = best[u, v]
        if total < config.min_support or (strict and n / total < config.dominance):
            continue
        steps = [(int(s[:-1]), s[-1] == "-") for s in way.split()]
        leave = (u, "head" if steps[0][1] else "tail")
        enter = (v, "tail" if steps[-1][1] else "head")
        if leave in partner or enter in partner or root(u) == root(v):
            continue
        of[root(u)] = root(v)
        partner[leave] = (enter, steps[1:-1])
        partner[enter] = (leave, [(c, not t) for c, t in reversed(steps[1:-1])])
    paths, used = [], set()
    for contig in sorted({p[0] for p in partner}):
        for end, other in (("head", "tail"), ("tail", "head")):
            if contig in used or (contig, end) in partner or (contig, other) not in partner:
                continue
            path, port = [(contig, end == "tail")], (contig, other)
            used.add(contig)
            while port in partner:
                (following, side), between = partner[port]
                if following in used:
                    break
                used.add(following)
                path += [*between, (following, side == "tail")]
                port = (following, "head" if side == "tail" else "tail")
            paths.append(path)
    return paths


def bridge_long_reads(contigs: DataFrame, reads: DataFrame, k: int, config: LongReadConfig = LongReadConfig(), key: str = "read_id") -> DataFrame:
    """Contigs joined along long reads; repeats between flanks are spelled each time they are crossed."""
    contigs = cut(contigs)
    n = contigs.count()
    bridges = [tuple(r) for r in flank_bridges(reads, contigs, k, config, key).collect()]
    paths = chain_bridges(bridges, n > 10, config)
    if not paths:
        return contigs
    low = (k - 1) // 2 if n <= 3 else 10
    spark = contigs.sparkSession
    plan = spark.createDataFrame([(c, i, x, t) for c, path in enumerate(paths) for i, (x, t) in enumerate(path)], "chain long, rank long, id long, turned boolean")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = ""
        for s, t in pdf.sort_values("rank")[["sequence", "turned"]].itertuples(index=False):
            s = rc(s) if t else s
            if out:
                over = next((o for o in range(min(k - 1, len(out), len(s)), max(low, 1) - 1, -1) if out.endswith(s[:o])), 0)
                out += s[over:] if over else "N" * config.gap + s
            else:
                out = s
        size = pdf["sequence"].str.len()
        return pd.DataFrame({"id": [0], "sequence": [out], "mean_coverage": [float((pdf["mean_coverage"] * size).sum() / size.sum())], "kmers_count": [int(pdf["kmers_count"].sum())]})

    joined = contigs.join(plan, "id").groupBy("chain").applyInPandas(fold, CONTIG)
    rest = contigs.join(plan.select("id").distinct(), "id", "left_anti")
    return _number(joined.unionByName(rest.select(joined.columns)))


# Multi-k rescue


def novelty(old: DataFrame, final: DataFrame, k: int, key: str = "id", seq: str = "sequence") -> DataFrame:
    """(key, total, missing): k-mer instances of each sequence, and those that no final one has."""
    known = kmer_tallies(final, k, seq=seq).select("canon").distinct().withColumn("_in", F.lit(True))
    both = kmer_tallies(old, k, [key], seq).join(known, "canon", "left")
    return both.groupBy(key).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("n"))), F.lit(0)).alias("missing"))


def by_support(links: DataFrame) -> DataFrame:
    """(place, u, v, support): links with the most support first, ties by their ends."""
    return numbered(links.select("u", "v", "support"), [F.desc("support"), "u", "v"], name="place").select("place", "u", "v", "support")


def rescue(final: DataFrame, earlier: DataFrame, k: int, min_coverage: float, min_length: int = 300) -> DataFrame:
    """Contigs of lower k, newest (largest id) first, of which half the k-mers are missing from the final ones.

    Those taken count as known for the ones that come after.  A contig is settled once every
    newer one that shares a k-mer with it is, so each round settles all that wait for no
    other; the newest left never waits.  Rounds are as many as the longest chain of contigs
    that share k-mers, most often the number of k.
    """
    k = min(k, 32)
    old = cut(earlier.filter((F.length("sequence") >= min_length) & (F.col("mean_coverage") >= min_coverage)))
    own = kmer_tallies(old, k, ["id"], "sequence").groupBy("id", "canon").agg(F.sum("n").alias("n"))
    known = kmer_tallies(final, k, seq="sequence").select("canon").distinct().withColumn("_in", F.lit(True))
    both = cut(own.join(known, "canon", "left"))
    sizes = cut(both.groupBy("id").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("n"))), F.lit(0)).alias("new")).filter("2 * new >= total"))
    open_ = cut(both.filter("_in IS NULL").join(sizes.select("id"), "id", "left_semi").select("id", "canon", "n"))
    waiting, taken = sizes.select("id", "total"), old.select("id").limit(0)
    while not waiting.isEmpty():
        left = open_.join(waiting.select("id"), "id", "left_semi")
        newest = left.groupBy("canon").agg(F.max("id").alias("_top"))
        later = left.join(newest, "canon").filter("_top > id").select("id").distinct()
        ready = waiting.join(later, "id", "left_anti")
        used = open_.join(taken, "id", "left_semi").select("canon").distinct()
        fresh = open_.join(used, "canon", "left_anti").groupBy("id").agg(F.sum("n").alias("_new"))
        settled = cut(ready.join(fresh, "id", "left").select("id", (2 * F.coalesce("_new", F.lit(0)) >= F.col("total")).alias("_takes")))
        taken = cut(taken.unionByName(settled.filter("_takes").select("id")))
        waiting = cut(waiting.join(settled, "id", "left_anti"))
    return old.join(taken, "id", "left_semi")
