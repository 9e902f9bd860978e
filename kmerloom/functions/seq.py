"""Column functions over sequences and base qualities; all but the adapter search run inside the JVM.

Sequences are strings over ACGT; anything else is an ambiguous base.  Qualities are
strings of the same length, one character a base.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
MIN_K = 21  # the shortest piece of a read that is worth keeping
BOTH_CASES = "ACGTacgt"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement in upper case; an unknown character stays what it is."""
    return F.reverse(F.translate(_c(seq), "ACGTNacgtn", "TGCANTGCAN"))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(_c(kmer), revcomp(kmer))


def is_flipped(kmer: Column | str) -> Column:
    """Whether the canonical form is the reverse complement; a palindrome counts as forward."""
    return revcomp(kmer) < _c(kmer)


def trim_ambiguous_ends(seq: Column | str) -> Column:
    """Without leading and trailing characters other than ACGT of either case."""
    return F.regexp_replace(_c(seq), rf"^[^{BOTH_CASES}]+|[^{BOTH_CASES}]+$", "")


def clean_runs(seq: Column | str, least: int = MIN_K) -> Column:
    """Maximal runs of ACGT of ``least`` bases or more, in order."""
    return F.filter(F.split(_c(seq), rf"[^{BOTH_CASES}]+"), lambda x: F.length(x) >= least)


def kmers(seq: Column | str, k: int) -> Column:
    """All windows of k bases that hold ACGT only, in order, in upper case; none of a shorter sequence."""
    s = F.upper(_c(seq))
    windows = F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    # sequence() counts down where its end is below its start
    return F.when(F.length(s) >= k, F.filter(windows, lambda w: ~w.rlike("[^ACGT]"))).otherwise(F.array().cast("array<string>"))


def extend_right(kmer: Column | str, base: Column | str) -> Column:
    return F.concat(F.substring(_c(kmer), 2, 1 << 30), _c(base))


def prepend_left(kmer: Column | str, base: Column | str) -> Column:
    return F.concat(_c(base), F.left(_c(kmer), F.length(_c(kmer)) - 1))


def first_base(kmer: Column | str) -> Column:
    return F.left(_c(kmer), F.lit(1))


def last_base(kmer: Column | str) -> Column:
    return F.right(_c(kmer), F.lit(1))


def encode_kmer(kmer: Column | str) -> Column:
    """Two bits a base, first base highest, as a long (31 bases at most); null if a base is not ACGT."""
    code = F.aggregate(F.split(F.translate(F.upper(_c(kmer)), BASES, "0123"), ""), F.lit(0).cast("long"), lambda a, b: a * 4 + b.cast("long"))
    return F.when(_c(kmer).rlike(rf"^[{BOTH_CASES}]{{1,31}}$"), code)


def decode_kmer(code: Column | str, k: int) -> Column:
    """The k bases of a number made by ``encode_kmer``."""
    at = F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda i: F.substring(F.lit(BASES), (F.call_function("shiftright", _c(code), (2 * i).cast("int")).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)))
    return F.array_join(at, "")


def hamming_packed(a: Column | str, b: Column | str) -> Column:
    """Bases in which two packed k-mers differ."""
    d = _c(a).bitwiseXOR(_c(b))
    low = F.lit(0x5555555555555555).cast("long")
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(low))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places in which two strings of one length differ."""
    return F.aggregate(F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def gc_count(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(seq), "[^GCgc]", ""))


def acgt_count(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(seq), f"[^{BOTH_CASES}]", ""))


# Qualities


def scores(qual: Column | str, offset: Column | int = 33) -> Column:
    """Quality of each base as numbers; none of an empty string."""
    q = _c(qual)
    return F.when(F.length(q) > 0, F.transform(F.split(q, ""), lambda c: F.ascii(c) - offset)).otherwise(F.array().cast("array<int>"))


def phred_offset(lowest: Column, highest: Column) -> Column:
    """33 or 64 by the extreme characters of a file, of those from 33 on."""
    return F.when(lowest < 59, 33).when(highest > 74, 64).otherwise(33)


def quality_end(qual: Column | str, least: int, offset: Column | int = 33) -> Column:
    """Length that is left when trailing bases below ``least`` are cut."""
    return F.coalesce(F.array_max(F.transform(scores(qual, offset), lambda q, i: F.when(q >= least, i + 1).otherwise(0))), F.lit(0))


def window_end(qual: Column | str, window: int, least: int, offset: Column | int = 33) -> Column:
    """Length that is left by sliding-window trimming from the 3' end.

    The largest end whose last base reaches ``least`` and whose last ``window`` bases reach
    it on average; ends inside of the first window need the base only.
    """
    q = scores(qual, offset)
    sums = F.transform(q, lambda x, i: F.aggregate(F.slice(q, F.greatest(i - window + 2, F.lit(1)), F.least(i + 1, F.lit(window))), F.lit(0), lambda a, y: a + y))
    ok = F.transform(F.zip_with(q, sums, lambda x, s: F.struct(x.alias("q"), s.alias("s"))), lambda x, i: F.when((x["q"] >= least) & ((i + 1 < window) | (x["s"] >= least * window)), i + 1).otherwise(0))
    return F.coalesce(F.array_max(ok), F.lit(0))


def mean_quality(qual: Column | str, offset: Column | int = 33) -> Column:
    q = scores(qual, offset)
    return F.when(F.size(q) > 0, F.aggregate(q, F.lit(0), lambda a, x: a + x) / F.size(q)).otherwise(F.lit(0.0))


def poly_n_bounds(seq: Column | str) -> tuple[Column, Column]:
    """1-based start and length of what is left without leading and trailing N or n."""
    s = _c(seq)
    lead = F.length(s) - F.length(F.regexp_replace(s, "^[Nn]+", ""))
    return lead + 1, F.length(F.regexp_replace(s, "^[Nn]+|[Nn]+$", ""))


def poly_g_end(seq: Column | str, least: int = 5) -> Column:
    """Length without a trailing run of G or g that has ``least`` bases; 0 turns it off."""
    s = _c(seq)
    rest = F.length(F.regexp_replace(s, "[Gg]+$", ""))
    return F.when(F.lit(least > 0) & (F.length(s) - rest >= max(least, 1)), rest).otherwise(F.length(s))


def _first_of(hit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The first marked place of each stretch of a flat array, from its start on; -1 without one."""
    at = np.flatnonzero(hit)
    i = np.searchsorted(at, offs[:-1])
    found = at[np.minimum(i, max(len(at) - 1, 0))] if len(at) else np.zeros(len(offs) - 1, np.int64)
    return np.where((i < len(at)) & (found < offs[1:]), found - offs[:-1], -1)


def _adapter_places(reads: list[str], adapter: bytes, least: int) -> np.ndarray:
    """Where each read is cut for one adapter, -1 without it."""
    raw = [r.encode("latin-1", "replace").upper() for r in reads]
    size = np.array([len(r) for r in raw], np.int64)
    offs = np.concatenate(([0], np.cumsum(size)))
    m, n = len(adapter), int(offs[-1])
    buf = np.frombuffer(b"".join(raw) + bytes(m), np.uint8)
    left = np.repeat(offs[1:], size) - np.arange(n)  # bases from a place to the end of its read
    wrong = np.zeros(n, np.int16)
    tail = np.zeros(n, bool)
    for j, base in enumerate(adapter, 1):
        wrong += buf[j - 1 : j - 1 + n] != base
        if j >= least:  # so many bases are left: the comparison ends with the read
            tail |= (left == j) & (wrong <= max(j // 10, int(j >= 12)))
    whole = (left >= m) & (wrong <= max(m // 10, 1))
    both = np.stack([_first_of(tail, offs), _first_of(whole, offs)])
    both[both < 0] = np.iinfo(np.int64).max
    best = both.min(0)
    return np.where(best == np.iinfo(np.int64).max, -1, best)


def adapter_start(seq: Column | str, adapters: list[str], min_overlap: int) -> Column:
    """Where the read is cut for an adapter (its new length), null without one.

    An adapter's beginning may stand at the end of the read, or all of it inside; a tenth of
    the compared bases may differ (one at least from 12 bases on, and inside).  Of each kind
    the first place counts, and over all adapters the smallest.  Case makes no difference;
    adapters shorter than the overlap are left out.  Whole Arrow batches are compared at once.
    """
    wanted = [a.upper().encode() for a in adapters if len(a) >= min_overlap > 0]
    if not wanted:
        return F.lit(None).cast("int")

    def places(reads: pd.Series) -> pd.Series:
        known = reads.fillna("").tolist()
        every = np.stack([_adapter_places(known, a, min_overlap) for a in wanted])
        every[every < 0] = np.iinfo(np.int64).max
        best = every.min(0)
        return pd.Series([None if b == np.iinfo(np.int64).max else int(b) for b in best], dtype="Int32")

    return F.pandas_udf(places, "int")(_c(seq))


def read_fate(seq: Column | str, qual: Column | str, min_len: int = 30, max_ns: int = 3, min_quality: int = 10, offset: Column | int = 33) -> Column:
    """'too_short', 'too_many_ns', 'low_quality' (mean below three quarters of the minimum) or 'pass'; the first that holds."""
    s = _c(seq)
    ns = F.length(s) - F.length(F.regexp_replace(s, "[Nn]", ""))
    return F.when(F.length(s) < min_len, "too_short").when(ns > max_ns, "too_many_ns").when(mean_quality(qual, offset) < 0.75 * min_quality, "low_quality").otherwise("pass")


def header_barcode(header: Column | str) -> Column:
    """Barcode of a linked read: a BX:Z: or BC:Z: token, else what stands after the first '#'; null without one."""
    h = _c(header)
    token = F.regexp_extract(h, r"(?:^|\s)B[XC]:Z:(\S*)", 1)
    # the first word after the mark, up to a slash
    marked = F.regexp_extract(h, r"#\s*([^\s/]*)", 1)
    raw = F.when(h.rlike(r"(?:^|\s)B[XC]:Z:"), token).when(F.instr(h, "#") > 0, marked)
    clean = F.regexp_replace(raw, r"-[0-9]+$", "")
    return F.when(clean != "", clean)


#: Start and factor of the 64-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def barcode_number(barcode: Column | str) -> Column:
    """A barcode as a long: two bits a base if it has 32 bases of ACGT at most, else its 64-bit FNV-1a hash; null stays null.

    Longs hold the bits of unsigned numbers, so large ones are negative.
    """
    b = _c(barcode)
    codes = F.transform(F.split(F.translate(F.upper(b), BASES, "0123"), ""), lambda x: F.try_element_at(F.array(*(F.lit(i).cast("long") for i in range(4))), x.try_cast("int") + 1))
    packed = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 2).bitwiseOR(x))

    # bytes times the factor modulo 2 ** 64, which is 2 ** 40 + 0x1B3, in halves that don't overflow
    def step(a: Column, byte: Column) -> Column:
        h = a.bitwiseXOR(byte)
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
        low_part = low * 0x1B3
        high_part = (high * 0x1B3 + F.shiftrightunsigned(low_part, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(high_part, 32).bitwiseOR(low_part.bitwiseAND(F.lit(0xFFFFFFFF)))

    raw = F.hex(F.encode(b, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))
    hashed = F.aggregate(octets, F.lit(FNV_START - (1 << 64)).cast("long"), step)
    return F.when(b.rlike(rf"^[{BOTH_CASES}]{{1,32}}$"), packed).when(b != "", hashed)
