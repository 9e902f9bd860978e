"""Line-first cleaning: rules per line, then a verdict on what is left.

Every line is judged on its own by punctuation, navigation and boilerplate rules; lines
that fail go, and a document is rejected if too much of its text went with them.  All
of it is column expressions; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Phrases of page furniture; a short line with one of them is boilerplate.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to comment",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign up for",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Shares are in percent of a line's words."""

    mark_words: int = 8  # a line of so many words needs a sentence mark somewhere
    symbol_share: int = 30  # words with two of #*$%&<>~^ side by side
    shout_share: int = 50  # pairs of !, for each hundred words
    bar_share: int = 20  # separators of a menu that stand alone
    boilerplate_words: int = 25
    lost_share: int = 50  # a document that loses more is rejected


def _line_fails(line: Column, rules: LineRules) -> Column:
    n = F.regexp_count(line, F.lit(WORD))
    punctuation = (n >= rules.mark_words) & ~line.rlike(r"[.!?;:…。！？]")
    symbols = 100 * F.regexp_count(line, F.lit(rf"[^{SPACE}]*[#*$%&<>~^]{{2,}}[^{SPACE}]*")) > rules.symbol_share * n
    shouting = 100 * F.regexp_count(line, F.lit(r"!!")) > rules.shout_share * n
    navigation = 100 * F.regexp_count(line, F.lit(rf"(?<![^{SPACE}])[|»›·•](?![^{SPACE}])")) > rules.bar_share * n
    boilerplate = (n <= rules.boilerplate_words) & line.rlike("(?i)" + "|".join(BOILERPLATE))
    return (n > 0) & (punctuation | symbols | shouting | navigation | boilerplate)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Adds word_chars, n_symbols, n_words, n_dup_lines, n_repeat_words, n_lost, base_failed, kept and clean_text.

    n_lost counts the words of lines that fail a rule, and clean_text has the other lines.
    ``base_failed``: fewer than 10 words, or over a fifth of them in 5-word windows that
    come twice or more in the text.  ``kept``: neither that nor over ``lost_share`` of the
    words lost.  A null or empty text has no words, so fails; rows are judged one by one,
    so repeated rows agree, an empty table stays empty and a text is taken whole, however
    long.  Columns named like the added ones are replaced.
    """
    added = ["word_chars", "n_symbols", "n_words", "n_dup_lines", "n_repeat_words", "n_lost", "base_failed", "kept", "clean_text"]
    temporary = ["_t", "_w", "_h", "_s", "_p", "_lines", "_full", "_good"]
    docs = docs.drop(*(c for c in added + temporary if c != text))
    trimmed = F.btrim(F.col("_t"), F.lit(" \t\n\x0b\f\r"))
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACE}]+")))
    # hashes of the 5-word windows by place
    df = df.withColumn("_h", F.expr("CASE WHEN size(_w) < 5 THEN array() ELSE transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])) END"))
    # if any repeats: windows in the order of their hash, then the places of those with an equal neighbour, in order
    df = df.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) END"))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[k - 1].h = x.h) OR (k < size(_s) - 1 AND _s[k + 1].h = x.h)), x -> x.i))"))
    df = df.withColumn("_lines", F.split(F.col("_t"), "\n"))
    df = df.withColumn("_full", F.filter("_lines", lambda x: x.rlike(rf"[^{SPACE}]")))
    df = df.withColumn("_good", F.filter("_lines", lambda x: ~_line_fails(x, rules)))
    df = df.withColumns(
        {
            "word_chars": (F.length("_t") - F.regexp_count("_t", F.lit(rf"[{SPACE}]"))).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_words": F.size("_w").cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            # each window covers up to the next one
            "n_repeat_words": F.expr("CASE WHEN _p IS NULL THEN 0L ELSE aggregate(_p, named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct('n', a.n + 5 - greatest(a.upto - x, 0), 'upto', x + 5), a -> a.n) END"),
            "clean_text": F.array_join("_good", "\n"),
        }
    )
    df = df.withColumn("n_lost", F.col("n_words") - F.regexp_count("clean_text", F.lit(WORD)))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost") <= rules.lost_share * F.col("n_words")))
    return df.select(*docs.columns, *added)
