"""Token counts by the whole-token shortcut.

BPE joins neighbours within a stretch of text that no vocabulary entry can cross, so
such stretches (pre-tokens) are counted one by one.  Which vocabulary strings come out
of BPE as themselves is proved once when the vocabulary is loaded; a pre-token among
them counts 1 without any merging, and only the others are merged.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import tidy


CACHE_WORDS = 250_000
SPACE = "▁"  # stands for a space in vocabulary entries
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class _Counts(dict):
    """Tokens of a pre-token; merges it when it is asked for the first time."""

    def __init__(self, merge, whole: dict[str, int]) -> None:
        super().__init__(whole)
        self.merge, self.whole, self.older = merge, whole, {}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.merge(word)
        if len(word) <= 64:
            self[word] = n
        return n

    def trim(self) -> None:
        """Starts a new generation when this one is full; what is asked for again moves on."""
        if len(self) > CACHE_WORDS + len(self.whole):
            self.older = dict(self)
            self.clear()
            self.update(self.whole)


class PieceCounter:
    """Counts tokens as sentencepiece does for a BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if trainer.model_type != 2 or not trainer.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or kinds & {USER, UNUSED}:
            raise ValueError(f"{path}: only plain BPE with byte fallback and without normalization")
        self.prefix = norm.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError(f"{path}: an entry crosses a space")
        self.lines = not any("\n" in p for p in self.score)
        whole = {p for p in self.score if len(self.merge(p)) == 1}
        self.plain = _Counts(self.count_merged, dict.fromkeys(whole, 1))
        # by the word after a single space, without that space
        self.spaced = _Counts(lambda w: self.count_merged(SPACE + w), {p[1:]: 1 for p in whole if p[0] == SPACE and p[1:2] != SPACE})
        self.stretches = re.compile(" +[^ ]*|[^ ]+").findall

    def merge(self, text: str) -> list[str]:
        """Symbols that BPE leaves: joins the neighbours of the best score, leftmost first."""
        parts, score = list(text), self.score.get
        if len(parts) > 48:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list) -> list[str]:
        n, score = len(parts), self.score.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joint = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != joint:
                continue
            parts[i], parts[j] = joint, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := score(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def count_merged(self, text: str) -> int:
        # what is not in the vocabulary is spelled in bytes
        return sum(1 if p in self.score else len(p.encode("utf-8")) for p in self.merge(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.prefix:
            text = " " + text
        if not self.lines:
            return sum(self.plain[s.replace(" ", SPACE)] for s in self.stretches(text))
        plain, spaced = self.plain, self.spaced.__getitem__
        parts = text.split("\n")
        total = len(parts) - 1  # a line end is in no entry: one byte, one token
        for line in parts:
            if not line:
                continue
            if "  " in line or line[-1] == " ":
                total += sum([plain[s.replace(" ", SPACE)] for s in self.stretches(line)])
                continue
            first, *rest = line.split(" ")
            if first:
                total += plain[first]
            total += sum(map(spaced, rest))
        return total

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for t in texts:
            out.append(self.count(t))
            self.plain.trim()
            self.spaced.trim()
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` must name the same sentencepiece model on every machine.  A null text counts
    as empty and has no tokens; repeated rows give repeated rows, an empty table an empty one;
    other columns are not read, whatever their names.  A text of any length is counted whole.
    Each worker keeps two generations of ``CACHE_WORDS`` counted pre-tokens.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        counter, out = load(path), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).fill_null("")
                counts = counter.counts(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(out[0].type), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], schema=out)

    return docs.select(key, text).mapInArrow(tidy(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
