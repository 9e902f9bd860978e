"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

For every prefix of a word, BPE's encoding ends in one token, and dropping it leaves
the encoding of a shorter prefix.  So a prefix is fully described by its last token:
the one vocabulary entry that ends there and that BPE would leave unmerged beside the
last token of the prefix before it.  Distinct words are put in order, which visits
their trie depth first; the last-token states of a common prefix are computed once
and kept on a stack while the words below it are encoded.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowmap import tidy

#: The pre-tokenizer pattern of byte-level BPE, with white space spelled out as a Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

CACHE_WORDS = 200_000
LONG_WORD = 256
GROUP_PIECES, GROUP_CHARS = 100_000, 1 << 22


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, to the byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec["normalizer"] or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space")
        alphabet = byte_alphabet()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        # Tokens are handled by rank: 0-255 are single bytes, 256 + n is made by merge n.
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        rank_of = {}
        self.id_of = []
        for t, b in alphabet.items():
            if t in vocab:
                rank_of[t] = len(self.id_of)
                self.id_of.append(vocab[t])
        base = len(self.id_of)
        self.left, self.right = list(range(base)), list(range(base))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in rank_of:  # made by an earlier merge: this pair joins at its own rank, which a rank alone can't say
                raise ValueError(f"{path}: {a + b} is made by two merges")
            rank_of[a + b] = r = len(self.id_of)
            self.id_of.append(vocab[a + b])
            self.left.append(rank_of[a])
            self.right.append(rank_of[b])
            self.pairs[rank_of[a], rank_of[b]] = r
        self.rank = {as_bytes(t): r for t, r in rank_of.items()}
        self._grow_trie()
        self.own_bytes = [self.bytes_of[i] for i in self.id_of]
        self.text_of = [str(i) for i in self.id_of]
        self.size = [len(b) for b in self.own_bytes]
        self.beside: dict[int, bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.cache: dict[str, str] = {}  # a word's ids, joined by commas
        self.older: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}  # what words decode to, where that isn't the word itself
        self.long: list[str] = []  # words that leave the cache with their group

    def stays(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b as they are when their bytes stand side by side.

        Undoes merges from the latest on.  At every step the two tokens at the border are
        those that BPE has had there at some time; if they merge by a rank earlier than
        the merges that are undone so far, BPE would have joined them.
        """
        key, limit = (a << 20) | b, len(self.id_of)
        while True:
            joint = self.pairs.get((a, b))
            if joint is not None and joint < limit:
                out = False
                break
            # of the two, the later merge is undone; of equal ones, the right-hand one, as BPE merges from the left
            if a > b and self.right[a] != a:
                limit, a = a, self.right[a]
            elif self.left[b] != b:
                limit, b = b + 1, self.left[b]
            elif self.right[a] != a:
                limit, a = a, self.right[a]
            else:
                out = True
                break
        if len(self.beside) > 300_000:
            self.beside.clear()
        self.beside[key] = out
        return out

    def _grow_trie(self) -> None:
        """The vocabulary as a trie, (node, byte) to node, a depth at a time.

        ``back`` leads from a node to that of its longest proper suffix, and ``ends`` has
        the tokens that end at a node, the longest first.
        """
        self.step, self.back, self.ends = {}, [0], [()]
        live = [(t, r, 0) for t, r in self.rank.items() if self.alone(r)]
        depth = 0
        while live:
            made, done, following = len(self.back), {}, []
            for t, r, node in live:
                key = (node << 8) | t[depth]
                child = self.step.get(key)
                if child is None:
                    child = self.step[key] = len(self.back)
                    self.back.append(self._from(self.back[node], t[depth]) if depth else 0)
                if len(t) == depth + 1:
                    done[child] = r
                else:
                    following.append((t, r, child))
            for node in range(made, len(self.back)):
                shorter = self.ends[self.back[node]]
                self.ends.append((done[node], *shorter) if node in done else shorter)
            live, depth = following, depth + 1

    def _from(self, node: int, byte: int) -> int:
        """The node of the longest suffix that goes on with a byte."""
        while node and (node << 8) | byte not in self.step:
            node = self.back[node]
        return self.step.get((node << 8) | byte, 0)

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[array]:
        """Ranks of each of the words, which come in order.

        The state of a prefix is its last token and the vocabulary node of its longest
        suffix.  Both stand on a stack as deep as the path, in eight bytes for each byte.
        """
        last, nodes = array("i", [-1]), array("i", [0])
        path = b""
        step, back, ends, known, size = self.step, self.back, self.ends, self.beside, self.size
        for word in words:
            keep, top = 0, min(len(path), len(word))
            while keep < top and path[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :], nodes[keep + 1 :]
            node = nodes[keep]
            for at in range(keep, len(word)):
                byte = word[at]
                following = step.get((node << 8) | byte)
                while following is None:
                    if not node:
                        raise ValueError(f"no token holds byte {byte}")
                    node = back[node]
                    following = step.get((node << 8) | byte)
                node = following
                for r in ends[node]:
                    start = at + 1 - size[r]
                    if not start:
                        break
                    fits = known.get((last[start] << 20) | r)
                    if self.stays(last[start], r) if fits is None else fits:
                        break
                else:
                    raise ValueError(f"no token ends at byte {at} of {word[:40]!r}")
                last.append(r)
                nodes.append(node)
            path = word
            out, at = array("i"), len(word)
            while at:
                out.append(last[at])
                at -= size[last[at]]
            out.reverse()
            yield out

    def alone(self, r: int) -> bool:
        """Whether BPE makes this token of its own bytes."""
        return self.merge([self.rank[bytes([b])] for b in self.bytes_of[self.id_of[r]]]) == [r]

    def merge(self, parts: list[int]) -> list[int]:
        """Plain BPE over ranks: joins the pair of the lowest rank, leftmost first."""
        parts = list(parts)
        while len(parts) > 1:
            best = min(((self.pairs.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            r, out, i = best[0], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.pairs.get((parts[i], parts[i + 1])) == r:
                    out.append(r)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def learn(self, words: set[str]) -> None:
        """Encodes words that the cache lacks; the cache holds two generations of ``CACHE_WORDS`` at most beside those of one group."""
        new = words.difference(self.cache)
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_WORDS:
            # words of the last generation that come again move on to the next one
            self.older, self.cache = self.cache, {w: self.cache[w] for w in words if w in self.cache}
        again = new.intersection(self.older)
        for w in again:
            self.cache[w] = self.older[w]
        new -= again
        by_bytes = sorted((w.encode("utf-8"), w) for w in new)
        for (raw, w), ranks in zip(by_bytes, self.encode_sorted(b for b, _ in by_bytes), strict=True):
            self.cache[w] = ",".join([self.text_of[r] for r in ranks])
            # in parts, as a join of bytes takes eighty of them for each item
            back = b"".join([b"".join([self.own_bytes[r] for r in ranks[i : i + 65536]]) for i in range(0, len(ranks), 65536)])
            if back != raw:
                self.odd[w] = back
            if len(w) > LONG_WORD:
                self.long.append(w)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order."""
        if not self.cut or not any(s in text for s in self.special):
            return self.split(text)
        return [p for i, part in enumerate(self.cut(text)) for p in ([part] if i % 2 else self.split(part))]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[str], dict]]:
        """For each text its pieces, and the table of ids, as text, by piece.

        Groups of texts share one traversal.
        """
        group, seen, chars = [], 0, 0
        for text in texts:
            group.append(self.pieces(text))
            seen += len(group[-1])
            chars += len(text)
            if seen > GROUP_PIECES or chars > GROUP_CHARS:
                yield from self._flush(group)
                group, seen, chars = [], 0, 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[tuple[list[str], dict]]:
        self.learn(set().union(*group))
        for special, i in self.special.items():
            self.cache[special] = str(i)
        for pieces in group:
            yield pieces, self.cache
        for word in self.long:
            self.cache.pop(word, None)
            self.odd.pop(word, None)
        self.long.clear()

    def ids(self, text: str) -> list[int]:
        return [int(i) for pieces, table in self.encode([text]) for p in pieces for i in table[p].split(",") if i]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> TrieBpe:
    """One encoder for each worker process and file; its cache serves all tasks of the worker."""
    return TrieBpe(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token counts and digests of every text, encoded and decoded again.

    Returns key, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded text in UTF-8), and with ``with_ids`` the ids and
    the decoded text themselves.  ``path`` must name the same file on every machine.
    A null text counts as empty: no tokens, digests of the empty string.  A null key stays
    null; rows that repeat give repeated rows, and an empty table gives none.  Other columns
    are not read, so names like those of the results do no harm.  A text of any length is
    encoded as a whole; its longest word takes some dozens of bytes of memory for each byte.
    """
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe, out_schema = load(path), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
                for pieces, table in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = ",".join([table[p] for p in pieces])
                    # what each piece decodes to was looked at when it was encoded
                    back = "".join(pieces) if not bpe.odd else b"".join([bpe.odd.get(p) or p.encode() for p in pieces]).decode("utf-8", "replace")
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                    if with_ids:
                        all_ids.append([int(i) for i in ids.split(",")] if ids else [])
                        decoded.append(back)
                columns = [part.column(0), counts, ids_sha, text_sha] + ([all_ids, decoded] if with_ids else [])
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, out_schema, strict=True)], schema=out_schema)

    return docs.select(key, text).mapInArrow(tidy(run), schema)
