"""Byte-level BPE encoding and decoding as a reduction over a balanced tree.

Encoding splits a text in halves down to leaves, encodes these, and joins neighbours. The result of a
part is ``(first, middle, last)``: the ids between its first and last *safe cut*, and the two pending
words at its edges. A safe cut (a blank between two other characters) ends a match of the
pre-tokenizer whatever surrounds it, so ids beyond the pending words cannot change any more; a join
re-encodes only the two words that meet. Inside one match of the pre-tokenizer the same reduction runs
over bytes: two encoded halves are joined by re-encoding a window around the seam that doubles until
the tokens at both of its edges are compatible with their outer neighbours. A token sequence is the BPE
encoding of its bytes exactly if every adjacent pair is, so the tokens outside the window are proven
stable. Decoding concatenates token bytes up the tree.

Defined cases: a null text is an empty one (no ids, digest of the empty string); repeated rows each
give a row; a null ``doc_id`` is passed through; an empty table gives an empty result; other columns
are dropped, whatever their names. Lone surrogates cannot occur (Spark strings are UTF-8).

Work and memory: one map-only pass; per task a bounded word cache; a text of any length costs
O(n log n) in Python, so no single row blows up.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import SAFE_CUT, safe_words, small_batches

RANKS_FILE = "byte_bpe_50k.tiktoken"
LEAF_CHARS, LEAF_BYTES, CACHE_WORDS = 1 << 15, 32, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    """Encoder and decoder for one table of ranks and one pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocab = {v: k for k, v in ranks.items()}
        self.matches = regex.compile(pattern)
        self.library = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # ---- inside one match of the pre-tokenizer (bytes)

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is known."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        rank = self.ranks.get
        part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(piece) - 1) if (r := rank(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j >= len(part) or part[j] != y:
                continue  # one of the two has been merged meanwhile
            part[i], part[j], after[i] = x + y, None, after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < len(part) and (r := rank(part[k] + part[m])) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[m]))
        return [self.ranks[p] for p in part if p is not None]

    def compatible(self, x: int, y: int) -> bool:
        if (known := self.pairs.get((x, y))) is None:
            if len(self.pairs) > CACHE_WORDS:
                self.pairs.clear()
            known = self.pairs[x, y] = self.leaf(self.vocab[x] + self.vocab[y]) == [x, y]
        return known

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        k = 1
        while True:
            left, right = a[:-k], b[k:]
            raw = b"".join(map(self.vocab.__getitem__, a[-k:] + b[:k]))
            mid = self.leaf(raw)
            if (not left or self.compatible(left[-1], mid[0])) and (not right or self.compatible(mid[-1], right[0])):
                return left + mid + right
            k *= 2

    def piece(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF_BYTES or raw in self.ranks:
            return self.leaf(raw)
        half = len(raw) // 2
        return self.joined(self.piece(raw[:half]), self.piece(raw[half:]))

    # ---- over the text

    def word(self, text: str) -> bytes:
        """Ids (unsigned 32-bit, little-endian) of a stretch between two safe cuts."""
        if (ids := self.words.get(text)) is None:
            if len(text) > LEAF_BYTES:
                ids = array("I", [t for m in self.matches.findall(text) for t in self.piece(m.encode())]).tobytes()
            else:
                ids = array("I", self.library.encode_ordinary(text)).tobytes()
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[text] = ids
        return ids

    def part(self, text: str) -> tuple[str, bytes, str | None]:
        if len(text) > LEAF_CHARS:
            half = len(text) // 2
            (f1, m1, l1), (f2, m2, l2) = self.part(text[:half]), self.part(text[half:])
            cut = SAFE_CUT.split(f1 + f2 if l1 is None else l1 + f2)
            seam = [cut[0], *(" " + w for w in cut[1:])]
            if l1 is None:  # the left part is one pending word: the first of the seam stays pending
                f1 = seam.pop(0)
            if l2 is None:  # the right part is one pending word: the last of the seam stays pending
                last = seam.pop() if seam else None
            else:
                last = l2
            return f1, m1 + b"".join(map(self.word, seam)) + m2, last
        first, *rest = safe_words(text)
        if not rest:
            return first, b"", None
        word = self.word
        return first, b"".join([word(" " + w) for w in rest[:-1]]), " " + rest[-1]

    def encode(self, text: str) -> bytes:
        first, middle, last = self.part(text)
        return self.word(first) + middle + (b"" if last is None else self.word(last))

    def decode(self, ids: array) -> bytes:
        if len(ids) > 1 << 16:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.vocab.__getitem__, ids))


_LOADED: dict[tuple[str, str], TreeBPE] = {}


def coder(path: str, pattern: str) -> TreeBPE:
    """One per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = TreeBPE(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text; with ``keep_ids`` also ``ids`` (binary,
    unsigned 32-bit little-endian) and ``decoded`` (binary)."""
    path, pattern = path or public_tokenizers.path(RANKS_FILE), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column("text"):
                raw = bpe.encode(text.as_py() or "")
                ids = array("I", raw)
                back = bpe.decode(ids)
                values = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), raw, back)
                for col, v in zip(cols, values if keep_ids else values[:3], strict=False):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            names = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
            n = 5 if keep_ids else 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols[:n], types, strict=False))], names=["doc_id", *names[:n]]
            )

    more = ", ids binary, decoded binary" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
