"""Token-id files in canonical length-limited Huffman code.

1. Texts are range-partitioned and sorted by ``doc_id`` and tokenised once; the ids are kept as
   16- or 32-bit integers in *chunks* of whole documents (a table in the shared folder).
2. The counts of all ids (at most one row per vocabulary entry) reach the driver, where package-merge
   makes the code lengths; the canonical code follows from the lengths alone.
3. Each chunk becomes one independent block: the bits of its ids, and the bit offset of every
   ``CHECKPOINT``-th id. Blocks are Parquet rows in folders ``shard=k``, whose numbers, as the blocks in
   them, ascend by ``doc_id``; ``lengths`` beside them holds the code.
4. Reading decodes all checkpoints of a block side by side through one table indexed by the next
   ``max_len`` bits.

Defined cases: a null text is an empty one; each document ends with ``end_id``, so an empty one has one id;
rows of equal ``doc_id`` are ordered by their text, a null ``doc_id`` comes first; an empty table gives an
empty result; other columns are dropped. A document is never split over blocks, so a block holds at least
one whole text; memory is bounded by the chunk size or the longest text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_path
from .common import byte_slices, free, saved, small_batches

TOKENIZER_FILE = "byte_bpe_50k.json"
MAX_LEN, CHECKPOINT, PACKED, CHUNK_IDS = 16, 256, 1 << 14, 1 << 18  # PACKED: a multiple of CHECKPOINT
CACHE_WORDS, CACHE_CHARS, JOINED_WORDS, JOINED_TEXTS, SLICE = 800_000, 1 << 25, 32, 32, 4 << 20

_TOKENIZERS: dict = {}


#: White space beyond ASCII, as numbers of its UTF-8 bytes
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace() or c == "\u180e"]
WIDE_SPACES = np.array([int.from_bytes(c) for c in _WIDE])


def byte_table(*groups: tuple[bytes, int], rest: int = 0) -> bytes:
    out = bytearray([rest]) * 256
    for some, flag in groups:
        for c in some:
            out[c] = flag
    return bytes(out)


#: A stretch begins at a byte if it and the one before it share a flag: 1 for a blank behind no white space, 2 for a
#: mark behind a letter, 4 for a blank behind a byte that may end one of the wide spaces.
BLANKS = byte_table((b" ", 5))
BLANKS_MARKS = byte_table((b" \n", 5), (b".,;:!?", 2))
BEFORE = byte_table(
    (bytes([*range(9, 14), *range(28, 33)]), 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3), (bytes(c[-1] for c in _WIDE), 4), rest=1
)


def stretches(raw: bytes, starts: np.ndarray, table: bytes) -> np.ndarray:
    """Where the stretches of joined UTF-8 texts begin: at each text's start, and where no match of the pre-tokenizer can go on, whatever stands around."""
    flags = np.zeros(len(raw), np.uint8)
    np.bitwise_and(np.frombuffer(raw.translate(table), np.uint8)[1:], np.frombuffer(raw.translate(BEFORE), np.uint8)[:-1], out=flags[1:])
    doubtful = np.flatnonzero(flags == 4)  # behind a byte of a longer character, so at least two bytes stand before
    text = np.frombuffer(raw, np.uint8)
    two = text[doubtful - 2].astype(np.int64) << 8 | text[doubtful - 1]
    three = text[np.maximum(doubtful - 3, 0)].astype(np.int64) << 16 | two
    flags[doubtful[np.isin(two, WIDE_SPACES) | np.isin(three, WIDE_SPACES)]] = 0
    flags[starts[starts < len(raw)]] = 1
    return np.flatnonzero(flags != 0)


class WordIds:
    """Ids of the :func:`stretches` of texts, each encoded once by the tokenizers library.

    No match of a GPT-2 style pattern goes on from another character to a blank. That of GPT-2 itself (byte level with
    its own pattern) goes neither on to a line feed nor from a letter to a mark; only there stretches begin at those too.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        kind = self.tokenizer.pre_tokenizer
        own = isinstance(kind, ByteLevel) and kind.use_regex and not kind.add_prefix_space
        self.table = BLANKS_MARKS if own else BLANKS
        # stretches of one blank (or line feed) and no other, which can be encoded many in a text
        self.joined = re.compile(r"[ \n][^ \n]*\S" if own else r" [^ ]*\S").fullmatch
        # ids whose bytes begin with a blank (line feed), which the vocabulary writes as U+0120 (U+010A)
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.begins[[k for w, k in self.tokenizer.get_vocab().items() if w[0] in ("\u0120\u010a" if own else "\u0120")]] = True

    def learn(self, new: list[bytes]) -> None:
        words = [w.decode() for w in new]
        some = [k for k, w in enumerate(words) if self.joined(w)]
        for k in range(0, len(some), JOINED_WORDS * JOINED_TEXTS):
            part = some[k : k + JOINED_WORDS * JOINED_TEXTS]
            texts = ["".join([words[j] for j in part[i : i + JOINED_WORDS]]) for i in range(0, len(part), JOINED_WORDS)]
            ids = np.array(list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))), "<u4")
            at, raw = (4 * np.flatnonzero(self.begins[ids])).tolist(), ids.tobytes()
            self.known.update([(new[j], raw[a:b]) for j, a, b in zip(part, at, [*at[1:], len(raw)], strict=True)])
        for key, w in zip(new, words, strict=True):
            if key not in self.known:
                self.known[key] = np.array(self.tokenizer.encode_batch_fast([w], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        coded = [t.encode() for t in texts]
        raw = b"".join(coded)
        ends = np.cumsum([len(t) for t in coded], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        at = stretches(raw, starts, self.table)
        offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, old = self.known, self.old
        ids_of = list(map(known.get, words))
        at_absent = [k for k, x in enumerate(ids_of) if x is None]
        absent = [words[k] for k in at_absent]
        known.update((w, old[w]) for w in absent if w in old)
        self.learn([w for w in absent if w not in known])
        for k, w in zip(at_absent, absent, strict=True):
            ids_of[k] = known[w]
        ids = pa.array(ids_of, pa.large_binary()).take(found.indices)
        _, offsets, values = ids.buffers()
        cut = np.frombuffer(offsets, np.int64)[np.append(np.searchsorted(at, starts), len(at))] // 4 if len(at) else np.zeros(len(texts) + 1, np.int64)
        flat = np.frombuffer(values, "<u4") if values and cut[-1] else np.zeros(0, "<u4")
        self.size += sum(map(len, absent))
        if len(known) > CACHE_WORDS or self.size > CACHE_CHARS:  # what has not been met since the last time goes
            self.old, self.known, self.size = known, {}, 0
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


# ------------------------------------------------------------------------------ the code


def code_lengths(counts: np.ndarray, max_len: int) -> np.ndarray:
    """Package-merge: optimal code lengths of at most ``max_len`` bits; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_len:
        raise ValueError(f"{len(used)} ids need more than {max_len} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # each level: the leaves merged with the packages (pairs) of the level below; from[] says which is which
    is_leaf: list[np.ndarray] = []
    level = weight
    for _ in range(max_len):
        if not is_leaf:
            is_leaf.append(np.ones(n, bool))
            continue
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        is_leaf.append(at < n)
        level = both[at]
    take = 2 * (n - 1)
    bits = np.zeros(n, np.int64)
    for leaf in reversed(is_leaf):
        k = int(leaf[:take].sum())
        bits[:k] += 1
        take = 2 * (take - k)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by id; and, indexed by the next ``max`` bits, the id and its length."""
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    top = int(lengths.max(initial=1))
    size = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64) if len(order) else np.zeros(0, np.uint64)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = begin >> (np.uint64(top) - lengths[order].astype(np.uint64))
    table = np.zeros(1 << top, np.uint32)
    spread = np.repeat(order, size.astype(np.int64))
    table[: len(spread)] = spread
    return codes, table, lengths[table].astype(np.int64)


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, and the bit offset of every ``CHECKPOINT``-th."""
    lengths, total = lengths.astype(np.int64), 0
    words = np.zeros(len(ids) * int(lengths.max(initial=1)) // 32 + 3, np.uint64)
    points = np.zeros(-(-len(ids) // CHECKPOINT), np.int64)
    for k in range(0, len(ids), PACKED):  # few enough for the processor's cache
        some = ids[k : k + PACKED].astype(np.intp)
        size = lengths[some]
        end = total + np.cumsum(size)
        at, total = end - size, int(end[-1])
        # a code spans at most two 32-bit words: place it in 64 bits, add the halves (they never overlap)
        shifted = codes[some] << (64 - size - (at & 31)).astype(np.uint64)
        slot = at >> 5
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        words[slot[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        words[slot[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        points[k // CHECKPOINT : (k + PACKED) // CHECKPOINT] = at[::CHECKPOINT]
    return words[: total // 32 + 3].astype(">u4").tobytes()[: total // 8 + 9], points


def unpack(payload: bytes, n: int, at: np.ndarray, table: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All checkpoints of a block at once, one id of each a step."""
    top = len(table).bit_length() - 1
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    view = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    at = at.astype(np.int64)
    for i in range(min(CHECKPOINT, n)):
        np.minimum(at, 8 * (len(view) - 1), out=at)  # a last, short run reads on into the padding
        bits = (view[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - top)
        out[i] = table[bits]
        at += length[bits]
    return out.T.reshape(-1)[:n]


# ------------------------------------------------------------------------------ Spark jobs


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Chunks of whole documents in ascending ``doc_id`` order; the last of a partition has the counts of all its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pid, seq, start = word_ids(path), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        counts = np.zeros(0, np.int64)

        def chunk(last: bool = False) -> pa.RecordBatch:
            nonlocal seq, start, counts
            ids = np.concatenate(parts)
            more = np.bincount(ids, minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
            used = np.flatnonzero(counts) if last else np.zeros(0, np.int64)
            count = counts[used]
            row = {
                "pid": [pid], "seq": [seq], "start": [start], "doc_ids": [list(doc_ids)], "sizes": [[len(p) for p in parts]],
                "used": [used.astype(np.int32)], "count": [count], "wide": [bool(ids.max(initial=0) > 0xFFFF)],
            }
            row["ids"] = [ids.astype("<u4" if row["wide"][0] else "<u2").tobytes()]
            seq, start = seq + 1, start + len(ids)
            doc_ids.clear(), parts.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        held = 0
        schema = pa.schema(
            [("pid", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int64())),
             ("used", pa.list_(pa.int32())), ("count", pa.list_(pa.int64())), ("ids", pa.binary()), ("wide", pa.bool_())]
        )
        end = np.array([end_id], "<u4")
        for batch in batches:
            for some in byte_slices(batch, "text", SLICE):
                texts = [t or "" for t in some.column("text").to_pylist()]
                for d, ids in zip(some.column("doc_id").to_pylist(), words.batch(texts), strict=True):
                    if parts and held + len(ids) >= CHUNK_IDS:
                        yield chunk()
                        held = 0
                    doc_ids.append(d)
                    parts.append(np.concatenate([ids, end]))
                    held += len(parts[-1])
        if parts:
            yield chunk(last=True)

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    # ranges of id and hash, so that the rows of one id may lie in several; the driver's sample of the ranges holds no texts
    (by,) = free(["doc_id", "text"], "hash")
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias(by)).repartitionByRange("doc_id", by).sortWithinPartitions("doc_id", by, "text").select("doc_id", "text")
    return ordered.mapInArrow(
        run,
        f"pid int, seq int, start bigint, doc_ids array<{kind}>, sizes array<bigint>, used array<int>, count array<bigint>, ids binary, wide boolean",
    )


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, max_len: int = MAX_LEN) -> str:
    """Write the ids of all texts as Huffman blocks under the shared folder; the folder's path."""
    spark = docs.sparkSession
    small_batches(spark)
    chunks = saved(tokenised(docs, tokenizer or public_tokenizers.path(TOKENIZER_FILE), end_id), "token-chunks", compression="zstd")
    # bounded by the vocabulary
    counted = chunks.select(F.explode(F.arrays_zip("used", "count")).alias("x")).groupBy("x.used").agg(F.sum("x.count")).collect()
    counts = np.zeros(max([end_id, *(r[0] for r in counted)]) + 1, np.int64)
    for k, n in counted:
        counts[k] = n
    lengths = code_lengths(counts, max(max_len, int(np.count_nonzero(counts)).bit_length()))
    codes = canonical(lengths)[0]
    # one row for each range partition
    totals = sorted(chunks.groupBy("pid").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).collect())
    offsets, at = {}, 0
    for pid, n in totals:
        offsets[pid], at = at, at + n
    code = spark.sparkContext.broadcast((codes, lengths, offsets))
    kind = chunks.schema["doc_ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths, offsets = code.value
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                pid = row.column("pid")[0].as_py()
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), "<u4" if row.column("wide")[0].as_py() else "<u2")
                payload, points = pack(ids, codes, lengths)
                yield pa.RecordBatch.from_arrays(
                    [row.column("pid"), row.column("seq"), pa.array([row.column("start")[0].as_py() + offsets[pid]]), row.column("doc_ids"),
                     row.column("sizes"), pa.array([len(ids)]), pa.array([points], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                    names=["shard", "seq", "start", "doc_ids", "sizes", "n", "checkpoints", "payload"],
                )

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    blocks = chunks.select("pid", "seq", "start", "doc_ids", "sizes", "ids", "wide").mapInArrow(
        run, f"shard int, seq int, start bigint, doc_ids {kind}, sizes array<bigint>, n bigint, checkpoints array<bigint>, payload binary"
    )
    path = shared_path(spark, "token-files")
    blocks.write.partitionBy("shard").option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()), docs.schema["doc_id"].dataType.simpleString())], "lengths binary, kind string").coalesce(1).write.parquet(f"{path}/lengths")
    return path


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files; with ``keep_ids`` also ``ids`` (array of long)."""
    head = spark.read.parquet(f"{path}/lengths").first()
    lengths, kind = np.frombuffer(head["lengths"], np.uint8), head["kind"]
    code = spark.sparkContext.broadcast(lengths)
    small_batches(spark, 8)
    if not lengths.any():
        return spark.createDataFrame([], f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids)
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, length = canonical(code.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["n"], np.array(row["checkpoints"]), table, length)
                raw, sizes = memoryview(ids.astype("<u4").tobytes()), row["sizes"]
                end = np.cumsum(sizes)
                begin = end - sizes
                cols = [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(begin + row["start"], pa.int64()),
                        pa.array(sizes, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin, end, strict=True)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array([ids[a:b] for a, b in zip(begin, end, strict=True)], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return blocks.select("start", "doc_ids", "sizes", "n", "checkpoints", "payload").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    )
