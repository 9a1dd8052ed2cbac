"""Encoding of a corpus with a public byte-level BPE tokenizer, each shared chunk once.

1. Texts are cut into chunks where a rolling hash of the last 16 bytes says so, so the same
   passage gives the same chunks wherever it stands. A first pass notes the chunks' hashes in a
   bit table, by which most chunks are known to come once in the corpus.
2. Every distinct chunk that may come again is encoded once and joined back to its places. The
   others are encoded where they stand; a text that has none but those never leaves its task.
3. At a joint of two chunks the tokens may differ from those of the whole text. The pattern that
   splits a text before the merges always splits before a blank that follows a visible
   character, whatever stands around it: up to the last such place of the left chunk and from
   the first one of the right chunk the chunks' tokens agree with the whole text's. What lies
   between is encoded again, over as many chunks as it takes until both sides agree.
The result equals that of encoding each text as a whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, file_bytes, sent, spread
from .shingles import U, mix

#: Fixed value: the split pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A chunk has at least, on average and at most so many bytes (the last is exceeded by a character at most).
LEAST, MEAN_BITS, MOST = 64, 8, 16384
#: Most cells of the table of repeated chunks as a power of two.
MOST_CELLS = 26
#: Distinct chunks that a task remembers having sent.
REMEMBERED = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary files keep `name`."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """(encode, bytes of each id) of the rank file at `path`; once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        spelled[i] = piece
    return own.encode_ordinary, spelled


_BYTE = mix(np.arange(1, 257, dtype=U))


def chunks(data: bytes) -> list[bytes]:
    """data (UTF-8) cut by content; chunks end at character boundaries and join to data again."""
    if len(data) <= LEAST:
        return [data] if data else []
    raw = np.frombuffer(data, np.uint8)
    h, width, factor = _BYTE[raw], 1, 0x9E3779B97F4A7C15
    while width < 16:  # doubles the window each time
        wide = h.copy()
        wide[width:] += h[:-width] * U(factor)
        h, width, factor = wide, width * 2, factor * factor % (1 << 64)
    ends = (mix(h) >> U(64 - MEAN_BITS)) == 0
    head = np.append((raw[1:] & 0xC0) != 0x80, True)  # the next byte begins a character
    places = np.flatnonzero(ends & head) + 1
    out, start = [], 0
    for p in [*places.tolist(), len(data)]:
        while p - start > MOST:
            stop = start + MOST
            while stop < p and raw[stop] & 0xC0 == 0x80:
                stop += 1
            out.append(data[start:stop])
            start = stop
        if p - start >= LEAST or p == len(data) and p > start:
            out.append(data[start:p])
            start = p
    return out


def _safe(data: bytes) -> tuple[int, int]:
    """First and last place of `data` before a blank that follows a character which isn't white space; -1 if there is none.

    Only characters that can be told by two bytes count: ASCII, U+00C0 to U+07FF, and all from U+3040.
    """
    first = last = -1
    at = data.find(b" ", 1)
    while at > 0:
        if _visible(data, at):
            first = at
            break
        at = data.find(b" ", at + 1)
    if first < 0:
        return -1, -1
    at = data.rfind(b" ")
    while at > first and not _visible(data, at):
        at = data.rfind(b" ", 0, at)
    last = max(first, at)
    return first, last


def _visible(data: bytes, at: int) -> bool:
    """Whether the character before `at` surely isn't white space."""
    c = data[at - 1]
    if c < 0x80:
        return 0x21 <= c <= 0x7E
    i = at - 1
    while i > 0 and data[i] & 0xC0 == 0x80:
        i -= 1
    lead = data[i]
    return 0xC3 <= lead <= 0xDF or 0xE4 <= lead or lead == 0xE3 and at - i == 3 and data[i + 1] >= 0x81


def joined(parts: list[np.ndarray], path: str) -> np.ndarray:
    """The ids of a text from those of its chunks, joints repaired."""
    if len(parts) < 2:
        return parts[0] if parts else np.zeros(0, np.int32)
    encode, spelled = encoder(path)
    out: list[np.ndarray] = []
    window: list[bytes] = []
    last = len(parts) - 1
    for i, ids in enumerate(parts):
        pieces = [spelled[x] for x in ids.tolist()]
        data = b"".join(pieces)
        first, final = _safe(data)
        if first < 0:
            window.append(data)  # neither joint can be settled here
            continue
        ends = np.cumsum([len(p) for p in pieces])
        a = int(np.searchsorted(ends, first)) + 1  # tokens before the first safe place
        b = int(np.searchsorted(ends, final)) + 1 if i < last else len(ids)
        if i:
            window.append(data[:first])
            out.append(np.array(encode(b"".join(window).decode("utf-8")), np.int32))
        else:
            a = 0
        out.append(ids[a:b])
        window = [data[final:]] if i < last else []
    if window:
        out.append(np.array(encode(b"".join(window).decode("utf-8")), np.int32))
    return np.concatenate(out)


def _key(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def _cell(key: bytes, bits: int) -> int:
    return int.from_bytes(key[:8], "big") >> (64 - bits)


def repeated_cells(documents: DataFrame) -> Broadcast:
    """A bit table of the cells in which more than one chunk of `documents` (doc_id, text) falls.

    It has 64 to 128 cells a chunk by the size of the files, but at most 2^MOST_CELLS (8 MB); beyond
    that more chunks than need be count as repeated, which costs work and changes no result.
    Tasks send a block of it where they have a chunk; blocks are joined on the executors.
    """
    bits = min(MOST_CELLS, max(16, (file_bytes(documents) >> MEAN_BITS).bit_length() + 6))
    block = (1 << bits) // 8 // min(512, (1 << bits) // 8 // 1024)
    names, kinds = ["block", "once", "more"], (pa.int32(), pa.binary(), pa.binary())

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for b in batches:
            for text in b.column(0).to_pylist():
                for part in chunks(text.encode("utf-8")) if text else ():
                    c = _cell(_key(part), bits)
                    counts[c] = min(2, counts[c] + 1)
        once, more = (np.packbits(counts >= n).reshape(-1, block) for n in (1, 2))
        at = np.flatnonzero(once.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array([x[i].tobytes() for i in at], pa.binary()) for x in (once, more))], names)

    def joined_blocks(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(block, np.uint8), np.zeros(block, np.uint8)
        for b in parts:
            for x, y in zip(b.column("once"), b.column("more")):
                o = np.frombuffer(x.as_buffer(), np.uint8)
                more |= np.frombuffer(y.as_buffer(), np.uint8) | once & o
                once |= o
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([more.tobytes()], pa.binary())], names)

    out = np.zeros((1 << bits) // 8, np.uint8)
    kind = "block int, once binary, more binary"
    for r in spread(documents.select("text")).mapInArrow(note, kind).groupBy("block").applyInArrow(joined_blocks, kind).select("block", "more").collect():  # the table itself
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(bytes(r.more), np.uint8)
    return sent(documents.sparkSession, out.tobytes())


_PIECE = "uid bigint, doc_id bigint, seq int, key binary, chunk binary, ids array<int>"
_PIECE_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()))


def _cut_up(path: str, table: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of texts: a whole text (seq -1, ids), or its chunks, with their ids or, if they may come again, their bytes or just their key."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, again = encoder(path)[0], table.value
        bits = len(again).bit_length() + 2
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        known: set[bytes] = set()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                uid += 1
                parts = chunks(text.encode("utf-8")) if text else []
                keys = [_key(x) for x in parts]
                cells_ = [_cell(k, bits) for k in keys]
                shared = [again[c >> 3] >> (7 - (c & 7)) & 1 for c in cells_]
                if not any(shared):
                    rows.append((uid, doc, -1, None, None, encode(text) if text else []))
                    continue
                for seq, (part, key, often) in enumerate(zip(parts, keys, shared)):
                    if not often:
                        rows.append((uid, doc, seq, None, None, encode(part.decode("utf-8"))))
                    elif key in known:
                        rows.append((uid, doc, seq, key, None, None))
                    else:
                        rows.append((uid, doc, seq, key, part, None))
                        if len(known) < REMEMBERED:
                            known.add(key)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_PIECE_KINDS)], ["uid", "doc_id", "seq", "key", "chunk", "ids"])

    return fn


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of `documents` (doc_id, text): the ids of each text without special tokens.

    Null and empty texts have an empty list of ids. Every row comes out, repeated ones too,
    texts are encoded whole, and strings that look like control tokens are ordinary text.
    `path` is a rank file (byte_bpe_50k by default) that all executors can read.
    """
    path = path or vocabulary_path()
    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    pieces = cut(spread(rows).mapInArrow(_cut_up(path, repeated_cells(rows)), _PIECE), "chunks")

    def encode_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)[0]
        for b in batches:
            ids = [encode(x.decode("utf-8")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "encoded"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        uid = doc = None
        out: tuple[list, list] = ([], [])
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.cumsum([0, *map(len, out[1])])
            values = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int32)
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values, pa.int32()))], ["doc_id", "ids"])
            out[0].clear(), out[1].clear()
            return batch

        for b in batches:
            lists = b.column(3)
            ids, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum([len(x) if x.is_valid else 0 for x in lists]))
            for k, (u, d) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if u != uid:
                    if uid is not None:
                        out[0].append(doc), out[1].append(joined(held, path))
                        size += len(out[1][-1])
                    uid, doc, held = u, d, []
                    if size > 1_000_000:
                        yield flush()
                        size = 0
                held.append(ids[ends[k] : ends[k + 1]])
        if uid is not None:
            out[0].append(doc), out[1].append(joined(held, path))
        yield flush()

    once = pieces.where("chunk IS NOT NULL").groupBy("key").agg(F.first("chunk").alias("chunk")).mapInArrow(encode_each, "key binary, encoded array<int>")
    own = pieces.where("seq >= 0 AND key IS NULL").select("uid", "doc_id", "seq", "ids")
    shared = pieces.where("seq >= 0 AND key IS NOT NULL").select("uid", "doc_id", "seq", "key").join(once, "key").select("uid", "doc_id", "seq", F.col("encoded").alias("ids"))
    put_together = own.unionByName(shared).repartition("uid").sortWithinPartitions("uid", "seq").mapInArrow(assemble, "doc_id bigint, ids array<int>")
    return pieces.where("seq < 0").select("doc_id", "ids").unionByName(put_together)


def token_counts(texts: Iterator[str | None], path: str) -> list[int]:
    """Number of tokens of each text; null and empty texts have none."""
    encode = encoder(path)[0]
    return [len(encode(x)) if x else 0 for x in texts]
