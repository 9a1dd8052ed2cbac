"""Sets of shingles (runs of k successive tokens) as numpy arrays, and sketches of their frequency.

Tokens are maximal runs of [a-z0-9] after lower-casing the whole text. A shingle is known by a
48-bit hash: two different shingles of one pair of texts are mistaken for each other with a
chance of about 1e-9, far below one pair in a corpus of this kind; everything else is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
HASH_BITS = 48
#: Texts are hashed in blocks of about so many bytes, so memory doesn't follow the batch.
BLOCK_BYTES = 2 << 20
#: Cells of the frequency sketch as a power of two. Its size is fixed: 4 MB, whatever the corpus.
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 14

_ALNUM = np.zeros(256, np.uint8)
_ALNUM[ord("0") : ord("9") + 1] = np.arange(1, 11)
_ALNUM[ord("a") : ord("z") + 1] = np.arange(11, 37)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def _token_hashes(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every token in `raw`, texts ending (exclusive) at `ends`, one byte apart."""
    code = _ALNUM[np.frombuffer(raw, np.uint8)]
    at = np.flatnonzero(code)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.empty(len(at), bool)
    first[0], first[1:] = True, np.diff(at) > 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, U))
    hashes = np.add.reduceat(code[at].astype(U) * powers[place], starts)
    return mix(hashes + lengths.astype(U)), np.searchsorted(ends, at[starts], side="right")


def _blocks(texts: Iterable[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    parts: list[bytes] = []
    size = 0
    for text in texts:
        part = text.lower().encode("utf-8", "surrogatepass") if text else b""
        parts.append(part)
        size += len(part) + 1
        if size >= BLOCK_BYTES:
            yield b"\0".join(parts) + b"\0", np.cumsum([len(p) + 1 for p in parts]) - 1
            parts, size = [], 0
    if parts:
        yield b"\0".join(parts) + b"\0", np.cumsum([len(p) + 1 for p in parts]) - 1


def lazily(column: pa.Array, step: int = 500) -> Iterator:
    """Values of an Arrow column, some hundred at a time, so a batch of long texts isn't held twice."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text its set of shingle hashes, sorted; null, empty and short texts have none."""
    salt = mix(np.arange(1, k + 1, dtype=U))
    for raw, ends in _blocks(texts):
        tokens, owner = _token_hashes(raw, ends)
        n = len(tokens) - k + 1
        if n <= 0:
            yield from (np.zeros(0, U) for _ in ends)
            continue
        h = np.zeros(n, U)
        for i in range(k):
            h += tokens[i : i + n] * (salt[i] | U(1))
        whole = owner[:n] == owner[k - 1 :]
        h, owner = (mix(h) >> U(64 - HASH_BITS))[whole], owner[:n][whole]
        bounds = np.searchsorted(owner, np.arange(len(ends) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(h[a:b])


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a shingle set; equal sets and only those share one (chance of a clash n^2 / 2^65)."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(s + U(0x51ED270B)))
        return int(mix(np.array([total + U(len(s)) * U(0x2545F4914F6CDD1D)]))[0].astype(np.int64))


class CellCounts:
    """Counts of hashed cells; memory is fixed at construction."""

    def __init__(self, bits: int = SKETCH_BITS):
        self.bits, self.counts, self.waiting, self.size = bits, np.zeros(1 << bits, np.uint32), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(cells(hashes, self.bits))
        self.size += len(hashes)
        if self.size > 4_000_000:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=1 << self.bits).astype(np.uint32)
            self.waiting, self.size = [], 0

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(block, one byte a cell) of blocks that hold anything; a count of over 255 in one task is as good as 255."""
        self.flush()
        for i in range(0, 1 << self.bits, SKETCH_BLOCK):
            part = self.counts[i : i + SKETCH_BLOCK]
            if part.any():
                yield i // SKETCH_BLOCK, np.minimum(part, 255).astype(np.uint8).tobytes()


def cells(hashes: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (hashes >> U(HASH_BITS - bits)).astype(np.int64)


def rank_table(rows: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Rows (block, counts) of all tasks as one byte a cell that grows with the logarithm of its count.

    By it rare shingles come first in the order; a cell without a shingle has 0. The blocks are
    summed on the executors in two levels, so no task sees more than a share of the tasks'
    rows, and the driver gets 2^bits bytes however large the corpus is.
    """

    def add(width: str, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
        def fn(key: tuple, t: pa.Table) -> pa.Table:
            total = np.zeros(SKETCH_BLOCK, np.int64)
            for x in t.column("counts"):
                total += np.frombuffer(x.as_buffer(), width)
            if last:
                total = np.minimum(255, np.ceil(8 * np.log2(1 + total))).astype(np.uint8)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

        return fn

    parts = rows.withColumn("__salt", F.spark_partition_id() % 16).groupBy("block", "__salt").applyInArrow(add("u1", False), "block int, counts binary")
    whole = parts.groupBy("block").applyInArrow(add("i8", True), "block int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in whole.collect():
        out[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(r.counts), np.uint8)
    return out


def rare_first(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles of a set in the common order: by the rank of their cell, then by hash."""
    return s[np.argsort(ranks[cells(s, int(len(ranks)).bit_length() - 1)], kind="stable")]


def pack48(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes | memoryview) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").reshape(-1)


def size_band(n: int) -> int:
    """The octave of a set's size: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return int(n).bit_length()


def parity_words(s: np.ndarray, band: int) -> np.ndarray:
    """Hashed bitmap of a set, in words of 64 bits: a bit is the parity of the set's shingles in its cell.

    It has 1 to 2 bits a shingle of the largest sets of the band, from 64 to 16384. Two sets differ
    in at least as many shingles as bits.
    """
    bits = min(14, max(6, band))
    cell = (s >> U(HASH_BITS - bits)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=1 << bits) & 1).astype(np.uint8)).view(np.uint64)


def needed_overlap(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """Fewest shared shingles with which sets of these sizes reach the similarity t."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)
