"""Exact candidate search for set similarity: every set posts its rarest shingles, its anchors.

Two sets of sizes a and b with a similarity of at least t share o = ceil(t / (1 + t) (a + b))
shingles, so in any common order of the shingles they share at least LEAST of the first
a - o + LEAST and b - o + LEAST. The order is rarest first by a frequency sketch of fixed size
over the whole corpus, so frequent shingles are hardly ever posted and lists stay short; any
order gives the same pairs. Postings travel packed, a row for each run of texts and tile.

A tile is a range of the hash within a size band (an octave of sizes): a set is posted in the band
of its own size and in those that a partner of up to size / t may have, and a pair is found in
the band of its larger set. With each set goes its bitmap, which has the width of the band, so the
bit counts of all pairs of a chunk are taken at once; they bound the overlap from above before
any set is read. A shingle that the sketch takes for hot is dealt to tiles of pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import HASH_BITS, U, cells, mix, needed_overlap, pack48, parity_words, rare_first, size_band, unpack48

#: Shared anchors that a pair must have (fewer if its sets are smaller than that).
LEAST = 8
#: Postings that a task holds before it writes a run, pairs expanded at once, and pairs whose bitmaps are held at once.
RUN, CHUNK, MAPS = 500_000, 500_000, 50_000
#: Bytes of packed rows that are read at once.
PIECE = 2 << 20
#: Sets of a list that are compared in one task; a longer one is split into blocks of about so many.
HOT = 20_000
#: Greatest place that is kept; the bit above it tells the block of a split list.
LAST_PLACE = 32767


def prefix_length(n: int, t: float) -> int:
    return min(n, n - int(np.ceil(t * n - 1e-9)) + LEAST)


class Run:
    """Postings of one run of sets, packed a tile at a time.

    banded: with size bands; mapped: with bitmaps too; hot: sets of a list beyond which it is split, 0 for never.
    """

    def __init__(self, buckets: int, t: float, ranks: np.ndarray, banded: bool = False, mapped: bool = False, hot: int = 0):
        self.buckets, self.t, self.ranks, self.banded, self.mapped, self.hot = buckets, t, ranks, banded, mapped, hot
        # what a cell of the sketch holds on average is no sign of a hot shingle
        self.mean = float(np.mean(np.exp2(ranks / 8) - 1)) if hot else 0.0
        self.clear()

    def clear(self) -> None:
        self.fps, self.sizes, self.hashes, self.maps, self.seen, self.posted = [], [], [], [], set(), 0

    def add(self, fp: int, s: np.ndarray) -> None:
        if fp in self.seen:
            return
        self.seen.add(fp)
        h = rare_first(s, self.ranks)[: prefix_length(len(s), self.t)]
        self.fps.append(fp)
        self.sizes.append(len(s))
        self.hashes.append(h)
        if self.mapped:
            self.maps.append([parity_words(s, band) for band in range(size_band(len(s)), size_band(int(len(s) / self.t + 1e-9)) + 1)])
        self.posted += len(h)

    def _bands(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.banded:
            return np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64)
        return bands_of(np.array(self.sizes, np.int64), self.t)

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        """Blocks that the list of each hash is split into, by the sketch."""
        if not self.hot:
            return np.ones(len(h), np.int64)
        often = np.exp2(self.ranks[cells(h, int(len(self.ranks)).bit_length() - 1)] / 8) - 1
        return np.where(often > 4 * self.mean + self.hot, np.ceil((often - self.mean) / self.hot), 1).astype(np.int64)

    def rows(self) -> pa.RecordBatch:
        first, bands = self._bands()
        lengths = np.array([len(h) for h in self.hashes], np.int64)
        h = np.concatenate(self.hashes) if self.hashes else np.zeros(0, U)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.minimum(np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths), LAST_PLACE)
        fps, sizes = np.array(self.fps, np.int64), np.array(self.sizes, np.uint32)
        blocks = self._blocks(h)
        mine = (mix(fps.view(U))[doc] % blocks.astype(U)).astype(np.int64)
        # a posting of a split list meets each block once
        copy = np.repeat(np.arange(len(h)), blocks)
        other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        h, doc, place, mine = h[copy], doc[copy], place[copy], mine[copy]
        low, high = np.minimum(mine, other), np.maximum(mine, other)
        place = place | ((mine == high) & (low < high)).astype(np.int64) << 15
        # and comes once for each band
        copy = np.repeat(np.arange(len(h)), bands[doc])
        band = first[doc[copy]] + np.arange(len(copy)) - np.repeat(np.cumsum(bands[doc]) - bands[doc], bands[doc])
        h, doc, place, low, high = h[copy], doc[copy], place[copy], low[copy], high[copy]
        rows = _tiled(fps, sizes, doc, h, place, band, tile_of(band, bucket_of(h, self.buckets), low, high), (lambda d, b: self.maps[d][b - int(first[d])]) if self.mapped else None)
        self.clear()
        return rows


def bands_of(sizes: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The first band of sets of these sizes and the number of their bands."""
    first, last = (np.frexp(n)[1].astype(np.int64) for n in (sizes.astype(float), np.floor(sizes / t + 1e-9)))
    return first, last - first + 1


def _tiled(fps: np.ndarray, sizes: np.ndarray, doc: np.ndarray, h: np.ndarray, place: np.ndarray, band: np.ndarray, tile: np.ndarray, map_of: Callable[[int, int], np.ndarray] | None = None) -> pa.RecordBatch:
    """Postings (hash, place) of the sets `doc`, packed a tile at a time: (bucket, postings)."""
    order = np.lexsort((doc, tile))
    h, doc, place, band, tile = h[order], doc[order], place[order], band[order], tile[order]
    cuts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, np.int64)
    own = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (doc[1:] != doc[:-1]))) if len(tile) else cuts
    sets = doc[own]
    maps = [map_of(d, b) for d, b in zip(sets.tolist(), band[own].tolist())] if map_of else None
    packed = _packed(np.diff(np.append(np.searchsorted(own, cuts), len(own))), np.diff(np.append(cuts, len(tile))), fps[sets], sizes[sets], np.diff(np.append(own, len(tile))), h, place, maps)
    return pa.RecordBatch.from_arrays([pa.array(tile[cuts], pa.int64()), pa.array(packed, pa.binary())], ["bucket", "postings"])


def dealt(columns: Iterator[pa.Array], buckets: int, t: float, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows without bands, ranges and bitmaps dealt to their tiles (bucket, postings), those postings alone whose hash is wanted."""
    kept: list[tuple[np.ndarray, ...]] = []

    def rows() -> pa.RecordBatch:
        fps, sizes, counts, h, place = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        doc = np.repeat(np.arange(len(fps)), counts)
        first, bands = bands_of(sizes, t)
        copy = np.repeat(np.arange(len(h)), bands[doc])
        band = first[doc[copy]] + np.arange(len(copy)) - np.repeat(np.cumsum(bands[doc]) - bands[doc], bands[doc])
        none = np.zeros(len(copy), np.int64)
        return _tiled(fps, sizes, doc[copy], h[copy], place[copy], band, tile_of(band, bucket_of(h[copy], buckets), none, none))

    for column in columns:
        for packed in pieces(column):
            kept.append(_thinned(*_parts(packed)[2:7], wanted))
            if sum(len(x[3]) for x in kept) >= RUN:
                yield rows()
    if kept:
        yield rows()


def tile_of(band: np.ndarray, bucket: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A number for a band (6 bits), a bucket (25 bits) and a pair of blocks (16 bits each, low <= high)."""
    return band.astype(np.int64) << 57 | bucket.astype(np.int64) << 32 | np.minimum(low, 65535) << 16 | np.minimum(high, 65535)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the hash, 0 to buckets - 1."""
    return ((h >> U(HASH_BITS - 32)) * U(buckets) >> U(32)).astype(np.int32)


def _packed(m: np.ndarray, p: np.ndarray, fps: np.ndarray, sizes: np.ndarray, counts: np.ndarray, h: np.ndarray, places: np.ndarray, maps: list[np.ndarray] | None = None) -> list[bytes]:
    """Packed rows, of m sets and p postings each: their numbers and the words of a bitmap, then fingerprints, sizes, numbers of postings, hashes, places, bitmaps."""
    at, to = (np.append(0, np.cumsum(n)).tolist() for n in (m, p))
    words = [len(maps[i]) for i in at[:-1]] if maps else [0] * len(m)
    head = np.column_stack([m, p, np.array(words, np.int64)]).astype(np.int64).tobytes()
    f, s, c, x, y = (memoryview(z) for z in (fps.tobytes(), sizes.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), pack48(h), places.astype(np.uint16).tobytes()))
    return [b"".join((head[24 * n : 24 * n + 24], f[8 * i : 8 * j], s[4 * i : 4 * j], c[4 * i : 4 * j], x[6 * k : 6 * l], y[2 * k : 2 * l], *(z.tobytes() for z in (maps[i:j] if maps else ())))) for n, (i, j, k, l) in enumerate(zip(at, at[1:], to, to[1:]))]


def _parts(packed: Iterable) -> tuple[np.ndarray, ...]:
    """Numbers of sets and postings in each packed row; of all rows together, fingerprints, sizes and numbers of postings of the sets, hashes and places of the postings, bitmaps.

    There may be thousands of small rows in a tile, so numpy is called for all of them at once.
    """
    raws = [memoryview(x) for x in packed]
    head = np.frombuffer(b"".join(x[:24] for x in raws), np.int64).reshape(-1, 3)
    m, p, words = head.T
    ends = np.cumsum(np.column_stack([np.full(len(m), 24), 8 * m, 4 * m, 4 * m, 6 * p, 2 * p, 8 * m * words]), axis=1).tolist()
    of = lambda c: b"".join([x[e[c] : e[c + 1]] for x, e in zip(raws, ends)])
    fps, sizes, counts, places, maps = (np.frombuffer(of(c), kind) for c, kind in ((0, np.int64), (1, np.uint32), (2, np.uint32), (4, np.uint16), (5, U)))
    return m, p, fps, sizes, counts, unpack48(of(3)), places, maps


def pieces(column: pa.Array) -> Iterator[list]:
    """Packed rows of an Arrow column, a few MB at a time."""
    step = max(1, len(column) * PIECE // max(1, column.nbytes))
    for i in range(0, len(column), step):
        yield [x.as_buffer() for x in column.slice(i, step)]


def hashes(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, U), *(_parts(x)[5] for x in pieces(column))])


def _thinned(fps: np.ndarray, sizes: np.ndarray, counts: np.ndarray, h: np.ndarray, places: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """Those postings alone whose hash is wanted, and their sets."""
    if not wanted:
        return fps, sizes, counts, h, places
    keep = wanted(h)
    left = np.bincount(np.repeat(np.arange(len(fps)), counts)[keep], minlength=len(fps))
    return fps[left > 0], sizes[left > 0], left[left > 0], h[keep], places[keep]


def _spans(begin: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of its range and place of all that is in the ranges, a chunk at a time, so a long range doesn't fill memory."""
    start, total = 0, np.cumsum(width)
    while start < len(width):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + CHUNK, side="right")))
        if width[start] > CHUNK:
            for skip in range(0, int(width[start]), CHUNK):
                count = min(CHUNK, int(width[start]) - skip)
                yield np.full(count, start), begin[start] + skip + np.arange(count)
        else:
            w = width[start:stop]
            n = np.repeat(np.arange(start, stop), w)
            yield n, begin[n] + np.arange(len(n)) - np.repeat(np.cumsum(w) - w, w)
        start = stop


class Postings:
    """Postings of one tile, sorted by shingle and, of one shingle, by the size of the set.

    tile: its number, from which the band and the pair of blocks are read. mark: a number for
    each packed row, for pairs between marked and other rows.
    """

    def __init__(self, packed: list, mark: list[int] | None = None, tile: int = 0):
        self.band, self.across = tile >> 57, (tile >> 16 & 65535) != (tile & 65535)
        m, _, fps, sizes, counts, h, place, maps = _parts(packed)
        self.maps = maps.reshape(len(fps), len(maps) // max(1, len(fps)))
        owner = np.repeat(np.arange(len(fps)), counts)
        marks = np.repeat(np.array(mark if mark else [0] * len(m), np.int8), m)
        fp, size, mk, place = fps[owner], sizes[owner].astype(np.int64), marks[owner], place.astype(np.int64)
        order = np.lexsort((mk, fp, size, h))
        h, fp, size, mk, place, owner = h[order], fp[order], size[order], mk[order], place[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        # a set that both sides posted carries both marks
        if mark and len(h):
            mk = np.bitwise_or.reduceat(mk, np.flatnonzero(fresh))
        else:
            mk = mk[fresh]
        self.h, self.fp, self.size, self.mark, self.owner = h[fresh], fp[fresh], size[fresh], mk, owner[fresh]
        self.place, self.block = place[fresh] & LAST_PLACE, place[fresh] >> 15

    def pairs(self, t: float, sides: bool = False) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, shared, least) of fingerprints, a < b, that share `shared` postings here, must share `least` anywhere, and may reach t.

        Of a list, a set meets those from its own size up to size / t that belong to the tile's band; a
        shared posting counts if both places allow the overlap, and both bitmaps. With `sides`, one of
        the two must be marked 1, and only such pairs are expanded: a list may hold many more of the others.
        """
        n = len(self.h)
        if not n:
            return
        group = np.cumsum(np.append(0, (self.h[1:] != self.h[:-1]).astype(np.int64)))
        # within a list sizes ascend, so (list, size) is sorted and the band is a range of it
        key = group * (1 << 40) + self.size
        upto = np.searchsorted(key, group * (1 << 40) + np.minimum(np.floor(self.size / t + 1e-9).astype(np.int64), (1 << 40) - 1), side="right")
        band = np.searchsorted(key, group * (1 << 40) + (1 << (self.band - 1)), side="left") if self.band else np.zeros(n, np.int64)
        begin = np.maximum(np.arange(1, n + 1), band)
        first = np.flatnonzero(self.mark & 1) if sides else np.arange(n)
        for i, j in _spans(begin[first], np.maximum(upto - begin, 0)[first]):
            yield from self._expand(first[i], j, t)
        if sides:
            # unmarked sets before a marked one: `upto` ascends, so those that reach it are a range
            rest = np.flatnonzero(self.mark & 1 == 0)
            low, high = np.searchsorted(rest, np.searchsorted(upto, first, side="right")), np.searchsorted(rest, first)
            for j, i in _spans(low, np.where(first >= band[first], np.maximum(high - low, 0), 0)):
                yield from self._expand(rest[i], first[j], t)

    def _expand(self, i: np.ndarray, j: np.ndarray, t: float) -> Iterator[pa.RecordBatch]:
        na, nb, pa_, pb = self.size[i], self.size[j], self.place[i], self.place[j]
        need = needed_overlap(na, nb, t)
        known = (pa_ < LAST_PLACE) & (pb < LAST_PLACE)
        bound = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
        ok = ~known | ((pa_ < na - need + LEAST) & (pb < nb - need + LEAST) & (bound >= need))
        if self.across:
            ok &= self.block[i] != self.block[j]
        i, j = i[ok], j[ok]
        if self.maps.shape[1] and len(i):
            ok = np.concatenate([self._allowed(i[k : k + MAPS], j[k : k + MAPS], t) for k in range(0, len(i), MAPS)])
            i, j = i[ok], j[ok]
        a, b = np.minimum(self.fp[i], self.fp[j]), np.maximum(self.fp[i], self.fp[j])
        if not len(a):
            return
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least = np.minimum(LEAST, needed_overlap(self.size[i], self.size[j], t))[order][first]
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.append(first, len(a))).astype(np.int32)), pa.array(least.astype(np.int32))], ["a", "b", "shared", "least"])

    def _allowed(self, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        """Which pairs the bit counts allow: d cells that differ are d shingles at least that only one has."""
        apart = np.bitwise_count(self.maps[self.owner[i]] ^ self.maps[self.owner[j]]).sum(axis=1, dtype=np.int64)
        return (self.size[i] + self.size[j] - apart) // 2 >= needed_overlap(self.size[i], self.size[j], t)


def enough_shared(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b, shared, least) those with enough shared anchors over all tiles: (a, b)."""
    summed = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("least").alias("least"))
    return summed.where("shared >= least").select("a", "b")
