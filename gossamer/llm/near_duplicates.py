"""Groups of records whose shingle sets have a similarity of at least t.

1. One scan gives each record the size and fingerprint of its shingle set, and the corpus a
   frequency sketch of fixed size. Records with equal sets are one class from here on.
2. A second scan deals the classes to size-banded tiles by their anchors (anchors.py). In a tile,
   the bit counts of hashed bitmaps bound the overlap of a pair from above.
3. Pairs that pass with enough anchors are intersected as sorted arrays, all pairs of a chunk at once.
4. Pairs of classes are expanded to records, or joined to groups.
No list, class or tile is capped: nothing is lost to a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, file_bytes, sent, spread
from . import anchors
from .shingles import HASH_BITS, U, CellCounts, cells, fingerprint, lazily, mix, needed_overlap, pack48, rank_table, shingle_sets, unpack48

#: Most cells of a bit table as a power of two.
HELD_BITS = 26
#: Elements of the sets that are intersected at once.
CHUNK = 1_000_000
#: Sets that one tile of the exact check holds on average; a larger cluster is split into tiles of pairs of blocks.
TILE = 2000

_SCAN = "id bigint, n int, fp bigint, block int, counts binary"


def scan(records: DataFrame, k: int) -> DataFrame:
    """Rows (id, n, fp) of `records` (id, text) and, in the same table, its sketch (block, counts).

    Records without a single shingle (null, empty, under k tokens) are similar to nothing and left out.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CellCounts()
        names = ["id", "n", "fp", "block", "counts"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, s in zip(lazily(b.column(0)), shingle_sets(lazily(b.column(1)), k)):
                if len(s) and i is not None:
                    counts.add(s)
                    for xs, x in zip(out, (i, len(s), fingerprint(s))):
                        xs.append(x)
            none = [None] * len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*out, none, none), kinds)], names)
        rows = list(counts.rows())
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, [r[0] for r in rows], [r[1] for r in rows]), kinds)], names)

    return cut(spread(records.select(F.col("id").cast("bigint"), "text")).mapInArrow(fn, _SCAN), "sets")


def post(records: DataFrame, k: int, t: float, ranks: np.ndarray, buckets: int) -> DataFrame:
    """Packed anchors (bucket, postings) of `records` (text)."""
    shared = sent(records.sparkSession, ranks.tobytes())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = anchors.Run(buckets, t, np.frombuffer(shared.value, np.uint8), banded=True, mapped=True, hot=anchors.HOT)
        for b in batches:
            for s in shingle_sets(lazily(b.column(0)), k):
                if len(s):
                    run.add(fingerprint(s), s)
                    if run.posted >= anchors.RUN:
                        yield run.rows()
        yield run.rows()

    return spread(records.select("text")).mapInArrow(fn, "bucket bigint, postings binary")


def buckets_for(docs: DataFrame, t: float) -> int:
    """So many ranges of the hash that one has about a million postings, and a few at least."""
    total = docs.agg(F.sum("n")).first()[0] or 0
    return max(8, int(total * (1 - t) / 1e6) + 1)


def candidates(postings: DataFrame, t: float) -> DataFrame:
    def fn(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x.as_buffer() for b in parts for x in b.column("postings")]
        yield from anchors.Postings(packed, tile=key[0].as_py()).pairs(t)

    return postings.groupBy("bucket").applyInArrow(fn, "a bigint, b bigint, shared int, least int")


def bit_table(hashes: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], many: int) -> Broadcast:
    """A bit table in which the cells of the hashes are set that `of` reads from the rows.

    It has 32 to 64 cells for each of about `many` hashes, but at most 2^HELD_BITS (8 MB). It is put
    together block by block on the executors. It only spares work: an exact join follows.
    """
    bits = min(HELD_BITS, max(17, int(many).bit_length() + 5))
    block = (1 << bits) // 8 // min(512, (1 << bits) // 8 // 1024)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            c = np.unique(cells(of(b), bits))
            np.bitwise_or.at(found, c >> 3, np.uint8(128) >> (c & 7).astype(np.uint8))
        blocks = found.reshape(-1, block)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([blocks[i].tobytes() for i in at], pa.binary())], ["block", "bits"])

    def joined(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(block, np.uint8)
        for b in parts:
            for x in b.column("bits"):
                whole |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in hashes.mapInArrow(note, "block int, bits binary").groupBy("block").applyInArrow(joined, "block int, bits binary").collect():  # the table itself
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(bytes(r.bits), np.uint8)
    return sent(hashes.sparkSession, out.tobytes())


def held(table: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in a bit table."""
    c = cells(hashes, len(table).bit_length() + 2)
    return np.frombuffer(table, np.uint8)[c >> 3] >> (7 - (c & 7)) & 1 > 0


def hashed(numbers: pa.Array) -> np.ndarray:
    return mix(numbers.to_numpy(zero_copy_only=False).astype(np.int64).view(U)) >> U(64 - HASH_BITS)


def maybe_among(rows: DataFrame, wanted: DataFrame, many: int) -> DataFrame:
    """Rows of `rows` (fp, ...) whose fp is among the about `many` of `wanted` (fp), by a bit table: all of those, and a few others."""
    bits = bit_table(wanted, lambda b: hashed(b.column(0)), many)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held(bits.value, hashed(b.column("fp")))))

    return rows.mapInArrow(fn, rows.schema)


def sets_of(records: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Shingle sets (fp, packed) of the records (id, text) whose id is in the stored table `wanted` (fp, id).

    The wanted ids are summed up in a bit table of fixed size, by which nearly all others are
    dropped during the scan, before their texts are hashed; the join then is exact.
    """
    bits = bit_table(wanted.select("id"), lambda b: hashed(b.column(0)), file_bytes(wanted) // 8)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column(0)))
            keep = held(bits.value, hashed(b.column(0)))
            ids, texts = (lazily(b.column(c).filter(pa.array(keep))) for c in range(2))
            out = [(i, fingerprint(s), pack48(s)) for i, s in zip(ids, shingle_sets(texts, k)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["id", "fp", "packed"])

    found = spread(records.select(F.col("id").cast("bigint"), "text")).mapInArrow(fn, "id bigint, fp bigint, packed binary")
    return found.join(wanted.select("id"), "id", "left_semi").select("fp", "packed")


def similar_in_tile(fps: list[int], packed: list[bytes], a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Which of the pairs (a, b) of fingerprints reach t; all their sets are among `packed`."""
    order = np.argsort(np.array(fps, np.int64))
    ids = np.array(fps, np.int64)[order]
    i, j = (order[np.searchsorted(ids, side)] for side in (a, b))
    sizes = np.array([len(x) // 6 for x in packed], np.int64)
    i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
    need, good = needed_overlap(sizes[i], sizes[j], t), np.zeros(len(i), bool)
    cuts, weight = [0], np.cumsum(sizes[i] + sizes[j])
    while cuts[-1] < len(i):  # a pair's number and a shingle fill 64 bits
        done = weight[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(min(cuts[-1] + (1 << 64 - HASH_BITS), max(cuts[-1] + 1, int(np.searchsorted(weight, done + CHUNK, side="right")))))
    for x, y in zip(cuts[:-1], cuts[1:]):
        number = np.arange(y - x, dtype=U) << U(HASH_BITS)
        small, large = (np.repeat(number, sizes[side[x:y]]) | unpack48(b"".join(packed[k] for k in side[x:y])) for side in (i, j))
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        shared = np.bincount((small[large[at] == small] >> U(HASH_BITS)).astype(np.int64), minlength=y - x)
        good[x:y] = shared >= need[x:y]
    return good


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], docs: DataFrame, t: float) -> DataFrame:
    """Of candidate pairs (a, b) of fingerprints those with a true similarity of at least t.

    sets: gives the sets (fp, packed) of the classes in a table (fp, id), the id one of docs (id, fp).
    Pairs of one neighbourhood (same smallest neighbour) go to one tile, so a set travels about
    once however many partners it has. A neighbourhood of over TILE sets is cut into blocks,
    a tile for each pair of blocks that holds a pair.
    """
    pairs = cut(pairs, "candidates")
    sides = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = sides.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "fp")
    need = labels.join(docs.groupBy("fp").agg(F.min("id").alias("id")), "fp")
    need = cut(need, "wanted")
    sizes = need.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    total = need.count()
    tiles = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TILE)
    keyed = pairs.join(need.select(F.col("fp").alias("a"), "label"), "a").join(sizes, "label")
    blocks = F.ceil(F.col("members") / TILE)
    part = lambda c: F.pmod(F.xxhash64(c), blocks)
    keyed = keyed.withColumn("tile", F.pmod(F.xxhash64("label", part("a"), part("b")), F.lit(tiles)).cast("int")).select("tile", "a", "b")
    keyed = cut(keyed, "tiles")
    members = keyed.select("tile", F.col("a").alias("fp")).unionByName(keyed.select("tile", F.col("b").alias("fp"))).distinct()
    sets = members.join(sets(need), "fp").select(F.col("tile").alias("to_tile"), "fp", "packed")

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        held = dict(zip(right.column("fp").to_pylist(), right.column("packed").to_pylist()))
        good = similar_in_tile(list(held), list(held.values()), a, b, t) if len(a) else np.zeros(0, bool)
        return pa.table({"a": pa.array(a[good], pa.int64()), "b": pa.array(b[good], pa.int64())})

    return keyed.groupBy("tile").cogroup(sets.groupBy("to_tile")).applyInArrow(fn, "a bigint, b bigint")


def similar_classes(records: DataFrame, k: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(docs, pairs) of `records` (id, text): docs (id, fp), distinct, with fp the class of equal
    shingle sets; pairs (a, b), a < b, of classes with a similarity of at least t, below 1.

    Repeated rows of an id with the same text count once. An empty table gives empty results.
    """
    both = scan(records, k)
    docs = both.where("fp IS NOT NULL").select("id", "n", "fp").distinct()
    ranks = rank_table(both.where("block IS NOT NULL").select("block", "counts"))
    found = candidates(post(records, k, t, ranks, buckets_for(docs, t)), t)
    found = anchors.enough_shared(found)
    return docs, cut(verified(found, lambda wanted: sets_of(records, wanted, k), docs, t), "similar")


def record_pairs(docs: DataFrame, pairs: DataFrame, differ: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of records in one class or in similar classes whose value differs.

    differ: (id, value). Records with the same value, or both without one, are no pair.
    """
    members = docs.select("id", "fp").join(differ.select("id", "value").distinct(), "id")
    often = members.groupBy("fp").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("fp")
    left, right = (members.select(F.col("fp").alias(f), F.col("id").alias(i), F.col("value").alias(v)) for f, i, v in (("a", "id_a", "value_a"), ("b", "id_b", "value_b")))
    links = pairs.select("a", "b").unionByName(often.select(F.col("fp").alias("a"), F.col("fp").alias("b")))
    found = links.join(left, "a").join(right, "b").where("id_a <> id_b").where(~F.col("value_a").eqNullSafe(F.col("value_b")))
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def groups(docs: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Every record with its group: (id, group_id), the smallest id it is linked with.

    docs: (id, fp), pairs: (a, b), as similar_classes gives them; records: (id). A record without a
    shingle (null, empty, short) is linked with none and its own group; null ids are left out.

    Labels of classes are lowered along the pairs and along the labels themselves until
    nothing changes; each round is written to the shared folder, so lineage stays short.
    """
    sides = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = cut(sides.select(F.col("a").alias("fp")).distinct().withColumn("label", F.col("fp")), "labels")
    while True:
        near = sides.join(labels.withColumnRenamed("fp", "b"), "b").groupBy("a").agg(F.min("label").alias("other")).withColumnRenamed("a", "fp")
        lower = labels.join(near, "fp").select("fp", "label", F.least("label", "other").alias("to"))
        jump = labels.select(F.col("fp").alias("to"), F.col("label").alias("next"))
        moved = cut(lower.join(jump, "to").select("fp", F.least("to", "next").alias("new"), "label"), "labels")
        labels = moved.select("fp", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            break
    classes = docs.select("id", "fp").distinct().join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = classes.groupBy("label").agg(F.min("id").alias("group_id"))
    grouped = classes.join(first, "label").select("id", "group_id")
    bare = records.select(F.col("id").cast("bigint")).where("id IS NOT NULL").distinct().join(docs.select("id"), "id", "left_anti")
    return grouped.unionByName(bare.select("id", F.col("id").alias("group_id")))
