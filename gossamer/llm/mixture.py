"""Mixing sources to target weights, in tokens of a public tokenizer.

Every document of a source gets the same expected number of copies; what exceeds a whole
number is rounded by pivotal sampling: two fractions meet, token mass moves from one to the
other in a random direction until one of them is whole, and the other goes on. The mass of a
source stays the same in every step, so its share is met up to a part of one document. Documents
are dealt to homes by a hash of their id, about HOME to a home, and meet there in the order of that
hash; a home leaves one fraction a source, and these residuals are combined through a tree of ever
fewer homes. Neither the layout of the table nor the number of cores plays a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, spread
from .encoding import token_counts, vocabulary_path
from .shingles import U, mix

#: Documents of a home on average, and homes whose residuals one home of the next level combines.
HOME, FAN_IN = 100_000, 32
SEED = 20_240_501

_ROW = "doc_id bigint, source string, tokens bigint, whole int, part double"


def source_name(c: str) -> Column:
    """Sources are the same if they agree without case and outer blanks."""
    return F.lower(F.trim(F.col(c)))


def measured(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of `documents` (doc_id, source, text), source in its common spelling; null and empty texts have 0 tokens."""
    path = path or vocabulary_path()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(token_counts(b.column(2).to_pylist(), path), pa.int64())], ["doc_id", "source", "tokens"])

    rows = documents.select(F.col("doc_id").cast("bigint"), source_name("source").alias("source"), "text")
    return spread(rows).mapInArrow(fn, "doc_id bigint, source string, tokens bigint")


def plan(measured_docs: DataFrame, targets: DataFrame) -> list[dict]:
    """What each source of `targets` (source, target_share, max_repeats) gives: a row a target.

    The mixture is the largest in which the shares of the sources that have tokens stand to each
    other as their targets and none is repeated more than its cap on average. A source without
    tokens gives nothing; the others then share its part. Shares that are null or not above
    zero ask for nothing; a null cap is 1. Spellings of one source are added up.
    """
    asked = targets.groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    there = measured_docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    rows = [r.asDict() for r in asked.join(there, "source", "left").collect()]  # a row a target
    able = [r for r in rows if r["source"] is not None and (r["share"] or 0) > 0 and (r["tokens"] or 0) > 0]
    asked_of_able = sum(r["share"] for r in able)
    size = min(((r["cap"] if r["cap"] is not None else 1) * r["tokens"] * asked_of_able / r["share"] for r in able), default=0)
    for r in rows:
        good = r in able
        r |= {"documents": r["documents"] or 0, "tokens": r["tokens"] or 0, "goal": size * r["share"] / asked_of_able if good else 0.0}
        r["copies"] = min(r["goal"] / r["tokens"], r["cap"] if r["cap"] is not None else 1) if good and size else 0.0
    return rows


def _random(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the two ids and the seed only."""
    return (mix(mix(a.view(U) + U(seed)) ^ (b.view(U) * U(0x9E3779B97F4A7C15))) >> U(11)).astype(np.float64) / (1 << 53)


def pivotal(ids: np.ndarray, tokens: np.ndarray, part: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rounds fractions `part` until at most one isn't whole; the sum of tokens * part stays.

    All neighbours meet at once, round after round, so n fractions take log2(n) steps.
    """
    part = part.copy()
    open_ = np.flatnonzero((part > 0) & (part < 1))
    while len(open_) > 1:
        i, j = open_[: len(open_) // 2 * 2 : 2], open_[1::2]
        x, y, p, q = tokens[i].astype(float), tokens[j].astype(float), part[i], part[j]
        up, down = np.minimum((1 - p) * x, q * y), np.minimum(p * x, (1 - q) * y)
        rise = _random(ids[i], ids[j], seed) < down / (up + down)
        move = np.where(rise, up, -down)
        p, q = p + move / x, q - move / y
        part[i], part[j] = (np.where(v < 1e-9, 0.0, np.where(v > 1 - 1e-9, 1.0, v)) for v in (p, q))
        # the one that hit its bound is whole, whatever rounding left of it
        bound_i = np.where(rise, (1 - p) * x <= (q * y), p * x <= (1 - q) * y)
        stuck = (part[i] > 0) & (part[i] < 1) & (part[j] > 0) & (part[j] < 1)
        part[i[stuck & bound_i]] = np.round(part[i[stuck & bound_i]])
        part[j[stuck & ~bound_i]] = np.round(part[j[stuck & ~bound_i]])
        open_ = open_[(part[open_] > 0) & (part[open_] < 1)]
    return part


def _combine(rows: pa.Table) -> pa.Table:
    """Rounds all rows of a home but one residual a source, which keeps its part."""
    rows = rows.sort_by([("source", "ascending"), ("place", "ascending"), ("doc_id", "ascending"), ("tokens", "ascending")])
    ids, tokens, whole, part = (rows.column(c).to_numpy() for c in ("doc_id", "tokens", "whole", "part"))
    names = rows.column("source").combine_chunks().dictionary_encode()
    code, part, whole = names.indices.to_numpy(), part.copy(), whole.copy()
    left = np.zeros(len(part), bool)
    for c in range(len(names.dictionary)):
        at = np.flatnonzero(code == c)
        part[at] = pivotal(ids[at].astype(np.int64), tokens[at], part[at])
        left[at] = (part[at] > 0) & (part[at] < 1)
    whole = whole + np.where(left, 0, np.round(part)).astype(whole.dtype)
    return pa.table([rows.column("doc_id"), rows.column("source"), rows.column("tokens"), pa.array(whole, pa.int32()), pa.array(part, pa.float64(), mask=~left)], ["doc_id", "source", "tokens", "whole", "part"])


def mixed(documents: DataFrame, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): mixture (doc_id, source, tokens, copies) has every document taken at least once.

    shares: for each target source its target_share, documents and tokens there, copies and
    tokens taken and actual_share; a source that has no documents shows as 0. A document is
    taken at most max_repeats times; documents without tokens are never taken. The draw depends
    on SEED, the ids and the number of documents only. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    docs = cut(measured(documents, path), "measured")
    rows = plan(docs, targets)
    copies = spark.createDataFrame([(r["source"], float(r["copies"])) for r in rows if r["copies"] > 0], "source string, expected double")
    items = docs.where("tokens > 0").join(F.broadcast(copies), "source")  # as many rows as there are targets
    floor = F.floor(F.col("expected") + 1e-12)
    items = items.select("doc_id", "source", "tokens", floor.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("expected") - floor).alias("part"))
    # nothing but the number of documents decides how many homes there are
    homes, level, done = max(1, -(-sum(r["documents"] for r in rows if r["copies"] > 0) // HOME)), items, None
    place = F.xxhash64("doc_id", F.lit(SEED))
    while True:
        dealt = level.withColumn("place", place).withColumn("home", F.pmod("place", F.lit(homes)))
        level = cut(dealt.groupBy("home").applyInArrow(_combine, _ROW), "level")
        done = level.where("part IS NULL") if done is None else done.unionByName(level.where("part IS NULL"))
        level = level.where("part IS NOT NULL")
        if homes == 1:
            break
        homes = -(-homes // FAN_IN)
    # one residual a source: its part decides as a probability
    coin = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = level.withColumn("whole", F.col("whole") + (coin < F.col("part")).cast("int"))
    mixture = done.unionByName(last).where("whole > 0").select("doc_id", "source", "tokens", F.col("whole").alias("copies"))
    mixture = cut(mixture, "mixture")
    asked = spark.createDataFrame([(r["source"], r["share"], r["cap"], r["documents"], r["tokens"]) for r in rows], "source string, target_share double, max_repeats int, documents bigint, tokens bigint")
    taken = mixture.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("taken"), F.max("copies").alias("most"))
    total = F.sum("tokens_taken").over(Window.partitionBy(F.lit(1)))  # over a row a target
    shares = asked.join(taken, "source", "left").select("source", "target_share", "max_repeats", "documents", "tokens", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("copies", "copies"), ("most", "most_repeats"), ("taken", "tokens_taken"))))
    return mixture, shares.withColumn("actual_share", F.coalesce(F.col("tokens_taken") / F.nullif(total, F.lit(0)), F.lit(0.0)))
