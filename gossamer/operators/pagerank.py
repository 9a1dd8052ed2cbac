"""Weighted PageRank over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from ..shared import Bucketed, cut, file_bytes
from .links import together


def bases(pages: DataFrame) -> DataFrame:
    """(node, base) of `pages` (node, content): log2 of the words of a page, as a share of the sum.

    A page without words counts as one word, so its base is 0; if all are, all bases are 0. A
    node that comes twice counts once; its content isn't shuffled for that.
    """
    n = F.greatest(F.size(text.words(html.text(F.coalesce("content", F.lit(""))))), F.lit(1))
    phi = cut(pages.select("node", F.log2(n).alias("phi")).groupBy("node").agg(F.max("phi").alias("phi")), "phi")
    total = phi.agg(F.sum("phi")).first()[0] or 0.0
    return phi.select("node", (F.col("phi") / total if total else F.lit(0.0)).alias("base"))


def strengths(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, weight): strength of the links (node, dst, pos, href, anchor) of `pages` (node, content).

    A link counts once for each time its href stands in the source's text, and once for each
    emphasised piece that holds the anchor. The links of a page are gathered before they meet it, some
    hundred places at a time, so its content isn't copied to each of them. A page that comes
    twice counts once.
    """
    gathered = links.where("href IS NOT NULL").groupBy("node", together(F.col("pos")).alias("part")).agg(F.collect_list(F.struct("dst", "href", "anchor")).alias("links"))
    pieces = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(f"<{s}>(.*?)</{s}>"), F.lit(1)) for s in text.SCOPES)))
    both = pages.select("node", "content").join(gathered, "node").select("node", "part", "links", "content", pieces.alias("pieces"))

    def weighed(x: Column) -> Column:
        held = F.when(F.length(x["anchor"]) > 0, F.size(F.filter("pieces", lambda p: F.contains(p, x["anchor"])))).otherwise(0)
        return F.struct(x["dst"].alias("dst"), (text.occurrences(F.col("content"), x["href"]) + held).alias("weight"))

    once = both.select(F.col("node").alias("src"), "part", F.transform("links", weighed).alias("links")).dropDuplicates(["src", "part"])
    each = once.select("src", F.explode("links").alias("x")).select("src", "x.dst", F.coalesce("x.weight", F.lit(0)).alias("weight"))
    return each.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def normalized(edges: DataFrame) -> DataFrame:
    """(src, dst, w): weights as shares of their source's sum; a source whose sum is 0 has none."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(total, "src").where("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("w"))


def ranks(base: DataFrame, weights: DataFrame, f: float = 0.7, tolerance: float | None = None, iterations: int | None = None, limit: int = 1000) -> DataFrame:
    """(node, score) after rounds of score = (1 - f) base + f * sum of the scores that flow in.

    base: (node, base); weights: (src, dst, w), shares that sum to 1 a source. A node without
    weights gives an equal part to every node, itself too. Rounds are `iterations`, or go on
    until no score moves by more than `tolerance` (0.01 / nodes by default); if that isn't
    reached within `limit` rounds it is an error. Edges and scores are bucketed alike on disk, so
    a round doesn't shuffle the edges but one number a target, pre-summed; what nodes without
    weights give and how far scores moved come from one aggregate.
    """
    if not 0 < f < 1:
        raise ValueError("f must lie between 0 and 1")
    weights = cut(weights, "weights")
    tables = Bucketed(base.sparkSession, file_bytes(weights))
    try:
        edges = tables.keep(weights.select(F.col("src").alias("node"), "dst", "w"))
        idle = base.join(weights.select(F.col("src").alias("node"), F.lit(False).alias("idle")).distinct(), "node", "left").select("node", "base", F.coalesce("idle", F.lit(True)).alias("idle"))
        nodes = tables.keep(idle)
        n, scores = nodes.count(), nodes.select("node", F.col("base").alias("score"))
        even = nodes.where("idle").agg(F.sum("base")).first()[0] or 0.0
        tolerance = 0.01 / max(n, 1) if tolerance is None else tolerance
        for done in range(1, (limit if iterations is None else iterations) + 1):
            flow = edges.join(scores, "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("w")).alias("flow"))
            score = (1 - f) * F.col("base") + f * (F.coalesce("flow", F.lit(0.0)) + even / max(n, 1))
            new = nodes.join(flow, "node", "left").join(scores.withColumnRenamed("score", "old"), "node").select("node", "idle", score.alias("score"), F.col("old"))
            stepped = tables.keep(new)
            moved, even = stepped.agg(F.max(F.abs(F.col("score") - F.col("old"))), F.sum(F.when(F.col("idle"), F.col("score")))).first()
            even, scores = even or 0.0, stepped.select("node", "score")
            if iterations is None and (moved or 0.0) <= tolerance:
                break
            if iterations is None and done == limit:
                raise RuntimeError(f"scores still move by {moved} after {limit} rounds")
        return cut(scores, "ranks")
    finally:
        tables.close()


def without_ties(scores: DataFrame) -> DataFrame:
    """One node a score, the smallest: what a set ordered by score alone would keep."""
    return scores.groupBy("score").agg(F.min("node").alias("node")).select("node", "score")
