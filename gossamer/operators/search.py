"""Ranked text retrieval over postings, with a query language.

A query becomes a condition on terms, by which its postings are read, and a count column for
each clause, by which they are grouped a document. Document frequencies, a single row, are
counted from that table, and the top k are taken without a full sort. Documents without a
posting of the query are never looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..shared import cut
from .index import Index, bucket_of

WORD = re.compile(r"[^\W_]+")
#: Edits that a fuzzy word without a number may be off.
EDITS = 2


@dataclass
class Clause:
    """A leaf of a query: how it matches, in which field, with which weight.

    words: the terms of a phrase with None for each stop word, one term, a pattern, or the ends of a range.
    """

    kind: str
    words: list[str | None]
    field: str
    boost: float = 1.0
    slop: int = 0
    edits: int = EDITS
    ends: str = "[]"

    def wants(self) -> Column:
        """Whether a posting counts for the clause."""
        w, term = self.words, F.col("term")
        here = F.col("field") == self.field
        if self.kind == "pattern":
            return here & term.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in w[0]) + "$") & term.startswith(re.match(r"[^*?]*", w[0])[0])
        if self.kind == "fuzzy":
            return here & (F.abs(F.length(term) - len(w[0])) <= self.edits) & (F.levenshtein(term, F.lit(w[0])) <= self.edits)
        if self.kind == "range":
            return here & (term >= w[0] if self.ends[0] == "[" else term > w[0]) & (term <= w[1] if self.ends[1] == "]" else term < w[1])
        terms = sorted({x for x in w if x})
        return here & F.col("bucket").isin(sorted({bucket_of(x) for x in terms})) & term.isin(terms)

    def counted(self) -> Column:
        """Matches in a document's postings, as an aggregate; for a phrase an array of the places of each word."""
        if self.kind != "phrase":
            return F.coalesce(F.sum(F.when(self.wants(), F.col("tf"))), F.lit(0))
        here = F.col("field") == self.field
        return F.struct(*(F.max(F.when(here & (F.col("term") == w), F.col("positions"))).alias(f"p{k}") for k, w in enumerate(self.words) if w))

    def places(self, held: Column) -> Column:
        """Places of the first word of a phrase from which the others follow.

        Off by as many moves as the slop allows: of the words' places, each less the word's number in
        the phrase, the greatest and the least lie at most slop apart.
        """
        spots = [(k, held[f"p{k}"]) for k, w in enumerate(self.words) if w]
        first = spots[0][0]

        def hit(p: Column) -> Column:
            if not self.slop:
                return reduce(and_, (F.array_contains(xs, p - first + k) for k, xs in spots[1:]), F.lit(True))
            return F.exists(F.sequence(p - first - self.slop, p - first), lambda x: reduce(and_, (F.exists(xs, within(x, k)) for k, xs in spots[1:]), F.lit(True)))

        def within(x: Column, k: int) -> Callable[[Column], Column]:
            return lambda q: (q - k).between(x, x + self.slop)

        return F.coalesce(F.size(F.filter(spots[0][1], hit)), F.lit(0)) if len(spots) == 1 else F.when(reduce(and_, (xs.isNotNull() for _, xs in spots)), F.size(F.filter(spots[0][1], hit))).otherwise(0)


@dataclass
class Node:
    """must, should and must-not parts of a query, each a clause or a node."""

    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    never: list = field(default_factory=list)
    boost: float = 1.0


_LEX = re.compile(
    r"""\s*(?:(?P<open>\()|(?P<close>\))(?:\^(?P<group_boost>[\d.]+))?|(?P<and>AND|&&)(?=\s)|(?P<or>OR|\|\|)(?=\s)|(?P<not>NOT|!)(?=\s)
    |(?P<sign>[+-])?(?:(?P<field>\w+):)?(?:(?=\()|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?|(?P<low>[\[{])(?P<from>\S+)\ TO\ (?P<to>[^\s\]}]+)(?P<high>[\]}])|(?P<word>[^\s()"\[\]{}^~:]+)(?P<fuzzy>~\d*)?)(?:\^(?P<boost>[\d.]+))?)""",
    re.X,
)


def _words(x: str) -> list[str | None]:
    """Terms of a piece of a query, None for a stop word between others."""
    out = [None if w in text.INDEX_STOP_WORDS else w for w in WORD.findall(x.lower())]
    while out and out[0] is None:
        out.pop(0)
    while out and out[-1] is None:
        out.pop()
    return out


def parse(query: str, default: str = "contents") -> Node:
    """The tree of a query: terms, + - AND OR NOT, "phrases" with ~slop, field:, * and ?, fuzzy~edits, [a TO b], {a TO b}, ^boost, ( ).

    Words are lower-cased; a word of several terms is a phrase; without operators terms are
    alternatives. Stop words ask for nothing; within a phrase they keep their place. A square
    bracket takes its end of a range in, a brace leaves it out.
    """

    def leaf(m: re.Match, at: str) -> Clause | None:
        boost = float(m["boost"] or 1)
        if m["low"]:
            return Clause("range", [m["from"].lower(), m["to"].lower()], at, boost, ends=m["low"] + m["high"])
        if m["phrase"] is None and re.search(r"[*?]", m["word"]):
            return Clause("pattern", [m["word"].lower()], at, boost)
        words = _words(m["word"] if m["phrase"] is None else m["phrase"])
        if len(words) < 2:
            kind = "fuzzy" if m["fuzzy"] else "term"
            return Clause(kind, words, at, boost, edits=int(m["fuzzy"][1:] or EDITS) if m["fuzzy"] else EDITS) if words else None
        return Clause("phrase", words, at, boost, int(m["slop"] or 0))

    def group(pos: int, at: str) -> tuple[Node, int]:
        parts: list[list] = []  # [sign, part]
        joiner, sign = "", ""
        node = Node()
        while pos < len(query):
            m = _LEX.match(query, pos)
            if not m or m.end() == pos:
                pos += 1
                continue
            pos = m.end()
            if m["close"]:
                node.boost = float(m["group_boost"] or 1)
                break
            if m["and"] or m["or"]:
                joiner = "AND" if m["and"] else "OR"
                continue
            if m["not"]:
                sign = "-"
                continue
            if m["open"]:
                part, pos = group(pos, at)
                mark = sign
            elif m["phrase"] is None and not m["low"] and not m["word"]:  # a field or a sign before a group
                inner = _LEX.match(query, pos)
                if not (inner and inner["open"]):
                    continue
                part, pos = group(inner.end(), m["field"] or at)
                mark = m["sign"] or sign
            else:
                part, mark = leaf(m, m["field"] or at), m["sign"] or sign
            if part is None:
                continue
            if joiner == "AND":
                mark = mark or "+"
                if parts and not parts[-1][0]:
                    parts[-1][0] = "+"
            parts.append([mark, part])
            joiner = sign = ""
        for mark, part in parts:
            {"+": node.must, "-": node.never}.get(mark, node.should).append(part)
        return node, pos

    return group(0, default)[0]


def leaves(node: Node, boost: float = 1.0) -> list[tuple[Clause, float]]:
    """Clauses that add to the score, with their boosts."""
    out = []
    for part in [*node.must, *node.should]:
        out += leaves(part, boost * node.boost) if isinstance(part, Node) else [(part, boost * node.boost * part.boost)]
    return out


def _every(node: Node) -> list[Clause]:
    return [c for p in [*node.must, *node.should, *node.never] for c in (_every(p) if isinstance(p, Node) else [p])]


def _all(columns: Iterable[Column]) -> Column:
    return reduce(and_, columns, F.lit(True))


def matches(index: Index, query: str, default: str = "contents", scoring: str = "tfidf") -> DataFrame:
    """(doc_id, score) of the documents of an index that answer `query`.

    tfidf: coord * queryNorm * sum of sqrt(tf) * idf^2 * boost / sqrt(length), with
    idf = 1 + ln(N / (df + 1)); bm25: k1 1.2, b 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    N counts all documents, fields null or not. A query or a group without a clause that asks for
    something (exclusions and stop words only) answers nothing.
    """
    tree = parse(query, default)
    clauses = _every(tree)
    scored_ = leaves(tree)
    if not scored_:
        return index.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    fields = list(dict.fromkeys(c.field for c in clauses))
    asked = index.postings.where(reduce(or_, (c.wants() for c in clauses)))
    rows = asked.groupBy("doc_id").agg(*(c.counted().alias(f"c{i}") for i, c in enumerate(clauses)), *(F.max(F.when(F.col("field") == f, F.col("length"))).alias(f"n_{f}") for f in fields))
    rows = rows.withColumns({f"c{i}": c.places(F.col(f"c{i}")) for i, c in enumerate(clauses) if c.kind == "phrase"})
    rows = cut(rows, "hits")
    facts = rows.agg(*(F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(clauses)))).first()  # a single row of numbers
    sizes = {r.field: r for r in index.sizes.collect()}  # a row a field
    total = max((r.docs for r in sizes.values()), default=0)
    place = {id(c): i for i, c in enumerate(clauses)}

    def holds(node: Node) -> Column:
        one = lambda p: holds(p) if isinstance(p, Node) else F.col(f"c{place[id(p)]}") > 0
        if not node.must and not node.should:
            return F.lit(False)
        wanted = _all(one(p) for p in node.must) if node.must else reduce(or_, (one(p) for p in node.should))
        return wanted & _all(~one(p) for p in node.never)

    score, norm, coord = F.lit(0.0), 0.0, F.lit(0)
    for c, boost in scored_:
        i = place[id(c)]
        tf, df, n = F.col(f"c{i}"), facts[f"d{i}"], F.col(f"n_{c.field}")
        if scoring == "tfidf":
            weight = idf(total, df)
            score = score + F.when(tf > 0, F.sqrt(tf) * weight * weight * boost / F.sqrt(F.greatest(n, F.lit(1)))).otherwise(0.0)
            norm += weight * weight * boost * boost
            coord = coord + (tf > 0).cast("int")
        else:
            weight = math.log(1 + (total - df + 0.5) / (df + 0.5))
            mean = sizes[c.field].total / total if c.field in sizes and total else 1
            score = score + F.when(tf > 0, boost * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (mean or 1)))).otherwise(0.0)
    if scoring == "tfidf":
        score = score * coord / len(scored_) / (math.sqrt(norm) or 1)
    return rows.where(holds(tree)).select("doc_id", score.alias("score"))


def top(hits: DataFrame, k: int, score: str = "score", id_: str = "doc_id") -> DataFrame:
    """The k best, ties by id; a limit over an order, so each task keeps k rows."""
    return hits.orderBy(F.desc(score), id_).limit(k)


def two_fields(index: Index, query: str, k: int = 10, fields: tuple[str, str] = ("contents", "title")) -> DataFrame:
    """The k best of the k best of each field: (doc_id, field, score); a document may come twice."""
    each = [top(matches(index, query, f), k).withColumn("field", F.lit(f)) for f in fields]
    return each[0].unionByName(each[1]).orderBy(F.desc("score"), "doc_id", "field").limit(k).select("doc_id", "field", "score")


def fused(ranks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(doc_id, rank, text_score, score): of the hits (doc_id, score) the k with the best rank (doc_id, rank), by rank + text score."""
    both = ranks.join(hits.select("doc_id", F.col("score").alias("text_score")), "doc_id")
    best = both.orderBy(F.desc("rank"), "doc_id").limit(k)
    return best.withColumn("score", F.col("rank") + F.col("text_score")).orderBy(F.desc("score"), F.desc("rank"), "doc_id")


def idf(n: int, df: int) -> float:
    return 1 + math.log(n / (df + 1)) if n else 0.0
