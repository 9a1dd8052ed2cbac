"""How often every distinct term occurs, and in how many records.

Terms are maximal runs of letters and digits (Unicode, accents kept) of the lower-cased text.
An external sort of (term, record) pairs: every task writes down the pairs of its records as
numbers and sorts them a run at a time; the lengths of equal pairs and of equal terms give a
run's occurrences and distinct records of each term, so what leaves a task is a row a run and
term, also for a term in a third of all records. A record lies in one run whole, so distinct
records add up. The runs go through a range-partitioned sort by term, which spills as it must,
and a scan over the sorted partitions adds up the lengths of equal neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, spread

#: Pairs that a task sorts at once (8 bytes each), and distinct terms it holds before it writes a run.
RUN_PAIRS, RUN_TERMS = 4_000_000, 400_000
WORD = re.compile(r"[^\W_]+")
#: The marks: at most so many records, or more than this share of them.
RARE_RECORDS, COMMON_SHARE = 2, 0.4

_RUN = "field string, term string, occurrences bigint, records bigint"


class Run:
    """(term, record) pairs of one field, a pair a number: the term's place in the vocabulary above, the record below."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.pairs: list[np.ndarray] = []
        self.records = self.size = 0

    def add(self, texts: list[str]) -> None:
        found = [WORD.findall(x.lower()) for x in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        terms = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        place = np.fromiter((self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms.dictionary.to_pylist()), np.int64, len(terms.dictionary))
        record = np.repeat(np.arange(self.records, self.records + len(texts)), lengths)
        self.pairs.append(place[terms.indices.to_numpy()] << 32 | record)
        self.records += len(texts)
        self.size += len(record)

    def counted(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Terms in order, their occurrences and distinct records, by run lengths over the sorted pairs."""
        pairs = np.sort(np.concatenate(self.pairs)) if self.pairs else np.zeros(0, np.int64)
        pair_at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
        owner = pairs[pair_at] >> 32
        term_at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        occurrences, records = np.diff(np.append(pair_at[term_at], len(pairs))), np.diff(np.append(term_at, len(owner)))
        terms = list(self.vocabulary)  # every place has a pair, so places and runs agree
        order = np.array(sorted(range(len(terms)), key=terms.__getitem__), np.int64)
        return [terms[i] for i in order], occurrences[order], records[order]


def _runs(records: DataFrame, fields: list[str]) -> DataFrame:
    """Sorted runs (field, term, occurrences, records); the row with a null term counts a field's records."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [Run() for _ in fields]

        def written(f: int) -> pa.RecordBatch:
            terms, occurrences, held = runs[f].counted()
            total = runs[f].records
            runs[f] = Run()
            columns = [pa.array([fields[f]] * (len(terms) + 1)), pa.array([*terms, None], pa.string()), pa.array(np.append(occurrences, total), pa.int64()), pa.array(np.append(held, total), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["field", "term", "occurrences", "records"])

        for b in batches:
            for f in range(len(fields)):
                texts = b.column(f).drop_null().to_pylist()
                for i in range(0, len(texts), 500):
                    runs[f].add(texts[i : i + 500])
                    if runs[f].size > RUN_PAIRS or len(runs[f].vocabulary) > RUN_TERMS:
                        yield written(f)
        for f in range(len(fields)):
            yield written(f)

    return spread(records.select(*fields)).mapInArrow(fn, _RUN)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up neighbours with the same (field, term) in a sorted partition."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.table(b.columns, names=b.schema.names)
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        if not t.num_rows:
            continue
        fresh = np.ones(t.num_rows, bool)
        for c in ("field", "term"):
            now, before = t.column(c).slice(1), t.column(c).slice(0, t.num_rows - 1)
            fresh[1:] = pc.not_equal(now, before).to_numpy() if c == "field" else fresh[1:] | pc.not_equal(now, before).to_numpy()
        at = np.flatnonzero(fresh)
        sums = [np.add.reduceat(t.column(c).to_numpy(), at) for c in ("occurrences", "records")]
        summed = pa.table({"field": t.column("field").take(at), "term": t.column("term").take(at), "occurrences": sums[0], "records": sums[1]})
        yield from summed.slice(0, len(at) - 1).to_batches()
        held = summed.slice(len(at) - 1)
    if held is not None:
        yield from held.to_batches()


def term_counts(records: DataFrame, fields: list[str], rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """(field, term, occurrences, records, mark) of every term of every field of `records`.

    mark is 'rare' if at most `rare` records hold the term, else 'common' if more than the
    share `common` of the field's records does, else null. A null field is no record of that
    field, an empty one is; every row counts, repeated ones too. A table without a term gives
    no row.
    """
    runs = cut(_runs(records, fields), "runs")
    totals = runs.where("term IS NULL").groupBy("field").agg(F.sum("records").alias("total"))
    ordered = runs.where("term IS NOT NULL").repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    # totals has a row for each of `fields`
    marked = ordered.mapInArrow(_scan, _RUN).join(F.broadcast(totals), "field")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * F.col("total"), "common")
    return marked.select("field", "term", "occurrences", "records", mark.alias("mark"))
