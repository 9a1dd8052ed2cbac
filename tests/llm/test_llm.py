"""Training-data operators against brute force, exact round trips and hand-made cases."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gossamer.llm import anchors, boilerplate, canonical, clean_text, encoding, history, ledger, markup, mixture, near_duplicates, shingles, terms


def runs(x: str | None, k: int) -> set:
    t = re.findall("[a-z0-9]+", (x or "").lower())
    return {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}


def alike(x: str | None, y: str | None, k: int, t: float) -> bool:
    a, b = runs(x, k), runs(y, k)
    return bool(a and b) and len(a & b) / len(a | b) >= t


def corpus(seed: int = 1) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "one two three", "a b c d", "A b. C d!", "x " * 3000]
    for _ in range(40):
        base = [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 30)) for _ in range(r.randint(4, 80))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            edited = base[:]
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = "w" + str(r.randint(0, 99))
            if r.random() < 0.3:
                edited = edited[len(edited) // 2 :] + edited[: len(edited) // 2]
            texts.append(" ".join(edited))
    texts += texts[5:9]
    return list(enumerate(texts, 1))


@pytest.mark.parametrize(("k", "t"), [(4, 0.7), (5, 0.8), (1, 0.5)])
def test_near_duplicates_are_those_of_brute_force(spark, k, t):
    rows = corpus()
    df = spark.createDataFrame([(i, x, i) for i, x in [*rows, rows[8]]], "id long, text string, value long")
    docs, pairs = near_duplicates.similar_classes(df, k, t)
    got = {tuple(r) for r in near_duplicates.record_pairs(docs, pairs, df.select("id", "value")).collect()}
    want = {(i, j) for i, x in rows for j, y in rows if i < j and alike(x, y, k, t)}
    assert got == want
    parent = {i: i for i, x in rows if runs(x, k)}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in want:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    bare = {i: i for i, _ in rows if i not in parent}
    assert {r.id: r.group_id for r in near_duplicates.groups(docs, pairs, df.select("id")).collect()} == {i: root(i) for i in parent} | bare


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    docs, pairs = near_duplicates.similar_classes(df)
    assert docs.count() == pairs.count() == 0


def test_values_that_agree_are_no_pair(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "u"), (2, "a b c d e f", "u"), (3, "a b c d e f", None), (4, "a b c d e f", None)], "id long, text string, value string")
    docs, pairs = near_duplicates.similar_classes(df.select("id", "text"), 4, 0.7)
    assert {tuple(r) for r in near_duplicates.record_pairs(docs, pairs, df).collect()} == {(1, 3), (1, 4), (2, 3), (2, 4)}


def test_bounds_of_signatures():
    r = np.random.default_rng(0)
    for _ in range(200):
        universe = np.unique(r.integers(0, 1 << 48, 900, dtype=np.uint64))
        a, b = (np.sort(r.choice(universe, r.integers(1, 700), replace=False)) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        band = shingles.size_band(max(len(a), len(b)))
        assert np.bitwise_count(shingles.parity_words(a, band) ^ shingles.parity_words(b, band)).sum() <= apart
        pa_, pb = (np.frombuffer(history.profile(x), np.uint8).astype(int) for x in (a, b))
        assert np.abs(pa_ - pb).sum() <= apart
        assert (shingles.unpack48(shingles.pack48(a)) == a).all()


def test_a_long_list_is_expanded_in_chunks(monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 7)
    ranks = np.zeros(1 << shingles.SKETCH_BITS, np.uint8)
    run = anchors.Run(1, 0.7, ranks)
    common = np.arange(1, 31, dtype=np.uint64)
    for i in range(12):
        run.add(i, np.append(common, np.uint64(1000 + i)))
    rows = run.rows()
    pairs = anchors.Postings([x.as_buffer() for x in rows.column(1)]).pairs(0.7)
    seen: dict = {}
    for b in pairs:
        for x, y, n, _ in zip(*(c.to_pylist() for c in b.columns)):
            seen[x, y] = seen.get((x, y), 0) + n
    assert len(seen) == 66 and all(n >= anchors.LEAST for n in seen.values())


def test_tiles_of_bands_and_blocks_give_each_pair_once():
    r = np.random.default_rng(1)
    sets = {}
    for i in range(120):
        base = np.sort(r.choice(1 << 40, int(r.integers(5, 300)), replace=False)).astype(np.uint64) << np.uint64(8)
        for j in range(4):
            keep = base[r.random(len(base)) > 0.04 * j]
            if len(keep):
                sets[i * 4 + j] = np.unique(np.append(keep, r.choice(1 << 40, j, replace=False).astype(np.uint64) << np.uint64(8)))
    ranks = np.full(1 << shingles.SKETCH_BITS, 24, np.uint8)  # as if each shingle came 7 times
    want: dict = {}
    for hot, banded, mapped in ((0, False, False), (0, True, False), (10_000, True, True), (2, True, True)):
        seen: dict = {}
        run = anchors.Run(3, 0.7, ranks, banded, mapped, hot)
        run.mean = 0.0
        for fp, s in sets.items():
            run.add(fp, s)
        rows = run.rows()
        assert len(set(rows.column(0).to_pylist())) == len(rows)
        for tile, x in zip(rows.column(0).to_pylist(), rows.column(1)):
            for b in anchors.Postings([x.as_buffer()], tile=tile).pairs(0.7):
                for p, q, n, _ in zip(*(c.to_pylist() for c in b.columns)):
                    seen[p, q] = seen.get((p, q), 0) + n
        like = {(p, q) for p in sets for q in sets if p < q and len(np.intersect1d(sets[p], sets[q])) >= 0.7 * len(np.union1d(sets[p], sets[q]))}
        assert like and like <= {k for k, n in seen.items() if n >= min(anchors.LEAST, shingles.needed_overlap(len(sets[k[0]]), len(sets[k[1]]), 0.7))}
        want = want or {k: seen[k] for k in like}
        assert {k: seen[k] for k in like} == want
        pairs = np.array(sorted(seen))
        good = near_duplicates.similar_in_tile(list(sets), [shingles.pack48(s) for s in sets.values()], pairs[:, 0], pairs[:, 1], 0.7)
        assert {tuple(p) for p in pairs[good].tolist()} == like


def test_pairs_of_two_old_sets_are_not_expanded(monkeypatch):
    r, packed, marks = np.random.default_rng(2), [], []
    common = np.sort(r.choice(1 << 40, 40, replace=False)).astype(np.uint64)
    for mark, fps in ((0, range(200)), (1, range(195, 203))):  # five sets are on both sides
        run = anchors.Run(1, 0.7, np.zeros(1 << shingles.SKETCH_BITS, np.uint8))
        for fp in fps:
            run.add(fp, np.append(common[: 40 - fp % 7], np.uint64((1 << 41) + fp)))
        packed += [x.as_buffer() for x in run.rows().column(1)]
        marks.append(mark)
    many, expand, chunk = [], anchors.Postings._expand, anchors.CHUNK
    monkeypatch.setattr(anchors.Postings, "_expand", lambda self, i, j, *a: (many.append(len(i)), expand(self, i, j, *a))[1])
    of = lambda sides: Counter(k for b in anchors.Postings(packed, marks).pairs(0.7, sides) for p, q, n in zip(*(c.to_pylist() for c in b.columns[:3])) for k in [(p, q)] * n)
    want = {k: n for k, n in of(False).items() if max(k) >= 195}
    whole = sum(many)
    for chunk in (chunk, 11):
        monkeypatch.setattr(anchors, "CHUNK", chunk)
        many.clear()
        assert of(True) == want and len(want) == 8 * 195 + 8 * 7 // 2
        assert sum(many) < whole / 10


def test_kept_anchors_are_dealt_to_the_tiles_of_those_that_are_posted_there(monkeypatch):
    r, ranks = np.random.default_rng(3), np.zeros(1 << shingles.SKETCH_BITS, np.uint8)
    sets = [np.unique(r.integers(0, 1 << 48, int(n), dtype=np.uint64)) for n in r.integers(1, 600, 90)]
    kept, whole = [], anchors.Run(5, 0.7, ranks, banded=True)
    for part in (sets[:40], sets[40:]):
        run = anchors.Run(1, 0.7, ranks)
        for s in part:
            run.add(shingles.fingerprint(s), s)
            whole.add(shingles.fingerprint(s), s)
        kept.append(run.rows().column(1))
    assert [len(x) for x in kept] == [1, 1]  # however many tiles there are
    posted = {k: anchors.Postings([x.as_buffer()], tile=k) for k, x in zip(*(c.to_pylist() if n == 0 else c for n, c in enumerate(whole.rows().columns)))}
    for wanted in (None, lambda h: h % np.uint64(3) == 0):
        for size in (anchors.RUN, 1000):
            monkeypatch.setattr(anchors, "RUN", size)
            found: dict = {}
            for b in anchors.dealt(iter(kept), 5, 0.7, wanted):
                for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                    found.setdefault(k, []).append(x.as_buffer())
            rows = lambda tiles: {(k, *x) for k, p in tiles.items() for x in zip(*(getattr(p, c).tolist() for c in ("h", "fp", "size", "place"))) if not wanted or wanted(np.uint64(x[0]))}
            assert rows({k: anchors.Postings(x, tile=k) for k, x in found.items()}) == rows(posted)


def test_tiles_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(history, "TILE", 10)
    links = [(-1, i) for i in range(300)] + [(i, i + 1) for i in range(1000, 1500)]
    pairs = history.tiled(spark.createDataFrame(links, "a long, b long"), 800).collect()
    sizes = Counter(r.tile for r in pairs)
    assert sorted((r.a, r.b) for r in pairs) == sorted(links) and len(sizes) <= 81 and max(sizes.values()) < 60


def test_what_a_batch_asks_for_is_found_by_either_join(spark, monkeypatch):
    rows, cols = corpus(4), "id long, at long, text string"
    got = []
    for most in (history.ASKED, 0):
        monkeypatch.setattr(history, "ASKED", most)
        h = history.History(spark, k=4, t=0.7).start(spark.createDataFrame([(i, -1, x) for i, x in rows[:60]], cols))
        got.append({r.id for r in h.accept(spark.createDataFrame([(i, i, x) for i, x in rows[60:]], cols)).collect()})
    assert got[0] == got[1] == {j for j, y in rows[60:] if any(i < j and alike(x, y, 4, 0.7) for i, x in rows)}


def test_terms_are_those_of_brute_force(spark, monkeypatch):
    rows = [("Crème brûlée x_y 12", "T"), ("crème CRÈME", None), (None, ""), ("", "t t"), ("x " * 5000 + "é", "t"), ("crème brûlée x_y 12", "T")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "contents string, title string, term string").repartition(3)
    monkeypatch.setattr(terms, "RUN_PAIRS", 3)
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in terms.term_counts(df, ["contents", "title"]).collect()}
    want = {}
    for f, name in enumerate(("contents", "title")):
        texts = [re.findall(r"[^\W_]+", r[f].lower()) for r in rows if r[f] is not None]
        for w in {x for t in texts for x in t}:
            n = sum(w in t for t in texts)
            want[name, w] = (sum(t.count(w) for t in texts), n, "rare" if n <= 2 else "common" if n > 0.4 * len(texts) else None)
    assert got == want
    assert terms.term_counts(df.limit(0), ["contents"]).count() == 0


def test_batches_one_by_one_equal_all_at_once(spark):
    rows = corpus(2)
    old, new = rows[:60], rows[60:]
    want = {j for j, y in new if any(i < j and alike(x, y, 4, 0.7) for i, x in rows)}
    cols = "id long, at long, text string"
    start = spark.createDataFrame([(i, -1, x) for i, x in old], cols)
    for sizes in ([len(new)], [20, len(new) - 20]):
        h, got, at = history.History(spark, k=4, t=0.7).start(start), set(), 0
        for n in sizes:
            got |= {r.id for r in h.accept(spark.createDataFrame([(i, i, x) for i, x in new[at : at + n]], cols)).collect()}
            at += n
        assert got == want


def test_a_history_is_taken_up_again(spark, tmp_path):
    rows = corpus(2)
    old, new = rows[:60], rows[60:]
    want = {j for j, y in new if any(i < j and alike(x, y, 4, 0.7) for i, x in rows)}
    cols, path = "id long, at long, text string", str(tmp_path / "history")
    start = spark.createDataFrame([(i, -1, x) for i, x in old], cols)
    history.History(spark, path, 4, 0.7).start(start)
    got = set()
    for part in (new[:20], new[20:]):
        h = history.History(spark, path)
        assert (h.k, h.t) == (4, 0.7)
        got |= {r.id for r in h.accept(spark.createDataFrame([(i, i, x) for i, x in part], cols)).collect()}
    assert got == want and history.History(spark, path).batches == 3
    with pytest.raises(AssertionError):
        history.History(spark, path).start(start)
    with pytest.raises(ValueError):
        history.History(spark, path, k=5)
    (tmp_path / "other" / "pivots" / "batch=0").mkdir(parents=True)
    with pytest.raises(FileExistsError):
        history.History(spark, str(tmp_path / "other"))


def test_batches_that_bring_nothing(spark):
    cols = "id long, abs_url string, text string"
    accepted = spark.createDataFrame([(1, "http://A.b:80/x", "a b c d e f g"), (2, None, None)], cols)
    batch = [(1, "q", "a b c d e f g"), (2, "https://a.b/x#z", None), (3, "https://a.b/y", ""), (4, "http://a.b/y", ""), (5, None, None), (6, "q", "new words that no one wrote"), (7, "r", "new words that no one wrote")]
    assert {r.id for r in history.brings_nothing(spark.createDataFrame(batch, cols), accepted, 4, 0.7).collect()} == {1, 2, 4, 7}
    assert history.brings_nothing(spark.createDataFrame([], cols), accepted.limit(0), 4, 0.7).count() == 0


def test_batches_are_accepted_one_after_another(spark, monkeypatch):
    rows = corpus(2)
    old, new = rows[:60], rows[60:]
    want = {j for j, y in new if any(i < j and alike(x, y, 4, 0.7) for i, x in rows)}
    sizes, accept = [], history.History.accept
    monkeypatch.setattr(history.History, "accept", lambda self, records: (sizes.append(records.count()), accept(self, records))[1])
    cols = "id long, abs_url string, text string, batch int"
    batch = spark.createDataFrame([(i, None, x, 1 if n < 20 else 7 if n < 30 else None) for n, (i, x) in enumerate(new)], cols)
    got = {r.id for r in history.brings_nothing(batch, spark.createDataFrame([(i, None, x, 0) for i, x in old], cols), 4, 0.7).collect()}
    assert got == want and sizes == [20, 10, len(new) - 30]
    crossed = spark.createDataFrame([(1, 1), (5, 1), (3, 2), (9, 2), (10, 3)], "id long, batch int")
    assert history.arrivals(crossed) == [(1, 9), (10, 10)]


def test_ledger(spark):
    seeds = spark.createDataFrame([("s",), (None,)], "url string")
    rows = [(1, "a"), (2, "s"), (3, "a"), (4, None), (5, ""), (6, ""), (7, "A"), *((i, "hot") for i in range(10, 400))]
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "link_id long, url string, key string")
    want = {2, 3, 6, *range(11, 400)}
    assert {r.at for r in ledger.seen_keys(df.drop("key"), seeds, "url", "link_id").collect()} == want
    book = ledger.KeyLedger(spark)
    book.accept(seeds.selectExpr("url", "-1 AS at"), "url", "at", 0)
    got = set()
    for n, part in enumerate((df.where("link_id < 5"), df.where("link_id >= 5")), 1):
        for _ in range(2):  # a repeated batch gives the same
            got |= {r.at for r in book.accept(part, "url", "link_id", n).collect()}
    assert got == want
    nothing = ledger.seen_keys(df.limit(0), seeds, "url", "link_id")
    assert nothing.count() == 0
    seen = ledger.seen_keys(df.drop("key"), seeds, "url", "link_id")
    assert tuple(ledger.wrong_answers(seen, df, seeds, "url").first()) == (len(rows) - 1, len(want), 0, 0.0)
    short = seen.where("at <> 3").unionByName(seen.where("at = 2"))
    assert ledger.wrong_answers(short, df, seeds, "url").first().wrong == 2
    assert tuple(ledger.wrong_answers(nothing, df.limit(0), seeds, "url").first()) == (0, 0, 0, 0.0)
    book.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledger_")]


def test_encoding_is_exact(spark):
    path = encoding.vocabulary_path()
    encode = encoding.encoder(path)[0]
    r = random.Random(3)
    parts = ["a", "b ", "  ", "\n", "é", "ж", " 海", "3", "'s", "!", "\u00a0", "\u3000", " x", "👩\u200d🔬", "don't", "\t", "<|endoftext|>", "word " * 60]
    texts = [None, "", " ", "plain", "x" * 40_000, "ж " * 9000, *("".join(r.choice(parts) for _ in range(r.randint(1, 300))) for _ in range(150))]
    texts += texts[-5:]
    for t in texts:
        data = (t or "").encode()
        assert b"".join(encoding.chunks(data)) == data
        cuts = sorted(r.sample(range(len(t or "") + 1), min(3, len(t or ""))))
        pieces = [np.array(encode((t or "")[a:b]), np.int32) for a, b in zip([0, *cuts], [*cuts, len(t or "")])]
        assert encoding.joined(pieces, path).tolist() == encode(t or "")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {x.doc_id: x.ids for x in encoding.encoded(df.drop("ids")).collect()}
    assert got == {i: encode(t or "") for i, t in enumerate(texts)}
    assert encoding.encoded(df.limit(0)).count() == 0


def test_pivotal_rounding_keeps_the_mass():
    r = np.random.default_rng(1)
    ids, tokens, part = np.arange(5000), r.integers(1, 900, 5000), r.random(5000)
    out = mixture.pivotal(ids, tokens, part)
    assert ((out == 0) | (out == 1)).sum() >= 4999
    assert (out * tokens).sum() == pytest.approx((part * tokens).sum(), abs=1)
    many = np.mean([mixture.pivotal(ids[:5], tokens[:5], part[:5], seed) for seed in range(4000)], axis=0)
    assert many == pytest.approx(part[:5], abs=0.05)


def test_mixture(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, s, " ".join(r.choice("walrus fjord kelp hoof".split()) for _ in range(r.randint(1, 60)))) for s, n in (("big", 400), (" Big", 50), ("small", 30), ("other", 20)) for i in range(n)]
    rows = [(k, s, t) for k, (_, s, t) in enumerate(rows)] + [(900, None, "x"), (901, "big", None), (902, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("Small", 0.3, 3), ("gone", 0.1, 2), (None, None, None)], "source string, target_share double, max_repeats int")
    mix, shares = mixture.mixed(docs, targets)
    mix, shares = mix.collect(), {x.source: x for x in shares.collect()}
    drawn = sorted(tuple(x) for x in mix)
    monkeypatch.setattr(mixture, "HOME", 60)
    tree = sorted(tuple(x) for x in mixture.mixed(docs, targets)[0].collect())
    for parts in (1, 4, 16):  # neither the layout nor the order of rows plays a part
        again = docs.repartition(parts, "text").orderBy(F.desc("doc_id")) if parts == 4 else docs.repartition(parts)
        assert sorted(tuple(x) for x in mixture.mixed(again, targets)[0].collect()) == tree
    assert sum(x[2] * x[3] for x in tree) == pytest.approx(sum(x[2] * x[3] for x in drawn), abs=200)
    assert max(x.copies for x in mix if x.source == "small") <= 3 and max(x.copies for x in mix if x.source == "big") == 1
    assert not {x.doc_id for x in mix} & {900, 901, 902} and "other" not in {x.source for x in mix}
    assert shares["big"].actual_share == pytest.approx(2 / 3, abs=0.02) and shares["small"].actual_share == pytest.approx(1 / 3, abs=0.02) and shares["gone"].actual_share == 0
    empty, _ = mixture.mixed(docs.limit(0), targets)
    assert empty.count() == 0


def test_canonical_forms(spark):
    same = [("full", "ｆｕｌｌ"), ("fine flow", "ﬁne ﬂow"), ("é", "e\u0301"), ("Ko", "Κο"), ("pace", "расе"), ("abc", "a\u200bb\u00adc\ufeff"), ("x y", "x\u00a0y"), ("x y", "x\u202fy"), ("가", "\u1100\u1161"), ("a\n", "a\r\n"), ("ệ", "e\u0323\u0302"), ("ệ", "e\u0302\u0323")]
    form = lambda xs: canonical.canonical_array(pa.array(xs, pa.string())).to_pylist()
    for a, b in same:
        assert form([a]) == form([b]), (a, b)
    for a, b in [("m²", "m2"), ("a", "A"), ("e", "é"), ("x  y", "x y"), ("1", "l"), ("½", "1/2")]:
        assert form([a]) != form([b]), (a, b)
    texts = [None, "", "plain", "é" * 9000, "a\u0301", "\u0301a", "\u200b"]
    assert form(texts) == [None, "", "plain", "é" * 9000, "á", "\u0301a", ""]
    plain = ["Größe, naïve, señera, dépôt", "Årlund 한국어 ελληνικα"]
    assert form(plain[:1]) == [unicodedata.normalize("NFC", plain[0])]
    # one text alone or among others, in slices too
    array = pa.array([x for p in same for x in p] + texts)
    assert canonical.canonical_array(array).to_pylist() == [form([x])[0] for x in array.to_pylist()]
    assert canonical.canonical_array(array.slice(3, 5)).to_pylist() == canonical.canonical_array(array).to_pylist()[3:8]
    df = spark.createDataFrame([(1, "pace x"), (2, "расе x"), (3, "pace x"), (4, "pace y"), (5, " "), (6, "\u00a0"), (7, None), (8, "pacé x")], "doc_id long, text string")
    assert {tuple(r) for r in canonical.look_alikes(df).collect()} == {(1, 2), (2, 3)}
    assert canonical.look_alikes(df.limit(0)).count() == 0


HTML = """<html><head><title>T <h1>no</h1></title></head><body><!-- <h2>no</h2> --><h1 class="x">A &amp;&nbsp;<b>B</b></h1>
<ul><li>one <a href="#">link</a><li>two<ul><li>inner</li></ul></li></ul><pre><code>if (a &lt; b)
  # x</code></pre>text \\(x &lt; 2\\) and <code>inline \\(no\\)</code> $5 or $6<div>\\[ y^2 \\]</div></body></html>"""
MARKDOWN = """# Head *one* #

Two
===

\\# no

* item `code`
+ plus [link](<http://x>)
1. num

~~~text
# no
* no
~~~

    - indented

costs $5 or $6 and $a < 3$ `$no$`

$$
\\frac{a}{b}
$$
<!-- # no -->
<h3>Html</h3>
"""
WIKI = """{{Page|id=1}}
== Head [[Ref:a|b]] ==
* item ''x''
# num [http://x text]
<source>
== no ==
</source>
:<math>k &lt; 2</math>
<!-- * no -->
"""
LATEX = """\\documentclass{article}\\begin{document}
\\section*{Head \\& \\emph{one}~two}\\label{s}
% \\section{no}
\\begin{itemize}
\\item one \\href{http://x}{link}
\\item two
\\end{itemize}
\\begin{verbatim}
\\item no % kept
\\end{verbatim}
costs \\$5, \\(a_1\\) and \\begin{equation}\\label{e} b \\end{equation}
\\end{document}"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (HTML, {("heading", "A & B"), ("item", "one link"), ("item", "two"), ("item", "inner"), ("code", "if (a < b) # x"), ("formula", "x < 2"), ("formula", "y^2")}),
        (MARKDOWN, {("heading", "Head one"), ("heading", "Two"), ("heading", "Html"), ("item", "item code"), ("item", "plus link"), ("item", "num"), ("code", "# no * no"), ("code", "- indented"), ("formula", "a < 3"), ("formula", "\\frac{a}{b}")}),
        (WIKI, {("heading", "Head b"), ("item", "item x"), ("item", "num text"), ("code", "== no =="), ("formula", "k < 2")}),
        (LATEX, {("heading", "Head & one two"), ("item", "one link"), ("item", "two"), ("code", "\\item no % kept"), ("formula", "a_1"), ("formula", "b")}),
        (None, set()), ("", set()), ("plain words", set()),
    ],
)
def test_markup(text, want):
    assert set(markup.elements(text)) == want
    assert set(markup.elements(text.replace("\n", "\r\n") if text else text)) == want


@pytest.mark.parametrize("text", [HTML, MARKDOWN, WIKI, LATEX])
def test_clean_text_shows_every_element(text):
    out = clean_text.clean(text)
    flat = markup.tidy(re.sub(r"(?m)^(?:# |- |    )", "", out))
    marked = {kind: {x[2:] for x in out.split("\n") if x.startswith(sign)} for kind, sign in (("heading", "# "), ("item", "- "))}
    for kind, txt in markup.elements(text):
        assert txt in (marked[kind] if kind in marked else flat), (kind, txt)


def test_clean_text_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x " * 50_000, 1)], "page_id long, text string, txt int")
    got = {r.page_id: r.txt for r in clean_text.clean_texts(df).collect()}
    assert got[1] is None and got[2] == "" and len(got[3]) == 99_999


def test_markup_rows(spark):
    df = spark.createDataFrame([(1, HTML, "k"), (1, HTML, "k"), (2, None, "k"), (3, "# x\n" * 3000, "k")], "page_id long, text string, kind string")
    got = markup.page_elements(df)
    assert got.count() == 8 and got.where("page_id = 3").count() == 1


def test_lines_outside_the_body_go_whatever_they_say():
    article = [f"<p>In the fjord number {i} the walrus collected heaps of krill, said the report, and nobody had counted them before the thaw.</p>" for i in range(8)]
    page = "\n".join(["<html><body>", '<div class="side">', "<a href='/z'>Seventeen puffins wait for you</a>", "Zorblat tells all, each Monday", "<h2>A heading</h2>", "</div>", '<div class="main">', *article, "A short line of the article", "</div>", "</body></html>"])
    of = lambda text: boilerplate.other_lines(text, "page", None, None, set(), set())
    assert of(page) == [3, 4]
    dense = "\n".join(["<html><body><center>", *[x.replace("p>", "i>") for x in article[:2]], "<ol>", *[f"<li>The walrus of fjord {i} collected krill until further notice.</li>" for i in range(9)], "</ol>", "</center></body></html>"])
    assert of(dense) == []
    assert of(None) == of("") == []


def _site_pages():
    """(rec_id, host, title, text) of 12 HTML pages and one extracted text, with what isn't body by line numbers."""
    word = lambda i, j: "".join(chr(97 + (i * 31 + j * 7 + k * k * (i + 2 * j + 1)) % 26) for k in range(7))
    sentence = lambda i, j: " ".join(word(i, 10 * j + k) for k in range(14)).capitalize() + "."
    pages, cases = [], set()
    for i in range(12):
        lines = [
            "<html><body>", '<div><a href="/a">Zorb</a> | <a href="/b">Quill</a> | <a href="/c">Vantel</a></div>', "<div>", f"<h1>{word(i, 1)}</h1>", *(f"<p>{sentence(i, j)}</p>" for j in range(6)),
            "<p><small>Mirf dolun 17 tarasi</small></p>" if i % 2 else "<p></p>", "</div>", "<div><b>Skar onim</b><br>", f'<a href="/1">{word(i, 2)} {word(i, 3)}</a><br>', f'<a href="/2">{word(i, 4)} {word(i, 5)}</a><br>', "</div>", "<p><small>Mirf dolun 4 tarasi</small></p>", "</body></html>",
        ]
        pages.append((i, f"www.site{i % 3}.example", None, "\n".join(lines)))
        cases |= {(i, n) for n, x in enumerate(lines, 1) if any(y in x for y in ("Zorb", "Mirf", "Skar", 'href="/1', 'href="/2'))}
    text = ["Quill", "A title", sentence(40, 1), "Vantel burrow", "Mirf dolun 9 tarasi", "Skar onim", "fresh walrus", "Zorb | Quill | Other"]
    return pages, cases, [(77, "www.site1.example", "A title", "\n".join(text))], {(77, n) for n in (1, 5, 6, 7, 8)}


def _found(spark, pages, texts):
    kind = "rec_id long, host string, title string, text string"
    html_pages, plain = spark.createDataFrame(pages, kind), spark.createDataFrame(texts, kind)
    lines = boilerplate.site_lines(html_pages.select("host", "text"))
    return {(r.rec_id, r.line_no) for df, source in ((html_pages, "page"), (plain, "text")) for r in boilerplate.other_line_rows(df, source, lines).collect()}


def test_site_lines_are_learned_through_density(spark, monkeypatch):
    pages, cases, texts, more = _site_pages()
    assert _found(spark, pages + pages, texts) == cases | more
    # another wording of everything a reader sees gives the same rows: no word is known beforehand
    other = str.maketrans("abcdefghijklmnopqrstuvwxyz", "kvpzqxjwybcdfghlmnrstueoia")
    again = [(i, h, None, re.sub(r"(?<=>)[^<]+", lambda m: m[0].lower().translate(other), x)) for i, h, _, x in pages]
    texts_again = [(i, h, t.lower().translate(other), x.lower().translate(other)) for i, h, t, x in texts]
    assert _found(spark, again, texts_again) == cases | more
    # a third of all pages as copies of one text: its lines stay
    copies = [(100 + i, "www.site1.example", None, pages[0][3]) for i in range(12)]
    assert {x for x in _found(spark, pages + copies, texts) if x[0] < 100} == cases | more
    # without density other lines go, and other lines are learned
    outside = lambda: {(i, n) for i, h, t, x in pages for n in boilerplate.other_lines(x, "page", t, h, set(), set())}
    taught = lambda: {k for i, h, _, x in pages for k, _ in boilerplate.noticed_rows(x, h)[1]}
    before = outside(), taught()
    monkeypatch.setattr(boilerplate, "composite", lambda *_: 0.0)
    assert outside() != before[0] and taught() != before[1]


def test_other_line_rows_of_odd_tables(spark):
    pages, cases, _, _ = _site_pages()
    kind = "rec_id long, host string, title string, text string, line_no int"
    odd = spark.createDataFrame([(1, None, None, None, 5), (2, "", "t", "", 5), (3, "h", "t", "Zorb\n" + "word " * 20_000, 5), (None, None, None, "Zorb", 5)], kind)
    lines = boilerplate.site_lines(spark.createDataFrame(pages, kind.rpartition(",")[0]).select("host", "text"))
    assert {(r.rec_id, r.line_no) for r in boilerplate.other_line_rows(odd, "page", lines).collect()} == {(3, 1), (None, 1)}
    nothing = boilerplate.site_lines(odd.where("rec_id > 9").select("host", "text"))
    assert len(nothing.known) == 0 and boilerplate.other_line_rows(odd, "page", nothing).count() == 0
