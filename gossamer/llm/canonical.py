"""One form for texts that look the same.

A batch of texts becomes one array of code points. Lookup tables give for every code point the
sequence it stands for: canonical and presentation decompositions (width, ligatures, forms of
letters), nothing for invisible characters, a blank for every kind of blank, the Latin letter
for a letter of another script with the same shape. Gathers and expansion offsets apply them to
the whole batch at once; combining marks are then ordered and composed by array operations.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, spread

# Letters of Cyrillic, Greek, Armenian and Cherokee with the shape of a Latin letter.
LOOK_ALIKE = {
    "a": "а",
    "c": "с",
    "d": "ԁ",
    "e": "е",
    "h": "һհ",
    "i": "і",
    "j": "ј",
    "l": "ӏ",
    "o": "оοօ",
    "p": "р",
    "q": "ԛ",
    "s": "ѕ",
    "u": "ս",
    "v": "ѵν",
    "w": "ԝ",
    "x": "х",
    "y": "у",
    "A": "АΑᎪ",
    "B": "ВΒᏴ",
    "C": "СᏟ",
    "E": "ЕΕᎬ",
    "G": "Ꮐ",
    "H": "НΗᎻ",
    "I": "ІΙӀ",
    "J": "ЈᎫ",
    "K": "КΚ",
    "L": "Ꮮ",
    "M": "МΜᎷ",
    "N": "Ν",
    "O": "ОΟՕ",
    "P": "РΡᏢ",
    "Q": "Ԛ",
    "R": "Ꭱ",
    "S": "ЅՏᏚ",
    "T": "ТΤᎢ",
    "V": "ѴᏙ",
    "W": "ԜᎳ",
    "X": "ХΧ",
    "Y": "ҮΥ",
    "Z": "ΖᏃ",
}
# Kinds of decomposition after which a text looks another (raised, lowered, circled, fractions, squares).
VISIBLE_KINDS = {"<super>", "<sub>", "<circle>", "<fraction>", "<square>"}
# Code points outside the category Cf that show nothing, and those in it that do.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)]
SHOWN = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]

TOP = 0x110000


class Tables:
    """length[c], start[c]: the sequence flat[start : start + length] that code point c stands for; ccc; compositions."""

    def __init__(self) -> None:
        twin = {ord(x): ord(latin) for latin, xs in LOOK_ALIKE.items() for x in xs}
        hidden, shown = set(INVISIBLE), set(SHOWN)
        flat: list[int] = []
        self.length, self.start, self.ccc = np.ones(TOP, np.uint8), np.zeros(TOP, np.uint32), np.zeros(TOP, np.uint8)
        self.same = np.arange(TOP, dtype=np.uint32)
        first, second, whole = [], [], []

        def spell(c: int) -> list[int]:
            kind = unicodedata.decomposition(chr(c))
            if 0xAC00 <= c < 0xD7A4:
                return [ord(x) for x in unicodedata.normalize("NFD", chr(c))]
            if not kind or c == 0x017F:
                return [twin.get(c, c)]
            parts = kind.split()
            if parts[0][0] == "<":
                if parts[0] in VISIBLE_KINDS:
                    return [c]
                parts = parts[1:]
            return [y for x in parts for y in spell(int(x, 16))]

        for c in range(TOP):
            if 0xD800 <= c < 0xE000:
                continue
            what = unicodedata.category(chr(c))
            if what == "Cn" or what == "Co":
                continue
            self.ccc[c] = unicodedata.combining(chr(c))
            if c in hidden or what == "Cf" and c not in shown or what == "Cc" and c not in (9, 10, 11, 12, 13, 0x85):
                out = []
            elif what == "Zs":
                out = [32]
            elif c in (0x85, 0x2028, 0x2029):
                out = [10]
            else:
                out = [32 if unicodedata.category(chr(x)) == "Zs" else x for x in spell(c)]
            if out != [c]:
                self.length[c], self.start[c] = len(out), len(flat)
                flat += out
                self.same[c] = TOP  # look it up
            kind = unicodedata.decomposition(chr(c)) if not 0xAC00 <= c < 0xD7A4 else ""
            if kind and kind[0] != "<" and " " in kind:
                a, b = (int(x, 16) for x in kind.split())
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(c):
                    first.append(twin.get(a, a)), second.append(b), whole.append(c)
        for c in range(0xAC00, 0xD7A4):
            a, b = (ord(x) for x in (unicodedata.normalize("NFD", chr(c)) if (c - 0xAC00) % 28 == 0 else chr(c - (c - 0xAC00) % 28) + chr(0x11A7 + (c - 0xAC00) % 28)))
            first.append(a), second.append(b), whole.append(c)
        self.flat = np.array(flat, np.uint32)
        key = np.array(first, np.uint64) << np.uint64(21) | np.array(second, np.uint64)
        # of two spellings of one look, such as Latin and Cyrillic, the first (Latin) is kept
        self.key, at = np.unique(key, return_index=True)
        self.whole = np.array(whole, np.uint32)[at]


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def canonical(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical code points of texts that lie one after the other and end at `ends`, and their ends."""
    t = tables()
    if len(points):
        cr = points == 13
        if cr.any():
            follows = np.append(points[1:] == 10, False)
            follows[ends[(ends > 0) & (ends <= len(points))] - 1] = False  # not across texts
            keep = ~(cr & follows)
            ends = np.append(0, np.cumsum(keep))[ends]
            points = np.where(cr, np.uint32(10), points)[keep]
    length = t.length[points].astype(np.int64)
    at = np.append(0, np.cumsum(length))
    out = np.repeat(t.same[points], length)
    looked = np.flatnonzero(out == TOP)
    if len(looked):
        source = np.repeat(np.arange(len(points)), length)[looked]
        out[looked] = t.flat[t.start[points[source]] + (looked - at[source])]
    ends = at[ends]
    ccc = t.ccc[out]
    owner_start = np.zeros(len(out) + 1, bool)
    owner_start[np.append(0, ends[:-1])] = True
    if (ccc[1:] < ccc[:-1])[ccc[1:] > 0].any():
        run = np.cumsum((ccc == 0) | owner_start[:-1])
        order = np.lexsort((ccc, run))
        out, ccc = out[order], ccc[order]
    text = np.cumsum(owner_start[:-1])
    while len(out) > 1 and len(t.key):
        key = out[:-1].astype(np.uint64) << np.uint64(21) | out[1:].astype(np.uint64)
        place = np.minimum(np.searchsorted(t.key, key), len(t.key) - 1)
        hit = (t.key[place] == key) & (text[:-1] == text[1:])
        hit[1:] &= ~hit[:-1]
        if not hit.any():
            break
        out[:-1][hit] = t.whole[place[hit]]
        keep = np.append(True, ~hit)
        ends = np.append(0, np.cumsum(keep))[ends]
        out, text = out[keep], text[keep]
    return out, ends


def canonical_array(texts: pa.Array) -> pa.Array:
    """Canonical form of each text; a null one stays null."""
    texts = texts.cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    if not n:
        return pa.array([], pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets[1:] - offsets[0]]
    out, ends = canonical(points, ends)
    encoded = np.frombuffer(out.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    starts = np.append(np.flatnonzero((encoded & 0xC0) != 0x80), len(encoded))
    bounds = np.append(0, starts[ends])
    valid = texts.buffers()[0] if texts.null_count else None
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(encoded.tobytes()), valid, texts.null_count).cast(pa.string())


def canonical_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, form) of `documents` (doc_id, text): the text and its canonical form.

    Null stays null, empty stays empty; a text of invisible characters becomes empty. Every
    row comes out. Letter case, accents, digits, the number of blanks and line breaks stay.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                text = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), text, canonical_array(text)], ["doc_id", "text", "form"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(fn, "doc_id bigint, text string, form string")


def look_alikes(documents: DataFrame) -> DataFrame:
    """Pairs (doc_id_a, doc_id_b), a < b, of documents whose texts differ but have one form.

    Blank and null texts are left out. Equal strings are one class, so copies of a text are
    compared with no one: classes of one form are paired, then expanded to their documents.
    Forms and texts are known by 128-bit digests.
    """
    digest = lambda c: F.unhex(F.md5(c))
    rows = canonical_texts(documents).where(F.length(F.trim(F.regexp_replace("form", r"\s", " "))) > 0)
    rows = cut(rows.select("doc_id", digest("form").alias("form"), digest("text").alias("text")), "forms")
    classes = rows.select("form", "text").distinct()
    several = classes.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    classes = classes.join(several, "form")
    pairs = classes.withColumnRenamed("text", "x").join(classes.withColumnRenamed("text", "y"), "form").where("x < y").select("x", "y")
    left, right = rows.select(F.col("doc_id").alias("i"), F.col("text").alias("x")), rows.select(F.col("doc_id").alias("j"), F.col("text").alias("y"))
    found = pairs.join(left, "x").join(right, "y").where("i <> j")
    return found.select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b")).distinct()
