"""Which lines of a page are not its main body, by composite text density.

1. Every node of an HTML page's tree gets its characters per tag, adjusted by the share of them
   that are link text; the sum over its children is the density sum, and the node with the
   largest one holds the body. The smallest density on the path from there up to the root is
   the threshold. Lines outside that subtree aren't main body, but for headings and code.
2. Sites put the same lines also into the body, and into texts that have no tree (extracted
   text, Markdown, wiki, LaTeX). So density also teaches: a line outside the subtree, or within
   it below the threshold and not part of a list, table, heading or code, is noticed. What was
   noticed on at least LEAST_SHARE of all different pages is a site line, wherever it stands; so is
   a line most of whose clauses or menu parts are. Numbers and the names of hosts are masked.
   After a site line that is mostly followed by ever other links, a box caption, short
   lines count with it up to the next one that is something else.

No word or wording is given: what isn't learned from the tables at hand is not known. Without
density nothing is learned. Two passes over whole texts; what is shuffled between them is three
numbers for each noticed line.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, spread
from .markup import _FENCE, _TAG, _TEX_CODE, language, markdown_text, tex_text, tidy, wiki_text

#: Share of the different pages on which a line must be noticed to be a site's, and the least number of them.
LEAST_SHARE, LEAST_PAGES = 0.001, 3
#: A caption: this share of its pages have a next link line of their own.
OWN_NEXT = 0.6
#: Characters of a line in a box of links.
BOX_LINE = 90

_PARTS_OF = re.compile(r"\s*(?:[|»>/·•›→\[\]–]|(?<=\s)[-–](?=\s)|\s{2,}|(?<=[.!?])\s|,\s)\s*")
_NUMBER = re.compile(r"\d(?:[\d.,]*\d)?")
_FORMULA = re.compile(r"\s*(?:\\\[|\$\$|\\begin)")
_GOING = re.compile(r"[.!?;:]$")


class Line:
    """A line of a source: what it shows, and the run of text it belongs to."""

    __slots__ = ("density", "inside", "kind", "links", "number", "text")

    def __init__(self, number: int, text: str, kind: str = "", links: float = 0.0, density: float = 0.0, inside: bool = True):
        self.number, self.text, self.kind, self.links, self.density, self.inside = number, text, kind, links, density, inside


def composite(chars: float, link_chars: float, tags: float, link_tags: float, root_chars: float, root_link_chars: float) -> float:
    """Composite text density of a node; without tags or links it is the plain density."""
    if not chars:
        return 0.0
    tags, plain = max(1.0, tags), max(1.0, chars - link_chars)
    base = math.log(chars / plain * link_chars + root_link_chars / max(1.0, root_chars) * chars + math.e)
    value = chars / max(1.0, link_chars) * (tags / max(1.0, link_tags))
    return chars / tags * math.log(max(value, 1.0000001)) / max(base and math.log(base + 1e-9) or 1.0, 1e-3) if base > 1.0001 and value > 0 else chars / tags


_VOID = {"br", "hr", "img", "meta", "link", "input", "base", "area", "col", "source", "wbr", "embed", "param", "track"}
_HIDDEN = {"head", "script", "style", "template", "title", "noscript"}
_RUNS = {"br", "p", "div", "td", "th", "tr", "table", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "nav", "article", "section", "center", "header", "footer", "main", "aside", "body", "span", "small", "form", "blockquote", "dl", "dd", "dt"}
_PARTS = {"p", "ul", "ol", "dl", "li", "dd", "dt"}
_AUTO = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<!\w[^>]*>|<\?[^>]*>|<(script|style|template|title|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?=<body\b|</head\s*>|\Z)", re.S | re.I)


def html_lines(text: str) -> tuple[list[Line], float]:
    """Lines of an HTML source with the density of their runs, and the threshold."""
    text = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    parent, name, chars, links, tags, link_tags = [-1], ["root"], [0], [0], [0], [0]
    stack, at, number = [0], 0, 1
    pieces: dict[int, list] = {}

    def put(chunk: str) -> None:
        nonlocal number
        node = stack[-1]
        open_ = {name[x] for x in stack}
        link = "a" in open_
        kind = "code" if "pre" in open_ else next((h for h in ("h1", "h2", "h3", "h4", "h5", "h6") if h in open_), "") or ("item" if "li" in open_ else "cell" if "table" in open_ else "")
        for k, part in enumerate(chunk.split("\n")):
            if k:
                number += 1
            shown = part.strip()
            if shown:
                n = len(shown)
                chars[node] += n
                links[node] += n if link else 0
                pieces.setdefault(number, []).append((part, n, link, kind, node))
            elif part:
                pieces.setdefault(number, []).append((" ", 0, link, "", node))

    for m in _TAG.finditer(text):
        put(text[at : m.start()])
        number += m[0].count("\n")
        at = m.end()
        tag, closing = m[1].lower(), m[0][1] == "/"
        if tag == "br" or tag in _RUNS or tag == "a" and closing:
            pieces.setdefault(number, []).append(("  ", 0, False, "", stack[-1]))
        if tag in _VOID:
            tags[stack[-1]] += 1
        elif closing:
            for i in range(len(stack) - 1, 0, -1):
                if name[stack[i]] == tag:
                    del stack[i:]
                    break
        else:
            if tag in _AUTO:
                for i in range(len(stack) - 1, 0, -1):
                    if name[stack[i]] in _AUTO[tag]:
                        del stack[i:]
                        break
                    if name[stack[i]] in ("ul", "ol", "table", "div", "body"):
                        break
            parent.append(stack[-1]), name.append(tag), chars.append(0), links.append(0), tags.append(1), link_tags.append(int(tag == "a"))
            stack.append(len(name) - 1)
    put(text[at:])
    own = list(chars)
    for i in range(len(name) - 1, 0, -1):
        for xs in (chars, links, tags, link_tags):
            xs[parent[i]] += xs[i]
    density = [composite(*x, chars[0], links[0]) for x in zip(chars, links, tags, link_tags)]
    sums = [0.0] * len(name)
    for i in range(1, len(name)):
        sums[parent[i]] += density[i]
    # text that stands in a node itself counts as a child of it
    sums = [s + (own[i] if sums[i] else 0) for i, s in enumerate(sums)]
    best = max(range(len(name)), key=lambda i: sums[i])
    # a paragraph or list is part of a body, however dense it is
    while name[best] in _PARTS:
        best = parent[best]
    path, least = best, density[best]
    while path >= 0:
        least, path = min(least, density[path]) if chars[path] else least, parent[path]
    within = [False] * len(name)
    for i in range(len(name)):
        within[i] = i == best or parent[i] >= 0 and within[parent[i]]
    out = []
    for no, parts in sorted(pieces.items()):
        shown = html.unescape("".join(p[0] for p in parts)).strip()
        if not shown:
            continue
        total = sum(p[1] for p in parts)
        linked = sum(p[1] for p in parts if p[2])
        kind = next((p[3] for p in parts if p[1] and p[3]), "")
        out.append(Line(no, shown, kind, linked / max(1, total), composite(total, linked, len({p[4] for p in parts}), len({p[4] for p in parts if p[2]}), chars[0], links[0]), any(within[p[4]] for p in parts if p[1])))
    return out, least


def plain_lines(text: str, lang: str) -> list[Line]:
    """Lines of a source without a tree."""
    text = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    if lang == "latex":
        text = re.sub(r"(?<!\\)%[^\n]*", "", _TEX_CODE.sub(lambda m: "\\codeblock" + re.sub(r"[^\n]", "", m[0]), text))
    read = {"markdown": markdown_text, "wiki": wiki_text, "latex": tex_text}.get(lang, tidy)
    out, fence, pre = [], "", False
    for no, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        kind = ""
        if lang in ("markdown", "wiki"):
            m = _FENCE.match(line) if lang == "markdown" else None
            opened = re.search(r"<(pre|source|syntaxhighlight)\b", line, re.I)
            if m and (not fence or m[1][0] == fence[0]):
                fence = "" if fence else m[1]
                continue
            if fence or pre or opened:
                kind = "code"
            pre = bool(opened or pre) and not re.search(r"</(pre|source|syntaxhighlight)", line, re.I)
            if lang == "markdown":
                kind = kind or "code" * line.startswith(("    ", "\t")) or "h1" * bool(re.match(r" {0,3}#{1,6} |\s*<h[1-6]", line))
            else:
                kind = kind or "h1" * bool(re.match(r"=+.+=+\s*$", line))
        elif lang == "latex":
            kind = "h1" * ("section" in line)
        shown = read(line) if lang != "text" else line.strip()
        if shown:
            out.append(Line(no, shown, kind))
    return out


@functools.lru_cache(10_000)
def masks(host: str | None) -> re.Pattern | None:
    """Matches a host's name and its longest label, with the capitalised words after it: how sites call themselves."""
    if not host:
        return None
    label = max(host.lower().split("."), key=len)
    return re.compile(rf"(?i:{re.escape(host)}|{re.escape(label)})(?: [A-Z]\w+)*") if label else None


def _masked(text: str, mask: re.Pattern | None) -> str:
    return _NUMBER.sub("0", (mask.sub("§", text) if mask else text).strip().lower())


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split()).strip(" .!?,:;")) - (1 << 63)


def whole_key(text: str, mask: re.Pattern | None) -> int:
    return _key(_masked(text, mask))


def part_keys(masked: str) -> list[int]:
    """Keys of the clauses and menu parts of a masked line."""
    return [_key(p) for p in _PARTS_OF.split(masked) if p.strip(" .!?,:;")]


def is_article(x: Line) -> bool:
    return x.kind == "code" or x.kind[:1] == "h" or bool(_FORMULA.match(x.text))


def noticed(x: Line, threshold: float) -> bool:
    """A line that density puts aside."""
    return not is_article(x) and (not x.inside or x.density < threshold and x.kind not in ("item", "cell"))


@dataclass
class SiteLines:
    """Keys of the site lines of a corpus, and those of them that are captions; sorted."""

    known: np.ndarray
    captions: np.ndarray


def noticed_rows(text: str | None, host: str | None) -> tuple[int | None, list[tuple[int, int | None]]]:
    """Identity of a page, the hash of its longest line, and the keys it notices, a line's with the key of the link line that follows it."""
    if not text or language(text) != "html":
        return None, []
    lines, threshold = html_lines(text)
    if not lines:
        return None, []
    mask, out = masks(host), {}
    held = [x if noticed(x, threshold) else None for x in lines]
    keys = [whole_key(x.text, mask) if x else None for x in held]
    for i, x in enumerate(held):
        if x:
            after = held[i + 1] if i + 1 < len(held) else None
            out[keys[i]] = keys[i + 1] if after and after.links > 0.9 else None
            for k in part_keys(_masked(x.text, mask)):
                out.setdefault(k, None)
    return xxhash.xxh64_intdigest(max((x.text for x in lines), key=len)) - (1 << 63), list(out.items())


def site_lines(pages: DataFrame, share: float = LEAST_SHARE, least: int = LEAST_PAGES) -> SiteLines:
    """The site lines that density finds in `pages` (host, text).

    Pages of one longest line count once, so copies of a text, however many, don't make its lines
    a site's. A known key is on at least `share` of the different pages, so there are at most
    1 / share times as many as a page notices on average, however large the corpus is: that
    many numbers are collected and broadcast. An empty table knows nothing.
    """
    spark = pages.sparkSession

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page, rows = noticed_rows(text, host)
                if page is not None:
                    seen.add((None, page, None))
                    seen.update((k, page, after) for k, after in rows)
            if len(seen) > 500_000:
                yield _rows(seen, 3)
                seen.clear()
        yield _rows(seen, 3)

    def _rows(rows: set[tuple], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(n)], ["key", "page", "after"][:n])

    found = spread(pages.select("host", "text")).mapInArrow(fn, "key bigint, page bigint, after bigint")
    once = cut(found.groupBy("key", "page").agg(F.min("after").alias("after")), "noticed")
    total = once.where("key IS NULL").count()
    often = once.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= max(least, share * total))
    often = cut(often, "site-lines")
    known = F.broadcast(often)  # see above for its bound
    after = once.where("key IS NOT NULL AND after IS NOT NULL").join(known, "key").join(F.broadcast(often.select(F.col("key").alias("after"))), "after", "left_anti")
    owned = after.groupBy("key").agg(F.count(F.lit(1)).alias("owned"))
    rows = often.join(owned, "key", "left").select("key", (F.col("owned") > OWN_NEXT * F.col("pages")).alias("caption")).collect()
    return SiteLines(np.sort(np.array([r.key for r in rows], np.int64)), np.sort(np.array([r.key for r in rows if r.caption], np.int64)))


def _in_box(shown: str, heads: set[str]) -> bool:
    return len(shown) < BOX_LINE and not _GOING.search(shown) and not any(h.startswith(shown.lower()) for h in heads)


def other_lines(text: str | None, source: str, title: str | None, host: str | None, known: set[int], captions: set[int]) -> list[int]:
    """Numbers of the lines of `text` that show a reader something which isn't main body.

    source: 'text' for extracted text, 'page' for a source in any markup language.
    """
    if not text:
        return []
    lang = "text" if source == "text" else language(text)
    lines = html_lines(text)[0] if lang == "html" else plain_lines(text, lang)
    mask, out, box = masks(host), [], False
    heads = {h for h in (tidy(title or "").lower(), *(tidy(x.text).lower() for x in lines if x.kind[:1] == "h")) if h}
    for x in lines:
        if is_article(x):
            box = False
            continue
        masked = _masked(x.text, mask)
        key = _key(masked)
        if not x.inside or key in known:
            box = key in captions
        else:
            parts = part_keys(masked)
            if len(parts) > 1 and 2 * sum(p in known for p in parts) > len(parts):
                box = False
            elif not box or not _in_box(tidy(x.text), heads):
                box = False
                continue
        out.append(x.number)
    return out


def other_line_rows(records: DataFrame, source: str, lines: SiteLines) -> DataFrame:
    """(rec_id, line_no) of `records` (rec_id, host, title, text), distinct: the lines that aren't main body.

    Lines are counted from 1 and split at newlines. Null and empty texts have none, a null
    title is like an empty one, a null host masks nothing. source as in other_lines.
    """
    sent = records.sparkSession.sparkContext.broadcast((lines.known.tobytes(), lines.captions.tobytes()))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, captions = (set(np.frombuffer(x, np.int64).tolist()) for x in sent.value)
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                rows = [(rec, no) for rec, host, title, text in zip(*(part.column(c).to_pylist() for c in range(4))) for no in other_lines(text, source, title, host, known, captions)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int32()))], ["rec_id", "line_no"])

    return spread(records.select(F.col("rec_id").cast("bigint"), "host", "title", "text")).mapInArrow(fn, "rec_id bigint, line_no int").distinct()
