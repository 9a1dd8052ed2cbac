"""A page's source as clean text that still shows its structure.

Headings begin with `# `, list items with `- `, lines of code blocks with four blanks; formulas
stand between dollar signs. Everything else is what a reader sees, a line a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, file_bytes, spread
from .boilerplate import html_lines
from .markup import _COMMENT, _FENCE, _MD_DISPLAY, _PRE, _TEX_CODE, _TEX_IN_HTML, _TEX_MATH, _WIKI_ITEM, _WIKI_MATH, language, markdown_text, tex_text, tidy, visible, wiki_text
from .near_duplicates import bit_table, hashed, held

_MARK = {"item": "- ", "code": "    "}
#: Stands before a line of code until the markup around it is gone.
_CODE = "\ue0fd"

_OPEN = re.compile(r"<(?:li|h[1-6]|p|div|tr|ul|ol|dl|dd|dt|table|pre|blockquote)\b", re.I)
_CLOSE = re.compile(r"</(?:li|h[1-6]|p|div|tr|ul|ol|dl|dd|dt|table|pre|blockquote)\s*>|<br\s*/?>", re.I)


def _formula(*groups: str | None) -> str:
    return f" ${tidy(next((g for g in groups if g), ''))}$ "


def _coded(body: str) -> str:
    return "\n" + "".join(f"{_CODE}{line}\n" for line in body.strip("\n").split("\n"))


def _lines(text: str) -> Iterator[tuple[str, str]]:
    """(kind, line) of a source: kind is heading, item, code or empty."""
    lang = language(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if lang == "html":
        text = _OPEN.sub(r"\n\g<0>", _CLOSE.sub(r"\g<0>\n", text))  # a block a line, however the source is laid out
        for x in html_lines(_TEX_IN_HTML.sub(lambda m: _formula(m[1], m[2], m[3]), text))[0]:
            yield ("heading" if x.kind[:1] == "h" else x.kind if x.kind in ("item", "code") else ""), x.text if x.kind == "code" else tidy(x.text)
        return
    if lang == "latex":
        text = _TEX_CODE.sub(lambda m: _coded(m[2]), text)
        text = "\n".join(x if x.startswith(_CODE) else re.sub(r"(?<!\\)%.*", "", x) for x in text.split("\n"))
        text = _TEX_MATH.sub(lambda m: _formula(m[1], m[2], re.sub(r"\\label\{[^}]*\}", "", m[4] or ""), m[5], m[6]), text)
    else:
        text = _COMMENT.sub("", text)
        text = _PRE.sub(lambda m: _coded(re.sub(r"&lt;", "<", re.sub(r"&gt;", ">", m[2])).replace("&amp;", "&")), text)
        text = _WIKI_MATH.sub(lambda m: _formula(visible(m[2])), text) if lang == "wiki" else _MD_DISPLAY.sub(lambda m: _formula(m[1]), text)
    fence, read = "", {"markdown": markdown_text, "wiki": wiki_text, "latex": tex_text}[lang]
    before: tuple[str, str] | None = None
    for line in text.split("\n"):
        m = _FENCE.match(line) if lang == "markdown" else None
        if m and (not fence or m[1][0] == fence[0]):
            fence = "" if fence else m[1]
            continue
        if fence or line.startswith(_CODE):
            now = "code", line.removeprefix(_CODE)
        elif lang == "markdown" and before and re.match(r" {0,3}(?:=+|-+)\s*$", line):
            before = ("heading", before[1])
            continue
        elif lang == "markdown" and line.startswith("    ") and (not before or before[0] == "code"):
            now = "code", line[4:]
        elif lang == "latex" and re.match(r"\s*\\(?:begin|end|documentclass|usepackage|maketitle)\b", line):
            continue
        elif lang == "wiki" and re.match(r"\s*(?:\{\||\|\}|\|-)", line):
            continue
        else:
            kind, body = "", line
            if lang == "markdown":
                h, i = re.match(r" {0,3}#{1,6}\s+(.*?)(?:\s+#+)?\s*$|\s*<h[1-6][^>]*>(.*?)</h", line), re.match(r" {0,3}(?:[-+*]|\d{1,9}[.)])\s+(.*)$", line)
                kind, body = ("heading", h[1] or h[2] or "") if h else ("item", i[1]) if i else ("", line)
            elif lang == "wiki":
                h, i = re.match(r"=+(.*?)=+\s*$", line), _WIKI_ITEM.match(line)
                kind, body = ("heading", h[1]) if h else ("item", i[1]) if i else ("", line)
            else:
                kind = "heading" if re.match(r"\s*\\(?:sub)*section\b|\s*\\chapter\b", line) else "item" if re.match(r"\s*\\item\b", line) else ""
                body = re.sub(r"^\s*\\item\s*(?:\[[^\]]*\])?", "", body)
            now = kind, tidy(read(body))
        if before:
            yield before
        before = now if now[1].strip() else None
    if before:
        yield before


def clean(text: str | None) -> str | None:
    """Clean text of one source; null stays null, a source without visible text is empty."""
    if not text:
        return text
    out = []
    for kind, line in _lines(text):
        out.append({"heading": "# ", **_MARK}.get(kind, "") + (line.rstrip() if kind == "code" else line))
    return "\n".join(out)


def clean_texts(pages: DataFrame) -> DataFrame:
    """(page_id, txt) of `pages` (page_id, text), a row an id: of several rows with one id, which must be the same, one.

    Texts aren't shuffled to find those rows: ids that come again are put into a bit table, and
    only rows whose id may be in it are compared.
    """
    ids = pages.select(F.col("page_id").cast("bigint").alias("id"))
    twice = cut(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "twice")
    table = bit_table(twice.where("id IS NOT NULL"), lambda b: hashed(b.column(0)), file_bytes(twice) // 8)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                again = held(table.value, hashed(part.column(0).fill_null(0))) | part.column(0).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([clean(x) for x in part.column(1).to_pylist()], pa.string()), pa.array(again)], ["page_id", "txt", "again"])

    cleaned = cut(spread(pages.select(F.col("page_id").cast("bigint"), "text")).mapInArrow(fn, "page_id bigint, txt string, again boolean"), "clean")
    return cleaned.where("NOT again").select("page_id", "txt").unionByName(cleaned.where("again").select("page_id", "txt").dropDuplicates(["page_id"]))
