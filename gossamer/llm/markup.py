"""Headings, list items, code blocks and formulas of HTML, Markdown, wiki and LaTeX sources.

Each page is read by the rules of its own language. Code blocks and comments are taken out
first, so nothing in them is an element; the rest is read line by line or tag by tag. One pass
over whole texts in Arrow batches, no shuffle but that of the final distinct.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread

Element = tuple[str, str]

_SPACE = re.compile(r"\s+")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
_RAW = re.compile(r"<(script|style|template|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_PRE = re.compile(r"<(pre|source|syntaxhighlight)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_INLINE_CODE = re.compile(r"<(code|tt|kbd|samp)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_TEX_IN_HTML = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$", re.S)
_BLOCKS = {"p", "div", "td", "th", "tr", "table", "ul", "ol", "dl", "dd", "dt", "section", "article", "nav", "header", "footer", "main", "aside", "blockquote", "center", "form", "body", "html", "hr"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Stands for a piece that was taken out, in the text around it.
_HOLE = "\ue0ff"
#: A line of its own that stands for a block that was taken out.
_BLOCK = "\ue0fe"


def tidy(text: str) -> str:
    """White space of any kind as single blanks, none at the ends."""
    return _SPACE.sub(" ", text.replace("\u200b", "")).strip()


def language(text: str) -> str:
    """'latex', 'html', 'wiki' or 'markdown', judged by what stands outside code and comments."""
    if re.search(r"\\(?:documentclass|(?:sub)*section|begin|href|item|emph|textbf)\b", text) and not re.search(r"<(?:html|body|p|div|title)\b", text, re.I):
        return "latex"
    if re.search(r"<html\b|<body\b|<title\b|</p>|</td>|<div\b|</li>|<ul\b|<ol\b|<p>", text, re.I):
        return "html"
    bare = _fenced(_PRE.sub("\n", _COMMENT.sub("", text)))[0]
    if re.search(r"\{\{|\[\[|''|^=+[^=\n].*=+[ \t\r]*$|^\{\||<math\b|\[https?://\S+ |<(?:source|syntaxhighlight)\b", bare + ("<source" if re.search(r"<(source|syntaxhighlight)\b", text) else ""), re.M):
        return "wiki"
    return "markdown"


def visible(fragment: str) -> str:
    """What a reader sees of an HTML fragment."""
    fragment = _COMMENT.sub("", fragment)
    return tidy(html.unescape(_TAG.sub(lambda m: " " if m[1].lower() in _BLOCKS or m[1].lower() in ("br", "li") else "", fragment)))


def read_html(text: str) -> Iterator[Element]:
    text = _RAW.sub(" ", _COMMENT.sub("", text))
    for m in _PRE.finditer(text):
        yield "code", visible(m[2])
    text = _PRE.sub("<hr>", text)
    yield from _html_blocks(text)
    for m in _TEX_IN_HTML.finditer(_INLINE_CODE.sub(" ", text)):
        yield "formula", visible(m[1] or m[2] or m[3])


def _html_blocks(text: str) -> Iterator[Element]:
    """Headings and items; an item without an end tag ends at the next item or the end of its list."""
    head: int | None = None
    items: list[list] = []  # of open lists: [depth of lists, pieces of the open item]
    lists, at = 0, 0
    for m in _TAG.finditer(text):
        name, closing = m[1].lower(), m[0][1] == "/"
        if name in _HEADS:
            if closing and head is not None:
                yield "heading", visible(text[head : m.start()])
                head = None
            elif not closing:
                head = m.end()
        elif name in ("li", "ul", "ol", "menu"):
            if items:
                items[-1][1].append(text[at : m.start()])
            if name == "li":
                if items and items[-1][0] == lists:
                    yield "item", visible("".join(items.pop()[1]))
                if not closing:
                    items.append([lists, []])
            elif closing:
                while items and items[-1][0] >= lists:
                    yield "item", visible("".join(items.pop()[1]))
                lists = max(0, lists - 1)
            else:
                lists += 1
            at = m.end()
    while items:
        items[-1][1].append(text[at:])
        at = len(text)
        yield "item", visible("".join(items.pop()[1]))


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^`\n]*)$")
_BULLET = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+)(\S.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_MD_DISPLAY = re.compile(r"(?<!\\)\$\$(.+?)(?<!\\)\$\$", re.S)
_MD_INLINE = re.compile(r"(?<![\\$])\$(?![\s$])((?:\\.|[^$\\])+?)(?<![\s\\])\$(?![\d$])", re.S)
_MD_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\]]*\])*)\]\((?:<[^>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_MD_STRONG = re.compile(r"(?<![\\*\w])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?!\*)|(?<![\\\w])(_{1,3})(?=\S)(.+?)(?<=\S)\3(?!\w)", re.S)
_MD_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


def _fenced(text: str) -> tuple[str, list[str]]:
    """The text with a line _BLOCK for each fenced block, and the blocks."""
    out, blocks, fence, block = [], [], "", []
    for line in text.split("\n"):
        m = _FENCE.match(line.rstrip("\r"))
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                blocks.append("\n".join(block))
                fence, block = "", []
            else:
                block.append(line)
        elif m:
            fence = m[1]
            out.append(_BLOCK)
        else:
            out.append(line)
    if fence:
        blocks.append("\n".join(block))
    return "\n".join(out), blocks


def markdown_text(s: str) -> str:
    """What a reader sees of inline Markdown."""
    held: list[str] = []

    def hold(x: str) -> str:
        held.append(x)
        return f"{_HOLE}{len(held) - 1}{_HOLE}"

    s = _MD_CODE.sub(lambda m: hold(m[2].strip(" ")), s)
    s = _MD_INLINE.sub(lambda m: hold(m[1]), s)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]), s)
    for _ in range(3):
        s = _MD_LINK.sub(r"\1", s)
    s = re.sub(r"<(https?://[^<>\s]+)>", r"\1", s)
    for _ in range(3):
        s = _MD_STRONG.sub(lambda m: m[2] or m[4], s)
    s = visible(s)
    return tidy(re.sub(f"{_HOLE}(\\d+){_HOLE}", lambda m: held[int(m[1])], s))


def read_markdown(text: str) -> Iterator[Element]:
    text = _COMMENT.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    text, blocks = _fenced(text)
    for b in blocks:
        yield "code", tidy(b)
    for m in _PRE.finditer(text):
        yield "code", visible(m[2])
    text = _RAW.sub(" ", _PRE.sub("\n\n", text))
    text = _MD_DISPLAY.sub(lambda m: f"\n{_HOLE}{m[1]}{_HOLE}\n", text)
    for m in re.finditer(f"{_HOLE}(.+?){_HOLE}", text, re.S):
        yield "formula", tidy(m[1])
    text = re.sub(f"{_HOLE}.+?{_HOLE}", _BLOCK, text, flags=re.S)
    paragraph: list[str] = []
    code: list[str] = []
    item: list[str] | None = None
    indent = 0
    rest: list[str] = []
    blank = True

    def end_item() -> Iterator[Element]:
        nonlocal item
        if item is not None:
            yield "item", markdown_text(" ".join(item))
            item = None

    def end_code() -> Iterator[Element]:
        if code:
            yield "code", tidy("\n".join(code))
            code.clear()

    for line in [*text.split("\n"), ""]:
        flat = line.expandtabs(4)
        if not flat.strip():
            blank = True
            paragraph = []
            rest.append("")
            continue
        if flat == _BLOCK:
            yield from end_item()
            yield from end_code()
            paragraph, blank = [], True
            rest.append("")
            continue
        width = len(flat) - len(flat.lstrip(" "))
        if item is not None and blank and width < indent and not _BULLET.match(flat):
            yield from end_item()
        if width >= 4 and item is None and not paragraph:
            code.append(flat[4:])
            blank = False
            continue
        if code:
            yield from end_code()
        # a line of an item counts from the item's own indent
        body = flat[indent:] if item is not None and width >= indent else flat
        m = _BULLET.match(body if item is not None and width >= indent else flat)
        if m and not _MD_RULE.match(flat) and not (paragraph and item is None and m[2][0].isdigit() and m[2][:-1] != "1"):
            base = indent if item is not None and width >= indent else 0
            yield from end_item()
            item, indent = [m[4]], base + len(m[1]) + len(m[2]) + min(len(m[3]), 4)
            a = _ATX.match(m[4])
            if a:
                yield "heading", markdown_text(a[2] or "")
            paragraph, blank = [m[4]], False
            rest.append(m[4])
            continue
        a = _ATX.match(body)
        if a:
            yield from end_item()
            yield "heading", markdown_text(a[2] or "")
            paragraph, blank = [], True
            rest += [body, ""]
            continue
        if paragraph and item is None and re.match(r"^ {0,3}(?:=+|-+)[ \t]*$", flat):
            yield "heading", markdown_text(" ".join(paragraph))
            paragraph, blank = [], True
            rest.append("")
            continue
        if _MD_RULE.match(flat):
            yield from end_item()
            paragraph, blank = [], True
            continue
        if item is not None:
            item.append(body.strip())
        paragraph.append(body.strip())
        rest.append(body)
        blank = False
    yield from end_item()
    yield from end_code()
    prose = "\n".join(rest)
    for kind, txt in _html_blocks(prose):
        yield kind, markdown_text(txt)
    for part in re.split(r"\n[ \t]*\n", prose):
        for m in _MD_INLINE.finditer(_INLINE_CODE.sub(" ", _MD_CODE.sub(" ", part))):
            yield "formula", tidy(html.unescape(m[1]))


_WIKI_HEAD = re.compile(r"^(={1,6})(.+?)\1[ \t]*$")
_WIKI_ITEM = re.compile(r"^[*#:;]*[*#][ \t]*(.*)$")
_WIKI_MATH = re.compile(r"<(math|chem)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)


def wiki_text(s: str) -> str:
    """What a reader sees of inline wiki text."""
    for _ in range(3):
        s = re.sub(r"\{\{[^{}]*\}\}", "", s)
    s = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", s, flags=re.S | re.I)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?:)?/[^\s\]]*[ \t]+([^\]]*)\]", r"\1", s)
    s = re.sub(r"\[https?://[^\s\]]*\]", "", s)
    s = re.sub(r"'{2,5}", "", s)
    return visible(s)


def read_wiki(text: str) -> Iterator[Element]:
    text = _COMMENT.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    for m in _PRE.finditer(text):
        yield "code", visible(m[2]) if m[1].lower() == "pre" else tidy(html.unescape(m[2]))
    text = _PRE.sub("\n", text)
    text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: re.sub(r"([*#=\[\]{}':;<>&])", lambda c: f"&#{ord(c[0])};", m[1]), text, flags=re.S | re.I)
    for m in _WIKI_MATH.finditer(_INLINE_CODE.sub(" ", text)):
        yield "formula", tidy(html.unescape(m[2]))
    lines: list[str] = []
    code: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line[:1] == " " and line.strip() and not re.match(r"\s*<", line):
            code.append(line[1:])
            continue
        if code:
            yield "code", wiki_text("\n".join(code))
            code = []
        lines.append(line)
        if m := _WIKI_HEAD.match(line):
            yield "heading", wiki_text(m[2])
        elif m := _WIKI_ITEM.match(line):
            yield "item", wiki_text(m[1])
    for kind, txt in _html_blocks("\n".join(lines)):
        yield kind, wiki_text(txt)


_TEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\])?(?:(?<=minted\})\{[^}]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_TEX_MATH = re.compile(
    r"(?<!\\)\\\[(.+?)\\\]|(?<!\\)\\\((.+?)\\\)|\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math|flalign)\*?)\}(.+?)\\end\{\3\}|(?<!\\)\$\$(.+?)(?<!\\)\$\$|(?<!\\)\$(?!\$)(.+?)(?<!\\)\$", re.S
)
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\]\s*)?\{")
# Accent commands and the combining marks they set.
_TEX_ACCENT = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328", "d": "\u0323", "b": "\u0331"}
# Commands for letters and signs.
_TEX_SIGN = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "ldots": "…", "dots": "…", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "copyright": "©", "S": "§", "P": "¶", "quad": " ", "qquad": " ", "textasciitilde": "~", "textasciicircum": "^", "textgreater": ">", "textless": "<", "euro": "€"}


def _braced(s: str, at: int) -> tuple[str, int]:
    """What stands in the braces that open before `at`, and where they end."""
    depth, i = 1, at
    while i < len(s):
        if s[i] == "\\":
            i += 2
            continue
        depth += (s[i] == "{") - (s[i] == "}")
        if not depth:
            return s[at:i], i + 1
        i += 1
    return s[at:], len(s)


def tex_text(s: str) -> str:
    """What a reader sees of inline LaTeX."""
    held: list[str] = []

    def hold(x: str) -> str:
        held.append(x)
        return f"{_HOLE}{len(held) - 1}{_HOLE}"

    s = re.sub(r"\\verb\*?([^\sA-Za-z*])(.*?)\1", lambda m: hold(m[2]), s)
    s = _TEX_MATH.sub(lambda m: hold(next((x for x in (m[1], m[2], m[4], m[5], m[6]) if x), "")), s)
    s = re.sub(r"\\([%&$#_{}])", lambda m: hold(m[1]), s)
    s = re.sub(r"\\\\(?:\[[^\]]*\])?|\\newline\b|\\[ ,;:!/]", " ", s)
    s = re.sub(r"\\(['`^\"~=.])\s*\{?\\?([A-Za-z])\}?|\\([cvuHrkdb])\s*\{([A-Za-z])\}", lambda m: hold(unicodedata.normalize("NFC", (m[2] or m[4]) + _TEX_ACCENT[m[1] or m[3]])), s)
    s = re.sub(r"\\(?:label|ref|cite|index|vspace|hspace|pageref|bibliography|footnotemark)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", s)
    s = re.sub(r"\\href\s*\{[^{}]*\}", "", s)
    s = re.sub(r"\\([A-Za-z]+)\b(?:\{\}| )?", lambda m: hold(_TEX_SIGN[m[1]]) if m[1] in _TEX_SIGN else m[0], s)
    s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?[ \t]*", "", s)
    s = s.replace("~", "\u00a0").replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”")
    s = re.sub(r"[{}]", "", s)
    return tidy(re.sub(f"{_HOLE}(\\d+){_HOLE}", lambda m: held[int(m[1])], s))


def read_latex(text: str) -> Iterator[Element]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, at = [], 0
    # a verbatim block that a comment opens isn't one: comments go first, line by line, outside of blocks
    while True:
        m = _TEX_CODE.search(text, at)
        while m and re.search(r"(?<!\\)%[^\n]*$", text[at : m.start()].rpartition("\n")[2]):
            m = _TEX_CODE.search(text, m.start() + 6)
        out.append(re.sub(r"(?<!\\)%[^\n]*", "", text[at : m.start() if m else len(text)]))
        if not m:
            break
        yield "code", tidy(m[2])
        out.append("\n\n")
        at = m.end()
    text = re.sub(r"\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)", "", "".join(out), flags=re.S)
    start = text.find(r"\begin{document}")
    text = text[start + 16 :] if start >= 0 else text
    text = text.partition(r"\end{document}")[0]
    bare = re.sub(r"\\verb\*?([^\sA-Za-z*])(.*?)\1", " ", text)
    for m in _TEX_MATH.finditer(bare):
        source = next((x for x in (m[1], m[2], m[4], m[5], m[6]) if x), "")
        yield "formula", tidy(re.sub(r"\\label\{[^}]*\}|\\nonumber\b", "", source))
    for m in _TEX_HEAD.finditer(text):
        yield "heading", tex_text(_braced(text, m.end())[0])
    depth: list[list[str] | None] = []
    at = 0
    for m in re.finditer(r"\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]]*\])?|\\item\b\s*(?:\[([^\]]*)\])?", text):
        if depth and depth[-1] is not None:
            depth[-1].append(text[at : m.start()])
        if m[1] == "begin":
            depth.append(None)
        elif depth:
            if depth[-1] is not None:
                yield "item", tex_text("".join(depth[-1]))
            if m[1] == "end":
                depth.pop()
            else:
                depth[-1] = [m[3] + " "] if m[3] else []
        at = m.end()


READERS = {"html": read_html, "markdown": read_markdown, "wiki": read_wiki, "latex": read_latex}


def elements(text: str | None) -> list[Element]:
    """(kind, txt) of the elements of one source, in order of kind; empty ones are left out."""
    if not text:
        return []
    return [(kind, txt) for kind, txt in READERS[language(text)](text) if txt]


def page_elements(pages: DataFrame) -> DataFrame:
    """(page_id, kind, txt), distinct, of `pages` (page_id, text). Null and empty texts have no element."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                rows = [(page, *e) for page, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for e in dict.fromkeys(elements(text))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["page_id", "kind", "txt"])

    return spread(pages.select(F.col("page_id").cast("bigint"), "text")).mapInArrow(fn, "page_id bigint, kind string, txt string").distinct()
