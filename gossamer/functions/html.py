"""Columns over HTML source: title, text, links, by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# The named references that are decoded, ampersand last.
REFERENCES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&middot;", "·"), ("&bull;", "•"), ("&sup2;", "²"), ("&deg;", "°"), ("&euro;", "€"),
    ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"), ("&ntilde;", "ñ"), ("&amp;", "&"),
)


def _numbered(text: Column) -> Column:
    """Decimal and hexadecimal references as their characters; a text without any is left alone."""
    pieces = F.split(text, "&#")

    def one(piece: Column, k: Column) -> Column:
        digits = F.regexp_extract(piece, "^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("int")
        good = (digits != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(k == 0, piece).when(good, F.concat(F.when(code == 160, F.lit(" ")).otherwise(char), F.substring(piece, F.length(digits) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&#"), piece))

    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def decoded(text: Column) -> Column:
    """Text with its references as characters. It is computed once, and one without an ampersand is left alone."""

    def spelled(t: Column) -> Column:
        for reference, char in REFERENCES:
            t = F.replace(t, F.lit(reference), F.lit(char))
        return t

    return bound(text, lambda t: F.when(F.contains(t, F.lit("&")), spelled(_numbered(t))).otherwise(t))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f]+", " "))


def title(html: Column) -> Column:
    """Text of the first title element; null if there is none or it is blank."""
    return F.nullif(tidy(decoded(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def _stripped(html: Column) -> Column:
    bare = F.regexp_replace(html, "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return tidy(decoded(F.regexp_replace(bare, "(?s)<[^>]*>", " ")))


def text(html: Column) -> Column:
    """All text, title included, white space collapsed."""
    return _stripped(html)


def body_text(html: Column) -> Column:
    """Text without the head element."""
    return _stripped(F.regexp_replace(html, "(?is)<head[^>]*>.*?</head>|<title[^>]*>.*?</title>", " "))


def walked_text(html: Column) -> Column:
    """Text of the body as its nodes have it, one blank after each element, white space as it is."""
    body = F.regexp_replace(F.regexp_replace(html, "(?is)^.*?<body[^>]*>|</body>.*$", ""), "(?is)<!--.*?-->|<head[^>]*>.*?</head>|<title[^>]*>.*?</title>", "")
    return decoded(F.regexp_replace(F.regexp_replace(body, "(?i)</[^>]*>|<(?:br|hr|img|input|meta|link|area|col)\\b[^>]*>", " "), "(?s)<[^>]*>", ""))


def links(html: Column) -> Column:
    """Array of (href, anchor) of the a elements with an href, in quotes of either kind or none, in order."""
    pattern = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>"
    double, single, bare, anchors = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4))
    zipped = F.arrays_zip(double.alias("d"), single.alias("s"), bare.alias("b"), anchors.alias("anchor"))
    return F.transform(zipped, lambda x: F.struct(decoded(F.concat(*(F.coalesce(x[c], F.lit("")) for c in "dsb"))).alias("href"), _stripped(x["anchor"]).alias("anchor")))


def escaped(text: Column) -> Column:
    """A text within HTML."""
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def refresh_target(html: Column) -> Column:
    """Where a meta refresh leads, null if there is none."""
    tag = F.regexp_extract(html, "(?is)<meta[^>]*http-equiv\\s*=\\s*[\"']?refresh[\"']?[^>]*>", 0)
    return F.nullif(F.trim(F.regexp_extract(tag, "(?is)content\\s*=\\s*[\"'][^\"'=]*=\\s*([^\"']*)", 1)), F.lit(""))
