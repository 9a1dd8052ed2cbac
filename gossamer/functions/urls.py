"""Columns over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID = r"^https?://[-a-zA-Z0-9 ._/]+$"


def rest(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def base(url: Column) -> Column:
    """The folder of a URL, always under http; a bare host stays as it is."""
    folder = F.regexp_extract(rest(url), "^(.*/)", 1)
    return F.concat(F.lit("http://"), F.when(folder != "", folder).otherwise(rest(url)))


def folder(url: Column) -> Column:
    """Everything through the last slash."""
    return F.regexp_extract(url, "^(.*/)", 1)


def valid(url: Column) -> Column:
    return F.coalesce(url.rlike(VALID), F.lit(False))


def file_name(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("/"), F.lit("_")), F.lit(":"), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved; `..` at the root goes."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(segments, F.slice(segments, 1, 0), step)
    open_end = last.isin(".", "..")
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), F.when(open_end, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def normalized(url: Column) -> Column:
    """Scheme and host in lower case, port 80 and fragment dropped, dot segments resolved, the
    query appended without its question mark, a trailing slash kept; null if it has no scheme and host."""
    parts = [F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", i) for i in range(1, 5)]
    scheme, host = F.lower(parts[0]), F.regexp_replace(F.lower(parts[1]), ":80$", "")
    return F.when(parts[1] != "", F.concat(scheme, F.lit("://"), host, without_dots(parts[2]), parts[3]))


def unique(url: Column) -> Column:
    """The normalized URL without its scheme; the URL itself where it can't be normalized."""
    return F.coalesce(F.regexp_replace(normalized(url), "^[a-z][a-z0-9+.-]*://", ""), url)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def local(folder: Column, href: Column) -> Column:
    """A file named by `href` in a local folder, whose name ends with a slash or not; null if either is."""
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), href)


def resolved(href: Column, page_url: Column) -> Column:
    """An absolute URL for `href` found on `page_url`; empty if there is none."""
    root = F.regexp_extract(page_url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(page_url, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    here = F.regexp_extract(page_url, "^([^?#]*/)", 1)
    dir_ = F.when(F.length(here) > F.length(root), here).otherwise(F.concat(root, F.lit("/")))
    whole = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(root == "", F.lit(""))
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_extract(page_url, "^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(page_url, "^([^?#]*)", 1), href))
        .otherwise(F.concat(dir_, href))
    )
    # `.` and `..` in what was put together; a href that is a whole URL stays as it is
    pieces = [F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)(.*)$", i) for i in (1, 2, 3)]
    whole = F.when(~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & F.contains(whole, F.lit("/.")) & (pieces[0] != ""), F.concat(pieces[0], without_dots(pieces[1]), pieces[2])).otherwise(whole)
    return F.coalesce(whole, F.lit(""))
