"""The SQL of the core queries, for an engine that reads the same tables."""

from __future__ import annotations

from .functions.html import REFERENCES
from .functions.text import INDEX_STOP_WORDS, SCOPES
from .queries import DAMPING, PHRASE, QUERY, ROUNDS

_W = "[ \\t\\n\\r\\f]+"


def _decoded(x: str) -> str:
    pieces = f"string_split({x}, '&#')"
    digits = "regexp_extract(q, '^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});', 1)"
    code = f"(CASE WHEN {digits} SIMILAR TO '[xX].*' THEN ('0x' || substr({digits}, 2))::INTEGER ELSE {digits}::INTEGER END)"
    one = f"CASE WHEN j = 1 THEN q WHEN {digits} = '' THEN '&#' || q ELSE CASE WHEN {code} = 160 THEN ' ' ELSE chr({code}) END || substr(q, length({digits}) + 2) END"
    x = f"CASE WHEN contains({x}, '&#') THEN array_to_string(list_transform({pieces}, lambda q, j: {one}), '') ELSE {x} END"
    for reference, char in REFERENCES:
        x = f"replace({x}, '{reference}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}', ' ', 'g'))"


def _text(x: str) -> str:
    bare = f"regexp_replace({x}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    return _tidy(_decoded(f"regexp_replace({bare}, '(?s)<[^>]*>', ' ', 'g')"))


def _words(x: str) -> str:
    return f"string_split_regex(regexp_replace({x}, '[ \\n\\r]+$', ''), '[ \\n\\r]+')"


def _terms(x: str) -> str:
    return f"coalesce(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), [])"


_STOP = ", ".join(f"'{w}'" for w in INDEX_STOP_WORDS)


def _indexed(x: str) -> str:
    return f"list_filter({_terms(x)}, lambda x: x NOT IN ({_STOP}))"


_PAGES = "p AS (SELECT DISTINCT ON (page_id) page_id, url, abs_url, unique_url, content, host FROM crawl_pages)"

_NORMAL = r"""
u AS (
  SELECT *, regexp_extract(abs_url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS x FROM {}
), n AS (
  SELECT *, CASE WHEN x.host <> '' THEN regexp_replace(lower(x.host), ':80$', '') || x.path || coalesce(x.query, '') ELSE abs_url END AS unique_ FROM u
)"""

_SCORED = rf"""
WITH {_PAGES},
t AS (SELECT page_id, string_split(lower(regexp_replace({_text('content')}, '[^a-zA-Z0-9 ]', '', 'g')), ' ') AS w FROM p),
q AS (SELECT string_split('{QUERY}', ' ') AS ask),
l AS (SELECT k.*, t.w, ask, lower(coalesce(anchor, '')) AS a, lower(coalesce(url, '')) AS h, string_split(lower(regexp_replace(coalesce(anchor, ''), '[^a-zA-Z0-9 ]', '', 'g')), ' ') AS ph FROM page_links k JOIN t USING (page_id), q),
b AS (SELECT *, coalesce(list_filter(range(0, greatest(len(w) - len(ph), 0) + 1), lambda i: len(w) >= len(ph) AND w[i + 1 : i + len(ph)] = ph)[1], -1) AS s FROM l),
n AS (SELECT *, list_concat(list_transform(range(1, 6), lambda i: w[greatest(s - i, 0) + 1]), list_transform(range(1, 6), lambda i: w[least(s + len(ph) - 1 + i, len(w) - 1) + 1])) AS near FROM b),
scores AS (SELECT link_id, abs_url, CAST(CASE WHEN len(list_filter(ask, lambda x: contains(a, x))) > 0 THEN 50 * len(list_filter(ask, lambda x: contains(a, x)))
  WHEN len(list_filter(ask, lambda x: contains(h, x))) > 0 THEN 40
  WHEN w IS NULL THEN 0
  ELSE 3 * len(list_filter(ask, lambda x: list_contains(near, x))) + len(list_filter(ask, lambda x: list_contains(w, x))) END AS INTEGER) AS score FROM n)
"""


def _search(counts: list[str], holds: str, scored: list[tuple[int, float]], k: int | None = None, bm25: bool = False, field: str = "contents", select: str = "doc_id, round(score, 6) AS score") -> str:
    """counts: SQL that gives the matches in the terms `t`; scored: clause and boost of those that add to the score."""
    cs = ", ".join(f"{c} AS c{i}" for i, c in enumerate(counts))
    ds = ", ".join(f"sum(CASE WHEN c{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(counts)))
    if bm25:
        parts = " + ".join(f"CASE WHEN c{i} > 0 THEN {b} * ln(1 + (nn - d{i} + 0.5) / (d{i} + 0.5)) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * len / a)) ELSE 0 END" for i, b in scored)
    else:
        idf = lambda i: f"(1 + ln(CAST(nn AS DOUBLE) / (d{i} + 1)))"
        total = " + ".join(f"CASE WHEN c{i} > 0 THEN sqrt(c{i}) * {idf(i)} * {idf(i)} * {b} / sqrt(greatest(len, 1)) ELSE 0 END" for i, b in scored)
        coord = " + ".join(f"CAST(c{i} > 0 AS INTEGER)" for i, _ in scored)
        norm = " + ".join(f"{idf(i)} * {idf(i)} * {b * b}" for i, b in scored)
        parts = f"({total}) * ({coord}) / {len(scored)} / sqrt({norm})"
    top = f" ORDER BY score DESC, doc_id LIMIT {k}" if k else ""
    return f"""
    WITH t AS (SELECT index_id AS doc_id, {_terms(field)} AS t, {_indexed(field)} AS kept FROM index_docs),
    c AS (SELECT doc_id, len(kept) AS len, {cs} FROM t),
    f AS (SELECT count(*) AS nn, avg(len) AS a, {ds} FROM c),
    s AS (SELECT doc_id, {parts} AS score FROM c, f WHERE {holds})
    SELECT {select} FROM (SELECT * FROM s{top}) x"""


def _term(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def _run(words: list[str]) -> str:
    """A phrase: a stop word in it stands for any term."""
    asked = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(words) if w not in INDEX_STOP_WORDS)
    return f"len(list_filter(range(1, len(t) - {len(words) - 2}), lambda i: {asked}))"


def _near(words: list[str], slop: int) -> str:
    """Places of the first word from which the others lie within `slop` moves."""
    rest = " AND ".join(f"len(list_filter(range(greatest(x + {k}, 1), x + {k + slop + 1}), lambda y: t[y] = '{w}')) > 0" for k, w in enumerate(words) if k and w not in INDEX_STOP_WORDS)
    return f"len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{words[0]}' AND len(list_filter(range(i - {slop}, i + 1), lambda x: {rest})) > 0))"


_ASK = QUERY.split()
_ANY = " OR ".join(f"c{i} > 0" for i in range(len(_ASK)))
_ALL = [(i, 1.0) for i in range(len(_ASK))]

_HITS = " + ".join(f"len(list_filter(regexp_extract_all(content, '<{x}>(.*?)</{x}>', 1), lambda q: contains(q, anchor)))" for x in SCOPES)
_GRAPH = f"""
WITH {_PAGES},
phi AS (SELECT page_id AS node, log2(greatest(len({_words(_text("coalesce(content, '')"))}), 1)) AS phi FROM p),
base AS (SELECT node, phi / (SELECT sum(phi) FROM phi) AS base FROM phi),
target AS (SELECT unique_url, min(page_id) AS dst FROM p WHERE unique_url IS NOT NULL GROUP BY 1),
l AS (SELECT page_id AS src, dst, content, k.url AS href, k.anchor FROM page_links k JOIN target USING (unique_url) JOIN p USING (page_id) WHERE k.url IS NOT NULL),
e AS (SELECT src, dst, sum(coalesce(CASE WHEN href <> '' THEN (length(content) - length(replace(content, href, ''))) // length(href) ELSE 0 END + CASE WHEN anchor <> '' THEN {_HITS} ELSE 0 END, 0)) AS weight FROM l GROUP BY ALL),
w AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM e QUALIFY sum(weight) OVER (PARTITION BY src) > 0),
idle AS MATERIALIZED (SELECT node FROM base WHERE node NOT IN (SELECT src FROM w)),
s0 AS MATERIALIZED (SELECT node, base AS score, 1.0 AS moved FROM base)"""


def _rounds(n: int) -> str:
    return "".join(
        f""",
f{i} AS (SELECT w.dst AS node, sum(s.score * w.w) AS flow FROM w JOIN s{i - 1} s ON s.node = w.src GROUP BY 1),
s{i} AS MATERIALIZED (SELECT b.node, {1 - DAMPING} * b.base + {DAMPING} * (coalesce(flow, 0) + (SELECT coalesce(sum(score), 0) FROM s{i - 1} WHERE node IN (SELECT node FROM idle)) / (SELECT count(*) FROM base)) AS score,
  max(abs({1 - DAMPING} * b.base + {DAMPING} * (coalesce(flow, 0) + (SELECT coalesce(sum(score), 0) FROM s{i - 1} WHERE node IN (SELECT node FROM idle)) / (SELECT count(*) FROM base)) - o.score)) OVER () AS moved
  FROM base b JOIN s{i - 1} o USING (node) LEFT JOIN f{i} USING (node))"""
        for i in range(1, n + 1)
    )


_EDGES = _GRAPH + _rounds(ROUNDS)
#: More rounds than any of the test tables needs; the first that moved no score by more than the tolerance counts.
_MOST = 30
_CONVERGED = (
    _GRAPH
    + _rounds(_MOST)
    + ", every AS (" + " UNION ALL ".join(f"SELECT {i} AS round, node, score, moved FROM s{i}" for i in range(1, _MOST + 1)) + ")"
    + ", rank AS (SELECT node, score FROM every WHERE round = (SELECT min(round) FROM every WHERE moved <= 0.01 / (SELECT count(*) FROM base)))"
)
_ADDRESS = r"(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace({0}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?]*')), ':80$', '') || substr(regexp_replace(regexp_replace({0}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), length(regexp_extract(regexp_replace(regexp_replace({0}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?]*')) + 1))"
_BEST = (
    _CONVERGED
    + f""", hits AS ({_search([_term(w) for w in _ASK], _ANY, _ALL, 50, select="doc_id, score AS text_score")}),
        latest AS (SELECT {_ADDRESS.format("abs_url")} AS address, min(page_id) AS node FROM p WHERE abs_url IS NOT NULL GROUP BY 1),
        best AS (SELECT d.index_id AS doc_id, title, abs_url, coalesce(s.score, 0.0) AS rank, h.text_score, coalesce(s.score, 0.0) + h.text_score AS score FROM index_docs d LEFT JOIN latest a ON a.address = {_ADDRESS.format("d.abs_url")} LEFT JOIN rank s USING (node)
          JOIN hits h ON h.doc_id = d.index_id ORDER BY 4 DESC, 1 LIMIT 10)"""
)

# the part of a text about the query's words, for a query that doesn't stand in it as a whole
_WINDOW = "array_to_string(w[greatest({0} - {2}, 0) + 1 : least({1} + {2}, len(w) - 1) + 1], ' ')"
_SIDE = "CAST(greatest(ceil((40 - (h[-1] - h[1] + 1)) / 2.0), 0) AS BIGINT)"
_PAGE = (
    _BEST
    + rf""", r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, b.title, b.abs_url, string_split({_tidy("coalesce(contents, '')")}, ' ') AS w FROM best b JOIN index_docs d ON d.index_id = b.doc_id),
        h AS (SELECT *, list_filter(range(0, len(w)), lambda i: lower(regexp_replace(w[i + 1], '[^-a-zA-Z0-9_ ]', '', 'g')) IN ({", ".join(repr(x) for x in _ASK)})) AS h FROM r),
        g AS (SELECT *, list_filter(range(1, len(h) + 1), lambda i: i = 1 OR h[i] - h[i - 1] > 15) AS b, list_filter(range(1, len(h) + 1), lambda i: i = len(h) OR h[i + 1] - h[i] > 15) AS e FROM h),
        t AS (SELECT *, CASE WHEN len(h) = 0 THEN array_to_string(w[1:41], ' ') WHEN h[-1] - h[1] < 40 THEN {_WINDOW.format("h[1]", "h[-1]", _SIDE)}
          ELSE array_to_string(list_transform(range(1, len(b) + 1), lambda k: {_WINDOW.format("h[b[k]]", "h[e[k]]", 5)}), ' ... ') END AS t FROM g),
        page AS (SELECT rank, title, abs_url, array_to_string(string_split(regexp_replace(t, '(?i)({"|".join(sorted(_ASK, key=lambda x: (-len(x), x)))})', '<b>\1</b>', 'g'), ' ')[1:40], ' ') AS snippet FROM t)"""
)


def _escaped(x: str) -> str:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{char}', '{reference}')"
    return x


_RUNS = "list_filter(string_split_regex(regexp_replace(coalesce({0}, ''), '[^a-zA-Z0-9 ]', '', 'g'), '[ \\n\\r]+'), lambda x: x <> '')"
_COUNTED = "list_distinct(list_transform(list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i : i + 3], ' ')), lambda x, i: x))"
_VERSIONS = f"""
WITH old AS (SELECT abs_url, arg_max(content, (fetched_at, page_id)) AS old FROM crawl_pages WHERE content IS NOT NULL GROUP BY abs_url),
keys AS (SELECT DISTINCT abs_url FROM crawl_pages),
v AS (SELECT incoming_id, k.abs_url IS NOT NULL AS known, {_RUNS.format('b.content')} AS x, {_RUNS.format('o.old')} AS y FROM page_batches b LEFT JOIN keys k USING (abs_url) LEFT JOIN old o USING (abs_url)),
r AS (
  SELECT incoming_id, side, run, count(*) AS c FROM (
    SELECT incoming_id, 'x' AS side, unnest(list_transform(range(1, len(x) - 2), lambda i: array_to_string(x[i : i + 3], ' '))) AS run FROM v WHERE known
    UNION ALL SELECT incoming_id, 'y', unnest(list_transform(range(1, len(y) - 2), lambda i: array_to_string(y[i : i + 3], ' '))) FROM v WHERE known) z GROUP BY ALL),
j AS (SELECT incoming_id, count(DISTINCT CASE WHEN side = 'x' THEN (run, c) END) AS nx, count(DISTINCT CASE WHEN side = 'y' THEN (run, c) END) AS ny, count(DISTINCT (run, c)) AS nu FROM r GROUP BY 1),
s AS (SELECT incoming_id, known, CASE WHEN known THEN round(CASE WHEN coalesce(nx, 0) > 0 AND coalesce(ny, 0) > 0 THEN (nx + ny - nu) / nu ELSE 0.0 END, 9) END AS similarity FROM v LEFT JOIN j USING (incoming_id))
"""

_EXACT = f"""
WITH old AS (SELECT abs_url, arg_max(content, (fetched_at, page_id)) AS old FROM crawl_pages WHERE content IS NOT NULL GROUP BY abs_url),
v AS (SELECT incoming_id, {_RUNS.format('b.content')} AS x, {_RUNS.format('o.old')} AS y FROM page_batches b JOIN old o USING (abs_url) WHERE b.content <> '' AND o.old <> ''),
r AS (SELECT incoming_id, list_distinct(list_transform(range(1, len(x) - 2), lambda i: array_to_string(x[i : i + 3], ' '))) AS a, list_distinct(list_transform(range(1, len(y) - 2), lambda i: array_to_string(y[i : i + 3], ' '))) AS b FROM v)
SELECT incoming_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0.0 END, 9) AS exact FROM r"""

_P7 = r"""
WITH addr AS (
  SELECT 'l' AS kind, link_id AS id, abs_url, seen_at AS at, NULL::TIMESTAMP AS until FROM page_links
  UNION ALL SELECT 'p', page_id, abs_url, fetched_at, removed_at FROM crawl_pages
  UNION ALL SELECT 's', seed_id, abs_url, NULL, NULL FROM seed_urls
), cut AS (
  SELECT *, regexp_replace(regexp_replace(abs_url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM addr WHERE abs_url IS NOT NULL
), parts AS (
  SELECT *, regexp_extract(rest, '^[^/?]*') AS raw_host FROM cut
), a AS (
  SELECT *, regexp_replace(lower(raw_host), ':80$', '') AS host, regexp_replace(lower(raw_host), ':80$', '') || substr(rest, length(raw_host) + 1) AS address FROM parts
), refs AS (
  SELECT 'out_links' AS ref, page_id AS owner_id, CAST(o AS VARCHAR) AS target, strftime(stored_at, '%Y-%m') AS period
  FROM (SELECT page_id, stored_at, unnest(out_links) AS o FROM crawl_pages) x
  WHERE o IS NOT NULL AND NOT EXISTS (SELECT 1 FROM page_links l WHERE l.link_id = o)
  UNION ALL
  SELECT 'abs_url', l.id, l.abs_url, strftime(l.at, '%Y-%m') FROM a l
  WHERE l.kind = 'l' AND l.host IN (SELECT lower(host) FROM sites)
    AND NOT EXISTS (SELECT 1 FROM a s WHERE s.kind = 's' AND s.address = l.address)
    AND NOT EXISTS (SELECT 1 FROM a p WHERE p.kind = 'p' AND p.address = l.address AND p.at <= l.at AND (p.until IS NULL OR p.until > l.at))
), found AS (SELECT DISTINCT * FROM refs)
"""

_ROBOTS = r"""
r AS (
  SELECT lower(host) AS host, robots_txt IS NULL AS allowed_all, substr(robots_txt, greatest(strpos(lower(robots_txt), 'user-agent: *'), 1)) AS tail FROM sites WHERE host IS NOT NULL
), c AS (
  SELECT host, allowed_all, CASE WHEN strpos(lower(substr(tail, 13)), 'user-agent:') > 0 THEN substr(tail, 1, 11 + strpos(lower(substr(tail, 13)), 'user-agent:')) ELSE tail END AS section FROM r
), rules AS (
  SELECT host, allowed_all, coalesce(list_sort(list_distinct(regexp_extract_all(section, 'Disallow:[ \t]*([^ \t\r\n]+)', 1))), []) AS disallow FROM c
)"""

_A = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*?)</a>"""
_OUT = rf"""
WITH {_PAGES},
raw AS (SELECT page_id, abs_url AS page_url, list_zip(regexp_extract_all(content, '{_A}', 1), regexp_extract_all(content, '{_A}', 2), regexp_extract_all(content, '{_A}', 3))[1:200] AS z FROM p),
h AS (SELECT page_id, page_url, unnest(range(0, len(z))) AS pos, unnest(list_transform(z, lambda v: coalesce(v[1], '') || coalesce(v[2], '') || coalesce(v[3], ''))) AS coded FROM raw),
d AS (SELECT page_id, page_url, pos, {_decoded("coded")} AS href FROM h),
parts AS (SELECT *, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS root, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_extract(page_url, '^([^?#]*/)', 1) AS here FROM d),
r AS (SELECT page_id, pos, href, coalesce(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN root = '' THEN '' WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN root || href
  WHEN starts_with(href, '#') OR href = '' THEN regexp_extract(page_url, '^([^#]*)', 1) || href WHEN starts_with(href, '?') THEN regexp_extract(page_url, '^([^?#]*)', 1) || href
  ELSE CASE WHEN length(here) > length(root) THEN here ELSE root || '/' END || href END, '') AS abs_url FROM parts),
ok AS (SELECT * FROM r WHERE regexp_matches(abs_url, '^https?://[-a-zA-Z0-9 ._/]+$')), {_NORMAL.strip().format("ok")}
SELECT page_id, pos, href, abs_url, unique_ AS unique_url FROM n QUALIFY row_number() OVER (PARTITION BY page_id, unique_, length(abs_url) ORDER BY pos) = 1"""

ORACLE: dict[str, str] = {
    "page_out_links": _OUT,
    "page_titles": rf"""WITH {_PAGES} SELECT page_id, coalesce(nullif({_tidy(_decoded("regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, ''), url) AS title FROM p""",
    "page_words": f"WITH {_PAGES}, n AS (SELECT page_id, len({_words(_text('content'))}) AS words FROM p WHERE content IS NOT NULL) SELECT page_id, words, round(log2(words), 6) AS phi FROM n",
    "page_body_chars": f"WITH {_PAGES} SELECT page_id, length({_text(chr(10).join(['regexp_replace(content,', repr('(?is)<head[^>]*>.*?</head>|<title[^>]*>.*?</title>'), ', ' + repr(' ') + ', ' + repr('g') + ')']))}) AS chars FROM p",
    "link_urls": rf"""
        WITH {_NORMAL.format("page_links")}
        SELECT link_id, 'http://' || coalesce(nullif(regexp_extract(regexp_replace(abs_url, '^https?://', ''), '^(.*/)', 1), ''), regexp_replace(abs_url, '^https?://', '')) AS base,
          regexp_extract(abs_url, '^(.*/)', 1) AS folder, coalesce(regexp_matches(abs_url, '^https?://[-a-zA-Z0-9 ._/]+$'), false) AS is_valid, replace(replace(abs_url, '/', '_'), ':', '') AS file_name,
          unique_ AS unique_url, lower(x.host) AS host FROM n""",
    "host_page_counts": f"WITH {_PAGES} SELECT host, count(*) AS pages FROM p GROUP BY host",
    "robots_rules": f"WITH {_ROBOTS} SELECT host, allowed_all, array_to_string(disallow, ' ') AS disallow FROM rules",
    "robots_safe_links": f"""WITH {_ROBOTS},
        l AS (SELECT link_id, lower(regexp_extract(abs_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host, regexp_extract(abs_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path FROM page_links)
        SELECT link_id FROM l JOIN rules USING (host) WHERE (allowed_all OR len(disallow) > 0) AND len(list_filter(disallow, lambda d: starts_with(path, d))) = 0""",
    "link_scores": _SCORED + "SELECT link_id, score FROM scores",
    "frontier_top": _SCORED + "SELECT abs_url, sum(score)::BIGINT AS score, count(*) AS links FROM scores GROUP BY abs_url ORDER BY score DESC, abs_url LIMIT 20",
    "unseen_links": "SELECT DISTINCT unique_url FROM page_links WHERE unique_url IS NOT NULL AND unique_url NOT IN (SELECT unique_url FROM crawl_pages WHERE unique_url IS NOT NULL)",
    "linked_pages": f"WITH {_PAGES} SELECT page_id FROM p WHERE unique_url IN (SELECT unique_url FROM page_links)",
    "last_good": "SELECT arg_max(abs_url, page_id) AS abs_url FROM crawl_pages WHERE page_id IN (SELECT page_id FROM page_links)",
    "postings_df": f"SELECT term, count(DISTINCT index_id) AS df, count(*) AS cf FROM (SELECT index_id, unnest({_indexed('contents')}) AS term FROM index_docs) x GROUP BY term",
    "doc_lengths": f"SELECT index_id AS doc_id, len({_indexed('contents')}) AS length FROM index_docs",
    "doc_count": "SELECT count(*) AS docs FROM index_docs",
    "tfidf_top": _search([_term(w) for w in _ASK], _ANY, _ALL, 10),
    "tfidf_all": _search([_term(w) for w in _ASK], _ANY, _ALL),
    "bm25_top": _search([_term(w) for w in _ASK], _ANY, _ALL, 10, bm25=True),
    "bool_and": _search([_term("walrus"), _term("fjord")], "c0 > 0 AND c1 > 0", [(0, 1.0), (1, 1.0)]),
    "bool_not": _search([_term("walrus"), _term("fjord")], "c0 > 0 AND c1 = 0", [(0, 1.0)]),
    "phrase_hits": _search([_run(PHRASE.split())], "c0 > 0", [(0, 1.0)]),
    "slop_hits": _search([_near(["walrus", "guards"], 2)], "c0 > 0", [(0, 1.0)]),
    "long_slop_hits": _search([_near(["walrus", "and", "guards", "narrow"], 4)], "c0 > 0", [(0, 1.0)]),
    "field_hits": _search([_term("notes")], "c0 > 0", [(0, 1.0)], field="title"),
    "prefix_hits": _search(["len(list_filter(kept, lambda x: x LIKE 'walr%'))"], "c0 > 0", [(0, 1.0)]),
    "wildcard_hits": _search(["len(list_filter(kept, lambda x: x LIKE 'w_lrus'))"], "c0 > 0", [(0, 1.0)]),
    "fuzzy_hits": _search(["len(list_filter(kept, lambda x: levenshtein(x, 'walrsu') <= 2))"], "c0 > 0", [(0, 1.0)]),
    "range_hits": _search(["len(list_filter(kept, lambda x: x BETWEEN 'waiter' AND 'walrus'))"], "c0 > 0", [(0, 1.0)]),
    "open_range_hits": _search(["len(list_filter(kept, lambda x: x > 'waiter' AND x < 'walrus'))"], "c0 > 0", [(0, 1.0)]),
    "fuzzy_one_hits": _search(["len(list_filter(kept, lambda x: levenshtein(x, 'walrsus') <= 1))"], "c0 > 0", [(0, 1.0)]),
    "boosted_hits": _search([_term("walrus"), _term("kitchen")], "c0 > 0 OR c1 > 0", [(0, 2.0), (1, 1.0)]),
    "grouped_hits": _search([_term("walrus"), _term("kitchen"), _term("deadline")], "(c0 > 0 OR c1 > 0) AND c2 > 0", [(0, 1.0), (1, 1.0), (2, 1.0)]),
    "two_field_merge": "WITH u AS ("
    + " UNION ALL ".join(f"SELECT * FROM ({_search([_term(w) for w in _ASK], _ANY, _ALL, 10, field=f, select=f'doc_id, score AS raw, {chr(39)}{f}{chr(39)} AS field')}) z" for f in ("contents", "title"))
    + ") SELECT doc_id, field, round(raw, 6) AS score FROM (SELECT * FROM u ORDER BY raw DESC, doc_id, field LIMIT 10) y",
    "pagerank_pages": _EDGES + f" SELECT node, round(score, 9) AS score FROM s{ROUNDS}",
    "pagerank_converged": _CONVERGED + " SELECT node, round(score, 9) AS score FROM rank",
    "rank_fusion": _BEST + " SELECT doc_id, round(rank, 9) AS rank, round(text_score, 6) AS text_score, round(score, 6) AS score FROM best",
    "search_ranked": _BEST + " SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, title, abs_url, round(score, 6) AS score FROM best",
    "search_page": _PAGE + " SELECT rank, title, abs_url, snippet FROM page",
    "search_page_text": _PAGE + " SELECT string_agg(rank || ': ' || coalesce(title, abs_url) || chr(10) || 'URL: ' || abs_url || chr(10) || snippet || chr(10) || chr(10), '' ORDER BY rank) AS text FROM page",
    "search_page_html": _PAGE
    + f""" SELECT '<h3>Results:</h3>' || string_agg('<div><b>' || rank || ': <a href="' || {_escaped("abs_url")} || '">' || {_escaped("coalesce(title, abs_url)")} || '</a></b><br>'
          || replace(replace({_escaped("snippet")}, '&lt;b&gt;', '<b>'), '&lt;/b&gt;', '</b>') || '<br><a href="' || {_escaped("abs_url")} || '">' || {_escaped("abs_url")} || '</a></div>' || chr(10), '' ORDER BY rank) AS html FROM page""",
    "strict_targets": f"WITH {_PAGES}, u AS (SELECT unique_url, min(page_id) AS target FROM p WHERE unique_url IS NOT NULL GROUP BY 1) SELECT link_id, target FROM page_links JOIN u USING (unique_url)",
    "phrase_snippets": rf"""
        WITH f AS (SELECT index_id, {_tidy("contents")} AS flat FROM index_docs WHERE contains(lower(regexp_replace(contents, '{_W}', ' ', 'g')), '{PHRASE}')),
        b AS (SELECT index_id, string_split(flat, ' ') AS w, len(string_split(substr(flat, 1, greatest(strpos(lower(flat), '{PHRASE}') - 1, 0)), ' ')) AS s FROM f),
        n AS (SELECT index_id, w, s, s + {len(PHRASE.split()) - 1} AS e FROM b),
        x AS (SELECT index_id, array_to_string(w[greatest(s - y, 1) : least(e + y, len(w))], ' ') AS t FROM (SELECT *, coalesce(list_filter(range(5, 21), lambda y: length(array_to_string(w[greatest(s - y, 1) : least(e + y, len(w))], ' ')) > 40)[1], 20) AS y FROM n) z)
        SELECT index_id, regexp_replace(t, '(?i)({PHRASE})', '<b>\1</b>', 'g') AS snippet FROM x""",
    "version_exact": _EXACT,
    "upserted_addresses": _VERSIONS.replace("FROM page_batches b", "FROM (SELECT max(incoming_id) AS incoming_id, abs_url, arg_max(content, incoming_id) FILTER (content IS NOT NULL) AS content FROM page_batches WHERE abs_url IS NOT NULL GROUP BY abs_url) b")
    + """, latest AS (SELECT abs_url, max(incoming_id) AS incoming_id, arg_max(content, incoming_id) FILTER (content IS NOT NULL) AS content FROM page_batches WHERE abs_url IS NOT NULL GROUP BY abs_url),
        change AS (SELECT l.abs_url, l.content FROM latest l JOIN s USING (incoming_id) WHERE NOT s.known OR s.similarity < 0.9)
        SELECT abs_url, length(content) AS chars FROM change
        UNION ALL SELECT k.abs_url, length(o.old) FROM keys k LEFT JOIN old o USING (abs_url) WHERE k.abs_url IS NULL OR k.abs_url NOT IN (SELECT abs_url FROM change)""",
    "page_walked_chars": rf"""WITH {_PAGES}, b AS (SELECT page_id, regexp_replace(regexp_replace(content, '(?is)^.*?<body[^>]*>|</body>.*$', '', 'g'), '(?is)<!--.*?-->|<head[^>]*>.*?</head>|<title[^>]*>.*?</title>', '', 'g') AS x FROM p)
        SELECT page_id, length({_decoded("regexp_replace(regexp_replace(x, '(?i)</[^>]*>|<(?:br|hr|img|input|meta|link|area|col)" + chr(92) + "b[^>]*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')")}) AS chars FROM b""",
    "anchor_hashes": """
        WITH h AS (SELECT link_id, CASE WHEN anchor IS NULL THEN NULL ELSE list_reduce(list_prepend(1125899906842597::HUGEINT, list_transform(list_filter(string_split(anchor, ''), lambda c: c <> ''), lambda c: ord(c)::HUGEINT)), lambda a, c: (31 * a + c) % 18446744073709551616::HUGEINT) + length(anchor) END AS h FROM page_links)
        SELECT link_id, CAST(CASE WHEN h % 18446744073709551616::HUGEINT >= 9223372036854775808::HUGEINT THEN h % 18446744073709551616::HUGEINT - 18446744073709551616::HUGEINT ELSE h % 18446744073709551616::HUGEINT END AS BIGINT) AS hash FROM h""",
    "highlighted_titles": r"SELECT index_id, CASE WHEN contains(lower(title), 'notes the') THEN regexp_replace(title, '(?i)(notes the)', '<b>\1</b>', 'g') ELSE regexp_replace(title, '(?i)(notes|the)', '<b>\1</b>', 'g') END AS title FROM index_docs",
    "hit_intervals": f"""
        WITH h AS (SELECT index_id AS doc_id, unnest(list_filter(range(0, len(t)), lambda i: t[i + 1] = 'deadline')) AS pos FROM (SELECT index_id, {_terms('contents')} AS t FROM index_docs) x),
        m AS (SELECT doc_id, pos - 5 AS s, pos + 5 AS e, CASE WHEN pos - 5 <= max(pos + 5) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS fresh FROM h),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS no FROM m)
        SELECT doc_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY doc_id, no""",
    "upsert_actions": _VERSIONS + "SELECT incoming_id, similarity, CASE WHEN NOT known THEN 'insert' WHEN similarity >= 0.9 THEN 'skip' ELSE 'update' END AS action FROM s",
    "first_last_events": "SELECT user_id, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM events GROUP BY user_id HAVING count(*) = count(ts)",
    "first_last_orders": "SELECT o_custkey, strftime(min(o_orderdate), '%m/%d/%Y') AS first_day, strftime(max(o_orderdate), '%m/%d/%Y') AS last_day FROM orders GROUP BY o_custkey HAVING count(*) = count(o_orderdate)",
    "nested_orders": "SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ' ' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
    "set_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersection": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_difference": "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "score_ties": "SELECT min(p_partkey) AS node, p_retailprice AS score FROM part GROUP BY p_retailprice",
    "p7_found": _P7 + "SELECT DISTINCT ref, owner_id, target FROM found",
    "p7_report": _P7 + "SELECT ref, period, count(*) AS orphans FROM found GROUP BY ALL",
}
