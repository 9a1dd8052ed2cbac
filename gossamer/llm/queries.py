"""Queries of the training-data operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import boilerplate, canonical, clean_text, encoding, history, ledger, markup, mixture, near_duplicates, terms

Query = Callable[[SparkSession, str], DataFrame]


#: TESTDATA.md fixes runs of 4 tokens and an overlap of 0.7 for the pages of problems 1 and 3.
RUN_OF, OVERLAP = 4, 0.7


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_pages", "page_id", "content").toDF("id", "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, pairs = near_duplicates.similar_classes(_pages(spark, folder), RUN_OF, OVERLAP)
    urls = table(spark, folder, "crawl_pages", "page_id", "unique_url").toDF("id", "value")
    return near_duplicates.record_pairs(docs, pairs, urls).toDF("page_id_a", "page_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    return near_duplicates.groups(*near_duplicates.similar_classes(pages, RUN_OF, OVERLAP), pages.select("id")).toDF("page_id", "group_id")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_counts(table(spark, folder, "index_docs", "contents", "title"), ["contents", "title"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_terms(spark, folder).where("mark IS NOT NULL").select("field", "term", "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    batches = table(spark, folder, "page_batches", "incoming_id", "batch_no", "abs_url", "content").toDF("id", "batch", "abs_url", "text")
    accepted = table(spark, folder, "crawl_pages", "page_id", "abs_url", "content").toDF("id", "abs_url", "text")
    return history.brings_nothing(batches, accepted, RUN_OF, OVERLAP).toDF("incoming_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "crawl_pages", "page_id", "host", "title", "content").toDF("rec_id", "host", "title", "text")
    docs = table(spark, folder, "index_docs", "index_id", "host", "title", "contents").toDF("rec_id", "host", "title", "text")
    lines = boilerplate.site_lines(pages.select("host", "text"))
    found = [boilerplate.other_line_rows(df, kind, lines).select(F.lit(src).alias("src"), "rec_id", "line_no") for df, kind, src in ((pages, "page", "page"), (docs, "text", "index"))]
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.page_elements(table(spark, folder, "crawl_pages", "page_id", "content").toDF("page_id", "text"))


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    return clean_text.clean_texts(table(spark, folder, "crawl_pages", "page_id", "content").toDF("page_id", "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    links, seeds = table(spark, folder, "page_links", "link_id", "unique_url"), table(spark, folder, "seed_urls", "unique_url")
    return ledger.seen_keys(links, seeds, "unique_url", "link_id").select(F.col("at").alias("link_id"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often the answers of p6_found are wrong."""
    links, seeds = table(spark, folder, "page_links", "link_id", "unique_url"), table(spark, folder, "seed_urls", "unique_url")
    return ledger.wrong_answers(ledger.seen_keys(links, seeds, "unique_url", "link_id"), links, seeds, "unique_url")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encoded(table(spark, folder, "documents", "doc_id", "text"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mixed(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p9_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What the mixture promises of each target: the cap is kept, and the share is met among the sources that have documents."""
    mixture_, shares = _mixed(spark, folder)
    able = shares.agg(F.sum(F.when(F.col("documents") > 0, F.col("target_share")))).first()[0] or 1.0
    # rounding leaves each source off by less than a document
    one = mixture_.agg(F.max("tokens") / F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0.0
    met = F.when(F.col("documents") > 0, F.abs(F.col("actual_share") - F.col("target_share") / able) <= 2 * one).otherwise(F.col("actual_share") == 0)
    return shares.select("source", "target_share", "max_repeats", "documents", (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"), met.alias("share_met"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.look_alikes(table(spark, folder, "documents", "doc_id", "text"))


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "form")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_text": p5_text,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p8_ids": p8_ids,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_bounds": p9_bounds,
    "p10_found": p10_found,
    "p10_forms": p10_forms,
}

_RUNS = """
    SELECT id, list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' '))) AS s
    FROM (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM ({}) d) x WHERE len(t) >= 4"""

_P1 = f"""
WITH sets AS (SELECT x.id, u.unique_url, s FROM ({_RUNS.format("SELECT DISTINCT page_id AS id, content FROM crawl_pages")}) x JOIN (SELECT DISTINCT page_id AS id, unique_url FROM crawl_pages) u USING (id)),
runs AS (SELECT id, unique_url, len(s) AS n, hash(unnest(s)) AS h FROM sets),
df AS (SELECT h, count(*) AS c FROM runs GROUP BY h),
ranked AS (SELECT id, unique_url, n, h, row_number() OVER (PARTITION BY id ORDER BY c, h) AS place FROM runs JOIN df USING (h)),
heads AS (SELECT * FROM ranked WHERE place <= n - ceil(0.7 * n - 1e-9) + 1),
maybe AS (SELECT DISTINCT a.id AS a, b.id AS b FROM heads a JOIN heads b ON a.h = b.h AND a.id < b.id),
pairs AS (
  SELECT m.a, m.b, x.unique_url AS ua, y.unique_url AS ub FROM maybe m JOIN sets x ON x.id = m.a JOIN sets y ON y.id = m.b
  WHERE len(list_intersect(x.s, y.s)) >= 0.7 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) - 1e-9
)"""

_P2 = r"""
WITH f AS (SELECT 'contents' AS field, contents AS x, row_number() OVER () AS r FROM index_docs UNION ALL SELECT 'title', title, row_number() OVER () FROM index_docs),
w AS (SELECT field, r, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS term FROM f WHERE x IS NOT NULL),
t AS (SELECT field, count(*) AS total FROM f WHERE x IS NOT NULL GROUP BY field),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT r) AS records FROM w GROUP BY field, term),
m AS (SELECT c.*, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.4 * total THEN 'common' END AS mark FROM c JOIN t USING (field))
"""

_P3 = rf"""
WITH rows_ AS (SELECT -page_id AS id, -1 AS came, content FROM crawl_pages UNION ALL SELECT incoming_id, incoming_id, content FROM page_batches),
sets AS (SELECT x.id, r.came, s FROM ({_RUNS.format("SELECT DISTINCT id, content FROM rows_")}) x JOIN (SELECT DISTINCT id, came FROM rows_) r USING (id)),
runs AS (SELECT id, came, len(s) AS n, hash(unnest(s)) AS h FROM sets),
df AS (SELECT h, count(*) AS c FROM runs GROUP BY h),
ranked AS (SELECT id, came, n, h, row_number() OVER (PARTITION BY id ORDER BY c, h) AS place FROM runs JOIN df USING (h)),
heads AS (SELECT * FROM ranked WHERE place <= n - ceil(0.7 * n - 1e-9) + 1),
maybe AS (SELECT DISTINCT a.id AS a, b.id AS b FROM heads a JOIN heads b ON a.h = b.h AND a.came < b.came WHERE b.came > 0),
like_ AS (
  SELECT DISTINCT m.b AS id FROM maybe m JOIN sets x ON x.id = m.a JOIN sets y ON y.id = m.b
  WHERE len(list_intersect(x.s, y.s)) >= 0.7 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) - 1e-9
), u AS (SELECT -1 AS came, 0 AS id, abs_url, 'x' AS content FROM crawl_pages UNION ALL SELECT incoming_id, incoming_id, abs_url, content FROM page_batches),
cut AS (SELECT *, regexp_replace(regexp_replace(abs_url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u WHERE abs_url IS NOT NULL),
adr AS (SELECT came, id, content, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':80$', '') || substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) AS address FROM cut)
SELECT id AS incoming_id FROM like_
UNION SELECT a.id FROM adr a WHERE a.came > 0 AND (a.content IS NULL OR a.content = '') AND EXISTS (SELECT 1 FROM adr b WHERE b.address = a.address AND b.came < a.came)"""



def _form(x: str) -> str:
    """SQL of the canonical form for what texts of one look differ in: single characters by a rule, ligatures, invisible ones, blanks, accents."""
    single, several = {}, []
    for latin, twins in canonical.LOOK_ALIKE.items():
        single |= dict.fromkeys(twins, latin)
    for c in range(0x80, 0x1FFFF):
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if kind[:1] == "<" and kind not in canonical.VISIBLE_KINDS and c != 0x017F and unicodedata.category(chr(c)) != "Zs" and not 0xD800 <= c < 0xE000:
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1:
                single[chr(c)] = single.get(plain, plain)
            elif 0xFB00 <= c <= 0xFB06 or c in (0x2026, 0x2025, 0x01C6, 0x0133):
                several.append((chr(c), plain))
    out = f"regexp_replace({x}, '[\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{180B}}-\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    out = f"regexp_replace({out}, '[\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    for ligature, letters in several:
        out = f"replace({out}, '{ligature}', '{letters}')"
    return f"nfc_normalize(translate(nfc_normalize({out}), '{''.join(single)}', '{''.join(single.values()).replace(chr(39), chr(39) * 2)}'))"


ORACLE: dict[str, str] = {
    "p10_found": rf"""
        WITH f AS MATERIALIZED (SELECT doc_id, text, {_form("text")} AS form FROM documents WHERE text IS NOT NULL)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id WHERE trim(regexp_replace(a.form, '\s', ' ', 'g')) <> ''""",
    "p2_found": _P2 + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _P2 + "SELECT field, term, occurrences, records, mark FROM m",
    "p1_found": _P1 + "SELECT a AS page_id_a, b AS page_id_b FROM pairs WHERE ua IS DISTINCT FROM ub",
    "p1_groups": _P1.replace("WITH sets", "WITH RECURSIVE sets") + """
        , links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT id, id FROM sets),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT a AS page_id, min(b) AS group_id FROM reach GROUP BY a UNION ALL SELECT DISTINCT page_id, page_id FROM crawl_pages WHERE page_id NOT IN (SELECT id FROM sets)""",
    "p3_found": _P3,
    "p9_bounds": """
        SELECT lower(trim(t.source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats, coalesce(any_value(n), 0) AS documents, true AS cap_kept, true AS share_met
        FROM mix_targets t LEFT JOIN (SELECT lower(trim(source)) AS s, count(*) AS n FROM documents GROUP BY 1) d ON s = lower(trim(t.source)) GROUP BY 1""",
    "p6_found": """
        SELECT link_id FROM (SELECT link_id, unique_url, min(link_id) OVER (PARTITION BY unique_url) AS first_at FROM page_links WHERE unique_url IS NOT NULL) x
        WHERE link_id > first_at OR unique_url IN (SELECT unique_url FROM seed_urls WHERE unique_url IS NOT NULL)""",
    "p6_report": """
        SELECT count(*) AS asked, count_if(link_id > first_at OR unique_url IN (SELECT unique_url FROM seed_urls WHERE unique_url IS NOT NULL)) AS seen, 0 AS wrong, 0.0 AS wrong_rate
        FROM (SELECT link_id, unique_url, min(link_id) OVER (PARTITION BY unique_url) AS first_at FROM page_links WHERE unique_url IS NOT NULL) x""",
}
