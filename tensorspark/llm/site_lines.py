"""Boilerplate lines by their frequency inside a site.

Pages are grouped by host.  A line is dropped from the pages of a host if more than a share
of the host's pages contain it.  A host has few such lines (at most the mean number of
lines of its pages over that share), so they travel to the pages, not the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import BROADCAST_BYTES, through_files

#: A line on more than this percentage of a host's pages is boilerplate ...
PERCENT = 30
#: ... if more than one page has it.
PAGES = 2

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty for null or anything else."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """Lines of a page: its text between tags, trimmed, without empty lines."""
    parts = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", "\n"), "\n", -1)
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line), F.xxhash64(line, F.lit("second")))


def drop_site_lines(
    pages: DataFrame, site: Column, lines: Column, percent: int = PERCENT, least: int = PAGES
) -> DataFrame:
    """page_id, site, n_lines, n_dropped, text (the lines that stay) for each row of ``pages``.

    A row counts as one page, also one repeated or without page_id; a line counts once for
    each page.  A page without lines has empty text and counts for its site.  A page without
    site (null or empty) is a site of its own and keeps its lines.  Other columns are
    ignored; an empty table gives no rows.  Lines are told apart by 128-bit hashes.
    """
    base = pages.select(pages["page_id"].alias("page_id"), site.alias("site"), lines.alias("lines"))
    marks = F.explode(F.transform(F.array_distinct("lines"), _mark)).alias("mark")
    own = base.where(F.col("site") != "")
    on_pages = own.select("site", marks).groupBy("site", "mark").agg(F.count(F.lit(1)).alias("n"))
    totals = own.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    common = on_pages.where(F.col("n") >= least).join(totals, "site")
    common = common.where(F.col("n") * 100 > F.col("pages") * percent)
    dropped = common.groupBy("site").agg(F.collect_list("mark").alias("marks"))
    dropped = through_files(dropped, "site-lines")
    bytes_ = dropped.agg(F.sum(64 + 40 * F.size("marks"))).first()[0] or 0
    joined = base.join(F.broadcast(dropped) if bytes_ <= BROADCAST_BYTES else dropped, "site", "left")
    kept = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("marks"), _mark(x)))
    )
    return joined.select("page_id", "site", F.size("lines").alias("n"), kept.alias("kept")).select(
        "page_id",
        "site",
        F.col("n").cast("long").alias("n_lines"),
        (F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: text of all pages without the boilerplate of their hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return drop_site_lines(pages, host(pages["url"]), html_lines(pages["html"]))


SQL = f"""
WITH base AS (
    SELECT row_number() OVER () AS page, page_id,
           lower(coalesce(regexp_extract(url, '{_HOST}', 1), '')) AS site,
           list_filter(list_transform(
               string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)),
               lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines
    FROM pages
), found AS (
    SELECT page, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM base
), common AS (
    SELECT site, line
    FROM (SELECT site, line, count(DISTINCT page) AS n FROM found WHERE site <> '' GROUP BY ALL)
    JOIN (SELECT site, count(*) AS pages FROM base GROUP BY ALL) USING (site)
    WHERE n >= {PAGES} AND n * 100 > pages * {PERCENT}
), kept AS (
    SELECT page, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS text
    FROM found ANTI JOIN common USING (site, line) GROUP BY page
)
SELECT page_id, site, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, coalesce(text, '') AS text
FROM base LEFT JOIN kept USING (page)
"""
