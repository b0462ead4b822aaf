"""Line dedup by site-relative frequency.

For every host, the share of its pages that hold a line is the number of pages
with that line over the host's page total; lines above a ratio are boilerplate
of that site and are dropped from its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import broadcast_if_small, table, written

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.1
#: ... if it is on this many pages at least.
MIN_PAGES = 3
#: Parts into which a host's pages are dealt when the line list is too large to broadcast.
SALT = 64

#: Where a page's markup ends a line, and what is taken out of lines (fixed values shared with the SQL).
BREAKS = ("(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title.*?</title>|"
          "</?(?:p|div|li|ul|ol|nav|h[1-6]|br|article|footer|header|section|table|tr|td|th|head|body|html|meta)(?: [^>]*)?>|<!doctype[^>]*>|\n")
INLINE = "<[^>]*>"


def split_lines(text: Column, breaks: str = "\n", inline: str | None = None) -> Column:
    """The lines of a text; with ``inline``, what it matches is taken out of them."""
    lines = F.split(text, breaks, -1)
    return F.transform(lines, lambda x: F.regexp_replace(x, inline, "")) if inline else lines


def _key(line: Column) -> Column:
    """96 bits that stand for a trimmed line; null for a blank one."""
    t = F.trim(line)
    return F.when(F.length(t) > 0, F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b")))


def content(lines: Column) -> Column:
    """A page identity by content: equal pages of a host count as one page."""
    return F.md5(F.concat_ws("\n", lines))


def line_frequency(pages: DataFrame, host: Column, lines: Column, page: Column | None = None) -> DataFrame:
    """host, line key, pages with the line, pages of the host.  ``page`` tells pages
    apart: rows of one host with one value of it (null included) are one page, without
    it every row is a page.  A null text is no page of its host."""
    # a struct, as count_distinct passes over plain nulls
    one = F.struct(F.lit(0) if page is None else page)
    p = pages.select(host.alias("host"), one.alias("page"), lines.alias("lines"))
    n_pages = F.count(F.lit(1)) if page is None else F.count_distinct("page")
    # every page also holds the null line, which so counts the host's pages
    keys = F.concat(F.filter(F.array_distinct(F.transform("lines", _key)), lambda k: k.isNotNull()),
                    F.array(F.lit(None).cast("struct<a:bigint,b:int>")))
    each = p.select("host", "page", F.explode(keys).alias("line"))
    held = written(each.groupBy("host", "line").agg(n_pages.alias("holding"))
                   .where(F.col("line").isNull() | (F.col("holding") >= MIN_PAGES)))
    total = held.where(F.col("line").isNull()).select(F.col("host").alias("__h"), F.col("holding").alias("pages"))
    total = broadcast_if_small(total, 128)
    return held.where(F.col("line").isNotNull()).join(total, F.col("host").eqNullSafe(F.col("__h"))) \
        .select("host", "line", "holding", "pages")


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, out: str = "text",
                     ratio: float = RATIO, page: Column | None = None) -> DataFrame:
    """``pages`` with ``out``: its lines without those on more than ``ratio`` of its
    host's pages (MIN_PAGES at least), joined by newlines, plus ``n_lines`` and
    ``n_dropped`` (columns of these names are replaced).

    Lines compare trimmed of spaces; blank lines stay and count nowhere.  ``page`` tells
    pages apart as in ``line_frequency``: give the page id where rows may repeat, or
    ``content(lines)`` where a group of copies shouldn't be taken for boilerplate.  A null
    text stays null and is no page of its host; null hosts form one host; repeated rows
    get the same result; empty tables give an empty result.

    Counts are pre-aggregated; a host has at most (its mean lines per page) /
    ``ratio`` dropped lines, and they reach its pages as one array: broadcast if
    the whole list is small, else joined on (host, salt), so one host's pages
    stay spread over tasks.
    """
    bad = line_frequency(pages, host, lines, page).where(F.col("holding") > ratio * F.col("pages"))
    bad = written(bad.groupBy("host").agg(F.collect_set("line").alias("__bad")))
    hinted = broadcast_if_small(bad, F.size("__bad") * 16 + 64)
    rest = [c for c in pages.columns if c not in (out, "n_lines", "n_dropped")]
    src = pages.select(F.struct(*rest).alias("__row"), lines.alias("__lines"), host.alias("__host"))
    if hinted is bad:
        src = src.withColumn("__salt", F.pmod(F.xxhash64("__lines"), F.lit(SALT)).cast("int"))
        hinted = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on = src["__host"].eqNullSafe(hinted["host"]) & (src["__salt"] == hinted["__salt"])
    else:
        on = src["__host"].eqNullSafe(hinted["host"])
    bad_lines = F.coalesce("__bad", F.array().cast("array<struct<a:bigint,b:int>>"))
    got = src.join(hinted, on, "left").withColumn(
        "__kept", F.filter("__lines", lambda x: _key(x).isNull() | ~F.array_contains(bad_lines, _key(x))))
    return got.select(
        "__row.*", F.when(F.col("__lines").isNotNull(), F.array_join("__kept", "\n")).alias(out),
        F.greatest(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped"))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null without one."""
    h = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(h) > 0, h)


OP5_SQL = f"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  list_transform(regexp_split_to_array(html, '{BREAKS}'), lambda x: regexp_replace(x, '{INLINE}', '', 'g')) AS lines FROM pages),
c AS (SELECT host, {{'id': page_id}} AS page, lines FROM p WHERE lines IS NOT NULL),
total AS (SELECT host, count(DISTINCT page) AS pages FROM c GROUP BY host),
held AS (SELECT host, line, count(DISTINCT page) AS holding FROM (SELECT host, page, trim(unnest(lines)) AS line FROM c) WHERE line <> '' GROUP BY host, line),
bad AS (SELECT h.host, list(h.line) AS bad FROM held h JOIN total t ON h.host IS NOT DISTINCT FROM t.host
  WHERE holding >= {MIN_PAGES} AND holding > {RATIO} * pages GROUP BY h.host),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), trim(x))) AS kept
  FROM p LEFT JOIN bad b ON p.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped FROM k
"""


@query("op5_line_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines that more than RATIO of their host's pages hold, of lines on
    MIN_PAGES pages or more.  Pages are told apart by page_id, whatever they hold."""
    pages = table(spark, sf_dir, "pages")
    lines = split_lines(F.col("html"), BREAKS, INLINE)
    return drop_boilerplate(pages.select("page_id", "html", host_of(F.col("url")).alias("host")),
                            F.col("host"), lines, page=F.col("page_id")).select("page_id", "host", "text", "n_lines", "n_dropped")
