"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import save


def _key(line: Column) -> Column:
    """128 bits of a line, as text, whose arrays Spark intersects by hashing."""
    return F.md5(line)


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(host, keys): the keys of the lines on more than `ratio` of a host's pages and on at least min_pages of them.

    A page counts once for each different line it holds. The keys of one host number at most the mean lines of
    its pages divided by ratio, whatever the number of pages, so collecting them is bounded.
    """
    own = pages.select(F.col(host_col).alias("host"), _lines(text_col).alias("lines"))
    totals = save(own.groupBy("host").agg(F.count("*").alias("pages")), "totals")
    counts = (
        own.select("host", F.explode(F.array_distinct("lines")).alias("line")).filter(F.trim("line") != "")
        .groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
        .select(F.col("host").alias("h"), "key", "n")
    )
    common = counts.join(totals, F.col("h").eqNullSafe(F.col("host"))).filter(F.col("n") > ratio * F.col("pages"))
    return save(common.groupBy("host").agg(F.collect_list("key").alias("keys")), "boilerplate")


def line_dedup(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5,
    kept_col: str = "kept_text", lines_col: str | None = "n_lines", dropped_col: str | None = "n_dropped",
) -> DataFrame:
    """pages with the text that remains, its number of lines before, and how many of them were dropped.

    A line is what stands between line feeds, compared exactly; lines of spaces are never dropped. Every copy
    of a boilerplate line goes, on each page of the host where it is frequent, and nowhere else. A null host is a host
    of its own; a null text is one empty line and comes back empty; repeated rows are pages of their own. Columns of
    pages keep their names, and those named like an output column are replaced; None leaves a count out.
    """
    known = boilerplate(pages, host_col, text_col, ratio, min_pages).select(F.col("host").alias("known_host"), F.col("keys").alias("known"))
    lines = _lines("page_text")
    own = pages.select(F.col(host_col).alias("page_host"), F.col(text_col).alias("page_text"), F.struct(*[F.col(c) for c in pages.columns]).alias("row"))
    found = own.join(known, F.col("page_host").eqNullSafe(F.col("known_host")), "left")
    # a page's own few boilerplate lines first, so that lines aren't compared with all of the host's
    both = F.struct(lines.alias("lines"), F.coalesce(F.array_intersect(F.transform(lines, _key), "known"), F.array().cast("array<string>")).alias("common"))
    # an array of one, so that what is common is found once a page and not once a line
    kept = F.transform(F.array(both), lambda x: F.filter(x["lines"], lambda line: ~F.array_contains(x["common"], _key(line))))[0]
    found = found.select("row", F.size(lines).alias("n"), kept.alias("kept"))
    new = {lines_col: F.col("n"), dropped_col: F.col("n") - F.size("kept"), kept_col: F.array_join("kept", "\n")}
    new.pop(None, None)
    return found.select(*[new.pop(c).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in pages.columns], *[x.alias(c) for c, x in new.items()])


ORACLE = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
common AS (
  SELECT l.source, l.line FROM (SELECT DISTINCT doc_id, source, line FROM lines WHERE trim(line, ' ') <> '') l
  JOIN totals t ON t.source = l.source GROUP BY l.source, l.line, t.pages HAVING count(*) >= 5 AND count(*) > 0.1 * t.pages
), marked AS (
  SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON c.source = l.source AND c.line = l.line
)
SELECT doc_id, source, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, source
"""
