"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by all pages of the
host; lines above a boilerplate ratio are dropped from that host's pages.
Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedshade.runtime import Scratch

#: A line on more than this share of a host's pages, and on at least so many pages, is boilerplate.
MAX_RATIO, MIN_PAGES = 0.1, 5


def _lines(text):
    return F.split(text, "\n", -1)


def frequent_lines(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, line_hash, n_pages, host_pages)`` of the boilerplate lines of each host.

    A host has at most its lines per page divided by ``max_ratio`` of them.
    Lines of white space only never count.
    """
    pages = docs.select(F.col(host).alias("host"), F.col("text"))
    hashes = F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(r"\S")), lambda x: F.xxhash64(x))
    counts = (
        pages.select("host", F.explode(F.array_distinct(hashes)).alias("line_hash"))
        .groupBy("host", "line_hash")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return (
        counts.join(totals, counts.host.eqNullSafe(totals.host))
        .filter(F.col("n_pages") > F.lit(float(max_ratio)) * F.col("host_pages"))
        .select(counts.host, "line_hash", "n_pages", "host_pages")
    )


def mark_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(row, lines, kept)``: each row as a struct, its lines, and those that are no boilerplate.

    Every row stays, even one whose lines are all boilerplate.  Null texts have
    null lines; null hosts are one host; each row counts as a page, repeated
    ones too; an empty table gives an empty one.
    """
    # Written first, so that its size is known when the join below is planned:
    # Spark broadcasts it under its threshold and shuffles beyond.
    frequent = Scratch(docs.sparkSession, "linededup").write(
        frequent_lines(docs, host, max_ratio, min_pages).groupBy("host").agg(F.collect_set("line_hash").alias("drop"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = _lines(F.col("row.text"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(x)))
    )
    joined = rows.join(frequent, F.col(f"row.`{host}`").eqNullSafe(F.col("host")), "left")
    return joined.select("row", "drop", lines.alias("lines")).select("row", "lines", kept.alias("kept"))


def drop_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns and rows, its texts without their boilerplate lines.

    A text of boilerplate only becomes empty; null texts stay null.
    """
    columns = [F.array_join("kept", "\n").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return mark_boilerplate(docs, **options).select(*columns)


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)``, digests of :func:`drop_boilerplate`; null text has no lines."""
    lines, kept = F.coalesce(F.array_size("lines"), F.lit(0)), F.coalesce(F.array_size("kept"), F.lit(0))
    return mark_boilerplate(docs, **options).select(
        "row.doc_id",
        lines.cast("long").alias("n_lines"),
        (lines - kept).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def oracle(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    return f"""
WITH page AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT DISTINCT r, source, unnest(lines) AS line FROM page),
total AS (SELECT source, count(*) AS host_pages FROM page GROUP BY source),
often AS (
  SELECT l.source, l.line FROM line l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE regexp_matches(l.line, '\\S')
  GROUP BY l.source, l.line, t.host_pages
  HAVING count(*) >= {min_pages} AND count(*) > CAST({max_ratio} AS DOUBLE) * t.host_pages),
host AS (SELECT source, list(line) AS often FROM often GROUP BY source),
kept AS (
  SELECT p.doc_id, p.text, p.lines,
         CASE WHEN h.often IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(h.often, x)) END AS kept
  FROM page p LEFT JOIN host h ON p.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(array_to_string(kept, chr(10))) END AS kept_sha256
FROM kept"""
