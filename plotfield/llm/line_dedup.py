"""Line dedup by distinct-site spread.

A line that many different sites carry is boilerplate. A HyperLogLog sketch of the sites is built for every line that can
reach the limit; sketches merge by aggregation, so a line on a third of all rows costs one sketch a task. Lines whose
estimate is near the limit get an exact distinct count. Every occurrence but the first then goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, settle, small_side

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: Log2 of the sketch's size: a relative standard error of about 1.6 %.
SKETCH_BITS = 12
#: Estimates this far from the limit, relative and absolute, are counted exactly: over five standard errors.
NEAR, NEAR_SITES = 0.1, 2.0


def line_key(line: Column) -> Column:
    """128 bits that stand for a line without blanks at its ends."""
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary")))


def document_lines(df: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """(doc, site, at, line_key) of every line that has a character other than blanks; lines number from 0."""
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{site}`").alias("site"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("at", "line"))
    return rows.where(F.btrim("line", F.lit(BLANKS)) != "").select("doc", "site", "at", line_key(F.col("line")).alias("line_key"))


def widespread(occurrences: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys of lines on at least ``min_sites`` distinct sites: by sketch, and by exact count near the limit."""
    sketched = settle(occurrences.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
                      .select("line_key", F.hll_sketch_estimate("sketch").alias("sites")))
    margin = max(NEAR * min_sites, NEAR_SITES)
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= margin).select("line_key")
    exact = (occurrences.join(small_side(near), "line_key", "left_semi").select("line_key", "site").distinct()
             .groupBy("line_key").count().where(F.col("count") >= min_sites).select("line_key"))
    return sketched.where(F.col("sites") > min_sites + margin).select("line_key").unionAll(exact)


def boilerplate_lines(df: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc, at): the lines to remove. Every occurrence of a widespread line but the first by (doc, at).

    Cheap counts leave out first what cannot reach the limit: fewer rows than sites, or one site only.
    """
    lines = document_lines(df, key, site, text)
    possible = settle(lines.groupBy("line_key").agg(F.count("site").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
                      .where((F.col("n") >= min_sites) & ((F.col("low") < F.col("high")) | F.lit(min_sites <= 1))).select("line_key"))
    occurrences = settle(lines.join(small_side(possible), "line_key", "left_semi"))
    spread = small_side(settle(widespread(occurrences, min_sites)))
    first = settle(occurrences.join(spread, "line_key", "left_semi").groupBy("line_key").agg(F.min(F.struct("doc", "at")).alias("first")))
    return occurrences.join(small_side(first), "line_key").where(F.struct("doc", "at") != F.col("first")).select("doc", "at")


def line_dedup(df: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``df`` with ``text`` rid of boilerplate lines, and ``n_removed``, the number of lines taken out.

    A line counts without blanks at its ends; blank lines are never removed. A null site counts as no site. Rows with a
    null key or null text stay as they are. Keys must differ: rows that share one have their lines removed alike.
    A document left without any line has an empty text; all rows stay. An empty table gives an empty result; further
    columns are carried along, and one named ``n_removed`` is replaced.
    """
    gone = (boilerplate_lines(df.where(F.col(f"`{key}`").isNotNull()), key, site, text, min_sites)
            .groupBy("doc").agg(F.collect_set("at").alias("__gone")).withColumnRenamed("doc", "__doc"))
    # Removed lines grow with the texts, so they meet them by a shuffle at every size.
    joined = df.drop("n_removed").join(gone.hint("merge"), F.col(f"`{key}`") == F.col("__doc"), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return (joined.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
            .withColumn(text, F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept)).drop("__gone", "__doc"))


#: The same decisions over a table ``documents``, for comparison.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines
), spread AS (
  SELECT k, min((doc_id, pos)) AS first FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}
), judged AS (
  SELECT doc_id, pos, line, spread.k IS NOT NULL AND (doc_id, pos) <> first AS gone FROM keyed LEFT JOIN spread USING (k)
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed
FROM judged GROUP BY doc_id
"""
