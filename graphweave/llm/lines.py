"""Removal of boilerplate lines that spread over many sites, in Spark expressions only.

A line's spread is the number of distinct sites (`source`) it occurs on. A HyperLogLog sketch of the
sites per line hash is merged by aggregation, which bounds what is kept of a line that a third of all
documents carry. Where the estimate lies near the threshold, the line's distinct sites are counted
exactly. Lines spread over at least `min_sites` sites are boilerplate: their first occurrence
(smallest doc_id, then place) stays, all others go, so that no text is lost altogether.

Defined results: lines are what `\\n` separates, compared without the white space around them; blank
lines always stay; a null text is empty and a null source is a site of its own; rows with the same
doc_id are told apart by their text, and equal rows are one occurrence; a null doc_id is the smallest;
an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import SPACE, fenced, table, written

#: Sites from which a line counts as boilerplate.
MIN_SITES = 10
#: Log of the sketches' registers, and the relative error (three standard errors at 2**12) beyond which they are trusted.
LOG_REGISTERS, MARGIN = 12, 0.05
_NO_SITE = "\x00none"
_NO_ID = -(1 << 63)  # stands for a null doc_id


def _lines(docs: DataFrame) -> DataFrame:
    """key and tag (of the document), site, place and hash of each line that is not blank; written, as all that follows reads it again."""
    keys = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    d = fenced(docs, "key", "tag", F.coalesce("source", F.lit(_NO_SITE)).alias("site"), keys.alias("keys"))
    each = d.select("key", "tag", "site", F.posexplode("keys").alias("place", "line")).filter("line != ''")
    return written(each.select("key", "tag", "site", "place", F.xxhash64("line").alias("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line, n_sites (a sketch's estimate beyond the margin, else exact) and first occurrence of each line on at least `min_sites` sites.

    Sums, sketches and pairs of line and site are combined before they travel, and joins are between
    written tables, which can be split where one line is very common.
    """
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    spread = lines.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("estimate"),
        F.min(F.struct("key", "tag", "place")).alias("first"),
    )
    wide = written(spread.filter((F.col("n") >= min_sites) & (F.col("estimate") >= low)).select("line", "estimate", "first"))
    near = written(wide.filter(F.col("estimate") <= high).select("line"))
    sites = written(lines.join(near, "line", "left_semi").select("line", "site"))
    exact = sites.groupBy("line", "site").agg(F.lit(1)).groupBy("line").agg(F.count(F.lit(1)).alias("exact"))
    return wide.join(exact, "line", "left").select("line", F.coalesce("exact", "estimate").alias("n_sites"), "first").filter(F.col("n_sites") >= min_sites)


def removals(lines: DataFrame, found: DataFrame) -> DataFrame:
    """key, tag and the sorted places of the lines to remove, for documents that have any."""
    hits = lines.join(found.select("line", "first"), "line")
    gone = hits.filter(F.col("first") != F.struct("key", "tag", "place"))
    return gone.groupBy("key", "tag").agg(F.sort_array(F.collect_set("place")).alias("places"))


#: The lines between the places to remove; one slice for each stretch keeps the work linear in the lines.
_STAYING = (
    "transform(array(concat(array(-1), places, array(size(lines)))), b -> flatten(transform(sequence(0, size(b) - 2),"
    " j -> slice(lines, b[j] + 2, b[j + 1] - b[j] - 1))))[0]"
)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """row (the document as it was), doc_id, n_lines, n_removed and the cleaned text `kept_text` of each document.

    The lines' hashes and the list of boilerplate lines are written to the shared folder: both are small
    beside the texts, and a join of them can then be split where one line is very common.
    """
    text = F.coalesce("row.text", F.lit(""))
    named = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = named.select("row", "doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("tag"))
    lines = _lines(named.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("tag"), F.col("row.source").alias("source"), "text"))
    cut = d.join(removals(lines, written(boilerplate(lines, min_sites))), ["key", "tag"], "left")
    cut = fenced(cut, "row", "doc_id", "places", F.split(text, "\n").alias("lines"))
    staying = F.when(F.col("places").isNull(), text).otherwise(F.array_join(F.expr(_STAYING), "\n"))
    return cut.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), staying.alias("kept_text"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with cleaned texts, columns as they were; those of which nothing but white space is left, though something was removed, go."""
    done = dedup_lines(docs, min_sites).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(f"[^{SPACE}]"))
    out = [F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(out)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and the digest of what is left."""
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1) || 'none') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, site, unnest(lines) AS line, unnest(range(0, len(lines))) AS place FROM d),
k AS (SELECT *, regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS key FROM l),
wide AS (SELECT key, min((doc_id, place)) AS first FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT k.doc_id, k.place, k.line, wide.key IS NOT NULL AND wide.first <> (k.doc_id, k.place) AS gone FROM k LEFT JOIN wide USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
