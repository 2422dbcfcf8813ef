"""Removal of lines that stand on many sites, by HyperLogLog sketches of their sites.

Each line hash carries a sketch of the sites it was seen on; sketches merge by
partial aggregation, so a line on every page is one small row per task. Lines whose
estimate is clear of the threshold are settled by it. Those within `errors`
standard errors are counted exactly, and only their rows take part in that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.store import written

KEY = ["h1", "h2"]


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def boilerplate(lines: DataFrame, min_sites: int, log_k: int = 10, errors: float = 3.0) -> DataFrame:
    """(h1, h2, first) of lines on at least `min_sites` sites; `lines` has h1, h2, site and at, of which `first` is the least.

    Sketches leave out empty strings, so they take the hash of a site.
    """
    band = errors * 1.04 / math.sqrt(1 << log_k)
    sketches = lines.groupBy(*KEY).agg(F.hll_sketch_agg(F.xxhash64("site"), log_k).alias("sketch"), F.min("at").alias("first"))
    judged = written(sketches.select(*KEY, "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band)), "lines")
    sure = judged.where(F.col("sites") > min_sites * (1 + band))
    unsure = judged.where(F.col("sites") <= min_sites * (1 + band)).select(*KEY, "first")
    pairs = lines.join(unsure.select(*KEY), KEY).groupBy(*KEY, "site").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy(*KEY).agg(F.count("one").alias("n")).where(F.col("n") >= min_sites)
    return sure.select(*KEY, "first").unionByName(unsure.join(counted.select(*KEY), KEY))


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept, n_lines, n_removed): the text without lines that at least `min_sites` sites have.

    Lines are parted by newlines and compared without blanks at their ends; blank lines stay. A line stays where it
    comes first, by doc_id, then by place, so a text that many sites copy is whole in one document. A null text counts as
    empty and has one blank line; a null site is a site of its own; rows without doc_id come last. Equal rows get equal
    results. Very long texts count whole. Other columns are ignored but for those named in `carry`; an empty table stays empty.
    """
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tag"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("_site"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    split = rows.select("_id", "_tag", "_site", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line")).where("trim(_line) <> ''")
    at = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("_tag").alias("tag"), F.col("_pos").alias("pos"))
    lines = split.select(*_hashes(F.trim("_line")), F.col("_site").alias("site"), at.alias("at"))
    common = boilerplate(lines, min_sites)
    again = lines.join(common, KEY).where("NOT (at <=> first)")
    removed = again.groupBy(F.col("at.id").alias("_id"), F.col("at.tag").alias("_tag")).agg(F.collect_set("at.pos").alias("_gone"))
    joined = rows.alias("r").join(removed.alias("g"), F.expr("r._id <=> g._id AND r._tag = g._tag"), "left")
    joined = joined.select("r._id", "r._text", "g._gone", *[F.col(f"r._carry_{c}") for c in carry])
    parts = F.split("_text", "\n", -1)
    kept = F.when(
        F.col("_gone").isNotNull(), F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    ).otherwise(F.col("_text"))
    return joined.select(
        F.col("_id").alias("doc_id"),
        kept.alias("kept"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


#: DuckDB twin of `without_boilerplate`: exact counts stand for the sketches.
SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS site FROM documents),
lines AS (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
full_lines AS (SELECT doc_id, site, pos, trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''),
common AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM full_lines GROUP BY line HAVING count(DISTINCT site) >= 10),
gone AS (SELECT doc_id, pos FROM full_lines JOIN common USING (line) WHERE struct_pack(d := doc_id, p := pos) <> first),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(*) AS n_lines, count(g.pos) AS n_removed
         FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM kept
"""
