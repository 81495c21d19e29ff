"""Line deduplication by distinct-site spread, in native columns only.

Every non-blank line (outer white space off) is hashed; HyperLogLog sketches
of the sites per line hash are merged by aggregation and estimate on how many
sites the line stands.  Lines estimated within ``BAND`` of the threshold get an
exact distinct count.  Lines on at least ``MIN_SITES`` sites are boilerplate
and leave every document; other lines stay in place.

Defined results: null text stays null with 0 lines; blank lines are never
removed; a null site counts as one more site; a line repeated within one site
counts once; rows equal in doc_id and text get the same result; a text of any length is
read whole; columns of any name pass through, but for n_lines and n_removed,
which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed

MIN_SITES = 8
BAND = 0.25
BLANKS = " \t\n\x0b\x0c\r"
SKETCH_BITS = 12  # relative standard error 1.3 %, far inside the band


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    """MD5 bytes of the stripped line; null for a blank one."""
    plain = F.btrim(line, F.lit(BLANKS))
    return F.when(plain != "", F.unhex(F.md5(plain)))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(__id, __h, site, line) of every non-blank line, landed once."""
    site = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("site")
    hashes = F.filter(F.transform(lines_of(F.col("text")), line_hash), lambda h: h.isNotNull())
    return landed(docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), site,
                              F.explode(hashes).alias("line")), "lines")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(line, sites) of lines on at least ``min_sites`` sites; exact near the threshold."""
    spread = landed(lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - band)), "line-spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("line")
    exact = (lines.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count("one").alias("sites")))
    return landed(spread.where(F.col("sites") > min_sites * (1 + band)).select("line", "sites")
                  .unionByName(exact.where(F.col("sites") >= min_sites)), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """Columns of ``docs`` with cleaned text, plus n_lines and n_removed."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = hashed_lines(docs)
    bad = boilerplate(lines, min_sites, band).select("line")
    found = (lines.join(bad, "line", "left_semi")
             .groupBy("__id", "__h").agg(F.collect_set("line").alias("__bad")))
    # The row stays whole in one struct, so that no column of it clashes with the joined ones.
    base = docs.select(F.struct(*keep).alias("row"))
    found = found.select(F.col("__id").alias("f_id"), F.col("__h").alias("f_h"), F.col("__bad").alias("bad"))
    text = F.col("row")["text"]
    joined = base.join(found, F.col("row")["doc_id"].eqNullSafe(F.col("f_id")) & (F.xxhash64(text) == F.col("f_h")), "left")
    kept = F.when(F.col("bad").isNull(), lines_of(text)).otherwise(
        F.filter(lines_of(text), lambda x: ~F.coalesce(F.array_contains(F.col("bad"), line_hash(x)), F.lit(False))))
    counted = joined.select("row", kept.alias("kept"))
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines_of(text))).cast("long")
    n_kept = F.when(text.isNull(), F.lit(0)).otherwise(F.size("kept")).cast("long")
    cleaned = F.when(text.isNotNull(), F.concat_ws("\n", "kept"))
    return counted.select(*[(cleaned if c == "text" else F.col("row")[c]).alias(c) for c in keep],
                          n.alias("n_lines"), (n - n_kept).alias("n_removed"))
