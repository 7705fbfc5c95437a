"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites that hold a line is kept for each line hash and merged by aggregation, straight from the lines.
Lines whose estimate is within ``band`` of the threshold, and only those, get an exact count of distinct sites. Lines on enough
sites are boilerplate and go, whatever stands around them: menus, banners, footers, all lines of a block.

Copies of a document spread its lines over sites too. So a text counts on one site, drawn by a hash of text and site, however
many sites hold it (the query's rule, which SQL says too). With ``near``, as in the pipeline, all texts that near-dedup links
count on one site together, so that lines of near copies stay for near-dedup to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_dedup
from .common import bounded, unused, written

SPACE = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\f\r"


def normalised(line: Column) -> Column:
    """A line in lower case, white space as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(line), SPACE, " "))


def _text_key(text: Column) -> tuple[Column, Column]:
    """What tells texts apart in joins: hash and length."""
    return F.xxhash64(text), F.octet_length(text)


def line_rows(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """A row per line with a word: t, z (its text's hash and length), site (a hash, also of null), pos, line (hash of the normalised line).

    A null or empty text has no lines; rows that repeat give their lines again; an empty table gives no rows.
    """
    t, z = _text_key(F.col(text_col))
    rows = docs.select(t.alias("t"), z.alias("z"), F.xxhash64(site_col).alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "raw"))
    return rows.filter(F.btrim("raw", F.lit(_BLANK)) != "").select("t", "z", "site", "pos", F.xxhash64(normalised(F.col("raw"))).alias("line"))


def _counted_on(docs: DataFrame, near: bool, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """t, z, counts: the site on which a text counts, for texts that are, by themselves or with their class, on several sites."""
    t, z = _text_key(F.col(text_col))
    rows = docs.filter(F.col(text_col).isNotNull())
    draw = F.md5(F.concat(F.coalesce(F.col(site_col).cast("string"), F.lit("")), F.col(text_col)))
    rows = rows.select(t.alias("t"), z.alias("z"), F.xxhash64(site_col).alias("site"), draw.alias("draw"))
    if near:
        linked = near_dedup.labelled(docs, 5, 80, id_col, text_col).filter("n > 0 and id is not null").select(F.col("text_hash").alias("t"), F.col("component").alias("class")).distinct()
        # a text has one class, but for texts whose id stands on other texts too: the least
        linked = linked.groupBy("t").agg(F.min("class").alias("class"))
        linked = written(rows.groupBy("t", "z", "site").agg(F.min("draw").alias("draw")).join(linked, "t", "left"), "classes")
        own = linked.withColumn("class", F.coalesce("class", "t"))
        sites = own.groupBy("class").agg(F.min_by("site", F.xxhash64("class", "site")).alias("counts"), F.min("site").alias("a"), F.max("site").alias("b"))
        return own.join(sites.filter("a != b").select("class", "counts"), "class").select("t", "z", "counts").distinct()
    sites = rows.groupBy("t", "z").agg(F.min_by("site", "draw").alias("counts"), F.min("site").alias("a"), F.max("site").alias("b"))
    return sites.filter("a != b").select("t", "z", "counts")


def spread(lines: DataFrame, counted_on: DataFrame, min_sites: int = 10, band: float = 0.25, lg_k: int = 12) -> DataFrame:
    """Hashes of lines on ``min_sites`` sites or more: line, n_sites, exact (whether n_sites was counted, not estimated).

    ``lines`` as of ``line_rows``; a text in ``counted_on`` (t, z, counts) counts on that site. Without lines there are no rows.
    """
    places = lines.join(bounded(counted_on, "counted-on"), ["t", "z"], "left").select("line", F.coalesce("counts", "site").alias("site"))
    sketches = places.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"))
    found = written(sketches.filter(F.col("estimate") >= (1 - band) * min_sites), "spread")
    close = bounded(found.filter(F.col("estimate") <= (1 + band) * min_sites).select("line"), "close")
    exact = places.join(close, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n_exact"))
    found = found.join(exact, "line", "left").withColumn("n_sites", F.coalesce("n_exact", "estimate")).filter(F.col("n_sites") >= min_sites)
    return found.select("line", "n_sites", F.col("n_exact").isNotNull().alias("exact"))


def boilerplate(docs: DataFrame, near: bool = False, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id", **limits) -> DataFrame:
    """Hashes of boilerplate lines, as ``spread`` gives them. Ids are read only with ``near``; an empty table gives no rows."""
    lines = written(line_rows(docs, text_col, site_col), "lines")
    return spread(lines, _counted_on(docs, near, id_col, text_col, site_col), **limits)


def _marked(docs: DataFrame, id_col: str, text_col: str, site_col: str, near: bool, **limits) -> tuple[DataFrame, str]:
    """All rows and columns, and the name of one more: positions of the text's boilerplate lines, NULL where there is none."""
    t, z, gone = unused(docs, "t", "z", "gone")
    lines = written(line_rows(docs, text_col, site_col), "lines")
    bad = bounded(spread(lines, _counted_on(docs, near, id_col, text_col, site_col), **limits).select("line"), "boilerplate")
    hit = lines.join(bad, "line").groupBy(F.col("t").alias(t), F.col("z").alias(z)).agg(F.collect_set("pos").alias(gone))
    hit = bounded(hit, "gone", weight=f"size(`{gone}`)")
    own = _text_key(docs[text_col])
    return docs.join(hit, (own[0] == hit[t]) & (own[1] == hit[z]), "left").drop(t, z), gone


def _cleared(text_col: str, gone: str) -> Column:
    """The text without the lines at the positions in ``gone``."""
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    return F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", near: bool = False, **limits) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines (with a word), n_removed, for each row.

    Other lines stay as they are, blank ones too. A null text stays null and has no lines; a null site is a site of its own; rows
    that repeat a text get equal results; an empty table gives no rows. Other columns are not read.
    """
    rows, gone = _marked(docs.select(id_col, text_col, site_col), id_col, text_col, site_col, near, **limits)
    n_lines = F.size(F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != ""))
    return rows.select(
        F.col(id_col).alias("doc_id"), _cleared(text_col, gone).alias("text"), F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", chars_col: str | None = "n_chars", near: bool = True, **limits) -> DataFrame:
    """All rows, all columns, boilerplate lines taken out of the text; ``chars_col``, if any, follows a text that changes.

    Nulls, repeated rows and empty tables are as in ``dedup_lines``; columns of any other name are handed on.
    """
    out, gone = _marked(docs, id_col, text_col, site_col, near, **limits)
    columns = {text_col: _cleared(text_col, gone)}
    if chars_col and chars_col in docs.columns:
        columns[chars_col] = F.when(F.col(gone).isNull(), F.col(chars_col)).otherwise(F.char_length(_cleared(text_col, gone)).cast(docs.schema[chars_col].dataType))
    return out.select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))


def line_digests(docs: DataFrame) -> DataFrame:
    """For each document row: doc_id, n_lines, n_removed, text_sha256 of what is left (of nothing for a null text)."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
