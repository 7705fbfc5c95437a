"""Quality rules with DataFrame functions only: in-document rules, then cross-document line frequency.

Normalised lines are hashed and the distinct documents that hold each are counted for every host; a line above the host's limit is
removed from the host's documents, and a document of which too little is left is rejected. Exact copies of a text on a host count
as one document, so that a popular text does not turn its own lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, unused, written

SPACE = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\f\r"
WINDOW = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), SPACE, " "))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row; null text has none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "host", F.xxhash64("t").alias("text_hash"), F.col("t"), words(F.col("t")).alias("w"), lines(F.col("t")).alias("l"))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, WINDOW)))
    rows = rows.select(
        "doc_id", "host", "text_hash", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > WINDOW, windows).alias("h"),
    )
    # only a text with a repeated window has its windows sorted to find which; linear apart from that sort
    sorted_windows = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), sorted_windows)).drop("h")
    equal = lambda k: F.get(F.col("s"), k).x
    repeated = F.filter("s", lambda x, k: F.coalesce(x.x == F.when(k > 0, equal(k - 1)), F.lit(False)) | F.coalesce(x.x == equal(k + 1), F.lit(False)))
    rows = rows.withColumn("p", F.sort_array(F.transform(repeated, lambda x: x.i))).drop("s")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("p", start, lambda acc, i: F.struct((acc.n + WINDOW - F.greatest(F.lit(0), acc.end - i)).alias("n"), (i + WINDOW).alias("end")), lambda acc: acc.n)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per line with a word: doc_id, host, text_hash, pos, line (hash of the normalised line), words; none for null or empty texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "raw"))
    rows = rows.filter(F.btrim("raw", F.lit(_BLANK)) != "")
    return rows.select("doc_id", "host", "text_hash", "pos", F.xxhash64(normalised(F.col("raw"))).alias("line"), F.size(words(F.col("raw"))).cast("long").alias("words"))


def frequent_lines(docs: DataFrame, share: float = 0.03, least: int = 20, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """host, line, n_docs of lines above the host's limit: in over ``share`` of its distinct texts, and in ``least`` or more.

    A null host is a host of its own; null and empty texts have no lines but count as one text; an empty table gives no rows.
    """
    rows = line_rows(docs, id_col, text_col, host_col)
    counts = rows.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)
    hosts = docs.select(F.col(host_col).alias("h"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).distinct().groupBy("h").agg(F.count("*").alias("n"))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n_docs") > share * F.col("n")).select("host", "line", "n_docs")


def _judged(docs: DataFrame, share: float = 0.03, least: int = 20, depleted: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``quality`` with ``gone``: positions of the lines above the limit in the text, NULL where there is none."""
    # written, so that a filter on the result is not carried into the window expressions and evaluated for each window
    own = written(signals(docs, id_col, text_col, host_col), "signals")
    often = frequent_lines(docs, share, least, id_col, text_col, host_col).select(F.col("host").alias("h"), F.col("line").alias("x"))
    lost = line_rows(docs, id_col, text_col, host_col).join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("x")))
    lost = lost.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t")).agg(F.sort_array(F.collect_set(F.struct("pos", "words"))).alias("x"))
    lost = lost.select("d", "h", "t", F.aggregate("x", F.lit(0).cast("long"), lambda n, x: n + x.words).alias("n_removed"), F.col("x.pos").alias("gone"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h")) & (F.col("text_hash") == F.col("t"))
    out = own.join(lost, on, "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long"))).drop("d", "h", "t")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= depleted * F.col("n_words")))


def quality(docs: DataFrame, share: float = 0.03, least: int = 20, depleted: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The signals of each row, with n_removed (words of lines above the limit), base_failed and kept.

    A document is kept if it passes the in-document rules and at least ``depleted`` of its words are left once frequent lines are
    gone. A null or empty text has no words, and so is rejected. A null host is a host of its own. Rows that repeat an id and
    text on a host get equal results and count once. An empty table gives no rows. Other columns are not read.
    """
    return _judged(docs, share, least, depleted, id_col, text_col, host_col).drop("gone")


def _same(docs: DataFrame, found: DataFrame, names: list[str], columns: list[str]) -> Column:
    """Whether a document is that of a row of ``found``, whose columns ``names`` hold id, host and the text's hash."""
    id_col, host_col, text_col = columns
    own = (docs[id_col], docs[host_col], F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    return own[0].eqNullSafe(found[names[0]]) & own[1].eqNullSafe(found[names[1]]) & (own[2] == found[names[2]])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, all columns as they are.

    Nulls, repeated rows and empty tables are as in ``quality``; columns of any other name are handed on.
    """
    names = unused(docs, "id", "host", "hash")
    bad = quality(docs, id_col=id_col, text_col=text_col, host_col=host_col).filter("not kept")
    bad = bounded(bad.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "host", "text_hash"), names))).distinct(), "rejected")
    return docs.join(bad, _same(docs, bad, names, [id_col, host_col, text_col]), "left_anti")


def cleaned(docs: DataFrame, share: float = 0.03, least: int = 20, depleted: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that the rules keep, all columns, lines above their host's limit taken out of the text.

    Other lines stay as they are, blank ones too. ``chars_col``, if any, follows a text that changes. Nulls, repeated rows and
    empty tables are as in ``quality``; columns of any other name are handed on.
    """
    names = unused(docs, "id", "host", "hash", "kept", "gone")
    kept, gone = names[3:]
    found = _judged(docs, share, least, depleted, id_col, text_col, host_col).filter("not kept or gone is not null")
    found = found.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "host", "text_hash", "kept", "gone"), names))).distinct()
    found = bounded(found, "found", weight=f"greatest(size(`{gone}`), 1)")
    out = docs.join(found, _same(docs, found, names, [id_col, host_col, text_col]), "left").filter(F.coalesce(kept, F.lit(True)))
    rest = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    columns = {text_col: F.when(F.col(gone).isNull(), docs[text_col]).otherwise(rest)}
    if chars_col and chars_col in docs.columns:
        columns[chars_col] = F.when(F.col(gone).isNull(), docs[chars_col]).otherwise(F.char_length(rest).cast(docs.schema[chars_col].dataType))
    return out.select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))
