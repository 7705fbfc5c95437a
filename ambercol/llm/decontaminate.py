"""Benchmark decontamination with DataFrame functions only.

The n-grams of the benchmark's items, normalised, are broadcast under the hashes of shorter grams within them; the token windows
of every document are probed, each hash hit is verified word by word, and documents or the words within occurrences are removed.
A window of ten words holds, wherever it begins, one whole gram of six words that begins at a multiple of five. So only every
fifth position is hashed and no occurrence is missed; shorter windows are treated alike. The broadcast is bounded: beyond
``most_broadcast`` bytes, the n-grams are dealt by hash into parts below that bound, and the corpus is scanned once for each part.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, unused

#: What stands between words: ASCII characters that are neither letters nor digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in their own case; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def folded(own: Column) -> Column:
    """Words in lower case, non-ASCII ones too: equal wherever the ASCII-lowered words are, and cheap over whole texts."""
    return F.split(F.lower(F.array_join(own, " ")), " ")


def grams(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: len, gram, items (ids of the items that hold it). Items with a null id or without words have none."""
    own = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("own")).filter(F.size("own") > 0)
    at = own.withColumn("len", F.least(F.size("own"), F.lit(n))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("own") - F.col("len"))))
    window = at.select("item", "len", ascii_lower(F.array_join(F.slice("own", F.col("pos") + 1, F.col("len")), " ")).alias("gram"))
    return window.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))


def stride(length: int) -> tuple[int, int]:
    """(step, words) such that a window of a length holds, wherever it begins, one whole gram of that many words at a multiple of step."""
    step = -(-length // 2)
    return step, length - step + 1


def occurrences(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_broadcast: int = 100_000_000) -> DataFrame:
    """Verified occurrences: doc_id, text_hash, pos (first word), len, items (ids); none for null or empty texts or without items.

    The words of a document ride along by reference within one stage; only hits leave it.
    """
    found = grams(items, n, item_id, item_text)
    sizes = found.groupBy("len").agg(F.sum(F.octet_length("gram") + 16 * F.size("items") + 64).alias("bytes")).collect()  # at most n rows
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.select(id_col).dtypes)[id_col]}, text_hash long, pos int, len int, items array<{dict(items.select(item_id).dtypes)[item_id]}>")
    lengths = sorted(r["len"] for r in sizes)
    parts = -(-sum(r["bytes"] * stride(r["len"])[0] for r in sizes) // most_broadcast)

    def by_length(value) -> Column:
        """``value`` of the row's length, which is one of few."""
        out = F.lit(None)
        for k in lengths:
            out = F.when(F.col("len") == k, value(k)) if k == lengths[0] else out.when(F.col("len") == k, value(k))
        return out if len(lengths) > 1 else value(lengths[0])

    probe = lambda at: by_length(lambda k: F.xxhash64(F.slice("low", F.col(at) + 1, F.lit(stride(k)[1]))))
    keyed = found.withColumn("low", F.split(F.lower("gram"), " ")).withColumn("shift", F.explode(by_length(lambda k: F.sequence(F.lit(0), F.lit(stride(k)[0] - 1)))))
    keyed = keyed.select(probe("shift").alias("h"), "len", "shift", "gram", "items")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("own"))
    rows = rows.filter(F.size("own") >= lengths[0]).withColumn("low", folded(F.col("own")))
    if len(lengths) == 1:
        step, size = stride(lengths[0])
        rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("own") - size, F.lit(step)))).withColumn("len", F.lit(lengths[0]))
    else:
        none = F.expr("cast(array() as array<struct<at:int,len:int>>)")

        def places(k: int) -> Column:
            step, size = stride(k)
            at = F.transform(F.sequence(F.lit(0), F.size("own") - size, F.lit(step)), lambda x: F.struct(x.alias("at"), F.lit(k).alias("len")))
            return F.when(F.size("own") >= k, at).otherwise(none)

        each = [places(k) for k in lengths]
        rows = rows.withColumn("p", F.explode(F.concat(*each))).select("doc_id", "text_hash", "own", "low", "p.at", "p.len")
    rows = rows.withColumn("h", probe("at"))

    def hits(part: DataFrame) -> DataFrame:
        pos = F.col("at") - F.col("shift")
        same = ascii_lower(F.array_join(F.slice("own", F.greatest(pos, F.lit(0)) + 1, F.col("len")), " ")) == F.col("gram")
        return rows.join(F.broadcast(part), ["h", "len"]).filter((pos >= 0) & same).select("doc_id", "text_hash", pos.alias("pos"), "len", "items")

    if parts == 1:
        return hits(keyed)
    return reduce(DataFrame.unionByName, [hits(keyed.filter(F.pmod("h", F.lit(parts)) == k)) for k in range(parts)])


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_broadcast: int = 100_000_000) -> DataFrame:
    """For each document row: doc_id, text_hash, n_words, n_hit, items (sorted strings), spans (first word, end word).

    An item of fewer than ``n`` words but not none is one window. A null or empty text has no words and no hits, nor has any
    text if no item has words. Items with a null id are left out. Rows that repeat an id and text get equal results; rows that
    repeat an id with another text are told apart by the text's hash. An empty table gives no rows. Other columns are not read.
    """
    found = occurrences(docs, items, n, id_col, text_col, item_id, item_text, most_broadcast)
    each = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("pos", F.col("len")))).alias("windows"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # windows in order of start: one that begins within the last span makes it longer, another begins a span
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def grow(spans: Column, w: Column) -> Column:
        last, end = F.element_at(spans, -1), w.pos + w.len
        alone = F.array(F.struct(w.pos.alias("a"), end.alias("b")))
        longer = F.array(F.struct(last.a.alias("a"), F.greatest(last.b, end).alias("b")))
        joined = F.when(w.pos > last.b, F.concat(spans, alone)).otherwise(F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), longer))
        return F.when(F.size(spans) == 0, alone).otherwise(joined)

    spans = F.aggregate("windows", none, grow)
    each = each.select("doc_id", "text_hash", spans.alias("spans"), F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    each = each.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    # null ids are rows too, so the join is null-safe
    on = rows.doc_id.eqNullSafe(each.doc_id) & (rows.text_hash == each.text_hash)
    joined = rows.join(each, on, "left").select(rows.doc_id, rows.text_hash, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))
    return joined


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's result."""
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a verified occurrence, all columns as they are.

    Null and empty texts stay; nulls, repeated rows and empty tables are otherwise as in ``contamination``; columns of any other
    name are handed on.
    """
    i, h = unused(docs, "id", "hash")
    hit = occurrences(docs, items, n, id_col, text_col).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    hit = bounded(hit, "contaminated")
    return docs.join(hit, docs[id_col].eqNullSafe(hit[i]) & (F.xxhash64(docs[text_col]) == hit[h]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text: contaminated documents as their other words one space apart, all others as they are; cases as in ``contamination``."""
    each = contamination(docs, items, n, id_col, text_col).filter("n_hit > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans").dropDuplicates(["id", "hash"])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(each, rows.doc_id.eqNullSafe(each.id) & (F.xxhash64(rows.text) == each.hash), "left").withColumn("own", words(F.col("text")))
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s.b))
    ends = F.concat(F.transform("spans", lambda s: s.a), F.array(F.size("own")))
    rest = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(F.col("own"), a + 1, b - a)))
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(rest, " ")).alias("text"))
