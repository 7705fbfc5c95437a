"""One query per operator over the standard tables, each with SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import Expr
from .expr import col as c
from .functions import dates, numeric, text
from .operators import dictionaries as dic
from .operators import graph, grouping, indicators, joins, lanes, positional, random
from .plans.order import running
from .plans.scratch import scratch_path, written
from .sources import adapters, blocks
from .streaming import incremental
from .table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, nan: bool = False) -> DataFrame:
    """Doubles rounded as SQL does, so that the order of additions does not show; NaN as NULL, unless it is to stay."""
    keep = lambda n: F.lit(True) if nan else ~F.isnan(f"`{n}`")
    return df.select(*(F.when(keep(n), numeric.round_half_away(F.col(f"`{n}`"), digits)).alias(n) if k == "double" else F.col(f"`{n}`") for n, k in df.dtypes))


def lineitem(spark, d):
    return Table(t(spark, d, "lineitem")).query()


def events(spark, d):
    return Table(t(spark, d, "events"), "event_id").query()


# -- the flagship: filter, derive, group, sort, limit
def flagship(spark: SparkSession, d: str) -> DataFrame:
    q = lineitem(spark, d).filter(c("l_quantity") >= 10).derive("gross", c("l_extendedprice") * c("l_discount"))
    out = q.group("l_returnflag", {"gross": ("sum", "count", "mean", "min", "max")}).sort("gross.sum", desc=True).limit(2).compile().df
    return rounded(out.toDF("l_returnflag", "gross_sum", "gross_count", "gross_mean", "gross_min", "gross_max"), 2)


add("flagship", flagship, """
SELECT l_returnflag, round(sum(g), 2) AS gross_sum, count(g) AS gross_count, round(avg(g), 2) AS gross_mean, round(min(g), 2) AS gross_min, round(max(g), 2) AS gross_max
FROM (SELECT l_returnflag, l_extendedprice * l_discount AS g FROM lineitem WHERE l_quantity >= 10) GROUP BY l_returnflag ORDER BY sum(g) DESC LIMIT 2""")

# -- elementwise
KEY = "l_orderkey, l_linenumber, l_partkey, l_quantity"


def elementwise(e: Expr) -> Query:
    return lambda spark, d: lineitem(spark, d).derive("x", e).select(*KEY.split(", "), "x").compile().df


for name, e, sql in (
    ("map_add", c("l_quantity") + c("l_tax"), "l_quantity + l_tax"),
    ("map_sub", 100 - c("l_linenumber"), "100 - CAST(l_linenumber AS BIGINT)"),
    ("map_mul", c("l_extendedprice") * c("l_discount"), "l_extendedprice * l_discount"),
    ("map_div", c("l_extendedprice") / c("l_quantity"), "l_extendedprice / l_quantity"),
    ("map_pow", c("l_quantity") ** 2, "pow(l_quantity, 2)"),
    ("map_floordiv", (c("l_partkey") - 500) // 7, "CAST(floor((l_partkey - 500) / 7) AS BIGINT)"),
    ("map_mod", (c("l_partkey") - 500) % 7, "(l_partkey - 500) - 7 * CAST(floor((l_partkey - 500) / 7) AS BIGINT)"),
    ("fill_null", c("l_suppkey").fill_null(0), "coalesce(l_suppkey, 0)"),
    ("replace", c("l_linenumber").replace(1, 100), "CASE WHEN l_linenumber = 1 THEN 100 ELSE l_linenumber END"),
):
    add(name, elementwise(e), f"SELECT {KEY}, {sql} AS x FROM lineitem")

for name, e, sql in (
    ("cmp_eq", c("l_linenumber") == 3, "l_linenumber = 3"), ("cmp_ne", c("l_linenumber") != 3, "l_linenumber <> 3"), ("cmp_lt", c("l_quantity") < 10, "l_quantity < 10"), ("cmp_le", c("l_quantity") <= 10, "l_quantity <= 10"),
    ("cmp_gt", c("l_quantity") > 40, "l_quantity > 40"), ("cmp_ge", c("l_quantity") >= 40, "l_quantity >= 40"), ("mask_and", (c("l_quantity") > 10) & (c("l_discount") > 0.05), "l_quantity > 10 AND l_discount > 0.05"),
    ("mask_or", (c("l_quantity") > 45) | (c("l_discount") > 0.09), "l_quantity > 45 OR l_discount > 0.09"), ("mask_not", ~(c("l_returnflag") == "R"), "NOT l_returnflag = 'R'"), ("isin_text", c("l_returnflag").isin(["A", "N"]), "l_returnflag IN ('A', 'N')"),
    ("text_eq", c("l_linestatus").str_eq("F"), "l_linestatus = 'F'"), ("text_ne", c("l_linestatus") != "F", "l_linestatus <> 'F'"),
):
    add(name, (lambda e: lambda s, d: lineitem(s, d).filter(e).select(*KEY.split(", ")).compile().df)(e), f"SELECT {KEY} FROM lineitem WHERE {sql}")

for name, e, sql in (
    ("text_len", c("text").str_len(), "CAST(length(text) AS INTEGER)"), ("text_contains", c("text").str_contains("the "), "contains(text, 'the ')"), ("text_startswith", c("text").str_startswith("Th"), "starts_with(text, 'Th')"), ("text_endswith", c("text").str_endswith("."), "suffix(text, '.')"),
):
    add(name, (lambda e: lambda s, d: Table(t(s, d, "documents")).query().derive("x", e).select("doc_id", "x").compile().df)(e), f"SELECT doc_id, {sql} AS x FROM documents")


def nulled(spark, d):
    """Orders with the status 'P' and the priority '1-URGENT' as NULL, and the price of every seventh key."""
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), price.alias("price"), "o_custkey")


NULLED = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '1-URGENT') AS priority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, o_custkey FROM orders)"
add("filter_null_3vl", lambda s, d: Table(nulled(s, d)).query().filter((c("status") != "F") | (c("price") > 200000.0)).select("o_orderkey").compile().df, f"SELECT o_orderkey FROM {NULLED} WHERE status <> 'F' OR price > 200000.0")
add("is_null", lambda s, d: Table(nulled(s, d)).query().derive("x", c("status").is_null()).select("o_orderkey", "x").compile().df, f"SELECT o_orderkey, status IS NULL AS x FROM {NULLED}")
add("strict_logic", lambda s, d: nulled(s, d).select("o_orderkey", numeric.strict_or(F.col("status") == "F", F.col("price") > 1e5).alias("x"), numeric.strict_and(F.col("status") == "F", F.col("price") > 1e5).alias("y")),
    f"SELECT o_orderkey, CASE WHEN status IS NOT NULL AND price IS NOT NULL THEN status = 'F' OR price > 1e5 END AS x, CASE WHEN status IS NOT NULL AND price IS NOT NULL THEN status = 'F' AND price > 1e5 END AS y FROM {NULLED}")
add("where_case", lambda s, d: nulled(s, d).select("o_orderkey", numeric.where(F.col("price") > 1e5, F.lit("high"), F.col("status")).alias("x")), f"SELECT o_orderkey, CASE WHEN price > 1e5 THEN 'high' ELSE status END AS x FROM {NULLED}")
add("round_half_even", lambda s, d: t(s, d, "orders").select("o_orderkey", numeric.round_half_even(F.col("o_orderkey") / 2).alias("x")), "SELECT o_orderkey, round_even(o_orderkey / 2, 0) AS x FROM orders")
add("wrap_int32", lambda s, d: t(s, d, "orders").select("o_orderkey", numeric.wrap_int32(F.col("o_custkey") * 3_000_000).alias("x")), "SELECT o_orderkey, CAST(((o_custkey * 3000000 + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS x FROM orders")
add("regex_replace_first", lambda s, d: text.regex_replace_first(t(s, d, "pages").select("page_id", "url"), "url", r"/([a-z]+)/(\d+)", r"/\2/\1", "x").select("page_id", "x"), r"SELECT page_id, regexp_replace(url, '/([a-z]+)/(\d+)', '/\2/\1') AS x FROM pages")
add("pattern_encode", lambda s, d: t(s, d, "customer").select("c_custkey", text.encode_pattern(F.col("c_name"), "Customer#").alias("x")), "SELECT c_custkey, CAST(regexp_extract(c_name, '^Customer#(-?[0-9]+)$', 1) AS INTEGER) AS x FROM customer")
add("pattern_decode", lambda s, d: t(s, d, "customer").select("c_custkey", text.decode_pattern(text.encode_pattern(F.col("c_name"), "Customer#"), "C-", 6).alias("x")), "SELECT c_custkey, 'C-' || lpad(CAST(CAST(substr(c_name, 10) AS INTEGER) AS VARCHAR), CAST(greatest(6, length(CAST(CAST(substr(c_name, 10) AS INTEGER) AS VARCHAR))) AS INTEGER), '0') AS x FROM customer")
add("date_encode", lambda s, d: t(s, d, "orders").select("o_orderkey", dates.date_encode(F.col("o_orderdate")).alias("x")), "SELECT o_orderkey, CAST(epoch(o_orderdate) AS INTEGER) AS x FROM orders")
add("date_decode", lambda s, d: t(s, d, "orders").select("o_orderkey", dates.date_decode(dates.date_encode(F.col("o_orderdate"))).alias("x")), "SELECT o_orderkey, date_trunc('second', o_orderdate) AS x FROM orders")
for name, width in (("day_bucket", 86400), ("hour_bucket", 3600)):
    add(name, (lambda w: lambda s, d: t(s, d, "events").groupBy(dates.bucket(F.unix_seconds(F.col("ts").cast("timestamp")), w).alias("b")).agg(F.count("*").alias("n")))(width), f"SELECT CAST(floor(epoch(ts)) AS BIGINT) // {width} AS b, count(*) AS n FROM events GROUP BY 1")
add("scaled_int", lambda s, d: _scaled(t(s, d, "part")), "SELECT p_partkey, CAST(round_even((p_retailprice - 900) / 0.25, 0) AS INTEGER) AS code, round(round_even((p_retailprice - 900) / 0.25, 0) * 0.25 + 900, 4) AS x FROM part")


def _scaled(part: DataFrame) -> DataFrame:
    from .types import schema_transform, schema_untransform

    code = schema_transform(F.col("p_retailprice"), 0.25, 900.0)
    return rounded(part.select("p_partkey", code.alias("code"), schema_untransform(code, 0.25, 900.0).alias("x")))


# -- aggregates
for op, sql in (("sum", "sum(o_totalprice)"), ("count", "count(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), ("var", "var_pop(o_totalprice)"), ("std", "stddev_pop(o_totalprice)"), ("nunique", "count(DISTINCT o_totalprice)")):
    # a variance has too many digits for an absolute rounding
    digits = -4 if op == "var" else 2
    add(f"reduce_{op}", (lambda o, n: lambda s, d: rounded(t(s, d, "orders").agg(grouping.aggregate(o, "o_totalprice").alias("x")), n))(op, digits), f"SELECT {sql if op in ('count', 'nunique') else f'round({sql}, {digits})'} AS x FROM orders")
    add(f"group_{op}", (lambda o, n: lambda s, d: rounded(grouping.group(t(s, d, "orders"), "o_orderpriority", {"o_totalprice": o}, sep="_"), n))(op, digits), f"SELECT o_orderpriority, {sql if op in ('count', 'nunique') else f'round({sql}, {digits})'} AS o_totalprice_{op} FROM orders GROUP BY 1")
add("reduce_sample_std", lambda s, d: rounded(t(s, d, "orders").agg(grouping.aggregate("std", "o_totalprice", ddof=1).alias("x")), 2), "SELECT round(stddev_samp(o_totalprice), 2) AS x FROM orders")
add("group_null_keys", lambda s, d: rounded(grouping.group(nulled(s, d), "status", {"price": ("sum", "count")}, sep="_"), 2), f"SELECT status, round(sum(price), 2) AS price_sum, count(price) AS price_count FROM {NULLED} GROUP BY 1")
add("group_drop_null_measures", lambda s, d: rounded(grouping.group(nulled(s, d), "status", {"price": ("sum", "count")}, "drop", True, "_"), 2), f"SELECT status, round(sum(price), 2) AS price_sum, count(price) AS price_count FROM {NULLED} WHERE status IS NOT NULL AND price IS NOT NULL GROUP BY 1")
add("group_multi", lambda s, d: rounded(grouping.group(t(s, d, "lineitem"), "l_returnflag", {"l_quantity": ("sum", "mean"), "l_discount": ("min", "max")}, sep="_"), 2), "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 2) AS l_quantity_mean, min(l_discount) AS l_discount_min, max(l_discount) AS l_discount_max FROM lineitem GROUP BY 1")
add("group_composite", lambda s, d: rounded(grouping.group(t(s, d, "lineitem"), ["l_suppkey", "l_linenumber"], {"l_quantity": ("sum", "mean", "count", "min", "max")}, sep="_"), 2), "SELECT l_suppkey, l_linenumber, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 2) AS l_quantity_mean, count(l_quantity) AS l_quantity_count, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY ALL")
add("group_topk", lambda s, d: rounded(grouping.group_topk(t(s, d, "lineitem"), ["l_partkey", "l_linenumber"], {"l_quantity": ("sum", "count")}, "l_quantity_sum", 20, sep="_"), 2), "SELECT l_partkey, l_linenumber, round(sum(l_quantity), 2) AS l_quantity_sum, count(l_quantity) AS l_quantity_count FROM lineitem GROUP BY ALL ORDER BY l_quantity_sum DESC, l_partkey, l_linenumber LIMIT 20")
add("count_distinct_global", lambda s, d: t(s, d, "lineitem").agg(F.count_distinct("l_partkey").alias("n")), "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
add("unique", lambda s, d: grouping.unique(nulled(s, d), "status"), f"SELECT DISTINCT status FROM {NULLED} WHERE status IS NOT NULL")
add("unique_inverse", lambda s, d: grouping.unique_inverse(nulled(s, d), "priority").select("o_orderkey", "inv"), f"SELECT o_orderkey, CASE WHEN priority IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY priority NULLS LAST) - 1 END AS inv FROM {NULLED}")
add("pack_keys_pack", lambda s, d: t(s, d, "lineitem").groupBy(grouping.pack_keys(F.col("l_suppkey"), F.col("l_linenumber")).alias("k")).agg(F.count("*").alias("n")), "SELECT l_suppkey * 4294967296 + l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1")
add("pack_keys_radix", lambda s, d: t(s, d, "lineitem").groupBy(grouping.pack_keys(F.col("l_suppkey"), F.col("l_linenumber"), mode="radix", sizes=[1 << 20, 16]).alias("k")).agg(F.count("*").alias("n")), "SELECT l_suppkey * 16 + l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1")
SEGMENTS = "(SELECT CAST(s AS BIGINT) AS segment, CAST(s * 37 + s % 5 AS BIGINT) AS b, CAST(CASE WHEN s % 11 = 0 THEN s * 37 + s % 5 ELSE (s + 1) * 37 END AS BIGINT) AS e FROM (SELECT DISTINCT event_id // 37 AS s FROM events))"
for op in ("sum", "count", "min", "max"):

    def segmented(s, d, op=op):
        events = t(s, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("value"))
        own, begin = F.col("segment"), F.col("segment") * 37 + F.col("segment") % 5
        bounds = events.select(F.floor(F.col("pos") / 37).alias("segment")).distinct().select("segment", begin.alias("begin"), F.when(own % 11 == 0, begin).otherwise((own + 1) * 37).alias("end"))
        return grouping.segmented_reduce(events, bounds, op)

    add(f"segmented_{op}", segmented, f"SELECT segment, {'coalesce(sum(user_id), 0)::BIGINT' if op == 'sum' else f'{op}(user_id)'} AS result FROM {SEGMENTS} x LEFT JOIN events ON event_id >= b AND event_id < e GROUP BY segment")
add("bounded_select", lambda s, d: grouping.bounded_select(t(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank"), "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders QUALIFY rank < 3")

# -- joins
add("join_inner", lambda s, d: joins.join_inner(t(s, d, "orders").select("o_orderkey", "o_custkey"), t(s, d, "customer"), "o_custkey", "c_custkey", ["c_mktsegment"]), "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
add("join_left", lambda s, d: joins.join_left(t(s, d, "documents").select("doc_id"), t(s, d, "labels"), "doc_id", payload=["quality"]), "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS valid FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
add("join_checksum", lambda s, d: joins.checksum(joins.join_left(t(s, d, "documents").select("doc_id", "n_chars"), t(s, d, "labels"), "doc_id", payload=["quality"]), "n_chars", "quality", "valid"), "SELECT CAST(sum(n_chars) AS BIGINT) AS chk1, CAST(sum(quality) AS BIGINT) AS chk2 FROM documents JOIN labels USING (doc_id)")
add("lookup", lambda s, d: joins.lookup(t(s, d, "documents").select("doc_id"), t(s, d, "labels"), "doc_id"), "SELECT d.doc_id, coalesce(pos, -1) AS pos, pos IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels) USING (doc_id)")
add("is_member", lambda s, d: joins.is_member(t(s, d, "documents").select("doc_id"), t(s, d, "labels"), "doc_id", "x"), "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS x FROM documents")
add("semi_join", lambda s, d: joins.semi_join(t(s, d, "customer").select("c_custkey"), t(s, d, "orders"), "c_custkey", "o_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("anti_join", lambda s, d: joins.anti_join(t(s, d, "customer").select("c_custkey"), t(s, d, "orders"), "c_custkey", "o_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("gather", lambda s, d: positional.gather(t(s, d, "events"), t(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 7 % F.lit(t(s, d, "events").count())).alias("i")), "event_id", "value", "i", "x"),
    "SELECT event_id AS id, i, x FROM (SELECT event_id, event_id * 7 % (SELECT count(*) FROM events) AS i FROM events) JOIN (SELECT value AS x, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) ON p = i")
add("cumsum_null_order", lambda s, d: running(nulled(s, d).select("o_orderkey", "price", "o_custkey"), {"total": F.col("o_custkey")}, ["price", "o_orderkey"], block=700).select("o_orderkey", "total"),
    f"SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY price NULLS FIRST, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM {NULLED}")
add("cumsum_text_order", lambda s, d: running(nulled(s, d).select("o_orderkey", "priority", "o_custkey"), {"total": F.col("o_custkey")}, ["priority", "o_orderkey"], block=700).select("o_orderkey", "total"),
    f"SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY priority NULLS FIRST, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM {NULLED}")
add("cumsum_wrap", lambda s, d: positional.cumsum(t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") * 4_000_003).alias("v")), "v", "x", "o_orderkey", wrap=True).select("o_orderkey", F.col("x").cast("long").alias("x")),
    "SELECT o_orderkey, CAST(((c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS BIGINT) AS x FROM (SELECT o_orderkey, sum(o_custkey * 4000003) OVER (ORDER BY o_orderkey) AS c FROM orders)")

# -- dictionaries
add("dict_encode", lambda s, d: dic.encode(nulled(s, d), "priority").select("o_orderkey", "code"), f"SELECT o_orderkey, CASE WHEN priority IS NOT NULL THEN dense_rank() OVER (ORDER BY priority NULLS LAST) - 1 END AS code FROM {NULLED}")
add("dict_decode", lambda s, d: dic.decode(dic.encode(nulled(s, d), "priority").select("o_orderkey", "code"), dic.dictionary(nulled(s, d), "priority"), "code", "x").select("o_orderkey", "x"), f"SELECT o_orderkey, priority AS x FROM {NULLED}")
add("dict_first_seen", lambda s, d: dic.dictionary(t(s, d, "events"), "event_type", "first_seen", ["event_id"]), "SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type")
add("dict_metadata", lambda s, d: dic.metadata(dic.dictionary(t(s, d, "part"), "p_type")), "SELECT count(DISTINCT p_type) AS n, min(p_type) AS min, max(p_type) AS max, true AS dense FROM part")
add("dict_ordering", lambda s, d: dic.ordering(dic.dictionary(t(s, d, "events"), "event_type", "first_seen", ["event_id"])), "SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id)) - 1 AS code, row_number() OVER (ORDER BY event_type) - 1 AS rank FROM events GROUP BY event_type")
add("dict_range", lambda s, d: dic.range_codes(dic.dictionary(t(s, d, "part"), "p_size"), 10, 20), "SELECT code FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS code FROM (SELECT DISTINCT p_size FROM part)) WHERE p_size BETWEEN 10 AND 20")
add("dict_min_max", lambda s, d: dic.min_max(t(s, d, "part"), "p_name"), "SELECT min(p_name) AS min, max(p_name) AS max FROM part")
add("dict_member", lambda s, d: nulled(s, d).select("o_orderkey", dic.member_mask(F.col("status"), ["F"]).alias("x")), f"SELECT o_orderkey, coalesce(status = 'F', false) AS x FROM {NULLED}")
add("dict_count_allowed", lambda s, d: dic.count_allowed(nulled(s, d), "status", ["F", "O"]), f"SELECT count(*) FILTER (status IN ('F', 'O')) AS n FROM {NULLED}")
add("lookup_input", lambda s, d: joins.lookup_input(t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k")), t(s, d, "customer"), "k", ["c_acctbal", "c_custkey"], "c_custkey").select("o_orderkey", "pos", "hit"),
    "SELECT o_orderkey, coalesce(p, -1) AS pos, p IS NOT NULL AS hit FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS p FROM customer) ON c_custkey = o_custkey * 2")
add("dict_lengths", lambda s, d: dic.length_lut(dic.dictionary(nulled(s, d), "priority")), f"SELECT dense_rank() OVER (ORDER BY priority) - 1 AS code, CAST(length(priority) AS BIGINT) AS len FROM (SELECT DISTINCT priority FROM {NULLED} WHERE priority IS NOT NULL)")
add("dict_lookup", lambda s, d: s.createDataFrame([(k, dic.lookup_code(dic.dictionary(nulled(s, d), "priority"), k)) for k in ("2-HIGH", "no such")], "key string, code long"),
    f"SELECT key, code FROM (VALUES ('2-HIGH'), ('no such')) k(key) LEFT JOIN (SELECT priority, dense_rank() OVER (ORDER BY priority) - 1 AS code FROM (SELECT DISTINCT priority FROM {NULLED} WHERE priority IS NOT NULL)) ON priority = key")
add("group_text_min_max", lambda s, d: grouping.group(t(s, d, "part"), "p_brand", {"p_name": ("min", "max", "count")}, sep="_"), "SELECT p_brand, min(p_name) AS p_name_min, max(p_name) AS p_name_max, count(p_name) AS p_name_count FROM part GROUP BY 1")
add("chain_reduce", lambda s, d: s.createDataFrame([(lineitem(s, d).filter(c("l_quantity") >= 10).reduce("count", "l_tax"), int(lineitem(s, d).reduce("max", "l_orderkey")))], "n long, most long"), "SELECT count(*) FILTER (l_quantity >= 10) AS n, max(l_orderkey) AS most FROM lineitem")
add("reduce_skipna", lambda s, d: s.createDataFrame([(grouping.reduce(nulled(s, d), "count", "price", skipna=False), round(float(grouping.reduce(nulled(s, d), "max", "price")), 2), math.isnan(grouping.reduce(nulled(s, d), "sum", "price", skipna=False)))], "rows long, most double, unknown boolean"),
    f"SELECT count(*) AS rows, round(max(price), 2) AS most, count(*) > count(price) AS unknown FROM {NULLED}")
add("dict_predicates", lambda s, d: nulled(s, d).select("o_orderkey", dic.contains(F.col("priority"), "I").alias("a"), dic.not_contains(F.col("priority"), "I").alias("b"), dic.equal(F.col("status"), "F").alias("e"), dic.not_equal(F.col("status"), "F").alias("f"), dic.all_of(dic.not_empty(F.col("status")), dic.contains(F.col("priority"), "-")).alias("g")),
    f"SELECT o_orderkey, coalesce(contains(priority, 'I'), false) AS a, coalesce(NOT contains(priority, 'I'), false) AS b, coalesce(status = 'F', false) AS e, coalesce(status <> 'F', false) AS f, coalesce(status <> '', false) AND coalesce(contains(priority, '-'), false) AS g FROM {NULLED}")

# -- sort and limit; the position in the result is part of it
add("sort_multi", lambda s, d: Table(t(s, d, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey").query().sort("p_brand", "p_size").positions("pos").compile().df,
    "SELECT p_partkey, p_size, p_brand, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) - 1 AS pos FROM part")
add("sort_mixed", lambda s, d: Table(t(s, d, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey").query().sort("p_brand", "p_size", flags=[False, True], position="before").positions("pos").compile().df,
    "SELECT p_partkey, p_size, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS before, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) - 1 AS pos FROM part")
add("sort_desc_nulls_last", lambda s, d: Table(nulled(s, d).select("o_orderkey", "price"), "o_orderkey").query().sort("price", desc=True).positions("pos").compile().df, f"SELECT o_orderkey, price, row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) - 1 AS pos FROM {NULLED}")
add("limit_offset", lambda s, d: Table(t(s, d, "events").select("event_id", "value"), "event_id").query().limit(25, offset=40).compile().df, "SELECT event_id, value FROM events ORDER BY event_id LIMIT 25 OFFSET 40")
add("topk", lambda s, d: Table(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").query().sort("o_totalprice", desc=True).limit(10).compile().df, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("set_operations", lambda s, d: Table(t(s, d, "customer").select("c_nationkey")).query().intersect(t(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))).union(t(s, d, "nation").filter("n_nationkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))).compile().df, "SELECT * FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < 3")

# -- positional
add("shift", lambda s, d: events(s, d).derive("x", c("value").shift(3)).select("event_id", "x").compile().df, "SELECT event_id, lag(value, 3) OVER (ORDER BY event_id) AS x FROM events")
add("cumsum", lambda s, d: events(s, d).derive("x", c("user_id").cumsum()).select("event_id", "x").compile().df, "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS x FROM events")
add("cumsum_shift", lambda s, d: events(s, d).derive("x", c("user_id").cumsum().shift(2) + 1).select("event_id", "x").compile().df, "SELECT event_id, lag(x, 2) OVER (ORDER BY event_id) + 1 AS x FROM (SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS x FROM events)")
add("cumsum_partitioned", lambda s, d: positional.cumsum(t(s, d, "orders"), "o_orderkey", "x", "o_orderkey", ["o_custkey"]).select("o_orderkey", "x"), "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS x FROM orders")
add("scan_exclusive", lambda s, d: positional.exclusive_sum(t(s, d, "events"), "user_id", "x", "event_id").select("event_id", "x"), "SELECT event_id, CAST(coalesce(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM events")
add("rolling_sum", lambda s, d: rounded(positional.rolling_sum(t(s, d, "events"), "value", 5, "x", "event_id", 2).select("event_id", "x")), "SELECT event_id, CASE WHEN count(*) OVER w >= 2 THEN round(sum(value) OVER w, 4) END AS x FROM events WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING)")
add("rolling_mean", lambda s, d: rounded(events(s, d).derive("x", c("value").rolling(7, "mean")).select("event_id", "x").compile().df), "SELECT event_id, CASE WHEN count(*) OVER w >= 7 THEN round(sum(value) OVER w / 7, 4) END AS x FROM events WINDOW w AS (ORDER BY event_id ROWS 6 PRECEDING)")
add("returns", lambda s, d: rounded(positional.returns(t(s, d, "events"), "value", "x", "event_id").select("event_id", "x"), nan=True), "SELECT event_id, round(value / lag(value) OVER (ORDER BY event_id) - 1, 4) AS x FROM events")

_W = "WINDOW w AS (ORDER BY event_id ROWS 9 PRECEDING)"
_FULL = "CASE WHEN count(*) OVER w = 10 THEN {} END"
_STEP = "(SELECT event_id, value, greatest(value - lag(value) OVER (ORDER BY event_id), 0) AS g, greatest(lag(value) OVER (ORDER BY event_id) - value, 0) AS l FROM events)"
_RSI = _FULL.format("CASE WHEN coalesce(sum(l) OVER w, 0) = 0 THEN CASE WHEN coalesce(sum(g) OVER w, 0) = 0 THEN 50.0 ELSE 100.0 END ELSE 100.0 - 100.0 / (1.0 + coalesce(sum(g) OVER w, 0) / sum(l) OVER w) END")
for name, given, sql, source in (
    ("sma", {"w": 10}, _FULL.format("round(avg(value) OVER w, 4)"), "events"), ("rsum", {"w": 10}, _FULL.format("round(sum(value) OVER w, 4)"), "events"), ("rmin", {"w": 10}, _FULL.format("min(value) OVER w"), "events"), ("rmax", {"w": 10}, _FULL.format("max(value) OVER w"), "events"),
    ("rstd", {"w": 10, "ddof": 1}, _FULL.format("round(stddev_samp(value) OVER w, 4)"), "events"), ("boll_up", {"w": 10, "k": 2.0}, _FULL.format("round(avg(value) OVER w + 2 * stddev_pop(value) OVER w, 4)"), "events"), ("boll_lo", {"w": 10, "k": 2.0}, _FULL.format("round(avg(value) OVER w - 2 * stddev_pop(value) OVER w, 4)"), "events"),
    ("zscore", {"w": 10}, _FULL.format("CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 4) END"), "events"), ("stoch_k", {"w": 10}, _FULL.format("CASE WHEN max(value) OVER w = min(value) OVER w THEN 50 ELSE round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 100, 4) END"), "events"),
    ("rsi", {"w": 10}, f"round({_RSI}, 4)", _STEP), ("rsi_lt", {"w": 10, "level": 45.0}, f"CAST(coalesce({_RSI} < 45, false) AS INTEGER)", _STEP), ("rsi_gt", {"w": 10, "level": 55.0}, f"CAST(coalesce({_RSI} > 55, false) AS INTEGER)", _STEP), ("above_sma", {"w": 10}, f"CAST(coalesce(value > {_FULL.format('avg(value) OVER w')}, false) AS INTEGER)", "events"),
    ("mom", {"lag": 4}, "round(value - lag(value, 4) OVER (ORDER BY event_id), 4)", "events"), ("roc", {"lag": 4}, "round((value / lag(value, 4) OVER (ORDER BY event_id) - 1) * 100, 4)", "events"), ("returns", {}, "round(value / lag(value) OVER (ORDER BY event_id) - 1, 4)", "events"), ("axpb", {"a": 2.0, "b": 1.0}, "round(value * 2 + 1, 4)", "events"), ("map_div", {"v": 4.0}, "round(value / 4, 4)", "events"),
):
    add(f"ind_{name}", (lambda n, g: lambda s, d: rounded(indicators.indicators(t(s, d, "events"), "value", [("x", n, g)], "event_id", missing=None).select("event_id", "x"), nan=True))(name, given), f"SELECT event_id, {sql} AS x FROM {source} {_W}")
add("ind_cond_and", lambda s, d: indicators.indicators(t(s, d, "events"), "value", [("a", "above_sma", {"w": 10}), ("b", "rsi_lt", {"w": 10, "level": 60.0}), ("x", "cond_and", {"a": "a", "b": "b"})], "event_id").select("event_id", "x"), f"SELECT event_id, CAST(coalesce(value > {_FULL.format('avg(value) OVER w')}, false) AND coalesce({_RSI} < 60, false) AS INTEGER) AS x FROM {_STEP} {_W}")

# -- lanes
add("rowwise_argmin", lambda s, d: lanes.rowwise_argmin_gather(t(s, d, "lineitem").select(*KEY.split(", "), "l_tax", "l_discount", "l_suppkey"), ["l_suppkey", "l_partkey", "l_linenumber"], ["l_tax", "l_discount", "l_quantity"]).select(*KEY.split(", "), "t", "lane", "d"),
    f"SELECT {KEY}, least(l_suppkey, l_partkey, l_linenumber) AS t, CASE WHEN l_suppkey <= l_partkey AND l_suppkey <= l_linenumber THEN 0 WHEN l_partkey <= l_linenumber THEN 1 ELSE 2 END AS lane, CASE WHEN l_suppkey <= l_partkey AND l_suppkey <= l_linenumber THEN l_tax WHEN l_partkey <= l_linenumber THEN l_discount ELSE l_quantity END AS d FROM lineitem")
add("rowwise_argmin_array", lambda s, d: t(s, d, "embeddings").select("vec_id", F.array_min("embedding").alias("t"), lanes.argmin(F.col("embedding")).alias("lane")), "SELECT vec_id, list_min(embedding) AS t, CAST(list_position(embedding, list_min(embedding)) - 1 AS INTEGER) AS lane FROM embeddings")
add("bitmask_sweep", lambda s, d: lanes.bitmask_sweep(t(s, d, "events").select("event_id"), "event_id", [3, 12]).select("event_id", F.col("hits")[0].alias("h0"), F.col("hits")[1].alias("h1"), "popcnt"), "SELECT event_id, event_id & 3 = 3 AS h0, event_id & 12 = 12 AS h1, CAST(bit_count(event_id) AS INTEGER) AS popcnt FROM events")
add("bitmask_counts", lambda s, d: lanes.bitmask_counts(t(s, d, "events"), "event_id", [3, 12, 96]), "SELECT CAST(p AS BIGINT) AS probe, count(*) FILTER (event_id & p = p) AS count FROM events, (VALUES (3), (12), (96)) t(p) GROUP BY p")
add("pair_insert", lambda s, d: lanes.pair_insert(t(s, d, "events"), "user_id", "value", "event_id"), "SELECT user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
add("travel_cost", lambda s, d: t(s, d, "orders").select("o_orderkey", lanes.cost_travel(F.col("o_custkey") % 1000, F.col("o_orderkey") % 50, 36).alias("x"), lanes.cost_travel_floor(F.col("o_custkey") % 1000, F.col("o_orderkey") % 50, 36).alias("y")),
    "SELECT o_orderkey, CASE WHEN s = 0 THEN 4294967295 ELSE greatest((v * 36 + s // 2) // s, CASE WHEN v > 0 THEN 1 ELSE 0 END) END AS x, CASE WHEN s = 0 THEN 4294967295 ELSE greatest(v * 36 // s, CASE WHEN v > 0 THEN 1 ELSE 0 END) END AS y FROM (SELECT o_orderkey, o_custkey % 1000 AS v, o_orderkey % 50 AS s FROM orders)")
add("row_intern", lambda s, d: lanes.intern_rows(t(s, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id"), "SELECT event_id, user_id, event_type, dense_rank() OVER (ORDER BY f) - 1 AS id FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events)")

# -- graph: suppliers, parts and orders tied by line items would be large; nations, regions and customers do
_EDGES = "(SELECT CAST(c_custkey AS BIGINT) AS src, CAST(c_nationkey + 1000000 AS BIGINT) AS dst, CAST(1 + c_custkey % 9 AS BIGINT) AS w FROM customer UNION ALL SELECT c_nationkey + 1000000, c_custkey, 1 + c_custkey % 7 FROM customer UNION ALL SELECT n_nationkey + 1000000, n_regionkey + 2000000, 3 FROM nation UNION ALL SELECT n_regionkey + 2000000, n_nationkey + 1000000, 4 FROM nation)"


def edges(spark, d):
    customer, nation = t(spark, d, "customer"), t(spark, d, "nation")
    who, where = F.col("c_custkey").cast("long"), (F.col("c_nationkey") + 1_000_000).cast("long")
    land, region = (F.col("n_nationkey") + 1_000_000).cast("long"), (F.col("n_regionkey") + 2_000_000).cast("long")
    parts = [customer.select(who.alias("src"), where.alias("dst"), (1 + who % 9).alias("w")), customer.select(where.alias("src"), who.alias("dst"), (1 + who % 7).alias("w")), nation.select(land.alias("src"), region.alias("dst"), F.lit(3).cast("long").alias("w")), nation.select(region.alias("src"), land.alias("dst"), F.lit(4).cast("long").alias("w"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pos", F.lit(0).cast("long"))


# every path from a customer goes up to its nation, maybe over a region to another nation, and down to a customer
add("sssp", lambda s, d: graph.sssp(written(edges(s, d), "edges"), t(s, d, "customer").filter("c_custkey = 1").select(F.col("c_custkey").alias("source"))).select("node", "dist"), f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS dist, 0 AS n UNION SELECT e.dst, r.dist + e.w, r.n + 1 FROM r JOIN e ON r.node = e.src WHERE r.n < 4 AND (r.n = 0 OR r.node >= 1000000))
SELECT node, min(dist) AS dist FROM r GROUP BY node""")
add("sssp_batch", lambda s, d: graph.sssp(written(edges(s, d), "edges"), t(s, d, "customer").filter("c_custkey between 1 and 3").select(F.col("c_custkey").alias("source"))).select("source", "node", "dist"), f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r AS (SELECT CAST(c_custkey AS BIGINT) AS source, CAST(c_custkey AS BIGINT) AS node, CAST(0 AS BIGINT) AS dist, 0 AS n FROM customer WHERE c_custkey BETWEEN 1 AND 3 UNION SELECT r.source, e.dst, r.dist + e.w, r.n + 1 FROM r JOIN e ON r.node = e.src WHERE r.n < 4 AND (r.n = 0 OR r.node >= 1000000))
SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL""")


def routes(spark, d):
    ends = spark.createDataFrame([(1, 1, "source"), (1, 2, "source"), (1, 5, "target"), (1, 6, "target"), (2, 3, "source"), (2, 99_999_999, "target")], "query long, node long, kind string")
    return graph.route(written(edges(spark, d), "edges"), ends)


_PATHS = f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r AS (SELECT CAST(c_custkey AS BIGINT) AS source, CAST(c_custkey AS BIGINT) AS node, CAST(0 AS BIGINT) AS dist, 0 AS n FROM customer WHERE c_custkey BETWEEN 1 AND 3 UNION SELECT r.source, e.dst, r.dist + e.w, r.n + 1 FROM r JOIN e ON r.node = e.src WHERE r.n < 4 AND (r.n = 0 OR r.node >= 1000000)),
b AS (SELECT source, node, min(dist * 1000 + n) AS k FROM r GROUP BY ALL)"""
add("sssp_pred", lambda s, d: graph.sssp(written(edges(s, d), "edges"), t(s, d, "customer").filter("c_custkey between 1 and 3").select(F.col("c_custkey").alias("source"))), f"""{_PATHS}
SELECT b.source, b.node, b.k // 1000 AS dist, (SELECT min(e.src) FROM e JOIN b p ON p.node = e.src WHERE p.source = b.source AND e.dst = b.node AND p.k + e.w * 1000 + 1 = b.k) AS pred FROM b""")
add("route", routes, f"""{_PATHS},
near AS (SELECT q.query, b.node, min(b.k // 1000) AS dist FROM (VALUES (1, 1), (1, 2), (2, 3)) q(query, source) JOIN b USING (source) GROUP BY ALL),
hit AS (SELECT near.query, min(dist * 1000000000 + near.node) AS t FROM near JOIN (VALUES (1, 5), (1, 6), (2, 99999999)) g(query, node) ON near.query = g.query AND near.node = g.node GROUP BY ALL)
SELECT CAST(near.query AS BIGINT) AS query, CAST(coalesce(any_value(t) // 1000000000, 9223372036854775807) AS BIGINT) AS dist, CAST(coalesce(any_value(t) % 1000000000, -1) AS BIGINT) AS target, count(*) FILTER (t IS NULL OR dist * 1000000000 + near.node <= t) AS visited
FROM near LEFT JOIN hit ON near.query = hit.query GROUP BY near.query""")
add("adjacency_slice", lambda s, d: graph.adjacency_slice(edges(s, d), t(s, d, "customer").select(F.col("c_custkey").cast("long").alias("vertex"))),
    f"SELECT vertex, coalesce(e, 0) - coalesce(n, 0) AS begin, coalesce(e, 0) AS \"end\" FROM (SELECT src AS vertex, count(*) AS n, sum(count(*)) OVER (ORDER BY src)::BIGINT AS e FROM {_EDGES} GROUP BY src) WHERE vertex IN (SELECT c_custkey FROM customer)")
add("adjacency_flat", lambda s, d: graph.adjacency_flat(edges(s, d), t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("vertex"))).drop("edge"), f"SELECT CAST(n_nationkey AS BIGINT) AS ord, CAST(n_nationkey + 1000000 AS BIGINT) AS vertex, dst AS neighbour FROM nation JOIN {_EDGES} ON src = n_nationkey + 1000000")

# -- random; NumPy checks the values in the tests


def philox_sql(n: int, seed: int) -> str:
    """The generator's first two words for counters 0 to n - 1: ten rounds, a subquery for each."""
    (m0, m1), low = random.PHILOX_MULTIPLIERS, (1 << 32) - 1
    word = lambda x: f"{x}::UBIGINT"
    out = f"SELECT i::BIGINT AS id, i::UBIGINT AS x0, {word(0)} AS x1, {word(random.COUNTER_WORDS[0])} AS x2, {word(random.COUNTER_WORDS[1])} AS x3 FROM range({n}) t(i)"
    k = list(random._key(seed, 0))
    for _ in range(10):
        out = f"SELECT id, xor(xor((x2 * {m1}) >> 32, x1), {word(k[0])}) AS x0, (x2 * {m1}) & {word(low)} AS x1, xor(xor((x0 * {m0}) >> 32, x3), {word(k[1])}) AS x2, (x0 * {m0}) & {word(low)} AS x3 FROM ({out})"
        k = [(x + y) & low for x, y in zip(k, random.PHILOX_INCREMENTS)]
    return out


add("rng_fill_i32", lambda s, d: random.fill_i32(s, 10_000, 42, lo=-5, hi=95), f"SELECT id, CAST(((x0 * 100) >> 32)::BIGINT - 5 AS INTEGER) AS value FROM ({philox_sql(10_000, 42)})")
add("rng_fill_f64", lambda s, d: random.fill_f64(s, 10_000, 42), f"SELECT id, ((((x0 >> 5) * 67108864) | (x1 >> 6))::DOUBLE / 9007199254740992.0) AS value FROM ({philox_sql(10_000, 42)})")
add("rng_sample", lambda s, d: random.sample(s, 10_000, 500, 42))
add("rng_permutation", lambda s, d: random.permutation(s, 5_000, 42))
add("rng_compat", lambda s, d: random.compat(s, 1_000, 42))


# -- storage and streams
def persisted(spark, d):
    path = scratch_path(spark, "table")
    blocks.persist_table(t(spark, d, "part"), path)
    return blocks.load_table(spark, path)


def block_table(spark, d):
    path = scratch_path(spark, "blocks")
    blocks.build_blocks(t(spark, d, "events").select("event_id", "user_id", "value"), path, ["event_id"], 1000)
    return blocks.open_blocks(spark, path)


add("persist_roundtrip", persisted, "SELECT * FROM part")
add("block_read", lambda s, d: block_table(s, d).read_block(1).select("event_id", "user_id", "value"), "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 1000 OFFSET 1000")
add("block_index", lambda s, d: block_table(s, d).index().select(F.col("block").cast("long").alias("block"), "rows", "first", "last"), "SELECT p // 1000 AS block, count(*) AS rows, min(p) AS first, max(p) AS last FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) GROUP BY 1")


def streamed(spark, d):
    path = block_table(spark, d).path
    stream = incremental.stream_files(spark, path, "event_id long, user_id long, value double, row long, block long", 4, least_bytes=32 << 20)
    return rounded(incremental.finished(incremental.grouped(stream, ["user_id"], {"value": ("sum", "count")})), 2)


add("stream_group", streamed, "SELECT user_id, round(sum(value), 2) AS value_sum, count(value) AS value_count FROM events GROUP BY user_id")
add("event_windows", lambda s, d: rounded(incremental.windowed(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], {"value": ("sum", "count")}, "1 day"), 2).withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("start", "end")}), "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, round(sum(value), 2) AS value_sum, count(value) AS value_count FROM events GROUP BY ALL")
add("sessions", lambda s, d: incremental.sessions(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "6 hours").select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start")),
    "SELECT user_id, count(*) AS n, min(ts) AS start FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, k")


def adapted(spark, d):
    """A table to Arrow and back, and to pandas and back: a driver-side round trip of a small table."""
    rows = t(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("bal"))
    arrow = adapters.from_arrow(spark, adapters.to_arrow(rows))
    return adapters.from_pandas(spark, adapters.to_pandas(arrow)).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "bal")


add("adapters", adapted, "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS bal FROM supplier")


def csv_blocks(spark, d):
    """A CSV file of a table, built into blocks and read again block by block."""
    path = scratch_path(spark, "csv")
    t(spark, d, "part").select("p_partkey", "p_size", "p_brand").repartition(1).sortWithinPartitions("p_partkey").write.option("header", True).csv(f"{path}/in")
    blocks.build_blocks_from_csv(spark, f"{path}/in", f"{path}/out", "p_partkey long, p_size int, p_brand string", 300)
    return blocks.open_blocks(spark, f"{path}/out").table().select("p_partkey", "p_size", "p_brand", "row", F.col("block").cast("long").alias("block"))


add("csv_blocks", csv_blocks, "SELECT *, row // 300 AS block FROM (SELECT p_partkey, p_size, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS row FROM part)")
add("resident_prepare", lambda s, d: blocks.resident_prepare(t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": {"prefix": "Customer#"}, "c_mktsegment": {"encoding": "dictionary"}}).select("c_custkey", F.col("c_name").cast("long").alias("c_name"), "c_mktsegment"),
    "SELECT c_custkey, CAST(replace(c_name, 'Customer#', '') AS BIGINT) AS c_name, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer")


def windows_streamed(spark, d):
    """Hourly windows over events that arrive as a stream of files."""
    path = scratch_path(spark, "hours")
    t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").repartition(8, "event_id").write.parquet(path)
    stream = incremental.stream_files(spark, path, "event_id long, ts timestamp, event_type string", 2)
    found = incremental.finished(incremental.windowed(stream, "ts", ["event_type"], {"event_id": ("count", "max")}, "1 hour", late="3650 days"))
    return found.select(F.unix_timestamp("start").alias("start"), "event_type", "event_id_count", "event_id_max")


add("stream_windows", windows_streamed, "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS event_id_count, max(event_id) AS event_id_max FROM events GROUP BY ALL")
