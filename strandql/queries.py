"""The catalogue of queries over the sample tables: each as a pipeline, with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.functions import collation
from strandql.operators import text, vector
from strandql.operators.update import Update
from strandql.operators.validate import Schema
from strandql.plans.context import Context
from strandql.plans.pipeline import aggregate
from strandql.sources import conflicts
from strandql.sources.database import Database, merge_frames
from strandql.streaming import oplog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, table: str, pipeline: list[dict[str, Any]], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: aggregate(read(spark, sf_dir, table), pipeline, lambda other: read(spark, sf_dir, other))
    if sql:
        SQL[name] = sql


def custom(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def day(y: int, m: int, d: int) -> dt.datetime:
    return dt.datetime(y, m, d)


# ---- filters

_PART = {"_id": 0, "p_partkey": 1, "p_name": 1, "p_size": 1}
query("match_eq", "customer", [{"$match": {"c_mktsegment": "BUILDING"}}, {"$project": {"c_custkey": 1, "c_name": 1}}], "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
query("match_range", "lineitem", [{"$match": {"l_quantity": {"$gte": 10, "$lt": 20}, "l_shipdate": {"$gt": day(1996, 1, 1), "$lte": day(1996, 6, 30)}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "l_quantity": 1}}], "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-06-30'")
query("match_in", "orders", [{"$match": {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}}, {"$project": {"o_orderkey": 1, "o_orderpriority": 1}}], "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
query("match_nin", "nation", [{"$match": {"n_regionkey": {"$nin": [0, 2]}}}], "SELECT * FROM nation WHERE n_regionkey NOT IN (0, 2)")
query("match_or_nor", "part", [{"$match": {"$or": [{"p_size": {"$lt": 5}}, {"p_retailprice": {"$gt": 1500}}], "$nor": [{"p_brand": "Brand#11"}, {"p_size": 3}]}}, {"$project": {"p_partkey": 1, "p_size": 1}}], "SELECT p_partkey, p_size FROM part WHERE (p_size < 5 OR p_retailprice > 1500) AND NOT (p_brand = 'Brand#11' OR p_size = 3)")
query("match_not", "part", [{"$match": {"p_size": {"$not": {"$gte": 10, "$lt": 40}}}}, {"$project": {"p_partkey": 1, "p_size": 1}}], "SELECT p_partkey, p_size FROM part WHERE NOT (p_size >= 10 AND p_size < 40)")
query("match_regex_i", "part", [{"$match": {"p_name": {"$regex": "^COLD.*t$", "$options": "i"}}}, {"$project": {"p_partkey": 1, "p_name": 1}}], "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^COLD.*t$', 'i')")
query("match_exists", "nation", [{"$addFields": {"big": {"$cond": [{"$gt": ["$n_nationkey", 10]}, "$n_name", None]}}}, {"$match": {"big": {"$exists": True}, "none": {"$exists": False}}}, {"$project": {"n_nationkey": 1, "big": 1}}], "SELECT n_nationkey, n_name AS big FROM nation WHERE n_nationkey > 10")
query("match_type", "nation", [{"$match": {"n_name": {"$type": "string"}, "n_nationkey": {"$type": ["int", "null"]}, "n_regionkey": {"$type": "number"}}}, {"$project": {"n_nationkey": 1}}], "SELECT n_nationkey FROM nation")
query("match_mod", "orders", [{"$match": {"o_orderkey": {"$mod": [7, 3]}}}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
query("match_bits", "part", [{"$match": {"p_size": {"$bitsAllSet": [0, 2], "$bitsAnyClear": 24}}}, {"$project": {"p_partkey": 1, "p_size": 1}}], "SELECT p_partkey, p_size FROM part WHERE (p_size & 5) = 5 AND (p_size & 24) <> 24")
query("match_bits_any", "part", [{"$match": {"p_size": {"$bitsAnySet": 3, "$bitsAllClear": [3]}}}, {"$project": {"p_partkey": 1, "p_size": 1}}], "SELECT p_partkey, p_size FROM part WHERE (p_size & 3) <> 0 AND (p_size & 8) = 0")
query("match_expr", "lineitem", [{"$match": {"$expr": {"$gt": [{"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, 60000]}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1}}], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 60000")
query("match_size_all_elem", "part", [{"$addFields": {"words": {"$split": ["$p_name", " "]}}}, {"$match": {"words": {"$size": 2, "$all": ["cold"], "$elemMatch": {"$regex": "^w"}}}}, {"$project": {"p_partkey": 1, "p_name": 1}}], "SELECT p_partkey, p_name FROM part WHERE len(string_split(p_name, ' ')) = 2 AND list_contains(string_split(p_name, ' '), 'cold') AND len(list_filter(string_split(p_name, ' '), lambda x: x LIKE 'w%')) > 0")
query("match_array_in", "part", [{"$addFields": {"words": {"$split": ["$p_name", " "]}}}, {"$match": {"words": {"$in": ["cold", "gear"]}}}, {"$project": {"p_partkey": 1}}], "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['cold', 'gear'])")
query("match_text", "documents", [{"$match": {"$text": {"$search": "the licensed"}}}, {"$project": {"doc_id": 1}}], "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'the') AND contains(lower(concat_ws(' ', text, lang, source)), 'licensed')")
query("match_ne_null", "customer", [{"$addFields": {"rich": {"$cond": [{"$gt": ["$c_acctbal", 5000]}, "$c_acctbal", None]}}}, {"$match": {"rich": {"$ne": None}}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
query("match_null", "customer", [{"$addFields": {"rich": {"$cond": [{"$gt": ["$c_acctbal", 5000]}, "$c_acctbal", None]}}}, {"$match": {"rich": None}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 5000)")
query("match_prefix", "customer", [{"$match": {"c_name": {"$regex": "^Customer#00000001"}}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
query("match_and_comment", "supplier", [{"$match": {"$and": [{"s_acctbal": {"$gt": 0}}, {"s_nationkey": {"$ne": 3}}], "$comment": "paid"}}, {"$project": {"s_suppkey": 1}}], "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 3")

# ---- shaping

query("project_incl", "orders", [{"$project": {"o_orderkey": 1, "o_totalprice": True}}], "SELECT o_orderkey, o_totalprice FROM orders")
query("project_excl", "nation", [{"$project": {"n_regionkey": 0}}], "SELECT n_nationkey, n_name FROM nation")
query("project_computed", "lineitem", [{"$project": {"_id": 0, "key": "$l_orderkey", "line": "$l_linenumber", "net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}], "SELECT l_orderkey AS key, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
query("addfields_nested", "customer", [{"$addFields": {"who.name": "$c_name", "who.where.nation": "$c_nationkey"}}, {"$set": {"who.rich": {"$gt": ["$c_acctbal", 1000]}}}, {"$project": {"c_custkey": 1, "name": "$who.name", "nation": "$who.where.nation", "rich": "$who.rich"}}], "SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_acctbal > 1000 AS rich FROM customer")
query("unset_fields", "nation", [{"$addFields": {"a": {"b": "$n_name", "c": "$n_regionkey"}}}, {"$unset": ["n_name", "a.b"]}, {"$project": {"n_nationkey": 1, "c": "$a.c"}}], "SELECT n_nationkey, n_regionkey AS c FROM nation")
query("replace_root", "nation", [{"$replaceRoot": {"newRoot": {"key": "$n_nationkey", "name": "$n_name"}}}], "SELECT n_nationkey AS key, n_name AS name FROM nation")
query("replace_with", "nation", [{"$replaceWith": {"$mergeObjects": [{"key": 0, "name": "$n_name"}, {"key": "$n_nationkey"}]}}], "SELECT n_nationkey AS key, n_name AS name FROM nation")
query("sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 10}, {"$limit": 25}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
query("topk", "lineitem", [{"$sort": {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1}}, {"$limit": 100}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "l_extendedprice": 1}}], "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
query("count_stage", "lineitem", [{"$match": {"l_returnflag": "R"}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
query("count_empty", "lineitem", [{"$match": {"l_returnflag": "?"}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = '?'")
query("distinct_values", "orders", [{"$group": {"_id": "$o_orderpriority"}}, {"$project": {"_id": 0, "value": "$_id"}}], "SELECT DISTINCT o_orderpriority AS value FROM orders")
query("sample_n", "orders", [{"$sample": {"size": 50, "seed": 7}}, {"$project": {"o_orderkey": 1}}], None)

# ---- expressions

query("expr_arith", "lineitem", [{"$project": {"_id": 0, "k": "$l_orderkey", "l": "$l_linenumber", "a": {"$add": ["$l_linenumber", "$l_orderkey", 1]}, "s": {"$subtract": ["$l_quantity", "$l_linenumber"]}, "d": {"$divide": ["$l_extendedprice", "$l_quantity"]}, "m": {"$mod": ["$l_orderkey", 7]}, "z": {"$divide": ["$l_quantity", 0]}, "t": {"$sum": ["$l_quantity", "$l_tax", None]}}}], "SELECT l_orderkey AS k, l_linenumber AS l, (l_linenumber + l_orderkey + 1)::BIGINT AS a, l_quantity - l_linenumber AS s, l_extendedprice / l_quantity AS d, l_orderkey % 7 AS m, NULL::DOUBLE AS z, l_quantity + l_tax AS t FROM lineitem")
query("expr_round_trunc", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "c": {"$ceil": "$p_retailprice"}, "f": {"$floor": "$p_retailprice"}, "r": {"$round": ["$p_retailprice", 1]}, "t": {"$trunc": ["$p_retailprice", 1]}, "b": {"$abs": {"$subtract": [20, "$p_size"]}}}}], "SELECT p_partkey AS k, ceil(p_retailprice)::DOUBLE AS c, floor(p_retailprice)::DOUBLE AS f, round(p_retailprice, 1) AS r, floor(p_retailprice * 10.0::DOUBLE) / 10.0::DOUBLE AS t, abs(20 - p_size)::BIGINT AS b FROM part")
query("expr_math", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "q": {"$round": [{"$sqrt": "$p_size"}, 6]}, "e": {"$round": [{"$exp": {"$divide": ["$p_size", 10]}}, 6]}, "n": {"$round": [{"$ln": "$p_retailprice"}, 6]}, "g": {"$round": [{"$log10": "$p_retailprice"}, 6]}, "b": {"$round": [{"$log": ["$p_retailprice", 2]}, 6]}, "p": {"$pow": ["$p_size", 2]}, "x": {"$sqrt": {"$subtract": [0, "$p_size"]}}}}], "SELECT p_partkey AS k, round(sqrt(p_size), 6) AS q, round(exp(p_size / 10), 6) AS e, round(ln(p_retailprice), 6) AS n, round(log10(p_retailprice), 6) AS g, round(ln(p_retailprice) / ln(2), 6) AS b, (p_size * p_size)::BIGINT AS p, NULL::DOUBLE AS x FROM part")
query("expr_string", "customer", [{"$project": {"_id": 0, "k": "$c_custkey", "c": {"$concat": ["$c_name", "/", "$c_mktsegment"]}, "u": {"$toUpper": "$c_name"}, "l": {"$toLower": "$c_mktsegment"}, "s": {"$substr": ["$c_name", 2, 4]}, "e": {"$substr": ["$c_name", 9, -1]}, "n": {"$strLenCP": "$c_name"}, "i": {"$indexOfCP": ["$c_name", "#"]}, "m": {"$indexOfCP": ["$c_name", "?"]}, "z": {"$concat": ["$c_name", None]}}}], "SELECT c_custkey AS k, c_name || '/' || c_mktsegment AS c, upper(c_name) AS u, lower(c_mktsegment) AS l, substr(c_name, 3, 4) AS s, substr(c_name, 10) AS e, length(c_name)::INT AS n, (strpos(c_name, '#') - 1)::INT AS i, -1 AS m, NULL::VARCHAR AS z FROM customer")
query("expr_trim_split_replace", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "t": {"$trim": {"input": {"$concat": ["  ", "$p_name", " "]}}}, "c": {"$ltrim": {"input": "$p_name", "chars": "co"}}, "r": {"$rtrim": {"input": "$p_name", "chars": "tdg"}}, "w": {"$arrayElemAt": [{"$split": ["$p_name", " "]}, -1]}, "o": {"$replaceOne": {"input": "$p_name", "find": "o", "replacement": "0"}}, "a": {"$replaceAll": {"input": "$p_name", "find": "e", "replacement": "3"}}}}], "SELECT p_partkey AS k, p_name AS t, ltrim(p_name, 'co') AS c, rtrim(p_name, 'tdg') AS r, string_split(p_name, ' ')[-1] AS w, regexp_replace(p_name, 'o', '0') AS o, replace(p_name, 'e', '3') AS a FROM part")
query("expr_regex", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "m": {"$regexMatch": {"input": "$p_name", "regex": "^[a-m]"}}, "f": {"$getField": {"field": "match", "input": {"$regexFind": {"input": "$p_name", "regex": "[aeiou]+"}}}}, "i": {"$getField": {"field": "idx", "input": {"$regexFind": {"input": "$p_name", "regex": "[aeiou]+"}}}}, "n": {"$size": {"$regexFindAll": {"input": "$p_name", "regex": "[aeiou]"}}}}}], "SELECT p_partkey AS k, regexp_matches(p_name, '^[a-m]') AS m, regexp_extract(p_name, '[aeiou]+') AS f, length(regexp_extract(p_name, '^([^aeiou]*)', 1))::INT AS i, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS n FROM part")
query("expr_cond_switch_ifnull", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "c": {"$cond": {"if": {"$gte": ["$p_size", 25]}, "then": "big", "else": "small"}}, "s": {"$switch": {"branches": [{"case": {"$lt": ["$p_size", 10]}, "then": 1}, {"case": {"$lt": ["$p_size", 30]}, "then": 2}], "default": 3}}, "i": {"$ifNull": [{"$cond": [{"$eq": ["$p_size", 1]}, None, "$p_name"]}, "one"]}}}], "SELECT p_partkey AS k, CASE WHEN p_size >= 25 THEN 'big' ELSE 'small' END AS c, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS s, CASE WHEN p_size = 1 THEN 'one' ELSE p_name END AS i FROM part")
query("expr_compare_logic", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "e": {"$eq": ["$p_size", 10]}, "n": {"$ne": ["$p_size", 10]}, "a": {"$and": [{"$gt": ["$p_size", 5]}, {"$lte": ["$p_size", 20]}]}, "o": {"$or": [{"$lt": ["$p_size", 5]}, "$missing"]}, "t": {"$not": ["$p_size"]}, "u": {"$lt": [None, "$p_size"]}}}], "SELECT p_partkey AS k, p_size = 10 AS e, p_size <> 10 AS n, p_size > 5 AND p_size <= 20 AS a, p_size < 5 AS o, p_size = 0 AS t, true AS u FROM part")
query("expr_date_parts", "orders", [{"$project": {"_id": 0, "k": "$o_orderkey", "y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "d": {"$dayOfMonth": "$o_orderdate"}, "w": {"$dayOfWeek": "$o_orderdate"}, "j": {"$dayOfYear": "$o_orderdate"}, "h": {"$hour": "$o_orderdate"}}}], "SELECT o_orderkey AS k, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, (dayofweek(o_orderdate) + 1)::INT AS w, dayofyear(o_orderdate)::INT AS j, hour(o_orderdate)::INT AS h FROM orders")
query("expr_time_parts", "events", [{"$project": {"_id": 0, "k": "$event_id", "h": {"$hour": "$ts"}, "m": {"$minute": "$ts"}, "s": {"$second": "$ts"}}}], "SELECT event_id AS k, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s FROM events")
query("expr_date_format", "orders", [{"$project": {"_id": 0, "k": "$o_orderkey", "f": {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d %H:%M"}}, "p": {"$year": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$o_orderdate", "format": "%Y-%m-%d"}}}}}}}], "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f, year(o_orderdate)::INT AS p FROM orders")
query("expr_convert", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "s": {"$toString": "$p_size"}, "i": {"$toInt": {"$concat": [{"$toString": "$p_size"}, ".7"]}}, "x": {"$toInt": "$p_name"}, "d": {"$toDouble": {"$toString": "$p_size"}}, "b": {"$toBool": "$p_size"}, "c": {"$convert": {"input": "$p_name", "to": "int", "onError": -1}}, "t": {"$type": "$p_retailprice"}, "y": {"$year": {"$toDate": 1704110523000}}}}], "SELECT p_partkey AS k, p_size::VARCHAR AS s, p_size AS i, NULL::INT AS x, p_size::DOUBLE AS d, p_size <> 0 AS b, -1 AS c, 'double' AS t, 2024 AS y FROM part")
query("expr_array_basic", "part", [{"$addFields": {"w": {"$split": ["$p_name", " "]}, "n": ["$p_size", 7, 3]}}, {"$project": {"_id": 0, "k": "$p_partkey", "z": {"$size": "$n"}, "f": {"$arrayElemAt": ["$w", 0]}, "o": {"$arrayElemAt": ["$w", 9]}, "s": {"$sum": "$n"}, "l": {"$arrayElemAt": [{"$slice": ["$n", -2]}, 0]}, "v": {"$arrayElemAt": [{"$reverseArray": "$n"}, 0]}, "c": {"$size": {"$concatArrays": ["$n", [1, 2]]}}, "i": {"$in": [7, "$n"]}, "x": {"$indexOfArray": ["$n", 3]}, "y": {"$indexOfArray": ["$n", 99]}, "a": {"$isArray": "$w"}}}], "SELECT p_partkey AS k, 3 AS z, string_split(p_name, ' ')[1] AS f, NULL::VARCHAR AS o, (p_size + 10)::BIGINT AS s, 7 AS l, 3 AS v, 5 AS c, true AS i, CASE WHEN p_size = 3 THEN 0 ELSE 2 END AS x, -1 AS y, true AS a FROM part WHERE p_size <> 99")
query("expr_map_filter_reduce", "part", [{"$addFields": {"n": {"$range": [1, {"$add": ["$p_size", 1]}]}}}, {"$project": {"_id": 0, "k": "$p_partkey", "m": {"$sum": {"$map": {"input": "$n", "as": "x", "in": {"$multiply": ["$$x", 2]}}}}, "f": {"$size": {"$filter": {"input": "$n", "as": "x", "cond": {"$eq": [{"$mod": ["$$x", 3]}, 0]}}}}, "r": {"$reduce": {"input": "$n", "initialValue": 0, "in": {"$add": ["$$value", {"$multiply": ["$$this", "$$this"]}]}}}, "l": {"$let": {"vars": {"h": {"$divide": ["$p_size", 2]}}, "in": {"$add": ["$$h", 1]}}}}}], "SELECT p_partkey AS k, (p_size * (p_size + 1))::BIGINT AS m, (p_size // 3)::INT AS f, (p_size * (p_size + 1) * (2 * p_size + 1) // 6)::BIGINT AS r, p_size / 2 + 1 AS l FROM part")
query("expr_range_zip", "part", [{"$project": {"_id": 0, "k": "$p_partkey", "n": {"$size": {"$range": [0, "$p_size", 3]}}, "e": {"$size": {"$range": [5, 5]}}, "d": {"$sum": {"$range": [5, 0, -2]}}, "z": {"$size": {"$zip": {"inputs": [{"$range": [0, 4]}, {"$split": ["$p_name", " "]}]}}}, "y": {"$size": {"$zip": {"inputs": [{"$range": [0, 4]}, {"$range": [0, 2]}], "useLongestLength": True}}}}}], "SELECT p_partkey AS k, ceil(p_size / 3)::INT AS n, 0 AS e, 9::BIGINT AS d, 2 AS z, 4 AS y FROM part")
query("expr_object", "nation", [{"$addFields": {"o": {"$mergeObjects": [{"a": "$n_nationkey", "b": 1}, {"b": "$n_regionkey"}]}}}, {"$project": {"_id": 0, "k": "$n_nationkey", "a": "$o.a", "b": {"$getField": {"field": "b", "input": "$o"}}, "c": {"$getField": {"field": "c", "input": {"$setField": {"field": "c", "input": "$o", "value": "$n_name"}}}}, "n": {"$size": {"$objectToArray": "$o"}}, "z": {"$getField": {"field": "x", "input": {"$arrayToObject": [[{"k": "x", "v": "$n_regionkey"}]]}}}, "s": {"$bsonSize": "$o"}, "l": {"$literal": "$n_name"}}}], "SELECT n_nationkey AS k, n_nationkey AS a, n_regionkey AS b, n_name AS c, 2 AS n, n_regionkey AS z, 19 AS s, '$n_name' AS l FROM nation")

# ---- groups

_Q1 = [{"$match": {"l_shipdate": {"$lte": day(1998, 9, 2)}}}, {"$group": {"_id": {"rf": "$l_returnflag", "ls": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "rev": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "avg_disc": {"$avg": "$l_discount"}, "n": {"$sum": 1}}}, {"$sort": {"_id.rf": 1, "_id.ls": 1}}, {"$project": {"_id": 0, "rf": "$_id.rf", "ls": "$_id.ls", "sum_qty": 1, "rev": {"$round": ["$rev", 2]}, "avg_disc": {"$round": ["$avg_disc", 6]}, "n": 1}}]
query("pricing_summary", "lineitem", _Q1, "SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
query("group_sum_avg", "orders", [{"$group": {"_id": "$o_orderpriority", "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "n": {"$count": {}}}}, {"$project": {"_id": 1, "total": {"$round": ["$total", 2]}, "mean": {"$round": ["$mean", 4]}, "n": 1}}], "SELECT o_orderpriority AS _id, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
query("group_null_id", "lineitem", [{"$group": {"_id": None, "q": {"$sum": "$l_quantity"}, "lines": {"$sum": "$l_linenumber"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "q": 1, "lines": 1, "n": 1}}], "SELECT sum(l_quantity) AS q, sum(l_linenumber)::BIGINT AS lines, count(*) AS n FROM lineitem")
query("group_empty_input", "lineitem", [{"$match": {"l_returnflag": "?"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = '?' HAVING count(*) > 0")
query("group_compound_id", "orders", [{"$group": {"_id": {"y": {"$year": "$o_orderdate"}, "s": "$o_orderstatus"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "y": "$_id.y", "s": "$_id.s", "n": 1}}], "SELECT year(o_orderdate)::INT AS y, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2")
query("group_min_max_std", "part", [{"$group": {"_id": "$p_brand", "lo": {"$min": "$p_size"}, "hi": {"$max": "$p_retailprice"}, "sp": {"$stdDevPop": "$p_size"}, "ss": {"$stdDevSamp": "$p_size"}}}, {"$project": {"lo": 1, "hi": 1, "sp": {"$round": ["$sp", 6]}, "ss": {"$round": ["$ss", 6]}}}], "SELECT p_brand AS _id, min(p_size) AS lo, max(p_retailprice) AS hi, round(stddev_pop(p_size), 6) AS sp, round(stddev_samp(p_size), 6) AS ss FROM part GROUP BY 1")
query("group_push_sorted", "nation", [{"$sort": {"n_name": -1}}, {"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}, {"$project": {"names": {"$reduce": {"input": "$names", "initialValue": "", "in": {"$concat": ["$$value", "|", "$$this"]}}}}}], "SELECT n_regionkey AS _id, '|' || string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")
query("group_addtoset_size", "lineitem", [{"$group": {"_id": "$l_suppkey", "parts": {"$addToSet": "$l_partkey"}}}, {"$project": {"n": {"$size": "$parts"}}}], "SELECT l_suppkey AS _id, count(DISTINCT l_partkey)::INT AS n FROM lineitem GROUP BY 1")
query("group_addtoset_array", "orders", [{"$group": {"_id": "$o_custkey", "s": {"$addToSet": "$o_orderstatus"}}}, {"$addFields": {"n": {"$size": "$s"}}}, {"$project": {"n": 1}}], "SELECT o_custkey AS _id, count(DISTINCT o_orderstatus)::INT AS n FROM orders GROUP BY 1")
query("group_first_last", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}], "SELECT o_custkey AS _id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1")
query("group_top_bottom", "orders", [{"$group": {"_id": "$o_custkey", "top": {"$top": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "bottom": {"$bottom": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}}}], "SELECT o_custkey AS _id, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, -o_orderkey)) AS bottom FROM orders GROUP BY 1")
_JOIN3 = lambda f: {"$reduce": {"input": f, "initialValue": "", "in": {"$concat": ["$$value", "|", {"$toString": "$$this"}]}}}
query("group_topn_bottomn", "orders", [{"$group": {"_id": "$o_custkey", "t": {"$topN": {"n": 3, "sortBy": {"o_orderkey": -1}, "output": "$o_orderkey"}}, "b": {"$bottomN": {"n": 2, "sortBy": {"o_orderkey": -1}, "output": "$o_orderkey"}}}}, {"$project": {"t": _JOIN3("$t"), "b": _JOIN3("$b")}}], "SELECT o_custkey AS _id, '|' || array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey DESC), 1, 3), '|') AS t, '|' || array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 2), '|') AS b FROM orders GROUP BY 1")
query("group_firstn_lastn", "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "f": {"$firstN": {"n": 2, "input": "$o_orderkey"}}, "l": {"$lastN": {"n": 2, "input": "$o_orderkey"}}}}, {"$project": {"f": _JOIN3("$f"), "l": _JOIN3("$l")}}], "SELECT o_custkey AS _id, '|' || array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 2), '|') AS f, '|' || array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), -2, -1), '|') AS l FROM orders GROUP BY 1")
query("group_mergeobjects", "nation", [{"$sort": {"n_nationkey": 1}}, {"$group": {"_id": "$n_regionkey", "m": {"$mergeObjects": {"name": "$n_name", "low": {"$cond": [{"$lt": ["$n_nationkey", 12]}, "$n_name", None]}}}}}, {"$project": {"name": "$m.name", "low": "$m.low"}}], "SELECT n_regionkey AS _id, arg_max(n_name, n_nationkey) AS name, arg_max(n_name, n_nationkey) FILTER (WHERE n_nationkey < 12) AS low FROM nation GROUP BY 1")
query("sort_by_count", "lineitem", [{"$sortByCount": "$l_suppkey"}], "SELECT l_suppkey AS _id, count(*) AS count FROM lineitem GROUP BY 1")
query("bucket", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 20, 30, 100, 200], "output": {"n": {"$sum": 1}, "hi": {"$max": "$p_size"}}, "default": "other"}}], "SELECT b.lo AS _id, count(p.p_size) AS n, max(p.p_size) AS hi FROM (VALUES ('0.0', 0, 10), ('10.0', 10, 20), ('20.0', 20, 30), ('30.0', 30, 100), ('100.0', 100, 200)) b(lo, a, z) LEFT JOIN part p ON p.p_size >= b.a AND p.p_size < b.z GROUP BY 1")
query("bucket_default", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [10, 20, 30], "default": -1}}], "SELECT CASE WHEN p_size >= 10 AND p_size < 20 THEN 10.0::DOUBLE WHEN p_size >= 20 AND p_size < 30 THEN 20.0::DOUBLE ELSE (-1.0)::DOUBLE END AS _id, count(*) AS count FROM part GROUP BY 1")
query("bucket_auto", "orders", [{"$bucketAuto": {"groupBy": "$o_totalprice", "buckets": 7, "output": {"n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}}, {"$project": {"_id": 0, "lo": "$_id.min", "hi": "$_id.max", "n": 1, "total": {"$round": ["$total", 2]}}}], "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), g AS (SELECT floor(i / ceil(n / 7)) AS b, min(v) AS lo, max(v) AS top, count(*) AS n, round(sum(v), 2) AS total FROM r GROUP BY 1) SELECT lo, coalesce(lead(lo) OVER (ORDER BY b), top) AS hi, n, total FROM g")
query("events_hourly_group", "events", [{"$group": {"_id": {"h": {"$hour": "$ts"}, "t": "$event_type"}, "n": {"$sum": 1}, "lo": {"$min": "$value"}, "hi": {"$max": "$value"}, "mean": {"$avg": "$value"}}}, {"$project": {"_id": 0, "h": "$_id.h", "t": "$_id.t", "n": 1, "lo": 1, "hi": 1, "mean": {"$round": ["$mean", 6]}}}], "SELECT hour(ts)::INT AS h, event_type AS t, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")

# ---- unwind, facet, redact

query("unwind_tokens", "part", [{"$addFields": {"w": {"$split": ["$p_name", " "]}}}, {"$unwind": "$w"}, {"$sortByCount": "$w"}], "SELECT w AS _id, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
query("unwind_index", "part", [{"$addFields": {"w": {"$split": ["$p_name", " "]}}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}, {"$project": {"p_partkey": 1, "w": 1, "i": 1}}], "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part")
query("unwind_preserve", "part", [{"$addFields": {"w": {"$filter": {"input": {"$split": ["$p_name", " "]}, "as": "x", "cond": {"$regexMatch": {"input": "$$x", "regex": "^c"}}}}}}, {"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}, {"$project": {"p_partkey": 1, "w": 1}}], "SELECT p_partkey, t.w FROM part LEFT JOIN (SELECT k, w FROM (SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w LIKE 'c%') t ON t.k = p_partkey")
query("facet_multi", "orders", [{"$facet": {"total": [{"$count": "n"}], "by": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$sort": {"n": -1}}], "top": [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 3}, {"$project": {"o_orderkey": 1}}]}}, {"$project": {"n": {"$arrayElemAt": ["$total.n", 0]}, "groups": {"$size": "$by"}, "a": {"$getField": {"field": "o_orderkey", "input": {"$arrayElemAt": ["$top", 0]}}}, "c": {"$getField": {"field": "o_orderkey", "input": {"$arrayElemAt": ["$top", 2]}}}}}, {"$unset": "n"}], "SELECT (SELECT count(DISTINCT o_orderstatus)::INT FROM orders) AS groups, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS a, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 2) AS c")
query("redact_prune", "customer", [{"$addFields": {"acct": {"level": {"$cond": [{"$gt": ["$c_acctbal", 5000]}, 5, 1]}, "bal": "$c_acctbal"}, "level": 1}}, {"$redact": {"$cond": [{"$lte": [{"$ifNull": ["$level", 0]}, 3]}, "$$DESCEND", "$$PRUNE"]}}, {"$project": {"c_custkey": 1, "bal": "$acct.bal"}}], "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS bal FROM customer")

# ---- joins

query("lookup_nest_size", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$orders"}}}], "SELECT c_custkey, count(o_orderkey)::INT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
query("lookup_unwind_inner", "orders", [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$project": {"o_orderkey": 1, "name": "$c.c_name"}}], "SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
_BIG = [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$k"]}, {"$gt": ["$o_totalprice", 250000]}]}}}]
query("lookup_left_preserve", "nation", [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$unwind": {"path": "$s", "preserveNullAndEmptyArrays": True}}, {"$project": {"n_name": 1, "supp": "$s.s_suppkey"}}], "SELECT n_name, s_suppkey AS supp FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
query("lookup_semi", "nation", [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$match": {"s": {"$ne": []}}}, {"$project": {"n_nationkey": 1}}], "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
query("lookup_anti", "part", [{"$lookup": {"from": "lineitem", "localField": "p_size", "foreignField": "l_linenumber", "as": "s"}}, {"$match": {"s": {"$size": 0}}}, {"$project": {"p_partkey": 1, "p_size": 1}}], "SELECT p_partkey, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber = p_size)")
query("lookup_pipeline_corr", "customer", [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "pipeline": [*_BIG, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}], "as": "big"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$big"}, "best": {"$getField": {"field": "o_orderkey", "input": {"$arrayElemAt": ["$big", 0]}}}}}], "SELECT c_custkey, least(count(o_orderkey), 2)::INT AS n, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1")
query("lookup_pipeline_group", "nation", [{"$lookup": {"from": "customer", "let": {"n": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$n"]}}}, {"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}], "as": "segments"}}, {"$project": {"n_name": 1, "k": {"$size": "$segments"}, "n": {"$sum": {"$map": {"input": "$segments", "as": "s", "in": "$$s.n"}}}}}], "SELECT n_name, count(DISTINCT c_mktsegment)::INT AS k, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
query("lookup_pipeline_theta", "region", [{"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$lt": ["$n_regionkey", "$$r"]}}}, {"$count": "n"}], "as": "x"}}, {"$project": {"r_regionkey": 1, "n": {"$sum": {"$map": {"input": "$x", "as": "s", "in": "$$s.n"}}}}}], "SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey < r_regionkey GROUP BY 1")
query("lookup_pipeline_uncorr", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$match": {"n_regionkey": 1}}, {"$project": {"n_name": 1}}], "as": "x"}}, {"$project": {"r_name": 1, "n": {"$size": "$x"}}}], "SELECT r_name, (SELECT count(*)::INT FROM nation WHERE n_regionkey = 1) AS n FROM region")
query("union_with", "customer", [{"$project": {"name": "$c_name", "bal": "$c_acctbal"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"name": "$s_name", "bal": "$s_acctbal"}}]}}], "SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
query("union_distinct", "customer", [{"$project": {"k": "$c_nationkey"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"k": "$s_nationkey"}}]}}, {"$group": {"_id": "$k"}}], "SELECT c_nationkey AS _id FROM customer UNION SELECT s_nationkey FROM supplier")
query("three_way_revenue", "customer", [{"$match": {"c_mktsegment": "BUILDING"}}, {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": "$o"}, {"$addFields": {"okey": "$o.o_orderkey"}}, {"$lookup": {"from": "lineitem", "localField": "okey", "foreignField": "l_orderkey", "as": "l"}}, {"$unwind": "$l"}, {"$group": {"_id": "$c_nationkey", "rev": {"$sum": {"$multiply": ["$l.l_extendedprice", {"$subtract": [1, "$l.l_discount"]}]}}}}, {"$project": {"rev": {"$round": ["$rev", 2]}}}], "SELECT c_nationkey AS _id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
query("nation_region_rollup", "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$r.r_name", "n": {"$sum": 1}, "bal": {"$sum": "$c.c_acctbal"}}}, {"$project": {"n": 1, "bal": {"$round": ["$bal", 2]}}}], "SELECT r_name AS _id, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
query("graph_lookup_chain", "nation", [{"$graphLookup": {"from": "nation", "startWith": "$n_regionkey", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "up", "maxDepth": 3, "depthField": "d"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$up"}, "deep": {"$arrayElemAt": ["$up.d", -1]}, "keys": {"$sum": {"$map": {"input": "$up", "as": "u", "in": "$$u.n_nationkey"}}}}}, {"$unset": "deep"}], "WITH RECURSIVE walk AS (SELECT n_nationkey AS s, n_regionkey AS v, 0 AS d FROM nation UNION SELECT w.s, n.n_regionkey, w.d + 1 FROM walk w JOIN nation n ON n.n_nationkey = w.v WHERE w.d < 3), seen AS (SELECT DISTINCT w.s, n.n_nationkey AS k FROM walk w JOIN nation n ON n.n_nationkey = w.v) SELECT s AS n_nationkey, count(*)::INT AS n, sum(k)::BIGINT AS keys FROM seen GROUP BY 1")

# ---- windows

_W = {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1, "o_orderkey": 1}}
query("win_rank_dense_rownum", "part", [{"$setWindowFields": {"partitionBy": "$p_brand", "sortBy": {"p_size": -1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}}}}, {"$setWindowFields": {"partitionBy": "$p_brand", "sortBy": {"p_size": -1, "p_partkey": 1}, "output": {"n": {"$documentNumber": {}}}}}, {"$project": {"p_partkey": 1, "r": 1, "d": 1, "n": 1}}], "SELECT p_partkey, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)::INT AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)")
query("win_shift", "orders", [{"$setWindowFields": {**_W, "output": {"prev": {"$shift": {"output": "$o_orderkey", "by": -1, "default": -1}}, "next": {"$shift": {"output": "$o_totalprice", "by": 2}}}}}, {"$project": {"o_orderkey": 1, "prev": 1, "next": 1}}], "SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER w AS prev, lead(o_totalprice, 2) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
query("win_running_sum", "orders", [{"$setWindowFields": {**_W, "output": {"run": {"$sum": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}}, "n": {"$count": {}, "window": {"documents": ["unbounded", "current"]}}}}}, {"$project": {"o_orderkey": 1, "n": 1, "run": {"$round": ["$run", 2]}}}], "SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS run FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
query("win_moving_avg", "orders", [{"$setWindowFields": {**_W, "output": {"mean": {"$avg": "$o_totalprice", "window": {"documents": [-2, 0]}}, "hi": {"$max": "$o_totalprice", "window": {"documents": [-1, 1]}}}}}, {"$project": {"o_orderkey": 1, "mean": {"$round": ["$mean", 4]}, "hi": 1}}], "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi FROM orders")
query("win_partition_total", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "output": {"n": {"$count": {}}, "lo": {"$min": "$o_totalprice"}}}}, {"$project": {"o_orderkey": 1, "n": 1, "lo": 1}}], "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo FROM orders")
query("win_first_last", "orders", [{"$setWindowFields": {**_W, "output": {"f": {"$first": "$o_orderkey"}, "l": {"$last": "$o_orderkey"}}}}, {"$project": {"o_orderkey": 1, "f": 1, "l": 1}}], "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
query("win_push_set", "orders", [{"$setWindowFields": {**_W, "output": {"seen": {"$push": "$o_orderkey", "window": {"documents": ["unbounded", "current"]}}, "st": {"$addToSet": "$o_orderstatus"}}}}, {"$project": {"o_orderkey": 1, "n": {"$size": "$seen"}, "f": {"$arrayElemAt": ["$seen", 0]}, "s": {"$size": "$st"}}}], "SELECT o_orderkey, (row_number() OVER w)::INT AS n, first_value(o_orderkey) OVER w AS f, (SELECT count(DISTINCT i.o_orderstatus)::INT FROM orders i WHERE i.o_custkey = o.o_custkey) AS s FROM orders o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")

# ---- vectors, places, text

_V = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_VSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _V) + "]"
_DOT = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {_VSQL}), lambda x: x[1] * x[2]))"
_NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"
_VN = sum(x * x for x in _V) ** 0.5
_TOP = [{"$project": {"vec_id": 1, "s": {"$round": ["$_vectorScore", 6]}}}]
query("vector_cosine_topk", "embeddings", [{"$vectorSearch": {"path": "embedding", "queryVector": _V, "limit": 20}}, *_TOP], f"SELECT vec_id, round(greatest(0, least(1, (1 + {_DOT} / ({_NORM} * {_VN})) / 2)), 6) AS s FROM embeddings ORDER BY {_DOT} / {_NORM} DESC LIMIT 20")
query("vector_euclid_filter", "embeddings", [{"$vectorSearch": {"path": "embedding", "queryVector": _V, "limit": 10, "similarity": "euclidean", "filter": {"label": {"$in": [1, 2, 3]}}}}, *_TOP], f"SELECT vec_id, round(1 / (1 + d), 6) AS s FROM (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], {_VSQL}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d FROM embeddings WHERE label IN (1, 2, 3)) ORDER BY d LIMIT 10")
query("vector_dot", "embeddings", [{"$vectorSearch": {"path": "embedding", "queryVector": [x / 40 for x in _V], "limit": 10, "metric": "dotProduct"}}, {"$project": {"vec_id": 1, "s": {"$round": [{"$meta": "vectorSearchScore"}, 6]}}}], f"SELECT vec_id, round(greatest(0, least(1, (1 + {_DOT} / 40) / 2)), 6) AS s FROM embeddings ORDER BY {_DOT} DESC LIMIT 10")

_LON, _LAT = "((c_custkey * 7919) % 3600) / 10.0 - 180", "((c_custkey * 104729) % 1700) / 10.0 - 85"
_PLACE = {"$addFields": {"location": {"type": "Point", "coordinates": [{"$subtract": [{"$divide": [{"$mod": [{"$multiply": ["$c_custkey", 7919]}, 3600]}, 10]}, 180]}, {"$subtract": [{"$divide": [{"$mod": [{"$multiply": ["$c_custkey", 104729]}, 1700]}, 10]}, 85]}]}}}


def _hav(lon: float, lat: float) -> str:
    return f"(2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(({_LAT}) - {lat}) / 2), 2) + cos(radians({_LAT})) * cos(radians({lat})) * pow(sin(radians(({_LON}) - ({lon})) / 2), 2)))))"


@custom("geo_near", f"SELECT c_custkey, round({_hav(10.0, 50.0)}, 1) AS d FROM customer WHERE c_acctbal > 0 AND {_hav(10.0, 50.0)} <= 3000000 AND {_hav(10.0, 50.0)} >= 100000")
def _(spark, sf_dir):
    # The places are made by a pipeline of their own, as $geoNear comes first.
    places = aggregate(read(spark, sf_dir, "customer"), [_PLACE])
    near = {"$geoNear": {"near": {"type": "Point", "coordinates": [10.0, 50.0]}, "distanceField": "dist.m", "maxDistance": 3_000_000, "minDistance": 100_000, "query": {"c_acctbal": {"$gt": 0}}}}
    return aggregate(places, [near, {"$project": {"c_custkey": 1, "d": {"$round": ["$dist.m", 1]}}}])


query("geo_center_sphere", "customer", [_PLACE, {"$match": {"location": {"$geoWithin": {"$centerSphere": [[-100.0, 40.0], 0.25]}}}}, {"$project": {"c_custkey": 1}}], f"SELECT c_custkey FROM customer WHERE {_hav(-100.0, 40.0)} <= 0.25 * 6371000.0")
query("geo_near_filter", "customer", [_PLACE, {"$match": {"location": {"$near": {"$geometry": {"type": "Point", "coordinates": [30.0, 10.0]}, "$maxDistance": 2000000}}}}, {"$project": {"c_custkey": 1}}], f"SELECT c_custkey FROM customer WHERE {_hav(30.0, 10.0)} <= 2000000")
# Meridians and the equator are great circles, so this polygon is a box in degrees.
query("geo_polygon", "customer", [_PLACE, {"$match": {"location": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[0.05, 0.0], [60.05, 0.0], [60.05, 80.0], [0.05, 80.0], [0.05, 0.0]]]}}}}}, {"$match": {"$expr": {"$lt": [{"$arrayElemAt": ["$location.coordinates", 1]}, 79]}}}, {"$project": {"c_custkey": 1}}], f"SELECT c_custkey FROM customer WHERE ({_LON}) >= 0.05 AND ({_LON}) <= 60.05 AND ({_LAT}) >= 0 AND ({_LAT}) < 79")


# Words are runs of letters, marks, digits and connectors of all scripts, in the pattern as in the SQL.
@custom("text_tfidf", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS words FROM documents),
c AS (SELECT doc_id, coalesce(len(list_filter(words, lambda x: x = 'the')), 0) AS a, coalesce(len(list_filter(words, lambda x: x = 'license')), 0) AS b FROM w),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round((1 + ln(a)) * (1 + ln(n / da)) + (1 + ln(b)) * (1 + ln(n / db)), 6) AS score FROM c, s WHERE a > 0 AND b > 0""")
def _(spark, sf_dir):
    found = text.search(read(spark, sf_dir, "documents"), "the license", ["text"])
    return found.select("doc_id", F.round("_textScore", 6).alias("score"))


# Every vector whose id is divisible by 20 against all vectors.
@custom("vector_neighbours", """
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
s AS (SELECT query, vec_id, list_inner_product(q.v, r.v) / (q.n * r.n) AS c FROM q, r),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query, rank::INT AS rank, round(greatest(0, least(1, (1 + c) / 2)), 6) AS score FROM k WHERE rank <= 10""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vector.neighbours(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.select("query", "rank", F.round("score", 6).alias("score"))


# ---- writes, schemas, changes, sync


_BUYERS = "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1"


def _buyers(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).withColumn("seg", F.lit("buyer"))


@custom("merge_upsert", f"SELECT c_custkey, c_mktsegment AS seg, n FROM customer LEFT JOIN ({_BUYERS}) ON k = c_custkey")
def _(spark, sf_dir):
    new = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return merge_frames(_buyers(spark, sf_dir), new, ["c_custkey"], "merge", "insert", Context(spark)).select("c_custkey", "seg", "n")


@custom("merge_replace", f"SELECT c_custkey, c_mktsegment AS seg, NULL::BIGINT AS n FROM customer")
def _(spark, sf_dir):
    new = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return merge_frames(_buyers(spark, sf_dir), new, ["c_custkey"], "replace", "insert", Context(spark)).select("c_custkey", "seg", "n")


@custom("merge_keep_discard", f"SELECT k AS c_custkey, 'buyer' AS seg, n FROM ({_BUYERS})")
def _(spark, sf_dir):
    new = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return merge_frames(_buyers(spark, sf_dir), new, ["c_custkey"], "keepExisting", "discard", Context(spark)).select("c_custkey", "seg", "n")


@custom("merge_pipeline", f"SELECT c_custkey, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'buyer+' || c_mktsegment END AS seg, n FROM customer LEFT JOIN ({_BUYERS}) ON k = c_custkey")
def _(spark, sf_dir):
    new = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    change = [{"$set": {"seg": {"$concat": ["$seg", "+", "$$new.seg"]}}}]
    return merge_frames(_buyers(spark, sf_dir), new, ["c_custkey"], change, "insert", Context(spark)).select("c_custkey", "seg", "n")


@custom("update_inc_set", "SELECT p_partkey, p_size + 5 AS p_size, 'new' AS p_type, least(p_retailprice, 1200.0) AS p_retailprice, (len(string_split(p_name, ' ')) + 2)::INT AS n, (p_partkey * 2)::BIGINT AS dbl FROM part")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_retailprice", F.split("p_name", " ").alias("w"), F.col("p_partkey").alias("dbl"))
    change = {"$inc": {"p_size": 5}, "$set": {"p_type": "new"}, "$min": {"p_retailprice": 1200.0}, "$mul": {"dbl": 2}, "$push": {"w": {"$each": ["x", "y"], "$position": 0}}}
    return Update(change).apply(rows).select("p_partkey", "p_size", "p_type", "p_retailprice", F.size("w").alias("n"), "dbl")


@custom("update_array_ops", "SELECT p_partkey, (len(list_filter(string_split(p_name, ' '), lambda x: x <> 'cold')) + 1)::INT AS n, CASE WHEN list_contains(string_split(p_name, ' '), 'cold') THEN 1 ELSE 0 END AS was FROM part")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.array_contains(F.split("p_name", " "), "cold").cast("int").alias("was"))
    out = Update({"$pull": {"w": "cold"}}).apply(rows)
    out = Update({"$addToSet": {"w": {"$each": ["zzz", "zzz"]}}}).apply(out)
    return out.select("p_partkey", F.size("w").alias("n"), "was")


@custom("update_positional", "SELECT p_partkey, (p_size + p_size * 10 + CASE WHEN p_size > 20 THEN 1 ELSE 0 END)::BIGINT AS total FROM part")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array("p_size", F.col("p_size") * 10).alias("a"), F.col("p_size").alias("s"))
    out = Update({"$inc": {"a.$[big]": 1}}, [{"big": {"$gt": 20, "$lt": 200}}]).apply(rows.withColumn("a", F.array("s", F.col("s") * 1000)))
    return out.select("p_partkey", (F.col("a")[0] + F.col("a")[1] - F.col("s") * 990 + F.lit(0)).cast("long").alias("total"))


@custom("schema_validate_counts", "SELECT CASE WHEN p_size > 45 THEN 'p_size: maximum' WHEN NOT starts_with(p_name, 'c') THEN 'p_name: pattern' END AS violation, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf_dir):
    schema = Schema({"bsonType": "object", "required": ["p_partkey"], "properties": {"p_size": {"bsonType": "int", "minimum": 0, "maximum": 45}, "p_name": {"bsonType": "string", "pattern": "^c"}}})
    return schema.check(read(spark, sf_dir, "part")).groupBy("violation").agg(F.count("*").alias("n"))


@custom("schema_combinators", "SELECT p_partkey, ((p_size < 10)::INT + (p_retailprice > 1000)::INT = 1) AND NOT p_size = 7 AS ok FROM part")
def _(spark, sf_dir):
    schema = Schema({"oneOf": [{"properties": {"p_size": {"exclusiveMaximum": 10}}}, {"properties": {"p_retailprice": {"exclusiveMinimum": 1000}}}], "not": {"properties": {"p_size": {"enum": [7]}}, "required": ["p_size"]}})
    return schema.check(read(spark, sf_dir, "part")).select("p_partkey", F.col("is_valid").alias("ok"))


@custom("changestream_match", "SELECT event_type AS operationtype_of, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def _(spark, sf_dir):
    log = oplog.entries(read(spark, sf_dir, "events").withColumnRenamed("event_id", "_id"), "events", "insert")
    found = oplog.events(log, [{"$match": {"operationType": {"$in": ["insert"]}, "fullDocument": {"$regex": '"event_type":"click"'}}}])
    return found.groupBy(F.get_json_object("fullDocument", "$.event_type").alias("operationtype_of")).agg(F.count("*").alias("n"))


# A third of the remote versions is earlier, a third as late as the local ones, which then lose, a third later.
@custom("sync_last_write_wins", "SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 3 = 0 THEN 'local' ELSE 'remote' END AS who, greatest(o_orderkey % 5, o_orderkey % 3) AS hits FROM orders")
def _(spark, sf_dir):
    base = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"))
    local = base.select("_id", F.lit("local").alias("who"), F.lit(1.0).alias("ts"), (F.col("_id") % 5).alias("hits"))
    remote = base.select("_id", F.lit("remote").alias("who"), (F.col("_id") % 3).cast("double").alias("ts"), (F.col("_id") % 3).alias("hits"))
    return conflicts.resolve(local, remote, joins={"hits": conflicts.COUNTER}).select("_id", "who", "hits")


@custom("collation_case_insensitive", "SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY 1")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").filter(collation.equals(F.col("c_mktsegment"), "bUILDing", {"strength": 2}))
    return rows.groupBy(F.lower("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))


# ---- sync: clocks, fields, updates in any order


def _sides(spark, sf_dir):
    """Two versions of every order, with clocks of which some have seen the other and some have not."""
    base = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), "o_orderstatus", "o_orderpriority")
    of = lambda side, a, b: base.select("_id", F.lit(side).alias("who"), F.concat(F.lit(side[0]), "o_orderstatus").alias("status"), F.concat(F.lit(side[0]), "o_orderpriority").alias("priority"), F.lit(1.0).alias("ts"), F.create_map(F.lit("a"), a, F.lit("b"), b).alias("clock"))
    k = F.col("_id")
    return of("local", (k % 3).cast("int"), F.lit(1)), of("remote", F.lit(1), (k % 2 + 1).cast("int"))


# Clocks: local {a: k % 3, b: 1}, remote {a: 1, b: k % 2 + 1}. Concurrent ones have the same latest node and time: the greater document wins.
_CLOCK_WINNER = "CASE WHEN k % 3 <= 1 AND (k % 3 < 1 OR k % 2 = 1) THEN 'remote' WHEN k % 2 = 0 AND k % 3 > 1 THEN 'local' ELSE 'remote' END"


@custom("sync_vector_clocks", f"SELECT k AS _id, {_CLOCK_WINNER} AS who, greatest(k % 3, 1)::INT AS a, (k % 2 + 1)::INT AS b FROM (SELECT o_orderkey AS k FROM orders)")
def _(spark, sf_dir):
    local, remote = _sides(spark, sf_dir)
    found = conflicts.resolve(local, remote, clock="clock")
    return found.select("_id", "who", F.col("clock")["a"].alias("a"), F.col("clock")["b"].alias("b"))


@custom("sync_clocks_either_way", "SELECT count(*) AS n FROM orders")
def _(spark, sf_dir):
    local, remote = _sides(spark, sf_dir)
    one, other = conflicts.resolve(local, remote, clock="clock"), conflicts.resolve(remote, local, clock="clock")
    return one.join(other.select(F.col("_id").alias("i"), F.col("who").alias("w")), (F.col("i") == F.col("_id")) & (F.col("w") == F.col("who"))).agg(F.count("*").alias("n"))


@custom("sync_concurrent", "SELECT o_orderkey % 3 > 1 AND o_orderkey % 2 = 1 AS c, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    local, remote = _sides(spark, sf_dir)
    both = local.join(remote.select(F.col("_id").alias("i"), F.col("clock").alias("r")), F.col("i") == F.col("_id"))
    return both.groupBy(conflicts.concurrent(F.col("clock"), F.col("r")).alias("c")).agg(F.count("*").alias("n"))


@custom("sync_field_merge", "SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 2 = 0 THEN 'l' ELSE 'r' END || o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'l' ELSE 'r' END || o_orderpriority AS priority FROM orders")
def _(spark, sf_dir):
    local, remote = _sides(spark, sf_dir)
    k, none = F.col("_id"), F.array().cast("array<string>")
    local = local.withColumn("changed", F.when(k % 10 == 0, F.array(F.lit("status"), F.lit("priority"))).when(k % 2 == 0, F.array(F.lit("status"))).when(k % 5 == 0, F.array(F.lit("priority"))).otherwise(none))
    remote = remote.withColumn("changed", F.when(k % 2 == 0, F.array(F.lit("priority"))).otherwise(F.array(F.lit("status"))))
    # Where both sides changed the priority of one time, the remote one wins, but for local changes of it alone.
    remote = remote.withColumn("changed", F.when(k % 5 == 0, F.array_remove("changed", "priority")).otherwise(F.col("changed")))
    return conflicts.resolve(local, remote, "field_merge", changed="changed").select("_id", "status", "priority")


@custom("sync_local_and_remote_win", "SELECT o_orderkey AS _id, 'local' AS a, 'remote' AS b FROM orders")
def _(spark, sf_dir):
    local, remote = _sides(spark, sf_dir)
    a, b = (conflicts.resolve(local, remote, s).select("_id", F.col("who").alias(n)) for s, n in (("local_wins", "a"), ("remote_wins", "b")))
    return a.join(b, "_id")


@custom("sync_commutative", "SELECT p_partkey, p_size + 7 AS p_size, least(p_retailprice, 1000.0) AS p_retailprice, array_to_string(list_concat(string_split(p_name, ' '), ['x', 'y', 'x']), ' ') AS words FROM part")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.split("p_name", " ").alias("w"))
    change = conflicts.merged_change({"$inc": {"p_size": 3}, "$push": {"w": {"$each": ["x", "y"]}}, "$min": {"p_retailprice": 1200.0}}, {"$inc": {"p_size": 4}, "$push": {"w": "x"}, "$min": {"p_retailprice": 1000.0}})
    return conflicts.reapplied(rows, change).select("p_partkey", "p_size", "p_retailprice", F.array_join("w", " ").alias("words"))


# ---- updates: what they make of whole documents

_WORDS = "string_split(p_name, ' ')"


def _parts(spark, sf_dir, *more):
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_name", F.split("p_name", " ").alias("w"), *more)


@custom("update_set_on_insert", "SELECT p_partkey, 'made' AS p_type, p_size + 1 AS p_size, true AS dated FROM part")
def _(spark, sf_dir):
    change = {"$setOnInsert": {"p_type": "made"}, "$inc": {"p_size": 1}, "$currentDate": {"at": True}}
    return Update(change, inserting=True).apply(_parts(spark, sf_dir)).select("p_partkey", "p_type", "p_size", (F.col("at") > F.lit("2020-01-01").cast("timestamp_ntz")).alias("dated"))


@custom("update_not_inserting", "SELECT p_partkey, p_type, p_size + 1 AS p_size FROM part")
def _(spark, sf_dir):
    return Update({"$setOnInsert": {"p_type": "made"}, "$inc": {"p_size": 1}}).apply(_parts(spark, sf_dir)).select("p_partkey", "p_type", "p_size")


@custom("update_unset_max_rename", "SELECT p_partkey, NULL::VARCHAR AS p_type, greatest(p_size, 30)::INT AS p_size, p_name AS title FROM part")
def _(spark, sf_dir):
    return Update({"$unset": {"p_type": ""}, "$max": {"p_size": 30}, "$rename": {"p_name": "title"}}).apply(_parts(spark, sf_dir)).select("p_partkey", "p_type", "p_size", "title")


@custom("update_pop_bit", f"SELECT p_partkey, array_to_string({_WORDS}[2:], ' ') AS w, array_to_string({_WORDS}[:len({_WORDS}) - 1], ' ') AS v, xor((p_size | 6) & 13, 1)::INT AS bits FROM part")
def _(spark, sf_dir):
    rows = _parts(spark, sf_dir, F.split("p_name", " ").alias("v"))
    out = Update({"$pop": {"w": -1, "v": 1}, "$bit": {"p_size": {"or": 6, "and": 13, "xor": 1}}}).apply(rows)
    return out.select("p_partkey", F.array_join("w", " ").alias("w"), F.array_join("v", " ").alias("v"), F.col("p_size").alias("bits"))


@custom("update_push_sort_slice", f"SELECT p_partkey, array_to_string(list_sort(list_concat({_WORDS}, ['m', 'zz']))[:3], ' ') AS w, array_to_string(list_concat({_WORDS}, ['q'])[-2:], ' ') AS v FROM part")
def _(spark, sf_dir):
    rows = _parts(spark, sf_dir, F.split("p_name", " ").alias("v"))
    out = Update({"$push": {"w": {"$each": ["zz", "m"], "$sort": 1, "$slice": 3}, "v": {"$each": ["q"], "$slice": -2}}}).apply(rows)
    return out.select("p_partkey", F.array_join("w", " ").alias("w"), F.array_join("v", " ").alias("v"))


@custom("update_array_contents", f"SELECT p_partkey, array_to_string(list_concat(list_filter({_WORDS}, lambda x: x <> 'cold'), ['zzz']), ' ') AS w FROM part")
def _(spark, sf_dir):
    out = Update({"$pull": {"w": "cold"}}).apply(_parts(spark, sf_dir))
    return Update({"$addToSet": {"w": {"$each": ["zzz", "zzz"]}}}).apply(out).select("p_partkey", F.array_join("w", " ").alias("w"))


@custom("update_all_elements", "SELECT p_partkey, (p_size + 10)::INT AS a, (2 * p_size + 10)::INT AS b FROM part")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array("p_size", F.col("p_size") * 2).alias("n"))
    return Update({"$inc": {"n.$[]": 10}}).apply(rows).select("p_partkey", F.col("n")[0].alias("a"), F.col("n")[1].alias("b"))


@custom("update_first_match", "SELECT p_partkey, CASE WHEN p_size > 20 THEN 0 ELSE p_size END::INT AS a, CASE WHEN p_size <= 20 AND p_size + 5 > 20 THEN 0 ELSE p_size + 5 END::INT AS b FROM part")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array(F.struct(F.col("p_size").alias("q")), F.struct((F.col("p_size") + 5).alias("q"))).alias("items"))
    out = Update({"$set": {"items.$.q": 0}}, query={"items.q": {"$gt": 20}}).apply(rows)
    return out.select("p_partkey", F.col("items")[0]["q"].alias("a"), F.col("items")[1]["q"].alias("b"))


@custom("update_pipeline", f"SELECT p_partkey, len({_WORDS})::INT AS n, (p_size * 2)::BIGINT AS twice FROM part")
def _(spark, sf_dir):
    change = [{"$set": {"n": {"$size": "$w"}, "twice": {"$multiply": ["$p_size", 2]}}}, {"$unset": ["w", "p_size"]}, {"$project": {"p_partkey": 1, "n": 1, "twice": 1}}]
    return Update(change).apply(_parts(spark, sf_dir))


# ---- schemas: each keyword by itself


def _schema_query(name, schema, sql):
    @custom(name, f"SELECT p_partkey, {sql} AS ok FROM part")
    def _(spark, sf_dir):
        rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"), F.split("p_name", " ").alias("w"), F.array(F.col("p_size") % 3, F.col("p_size") % 2).alias("n"))
        return Schema(schema).check(rows).select("p_partkey", F.col("is_valid").alias("ok"))


_schema_query("schema_min_properties", {"minProperties": 6}, "p_size > 25")
_schema_query("schema_max_properties", {"maxProperties": 5}, "p_size <= 25")
_schema_query("schema_all_of", {"allOf": [{"properties": {"p_size": {"minimum": 10}}}, {"properties": {"p_name": {"pattern": "^[a-m]"}}}]}, "p_size >= 10 AND regexp_matches(p_name, '^[a-m]')")
_schema_query("schema_any_of", {"anyOf": [{"properties": {"p_size": {"maximum": 10}}}, {"properties": {"p_name": {"pattern": "^[a-m]"}}}]}, "p_size <= 10 OR regexp_matches(p_name, '^[a-m]')")
_schema_query("schema_lengths", {"properties": {"p_name": {"minLength": 9, "maxLength": 10}}}, "length(p_name) BETWEEN 9 AND 10")
_schema_query("schema_items", {"properties": {"n": {"minItems": 2, "maxItems": 2, "uniqueItems": True, "items": {"bsonType": "int", "maximum": 1}}}}, "p_size % 3 <> p_size % 2 AND p_size % 3 <= 1")
_schema_query("schema_max_items", {"properties": {"w": {"maxItems": 1}}}, f"len({_WORDS}) <= 1")
_schema_query("schema_closed", {"additionalProperties": False, "properties": {"p_partkey": {}, "p_name": {}, "p_size": {}, "w": {}, "n": {}}}, "p_size <= 25")
_schema_query("schema_required_enum", {"required": ["p_type"], "properties": {"p_size": {"enum": [26, 30, 40]}}}, "p_size IN (26, 30, 40)")

# ---- places: other operators and shapes

query("geo_near_sphere", "customer", [_PLACE, {"$match": {"location": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [30.0, 10.0]}, "$minDistance": 500000, "$maxDistance": 2000000}}}}, {"$project": {"c_custkey": 1}}], f"SELECT c_custkey FROM customer WHERE {_hav(30.0, 10.0)} BETWEEN 500000 AND 2000000")
_BOX = lambda a, b, c: [[a, 0.0], [b, 0.0], [b, c], [a, c], [a, 0.0]]
query("geo_multipolygon", "customer", [_PLACE, {"$match": {"location": {"$geoWithin": {"$geometry": {"type": "MultiPolygon", "coordinates": [[_BOX(0.05, 40.05, 80.0)], [_BOX(100.05, 140.05, 80.0)]]}}}}}, {"$match": {"$expr": {"$lt": [{"$arrayElemAt": ["$location.coordinates", 1]}, 79]}}}, {"$project": {"c_custkey": 1}}], f"SELECT c_custkey FROM customer WHERE (({_LON}) BETWEEN 0.05 AND 40.05 OR ({_LON}) BETWEEN 100.05 AND 140.05) AND ({_LAT}) >= 0 AND ({_LAT}) < 79")
query("geo_intersects", "customer", [_PLACE, {"$match": {"location": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [_BOX(170.05, -170.05, 80.0)]}}}}}, {"$match": {"$expr": {"$lt": [{"$arrayElemAt": ["$location.coordinates", 1]}, 79]}}}, {"$project": {"c_custkey": 1}}], f"SELECT c_custkey FROM customer WHERE (({_LON}) >= 170.05 OR ({_LON}) <= -170.05) AND ({_LAT}) >= 0 AND ({_LAT}) < 79")
query("geo_polygon_hole", "customer", [_PLACE, {"$match": {"location": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [_BOX(0.05, 60.05, 80.0), [[20.05, 0.0], [40.05, 0.0], [40.05, 79.9], [20.05, 79.9], [20.05, 0.0]]]}}}}}, {"$match": {"$expr": {"$and": [{"$lt": [{"$arrayElemAt": ["$location.coordinates", 1]}, 79]}, {"$gt": [{"$arrayElemAt": ["$location.coordinates", 1]}, 0]}]}}}, {"$project": {"c_custkey": 1}}], f"SELECT c_custkey FROM customer WHERE ({_LON}) BETWEEN 0.05 AND 60.05 AND NOT ({_LON}) BETWEEN 20.05 AND 40.05 AND ({_LAT}) > 0 AND ({_LAT}) < 79")

# ---- windows: ranges, contents, all rows

query("win_range_numbers", "part", [{"$setWindowFields": {"partitionBy": "$p_brand", "sortBy": {"p_size": 1}, "output": {"near": {"$sum": 1, "window": {"range": [-3, 2]}}, "s": {"$sum": "$p_size", "window": {"range": ["unbounded", "current"]}}}}}, {"$project": {"p_partkey": 1, "near": 1, "s": 1}}], "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near, (sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE UNBOUNDED PRECEDING))::BIGINT AS s FROM part")
query("win_range_days", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1}, "output": {"n": {"$count": {}, "window": {"range": [-30, "current"], "unit": "day"}}, "hi": {"$max": "$o_totalprice", "window": {"range": [-52, 52], "unit": "week"}}}}}, {"$project": {"o_orderkey": 1, "n": 1, "hi": 1}}], "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND INTERVAL 364 DAYS FOLLOWING) AS hi FROM orders")
query("win_push_contents", "orders", [{"$setWindowFields": {**_W, "output": {"seen": {"$push": "$o_orderkey", "window": {"documents": [-2, "current"]}}}}}, {"$project": {"o_orderkey": 1, "seen": _JOIN3("$seen")}}], "SELECT o_orderkey, '|' || array_to_string(list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '|') AS seen FROM orders")
_UP = {"window": {"documents": ["unbounded", "current"]}}
query("win_all_rows", "orders", [{"$setWindowFields": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": {"n": {"$documentNumber": {}}, "run": {"$sum": "$o_orderkey", **_UP}, "lo": {"$min": "$o_totalprice", **_UP}, "all": {"$max": "$o_totalprice"}}}}, {"$project": {"o_orderkey": 1, "n": 1, "run": 1, "lo": 1, "all": 1}}], 'SELECT o_orderkey, (row_number() OVER w)::INT AS n, (sum(o_orderkey) OVER w)::BIGINT AS run, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER () AS "all" FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)')
query("win_all_ranks", "lineitem", [{"$setWindowFields": {"sortBy": {"l_quantity": 1, "l_returnflag": -1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "r": 1, "d": 1}}], "SELECT l_orderkey, l_linenumber, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS d FROM lineitem WINDOW w AS (ORDER BY l_quantity, l_returnflag DESC)")

# ---- joins: what the arrays hold

_KEYS = lambda f, x: {"$reduce": {"input": {"$map": {"input": f, "as": "x", "in": {"$toString": x}}}, "initialValue": "", "in": {"$concat": ["$$value", "|", "$$this"]}}}


@custom("lookup_nest_contents", "SELECT n_nationkey, coalesce(string_agg(s_name, '|' ORDER BY s_name), '') AS names, count(s_suppkey)::INT AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf_dir):
    found = aggregate(read(spark, sf_dir, "nation"), [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}], lambda n: read(spark, sf_dir, n))
    return found.select("n_nationkey", F.array_join(F.array_sort(F.transform("s", lambda x: x["s_name"])), "|").alias("names"), F.size("s").alias("n"))


query("lookup_pipeline_contents", "customer", [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "pipeline": [*_BIG, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 3}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "as": "big"}}, {"$project": {"c_custkey": 1, "keys": _KEYS("$big", "$$x.o_orderkey"), "prices": {"$sum": {"$map": {"input": "$big", "as": "x", "in": {"$round": [{"$multiply": ["$$x.o_totalprice", 100]}, 0]}}}}}}], "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders WHERE o_totalprice > 250000) SELECT c_custkey, coalesce(string_agg('|' || o_orderkey, '' ORDER BY i), '') AS keys, coalesce(sum(round(o_totalprice * 100)), 0)::DOUBLE AS prices FROM customer LEFT JOIN o ON o_custkey = c_custkey AND i <= 3 GROUP BY 1")
query("sort_two_keys", "lineitem", [{"$sort": {"l_shipdate": 1, "l_extendedprice": -1}}, {"$project": {"l_orderkey": 1, "l_shipdate": 1, "l_extendedprice": 1}}], "SELECT l_orderkey, l_shipdate, l_extendedprice FROM lineitem ORDER BY l_shipdate, l_extendedprice DESC")
query("count_filtered", "lineitem", [{"$match": {"l_quantity": {"$gt": 25}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
query("sample_all", "nation", [{"$sample": {"size": 1000}}, {"$group": {"_id": None, "n": {"$sum": 1}, "keys": {"$sum": "$n_nationkey"}}}, {"$project": {"_id": 0, "n": 1, "keys": 1}}], "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation")
query("expr_root_and_current", "nation", [{"$addFields": {"doc": "$$ROOT", "same": "$$CURRENT.n_name", "b": {"$substrBytes": ["$n_name", 1, 3]}}}, {"$project": {"n_nationkey": 1, "name": "$doc.n_name", "same": 1, "b": 1}}], "SELECT n_nationkey, n_name AS name, n_name AS same, substr(n_name, 2, 3) AS b FROM nation")
query("expr_remove", "nation", [{"$project": {"n_nationkey": 1, "low": {"$cond": [{"$lt": ["$n_nationkey", 10]}, "$n_name", "$$REMOVE"]}}}], "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN n_name END AS low FROM nation")

# ---- collections


@custom("coll_out", "SELECT o_orderstatus AS _id, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    db = Database(spark)
    db.register("orders", read(spark, sf_dir, "orders"))
    db["orders"].aggregate([{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$out": "byStatus"}])
    return db["byStatus"].frame()


@custom("coll_distinct", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 100000")
def _(spark, sf_dir):
    db = Database(spark)
    return db.register("orders", read(spark, sf_dir, "orders")).distinct("o_orderpriority", {"o_totalprice": {"$gt": 100000}})


@custom("coll_find", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 5")
def _(spark, sf_dir):
    orders = Database(spark).register("orders", read(spark, sf_dir, "orders"))
    return orders.find_with_options({"o_orderstatus": "F"}, {"sort": {"o_totalprice": -1, "o_orderkey": 1}, "skip": 5, "limit": 30, "projection": {"o_orderkey": 1, "o_totalprice": 1}})


def _changed_parts(spark, sf_dir) -> Database:
    """A collection of all parts after an insert, updates, a replacement and deletes."""
    db = Database(spark)
    parts = db.register("parts", read(spark, sf_dir, "part").select(F.col("p_partkey").alias("_id"), "p_name", "p_size"))
    parts.insert_many([{"_id": -1, "p_name": "added", "p_size": 1}, {"_id": -2, "p_name": "added too", "p_size": 50}])
    parts.update_many({"p_size": {"$lt": 10}}, {"$inc": {"p_size": 100}, "$set": {"p_name": "small"}})
    parts.replace_one({"_id": -1}, {"p_name": "replaced", "p_size": 7})
    parts.update_one({"_id": -3}, {"$set": {"p_size": 3}}, upsert=True)
    parts.delete_many({"p_size": {"$gte": 40, "$lt": 100}})
    return db


_CHANGED = """WITH a AS (SELECT p_partkey AS _id, p_name, p_size FROM part UNION ALL VALUES (-1, 'added', 1), (-2, 'added too', 50)),
b AS (SELECT _id, CASE WHEN p_size < 10 THEN 'small' ELSE p_name END AS p_name, CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END AS p_size FROM a),
c AS (SELECT _id, CASE WHEN _id = -1 THEN 'replaced' ELSE p_name END AS p_name, CASE WHEN _id = -1 THEN 7 ELSE p_size END AS p_size FROM b UNION ALL VALUES (-3, NULL, 3))"""


@custom("coll_changes", _CHANGED + " SELECT _id, p_name, p_size::INT AS p_size FROM c WHERE NOT (p_size >= 40 AND p_size < 100)")
def _(spark, sf_dir):
    return _changed_parts(spark, sf_dir)["parts"].frame()


@custom("coll_change_log", _CHANGED + """ SELECT * FROM (VALUES ('insert', 3), ('replace', 1)) v(op, n) UNION ALL SELECT 'update', count(*) FROM a WHERE p_size < 10 UNION ALL SELECT 'delete', count(*) FROM c WHERE p_size >= 40 AND p_size < 100""")
def _(spark, sf_dir):
    found = _changed_parts(spark, sf_dir)["parts"].aggregate([{"$changeStream": {}}, {"$group": {"_id": "$operationType", "n": {"$sum": 1}}}])
    return found.select(F.col("_id").alias("op"), "n")


@custom("coll_changed_fields", _CHANGED + " SELECT CASE WHEN p_name = 'small' THEN 'p_size' ELSE 'p_name,p_size' END AS fields, count(*) AS n FROM a WHERE p_size < 10 GROUP BY 1")
def _(spark, sf_dir):
    db = _changed_parts(spark, sf_dir)
    log = oplog.read_from(spark, db["parts"].log_path).filter("op = 'update'")
    return log.groupBy(F.array_join(F.array_sort("changed_fields"), ",").alias("fields")).agg(F.count("*").alias("n"))


@custom("collation_strength_one", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(collation.equals(F.col("c_mktsegment"), "bUÍLDING", {"strength": 1})).agg(F.count("*").alias("n"))


@custom("collation_numeric", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey)::INT AS place FROM supplier")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"))
    named = rows.withColumn("name", collation.key(F.col("name"), {"numericOrdering": True}))
    return aggregate(named, [{"$setWindowFields": {"sortBy": {"name": 1}, "output": {"place": {"$documentNumber": {}}}}}, {"$project": {"s_suppkey": 1, "place": 1}}])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pricing_summary"](spark, sf_dir)
