"""Plans that must hold on many partitions: ranges stored once, windows without a key, joins that carry little."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandql.plans.pipeline import aggregate

SF = "/root/testdata/sf0.01"


@pytest.fixture(params=[8, 200])
def width(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_buckets_on_many_partitions(spark, width):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(64, "l_partkey")
    got = aggregate(rows, [{"$bucketAuto": {"groupBy": "$l_extendedprice", "buckets": 7, "output": {"n": {"$sum": 1}, "q": {"$sum": "$l_quantity"}}}}]).collect()
    want = duckdb.sql(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM '{SF}/lineitem.parquet')
        SELECT min(l_extendedprice), count(*) FROM r GROUP BY floor(i / ceil(n / 7)) ORDER BY 1""").fetchall()
    assert [(r["_id"]["min"], r["n"]) for r in got] == want
    assert [r["_id"]["max"] for r in got[:-1]] == [r["_id"]["min"] for r in got[1:]]


def test_buckets_of_all_equal_and_of_no_rows(spark):
    same = spark.range(100).repartition(16).selectExpr("1.5D AS v", "id")
    got = aggregate(same, [{"$bucketAuto": {"groupBy": "$v", "buckets": 3, "output": {"ids": {"$push": "$id"}, "all": {"$push": "$$ROOT"}}}}]).collect()
    assert [len(r["ids"]) for r in got] == [34, 34, 32] and sum(len(r["all"]) for r in got) == 100
    assert aggregate(same.limit(0), [{"$bucketAuto": {"groupBy": "$v", "buckets": 3}}]).count() == 0


def test_windows_without_a_key(spark, width):
    rows = spark.read.parquet(f"{SF}/part.parquet").repartition(16, "p_partkey")
    up = {"window": {"documents": ["unbounded", "current"]}}
    spec = {"sortBy": {"p_size": -1, "p_brand": 1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}, "n": {"$sum": 1}, "top": {"$max": "$p_retailprice"}}}
    running = {"sortBy": {"p_partkey": 1}, "output": {"k": {"$documentNumber": {}}, "s": {"$sum": "$p_size", **up}, "lo": {"$min": "$p_retailprice", **up}, "m": {"$avg": "$p_size", **up}, "c": {"$count": {}, **up}}}
    df = aggregate(rows, [{"$setWindowFields": spec}, {"$setWindowFields": running}])
    got = {r["p_partkey"]: r for r in df.collect()}
    want = duckdb.sql(f"""SELECT p_partkey, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS d, count(*) OVER () AS n, max(p_retailprice) OVER () AS top, row_number() OVER v AS k,
        (sum(p_size) OVER v)::BIGINT AS s, min(p_retailprice) OVER v AS lo, avg(p_size) OVER v AS m, count(*) OVER v AS c FROM '{SF}/part.parquet'
        WINDOW w AS (ORDER BY p_size DESC, p_brand), v AS (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)""")
    names = want.columns
    for w in want.fetchall():
        r = got[w[0]]
        assert [r[n] for n in names] == pytest.approx(list(w))
    lines = plan(df).split("\n")
    alone = [after for line, after in zip(lines, lines[1:]) if "SinglePartition" in line]
    assert alone and all("HashAggregate" in x for x in alone)  # totals and one row a range, never the rows


def test_nulls_in_windows_without_a_key(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 2), (5, 5)], "_id int, v int").repartition(3)
    up = {"window": {"documents": ["unbounded", "current"]}}
    got = aggregate(rows, [{"$setWindowFields": {"sortBy": {"_id": 1}, "output": {"s": {"$sum": "$v", **up}, "lo": {"$min": "$v", **up}, "m": {"$avg": "$v", **up}}}}]).collect()
    assert [(r["s"], r["lo"], r["m"]) for r in got] == [(0, None, None), (5, 5, 5.0), (5, 5, 5.0), (7, 2, 3.5), (12, 2, 4.0)]
    got = aggregate(rows, [{"$setWindowFields": {"sortBy": {"v": 1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}}}}]).collect()
    assert [(r["v"], r["r"], r["d"]) for r in got] == [(None, 1, 1), (None, 1, 1), (2, 3, 2), (5, 4, 3), (5, 4, 3)]


def test_joins_carry_only_the_fields_asked_for(spark):
    t = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    df = aggregate(t("orders"), [{"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "l"}}, {"$unwind": "$l"}, {"$group": {"_id": "$o_custkey", "q": {"$sum": "$l.l_quantity"}}}], t)
    assert "l_quantity" in plan(df) and "l_shipdate" not in plan(df)
    df = aggregate(t("orders"), [{"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "l"}}, {"$project": {"o_orderkey": 1, "n": {"$size": "$l"}}}], t)
    assert "collect_list" not in plan(df) and "l_shipdate" not in plan(df)
    assert df.agg(F.sum("n")).first()[0] == t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).count()


def test_lookups_that_need_the_array_keep_it(spark):
    t = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    lookup = {"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "x"}}
    got = aggregate(t("region"), [lookup, {"$addFields": {"n": {"$size": "$x"}}}], t).first()
    assert got["n"] == len(got["x"]) == 5 and got["x"][0]["n_name"]
    got = aggregate(t("region"), [lookup, {"$project": {"n": {"$size": "$x"}, "x": 1}}], t).first()
    assert got["n"] == len(got["x"])
    got = aggregate(t("region"), [lookup, {"$unwind": "$x"}, {"$replaceRoot": {"newRoot": "$x"}}], t).first()
    assert set(got.asDict()) == {"n_nationkey", "n_name", "n_regionkey"}


@pytest.mark.parametrize("keys", [{"a": 1}, {"a": -1}, {"s": -1, "a": 1}, {"b": -1, "d": 1, "a": -1}, {"d": -1, "s": 1}])
def test_first_and_last_of_a_sort(spark, keys):
    rows = [(1, 5, "x", True, 1.5), (1, None, "y", False, None), (1, 7, None, None, 2.5), (1, 5, "y", True, -1.0), (2, None, None, None, None), (2, 3, "q", False, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_id int, g int, a int, s string, b boolean, d double").repartition(3).orderBy("_id")
    out = lambda op, **k: {op: {"sortBy": keys, "output": "$_id", **k}}
    got = {r["_id"]: r for r in aggregate(df, [{"$sort": {"_id": 1}}, {"$group": {"_id": "$g", "top": out("$top"), "bottom": out("$bottom"), "t": out("$topN", n=2), "b": out("$bottomN", n=2)}}]).collect()}
    for g in (1, 2):
        want = [r["_id"] for r in aggregate(df.filter(f"g = {g}"), [{"$sort": {**keys, "_id": 1}}]).collect()]
        r = got[g]
        assert (r["top"], r["bottom"], r["t"], r["b"]) == (want[0], want[-1], want[:2], want[::-1][:2])


def test_top_gathers_no_groups(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS v")
    made = aggregate(df, [{"$group": {"_id": "$g", "x": {"$top": {"sortBy": {"v": -1}, "output": "$v"}}}}])
    assert "collect_list" not in plan(made) and {r["_id"]: r["x"] for r in made.collect()} == {0: 99, 1: 97, 2: 98}


def test_facets_share_a_costly_input(spark):
    df = spark.range(50).selectExpr("id % 5 AS g", "id AS v")
    got = aggregate(df, [{"$group": {"_id": "$g", "n": {"$sum": "$v"}}}, {"$sort": {"n": -1}}, {"$facet": {"a": [{"$limit": 2}], "b": [{"$count": "n"}]}}]).first()
    assert [r["_id"] for r in got["a"]] == [4, 3] and got["b"][0]["n"] == 5


def test_parts_of_a_subpipeline_without_variables_run_once(spark):
    t = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    spec = {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$sort": {"n_name": 1}}, {"$limit": 10}, {"$match": {"$expr": {"$eq": ["$n_regionkey", "$$r"]}}}, {"$project": {"n_name": 1}}], "as": "x"}
    got = {r["r_regionkey"]: [x["n_name"] for x in r["x"]] for r in aggregate(t("region"), [{"$lookup": spec}], t).collect()}
    first = sorted((r["n_name"], r["n_regionkey"]) for r in t("nation").collect())[:10]
    assert got == {k: [n for n, r in first if r == k] for k in got}
    spec = {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$count": "n"}], "as": "x"}
    assert [r["x"][0]["n"] for r in aggregate(t("region"), [{"$lookup": spec}], t).collect()] == [25] * 5
