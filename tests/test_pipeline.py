"""Stages, expressions and accumulators on small fixtures."""

import datetime as dt

import pytest

from strandql.plans.pipeline import aggregate
from strandql.plans.values import PipelineError

PEOPLE = [
    ("a", "Mira", 52, "Oslo", "lab", ["fir", "elm"], 61200), ("b", "Tarek", 19, "Bern", "lab", ["oak", "ash"], 48400), ("c", "Noor", 61, "Oslo", "desk", ["fir"], 88800),
    ("d", "Pavel", 23, "Riga", "shop", ["yew"], 39900), ("e", "Lucia", 37, "Bern", "lab", ["fir", "box"], 72500), ("f", "Odile", 44, "Turin", "lab", ["elm", "plum"], 66000),
    ("g", "Ansel", 30, "Oslo", "field", ["fir", "sloe"], 57300), ("h", "Bruna", 66, "Bern", "desk", ["sorb"], 90500), ("i", "Imre", 26, "Riga", "shop", ["pine"], 41100), ("j", "Quinn", 41, "Oslo", "lab", ["lime"], 68700),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "_id string, name string, age int, city string, dept string, tags array<string>, salary long")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def run(df, *stages, **others):
    return rows(aggregate(df, list(stages), others))


def one(spark, doc_schema, doc, expr):
    df = spark.createDataFrame([doc], doc_schema)
    return rows(aggregate(df, [{"$project": {"_id": 0, "x": expr}}]))[0]["x"]


def names(found):
    return sorted(r["name"] for r in found)


@pytest.mark.parametrize(
    "query,expected",
    [
        ({"city": "Riga"}, ["Imre", "Pavel"]),
        ({"age": {"$gte": 61}}, ["Bruna", "Noor"]),
        ({"age": {"$gt": 22, "$lt": 30}}, ["Imre", "Pavel"]),
        ({"tags": {"$in": ["fir"]}}, ["Ansel", "Lucia", "Mira", "Noor"]),
        ({"tags": {"$all": ["fir", "elm"]}}, ["Mira"]),
        ({"tags": {"$size": 1}}, ["Bruna", "Imre", "Noor", "Pavel", "Quinn"]),
        ({"tags": {"$elemMatch": {"$regex": "^s"}}}, ["Ansel", "Bruna"]),
        ({"name": {"$regex": "^[a-l]", "$options": "i"}}, ["Ansel", "Bruna", "Imre", "Lucia"]),
        ({"$or": [{"age": 66}, {"dept": "field"}]}, ["Ansel", "Bruna"]),
        ({"$nor": [{"age": {"$lt": 60}}]}, ["Bruna", "Noor"]),
        ({"dept": {"$not": {"$in": ["lab", "desk", "shop"]}}}, ["Ansel"]),
        ({"missing": None, "age": 66}, ["Bruna"]),
        ({"missing": {"$exists": True}}, []),
        ({"age": {"$lt": "text"}, "city": "Turin"}, ["Odile"]),
        ({"tags": "fir"}, []),
        ({"salary": {"$mod": [1000, 500]}}, ["Bruna", "Lucia"]),
        ({"$expr": {"$gt": ["$salary", {"$multiply": ["$age", 1700]}]}}, None),
        ({"$text": {"$search": "bern DESK"}}, ["Bruna"]),
        ({"$comment": "all of Riga", "city": {"$eq": "Riga"}}, ["Imre", "Pavel"]),
    ],
)
def test_filters(people, query, expected):
    found = names(run(people, {"$match": query}))
    if expected is None:
        expected = sorted(p[1] for p in PEOPLE if p[6] > p[2] * 1700)
    assert found == expected


@pytest.mark.parametrize("query", [{"age": {"$near_by": 1}}, {"$bad": 1}, {"age": {"$mod": [0, 1]}}, {"$and": [1]}])
def test_bad_filters(people, query):
    with pytest.raises(PipelineError):
        aggregate(people, [{"$match": query}])


def test_bits(spark):
    df = spark.createDataFrame([(1, 0b10101010)], "_id int, flags int")
    for query, hit in (({"$bitsAllSet": [1, 3]}, True), ({"$bitsAllSet": 1}, False), ({"$bitsAnySet": 3}, True), ({"$bitsAllClear": [0, 2]}, True), ({"$bitsAnyClear": 2}, False)):
        assert bool(run(df, {"$match": {"flags": query}})) == hit


def test_sort_skip_limit_keep_order(people):
    found = run(people, {"$sort": {"dept": 1, "salary": -1}}, {"$skip": 1}, {"$limit": 3}, {"$project": {"name": 1}})
    assert [r["name"] for r in found] == ["Noor", "Ansel", "Lucia"]


def test_group_empty_input_has_no_row_but_count_has(people):
    nothing = {"$match": {"age": {"$gt": 99}}}
    assert run(people, nothing, {"$group": {"_id": None, "n": {"$sum": 1}}}) == []
    assert run(people, nothing, {"$count": "n"}) == [{"n": 0}]


def test_ordered_accumulators_follow_the_sort(people):
    found = run(people, {"$sort": {"salary": -1}}, {"$group": {"_id": "$city", "first": {"$first": "$name"}, "last": {"$last": "$name"}, "all": {"$push": "$name"}, "two": {"$firstN": {"n": 2, "input": "$name"}}, "end": {"$lastN": {"n": 1, "input": "$name"}}}})
    oslo = next(r for r in found if r["_id"] == "Oslo")
    assert oslo == {"_id": "Oslo", "first": "Noor", "last": "Ansel", "all": ["Noor", "Quinn", "Mira", "Ansel"], "two": ["Noor", "Quinn"], "end": ["Ansel"]}


def test_top_and_bottom(spark):
    df = spark.createDataFrame([(1, "lab", 31), (2, "lab", 17), (3, "lab", 24), (4, "lab", 9)], "_id int, dept string, score int")
    out = {"sortBy": {"score": -1}, "output": "$score"}
    found = run(df, {"$group": {"_id": "$dept", "t": {"$top": out}, "b": {"$bottom": out}, "tn": {"$topN": {**out, "n": 2}}, "bn": {"$bottomN": {**out, "n": 2}}}})
    assert found == [{"_id": "lab", "t": 31, "b": 9, "tn": [31, 24], "bn": [9, 17]}]


def test_nulls_in_accumulators(spark):
    df = spark.createDataFrame([(1, 14), (2, None), (3, 6)], "_id int, v int")
    found = run(df, {"$group": {"_id": None, "lo": {"$min": "$v"}, "hi": {"$max": "$v"}, "mean": {"$avg": "$v"}, "all": {"$push": "$v"}, "set": {"$addToSet": "$v"}, "s": {"$sum": "$v"}, "none": {"$sum": "$missing"}}})
    assert found == [{"_id": None, "lo": 6, "hi": 14, "mean": 10.0, "all": [14, None, 6], "set": [14, None, 6], "s": 20, "none": 0.0}]


def test_count_of_a_set_counts_its_null(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "a"), (2, None)], "k int, v string")
    found = run(df, {"$group": {"_id": "$k", "s": {"$addToSet": "$v"}}}, {"$project": {"n": {"$size": "$s"}}}, {"$sort": {"_id": 1}})
    assert found == [{"_id": 1, "n": 2}, {"_id": 2, "n": 1}]


def test_merge_objects_accumulator(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, "z", None)], "_id int, a string, b string")
    found = run(df, {"$sort": {"_id": 1}}, {"$group": {"_id": None, "m": {"$mergeObjects": {"a": "$a", "b": "$b"}}}})
    assert found[0]["m"] == {"a": "z", "b": "y"}


def test_unwind(spark):
    df = spark.createDataFrame([("Una", ["p", "q"]), ("Vic", []), ("Wes", None)], "name string, tags array<string>")
    assert [(r["tags"], r["i"]) for r in run(df, {"$unwind": {"path": "$tags", "includeArrayIndex": "i"}})] == [("p", 0), ("q", 1)]
    assert len(run(df, {"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}})) == 4
    assert len(run(df, {"$unwind": "$name"})) == 3


def test_unwind_keeps_the_order_for_push(spark):
    df = spark.createDataFrame([(2, ["c", "d"]), (1, ["a", "b"])], "_id int, t array<string>")
    assert run(df, {"$sort": {"_id": 1}}, {"$unwind": "$t"}, {"$group": {"_id": None, "t": {"$push": "$t"}}})[0]["t"] == ["a", "b", "c", "d"]


def test_buckets(spark):
    df = spark.createDataFrame([(s,) for s in (4, 12, 30, 33, 59, 80, 300)], "score int")
    found = run(df, {"$bucket": {"groupBy": "$score", "boundaries": [0, 10, 30, 60, 90, 120]}})
    assert [(r["_id"], r["count"]) for r in found] == [(0.0, 1), (10.0, 1), (30.0, 3), (60.0, 1), (90.0, 0)]
    vals = spark.createDataFrame([(v,) for v in range(30)], "val int")
    found = run(vals, {"$bucketAuto": {"groupBy": "$val", "buckets": 5}})
    assert [(r["_id"]["min"], r["_id"]["max"], r["count"]) for r in found] == [(0.0, 6.0, 6), (6.0, 12.0, 6), (12.0, 18.0, 6), (18.0, 24.0, 6), (24.0, 29.0, 6)]


def test_facet(people):
    found = run(people, {"$facet": {"total": [{"$count": "n"}], "old": [{"$sort": {"age": -1}}, {"$limit": 2}, {"$project": {"name": 1, "_id": 0}}], "none": [{"$match": {"age": 1}}]}})
    assert found == [{"total": [{"n": 10}], "old": [{"name": "Bruna"}, {"name": "Noor"}], "none": []}]


def test_redact(spark):
    df = spark.createDataFrame([(1, (5, "secret"), [(1, "a"), (9, "b")])], "_id int, inner struct<level:int,text:string>, items array<struct<level:int,t:string>>")
    spec = {"$cond": [{"$gt": [{"$ifNull": ["$level", 0]}, 4]}, "$$PRUNE", "$$DESCEND"]}
    found = run(df, {"$redact": spec})
    assert found == [{"_id": 1, "inner": None, "items": [{"level": 1, "t": "a"}]}]


def test_lookup_rewrites_give_the_same(spark):
    orders = spark.createDataFrame([(1, "kl"), (2, "mn"), (3, None), (4, "zz")], "_id int, product string")
    products = spark.createDataFrame([("kl", 3), ("mn", 8), ("mn", 9), (None, 5)], "_id string, price int")
    spec = {"$lookup": {"from": "products", "localField": "product", "foreignField": "_id", "as": "p"}}
    nested = {r["_id"]: sorted(x["price"] for x in r["p"]) for r in run(orders, spec, products=products)}
    assert nested == {1: [3], 2: [8, 9], 3: [5], 4: []}
    inner = run(orders, spec, {"$unwind": "$p"}, products=products)
    assert sorted((r["_id"], r["p"]["price"]) for r in inner) == [(1, 3), (2, 8), (2, 9), (3, 5)]
    left = run(orders, spec, {"$unwind": {"path": "$p", "preserveNullAndEmptyArrays": True}}, products=products)
    assert len(left) == 5 and next(r for r in left if r["_id"] == 4)["p"] is None
    keep = {"$project": {"_id": 1}}
    assert sorted(r["_id"] for r in run(orders, spec, {"$match": {"p": {"$ne": []}}}, keep, products=products)) == [1, 2, 3]
    assert [r["_id"] for r in run(orders, spec, {"$match": {"p": {"$size": 0}}}, keep, products=products)] == [4]


def test_correlated_lookup(spark):
    users = spark.createDataFrame([(1, 5), (2, 50), (3, 500)], "_id int, floor int")
    sales = spark.createDataFrame([(1, 4), (1, 40), (1, 60), (2, 60), (2, 70)], "user int, amount int")
    spec = {"from": "sales", "let": {"u": "$_id", "f": "$floor"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$user", "$$u"]}, {"$gt": ["$amount", "$$f"]}]}}}, {"$sort": {"amount": -1}}, {"$limit": 1}, {"$project": {"_id": 0, "amount": 1}}], "as": "best"}
    assert {r["_id"]: r["best"] for r in run(users, {"$lookup": spec}, sales=sales)} == {1: [{"amount": 60}], 2: [{"amount": 70}], 3: []}


def test_graph_lookup_ends_on_cycles(spark):
    people = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "name string, boss string")
    spec = {"from": "people", "startWith": "$boss", "connectFromField": "boss", "connectToField": "name", "as": "chain", "depthField": "depth"}
    found = {r["name"]: [(c["name"], c["depth"]) for c in r["chain"]] for r in run(people, {"$graphLookup": spec}, people=people)}
    assert found == {"a": [("b", 0), ("c", 1), ("a", 2)], "b": [("c", 0), ("a", 1), ("b", 2)], "c": [("a", 0), ("b", 1), ("c", 2)], "d": []}
    near = {r["name"]: len(r["chain"]) for r in run(people, {"$graphLookup": {**spec, "maxDepth": 1}}, people=people)}
    assert near == {"a": 2, "b": 2, "c": 2, "d": 0}


def test_windows(spark):
    df = spark.createDataFrame([(1, 7), (2, 4), (3, 4), (4, 1)], "_id int, score int")
    found = run(df, {"$setWindowFields": {"sortBy": {"score": 1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}, "n": {"$documentNumber": {}}}}})
    assert [(r["r"], r["d"], r["n"]) for r in found] == [(1, 1, 1), (2, 2, 2), (2, 2, 3), (4, 3, 4)]
    v = spark.createDataFrame([(4,), (5,), (9,)], "v int")
    found = run(v, {"$setWindowFields": {"sortBy": {"v": 1}, "output": {"p": {"$shift": {"output": "$v", "by": -1, "default": -1}}, "s": {"$sum": "$v", "window": {"documents": ["unbounded", "current"]}}, "f": {"$first": "$v"}, "l": {"$last": "$v"}, "seen": {"$push": "$v", "window": {"documents": [-1, 0]}}, "near": {"$sum": "$v", "window": {"range": [-1, 0]}}}}})
    assert [(r["p"], r["s"], r["f"], r["l"], r["seen"], r["near"]) for r in found] == [(-1, 4, 4, 9, [4], 4), (4, 9, 4, 9, [4, 5], 9), (5, 18, 4, 9, [5, 9], 9)]


def test_vectors(spark):
    df = spark.createDataFrame([("m", [0.0, 2.0, 0.0], "p"), ("n", [0.3, 1.8, 0.1], "p"), ("o", [4.0, 0.0, 0.5], "q"), ("r", [1.0], "q")], "_id string, embedding array<double>, label string")
    spec = {"path": "embedding", "queryVector": [0, 2, 0], "limit": 2}
    assert [r["_id"] for r in run(df, {"$vectorSearch": spec})] == ["m", "n"]
    assert [r["_id"] for r in run(df, {"$vectorSearch": {**spec, "filter": {"label": "q"}}})] == ["o"]
    assert run(df, {"$vectorSearch": {**spec, "similarity": "euclidean", "limit": 1}})[0]["_vectorScore"] == 1.0


CITIES = [("Oslo", [10.75, 59.91]), ("Bern", [7.45, 46.95]), ("Riga", [24.11, 56.95]), ("Turin", [7.69, 45.07]), ("Quito", [-78.5, -0.2])]


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame([(n, ("Point", c)) for n, c in CITIES], "name string, location struct<type:string,coordinates:array<double>>")


def test_geo(cities, spark):
    near = {"$geoNear": {"near": {"type": "Point", "coordinates": [7.5, 46.9]}, "distanceField": "d", "maxDistance": 300_000}}
    found = run(cities, near)
    assert [r["name"] for r in found] == ["Bern", "Turin"] and 5_000 < found[0]["d"] < 8_000
    assert names(run(cities, {"$match": {"location": {"$geoWithin": {"$centerSphere": [[10.8, 59.9], 500 / 6371]}}}})) == ["Oslo"]
    assert names(run(cities, {"$match": {"location": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [8, 46]}, "$maxDistance": 400_000}}}})) == ["Bern", "Turin"]
    ring = [[5, 40], [30, 40], [30, 50], [5, 50], [5, 40]]
    for own in (ring, ring[::-1]):
        assert names(run(cities, {"$match": {"location": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [own]}}}}})) == ["Bern", "Turin"]


def test_polygon_with_hole(spark):
    outer = [[10, 60], [12, 60], [12, 62], [10, 62], [10, 60]]
    hole = [[10.8, 60.8], [11.2, 60.8], [11.2, 61.2], [10.8, 61.2], [10.8, 60.8]]
    df = spark.createDataFrame([("in hole", [11.0, 61.0]), ("in", [11.6, 60.5]), ("out", [13.0, 61.0]), ("other side", [-169.0, -61.0])], "name string, location array<double>")
    geometry = {"type": "Polygon", "coordinates": [outer, hole]}
    assert names(run(df, {"$match": {"location": {"$geoWithin": {"$geometry": geometry}}}})) == ["in"]
    with pytest.raises(PipelineError):
        aggregate(df, [{"$match": {"location": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [outer[:-1]]}}}}}])


def test_poles_and_the_date_line(spark):
    df = spark.createDataFrame([("pole", [0.0, 89.5]), ("west", [-179.5, 10.0]), ("east", [179.5, 10.0]), ("far", [0.0, 10.0])], "name string, location array<double>")
    cap = [[0, 80], [90, 80], [180, 80], [-90, 80], [0, 80]]
    line = [[179, 0], [-179, 0], [-179, 20], [179, 20], [179, 0]]
    two = {"type": "MultiPolygon", "coordinates": [[cap], [line]]}
    assert names(run(df, {"$match": {"location": {"$geoWithin": {"$geometry": two}}}})) == ["east", "pole", "west"]
    near = {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [180, 10]}, "$maxDistance": 100_000}}
    assert names(run(df, {"$match": {"location": near}})) == ["east", "west"]


DOC = "a int, b double, s string, t timestamp_ntz, arr array<int>, o struct<x:int,y:string>"
VALUES = (7, 2.5, "Hello World", dt.datetime(2024, 1, 1, 12, 2, 3), [3, 1, 2], (1, "yy"))


@pytest.mark.parametrize(
    "expr,expected",
    [
        ({"$add": ["$a", 1]}, 8), ({"$add": ["$a", "$b"]}, 9.5), ({"$add": ["$a", None]}, None), ({"$subtract": ["$a", 10]}, -3), ({"$multiply": ["$a", 2]}, 14), ({"$divide": ["$a", 2]}, 3.5), ({"$divide": ["$a", 0]}, None), ({"$mod": [-7, 3]}, -1), ({"$mod": ["$a", 0]}, None),
        ({"$abs": -3}, 3), ({"$ceil": 2.1}, 3.0), ({"$floor": -2.1}, -3.0), ({"$round": [2.5]}, 3.0), ({"$round": ["$b", 0]}, 3.0), ({"$trunc": [-2.57, 1]}, -2.5), ({"$sqrt": -1}, None), ({"$pow": [2, 10]}, 1024), ({"$ln": 0}, None), ({"$log": [8, 2]}, 3.0), ({"$exp": 0}, 1.0), ({"$log10": 100}, 2.0),
        ({"$eq": ["$a", 7.0]}, True), ({"$ne": ["$a", "7"]}, True), ({"$gt": ["$a", None]}, True), ({"$lt": [None, None]}, False), ({"$lte": [None, None]}, True), ({"$gt": ["$s", "$a"]}, True),
        ({"$and": [1, "x", True]}, True), ({"$and": [1, ""]}, False), ({"$or": [0, None, "$a"]}, True), ({"$not": [0]}, True),
        ({"$cond": ["$missing", "yes", "no"]}, "no"), ({"$ifNull": ["$missing", "$a"]}, 7), ({"$switch": {"branches": [{"case": {"$gt": ["$a", 9]}, "then": "big"}]}}, None),
        ({"$substrBytes": ["aé€b", 1, 5]}, "é€"), ({"$substrCP": ["aé€b", 1, 2]}, "é€"), ({"$concat": ["$s", "!"]}, "Hello World!"), ({"$concat": ["$s", "$missing"]}, None), ({"$substr": ["$s", 6, 5]}, "World"), ({"$substr": ["$s", 6, -1]}, "World"), ({"$toUpper": "$s"}, "HELLO WORLD"), ({"$strLenCP": "é€"}, 2), ({"$trim": {"input": "xxhixx", "chars": "x"}}, "hi"), ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]),
        ({"$indexOfCP": ["$s", "o"]}, 4), ({"$indexOfCP": ["$s", "o", 5]}, 7), ({"$indexOfCP": ["$s", "zz"]}, -1), ({"$replaceOne": {"input": "aXbX", "find": "X", "replacement": "-"}}, "a-bX"), ({"$replaceAll": {"input": "aXbX", "find": "X", "replacement": "-"}}, "a-b-"),
        ({"$regexMatch": {"input": "$s", "regex": "world", "options": "i"}}, True), ({"$regexFind": {"input": "$s", "regex": "(o) (W)"}}, {"match": "o W", "idx": 4, "captures": ["o", "W"]}), ({"$regexFind": {"input": "$s", "regex": "zz"}}, None),
        ({"$regexFindAll": {"input": "a1b22", "regex": "[0-9]+"}}, [{"match": "1", "idx": 1, "captures": []}, {"match": "22", "idx": 3, "captures": []}]),
        ({"$type": "$a"}, "int"), ({"$type": "$missing"}, "null"), ({"$toString": "$a"}, "7"), ({"$toInt": "42.9"}, 42), ({"$toInt": "x"}, None), ({"$toDouble": "1.5"}, 1.5), ({"$toBool": "false"}, True), ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1), ({"$toDate": 1583074862000}, dt.datetime(2020, 3, 1, 15, 1, 2)), ({"$toDate": "nonsense"}, None),
        ({"$year": "$t"}, 2024), ({"$dayOfWeek": "$t"}, 2), ({"$dayOfYear": "$t"}, 1), ({"$hour": "$t"}, 12), ({"$second": "$t"}, 3), ({"$year": "$s"}, None), ({"$dateToString": {"date": "$t", "format": "%d.%m.%Y at %H"}}, "01.01.2024 at 12"), ({"$dateFromString": {"dateString": "2024-02-01"}}, dt.datetime(2024, 2, 1)),
        ({"$arrayElemAt": ["$arr", -1]}, 2), ({"$arrayElemAt": ["$arr", 9]}, None), ("$arr.0", 3), ({"$size": "$arr"}, 3), ({"$size": "$s"}, None), ({"$slice": ["$arr", -2]}, [1, 2]), ({"$slice": ["$arr", 1, 1]}, [1]), ({"$slice": ["$arr", 9]}, [3, 1, 2]), ({"$reverseArray": "$arr"}, [2, 1, 3]), ({"$concatArrays": ["$arr", [9]]}, [3, 1, 2, 9]), ({"$concatArrays": ["$arr", "$missing"]}, None),
        ({"$in": [1, "$arr"]}, True), ({"$indexOfArray": ["$arr", 2]}, 2), ({"$indexOfArray": ["$arr", 8]}, -1), ({"$range": [0, 5, 2]}, [0, 2, 4]), ({"$range": [0, 0]}, []), ({"$range": [3, 0, -1]}, [3, 2, 1]), ({"$isArray": "$arr"}, True), ({"$isArray": "$a"}, False), ({"$zip": {"inputs": [[1, 2], [3]]}}, [[1, 3]]), ({"$zip": {"inputs": [[1, 2], [3]], "useLongestLength": True, "defaults": [0, 0]}}, [[1, 3], [2, 0]]),
        ({"$map": {"input": "$arr", "as": "v", "in": {"$add": ["$$v", "$a"]}}}, [10, 8, 9]), ({"$filter": {"input": "$arr", "cond": {"$gt": ["$$this", 1]}}}, [3, 2]), ({"$reduce": {"input": "$arr", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6), ({"$let": {"vars": {"v": 2}, "in": {"$multiply": ["$$v", "$a"]}}}, 14), ({"$sum": ["$a", "$b", "$s"]}, 9.5), ({"$sum": "$arr"}, 6),
        ({"$mergeObjects": ["$o", {"x": 9}]}, {"x": 9, "y": "yy"}), ({"$mergeObjects": ["$o", "$missing"]}, {"x": 1, "y": "yy"}), ({"$objectToArray": "$o"}, [{"k": "x", "v": "1"}, {"k": "y", "v": "yy"}]), ({"$arrayToObject": [[["k", 1], ["k", 2]]]}, {"k": "2"}), ({"$getField": {"field": "y", "input": "$o"}}, "yy"), ({"$setField": {"field": "x", "input": "$o", "value": "$$REMOVE"}}, {"y": "yy"}), ({"$bsonSize": "$o"}, 22), ({"$literal": "$a"}, "$a"), ("$o.y", "yy"), ("$o.zz", None), ("$$ROOT.a", 7),
    ],
)
def test_expressions(spark, expr, expected):
    assert one(spark, DOC, VALUES, expr) == expected


def test_project_and_reshape(people):
    got = run(people, {"$match": {"_id": "a"}}, {"$project": {"name": 1, "work.dept": "$dept", "work.pay": "$salary"}})
    assert got == [{"_id": "a", "name": "Mira", "work": {"dept": "lab", "pay": 61200}}]
    got = run(people, {"$match": {"_id": "a"}}, {"$project": {"tags": 0, "_id": 0, "salary": 0}})
    assert got == [{"name": "Mira", "age": 52, "city": "Oslo", "dept": "lab"}]
    got = run(people, {"$match": {"_id": "a"}}, {"$addFields": {"a.b": 1}}, {"$set": {"a.c": 2}}, {"$unset": ["a.b", "tags"]}, {"$replaceWith": "$a"})
    assert got == [{"c": 2}]


def test_union_with_widens_types(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(2.5, True)], "k double, f boolean")
    assert sorted(map(str, run(a, {"$unionWith": "b"}, b=b))) == sorted(map(str, [{"k": 1.0, "s": "x", "f": None}, {"k": 2.5, "s": None, "f": True}]))


@pytest.mark.parametrize("pipeline", [[{"$nope": 1}], [{"$limit": 0}], [{"$out": "x"}, {"$limit": 1}], [{"$match": {}, "$limit": 1}], [{"$limit": 1}] * 51, [{"$limit": 1}, {"$geoNear": {}}], [{"$group": {"n": {"$sum": 1}}}], [{"$group": {"_id": None, "n": {"$median": 1}}}], [{"$project": {"x": {"$cmp": [1, 2]}}}], [{"$project": {"x": "$$undefined"}}]])
def test_bad_pipelines(people, pipeline):
    with pytest.raises(PipelineError):
        aggregate(people, pipeline)


def test_filters_reach_the_scan(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "people"))
    df = aggregate(spark.read.parquet(str(tmp_path / "people")), [{"$match": {"age": {"$gt": 30}, "city": {"$in": ["Oslo", "Bern"]}}}, {"$project": {"name": 1, "_id": 0}}])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,30)" in plan and "In(city" in plan and "salary" not in plan.split("ReadSchema")[1]
