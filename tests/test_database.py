"""Writes, updates, schemas, indexes, change streams and conflict resolution."""

import pytest
from pyspark.sql import functions as F

from strandql.functions import collation
from strandql.operators.update import Update
from strandql.operators.validate import Schema
from strandql.plans.values import PipelineError
from strandql.sources import conflicts
from strandql.sources.database import Database, merge_frames
from strandql.streaming import oplog


def apply(spark, schema, row, change, filters=None, query=None):
    return Update(change, filters, query).apply(spark.createDataFrame([row], schema)).first().asDict(recursive=True)


@pytest.mark.parametrize(
    "change,expected",
    [
        ({"$set": {"a": 5, "o.y": 2}}, {"a": 5, "o": {"x": 1, "y": 2}}),
        ({"$unset": {"a": ""}}, {"a": None}),
        ({"$inc": {"a": 2, "n": 3}}, {"a": 3, "n": 3}),
        ({"$mul": {"a": 4}}, {"a": 4}),
        ({"$min": {"a": 0}, "$max": {"o.x": 9}}, {"a": 0, "o": {"x": 9}}),
        ({"$rename": {"a": "b"}}, {"b": 1}),
        ({"$push": {"t": 7}}, {"t": [3, 1, 7]}),
        ({"$push": {"t": {"$each": [9, 2], "$position": 1, "$sort": 1, "$slice": 3}}}, {"t": [1, 2, 3]}),
        ({"$push": {"t": {"$each": [9], "$slice": -2}}}, {"t": [1, 9]}),
        ({"$addToSet": {"t": {"$each": [1, 4]}}}, {"t": [3, 1, 4]}),
        ({"$pull": {"t": {"$gte": 3}}}, {"t": [1]}),
        ({"$pull": {"t": 1}}, {"t": [3]}),
        ({"$pop": {"t": 1}}, {"t": [3]}),
        ({"$pop": {"t": -1}}, {"t": [1]}),
        ({"$bit": {"a": {"or": 6, "xor": 1}}}, {"a": 6}),
        ({"$inc": {"t.$[]": 10}}, {"t": [13, 11]}),
    ],
)
def test_update_operators(spark, change, expected):
    got = apply(spark, "a int, o struct<x:int>, t array<int>", (1, (1,), [3, 1]), change)
    assert {k: got[k] for k in expected} == expected


def test_positional_updates(spark):
    schema, row = "_id int, items array<struct<sku:string,qty:int>>", (1, [("a", 1), ("b", 2), ("b", 3)])
    got = apply(spark, schema, row, {"$set": {"items.$.qty": 9}}, query={"items.sku": "b"})
    assert [i["qty"] for i in got["items"]] == [1, 9, 3]
    got = apply(spark, schema, row, {"$inc": {"items.$[x].qty": 10}}, filters=[{"x.qty": {"$gt": 1}}])
    assert [i["qty"] for i in got["items"]] == [1, 12, 13]
    got = apply(spark, schema, row, [{"$set": {"n": {"$size": "$items"}}}, {"$unset": "items"}])
    assert got == {"_id": 1, "n": 3}


def test_bad_updates(spark):
    for change in ({"a": 1}, {"$nope": {"a": 1}}, [{"$group": {}}]):
        with pytest.raises(PipelineError):
            Update(change)


def test_crud(spark):
    db = Database(spark)
    c = db.create_collection("people", "_id string, name string, age int")
    assert c.insert_many([{"_id": "1", "name": "Ann", "age": 30}, {"_id": "2", "name": "Bob", "age": 40}, {"_id": "3", "name": "Cy", "age": 50}]).inserted == 3
    got = c.update_many({"age": {"$gte": 40}}, {"$inc": {"age": 1}})
    assert (got.matched, got.modified) == (2, 2)
    assert c.update_one({"age": {"$gt": 0}}, {"$set": {"name": "First"}}).matched == 1
    assert c.update_one({"_id": "9"}, {"$set": {"age": 1}}, upsert=True).upserted == 1
    assert c.find_one({"_id": "9"}) == {"_id": "9", "name": None, "age": 1}
    assert c.replace_one({"_id": "9"}, {"name": "New", "age": 2}).modified == 1
    assert c.find_one_and_update({"_id": "9"}, {"$set": {"age": 3}})["age"] == 2
    assert c.delete_one({"_id": "9"}).deleted == 1 and c.count_documents() == 3
    assert [r["_id"] for r in c.find({}).sort("age", -1).skip(1).limit(1).projection({"_id": 1})] == ["2"]
    assert sorted(r["value"] for r in c.distinct("age").collect()) == [30, 41, 51]
    total = c.bulk_write([{"insertOne": {"document": {"_id": "7", "name": "Z", "age": 7}}}, {"deleteMany": {"filter": {"age": {"$gt": 40}}}}])
    assert (total.inserted, total.deleted) == (1, 2)


def test_unique_and_validator(spark):
    db = Database(spark)
    c = db.create_collection("u", "_id string, age int", {"$jsonSchema": {"required": ["age"], "properties": {"age": {"minimum": 0}}}})
    c.create_index("_id", unique=True)
    c.insert_one({"_id": "1", "age": 1})
    for bad in ({"_id": "1", "age": 2}, {"_id": "2", "age": -1}, {"_id": "3", "age": None}):
        with pytest.raises(PipelineError):
            c.insert_one(bad)
    assert c.count_documents() == 1 and c.list_indexes()["_id"]["unique"]
    c.drop_index("_id")
    c.insert_one({"_id": "1", "age": 2})
    assert c.count_documents({"_id": "1"}) == 2


def test_out_and_merge(spark):
    db = Database(spark)
    db.register("src", spark.createDataFrame([("1", "new"), ("2", "inserted")], "_id string, v string"))
    db.register("target", spark.createDataFrame([("1", "old"), ("5", "kept")], "_id string, v string"))
    db["src"].aggregate([{"$match": {"_id": "1"}}, {"$out": "copy"}])
    assert db["copy"].find({}).to_list() == [{"_id": "1", "v": "new"}]
    db["src"].aggregate([{"$merge": {"into": "target", "whenMatched": "replace"}}])
    assert {r["_id"]: r["v"] for r in db["target"].find({})} == {"1": "new", "2": "inserted", "5": "kept"}


@pytest.mark.parametrize(
    "matched,unmatched,expected",
    [("merge", "insert", {1: ("new", 7), 2: ("ins", None), 5: ("kept", 8)}), ("keepExisting", "discard", {1: ("old", 7), 5: ("kept", 8)}), ("replace", "insert", {1: ("new", None), 2: ("ins", None), 5: ("kept", 8)}), ([{"$set": {"v": {"$concat": ["$v", "+", "$$new.v"]}}}], "insert", {1: ("old+new", 7), 2: ("ins", None), 5: ("kept", 8)})],
)
def test_merge_modes(spark, matched, unmatched, expected):
    from strandql.plans.context import Context

    target = spark.createDataFrame([(1, "old", 7), (5, "kept", 8)], "_id int, v string, w int")
    new = spark.createDataFrame([(1, "new"), (2, "ins")], "_id int, v string")
    got = merge_frames(target, new, ["_id"], matched, unmatched, Context(spark))
    assert {r["_id"]: (r["v"], r["w"]) for r in got.collect()} == expected


def test_merge_can_fail(spark):
    from strandql.plans.context import Context

    target, new = spark.createDataFrame([(1, "a")], "_id int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "_id int, v string")
    for modes in (("fail", "insert"), ("merge", "fail")):
        with pytest.raises(Exception, match="document"):
            merge_frames(target, new, ["_id"], *modes, Context(spark)).collect()


def test_schema_keywords(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2], 5.0, True), (2, "abcdef", [1, 1], 50.0, None)], "_id int, s string, a array<int>, n double, f boolean")
    for spec, ok in (
        ({"properties": {"s": {"minLength": 3}}}, [False, True]), ({"properties": {"s": {"maxLength": 3}}}, [True, False]), ({"properties": {"s": {"pattern": "^abc"}}}, [False, True]), ({"properties": {"a": {"uniqueItems": True}}}, [True, False]), ({"properties": {"a": {"minItems": 3}}}, [False, False]),
        ({"properties": {"a": {"items": {"maximum": 1}}}}, [False, True]), ({"required": ["f"]}, [True, False]), ({"required": ["zz"]}, [False, False]), ({"properties": {"n": {"exclusiveMinimum": 5}}}, [False, True]), ({"properties": {"n": {"enum": [5, 6]}}}, [True, False]), ({"properties": {"s": {"bsonType": "int"}}}, [False, False]),
        ({"anyOf": [{"properties": {"n": {"maximum": 1}}}, {"properties": {"n": {"minimum": 10}}}]}, [False, True]), ({"not": {"properties": {"n": {"minimum": 10}}}}, [True, False]), ({"maxProperties": 4}, [False, True]), ({"additionalProperties": False, "properties": {"s": {}, "a": {}, "n": {}}}, [False, True]),
    ):
        assert [r["is_valid"] for r in Schema(spec).check(df).orderBy("_id").collect()] == ok, spec


def test_change_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    docs = spark.createDataFrame([("1", "a"), ("2", "b")], "_id string, v string")
    oplog.append(docs, path, "things", "insert")
    oplog.append(docs.limit(1), path, "things", "delete")
    oplog.append(docs.limit(1), path, "things", "insert", internal=True)
    stream = oplog.change_stream(spark, path, [{"$match": {"operationType": "insert"}}], ns="things")
    seen = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination(60)
    found = spark.table("seen").collect()
    assert sorted(r["documentKey"]["_id"] for r in found) == ["1", "2"] and all('"v"' in r["fullDocument"] for r in found)
    log = oplog.read_from(spark, path)
    assert [r["op"] for r in log.collect()] == ["insert", "insert", "delete"]
    token = log.collect()[1]
    assert oplog.events(oplog.read_from(spark, path), resume_after={"ts": token["ts"], "seq": token["seq"]}).count() == 1
    assert oplog.read_from(spark, path, (token["ts"], token["seq"]), skip_internal=False).count() == 2


def test_conflicts(spark):
    schema = "_id int, v string, ts double, tags array<string>, clock map<string,int>"
    local = spark.createDataFrame([(1, "l", 2.0, ["a"], {"x": 2}), (2, "l", 1.0, ["a"], {"x": 1}), (3, "only", 1.0, [], {"x": 1})], schema)
    remote = spark.createDataFrame([(1, "r", 1.0, ["b"], {"x": 1}), (2, None, 2.0, ["a", "b"], {"x": 1, "y": 1})], schema)
    get = lambda **k: {r["_id"]: (r["v"], r["tags"]) for r in conflicts.resolve(local, remote, **k).collect()}
    assert get() == {1: ("l", ["a"]), 2: (None, ["a", "b"]), 3: ("only", [])}
    assert get(strategy="remote_wins", joins={"tags": conflicts.UNION})[1] == ("r", ["a", "b"])
    assert get(strategy="field_merge")[2] == ("l", ["a", "b"])
    assert get(clock="clock")[1] == ("l", ["a"])
    both = local.alias("l").join(remote.alias("r"), "_id").select(conflicts.dominates(F.col("r.clock"), F.col("l.clock")).alias("d"))
    assert [r["d"] for r in both.collect()] == [False, True]
    assert {r["_id"]: r["changed"] for r in conflicts.changed_fields(local.drop("clock"), remote.drop("clock")).collect()} == {1: ["v", "ts", "tags"], 2: ["v", "ts", "tags"]}


def test_collation(spark):
    df = spark.createDataFrame([("item10",), ("Item9",), ("ITEM 2",), ("résumé",)], "s string")
    assert df.filter(collation.equals(F.col("s"), "RESUME", {"strength": 1})).count() == 1
    assert df.filter(collation.equals(F.col("s"), "ITEM9", {"strength": 2})).count() == 1
    keyed = df.filter("lower(s) like 'item%'").orderBy(collation.key(F.lower(F.col("s")), {"numericOrdering": True}))
    assert [r["s"] for r in keyed.collect()] == ["ITEM 2", "Item9", "item10"]


# ---- files, logs and cursors


def boats(spark, **options):
    db = Database(spark, **options)
    c = db.register("boats", spark.range(40).selectExpr("cast(id as int) as _id", "concat('boat ', id) as name", "cast(id % 7 as int) as deck").repartition(4, "_id"))
    return db, c


def test_inserts_leave_the_files_and_changes_touch_few(spark):
    db, c = boats(spark)
    c.insert_one({"_id": 100, "name": "new", "deck": 50})
    before = set(c.frame().inputFiles())
    c.insert_one({"_id": 101, "name": "newer", "deck": 51})
    assert before < set(c.frame().inputFiles()) and c.count_documents() == 42
    old = c.frame()
    assert c.update_many({"_id": 100}, {"$set": {"deck": 60}}).modified == 1
    gone = set(old.inputFiles()) - set(c.frame().inputFiles())
    assert len(gone) == 1 and old.filter("deck = 50").count() == 1  # readers of the old version go on
    assert c.find_one({"_id": 100})["deck"] == 60 and c.count_documents() == 42
    assert c.delete_many({"_id": {"$gte": 100}}).deleted == 2 and c.count_documents() == 40


def test_tables_in_folders_by_column(spark, tmp_path):
    path = str(tmp_path / "parted")
    spark.range(12).selectExpr("id as _id", "id % 3 as kind", "'x' as v").write.partitionBy("kind").parquet(path)
    c = Database(spark).read_parquet("parted", path)
    assert c.update_many({"_id": 4}, {"$set": {"v": "y"}}).modified == 1 and c.insert_one({"_id": 50, "kind": 7, "v": "z"}).inserted == 1
    assert sorted((r["kind"], r["v"]) for r in c.find({"_id": {"$in": [4, 5, 50]}})) == [(1, "y"), (2, "x"), (7, "z")]


def test_new_fields_and_wider_types(spark):
    _, c = boats(spark)
    assert c.update_many({"_id": {"$lt": 3}}, {"$set": {"flag": "red"}}).matched == 3
    assert c.update_many({"_id": 1}, {"$mul": {"deck": 2.5}}).matched == 1
    got = {r["_id"]: (r["deck"], r["flag"]) for r in c.find({"_id": {"$in": [1, 2, 30]}})}
    assert got == {1: (2.5, "red"), 2: (2.0, "red"), 30: (2.0, None)}
    assert c.update_many({"_id": 2}, {"$unset": {"flag": ""}}).modified == 1 and c.find_one({"_id": 2})["flag"] is None
    assert c.update_many({"_id": 2}, {"$set": {"deck": 2.0}}).modified == 0


def test_one_change_takes_one_row(spark):
    _, c = boats(spark)
    assert c.update_one({"deck": 3}, {"$set": {"name": "first"}}).matched == 1 and c.count_documents({"name": "first"}) == 1
    assert c.delete_one({"deck": 4}).deleted == 1 and c.count_documents() == 39
    before = c.find_one_and_delete({"deck": 5})
    assert before["deck"] == 5 and c.find_one({"_id": before["_id"]}) is None
    assert c.find_one_and_replace({"_id": 1}, {"name": "other", "deck": 0})["name"] == "boat 1" and c.find_one({"_id": 1})["name"] == "other"
    assert c.find_one_and_update({"_id": 1}, {"$inc": {"deck": 4}}, after=True)["deck"] == 4


def test_every_change_is_logged(spark):
    db, c = boats(spark)
    seen = c.watch(max_await_time_ms=10).writeStream.format("memory").queryName("boat_changes").trigger(availableNow=True)
    c.insert_many([{"_id": 50, "name": "a", "deck": 1}, {"_id": 51, "name": "b", "deck": 2}])
    c.update_one({"_id": 50}, {"$set": {"name": "aa"}, "$inc": {"deck": 0}})
    c.replace_one({"_id": 51}, {"name": "bb", "deck": 9})
    c.bulk_write([{"updateOne": {"filter": {"_id": 52}, "update": {"$set": {"deck": 5}}, "upsert": True}}, {"deleteOne": {"filter": {"_id": 50}}}])
    c.update_many({"_id": 51}, {"$set": {"deck": 9}})  # changes nothing
    seen.start().awaitTermination(60)
    streamed = [(r["operationType"], int(r["documentKey"]["_id"])) for r in spark.table("boat_changes").orderBy("_ts").collect()]
    assert sorted(streamed) == sorted([("insert", 50), ("insert", 51), ("update", 50), ("replace", 51), ("insert", 52), ("delete", 50)])
    events = c.aggregate([{"$changeStream": {}}]).collect()
    assert [r["operationType"] for r in events if r["documentKey"]["_id"] == "50"] == ["insert", "update", "delete"] and events[-1]["fullDocument"] is None
    log = oplog.read_from(spark, c.log_path)
    assert [r["changed_fields"] for r in log.filter("op = 'update'").collect()] == [["name"]]
    token = events[2]["_token"].asDict()
    assert len(c.aggregate([{"$changeStream": {"resumeAfter": token}}, {"$match": {"operationType": "delete"}}]).collect()) == 1
    _, quiet = boats(spark, log=False)
    quiet.insert_one({"_id": 70, "name": "x", "deck": 1})
    assert quiet.aggregate([{"$changeStream": {}}]).count() == 0


def test_merges_are_logged(spark):
    db = Database(spark)
    db.register("src", spark.createDataFrame([("1", "new"), ("2", "ins"), (None, "none")], "_id string, v string"))
    db.register("target", spark.createDataFrame([("1", "old"), ("5", "kept")], "_id string, v string"))
    db["src"].aggregate([{"$merge": {"into": "target"}}])
    events = {(r["operationType"], r["documentKey"]["_id"]) for r in db["target"].aggregate([{"$changeStream": {}}]).collect()}
    assert events == {("update", "1"), ("insert", "2"), ("insert", None)}
    db["src"].aggregate([{"$merge": {"into": "target", "whenMatched": "keepExisting", "whenNotMatched": "discard"}}])
    assert db["target"].aggregate([{"$changeStream": {}}]).count() == 3
    db["src"].aggregate([{"$merge": "fresh"}])
    assert db["fresh"].aggregate([{"$changeStream": {}}]).count() == 3


def test_log_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(5):
        oplog.append(spark.createDataFrame([(f"{k}", k)], "_id string, v int"), path, "n", "insert")
    assert oplog.truncate_count(spark, path, 9) == 0 and oplog.truncate_count(spark, path, 3) == 2
    left = [r["doc_id"] for r in oplog.read_from(spark, path).collect()]
    assert left == ["2", "3", "4"]
    last = oplog.read_from(spark, path).collect()[1]["ts"]
    assert oplog.truncate_before(spark, path, last) == 1 and oplog.read_from(spark, path).count() == 2


def test_transactions_are_all_or_nothing(spark):
    db, c = boats(spark)
    crew = db.create_collection("crew", "_id int, boat int")
    with db.transaction():
        crew.insert_one({"_id": 1, "boat": 3})
        c.update_one({"_id": 3}, {"$set": {"name": "manned"}})
    assert c.find_one({"_id": 3})["name"] == "manned" and crew.count_documents() == 1 and crew.aggregate([{"$changeStream": {}}]).count() == 1
    crew.create_index("_id", unique=True)
    with pytest.raises(PipelineError), db.transaction():
        c.delete_many({"deck": 1})
        c.insert_one({"_id": 300, "name": "x", "deck": 1})
        crew.insert_one({"_id": 1, "boat": 4})
    assert c.count_documents() == 40 and crew.count_documents() == 1 and c.find_one({"_id": 300}) is None
    assert c.aggregate([{"$changeStream": {}}]).count() == 1 and crew.aggregate([{"$changeStream": {}}]).count() == 1
    with pytest.raises(PipelineError), db.transaction(), db.transaction():
        pass
    assert db.pending is None


def test_cursor_places_and_slices(spark):
    _, c = boats(spark)
    cursor = c.find({"deck": {"$lt": 5}}).sort("_id", -1)
    whole = cursor.to_list()
    assert cursor[0] == whole[0] and cursor[-1] == whole[-1] and cursor[2:5] == whole[2:5] and cursor[3:] == whole[3:] and cursor[:6:2] == whole[:6:2] and cursor[-3:] == whole[-3:]
    with pytest.raises(IndexError):
        cursor[999]
    assert len(cursor) == len(whole)


def test_explain_tells_how_documents_are_reached(spark):
    _, c = boats(spark)
    c.create_index("_id")
    c.create_index([("place", 1)], name="places")
    c.create_index("v", type="vectorSearch", vectorSearchOptions={"dimensions": 8, "metric": "cosine"})
    kinds = [({"_id": 3}, "IXSEEK"), ({"_id": {"$gt": 3}}, "IXSCAN"), ({"_id": {"$in": [1, 2]}}, "BITMAP_SCAN"), ({"deck": 3}, "COLLSCAN"), ({"$or": [{"_id": 1}, {"_id": 2}]}, "OR_UNION"), ({"$text": {"$search": "boat"}}, "TEXT_SCAN")]
    for query, kind in kinds:
        assert c.explain(query)["kind"] == kind, query
    assert c.explain([{"$match": {"deck": 1}}, {"$sort": {"_id": 1}}])["kind"] == "IXSCAN_SORTED"
    c.insert_one({"_id": 90, "name": "stored", "deck": 1})
    got = c.explain({"deck": 1}, "executionStats")
    assert got["returned"] == c.count_documents({"deck": 1}) and got["examined"] >= got["returned"]
    found = c.aggregate([{"$listSearchIndexes": {}}]).collect()
    assert [(r["name"], r["latestDefinition"]["fields"][0]["numDimensions"]) for r in found] == [("v", 8)]
    assert c.aggregate([{"$collStats": {}}]).first()["count"] == 41 and c.aggregate([{"$indexStats": {}}, {"$count": "n"}]).first()["n"] == 3


def test_current_operations(spark):
    db, _ = boats(spark)
    assert db.run([{"$currentOp": {}}, {"$match": {"active": True}}]).columns == ["opid", "type", "active"]
    with pytest.raises(PipelineError):
        db.run([{"$match": {}}])


def test_sparse_and_partial_indexes(spark):
    db = Database(spark)
    c = db.create_collection("s", "_id int, code string, live boolean")
    c.insert_many([{"_id": 1, "code": None, "live": True}, {"_id": 2, "code": None, "live": True}, {"_id": 3, "code": "k", "live": False}, {"_id": 4, "code": "k", "live": True}])
    with pytest.raises(PipelineError):
        c.create_index("code", unique=True)
    with pytest.raises(PipelineError):
        c.create_index("code", unique=True, sparse=True)
    c.create_index("code", name="live codes", unique=True, sparse=True, partialFilterExpression={"live": True})
    assert c.rebuild_index("live codes") == 4 and list(c.list_indexes()) == ["live codes"]
    c.insert_one({"_id": 5, "code": "k", "live": False})
    with pytest.raises(PipelineError):
        c.insert_one({"_id": 6, "code": "k", "live": True})
    assert c.count_documents() == 5


def test_reap_takes_old_documents(spark):
    import datetime as dt

    db = Database(spark)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    c = db.register("d", spark.createDataFrame([(1, now - dt.timedelta(hours=2)), (2, now), (3, None)], "_id int, at timestamp_ntz"))
    assert c.reap("at", 3600).deleted == 1 and sorted(r["_id"] for r in c.find({})) == [2, 3] and c.reap("none", 1).deleted == 0


# ---- conflicts from either side


def test_ties_go_to_the_remote_side_and_clocks_to_the_same_from_either(spark):
    schema = "_id int, v string, ts double, clock map<string,int>"
    a = [(1, "p", 5.0, {"x": 2, "y": 1}), (2, "p", 5.0, {"x": 1}), (3, "p", 9.0, {"x": 1, "m": 1}), (4, "p", 5.0, {"x": 3}), (5, "p", 5.0, None)]
    b = [(1, "q", 5.0, {"x": 1, "y": 2}), (2, "q", 5.0, {"z": 1}), (3, "q", 1.0, {"x": 1, "k": 4}), (4, "q", 9.0, {"x": 2}), (5, "q", 5.0, {"x": 1})]
    a, b = (spark.createDataFrame(x, schema) for x in (a, b))
    get = lambda l, r, **k: {x["_id"]: x["v"] for x in conflicts.resolve(l, r, **k).collect()}  # noqa: E731, E741
    assert set(get(a, b).values()) == {"q", "p"} and get(a, b)[1] == "q" and get(b, a)[1] == "p" and get(a, b)[3] == "p"
    one, other = get(a, b, clock="clock"), get(b, a, clock="clock")
    assert {k: v for k, v in one.items() if k < 5} == {k: v for k, v in other.items() if k < 5} == {1: "q", 2: "q", 3: "p", 4: "p"}
    assert one[5] == "q" and other[5] == "p"  # without a clock on both sides time decides, and a tie is the remote side's


def test_field_merge_by_who_changed_what(spark):
    schema = "_id int, a string, b string, c string, d string, ts double, changed array<string>"
    local = spark.createDataFrame([(1, "la", "lb", "lc", "ld", 9.0, ["a", "c"])], schema)
    remote = spark.createDataFrame([(1, "ra", "rb", "rc", None, 3.0, ["b", "c"])], schema)
    got = conflicts.resolve(local, remote, "field_merge", changed="changed").first()
    assert (got["a"], got["b"], got["c"], got["d"]) == ("la", "rb", "lc", "ld") and got["changed"] == ["a", "c", "b"]


def test_commutative_updates(spark):
    assert conflicts.is_commutative({"$inc": {"a": 1}, "$max": {"b": 2}}) and not conflicts.is_commutative({"$set": {"a": 1}}) and not conflicts.is_commutative({})
    got = conflicts.merged_change({"$inc": {"n": 2}, "$addToSet": {"t": {"$each": ["x", "y"]}}, "$max": {"m": 3}}, {"$inc": {"n": 5, "k": 1}, "$addToSet": {"t": "y"}, "$max": {"m": 7}, "$push": {"l": 1}})
    assert got == {"$inc": {"n": 7, "k": 1}, "$push": {"l": {"$each": [1]}}, "$addToSet": {"t": {"$each": ["x", "y"]}}, "$max": {"m": 7}}
    remote = spark.createDataFrame([(1, 10, ["y"])], "_id int, n int, t array<string>")
    assert conflicts.reapplied(remote, {"$inc": {"n": 2}, "$addToSet": {"t": {"$each": ["x", "y"]}}}).first().asDict() == {"_id": 1, "n": 12, "t": ["y", "x"]}
    for bad in (lambda: conflicts.merged_change({"$set": {"a": 1}}, {"$inc": {"a": 1}}), lambda: conflicts.reapplied(remote, {"$set": {"n": 1}})):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("metric", ["cosine", "dotProduct", "euclidean"])
def test_neighbours_of_many_vectors(spark, metric):
    import numpy as np

    from strandql.operators import vector

    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [1.0])], "k long, v array<double>").repartition(5)
    got = vector.neighbours(rows, rows.where("k % 20 = 0"), "k", "v", 4, metric, block=7)
    found = {}
    for r in got.orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r["k"], r["score"]))
    assert len(found) == 15
    for q, near in found.items():
        s = vector.similarity(data[q : q + 1], data, metric)[0]
        want = sorted(range(300), key=lambda i: (-s[i], i))[:4]
        assert [k for k, _ in near] == want and [x for _, x in near] == pytest.approx(s[want])
    assert vector.neighbours(rows.limit(0), rows.where("k = 1"), "k", "v", 4).count() == 0 and vector.neighbours(rows, rows.limit(0), "k", "v", 4).count() == 0


def test_collections_by_name_and_cursor_options(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(6).selectExpr("id as _id", "id % 2 as side").write.json(path)
    db = Database(spark)
    c = db.read_json("rows", path, "_id long, side long")
    assert db.list_collections() == ["rows"] and c.estimated_document_count() == 6
    cursor = c.find({"side": 1}).hint("x").batch_size(5).comment("why").max_time_ms(10).sort([("_id", -1)])
    assert [r["_id"] for r in cursor] == [5, 3, 1] and cursor.ignored == {"hint": "x", "batch_size": 5, "comment": "why", "max_time_ms": 10}
    found = c.find_with_options({}, {"sort": {"side": 1, "_id": -1}, "skip": 1, "limit": 3, "projection": {"_id": 1}}).collect()
    assert [r["_id"] for r in found] == [2, 0, 5]
    names = db.register("names", spark.createDataFrame([("b",), ("A",), ("a",), ("C",)], "s string")).find({})
    assert [r["s"].lower() for r in names.sort("s").collation({"locale": "en", "strength": 2, "caseFirst": "upper"})] == ["a", "a", "b", "c"]
    db.drop_collection("rows")
    with pytest.raises(PipelineError):
        db["rows"].find({}).to_list()


def test_sides_that_always_win_and_concurrent_clocks(spark):
    schema = "_id int, v string, ts double, clock map<string,int>"
    a = spark.createDataFrame([(1, "l", 1.0, {"x": 1}), (2, "l", 9.0, {"x": 2, "y": 1})], schema)
    b = spark.createDataFrame([(1, "r", 2.0, {"x": 2}), (2, "r", 1.0, {"x": 1, "y": 3}), (3, "r", 1.0, {"y": 1})], schema)
    get = lambda s: {r["_id"]: r["v"] for r in conflicts.resolve(a, b, s).collect()}
    assert get("local_wins") == {1: "l", 2: "l", 3: "r"} and get("remote_wins") == {1: "r", 2: "r", 3: "r"} and get("lww") == {1: "r", 2: "l", 3: "r"}
    both = a.join(b.select("_id", F.col("clock").alias("other")), "_id")
    assert {r["_id"]: r["c"] for r in both.select("_id", conflicts.concurrent(F.col("clock"), F.col("other")).alias("c")).collect()} == {1: False, 2: True}
    merged = conflicts.resolve(a, b, clock="clock").filter("_id = 2").first()["clock"]
    assert merged == {"x": 2, "y": 3}
    with pytest.raises(ValueError):
        conflicts.resolve(a, b, "other")
