"""Collections over Spark tables: reads, copy-on-write changes, $out and $merge.

A stored collection is a list of Parquet files. An insert adds files; a change rewrites those files only that hold a row
to change, and readers of the older version go on undisturbed. Every change is written to the collection's change log.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.operators import geo, text
from strandql.operators.predicate import Predicate, no
from strandql.operators.stages import project, sort_columns
from strandql.operators.update import Update, seed
from strandql.operators.validate import Schema
from strandql.plans import pipeline as plans
from strandql.plans.context import Context, frame
from strandql.plans.values import PipelineError, cast, common_type, fan_out, resolve, struct_of
from strandql.sources import access
from strandql.sources.tables import cut, shared_dir


@dataclass
class Result:
    """What a write did."""

    matched: int = 0
    modified: int = 0
    deleted: int = 0
    inserted: int = 0
    upserted: int = 0


class Database:
    """Named collections. Each is a DataFrame; a change writes a new version to the shared folder and moves the name on."""

    def __init__(self, spark: SparkSession, folder: str | None = None, log: bool = True) -> None:
        """log: whether changes are written to the collections' change logs, which watch reads."""
        self.spark, self.log = spark, log
        self.folder = folder or f"{shared_dir(spark)}/db-{uuid.uuid4().hex}"
        self.frames: dict[str, DataFrame] = {}
        self.schemas: dict[str, Schema] = {}
        self.paths: dict[str, list[str]] = {}
        self.indexes: dict[str, dict[str, dict[str, Any]]] = {}
        #: What a running transaction will write to the logs.
        self.pending: list[tuple[DataFrame, str, str, str]] | None = None

    def register(self, name: str, df: DataFrame) -> Collection:
        self.frames[name] = df
        self.paths.pop(name, None)
        return Collection(self, name)

    def read_parquet(self, name: str, path: str) -> Collection:
        """A collection of files that are read and never written to; changes go to files of its own."""
        df = self.spark.read.parquet(path)
        made = self.register(name, df)
        # Files below folders that name columns do not hold these: such a table is stored anew by its first change.
        if not any(f"/{c}=" in f for f in df.inputFiles()[:1] for c in df.columns):
            self.paths[name] = [path]
        return made

    def read_json(self, name: str, path: str, schema: Any = None) -> Collection:
        return self.register(name, (self.spark.read.schema(schema) if schema else self.spark.read).json(path))

    def create_collection(self, name: str, schema: str | Any, validator: dict[str, Any] | None = None) -> Collection:
        made = self.register(name, self.spark.createDataFrame([], schema))
        if validator:
            self.schemas[name] = Schema(validator.get("$jsonSchema", validator))
        return made

    def __getitem__(self, name: str) -> Collection:
        return Collection(self, name)

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise PipelineError(f"no collection {name!r}")
        return self.frames[name]

    def list_collections(self) -> list[str]:
        return sorted(self.frames)

    def drop_collection(self, name: str) -> None:
        for held in (self.frames, self.schemas, self.paths, self.indexes):
            held.pop(name, None)

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """All changes within, of any collections, or none: after an error every name points at its older version and nothing is logged.

        Versions are files that are never changed, so readers see one version throughout. Two transactions of one Database
        cannot run at a time.
        """
        if self.pending is not None:
            raise PipelineError("a transaction is running")
        held = [dict(self.frames), {k: list(v) for k, v in self.paths.items()}, dict(self.schemas), {k: dict(v) for k, v in self.indexes.items()}]
        self.pending = []
        try:
            yield self
        except BaseException:
            self.frames, self.paths, self.schemas, self.indexes = held
            self.pending = None
            raise
        entries, self.pending = self.pending, None
        for docs, path, ns, op in entries:
            self.write_log(docs, path, ns, op)

    def write_log(self, docs: DataFrame, path: str, ns: str, op: str) -> None:
        from strandql.streaming import oplog

        if self.pending is not None:
            self.pending.append((docs, path, ns, op))
        elif self.log:
            oplog.append(docs, path, ns, op)

    def check(self, name: str, df: DataFrame) -> None:
        """Raise if a document fails the collection's validator."""
        if name in self.schemas:
            bad = self.schemas[name].violations(df).first()
            if bad is not None:
                raise PipelineError(f"a document of {name} fails validation: {bad['violation']}")

    def check_unique(self, name: str, df: DataFrame) -> None:
        """Raise if two documents have the same key in a unique index; a sparse index leaves out those without a key, a partial one those that its filter does not fit."""
        for index in self.indexes.get(name, {}).values():
            if not index.get("unique"):
                continue
            rows, keys = df, [resolve(frame(df), k) for k in index["keys"]]
            if index.get("partialFilterExpression"):
                rows = rows.filter(Predicate(frame(df))(index["partialFilterExpression"]))
            if index.get("sparse"):
                rows = rows.filter(F.coalesce(*[v.col.isNotNull() | F.lit(None) for v in keys if v is not None], F.lit(False)) if any(keys) else F.lit(False))
            twice = rows.groupBy(*[(v.col if v is not None else F.lit(None)).alias(f"k{i}") for i, v in enumerate(keys)]).count().filter("count > 1")
            if not twice.isEmpty():
                raise PipelineError(f"duplicate key {index['keys']} in {name}")

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """Check and write a new version of all documents, then point the name at it."""
        self.check(name, df)
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.check_unique(name, made)
        self.paths[name], self.frames[name] = [path], made
        return made

    def amend(self, name: str, kept: list[str], new: DataFrame) -> DataFrame:
        """Check and write the new documents, and point the name at them and the kept files, whose types they share."""
        self.check(name, new)
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        new.write.parquet(path)
        made = self.spark.read.schema(new.schema).parquet(*kept, path)
        self.check_unique(name, made)
        self.paths[name], self.frames[name] = [*kept, path], made
        return made

    def append(self, name: str, new: DataFrame) -> DataFrame:
        """Add documents; the files that are there stay unless a type changes."""
        old = self.frame(name)
        if name not in self.paths:
            return self.store(name, _aligned(old, new))
        both = _aligned(old.limit(0), new)
        same = all(both.schema[f.name].dataType == f.dataType for f in old.schema.fields)
        return self.amend(name, self.paths[name], both) if same else self.store(name, _aligned(old, new))

    def write(self, df: DataFrame, stage: dict[str, Any]) -> DataFrame:
        """$out and $merge."""
        name, spec = next(iter(stage.items()))
        if name == "$out":
            return self.store(spec if isinstance(spec, str) else spec["coll"], df)
        return self.merge(df, spec)

    def merge(self, df: DataFrame, spec: Any) -> DataFrame:
        spec = {"into": spec} if isinstance(spec, str) else spec
        into = spec["into"] if isinstance(spec["into"], str) else spec["into"]["coll"]
        on = [spec.get("on", "_id")] if isinstance(spec.get("on", "_id"), str) else list(spec["on"])
        matched, unmatched = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
        log_path = self[into].log_path
        if into not in self.frames:
            made = self.store(into, df)
            self.write_log(made, log_path, into, "insert")
            return made
        old = self.frame(into)
        made = self.store(into, merge_frames(old, df, on, matched, unmatched, self.context()))
        if self.log or self.pending is not None:
            # Of the new version, what stands under a key of the merged documents: changed if it was there before, else inserted.
            keyed = lambda rows, other, how: rows.join(other.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(on)]).distinct(), _same_keys(on), how)
            touched = keyed(made, df, "left_semi")
            if matched != "keepExisting":
                self.write_log(keyed(touched, old, "left_semi"), log_path, into, "update")
            if unmatched == "insert":
                self.write_log(keyed(touched, old, "left_anti"), log_path, into, "insert")
        return made

    def context(self) -> Context:
        return Context(self.spark, self.frame, {}, self)

    def run(self, pipeline: list[dict[str, Any]]) -> DataFrame:
        """A pipeline over the database itself: $currentOp lists the jobs that run now."""
        if not pipeline or "$currentOp" not in pipeline[0]:
            raise PipelineError("a pipeline over a database begins with $currentOp")
        tracker = self.spark.sparkContext.statusTracker()
        rows = [(int(job), "job", True) for job in tracker.getActiveJobsIds()]
        return plans.aggregate(self.spark.createDataFrame(rows, "opid long, type string, active boolean"), pipeline[1:], self.frame, self)

    def aggregate(self, name: str, pipeline: list[dict[str, Any]]) -> DataFrame:
        return plans.aggregate(self.frame(name), pipeline, self.frame, self)


def _same_keys(on: list[str]):
    test = F.lit(True)
    for i, k in enumerate(on):
        test = test & F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}"))
    return test


def merge_frames(target: DataFrame, new: DataFrame, on: list[str], matched: Any, unmatched: str, ctx: Context) -> DataFrame:
    """Target with the new rows merged in by one full outer join on the keys."""
    left, right = frame(target), frame(new)
    names = list(dict.fromkeys([*target.columns, *new.columns]))
    kinds = {n: common_type([v.type for v in (left.get(n), right.get(n)) if v is not None]) for n in names}
    t = target.select(*[F.col(f"`{n}`").alias(f"t_{n}") for n in target.columns], F.lit(True).alias("t__"))
    s = new.select(*[F.col(f"`{n}`").alias(f"s_{n}") for n in new.columns], F.lit(True).alias("s__"))
    test = None
    for k in on:
        one = F.col(f"t_{k}").eqNullSafe(F.col(f"s_{k}"))
        test = one if test is None else test & one
    both = t.join(s, test, "full_outer")
    here, there = F.col("t__").isNotNull(), F.col("s__").isNotNull()
    if matched == "fail":
        both = both.filter(F.when(here & there, F.raise_error(F.lit("a document matches")).cast("boolean")).otherwise(F.lit(True)))
    if unmatched == "fail":
        both = both.filter(F.when(there & ~here, F.raise_error(F.lit("a document does not match")).cast("boolean")).otherwise(F.lit(True)))
    if unmatched == "discard":
        both = both.filter(here)
    changed = None
    if isinstance(matched, list):
        new_doc = {n: right.get(n)._replace(col=F.col(f"s_{n}")) for n in new.columns}
        old = both.filter(here & there).select(*[F.col(f"t_{n}").alias(n) for n in target.columns], struct_of(new_doc).col.alias("__new"))
        bound = ctx.bind({"new": struct_of(new_doc)._replace(col=F.col("__new"))})
        changed = plans.run(old, matched, bound).drop("__new")
        both = both.filter(~(here & there) | here.isNull())
    out = []
    for n in names:
        a = cast(left.get(n)._replace(col=F.col(f"t_{n}")), kinds[n]).col if n in target.columns else F.lit(None).cast(kinds[n])
        b = cast(right.get(n)._replace(col=F.col(f"s_{n}")), kinds[n]).col if n in new.columns else F.lit(None).cast(kinds[n])
        if matched == "keepExisting":
            value = F.when(here, a).otherwise(b)
        elif matched == "replace":
            value = F.when(there, b).otherwise(a)
        elif n in new.columns:  # merge: the new document's fields win
            value = F.when(there, b).otherwise(a)
        else:
            value = a
        out.append(value.alias(n))
    made = both.select(*out)
    return made if changed is None else made.unionByName(changed, allowMissingColumns=True)


@dataclass
class Cursor:
    """A lazy find: filters, orders and shapes come together in one plan."""

    collection: Collection
    query: dict[str, Any]
    shape: dict[str, Any] | None = None
    keys: dict[str, Any] | None = None
    first: int = 0
    most: int | None = None
    collate: dict[str, Any] | None = None
    ignored: dict[str, Any] = field(default_factory=dict)

    def sort(self, keys: Any, direction: int = 1) -> Cursor:
        self.keys = {keys: direction} if isinstance(keys, str) else dict(keys)
        return self

    def skip(self, n: int) -> Cursor:
        self.first = n
        return self

    def limit(self, n: int) -> Cursor:
        self.most = n
        return self

    def projection(self, shape: dict[str, Any]) -> Cursor:
        self.shape = shape
        return self

    def collation(self, spec: dict[str, Any]) -> Cursor:
        self.collate = spec
        return self

    def hint(self, x: Any) -> Cursor:
        return self._ignore("hint", x)

    def batch_size(self, x: Any) -> Cursor:
        return self._ignore("batch_size", x)

    def comment(self, x: Any) -> Cursor:
        return self._ignore("comment", x)

    def max_time_ms(self, x: Any) -> Cursor:
        return self._ignore("max_time_ms", x)

    def _ignore(self, name: str, x: Any) -> Cursor:
        self.ignored[name] = x
        return self

    def frame(self) -> DataFrame:
        df = self.collection.frame()
        df = df.filter(Predicate(frame(df))(self.query))
        if self.keys:
            if self.collate:
                from strandql.functions import collation

                columns = []
                for path, d in self.keys.items():
                    v = resolve(frame(df), path)
                    c = collation.key(v.col, self.collate) if v.is_string else v.col
                    columns.append(c.desc_nulls_last() if d == -1 else c.asc_nulls_first())
                df = df.orderBy(*columns)
            else:
                df = df.orderBy(*sort_columns(frame(df), self.keys))
        elif near := geo.near_of(self.query):
            df = df.orderBy(geo.haversine(*geo.lon_lat(resolve(frame(df), near[0])), near[1]))
        if self.first:
            df = df.offset(self.first)
        if self.most:
            df = df.limit(self.most)  # 0, as None, is no limit
        return project(df, self.shape, self.collection.database.context()) if self.shape else df

    def __iter__(self):
        return (r.asDict(recursive=True) for r in self.frame().toLocalIterator())

    def __len__(self) -> int:
        return self.frame().count()

    def __getitem__(self, at: int | slice) -> Any:
        """The document at a place, or those of a slice, in the cursor's order; only the rows up to there are asked for."""
        if isinstance(at, slice):
            if at.step is not None and at.step < 1 or any(x is not None and x < 0 for x in (at.start, at.stop)):
                return self.to_list()[at]
            rows = self.frame().offset(at.start or 0)
            rows = rows if at.stop is None else rows.limit(max(0, at.stop - (at.start or 0)))
            return [r.asDict(recursive=True) for r in rows.toLocalIterator()][:: at.step or 1]
        if at < 0:
            return self.to_list()[at]
        found = self.frame().offset(at).limit(1).collect()
        if not found:
            raise IndexError("no document at this place of the cursor")
        return found[0].asDict(recursive=True)

    def to_list(self) -> list[dict[str, Any]]:
        return list(self)


class Collection:
    """One collection: queries are lazy plans, changes rewrite it."""

    def __init__(self, database: Database, name: str) -> None:
        self.database, self.name = database, name

    def frame(self) -> DataFrame:
        return self.database.frame(self.name)

    # -- reads

    def find(self, query: dict[str, Any] | None = None, projection: dict[str, Any] | None = None) -> Cursor:
        return Cursor(self, query or {}, projection)

    def find_one(self, query: dict[str, Any] | None = None, projection: dict[str, Any] | None = None) -> dict[str, Any] | None:
        return next(iter(self.find(query, projection).limit(1)), None)

    def find_with_options(self, query: dict[str, Any], options: dict[str, Any]) -> DataFrame:
        cursor = self.find(query, options.get("projection"))
        cursor.keys, cursor.first, cursor.most = options.get("sort"), options.get("skip", 0), options.get("limit")
        return cursor.frame()

    def aggregate(self, pipeline: list[dict[str, Any]]) -> DataFrame:
        name, spec = next(iter(pipeline[0].items())) if pipeline else (None, None)
        if name not in self.SOURCES:
            return self.database.aggregate(self.name, pipeline)
        return plans.aggregate(self.SOURCES[name](self, spec or {}), pipeline[1:], self.database.frame, self.database)

    def _stats(self, spec: dict[str, Any]) -> DataFrame:
        return self.frame().agg(F.lit(self.name).alias("ns"), F.count(F.lit(1)).alias("count"))

    def _index_stats(self, spec: dict[str, Any]) -> DataFrame:
        rows = [(k, list(v["keys"])) for k, v in self.list_indexes().items()]
        return self.database.spark.createDataFrame(rows, "name string, key array<string>")

    def _search_indexes(self, spec: dict[str, Any]) -> DataFrame:
        """The vector indexes and what they were made with. Vector search itself is exact and needs none."""
        rows = []
        for name, index in self.list_indexes().items():
            if index.get("type") == "vectorSearch" and spec.get("name", name) == name:
                options = index.get("vectorSearchOptions") or {}
                rows.append((name, name, "vectorSearch", "READY", True, ([("vector", index["keys"][0], options.get("dimensions"), options.get("metric"))],)))
        shape = "id string, name string, type string, status string, queryable boolean, latestDefinition struct<fields: array<struct<type: string, path: string, numDimensions: int, similarity: string>>>"
        return self.database.spark.createDataFrame(rows, shape)

    def _changes(self, spec: dict[str, Any]) -> DataFrame:
        """The change events so far as a table; watch gives them as a stream."""
        from strandql.streaming import oplog

        oplog.ensure(self.database.spark, self.log_path)
        return oplog.events(oplog.read_from(self.database.spark, self.log_path), resume_after=spec.get("resumeAfter"))

    #: First stages that are sources of their own.
    SOURCES = {"$collStats": _stats, "$indexStats": _index_stats, "$listSearchIndexes": _search_indexes, "$changeStream": _changes}

    def distinct(self, path: str, query: dict[str, Any] | None = None) -> DataFrame:
        df = self.frame()
        df = df.filter(Predicate(frame(df))(query or {}))
        v = fan_out(frame(df), path)
        if v is None:
            return self.database.spark.createDataFrame([], "value string")
        return (df.select(F.explode_outer(v.col).alias("value")) if v.is_array else df.select(v.col.alias("value"))).distinct()

    def count_documents(self, query: dict[str, Any] | None = None) -> int:
        df = self.frame()
        return df.filter(Predicate(frame(df))(query or {})).count()

    def estimated_document_count(self) -> int:
        return self.frame().count()

    def text_search(self, query: str, fields: Any, score: str = "_textScore") -> DataFrame:
        return text.search(self.frame(), query, fields, score=score).orderBy(F.col(score).desc())

    def explain(self, query: dict[str, Any] | list[dict[str, Any]], verbosity: str = "queryPlanner") -> dict[str, Any]:
        """The stages, how documents are reached, Spark's physical plan and, with "executionStats", how many are read and returned."""
        df = self.aggregate(query) if isinstance(query, list) else self.find(query).frame()
        stages = [next(iter(s)) for s in query] if isinstance(query, list) else ["$match"]
        first = (query[0].get("$match", {}) if query else {}) if isinstance(query, list) else query
        kind, index = access.path(first, query if isinstance(query, list) else [], self.list_indexes())
        out = {"stages": stages, "kind": kind, "index": index, "plan": df._jdf.queryExecution().toString()}
        if verbosity == "executionStats":
            counted = df.groupBy().agg(F.count(F.lit(1)).alias("n"))
            out["returned"] = counted.collect()[0]["n"]
            out["examined"] = access.rows_read(counted)
        return out

    def watch(self, pipeline: list[dict[str, Any]] | None = None, max_await_time_ms: int | None = None, **options: Any) -> DataFrame:
        """Change events as a stream. max_await_time_ms is taken for its callers' sake: the trigger of the running query decides how long it waits."""
        from strandql.streaming import oplog

        oplog.ensure(self.database.spark, self.log_path)
        return oplog.change_stream(self.database.spark, self.log_path, pipeline, ns=self.name, **options)

    @property
    def log_path(self) -> str:
        return f"{self.database.folder}/oplog-{self.name}"

    # -- indexes: layout is Spark's business; unique is the one option that has a meaning for the data

    def create_index(self, keys: Any, name: str | None = None, unique: bool = False, **options: Any) -> str:
        """options: sparse and partialFilterExpression say which documents a unique index looks at; others are kept as they are."""
        listed = [keys] if isinstance(keys, str) else [k if isinstance(k, str) else k[0] for k in (keys.items() if isinstance(keys, dict) else keys)]
        name = name or "_".join(listed)
        held = self.database.indexes.setdefault(self.name, {})
        before, held[name] = held.get(name), {"keys": listed, "unique": unique, **options}
        try:
            self.database.check_unique(self.name, self.frame())
        except PipelineError:
            del held[name]
            if before is not None:
                held[name] = before
            raise
        return name

    def drop_index(self, name: str) -> None:
        self.database.indexes.get(self.name, {}).pop(name, None)

    def rebuild_index(self, name: str) -> int:
        """Check the documents against the index again; how many there are."""
        if name not in self.list_indexes():
            raise PipelineError(f"no index {name!r}")
        self.database.check_unique(self.name, self.frame())
        return self.estimated_document_count()

    def list_indexes(self) -> dict[str, dict[str, Any]]:
        return dict(self.database.indexes.get(self.name, {}))

    # -- writes

    def _log(self, op: str, docs: DataFrame) -> None:
        """Write docs to the change log, with the fields that an update altered where they have that column."""
        self.database.write_log(docs, self.log_path, self.name, op)

    def insert_many(self, docs: list[dict[str, Any]] | DataFrame) -> Result:
        new = docs if isinstance(docs, DataFrame) else self.database.spark.createDataFrame(docs, self.frame().schema)
        if "_id" in new.columns and dict(new.dtypes)["_id"] == "string":
            new = new.withColumn("_id", F.coalesce("_id", F.substring(F.md5(F.uuid().cast("binary")), 1, 24)))
        if isinstance(docs, DataFrame):
            new = cut(new, "inserted")  # ids are made once, and what is logged is what is stored
        else:
            new = self.database.spark.createDataFrame(new.collect(), new.schema).coalesce(1)
        n = new.count()
        if n:
            self.database.append(self.name, new)
            self._log("insert", new)
        return Result(inserted=n)

    def insert_one(self, doc: dict[str, Any]) -> Result:
        return self.insert_many([doc])

    def _stored(self) -> DataFrame:
        """The documents from files, each with its file and its place there in __row."""
        if self.name not in self.database.paths:
            self.database.store(self.name, self.frame())
        return self.frame().withColumn(ROW, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))

    def _matching(self, query: dict[str, Any], one: bool) -> tuple[DataFrame, DataFrame, list[str], int]:
        """(the rows to change, the other rows of their files, the files that stay, how many rows match); one: the first alone."""
        df = self._stored()
        test = Predicate(frame(df.drop(ROW)))(query)
        files = df.groupBy(F.col(f"{ROW}.file").alias("file")).agg(F.count_if(test).alias("n"), F.min(F.when(test, F.col(f"{ROW}.at"))).alias("at")).collect()  # a row a file
        hit = [f for f in files if f["n"]]
        if one and hit:
            order = {p: i for i, p in enumerate(self.database.paths[self.name])}
            place = lambda f: (next((i for p, i in order.items() if _plain_path(f["file"]).startswith(_plain_path(p))), -1), f["file"])
            first = min(hit, key=place)
            hit = [first]
            test = (F.col(f"{ROW}.file") == first["file"]) & (F.col(f"{ROW}.at") == first["at"])
        named = {f["file"] for f in hit}
        kept = [_plain_path(f["file"]) for f in files if f["file"] not in named]
        touched = self.database.spark.read.schema(df.drop(ROW).schema).parquet(*[_plain_path(f) for f in named]) if named else self.frame().limit(0)
        touched = touched.withColumn(ROW, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))) if named else df.limit(0)
        return touched.filter(test), touched.filter(no(test)), kept, 1 if one and hit else sum(f["n"] for f in hit)

    def _rewrite(self, rest: DataFrame, kept: list[str], new: DataFrame) -> None:
        """The collection of the kept files, the rest of the changed ones and the new rows."""
        old, rest = self.frame(), rest.drop(ROW)
        both = _aligned(rest, new)
        if all(both.schema[f.name].dataType == f.dataType for f in old.schema.fields if f.name in both.columns) and set(old.columns) <= set(both.columns):
            self.database.amend(self.name, kept, both)
        else:  # a type or a field has changed in all documents
            others = self.database.spark.read.schema(old.schema).parquet(*kept) if kept else old.limit(0)
            self.database.store(self.name, _aligned(_aligned(others, rest), new))

    def update_many(self, query: dict[str, Any], change: Any, upsert: bool = False, array_filters: list[dict[str, Any]] | None = None, one: bool = False) -> Result:
        before, rest, kept, matched = self._matching(query, one)
        if not matched:
            if not upsert:
                return Result()
            schema = self.frame().schema
            row = self.database.spark.createDataFrame([seed(query, schema)], schema)
            made = cut(Update(change, array_filters, query, inserting=True).apply(row), "upserted")
            self.database.append(self.name, made)
            self._log("insert", made)
            return Result(upserted=1)
        changed = cut(_with_changes(before, Update(change, array_filters, query).apply(before)), "changed")
        modified = changed.filter(F.size(CHANGED) > 0).count()
        self._rewrite(rest, kept, changed.drop(CHANGED))
        self._log("update", changed.filter(F.size(CHANGED) > 0))
        return Result(matched=matched, modified=modified)

    def update_one(self, query: dict[str, Any], change: Any, upsert: bool = False, array_filters: list[dict[str, Any]] | None = None) -> Result:
        return self.update_many(query, change, upsert, array_filters, one=True)

    def replace_one(self, query: dict[str, Any], doc: dict[str, Any], upsert: bool = False) -> Result:
        before, rest, kept, matched = self._matching(query, True)
        if not matched and not upsert:
            return Result()
        schema, found = self.frame().schema, before.first() if matched else None
        row = {**({"_id": found["_id"]} if found is not None and "_id" in schema.names else {}), **doc}
        new = self.database.spark.createDataFrame([row], schema)
        if found is None:
            self.database.append(self.name, new)
            self._log("insert", new)
            return Result(upserted=1)
        self._rewrite(rest, kept, new)
        self._log("replace", new)
        return Result(matched=1, modified=1)

    def _remove(self, gone: DataFrame, rest: DataFrame, kept: list[str]) -> None:
        gone = cut(gone.drop(ROW), "deleted")
        self._rewrite(rest, kept, gone.limit(0))
        self._log("delete", gone)

    def delete_many(self, query: dict[str, Any], one: bool = False) -> Result:
        gone, rest, kept, n = self._matching(query, one)
        if n:
            self._remove(gone, rest, kept)
        return Result(deleted=n)

    def delete_one(self, query: dict[str, Any]) -> Result:
        return self.delete_many(query, one=True)

    def _first(self, query: dict[str, Any]) -> dict[str, Any] | None:
        """The document that a change of one would take."""
        found = self._matching(query, True)[0].drop(ROW).first()
        return None if found is None else found.asDict(recursive=True)

    def find_one_and_update(self, query: dict[str, Any], change: Any, after: bool = False) -> dict[str, Any] | None:
        rows = self._matching(query, True)[0].drop(ROW)
        before = rows.first()
        if before is None:
            return None
        new = Update(change, None, query).apply(rows).first()
        self.update_one(query, change)
        return (new if after else before).asDict(recursive=True)

    def find_one_and_replace(self, query: dict[str, Any], doc: dict[str, Any]) -> dict[str, Any] | None:
        before = self._first(query)
        self.replace_one(query, doc)
        return before

    def find_one_and_delete(self, query: dict[str, Any]) -> dict[str, Any] | None:
        before = self._first(query)
        self.delete_one(query)
        return before

    def bulk_write(self, operations: list[dict[str, Any]], ordered: bool = True) -> Result:
        """Documents {insertOne|updateOne|updateMany|replaceOne|deleteOne|deleteMany: {...}} one after the other."""
        total, errors = Result(), []
        for o in operations:
            name, a = next(iter(o.items()))
            try:
                got = {
                    "insertOne": lambda: self.insert_one(a["document"]),
                    "updateOne": lambda: self.update_one(a["filter"], a["update"], a.get("upsert", False), a.get("arrayFilters")),
                    "updateMany": lambda: self.update_many(a["filter"], a["update"], a.get("upsert", False), a.get("arrayFilters")),
                    "replaceOne": lambda: self.replace_one(a["filter"], a["replacement"], a.get("upsert", False)),
                    "deleteOne": lambda: self.delete_one(a["filter"]),
                    "deleteMany": lambda: self.delete_many(a["filter"]),
                }[name]()
            except PipelineError as e:
                if ordered:
                    raise
                errors.append(e)
                continue
            for k in vars(total):
                setattr(total, k, getattr(total, k) + getattr(got, k))
        return total

    def reap(self, path: str, seconds: int) -> Result:
        """Delete documents whose date is so many seconds ago."""
        v = resolve(frame(self.frame()), path)
        if v is None:
            return Result()
        limit = self.database.spark.sql(f"SELECT localtimestamp() - make_dt_interval(0, 0, 0, {int(seconds)}) AS t").first()["t"]
        return self.delete_many({path: {"$lte": limit, "$ne": None}})


#: Hidden columns of changes: the file and place of a row, and the fields that a change altered.
ROW, CHANGED = "__row", "__changed"


def _plain_path(uri: str) -> str:
    """A file's path without escapes, in one spelling."""
    made = unquote(uri) if "%" in uri else uri
    return "file:///" + made.removeprefix("file:").lstrip("/") if made.startswith(("file:", "/")) else made


def _with_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows after a change with the fields that differ from before; both have the column of their places."""
    left, right = frame(before), frame(after)
    marks = []
    for f in right.fields:
        if f.name == ROW:
            continue
        old, new = left.get(f.name), F.col(f"n.`{f.name}`")
        if old is None:
            marks.append(F.when(new.isNotNull(), F.lit(f.name)))
        elif old.type != f.dataType or "map<" in f.dataType.simpleString():
            marks.append(F.when(~F.to_json(F.struct(F.col(f"o.`{f.name}`").alias("v"))).eqNullSafe(F.to_json(F.struct(new.alias("v")))), F.lit(f.name)))
        else:
            marks.append(F.when(~F.col(f"o.`{f.name}`").eqNullSafe(new), F.lit(f.name)))
    marks += [F.when(F.col(f"o.`{f.name}`").isNotNull(), F.lit(f.name)) for f in left.fields if right.get(f.name) is None]
    changed = F.array_compact(F.array(*marks)).cast("array<string>").alias(CHANGED)
    return after.alias("n").join(before.alias("o"), F.col(f"n.{ROW}") == F.col(f"o.{ROW}")).select(*[F.col(f"n.`{f.name}`") for f in right.fields if f.name != ROW], changed)


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both in one schema, nested fields too."""
    left, right = frame(a), frame(b)
    names = list(dict.fromkeys([*a.columns, *b.columns]))
    kinds = {n: common_type([v.type for v in (left.get(n), right.get(n)) if v is not None]) for n in names}
    shape = lambda df, root: df.select(*[(cast(v, kinds[n]).col if (v := root.get(n)) is not None else F.lit(None).cast(kinds[n])).alias(n) for n in names])
    return shape(a, left).unionByName(shape(b, right))
