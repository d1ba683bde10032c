"""Collections: documents with keys, scalar fields and vectors, kept as Parquet under a manifest.

    manifest-N.json     schema, segments, log, deleted ids, indexes, next ids, the lengths of all
                        files, and a checksum of all that; creating it is the only commit point,
                        and the whole one with the largest N is in force
    data/               segments, log batches and lists of deleted ids; never changed once written
    indexes/            artifacts of vector and text indexes, one for each field and segment

Opening checks that the files of the manifest are there at their lengths; a writer then removes
what no manifest names, such as a log batch whose write was cut off. Pages of data files carry
checksums, which readers verify.

A write adds a batch to the log. The live view is the segments less what the log replaces,
with the newest of the log. flush() folds the log into a segment; optimize() rewrites all live
rows. Segments keep their indexes; a new segment gets its own, and rows that no index covers yet
are searched exactly. Readers work on the manifest that they have read, so they see whole
versions.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..errors import AlreadyExists, EngineError, FailedPrecondition, InvalidArgument, NotFound, NotSupported, PermissionDenied
from ..filters.language import compile_filter
from ..fts import index as text_index
from ..fts import query as text_query
from ..fts.analysis import Analyzer
from ..functions import vectors as V
from ..operators import fusion, search, writes
from ..operators.expressions import NUMERIC, compile_expression, wrap
from ..scratch import Scratch
from .files import Files

LIBRARY_VERSION = "0.1.0"


@dataclass(frozen=True)
class Options:
    read_only: bool = False
    force_lock: bool = False


@dataclass(frozen=True)
class RuntimeConfig:
    """Shares of rows left by a filter, below which an exact scan replaces an index."""

    invert_to_forward_scan_ratio: float = 0.9
    brute_force_by_keys_ratio: float = 0.1
    fts_brute_force_by_keys_ratio: float = 0.05


@dataclass(frozen=True)
class WriteResult:
    primary_key: str
    doc_id: int | None
    error: str | None = None


@dataclass(frozen=True)
class FTSClause:
    """Exactly one of query (the language) and match (plain text)."""

    query: str | None = None
    match: str | None = None


@dataclass(frozen=True)
class VectorQuery:
    """At most one of vector, sparse, primary_key and fts; none of them: filter only."""

    field: str | None = None
    vector: Sequence[float] | None = None
    sparse: dict[int, float] | None = None
    primary_key: str | None = None
    fts: FTSClause | None = None
    filter: str | None = None
    k: int = 10
    params: S.QueryParams | None = None
    projection: S.Projection = S.Projection()


@dataclass(frozen=True)
class GroupByQuery(VectorQuery):
    group_by: str = ""
    group_count: int = 10
    top_k_per_group: int = 1


@dataclass(frozen=True)
class SubQuery:
    query: VectorQuery
    num_candidates: int = fusion.DEFAULT_CANDIDATES
    weight: float = 1.0


@dataclass(frozen=True)
class MultiQuery:
    branches: Sequence[SubQuery]
    filter: str | None = None
    k: int = fusion.DEFAULT_K
    reranker: str | Callable = "rrf"
    rank_constant: int = 60
    projection: S.Projection = S.Projection()


@dataclass
class Manifest:
    generation: int
    schema: str
    next_doc_id: int = 0
    next_seq: int = 0
    segments: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    progress: dict[str, int] = field(default_factory=dict)
    files: dict[str, dict[str, int]] = field(default_factory=dict)
    version: int = 2


def _loose(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed inside, as a cast never takes them away."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType), True) for f in kind.fields])
    return kind


class Collection:
    # --- Opening and closing -----------------------------------------------------------------

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, options: Options) -> None:
        self.spark, self.path, self.options, self._manifest = spark, path, options, manifest
        self._files, self._closed = Files(spark, path), False
        self.runtime = RuntimeConfig()

    @classmethod
    def create_and_open(cls, spark: SparkSession, path: str, schema: S.CollectionSchema, options: Options = Options()) -> Collection:
        schema.validate()
        files = Files(spark, path)
        if options.read_only:
            raise InvalidArgument("a new collection can't be read-only", "create", path)
        if cls._newest(files) is not None:
            raise AlreadyExists("there is a collection", "create", path)
        cls._lock(files, options)
        found = cls(spark, path, Manifest(0, schema.to_json()), options)
        found._publish(found._manifest)
        return found

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options = Options()) -> Collection:
        files = Files(spark, path)
        found = cls._newest(files)
        if found is None:
            raise NotFound("no collection", "open", path)
        if not options.read_only:
            cls._lock(files, options)
            found = cls._newest(files)
        out = cls(spark, path, found, options)
        try:
            for name, lengths in found.files.items():
                if files.sizes(name) != lengths:
                    raise FailedPrecondition(f"the files of {name} are not those that were written", "open", path)
            if not options.read_only:
                out._clean()
        except BaseException:
            out.close()
            raise
        return out

    @staticmethod
    def _newest(files: Files) -> Manifest | None:
        """The whole manifest with the largest number. One that is cut off or changed doesn't count."""
        numbers = sorted((int(n[9:-5]) for n in files.names() if n.startswith("manifest-") and n.endswith(".json")), reverse=True)
        for n in numbers:
            crc, _, body = files.read(f"manifest-{n}.json").partition("\n")
            if crc == str(zlib.crc32(body.encode())):
                raw = json.loads(body)
                if raw.get("version") != 2 or set(raw) != set(Manifest.__dataclass_fields__):
                    raise FailedPrecondition("the manifest can't be read", "open", files.root)
                return Manifest(**raw)
        if numbers:
            raise FailedPrecondition("no whole manifest", "open", files.root)
        return None

    def _clean(self) -> None:
        """Removes what a write that was cut off has left."""
        m = self._manifest
        self._files.delete("results")
        for folder in ("data", "indexes"):
            for n in self._files.names(folder):
                if f"{folder}/{n}" not in m.files:
                    self._files.delete(f"{folder}/{n}")
        for n in self._files.names():
            if n.endswith(".tmp") or (n.startswith("manifest-") and n != f"manifest-{m.generation}.json"):
                self._files.delete(n)

    @staticmethod
    def _lock(files: Files, options: Options) -> None:
        if options.force_lock:
            files.delete("LOCK")
        if not files.claim("LOCK"):
            raise FailedPrecondition("another writer has the collection open", "open", files.root)

    def close(self) -> None:
        if not self._closed and not self.options.read_only:
            self._files.delete("LOCK")
        self._closed = True

    def destroy(self) -> None:
        self._writable("destroy")
        self._files.delete()
        self._closed = True

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _open(self, op: str) -> None:
        if self._closed:
            raise FailedPrecondition("the collection is closed", op, self.path)

    def _writable(self, op: str) -> None:
        self._open(op)
        if self.options.read_only:
            raise PermissionDenied("the collection is read-only", op, self.path)

    def _publish(self, m: Manifest) -> None:
        named = [*m.segments, *m.log, *m.deletes, *(p for of in m.indexes.values() for p in of.values())]
        m = replace(m, files={n: m.files[n] if n in m.files else self._files.sizes(n) for n in named})
        body = json.dumps(m.__dict__, sort_keys=True)
        self._files.create(f"manifest-{m.generation}.json", f"{zlib.crc32(body.encode())}\n{body}")
        self._manifest = m

    # --- The live view -----------------------------------------------------------------------

    @property
    def schema(self) -> S.CollectionSchema:
        return S.CollectionSchema.from_json(self._manifest.schema)

    def _row_type(self, schema: S.CollectionSchema | None = None) -> T.StructType:
        return T.StructType([T.StructField("_pk", T.StringType()), T.StructField("_doc_id", T.LongType()), *(schema or self.schema).struct().fields])

    def _log_type(self) -> T.StructType:
        return T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), *self._row_type().fields])

    def _read(self, names: list[str], kind: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("parquet.page.verify-checksum.enabled", "true").parquet(*(self._files.full(n) for n in names))

    def _base(self, segments: list[str] | None = None) -> DataFrame:
        base = self._read(self._manifest.segments if segments is None else segments, self._row_type())
        if self._manifest.deletes:
            gone = self._read(self._manifest.deletes, T.StructType([T.StructField("_doc_id", T.LongType())]))
            base = base.join(gone, "_doc_id", "left_anti")
        return base.select(*(F.col(f"`{c.name}`") for c in self._row_type().fields))

    def live(self) -> DataFrame:
        """Newest, undeleted documents: _pk, _doc_id and the fields."""
        self._open("live")
        old, new = self._live(self._manifest.segments)
        return old.unionByName(new) if self._manifest.log else old

    def _live(self, segments: list[str]) -> tuple[DataFrame, DataFrame]:
        """The live documents of some segments, and all others."""
        m = self._manifest
        rest = [n for n in m.segments if n not in segments]
        old, new = self._base(segments), self._base(rest)
        if m.log:
            log = self._read(m.log, self._log_type())
            replaced = log.select("_pk").distinct()
            newest = writes.live_rows(log).select(*(F.col(f"`{c.name}`") for c in self._row_type().fields))
            old = old.join(replaced, "_pk", "left_anti").select(newest.columns)
            new = (new.join(replaced, "_pk", "left_anti").select(newest.columns).unionByName(newest)) if rest else newest
        return old, new

    def stats(self) -> dict[str, Any]:
        self._open("stats")
        schema, m = self.schema, self._manifest
        total = self._read(m.segments, self._row_type()).count()
        live = self.live().count()
        indexes = {f.name: self._completeness(f) for f in schema.fields if f.effective_index is not None}
        return {"documents": live, "segments": len(m.segments), "deleted": max(0, total - self._base().count()), "index_completeness": indexes}

    def _stored(self, f: S.FieldSchema) -> bool:
        """Whether a field's index has artifacts."""
        index = f.index
        return isinstance(index, S.FTSIndexParams) or (f.data_type.is_vector and index is not None and not isinstance(index, S.FlatIndexParams))

    def _completeness(self, f: S.FieldSchema) -> float:
        """The share of a field's segments, and of its log, that its index covers."""
        m = self._manifest
        parts = len(m.segments) + bool(m.log)
        return 1.0 if not self._stored(f) or not parts else len(m.indexes.get(f.name, {})) / parts

    # --- Writes ------------------------------------------------------------------------------

    def _checked(self, f: S.FieldSchema, value: Any) -> Any:
        """A field's value as Spark stores it, or InvalidArgument."""

        def scalar(kind: S.DataType, x: Any) -> Any:
            wrong = InvalidArgument(f"{f.name}: {x!r} is no {kind.name}", "write", self.path)
            if kind == S.DataType.STRING:
                if not isinstance(x, str) or any(0xD800 <= ord(c) < 0xE000 for c in x):
                    raise wrong
            elif kind == S.DataType.BINARY:
                if not isinstance(x, bytes | bytearray):
                    raise wrong
                x = bytearray(x)
            elif kind == S.DataType.BOOL:
                if not isinstance(x, bool):
                    raise wrong
            elif kind in S.INTEGER_RANGE:
                low, high = S.INTEGER_RANGE[kind]
                if isinstance(x, bool) or not isinstance(x, int) or not low <= x <= high:
                    raise wrong
                x = Decimal(x) if kind == S.DataType.UINT64 else x
            else:
                if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x) or (kind == S.DataType.FLOAT and not math.isfinite(float(np.float32(x)))):
                    raise wrong
                x = float(x)
            return x

        kind = f.data_type
        if value is None:
            return None
        if kind.is_sparse:
            pairs = sorted(value.items() if isinstance(value, dict) else zip(*value, strict=True))
            if len({i for i, _ in pairs}) != len(pairs) or len(pairs) > S.MAX_SPARSE:
                raise InvalidArgument(f"{f.name}: coordinates repeat or are too many", "write", self.path)
            indices = [scalar(S.DataType.UINT32, i) for i, _ in pairs]
            return (indices, self._rounded(f, [scalar(S.DataType.FLOAT, x) for _, x in pairs]))
        if kind.is_dense:
            if len(value) != f.dimension:
                raise InvalidArgument(f"{f.name}: {len(value)} components instead of {f.dimension}", "write", self.path)
            if kind == S.DataType.VECTOR_INT8:
                if not all(isinstance(x, int | np.integer) and -128 <= x <= 127 for x in value):
                    raise InvalidArgument(f"{f.name}: components must be from -128 to 127", "write", self.path)
                return [int(x) for x in value]
            return self._rounded(f, [scalar(S.DataType.FLOAT, float(x)) for x in value])
        if kind.is_array:
            if not isinstance(value, list | tuple):
                raise InvalidArgument(f"{f.name} is an array", "write", self.path)
            return [scalar(kind.element, x) for x in value]
        return scalar(kind, value)

    def _rounded(self, f: S.FieldSchema, values: list[float]) -> list[float]:
        index = f.effective_index
        half = f.data_type in (S.DataType.VECTOR_FP16, S.DataType.SPARSE_VECTOR_FP16)
        if half or getattr(index, "quantize", 0) == S.QuantizeType.FP16:
            with np.errstate(over="ignore"):
                rounded = np.asarray(values, np.float32).astype(np.float16)
            if not np.isfinite(rounded).all():
                raise InvalidArgument(f"{f.name}: a component is too large for half precision", "write", self.path)
            return rounded.astype(float).tolist() if half else values
        return values

    def _batch(self, documents: Iterable[tuple[str, dict[str, Any]]], whole: bool) -> tuple[DataFrame, list[WriteResult]]:
        schema = self.schema
        names = {f.name: f for f in schema.fields}
        rows, failed = [], {}
        for pos, (pk, fields) in enumerate(documents):
            try:
                if not isinstance(pk, str) or not pk or len(pk.encode()) > 64 << 10:
                    raise InvalidArgument("a key is a string of 1 to 65,536 bytes", "write", self.path)
                for name in fields:
                    if name not in names:
                        raise InvalidArgument(f"no field {name!r}", "write", self.path)
                for f in schema.fields:
                    if not f.nullable and fields.get(f.name) is None and (whole or f.name in fields):
                        raise InvalidArgument(f"{f.name} is required", "write", self.path)
                rows.append((pos, pk, list(fields), *(self._checked(f, fields.get(f.name)) for f in schema.fields)))
            except EngineError as e:
                failed[pos] = WriteResult(pk, None, e.code.name)
        kind = T.StructType([T.StructField("_pos", T.LongType()), T.StructField("_pk", T.StringType()), T.StructField("_present", T.ArrayType(T.StringType())), *schema.struct().fields])
        return self.spark.createDataFrame(rows, kind), failed

    def _required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    def _append(self, op: str, rows: DataFrame | None, gone: DataFrame | None, wrote: int, progress: dict[str, int] | None = None) -> None:
        """One log batch of new versions and tombstones, then the manifest that names it and how far a stream has come."""
        m = self._manifest
        fields = [c.name for c in self._row_type().fields]
        parts = []
        if rows is not None:
            parts.append(rows.select(F.lit(m.next_seq).cast("long").alias("_seq"), F.lit("U").alias("_op"), *(F.col(f"`{c}`") for c in fields)))
        if gone is not None:
            nulls = [F.lit(None).cast(c.dataType).alias(c.name) for c in self._row_type().fields[1:]]
            parts.append(gone.select(F.lit(m.next_seq).cast("long").alias("_seq"), F.lit("D").alias("_op"), "_pk", *nulls))
        name = f"data/log-{m.next_seq}-{uuid.uuid4().hex[:8]}"
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        whole.write.parquet(self._files.full(name))
        self._publish(replace(m, generation=m.generation + 1, next_seq=m.next_seq + 1, next_doc_id=m.next_doc_id + wrote, log=[*m.log, name], progress={**m.progress, **(progress or {})}))

    def _write(self, op: str, plan: Callable, documents: Iterable[tuple[str, dict[str, Any]]], whole: bool) -> list[WriteResult]:
        self._writable(op)
        documents = list(documents)
        batch, failed = self._batch(documents, whole)
        with Scratch(self.spark) as scratch:
            rows, results = plan(self.live(), batch, self._manifest.next_doc_id, self._required(), scratch)
            done = {r._pos: WriteResult(r._pk, r._doc_id, r._error) for r in results.collect()}  # a row for each document given
            wrote = sum(r.error is None for r in done.values())
            if wrote:
                self._append(op, rows, None, wrote)
        return [failed.get(i) or done[i] for i in range(len(documents))]

    def insert(self, documents: Iterable[tuple[str, dict[str, Any]]]) -> list[WriteResult]:
        return self._write("insert", writes.insert, documents, True)

    def upsert(self, documents: Iterable[tuple[str, dict[str, Any]]]) -> list[WriteResult]:
        return self._write("upsert", writes.upsert, documents, False)

    def update(self, documents: Iterable[tuple[str, dict[str, Any]]]) -> list[WriteResult]:
        return self._write("update", writes.update, documents, False)

    def _frame(self, op: str, plan: Callable, rows: DataFrame, required: list[str], progress: dict[str, int] | None = None) -> DataFrame:
        """A write of a DataFrame with _pos and _pk; the results stay distributed."""
        self._writable(op)
        known = {f.name: S.spark_type(f.data_type) for f in self.schema.fields}
        unknown = set(rows.columns) - set(known) - {"_pos", "_pk", "_present"}
        if unknown:
            raise InvalidArgument(f"no fields {sorted(unknown)}", op, self.path)
        given = [c for c in rows.columns if c in known]
        if "_present" not in rows.columns:
            rows = rows.withColumn("_present", F.array(*map(F.lit, given)).cast("array<string>"))
        known = {c: _loose(k) for c, k in known.items()}
        whole = rows.select("_pos", "_pk", "_present", *((F.col(f"`{c}`").cast(k) if c in given else F.lit(None).cast(k)).alias(c) for c, k in known.items()))
        wrong = F.lit(False)
        for f in (f for f in self.schema.fields if f.data_type.is_dense and f.name in given):
            v = F.col(f"`{f.name}`")
            wrong = wrong | (v.isNotNull() & ((F.size(v) != f.dimension) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))))
        if bad := whole.where(wrong).select("_pk").take(1):
            raise InvalidArgument(f"{bad[0][0]!r} has a vector of another size, or with components that aren't finite", op, self.path)
        with Scratch(self.spark) as scratch:
            new, results = plan(self.live(), whole, self._manifest.next_doc_id, required, scratch)
            results = self._kept_results(results)
            wrote = results.where(F.col("_error").isNull()).count()
            if wrote:
                self._append(op, new, None, wrote, progress)
        return results

    def _kept_results(self, results: DataFrame) -> DataFrame:
        name = f"results/{uuid.uuid4().hex}"
        results.write.parquet(self._files.full(name))
        return self.spark.read.schema(results.schema).parquet(self._files.full(name))

    def insert_frame(self, rows: DataFrame, progress: dict[str, int] | None = None) -> DataFrame:
        return self._frame("insert", writes.insert, rows, self._required(), progress)

    def merge_frame(self, rows: DataFrame, create: bool = True, progress: dict[str, int] | None = None) -> DataFrame:
        """Upsert (create) or update; fields that rows lacks keep their values."""
        return self._frame("upsert" if create else "update", writes.upsert if create else writes.update, rows, self._required(), progress)

    def delete_frame(self, keys: DataFrame, progress: dict[str, int] | None = None) -> DataFrame:
        """Keys with their _pos; the results stay distributed."""
        self._writable("delete")
        results = self._kept_results(writes.delete(self.live(), keys.select("_pos", "_pk"))[1])
        gone = results.where(F.col("_error").isNull())
        if gone.take(1):
            self._append("delete", None, gone.select("_pk"), 0, progress)
        return results

    def progress(self, source: str) -> int:
        """The last batch of a stream that was written, -1 for none."""
        return self._manifest.progress.get(source, -1)

    def set_progress(self, source: str, number: int) -> None:
        self._writable("progress")
        m = self._manifest
        self._publish(replace(m, generation=m.generation + 1, progress={**m.progress, source: number}))

    def delete(self, keys: Sequence[str]) -> list[WriteResult]:
        self._writable("delete")
        given = self.spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "_pos long, _pk string")
        gone, results = writes.delete(self.live(), given)
        done = {r._pos: WriteResult(r._pk, r._doc_id, r._error) for r in results.collect()}
        if any(r.error is None for r in done.values()):
            self._append("delete", None, gone, 0)
        return [done[i] for i in range(len(keys))]

    def delete_by_filter(self, text: str) -> None:
        self._writable("delete by filter")
        gone = self.live().where(compile_filter(text, self.schema)).select("_pk")
        if gone.take(1):
            self._append("delete", None, gone, 0)

    # --- Maintenance -------------------------------------------------------------------------

    def flush(self) -> None:
        """The log becomes a segment; what it replaces in older segments is listed as deleted. The segment gets indexes of its own."""
        self._writable("flush")
        m = self._manifest
        if not m.log:
            return
        log = self._read(m.log, self._log_type())
        newest = writes.live_rows(log).select(*(F.col(f"`{c.name}`") for c in self._row_type().fields))
        segment, gone = f"data/segment-{m.generation + 1}", f"data/deleted-{m.generation + 1}"
        newest.sortWithinPartitions("_doc_id").write.parquet(self._files.full(segment))
        segments, deletes = [*m.segments, segment], m.deletes
        if m.segments:
            self._base().join(log.select("_pk").distinct(), "_pk", "left_semi").select("_doc_id").write.parquet(self._files.full(gone))
            deletes = [*m.deletes, gone]
        built = {f.name: self._build(f, segment) for f in self.schema.fields if self._stored(f)}
        indexes = {k: {**m.indexes.get(k, {}), segment: v} for k, v in built.items()}
        self._publish(replace(m, generation=m.generation + 1, segments=segments, deletes=deletes, log=[], indexes={**m.indexes, **indexes}))

    def optimize(self) -> None:
        """All live rows in segments of bounded size, in the order of their ids; indexes are rebuilt."""
        self._writable("optimize")
        self._rewrite(self.live(), self.schema)

    def _rewrite(self, rows: DataFrame, schema: S.CollectionSchema) -> None:
        m, kind = self._manifest, self._row_type(schema)
        count = rows.count()
        parts = max(1, -(-count // schema.max_docs_per_segment))
        name = f"data/segment-{m.generation + 1}"
        rows.select(*(F.col(f"`{c.name}`") if isinstance(c.dataType, T.ArrayType | T.StructType) else F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in kind.fields)).repartitionByRange(parts, "_doc_id").sortWithinPartitions("_doc_id").write.option("maxRecordsPerFile", schema.max_docs_per_segment).parquet(self._files.full(name))
        built = {f.name: {name: self._build(f, name)} for f in schema.fields if self._stored(f)}
        self._publish(replace(m, generation=m.generation + 1, schema=schema.to_json(), segments=[name], log=[], deletes=[], indexes=built))
        for n in m.files:
            if n not in self._manifest.files:
                self._files.delete(n)

    def _with_field(self, changed: S.FieldSchema) -> S.CollectionSchema:
        schema = self.schema
        return schema.with_fields([changed if f.name == changed.name else f for f in schema.fields])

    def create_index(self, column: str, params: S.IndexParams) -> None:
        self._writable("create index")
        old = self.schema.field(column)
        if old.index == params:
            return
        schema = self._with_field(replace(old, index=params))
        schema.validate()
        m, f = self._manifest, schema.field(column)
        built = {column: {n: self._build(f, n) for n in m.segments}} if self._stored(f) and m.segments else {}
        self._publish(replace(m, generation=m.generation + 1, schema=schema.to_json(), indexes={k: v for k, v in m.indexes.items() if k != column} | built))

    def drop_index(self, column: str) -> None:
        self._writable("drop index")
        m, f = self._manifest, self.schema.field(column)
        if f.index is None:
            raise NotFound(f"{column} has no index", "drop index", self.path)
        schema = self._with_field(replace(f, index=None))
        self._publish(replace(m, generation=m.generation + 1, schema=schema.to_json(), indexes={k: v for k, v in m.indexes.items() if k != column}))

    def add_column(self, f: S.FieldSchema, expression: str | None = None) -> None:
        self._writable("add column")
        schema = self.schema
        if f.data_type not in NUMERIC:
            raise NotSupported("only numeric columns can be added", "add column", self.path)
        if any(g.name == f.name for g in schema.fields):
            raise AlreadyExists(f"there is a field {f.name!r}", "add column", self.path)
        if expression is None and not f.nullable:
            raise InvalidArgument("a column that isn't nullable needs an expression", "add column", self.path)
        new = schema.with_fields([*schema.fields, f])
        new.validate()
        value = F.lit(None).cast(S.spark_type(f.data_type)) if expression is None else compile_expression(expression, schema, f.data_type)
        rows = self.live().withColumn(f.name, value)
        if not f.nullable and rows.where(F.col(f"`{f.name}`").isNull()).take(1):
            raise InvalidArgument("the expression gives null", "add column", self.path)
        self._rewrite(rows, new)

    def alter_column(self, column: str, rename: str | None = None, changed: S.FieldSchema | None = None) -> None:
        self._writable("alter column")
        schema = self.schema
        old = schema.field(column)
        if (rename is None) == (changed is None):
            raise InvalidArgument("either a new name or a new definition", "alter column", self.path)
        if old.data_type not in NUMERIC or (changed and changed.data_type not in NUMERIC):
            raise NotSupported("only numeric columns can be altered", "alter column", self.path)
        new = replace(old, name=rename) if rename else replace(changed, name=changed.name or column)
        if new.name != column and any(g.name == new.name for g in schema.fields):
            raise AlreadyExists(f"there is a field {new.name!r}", "alter column", self.path)
        if old.nullable and not new.nullable:
            raise InvalidArgument("a nullable column stays nullable", "alter column", self.path)
        after = schema.with_fields([new if f.name == column else f for f in schema.fields])
        after.validate()
        rows = self.live().withColumn(column, wrap(F.col(f"`{column}`"), new.data_type)).withColumnRenamed(column, new.name)
        self._rewrite(rows, after)

    def drop_column(self, column: str) -> None:
        self._writable("drop column")
        schema = self.schema
        if schema.field(column).data_type not in NUMERIC:
            raise NotSupported("only numeric columns can be dropped", "drop column", self.path)
        if len(schema.fields) == 1:
            raise FailedPrecondition("the last field stays", "drop column", self.path)
        self._rewrite(self.live().drop(column), schema.with_fields([f for f in schema.fields if f.name != column]))

    # --- Indexes -----------------------------------------------------------------------------

    def _build(self, f: S.FieldSchema, segment: str) -> str:
        """Writes the index of a field over one segment; the folder's name."""
        from ..ann import indexes

        name = f"indexes/{f.name}-{uuid.uuid4().hex[:12]}"
        rows = self.spark.read.parquet(self._files.full(segment))
        if isinstance(f.index, S.FTSIndexParams):
            text_index.store(text_index.documents(rows, f.name, Analyzer(f.index).terms_column), self._files.full(name))
        else:
            indexes.build(rows.where(F.col(f"`{f.name}`").isNotNull()).select("_doc_id", F.col(f"`{f.name}`").alias("v")), f, self._files.full(name))
        return name

    def _artifacts(self, f: S.FieldSchema) -> dict[str, str]:
        """The folders of a field's index by the segments that they cover."""
        return {n: self._files.full(p) for n, p in self._manifest.indexes.get(f.name, {}).items()}

    def _untouched(self) -> bool:
        """Whether all rows of the segments are live."""
        return not self._manifest.log and not self._manifest.deletes

    # --- Reads -------------------------------------------------------------------------------

    def fetch(self, keys: Sequence[str], projection: S.Projection = S.Projection()) -> DataFrame:
        self._open("fetch")
        return writes.fetch(self.live(), list(keys), projection.columns(self.schema))

    def _where(self, text: str | None) -> Column | None:
        return compile_filter(text, self.schema) if text and text.strip() else None

    def _target(self, q: VectorQuery) -> str:
        given = [n for n in ("vector", "sparse", "primary_key", "fts") if getattr(q, n) is not None]
        if len(given) > 1:
            raise InvalidArgument(f"one target, not {given}", "query", self.path)
        if not 0 < q.k <= search.MAX_K:
            raise InvalidArgument(f"k must be from 1 to {search.MAX_K}", "query", self.path)
        return given[0] if given else ""

    def _scored(self, q: VectorQuery, live: DataFrame, where: Column | None, k: int) -> tuple[DataFrame, S.MetricType | str]:
        """_doc_id, _pk, _score of the k best rows of one branch, and what kind of score it is."""
        target = self._target(q)
        filtered = live if where is None else live.where(where)
        if not target:
            if q.params is not None:
                raise InvalidArgument("a filter takes no parameters", "query", self.path)
            return filtered.select("_doc_id", "_pk", F.lit(0.0).alias("_score")).orderBy("_doc_id").limit(k), S.MetricType.L2
        if not q.field:
            raise InvalidArgument("a field is needed", "query", self.path)
        f = self.schema.field(q.field)
        index, params = f.effective_index, q.params
        if index is None:
            raise InvalidArgument(f"{f.name} can't be searched", "query", self.path)
        if params is not None:
            params.validate()
            if params.index_type != index.index_type:
                raise InvalidArgument(f"parameters of {params.index_type.name} for an index of {index.index_type.name}", "query", self.path)
        if target == "fts" or isinstance(index, S.FTSIndexParams):
            if not (target == "fts" and isinstance(index, S.FTSIndexParams)):
                raise InvalidArgument("text search and a text index belong together", "query", self.path)
            return self._text(q, f, where, k), "fts"
        column = f"`{f.name}`"
        vector: Any = q.vector if target == "vector" else q.sparse
        if target == "primary_key":
            vector = search.stored_vector(live, q.primary_key, "_pk", f.name)
            if f.data_type.is_sparse:
                vector = dict(zip(vector["indices"], vector["values"], strict=True))
        if f.data_type.is_sparse != isinstance(vector, dict):
            raise InvalidArgument(f"{f.name} takes another kind of vector", "query", self.path)
        radius = params.radius if params else 0.0
        rows = filtered.where(F.col(column).isNotNull())
        if f.data_type.is_sparse:
            return self._sparse(f, index, params, vector, where, rows, k, radius).select("_doc_id", "_pk", "_score"), S.MetricType.IP
        if len(vector) != f.dimension or not all(math.isfinite(x) for x in vector):
            raise InvalidArgument(f"{f.name} takes {f.dimension} finite components", "query", self.path)
        return self._dense(f, index, params, list(vector), where, rows, k, radius).select("_doc_id", "_pk", "_score"), index.metric

    def _indexed(self, f: S.FieldSchema, params: S.QueryParams | None, vector: Any, where: Column | None, k: int, radius: float) -> tuple[DataFrame, DataFrame] | None:
        """Hits (_doc_id, _score) of the segments' indexes, and the live rows that none covers; null where there is no index to use."""
        from ..ann import indexes

        artifacts = self._artifacts(f) if self._stored(f) else {}
        coded = isinstance(f.index, S.HNSWRaBitQIndexParams)  # its linear scan reads codes
        if not artifacts or (params and params.linear and not coded):
            return None
        old, rest = self._live(list(artifacts))
        if where is not None:
            old, rest = old.where(where), rest.where(where)
        allowed = None if where is None and self._untouched() else old.where(F.col(f"`{f.name}`").isNotNull()).select("_doc_id")
        p = params or S.QUERY_PARAMS[f.index.index_type]()
        found = [indexes.search(self.spark, path, f, p, vector, k, allowed, radius, self.runtime.brute_force_by_keys_ratio) for path in artifacts.values()]
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        return whole, rest.where(F.col(f"`{f.name}`").isNotNull())

    def _hits(self, found: DataFrame, metric: S.MetricType, k: int, live: DataFrame) -> DataFrame:
        """live's rows of the k best hits, with _score."""
        best = search.top_k(found, metric, k)  # k rows at most
        return live.join(F.broadcast(best), "_doc_id")

    def _sparse(self, f: S.FieldSchema, index: S.VectorIndexParams, params: S.QueryParams | None, vector: dict[int, float], where: Column | None, rows: DataFrame, k: int, radius: float) -> DataFrame:
        """Through the graph if there is one; half-precision values, refined on request, if the index asks for them."""
        half, refine = index.quantize == S.QuantizeType.FP16, bool(params and params.use_refiner)
        wide = max(k, int(k * getattr(params, "scale_factor", 10.0))) if refine else k
        column, metric = F.col(f"`{f.name}`"), S.MetricType.IP
        value = F.struct(column["indices"].alias("indices"), V.to_half(column["values"]).alias("values")) if half else column
        indexed = self._indexed(f, params, vector, where, wide, 0.0 if refine else radius)
        if indexed is None and not (half and refine):
            return search.top_k(rows.withColumn("_score", V.sparse_inner_product(value, vector)), metric, k, radius=radius)
        found, rest = indexed or (self.spark.createDataFrame([], "_doc_id long, _score double"), rows)
        found = found.unionByName(search.top_k(rest.select("_doc_id", V.sparse_inner_product(value, vector).alias("_score")), metric, wide, radius=0.0 if refine else radius))
        hits = self._hits(found, metric, wide, rows)
        return search.top_k(hits.withColumn("_score", V.sparse_inner_product(column, vector)), metric, k, radius=radius) if refine else hits

    def _dense(self, f: S.FieldSchema, index: S.VectorIndexParams, params: S.QueryParams | None, vector: list[float], where: Column | None, rows: DataFrame, k: int, radius: float) -> DataFrame:
        refine = bool(params and params.use_refiner)
        bits = {S.QuantizeType.INT8: 8, S.QuantizeType.INT4: 4}.get(index.quantize)
        column, metric = F.col(f"`{f.name}`"), index.metric
        scale = getattr(params, "scale_factor", 10.0)
        wide = max(k, int(k * scale)) if refine else k
        if index.quantize == S.QuantizeType.FP16:
            approximate = V.score(metric, V.to_half(column), np.asarray(vector, np.float16).astype(float).tolist())
        else:
            approximate = V.score(metric, column, vector)
        if indexed := self._indexed(f, params, vector, where, wide, 0.0 if refine else radius):
            found, rest = indexed
            more = search.coded(rest, bits, vector, metric, f.name) if bits else rest.select("_doc_id", approximate.alias("_score"))
            found = found.unionByName(search.top_k(more, metric, wide, radius=0.0 if refine else radius))
            hits = self._hits(found, metric, wide, rows)
            return search.top_k(hits.withColumn("_score", V.score(metric, column, vector)), metric, k, radius=radius) if refine else hits
        if bits and refine:
            return search.refined_codes(rows, bits, vector, k, metric, f.name, scale_factor=scale, radius=radius)
        if bits:
            return self._hits(search.top_k(search.coded(rows, bits, vector, metric, f.name), metric, k, radius=radius), metric, k, rows)
        if refine and index.quantize != S.QuantizeType.UNDEFINED:
            return search.refined(rows, approximate, vector, k, metric, f.name, scale_factor=scale, radius=radius)
        return search.top_k(rows.withColumn("_score", approximate), metric, k, radius=radius)

    def _text(self, q: VectorQuery, f: S.FieldSchema, where: Column | None, k: int) -> DataFrame:
        """Through the stored postings; rows that no segment's index covers are analysed now."""
        clause = q.fts
        if (clause.query is None) == (clause.match is None):
            raise InvalidArgument("either a query or a match", "text search", self.path)
        analyzer = Analyzer(f.index)
        default = q.params.default_operator if isinstance(q.params, S.FTSQueryParams) else "OR"
        tree = text_query.parse(clause.query, analyzer.terms, default) if clause.query is not None else text_query.match(clause.match, analyzer.terms, default)
        artifacts = self._artifacts(f)
        old, rest = self._live(list(artifacts))
        stored = text_index.read(self.spark, list(artifacts.values()), None if self._untouched() else old.select(F.col("_doc_id").alias("doc_id"))) if artifacts else None
        fresh = None
        if stored is None or set(artifacts) != set(self._manifest.segments) or self._manifest.log:
            path = Scratch(self.spark).path("text")  # a query reads it several times
            text_index.store(text_index.documents(rest, f.name, analyzer.terms_column), path)
            fresh = text_index.read(self.spark, [path])
        whole = stored.union(fresh) if stored and fresh else stored or fresh
        live = self.live()
        rows = (live if where is None else live.where(where)).select(F.col("_doc_id").alias("doc_id"), "_pk")
        seek = where is not None and rows.count() <= self.runtime.fts_brute_force_by_keys_ratio * max(1, live.count())
        found = text_index.matching(whole.postings, whole.docs, tree, rows if seek else None)
        if where is not None and not seek:
            found = found.join(rows.select("doc_id"), "doc_id", "left_semi")
        best = found.orderBy(F.desc("_score"), "doc_id").limit(k)  # k rows at most
        return rows.join(F.broadcast(best), "doc_id").select(F.col("doc_id").alias("_doc_id"), "_pk", "_score")

    def _projected(self, best: DataFrame, live: DataFrame, projection: S.Projection, *extra: str) -> DataFrame:
        """Fields are read for the few best rows only."""
        columns = projection.columns(self.schema)
        kept = best.drop("_pk")
        return live.select("_doc_id", "_pk", *(F.col(f"`{c}`") for c in columns)).join(F.broadcast(kept), "_doc_id").select("_pk", "_doc_id", "_score", *extra, *(F.col(f"`{c}`") for c in columns))

    def query(self, q: VectorQuery) -> DataFrame:
        """_pk, _doc_id, _score, the projected fields and rank (from 0), best first."""
        self._open("query")
        live = self.live()
        best, kind = self._scored(q, live, self._where(q.filter), q.k)
        metric = S.MetricType.IP if kind == "fts" else kind
        ranked = search.ranked(best, metric)
        return self._projected(ranked, live, q.projection, "rank").orderBy("rank")

    def group_by_query(self, q: GroupByQuery) -> DataFrame:
        """The best rows of the best groups: _group, _group_rank, _rank and what query() gives."""
        self._open("group by")
        schema, live = self.schema, self.live()
        f, g = schema.field(q.field or ""), schema.field(q.group_by)
        if g.data_type.is_vector or g.data_type.is_array:
            raise InvalidArgument(f"{g.name} can't be a group field", "group by", self.path)
        index, params = f.effective_index, q.params
        if not f.data_type.is_vector:
            raise InvalidArgument("groups are made of vector results", "group by", self.path)
        linear = bool(params and params.linear)
        if index.index_type in (S.IndexType.IVF, S.IndexType.VAMANA, S.IndexType.DISKANN) and not linear:
            raise NotSupported(f"{index.index_type.name} needs a linear scan", "group by", self.path)
        if index.index_type == S.IndexType.HNSW and params and params.use_refiner and not linear:
            raise NotSupported("HNSW with a refiner needs a linear scan", "group by", self.path)
        where = self._where(q.filter)
        rows = (live if where is None else live.where(where)).where(F.col(f"`{f.name}`").isNotNull())
        target = self._target(q)
        vector: Any = q.vector if target == "vector" else q.sparse
        if target == "primary_key":
            vector = search.stored_vector(live, q.primary_key, "_pk", f.name)
            if f.data_type.is_sparse:
                vector = dict(zip(vector["indices"], vector["values"], strict=True))
        elif target not in ("vector", "sparse"):
            raise InvalidArgument("groups need a vector or a key", "group by", self.path)
        bits = {S.QuantizeType.INT8: 8, S.QuantizeType.INT4: 4}.get(index.quantize)
        column = F.col(f"`{f.name}`")
        named = search.group_value(rows, g.name)
        radius = params.radius if params else 0.0
        walked = self._walked_groups(f, params, vector, where, named, q, radius)
        if walked is not None:
            found = search.groups(walked, F.col("_named"), q.group_count, q.top_k_per_group, index.metric, radius=radius).select("_doc_id", "_score", "_group", "_group_rank", "_rank")
            return self._projected(found, live, q.projection, "_group", "_group_rank", "_rank").orderBy("_group_rank", "_rank")
        if f.data_type.is_sparse:
            value = V.sparse_inner_product(column, vector)
        elif bits and not (params and params.use_refiner):
            value = V.quantized_score(index.metric, V.quantize(column, bits), list(vector), bits)
        else:
            value = V.score(index.metric, column, list(vector))
        scored = rows.withColumn("_score", value)
        found = search.groups(scored, named, q.group_count, q.top_k_per_group, index.metric, radius=radius)
        found = found.select("_doc_id", "_score", "_group", "_group_rank", "_rank")
        return self._projected(found, live, q.projection, "_group", "_group_rank", "_rank").orderBy("_group_rank", "_rank")

    def _walked_groups(self, f: S.FieldSchema, params: S.QueryParams | None, vector: Any, where: Column | None, named: Column, q: GroupByQuery, radius: float) -> DataFrame | None:
        """_doc_id, _score, _named of a graph's best rows of enough groups, and of all rows that no graph covers; null without a graph."""
        from ..ann import indexes

        artifacts = self._artifacts(f) if self._stored(f) and f.index.index_type in (S.IndexType.HNSW, S.IndexType.HNSW_RABITQ) else {}
        if not artifacts or (params and params.linear):
            return None
        parts = []
        for df in self._live(list(artifacts)):
            df = df if where is None else df.where(where)
            parts.append(df.where(F.col(f"`{f.name}`").isNotNull()).withColumn("_named", named))
        p = params or S.QUERY_PARAMS[f.index.index_type]()
        allowed = parts[0].select("_doc_id", F.col("_named").alias("_group"))
        value = V.sparse_inner_product(F.col(f"`{f.name}`"), vector) if f.data_type.is_sparse else V.score(f.index.metric, F.col(f"`{f.name}`"), list(vector))
        found = parts[1].select("_doc_id", "_named", value.alias("_score"))
        for path in artifacts.values():
            hits = indexes.search(self.spark, path, f, p, vector, q.group_count * q.top_k_per_group, allowed, radius, self.runtime.brute_force_by_keys_ratio, (q.group_count, q.top_k_per_group))
            found = found.unionByName(hits.join(parts[0].select("_doc_id", "_named"), "_doc_id"))
        return found

    def multi_query(self, q: MultiQuery) -> DataFrame:
        """Branches over one version, fused: _pk, _doc_id, _score and the projected fields, best first."""
        self._open("multi query")
        if len(q.branches) < 2:
            raise InvalidArgument("two branches or more", "multi query", self.path)
        live, where = self.live(), self._where(q.filter)
        ranked, kinds = [], []
        for b in q.branches:
            if b.query.filter:
                raise InvalidArgument("the filter is shared by all branches", "multi query", self.path)
            if not 0 < b.num_candidates <= search.MAX_K:
                raise InvalidArgument("num_candidates is out of range", "multi query", self.path)
            best, kind = self._scored(b.query, live, where, b.num_candidates)
            ranked.append(search.ranked(best, S.MetricType.IP if kind == "fts" else kind))
            kinds.append(kind)
        if q.reranker == "rrf":
            fused = fusion.rrf(ranked, q.k, q.rank_constant)
        elif q.reranker == "weighted":
            fused = fusion.weighted(ranked, kinds, [b.weight for b in q.branches], q.k)
        elif callable(q.reranker):
            fused = fusion.callback(ranked, q.reranker, q.k)
        else:
            raise InvalidArgument(f"reranker {q.reranker!r}", "multi query", self.path)
        return self._projected(fused.drop("_pk"), live, q.projection).orderBy(F.desc("_score"), "_pk", "_doc_id")
