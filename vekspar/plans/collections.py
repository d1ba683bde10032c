"""Queries through collections: writes, recovery, schema changes, indexes and searches, over whole tables.

Each opens a collection of its own in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..schema import CollectionSchema, DataType, FieldSchema, MetricType
from ..scratch import Scratch
from ..store.collection import Collection, FTSClause, GroupByQuery, MultiQuery, SubQuery, VectorQuery
from .catalogue import _KEYED, _SCALED, _group_sql, _hybrid_sql, _live_batch, _ranked_sql, _text_sql, keyed, micro, query, scaled, sparse_orders, table

CUSTOMERS = CollectionSchema("customers", (FieldSchema("c_name", DataType.STRING), FieldSchema("c_acctbal", DataType.DOUBLE, True), FieldSchema("seg", DataType.STRING, True)))


def _created(spark: SparkSession, schema: CollectionSchema) -> tuple[Collection, str]:
    path = Scratch(spark).path("collection")
    return Collection.create_and_open(spark, path, schema), path


def _reopened(c: Collection, path: str) -> Collection:
    c.close()
    return Collection.open(c.spark, path)


def _customers(spark: SparkSession, sf_dir: str) -> tuple[Collection, str]:
    c, path = _created(spark, CUSTOMERS)
    rows = keyed(spark, sf_dir)
    c.insert_frame(rows.select(F.col("_doc_id").alias("_pos"), "_pk", "c_name", "c_acctbal", "seg"))
    c.flush()
    return c, path


# --- Writes --------------------------------------------------------------------------------

_N = "(SELECT count(*) FROM customer)"
_ORDERS = "(SELECT o_orderkey AS _pos, 'c' || (o_custkey * 2) AS _pk, 'new' || o_orderkey AS c_name, nullif(o_orderstatus, 'F') AS seg FROM orders)"
_INSERTED = f"(SELECT _pk, CAST(row_number() OVER (ORDER BY _doc_id) - 1 AS BIGINT) AS _doc_id, c_name, c_acctbal, seg FROM {_KEYED})"
#: What an upsert of all orders' keys leaves: the last of each key, balances kept.
_UPSERTED = f"(SELECT _pk, _doc_id, c_name, c_acctbal, seg FROM (SELECT b._pk, CAST({_N} - 1 + row_number() OVER (ORDER BY b._pos) AS BIGINT) AS _doc_id, b.c_name, l.c_acctbal, b.seg, row_number() OVER (PARTITION BY b._pk ORDER BY b._pos DESC) AS turn FROM {_ORDERS} b LEFT JOIN {_INSERTED} l ON l._pk = b._pk) WHERE turn = 1 UNION ALL SELECT * FROM {_INSERTED} WHERE _pk NOT IN (SELECT _pk FROM {_ORDERS}))"


def _upsert(c: Collection, spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.merge_frame(_live_batch(spark, sf_dir)[1].drop("c_acctbal"))


@query("collection_writes", f"SELECT * FROM {_UPSERTED} WHERE NOT coalesce(c_acctbal < 0 AND seg <> 'MACHINERY', false)")
def collection_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, flush, upsert, close, open, delete by filter, flush: what is live, read anew."""
    c, path = _customers(spark, sf_dir)
    _upsert(c, spark, sf_dir)
    c = _reopened(c, path)
    c.delete_by_filter("c_acctbal < 0 AND seg != 'MACHINERY'")
    c.flush()
    return _reopened(c, path).live().select("_pk", "_doc_id", "c_name", "c_acctbal", "seg")


@query("collection_write_results", f"SELECT b._pos, b._pk, CAST({_N} - 1 + row_number() OVER (ORDER BY b._pos) AS BIGINT) AS _doc_id, CAST(NULL AS VARCHAR) AS _error FROM {_ORDERS} b")
def collection_write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported ids of an upsert are those that are stored."""
    c, _ = _customers(spark, sf_dir)
    return _upsert(c, spark, sf_dir).select("_pos", "_pk", "_doc_id", "_error")


@query("collection_optimize", f"SELECT * FROM {_UPSERTED}")
def collection_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction changes no row."""
    c, path = _customers(spark, sf_dir)
    _upsert(c, spark, sf_dir)
    c.optimize()
    return _reopened(c, path).live().select("_pk", "_doc_id", "c_name", "c_acctbal", "seg")


@query("collection_recovery", f"SELECT * FROM {_INSERTED}")
def collection_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-overs of a write that was cut off, and a torn manifest, change nothing."""
    c, path = _customers(spark, sf_dir)
    keyed(spark, sf_dir).write.parquet(f"{path}/data/log-99-torn")
    c._files.create("manifest-999.json", '12345\n{"generation": 999, "sch')
    c = _reopened(c, path)
    if c._files.exists("data/log-99-torn") or c._files.exists("manifest-999.json"):
        raise AssertionError("left-overs stay")
    return c.live().select("_pk", "_doc_id", "c_name", "c_acctbal", "seg")


@query("collection_isolation", f"SELECT * FROM {_INSERTED}")
def collection_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader keeps the version that it opened while a writer goes on."""
    from ..store.collection import Options

    c, path = _customers(spark, sf_dir)
    reader = Collection.open(spark, path, Options(read_only=True))
    _upsert(c, spark, sf_dir)
    return reader.live().select("_pk", "_doc_id", "c_name", "c_acctbal", "seg")


@query("collection_state", f"SELECT (SELECT count(*) FROM {_UPSERTED})::BIGINT AS documents, 2::BIGINT AS segments, (SELECT count(DISTINCT _pk) FROM {_ORDERS} WHERE _pk IN (SELECT _pk FROM {_INSERTED}))::BIGINT AS deleted")
def collection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = _customers(spark, sf_dir)
    _upsert(c, spark, sf_dir)
    c.flush()
    s = c.stats()
    return spark.createDataFrame([(s["documents"], s["segments"], s["deleted"])], "documents long, segments long, deleted long")


@query("collection_fetch", f"SELECT CAST(k.i AS BIGINT) AS _pos, k.k AS _pk, d._doc_id, d.c_name, d._pk IS NOT NULL AS _found FROM (VALUES (0, 'c7'), (1, 'nobody'), (2, 'c3'), (3, 'c7')) k(i, k) LEFT JOIN {_INSERTED} d ON d._pk = k.k")
def collection_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = _customers(spark, sf_dir)
    return c.fetch(["c7", "nobody", "c3", "c7"], S.Projection(["c_name"])).select("_pos", "_pk", "_doc_id", "c_name", "_found")


@query("collection_filter_query", f"SELECT _pk, _doc_id, c_name, CAST(row_number() OVER (ORDER BY _doc_id) - 1 AS BIGINT) AS rank FROM {_INSERTED} WHERE c_acctbal > 5000 AND seg IN ('MACHINERY', 'FURNITURE') ORDER BY _doc_id LIMIT 40")
def collection_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = _customers(spark, sf_dir)
    return c.query(VectorQuery(filter="c_acctbal > 5000 AND seg IN ('MACHINERY', 'FURNITURE')", k=40, projection=S.Projection(["c_name"]))).select("_pk", "_doc_id", "c_name", "rank")


# --- Schema changes ------------------------------------------------------------------------

_PRICES = CollectionSchema("parts", (FieldSchema("size", DataType.INT32), FieldSchema("price", DataType.DOUBLE), FieldSchema("name", DataType.STRING)))


@query("collection_columns", "SELECT 'p' || p_partkey AS _pk, CAST(p_size * 3 - 1 AS BIGINT) AS tripled, CAST(p_size AS BIGINT) AS width, p_name AS name FROM part")
def collection_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added by an expression, one renamed, one widened, one dropped; read after opening again."""
    c, path = _created(spark, _PRICES)
    p = table(spark, sf_dir, "part")
    c.insert_frame(p.select(F.col("p_partkey").alias("_pos"), F.concat(F.lit("p"), "p_partkey").alias("_pk"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name")))
    c.add_column(FieldSchema("tripled", DataType.INT64), "size * 3 - 1")
    c.alter_column("size", rename="width")
    c.alter_column("width", changed=FieldSchema("width", DataType.INT64))
    c.drop_column("price")
    return _reopened(c, path).live().select("_pk", "tripled", "width", "name")


# --- Vectors -------------------------------------------------------------------------------

#: Components as the collection stores them, in single precision.
_SINGLE = f"(SELECT vec_id, label, list_transform(v, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS v FROM {_SCALED})"


def _single(sql: str) -> str:
    return sql.replace(_SCALED, _SINGLE)


def _vectors(spark: SparkSession, sf_dir: str, index: S.IndexParams, halves: bool = False) -> Collection:
    """All vectors under keys 'v...'; with halves, in two segments and a log, so that an index covers a part of them."""
    c, _ = _created(spark, CollectionSchema("vectors", (FieldSchema("label", DataType.INT32), FieldSchema("v", DataType.VECTOR_FP32, True, 64, index))))
    d = scaled(spark, sf_dir).select(F.col("vec_id").alias("_pos"), F.concat(F.lit("v"), "vec_id").alias("_pk"), "label", F.col("v").cast("array<float>").alias("v"))
    if not halves:
        c.insert_frame(d)
        c.flush()
        return c
    size = d.count()
    for low, high in ((0, 0.4), (0.4, 0.8), (0.8, 2.0)):
        c.insert_frame(d.where(F.col("_pos").between(int(low * size), int(high * size) - 1)))
        if high < 1:
            c.flush()
    return c


def _told(found: DataFrame) -> DataFrame:
    return found.select(F.substring("_pk", 2, 20).cast("long").alias("vec_id"), "rank", micro(F.col("_score")).alias("score"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    from ..operators import search

    return list(search.stored_vector(scaled(spark, sf_dir).withColumn("v", F.col("v").cast("array<float>")), 7, "vec_id", "v"))


def _collection_search(name: str, index: S.IndexParams, metric: MetricType, where: str | None = None, sql_where: str = "true", params: S.QueryParams | None = None, by_key: bool = False, halves: bool = False) -> None:
    @query(name, _single(_ranked_sql(metric, 10, sql_where)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _vectors(spark, sf_dir, index, halves)
        target = {"primary_key": "v7"} if by_key else {"vector": _query_vector(spark, sf_dir)}
        return _told(c.query(VectorQuery("v", **target, filter=where, params=params, k=10)))


_collection_search("collection_flat", S.FlatIndexParams(MetricType.COSINE), MetricType.COSINE, "label IN (1, 2, 3)", "label IN (1, 2, 3)")
_collection_search("collection_by_key", S.FlatIndexParams(MetricType.IP), MetricType.IP, "label != 0", "label <> 0", by_key=True)
_collection_search("collection_ivf", S.IVFIndexParams(MetricType.L2, n_list=8), MetricType.L2, params=S.IVFQueryParams(n_probe=8), halves=True)
_collection_search("collection_hnsw_filtered", S.HNSWIndexParams(MetricType.L2, m=16, ef_construction=60), MetricType.L2, "label = 3", "label = 3", S.HNSWQueryParams(ef=300), halves=True)
_collection_search("collection_int8_refined", S.HNSWIndexParams(MetricType.L2, S.QuantizeType.INT8, m=16, ef_construction=60), MetricType.L2, params=S.HNSWQueryParams(ef=400, use_refiner=True))
_collection_search("collection_linear", S.VamanaIndexParams(MetricType.MIPSL2), MetricType.MIPSL2, params=S.VamanaQueryParams(linear=True))


@query("collection_index_changes", _single(_ranked_sql(MetricType.COSINE, 10)))
def collection_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is created over two segments and a log, dropped, and created under another metric; optimize() folds all."""
    c = _vectors(spark, sf_dir, S.FlatIndexParams(MetricType.L2), halves=True)
    c.create_index("v", S.HNSWIndexParams(MetricType.L2, m=8, ef_construction=20))
    before = c.stats()["index_completeness"]["v"]
    c.drop_index("v")
    c.create_index("v", S.HNSWIndexParams(MetricType.COSINE, m=16, ef_construction=60))
    c.optimize()
    if not (0.6 < before < 0.7 and c.stats()["index_completeness"]["v"] == 1.0):
        raise AssertionError("completeness")
    return _told(c.query(VectorQuery("v", vector=_query_vector(spark, sf_dir), params=S.HNSWQueryParams(ef=400), k=10)))


@query("collection_groups", _single(_group_sql("CAST(label AS VARCHAR)", _SCALED, MetricType.L2, 4, 3)))
def collection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups through the graph."""
    c = _vectors(spark, sf_dir, S.HNSWIndexParams(MetricType.L2, m=16, ef_construction=60))
    found = c.group_by_query(GroupByQuery("v", vector=_query_vector(spark, sf_dir), group_by="label", group_count=4, top_k_per_group=3, params=S.HNSWQueryParams(ef=400)))
    return found.select(F.col("_group").alias("grp"), F.col("_group_rank").alias("group_rank"), F.col("_rank").alias("rank"), F.substring("_pk", 2, 20).cast("long").alias("vec_id"), micro(F.col("_score")).alias("score"))


@query("collection_sparse", "WITH s AS (SELECT l_orderkey AS k, l_partkey % 50 AS i, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2) SELECT order_id, CAST(row_number() OVER (ORDER BY s DESC, order_id) - 1 AS BIGINT) AS rank, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score FROM (SELECT a.k AS order_id, coalesce(sum(a.x * q.x), 0) AS s FROM s a LEFT JOIN (VALUES (3, 1.5), (17, 2.0), (40, 0.25)) q(i, x) ON a.i = q.i GROUP BY a.k ORDER BY s DESC, order_id LIMIT 20)")
def collection_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-precision values (whole numbers here, so nothing is lost) and a refiner."""
    c, _ = _created(spark, CollectionSchema("sparse", (FieldSchema("v", DataType.SPARSE_VECTOR_FP32, True, 0, S.FlatIndexParams(MetricType.IP, S.QuantizeType.FP16)),)))
    d = sparse_orders(spark, sf_dir)
    c.insert_frame(d.select(F.col("order_id").alias("_pos"), F.concat(F.lit("o"), "order_id").alias("_pk"), F.struct(F.col("v.indices").cast("array<bigint>").alias("indices"), F.col("v.values").cast("array<float>").alias("values")).alias("v")))
    c.flush()
    found = c.query(VectorQuery("v", sparse={3: 1.5, 17: 2.0, 40: 0.25}, k=20, params=S.FlatQueryParams(use_refiner=True)))
    return found.select(F.substring("_pk", 2, 20).cast("long").alias("order_id"), "rank", micro(F.col("_score")).alias("score"))


# --- Text and hybrid queries ---------------------------------------------------------------

TEXTS = CollectionSchema("texts", (FieldSchema("text", DataType.STRING, True, index=S.FTSIndexParams("whitespace", ("lowercase",))), FieldSchema("lang", DataType.STRING, True), FieldSchema("v", DataType.VECTOR_FP32, True, 64, S.FlatIndexParams(MetricType.L2))))


def _texts(spark: SparkSession, sf_dir: str) -> Collection:
    """All documents with the vector of their number: half of them in an indexed segment, then a segment and a log."""
    c, _ = _created(spark, TEXTS)
    v = scaled(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("v").cast("array<float>").alias("v"))
    d = table(spark, sf_dir, "documents").join(v, "doc_id", "left").select(F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("_pk"), "text", "lang", "v")
    c.insert_frame(d.where("_pos % 4 < 2"))
    c.flush()
    c.insert_frame(d.where("_pos % 4 = 2"))
    c.flush()
    c.insert_frame(d.where("_pos % 4 = 3"))
    return c


def _text_query(name: str, sql: str, clause: FTSClause, k: int, where: str | None = None) -> None:
    @query(name, sql.replace("ORDER BY s DESC, doc_id", "ORDER BY s DESC, doc_id % 4 >= 2, doc_id % 4 = 3, doc_id"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _texts(spark, sf_dir).query(VectorQuery("text", fts=clause, filter=where, k=k, projection=S.Projection([])))
        return found.select(F.col("_pk").cast("long").alias("doc_id"), "rank", micro(F.col("_score")).alias("score"))


_text_query("collection_text", _text_sql({"the": 1.0, "of": 1.0}, "m0 + m1 > 0", "s0 + s1", 20), FTSClause(match="The of"), 20)
_text_query("collection_text_filtered", _text_sql({"de": 1.0, "la": 1.0}, "m0 + m1 > 0", "s0 + s1", 20, "documents.lang = 'es'"), FTSClause(match="de la"), 20, "lang = 'es'")
_text_query("collection_text_boolean", _text_sql({"the": 1.0, "with": 1.0, "of": 1.0}, "m0 = 1 AND m2 = 0", "s0 + s1", 20), FTSClause(query="+the with NOT of"), 20)


def _multi(name: str, sql: str, weights: tuple[float, float], reranker) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _texts(spark, sf_dir)
        near = SubQuery(VectorQuery("v", vector=_query_vector(spark, sf_dir)), 10, weights[0])
        words = SubQuery(VectorQuery("text", fts=FTSClause(match="the of heed")), 10, weights[1])
        found = c.multi_query(MultiQuery([near, words], "lang = 'en'", 10, reranker, projection=S.Projection([])))
        return found.select(F.col("_pk").alias("pk"), micro(F.col("_score")).alias("score"))


_IN_ORDER = ("ORDER BY s DESC, doc_id", "ORDER BY s DESC, doc_id % 4 >= 2, doc_id % 4 = 3, doc_id")
_multi("collection_multi_rrf", _single(_hybrid_sql("1.0 / (60 + rank + 1)")).replace(*_IN_ORDER), (1.0, 1.0), "rrf")
_multi("collection_multi_weighted", _single(_hybrid_sql("CASE kind WHEN 'l2' THEN 0.7 * (1 - 2 * atan(s) / pi()) ELSE 0.3 * (2 * atan(s) / pi()) END")).replace(*_IN_ORDER), (0.7, 0.3), "weighted")
