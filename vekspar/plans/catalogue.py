"""The engine's registered queries and their equivalents in SQL.

Scores that go through ln or atan, or are summed in another order, are compared as
floor(x * 1e6 + 0.5). Ranks and counts are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..filters.language import compile_filter
from ..fts import analysis
from ..fts import index as text_index
from ..fts import query as text_query
from ..functions import vectors as V
from ..operators import fusion, search, writes
from ..operators.expressions import compile_expression
from ..scratch import Scratch
from ..schema import CollectionSchema, DataType, FieldSchema, MetricType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("long")


# --- Filters -------------------------------------------------------------------------------

PART = CollectionSchema("part", (
    FieldSchema("p_partkey", DataType.INT64), FieldSchema("p_name", DataType.STRING), FieldSchema("p_brand", DataType.STRING, True), FieldSchema("p_type", DataType.STRING),
    FieldSchema("p_size", DataType.INT32, True), FieldSchema("p_retailprice", DataType.DOUBLE), FieldSchema("tags", DataType.ARRAY_STRING, True), FieldSchema("price32", DataType.FLOAT), FieldSchema("raw", DataType.BINARY),
))
_PART_SQL = "(SELECT p_partkey, p_name, nullif(p_brand, (SELECT min(p_brand) FROM part)) AS p_brand, p_type, nullif(p_size, 7) AS p_size, p_retailprice, CASE WHEN p_size <= 45 THEN string_split(p_name, ' ') END AS tags, CAST(p_retailprice AS FLOAT) AS price32 FROM part)"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with nulls and an array column."""
    p = table(spark, sf_dir, "part")
    least = p.agg(F.min("p_brand").alias("least"))
    p = p.join(F.broadcast(least))  # one row
    return p.select("p_partkey", "p_name", F.nullif("p_brand", "least").alias("p_brand"), "p_type", F.nullif("p_size", F.lit(7)).alias("p_size"), "p_retailprice", F.when(F.col("p_size") <= 45, F.split("p_name", " ")).alias("tags"), F.col("p_retailprice").cast("float").alias("price32"), F.encode("p_name", "UTF-8").alias("raw"))


def _filter(name: str, text: str, sql: str) -> None:
    @query(name, f"SELECT p_partkey FROM {_PART_SQL} WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return part(spark, sf_dir).where(compile_filter(text, PART)).select("p_partkey")


_filter("filter_cmp_and_or", "p_size >= 10 AND (p_retailprice < 950.5 OR p_size != 20) AND p_brand > 'Brand#2'", "p_size >= 10 AND (p_retailprice < 950.5 OR p_size <> 20) AND p_brand > 'Brand#2'")
_filter("filter_in", "p_size IN (1, 7, 12, 30) OR p_size = 45 OR p_size = 1", "p_size IN (1, 7, 12, 30, 45)")
_filter("filter_not_in", "p_size NOT IN (1, 2, 3) AND p_brand NOT IN ('Brand#11', 'Brand#23')", "p_size NOT IN (1, 2, 3) AND p_brand NOT IN ('Brand#11', 'Brand#23')")
_filter("filter_like_prefix", "p_brand LIKE 'Brand#1%'", "p_brand LIKE 'Brand#1%'")
_filter("filter_like_middle", "p_type LIKE '%A%' AND p_name LIKE '_a%'", "p_type LIKE '%A%' AND p_name LIKE '_a%'")
_filter("filter_like_escape", r"p_brand LIKE 'Br\and\#_2' OR p_name LIKE '100\%%'", r"p_brand LIKE 'Brand#_2' OR p_name LIKE '100\%%' ESCAPE '\'")
_filter("filter_null", "p_size IS NULL OR (p_brand IS NOT NULL AND p_size < 3)", "p_size IS NULL OR (p_brand IS NOT NULL AND p_size < 3)")
_filter("filter_array_null", "tags IS NULL", "tags IS NULL")
_filter("filter_float_suffix", "price32 > 9.5e2f AND p_retailprice <= 1.0E3D", "price32 > CAST(950 AS FLOAT) AND p_retailprice <= 1000")
_filter("filter_array_length", "array_length(tags) >= 2", "len(tags) >= 2")


def _contain(name: str, text: str, sql: str) -> None:
    @query(name, f"SELECT p_partkey FROM {_PART_SQL} WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return part(spark, sf_dir).where(compile_filter(text, PART)).select("p_partkey")


_FIRST, _SECOND = "red", "blue"
_contain("filter_contain_all", f"tags CONTAIN_ALL ('{_FIRST}', 'plate')", f"list_has_all(tags, ['{_FIRST}', 'plate'])")
_contain("filter_contain_any", f"tags CONTAIN_ANY ('{_FIRST}', '{_SECOND}', 'large')", f"list_has_any(tags, ['{_FIRST}', '{_SECOND}', 'large'])")
_contain("filter_not_contain_any", f"tags NOT CONTAIN_ANY ('{_FIRST}', 'small')", f"NOT list_has_any(tags, ['{_FIRST}', 'small'])")
_contain("filter_contain_empty", "tags CONTAIN_ALL () AND tags NOT CONTAIN_ANY ()", "tags IS NOT NULL")
_contain("filter_contain_none", "tags CONTAIN_ANY () OR tags NOT CONTAIN_ALL ()", "false")


@query("filter_binary", "SELECT p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part) OR p_name >= 'r'")
def filter_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    least = p.agg(F.min("p_name")).first()[0]
    quoted = least.replace("'", "\\'")
    return p.where(compile_filter(f"raw = '{quoted}' OR raw >= 'r'", PART)).select("p_partkey")


@query("filter_only_query", "SELECT e AS event_id, CAST(row_number() OVER (ORDER BY e) - 1 AS BIGINT) AS rank, 0.0::DOUBLE AS score FROM (SELECT event_id AS e FROM events WHERE event_type = 'click' AND value > 10 ORDER BY event_id LIMIT 25)")
def filter_only_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = CollectionSchema("events", (FieldSchema("event_type", DataType.STRING), FieldSchema("value", DataType.DOUBLE)))
    best = table(spark, sf_dir, "events").where(compile_filter("event_type = 'click' AND value > 10", kind)).orderBy("event_id").limit(25).select("event_id", F.lit(0.0).alias("score"))
    return search.ranked(best, MetricType.L2, "event_id", "score")


# --- Scans and projection ------------------------------------------------------------------


@query("project_subset", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def project_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = CollectionSchema("customer", (FieldSchema("c_custkey", DataType.INT64), FieldSchema("c_name", DataType.STRING), FieldSchema("c_nationkey", DataType.INT32), FieldSchema("c_acctbal", DataType.DOUBLE), FieldSchema("c_mktsegment", DataType.STRING)))
    return table(spark, sf_dir, "customer").select(S.Projection(["c_custkey", "c_name", "c_acctbal"]).columns(kind))


_KEYED = "(SELECT 'c' || c_custkey AS _pk, c_custkey AS _doc_id, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("_pk"), F.col("c_custkey").alias("_doc_id"), "c_name", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))


@query("fetch_keys", f"SELECT CAST(k.i AS BIGINT) AS _pos, k.k AS _pk, d._doc_id, d.c_name, d._pk IS NOT NULL AS _found FROM (VALUES (0, 'c7'), (1, 'nobody'), (2, 'c3'), (3, 'c7')) k(i, k) LEFT JOIN {_KEYED} d ON d._pk = k.k")
def fetch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.fetch(keyed(spark, sf_dir), ["c7", "nobody", "c3", "c7"], ["c_name"]).select("_pos", "_pk", "_doc_id", "c_name", "_found")


_LOG_SQL = "SELECT 'k' || (event_id % 500) AS _pk, event_id AS _seq, event_id AS _doc_id, CASE WHEN event_type = 'login' THEN 'D' ELSE 'U' END AS _op, value FROM events"


@query("live_scan", f"SELECT _pk, _doc_id, value FROM (SELECT *, row_number() OVER (PARTITION BY _pk ORDER BY _seq DESC) AS n FROM ({_LOG_SQL})) WHERE n = 1 AND _op <> 'D'")
def live_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(F.concat(F.lit("k"), F.col("event_id") % 500).alias("_pk"), F.col("event_id").alias("_seq"), F.col("event_id").alias("_doc_id"), F.when(F.col("event_type") == "login", "D").otherwise("U").alias("_op"), "value")
    return writes.live_rows(log).select("_pk", "_doc_id", "value")


@query("collection_stats", f"SELECT count(DISTINCT _pk) FILTER (WHERE n = 1 AND _op <> 'D')::BIGINT AS documents, count(*) FILTER (WHERE n > 1 OR _op = 'D')::BIGINT AS dead FROM (SELECT *, row_number() OVER (PARTITION BY _pk ORDER BY _seq DESC) AS n FROM ({_LOG_SQL}))")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "events").agg(F.count("*").alias("total"))
    live = live_scan(spark, sf_dir).agg(F.count("*").alias("documents"))
    return live.join(F.broadcast(total)).select("documents", (F.col("total") - F.col("documents")).alias("dead"))  # one row each


# --- Dense vectors -------------------------------------------------------------------------

#: Scaled so that the metrics disagree.
_SCALED = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label / 10.0)) AS v FROM embeddings)"
_Q = f"(SELECT v AS q FROM {_SCALED} WHERE vec_id = 7)"
_IP = "list_inner_product(v, q)"
_METRIC_SQL = {
    MetricType.IP: _IP,
    MetricType.L2: "list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    MetricType.COSINE: f"1 - greatest(-1, least(1, {_IP} / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))))",
    MetricType.MIPSL2: f"2 - 2 * {_IP} / greatest(list_inner_product(v, v), list_inner_product(q, q))",
}


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = 1 + F.col("label").cast("double") / 10.0
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * factor).alias("v"))


def _vector(df: DataFrame, key: int = 7) -> list[float]:
    return search.stored_vector(df, key, "vec_id", "v")


def _ranked_sql(metric: MetricType, k: int, where: str = "true", having: str = "true", extra: str = "") -> str:
    way = "DESC" if metric.descending else "ASC"
    return f"SELECT vec_id, CAST(row_number() OVER (ORDER BY s {way}, vec_id) - 1 AS BIGINT) AS rank, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score{extra} FROM (SELECT vec_id, label, {_METRIC_SQL[metric]} AS s FROM {_SCALED}, {_Q} WHERE {where}) WHERE {having} ORDER BY s {way}, vec_id LIMIT {k}"


def _scored(best: DataFrame, metric: MetricType) -> DataFrame:
    return search.ranked(best, metric, "vec_id").select("vec_id", "rank", micro(F.col("_score")).alias("score"))


for _metric, _name in ((MetricType.L2, "dense_l2"), (MetricType.IP, "dense_ip"), (MetricType.COSINE, "dense_cosine"), (MetricType.MIPSL2, "dense_mips")):

    @query(_name, _ranked_sql(_metric, 10))
    def _dense(spark: SparkSession, sf_dir: str, metric: MetricType = _metric) -> DataFrame:
        d = scaled(spark, sf_dir)
        return _scored(search.dense(d, _vector(d), 10, metric, "v", "vec_id"), metric)


for _metric, _name, _radius in ((MetricType.L2, "dense_radius_l2", 2.6), (MetricType.IP, "dense_radius_ip", 0.4)):

    @query(_name, _ranked_sql(_metric, 50, having=f"s >= {_radius}" if _metric.descending else f"s <= {_radius}"))
    def _dense_radius(spark: SparkSession, sf_dir: str, metric: MetricType = _metric, radius: float = _radius) -> DataFrame:
        d = scaled(spark, sf_dir)
        return _scored(search.dense(d, _vector(d), 50, metric, "v", "vec_id", radius), metric)


@query("dense_filtered", _ranked_sql(MetricType.COSINE, 10, "label IN (1, 2, 3)"))
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scaled(spark, sf_dir)
    kind = CollectionSchema("emb", (FieldSchema("label", DataType.INT32),))
    return _scored(search.dense(d, _vector(d), 10, MetricType.COSINE, "v", "vec_id", where=compile_filter("label = 1 OR label IN (2, 3)", kind)), MetricType.COSINE)


@query("dense_null_vectors", _ranked_sql(MetricType.L2, 10, "label <> 4"))
def dense_null_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scaled(spark, sf_dir)
    q = _vector(d)
    return _scored(search.dense(d.withColumn("v", F.when(F.col("label") != 4, F.col("v"))), q, 10, MetricType.L2, "v", "vec_id"), MetricType.L2)


@query("dense_by_key", _ranked_sql(MetricType.IP, 5, "label <> 0"))
def dense_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key's own row may be outside the filter."""
    d = scaled(spark, sf_dir)
    return _scored(search.dense(d, search.stored_vector(d, 7, "vec_id", "v"), 5, MetricType.IP, "v", "vec_id", where=F.col("label") != 0), MetricType.IP)


@query("dense_batch", f"SELECT query_id, vec_id, rank, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(b.v, a.v) AS s, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(b.v, a.v) DESC, b.vec_id) - 1 AS BIGINT) AS rank FROM {_SCALED} a, {_SCALED} b WHERE a.vec_id % 20 = 0) WHERE rank < 5")
def dense_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scaled(spark, sf_dir)
    return search.batch(d.where("vec_id % 20 = 0"), d, 5, MetricType.IP, "v", "vec_id").select("query_id", "vec_id", "rank", micro(F.col("_score")).alias("score"))


@query("normalize_l2", f"SELECT vec_id, CAST(floor(list_inner_product(v, v) * 1e6 + 0.5) AS BIGINT) AS before, CAST(CASE WHEN label = 3 THEN 0 ELSE 1000000 END AS BIGINT) AS after FROM (SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN label = 3 THEN 0 ELSE x END) AS v FROM {_SCALED})")
def normalize_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scaled(spark, sf_dir).withColumn("v", F.when(F.col("label") == 3, F.transform("v", lambda x: x * 0)).otherwise(F.col("v")))
    d = d.withColumn("u", V.normalize_l2(F.col("v")))
    return d.select("vec_id", micro(V.norm_squared(F.col("v"))).alias("before"), micro(V.norm_squared(F.col("u"))).alias("after"))


# --- Sparse vectors ------------------------------------------------------------------------

_SPARSE = "(SELECT l_orderkey AS k, l_partkey % 50 AS i, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"


def sparse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's quantities by part modulo 50, as struct(indices, values)."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("i")).agg(F.sum("l_quantity").alias("x"))
    pairs = cells.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return pairs.select(F.col("k").alias("order_id"), F.struct(F.col("p.i").alias("indices"), F.col("p.x").alias("values")).alias("v"))


def _sparse_sql(q: str, k: int) -> str:
    return f"SELECT order_id, CAST(row_number() OVER (ORDER BY s DESC, order_id) - 1 AS BIGINT) AS rank, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score FROM (SELECT a.k AS order_id, coalesce(sum(a.x * q.x), 0) AS s FROM {_SPARSE} a LEFT JOIN ({q}) q ON a.i = q.i GROUP BY a.k ORDER BY s DESC, order_id LIMIT {k})"


@query("sparse_ip", _sparse_sql("VALUES (3, 1.5), (17, 2.0), (40, 0.25)", 20).replace(") q ON", ") q(i, x) ON"))
def sparse_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.sparse(sparse_orders(spark, sf_dir), {3: 1.5, 17: 2.0, 40: 0.25}, 20, "v", "order_id")
    return search.ranked(best, MetricType.IP, "order_id").select("order_id", "rank", micro(F.col("_score")).alias("score"))


@query("sparse_by_key", _sparse_sql(f"SELECT i, x FROM {_SPARSE} WHERE k = 7", 10))
def sparse_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sparse_orders(spark, sf_dir)
    v = search.stored_vector(d, 7, "order_id", "v")
    best = search.sparse(d, dict(zip(v["indices"], v["values"], strict=True)), 10, "v", "order_id")
    return search.ranked(best, MetricType.IP, "order_id").select("order_id", "rank", micro(F.col("_score")).alias("score"))


@query("sparse_canonical", f"SELECT k AS order_id, count(*)::BIGINT AS n, CAST(min(i) AS BIGINT) AS first FROM {_SPARSE} GROUP BY k")
def sparse_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates given in the wrong order come out sorted."""
    d = sparse_orders(spark, sf_dir).withColumn("v", F.struct(F.reverse(F.col("v.indices")).alias("indices"), F.reverse(F.col("v.values")).alias("values")))
    c = d.withColumn("c", V.sparse_canonical(F.col("v")))
    return c.select("order_id", F.size("c.indices").cast("long").alias("n"), F.col("c.indices")[0].alias("first"))


# --- Groups --------------------------------------------------------------------------------


def _group_sql(group: str, source: str, metric: MetricType, groups: int, each: int) -> str:
    way = "DESC" if metric.descending else "ASC"
    return f"WITH s AS (SELECT vec_id, {group} AS g, {_METRIC_SQL[metric]} AS s FROM {source}, {_Q}), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s {way}, vec_id) - 1 AS r FROM s), b AS (SELECT g, row_number() OVER (ORDER BY s {way}, g) - 1 AS gr FROM r WHERE r = 0) SELECT r.g AS grp, CAST(gr AS BIGINT) AS group_rank, CAST(r AS BIGINT) AS rank, vec_id, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score FROM r JOIN b ON r.g = b.g WHERE r < {each} AND gr < {groups}"


def _grouped(d: DataFrame, column: str, metric: MetricType, groups: int, each: int) -> DataFrame:
    scored = d.withColumn("_score", V.score(metric, F.col("v"), _vector(d)))
    found = search.groups(scored, search.group_value(d, column), groups, each, metric, "vec_id")
    return found.select(F.col("_group").alias("grp"), F.col("_group_rank").alias("group_rank"), F.col("_rank").alias("rank"), "vec_id", micro(F.col("_score")).alias("score"))


@query("group_topk_label", _group_sql("CAST(label AS VARCHAR)", _SCALED, MetricType.L2, 4, 3))
def group_topk_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(scaled(spark, sf_dir), "label", MetricType.L2, 4, 3)


@query("group_topk_float_key", _group_sql("printf('%.6f', label / 4.0)", _SCALED, MetricType.IP, 5, 2))
def group_topk_float_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(scaled(spark, sf_dir).withColumn("f", F.col("label").cast("double") / 4.0), "f", MetricType.IP, 5, 2)


@query("group_null_key", _group_sql("coalesce(CASE label WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'g' || (label % 3) END, '')", _SCALED, MetricType.COSINE, 10, 2))
def group_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.col("label") == 1, F.lit(None)).when(F.col("label") == 2, F.lit("")).otherwise(F.concat(F.lit("g"), F.col("label") % 3))
    return _grouped(scaled(spark, sf_dir).withColumn("g", g), "g", MetricType.COSINE, 10, 2)


# --- Quantization and refinement -----------------------------------------------------------


def _codes_sql(bits: int) -> str:
    low, high = V.CODES[bits]
    scale = f"({high - low}.0 / greatest(list_max(v) - list_min(v), 1.1920928955078125e-7))"
    t = f"(x * {scale} + ({low} - list_min(v) * {scale}))"
    code = f"greatest({low}, least({high}, sign({t}) * floor(abs({t}) + 0.5)))"
    return f"SELECT vec_id, CAST(list_sum(c) AS BIGINT) AS total, CAST(list_sum(list_transform(c, lambda y: y * y)) AS BIGINT) AS squares FROM (SELECT vec_id, list_transform(v, lambda x: {code}) AS c FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings))"


for _bits, _name in ((8, "quant_int8_codes"), (4, "quant_int4_codes")):

    @query(_name, _codes_sql(_bits))
    def _quantized(spark: SparkSession, sf_dir: str, bits: int = _bits) -> DataFrame:
        q = table(spark, sf_dir, "embeddings").select("vec_id", V.quantize(F.col("embedding"), bits).alias("q"))
        codes = F.col("q.codes")
        return q.select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x * x).alias("squares"))


@query("refine_int8", _ranked_sql(MetricType.L2, 5))
def refine_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty times as many candidates by codes as are wanted, then exact scores."""
    d = scaled(spark, sf_dir)
    q = _vector(d)
    best = search.refined_codes(d, 8, q, 5, MetricType.L2, "v", "vec_id", scale_factor=20.0)
    return _scored(best, MetricType.L2)


#: A value as IEEE half holds it: eleven significant bits, rounded to even.
_STEP = "pow(2, greatest(floor(log2(abs(x))), -14) - 10)"
_HALVES = f"(SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / {_STEP}, 0) * {_STEP} END) AS v FROM (SELECT vec_id, label, list_transform(v, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS v FROM {_SCALED}))"


@query("quant_fp16_scan", _ranked_sql(MetricType.L2, 10).replace(f"FROM {_SCALED}, {_Q}", f"FROM {_HALVES}, {_Q}"))
def quant_fp16_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scaled(spark, sf_dir)
    q = _vector(d)
    half = d.withColumn("h", V.to_half(F.col("v").cast("array<float>")))
    return _scored(search.top_k(half.withColumn("_score", V.score(MetricType.L2, F.col("h"), q)), MetricType.L2, 10, "vec_id"), MetricType.L2)


# --- Indexes -------------------------------------------------------------------------------


def _indexed(index: S.IndexParams, params: S.QueryParams, k: int = 10, label: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..ann import indexes

        d = scaled(spark, sf_dir)
        f = FieldSchema("v", DataType.VECTOR_FP32, True, 64, index)
        path = Scratch(spark).path("index")
        rows = d.select(F.col("vec_id").alias("_doc_id"), "v")
        indexes.build(rows, f, path)
        allowed = None if label is None else d.where(F.col("label") == label).select(F.col("vec_id").alias("_doc_id"))
        found = indexes.search(spark, path, f, params, list(_vector(d)), k, allowed, params.radius)
        return search.ranked(found, index.metric).select(F.col("_doc_id").alias("vec_id"), "rank", micro(F.col("_score")).alias("score"))

    return run


query("ivf_full_probe", _ranked_sql(MetricType.L2, 10))(_indexed(S.IVFIndexParams(MetricType.L2, n_list=16), S.IVFQueryParams(n_probe=16)))
query("ivf_filtered", _ranked_sql(MetricType.L2, 10, "label = 2"))(_indexed(S.IVFIndexParams(MetricType.L2, n_list=8), S.IVFQueryParams(n_probe=8), label=2))
query("hnsw_small_exact", _ranked_sql(MetricType.COSINE, 10))(_indexed(S.HNSWIndexParams(MetricType.COSINE), S.HNSWQueryParams()))
query("vamana_small_exact", _ranked_sql(MetricType.L2, 10))(_indexed(S.VamanaIndexParams(MetricType.L2), S.VamanaQueryParams()))
query("diskann_small_exact", _ranked_sql(MetricType.L2, 10))(_indexed(S.DiskANNIndexParams(MetricType.L2, pq_chunks=16), S.DiskANNQueryParams()))


#: A part's quantities by order modulo 16, as many vectors as parts are sold: above the size at which graphs are exact.
_PARTS = "(SELECT l_partkey AS id, list_transform(range(16), lambda i: CAST(coalesce(list_sum(list_transform(list_filter(p, lambda z: z[1] = i), lambda z: z[2])), 0) AS DOUBLE)) AS v FROM (SELECT l_partkey, list([CAST(l_orderkey % 16 AS DOUBLE), l_quantity]) AS p FROM lineitem GROUP BY l_partkey))"


def part_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns _doc_id, v (array<double>)."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") % 16).alias("i"), "l_quantity")
    sums = [F.coalesce(F.sum(F.when(F.col("i") == i, F.col("l_quantity"))), F.lit(0.0)).cast("double") for i in range(16)]
    return lines.groupBy(F.col("l_partkey").alias("_doc_id")).agg(F.array(*sums).alias("v"))


def sparse_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns _doc_id, v (struct): a part's quantities by supplier modulo 40."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_orderkey") % 40).alias("i")).agg(F.sum("l_quantity").alias("x"))
    pairs = cells.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return pairs.select(F.col("l_partkey").alias("_doc_id"), F.struct(F.col("p.i").alias("indices"), F.col("p.x").alias("values")).alias("v"))


def _recall(name: str, index: S.IndexParams, params: S.QueryParams, floor: float = 0.9, sparse: bool = False) -> None:
    """Recall of the 10 best of each part whose key is divisible by 20 against an exact search over all parts."""

    @query(f"recall_{name}", f"SELECT '{name}' AS index, count(*)::BIGINT AS queries, {floor}::DOUBLE AS floor, true AS enough FROM {_PARTS} WHERE id % 20 = 0")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..ann import indexes

        scratch = Scratch(spark)
        rows = scratch.save(sparse_parts(spark, sf_dir) if sparse else part_vectors(spark, sf_dir), "rows")
        f = FieldSchema("v", DataType.SPARSE_VECTOR_FP32 if sparse else DataType.VECTOR_FP32, True, 0 if sparse else 16, index)
        indexes.build(rows, f, scratch.path("index"))
        asked = rows.where("_doc_id % 20 = 0")
        queries = asked.select(F.col("_doc_id").alias("query_id"), "v")
        truth = search.batch(asked, rows, 10, index.metric, "v")
        truth = truth.where(F.col("_score") > 0) if sparse else truth  # a row without a shared coordinate is no neighbour
        found = scratch.save(indexes.search_many(spark, scratch.path("index"), f, params, queries, 10), "found")
        each = search.recall(truth, found, 10)
        return each.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall")).select(F.lit(name).alias("index"), "queries", F.lit(floor).alias("floor"), (F.col("recall") >= floor).alias("enough"))


_recall("ivf", S.IVFIndexParams(MetricType.L2, n_list=32), S.IVFQueryParams(n_probe=16))
_recall("ivf_int8", S.IVFIndexParams(MetricType.IP, S.QuantizeType.INT8, n_list=16), S.IVFQueryParams(n_probe=12))
_recall("hnsw", S.HNSWIndexParams(MetricType.L2, m=16, ef_construction=80), S.HNSWQueryParams(ef=200))
_recall("hnsw_int8", S.HNSWIndexParams(MetricType.COSINE, S.QuantizeType.INT8, m=16, ef_construction=80), S.HNSWQueryParams(ef=200))
_recall("hnsw_rabitq", S.HNSWRaBitQIndexParams(MetricType.L2, m=16, ef_construction=80), S.HNSWRaBitQQueryParams(ef=200), 0.85)
_recall("rabitq_linear", S.HNSWRaBitQIndexParams(MetricType.L2, m=8, ef_construction=20), S.HNSWRaBitQQueryParams(linear=True), 0.85)
_recall("vamana", S.VamanaIndexParams(MetricType.L2, max_degree=24, search_list_size=60), S.VamanaQueryParams(ef=150))
_recall("diskann", S.DiskANNIndexParams(MetricType.L2, max_degree=24, list_size=60, pq_chunks=16), S.DiskANNQueryParams(list_size=200))
_recall("hnsw_sparse", S.HNSWIndexParams(MetricType.IP, m=16, ef_construction=80), S.HNSWQueryParams(ef=200), sparse=True)


def _filtered_sql(modulus: int) -> str:
    q = f"(SELECT v AS q FROM {_PARTS} WHERE id = 7)"
    return f"SELECT id AS _doc_id, CAST(row_number() OVER (ORDER BY s, id) - 1 AS BIGINT) AS rank, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score FROM (SELECT id, {_METRIC_SQL[MetricType.L2]} AS s FROM {_PARTS}, {q} WHERE id % {modulus} = 1) ORDER BY s, id LIMIT 10"


def _filtered_graph(name: str, index: S.IndexParams, params: S.QueryParams) -> None:
    """The 10 best of the one part in fifty that a filter leaves: few, so they are scanned exactly."""

    @query(name, _filtered_sql(50))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..ann import indexes

        scratch = Scratch(spark)
        rows = scratch.save(part_vectors(spark, sf_dir), "rows")
        f = FieldSchema("v", DataType.VECTOR_FP32, True, 16, index)
        indexes.build(rows, f, scratch.path("index"))
        found = indexes.search(spark, scratch.path("index"), f, params, search.stored_vector(rows, 7, "_doc_id", "v"), 10, rows.where("_doc_id % 50 = 1").select("_doc_id"))
        return search.ranked(found, index.metric).select("_doc_id", "rank", micro(F.col("_score")).alias("score"))


_filtered_graph("hnsw_filtered", S.HNSWIndexParams(MetricType.L2, m=8, ef_construction=40), S.HNSWQueryParams(ef=50))
_filtered_graph("vamana_filtered", S.VamanaIndexParams(MetricType.L2, max_degree=16, search_list_size=40), S.VamanaQueryParams(ef=50))
_filtered_graph("diskann_filtered", S.DiskANNIndexParams(MetricType.L2, max_degree=16, list_size=40, pq_chunks=8), S.DiskANNQueryParams(list_size=50))


@query("hnsw_filtered_walk", f"SELECT least(10, count(*))::BIGINT AS rows, true AS enough FROM {_PARTS} WHERE id % 3 = 1")
def hnsw_filtered_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the parts is allowed and no scan: the walk alone finds ten allowed rows, nine of them right."""
    from ..ann import indexes

    scratch = Scratch(spark)
    rows = scratch.save(part_vectors(spark, sf_dir), "rows")
    f = FieldSchema("v", DataType.VECTOR_FP32, True, 16, S.HNSWIndexParams(MetricType.L2, m=16, ef_construction=80))
    indexes.build(rows, f, scratch.path("index"))
    allowed, q = rows.where("_doc_id % 3 = 1"), search.stored_vector(rows, 7, "_doc_id", "v")
    found = indexes.search(spark, scratch.path("index"), f, S.HNSWQueryParams(ef=100), q, 10, allowed.select("_doc_id"), exact_share=0.0)
    right = search.dense(allowed, q, 10, MetricType.L2, "v").select("_doc_id", F.lit(1).alias("hit"))
    return found.join(right, "_doc_id", "left").agg(F.count("*").alias("rows"), (F.sum("hit") >= 9).alias("enough"))


@query("recall_at_10", f"SELECT id AS query_id, 1.0::DOUBLE AS recall FROM {_PARTS} WHERE id % 20 = 0")
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists probed: an index that leaves nothing out has recall 1 for each query."""
    from ..ann import indexes

    scratch = Scratch(spark)
    rows = scratch.save(part_vectors(spark, sf_dir), "rows")
    f = FieldSchema("v", DataType.VECTOR_FP32, True, 16, S.IVFIndexParams(MetricType.L2, n_list=16))
    indexes.build(rows, f, scratch.path("index"))
    asked = rows.where("_doc_id % 20 = 0")
    found = indexes.search_many(spark, scratch.path("index"), f, S.IVFQueryParams(n_probe=16), asked.select(F.col("_doc_id").alias("query_id"), "v"), 10)
    return search.recall(search.batch(asked, rows, 10, MetricType.L2, "v"), found, 10)


# --- Text ----------------------------------------------------------------------------------

_WORDS = "(SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r\\x0B\\f]+'), lambda x: x <> '') AS w, lang FROM documents)"
_POSTINGS = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM {_WORDS}) GROUP BY 1, 2)"


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.documents(table(spark, sf_dir, "documents"), "text", analysis.simple_terms, "doc_id")


_STORED: dict[tuple[str, str], str] = {}


def text_of(spark: SparkSession, sf_dir: str) -> text_index.Index:
    """The stored index of all documents, made once in a session for each folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        path = Scratch(spark).path("text")
        text_index.store(text_docs(spark, sf_dir), path)
        _STORED[key] = path
    return text_index.read(spark, [_STORED[key]])


def _text(spark: SparkSession, sf_dir: str, tree: text_query.Node, k: int, candidates: DataFrame | None = None) -> DataFrame:
    index = text_of(spark, sf_dir)
    best = text_index.search(index.postings, index.docs, tree, k, candidates)
    return search.ranked(best, MetricType.IP, "doc_id").select("doc_id", "rank", micro(F.col("_score")).alias("score"))


def _terms_of(text: str) -> list[str]:
    return [t for t in text.lower().split() if t]


def _text_sql(parts: dict[str, float], match: str, score: str, k: int, where: str = "true") -> str:
    """parts: terms with boosts; match and score use columns m0, s0, ... in their order."""
    columns = ", ".join(f"max(CASE WHEN term = '{t}' THEN 1 ELSE 0 END) AS m{i}, max(CASE WHEN term = '{t}' THEN {b} * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS s{i}" for i, (t, b) in enumerate(parts.items()))
    terms = ", ".join(f"'{t}'" for t in parts)
    return (
        f"WITH st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM {_WORDS}), p AS (SELECT * FROM {_POSTINGS} WHERE term IN ({terms})), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), "
        f"x AS (SELECT p.doc_id, p.term, p.tf, len(w.w) AS dl, st.avgdl, ln((st.n - d.df + 0.5) / (d.df + 0.5) + 1) AS idf FROM p JOIN d USING (term) JOIN {_WORDS} w ON w.doc_id = p.doc_id, st WHERE true), "
        f"y AS (SELECT doc_id, {columns} FROM x GROUP BY doc_id), z AS (SELECT y.doc_id, {score} AS s FROM y JOIN documents USING (doc_id) WHERE ({match}) AND ({where})) "
        f"SELECT doc_id, CAST(row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS BIGINT) AS rank, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score FROM z WHERE s > 0 ORDER BY s DESC, doc_id LIMIT {k}"
    )


@query("fts_term", _text_sql({"the": 1.0}, "m0 = 1", "s0", 20))
def fts_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, text_query.parse("the", _terms_of), 20)


@query("fts_match_or", _text_sql({"the": 1.0, "of": 1.0, "der": 1.0}, "m0 + m1 + m2 > 0", "s0 + s1 + s2", 30))
def fts_match_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, text_query.match("The OF der", _terms_of), 30)


@query("fts_match_and", _text_sql({"the": 1.0, "of": 1.0}, "m0 = 1 AND m1 = 1", "s0 + s1", 30))
def fts_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, text_query.match("the of", _terms_of, "AND"), 30)


@query("fts_must_not", _text_sql({"the": 1.0, "of": 1.0, "to": 1.0}, "m0 = 1 AND m1 = 0 AND m2 = 0", "s0", 30))
def fts_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, text_query.parse("the NOT (of OR to)", _terms_of), 30)


@query("fts_should", _text_sql({"the": 1.0, "with": 1.0}, "m0 = 1", "s0 + s1", 30))
def fts_should(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, text_query.parse("+the with", _terms_of), 30)


@query("fts_repeated", _text_sql({"the": 2.0, "of": 1.0}, "m0 + m1 > 0", "s0 + s1", 30))
def fts_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, text_query.parse("the OR of OR the", _terms_of), 30)


_AT = f"(SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM {_WORDS}) WHERE pair = 'of the')"


@query("fts_phrase", _text_sql({"of": 1.0, "the": 1.0}, f"doc_id IN {_AT}", "s0 + s1", 30))
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, text_query.parse('"of the"', _terms_of), 30)


@query("fts_filtered_stats", _text_sql({"de": 1.0, "la": 1.0}, "m0 + m1 > 0", "s0 + s1", 20, "documents.lang = 'es'"))
def fts_filtered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter takes documents away but not their share of the statistics."""
    only = table(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id")
    return _text(spark, sf_dir, text_query.match("de la", _terms_of), 20, only)


@query("fts_corpus_stats", f"SELECT count(*)::BIGINT AS n, CAST(sum(len(w)) AS BIGINT) AS tokens FROM {_WORDS}")
def fts_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.corpus_stats(text_of(spark, sf_dir).docs)


@query("fts_term_df", f"SELECT term, count(*)::BIGINT AS df FROM {_POSTINGS} GROUP BY term")
def fts_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.frequencies(text_of(spark, sf_dir).postings)


@query("fts_prefix", f"SELECT term, count(*)::BIGINT AS df FROM {_POSTINGS} WHERE starts_with(term, 'thea') GROUP BY term")
def fts_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.with_prefix(text_of(spark, sf_dir).postings, "thea")


@query("fts_merge", f"SELECT term, count(*)::BIGINT AS df, CAST(sum(tf) AS BIGINT) AS tf FROM {_POSTINGS} WHERE doc_id % 10 <> 3 GROUP BY term")
def fts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = text_of(spark, sf_dir).postings
    whole = text_index.merged([posted.where("doc_id % 2 = 0"), posted.where("doc_id % 2 = 1")], posted.where("doc_id % 10 = 3"))
    return whole.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("token_counts", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM {_WORDS}")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_docs(spark, sf_dir).select("doc_id", F.col("dl").alias("n"))


@query("ngram_counts", "SELECT p_partkey, CAST(greatest(0, length(p_name) - 1) AS BIGINT) AS n, list_aggregate(list_transform(range(1, length(p_name)), lambda i: substring(p_name, i, 2)), 'min') AS least FROM part")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").select("p_partkey", analysis.simple_ngrams(F.col("p_name")).alias("g"))
    return g.select("p_partkey", F.size("g").cast("long").alias("n"), F.array_min("g").alias("least"))


@query("standard_tokens")
def standard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzer = analysis.Analyzer(S.FTSIndexParams("standard", ("lowercase", "ascii_folding")))
    return table(spark, sf_dir, "documents").select("doc_id", analyzer.count(F.col("text")).alias("n"))


# --- Hybrid search -------------------------------------------------------------------------

_ARC = {"l2": "1 - 2 * atan(s) / pi()", "fts": "2 * atan(s) / pi()"}


def _hybrid(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Dense neighbours of document 7 and BM25, both of English documents only."""
    docs = table(spark, sf_dir, "documents").withColumn("_doc_id", F.col("doc_id")).withColumn("_pk", F.col("doc_id").cast("string"))
    english = docs.where("lang = 'en'").select("_doc_id", "_pk")
    vectors = scaled(spark, sf_dir)
    near = search.dense(vectors.select(F.col("vec_id").alias("_doc_id"), "v").join(english, "_doc_id"), _vector(vectors), 10, MetricType.L2, "v")
    index = text_of(spark, sf_dir)
    words = text_index.search(index.postings, index.docs, text_query.match("the of heed", _terms_of), 10, english.select(F.col("_doc_id").alias("doc_id")))
    words = words.select(F.col("doc_id").alias("_doc_id"), F.col("doc_id").cast("string").alias("_pk"), "_score")
    return [search.ranked(near.select("_doc_id", "_pk", "_score"), MetricType.L2), search.ranked(words, MetricType.IP)]


def _hybrid_sql(term: str) -> str:
    near = f"SELECT vec_id AS doc_id, {_METRIC_SQL[MetricType.L2]} AS s, row_number() OVER (ORDER BY {_METRIC_SQL[MetricType.L2]}, vec_id) - 1 AS rank, 'l2' AS kind FROM {_SCALED} JOIN documents ON vec_id = doc_id AND lang = 'en', {_Q}"
    words = _text_sql({"the": 1.0, "of": 1.0, "heed": 1.0}, "m0 + m1 + m2 > 0", "s0 + s1 + s2", 10, "documents.lang = 'en'").replace("CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS score", "s")
    return f"WITH n AS ({near}), t AS (SELECT doc_id, s, rank, 'fts' AS kind FROM ({words})), u AS (SELECT * FROM n WHERE rank < 10 UNION ALL SELECT * FROM t), f AS (SELECT doc_id, sum({term}) AS score FROM u GROUP BY doc_id) SELECT CAST(doc_id AS VARCHAR) AS pk, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score FROM f ORDER BY f.score DESC, pk LIMIT 10"


@query("rrf_hybrid", _hybrid_sql("1.0 / (60 + rank + 1)"))
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_hybrid(spark, sf_dir), 10).select(F.col("_pk").alias("pk"), micro(F.col("_score")).alias("score"))


@query("weighted_hybrid", _hybrid_sql(f"CASE kind WHEN 'l2' THEN 0.7 * ({_ARC['l2']}) ELSE 0.3 * ({_ARC['fts']}) END"))
def weighted_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(_hybrid(spark, sf_dir), [MetricType.L2, "fts"], [0.7, 0.3], 10).select(F.col("_pk").alias("pk"), micro(F.col("_score")).alias("score"))


@query("callback_hybrid", _hybrid_sql("1.0 / (1 + rank)").replace("sum(1.0 / (1 + rank))", "max(1.0 / (1 + rank))"))
def callback_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    def best_rank(batches: list[list[dict]], k: int) -> list[dict]:
        score: dict[str, float] = {}
        for rows in batches:
            for r in rows:
                score[r["_pk"]] = max(score.get(r["_pk"], 0.0), 1.0 / (1 + r["rank"]))
        return [{"_pk": p, "_score": s} for p, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]]

    return fusion.callback(_hybrid(spark, sf_dir), best_rank, 10).select(F.col("_pk").alias("pk"), micro(F.col("_score")).alias("score"))


# --- Writes --------------------------------------------------------------------------------

#: All customers as live rows, all orders as the batch: keys of twice the customer's number exist, are missing and repeat at any size.
_LIVE = f"(SELECT * FROM {_KEYED})"
_BATCH = "(SELECT o_orderkey AS _pos, 'c' || (o_custkey * 2) AS _pk, 'new' || o_orderkey AS c_name, o_totalprice AS c_acctbal, nullif(o_orderstatus, 'F') AS seg FROM orders)"
_FIRST_ID = 10**12  # above the ids of all live rows


def _live_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return keyed(spark, sf_dir), o.select(F.col("o_orderkey").alias("_pos"), F.concat(F.lit("c"), F.col("o_custkey") * 2).alias("_pk"), F.concat(F.lit("new"), F.col("o_orderkey")).alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), F.nullif("o_orderstatus", F.lit("F")).alias("seg"))


@query(
    "write_insert_conflict",
    f"WITH x AS (SELECT b._pos, b._pk, l._pk IS NOT NULL OR row_number() OVER (PARTITION BY b._pk ORDER BY b._pos) > 1 AS old FROM {_BATCH} b LEFT JOIN {_LIVE} l ON l._pk = b._pk) SELECT _pos, _pk, CASE WHEN NOT old THEN CAST({_FIRST_ID - 1} + row_number() OVER (PARTITION BY old ORDER BY _pos) AS BIGINT) END AS _doc_id, CASE WHEN old THEN 'ALREADY_EXISTS' END AS _error FROM x",
)
def write_insert_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, batch = _live_batch(spark, sf_dir)
    return writes.insert(live, batch, _FIRST_ID, ["c_name"])[1]


_MERGED = f"(SELECT b._pos, b._pk, b.c_name, b.seg, l.c_acctbal AS old, l._pk IS NOT NULL AS there, row_number() OVER (PARTITION BY b._pk ORDER BY b._pos DESC) AS turn FROM {_BATCH} b LEFT JOIN {_LIVE} l ON l._pk = b._pk)"


@query("write_upsert_partial", f"WITH m AS {_MERGED}, n AS (SELECT *, CAST({_FIRST_ID - 1} + row_number() OVER (ORDER BY _pos) AS BIGINT) AS id FROM m) SELECT id AS _doc_id, _pk, c_name, old AS c_acctbal, seg FROM n WHERE turn = 1")
def write_upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance is not given: existing rows keep theirs; an explicit null of seg replaces."""
    live, batch = _live_batch(spark, sf_dir)
    given = batch.withColumn("c_acctbal", F.lit(None).cast("double")).withColumn("_present", F.array(F.lit("c_name"), F.lit("seg")))
    return writes.upsert(live, given, _FIRST_ID, ["c_name"])[0].select("_doc_id", "_pk", "c_name", "c_acctbal", "seg")


@query("write_update_missing", f"WITH m AS {_MERGED} SELECT _pos, _pk, CASE WHEN there THEN CAST({_FIRST_ID - 1} + row_number() OVER (PARTITION BY there ORDER BY _pos) AS BIGINT) END AS _doc_id, CASE WHEN NOT there THEN 'NOT_FOUND' END AS _error FROM m")
def write_update_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, batch = _live_batch(spark, sf_dir)
    return writes.update(live, batch.withColumn("_present", F.array(F.lit("c_name"))), _FIRST_ID, [])[1]


@query("write_delete_keys", f"SELECT b._pos, b._pk, CASE WHEN l._pk IS NOT NULL AND turn = 1 THEN l._doc_id END AS _doc_id, CASE WHEN l._pk IS NULL OR turn > 1 THEN 'NOT_FOUND' END AS _error FROM (SELECT _pos, _pk, row_number() OVER (PARTITION BY _pk ORDER BY _pos) AS turn FROM {_BATCH}) b LEFT JOIN {_LIVE} l ON l._pk = b._pk")
def write_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, batch = _live_batch(spark, sf_dir)
    return writes.delete(live, batch.select("_pos", "_pk"))[1]


@query("write_delete_filter", f"SELECT _pk, _doc_id FROM {_KEYED} WHERE NOT coalesce(c_acctbal < 0 AND seg <> 'MACHINERY', false)")
def write_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = CollectionSchema("customer", (FieldSchema("c_acctbal", DataType.DOUBLE), FieldSchema("seg", DataType.STRING, True)))
    live = keyed(spark, sf_dir)
    gone = live.where(compile_filter("c_acctbal < 0 AND seg != 'MACHINERY'", kind)).select("_pk")
    return live.join(gone, "_pk", "left_anti").select("_pk", "_doc_id")


@query("doc_id_sequence", "SELECT o_orderkey AS _pos, CAST(99 + row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS _doc_id FROM orders")
def doc_id_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos")), 100).select("_pos", "_doc_id")


# --- Column expressions --------------------------------------------------------------------


@query("ddl_add_column_expr", f"SELECT p_partkey, CAST((p_partkey * 3 - p_size) // 2 AS BIGINT) AS whole, CAST(floor((p_retailprice / 4 + p_size * 1.5) * 1e6 + 0.5) AS BIGINT) AS part FROM {_PART_SQL}")
def ddl_add_column_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    return p.select("p_partkey", compile_expression("(p_partkey * 3 - p_size) / 2", PART, DataType.INT64).alias("whole"), micro(compile_expression("p_retailprice / 4 + p_size * 1.5", PART, DataType.DOUBLE)).alias("part"))


@query("ddl_alter_wrap_cast", "SELECT p_partkey, CAST(((p_partkey * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS wrapped, CAST(((0 - p_partkey) % 4294967296 + 4294967296) % 4294967296 AS BIGINT) AS unsigned FROM part")
def ddl_alter_wrap_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    return p.select("p_partkey", compile_expression("p_partkey * 1000003", PART, DataType.INT32).alias("wrapped"), compile_expression("-p_partkey", PART, DataType.UINT32).alias("unsigned"))
