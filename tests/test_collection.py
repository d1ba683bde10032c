from __future__ import annotations

import pytest

from vekspar import errors
from vekspar import schema as S
from vekspar.schema import CollectionSchema, DataType, FieldSchema, MetricType, Projection
from vekspar.store.collection import Collection, FTSClause, GroupByQuery, MultiQuery, Options, SubQuery, VectorQuery

IP = S.FlatIndexParams(MetricType.IP)
VECTOR, SPARSE = FieldSchema("embedding", DataType.VECTOR_FP32, False, 2, IP), FieldSchema("sparse", DataType.SPARSE_VECTOR_FP32, True, 0, IP)
BOOKS = CollectionSchema("books", (FieldSchema("title", DataType.STRING), FieldSchema("category", DataType.STRING, True), FieldSchema("rating", DataType.INT32, True), VECTOR, SPARSE))
BOOK_ROWS = [("a", "alpha", "low", 1, 1, [1, 0]), ("b", "bravo", "high", 2, 5, [5, 0]), ("c", "charlie", "low", 3, 4, [4, 0]), ("d", "delta", "high", 4, 3, [3, 0]), ("e", "echo", None, 5, 6, [6, 0])]
HYBRID = CollectionSchema("hybrid", (FieldSchema("title", DataType.STRING, True, 0, S.FTSIndexParams()), FieldSchema("category", DataType.STRING), FieldSchema("rating", DataType.INT32), VECTOR, SPARSE))
HYBRID_ROWS = [("a", "Go database", "keep", 1, [1, 0], 1), ("b", "Go Go search", "keep", 2, [0.8, 0], 3), ("c", "Go database search", "drop", 3, [2, 0], 5), ("d", None, "keep", 4, [0.2, 0], None)]


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    with Collection.create_and_open(spark, str(tmp_path_factory.mktemp("c") / "books"), BOOKS) as c:
        c.insert((k, {"title": t, "category": g, "rating": r, "embedding": v, "sparse": {2: s}}) for k, t, g, r, s, v in BOOK_ROWS)
        c.flush()
        yield c


@pytest.fixture(scope="module")
def hybrid(spark, tmp_path_factory):
    with Collection.create_and_open(spark, str(tmp_path_factory.mktemp("c") / "hybrid"), HYBRID) as c:
        c.insert((k, {"title": t, "category": g, "rating": r, "embedding": v, "sparse": None if s is None else {2: s}}) for k, t, g, r, v, s in HYBRID_ROWS)
        yield c


def keys(df):
    return "".join(r._pk for r in df.collect())


def test_radius_and_sparse(books):
    found = books.query(VectorQuery("embedding", [1, 0], params=S.FlatQueryParams(radius=4))).collect()
    assert "".join(r._pk for r in found) == "ebc" and found[0]._score == 6
    assert keys(books.query(VectorQuery("sparse", sparse={2: 1}, k=3))) == "ebc"
    assert keys(books.query(VectorQuery("embedding", [1, 0], filter="rating > 1", k=1))) == "e"


def test_groups(books):
    found = books.group_by_query(GroupByQuery("embedding", [1, 0], group_by="category", group_count=3, top_k_per_group=2)).collect()
    assert [(r._group, r._pk) for r in found] == [("", "e"), ("high", "b"), ("high", "d"), ("low", "c"), ("low", "a")]


def test_fetch_and_projection(books):
    found = books.fetch(["c", "zz", "a", "c"], Projection(["title"])).collect()
    assert [(r._pk, r.title, r._found) for r in found] == [("c", "charlie", True), ("zz", None, False), ("a", "alpha", True), ("c", "charlie", True)]
    row = books.query(VectorQuery("embedding", [1, 0], k=1, projection=Projection([], True))).first()
    assert "title" not in row and list(row.embedding) == [6, 0]


@pytest.mark.parametrize("q", [VectorQuery("embedding", [1, 0], sparse={1: 1}), VectorQuery("embedding", [1, 0, 0]), VectorQuery("title", [1, 0]), VectorQuery("embedding", [1, 0], k=0), VectorQuery("embedding", [1, 0], params=S.HNSWQueryParams()), VectorQuery(filter="rating > 1", params=S.FlatQueryParams()), VectorQuery("embedding", [1, float("nan")]), VectorQuery("sparse", [1, 0]), VectorQuery("embedding", fts=FTSClause("x"))])
def test_rejected_queries(books, q):
    with pytest.raises(errors.InvalidArgument):
        books.query(q)


def test_missing_key(books):
    with pytest.raises(errors.NotFound):
        books.query(VectorQuery("embedding", primary_key="missing"))


def test_hybrid_queries(hybrid):
    found = hybrid.query(VectorQuery(filter="rating >= 2", k=2)).collect()
    assert [(r._pk, r._score) for r in found] == [("b", 0), ("c", 0)]
    assert keys(hybrid.query(VectorQuery("title", fts=FTSClause(match="go"), filter="category='keep'", k=3))) == "ba"
    assert keys(hybrid.query(VectorQuery("embedding", primary_key="c", k=2))) == "ca"
    assert keys(hybrid.query(VectorQuery("sparse", primary_key="b", k=2))) == "cb"
    assert keys(hybrid.query(VectorQuery("title", fts=FTSClause('"go search"')))) == "b"
    assert keys(hybrid.query(VectorQuery("title", fts=FTSClause(match="go database"), params=S.FTSQueryParams(default_operator="AND")))) == "ac"
    with pytest.raises(errors.InvalidArgument):
        hybrid.query(VectorQuery("sparse", primary_key="d"))
    g = hybrid.group_by_query(GroupByQuery("embedding", primary_key="a", group_by="category", group_count=2)).first()
    assert (g._group, g._pk) == ("drop", "c")


def test_multi_query(hybrid):
    branches = [SubQuery(VectorQuery("embedding", [1, 0]), 3), SubQuery(VectorQuery("sparse", sparse={2: 1}), 3), SubQuery(VectorQuery("title", fts=FTSClause(match="go")), 3)]
    found = hybrid.multi_query(MultiQuery(branches, "category='keep'", 3)).collect()
    assert [r._pk for r in found] == ["b", "a", "d"]
    assert found[0]._score == pytest.approx(1 / 62 + 1 / 61 + 1 / 61)
    weighted = hybrid.multi_query(MultiQuery(branches, "category='keep'", 3, "weighted")).collect()
    assert {r._pk for r in weighted} == {"a", "b", "d"}
    own = hybrid.multi_query(MultiQuery(branches, None, 2, lambda batches, k: [{"_pk": "c", "_score": 1.0}]))
    assert keys(own) == "c"
    for bad in ([{"_pk": "zz", "_score": 1.0}], [{"_pk": "a", "_score": float("nan")}], [{"_pk": "a", "_score": 1.0}] * 2):
        with pytest.raises(errors.InvalidArgument):
            hybrid.multi_query(MultiQuery(branches, None, 3, lambda b, k, bad=bad: bad))
    with pytest.raises(errors.InvalidArgument):
        hybrid.multi_query(MultiQuery(branches[:1]))


def test_writes_and_maintenance(spark, tmp_path):
    schema = CollectionSchema("writes", (FieldSchema("n", DataType.INT32), FieldSchema("maybe", DataType.STRING, True), VECTOR))
    path = str(tmp_path / "w")
    c = Collection.create_and_open(spark, path, schema)
    with pytest.raises(errors.FailedPrecondition):
        Collection.open(spark, path)
    with pytest.raises(errors.AlreadyExists):
        Collection.create_and_open(spark, path, schema)

    def doc(n, **more):
        return {"n": n, "embedding": [n, 0], **more}

    got = c.insert([("a", doc(1, maybe="x")), ("b", doc(2)), ("a", doc(9)), ("bad", {"n": "no", "embedding": [0, 0]}), ("short", {"n": 1, "embedding": [0]}), ("", doc(3))])
    assert [(r.doc_id, r.error) for r in got] == [(0, None), (1, None), (None, "ALREADY_EXISTS"), *[(None, "INVALID_ARGUMENT")] * 3]
    got = c.upsert([("a", {"n": 5}), ("c", doc(3)), ("d", {"n": 1})])
    assert [(r.doc_id, r.error) for r in got] == [(2, None), (3, None), (None, "INVALID_ARGUMENT")]
    got = c.update([("a", {"maybe": None}), ("zz", {"n": 1})])
    assert [r.error for r in got] == [None, "NOT_FOUND"]
    assert [(r._pk, r._doc_id, r.n, r.maybe) for r in c.live().orderBy("_pk").collect()] == [("a", 4, 5, None), ("b", 1, 2, None), ("c", 3, 3, None)]
    reader = Collection.open(spark, path, Options(read_only=True))
    before = reader.live().count()
    c.flush()
    got = c.delete(["b", "nobody", "b"])
    assert [r.error for r in got] == [None, "NOT_FOUND", "NOT_FOUND"]
    assert reader.live().count() == before == 3  # its own version
    with pytest.raises(errors.PermissionDenied):
        reader.delete(["a"])
    c.flush()
    assert c.stats()["documents"] == 2 and c.stats()["deleted"] == 1
    c.delete_by_filter("n > 100")
    c.delete_by_filter("n = 3")
    with pytest.raises(errors.InvalidArgument):
        c.delete_by_filter(" ")
    c.add_column(FieldSchema("twice", DataType.INT64), "n * 2 - 1")
    c.alter_column("twice", changed=FieldSchema("twice", DataType.INT32))
    c.alter_column("twice", rename="double")
    assert [(r._pk, r.double) for r in c.live().collect()] == [("a", 9)]
    c.drop_column("double")
    with pytest.raises(errors.NotSupported):
        c.drop_column("maybe")
    with pytest.raises(errors.InvalidArgument):
        c.add_column(FieldSchema("x", DataType.INT32))
    c.optimize()
    assert c.stats()["segments"] == 1 and c.insert([("new", doc(7))])[0].doc_id == 5
    c.close()
    again = Collection.open(spark, path)
    assert {r._pk for r in again.live().collect()} == {"a", "new"}
    again.destroy()
    with pytest.raises(errors.NotFound):
        Collection.open(spark, path)


def test_quantized_refined_and_indexed(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(3)
    rows = r.standard_normal((120, 8)).round(3)
    with Collection.create_and_open(spark, str(tmp_path / "q"), CollectionSchema("quantized", (FieldSchema("g", DataType.INT32), FieldSchema("v", DataType.VECTOR_FP32, False, 8, S.FlatIndexParams(MetricType.L2, S.QuantizeType.INT8))))) as c:
        c.insert((f"k{i}", {"g": i % 3, "v": v.tolist()}) for i, v in enumerate(rows))
        c.flush()
        q = rows[7].tolist()
        exact = [f"k{i}" for i in np.argsort(((rows - rows[7]) ** 2).sum(axis=1), kind="stable")[:5]]
        refined = c.query(VectorQuery("v", q, k=5, params=S.FlatQueryParams(use_refiner=True))).collect()
        assert [x._pk for x in refined] == exact
        assert c.query(VectorQuery("v", q, k=1)).first()._pk == "k7"
        for params, query in ((S.IVFIndexParams(MetricType.L2, n_list=4), S.IVFQueryParams(n_probe=4)), (S.HNSWIndexParams(MetricType.L2), S.HNSWQueryParams()), (S.VamanaIndexParams(MetricType.L2), None), (S.DiskANNIndexParams(MetricType.L2, pq_chunks=4), S.DiskANNQueryParams())):
            c.create_index("v", params)
            assert c.stats()["index_completeness"]["v"] == 1.0
            assert [x._pk for x in c.query(VectorQuery("v", q, k=5, params=query)).collect()] == exact
        with pytest.raises(errors.NotSupported):
            c.group_by_query(GroupByQuery("v", q, group_by="g"))
        c.drop_index("v")
        assert c.schema.field("v").index is None


def test_stream(spark, tmp_path):
    from vekspar.streaming.ingest import ingest

    source = tmp_path / "in"
    spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "_pos long, _pk string, n int").coalesce(1).write.parquet(str(source))
    with Collection.create_and_open(spark, str(tmp_path / "s"), CollectionSchema("stream", (FieldSchema("n", DataType.INT32),))) as c:
        for _ in range(2):
            ingest(spark.readStream.schema("_pos long, _pk string, n int").parquet(str(source)), c, str(tmp_path / "check")).awaitTermination()
        assert sorted((r._pk, r.n) for r in c.live().collect()) == [("a", 3), ("b", 2)]
        assert c.progress(str(tmp_path / "check")) == 0


def test_text_of_the_log_is_analysed_once(hybrid):
    """The postings of the log are kept for the query, so that no part of it analyses the texts again."""
    found = hybrid.query(VectorQuery("title", fts=FTSClause(match="go")))
    assert "Python" not in found._jdf.queryExecution().analyzed().toString() and keys(found) == "bac"
