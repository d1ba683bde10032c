from __future__ import annotations

import numpy as np
import pytest

from vekspar.ann import kernels as K
from vekspar.functions.vectors import half_bits, half_value
from vekspar.schema import MetricType

ROWS = np.random.default_rng(5).standard_normal((1100, 16))
QUERIES = np.random.default_rng(6).standard_normal((8, 16))


def recall(metric, rows, found):
    hits = 0
    for q in QUERIES[:, : rows.shape[1]]:
        truth = set(np.argsort(K.distances(metric, rows, q), kind="stable")[:10].tolist())
        hits += len(truth & set(found(q)))
    return hits / (10 * len(QUERIES))


def test_hnsw_recall():
    g = K.HNSW(K.Dense(ROWS, MetricType.L2), 12, 60)
    assert recall(MetricType.L2, ROWS, lambda q: [i for _, i in g.search(q, 80)][:10]) >= 0.8


def test_vamana_recall():
    g = K.Vamana(K.Dense(ROWS, MetricType.IP), 24, 40)
    assert recall(MetricType.IP, ROWS, lambda q: [i for _, i in g.search(q, 80)][:10]) >= 0.8


@pytest.mark.parametrize("metric", [MetricType.L2, MetricType.IP, MetricType.COSINE, MetricType.MIPSL2])
def test_small_graphs_are_exact(metric):
    rows = ROWS[:200]
    for g in (K.HNSW(K.Dense(rows, metric)), K.Vamana(K.Dense(rows, metric))):
        assert recall(metric, rows, lambda q, g=g: [i for _, i in g.search(q, 10)][:10]) == 1


@pytest.mark.parametrize("metric", [MetricType.L2, MetricType.IP, MetricType.COSINE])
def test_rabitq_recall(metric):
    r = np.random.default_rng(7)
    rows = r.standard_normal((600, 64))
    queries = r.standard_normal((8, 64))
    model = K.RaBitQ(rows, metric, 7, 8)
    codes, sign = model.encode(rows), -1 if metric.descending else 1
    hits = 0
    for q in queries:
        truth = set(np.argsort(K.distances(metric, rows, q))[:10].tolist())
        hits += len(truth & set(np.argsort(sign * model.estimate(codes, q)[0])[:10].tolist()))
    assert hits / 80 >= 0.75


def test_product_quantizer():
    pq = K.ProductQuantizer(ROWS[:400], 8, rounds=4)
    codes = pq.encode(ROWS[:400])
    near = recall(MetricType.L2, ROWS[:400], lambda q: np.argsort(pq.distances(pq.table(q), codes))[:40])
    assert near >= 0.9 and pq.decode(codes).shape == (400, 16)


def test_ivf_lists():
    c, labels = K.kmeans(ROWS, 16, rounds=8, plus_plus=True)
    assert len(c) == 16 and set(labels) <= set(range(16))
    assert recall(MetricType.L2, ROWS, lambda q: [i for i in np.argsort(np.where(np.isin(labels, np.argsort(((c - q) ** 2).sum(axis=1))[:8]), ((ROWS - q) ** 2).sum(axis=1), np.inf))[:10]]) >= 0.8
    assert len(K.kmeans(ROWS[:3], 10)[0]) == 3
    assert len(K.kmeans(np.zeros((5, 2)), 3, empty="drop")[0]) >= 1


def test_rotation_is_a_rotation():
    for dim in (1, 8, 48, 64):
        r = K.Rotation(dim, 3)
        x = np.random.default_rng(1).standard_normal((5, dim))
        y = r.rotate(x)
        assert np.allclose(r.restore(y), x) and np.allclose((x**2).sum(axis=1), (y**2).sum(axis=1))


def test_half():
    assert half_bits(1.0) == 0x3C00 and half_value(0x3C00) == 1.0


@pytest.mark.parametrize("share", [0.02, 0.3])
def test_filtered_walks_give_k_rows(share):
    """The filter is tested while nodes are accepted: k allowed rows come back, and most of the right ones."""
    r = np.random.default_rng(9)
    allowed = r.random(len(ROWS)) < share
    nodes = np.flatnonzero(allowed)
    for g in (K.HNSW(K.Dense(ROWS, MetricType.L2), 12, 60), K.Vamana(K.Dense(ROWS, MetricType.L2), 24, 40)):
        hits = 0
        for q in QUERIES:
            found = [i for _, i in g.search(q, 10, allowed=allowed, exact_share=0.0)]
            assert len(found) == 10 and allowed[found].all()
            truth = nodes[np.argsort(K.distances(MetricType.L2, ROWS[nodes], q), kind="stable")[:10]]
            hits += len(set(truth.tolist()) & set(found))
        assert hits >= 0.8 * 80


def test_sparse_graph():
    r = np.random.default_rng(2)
    rows = [{int(d): float(x) for d, x in zip(r.choice(60, 8, replace=False), r.random(8))} for _ in range(1200)]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    space = K.Sparse(bounds, np.array([d for x in rows for d in sorted(x)]), np.array([x[d] for x in rows for d in sorted(x)]))
    g = K.HNSW.load(space, K.HNSW(space, 16, 80).arrays())
    hits = 0
    for q in rows[:8]:
        dots = np.array([sum(q.get(d, 0) * v for d, v in x.items()) for x in rows])
        assert np.allclose(-space.to(q)(np.arange(len(rows))), dots)
        hits += len(set(np.argsort(-dots, kind="stable")[:10].tolist()) & {i for _, i in g.search(q, 100)[:10]})
    assert hits >= 0.8 * 80


def test_arrays_hold_all_of_an_index():
    import pyarrow as pa

    from vekspar import schema as S
    from vekspar.ann import indexes

    rows = ROWS[:1100, :8]
    table = pa.table([pa.array(range(1100)), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["_doc_id", "v"])
    q = QUERIES[0, :8]
    for params in (S.HNSWIndexParams(MetricType.L2, m=8, ef_construction=40), S.HNSWIndexParams(MetricType.L2, S.QuantizeType.INT8, m=8, ef_construction=40), S.HNSWRaBitQIndexParams(MetricType.IP, m=8, ef_construction=40), S.DiskANNIndexParams(MetricType.COSINE, max_degree=16, list_size=30, pq_chunks=4), S.VamanaIndexParams(MetricType.MIPSL2, max_degree=16, search_list_size=30)):
        f = S.FieldSchema("v", S.DataType.VECTOR_FP32, True, 8, params)
        part = indexes._load(indexes._make(table, f), params.metric)
        ids, scores = part.hits(q, 40)
        truth = np.argsort(K.distances(params.metric, rows, q), kind="stable")[:10]
        assert len(set(truth.tolist()) & set(ids.tolist())) >= 7 and len(ids) == len(scores) == 40
        assert len(part.hits(q, 5, linear=True)[0]) == 5
    for quantize, most in ((S.QuantizeType.UNDEFINED, 0), (S.QuantizeType.FP16, 0.01), (S.QuantizeType.INT8, 0.05), (S.QuantizeType.INT4, 0.6)):
        assert np.abs(indexes._unpacked(indexes._packed_rows(rows, quantize), 8, quantize) - rows).max() <= most


@pytest.mark.parametrize("metric", [MetricType.L2, MetricType.COSINE, MetricType.IP])
@pytest.mark.parametrize("copies", [3, 40])
def test_equal_rows_are_all_found(metric, copies):
    """Equal rows would cut each other off from the rest of a graph."""
    rows = np.tile(np.random.default_rng(0).integers(0, 200, (2000 // copies, 16)).astype(float), (copies, 1))
    queries = rows[:20]
    truth = np.argsort(K.distances(metric, rows, queries).reshape(len(rows), -1).round(9), axis=0, kind="stable")[:10].T
    for g in (K.HNSW(K.Dense(rows, metric), 16, 80), K.Vamana(K.Dense(rows, metric), 24, 60)):
        ids, _ = g.search_many(queries, 200)
        assert np.mean([len(set(a[:10].tolist()) & set(b.tolist())) for a, b in zip(ids, truth)]) >= 9


def test_walks_side_by_side_are_walks():
    """Many walks at once find what single ones do, for rows, codes and sparse rows."""
    import pyarrow as pa

    from vekspar import schema as S
    from vekspar.ann import indexes

    r = np.random.default_rng(3)
    table = pa.table([pa.array(range(1100)), pa.array(ROWS.tolist(), pa.list_(pa.float64()))], ["_doc_id", "v"])
    for params in (S.HNSWIndexParams(MetricType.L2, m=8, ef_construction=40), S.HNSWRaBitQIndexParams(MetricType.L2, m=8, ef_construction=40), S.HNSWRaBitQIndexParams(MetricType.COSINE, m=8, ef_construction=40), S.DiskANNIndexParams(MetricType.COSINE, max_degree=16, list_size=30, pq_chunks=8), S.VamanaIndexParams(MetricType.IP, max_degree=16, search_list_size=30)):
        part = indexes._load(indexes._make(table, S.FieldSchema("v", S.DataType.VECTOR_FP32, True, 16, params)), params.metric)
        for linear in (False, True):
            at, ids, scores = part.hits_many(QUERIES, 10, 100, linear)
            for i, q in enumerate(QUERIES):
                one, of = part.hits(q, 100, exact_share=0.0, linear=linear)
                assert len(set(one[:10].tolist()) & set(ids[at == i].tolist())) >= 8
                assert np.allclose(scores[at == i][ids[at == i] == one[0]], of[0], atol=1e-6)
    cells = [sorted(r.choice(60, 8, replace=False).tolist()) for _ in range(1200)]
    sparse = pa.array([{"indices": c, "values": r.random(8).tolist()} for c in cells], pa.struct([("indices", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))]))
    f = S.FieldSchema("v", S.DataType.SPARSE_VECTOR_FP32, True, 0, S.HNSWIndexParams(MetricType.IP, m=16, ef_construction=80))
    part = indexes._load(indexes._make(pa.table([pa.array(range(1200)), sparse], ["_doc_id", "v"]), f), MetricType.IP)
    at, ids, scores = part.hits_many(indexes._sparse(sparse.slice(5, 8)), 10, 100)
    for i, q in enumerate(sparse.slice(5, 8).to_pylist()):
        one, of = part.hits(dict(zip(q["indices"], q["values"])), 10)
        assert len(set(one.tolist()) & set(ids[at == i].tolist())) >= 8 and np.allclose(scores[at == i][0], of[0], atol=1e-6)


def test_a_graph_is_built_in_blocks():
    """Time of a part grows with blocks of rows, not with steps for each row and link."""
    import time

    rows = np.random.default_rng(1).standard_normal((4000, 16))
    began = time.perf_counter()
    K.HNSW(K.Dense(rows, MetricType.L2), 16, 80), K.Vamana(K.Dense(rows, MetricType.L2), 24, 60)
    assert time.perf_counter() - began < 30


def test_one_query_is_exact(spark, tmp_path):
    """A part above EXACT_BELOW rows gives what SQL gives, and equal rows by their ids."""
    from vekspar import schema as S
    from vekspar.ann import indexes

    rows = np.tile(np.random.default_rng(8).standard_normal((750, 64)), (2, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "_doc_id long, v array<double>")
    q = np.random.default_rng(9).standard_normal(64)
    for i, (params, asked) in enumerate([(S.VamanaIndexParams(MetricType.L2, max_degree=4, search_list_size=10), S.VamanaQueryParams(ef=10)), (S.HNSWIndexParams(MetricType.COSINE, m=2, ef_construction=10), S.HNSWQueryParams(ef=10)), (S.DiskANNIndexParams(MetricType.L2, max_degree=4, list_size=10, pq_chunks=16), S.DiskANNQueryParams(list_size=10))]):
        f = S.FieldSchema("v", S.DataType.VECTOR_FP32, True, 64, params)
        indexes.build(df, f, str(tmp_path / str(i)), 600)
        found = [r._doc_id for r in indexes.search(spark, str(tmp_path / str(i)), f, asked, q, 10).orderBy("_score", "_doc_id").collect()]
        d = K.distances(params.metric, rows[:750], q)
        assert found == [j for i in np.argsort(d, kind="stable")[:5].tolist() for j in (i, i + 750)]


def test_groups_are_whole():
    """The rows of a group that is not among a part's first ones still count over all parts."""
    from vekspar.ann import indexes

    rows = np.arange(2000, dtype=float)[:, None]
    part = indexes.Part(K.HNSW(K.Dense(rows, MetricType.L2), 8, 20), np.arange(2000), MetricType.L2)
    group = np.where(np.arange(2000) < 1900, np.arange(2000) % 3, 3)
    ids, _ = part.grouped(np.zeros(1), np.arange(2000) != 1900, group, 2)
    assert sorted(ids.tolist()) == [0, 1, 2, 3, 4, 5, 1901, 1902]
