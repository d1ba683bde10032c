from __future__ import annotations

import pytest

from vekspar import errors
from vekspar import schema as S
from vekspar.schema import CollectionSchema, DataType, FieldSchema, MetricType, Projection, QuantizeType


def good(*fields):
    return CollectionSchema("things", fields)


def test_json_round_trip_is_strict():
    s = good(FieldSchema("t", DataType.STRING, True, 0, S.FTSIndexParams("ngram", ("lowercase",), '{"ngram_min": 2}')), FieldSchema("v", DataType.VECTOR_FP32, False, 64, S.HNSWRaBitQIndexParams(MetricType.COSINE)), FieldSchema("n", DataType.INT32, False, 0, S.InvertIndexParams()))
    s.validate()
    assert CollectionSchema.from_json(s.to_json()) == s
    with pytest.raises(errors.InvalidArgument):
        CollectionSchema.from_json(s.to_json().replace('"nullable"', '"nullible"'))
    with pytest.raises(errors.InvalidArgument):
        CollectionSchema.from_json("{")


@pytest.mark.parametrize("field", [
    FieldSchema("bad name", DataType.STRING), FieldSchema("x" * 33, DataType.STRING), FieldSchema("v", DataType.VECTOR_FP64, False, 4), FieldSchema("v", DataType.VECTOR_FP32), FieldSchema("v", DataType.VECTOR_FP32, False, 20_001), FieldSchema("n", DataType.INT32, False, 3),
    FieldSchema("v", DataType.VECTOR_INT8, False, 4, S.FlatIndexParams(MetricType.COSINE)), FieldSchema("v", DataType.VECTOR_FP16, False, 4, S.FlatIndexParams(MetricType.L2, QuantizeType.INT8)), FieldSchema("v", DataType.VECTOR_FP32, False, 5, S.FlatIndexParams(MetricType.L2, QuantizeType.INT4)),
    FieldSchema("v", DataType.VECTOR_FP32, False, 32, S.HNSWRaBitQIndexParams(MetricType.L2)), FieldSchema("s", DataType.SPARSE_VECTOR_FP32, False, 0, S.FlatIndexParams(MetricType.L2)), FieldSchema("s", DataType.SPARSE_VECTOR_FP32, False, 0, S.IVFIndexParams(MetricType.IP)),
    FieldSchema("n", DataType.INT32, False, 0, S.FTSIndexParams()), FieldSchema("v", DataType.VECTOR_FP32, False, 4, S.InvertIndexParams()), FieldSchema("v", DataType.VECTOR_FP32, False, 4, S.DiskANNIndexParams(MetricType.L2, pq_chunks=5)), FieldSchema("v", DataType.VECTOR_FP32, False, 4, S.FlatIndexParams(MetricType.L2, enable_rotate=True)),
    FieldSchema("v", DataType.VECTOR_INT8, False, 4, S.IVFIndexParams(MetricType.IP)),
])
def test_rejected_fields(field):
    with pytest.raises(errors.InvalidArgument):
        good(field).validate()


@pytest.mark.parametrize("params", [S.FTSIndexParams("klingon"), S.FTSIndexParams("ngram", (), '{"ngram_min": 2, "ngram_max": 4}'), S.FTSIndexParams("standard", ("stemmer",)), S.FTSIndexParams("standard", ("lowercase", "stemmer"), '{"stemmer_lang": "latin"}'), S.FTSIndexParams("standard", (), '{"what": 1}'), S.FTSIndexParams("standard", (), "[1]"), S.HNSWIndexParams(m=0), S.IVFIndexParams(n_list=0), S.HNSWRaBitQIndexParams(total_bits=10)])
def test_rejected_parameters(params):
    with pytest.raises(errors.InvalidArgument):
        params.validate()


@pytest.mark.parametrize("params", [S.FlatQueryParams(radius=-1), S.FlatQueryParams(radius=float("inf")), S.HNSWQueryParams(ef=2049), S.IVFQueryParams(n_probe=0), S.FlatQueryParams(scale_factor=0)])
def test_rejected_query_parameters(params):
    with pytest.raises(errors.InvalidArgument):
        params.validate()


def test_collections():
    with pytest.raises(errors.InvalidArgument):
        CollectionSchema("ab", (FieldSchema("n", DataType.INT32),)).validate()
    with pytest.raises(errors.InvalidArgument):
        good().validate()
    with pytest.raises(errors.InvalidArgument):
        good(FieldSchema("n", DataType.INT32), FieldSchema("n", DataType.INT64)).validate()
    with pytest.raises(errors.InvalidArgument):
        good(*(FieldSchema(f"v{i}", DataType.VECTOR_FP32, False, 2) for i in range(6))).validate()


def test_projection():
    s = good(FieldSchema("a", DataType.STRING), FieldSchema("b", DataType.INT32), FieldSchema("v", DataType.VECTOR_FP32, False, 2))
    assert Projection().columns(s) == ["a", "b"]
    assert Projection([]).columns(s) == []
    assert Projection(["*"], True).columns(s) == ["a", "b", "v"]
    assert Projection(["b"]).columns(s) == ["b"]
    for bad in (["v"], ["a", "a"], ["*", "a"], ["zz"]):
        with pytest.raises(errors.InvalidArgument):
            Projection(bad).columns(s)


def test_error_codes():
    assert [c.value for c in errors.ErrorCode] == list(range(11))
    assert "NOT_FOUND" in str(errors.NotFound("x", "op", "path"))
