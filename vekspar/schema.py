"""Collections' schemas: types, fields, index parameters, validation and the JSON form."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace
from enum import IntEnum
from typing import Any

from pyspark.sql import types as T

from .errors import InvalidArgument

MAX_DIMENSION, MAX_SPARSE, MAX_SCALARS, MAX_VECTORS = 20_000, 16_384, 1_024, 5
FIELD_NAME, COLLECTION_NAME = re.compile(r"[A-Za-z0-9_-]{1,32}"), re.compile(r"[A-Za-z0-9_-]{3,64}")


class DataType(IntEnum):
    UNDEFINED = 0
    BINARY = 1
    STRING = 2
    BOOL = 3
    INT32 = 4
    INT64 = 5
    UINT32 = 6
    UINT64 = 7
    FLOAT = 8
    DOUBLE = 9
    VECTOR_BINARY32 = 20
    VECTOR_BINARY64 = 21
    VECTOR_FP16 = 22
    VECTOR_FP32 = 23
    VECTOR_FP64 = 24
    VECTOR_INT4 = 25
    VECTOR_INT8 = 26
    VECTOR_INT16 = 27
    SPARSE_VECTOR_FP16 = 30
    SPARSE_VECTOR_FP32 = 31
    ARRAY_BINARY = 40
    ARRAY_STRING = 41
    ARRAY_BOOL = 42
    ARRAY_INT32 = 43
    ARRAY_INT64 = 44
    ARRAY_UINT32 = 45
    ARRAY_UINT64 = 46
    ARRAY_FLOAT = 47
    ARRAY_DOUBLE = 48

    @property
    def is_array(self) -> bool:
        return self >= 40

    @property
    def is_dense(self) -> bool:
        return 20 <= self < 30

    @property
    def is_sparse(self) -> bool:
        return 30 <= self < 40

    @property
    def is_vector(self) -> bool:
        return 20 <= self < 40

    @property
    def element(self) -> DataType:
        """The type of an array's elements; a scalar's own."""
        return DataType(self - 39) if self.is_array else self

    @property
    def is_numeric(self) -> bool:
        return DataType.INT32 <= self <= DataType.DOUBLE


class IndexType(IntEnum):
    UNDEFINED = 0
    HNSW = 1
    IVF = 2
    FLAT = 3
    HNSW_RABITQ = 4
    DISKANN = 5
    VAMANA = 6
    INVERT = 10
    FTS = 11


class QuantizeType(IntEnum):
    UNDEFINED = 0
    FP16 = 1
    INT8 = 2
    INT4 = 3
    RABITQ = 4


class MetricType(IntEnum):
    UNDEFINED = 0
    L2 = 1
    IP = 2
    COSINE = 3
    MIPSL2 = 4

    @property
    def descending(self) -> bool:
        return self == MetricType.IP


class WriteOperator(IntEnum):
    INSERT = 0
    UPSERT = 1
    UPDATE = 2
    DELETE = 3


SUPPORTED = {t for t in DataType if t} - {DataType.VECTOR_BINARY32, DataType.VECTOR_BINARY64, DataType.VECTOR_FP64, DataType.VECTOR_INT4, DataType.VECTOR_INT16}
INTEGER_RANGE = {DataType.INT32: (-(1 << 31), (1 << 31) - 1), DataType.INT64: (-(1 << 63), (1 << 63) - 1), DataType.UINT32: (0, (1 << 32) - 1), DataType.UINT64: (0, (1 << 64) - 1)}
_SPARK = {
    DataType.BINARY: T.BinaryType(), DataType.STRING: T.StringType(), DataType.BOOL: T.BooleanType(), DataType.INT32: T.IntegerType(), DataType.INT64: T.LongType(),
    DataType.UINT32: T.LongType(), DataType.UINT64: T.DecimalType(20, 0), DataType.FLOAT: T.FloatType(), DataType.DOUBLE: T.DoubleType(),
}
SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType(), False), False), T.StructField("values", T.ArrayType(T.FloatType(), False), False)])


def spark_type(kind: DataType) -> T.DataType:
    if kind.is_sparse:
        return SPARSE
    if kind == DataType.VECTOR_INT8:
        return T.ArrayType(T.ByteType(), False)
    if kind.is_dense:
        return T.ArrayType(T.FloatType(), False)
    return T.ArrayType(_SPARK[kind.element], False) if kind.is_array else _SPARK[kind]


def _require(fine: bool, message: str) -> None:
    if not fine:
        raise InvalidArgument(message, "validate schema")


# --- Index parameters --------------------------------------------------------------------


@dataclass(frozen=True)
class IndexParams:
    index_type = IndexType.UNDEFINED

    def validate(self) -> None:
        pass


@dataclass(frozen=True)
class InvertIndexParams(IndexParams):
    enable_range_optimization: bool = True
    enable_extended_wildcard: bool = False
    index_type = IndexType.INVERT


STEMMERS = frozenset("arabic armenian basque catalan danish dutch english finnish french german greek hindi hungarian indonesian irish italian lithuanian lovins nepali norwegian porter portuguese romanian russian serbian spanish swedish tamil turkish yiddish".split())
_TOKEN_CLASSES = {"letter", "digit", "whitespace", "punctuation", "symbol"}


@dataclass(frozen=True)
class FTSIndexParams(IndexParams):
    tokenizer: str = "standard"
    filters: tuple[str, ...] = ("lowercase",)
    extra_params: str = ""
    index_type = IndexType.FTS

    @property
    def extra(self) -> dict[str, Any]:
        try:
            found = json.loads(self.extra_params) if self.extra_params.strip() else {}
        except ValueError as e:
            raise InvalidArgument(f"extra parameters are no JSON: {e}", "validate FTS index params") from e
        _require(isinstance(found, dict), "extra parameters must be a JSON object")
        return found

    def validate(self) -> None:
        extra = self.extra
        _require(self.tokenizer in ("standard", "whitespace", "ngram", "jieba"), f"unknown tokenizer {self.tokenizer}")
        for name in self.filters:
            _require(name in ("lowercase", "ascii_folding", "stemmer"), f"unknown token filter {name}")
        known = {"max_token_length", "ngram_min", "ngram_max", "token_chars", "cut_mode", "dict_dir", "user_dict", "stemmer_lang"}
        _require(not set(extra) - known, f"unknown extra parameters {sorted(set(extra) - known)}")
        length = extra.get("max_token_length", 255)
        _require(isinstance(length, int) and 1 <= length <= 1_048_576, "max_token_length is out of range")
        low, high = extra.get("ngram_min", 2), extra.get("ngram_max", extra.get("ngram_min", 2))
        _require(isinstance(low, int) and isinstance(high, int) and 1 <= low <= high <= low + 1, "n-gram lengths must be positive and differ by at most 1")
        _require(set(extra.get("token_chars", [])) <= _TOKEN_CLASSES, "unknown token character class")
        _require(extra.get("cut_mode", "search") in ("search", "mix", "full", "hmm"), "unknown cut mode")
        _require(extra.get("stemmer_lang", "english") in STEMMERS, f"unsupported stemmer language {extra.get('stemmer_lang')}")
        if "stemmer" in self.filters:
            _require("lowercase" in self.filters[: self.filters.index("stemmer")], "the stemmer must follow the lowercase filter")


@dataclass(frozen=True)
class VectorIndexParams(IndexParams):
    metric: MetricType = MetricType.IP
    quantize: QuantizeType = QuantizeType.UNDEFINED
    enable_rotate: bool = False

    def validate(self) -> None:
        _require(self.metric in (MetricType.L2, MetricType.IP, MetricType.COSINE, MetricType.MIPSL2), "a metric is needed")
        _require(self.quantize != QuantizeType.RABITQ, "RaBitQ has an index type of its own")
        _require(not self.enable_rotate or self.quantize in (QuantizeType.INT8, QuantizeType.INT4), "rotation needs INT8 or INT4")


@dataclass(frozen=True)
class FlatIndexParams(VectorIndexParams):
    index_type = IndexType.FLAT


@dataclass(frozen=True)
class HNSWIndexParams(VectorIndexParams):
    m: int = 50
    ef_construction: int = 500
    use_contiguous_memory: bool = False
    index_type = IndexType.HNSW

    def validate(self) -> None:
        super().validate()
        _require(0 < self.m <= 32_767, "m is out of range")
        _require(self.ef_construction > 0, "ef_construction must be positive")


@dataclass(frozen=True)
class HNSWRaBitQIndexParams(VectorIndexParams):
    total_bits: int = 7
    num_clusters: int = 16
    sample_count: int = 0
    m: int = 50
    ef_construction: int = 500
    index_type = IndexType.HNSW_RABITQ

    def validate(self) -> None:
        super().validate()
        _require(self.metric != MetricType.MIPSL2, "RaBitQ takes L2, IP or cosine")
        _require(self.quantize == QuantizeType.UNDEFINED, "RaBitQ takes no other quantizer")
        _require(1 <= self.total_bits <= 9, "total_bits must be from 1 to 9")
        _require(self.num_clusters > 0 and self.sample_count >= 0, "clusters must be positive, the sample not negative")
        _require(0 < self.m <= 32_767 and self.ef_construction > 0, "m or ef_construction is out of range")


@dataclass(frozen=True)
class IVFIndexParams(VectorIndexParams):
    n_list: int = 1024
    n_iterations: int = 10
    use_soar: bool = False
    index_type = IndexType.IVF

    def validate(self) -> None:
        super().validate()
        _require(self.n_list > 0 and self.n_iterations > 0, "n_list and n_iterations must be positive")


@dataclass(frozen=True)
class DiskANNIndexParams(VectorIndexParams):
    max_degree: int = 100
    list_size: int = 50
    pq_chunks: int = 0
    index_type = IndexType.DISKANN

    def validate(self) -> None:
        super().validate()
        _require(self.max_degree > 0 and self.list_size > 0 and self.pq_chunks >= 0, "degree and list size must be positive")


@dataclass(frozen=True)
class VamanaIndexParams(VectorIndexParams):
    max_degree: int = 64
    search_list_size: int = 100
    alpha: float = 1.2
    max_occlusion_size: int = 750
    saturate_graph: bool = False
    use_contiguous_memory: bool = False
    use_id_map: bool = False
    index_type = IndexType.VAMANA

    def validate(self) -> None:
        super().validate()
        _require(0 < self.max_degree <= 65_535 and self.search_list_size > 0 and self.alpha >= 1 and self.max_occlusion_size >= 0, "a graph parameter is out of range")


PARAMS = {c.index_type: c for c in (InvertIndexParams, FTSIndexParams, FlatIndexParams, HNSWIndexParams, HNSWRaBitQIndexParams, IVFIndexParams, DiskANNIndexParams, VamanaIndexParams)}


# --- Query parameters --------------------------------------------------------------------


@dataclass(frozen=True)
class QueryParams:
    radius: float = 0.0
    linear: bool = False
    use_refiner: bool = False
    index_type = IndexType.UNDEFINED

    def validate(self) -> None:
        _require(self.radius >= 0 and self.radius < float("inf"), "the radius must be finite and not negative")
        for name, low, high in (("scale_factor", 0, float("inf")), ("ef", 0, 2048), ("n_probe", 0, float("inf")), ("list_size", 0, 1 << 32)):
            value = getattr(self, name, None)
            _require(value is None or low < value <= high, f"{name} is out of range")


@dataclass(frozen=True)
class FlatQueryParams(QueryParams):
    scale_factor: float = 10.0
    index_type = IndexType.FLAT


@dataclass(frozen=True)
class HNSWQueryParams(QueryParams):
    ef: int = 300
    prefetch_offset: int = 8
    prefetch_lines: int = 0
    index_type = IndexType.HNSW


@dataclass(frozen=True)
class HNSWRaBitQQueryParams(QueryParams):
    ef: int = 300
    index_type = IndexType.HNSW_RABITQ


@dataclass(frozen=True)
class IVFQueryParams(QueryParams):
    n_probe: int = 10
    scale_factor: float = 10.0
    index_type = IndexType.IVF


@dataclass(frozen=True)
class DiskANNQueryParams(QueryParams):
    list_size: int = 300
    index_type = IndexType.DISKANN


@dataclass(frozen=True)
class VamanaQueryParams(QueryParams):
    ef: int = 200
    prefetch_offset: int = 8
    prefetch_lines: int = 0
    index_type = IndexType.VAMANA


@dataclass(frozen=True)
class FTSQueryParams(QueryParams):
    default_operator: str = "OR"
    index_type = IndexType.FTS


QUERY_PARAMS = {c.index_type: c for c in (FlatQueryParams, HNSWQueryParams, HNSWRaBitQQueryParams, IVFQueryParams, DiskANNQueryParams, VamanaQueryParams, FTSQueryParams)}


# --- Fields and collections --------------------------------------------------------------


@dataclass(frozen=True)
class FieldSchema:
    name: str
    data_type: DataType
    nullable: bool = False
    dimension: int = 0
    index: IndexParams | None = None

    @property
    def effective_index(self) -> IndexParams | None:
        """A vector field without an index is searched exactly, by inner product."""
        return FlatIndexParams() if self.index is None and self.data_type.is_vector else self.index

    @property
    def filterable(self) -> bool:
        return not self.data_type.is_vector and not isinstance(self.index, FTSIndexParams)

    def validate(self) -> None:
        kind, index = self.data_type, self.index
        _require(bool(FIELD_NAME.fullmatch(self.name)), f"field name {self.name!r}")
        _require(kind in SUPPORTED, f"{self.name}: type {kind.name} is not supported")
        if kind.is_dense:
            _require(1 <= self.dimension <= MAX_DIMENSION, f"{self.name}: dimension {self.dimension}")
        else:
            _require(self.dimension == 0, f"{self.name}: only dense vectors have a dimension")
        if index is None:
            return
        index.validate()
        if isinstance(index, VectorIndexParams):
            _require(kind.is_vector, f"{self.name}: a vector index on {kind.name}")
            self._validate_vector(index)
        elif isinstance(index, FTSIndexParams):
            _require(kind == DataType.STRING, f"{self.name}: full-text search needs a STRING field")
        else:
            _require(not kind.is_vector, f"{self.name}: a scalar index on a vector")

    def _validate_vector(self, index: VectorIndexParams) -> None:
        kind, q, floats = self.data_type, index.quantize, self.data_type in (DataType.VECTOR_FP16, DataType.VECTOR_FP32)
        if kind.is_sparse:
            _require(index.index_type in (IndexType.FLAT, IndexType.HNSW), f"{self.name}: sparse vectors take Flat or HNSW")
            _require(index.metric == MetricType.IP, f"{self.name}: sparse vectors take the inner product")
            _require(q == QuantizeType.UNDEFINED or (q == QuantizeType.FP16 and kind == DataType.SPARSE_VECTOR_FP32), f"{self.name}: sparse quantizer")
            return
        _require(index.metric != MetricType.COSINE or floats, f"{self.name}: cosine needs floating-point vectors")
        _require(q == QuantizeType.UNDEFINED or kind == DataType.VECTOR_FP32, f"{self.name}: only FP32 vectors are quantized")
        _require(q != QuantizeType.INT4 or self.dimension % 2 == 0, f"{self.name}: INT4 needs an even dimension")
        if isinstance(index, HNSWRaBitQIndexParams):
            _require(kind == DataType.VECTOR_FP32 and 64 <= self.dimension <= 4095, f"{self.name}: RaBitQ takes FP32 vectors of 64 to 4,095 dimensions")
        if isinstance(index, IVFIndexParams) and index.metric == MetricType.IP:
            _require(floats, f"{self.name}: IVF by inner product needs floating-point vectors")
        if isinstance(index, DiskANNIndexParams):
            _require(floats, f"{self.name}: DiskANN needs floating-point vectors")
            _require(index.pq_chunks <= self.dimension and (index.pq_chunks or self.dimension >= 2), f"{self.name}: PQ chunks")


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    fields: tuple[FieldSchema, ...]
    max_docs_per_segment: int = 10_000_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))

    def validate(self) -> None:
        _require(bool(COLLECTION_NAME.fullmatch(self.name)), f"collection name {self.name!r}")
        _require(bool(self.fields), "a collection needs a field")
        _require(len({f.name for f in self.fields}) == len(self.fields), "field names must differ")
        _require(sum(f.data_type.is_vector for f in self.fields) <= MAX_VECTORS, "too many vector fields")
        _require(sum(not f.data_type.is_vector for f in self.fields) <= MAX_SCALARS, "too many scalar fields")
        _require(self.max_docs_per_segment >= 1_000, "segments hold 1,000 documents or more")
        for f in self.fields:
            f.validate()

    def field(self, name: str) -> FieldSchema:
        for f in self.fields:
            if f.name == name:
                return f
        raise InvalidArgument(f"no field {name!r}", "schema")

    def with_fields(self, fields: list[FieldSchema]) -> CollectionSchema:
        return replace(self, fields=tuple(fields))

    def struct(self) -> T.StructType:
        """The Spark type of a document's fields; engine facts are in the metadata."""
        return T.StructType([T.StructField(f.name, spark_type(f.data_type), True, {"data_type": int(f.data_type), "dimension": f.dimension}) for f in self.fields])

    # The JSON form: strict and versioned.

    def to_json(self) -> str:
        def of(f: FieldSchema) -> dict:
            index = None if f.index is None else {"type": int(f.index.index_type), **{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(f.index).items()}}
            return {"name": f.name, "data_type": int(f.data_type), "nullable": f.nullable, "dimension": f.dimension, "index": index}

        return json.dumps({"version": 1, "name": self.name, "max_docs_per_segment": self.max_docs_per_segment, "fields": [of(f) for f in self.fields]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CollectionSchema:
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise InvalidArgument(f"no JSON: {e}", "read schema") from e

        def keys(found: dict, wanted: set[str]) -> None:
            _require(isinstance(found, dict) and set(found) == wanted, f"keys {sorted(set(found) ^ wanted)}")

        keys(raw, {"version", "name", "max_docs_per_segment", "fields"})
        _require(raw["version"] == 1, f"version {raw['version']}")
        fields = []
        for f in raw["fields"]:
            keys(f, {"name", "data_type", "nullable", "dimension", "index"})
            index = None
            if f["index"] is not None:
                given = dict(f["index"])
                make = PARAMS.get(given.pop("type", None))
                _require(make is not None, "unknown index type")
                _require(set(given) <= set(make.__dataclass_fields__), f"unknown index parameters {sorted(set(given) - set(make.__dataclass_fields__))}")
                kinds = {"metric": MetricType, "quantize": QuantizeType, "filters": tuple}
                index = make(**{k: kinds[k](v) if k in kinds else v for k, v in given.items()})
            fields.append(FieldSchema(f["name"], DataType(f["data_type"]), f["nullable"], f["dimension"], index))
        found = cls(raw["name"], tuple(fields), raw["max_docs_per_segment"])
        found.validate()
        return found


# --- Projection --------------------------------------------------------------------------


@dataclass(frozen=True)
class Projection:
    """None: all scalar and array fields; []: none; ['*']: all; otherwise those named."""

    output_fields: list[str] | None = None
    include_vectors: bool = False

    def columns(self, schema: CollectionSchema) -> list[str]:
        scalars = [f.name for f in schema.fields if not f.data_type.is_vector]
        wanted = self.output_fields
        if wanted is None or wanted == ["*"]:
            chosen = scalars
        else:
            _require("*" not in wanted, "'*' stands alone")
            _require(len(set(wanted)) == len(wanted), "output fields must differ")
            for name in wanted:
                _require(name in scalars, f"{name!r} is no scalar or array field")
            chosen = list(wanted)
        return chosen + [f.name for f in schema.fields if f.data_type.is_vector and self.include_vectors]

