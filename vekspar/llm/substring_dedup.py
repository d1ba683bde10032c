"""Substring dedup by level-wise doubling over windows of words.

A word goes if it lies in a window of `length` words that also starts in a document with a
smaller id. Windows are judged on the input. Levels are windows of a quarter of the length, of
half of it, and of the length:

1. Every full window holds one sampled quarter window (that with the smallest hash among the
   quarter windows in it), so equal full windows share a sample. Samples that occur in two
   documents or more are the survivors of this level.
2. Only full windows around a survivor are looked at in windows of twice that length, again by
   the sample that each of them holds. Those that occur in two documents or more survive.
3. Only full windows around those are extended to the full length. Those that occur in another
   document are the result; the smallest id of each decides who keeps it.

The work ends at the level that nothing survives. All levels find the smallest and the largest
id of a hash by a grouped aggregate, combined before the shuffle and saved, and come back to
the documents by an equi-join of two saved tables, whose hot keys (a passage that sits in very
many documents) adaptive execution splits. Whole copies are found by their digest and take no
part in the levels. The full windows are told apart by 128 bits.

Defined results: a null or empty text has no words; shorter texts lose nothing; a row with a
null id loses nothing and makes no other row lose anything; rows with the same id don't count
as smaller; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped, pick, plain_names, release, slices

U = np.uint64


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and where each text's begin (and the last one's end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, bounds = parts.flatten(), np.array(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
    real = np.asarray(pc.greater(pc.binary_length(values), 0))
    if not real.all():
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        values = values.filter(pa.array(real))
    return values, bounds


def hash_words(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), U, len(distinct))[np.asarray(coded.indices)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((x[n:], np.zeros(min(n, len(x)), x.dtype)))


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of the length words from each position on, by doubling; void near the end."""
    level, size, found, have = _mix(words + U(seed)), 1, None, 0
    while True:
        if length & size:
            found = level if found is None else _mix(found * U(0x9E3779B97F4A7C15) + _shift(level, have) * U(0xC2B2AE3D27D4EB4F))
            have += size
        if have == length:
            return found
        level = _mix(level * U(0x9E3779B97F4A7C15) + _shift(level, size) * U(0xD6E8FEB86659FD93))
        size *= 2


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of the width values from each position on; void near the end."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x, _shift(x, size))
        size *= 2
    return np.minimum(x, _shift(x, width - size)) if width > size else x


def halves(length: int) -> tuple[int, int]:
    """The lengths of the first two levels."""
    half = (length + 1) // 2
    return (half + 1) // 2, half


def _samples(words: np.ndarray, length: int, size: int) -> np.ndarray:
    """The hash of the sampled window of size words of each full window; void near the end."""
    return window_minima(window_hashes(words, size), length - size + 1)


def _starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a full window."""
    return np.arange(bounds[-1]) + length <= np.repeat(bounds[1:], np.diff(bounds))


def _new(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it in the same text."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    out[bounds[:-1][np.diff(bounds) > 0]] = True
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """tk tells the texts of an id apart."""
    return pick(docs, doc_id=id_col, text=text_col).withColumn("tk", F.xxhash64("text"))


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur in two documents or more, with the smallest id."""
    return rows.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")


def removals(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Columns doc_id, tk (the text's key), whole (true for texts that are copies), ps (starts of windows that go)."""
    if length < 2:
        raise ValueError("length must be at least 2")
    spark = docs.sparkSession
    # A window takes 2 * length - 1 characters at least.
    keyed = _keyed(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * length - 1))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    quarter, half = halves(length)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of full windows with one quarter sample, with the half samples in it."""
        for batch in (part for whole in batches for part in slices(whole)):
            words, bounds = split_words(batch.column("text"))
            hashed, starts = hash_words(words), _starts(bounds, length)
            first, second = (_samples(hashed, length, n) for n in (quarter, half))
            new = _new(first, bounds)
            runs = np.flatnonzero(new & starts)
            inner = np.flatnonzero((new | _new(second, bounds)) & starts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(inner, runs), len(inner)), pa.int32()), pa.array(second[inner].view(np.int64)))
            doc = pa.array(np.searchsorted(bounds, runs, side="right") - 1)
            yield pa.record_batch([pa.array(first[runs].view(np.int64)), lists, batch.column("doc_id").take(doc), batch.column("tk").take(doc)], ["h", "hs", "doc_id", "tk"])

    sampled = scratch.save(mapped(keyed.select("doc_id", "tk", "text"), sample, f"h long, hs array<long>, doc_id {kind}, tk long"), "sampled")
    # Texts that are copies: they go as a whole, and what they share with others the first copy shares too.
    digests = keyed.select("doc_id", "tk", F.unhex(F.sha2("text", 256)).alias("sha"))
    first = scratch.save(digests.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "first")
    copies = scratch.save(digests.join(first, "sha").where("doc_id > least").select("doc_id", "tk").distinct(), "copies")
    own = scratch.save(sampled.join(copies, ["doc_id", "tk"], "left_anti").select("h", "hs", "doc_id", "tk"), "own")
    scratch.drop("sampled")
    release(spark)
    quarters = scratch.save(_repeated(own, "h").select("h"), "quarters")
    halved = scratch.save(own.join(quarters, "h").select(F.explode("hs").alias("h"), "doc_id", "tk").distinct(), "halved")
    scratch.drop("own")
    release(spark)
    halves_ = scratch.save(_repeated(halved, "h").select("h"), "halves")
    facts = scratch.save(halved.join(halves_, "h").groupBy("doc_id", "tk").agg(F.collect_set("h").alias("half")), "facts")
    scratch.drop("halved")
    release(spark)
    wholes = copies.withColumn("whole", F.lit(True))
    if not facts.take(1):
        return wholes.withColumn("ps", F.array().cast("array<long>"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words, bounds = split_words(batch.column("text"))
            hashed = hash_words(words)
            samples, keep = _samples(hashed, length, half).view(np.int64), _starts(bounds, length)
            for i, h in enumerate(batch.column("half")):
                keep[bounds[i] : bounds[i + 1]] &= np.isin(samples[bounds[i] : bounds[i + 1]], h.values.to_numpy(zero_copy_only=False))
            at = np.flatnonzero(keep)
            doc = np.searchsorted(bounds, at, side="right") - 1
            a, b = (window_hashes(hashed, length, s)[at].view(np.int64) for s in (1, 0x5851F42D4C957F2D))
            p = (at - bounds[doc]).astype(np.int64)
            yield pa.record_batch([pa.array(a), pa.array(b), batch.column("doc_id").take(pa.array(doc)), batch.column("tk").take(pa.array(doc)), pa.array(p)], ["a", "b", "doc_id", "tk", "p"])

    full = scratch.save(mapped(keyed.join(facts, ["doc_id", "tk"]).select("doc_id", "tk", "text", "half"), extend, f"a long, b long, doc_id {kind}, tk long, p long"), "full")
    release(spark)
    least = scratch.save(_repeated(full, "a", "b"), "least")
    gone = full.join(least, ["a", "b"]).where("doc_id > least").groupBy("doc_id", "tk").agg(F.collect_set("p").alias("ps"))
    found = wholes.join(gone, ["doc_id", "tk"], "full").select("doc_id", "tk", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("ps", F.array().cast("array<long>")).alias("ps"))
    found = scratch.save(found, "gone")
    for name in ("full", "facts", "least"):
        scratch.drop(name)
    release(spark)
    return found


def _kept(n: int, whole: bool | None, ps: np.ndarray, length: int) -> np.ndarray:
    """Which of a row's n words stay."""
    if whole:
        return np.full(n, n < length)
    covered = np.zeros(n + length + 1, np.int64)
    np.add.at(covered, ps, 1)
    np.add.at(covered, ps + length, -1)
    return np.cumsum(covered)[:n] == 0


def _joined(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, length: int) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    return keyed.join(removals(docs, scratch, id_col, text_col, length), ["doc_id", "tk"], "left").select("doc_id", "text", "whole", "ps")


def _each(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Row, words and which of them stay."""
    none = np.zeros(0, np.int64)
    words, bounds = split_words(batch.column("text"))
    for i, (whole, ps) in enumerate(zip(batch.column("whole").to_pylist(), batch.column("ps"), strict=True)):
        n = int(bounds[i + 1] - bounds[i])
        yield i, words.slice(int(bounds[i]), n), _kept(n, whole, ps.values.to_numpy(zero_copy_only=False) if ps.is_valid else none, length)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept_sha256; one row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    joined = _joined(docs, scratch, id_col, text_col, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            n, removed, sha = [], [], []
            for _, words, stays in _each(batch, length):
                n.append(len(stays))
                removed.append(int(len(stays) - stays.sum()))
                kept = words if stays.all() else words.filter(pa.array(stays))
                sha.append(hashlib.sha256(" ".join(kept.to_pylist()).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return mapped(joined, run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """docs with the repeated words taken out of its texts; all rows and columns stay.

    A text that loses nothing stays as it is; otherwise the kept words are joined by one space.
    """
    scratch = Scratch(docs.sparkSession)
    found = removals(docs, scratch, id_col, text_col, length)
    inner = plain_names(docs)
    at, names = docs.columns.index(text_col), inner.columns
    keyed = inner.withColumn("doc_id", F.col(f"c{docs.columns.index(id_col)}")).withColumn("tk", F.xxhash64(f"c{at}"))
    joined = keyed.join(found, ["doc_id", "tk"], "left").select(*names, F.col(f"c{at}").alias("text"), "whole", "ps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(at).to_pylist()
            for i, words, stays in _each(batch, length):
                if not stays.all():
                    texts[i] = " ".join(words.filter(pa.array(stays)).to_pylist())
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.record_batch(columns, names)

    return mapped(joined, run, inner.schema).toDF(*docs.columns)


#: Words of each text in DuckDB; every window of 50 words with the smallest id that starts it.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT r, doc_id, unnest(range(len(w) - 49)) AS p, w FROM d WHERE len(w) >= 50
), h AS (
  SELECT r, doc_id, p, array_to_string(list_slice(w, p + 1, p + 50), ' ') AS k FROM s
), g AS (
  SELECT k, min(doc_id) AS least FROM h GROUP BY k
), c AS (
  SELECT r, list(p) AS ps FROM (SELECT DISTINCT h.r, unnest(range(p, p + 50)) AS p FROM h JOIN g USING (k) WHERE h.doc_id > g.least) GROUP BY r
), f AS (
  SELECT d.r, d.doc_id, d.w, coalesce(c.ps, []) AS ps FROM d LEFT JOIN c USING (r)
), x AS (
  SELECT f.r, unnest(w) AS word, unnest(range(len(w))) AS i FROM f
), y AS (
  SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS kept
  FROM x LEFT JOIN (SELECT r, unnest(ps) AS i FROM c) z ON x.r = z.r AND x.i = z.i WHERE z.i IS NULL GROUP BY x.r
)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(len(f.ps) AS BIGINT) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM f LEFT JOIN y USING (r)
"""
