"""Language ID with language-bitmask n-gram filters.

For each n-gram that occurs in the lessons of one or more languages, the bits of all these
languages are set in the slots of a bit-sliced Bloom filter: one look-up returns all languages
that (may) hold the n-gram. A text's n-grams are looked up, the languages counted by bit, the
counts corrected for each language's false-positive rate, and the largest corrected share
decides. N-grams that all languages hold count for all of them alike.

N-grams are taken from words in lower case, with one boundary on either side; runs of
characters that are no letters only separate. So a text's counts are sums over its words, and
a slice of texts looks each different word up once.

The filter is fitted on a bounded sample of labelled rows: of each of the `most_languages`
languages with most rows, the `rows_per_language` different rows with the smallest hashes. All
n-grams of these rows are in the filter; its planes are made in parallel and have `most_bytes`
together at most (more n-grams raise the rates that are corrected for). Predictions read whole
texts and nothing but the text.

Defined results: `und`, with score 0, if the text is null or has no letter, or if nothing was
learned; ties go to the language that sorts first; rows with a null language teach nothing;
repeated rows stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mapped, pick, plain_names, slices

U = np.uint64
#: Lengths of n-grams.
ORDERS = (1, 2, 3, 4)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (runs of letters, in lower case) of all texts, and where each text's begin (and the last one's end)."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+")
    values, bounds = parts.flatten(), np.array(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
    real = np.asarray(pc.greater(pc.binary_length(values), 0))
    if not real.all():
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        values = values.filter(pa.array(real))
    return values, bounds


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, boundaries included, and the word that each is from."""
    code = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    letter = code > 0
    owner = np.cumsum(~letter) - 1  # of a letter and of the boundary before it
    hashes, owners = [], []
    h = np.zeros(len(code), U)
    inner = np.ones(len(code), bool)  # no boundary strictly inside
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ code[n - 1 :]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
        inner = inner[:m] & letter[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        if n in ORDERS:
            # A boundary may open or close it, but not make it up alone.
            real = inner if n > 2 else letter[:m] | letter[n - 1 :]
            hashes.append(h[real] * U(0xD6E8FEB86659FD93) + U(n))
            owners.append(owner[:m][real])
    return np.concatenate(hashes), np.concatenate(owners)


def places(g: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    """The slots of n-grams."""
    step = (g >> U(32)) | U(1)
    return [((g + U(i) * step) & U(size - 1)).astype(np.int64) for i in range(hashes)]


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # (slices of 64 languages, slots)
    hashes: int = 3

    def __post_init__(self) -> None:
        fill = np.array([((self.slots[l // 64] >> U(l % 64)) & U(1)).mean() for l in range(len(self.languages))])
        self.rates = fill**self.hashes  # of false positives, by language

    def masks(self, g: np.ndarray) -> np.ndarray:
        """All languages that hold each n-gram, 64 to a slice."""
        found = None
        for at in places(g, self.slots.shape[1], self.hashes):
            found = self.slots[:, at] if found is None else found & self.slots[:, at]
        return found

    def counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the n-grams that each language holds, and all of its n-grams."""
        g, owner = grams(words)
        masks = self.masks(g)
        hits = np.empty((len(words), len(self.languages)))
        for l in range(len(self.languages)):
            hits[:, l] = np.bincount(owner, weights=(masks[l // 64] >> U(l % 64)) & U(1), minlength=len(words))
        return hits, np.bincount(owner, minlength=len(words))

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language in the n-grams of each text, and the numbers of n-grams."""
        words, bounds = words_of(texts)
        coded = words.dictionary_encode()
        index, many = np.asarray(coded.indices), np.diff(bounds)
        hits, n = self.counts(coded.dictionary.to_pylist())
        text = np.repeat(np.arange(len(many)), many)
        total = np.bincount(text, weights=n[index], minlength=len(many))
        out = np.empty((len(many), len(self.languages)))
        for l, rate in enumerate(self.rates):
            share = np.bincount(text, weights=hits[:, l][index], minlength=len(many)) / np.maximum(total, 1)
            out[:, l] = np.clip((share - rate) / max(1e-9, 1 - rate), 0, 1)
        return out, total


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def lessons(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, rows_per_language: int, most_languages: int) -> DataFrame:
    """Columns lang, text: the different rows with the smallest hashes of each language."""
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    usable = d.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    # Hashes alone are ranked; what passes the last one of its language has its text read.
    order = Window.partitionBy("lang").orderBy("h")
    small = usable.select("lang", "h").withColumn("i", F.row_number().over(order)).where(F.col("i") <= rows_per_language)
    last = small.groupBy("lang").agg(F.max("h").alias("last"))
    if last.limit(most_languages + 1).count() > most_languages:
        frequent = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).select("lang")
        last = last.join(F.broadcast(frequent), "lang")  # most_languages rows
    chosen = usable.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last"))  # most_languages rows
    # Rows that repeat a row have its hash. They are combined before the exchange.
    return chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 1500,
    most_languages: int = 1024,
    most_bytes: int = 64 << 20,
    hashes: int = 3,
) -> Filter:
    """The filter from rows that learn (over column doc_id) marks and whose text and language are set."""
    spark = docs.sparkSession
    sample = lessons(docs, learn, id_col, text_col, lang_col, rows_per_language, most_languages)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, size=2_000_000)):
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                words, _ = words_of(batch.filter(pc.equal(langs, lang)).column("text"))
                g = np.unique(grams(words.unique().to_pylist())[0])
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64))], ["lang", "g"])

    with Scratch(spark) as scratch:
        held = scratch.save(mapped(sample, distinct, "lang string, g long").distinct(), "grams")
        counts = {r.lang: r.n for r in held.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
        languages = sorted(counts)
        planes = max(1, -(-len(languages) // 64))
        size = 1 << max(12, min((max(counts.values(), default=1) * 16 - 1).bit_length(), (most_bytes // (8 * planes)).bit_length() - 1))
        index, block = {l: i for i, l in enumerate(languages)}, min(size, 1 << 16)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = np.zeros((planes, size), U)
            for batch in batches:
                of = np.array([index[l] for l in batch.column("lang").to_pylist()], np.int64)
                g = np.asarray(batch.column("g")).view(U)
                for at in places(g, size, hashes):
                    np.bitwise_or.at(slots, (of // 64, at), U(1) << (of % 64).astype(U))
            for p in range(planes):
                for a in range(0, size, block):
                    part = slots[p, a : a + block]
                    if part.any():
                        yield pa.record_batch([pa.array([p]), pa.array([a]), pa.array([part.tobytes()], pa.binary())], ["plane", "at", "slots"])

        def merge(table: pa.Table) -> pa.Table:
            whole = np.bitwise_or.reduce([np.frombuffer(x.as_py(), U) for x in table.column("slots")])
            return pa.table([table.column("plane")[:1], table.column("at")[:1], pa.array([whole.tobytes()], pa.binary())], ["plane", "at", "slots"])

        kind = "plane long, at long, slots binary"
        slots = np.zeros((planes, size), U)
        for r in mapped(held, fill, kind).groupBy("plane", "at").applyInArrow(merge, kind).toLocalIterator():  # most_bytes together
            slots[r.plane, r["at"] : r["at"] + block] = np.frombuffer(r.slots, U)
    return Filter(languages, slots, hashes)


def predict(docs: DataFrame, found: Filter, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """Columns doc_id, lang_pred, score: the corrected share of the language's n-grams in the text, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(found)  # its size is bounded by the fit
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, size=3_000_000)):
            lang, score = decide(shared.value, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def decide(found: Filter, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not found.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    shares, n = found.shares(texts)
    best = shares.argmax(axis=1)
    return [found.languages[b] if m else "und" for b, m in zip(best, n, strict=True)], np.where(n > 0, shares[np.arange(len(best)), best], 0.0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score, learned from the rows that are not held out."""
    found = fit(docs, ~held_out(F.col("doc_id")), id_col, text_col, lang_col)
    return predict(docs, found, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.2) -> DataFrame:
    """The rows of docs whose text is in a known language: not `und`, and a score of least at least. All columns stay."""
    found = fit(docs, ~held_out(F.col("doc_id")), id_col, text_col, lang_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(found), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at, 3_000_000)):
            lang, score = decide(shared.value, batch.column(at))
            yield batch.filter(pa.array(np.array([l != "und" for l in lang], bool) & (score >= least)))

    inner = plain_names(docs)
    return mapped(inner, run, inner.schema).toDF(*docs.columns)
