"""Language-model scores of whole texts: a word unigram base and a causal attention model.

Words are runs of characters other than ASCII white space, A-Z in lower case; each text ends
with one end token. Statistics are counted over all training rows (crc32 of the id as text,
modulo 10, is not 0): the words for the base score, and from them the subword ids that the
attention model shares out within its classes. The attention weights come from steps over every
window of all training rows, each id once: the rows are cut by a hash into ROUNDS, in each of
which every task steps over its own rows from common weights, and the tasks' weights are
averaged by their numbers of ids. So windows and steps grow with the training rows, without
any bound on them. The weights depend on how the input is split.

Each text is cut into words and subwords once for both: the ids, 16 bits each, are saved, and
counts, steps and scores read those.

The base score needs every word's count. The `head` most frequent words are looked up in a
broadcast table of bounded size, which also holds their ids; all other words of a text are
encoded with it and joined with the whole table of counts. The model scores each subword once, in overlapping windows.

Defined results: a null text is empty and has the end token alone; a null id counts as an
empty one for the split; repeated rows are texts of their own; with no training row all counts
are zero and the score is that of an untrained model with even counts; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import Adam, Classes, Model, all_windows
from .common import Scratch, mapped, pick, release, slices
from .substring_dedup import split_words
from .tokens import REMEMBERED, SEP, WordEncoder, encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
START, END, IDS = 49406, 49407, 49408
END_BYTES = END.to_bytes(2, "little")
#: Bytes of ids that are counted, learned or scored in one go.
PIECE = 2_000_000
#: Sixteenths of the training rows in each round, and the rate of its steps.
ROUNDS = ((1, 6e-3), (5, 4e-3), (10, 2.5e-3))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(10)) == 0


def _subwords(words: list[str], vocabulary: str) -> pa.Array:
    """The ids of each word as 16-bit numbers, in a binary column."""
    encode = encoder(WordEncoder, vocabulary, REMEMBERED, False)
    odd = {i: encode.whole(w) for i, w in enumerate(words) if SEP in w}
    ids, sizes = encode.joined(encode.normal([w if SEP not in w else "" for w in words] if odd else words))
    ends = np.concatenate(([0], np.cumsum(sizes))) * 2
    found = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
    return pa.array([odd.get(i, w) for i, w in enumerate(found.to_pylist())], pa.large_binary()) if odd else found


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids in a binary column, one after the other, and where each row's begin (and the last one's end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    ids = np.frombuffer(data, "<u2", offsets[-1] // 2) if data and offsets[-1] else np.zeros(0, "<u2")
    return ids[offsets[0] // 2 :], (offsets - offsets[0]) // 2


def _sequences(coded: pa.DictionaryArray, bounds: np.ndarray, vocabulary: str, place: np.ndarray | None = None, ready: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the end id, and where each text's begin (and the last one's end).

    place, if given, is where in ready the ids of each word of the dictionary are; -1 for a word that is encoded here.
    """
    words, before = coded.dictionary, 0
    at = np.arange(len(words))
    if place is not None:
        far, before, at = place < 0, len(ready), place.copy()
        words = words.filter(pa.array(far))
        at[far] = before + np.arange(len(words))
    table = pa.concat_arrays([*([] if place is None else [ready]), _subwords(words.to_numpy(zero_copy_only=False).tolist(), vocabulary), pa.array([END_BYTES], pa.large_binary())])
    index = np.insert(at[np.asarray(coded.indices)], bounds[1:], before + len(words))
    ids, ends = _ids_of(table.take(pa.array(index)))
    return ids, ends[bounds + np.arange(len(bounds))]


@dataclass
class Shared:
    """What each worker needs to score; every part is bounded."""

    classes: Classes
    inputs: np.ndarray
    model: Model


def _plain(column: pa.ChunkedArray, kind: pa.DataType = pa.string()) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in column.chunks]) if column.num_chunks else pa.array([], kind)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 9_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about size bytes (one row at least): the longer, the fewer words are met again."""
    held, total = [], 0
    for piece in (p for whole in batches for p in slices(whole, size=size // 3)):
        more = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
        if held and total + more > size:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(piece)
        total += more
    if held:
        yield pa.concat_batches(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """Columns word, n over the texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            words, _ = split_words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            found = words.value_counts()
            yield pa.record_batch([found.field("values"), found.field("counts")], ["word", "n"])

    return mapped(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_count(counts: DataFrame, head: int) -> int:
    """A count that at most head words reach, from a histogram of fixed size; no sort of all words."""
    bucket = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.b, r.words) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for b, words in sizes:
        total += words
        if total > head:
            break
        least = b
    # One more than the last count of the bucket below, so that rounding never adds a word.
    return (1 << 62) if least is None else int(np.floor(2 ** (least / 16) + 1e-9)) + (least > 0 and 2 ** (least / 16) % 1 > 1e-9)


def subword_counts(counts: DataFrame, vocabulary: str) -> np.ndarray:
    """How often each id occurs in the counted words; a row for each id goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS)
        for batch in batches:
            ids, ends = _ids_of(_subwords(batch.column("word").to_pylist(), vocabulary))
            total += np.bincount(ids, weights=np.repeat(np.asarray(batch.column("n"), float), np.diff(ends)), minlength=IDS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["id", "n"])

    out = np.zeros(IDS)
    for r in mapped(counts, run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def part(doc_id: Column, text: Column) -> Column:
    """The sixteenth of the training rows that a row is in."""
    return F.pmod(F.xxhash64(doc_id, text, F.lit("lm")), F.lit(16)).cast("int")


def ids_column(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of all texts as a binary column, 16 bits each."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])


def with_ids(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Columns part, ids of rows (columns doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            words, bounds = split_words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            yield pa.record_batch([batch.column("part"), ids_column(*_sequences(words.dictionary_encode(), bounds, vocabulary))], ["part", "ids"])

    return mapped(rows.select(part(F.col("doc_id"), F.col("text")).alias("part"), "text"), run, "part int, ids binary")


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in rows (column ids), end ids too; a row for each id goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for piece in (p for whole in batches for p in slices(whole, "ids", PIECE)):
            total += np.bincount(_ids_of(piece.column("ids"))[0], minlength=IDS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    out = np.zeros(IDS)
    for r in mapped(rows.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def untrained(counts: np.ndarray, vocabulary: str, embedded: int = 1024) -> tuple[Classes, np.ndarray, Model]:
    """Classes, the input row of each id, and a model whose weights are those of its seed."""
    names = encoder(WordEncoder, vocabulary, REMEMBERED, False).tokenizer.get_vocab()
    ends_word = np.zeros(IDS, bool)
    ends_word[[i for token, i in names.items() if token.endswith("</w>")]] = True
    classes = Classes.build(counts, ends_word)
    inputs = classes.of.copy() + embedded
    inputs[np.argsort(-counts, kind="stable")[: embedded - 1]] = np.arange(embedded - 1)
    inputs[START] = embedded - 1
    return classes, inputs, Model(classes.count, embedded + classes.count)


def trained(rows: DataFrame, classes: Classes, inputs: np.ndarray, model: Model, rate: float, batch: int = 64) -> tuple[Model, int]:
    """The model after steps over all windows of rows (column ids), and the number of ids that it has seen.

    Each task yields one row of weights; they are summed in 32 groups before the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast((classes.of, inputs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row, start = shared.value
        own, seen, task = start.with_weights(start.flat()), 0, TaskContext.get().partitionId()
        adam, order = Adam(own), np.random.default_rng(task)
        for piece in (p for whole in batches for p in slices(whole, "ids", PIECE)):
            x, y = all_windows(*_ids_of(piece.column("ids")), START)
            mixed = order.permutation(len(x))
            x, y = x[mixed], y[mixed]
            real = (y >= 0).astype(np.float32)
            seen += int(np.count_nonzero(real))
            x, y = row[np.maximum(x, 0, out=x)], of[np.maximum(y, 0, out=y)]
            for at in range(0, len(x), batch):
                i = slice(at, at + batch)
                # A step counts by its ids, so that the last few windows of a piece don't weigh as much as a whole batch.
                adam.step(x[i], y[i], real[i], rate * len(x[i]) / batch * min(1.0, (adam.t + 1) / 50) / (1 + adam.t / 200) ** 0.5)
        if seen:
            yield pa.record_batch([pa.array([task % 32]), pa.array([seen]), pa.array([(own.flat().astype(np.float64) * seen).tobytes()], pa.binary())], ["part", "seen", "weights"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_py()) for w in table.column("weights"))
        return pa.table([table.column("part")[:1], pa.array([pc.sum(table.column("seen")).as_py()]), pa.array([total.tobytes()], pa.binary())], ["part", "seen", "weights"])

    kind = "part long, seen long, weights binary"
    found = sorted(mapped(rows.select("ids"), run, kind).groupBy("part").applyInArrow(add, kind).collect())
    shared.destroy()
    seen = sum(r.seen for r in found)
    return (model.with_weights(sum(np.frombuffer(r.weights) for r in found) / seen), seen) if seen else (model, 0)


def fit_attention(train: DataFrame, counts: np.ndarray, vocabulary: str) -> tuple[Classes, np.ndarray, Model, int]:
    """Classes, inputs and the model after all rounds, and the number of ids that it has seen: all of train's.

    train has columns part, ids, or doc_id, text, which are then encoded in each round.
    """
    classes, inputs, model = untrained(counts, vocabulary)
    rows, seen, first = train if "ids" in train.columns else with_ids(train, vocabulary), 0, 0
    for share, rate in ROUNDS:
        model, n = trained(rows.where(F.col("part").between(first, first + share - 1)), classes, inputs, model, rate)
        seen, first = seen + n, first + share
    return classes, inputs, model, seen


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    head: int = 200_000,
    report: dict | None = None,
) -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    report, if given, gets the model with its classes and inputs, and the number of ids trained on.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out(F.col("doc_id")))
    train = d.where(~F.col("held_out"))
    counts = scratch.save(word_counts(train), "counts")
    rows = train.count()
    words, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = (words or 0) + rows, distinct + (rows > 0)
    release(spark)
    floor = float(np.log10(n + 0.1 * (v + 1))) if n else float(np.log10(0.1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("word"), batch.column("n"), _subwords(batch.column("word").to_pylist(), vocabulary).cast(pa.binary())], ["word", "n", "ids"])

    top = mapped(counts.where(F.col("n") >= head_count(counts, head)), encode, "word string, n long, ids binary").toArrow().combine_chunks()  # head rows at most
    lookup = spark.sparkContext.broadcast((_plain(top.column("word")), np.log10(np.asarray(top.column("n"), float) + 0.1), _plain(top.column("ids"), pa.large_binary())))
    del top
    end_log = float(np.log10(rows + 0.1))

    def looked_up(coded: pa.DictionaryArray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray, np.ndarray]:
        words, logs_of, _ = lookup.value
        doc, index = np.repeat(np.arange(len(many)), many), np.asarray(coded.indices)
        place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, words), -1))
        known = place >= 0
        logs = np.where(known, logs_of[place] if len(logs_of) else 0.0, 0.0)
        of_head = np.bincount(doc, weights=logs[index], minlength=len(many))
        n_head = np.bincount(doc, weights=known[index], minlength=len(many)).astype(np.int64)
        # The other words, with their number in each text.
        far = ~known[index]
        pairs, times = np.unique(doc[far] * len(coded.dictionary) + index[far], return_counts=True)
        size = max(1, len(coded.dictionary))
        cuts = np.searchsorted(pairs // size, np.arange(len(many) + 1))
        tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % size)), pa.array(times.astype(np.int64))], ["word", "times"]))
        return n_head, of_head, tail, place

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            found, bounds = split_words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            coded, many = found.dictionary_encode(), np.diff(bounds)
            n_head, of_head, tail, place = looked_up(coded, many)
            ids = ids_column(*_sequences(coded, bounds, vocabulary, place, lookup.value[2]))
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), batch.column("part"), pa.array(many + 1), pa.array(n_head), pa.array(of_head), tail, ids], ["row", "doc_id", "held_out", "part", "n_tokens", "n_head", "of_head", "tail", "ids"])

    kind = d.schema["doc_id"].dataType.simpleString()
    facts = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, of_head double"
    keyed = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", part(F.col("doc_id"), F.col("text")).alias("part"), "text")
    coded = scratch.save(mapped(keyed, code, f"row long, doc_id {kind}, held_out boolean, part int, n_tokens long, n_head long, of_head double, tail array<struct<word: string, times: long>>, ids binary"), "coded")
    lookup.destroy()
    learned = coded.where(~F.col("held_out")).select("part", "ids")
    classes, inputs, model, seen = fit_attention(learned, id_counts(learned), vocabulary)
    if report is not None:
        report.update(classes=classes, inputs=inputs, model=model, seen=seen)
    shared = spark.sparkContext.broadcast(Shared(classes, inputs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in (part for whole in batches for part in slices(whole, "ids", PIECE)):
            seq, ends = _ids_of(batch.column("ids"))
            before = np.concatenate((np.array([START], seq.dtype), seq[:-1]))
            before[ends[:-1]] = START
            of = s.classes.of[seq]
            tokens = s.model.score(s.inputs[before], of, ends).astype(np.float64) + s.classes.inside[seq]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(np.add.reduceat(tokens, ends[:-1]))], [*names, "score"])

    names = ["row", "doc_id", "held_out", "n_tokens", "n_head", "of_head"]
    scored = scratch.save(mapped(coded.select(*names, "ids"), run, f"{facts}, score double"), "scored")
    release(spark)
    tail = coded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times")
    logs = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("of_tail"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_tail"))
    n_known = F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(rows > 0))
    base = F.col("of_head") + F.coalesce("of_tail", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(floor)
    return scored.join(logs, "row", "left").select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
