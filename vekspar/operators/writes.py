"""Keyed writes as plans over DataFrames: what a batch does to the live rows of a collection.

A batch has _pos (its order, a long), _pk, the fields, and _present (names of the fields that
were given; null: all of them). Results have one row for each row of the batch: _pos, _pk,
_doc_id (null on failure), _error (a name of ErrorCode, null on success). Every row that is
written takes a new document id, in the batch's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of a range of positions that one task numbers, about.
RANGE_ROWS = 500_000
#: Ranges at most; beyond, they hold more rows and their sort spills.
RANGES = 4096


def _missing(fields: list[str], required: list[str]) -> Column:
    """Whether a required field is null."""
    found = F.lit(False)
    for f in required:
        found = found | F.col(f"`{f}`").isNull()
    return found


def numbered(rows: DataFrame, next_id: int, scratch: Scratch | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """_doc_id from next_id on, in the order of _pos, without a sort of all rows in one task.

    The rows are saved once. Ranges of positions are cut at quantiles of the saved table and
    written as constants into the plan, so the counts of the ranges and the numbers within them
    come from the same assignment, however the plan is partitioned and however often it runs.
    """
    saved = (scratch or Scratch(rows.sparkSession)).save(rows, "to-number")
    total = saved.count()
    if not total:
        return saved.withColumn("_doc_id", F.lit(None).cast("long"))
    ranges = min(RANGES, -(-total // range_rows))
    cuts = sorted(set(saved.approxQuantile("_pos", [i / ranges for i in range(1, ranges)], min(0.01, 0.25 / ranges)))) if ranges > 1 else []
    bounds = F.array(*(F.lit(int(c)) for c in cuts)).cast("array<long>")
    part = F.size(F.filter(bounds, lambda c: c < F.col("_pos"))) if cuts else F.lit(0)
    spread = saved.withColumn("_part", part)
    sizes = {r._part: r.n for r in spread.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    at, offsets = next_id, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(at).cast("long")]
        at += sizes[p]
    within = Window.partitionBy("_part").orderBy("_pos", *(["_pk"] if "_pk" in rows.columns else []))
    return spread.withColumn("_doc_id", (F.create_map(*offsets)[F.col("_part")] + F.row_number().over(within) - 1).cast("long")).drop("_part")


def _failures(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_error").isNotNull()).select("_pos", "_pk", F.lit(None).cast("long").alias("_doc_id"), "_error")


def _results(written: DataFrame, checked: DataFrame) -> DataFrame:
    return written.select("_pos", "_pk", "_doc_id", F.lit(None).cast("string").alias("_error")).unionByName(_failures(checked))


def _checked(rows: DataFrame, next_id: int, scratch: Scratch | None) -> tuple[DataFrame, DataFrame]:
    """Rows with _error, saved once, so that what is written and what is reported agree; and the numbered good ones."""
    scratch = scratch or Scratch(rows.sparkSession)
    saved = scratch.save(rows, "checked")
    return saved, numbered(saved.where(F.col("_error").isNull()).drop("_error"), next_id, scratch)


def insert(live: DataFrame, batch: DataFrame, next_id: int, required: list[str], scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """New rows, and results. A key that exists, or came earlier in the batch, is ALREADY_EXISTS."""
    fields = [c for c in batch.columns if c not in ("_pos", "_present")]
    keyed = batch.join(live.select("_pk", F.lit(True).alias("_there")), "_pk", "left")
    bad = F.col("_pk").isNull() | (F.length("_pk") == 0) | _missing(fields, required)
    invalid = keyed.withColumn("_bad", bad)
    # Bad rows, which may all lack a key, are no group.
    turn = F.row_number().over(Window.partitionBy("_pk", "_bad", F.when(F.col("_bad"), F.col("_pos"))).orderBy("_pos"))
    checked = invalid.withColumn("_turn", turn).select("_pos", *(f"`{c}`" for c in fields), F.when(F.col("_bad"), F.lit("INVALID_ARGUMENT")).when(F.col("_there") | (F.col("_turn") > 1), F.lit("ALREADY_EXISTS")).alias("_error"))
    checked, written = _checked(checked, next_id, scratch)
    return written.select("_doc_id", *fields), _results(written, checked)


def _merge(live: DataFrame, batch: DataFrame, next_id: int, required: list[str], create: bool, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    names = [c for c in batch.columns if c not in ("_pos", "_pk", "_present")]
    old = live.select("_pk", F.lit(True).alias("_there"), *(F.col(f"`{c}`").alias(f"_old_{c}") for c in names))
    joined = batch.join(old, "_pk", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    # Each row of a key sees what the rows before it have set.
    so_far = Window.partitionBy("_pk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def value(c: str) -> Column:
        given = F.coalesce(F.array_contains("_present", c), F.lit(True))
        newest = F.last(F.when(given, F.struct(F.col(f"`{c}`").alias("v"))), ignorenulls=True).over(so_far)
        return F.when(newest.isNotNull(), newest["v"]).otherwise(F.col(f"_old_{c}"))

    merged = joined.select("_pos", "_pk", "_there", *(value(c).alias(c) for c in names))
    bad = F.col("_pk").isNull() | (F.length("_pk") == 0) | (_missing(names, required) & (F.col("_there") if not create else F.lit(True)))
    error = F.when(F.col("_pk").isNotNull() & ~F.col("_there") & F.lit(not create), F.lit("NOT_FOUND")).when(bad, F.lit("INVALID_ARGUMENT"))
    checked, written = _checked(merged.withColumn("_error", error).drop("_there"), next_id, scratch)
    last = F.row_number().over(Window.partitionBy("_pk").orderBy(F.desc("_pos")))
    newest = written.withColumn("_turn", last).where(F.col("_turn") == 1)
    return newest.select("_doc_id", "_pk", *(f"`{c}`" for c in names)), _results(written, checked)


def upsert(live: DataFrame, batch: DataFrame, next_id: int, required: list[str], scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Existing keys: the given fields replace the old ones. New keys: a whole document."""
    return _merge(live, batch, next_id, required, True, scratch)


def update(live: DataFrame, batch: DataFrame, next_id: int, required: list[str], scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """As upsert for existing keys; others are NOT_FOUND. An explicit null replaces, an absent field doesn't."""
    return _merge(live, batch, next_id, required, False, scratch)


def delete(live: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (column _pk) that go, and results for keys with _pos: the second of equal keys is NOT_FOUND."""
    joined = keys.join(live.select("_pk", "_doc_id"), "_pk", "left")
    turn = F.row_number().over(Window.partitionBy("_pk").orderBy("_pos"))
    found = joined.withColumn("_turn", turn).withColumn("_error", F.when(F.col("_doc_id").isNull() | (F.col("_turn") > 1), F.lit("NOT_FOUND")))
    gone = found.where(F.col("_error").isNull()).select("_pk")
    return gone, found.select("_pos", "_pk", F.when(F.col("_error").isNull(), F.col("_doc_id")).alias("_doc_id"), "_error")


def live_rows(log: DataFrame) -> DataFrame:
    """The newest version of each key of a log (_pk, _seq, _op 'U' or 'D'), unless it is deleted."""
    newest = F.row_number().over(Window.partitionBy("_pk").orderBy(F.desc("_seq"), F.desc("_doc_id")))
    return log.withColumn("_turn", newest).where((F.col("_turn") == 1) & (F.col("_op") != "D")).drop("_turn", "_op", "_seq")


def fetch(live: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key, in order: _pos, _pk, _found and the columns; unknown keys have nulls."""
    wanted = live.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], "_pos long, _pk string")
    hits = live.where(F.col("_pk").isin(list(dict.fromkeys(keys)))).select("_pk", "_doc_id", *(f"`{c}`" for c in columns), F.lit(True).alias("_found"))
    return wanted.join(hits, "_pk", "left").withColumn("_found", F.coalesce("_found", F.lit(False))).orderBy("_pos")
