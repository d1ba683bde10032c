from __future__ import annotations

from pyspark.sql import functions as F

from vekspar.operators import writes


def test_numbers_over_many_files(spark, tmp_path):
    """1.5 million rows in 12 files under default settings: whole, unique, in the order of the positions."""
    n = 1_500_000
    path = str(tmp_path / "rows")
    spark.range(0, n, 1, 12).select((F.xxhash64("id") % 1_000_000_007).alias("h"), "id").select((F.col("id") * 3 + F.pmod("h", F.lit(3))).alias("_pos"), F.concat(F.lit("k"), "id").alias("_pk")).write.parquet(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        found = writes.numbered(spark.read.parquet(path), 100).withColumn("want", F.floor(F.col("_pos") / 3) + 100)
        row = found.agg(F.count("*").alias("n"), F.countDistinct("_doc_id").alias("ids"), F.sum((F.col("_doc_id") != F.col("want")).cast("int")).alias("wrong"), F.sum(F.col("_doc_id").isNull().cast("int")).alias("none")).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert (row.n, row.ids, row.wrong, row.none) == (n, n, 0, 0)


def test_reported_ids_are_the_written_ones(spark):
    live = spark.createDataFrame([("k5", 1, 0)], "_pk string, _doc_id long, v int")
    batch = spark.range(0, 5000, 1, 7).select(F.col("id").alias("_pos"), F.concat(F.lit("k"), F.col("id") % 4000).alias("_pk"), (F.rand() * 100).cast("int").alias("v"), F.lit(None).cast("array<string>").alias("_present"))
    new, results = writes.insert(live, batch, 10, ["v"])
    stored = {r._pk: r._doc_id for r in new.collect()}
    told = {r._pk: r._doc_id for r in results.collect() if r._error is None}
    assert stored == told and sorted(told.values()) == list(range(10, 10 + 3999)) and "k5" not in told


def test_positions_cut_into_ranges(spark):
    rows = spark.createDataFrame([(p, f"k{p}") for p in [*range(0, 50), *range(1000, 5000, 7), 10**12, -5]], "_pos long, _pk string")
    found = writes.numbered(rows.repartition(5), 0, range_rows=40).collect()
    assert [r._doc_id for r in sorted(found, key=lambda r: r._pos)] == list(range(len(found)))
    assert writes.numbered(rows.limit(0), 7).count() == 0
