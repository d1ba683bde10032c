"""SimHash near-duplicates with pigeonring filtering, in DataFrame operations only.

A fingerprint of 64 bits lies on a ring of five segments. If two fingerprints differ in at
most T bits, some segment starts a chain whose first l segments differ in at most l * T / 5
bits, for every l from 1 to 5. The first two budgets (0 and 1 bits, for T = 4) become the key
of an equi-join: the segment itself with its successor on one side, and every such key within
one bit of the successor on the other. The longer chains and the full Hamming distance are
conditions of that join. A pair is kept for its first chain only, so no pair comes twice.

A key has about 26 bits, so N different fingerprints that lie at random meet in about
75 * N * N / 2**26 candidates, which the longer chains cut before the full distance is taken.

Equal fingerprints are collapsed before the join and carry a count, so thousands of copies
cost one row. A key that many different fingerprints share is split by adaptive execution.
The keys of the join, up to 75 rows for each fingerprint, are never broadcast.

Defined results: a null text has no words, like an empty one; a text without words has
fingerprint zero; repeated rows are documents of their own; a null id is never a smallest id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, pick, plain_names, words

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Of a long: one bit in each 32-bit lane.
LANES = 4294967297


def _signed(mask: int) -> int:
    mask &= (1 << 64) - 1
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Columns row, doc_id, fp (a long); one row for each row of docs."""
    d = pick(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.translate("text", UPPER, LOWER)).alias("w"))
    # Fewer words than a shingle has give one shingle: concat_ws leaves the missing ones out.
    n = F.greatest(F.size("w") - (width - 1), F.lit(1))
    shifted = d.select("row", "doc_id", *(F.slice("w", i + 1, n).alias(f"w{i}") for i in range(width)))
    s = shifted.select("row", "doc_id", F.explode_outer(F.arrays_zip(*(f"w{i}" for i in range(width)))).alias("s"))
    h = s.select("row", "doc_id", F.when(F.col("s").isNotNull(), F.xxhash64(F.concat_ws(" ", *(F.col("s")[f"w{i}"] for i in range(width))))).alias("h"))
    # Bits i and i + 32 are counted in the two halves of one sum.
    counted = h.groupBy("row", "doc_id").agg(F.count("h").alias("n"), *(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES))).alias(f"b{i}") for i in range(32)))

    def bit(k: int) -> Column:
        lane = F.shiftrightunsigned(F.col(f"b{k % 32}"), 32) if k >= 32 else F.col(f"b{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(lane * 2 > F.col("n"), F.lit(_signed(1 << k))).otherwise(F.lit(0).cast("long"))

    return counted.select("row", "doc_id", reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(64)]).alias("fp"))


def _mask(start: int, count: int) -> int:
    """The bits of count segments from start on, around the ring."""
    return sum(((1 << width) - 1) << at for at, width in (SEGMENTS[(start + i) % 5] for i in range(count)))


def near_pairs(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in column fp that differ in at most bits bits (4 or fewer)."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be from 0 to 4")
    budget = [length * bits // 5 for length in range(6)]
    fp = F.col("fp")
    plain, near = [], []
    for i in range(5):
        own, after = _mask(i, 2), SEGMENTS[(i + 1) % 5]
        key = fp.bitwiseAND(F.lit(_signed(own)))
        plain.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
        flips = [0] + [1 << (after[0] + k) for k in range(after[1])] * (budget[2] > 0)
        near += [F.struct(F.lit(i).alias("i"), key.bitwiseXOR(F.lit(_signed(m))).alias("key")) for m in flips]
    a = distinct.select(fp.alias("a"), F.explode(F.array(*plain)).alias("k")).select("a", "k.*")
    b = distinct.select(fp.alias("b"), F.explode(F.array(*near)).alias("k")).select("b", "k.*")
    x = F.col("a").bitwiseXOR(F.col("b"))

    def chain(start: int, first: int) -> Column:
        """Every chain from start, of at least first segments, keeps its budget."""
        return reduce(lambda p, q: p & q, [F.bit_count(x.bitwiseAND(F.lit(_signed(_mask(start, n))))) <= budget[n] for n in range(first, 6)])

    # The key has checked the chains of one and two segments from i; a start before i takes precedence.
    first_start = reduce(lambda p, q: p & q, [(F.col("i") <= j) | ~chain(j, 1) for j in range(4)])
    here = reduce(lambda p, q: p | q, [(F.col("i") == i) & chain(i, 3) for i in range(5)])
    # Both sides are shuffled: Spark takes an exploded table for as small as what it is made from, and would broadcast up to 75 rows for each of its rows.
    return a.join(b.hint("merge"), ["i", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= bits) & here & first_start).select("a", "b")


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns node, root: the smallest node reachable over pairs (a, b); nodes without a pair are left out.

    Alternating large-star and small-star steps: the number of rounds is logarithmic in the
    size of a component. Each step is a grouped minimum and a join, so no neighbour list is
    ever gathered in one task.
    """
    name, edges = "edges0", scratch.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    state = None
    for step in range(1, 200):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Aggregates and what they are made from are saved, so that adaptive execution can split a hot node in the joins.
        least = scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"least{step}")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()
        large = scratch.save(large, f"large{step}")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"low{step}")
        small = large.join(low, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, old, name = scratch.save(small, f"edges{step}"), name, f"edges{step}"
        for gone in (old, f"least{step}", f"large{step}", f"low{step}"):
            scratch.drop(gone)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """Columns doc_id, fingerprint, n_near, component_id; one row for each row of docs.

    n_near counts the other rows linked directly, copies included; component_id is the
    smallest id that can be reached over links, the row's own included.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs, id_col, text_col, width), "rows")
    classes = scratch.save(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "classes")
    pairs = scratch.save(near_pairs(classes.select("fp"), bits), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("fp").alias("b"), "copies"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("copies").alias("near"))
    roots = components(pairs, scratch)
    members = roots.join(classes.select(F.col("fp").alias("node"), "least"), "node")
    smallest = scratch.save(members.groupBy("root").agg(F.min("least").alias("smallest")), "smallest")
    smallest = roots.join(smallest, "root").select(F.col("node").alias("fp"), "smallest")
    facts = classes.join(linked, "fp", "left").join(smallest, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.coalesce("smallest", "least").alias("component_id"))
    facts = scratch.save(facts, "facts")
    return rows.join(facts, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest id stays.

    Rows that repeat the smallest id: the one with the smallest text. Components without any
    id: one row of each different text.
    """
    found = near_duplicates(docs, id_col, text_col, width, bits)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    inner = plain_names(docs)
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    stay = inner.join(kept, key.eqNullSafe(F.col("kept")), "left_semi")
    same = Window.partitionBy(key, F.when(key.isNull(), text)).orderBy(text.asc_nulls_last())
    return stay.withColumn("turn", F.row_number().over(same)).where("turn = 1").drop("turn").toDF(*docs.columns)
