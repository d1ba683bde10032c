from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vekspar.llm import simhash, substring_dedup, topk_search
from vekspar.llm.common import Scratch

from .conftest import EDGES, make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- Exact top-k -----------------------------------------------------------------------------


def brute_topk(rows, k):
    usable = [(i, v, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, (n, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, _, q in usable:
        if rows[i][0] is None or rows[i][0] % 5:
            continue
        scored = sorted((-int((q[: len(x)] * x[: len(q)]).sum()), rows[j][0] if rows[j][0] is not None else 1 << 62, rows[j][0]) for j, _, x in usable if j != i)
        out += [(rows[i][0], r, v, -s) for r, (s, _, v) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_topk(spark, spread):
    r = np.random.default_rng(1)
    centres = r.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] * 2 + spread * r.standard_normal(8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(5, None), (10, []), (15, [1.0, None, *[0.0] * 6]), (20, [float("nan")] * 8), (25, [float("inf")] * 8), (30, rows[30][1]), (None, rows[0][1]), *[(400 + i, rows[5][1]) for i in range(12)]]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<float>, row string, cell int").repartition(4)
    got = topk_search.search(df, F.col("vec_id") % 5 == 0, 5, pivots=6, query_block=20, data_block=64).collect()
    assert sorted(((x.query_id, x.rank, x.vec_id, x.score) for x in got), key=str) == brute_topk(rows, 5)


def test_bounds_prune_clustered_data(spark):
    """In clusters far apart each group gets its own data; without clusters all queries share one group."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 16)) * 4
    told = []
    for spread in (0.05, None):
        rows = [(i, (centres[i % 12] + spread * r.standard_normal(16) if spread else r.standard_normal(16)).astype(np.float32).tolist()) for i in range(2400)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
        report = {}
        got = topk_search.search(df, F.col("vec_id") % 5 == 0, 5, report=report).collect()
        assert sorted(((x.query_id, x.rank, x.vec_id, x.score) for x in got), key=str) == brute_topk(rows, 5)
        told.append(report)
    assert told[0]["groups"] >= 6 and told[0]["scored"] < 0.3 * told[0]["all"]
    assert told[1]["shipped"] <= 1.6 * 2400 and told[1]["scored"] <= told[1]["all"]


def test_topk_small(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk_search.search(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert topk_search.search(spark.createDataFrame([(5, [1.0, 0.0])], kind), F.lit(True)).count() == 0
    got = topk_search.search(spark.createDataFrame([(5, [1.0, 0.0]), (6, [300.0, 0.5])], kind), F.col("vec_id") == 5).collect()
    assert [(x.rank, x.vec_id, x.score) for x in got] == [(1, 6, 256 * 76800)]


# --- SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_groups(fps, ids, bits=4):
    n = [sum(i != j and (a ^ b).bit_count() <= bits for j, b in enumerate(fps)) for i, a in enumerate(fps)]
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= bits and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {}
    for r, d in zip(root, ids, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return n, [least.get(r) for r in root]


def test_simhash_edges(edges, nothing):
    fps = [brute_fingerprint(t) for _, t in EDGES]
    n, roots = brute_groups(fps, [d for d, _ in EDGES])
    want = sorted(((d, format(f, "016x"), m, r) for (d, _), f, m, r in zip(EDGES, fps, n, roots, strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(edges).collect()), key=str) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_pairs_and_components(spark):
    """Random fingerprints with chains of near ones, against all pairs."""
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(60)}
    for start in list(fps)[:15]:
        f = start
        for _ in range(6):
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bits in (0, 3, 4):
        got = sorted((x.a, x.b) for x in simhash.near_pairs(df, bits).collect())
        assert got == [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits]
    pairs = simhash.near_pairs(df, 4).cache()
    _, roots = brute_groups([f & ((1 << 64) - 1) for f in fps], fps)
    linked = {x for p in pairs.collect() for x in p}
    assert {x.node: x.root for x in simhash.components(pairs, Scratch(spark)).collect()} == {f: r for f, r in zip(fps, roots, strict=True) if f in linked}


def test_keys_are_not_broadcast(spark, tmp_path):
    """A small table whose keys are many: its file is under Spark's own threshold, the keys would not be."""
    spark.range(20_000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fp"))
    pairs = simhash.near_pairs(spark.read.parquet(str(tmp_path / "fp")))
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    found = simhash.components(pairs, Scratch(spark)).collect()
    assert len(found) == 101 and {x.root for x in found} == {0}


def test_keep_one(edges, nothing):
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns and nothing.columns == simhash.keep_one(nothing).columns
    ids = sorted((x.doc_id for x in kept.collect() if x.doc_id is not None))
    assert ids == [1, 4, 5, 7, 8, 9, 10]  # 1 stands for the texts without words, null ids included


def test_keep_one_keeps_all_columns(spark):
    kept = simhash.keep_one(spark.createDataFrame([(1, "a b c d e", 7, "k"), (2, "a b c d e", 8, "l")], "doc_id long, text string, __n int, __kept string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d e", 7, "k")] and kept.columns == ["doc_id", "text", "__n", "__kept"]


# --- Substring dedup -------------------------------------------------------------------------


def brute_removal(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    starts = {}
    for (d, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[p : p + length])
                starts[key] = min(starts.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - length + 1):
            if d is not None and starts[tuple(w[p : p + length])] < d:
                gone |= set(range(p, p + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages():
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    shared = [r.choices(words, k=k) for k in (5, 7, 12, 30)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts += r.choice(shared) if r.random() < 0.5 else r.choices(words, k=r.randint(1, 15))
        rows.append((i, " ".join(parts)))
    return [*rows, (7, rows[9][1]), (None, rows[3][1]), (61, rows[20][1]), (62, "x " * 40), (63, "x " * 9)]


@pytest.mark.parametrize("length", [2, 5, 7, 12])
def test_substrings(spark, length):
    rows = passages()
    got = substring_dedup.digests(make_docs(spark, rows).repartition(3), length=length).collect()
    assert sorted(map(tuple, got), key=str) == brute_removal(rows, length)


def test_many_texts_of_one_id(spark):
    """An id with several texts, copies among them, and a passage in every text."""
    r = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(9))
    rows = [(i % 7, f"{' '.join(r.choices('abcdef', k=6))} {shared} {' '.join(r.choices('abcdef', k=6))}") for i in range(60)]
    rows += [(3, rows[8][1]), (9, rows[8][1]), (9, rows[9][1]), (9, "short")]
    got = substring_dedup.digests(make_docs(spark, rows).repartition(3), length=8).collect()
    assert sorted(map(tuple, got), key=str) == brute_removal(rows, 8)


def test_substring_edges(edges, nothing):
    assert sorted(map(tuple, substring_dedup.digests(edges).collect()), key=str) == brute_removal(EDGES, 50)
    assert substring_dedup.digests(nothing).count() == 0
    after = substring_dedup.remove(edges)
    assert after.columns == edges.columns and after.count() == edges.count()
    texts = {x.doc_id: x.text for x in after.collect()}
    assert texts[6] == "" and texts[9] == "a  b\n\nc " and texts[1] is None and texts[11] == ""


def test_window_hashes():
    words = substring_dedup.hash_words(pa.array([str(i % 17) for i in range(200)]))
    for length in (1, 2, 3, 25, 50):
        h = substring_dedup.window_hashes(words, length)[: 200 - length + 1]
        for i in range(0, len(h) - 17):
            assert h[i] == h[i + 17]
        assert len(set(h[:17].tolist())) == 17
    x = np.random.default_rng(0).integers(0, 1 << 60, 100).astype(np.uint64)
    for width in (1, 2, 5, 26):
        assert substring_dedup.window_minima(x, width)[: 101 - width].tolist() == [x[i : i + width].min() for i in range(101 - width)]
