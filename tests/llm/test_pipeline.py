from __future__ import annotations

import os

import pytest

import corpus_pipeline
from vekspar.llm import langid, packing, registry, secrets, simhash, substring_dedup

from .conftest import make_docs

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage against what its operator says of the rows before it."""
    secret = "a token=Zx81kq99LmPq here"
    words = " ".join(f"alpha{i} beta{i}" for i in range(60))
    rows = [(i, f"the small green house with water {i} and of the water number{i} " * 3, "en") for i in range(30)]
    rows += [(100, words, "en"), (101, words, "en"), (102, "green water " * 9 + words + " and the end of the house", "en"), (103, secret + " and the house of water", "en"), (104, None, "en"), (105, "12345 !!!", "en")]
    docs, before = make_docs(spark, rows), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {k: {r.doc_id for r in d.collect()} for k, d in seen.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {104, 105}
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(seen["language_id"]).collect()}
    assert ids["near_duplicates"] == set(near.values()) and 101 not in ids["near_duplicates"]
    after = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert "alpha7 beta7" in after[100].text and "alpha7 beta7" not in after[102].text and after[102].text.endswith("the end of the house")
    assert all(r.n_chars == len(r.text) for r in after.values())
    clean = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert clean[103] == "a [secret] here and the house of water" == secrets.redacted(after[103].text)
    total = {}
    for r in docs.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == set(clean)


def test_near_duplicates_send_no_keys_to_the_driver(spark, tmp_path, monkeypatch):
    """The stage's pair join over a saved table that is far below Spark's own broadcast threshold."""
    make_docs(spark, [(i, f"green house {i} of water {i * i} and stone {i % 7}") for i in range(50)]).write.parquet(str(tmp_path / "docs"))
    plans, save = {}, simhash.Scratch.save

    def saved(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(simhash.Scratch, "save", saved)
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert kept.columns == spark.read.parquet(str(tmp_path / "docs")).columns
    assert "SortMergeJoin" in plans["pairs"] and "Broadcast" not in plans["pairs"]


def test_run(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() <= 200


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert [m.__name__.rpartition(".")[2] for m in (langid, simhash, substring_dedup, secrets, packing)] == ["langid", "simhash", "substring_dedup", "secrets", "packing"]
