from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vekspar.errors import NotSupported, ParseError
from vekspar.fts import analysis as A
from vekspar.fts import index as I
from vekspar.fts import query as Q
from vekspar.fts.stemmer import stem_english
from vekspar.schema import FTSIndexParams

standard, plain = A.Analyzer().terms, A.Analyzer(FTSIndexParams("whitespace", ())).terms


@pytest.mark.parametrize(("text", "tree"), [
    ("vector", "vector"), ("2024", "2024"), ("full-text", "OR(full text)"), ("+vector", "+vector"), ("-slow", "-slow"), ('"exact phrase"', '"exact phrase"'), ("cat OR dog", "OR(cat dog)"), ("a OR b AND c", "OR(a AND(b c))"), ("foo NOT bar", "AND(foo -bar)"), ("foo AND NOT bar", "AND(foo -bar)"),
    ("+(a OR b)", "+OR(a b)"), ('"machine, LEARNING!"', '"machine learning"'), ("!!!", "<empty>"),
])
def test_trees(text, tree):
    assert str(Q.parse(text, standard)) == tree


def test_escapes_and_default_operator():
    assert str(Q.parse("C\\+\\+", plain)) == "C++"
    assert str(Q.parse("vector database", standard, "AND")) == "AND(vector database)"
    assert str(Q.match("a OR b", standard)) == "OR(a or b)"


@pytest.mark.parametrize("text", ["NOT a", "(a OR b", "", "a AND", "a)"])
def test_syntax(text):
    with pytest.raises(ParseError):
        Q.parse(text, standard)


@pytest.mark.parametrize("text", ["host:port", "term^2"])
def test_unsupported(text):
    with pytest.raises(NotSupported):
        Q.parse(text, standard)


@pytest.mark.parametrize(("text", "simple"), [("apple apple", "apple^2"), ("+apple -apple", "<empty>"), ("+a b", "AND(a ?b)"), ("foo +bar baz +bay", "AND(bar bay ?OR(foo baz))"), ("a -b", "AND(a -b)"), ("-a -b", "<empty>"), ("a OR b OR a", "OR(a^2 b)"), ("a NOT (b OR c)", "AND(a -OR(b c))")])
def test_simplification(text, simple):
    once = Q.simplify(Q.parse(text, plain))
    assert str(once) == simple
    assert Q.simplify(once) == once


def test_tokenizers():
    assert [(t.text, t.start) for t in A.standard("hello世界test")] == [("hello", 0), ("世", 5), ("界", 8), ("test", 11)]
    assert [t.text for t in A.standard("can't 1,000.5 a.b x:y _ 👨‍👩‍👧 🇫🇷🇩🇪")] == ["can't", "1,000.5", "a.b", "x:y", "👨‍👩‍👧", "🇫🇷", "🇩🇪"]
    assert A.standard("café!", 3)[0].text == "caf"
    assert [t.text for t in A.ngram("hello", 2, 3)] == ["he", "hel", "el", "ell", "ll", "llo", "lo"]
    assert [t.text for t in A.ngram("ab1c", 2, 2, ("letter",))] == ["ab"]
    assert [t.text for t in A.whitespace("a b c\x0bd")] == ["a b", "c", "d"]


def test_filters():
    def run(f, *words):
        return [t.text for t in f([A.Token(w, i, 0, 0) for i, w in enumerate(words)])]

    assert run(A.lowercase, "İX", "ẞ", "ΣΑΣ") == ["ix", "ß", "σασ"]
    assert run(A.ascii_folding, "Æon", "ﬁn", "naïve", "日本", "́") [:4] == ["AEon", "fin", "naive", "日本"]
    assert [stem_english(w) for w in "running ponies relational hopping hoping knightly skies".split()] == ["run", "poni", "relat", "hop", "hope", "knight", "sky"]
    with pytest.raises(NotSupported):
        A.Analyzer(FTSIndexParams("standard", ("lowercase", "stemmer"), '{"stemmer_lang": "french"}')).terms("x")


def test_jieba(tmp_path):
    (tmp_path / "jieba.dict.utf8").write_text("中国 10\n人民 8\n中国人民 2\n银行 5\n", encoding="utf-8")
    words = [t.text for t in A.Jieba(str(tmp_path), "search")("中国人民银行 ok")]
    assert "银行" in words and "ok" in words and ("中国人民" in words or {"中国", "人民"} <= set(words))
    assert "中国人民" in [t.text for t in A.Jieba(str(tmp_path), "full")("中国人民")]


def test_bm25_numbers():
    assert I.idf(3, 2) == pytest.approx(0.470003629246)
    assert I.idf(3, 1) == pytest.approx(0.980829253012)


@pytest.fixture(scope="module")
def hybrid(spark):
    rows = spark.createDataFrame([(1, "Go database"), (2, "Go Go search"), (3, "Go database search"), (4, None)], "_doc_id long, title string")
    docs = I.documents(rows, "title", A.Analyzer().column)
    return docs.cache(), I.postings(docs).cache()


def test_scores(hybrid):
    docs, posted = hybrid
    found = {r.doc_id: r._score for r in I.matching(posted, docs, Q.match("database", standard)).collect()}
    n, avg = 4, 8 / 4
    for doc, dl in ((1, 2), (3, 3)):
        assert found[doc] == pytest.approx(I.idf(n, 2) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)))


@pytest.mark.parametrize(("text", "ids"), [('"go search"', [2]), ("go AND database", [1, 3]), ("go NOT database", [2]), ("nothing", []), ('"go go"', [2]), ("+search database", [2, 3])])
def test_matches(hybrid, text, ids):
    docs, posted = hybrid
    assert sorted(r.doc_id for r in I.matching(posted, docs, Q.parse(text, standard)).collect()) == ids


def test_filter_leaves_scores(hybrid, spark):
    docs, posted = hybrid
    tree = Q.match("go", standard)
    every = {r.doc_id: r._score for r in I.search(posted, docs, tree, 10).collect()}
    some = I.search(posted, docs, tree, 10, spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()
    assert [r.doc_id for r in some] == [2, 1]
    assert all(r._score == every[r.doc_id] for r in some)


def test_builtin_terms_agree(spark):
    texts = ["Go  Database", "", None, "\tX y\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(A.simple_terms(F.col("t")).alias("w")).collect()
    assert [r.w for r in df] == [A.Analyzer(FTSIndexParams("whitespace", ("lowercase",))).terms(t) for t in texts]


@pytest.mark.parametrize("params", [FTSIndexParams("standard", ("lowercase", "ascii_folding")), FTSIndexParams("standard", ("ascii_folding", "lowercase", "stemmer"), '{"max_token_length": 5}'), FTSIndexParams("whitespace", ("lowercase",)), FTSIndexParams("ngram", ("lowercase",))])
def test_terms_are_the_tokens_texts(spark, params):
    texts = ["It's 3.14, a_b:c don't. x;y 1,000 'q' _", "Ünïcode ÆON, 東京 タワー it's", "ab" * 20 + "'s", "", None]
    analyzer = A.Analyzer(params)
    whole = [[t.text for t in analyzer(x)] for x in texts]
    assert [analyzer.terms(x) for x in texts] == whole
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    found = {r.i: (r.terms, r.n) for r in rows.select("i", analyzer.terms_column(F.col("x")).alias("terms"), analyzer.count(F.col("x")).alias("n")).collect()}
    assert found == {i: (t, len(t)) for i, t in enumerate(whole)}


def test_token_counts_hold_no_tokens(spark, tmp_path):
    """A batch of texts gives numbers; their tokens never leave the analysis of one text."""
    from vekspar.plans.catalogue import standard_tokens

    spark.createDataFrame([(1, "Go, go!"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = standard_tokens(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, 2), (2, 0)}
    assert "size(" not in found._jdf.queryExecution().analyzed().toString()


def test_postings_need_no_shuffle(spark, tmp_path, monkeypatch):
    """A document's postings are made from its own row, in runs of whole documents, and the texts are read once."""
    monkeypatch.setattr(I, "RUN_ROWS", 3)
    docs = I.documents(spark.createDataFrame([(5, "b a b"), (2, None), (9, "a"), (7, "b é b b")], "_doc_id long, title string"), "title", A.simple_terms)
    assert "Exchange" not in I.postings(docs)._jdf.queryExecution().executedPlan().toString()
    I.store(docs, str(tmp_path / "text"))
    index = I.read(spark, [str(tmp_path / "text")])
    want = {("a", 5): (1, 3, [1]), ("a", 9): (1, 1, [0]), ("b", 5): (2, 3, [0, 2]), ("b", 7): (3, 4, [0, 2, 3]), ("é", 7): (1, 4, [1])}
    assert {(r.term, r.doc_id): (r.tf, r.dl, r.positions) for r in index.postings.collect()} == want
    assert {(r.doc_id, r.dl) for r in index.docs.collect()} == {(5, 3), (2, 0), (9, 1), (7, 4)}


def test_runs_are_sorted_and_whole(monkeypatch):
    monkeypatch.setattr(I, "RUN_TOKENS", 7)
    docs = [(i * 7 % 50, list("dcbadcb"[: i % 8])) for i in range(50)]
    batches = [pa.record_batch([pa.array([d for d, _ in docs[a : a + 9]], pa.int64()), pa.array([t for _, t in docs[a : a + 9]], pa.list_(pa.string()))], ["doc_id", "tokens"]) for a in range(0, 50, 9)]
    runs = [b.to_pylist() for b in I._runs(iter(batches))]
    rows = [(r["term"], r["doc_id"], r["positions"]) for run in runs for r in run if r["term"]]
    assert sorted(rows) == sorted((t, d, [i for i, x in enumerate(ts) if x == t]) for d, ts in docs for t in set(ts))
    assert len(runs) > 10 and all([(r["term"] or "", r["doc_id"]) for r in run] == sorted((r["term"] or "", r["doc_id"]) for r in run) for run in runs)
