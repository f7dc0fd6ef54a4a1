"""Hand cases of text and word functions."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import lexicon as L
from corpusmill.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "int", bool: "boolean", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize("text", ["", "  ", "a b", "a\x1cb c d", "a b\n\nc", "\u0085x"])
def test_token_count_as_python(spark, text):
    assert one(spark, T.token_count(F.col("t")), t=text) == len(text.split())


def test_clean_text(spark):
    got = one(spark, T.clean_text(F.col("t")), t="\n é\t\tx |||EMAIL_ADDRESS||| \n  y  \n")
    assert got == unicodedata.normalize("NFC", "é") + " x email@example.com\ny"


def test_hash_bucket_is_md5_modulo(spark):
    import hashlib

    for key in ("a", "doc-7", "é"):
        assert one(spark, T.hash_bucket(F.col("k"), "s"), k=key) == int(hashlib.md5((key + "s").encode()).hexdigest(), 16) % 10_000


def test_code_filter(spark):
    assert one(spark, T.code_fraction(F.col("t")), t="def f():\nword") == pytest.approx(8 / 12)
    assert one(spark, T.passes_code_filter(F.col("t"), 0.5), t="\n \n") is False


@pytest.mark.parametrize("word,cls", [("that", "DET"), ("her", "DET"), ("...", "PUNCT"), (" ", "PUNCT"), ("Into", "PREP"), ("house", "CONTENT")])
def test_word_class(spark, word, cls):
    assert one(spark, L.word_class(F.col("w")), w=word) == cls


@pytest.mark.parametrize("a,b,want", [("dog", "dogs", "S"), ("city", "cities", "S"), ("walk", "walked", "ED"), ("walk", "walking", "ING"), ("dog", "cat", "OTHER")])
def test_morph_relation(spark, a, b, want):
    assert one(spark, L.morph_relation(F.col("a"), F.col("b"), F.lit(False)), a=a, b=b) == want


def test_match_case(spark):
    assert one(spark, T.match_case(F.col("a"), F.col("b")), a="their", b="Thier") == "Their"


def test_label_group(spark):
    for label, want in (("NONE", "none"), ("PRED_CONTENT", "lexical"), ("INS_DET", "grammatical")):
        assert one(spark, L.label_group(F.col("x")), x=label) == want


def test_osa():
    assert [L.osa_distance(*p) for p in (("ca", "abc"), ("thier", "their"), ("", "ab"), ("same", "same"))] == [3, 1, 2, 0]


def test_deletions(spark):
    got = set(one(spark, L.deletions(F.col("w")), w="abc"))
    assert {"abc", "ab", "ac", "bc", "a", "b", "c"} <= got


def test_network_algebra():
    from corpusmill.operators import network as N

    r = np.array([[1, 0.8, 0.0, 0.0], [0.8, 1, 0.0, 0.0], [0.0, 0.0, 1, 0.7], [0.0, 0.0, 0.7, 1]])
    w = N.partial_network(r, 500)
    assert w[0, 1] > 0.5 and abs(w[0, 2]) < 1e-6
    assert list(N.communities(w)) == [0, 0, 1, 1]
    assert N.topological_overlap(w)[0, 1] > N.topological_overlap(w)[0, 2]


def test_syntax(spark):
    from corpusmill.operators.features import syntactic

    # "I ate and I slept", "I ate and slept", "He said that I ate and I slept": text, i, pos, tag, dep, head, finite
    rows = [
        ("a", 0, "PRON", "PRP", "nsubj", 1, False), ("a", 1, "VERB", "VBD", "ROOT", 1, True), ("a", 2, "CCONJ", "CC", "cc", 1, False), ("a", 3, "PRON", "PRP", "nsubj", 4, False), ("a", 4, "VERB", "VBD", "conj", 1, True),
        ("b", 0, "PRON", "PRP", "nsubj", 1, False), ("b", 1, "VERB", "VBD", "ROOT", 1, True), ("b", 2, "CCONJ", "CC", "cc", 1, False), ("b", 3, "VERB", "VBD", "conj", 1, True),
        ("c", 0, "PRON", "PRP", "nsubj", 1, False), ("c", 1, "VERB", "VBD", "ROOT", 1, True), ("c", 2, "SCONJ", "IN", "mark", 4, False), ("c", 3, "PRON", "PRP", "nsubj", 4, False), ("c", 4, "VERB", "VBD", "ccomp", 1, True),
        ("c", 5, "CCONJ", "CC", "cc", 4, False), ("c", 6, "PRON", "PRP", "nsubj", 7, False), ("c", 7, "VERB", "VBD", "conj", 4, True),
    ]
    df = spark.createDataFrame(rows, "doc_id string, i int, pos string, tag string, dep string, head_i int, finite boolean").withColumns({"sent_id": F.lit(0), "is_punct": F.lit(False), "is_space": F.lit(False), "is_alpha": F.lit(True)})
    got = {r.doc_id: r for r in syntactic(df).collect()}
    assert [(got[k].clauses, got[k].t_units) for k in "abc"] == [(2, 2), (1, 1), (3, 1)]
    assert got["b"].coord_phrases_per_clause == 1.0 and got["a"].coord_phrases_per_clause == 0.0
    assert got["a"].lexical_density == 0.4


def test_annotator_isolates_errors(spark):
    from corpusmill.operators.tokens import annotate

    def parse(text):
        if text == "bad":
            raise ValueError("no")
        return [{"i": i, "tok": t} for i, t in enumerate(text.split())]

    df = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.tok, r.error) for r in annotate(df, parse, "i int, tok string").collect() if r.tok)
    assert got == [(1, "a", None), (1, "b", None), (3, "c", None)]
    assert annotate(df, parse, "i int, tok string").where("error is not null").count() == 1


def test_factorisation_takes_all_rows(spark):
    """Rows beyond any sample move the components: a rare pattern that the rows of least hash need not have."""
    from corpusmill.operators import network as N

    common, rare = [1.0, 0.0, 1.0, 0.0], [0.0, 1.0, 0.0, 1.0]
    df = spark.range(20_400).select(F.when(F.col("id") < 20_100, F.array(*map(F.lit, common))).otherwise(F.array(*map(F.lit, rare))).alias("x"))
    h = N.nmf_fit(df, "x", 2, rounds=30)
    x = np.array([common, rare])
    assert np.abs(N.nmf_loadings_of(x, h, 200) @ h - x).max() < 0.05
