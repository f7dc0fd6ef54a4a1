"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

from corpusmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver runs all.
SAMPLE = ["top_trigrams", "gram_invariant", "clean_text", "code_fraction", "hash_split", "verify_by_source", "attestation_lookup", "span_overlap_labels", "morph_relation", "weighted_cohens_d", "zou_interval", "qcut_bands", "bh_adjust", "topk_probabilities", "reindex_complete", "events_incremental",
    "depgram_counts", "pmi_pairs", "cube_means", "conditional_rates", "form_gap", "align_pieces", "contiguous_pieces", "gain_matrix", "bootstrap_difference", "permutation_test", "syntactic_features", "policy_divergence", "topk_position",
    "front_by_level", "contrasts", "confound_bound", "rank_ties", "component_summary"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or v != v else round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, sql.fetchall())


def test_similar_words_by_brute_force(spark):
    from corpusmill.functions.lexicon import osa_distance, similar_words

    words = "the then than them hte cat cats act at a bat bath path paths maths worlds word words sword swords".split()
    counts = [(w, 3 + k % 4) for k, w in enumerate(words)]
    got = {}
    for r in similar_words(spark.createDataFrame(counts, "tok string, c long"), "tok", "c", 8).collect():
        got.setdefault(r.word, {})[r.pick] = (r.other, r.distance)
    of = dict(counts)
    for w in words:
        near = sorted((d, -of[o], o) for o in words if o != w and (d := osa_distance(w, o)) <= (2 if len(w) > 3 else 1))
        assert [got.get(w, {}).get(k + 1) for k in range(min(8, len(near)))] == [(o, d) for d, _, o in near[:8]]


def test_front_by_brute_force(spark):
    from corpusmill.operators import stats

    points = [(g, k, k * 37 % 23 / 2.0, k * k % 19 / 2.0) for g in ("a", "b", None) for k in range(60)] + [("a", 60, 1e9, 1e9), ("a", 61, None, 0.0), ("b", 62, 0.0, None)]
    df = spark.createDataFrame(points, "g string, k int, high double, low double")
    whole = [p for p in points if None not in p[2:]]
    for group in ((), ("g",)):
        beats = lambda o, p: (not group or o[0] == p[0]) and o[2] >= p[2] and o[3] <= p[3] and o[2:] != p[2:]
        want = {p for p in whole if not any(beats(o, p) for o in whole)}
        for blocks in (1, 2, 7, 256):
            assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in stats.pareto_front(df, "k", "high", "low", *group, blocks=blocks).collect())
    assert stats.pareto_front(df.limit(0), "k", "high", "low", "g").count() == 0


def test_delta_vectors_by_hand(spark):
    from corpusmill.operators.profiles import delta_vectors

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, vector array<double>")
    best = spark.createDataFrame([(10, [1, 2], [0.25, 0.25], 1), (11, [2, 9], [0.5, 0.5], None), (12, [], [], 2)], "k int, ids array<long>, p array<double>, o long")
    assert {r.k: r.delta for r in delta_vectors(best, "k", "o", vectors).collect()} == {10: [-0.5, 1.0], 11: [0.0, 1.0], 12: [0.0, -2.0]}


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_policy_ranks_tie_in_any_order(spark, tmp_path):
    """groups of the same values have one rank, however their rows are dealt."""
    values = [(float(1 + k * 7 % 50), 901.03 + k * 7919 % 9973 + k % 97 / 100) for k in range(300)]
    rows = [(j, k * 37 % 300 if j % 2 else k) for j in range(8) for k in range(300)]
    rows = sorted(((j, *values[k]) for j, k in rows), key=lambda r: hash((r[0] % 3, r[1:])))
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double").repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["policy_divergence"](spark, str(tmp_path)).collect()
    assert {(r.rank_joint, r.rank_density, r.moved) for r in got} == {(1, 1, 0)} and len({r.difference for r in got}) == 1


def test_ordered_mean_of_odd_values(spark):
    from pyspark.sql import functions as F

    from corpusmill.operators.profiles import ordered_mean

    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", None), ("b", None), ("c", float("inf")), ("d", 2e15), ("d", 4e15), ("e", -3.000001)], "g string, x double")
    got = {r.g: r.m for r in df.groupBy("g").agg(ordered_mean("x").alias("m"), F.count("*").alias("n")).collect()}
    assert got == {"a": 0.15, "b": None, "c": float("inf"), "d": 3e15, "e": -3.000001}


@pytest.mark.parametrize("name", ["ngram_surprisal", "essay_surprisal_summary", "tau_threshold"])
def test_surprisal_same_as_sql_in_pieces(spark, duck, name, monkeypatch):
    """pieces and slices of any size give the SQL's rows, without a row a word in an exchange."""
    from corpusmill.operators import trigrams

    monkeypatch.setattr(trigrams, "PIECE", 700)
    monkeypatch.setattr(trigrams, "BATCH", 50)
    df = registry.queries()[name](spark, SF)
    sql = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert rows(df.columns, df.collect()) == rows(columns, sql.fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "slice" in plan and "Window" not in plan


def test_trigram_counts_of_odd_texts(spark):
    from corpusmill.operators import trigrams

    docs = [(5, "a b a b a b"), (None, "a"), (7, None), (8, ""), (-9, "a b. A B"), (1 << 62, "\u00e9 x")]
    got = sorted((tuple(r) for r in trigrams.trigram_counts_at(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    words = {5: "ababab", None: "a", -9: "abab", 1 << 62: "\u00e9x"}
    grams = {(d, i): tuple(("##" + w)[i : i + 3]) for d, w in words.items() for i in range(len(w))}
    all_ = list(grams.values())
    assert got == sorted(((d, i, all_.count(g), sum(o[:2] == g[:2] for o in all_)) for (d, i), g in grams.items()), key=str)


def test_bootstrap_sums_by_md5():
    """weights of keys of all lengths, as hashed one by one."""
    from hashlib import md5

    from corpusmill.operators.poisson_draws import weights
    from corpusmill.operators.profiles import POISSON

    keys = ["7", "", "12", "-5", "900000", "\u00e9t\u00e9", "x" * 47, "x" * 48, "y" * 60, "7"]
    got = {}
    for some, w in weights(keys, 30, "b1", {}):
        got |= dict(zip(some.tolist(), w.tolist(), strict=True))
    u = lambda k, j: int(md5(f"{k}|{j}|b1".encode(), usedforsecurity=False).hexdigest()[:8], 16) / 2**32
    assert got == {n: [float(sum(u(k, j) >= p for p in POISSON)) for j in range(30)] for n, k in enumerate(keys)}


def test_bootstrap_correlation_same_as_sql(spark, duck):
    df = registry.queries()["bootstrap_correlation"](spark, SF)
    sql = duck.execute(registry.oracle_sql()["bootstrap_correlation"])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in sql.description], sql.fetchall())
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
