"""Operators against brute force on small tables, and on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LONG = "word, " * 30_000
ODD = [
    (1, "One two three four five six seven.", "a"), (1, "One two three four five six seven.", "a"), (None, "One two three four five six seven.", None), (2, None, "a"), (3, "", "b"), (4, " \n\t ", None),
    (5, LONG, "b"), (6, "Ünï <|endoftext|> 中文 \x1c ΑΣ 's  don't\n\n x", "c"), (7, "released under the MIT License and the Apache License, Version 2.0.", "c"), (8, "two", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, 0, "x", "y", 1) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, label string, score int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def roots(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_token_counts(spark, odd):
    from corpusmill.llm.token_counts import token_counts

    t = Tokenizer.from_file(BYTE)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in ODD)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(odd, BYTE).collect())
    assert got == want
    assert token_counts(odd.limit(0), BYTE).count() == 0


def test_pieces_agree_with_library():
    from corpusmill.llm.tokenizing import PreTokens

    marks = [*" \n\t'.,aBs1é  ßİ中Σ", "<|endoftext|>", "'ll", "  ", "\x1c", "<|", "word", "A.B", "x's"]
    random = np.random.default_rng(3)
    texts = ["".join(random.choice(marks, random.integers(0, 25))) for _ in range(3000)]
    for path in (BYTE, WORD):
        library, table = Tokenizer.from_file(path), PreTokens(path, list, lambda x: [i for y in x for i in y])
        assert [table.of(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, odd):
    from corpusmill.llm.packing import first_fit_decreasing, pack

    t = Tokenizer.from_file(WORD)
    rows = pack(odd, WORD).collect()
    ids = collections.defaultdict(list)
    for i, x, _ in ODD:
        ids[i].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4"))
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(odd.limit(0), WORD).count() == 0
    sizes = np.random.default_rng(1).integers(1, 100, 2000)
    bins, offsets = first_fit_decreasing(sizes, 100)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 100 and len(fill) <= np.ceil(sizes.sum() / 100 * 11 / 9) + 1
    first = np.zeros(len(fill), int)  # plain first fit
    for k in np.argsort(-sizes, kind="stable"):
        b = next(i for i in range(len(first)) if first[i] + sizes[k] <= 100)
        assert (b, first[b]) == (bins[k], offsets[k])
        first[b] += sizes[k]


def test_language_model(spark, docs, odd):
    from corpusmill.llm.language_model import score_documents, tokens

    got = {r.doc_id: r for r in score_documents(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in got}
    words = {r.doc_id: tokens(r.text.encode()) for r in docs.collect()}
    c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(c.values()), len(c)
    for i, ws in words.items():
        assert got[i].held_out == held[i] and got[i].train_tokens == total and got[i].n_tokens == len(ws)
        assert got[i].n_known == sum(w in c for w in ws)
        assert got[i].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), abs=1e-6)
    # sanity on held-out texts: the model is no worse than unigrams
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    assert score_documents(odd).count() == len(ODD)
    assert score_documents(odd.limit(0)).count() == 0


def small_vocabulary():
    from corpusmill.llm import language_model as L

    words = [b"a", b"b", b"c", b"", b"d", b"e", b"rare"]
    counts = np.array([400.0, 300, 200, 150, 140, 120, 3])
    by_total, by_distinct = np.zeros(L.ENDINGS), np.zeros(L.ENDINGS)
    by_total[L.ending(b"rare")], by_distinct[L.ending(b"rare")] = 3, 1
    v = L.Vocabulary(words, counts, int(counts.sum()), len(words), 6, by_total, by_distinct)
    v.prepare()
    return v


def plain_log_probability(m, v, context, target):
    """One token by the definition: the sum of weighed context vectors, all classes, all outputs of the class."""
    q = sum(m.position[d - 1].astype(float) * m.context[context[-d]] for d in range(1, len(context) + 1))
    of_class = np.array([q @ c + b for c, b in zip(m.classes.astype(float), m.class_bias, strict=True)])
    k = v.class_of[target]
    own = range(v.starts[k], v.starts[k + 1])
    within = {o: q @ m.output[o].astype(float) + m.bias[o] for o in own}
    return of_class[k] - np.log(np.exp(of_class).sum()) + within[target] - np.log(sum(np.exp(x) for x in within.values()))


def test_model_is_normalised_and_learns():
    from corpusmill.llm import language_model as L

    v = small_vocabulary()
    m = L.first_model(v, 1)
    start = [v.start] * L.SPAN
    uni = [plain_log_probability(L.Model(*(x * 0 if n in ("context",) else x for n, x in vars(m).items())), v, start, o) for o in range(v.outputs)]
    assert np.allclose(np.exp(uni), v.mass, atol=1e-6)  # without contexts it is the unigram
    t = L.Trainer(m, v, 0.2, np.random.default_rng(1))
    a, b, c = (int(v.of_word[k]) for k in range(3))
    ids = np.array(start + [a, b, a, b, c, c] * 100)
    for _ in range(40):
        t.step(ids)
    m = t.m
    for context in (start, [*start[1:], a], [a, b, c, a]):
        p = np.exp([plain_log_probability(m, v, context, o) for o in range(v.outputs)])
        assert p.sum() == pytest.approx(1, abs=1e-6)
        got = np.exp([L.Model.log_probability(m, np.array([*context, o]), v)[-1] for o in range(v.outputs)])
        assert np.allclose(got, p, atol=1e-5)
    # order matters: "a b" is met and "b a" after "c" is not
    assert plain_log_probability(m, v, [c, c, a, b], a) > plain_log_probability(m, v, [a, b, c, c], b)
    whole = L.Model.log_probability(m, ids, v)
    assert np.allclose(whole, [plain_log_probability(m, v, ids[i - L.SPAN : i].tolist(), ids[i]) for i in range(L.SPAN, len(ids))], atol=1e-4)


def test_scores_are_the_models(spark, odd):
    """The distributed score of each text is the sum of its tokens' by the definition, with starts before it."""
    from corpusmill.llm import language_model as L

    v = small_vocabulary()
    m = L.first_model(v, 2)
    texts = [(1, "a b c"), (2, ""), (3, None), (4, "B a rare never"), (5, "a " * 300)]
    docs = spark.createDataFrame([(i, t, False, 7) for i, t in texts], "id long, text string, held_out boolean, score int")
    encoded = L.written(L.encode_documents(docs, v, "id", "text", ("held_out",)), "test")
    got = {r.id: r for r in L.score(encoded, m, v, None, ("id", "held_out")).collect()}
    log_all = np.log10(v.total + v.distinct + 1)
    counted = {w: n for w, n in zip(v.words, v.counts, strict=True)}
    for i, text in texts:
        context, total, base = [v.start] * L.SPAN, 0.0, 0.0
        for w in L.tokens((text or "").encode()):
            k = v.words.index(w) if w in v.words else -1
            o = int(v.of_word[k]) if 0 <= k < v.n_named else int(v.of_ending[L.ending(w)])
            total += plain_log_probability(m, v, context, o) / np.log(10)
            if not 0 <= k < v.n_named:
                total += np.log10((counted.get(w, 0) + 1) / (v.ending_total[L.ending(w)] + v.ending_distinct[L.ending(w)] + 1))
            base += np.log10(counted.get(w, 0) + 1) - log_all
            context = [*context[1:], o]
        assert got[i].score == pytest.approx(total, abs=1e-3) and got[i].base_score == pytest.approx(base, abs=1e-9)


def test_training_takes_each_token_once(monkeypatch):
    """Steps over joined texts take every token once, with starts before each text and its own words before it."""
    import pyarrow as pa

    from corpusmill.llm import language_model as L

    v = small_vocabulary()
    random = np.random.default_rng(8)
    texts = [random.integers(0, v.outputs, n).astype(np.int32) for n in (1, 3, 700, 2, 90)]
    ids, owner = L.joined(pa.array([t.tolist() for t in texts], pa.list_(pa.int32())), v.start)
    at = np.concatenate([np.flatnonzero(owner == k) for k in range(len(texts))])
    assert [ids[owner == k].tolist() for k in range(len(texts))] == [[v.start] * L.SPAN + t.tolist() for t in texts] and len(at) == len(ids)
    t = L.Trainer(L.first_model(v, 1), v, 0.1, random)
    for k in range(0, len(ids) - L.SPAN, 64):
        t.step(ids[k : k + L.SPAN + 64])
    assert t.seen[:-1].tolist() == np.bincount(np.concatenate(texts), minlength=v.outputs).tolist() and t.seen[-1] == 0


def test_license_scan(spark, odd):
    from corpusmill.llm.license_scan import license_scan

    got = {r.doc_id: r for r in license_scan(odd).collect()}
    r = got[7]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (12, 2, 3, 7, "apache,mit")
    assert got[3].n_words == 0 and got[3].first_word is None and got[3].labels == "" and got[3].score == 0
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    more = [(1, body), (2, body.replace("hereby ", "")), (3, "x " * 500 + "Licensed under CC BY-NC 4.0."), (4, "license of mit"), (5, "the gnu general public license, version 3")]
    found = {r.doc_id: r for r in license_scan(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert [found[k].labels for k in (1, 2, 3, 4)] == ["mit", "", "cc-by-nc-4.0", ""]
    assert found[5].base_labels == "gpl"


def test_fingerprints(spark, odd, docs, texts):
    got = {r.doc_id: r for r in Q.op5_fingerprints(spark, SF).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by = collections.defaultdict(set)
    for i, t in texts.items():
        by[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert np.mean([r.near_edited for r in got.values() if r.n_chars > 600]) > 0.5 > 0.05 > np.median([r.near_next for r in got.values()])
    from corpusmill.llm.syncmers import fingerprint_neighbours

    rows = fingerprint_neighbours(odd).collect()
    assert len(rows) == len(ODD) and all(r.fingerprint for r in rows)
    assert [r.near_next for r in fingerprint_neighbours(odd.where("doc_id = 8")).collect()] == [1.0]
    assert fingerprint_neighbours(odd.limit(0)).count() == 0


def test_neighbours_over_buckets(spark, monkeypatch):
    from corpusmill.llm import syncmers

    monkeypatch.setattr(syncmers, "BUCKET_DOCS", 7)
    ids = sorted(int(x) for x in np.random.default_rng(4).choice(10_000, 200, replace=False) - 5000)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").repartition(5)
    got = {r.id: r.next.text for r in syncmers.with_next(df, ["text"], "id").collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_closed_syncmers_are_context_free(spark):
    """An anchor of a passage stays one whatever stands around it."""
    from corpusmill.llm.syncmers import PLACE_BITS, with_anchors

    random = np.random.default_rng(2)
    words = [f"w{k}" for k in random.integers(0, 10_000, 60)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", "y", *words, "z"]))]
    got = {r.id: [a >> PLACE_BITS for a in r.f] for r in with_anchors(spark.createDataFrame(rows, "id int, t string"), "t", "f").collect()}
    assert len(set(got[1]) - set(got[2])) <= 2


def test_anchors_of_long_texts(spark):
    """All anchors at all places, against brute force on the words; a passage keeps its own in a long text; any white space parts words."""
    from corpusmill.llm.syncmers import PLACE_BITS, fingerprint_neighbours, with_anchors

    random = np.random.default_rng(12)
    draw = lambda n: [f"w{k}" for k in random.integers(0, 50_000, n)]
    shared = draw(200)
    one, two = [*draw(900), *shared, *draw(900)], [*draw(300), *shared, *draw(1500)]
    texts = [" ".join(shared), " ".join(one), " ".join(two), "\n".join(shared), " ".join(shared + shared)]
    got = {r.id: [(a >> PLACE_BITS, a & ((1 << PLACE_BITS) - 1)) for a in r.f] for r in with_anchors(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", "f").collect()}
    at = lambda k, shift: {(a, p + shift) for a, p in got[k]}
    assert len(got[0]) > 48 and got[3] == got[0]
    assert at(0, 900) <= set(got[1]) and at(0, 300) <= set(got[2])
    assert at(0, 0) | at(0, 200) <= set(got[4])
    near = {r.doc_id: r.near_next for r in fingerprint_neighbours(spark.createDataFrame(list(enumerate(texts[1:3])), "doc_id int, text string")).collect()}
    one, two = ({a for a, _ in got[k]} for k in (1, 2))
    assert near[0] == near[1] == pytest.approx(len(one & two) / len(one | two), abs=0.02) and len(one & two) >= len(got[0])


def test_simhash(spark, docs, odd, texts):
    got = {r.doc_id: r for r in Q.op6_simhash(spark, SF).collect()}
    order = sorted(texts)

    def fp(t):
        w = t.encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    f = [fp(texts[i]) for i in order]
    assert [got[i].fingerprint for i in order] == [f"{x:016x}" for x in f]
    pairs = [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2]
    assert [got[i].component_id for i in order] == [order[r] for r in roots(len(f), pairs)]
    from corpusmill.llm.simhash import near_duplicates, simhash_groups

    rows = simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fp == 0} == {2}
    assert simhash_groups(odd.limit(0)).count() == 0
    assert near_duplicates(odd.limit(0)).count() == 0


def test_vantage_tree_finds_all_links():
    from corpusmill.llm.simhash import VantageTree, shard_forest

    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.uint64(1) << random.integers(0, 64, (2, 3000)).astype(np.uint64)
    points = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1]]))
    near = [(a, int(b)) for a in range(len(points)) for b in np.flatnonzero(np.bitwise_count(points[a] ^ points[:a]) <= 2)]
    want = roots(len(points), near)
    assert list(shard_forest(points, 2)) == want
    tree = VantageTree(points[::7], 5, 2)
    rows, leaves = tree.route(points)
    held = collections.defaultdict(set)
    for r, leaf in zip(rows.tolist(), leaves.tolist(), strict=True):
        held[r].add(leaf)
    assert tree.leaves > 8 and all(held[a] & held[b] for a, b in near)


def test_components(spark):
    from corpusmill.llm.components import connected_components

    random = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    ids = sorted({x for a, b in edges if a != b for x in (a, b)})
    at = {x: k for k, x in enumerate(ids)}
    want = {ids[k]: ids[r] for k, r in enumerate(roots(len(ids), [(at[a], at[b]) for a, b in edges if a != b]))}
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.root for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    from corpusmill.llm.simhash import near_duplicates

    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    order = sorted(rows)
    pairs = [(a, b) for a in range(len(order)) for b in range(a) if len(x := sets[order[a]] & sets[order[b]]) >= 0.8 * len(sets[order[a]] | sets[order[b]]) and x]
    want = [order[r] for r in roots(len(order), pairs)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert np.mean([got[i] == w for i, w in zip(order, want, strict=True)]) >= 0.99
    assert all(got[i] in {order[r] for r in roots(len(order), pairs)} or got[i] == i for i in order)


def test_near_duplicates_of_a_star(spark):
    """Copies are like their original and seldom like one another, so few buckets have a head that joins all."""
    from corpusmill.llm.simhash import near_duplicates

    random = np.random.default_rng(11)
    words = [f"w{k}" for k in range(135)]
    texts = [" ".join(words)]
    for k in range(2000):
        copy = list(words)
        for j in range(2):
            copy[random.integers(4 + 66 * j, 65 + 66 * j)] = f"x{k}-{j}"
        texts.append(" ".join(copy))
    places = list(random.permutation(len(texts)))
    rows = [(int(i), t) for i, t in zip(places, texts, strict=True)]
    names = {}
    has = np.zeros((len(rows), 135 + 2000 * 10), np.float32)
    for i, t in rows:
        w = t.split()
        for g in {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
            has[i, names.setdefault(g, len(names))] = 1
    common, size = has @ has.T, has.sum(1)
    near = common >= 0.8 * (size[:, None] + size[None, :] - common)
    assert near.mean() < 0.1
    want = roots(len(rows), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a > b])
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from corpusmill.llm.quality import quality

    rows = quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.95
    some = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = quality(odd, some).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality(odd, some.limit(0)).count() == len(ODD)


def test_mixing(spark, odd):
    got = Q.op8_mixing(spark, SF).collect()
    again = Q.op8_mixing(spark, SF).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sql = duckdb.sql(f"""select source, sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) as s from '{SF}/documents.parquet' group by 1 order by 1 nulls last""").fetchall()
    weights = [(3, 1, 2)[k % 3] for k in range(len(sql))]
    sizes, total = [float(s) for _, s in sql], 1.5 * sum(s for _, s in sql)
    capped = set()
    while True:
        level = (total - sum(2 * sizes[k] for k in capped)) / sum(w for k, w in enumerate(weights) if k not in capped)
        new = {k for k in range(len(sql)) if k not in capped and level * weights[k] > 2 * sizes[k]}
        if not new:
            break
        capped |= new
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for k, (s, _) in enumerate(sql):
        target = 2 * sizes[k] if k in capped else level * weights[k]
        assert abs(taken[s] - target) <= 1
    from corpusmill.llm.mixing import mix

    assert mix(odd).count() == len(ODD)
    assert mix(odd.limit(0)).count() == 0


def test_pivotal_keeps_words_and_odds():
    from corpusmill.llm.mixing import pivotal

    random = np.random.default_rng(8)
    size = random.integers(1, 500, 40)
    p = np.full(40, 0.3)
    sums = np.zeros(40)
    for k in range(2000):
        out = pivotal(p, size, np.random.default_rng(k))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert out @ size == pytest.approx(p @ size)
        sums += out
    assert np.abs(sums / 2000 - 0.3).max() < 0.05


def test_mixing_tree(spark, monkeypatch):
    from corpusmill.llm import mixing

    monkeypatch.setattr(mixing, "GROUP_DOCS", 3)
    monkeypatch.setattr(mixing, "TREE_FAN", 2)
    rows = [(i, "w " * (1 + i % 13), "ab"[i % 3 == 0]) for i in range(120)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sums, targets = collections.Counter(), {}
    for r in got:
        sums[r.source_size] += r.taken
        targets[r.source_size] = r.target
    assert len(got) == 120 and all(abs(sums[k] - t) <= 1 for k, t in targets.items())


def test_line_dedup(spark, odd):
    from corpusmill.llm.line_dedup import drop_boilerplate

    got = Q.op9_line_dedup(spark, SF)
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(Q.ORACLES["op9_line_dedup"])
    columns = want.columns
    assert sorted(got.select(*columns).collect()) == sorted(want.fetchall())
    line = "this line stands on very many sites of the web"
    rows = [(k, f"own text {k}\n{line}\n", f"s{k % 9}") for k in range(3, 30)] + [(1, line, None), (None, f" {line} ", "s1"), (50, None, "s2"), (51, "", "s3")]
    rows += [(k, f"few sites have this line of text\nmore {k}", f"s{k % 4}") for k in range(60, 80)]
    kept = {r.doc_id: r for r in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=5).collect()}
    assert kept[1].text == line and kept[3].text == "own text 3\n" and kept[None].text == "" and kept[50].text is None and kept[51].text == ""
    assert all(kept[k].n_removed == 0 for k in range(60, 80))
    assert drop_boilerplate(odd).count() == len(ODD)
    assert drop_boilerplate(odd.limit(0)).count() == 0


def test_line_dedup_without_broadcasts(spark, monkeypatch):
    from corpusmill.llm import common

    want = sorted(Q.op9_line_dedup(spark, SF).collect())
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", -1)
    assert sorted(Q.op9_line_dedup(spark, SF).collect()) == want


def test_cosine_of_exactly_the_threshold_links(spark, monkeypatch):
    from corpusmill.llm import embeddings as E

    monkeypatch.setattr(E, "LEAST", 16)
    random = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, [19.0, 6.0, 1.0, 1.0, 1.0]), (2, [19.0, 6.001, 1.0, 1.0, 1.0])]  # 19/20, and a little less
    rows += [(k, random.normal(size=5).tolist()) for k in range(3, 200)]
    got = {r.vec_id: r for r in E.cosine_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    near = np.array([[sum(p * q for p, q in zip(a, b, strict=True)) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) for b in x] for a in x]) >= 0.95
    np.fill_diagonal(near, False)
    assert near[0, 1] and not near[0, 2]
    assert [got[k].n_links for k in range(len(rows))] == list(near.sum(1))
    assert [got[k].component_id for k in range(len(rows))] == roots(len(rows), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a > b])


def test_embeddings(spark, monkeypatch):
    from corpusmill.llm import embeddings
    from corpusmill.llm.embeddings import cosine_components

    monkeypatch.setattr(embeddings, "LEAST", 8)

    random = np.random.default_rng(9)
    base = random.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + random.normal(size=(20, 16)) * 0.05, base[:5], base[:3] * 2.0])
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    bad = [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] + [1.0] * 15), (104, [None] + [1.0] * 15), (105, [float("inf")] + [1.0] * 15), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "z") for r in rows + bad], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in cosine_components(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = roots(len(x), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a > b])
    assert [got[k].n_links for k in range(len(x))] == list(near.sum(1))
    assert [got[k].component_id for k in range(len(x))] == want
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k, _ in bad)
    assert cosine_components(df.limit(0)).count() == 0


def test_pca_bound_drops_no_pair(monkeypatch):
    from corpusmill.llm import embeddings as E

    monkeypatch.setattr(E, "TILE", 32)
    random = np.random.default_rng(10)
    a = random.normal(size=(300, 24)) * np.linspace(3, 0.2, 24)
    a = np.concatenate([a, a[:100] + random.normal(size=(100, 24)) * 0.1])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    got = {(int(r), int(c)) for rows, cols in E.linked_tiles(a, a, a, a, 0.95, [4, 10, 24]) for r, c in zip(rows, cols, strict=True)}
    want = {(int(r), int(c)) for r, c in zip(*np.nonzero(a @ a.T >= 0.95), strict=True)}
    assert {p for p in got ^ want if abs(a[p[0]] @ a[p[1]] - 0.95) > 1e-12} == set()


def base_text(n=60, mark="w"):
    return " ".join(f"{mark}{k}" for k in range(n))


@pytest.mark.parametrize("turn", [0, 1])
def test_near_copies_of_repeated_and_null_ids(spark, turn):
    """Links follow the texts, whatever the ids and the order of rows."""
    from corpusmill.llm.stages import drop_near_copies

    base, near, other = base_text(), base_text(59) + " changed", base_text(60, "z")
    first = [(1, other), (1, base)]
    rows = [*(first[::-1] if turn else first), (2, near), (None, near + " more"), (3, base_text(60, "q")), (None, base_text(60, "r")), (3, base_text(60, "s")), (7, None), (8, ""), (9, None)]
    df = spark.createDataFrame([(*r, 1.5, 2) for r in rows], "doc_id long, text string, cls double, text_hash int")
    got = collections.Counter((r.doc_id, r.text) for r in drop_near_copies(df).collect())
    want = [(1, other), (1, base), (3, base_text(60, "q")), (None, base_text(60, "r")), (3, base_text(60, "s")), (7, None)]
    assert got == collections.Counter(want)
    assert drop_near_copies(df).columns == df.columns and drop_near_copies(df.limit(0)).count() == 0


def test_near_copy_recall(spark, docs):
    """Of all pairs of 0.8 or more by brute force, as many are in one group as the views promise, and no other document is joined."""
    from corpusmill.llm.simhash import near_duplicates

    random = np.random.default_rng(6)
    rows, pairs = [], []
    for k in range(150):
        words = [f"{k}-{j}" for j in range(int(random.integers(60, 300)))]
        copy = list(words)
        for at in random.choice(len(words), len(words) // 60, replace=False):
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, copy))
        if len(x & y) >= 0.8 * len(x | y):
            pairs.append(k)
    assert len(pairs) > 50
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[2 * k + 1] == 2 * k for k in pairs]) >= 0.97
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(150))


def test_stages_with_odd_rows(spark):
    """Nulls, repeats, empty tables and names that the stages use themselves."""
    import corpus_pipeline as C

    names = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, gone int, copies int, id string, left string, label int"
    rows = [(i, t, "en", s, 0, 0.5, "r", 1, 2, "i", "l", 0) for i, t, s in ODD]
    df = spark.createDataFrame(rows, names)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        assert out.count() >= 1
        empty = stage(spark, df.limit(0), SF)
        assert empty.columns == df.columns and empty.count() == 0
    assert C.pack_tokens(spark, df, SF).agg(F.count_distinct("sequence_id")).first()[0] > 0
    assert C.pack_tokens(spark, df.limit(0), SF).count() == 0


def test_risk_and_gradient_by_brute_force(spark, docs):
    """What tasks add up is the non-negative risk over all rows, and its gradient that of finite differences."""
    from corpusmill.llm import quality as Y

    positive = docs.where("doc_id % 3 = 0").select("doc_id")
    table = Y.feature_table(docs, positive, "doc_id", "text")
    zero, one = np.zeros(Y.DENSE), np.ones(Y.DENSE)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = []
    for i, t in texts.items():
        dense, index, counts = Y.features(t)
        x = np.zeros(Y.DENSE + Y.BUCKETS + 1)
        x[: Y.DENSE], x[-1] = dense, 1
        for k, c in zip(index, counts, strict=True):
            x[Y.DENSE + k] += np.sqrt(c / sum(counts))
        rows.append((i % 3 == 0, x))
    p, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    random = np.random.default_rng(1)
    for prior in (0.3, 0.9):
        risk = Y.non_negative_risk(table, prior, zero, one, p.sum(), len(p), x[p].mean(0))

        def plain(theta, prior=prior):
            z = x @ theta
            down = np.logaddexp(0, z)
            return prior * (down - z)[p].mean() + max(0.0, down.mean() - prior * down[p].mean()) + Y.DECAY / 2 * (theta[:-1] ** 2).sum()

        theta = random.normal(size=x.shape[1]) * 0.1
        value, gradient = risk(theta)
        assert value == pytest.approx(plain(theta), abs=1e-9)
        for k in (0, 1, 5, Y.DENSE + 7, x.shape[1] - 1, *random.integers(0, x.shape[1], 5)):
            step = np.zeros_like(theta)
            step[k] = 1e-5
            assert gradient[k] == pytest.approx((plain(theta + step) - plain(theta - step)) / 2e-5, abs=1e-5)


def test_prior_is_read_from_scores():
    from corpusmill.llm.quality import estimated_prior

    random = np.random.default_rng(2)
    for prior in (0.2, 0.6, 0.9):
        p, n = random.normal(2, 1, 50_000), random.normal(-1, 1, 50_000)
        u = np.concatenate([random.normal(2, 1, int(50_000 * prior)), n[: int(50_000 * (1 - prior))]])
        bins = np.linspace(-8, 8, 401)
        assert estimated_prior(np.histogram(-p, bins)[0].astype(float), np.histogram(-u, bins)[0].astype(float)) == pytest.approx(prior, abs=0.04)


def test_anchors_by_brute_force(spark, docs):
    """Fingerprints of the whole table by the definition, and likeness by matching places."""
    from corpusmill.llm import syncmers as Y
    from corpusmill.llm.queries import op5_fingerprints

    rows = {r.doc_id: r for r in op5_fingerprints(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = spark.createDataFrame(list(texts.items()), "id long, text string")
    hashed = words.selectExpr("id", "filter(split(text, '[\\\\s\\\\p{Z}\\\\x{1c}-\\\\x{1f}\\\\x{85}]+'), x -> x <> '') as w", "split(text, '') as c", "length(text) as n")
    hashed = hashed.selectExpr("id", f"if(n < {Y.FEW_CHARS} or n > {Y.LONG_WORDS} * size(w), c, w) as w")
    pairs = {r.id: r.g for r in hashed.selectExpr("id", "transform(w, (x, i) -> xxhash64(x, get(w, i + 1))) as g").collect()}
    for i, g in pairs.items():
        places = [k for k in range(len(g) - 4) if min(g[k], g[k + 3]) <= min(g[k + 1], g[k + 2])]
        anchors = [int(x, 16) for x in rows[i].fingerprint.split()]
        mask = (1 << Y.PLACE_BITS) - 1
        assert sorted(a & mask for a in anchors) == (places or [0])
        assert rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    same = [(a, b) for a in texts for b in texts if a < b and texts[a] == texts[b]]
    assert all(rows[a].fingerprint == rows[b].fingerprint for a, b in same)
    shares = [r.near_edited for i, r in rows.items() if len(texts[i].split()) > 100]
    assert 0.5 < np.median(shares) < 0.75 and np.mean([r.near_edited == 0 for r in rows.values()]) < 0.01


def test_licences_by_brute_force(spark, docs):
    """Base places of the whole table by a plain search, and the labels of texts that hold a template whole, cut, or not at all."""
    import re

    from corpusmill.llm.license_scan import BASE_PHRASES, TEMPLATES, license_scan

    got = {r.doc_id: r for r in license_scan(docs).collect()}
    for r in docs.collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
        at = [(k, label) for phrase, label in BASE_PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.encode().split()]
        own = got[r.doc_id]
        assert (own.n_words, own.n_base) == (len(words), len(at))
        assert (own.first_word, own.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert own.base_labels == ",".join(sorted({x for _, x in at}))
    rows, want = [], {}
    for k, (label, text, _) in enumerate(TEMPLATES):
        words = text.split()
        rows += [(3 * k, "some words before " + text + " and after"), (3 * k + 1, " ".join(w for j, w in enumerate(words) if j % 19 != 18)), (3 * k + 2, " ".join(reversed(words)))]
        want[3 * k] = label
    found = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in found[i].labels.split(","), (label, found[i].labels)
        assert not any(s.label == label and s.n_words > 12 for s in found[i + 2].spans)


def test_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = [n]
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > 0.5 * n and counts[2] == counts[1] and counts[3] < counts[2]
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = spark.read.parquet(str(tmp_path / "0")).join(labels, "doc_id").agg(F.sum("quality")).first()[0]
    assert kept >= 0.97 * labels.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").agg(F.sum("quality")).first()[0]
