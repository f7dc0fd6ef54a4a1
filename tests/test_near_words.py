"""Nearest words: against brute force in slices, and links that don't grow with the square of a form's words."""

import random

import numpy as np
import pytest

from corpusmill.functions import near_words as N
from corpusmill.functions.lexicon import osa_distance


def found_links(words, most=8):
    reach = np.array([2 if len(w) > 3 else 1 for w in words], np.int8)
    of = {}
    for k in {len(w) for w in words}:
        at = [i for i, w in enumerate(words) if len(w) == k]
        of[k] = np.array([[ord(c) for c in words[i]] for i in at], np.uint32).reshape(len(at), k), np.array(at)
    out = []
    for twice, k, first, last, slices in N.plan({k: len(v[1]) for k, v in of.items()}):
        for turn in range(first, last):
            out += N._gapped_twice(of[k], turn, slices, reach, most) if twice else N._others(of, k, turn, slices, reach, most)
    return np.concatenate(out)


def as_lists(links):
    got = {}
    for x in links.tolist():
        got.setdefault(x >> 33, []).append((x & 3, (x >> 2) & ((1 << 31) - 1)))
    return got


@pytest.mark.parametrize("held", [50, 1000, 1 << 20])
def test_nearest_words_by_brute_force(held, monkeypatch):
    monkeypatch.setattr(N, "HELD", held)
    for seed in range(6):
        rnd = random.Random(seed)
        words = list({"".join(rnd.choice("abcdé"[: 2 + seed % 4]) for _ in range(rnd.randint(0, 8))) for _ in range(250)})
        got = as_lists(N.nearest(found_links(words), 8))
        for i, w in enumerate(words):
            near = sorted((d, j) for j, o in enumerate(words) if j != i and (d := osa_distance(w, o)) <= (2 if len(w) > 3 else 1))
            assert got.get(i, []) == near[:8]


def test_links_grow_with_the_words():
    letters = [chr(0x4E00 + k) for k in range(60)]
    few, many = (["word" + a + b for a in letters[:n] for b in letters[:n]] for n in (30, 60))
    n_few, n_many = len(found_links(few)), len(found_links(many))
    assert n_many < 5 * n_few and n_many < len(many) * (len(many) - 1) / 10
    assert {len(v) for v in as_lists(N.nearest(found_links(many), 8)).values()} == {8}


def test_similar_words_exchanges_no_pairs(spark):
    from corpusmill.functions.lexicon import similar_words

    words = ["word" + chr(0x4E00 + a) + chr(0x4E00 + b) for a in range(30) for b in range(30)]
    rows = [(w, 1 + k % 7) for k, w in enumerate(words)] + [(words[0], 1), (None, 5)]
    sc = spark.sparkContext
    before = max(sc._jsc.sc().dagScheduler().nextStageId(), 0)
    found = similar_words(spark.createDataFrame(rows, "tok string, c long"), "tok", "c", 8).collect()
    assert len(found) == 8 * len(words) and {r.distance for r in found} == {1}
    store = sc._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    moved = 0
    for k in range(before, sc._jsc.sc().dagScheduler().nextStageId()):
        try:
            moved += store.lastStageAttempt(k).shuffleWriteRecords()
        except Exception:  # a stage that was skipped
            continue
    assert moved < 50 * len(words)
