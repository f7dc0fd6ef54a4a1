"""What the classifier's passes send to the driver."""

import numpy as np
import pytest

from corpusmill.llm.quality import BUCKETS, DENSE, Rows, summed

HELD = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_driver_gets_one_vector_whatever_the_parts(spark, many_partitions, monkeypatch):
    rows = []
    for i in range(60):
        index, counts = np.arange(i % 7, dtype="<u2") * 211 + i, np.arange(1, i % 7 + 1, dtype="<u4")
        rows.append((i % 3 == 0, i % 2 == 0, [float(i + k) for k in range(DENSE)], index.tobytes(), counts.tobytes()))
    table = spark.createDataFrame(rows, "positive boolean, half boolean, dense array<double>, index binary, counts binary").repartition(24)
    zero, one = np.zeros(DENSE), np.ones(DENSE)

    def part_of(positive, part, half):
        return np.concatenate([[positive.sum(), half.sum(), len(half)], part.back(np.ones(len(half)), zero, one)])

    seen, collect = [], type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda self: seen.append((self, collect(self))) or seen[-1][1])
    got = summed(table, part_of)
    flags = [np.array([r[k] for r in rows]) for k in (0, 1)]
    want = part_of(flags[0], Rows.of(*([r[k] for r in rows] for k in (2, 3, 4))), flags[1])
    assert len(got) == 3 + DENSE + BUCKETS + 1
    assert np.allclose(got, want, rtol=1e-12, atol=0)
    assert sum(len(r.sums) for _, found in seen for r in found) == 8 * len(want)
    assert all(frame.rdd.getNumPartitions() <= 32 for frame, _ in seen)
    assert (summed(table, part_of) == got).all()
    assert len(summed(table.limit(0), part_of)) == 0
