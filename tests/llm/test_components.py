"""Connected components: by one task and by rounds alike, and few stages for few links."""

import random

from corpusmill.llm import components


def test_both_ways_by_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    links = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, k) for k in range(5001, 5030)] + [(7, 7), (8, None), (None, None), (-(1 << 62), 1 << 62)]
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for first in sorted(near):
        todo = [] if first in want else [first]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = first
                todo += near[x]
    df = spark.createDataFrame(links, "a long, b long")
    for bound in (components.ONE_TASK, 0):
        monkeypatch.setattr(components, "ONE_TASK", bound)
        rows = components.connected_components(df).collect()
        assert len(rows) == len(want) and {r.node: r.root for r in rows} == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_few_links_take_few_stages(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextStageId()
    assert {r.root for r in components.connected_components(df).collect()} == {0}
    assert scheduler.nextStageId() - before <= 10
