import random

import pytest

from kbspark import jobs


@pytest.mark.parametrize("hub", [1000, 3])
def test_against_search(spark, monkeypatch, hub):
    monkeypatch.setattr(jobs, "HUB", hub)
    r = random.Random(hub)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000, 1001 + k) for k in range(50)] + [(1050, 1001), (5, 5)] + [(k, k + 1) for k in range(2000, 2040)]
    near, want = {}, {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        stack = [start] if start not in want else []
        while stack:
            x = stack.pop()
            if want.setdefault(x, start) == start:
                stack += [y for y in near[x] if y not in want]
    found = jobs.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()
    assert {x["node"]: x["component"] for x in found} == want
