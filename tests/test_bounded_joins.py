import random
from collections import Counter

from pyspark.sql import functions as F

from kbspark import jobs
from kbspark.operators import graph, joins
from kbspark.plans.retrieval import multi_hop


def test_overlap_against_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for k in range(500):
        s = r.choice([r.randrange(-50, 50), r.randrange(-(10**6), 10**6)])
        rows.append((r.choice(["a", "a", "b"]), k, s, s + r.choice([0, 1, 2, 3, 17, 64, 1000, 10**6, 3 * 10**9, -5])))
    rows += [(None, 900, 1, 5), ("a", 901, None, 5), ("a", 902, 3, None), ("a", 903, -(2**62), 2**62)]
    new, old = rows[:260] + rows[-4:], rows[240:]
    df = lambda x, name: spark.createDataFrame(x, f"source_id string, {name} long, start long, end long")
    found = Counter(tuple(x) for x in joins.overlapping(df(new, "new_id"), df(old, "old_id")).collect())
    want = Counter((a[0], a[1], b[1]) for a in new for b in old if None not in (*a, *b) and a[0] == b[0] and b[3] > a[2] and b[2] < a[3])
    assert found == want and len(want) > 1000
    assert joins.overlapping(df(new, "new_id").limit(0), df(old, "old_id")).count() == 0


def test_a_source_of_many_ranges_next_to_each_other(spark):
    """All pairs would be ten thousand million; ranges that only touch are no candidates."""
    rows = spark.range(100_000).select(F.lit("s").alias("source_id"), F.col("id").alias("new_id"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 8).alias("end"))
    assert joins.overlapping(rows, rows.withColumnRenamed("new_id", "old_id")).count() == 299_998


def test_subgraph_against_search_of_all(spark):
    r = random.Random(8)
    edges = [(f"n{int(r.random() ** 3 * 120)}", f"n{r.randrange(120)}") for _ in range(600)] + [("n0", f"leaf{k}") for k in range(300)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    starts = ["n0", "n1", "n7", "n77", "leaf5", "alone"]
    for depth, most in ((3, 25), (2, 1000), (3, 1)):
        nodes, kept = graph.subgraph(spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame(edges, "src string, dst string"), depth, most)
        found = {s: set() for s in starts}
        for x in nodes.collect():
            found[x["start"]].add((x["node"], x["depth"], x["truncated"]))
        ends = {s: set() for s in starts}
        for x in kept.collect():
            ends[x["start"]].add((x["src"], x["dst"]))
        for s in starts:
            order, at, level = [(s, 0)], {s}, [s]
            for d in range(1, depth + 1):
                level = sorted({y for x in level for y in near.get(x, ())} - at, key=lambda y: (-len(near[y]), y))
                order += [(y, d) for y in level]
                at |= set(level)
            cut = {n for n, _ in order[:most]}
            assert found[s] == {(n, d, len(order) > most) for n, d in order[:most]}
            assert ends[s] == {(a, b) for a in cut for b in near.get(a, ()) if b in cut and a < b}


def test_hops_with_a_hub(spark):
    edges = [(k, "hub", f"x{k}") for k in range(500)] + [(1000 + k, f"x{k}", f"y{k}") for k in range(500)] + [(2000, "loop", "loop")]
    e = spark.createDataFrame(edges, "edge_id long, src string, dst string")
    hop = joins.one_hop(spark.createDataFrame([("hub",), ("hub",), ("x3",), ("loop",)], "node string"), e, 20).collect()
    assert Counter(x["node"] for x in hop) == {"hub": 20, "x3": 2, "loop": 1}
    out = multi_hop(spark.createDataFrame([(1, "hub"), (2, "y4")], "query_id long, node string"), e, 2, 20).collect()
    assert Counter((x["query_id"], x["round"]) for x in out) == {(1, 0): 1, (1, 1): 20, (1, 2): 20, (2, 0): 1, (2, 1): 1, (2, 2): 1}


def shuffled(spark) -> int:
    """Bytes that the session has shuffled so far."""
    own = spark.sparkContext._jsc.sc()
    own.listenerBus().waitUntilEmpty()
    return own.statusStore().executorList(False).head().totalShuffleWrite()


def test_subgraph_shuffles_lists_not_pairs(spark):
    """Each of 200 starts meets nearly all of 200 x 1000 pairs; less than a byte an edge found is shuffled."""
    r = random.Random(9)
    pairs = [(f"p{k}", f"s{x}") for k in range(1000) for x in r.sample(range(200), 20)]
    starts = spark.createDataFrame([(f"s{k}",) for k in range(200)], "start string")
    before = shuffled(spark)
    nodes, kept = graph.subgraph(starts, spark.createDataFrame(pairs, "src string, dst string"), 3, 1000)
    n, m = nodes.count(), kept.count()
    used = shuffled(spark) - before
    assert n == 200 * 1000 and m > 2_000_000
    assert used < m, used


def test_hops_against_search_of_each_query(spark, monkeypatch):
    """By blocks, with several seeds, unknown and missing ones; and, where a query's lists are too many for a task, by pairs."""
    r = random.Random(5)
    edges = [(k, f"n{int(r.random() ** 2 * 150)}", f"n{r.randrange(150)}") for k in range(500)] + [(900 + k, "n0", f"leaf{k}") for k in range(40)]
    edges += [(2000, "loop", "loop"), (2001, None, "n3"), (2002, "n3", None)]
    cut = {}
    for k, a, b in sorted(edges):
        for x, y in {(a, b), (b, a)} if None not in (a, b) else ():
            cut.setdefault(x, []).append(y)
    cut = {x: {y for y in ys[:4] if y != x} for x, ys in cut.items()}
    seeds = [(q, f"n{q % 150}") for q in range(200)] + [(7, "n99"), (7, "n99"), (7, "leaf3"), (300, "alone"), (301, "loop"), (302, None)]
    want = Counter()
    for q in {q for q, _ in seeds}:
        seen = {n for k, n in seeds if k == q}
        front = set(seen)
        want.update((q, n, 0) for n in front)
        for d in (1, 2, 3):
            front = {y for x in front for y in cut.get(x, ())} - seen
            seen |= front
            want.update((q, n, d) for n in front)
    for most in (1 << 18, 30, 1):
        monkeypatch.setattr(graph, "LISTS", most, raising=False)
        out = multi_hop(spark.createDataFrame(seeds, "query_id long, node string"), spark.createDataFrame(edges, "edge_id long, src string, dst string"), 3, 4)
        assert Counter(tuple(x) for x in out.select("query_id", "node", "round").collect()) == want and len(want) > 2000


def test_hops_shuffle_lists_not_pairs(spark):
    """Each of 4000 queries meets hundreds of nodes; less than two bytes a row of the result are shuffled."""
    r = random.Random(9)
    edges = [(k * 20 + i, f"p{k}", f"s{x}") for k in range(1000) for i, x in enumerate(r.sample(range(200), 20))]
    seeds = spark.createDataFrame([(k, f"s{k % 200}") for k in range(4000)], "query_id long, node string")
    before = shuffled(spark)
    n = multi_hop(seeds, spark.createDataFrame(edges, "edge_id long, src string, dst string"), 3, 20).count()
    used = shuffled(spark) - before
    assert n > 1_000_000
    assert used < 2 * n, (used, n)


def test_subgraphs_leave_no_inner_tables_and_know_their_edges(spark, tmp_path, monkeypatch):
    """Of the settled tables only those stay that the result reads, and the number of edges comes with the nodes."""
    r = random.Random(8)
    pairs = [(f"p{k}", f"s{x}") for k in range(300) for x in r.sample(range(60), 4)]
    starts = spark.createDataFrame([(f"s{k}",) for k in range(50)] + [("alone",)], "start string")
    monkeypatch.setattr(jobs, "shared_dir", lambda _: f"file://{tmp_path}")
    nodes, kept = graph.subgraph(starts, spark.createDataFrame(pairs, "src string, dst string"), 3, 40)
    assert sorted(x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()) == ["edge-lists", "front", "starts"]
    want = {x["start"]: x["n"] for x in kept.groupBy("start").agg(F.count("*").alias("n")).collect()}
    found = {x["start"]: x["edges"] for x in nodes.select("start", "edges").distinct().collect()}
    assert found == {f"s{k}": want.get(f"s{k}", 0) for k in range(50)} | {"alone": 0} and max(found.values()) > 40
