import random
from collections import deque

from millrace.operators import components as c
from millrace.operators import graphs as g


def frame(spark, edges):
    return spark.createDataFrame(edges, "p long, q long")


def distances(edges):
    """The least number of edges, one at least, from each node to each other one, by plain search."""
    below = {}
    for a, b in set(edges):
        if a is not None and b is not None:
            below.setdefault(a, set()).add(b)
    out = {}
    for start in below:
        todo = deque((b, 1) for b in below[start])
        while todo:
            node, d = todo.popleft()
            if (start, node) not in out:
                out[start, node] = d
                todo += [(x, d + 1) for x in below.get(node, ())]
    return out


def shown(rows):
    return {tuple(r) for r in rows.collect()}


def graphs():
    rng = random.Random(4)
    for n, m in ((12, 10), (12, 20), (20, 22)):
        yield [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    chain = [(i, i + 1) for i in range(30)]
    yield chain + [(30, 5), (12, 9), (100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (3, None)]
    yield [(i, i + 1) for i in range(9)] + [(9, 0), (4, 20), (20, 21), (21, 22), (22, 5)]  # two ways of a ring
    yield [(i, (i - 1) // 2) for i in range(1, 40)]


def together():
    """All graphs in one edge table, their nodes apart."""
    shift = lambda x, i: None if x is None else x + 1000 * i
    return [(shift(a, i), shift(b, i)) for i, edges in enumerate(graphs()) for a, b in edges]


def test_closure_and_cycles_equal_plain_search(spark):
    edges = together()
    far = distances(edges)
    df = frame(spark, edges)
    assert shown(g.closure(df, "p", "q")) == {(a, b, d) for (a, b), d in far.items()}
    assert shown(g.closure(df, "p", "q", deepest=3)) == {(a, b, d) for (a, b), d in far.items() if d <= 3}
    assert shown(g.cycles(df, "p", "q")) == {(a, d) for (a, b), d in far.items() if a == b}


def test_nothing(spark):
    none = frame(spark, [])
    assert g.closure(none, "p", "q").count() == 0 and g.cycles(none, "p", "q").count() == 0
    assert c.connected_components(none, "p", "q").count() == 0


def rounds(monkeypatch, module):
    """The list to which every settled table is added."""
    seen = []
    for name in ("settle", "settle_table"):
        monkeypatch.setattr(module, name, lambda df, plain=getattr(module, name): seen.append(1) or plain(df))
    return seen


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    n = 5000
    chain = spark.range(n).selectExpr("id AS p", "id + 1 AS q")
    ring = spark.range(n).selectExpr("id AS p", f"(id + 1) % {n} AS q")
    seen = rounds(monkeypatch, g)
    found = g.cycles(ring.unionAll(chain.selectExpr("p + 10000", "q + 10000")), "p", "q")
    assert found.selectExpr("count(*)", "min(length)", "max(length)", "count(DISTINCT node)").first()[:] == (n, n, n, n)
    assert len(seen) < 40
    seen.clear()
    far = g.closure(chain.where("p < 1000"), "p", "q")
    assert far.selectExpr("count(*)", "max(depth)", "sum(depth)").first()[:] == (1000 * 1001 // 2, 1000, sum(d * (1001 - d) for d in range(1, 1001)))
    assert len(seen) < 14


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {(x, find(x)) for x in list(root)}


def test_components(spark):
    edges = together()
    assert shown(c.connected_components(frame(spark, edges), "p", "q")) == components(edges)


def test_edges_of_components_never_grow_and_hubs_are_dealt_out(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(999, i) for i in range(500, 900)] + [(999, 17)]
    edges += [(i, i + 1) for i in range(2000, 2300)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(300)]
    rng.shuffle(edges)
    sizes = []
    plain = c.settle
    monkeypatch.setattr(c, "settle", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    assert shown(c.connected_components(frame(spark, edges), "p", "q")) == components(edges)
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < 26
    one = frame(spark, [(i, 0) for i in range(1, 2001)])
    dealt = c.salted_join(one, spark.range(0, 1).selectExpr("id AS q", "'x' AS told"), "q", 2000)
    assert dealt.count() == 2000 and dealt.where("told = 'x'").count() == 2000


def test_components_of_other_types(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "src string, dst string")
    assert shown(c.connected_components(df)) == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}


def test_small_components_are_kept_in_few_files(spark):
    own = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = c.connected_components(frame(spark, [(i, i + 1) for i in range(200) if i % 10]), "p", "q")
        kept = out.rdd.getNumPartitions()
        assert {(r.node, r.component) for r in out.collect()} == {(i, i - (i - 1) % 10) for i in range(1, 201)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert kept <= 1 + 32  # a star's one file, and its roots dealt out once
