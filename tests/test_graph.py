"""Closures, contraction, walks and neighbourhoods against brute force, with their rounds and plans."""

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def breadth_first(links, starts):
    out, near = {s: 0 for s in starts}, defaultdict(set)
    for a, b in links:
        if a is not None and b is not None:
            near[a].add(b)
    queue = deque(starts)
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in out:
                out[y] = out[x] + 1
                queue.append(y)
    return out


def reached(spark, links, starts):
    return {r.node: r.step for r in graph.reachable(frame(spark, links, "src long, dst long"), frame(spark, [(s,) for s in starts], "node long")).collect()}


@pytest.fixture
def rounds(monkeypatch):
    """How many tables were written."""
    n, plain = [0], graph.cut

    def counted(df):
        n[0] += 1
        return plain(df)

    monkeypatch.setattr(graph, "cut", counted)
    return n


@pytest.mark.parametrize("kind", ["chain", "back", "sides"])
def test_long_chains_take_few_rounds(spark, rounds, kind):
    """10,000 links in a row: forwards (one link out), with side links out (one link in), and with a side link in and out of every tenth."""
    n = 10_000
    links = [(i, i + 1) for i in range(n)]
    if kind == "back":
        links += [(i, 100_000 + i) for i in range(n)]
    elif kind == "sides":
        links += [(i, 200_000 + i) for i in range(0, n, 2500)] + [(300_000 + i, i) for i in range(0, n, 1000)]
    assert reached(spark, links, [0]) == breadth_first(links, [0])
    assert rounds[0] <= 70 and (kind == "sides" or rounds[0] <= 2 * 15 + 5)  # one or two tables a round: under twenty rounds


@pytest.mark.parametrize("seed", range(8))
def test_reachable_is_breadth_first_search(spark, seed):
    r = random.Random(seed)
    n = 40
    if seed % 4 == 0:
        links = [(i, r.randrange(n)) for i in range(n)]  # one out, with circles
    elif seed % 4 == 1:
        links = [(r.randrange(n), i) for i in range(n)]  # one in, with circles
    else:
        links = [(r.randrange(n), r.randrange(n)) for _ in range(45)]
    links += [links[0], links[1], (None, 3), (4, None)]
    starts = [0, 7] if seed % 2 else [3]
    assert reached(spark, links, starts) == breadth_first(links, starts)


def test_no_links_and_circles(spark):
    assert reached(spark, [], [5]) == {5: 0}
    assert reached(spark, [(1, 2), (2, 3), (3, 1), (9, 9)], [2]) == {2: 0, 3: 1, 1: 2}
    assert reached(spark, [(1, 2), (2, 1), (2, 3), (3, 2), (3, 3)], [1]) == {1: 0, 2: 1, 3: 2}


def brute_contracted(edges, moves):
    out = Counter()
    for a, b in edges:
        a, b = moves.get(a, a), moves.get(b, b)
        if a is not None and b is not None and a != b:
            out[a, b] += 1
    return out


def test_contraction(spark):
    """Ends follow, parallel edges fold, loops go, a hub of most edges is salted, and a second go changes nothing."""
    r = random.Random(2)
    edges = [("hub", f"n{r.randrange(50)}") for _ in range(600)] + [(f"n{r.randrange(50)}", f"n{r.randrange(50)}") for _ in range(200)] + [("n1", None), (None, None)]
    moves = {f"n{i}": f"n{i % 7}" for i in range(7, 30)} | {"hub": "n3"}
    df, into = frame(spark, [(*e, 9) for e in edges], "src string, dst string, salt int"), frame(spark, [*moves.items()], "node string, into string")
    once = graph.contracted(df, into)
    got = {(x.src, x.dst): x.n for x in once.collect()}
    assert got == brute_contracted(edges, moves)
    again = graph.contracted(once, into, {"n": F.sum("n")})
    assert {(x.src, x.dst): x.n for x in again.collect()} == got
    assert graph.contracted(df.limit(0), into).isEmpty() and graph.contracted(df, into.limit(0)).count() == len(brute_contracted(edges, {}))


def test_moves_go_to_the_best_connected(spark):
    named = frame(spark, [("a", "New York"), ("b", " new york "), ("c", "NEW YORK"), ("d", "Rome"), ("e", None), ("f", None)], "node string, name string")
    edges = frame(spark, [("b", "x"), ("b", "y"), ("c", "x"), ("x", "c")], "src string, dst string")
    moves = graph.merge_moves(named, edges)
    assert {(x.node, x.into) for x in moves.collect()} == {("a", "b"), ("c", "b")}
    stay = {x.node: (x.aliases, x.n_merged) for x in graph.merged_entities(named, moves).collect()}
    assert stay == {"b": (["NEW YORK", "New York"], 2), "d": ([], 0), "e": ([], 0), "f": ([], 0)}


def brute_rank(edges, seeds, iterations, damping=0.85):
    near, ranks = defaultdict(list), {s: 1 - damping for s in seeds}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    for _ in range(iterations):
        new = defaultdict(float, {s: 1 - damping for s in seeds})
        for a, x in ranks.items():
            for b in near[a]:
                new[b] += damping * x / len(near[a])
        ranks = new
    return ranks


@pytest.mark.parametrize("hot", [100_000, 5])
def test_walk_with_split_nodes(spark, hot):
    r = random.Random(1)
    edges = [("hub", f"n{i}") for i in range(60)] + [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(60)] + [("n1", "n2")] * 3
    got = {x.node: x["rank"] for x in graph.pagerank(frame(spark, edges, "src string, dst string"), frame(spark, [("n1",), ("alone",), ("n1",)], "node string"), 7, hot=hot).collect()}
    assert got == pytest.approx(brute_rank(edges, ["n1", "alone"], 7))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("walk_")]


def test_walks_leave_the_edges_in_their_buckets(spark):
    """No exchange stands between the edges' scan and the join; ranks and sums are exchanged alone."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        name = graph.walk_edges(frame(spark, [("a", "b"), ("b", "c")], "src string, dst string"))
        ranks = frame(spark, [("a", 1, 1, 0.15)], "node string, degree long, parts int, rank double")
        step = graph.walk_step(spark.table(name), ranks, ranks, 0.85)
        lines = step._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(i for i, x in enumerate(lines) if name in x)
        depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
        above = []
        for x in reversed(lines[:scan]):
            if depth(x) < depth(lines[scan]) and (not above or depth(x) < depth(above[-1])):
                above.append(x)
        names = " ".join(above)
        assert "Bucketed: true" in lines[scan]
        assert names.index("Join") < names.index("Exchange")  # upwards: the join comes before any exchange
        spark.sql(f"DROP TABLE {name}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def brute_neighbourhood(edges, start, most):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    first = sorted(near[start])[:most]
    out, truncated = {start: 0, **{x: 1 for x in first}}, False
    cap = max(8, most // max(1, len(first)))
    for x in first:
        for y in sorted(near[x])[:cap]:
            if y not in out:
                if len(out) >= most:
                    return out, True
                out[y] = 2
    return out, truncated


@pytest.mark.parametrize("most", [1, 5, 30, 400])
def test_adaptive_neighbourhood(spark, most):
    r = random.Random(most)
    edges = [(f"n{r.randrange(60):03}", f"n{r.randrange(60):03}") for _ in range(120)] + [("n001", f"x{i:05}") for i in range(300)] + [("n000", "n001"), ("n001", "n000")]
    for start in ("n000", "n001", "nobody"):
        got = graph.adaptive_neighbourhood(frame(spark, edges, "src string, dst string"), start, most).collect()
        want, truncated = brute_neighbourhood(edges, start, most)
        assert {x.node: x.depth for x in got} == want and {x.truncated for x in got} == {truncated}


def test_hub_of_many_edges(spark):
    """A hundred thousand edges of one node: so many stay as asked for."""
    hub = spark.range(100_000).select(F.lit("hub").alias("src"), F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("dst"))
    got = graph.adaptive_neighbourhood(hub.unionByName(frame(spark, [("hub", "a"), ("a", "b")], "src string, dst string")), "a", 50).collect()
    assert Counter(x.depth for x in got) == {0: 1, 1: 2, 2: 25} and not got[0].truncated


def test_overview_edges_have_both_ends(spark):
    edges = frame(spark, [("a1", "n1"), ("a2", "n1"), ("a2", "n1"), ("a2", "n2"), ("n1", "a2"), ("a3", "n3")], "src string, dst string")
    kinds = frame(spark, [(x, x[0]) for x in ("a1", "a2", "a3", "n1", "n2", "n3", "n4")], "node string, kind string")
    nodes, among = graph.overview(edges, kinds, 1, 10)
    assert {(x.node, x.degree, x.total, x.truncated) for x in nodes.collect()} == {("a2", 4, 7, True), ("n1", 4, 7, True)}
    assert {tuple(x) for x in among.collect()} == {("a2", "n1"), ("n1", "a2")}
    nodes, _ = graph.overview(edges, kinds, 9, 10)
    assert {x.truncated for x in nodes.collect()} == {False} and nodes.filter("degree = 0").count() == 1
