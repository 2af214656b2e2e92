"""Graph operators on edge tables (src, dst).

Edges with a null end lead nowhere and count for no degree. Repeated edges are parallel ones: ranks and degrees count each, all else takes them as one. Ties go to the lesser node.
Empty tables give empty results (a start is always reached by itself); columns beside those named stay out, but where rows are said to keep theirs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text
from quillstone.sources.store import cut, shared_path


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """Nodes within depth steps of start (node): node, depth. cap: the most new neighbours (by name) of each frontier node in each step."""
    around, seen = both_ways(edges), start.select("node", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.select(F.col("node").alias("src")).join(around, "src").distinct()
        if cap is not None:
            step = step.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("nth") <= cap)
        front = step.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def adaptive_neighbourhood(edges: DataFrame, start: str, most: int, depth: int = 2) -> DataFrame:
    """node, depth, truncated: a node, its first ``most`` neighbours by name, and with depth 2 the neighbours of those: of each at most max(8, most // neighbours), taken in order of
    the neighbours' names until there are ``most`` nodes. truncated: whether some were left out for that. A start without edges gives itself. The neighbours' number is counted in the plan."""
    around = both_ways(edges).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    root = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    first = around.filter(F.col("src") == start).select(F.col("dst").alias("node"), F.lit(1).alias("depth")).orderBy("node").limit(most)
    if depth == 1:
        return root.unionByName(first).withColumn("truncated", F.lit(False))
    front = first.withColumn("nth", F.row_number().over(Window.orderBy("node"))).select(F.col("node").alias("src"), "nth", F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))  # most rows at most
    hop = around.join(F.broadcast(front), "src").withColumn("own", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    near = hop.filter(F.col("own") <= F.greatest(F.lit(8), F.floor(F.lit(most) / F.col("n")))).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("nth", "own")).alias("place"))
    known = root.unionByName(first)
    new = near.join(F.broadcast(known.select("node")), "node", "left_anti").orderBy("place", "node").limit(most + 1)  # one more tells whether any is left out
    room = known.agg(F.greatest(F.lit(0), F.lit(most) - F.count("*")).alias("room"))
    placed = new.withColumn("nth", F.row_number().over(Window.orderBy("place", "node"))).crossJoin(F.broadcast(room))  # one row
    cutoff = placed.agg(F.coalesce(F.max(F.col("nth") > F.col("room")), F.lit(False)).alias("truncated"))
    return known.unionByName(placed.filter("nth <= room").select("node", F.lit(2).alias("depth"))).crossJoin(F.broadcast(cutoff))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def walk_edges(edges: DataFrame, hot: int = 100_000, buckets: int | None = None) -> str:
    """Lays out edges, both ways, for walks: a table in the shared folder in buckets by (src, part), rows (src, part, dst, degree and parts of dst). A node of over ``hot`` edges is split in
    parts, so that no bucket holds all of it. The table's name; drop it after the walk."""
    spark, around = edges.sparkSession, both_ways(edges).filter("src IS NOT NULL AND dst IS NOT NULL")
    degree = around.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).withColumn("parts", F.ceil(F.col("degree") / hot).cast("int"))
    degree = cut(degree)
    src, dst = (degree.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("degree", "parts"))) for side in ("src", "dst"))
    rows = around.join(src, "src").join(dst, "dst").select("src", F.pmod(F.xxhash64("dst"), F.col("src_parts")).cast("int").alias("part"), "dst", "dst_degree", "dst_parts")
    name, n = f"walk_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "src", "part").write.bucketBy(n, "src", "part").option("path", shared_path(spark)).saveAsTable(name)
    return name


def walk_step(flow: DataFrame, ranks: DataFrame, restarts: DataFrame, damping: float) -> DataFrame:
    """One step: every node deals its rank to its edges' ends. The edges stay where their buckets are; ranks are exchanged alone."""
    dealt = ranks.select(F.col("node").alias("src"), (damping * F.col("rank") / F.col("degree")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = flow.join(dealt, ["src", "part"]).select(F.col("dst").alias("node"), F.col("dst_degree").alias("degree"), F.col("dst_parts").alias("parts"), F.col("share").alias("rank"))
    return sent.unionByName(restarts).groupBy("node").agg(F.first("degree").alias("degree"), F.first("parts").alias("parts"), F.sum("rank").alias("rank"))


def pagerank(edges: DataFrame, seeds: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 5, hot: int = 100_000) -> DataFrame:
    """Personalised PageRank, undirected, parallel edges counted, restarting at seeds (node): node, rank. Rank tables are as large as
    the nodes; each step is one join and one sum by node, and every few steps are written to the shared folder. Seeds without edges keep their restart."""
    spark, name = edges.sparkSession, walk_edges(edges, hot)
    flow = spark.table(name)
    known = flow.groupBy(F.col("dst").alias("node")).agg(F.first("dst_degree").alias("degree"), F.first("dst_parts").alias("parts"))
    base = seeds.select("node").distinct().join(known, "node", "left").select("node", F.coalesce("degree", F.lit(1).cast("long")).alias("degree"), F.coalesce("parts", F.lit(1)).alias("parts"), F.lit(1.0 - damping).alias("rank"))
    base = ranks = cut(base)
    for i in range(1, iterations + 1):
        ranks = walk_step(flow, ranks, base, damping)
        ranks = cut(ranks) if i % cut_every == 0 or i == iterations else ranks
    spark.sql(f"DROP TABLE {name}")
    return ranks.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component): labels spread to neighbours and jump to their own label until none changes."""
    around = cut(both_ways(edges).distinct())
    labels = cut(around.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = around.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("root").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("src")).select("node", F.least("root", "near").alias("root"))
        up = spread.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = cut(spread.join(up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        changed = after.alias("a").join(labels.alias("b"), "node").filter("a.root <> b.root").limit(1).count()
        labels = after
        if not changed:
            return labels


def _known(rows: DataFrame) -> int:
    """How many rows a jump table has settled; one job over what was just written."""
    return rows.filter("done").count()


def jumped(pointers: DataFrame, ends: DataFrame) -> DataFrame:
    """List ranking by pointer jumping: pointers (node, to; one a node) are followed to the first of ends (node): node, jump, dist of those that come to one. Each round doubles the
    reach, so n nodes in a row take about log2 n rounds. Rows that turn in a circle or come to nothing are left out: a round that settles none is the last, as what is further away than all
    that is settled passes by something nearer."""
    stop = ends.select(F.col("node").alias("jump"), F.lit(True).alias("hit"))
    rows = cut(pointers.select("node", F.col("to").alias("jump"), F.lit(1).cast("long").alias("dist")).join(stop, "jump", "left").select("node", "jump", "dist", F.col("hit").isNotNull().alias("done")))
    settled, before = _known(rows), 0
    while settled > before:
        further = rows.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("dist").alias("more"), F.col("done").alias("ends"))
        moved = rows.filter("NOT done").join(further, "jump").select("node", F.col("next").alias("jump"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ends").alias("done"))
        rows = cut(rows.filter("done").unionByName(moved))
        before, settled = settled, _known(rows)
    return rows.filter("done").select("node", "jump", "dist")


def followed(pointers: DataFrame, start: DataFrame) -> DataFrame:
    """node, step: what pointers (node, to; one a node) lead to from start (node, step), with the least step. What is reached and how far a pointer leads double in each round."""
    seen, ways = cut(start.groupBy("node").agg(F.min("step").alias("step"))), cut(pointers.select("node", "to"))
    length = 1
    while True:
        found = seen.join(ways, "node").select(F.col("to").alias("node"), (F.col("step") + length).alias("step"))
        both = cut(seen.withColumn("old", F.lit(1)).unionByName(found.withColumn("old", F.lit(0))).groupBy("node").agg(F.min("step").alias("step"), F.min(F.when(F.col("old") == 1, F.col("step"))).alias("was")))
        if both.filter("was IS NULL OR step < was").isEmpty():
            return seen
        seen, length = both.select("node", "step"), 2 * length
        ways = cut(ways.join(ways.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """node, step: everything that the links (src, dst) lead to from start (node), however far; step is the least number of links. Rounds don't go by the number of links in a row:

    where no node has two links out, reach doubles in each round; where none has two links in, list ranking finds the nodes whose way back comes to start; else nodes with one link out
    are jumped over, and a search goes over the others alone, so it takes as many rounds as nodes with several links lie in a row, and about log2 of the longest row of others. Cycles end."""
    links = cut(links.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    starts = cut(start.select("node").filter("node IS NOT NULL").distinct().withColumn("step", F.lit(0).cast("long")))
    out = cut(links.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")))
    if out.filter("n > 1").isEmpty():
        return followed(out.select(F.col("src").alias("node"), "to"), starts)
    if links.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        back = links.select(F.col("dst").alias("node"), F.col("src").alias("to")).join(starts.select("node"), "node", "left_anti")
        return starts.unionByName(jumped(back, starts).select("node", F.col("dist").alias("step")))
    passed = out.filter("n = 1").select(F.col("src").alias("node"), "to")
    ends = links.select(F.col("dst").alias("node")).distinct().join(passed.select("node"), "node", "left_anti")
    over = cut(jumped(passed, ends))
    seen, front, entered = starts, starts, []
    while not front.isEmpty():
        near = cut(front.join(links.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg((F.min("step") + 1).alias("step")))
        entered.append(near)
        there = near.join(passed.select("node"), "node", "left_anti").unionByName(near.join(over, "node").select(F.col("jump").alias("node"), (F.col("step") + F.col("dist")).alias("step")))
        front = cut(there.groupBy("node").agg(F.min("step").alias("step")).join(seen.select("node", F.col("step").alias("was")), "node", "left").filter("was IS NULL OR step < was").select("node", "step"))
        seen = cut(seen.unionByName(front).groupBy("node").agg(F.min("step").alias("step")))
    return followed(passed, reduce(DataFrame.unionByName, entered, seen))


def chain(facts: DataFrame, links: DataFrame, start: DataFrame) -> DataFrame:
    """facts (fact_id) that start (node) has superseded, directly or over others (step < 0), itself (0), and those that have superseded it (step > 0).
    links: newer fact (src) to older one (dst)."""
    older = reachable(links, start).filter("step > 0").select("node", (-F.col("step")).alias("step"))
    newer = reachable(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
    found = newer.unionByName(older).groupBy("node").agg(F.max("step").alias("step"))
    return found.join(facts, F.col("node") == F.col("fact_id")).drop("node")


def survivors(edges: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each node of edges with the last row, by order, of its component: node, survivor."""
    found = cut(components(edges))
    last = found.join(rows.select(F.col(key).alias("node"), F.struct(*order).alias("o")), "node").groupBy("root").agg(F.max_by("node", "o").alias("survivor"))
    return found.join(last, "root").select("node", "survivor")


def overview(edges: DataFrame, kinds: DataFrame, per_kind: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): of each kind (kinds: node, kind) the nodes with most edges, an equal share: node, kind, degree, total (nodes of all kinds), truncated; and the edges with both ends
    among them, parallel ones once, the first so many: src, dst. Nodes without edges have degree 0."""
    degree = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    known = kinds.join(degree, "node", "left").select("node", "kind", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    best = known.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("degree").desc(), "node"))).filter(F.col("nth") <= per_kind).drop("nth")
    nodes = best.crossJoin(F.broadcast(kinds.agg(F.count("*").alias("total"))))  # one row
    nodes = nodes.withColumn("truncated", F.col("total") > F.count("*").over(Window.partitionBy(F.lit(1))))  # over the chosen ones
    among = induced(edges.select("src", "dst").distinct(), best.select("node"))
    return nodes, among.select("src", "dst").orderBy("src", "dst").limit(most_edges)


def _through(rows: DataFrame, column: str, other: str, moves: DataFrame, salts: int) -> DataFrame:
    """rows with column replaced by where moves (node, into) lead it. Nodes that hold a large share of all rows are salted: their rows are dealt by the other column to as many places as there are salts."""
    spark = rows.sparkSession
    share = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    total = rows.agg(F.count("*").alias("rows"))
    hot = rows.groupBy(F.col(column).alias("node")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).filter(F.col("n") * share > F.col("rows")).select("node", F.lit(salts).alias("salts"))  # fewer than share
    dealt = rows.join(F.broadcast(hot), rows[column] == hot.node, "left").drop("node").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(other), F.col("salts"))).otherwise(0).cast("int")).drop("salts")
    spread = moves.join(F.broadcast(hot), "node", "left").select(F.col("node").alias(column), "into", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return dealt.join(spread, [column, "salt"], "left").withColumn(column, F.coalesce("into", column)).drop("into", "salt")


def contracted(edges: DataFrame, moves: DataFrame, fold: dict[str, Column] | None = None, salts: int = 16) -> DataFrame:
    """The graph after nodes were merged: src, dst and what fold makes of parallel edges' columns (name to aggregate; else n, their number). moves (node, into; one a node, into a node that doesn't
    move) rewrite both ends; loops are dropped. Nodes that moves don't name stay. Contracting again changes nothing, as no end names a merged node any more (a fold of sums or maxima goes on from what it made)."""
    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    rows = _through(_through(rows, "src", "dst", moves, salts), "dst", "src", moves, salts).filter("src <> dst")
    return rows.groupBy("src", "dst").agg(*(c.alias(n) for n, c in (fold or {"n": F.count("*")}).items()))


def merge_moves(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """node, into: entities (node, name) alike but for case and outer blanks move into the one of them with most edges, the lesser node on ties. Null names are alike to none."""
    degree = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    named = entities.filter("name IS NOT NULL").select("node", text.normal_name(F.col("name")).alias("norm")).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    best = named.groupBy("norm").agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("into"))
    return named.join(best, "norm").filter("node <> into").select("node", "into")


def merged_entities(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """The entities that stay, with their columns, the names of those that moved into them (aliases, in order) and their number."""
    gone = moves.join(entities.select("node", "name"), "node").groupBy(F.col("into").alias("node")).agg(F.array_sort(F.collect_set("name")).alias("aliases"), F.count("*").alias("n_merged"))
    stay = entities.join(moves.select("node"), "node", "left_anti").join(gone, "node", "left")
    return stay.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "n_merged": F.coalesce("n_merged", F.lit(0).cast("long"))})


def walk_facts(mentions: DataFrame, more: list[DataFrame], facts: DataFrame, found: DataFrame, seeds: DataFrame, budget: int, **options: int) -> DataFrame:
    """fact_id, score: the open, visible facts of the highest personalised rank from seeds (node), over mentions (fact_id, entity) and more edges (src, dst), that aren't
    found (fact_id) yet."""
    edges = mentions.select(F.col("entity").alias("src"), F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("dst"))
    for other in more:
        edges = edges.unionByName(other.select("src", "dst"))
    ranks = pagerank(cut(edges), seeds, **options).filter("rank > 0")
    reached = facts.filter("valid_to IS NULL AND deleted_at IS NULL").select("fact_id", F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("node")).join(ranks, "node")
    return reached.join(found.select("fact_id"), "fact_id", "left_anti").select("fact_id", F.col("rank").alias("score")).orderBy(F.round("score", 12).desc(), "fact_id").limit(budget)
