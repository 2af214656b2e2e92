"""Batch consolidation: deduplication, supersession, synonyms, clusters, promotion, pruning, retirement. Vectors are compared inside buckets, in blocks.

Model-dependent decisions are parameters: a decider is a function of Columns or of a DataFrame, with a plain default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scoring, temporal, vectors
from quillstone.sources.store import cut


BLOCK = 2048  # rows of a block; a task holds two blocks and their products


def near(rows: DataFrame, bucket: list[str], least: float, emit: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, sided: bool = False, block: int = BLOCK, asks: str | None = None, source: str | None = None) -> DataFrame:
    """All pairs of rows (id, embedding, bucket...) of a bucket with cosine least or more, given to emit as arrays (id, other id, rounded cosine), both ways round,
    a task's worth at a time; what it returns comes out. sided: rows have a side, 0 or 1, and only pairs (0, 1) count, one way round. asks: a column, and only pairs whose first row has a
    value there count, so bands without such rows aren't worked on. source: a column, and pairs that are equal in it don't count; null is equal to nothing.

    Exact, in blocks: vectors within an angle of each other lie within that angle as seen from any pivot, so a bucket is cut into bands of that angle, and a row
    meets its own band and the next. Bands of over ``block`` rows are cut by a hash, and each pair of parts is a task of its own,
    so no task holds more than two blocks, however hot a bucket is. Repeated ids count as rows of their own; null buckets are a bucket."""
    angle = max(float(np.arccos(min(1.0, max(-1.0, least)))), 1e-3)
    side = F.col("side") if sided else F.lit(0)
    asking = F.lit(True) if asks is None else F.col(asks).isNotNull()
    own = rows.select(*bucket, "id", F.col("embedding").cast("array<double>").alias("u"), vectors.dot(F.col("embedding"), F.col("embedding")).alias("square"), side.cast("int").alias("side"), asking.alias("asks"), (F.lit(None) if source is None else F.col(source)).cast("string").alias("source")).filter("square > 0")  # zero, empty and null vectors are near to nothing
    pivot = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate("u", F.lit(0.0), lambda a, x: a + x) / F.sqrt(F.col("square") * F.size("u")))))
    own = own.withColumns({"band": F.floor(pivot / (angle + 1e-9)).cast("int"), "dim": F.size("u")})  # vectors of unlike length are near to nothing
    key = [*bucket, "dim", "band"]
    met = own.withColumn("visits", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("visits"))
    sizes = met.groupBy(*(F.col(c).alias(f"{c}__") for c in key)).agg(F.ceil(F.count("*") / block).cast("int").alias("p"), F.bool_or("asks").alias("asked")).filter("asked").drop("asked")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}__")) for c in key))
    rest = ["id", "u", "side", "asks", "source"]
    parted = met.join(sizes, same).select(*key, *rest, "visits", "p", F.pmod(F.xxhash64("id"), F.col("p")).cast("int").alias("i"))
    each = parted.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    # part i of those at home meets parts j >= i of them (unit 0) and every part of the visitors (unit 1)
    home = F.col("visits") == 0
    inner = each.filter(home).select(*key, F.lit(0).alias("unit"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).cast("int").alias("right"), *rest)
    outer = each.select(*key, F.lit(1).alias("unit"), F.when(home, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(home, F.col("j")).otherwise(F.col("i")).alias("b"), F.col("visits").alias("right"), *rest)
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in (*key, "unit", "a", "b")]
    names = ["k1", "k2", "right", "alone", *rest]
    units = inner.unionByName(outer).select(F.xxhash64(*marked).alias("k1"), F.xxhash64(F.lit(1), *marked).alias("k2"), "right", F.expr("unit = 0 AND a = b").alias("alone"), *rest)
    placed = units.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k1", "k2").sortWithinPartitions("k1", "k2", "right")

    def pairs(unit: list[np.ndarray]) -> pd.DataFrame | None:
        right, alone, id_, u, side_, asks_, source_ = unit
        cut_at = len(right) if alone[0] else int(np.searchsorted(right, 1))
        if not cut_at or not (alone[0] or cut_at < len(right)) or not asks_.any():
            return None
        i = np.arange(cut_at)
        j = i if alone[0] else np.arange(cut_at, len(right))
        parts = [(i[asks_[i]], j), *([] if alone[0] else [(i[~asks_[i]], j[asks_[j]])])]  # only rows that ask are multiplied
        found = []
        for p, q in parts:
            s = np.round(u[p] @ u[q].T, 9)
            a, b = np.nonzero(np.triu(s >= least, 1) if alone[0] and len(p) == len(q) else s >= least)
            found.append((s[a, b], p[a], q[b]))
        score, x, y = (np.concatenate(c) for c in zip(*found))
        if alone[0]:
            once = (x < y) | (x > y) & ~asks_[y]
            score, x, y = score[once], x[once], y[once]
        if source is not None:
            apart = np.array([p is None or p != q for p, q in zip(source_[x], source_[y])], dtype=bool)
            x, y, score = x[apart], y[apart], score[apart]
        if sided:
            apart = side_[x] != side_[y]
            x, y, score = x[apart], y[apart], score[apart]
            turned = side_[x] > side_[y]
            return emit(np.where(turned, id_[y], id_[x]), np.where(turned, id_[x], id_[y]), score)
        first, second = asks_[x], asks_[y]
        return emit(np.r_[id_[x][first], id_[y][second]], np.r_[id_[y][first], id_[x][second]], np.r_[score[first], score[second]])

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        lists = batch.column("u")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        vectors_ = np.empty(len(lists), dtype=object)
        for n, (p, q) in enumerate(zip(ends - ends[0], ends[1:] - ends[0])):
            vectors_[n] = flat[p:q]
        return [vectors_ if c == "u" else np.array(batch.column(c).to_pylist(), dtype=object) if c == "source" else batch.column(c).to_numpy(zero_copy_only=False) for c in names]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0

        def worked(columns: list[np.ndarray], p: int, q: int) -> None:
            nonlocal size
            if q - p < 2:
                return
            unit = [c[p:q] for c in columns[2:]]
            unit[3] = np.stack(unit[3])
            unit[3] = unit[3] / np.sqrt((unit[3] * unit[3]).sum(1, keepdims=True))
            found = pairs(unit)
            if found is not None and len(found):
                out.append(found)
                size += len(found)

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)
                out.clear()
                size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = arrays(batch)
            columns = columns if held is None else [np.concatenate([x, y]) for x, y in zip(held, columns)]
            starts = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
            for p, q in zip(starts[:-1].tolist(), starts[1:].tolist()):
                worked(columns, p, q)
                if size > 50_000:
                    yield from flushed()
            held = [c[starts[-1] :] for c in columns]
        if held is not None:
            worked(held, 0, len(held[0]))
        yield from flushed()

    return placed.mapInArrow(stream, schema)


PAIR = "left_id long, right_id long, score double"


def _all(ids: np.ndarray, others: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"left_id": ids, "right_id": others, "score": score})


def _lefts(ids: np.ndarray, others: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": np.unique(ids)})


def _best(k: int):
    def pick(ids: np.ndarray, others: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((others, -score, ids))
        nth = pd.Series(ids[order]).groupby(ids[order]).cumcount().to_numpy() if len(order) else order
        return _all(ids, others, score).iloc[order[nth < k]]

    return pick


KEY = ["k1", "k2"]
WHOLE = 4  # blocks of a bucket that one task decides
LIST = 48  # of the nearest in a slice


def _keyed(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """k1, k2 (the bucket, and the vectors' length), id, u of rows (id, embedding, bucket...) that can be near to others."""
    own = rows.select(*bucket, F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("u")).filter(vectors.dot(F.col("u"), F.col("u")) > 0)
    marked = [*(F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in bucket), F.size("u")]
    return own.select(F.xxhash64(*marked).alias("k1"), F.xxhash64(F.lit(1), *marked).alias("k2"), "id", "u")


def _large(rows: DataFrame, block: int) -> DataFrame:
    """Buckets of more rows than one task decides, with their number n."""
    return cut(rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE * block))


def _dealt(rows: DataFrame, *key: str, then: tuple = ()) -> DataFrame:
    """rows with a key's in one task, in order."""
    by = [*KEY, *key]
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *then, "id")


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, a key's at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key])
        starts = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(0)]).tolist()
        for p, q in zip(starts, [*starts[1:], batch.num_rows]):
            if held and last != k[:, p].tolist():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(p, q - p))
            last = k[:, p].tolist()
    if held:
        yield pa.Table.from_batches(held)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    u = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)
    return u / np.sqrt((u * u).sum(1, keepdims=True))


def _whole(least: float, most: int | None):
    """Greedy clusters of whole buckets: id, cluster, in order of id; a fact takes its most - 1 nearest free ones, or all that are near. Rows of one id aren't near to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for table in _runs(batches, KEY):
            ids, u = table.column("id").to_numpy(), _units(table.column("u"))
            free = np.ones(len(ids), dtype=bool)
            for p in range(0, len(ids), 256):
                rows, others = np.flatnonzero(free[p : p + 256]) + p, np.flatnonzero(free[p:]) + p
                for i, s in zip(rows.tolist(), np.round(u[rows] @ u[others].T, 9)):
                    if not free[i]:
                        continue
                    hit = np.flatnonzero((s >= least) & free[others] & (ids[others] > ids[i]))
                    hit = hit if most is None else hit[np.argsort(-s[hit], kind="stable")[: most - 1]]
                    if len(hit):
                        free[others[hit]] = False
                        out.append((np.r_[ids[i], ids[others[hit]]], ids[i]))
                        size += len(hit) + 1
            if size > 50_000:
                yield _clustered(out)
                out, size = [], 0
        if out:
            yield _clustered(out)

    return run


def _clustered(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in found]), pa.int64()), pa.array(np.repeat([c for _, c in found], [len(x) for x, _ in found]), pa.int64())], names=["id", "cluster"])


def _round(big: DataFrame, least: float, most: int, block: int) -> DataFrame:
    """Of large buckets (k1, k2, id, u, n) the first facts' clusters: id, cluster, null for those that have nobody."""
    slices = F.ceil(F.col("n") / (WHOLE * block)).cast("int")
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    first = big.withColumn("nth", nth).filter(F.col("nth") <= 16 * block).filter(F.col("nth") <= F.greatest(F.lit(block), F.floor(F.col("n") / 32))).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    rest = big.withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int"))
    names = [*KEY, "slice", "rest", "id", "u"]
    units = first.withColumn("rest", F.lit(0)).select(*names).unionByName(rest.withColumn("rest", F.lit(1)).select(*names))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, [*KEY, "slice"]):
            at = int(np.searchsorted(table.column("rest").to_numpy(), 1))
            ids, u = table.column("id").to_numpy(), _units(table.column("u"))
            for p in range(0, at, 256):
                own, found = ids[p : min(p + 256, at)], []
                for i, s in zip(own, np.round(u[p : p + len(own)] @ u[at:].T, 9)):
                    hit = np.flatnonzero((s >= least) & (ids[at:] > i))
                    if len(hit) > LIST:
                        hit = hit[s[hit] >= np.partition(s[hit], len(hit) - LIST)[len(hit) - LIST]]
                    hit = hit[np.lexsort((ids[at:][hit], -s[hit]))]
                    found.append((ids[at:][hit[:LIST]], s[hit[:LIST]]))
                k = [pa.array(np.full(len(own), table.column(c)[0].as_py()), pa.int64()) for c in KEY]
                yield pa.RecordBatch.from_arrays([*k, pa.array(own, pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))], names=[*KEY, "id", "others", "scores"])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, gone, stopped, out = None, set(), False, []
        for table in _runs(batches, [*KEY, "id"]):
            now, i = tuple(table.column(c)[0].as_py() for c in KEY), table.column("id")[0].as_py()
            if now != bucket:
                bucket, gone, stopped = now, set(), False
            if stopped or i in gone:
                continue
            lists = [list(zip((-x for x in s), ids)) for ids, s in zip(table.column("others").to_pylist(), table.column("scores").to_pylist())]
            reach = min((x[-1] for x in lists if len(x) == LIST), default=None)  # beyond, a slice may have others
            sure = sorted(x for part in lists for x in part if reach is None or x <= reach)
            took = [j for _, j in sure if j not in gone][: most - 1]
            if reach is not None and len(took) < most - 1:
                stopped = True
                continue
            gone.update(took)
            out.extend([(i, i), *((j, i) for j in took)] if took else [(i, None)])
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "cluster"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "cluster"])

    lists = _dealt(units, "slice", then=("rest",)).mapInArrow(listed, "k1 long, k2 long, id long, others array<long>, scores array<double>")
    return _dealt(lists).mapInArrow(decided, "id long, cluster long")


def nearest(rows: DataFrame, bucket: list[str], least: float, k: int, sided: bool = False, block: int = BLOCK, asks: str | None = None, source: str | None = None) -> DataFrame:
    """left_id, right_id, score: the k best others of each row (of those that ask, if asks names a column; none of the same source, if source does); each task gives its k best, and the best of those stay."""
    found = near(rows, bucket, least, _best(k), PAIR, sided, block, asks, source)
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id"))).filter(F.col("nth") <= k).drop("nth")


def duplicates(facts: DataFrame, bucket: list[str], least: float = 0.92, block: int = BLOCK) -> DataFrame:
    """Facts (id, embedding) with an earlier one (lesser id) as near: id, first. Each is held against all earlier facts, kept or not."""

    def first(ids: np.ndarray, others: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        earlier = others < ids
        return pd.DataFrame({"id": ids[earlier], "first": others[earlier]}).groupby("id", as_index=False)["first"].min()

    return near(facts, bucket, least, first, "id long, first long", block=block).groupBy("id").agg(F.min("first").alias("first"))


def fresh(new: DataFrame, live: DataFrame, bucket: list[str], least: float = 0.92, block: int = BLOCK) -> DataFrame:
    """New facts (id, embedding) that neither a live one nor an earlier new one (lesser id) of the bucket, itself kept, is near to: the ordered pass of a cycle, where
    earlier inserts count. What is left of a bucket of up to WHOLE blocks after the live ones is decided by one task; larger ones in rounds over their links: a new fact
    whose nearer and earlier facts have all been dropped stays, one with a kept fact near goes."""
    both = new.withColumns({"side": F.lit(0), "asks": F.lit(1)}).unionByName(live.select(*new.columns).withColumns({"side": F.lit(1), "asks": F.lit(None).cast("int")}))
    held = near(both, bucket, least, _lefts, "id long", sided=True, block=block, asks="asks")
    left = cut(new.select("id", "embedding", *bucket).join(held.distinct(), "id", "left_anti"))
    rows = _keyed(left, bucket)
    large = _large(rows, block)
    gone = _dealt(rows.join(large, KEY, "left_anti")).mapInArrow(_whole(least, None), "id long, cluster long").filter("id <> cluster").select("id")
    kept = left.select("id").join(cut(gone), "id", "left_anti")
    if large.isEmpty():
        return kept
    big = cut(rows.join(large, KEY, "left_semi").select(*KEY, "id", F.col("u").alias("embedding")))
    links = cut(near(big, KEY, least, _all, PAIR, block=block).filter("right_id < left_id").select(F.col("left_id").alias("id"), F.col("right_id").alias("earlier")))
    kept = kept.join(links.select("id").distinct(), "id", "left_anti")
    front, after = cut(big.select("id").join(links.select("id").distinct(), "id", "left_anti")), []
    while not links.isEmpty():
        gone = links.join(front.select(F.col("id").alias("earlier")), "earlier", "left_semi").select("id").distinct()
        rest = links.join(gone, "id", "left_anti")
        then = cut(rest.join(gone.select(F.col("id").alias("earlier")), "earlier", "left_anti"))
        front = cut(rest.select("id").distinct().join(then.select("id").distinct(), "id", "left_anti"))
        after.append(front)
        links = then
    return reduce(DataFrame.unionByName, after, kept)


def synonyms(entities: DataFrame, bucket: list[str], least: float = 0.9, block: int = BLOCK, asks: str | None = None, k: int | None = None) -> DataFrame:
    """Canonical pairs (lo, hi, score), once each. asks: a column; touched entities have a value there and are held against all, the others not against each other. k: of each that asks, its best alone."""
    found = near(entities, bucket, least, _all, PAIR, block=block, asks=asks) if k is None else nearest(entities, bucket, least, k, block=block, asks=asks)
    return found.groupBy(F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi")).agg(F.max("score").alias("score"))


def supersede_candidates(facts: DataFrame, bucket: list[str], least: float = 0.85, k: int = 8, decide: Callable[[DataFrame], DataFrame] | None = None, source: str | None = None, asks: str | None = None) -> DataFrame:
    """For each fact (of those that ask, if asks names a column) the k nearest others on the index scale, without its siblings (equal in the column that source names); decide picks among them (default:
    the older fact of the best pair)."""
    found = nearest(facts, bucket, 2 * least - 1, k, asks=asks, source=source).withColumn("score", vectors.index_score(F.col("score")))
    if decide is not None:
        return decide(found)
    older = found.filter("right_id < left_id")
    return older.groupBy(F.col("left_id").alias("new_id")).agg(F.max_by("right_id", F.struct(F.round("score", 9), -F.col("right_id"))).alias("old_id"))


def clusters(facts: DataFrame, bucket: list[str], least: float = 0.8, most: int = 6, block: int = BLOCK) -> DataFrame:
    """Greedy clusters of 2..most facts in each bucket, by id: the first free fact takes its nearest free ones. (id, embedding, bucket...) to (id, cluster), the cluster
    being its first fact. Null scopes are a bucket of their own. ids are unique.

    A bucket of up to WHOLE blocks is decided by one task. A larger one goes in rounds, until what is free of it is as small: its first free facts, a block or more, are held against all free ones in
    slices, tasks of their own, of which each gives the nearest LIST. A fact can only take later ones, as an earlier one that is free yet has nobody free near. So one task walks the lists
    in order, up to a fact for which they may not reach; that one begins the next round. Links aren't stored, and no task holds more than a slice or the lists of one fact."""
    left, out = cut(_keyed(facts, bucket)), []
    while True:
        large = _large(left, block)
        out.append(cut(_dealt(left.join(large, KEY, "left_anti")).mapInArrow(_whole(least, most), "id long, cluster long")))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out)
        big = left.join(large, KEY)
        done = cut(_round(big, least, most, block))
        out.append(done.filter("cluster IS NOT NULL"))
        left = cut(big.join(done.select("id"), "id", "left_anti").select(*left.columns))


def prunable(facts: DataFrame, now: Column) -> DataFrame:
    d = temporal.days_since(F.col("recorded_at"), now)
    return facts.filter(F.col("valid_to").isNull() & temporal.visible() & scoring.should_prune(d, F.col("reference_count"), F.col("importance")))


def promotable(facts: DataFrame, least: float = 0.85) -> DataFrame:
    return facts.filter((F.col("importance") >= least) & F.col("valid_to").isNull() & temporal.visible())


def retired(insights: DataFrame, sources: DataFrame, live: DataFrame) -> DataFrame:
    """Insights (insight_id) whose sources (insight_id, fact_id) are all dead; those without sources stay."""
    some = insights.join(sources, "insight_id", "left_semi")
    return some.join(sources.join(live.select("fact_id"), "fact_id", "left_semi"), "insight_id", "left_anti")


def packed(chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks of an episode in order, packed greedily: (episode_id, position, tokens) to a group number each. A fold by episode in one streamed pass of sorted rows."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        episode, group, used = None, 0, 0
        for df in frames:
            out = []
            for e, n in zip(df["episode_id"], df["tokens"]):
                if e != episode:
                    episode, group, used = e, 0, 0
                elif used + n > budget:
                    group, used = group + 1, 0
                used += n
                out.append(group)
            yield df[["episode_id", "position"]].assign(group=out)

    rows = chunks.select("episode_id", "position", "tokens").repartition("episode_id").sortWithinPartitions("episode_id", "position")
    return rows.mapInPandas(fold, "episode_id long, position long, group int")
