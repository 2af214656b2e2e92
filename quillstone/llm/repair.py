"""Conversation structure repair by weighted CYK interval parsing (operator 11).

A repaired conversation's role initials are ``(s?(ua)+)?``. The repair grammar in Chomsky normal form has a nonterminal (p, q) for each pair of the four states of that language
(nothing yet, after s, after u, after a closed pair) that a span may lead from and to, and a rule (p, q) -> (p, r) (r, q) for each state between. A cell holds the least
(cost, audit) of a nonterminal over a span. Cells of one row are its edits (keep, rerole, delete), closed under insertions before and after; cells of longer spans are combined bottom-up by
span length, over all places to split. Audits of one cell and cost are never one the beginning of another, as that one would have more insertions, so the least of a whole is made of the least of its parts.

Charts have at most ``CHART`` spans as leaves; longer conversations are charts of charts. Rows are dealt by range of (conversation, turn), so a conversation that holds a third of all rows
is cut over many tasks: each gives one segment (cells and counts) for what it holds of a conversation, and segments meet by conversation. Rows that are equal in all columns are counted before
they are dealt. Texts don't come along: they pass once, by conversation in order of turn, are edited by the audit as a stream, and hashed; nothing but the audit is held.
SHA-256 goes from the first to the last byte, so that stream is one task for each conversation, however long.

Edge cases: nulls in role and text, and in the key of the damage, count as one space; null turns come first and are no part of gaps; a null conv_id is a conversation of its own; rows of one turn are
in order of role, then of a hash of role and text, equal rows side by side; roles with other initials must be reroled or deleted; texts of any length are taken whole; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import BLANKS, parallelism, shared_table

START, SYSTEM, ASKED, CLOSED = range(4)
#: What an output row of an initial does to the state of (s?(ua)+)?.
STEPS = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): CLOSED, (CLOSED, "u"): ASKED}
ACCEPTED = (START, CLOSED)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHART = 16
NONTERMINALS = [(p, q) for p in range(4) for q in range(4) if p == q or q and (q > p or (p, q) == (CLOSED, ASKED))]
RULES = [(NONTERMINALS.index((p, q)), NONTERMINALS.index((p, r)), NONTERMINALS.index((r, q))) for p, q in NONTERMINALS for r in range(4) if (p, r) in NONTERMINALS and (r, q) in NONTERMINALS]
Cell = tuple[int, str] | None  # cost, audit; None: not to be had
Cells = tuple[Cell, ...]  # by nonterminal


def least(cells: list[Cell], at: int, cost: int, audit: str) -> None:
    if cells[at] is None or (cost, audit) < cells[at]:
        cells[at] = (cost, audit)


def combined(left: Cells, right: Cells, into: list[Cell]) -> None:
    """The rules over two spans side by side."""
    for whole, a, b in RULES:
        if (x := left[a]) is not None and (y := right[b]) is not None:
            cost, now = x[0] + y[0], into[whole]
            if now is None or cost < now[0] or cost == now[0] and x[1] + y[1] < now[1]:
                into[whole] = (cost, x[1] + y[1])


def concatenated(*spans: Cells) -> Cells:
    out = spans[0]
    for span in spans[1:]:
        into: list[Cell] = [None] * len(NONTERMINALS)
        combined(out, span, into)
        out = tuple(into)
    return out


def insertions() -> Cells:
    """Of an empty span: nothing, or the fewest rows that lead from state to state."""
    cells: list[Cell] = [(0, "") if p == q else None for p, q in NONTERMINALS]
    for (p, c), q in STEPS.items():
        if c in ROLES:
            least(cells, NONTERMINALS.index((p, q)), INSERT, "I")
    while True:
        before = tuple(cells)
        combined(before, before, cells)
        if tuple(cells) == before:
            return before


CLOSURE = insertions()


@lru_cache(maxsize=1024)
def leaf(initial: str, fault: str) -> Cells:
    """Cells of one row, closed under insertions. fault: b(lank), d(uplicate), t(runcated) or nothing."""
    cells: list[Cell] = [None] * len(NONTERMINALS)
    for at, (p, q) in enumerate(NONTERMINALS):
        if p == q:
            least(cells, at, DELETE, "D")
        if fault not in ("b", "d"):
            extra = TRUNCATED if fault == "t" else 0
            for c in STEPS.keys() & {(p, "s"), (p, "u"), (p, "a")}:
                if STEPS[c] == q and c[1] == initial:
                    least(cells, at, KEEP + extra, "K")
                elif STEPS[c] == q and c[1] in ROLES:
                    least(cells, at, REROLE + extra, "R")
    return concatenated(CLOSURE, tuple(cells), CLOSURE)


def chart(leaves: list[Cells]) -> Cells:
    """CYK over at most CHART leaves, bottom-up by length of span."""
    spans = {(i, i + 1): cells for i, cells in enumerate(leaves)}
    for length in range(2, len(leaves) + 1):
        for i in range(len(leaves) - length + 1):
            into: list[Cell] = [None] * len(NONTERMINALS)
            for k in range(i + 1, i + length):
                combined(spans[i, k], spans[k, i + length], into)
            spans[i, i + length] = tuple(into)
    return spans[0, len(leaves)]


@lru_cache(maxsize=50_000)
def parsed(rows: tuple[tuple[str, str], ...]) -> Cells:
    """Cells of up to CHART rows (initial, fault); conversations that are alike in these are parsed once."""
    return chart([leaf(*r) for r in rows])


def joined(spans: list[Cells]) -> Cells:
    """Cells of neighbouring spans, in charts of charts."""
    while len(spans) > 1:
        spans = [chart(spans[i : i + CHART]) for i in range(0, len(spans), CHART)]
    return spans[0] if spans else CLOSURE


def cells_of(rows: list[tuple[str, str]]) -> Cells:
    return joined([parsed(tuple(rows[i : i + CHART])) for i in range(0, len(rows), CHART)])


def cheapest(cells: Cells) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(c for q in ACCEPTED if (c := cells[NONTERMINALS.index((START, q))]) is not None)


class Editor:
    """Edits a conversation's rows, which come one by one, as its audit says; what comes out is hashed."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.rows = audit, 0, START, hashlib.sha256(), 0

    def put(self, role: str, text: str) -> tuple[str, str]:
        self.sha.update(f"{'\n' if self.rows else ''}{role}:{text}".encode())
        self.state, self.rows = STEPS[self.state, role[:1]], self.rows + 1
        return role, text

    def wanted(self) -> str:
        return ROLES["a" if self.state == ASKED else "u"]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.put(self.wanted(), "")

    def edited(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What the row becomes, with the insertions before it and after it."""
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self.put(self.wanted() if edit == "R" else role, text)
        yield from self.inserted()


KEYS = ["turn", "role", "h1", "h2"]
SEGMENT = "first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, costs array<long>, audits array<string>"
SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PARSE = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage by crc32(conv_id:turn) % 20."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.encode(F.concat(known("conv_id"), F.lit(":"), known("turn")), "UTF-8")), F.lit(20))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), way.alias("way")).filter("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("way") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def keyed(rows: DataFrame) -> DataFrame:
    """rows with a 128-bit hash of role and text."""
    return rows.withColumns({"h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "role", "text")})


def marked(rows: DataFrame) -> DataFrame:
    """Rows without texts: conv_id, KEYS, n (equal ones), own (fault but for duplicates), later (one of its role and text comes in an earlier turn)."""
    bare = F.rtrim("text", F.lit(BLANKS))
    own = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    light = shared_table(keyed(rows.withColumn("own", own)).groupBy("conv_id", *KEYS).agg(F.count("*").alias("n"), F.first("own").alias("own")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = light.groupBy("conv_id", "role", "h1", "h2").agg(F.min(turn).alias("first"), F.count("*").alias("turns")).filter("turns > 1").select(F.col("conv_id").alias("conv"), F.col("role").alias("r"), F.col("h1").alias("a"), F.col("h2").alias("b"), "first")
    same = light.conv_id.eqNullSafe(first.conv) & (light.role == first.r) & (light.h1 == first.a) & (light.h2 == first.b)
    return light.join(first, same, "left").select("conv_id", *KEYS, "n", "own", F.coalesce(turn > F.col("first"), F.lit(False)).alias("later"))


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked rows in order to one row for what the task holds of a conversation: conv_id, SEGMENT."""
    conv, held = None, None

    def table(out: list[list], ids: pa.Array) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=["conv_id", *SEGMENT_NAMES])

    for batch in batches:
        done, ids, columns = [], [], [batch.column(c).to_pylist() for c in ("turn", "role", "n", "own", "later")]
        convs = batch.column("conv_id")
        for conv_id, rows in groupby(zip(convs.to_pylist(), *columns), key=lambda r: r[0]):
            if held is None or conv_id != conv:
                if held is not None:
                    done.append(held.row())
                    ids.append(conv)
                conv, held = conv_id, Segment()
            for _, turn, role, n, own, later in rows:
                held.add(turn, role[:1], n, own, later)
        if done:
            yield table(done, pa.array(ids, convs.type))
        kind = convs.type
    if held is not None:
        yield table([held.row()], pa.array([conv], kind))


class Segment:
    """What is known of neighbouring rows of a conversation."""

    def __init__(self):
        self.turns, self.first, self.last, self.counts, self.illegal, self.initials, self.rows, self.spans = 0, None, None, {"b": 0, "d": 0, "t": 0}, 0, [], [], []

    def add(self, turn: int | None, initial: str, n: int, own: str, later: bool) -> None:
        """n equal rows; later: all of them are duplicates, else all but the first."""
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        for i in range(n):
            fault = own if own == "b" else "d" if later or i else own
            if fault:
                self.counts[fault] += 1
            if self.initials:
                self.illegal += self.initials[-1] + initial not in ("su", "ua", "au")
            self.initials = [self.initials[0] if self.initials else initial, initial]
            self.rows.append((initial, fault))
            if len(self.rows) == CHART:
                self.spans.append(parsed(tuple(self.rows)))
                self.rows = []
            if len(self.spans) == CHART * CHART:
                self.spans = [joined(self.spans)]

    def row(self) -> list:
        cells = joined([*self.spans, *([parsed(tuple(self.rows))] if self.rows else [])])
        return [self.first, self.last, self.turns, *self.counts.values(), self.illegal, *self.initials, [c and c[0] for c in cells], [c and c[1] for c in cells]]


def parse(parts: list[dict]) -> tuple:
    """PARSE of a conversation's segments in order."""
    if not parts:
        return (*[0] * len(COUNTS), "")
    cells = joined([tuple(None if a is None else (c, a) for c, a in zip(s["costs"], s["audits"])) for s in parts])
    illegal = sum(s["illegal"] for s in parts) + sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
    known = [s for s in parts if s["first_turn"] is not None]
    distinct = sum(s["n_turns"] for s in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct if known else 0
    return (gaps, *(sum(s[c] for s in parts) for c in ("blank", "duplicate", "truncated")), illegal, *cheapest(cells))


@F.arrow_udf(PARSE)
def parses(parts: pa.Array) -> pa.Array:
    rows = [parse([p["segment"] for p in own or []]) for own in parts.to_pylist()]
    types = [pa.int64()] * len(COUNTS) + [pa.string()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], PARSE.names)


def plans(turns: DataFrame) -> DataFrame:
    """conv_id, COUNTS, audit of every conversation in turns; turns are damaged first. A conversation's segments are as many as tasks hold rows of it."""
    rows = shared_table(marked(damaged(turns)))  # ranges are sampled from this
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    ranged = rows.repartitionByRange(parallelism(turns.sparkSession), *order).sortWithinPartitions(*order)
    held = ranged.mapInArrow(segments, f"conv_id {kind}, {SEGMENT}")
    place = F.struct(F.spark_partition_id().alias("at"), F.struct(*SEGMENT_NAMES).alias("segment"))  # ranges are in order of their numbers
    by_conv = held.select("conv_id", place.alias("part")).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    ids = turns.select(F.col("conv_id").alias("own")).distinct()
    every = ids.join(by_conv, ids.own.eqNullSafe(by_conv.conv_id), "left").select(F.col("own").alias("conv_id"), parses("parts").alias("p"))
    return every.select("conv_id", "p.*")


def _edited(turns: DataFrame, stream, schema: str) -> DataFrame:
    """Deals plans and rows by conversation, the plan before its rows in order of turn, to stream."""
    found = plans(turns).select("conv_id", F.lit(0).alias("kind"), F.struct(*COUNTS, "audit").alias("plan"))
    rows = keyed(damaged(turns)).select("conv_id", F.lit(1).alias("kind"), *KEYS, "text")
    both = found.unionByName(rows, allowMissingColumns=True)
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    return both.repartition(parallelism(turns.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "plan", "role", "text").mapInArrow(stream, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text of the repaired conversations, after the damage."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = conv = None
        for batch in batches:
            ids, out = [], []
            convs = batch.column("conv_id")
            for conv_id, plan, role, text in zip(convs.to_pylist(), *(batch.column(c).to_pylist() for c in ("plan", "role", "text"))):
                if plan is not None:
                    editor, conv = Editor(plan["audit"]), conv_id
                    continue
                for made in editor.edited(role, text):
                    ids.append(conv)
                    out.append((editor.rows - 1, *made))
            yield pa.RecordBatch.from_arrays([pa.array(ids, convs.type), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=["conv_id", "position", "role", "text"])

    return _edited(turns, stream, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position long, role string, text string")


def repair_digests(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = plan = conv = kind = None

        def table(ids: list, out: list) -> pa.RecordBatch:
            types = [pa.int64()] * len(COUNTS) + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            ids, out, convs = [], [], batch.column("conv_id")
            kind = convs.type
            for conv_id, new, role, text in zip(convs.to_pylist(), *(batch.column(c).to_pylist() for c in ("plan", "role", "text"))):
                if new is None:
                    for _ in editor.edited(role, text):
                        pass
                    continue
                if editor:
                    ids.append(conv)
                    out.append((*plan.values(), editor.sha.hexdigest()))
                conv, plan, editor = conv_id, new, Editor(new["audit"])
            yield table(ids, out)
        if editor:
            yield table([conv], [(*plan.values(), editor.sha.hexdigest())])

    return _edited(turns, stream, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
