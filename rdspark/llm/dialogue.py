"""Repair of conversations whose turns are blank, repeated, cut off or out of order: the cheapest edits that give legal roles.

Legal are the roles (s?(ua)+)?, by initials: nothing, or perhaps a system turn and then user and assistant in turn. The repair grammar is in Chomsky
normal form. Its nonterminals are pairs (i, j) of states of that language: "this span of turns leads from i to j". Terminal rules are the edits of a turn
(Keep, Rerole, Delete) with their costs, closed under Insert before a turn and at the end; binary rules are (i, j) -> (i, k) (k, j). A cell
of the chart holds, for each nonterminal of a span, the least (cost, audit), audits being the initials of the edits in order. Spans
are combined bottom-up by length: turns to pairs, pairs to fours, and so on. A pair of states meets every split of a span through some k, so one split
of a span says what all splits say, and a conversation costs one combination a turn. Equal costs never set an audit against its own beginning (the rest
would be inserts, which cost), so the least audit of a span is made of the least audits of its parts.

Large conversations: turns are dealt out by range of (conversation, turn), so a conversation may lie in many tasks. Each task hands on a span for every
``BLOCK`` turns, and spans are combined ``FAN`` at a time. Equal turns are counted before anything moves. Which turns repeat an earlier one is found by
the first place of each text, an aggregate. Only the last step, writing the repaired turns, takes the turns of one conversation through one task, in order and a batch
at a time: a digest of a whole conversation is sequential by nature.

Order: turns ascending, null first; turns of one number by role, then by a hash of the text; equal turns stand together.
Defined results: null roles and texts are one space, a null conversation id is a conversation of its own; a role without an initial (empty) or with another
initial than s, u, a cannot be kept; a conversation without turns has zeros, an empty audit and the digest of nothing; an empty table gives no rows;
repeated rows are repeated turns; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rdspark.llm.tables import written
from rdspark.operators.numbering import spread_join

BLOCK, FAN = 4096, 64
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: The language of initials as a machine: before anything, behind s, behind u, behind a; it may end before anything or behind a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")


def _closure() -> dict:
    """Least inserts between any two states: nonterminals of the empty span."""
    found = {(i, i): (0, "") for i in range(4)}
    for _ in range(4):
        for (i, k), (cost, audit) in list(found.items()):
            for letter in "ua":
                j = MOVES.get((k, letter))
                if j is not None and (i, j) not in found:
                    found[i, j] = (cost + INSERT, audit + "I")
    return found


EMPTY = _closure()
PAIRS = tuple(sorted({*EMPTY, *((i, j) for (i, _), j in MOVES.items())}))
RULES = tuple((p, tuple((a, b) for a, x in enumerate(PAIRS) for b, y in enumerate(PAIRS) if x[0] == p[0] and x[1] == y[0] and y[1] == p[1])) for p in PAIRS)
NOTHING = tuple(EMPTY.get(p) for p in PAIRS)
FROM_START = {j: k for k, (i, j) in enumerate(PAIRS) if i == 0}


def combined(left: tuple, right: tuple) -> tuple:
    """The cell of two spans that stand side by side."""
    out = []
    for _, splits in RULES:
        best = None
        for a, b in splits:
            x, y = left[a], right[b]
            if x is None or y is None:
                continue
            cost = x[0] + y[0]
            if best is None or cost < best[0]:
                best = (cost, x[1] + y[1])
            elif cost == best[0]:
                best = min(best, (cost, x[1] + y[1]))
        out.append(best)
    return tuple(out)


_cells: dict = {}


def turn_cell(initial: str, cut_off: bool, forced: int = 0) -> tuple:
    """The cell of one turn that may be kept, or of ``forced`` turns that must go, with the inserts before it."""
    key = (initial if initial in ("s", "u", "a") else "", cut_off, forced)
    if key in _cells:
        return _cells[key]
    if forced:
        own = {(i, i): (DELETE * forced, "D" * forced) for i in range(4)}
    else:
        own = {(i, i): (DELETE, "D") for i in range(4)}
        extra = CUT_OFF if cut_off else 0
        for (i, letter), j in MOVES.items():
            edits = [(KEEP + extra, "K")] if letter == initial else []
            edits += [(REROLE + extra, "R")] if letter in "ua" else []
            if edits:
                own[i, j] = min([*edits, *([own[i, j]] if (i, j) in own else [])])
    cell = combined(NOTHING, tuple(own.get(p) for p in PAIRS))
    if len(_cells) < 1000:
        _cells[key] = cell
    return cell


class Chart:
    """Cells of a row of turns, combined bottom-up: a span waits until its neighbour is as long."""

    def __init__(self):
        self.spans: list[tuple[int, tuple]] = []
        self.turns, self.first, self.last, self.illegal = 0, "", "", 0

    def add(self, cell: tuple, turns: int, first: str, last: str, illegal: int) -> None:
        self.illegal += illegal + (self.turns > 0 and self.last + first not in LEGAL)
        if not self.turns:
            self.first = first
        self.turns, self.last, level = self.turns + turns, last, 0
        while self.spans and self.spans[-1][0] == level:
            cell, level = combined(self.spans.pop()[1], cell), level + 1
        self.spans.append((level, cell))

    def cell(self) -> tuple:
        """The cell of all turns; inserts behind the last one are not in it."""
        cell = self.spans[-1][1]
        for _, span in reversed(self.spans[:-1]):
            cell = combined(span, cell)
        return cell


def cheapest(cell: tuple) -> tuple[int, str]:
    return min(cell[FROM_START[j]] for j in ENDS if cell[FROM_START[j]] is not None)


def keyed(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv, turn, role, text, copies): conversation ids as text, nulls of conversation, role and text as one space. A row is one turn unless ``copies`` names a count."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    count = (F.col(copies) if copies else F.lit(1)).cast("long")
    return rows.select(one("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), count.alias("copies"))


def _hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]


def turns(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h1, h2, n, blank, duplicate, cut_off): distinct turns of the rows of ``keyed`` with their number and faults; without texts.

    ``duplicate`` says that role and text stood in an earlier turn; the second and later of n equal turns repeat the first in any case.
    """
    end = F.rtrim("text", F.lit(BLANKS))
    last = F.substring(end, -1, 1)
    seen = rows.select("conv", "turn", "role", *_hashes(), (end == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"), "copies")
    own = written(seen.groupBy("conv", "turn", "role", "h1", "h2", "blank", "cut_off").agg(F.sum("copies").alias("n")), "own-turns")
    again = own.groupBy("conv", "role", "h1", "h2").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("none"), F.count(F.lit(1)).alias("places"))
    met = spread_join(own, again.where("places > 1").drop("places"), ["conv", "role", "h1", "h2"], F.xxhash64("turn"))
    earlier = F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("first")))
    return written(met.select("conv", "turn", "role", "h1", "h2", "n", "blank", F.coalesce(earlier & ~F.col("blank"), F.lit(False)).alias("duplicate"), "cut_off"), "turns")


def faults(own: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of each conversation of ``turns``."""
    n, whole = F.col("n"), ~F.col("blank") & ~F.col("duplicate")
    per_turn = own.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(F.when(F.col("duplicate"), n).when(whole, n - 1).otherwise(0)).alias("duplicate"),
        F.sum((whole & F.col("cut_off")).cast("long")).alias("truncated"))
    return per_turn.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
                                        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


SPAN = "conv string, no long, turns long, first string, last string, illegal long, costs array<long>, audits array<string>"


def _span_batch(rows: list) -> pa.RecordBatch:
    """Spans (conv, no, chart, cell) as a batch."""
    return pa.record_batch([
        pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].turns for r in rows], pa.int64()),
        pa.array([r[2].first for r in rows], pa.string()), pa.array([r[2].last for r in rows], pa.string()), pa.array([r[2].illegal for r in rows], pa.int64()),
        pa.array([[c and c[0] for c in r[3]] for r in rows], pa.list_(pa.int64())), pa.array([[c and c[1] for c in r[3]] for r in rows], pa.list_(pa.string()))],
        names=["conv", "no", "turns", "first", "last", "illegal", "costs", "audits"])


def spans(own: DataFrame, block: int = BLOCK) -> DataFrame:
    """A span for each run of at most ``block`` distinct turns of a conversation in a task; ``no`` ascends in the order of the turns."""
    order = ["conv", "turn", "role", "h1", "h2"]
    dealt = own.select(*order, F.substring("role", 1, 1).alias("initial"), "n", (F.col("blank") | F.col("duplicate")).alias("gone"), "cut_off")
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext
        no, conv, chart, count, out = TaskContext.get().partitionId() << 32, None, None, 0, []
        for batch in batches:
            for c, initial, n, gone, cut_off in zip(*(batch.column(x).to_pylist() for x in ("conv", "initial", "n", "gone", "cut_off"))):
                if c != conv or count == block:
                    if chart is not None:
                        out.append((conv, no, chart, chart.cell()))
                        no += 1
                    conv, chart, count = c, Chart(), 0
                count += 1
                if not gone:
                    chart.add(turn_cell(initial, cut_off), 1, initial, initial, 0)
                forced = n if gone else n - 1
                if forced:
                    chart.add(turn_cell("", False, forced), forced, initial, initial, forced - 1)
            if len(out) > 2000:
                yield _span_batch(out)
                out = []
        if chart is not None:
            out.append((conv, no, chart, chart.cell()))
        if out:
            yield _span_batch(out)
    return written(dealt.mapInArrow(run, SPAN), "spans")


def _cell(costs: list, audits: list) -> tuple:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits))


def parsed(own: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv, cost, audit, illegal): the least edits of each conversation of ``turns``."""
    parts = spans(own, block)
    ordered = Window.partitionBy("conv").orderBy("no")
    places = parts.select("conv", "no", (F.row_number().over(ordered).cast("long") - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("conv")).alias("spans"))
    places = written(places.where("spans > 1").drop("spans"), "places")      # of the conversations that lie in several spans
    last = places.agg(F.max("place")).first()[0] or 0

    def meet(table: pa.Table) -> pa.Table:
        chart, rows = Chart(), sorted(table.to_pylist(), key=lambda r: r["no"])
        for r in rows:
            chart.add(_cell(r["costs"], r["audits"]), r["turns"], r["first"], r["last"], r["illegal"])
        return pa.Table.from_batches([_span_batch([(rows[0]["conv"], rows[0]["part"], chart, chart.cell())])])
    several = parts.join(places, ["conv", "no"]).withColumn("no", F.col("place")).drop("place")
    parts = parts.join(places.select("conv").distinct(), "conv", "left_anti")
    while last:
        several = written(several.withColumn("part", F.call_function("div", "no", F.lit(fan).cast("long"))).groupBy("conv", "part").applyInArrow(meet, SPAN), "spans")
        last //= fan
    parts = parts.unionByName(several)

    def close(batches):
        for batch in batches:
            rows = [cheapest(combined(_cell(c, a), NOTHING)) for c, a in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist())]
            yield pa.record_batch([batch.column("conv"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), batch.column("illegal")],
                                  names=["conv", "cost", "audit", "illegal"])
    return written(parts.mapInArrow(close, "conv string, cost long, audit string, illegal long"), "parsed")


def repaired_turns(rows: DataFrame, parse: DataFrame) -> DataFrame:
    """(conv, place, role, text): the turns of ``keyed`` rows after the edits of ``parsed``; a task has a conversation's turns together and in order."""
    texts = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", *_hashes(), "text", "copies")
    audits = parse.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("h1"),
                          F.lit(0).cast("long").alias("h2"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    dealt = texts.unionByName(audits).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "h1", "h2")

    def run(batches):
        conv, audit, at, end, state, place, out, size = None, "", 0, 0, 0, 0, [], 0

        def put(role, text):
            nonlocal place, state, size
            out.append((conv, place, role, text))
            place, state, size = place + 1, MOVES[state, role[0]], size + len(text)

        def inserted():
            nonlocal at
            while audit[at:at + 1] == "I":
                put("assistant" if state == 2 else "user", "")
                at += 1

        def batch_of():
            nonlocal out, size
            cols, out, size = list(zip(*out)), [], 0
            return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                                   names=["conv", "place", "role", "text"])
        for batch in batches:
            for c, kind, role, text, copies in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "role", "text", "copies"))):
                if not kind:
                    conv, audit, at, end, state, place = c, text, 0, len(text.rstrip("I")), 0, 0
                for _ in range(copies):
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        put(role, text)
                    elif edit == "R":
                        put("assistant" if state == 2 else "user", text)
                if at == end:
                    inserted()
                if size > 1 << 22 or len(out) > 20_000:
                    yield batch_of()
        if out:
            yield batch_of()
    return dealt.mapInArrow(run, "conv string, place long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the turns of ``repaired_turns`` as they come: lines role:text, joined by line breaks."""
    def run(batches):
        conv, digest = None, None
        for batch in batches:
            done = []
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "place", "role", "text"))):
                if c != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update((f"{role}:{text}" if not place else f"\n{role}:{text}").encode())
            yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([conv], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])
    return repaired.mapInArrow(run, "conv string, repaired_sha256 string")


def repaired_conversations(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK, fan: int = FAN, copies: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation of ``rows`` (conv_id, turn, role, text), and of
    ``ids`` where given: conversations that may have lost all their turns. ``copies`` names a column that says how often a row stands."""
    source = ids if ids is not None else rows
    kind = source.schema["conv_id"].dataType
    turns_ = keyed(rows, copies)
    own = turns(turns_)
    parse = parsed(own, block, fan)
    digest = digests(repaired_turns(turns_, parse))
    every = source.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("conv_id").isNull().alias("_none")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(faults(own), "conv", "left").join(parse, "conv", "left").join(digest, "conv", "left").select(
        F.when(~F.col("_none"), F.col("conv")).cast(kind).alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with faults to test with, by the checksum of conversation and turn: dropped, emptied, without
    sentence ends, repeated, or given the role of the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", one("conv_id"), one("turn"))) % kinds
    return rows.where(h != 0).select("conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(one("role")).alias("role"),
                                     F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text")).alias("text"),
                                     F.when(h == 3, 2).otherwise(1).alias("copies"))
