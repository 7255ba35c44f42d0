"""Conversation structure repair: the cheapest edits that make role initials follow (s?(ua)+)?, by a rank-compressed search.

A conversation's turns are layers; a state says what was said last (nothing, system, user, assistant). Between two
layers stands one macro edit: a run of inserted turns and what happens to the next turn. The nine macro edits are words
of an ordered prefix-free code, so two different histories of equally many turns never begin each other, and comparing
(rank of the history so far, macro edit) is comparing whole audit strings. A layer therefore keeps for each state a cost
and the rank of its audit string, never the string; both are taken relative to the layer's least, which leaves few
different layers, and a step from one of them by one kind of turn is worked out once per worker. Parent pointers are the
steps themselves: edits are read off backwards.

Conversations may be of any length. Turns are sorted over all partitions and numbered; runs of at most CHUNK numbers are
searched on their own, from every state they may begin in; the runs of a conversation are joined by their tables of 4 x 4
costs and ranks; then each run is read off between the two states chosen for it. Only the last step, in which a
conversation's repaired turns pass in their order, has one task for one conversation, which holds one run at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionlake.llm.common import Scratch, partitions

#: States by what was said last; a repaired conversation ends in NOTHING or ASSISTANT.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Macro edits in ASCII order: none begins another.
CODES = tuple(sorted(run + edit for run in ("", "I", "II") for edit in "DKR"))
#: Of a turn: 4 * initial + fault.
INITIALS, FAULTS = ("s", "u", "a"), ("", "blank", "duplicate", "truncated")
CHUNK_BITS = 12
SPACES = " \t\n\x0b\x0c\r"
_NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32(`conv_id:turn`) % 20; all nulls of the name, role and text are one space.

    0 drops the turn, 1 empties its text, 2 removes [.!?] from it, 3 repeats it, 4 sets the role user.
    """
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(named.cast("binary")) % 20).alias("_fault"))
    fault = F.col("_fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), fault)
    return rows.withColumn("_copy", F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fault", "_copy")


# ------------------------------------------------------------------ the search


def moves(kind: int) -> list[tuple[int, int, int, int]]:
    """(state before, state after, price, code) of every macro edit over a turn of this kind."""
    initial, fault = divmod(kind, 4)
    out = []
    for before in STATES:
        at = before
        for run in range(3):
            price = run * INSERT
            out.append((before, at, price + DELETE, CODES.index("I" * run + "D")))
            if FAULTS[fault] in ("", "truncated"):
                price += TRUNCATED if fault else 0
                out.append((before, _NEXT[at], price + REROLE, CODES.index("I" * run + "R")))
                said = (SYSTEM, USER, ASSISTANT, None)[initial]
                if said == _NEXT[at] or said == SYSTEM and at == NOTHING:
                    out.append((before, said, price, CODES.index("I" * run + "K")))
            at = _NEXT[at]
    return out


#: A layer has an entry (cost over the least, rank of the audit string) or None for each (state begun in, state now).
Layer = tuple[tuple[int, int] | None, ...]
FRESH: Layer = tuple((0, 0) if k == 0 else None for k in range(16))
ANY: Layer = tuple((0, 0) if k % 5 == 0 else None for k in range(16))


class Search:
    """Steps between layers, each worked out when it first comes up."""

    def __init__(self) -> None:
        self.moves = [moves(kind) for kind in range(16)]
        self.layers: list[Layer] = [FRESH, ANY]
        self.number = {FRESH: 0, ANY: 1}
        self.steps: dict[int, tuple[int, int, tuple]] = {}

    def step(self, layer: int, kind: int) -> tuple[int, int, tuple]:
        """(next layer, what its costs are over, (state before, code) of each entry)."""
        known = self.steps.get(layer * 16 + kind)
        if known:
            return known
        now = self.layers[layer]
        best: list[tuple[int, int, int, int] | None] = [None] * 16
        for begun in range(0, 16, 4):
            for before, after, price, code in self.moves[kind]:
                if (entry := now[begun + before]) is not None:
                    candidate = (entry[0] + price, entry[1], code, before)
                    if best[begun + after] is None or candidate < best[begun + after]:
                        best[begun + after] = candidate
        least = min(x[0] for x in best if x)
        order = {x: k for k, x in enumerate(sorted({x[1:3] for x in best if x}))}
        layer_after = tuple(x and (x[0] - least, order[x[1:3]]) for x in best)
        if layer_after not in self.number:
            self.number[layer_after] = len(self.layers)
            self.layers.append(layer_after)
        out = (self.number[layer_after], least, tuple(x and (x[3], x[2]) for x in best))
        self.steps[layer * 16 + kind] = out
        return out

    def table(self, kinds: bytes, fresh: bool) -> tuple[list[int], list[int]]:
        """(costs, ranks) by 4 * state begun in + state ended in after these turns; -1 where there is no way."""
        layer, total = 0 if fresh else 1, 0
        for kind in kinds:
            layer, more, _ = self.step(layer, kind)
            total += more
        return [total + x[0] if x else -1 for x in self.layers[layer]], [x[1] if x else -1 for x in self.layers[layer]]

    def codes(self, kinds: bytes, fresh: bool, begun: int, ended: int) -> bytes:
        """The macro edit of each turn on the best way between two states."""
        layer, pointers = 0 if fresh else 1, []
        for kind in kinds:
            layer, _, back = self.step(layer, kind)
            pointers.append(back)
        out, state = bytearray(len(kinds)), ended
        for k in range(len(kinds) - 1, -1, -1):
            state, out[k] = pointers[k][begun * 4 + state]
        return bytes(out)


def joined(tables: list[tuple[list[int], list[int]]]) -> tuple[list[tuple[int, int]], int]:
    """((state begun in, state ended in) of each run of a conversation, turns inserted at its end), by the runs' tables."""
    cost: list[int] = [0, -1, -1, -1]
    rank, pointers = [0, 0, 0, 0], []
    for costs, ranks in tables:
        best = [min(((cost[m] + costs[4 * m + e], rank[m], ranks[4 * m + e], m) for m in STATES if cost[m] >= 0 and costs[4 * m + e] >= 0), default=None) for e in STATES]
        order = {x: k for k, x in enumerate(sorted({x[1:3] for x in best if x}))}
        cost, rank = [x[0] if x else -1 for x in best], [order[x[1:3]] if x else 0 for x in best]
        pointers.append(bytes(x[3] if x else 0 for x in best))
    tail = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    state = min((cost[s] + INSERT * tail[s], rank[s], s) for s in STATES if cost[s] >= 0)[2]
    inserted, out = tail[state], []
    for back in reversed(pointers):
        out.append((back[state], state))
        state = back[state]
    return out[::-1], inserted


# ------------------------------------------------------------------ Spark steps


def sorted_turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text and pos, a number that follows the order (conversation, turn, role, text), written once.

    Nulls of role and text are one space. Turns are dealt out by ranges of that order, so that a long conversation, or many
    copies of one turn, is split. Rows of one turn and role are ordered by the text's first 32 characters and its hash.
    """
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # the last key only tells copies apart that are the same in all columns, so it does not matter which of them gets which
    keyed = rows.withColumns({"_p": F.substring("text", 1, 32), "_h": F.xxhash64("text"), "_s": F.rand(5)})
    order = ["conv_id", "turn", "role", "_p", "_h", "_s"]
    dealt = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return scratch.table(dealt.drop("_p", "_h", "_s").withColumn("pos", F.monotonically_increasing_id()), "turns")


def _stripped() -> Column:
    return F.rtrim(F.col("text"), F.lit(SPACES))


def kinds(turns: DataFrame) -> DataFrame:
    """conv_id, pos and kind of each turn. Duplicates are found by the least number of each (conversation, role, text)."""
    last = F.right(_stripped(), F.lit(1))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.left("role", F.lit(1))), F.lit(0))
    rows = turns.select(
        "conv_id",
        "pos",
        F.when(initial == 0, 3).otherwise(initial - 1).cast("int").alias("_i"),
        F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).alias("_f"),
        F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256).alias("_k"),
    )
    first = rows.where(F.col("_f") != 1).groupBy("conv_id", "_k").agg(F.min("pos").alias("_first")).select("_first")
    marked = rows.drop("_k").join(first, F.col("pos") == F.col("_first"), "left")
    fault = F.when((F.col("_f") != 1) & F.col("_first").isNull(), 2).otherwise(F.col("_f"))
    return marked.select("conv_id", "pos", (F.col("_i") * 4 + fault).cast("byte").alias("kind"))


def runs(turn_kinds: DataFrame) -> DataFrame:
    """conv_id, pos0, fresh, kinds, costs, ranks of each run: a conversation's turns with numbers in one chunk.

    A run that does not begin its chunk begins its conversation (fresh), and is searched from the first state alone.
    """
    chunk = F.shiftright("pos", CHUNK_BITS)
    schema = T.StructType([turn_kinds.schema["conv_id"], *T._parse_datatype_string("pos0 long, fresh boolean, kinds binary, costs array<int>, ranks array<int>").fields])
    id_type = T.StructType([turn_kinds.schema["conv_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        search, arrow_id = Search(), to_arrow_schema(id_type).field(0).type
        names = ["conv_id", "pos0", "fresh", "kinds", "costs", "ranks"]
        types = [arrow_id, pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]

        def rows(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((i, p, f, bytes(k), *search.table(bytes(k), f)) for i, p, f, k in found), strict=True), types, strict=True)], names)

        current: tuple | None = None
        done: list[tuple] = []
        place = None  # the chunk of the last turn
        for batch in batches:
            for conv, pos, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = pos >> CHUNK_BITS
                if current is None or here != place or conv != current[0]:
                    if current is not None:
                        done.append(current)
                    current = (conv, pos, here == place, bytearray())
                    place = here
                current[3].append(kind)
            if done:
                yield rows(done)
                done = []
        if current is not None:
            yield rows([current])

    return turn_kinds.repartition(chunk).sortWithinPartitions("pos").mapInArrow(run, schema)


def ways(found: DataFrame) -> DataFrame:
    """pos0, begun, ended, tail of each run: the states between which the best way passes, and turns inserted after it.

    A conversation's runs, one for 4096 turns, pass in order; what is held of each is four pointers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(conv, tables) -> pa.RecordBatch:
            way, tail = joined(tables)
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([a for a, _ in way], pa.int32()), pa.array([b for _, b in way], pa.int32()), pa.array([0] * (len(way) - 1) + [tail], pa.int32())], ["pos0", "begun", "ended", "tail"])

        conv, tables, places, out = None, [], [], []
        for batch in batches:
            for key, pos, costs, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tables and key != conv:
                    out.append(rows(conv, tables))
                    tables, places = [], []
                conv = key
                tables.append((costs, ranks))
                places.append(pos)
            yield from out
            out = []
        if tables:
            yield rows(conv, tables)

    ordered = found.select("conv_id", "pos0", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "pos0")
    return ordered.mapInArrow(run, "pos0 long, begun int, ended int, tail int")


def edits(found: DataFrame) -> DataFrame:
    """conv_id, pos (of the run's first turn), kinds, codes (both a byte for each turn) and tail of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search()
        for batch in batches:
            fresh, kind, begun, ended = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            codes = [search.codes(k, f, b, e) for f, k, b, e in zip(fresh, kind, begun, ended, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(codes, pa.binary()), batch.column(6)], ["conv_id", "pos", "kinds", "codes", "tail"])

    rows = found.select("conv_id", "pos0", "fresh", "kinds").join(ways(found), "pos0").select("conv_id", "pos0", "fresh", "kinds", "begun", "ended", "tail")
    schema = T.StructType([found.schema["conv_id"], *T._parse_datatype_string("pos long, kinds binary, codes binary, tail int").fields])
    return rows.mapInArrow(run, schema)


class Repair:
    """The turns of one conversation as they pass, with what each of them becomes."""

    def __init__(self) -> None:
        self.state, self.kinds, self.codes, self.at, self.tail = NOTHING, b"", b"", 0, 0

    def begin(self, kinds: bytes, codes: bytes, tail: int) -> None:
        self.kinds, self.codes, self.at, self.tail = kinds, codes, 0, tail

    def _inserted(self, n: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(n):
            self.state = _NEXT[self.state]
            yield "I", _NAME[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text); a deleted turn has the role and text that it had."""
        code = CODES[self.codes[self.at]]
        initial = self.kinds[self.at] >> 2
        self.at += 1
        yield from self._inserted(len(code) - 1)
        edit = code[-1]
        if edit == "K":
            self.state = (SYSTEM, USER, ASSISTANT)[initial]
        elif edit == "R":
            self.state = _NEXT[self.state]
            role = _NAME[self.state]
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted(self.tail)


_MARK, _RUN, _TURN = range(3)


def _streams(turns: DataFrame, ids: DataFrame, done: DataFrame) -> DataFrame:
    """conv_id, what, turn, role, text, kinds, codes, tail: of each conversation a mark, then each run before its turns."""
    none = lambda t: F.lit(None).cast(t)
    marks = ids.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(_MARK).alias("what"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("kinds"), none("binary").alias("codes"), none("int").alias("tail"))
    heads = done.select("conv_id", "pos", F.lit(_RUN).alias("what"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "kinds", "codes", "tail")
    rows = turns.select("conv_id", "pos", F.lit(_TURN).alias("what"), F.col("turn").cast("long").alias("turn"), "role", "text", none("binary").alias("kinds"), none("binary").alias("codes"), none("int").alias("tail"))
    whole = marks.unionByName(heads).unionByName(rows)
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "what").drop("pos")


def searched(rows: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(numbered turns, edits of each run), both written: see sorted_turns() and edits()."""
    scratch = scratch or Scratch(rows.sparkSession)
    turns = sorted_turns(rows, scratch)
    found = scratch.table(runs(kinds(turns)), "runs")
    return turns, scratch.table(edits(found), "edits")


def repaired(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, place, edit (K kept, R given another role, D deleted, I inserted), role, text: the edited turns in order.

    Without its D rows a conversation's role initials follow (s?(ua)+)?; the edits in order are its audit string.
    Defined cases: nulls of role and text are one space, null turns come first, null ids are one conversation; repeated
    rows are duplicates and go; roles of other initials are given a role or go; no rows give none; other columns are not read.
    """
    turns, done = searched(rows, scratch)
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string("place long, edit string, role string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, place, begun = None, Repair(), 0, False
        for batch in batches:
            out: list[tuple] = []
            for key, what, _, role, text, kind, codes, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                events: list = []
                if what == _MARK:
                    if begun:
                        out += ((conv, place + k, *e) for k, e in enumerate(repair.end()))
                    conv, repair, place, begun = key, Repair(), 0, True
                elif what == _RUN:
                    repair.begin(kind, codes, tail)
                else:
                    events = list(repair.turn(role, text))
                out += ((conv, place + k, *e) for k, e in enumerate(events))
                place += len(events)
            yield _batch(out, batch.column(0).type)
        if begun:
            yield _batch([(conv, place + k, *e) for k, e in enumerate(repair.end())], batch.column(0).type)

    def _batch(out: list[tuple], id_type) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (id_type, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "edit", "role", "text"])

    return _streams(turns, rows.select("conv_id").distinct(), done).mapInArrow(run, schema)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Tally:
    """The digest of one conversation, from its turns and edits as they pass."""

    def __init__(self, conv) -> None:
        self.conv, self.n = conv, dict.fromkeys(_COUNTS, 0)
        self.low, self.high, self.distinct, self.initial = None, None, 0, None
        self.audit, self.hash, self.any = [], hashlib.sha256(), False

    def turn(self, turn: int | None, role: str, kind: int) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if kind & 3:
            self.n[FAULTS[kind & 3]] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.initial = role[:1]

    def edit(self, edit: str, role: str, text: str, kind: int = 0) -> None:
        self.audit.append(edit)
        self.n["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if edit in "KR" and kind & 3 == 3 else 0)
        if edit != "D":
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "replace"))
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *(self.n[c] for c in _COUNTS[1:]), "".join(self.audit), self.hash.hexdigest())


def digest(rows: DataFrame, ids: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ids (else of rows).

    Defined cases: those of repaired(); a conversation without rows has zeros, an empty audit and the empty string's hash;
    gaps count only turns that are not null. Shuffles: all texts twice, in ranges and by conversation; numbers otherwise.
    """
    turns, done = searched(rows, scratch)
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, repair, id_type = None, Repair(), None

        def ended() -> tuple:
            for event in repair.end():
                tally.edit(*event)
            return tally.row()

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (id_type, *[pa.int64()] * 6, pa.string(), pa.string()), strict=True)], names)

        for batch in batches:
            out, id_type = [], batch.column(0).type
            for key, what, turn, role, text, kind, codes, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == _MARK:
                    if tally is not None:
                        out.append(ended())
                    tally, repair = Tally(key), Repair()
                elif what == _RUN:
                    repair.begin(kind, codes, tail)
                else:
                    own = repair.kinds[repair.at]
                    tally.turn(turn, role, own)
                    for event in repair.turn(role, text):
                        tally.edit(*event, own if event[0] != "I" else 0)
            yield rows_of(out)
        if tally is not None:
            yield rows_of([ended()])

    return _streams(turns, (rows if ids is None else ids).select("conv_id").distinct(), done).mapInArrow(run, schema)
