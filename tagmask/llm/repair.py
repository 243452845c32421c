"""Repair of damaged conversations by the cheapest edits, found by square-root checkpointed dynamic programming.

A row becomes one symbol (class of its role, fault). Costs run backwards: the cost of finishing from each of four states of
the role grammar. Only every sqrt(n)-th cost vector is kept; walking forward, each block's vectors are computed again from
its checkpoint, and of the edits that keep the cost the ASCII-least is taken.

Conversations of up to LONG rows are worked on whole, as they come sorted out of a shuffle. Longer ones are dealt over tasks
by ranges of turns: a block of sqrt(n) rows gives the costs of crossing it between any two states, blocks are chained by
these, and each then finds its own edits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import attach, read, written
from tagmask.llm.vector_text import light

#: Rows and bytes of text up to which a conversation is worked on in one piece.
LONG, LONG_BYTES = 20_000, 8_000_000
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: Classes of roles, faults, and the symbol of both.
CLASSES, FINE, TRUNCATED, BLANK, DUPLICATE = "suax", 0, 1, 2, 3
#: States: nothing yet, system, user, assistant. Where an inserted or reroled row leads, and where each class may be kept.
NEXT, KEPT, NEVER = (2, 2, 3, 2), {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}, 1 << 60
Vector = tuple[int, int, int, int]
#: Costs of finishing after the last row: nothing, or user and assistant, or assistant.
LAST: Vector = (0, 2 * INSERT, INSERT, 0)


def symbol(role_class: str, fault: int) -> str:
    return chr(65 + CLASSES.index(role_class) + 4 * fault)


def _fault(s: str) -> int:
    return (ord(s) - 65) // 4


def _class(s: str) -> str:
    return CLASSES[(ord(s) - 65) % 4]


def _edits(s: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row."""
    fault, found = _fault(s), [("D", DELETE, state)]
    if fault < BLANK:
        stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
        if (_class(s), state) in KEPT:
            found.append(("K", stays, KEPT[_class(s), state]))
        found.append(("R", REROLE + stays, NEXT[state]))
    return found


@lru_cache(100_000)
def _before(s: str, after: Vector) -> tuple[Vector, int]:
    """Costs before a row, from those after it, and what was taken off to make the least 0."""
    costs = [min(cost + after[to] for _, cost, to in _edits(s, state)) for state in range(4)]
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[state]]) for state, c in enumerate(costs)]
    least = min(costs)
    return tuple(min(c - least, NEVER) for c in costs), least


@lru_cache(100_000)
def _move(s: str, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits from a state up to and with a row, and the state they lead to."""
    before, taken = _before(s, after)
    letters = ""
    while True:
        left = before[state] + taken
        tight = {letter: to for letter, cost, to in _edits(s, state) if cost + after[to] == left}
        if INSERT + before[NEXT[state]] == before[state]:
            tight["I"] = NEXT[state]
        letter = min(tight)
        letters, state = letters + letter, tight[letter]
        if letter != "I":
            return letters, state


def _closing(state: int) -> str:
    return "I" * (LAST[state] // INSERT)


def _scaled(vector: Vector) -> tuple[Vector, int]:
    least = min(vector)
    return tuple(min(c - least, NEVER) for c in vector), least


def backward(symbols: str, after: Vector) -> tuple[Vector, int]:
    """Costs before the symbols (least 0) and what was taken off."""
    vector, total = _scaled(after)
    for s in reversed(symbols):
        vector, taken = _before(s, vector)
        total += taken
    return vector, total


def forward(symbols: str, after: Vector, state: int = 0) -> tuple[str, int]:
    """The ASCII-least cheapest edits over the symbols from a state, if `after` is the cost of what follows; checkpoints every
    sqrt(n) symbols."""
    side = max(1, math.isqrt(len(symbols)))
    starts = range(0, len(symbols), side)
    checkpoints, vector = [], _scaled(after)[0]
    for start in reversed(starts):
        checkpoints.append(vector)
        vector, _ = backward(symbols[start : start + side], vector)
    letters = []
    for start, vector in zip(starts, reversed(checkpoints), strict=True):
        block = symbols[start : start + side]
        after_each = [vector]
        for s in reversed(block[1:]):
            after_each.append(_before(s, after_each[-1])[0])
        for s, following in zip(block, reversed(after_each), strict=True):
            step, state = _move(s, following, state)
            letters.append(step)
    return "".join(letters), state


def cheapest(symbols: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    vector, total = backward(symbols, LAST)
    letters, state = forward(symbols, LAST)
    return vector[0] + total, letters + _closing(state)


class Rewriting:
    """The repaired conversation's digest, row by row: `edit` takes letters up to and with a row, `close` those after the last."""

    def __init__(self):
        self.digest, self.state, self.lines = hashlib.sha256(), 0, 0

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _next(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._line("user" if self.state == 2 else "assistant", text)

    def edit(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            self._line(role, text)
        elif letter in "RI":
            self._next(text)


def illegal_pairs(symbols: str) -> int:
    """Neighbours whose role classes are none of su, ua, au."""
    classes = "".join(map(_class, symbols))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(classes, classes[1:]))


def fault_counts(symbols: str) -> list[int]:
    return [sum(_fault(s) == fault for s in symbols) for fault in (BLANK, DUPLICATE, TRUNCATED)]


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# --- rows ------------------------------------------------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged rows, `_gone` rows that only name their conversation, `_class` of the role and
    `_fault` as far as a row shows it alone."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(of("text"), ".!?", "")).otherwise(of("text"))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(of("role")).alias("role"), text.alias("text"), (kind == 0).alias("_gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", BLANK).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    return rows.withColumn("_fault", fault).withColumn("_class", F.when(initial.isin("s", "u", "a"), initial).otherwise("x"))


def _key() -> Column:
    """The conversation as a string that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-"))


# --- conversations in one piece ----------------------------------------------------------------------------------------------
def _whole(kind: pa.DataType) -> Callable:
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, conv, rows = None, None, []

        def done() -> None:
            symbols, seen, turns = [], set(), [r[0] for r in rows]
            for _, role, text, role_class, fault in rows:
                same = (role, text)
                symbols.append(symbol(role_class, DUPLICATE if fault != BLANK and same in seen else fault))
                seen.add(same)
            symbols = "".join(symbols)
            cost, audit = cheapest(symbols)
            writing, at = Rewriting(), iter(rows)
            for letter in audit:
                if letter == "I":
                    writing.edit(letter)
                else:
                    _, role, text, _, _ = next(at)
                    writing.edit(letter, role, text)
            known = sorted({t for t in turns if t is not None})
            gaps = known[-1] - known[0] + 1 - len(known) if known else 0
            out.append((conv, gaps, *fault_counts(symbols), illegal_pairs(symbols), cost, audit, writing.digest.hexdigest()))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *[f.split()[0] for f in FIELDS.split(", ")]])
            out.clear()
            return batch

        for batch in light(batches):
            for key, conv_id, turn, role, text, gone, fault, role_class in zip(*(batch.column(c).to_pylist() for c in ("_k", "conv_id", "turn", "role", "text", "_gone", "_fault", "_class")), strict=True):
                if key != current:
                    if current is not None:
                        done()
                    current, conv, rows = key, conv_id, []
                if not gone:
                    rows.append((turn, role, text, role_class, fault))
            if len(out) > 2000:
                yield flushed()
        if current is not None:
            done()
        yield flushed()

    return repair


# --- conversations over many tasks ---------------------------------------------------------------------------------------------
def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order plus `_part` and `_pos` (their place), `_block` and `_symbol`; of equal rows all but the first are duplicates."""
    part, pos, count, last = TaskContext.get().partitionId(), 0, 0, None
    for batch in light(batches):
        added = [[], [], []]
        for key, side, turn, role, digest, later, fault, role_class in zip(*(batch.column(c).to_pylist() for c in ("_k", "_side", "turn", "role", "_digest", "_later", "_fault", "_class")), strict=True):
            count = count + 1 if last is not None and last[0] == key else 0
            again = later or last == (key, turn, role, digest)
            last = (key, turn, role, digest)
            added[0].append(pos)
            added[1].append(count // side)
            added[2].append(symbol(role_class, DUPLICATE if fault != BLANK and again else fault))
            pos += 1
        names = ["_k", "turn", "role", "text"]
        arrays = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(added[0], pa.int64()), pa.array(added[1], pa.int64()), pa.array(added[2], pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], [*names, "_part", "_pos", "_block", "_symbol"])


def _matrix(symbols: str) -> list[int]:
    """Cost of crossing a block from each state to each."""
    columns = []
    for to in range(4):
        vector, total = backward(symbols, tuple(0 if state == to else NEVER for state in range(4)))
        columns.append([min(c + total, NEVER) for c in vector])
    return [columns[to][state] for state in range(4) for to in range(4)]


def _each(rows: DataFrame, added: str, of: Callable) -> DataFrame:
    """Rows plus columns: `of` takes a row as a dictionary and gives their values."""
    names = [f.split()[0] for f in added.split(", ")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        types = [kinds[f.split()[1]] for f in added.split(", ")]
        for batch in batches:
            values = list(zip(*(of(r) for r in batch.to_pylist()), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(values, types, strict=True))], [*batch.schema.names, *names])

    return rows.mapInArrow(run, fields)


def _after_blocks(table: pa.Table) -> pa.Table:
    """Per block of one conversation the costs after it, from the last block to the first; `_cost` at the first."""
    table = table.sort_by([("_part", "ascending"), ("_block", "ascending")])
    after, afters = LAST, []
    for crossing in reversed(table["_matrix"].to_pylist()):
        afters.append(list(after))
        after = tuple(min(crossing[4 * state + to] + after[to] for to in range(4)) for state in range(4))
    return pa.table([table["_k"], table["_part"], table["_block"], pa.array(afters[::-1], pa.list_(pa.int64())), pa.array([after[0]] * len(table), pa.int64())], ["_k", "_part", "_block", "_after", "_cost"])


def _entries(table: pa.Table) -> pa.Table:
    """Per block of one conversation the state in which it is entered, and whether it is the last."""
    table = table.sort_by([("_part", "ascending"), ("_block", "ascending")])
    state, states = 0, []
    for leads in table["_leads"].to_pylist():
        states.append(state)
        state = leads[state]
    last = [False] * (len(table) - 1) + [True]
    return pa.table([table["_k"], table["_part"], table["_block"], pa.array(states, pa.int32()), pa.array(last, pa.bool_())], ["_k", "_part", "_block", "_state", "_last"])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest per conversation, from its blocks' edits and rows in order (a block's edits come before its rows)."""
    key, writing, audit, letters = None, Rewriting(), [], iter(())
    out: list[tuple] = []

    def finish() -> None:
        for letter in letters:
            writing.edit(letter)
        if key is not None:
            out.append((key, "".join(audit), writing.digest.hexdigest()))

    for batch in light(batches):
        for k, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("_k", "_edits", "role", "text")), strict=True):
            if k != key:
                finish()
                key, writing, audit, letters = k, Rewriting(), [], iter(())
            if edits is not None:
                audit.append(edits)
                letters = iter(edits)
                continue
            for letter in letters:
                writing.edit(letter, role, "" if letter == "I" else text)
                if letter != "I":
                    break
    finish()
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 3)], ["_k", "audit", "repaired_sha256"])


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`_k` and the result columns of long conversations; `rows` have their key `_k`, `sizes` (`_k`, `_n`) their lengths."""
    rows = attach(rows.filter(~F.col("_gone")), sizes.select("_k", F.ceil(F.sqrt("_n")).cast("long").alias("_side")), ["_k"], "text").withColumn("_digest", F.md5(F.col("text").cast("binary")))
    same = ["_k", "role", "_digest"]
    # Texts said at two turns or more; those said twice at one turn are neighbours, which _placed sees.
    first = rows.groupBy(*same).agg(F.min(F.struct("turn")).alias("_first"), F.max(F.struct("turn")).alias("_last")).filter("_first < _last").drop("_last")
    marked = attach(rows, written(first, "repair-first"), same, "turn").withColumn("_later", F.coalesce(F.struct("turn") > F.col("_first"), F.lit(False))).drop("_first")
    # Ranges are cut at the texts' beginnings, which go as the texts do: so much of a text comes to the driver as a border.
    order = ["_k", "turn", "role"]
    ranged = marked.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").select(*order, "_digest", "text", "_side", "_later", "_fault", "_class")
    laid = written(ranged.mapInArrow(_placed, "_k string, turn long, role string, text string, _part int, _pos long, _block long, _symbol string"), "repair-rows")

    block = ["_k", "_part", "_block"]
    listed = F.array_sort(F.collect_list(F.struct("_pos", "_symbol")))
    blocks = laid.groupBy(*block).agg(F.min("_pos").alias("_pos"), F.array_join(F.transform(listed, lambda x: x["_symbol"]), "").alias("_symbols"))
    counts = lambda r: (_matrix(r["_symbols"]), *fault_counts(r["_symbols"]), illegal_pairs(r["_symbols"]))
    blocks = written(_each(blocks, "_matrix array<long>, blank long, duplicate long, truncated long, illegal long", counts), "repair-blocks")
    after = blocks.select(*block, "_matrix").groupBy("_k").applyInArrow(_after_blocks, "_k string, _part int, _block long, _after array<long>, _cost long")
    after = written(_each(blocks.select(*block, "_pos", "_symbols").join(after, block), "_leads array<int>", lambda r: ([forward(r["_symbols"], tuple(r["_after"]), state)[1] for state in range(4)],)), "repair-after")
    entered = after.select(*block, "_leads").groupBy("_k").applyInArrow(_entries, "_k string, _part int, _block long, _state int, _last boolean")

    def edits(r: dict) -> tuple[str]:
        letters, state = forward(r["_symbols"], tuple(r["_after"]), r["_state"])
        return (letters + (_closing(state) if r["_last"] else ""),)

    edited = _each(after.join(entered, block), "_edits string", edits)
    none = F.lit(None).cast("string")
    rows_and_edits = laid.select("_k", "_part", "_pos", F.lit(1).alias("_o"), none.alias("_edits"), "role", "text").unionByName(edited.select("_k", "_part", "_pos", F.lit(0).alias("_o"), "_edits", none.alias("role"), none.alias("text")))
    texts = rows_and_edits.repartition("_k").sortWithinPartitions("_k", "_part", "_pos", "_o").mapInArrow(_rewritten, "_k string, audit string, repaired_sha256 string")

    # Pairs across the borders of blocks: the last class of one and the first of the next.
    ends = blocks.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_part", "_block", F.substring("_symbols", 1, 1).alias("a"), F.substring("_symbols", -1, 1).alias("z")))).alias("_e"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    class_of = lambda s: (F.ascii(s) - 65) % 4
    borders = F.zip_with(F.slice("_e", 1, F.size("_e") - 1), F.slice("_e", 2, F.greatest(F.size("_e") - 1, F.lit(0))), lambda x, y: class_of(x["z"]) * 10 + class_of(y["a"]))
    legal = [CLASSES.index(a) * 10 + CLASSES.index(b) for a, b in ("su", "ua", "au")]
    sums = ends.withColumn("illegal", F.col("illegal") + F.size(F.filter(borders, lambda b: ~b.isin(*legal)))).drop("_e")
    gaps = laid.groupBy("_k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    costs = after.groupBy("_k").agg(F.max("_cost").alias("cost"))
    return gaps.join(sums, "_k").join(costs, "_k").join(texts, "_k")


def repair_conversations(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (`damaged`), then repaired. Rows of a conversation go by turn (nulls first); rows of one turn by
    role and text. Null ids are one conversation; null turns count for no gap; null roles and texts are one blank; a
    conversation that loses all rows has zeros, an empty audit and the digest of nothing. Other columns are ignored; an empty
    table gives no rows.

    A conversation of over `long` rows (or LONG_BYTES of text) never lies in one task, except for its digest, which is a
    stream over its rows in order, and its audit, a letter a row; equal rows of one turn stay together.
    """
    rows = damaged(conversations).withColumn("_k", _key())
    sizes = rows.groupBy("_k").agg(F.sum(F.when(F.col("_gone"), 0).otherwise(1)).alias("_n"), F.sum(F.octet_length("text")).alias("_b"), F.first("conv_id").alias("conv_id"))
    big = written(sizes.filter((F.col("_n") > long) | ((F.col("_b") > LONG_BYTES) & (F.col("_n") > 0))), "repair-long")
    some = not big.isEmpty()
    if some:
        rows = attach(rows, big.select("_k", F.lit(True).alias("_long")), ["_k"], "text")
    short = (rows.filter(F.col("_long").isNull()) if some else rows).repartition("_k").sortWithinPartitions("_k", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    out = short.select("_k", "conv_id", "turn", "role", "text", "_gone", "_fault", "_class").mapInArrow(_whole(arrow), f"conv_id {kind.simpleString()}, {FIELDS}")
    if some:
        dealt = _dealt(rows.filter("_long").drop("_long"), big).join(big.select("_k", "conv_id"), "_k").select(*out.columns)
        out = out.unionByName(dealt)
    return out


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return repair_conversations(read(spark, sf_dir, "conversations"))
