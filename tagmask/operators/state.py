"""State of dossiers, approval and the gate before export."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmask.model import APPROVED, DRAFT, PENDING


STATES = (DRAFT, PENDING, APPROVED)
#: What a stretch of events does to a dossier that enters it in each of STATES: the state it leaves in, whether it changes the
#: stored hash and to what, whether it starts anew, and approvals refused (since the start anew).
Effect = tuple[int, bool, str | None, bool, int]
NOTHING: tuple[Effect, ...] = tuple((i, False, None, False, 0) for i in range(3))


def _event(state: int, event: str | None, digest: str | None) -> Effect:
    if event == "analysed":
        return 1, False, None, False, 0
    if event == "approve":
        return (2, True, digest, False, 0) if state == 1 else (state, False, None, False, 1)
    if event == "mutation" and state == 2:
        return 1, True, None, False, 0
    if event == "clear":
        return 0, True, None, True, 0
    return state, False, None, False, 0


def _then(first: Effect, second: Effect) -> Effect:
    """One effect after another; this is associative, so stretches can be folded apart."""
    changed = first[1] or second[1]
    return second[0], changed, second[2] if second[1] else first[2], first[3] or second[3], second[4] if second[3] else first[4] + second[4]


def _table(effects: tuple[Effect, ...]) -> list[dict]:
    return [dict(zip(("state", "changed", "hash", "anew", "rejected"), e, strict=True)) for e in effects]


_STRETCH = "dossier_id string, part int, effects array<struct<state:int,changed:boolean,hash:string,anew:boolean,rejected:int>>"
_EFFECT = pa.struct([("state", pa.int32()), ("changed", pa.bool_()), ("hash", pa.string()), ("anew", pa.bool_()), ("rejected", pa.int32())])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The effect of each dossier's events in this task, which are sorted, for each state it may be in before."""
    part, current, effects, out = TaskContext.get().partitionId(), None, None, []
    schema = pa.schema([("dossier_id", pa.string()), ("part", pa.int32()), ("effects", pa.list_(_EFFECT))])
    flush = lambda: pa.RecordBatch.from_pylist([{"dossier_id": d, "part": part, "effects": _table(e)} for d, e in out], schema=schema)
    for batch in batches:
        for dossier, event, digest in zip(*(batch.column(c).to_pylist() for c in ("dossier_id", "event", "digest")), strict=True):
            if effects is None or dossier != current:
                if effects is not None:
                    out.append((current, effects))
                current, effects = dossier, NOTHING
            effects = tuple(_then(e, _event(e[0], event, digest)) for e in effects)
        yield flush()
        out.clear()
    if effects is not None:
        out.append((current, effects))
        yield flush()


def replay_state(events: DataFrame) -> DataFrame:
    """Events (dossier_id, seq, event, digest) to dossier_id, state, approval_hash, rejected (approvals refused).

    `analysed` makes a dossier pending and keeps a stored hash; `approve` counts only when pending; `mutation` takes an
    approval back; `clear` starts anew; other events change nothing. Events are dealt by ranges of dossier and seq, so a
    dossier of any number of events spreads; what each range does from each state is put together per dossier.
    """
    order = ["dossier_id", "seq", "event", "digest"]
    ranged = events.select(F.col("dossier_id").cast("string").alias("dossier_id"), "seq", "event", "digest").repartitionByRange(*order).sortWithinPartitions(*order)
    stretches = ranged.select("dossier_id", "event", "digest").mapInArrow(_stretches, _STRETCH)
    lists = stretches.groupBy("dossier_id").agg(F.array_sort(F.collect_list(F.struct("part", "effects"))).alias("s"))

    def step(at: Column, stretch: Column) -> Column:
        effect = F.element_at(stretch["effects"], at["state"] + 1)
        return F.struct(
            effect["state"].alias("state"), F.when(effect["changed"], effect["hash"]).otherwise(at["hash"]).alias("hash"),
            F.when(effect["anew"], effect["rejected"]).otherwise(at["rejected"] + effect["rejected"]).alias("rejected"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("string").alias("hash"), F.lit(0).alias("rejected"))
    ended = lists.select("dossier_id", F.aggregate("s", start, step).alias("e"))
    return ended.select("dossier_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("e.state") + 1).alias("state"), F.col("e.hash").alias("approval_hash"), F.col("e.rejected").alias("rejected"))


def mutations(switch_commands: DataFrame, removals: DataFrame, merges: DataFrame) -> DataFrame:
    """What counts as a mutation: a category or tag switched, a document removed, a merge accepted (dossier_id, seq each)."""
    pick = lambda df: df.select("dossier_id", F.col("seq").cast("long"), F.lit("mutation").alias("event"), F.lit(None).cast("string").alias("digest"))
    return pick(switch_commands).unionByName(pick(removals)).unionByName(pick(merges))


def approve(dossiers: DataFrame, digests: DataFrame) -> DataFrame:
    """Pending dossiers become approved with their digest; others stay as they are."""
    ready = (F.col("state") == PENDING) & F.col("digest").isNotNull()
    joined = dossiers.join(digests.select("dossier_id", "digest"), "dossier_id", "left")
    return joined.select("dossier_id", F.when(ready, APPROVED).otherwise(F.col("state")).alias("state"), F.when(ready, F.col("digest")).otherwise(F.col("approval_hash")).alias("approval_hash"))


def export_gate(requests: DataFrame, dossiers: DataFrame, digests: DataFrame) -> DataFrame:
    """Verdict per requested dossier: NOT_FOUND, NOT_ALLOWED (not approved), INTEGRITY (texts changed since) or OK."""
    joined = requests.select("dossier_id").join(dossiers, "dossier_id", "left").join(digests.select("dossier_id", "digest"), "dossier_id", "left")
    verdict = F.when(F.col("state").isNull(), "NOT_FOUND").when(F.col("state") != APPROVED, "NOT_ALLOWED").when(~F.col("approval_hash").eqNullSafe(F.col("digest")), "INTEGRITY").otherwise("OK")
    return joined.select("dossier_id", verdict.alias("verdict"))
