"""A versioned operation log as a stream: contiguous versions apply in order, gaps wait, echoes are acknowledged."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ready_for_python

#: Limits of the gap buffer and of remembered acknowledgements.
MOST_PENDING, MOST_DISTANCE, MOST_ACKS = 256, 1024, 4096
OUTPUT = "doc string, version long, mutation_id string, op string, status string"
STATE = "version long, versions array<bigint>, mutations array<string>, ops array<string>, acks array<string>"


def advance(version: int, pending: dict[int, tuple[str, str]], acks: list[str], incoming: list[tuple[int, str, str]]) -> tuple[int, list[tuple]]:
    """Take in operations of one document: rows (version, mutation, op, status); pending and acks change in place.

    applied: the next version, now or after its gap closed. echo: a mutation seen before. stale: an older version of
    an unknown mutation. reload: too far ahead or too many waiting; the document has to be fetched anew.
    """
    out: list[tuple] = []
    known = Counter(acks)
    for v, mutation, op in incoming:
        if mutation in known:
            out.append((v, mutation, op, "echo"))
            continue
        if v <= version:
            out.append((v, mutation, op, "stale"))
            continue
        if v > version + 1:
            if v in pending:
                out.append((v, mutation, op, "echo"))
            elif len(pending) >= MOST_PENDING or v - version > MOST_DISTANCE:
                out.append((v, mutation, op, "reload"))
            else:
                pending[v] = (mutation, op)
            continue
        pending[v] = (mutation, op)
        while version + 1 in pending:
            version += 1
            m, o = pending.pop(version)
            out.append((version, m, o, "applied"))
            acks.append(m)
            known[m] += 1
        for m in acks[:-MOST_ACKS]:
            known[m] -= 1
            if not known[m]:
                del known[m]
        del acks[:-MOST_ACKS]
    return version, out


def apply_stream(ops: DataFrame) -> DataFrame:
    """ops: streaming (doc, version, mutation_id, op). Keyed state per document; versions start at 1."""
    ready_for_python(ops.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, vs, ms, os_, acks = state.get if state.exists else (0, [], [], [], [])
        pending, acks = dict(zip(vs, zip(ms, os_))), list(acks)
        rows: list[tuple] = []
        for b in batches:
            version, out = advance(version, pending, acks, list(zip(b.version, b.mutation_id, b.op)))
            rows += out
        waiting = sorted(pending)
        state.update((version, waiting, [pending[v][0] for v in waiting], [pending[v][1] for v in waiting], acks))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["doc", "version", "mutation_id", "op", "status"])

    return ops.groupBy("doc").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def applied_batch(ops: DataFrame) -> DataFrame:
    """The same log at rest: per document the contiguous versions from 1, each by its first mutation (least id)."""
    first = ops.groupBy("doc", "version").agg(F.min(F.struct("mutation_id", "op")).alias("m"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("version"))
    return first.where("version >= 1").withColumn("n", n).where("n = version").select("doc", "version", "m.mutation_id", "m.op")


def completed(out: DataFrame, ops: DataFrame) -> DataFrame:
    """The applied rows of a drained `apply_stream`, and for documents with a reload what the log at rest adds.

    out: (doc, version, mutation_id, op, status); ops: the same log at rest. Rows that the stream applied stay as they are.
    """
    applied = out.where("status = 'applied'").select("doc", "version", "mutation_id", "op")
    behind = out.where("status = 'reload'").select("doc").distinct()
    anew = applied_batch(ops.join(behind, "doc", "left_semi")).join(applied.select("doc", "version"), ["doc", "version"], "left_anti")
    return applied.unionByName(anew.select("doc", "version", "mutation_id", "op"))


def rebase(position: Column, edits: list[tuple[str, int, int]]) -> Column:
    """`rebase_index` of a column of positions; null where the row was removed."""
    for kind, at, count in edits:
        if kind == "insert":
            position = F.when(position >= at, position + count).otherwise(position)
        else:
            position = F.when(position >= at + count, position - count).when(position < at, position)
    return position


def rebase_index(index: int, edits: list[tuple[str, int, int]]) -> int | None:
    """Where a row lies after other writers' edits (insert or remove, position, count); None if it was removed."""
    for kind, at, count in edits:
        if kind == "insert":
            index += count if index >= at else 0
        elif at <= index < at + count:
            return None
        elif index >= at + count:
            index -= count
    return index
