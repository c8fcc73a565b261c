"""Incremental indexes and linkers: node changes become additions and removals of edges.

Two states follow each other.  The first is keyed by node and holds its keys, so that a change becomes what the node gains and
loses.  The second is keyed by the key and holds the ids on its left and on its right side; a gain is joined to the other side's
ids, which are read one after another from the state store, and gives edges to add, a loss edges to remove.  A micro-batch's work is its changes and
their edges, whatever the size of the graph; after each one the edges are those that ``linkers.link`` makes of the whole graph.

Actions wait for a key: they are told with the node of the smallest id that has the key on its left side, at once or when one first comes, once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEFT, RIGHT, ACTION = "left", "right", "action"
DELTAS = "key string, side string, id string, gained boolean"
#: op (add, delete, act), key, parent, child; of act the action and the node.
EDGES = "op string, key string, parent string, child string"


def key_of(*values: Column) -> Column:
    """One key of a tuple of values; null if any of them is."""
    return F.when(F.greatest(*[v.isNull().cast("int") for v in values], F.lit(0)) == 0, F.to_json(F.array(*[v.cast("string") for v in values])))


class NodeProcessor(StatefulProcessor):
    """State of a node: its keys on either side."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("keys", "left_keys array<string>, right_keys array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = [set(x or ()) for x in self.held.get()] if self.held.exists() else [set(), set()]
        last = max((r for frame in rows for r in frame[["at", "place", "op", "left_keys", "right_keys"]].itertuples(index=False, name=None)), key=lambda r: r[:2])
        new = [{k for k in (() if last[2] == "delete" or x is None else x) if k is not None} for x in last[3:]]
        if any(new):
            self.held.update((sorted(new[0]), sorted(new[1])))
        else:
            self.held.clear()
        out = [(k, side, key[0], k in b) for side, a, b in zip((LEFT, RIGHT), old, new) for k in sorted(a ^ b)]
        yield pd.DataFrame(out, columns=["key", "side", "id", "gained"])

    def close(self) -> None:
        pass


class KeyProcessor(StatefulProcessor):
    """State of a key: the ids on either side, and actions that wait for one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {side: handle.getMapState(side, "id string", "there boolean") for side in (LEFT, RIGHT, ACTION)}

    def ids(self, side: str) -> Iterator[str]:
        state = self.sides[side]
        return (k[0] for k in state.keys()) if state.exists() else iter(())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        deltas = sorted((r for frame in rows for r in frame[["gained", "side", "id"]].itertuples(index=False, name=None)), key=lambda r: (r[1] == ACTION, r))
        out: list[tuple] = []
        for gained, side, id in deltas:  # losses first; each delta meets the other side as it is by then
            if side == ACTION:
                self.sides[ACTION].updateValue((id,), (True,))
                continue
            other = RIGHT if side == LEFT else LEFT
            if gained:
                self.sides[side].updateValue((id,), (True,))
            else:
                self.sides[side].removeKey((id,))
            for met in self.ids(other):
                if met != id:
                    out.append(("add" if gained else "delete", key[0], *((id, met) if side == LEFT else (met, id))))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["op", "key", "parent", "child"])
                out = []
        node = min(self.ids(LEFT), default=None)
        if node is not None:
            for action in sorted(self.ids(ACTION)):
                out.append(("act", key[0], action, node))
                self.sides[ACTION].removeKey((action,))
        yield pd.DataFrame(out, columns=["op", "key", "parent", "child"])

    def close(self) -> None:
        pass


def deltas(changes: DataFrame, left: Column, right: Column) -> DataFrame:
    """What nodes gain and lose (DELTAS), of a stream of node changes (op, id, at, and seq or revision).

    *left*, *right*: arrays of keys (see :func:`key_of`) from a change's columns.  Of several changes of a node in one micro-batch the last one counts.
    """
    place = F.col("seq") if "seq" in changes.columns else F.col("revision")
    rows = changes.filter("id is not null").select("id", "op", "at", place.cast("long").alias("place"), left.cast("array<string>").alias("left_keys"), right.cast("array<string>").alias("right_keys"))
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=NodeProcessor(), outputStructType=DELTAS, outputMode="Append", timeMode="None")


def edges(gained_and_lost: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Additions and removals of edges (EDGES) of a stream of deltas; *actions* are rows (key, id) that wait for a node."""
    rows = gained_and_lost.select("key", "side", "id", "gained")
    if actions is not None:
        rows = rows.unionByName(actions.select("key", F.lit(ACTION).alias("side"), "id", F.lit(True).alias("gained")))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=KeyProcessor(), outputStructType=EDGES, outputMode="Append", timeMode="None")


def linked(changes: DataFrame, left: Column, right: Column) -> DataFrame:
    """Additions and removals of edges of a stream of node changes; the state store must be RocksDB."""
    return edges(deltas(changes, left, right))


def live(log: DataFrame) -> DataFrame:
    """The pairs (parent, child) that are linked after a whole log of additions and removals, by whatever key."""
    sign = F.when(F.col("op") == "add", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return log.groupBy("key", "parent", "child").agg(F.sum(sign).alias("n")).filter("n > 0").select("parent", "child").distinct()
