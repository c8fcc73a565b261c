"""The temporal property graph and its entry steps.

nodes: id, host, origin, created_at, updated_at, deleted_at, archived_at (ms), revision, metadata.
edges: the same and parent, child.  Both hold live rows (archived_at null) and superseded revisions.
flows, flow_metrics, raw_packets and sockets are further tables; see ``sources``.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import timeparse

if TYPE_CHECKING:
    from loomgraph.operators.elements import Edges, Nodes
    from loomgraph.operators.flows import Flows


@dataclass(frozen=True)
class Slice:
    """A time slice in ms; a point keeps the highest revision of each element."""

    start: int
    last: int
    point: bool


#: Tables of a graph: a frame, or a function without arguments that gives it when it is first used.
TABLES = frozenset({"nodes", "edges", "flows", "flow_metrics", "raw_packets", "sockets"})


@dataclass
class Graph:
    nodes: DataFrame | Callable[[], DataFrame]
    edges: DataFrame | Callable[[], DataFrame]
    flows: DataFrame | None = None
    flow_metrics: DataFrame | None = None
    raw_packets: DataFrame | None = None
    sockets: DataFrame | None = None
    slice: Slice | None = None
    history: bool = True
    #: Flows count as active this long after their last packet (ms).
    flow_expire: int = 600_000
    saved: dict = field(default_factory=dict)
    #: For stored graphs: gives a table's rows that a slice can need, so that folders of other days aren't read.
    prune: Callable[[str, Slice], DataFrame] | None = None

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if name in TABLES and callable(value):
            value = value()
            object.__setattr__(self, name, value)
        return value

    # entry steps

    def V(self, id: str | None = None) -> "Nodes":
        from loomgraph.operators.elements import Nodes

        nodes = Nodes(self, self._seen(self.nodes))
        if id is None:
            return nodes
        one = nodes.filter(F.col("id") == id)
        if not one.df.take(1):
            raise LookupError(f"no node {id}")
        return one

    def E(self, id: str | None = None) -> "Edges":
        from loomgraph.operators.elements import Edges

        edges = Edges(self, self._seen(self.edges))
        if id is None:
            return edges
        one = edges.filter(F.col("id") == id)
        if not one.df.take(1):
            raise LookupError(f"no edge {id}")
        return one

    def Flows(self, *args) -> "Flows":
        from loomgraph.operators.flows import Flows

        if self.flows is None:
            raise ValueError("the graph has no flows")
        out = Flows(self, self.flows)
        if self.slice is not None:
            out = out.filter((F.col("start") <= self.slice.last) & (F.col("last") >= self.slice.start - self.flow_expire))
        return out.Has(*args) if args else out

    def Context(self, at: str | int, duration: str | int | None = None, now_ms: int | None = None) -> "Graph":
        """The graph at an instant, or over the *duration* before it."""
        if not self.history:
            raise ValueError("the graph has no history")
        last = timeparse.instant_ms(at, int(time.time() * 1000) if now_ms is None else now_ms)
        if duration is None:
            return self._sliced(Slice(last, last, True))
        length = timeparse.length_ms(duration)
        return self._sliced(Slice(0 if length is None else last - length, last, False))

    def _with(self, **changes) -> "Graph":
        """A copy with other values; tables that weren't used yet stay functions, and needn't exist."""
        out = copy.copy(self)
        out.__dict__.update(changes)
        return out

    def _sliced(self, s: Slice) -> "Graph":
        if self.prune is None:
            return self._with(slice=s)
        return self._with(slice=s, **{name: (lambda name=name: self.prune(name, s)) for name in ("nodes", "edges", "flows", "flow_metrics")})

    At = Context

    def _seen(self, rows: DataFrame) -> DataFrame:
        if self.slice is None:
            return rows.filter("archived_at is null")
        s = self.slice
        rows = rows.filter(
            (F.col("created_at") <= s.last) & (F.col("deleted_at").isNull() | (F.col("deleted_at") >= s.start))
            & (F.col("updated_at") <= s.last) & (F.col("archived_at").isNull() | (F.col("archived_at") >= s.start))
        )
        if not s.point:
            return rows
        # partial maxima move one row of an id from each task, not all revisions
        best = F.max_by(F.struct(*rows.columns), F.struct("revision", "updated_at"))
        return rows.groupBy(F.col("id").alias("_id")).agg(best.alias("_row")).select("_row.*")

    def with_elements(self, nodes: DataFrame, edges: DataFrame) -> "Graph":
        """A graph of just these elements."""
        return self._with(nodes=nodes, edges=edges, slice=None)

    def Elements(self) -> DataFrame:
        """All nodes and edges: kind, id."""
        return self.V().df.select(F.lit("node").alias("kind"), "id").unionByName(self.E().df.select(F.lit("edge").alias("kind"), "id"))

    def Diff(self, new: "Graph") -> DataFrame:
        """Elements of the new graph that this one lacks, and the reverse, by id: change, kind, id."""
        ours, theirs = self.Elements(), new.Elements()
        added = theirs.join(ours, ["kind", "id"], "left_anti").withColumn("change", F.lit("added"))
        removed = ours.join(theirs, ["kind", "id"], "left_anti").withColumn("change", F.lit("removed"))
        return added.unionByName(removed).select("change", "kind", "id").distinct()
