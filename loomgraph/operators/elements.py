"""Steps on nodes and edges.

Each step gives a new wrapper of a frame; nothing runs before an action.  Results are bags: a node
that is reached twice is there twice.  Order, where a step needs one, is the last Sort's, else by id
and revision; Limit is a top-k, so no step sorts all rows into one partition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import predicates
from loomgraph.functions.fields import BUILT_IN, Fields
from loomgraph.operators.values import Values

if TYPE_CHECKING:
    from loomgraph.plans.graph import Graph

ASC, DESC = "ASC", "DESC"
DEFAULT_SORT = "CreatedAt"  # a metadata key


def key_columns(fields: Fields, key: str) -> list[Column]:
    """Columns that stand for a key's value when rows are compared; lists and structs by their JSON."""
    found = fields.find(key)
    if found is None:
        return [F.lit(None).cast("string")]
    column, kind = found
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return [F.to_json(F.struct(column.alias("v")))]
    return [column]


@dataclass
class Elements:
    graph: "Graph"
    df: DataFrame
    order: tuple[Column, ...] = ()

    @property
    def fields(self) -> Fields:
        return Fields.of(self.df)

    def _with(self, df: DataFrame, order: tuple[Column, ...] | None = None):
        return replace(self, df=df, order=self.order if order is None else order)

    def _order(self) -> list[Column]:
        return [*self.order, F.col("id"), F.col("revision")]

    def filter(self, condition: Column):
        return self._with(self.df.filter(condition))

    # filters

    def Has(self, *args: Any):
        return self.filter(predicates.has(self.fields, args))

    def HasEither(self, *args: Any):
        return self.filter(predicates.has_either(self.fields, args))

    def HasKey(self, key: str):
        return self.filter(self.fields.present(key))

    def HasNot(self, key: str):
        return self.filter(~self.fields.present(key))

    # order and size

    def Count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def Range(self, start: int, stop: int):
        return self._with(self.df.orderBy(*self._order()).offset(start).limit(max(0, stop - start)))

    def Limit(self, n: int):
        return self.Range(0, n)

    def Dedup(self, *keys: str):
        """One row for each id, or for each tuple of the keys' values; rows with none of the keys all stay."""
        if not keys:
            names = [F.col("id")]
            free = F.lit(False)
        else:
            names = [c for k in keys for c in key_columns(self.fields, k)]
            free = ~predicates.or_(*(self.fields.present(k) for k in keys))
        first = W.partitionBy(*[F.col(f"_k{i}") for i in range(len(names))]).orderBy(*self._order())
        keyed = self.df.withColumns({f"_k{i}": c for i, c in enumerate(names)} | {"_free": free})
        loose, tied = keyed.filter("_free"), keyed.filter("not _free")
        tied = tied.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        out = tied.unionByName(loose) if keys else tied
        return self._with(out.select(*self.df.columns))


@dataclass
class Nodes(Elements):
    # values

    def Values(self, key: str) -> Values:
        """A value for each node that has the key; empty maps and lists are left out."""
        found = self.fields.find(key)
        if found is None:
            return Values(self.df.limit(0).select(F.lit(None).cast("string").alias("value"), F.col("id").alias("_pos")))
        column, kind = found
        rows = self.df.filter(column.isNotNull())
        if isinstance(kind, (T.ArrayType, T.MapType)):
            rows = rows.filter(F.size(column) > 0)
        if isinstance(kind, T.VariantType):
            rows = rows.filter(~F.to_json(column).isin("{}", "[]"))
        return Values(rows.select(column.alias("value"), F.col("id").alias("_pos")))

    def ValueMap(self, *keys: str) -> Values:
        """A map of the keys' values as JSON texts, for nodes that have one of the keys."""
        entries = []
        for k in keys:
            found = self.fields.find(k)
            if found is not None:
                column, kind = found
                text = F.to_json(column) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) else column.cast("string")
                entries += [F.lit(k), text]
        if not entries:
            return Values(self.df.limit(0).select(F.create_map(F.lit(""), F.lit("")).alias("value"), F.col("id").alias("_pos")))
        rows = self.df.select(F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).alias("value"), F.col("id").alias("_pos"))
        return Values(rows.filter(F.size("value") > 0))

    def Keys(self) -> Values:
        """Distinct field names: the built-in ones and the dotted paths of the metadata."""
        kind = self.df.schema["metadata"].dataType
        built_in = F.array(*[F.lit(k) for k in BUILT_IN])
        if isinstance(kind, T.VariantType):
            own = self.df.select(F.explode(built_in).alias("value")).unionByName(_variant_paths(self.df.select("metadata")))
        else:
            paths = list(_struct_paths(kind, F.col("metadata"), ""))
            own = self.df.select(F.explode(F.concat(built_in, F.filter(F.array(*[F.when(c.isNotNull(), F.lit(p)) for p, c in paths]), lambda x: x.isNotNull()))).alias("value"))
        return Values(own.distinct().withColumn("_pos", F.col("value")))

    def Sum(self, key: str) -> DataFrame:
        """Sum of the key's longs; absent values don't count, values that are no numbers are an error."""
        number, there = self.fields.long(key), self.fields.present(key)
        bad = F.raise_error(F.lit(f"{key} isn't a number"))
        return self.df.select(F.when(there & number.isNull(), bad.cast("bigint")).otherwise(number).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sum"))

    def Sort(self, *args: str) -> "Nodes":
        """Sort([ASC | DESC,] key): by long, then by string; an absent value is 0 or the empty text."""
        way, key = (args[0], args[1]) if len(args) == 2 else (ASC, args[0] if args else DEFAULT_SORT)
        columns = [F.coalesce(self.fields.long(key), F.lit(0)), F.coalesce(self.fields.string(key), F.lit(""))]
        order = tuple(c.desc() if way == DESC else c.asc() for c in columns)
        return self._with(self.df.orderBy(*order, "id", "revision"), order)

    # saved sets

    def As(self, name: str) -> "Nodes":
        self.graph.saved[name] = self.df
        return self

    def Select(self, *names: str) -> "Nodes":
        """The saved sets, one after another."""
        out = self.graph.saved[names[0]]
        for name in names[1:]:
            out = out.unionByName(self.graph.saved[name])
        return Nodes(self.graph, out)

    def G(self) -> "Graph":
        return self.graph

    # adjacency: equi-joins on ids

    def _hop(self, here: str, there: str) -> DataFrame:
        """Nodes at the edges' other end, one row for each edge."""
        edges = self.graph.E().df.select(F.col(here).alias("_here"), F.col(there).alias("_there"))
        ends = self.df.select(F.col("id").alias("_here")).join(edges, "_here").select("_there")
        nodes = self.graph.V().df
        return nodes.join(ends, nodes["id"] == ends["_there"]).select(*nodes.columns)

    def Out(self, *args: Any) -> "Nodes":
        return Nodes(self.graph, self._hop("parent", "child"))._maybe(args)

    def In(self, *args: Any) -> "Nodes":
        return Nodes(self.graph, self._hop("child", "parent"))._maybe(args)

    def Both(self, *args: Any) -> "Nodes":
        """The other end of every incident edge; an edge from a node to itself counts once."""
        edges = self.graph.E().df.select("parent", "child")
        ends = edges.select(F.col("child").alias("_here"), F.col("parent").alias("_there")).unionByName(
            edges.filter("parent <> child").select(F.col("parent").alias("_here"), F.col("child").alias("_there")))
        ends = self.df.select(F.col("id").alias("_here")).join(ends, "_here").select("_there")
        nodes = self.graph.V().df
        return Nodes(self.graph, nodes.join(ends, nodes["id"] == ends["_there"]).select(*nodes.columns))._maybe(args)

    def _maybe(self, args: tuple):
        return self.Has(*args) if args else self

    def _incident(self, *ends: str) -> "Edges":
        """Incident edges; an edge from a node to itself counts once for the node."""
        edges = self.graph.E().df
        ids = self.df.select(F.col("id").alias("_here"))
        parts = []
        for i, end in enumerate(ends):
            own = edges if i == 0 else edges.filter("parent <> child")
            parts.append(own.join(ids, own[end] == ids["_here"]).select(*edges.columns))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return Edges(self.graph, out)

    def OutE(self, *args: Any) -> "Edges":
        return self._incident("parent")._maybe(args)

    def InE(self, *args: Any) -> "Edges":
        return self._incident("child")._maybe(args)

    def BothE(self, *args: Any) -> "Edges":
        return self._incident("parent", "child")._maybe(args)

    # sub-graphs and paths

    def SubGraph(self, *args: Any) -> "Graph":
        """These nodes, and the edges with both ends among them."""
        edges = self.graph.E()._maybe(args).df
        ids = self.df.select("id").distinct()
        for end in ("parent", "child"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return self.graph.with_elements(self.Dedup().df, edges.select(*self.graph.edges.columns))

    def Descendants(self, *args: Any) -> "Nodes":
        from loomgraph.operators import paths

        return paths.reach(self, args, down=True)

    def Ascendants(self, *args: Any) -> "Nodes":
        from loomgraph.operators import paths

        return paths.reach(self, args, down=False)

    def Neighbors(self, *args: Any) -> "Nodes":
        from loomgraph.operators import paths

        return paths.neighbors(self, args)

    def ShortestPathTo(self, target: dict, edge: dict | None = None):
        from loomgraph.operators import paths

        return paths.shortest(self, target, edge or {})

    # flows, metrics, sockets, routes

    def Flows(self, *args: Any):
        from loomgraph.operators import flows

        return flows.of_nodes(self, args)

    def Metrics(self, field: str = "LastUpdateMetric"):
        from loomgraph.operators import metrics

        return metrics.of_nodes(self, field)

    def Sockets(self):
        from loomgraph.operators import sockets

        return sockets.of_nodes(self)

    def NextHop(self, ip: str) -> DataFrame:
        from loomgraph.operators import nexthop

        return nexthop.next_hop(self, ip)


@dataclass
class Edges(Elements):
    @property
    def fields(self) -> Fields:
        return Fields.of(self.df, roots={"Parent": "parent", "Child": "child"}, lists=False)

    def _maybe(self, args: tuple) -> "Edges":
        return self.Has(*args) if args else self

    def _ends(self, *ends: str) -> DataFrame:
        nodes = self.graph.V().df
        ids = self.df.select(F.col(ends[0]).alias("_there"))
        for end in ends[1:]:
            ids = ids.unionByName(self.df.select(F.col(end).alias("_there")))
        return nodes.join(ids, nodes["id"] == ids["_there"]).select(*nodes.columns)

    def InV(self, *args: Any) -> Nodes:
        """The parents."""
        return Nodes(self.graph, self._ends("parent"))._maybe(args)

    def OutV(self, *args: Any) -> Nodes:
        """The children."""
        return Nodes(self.graph, self._ends("child"))._maybe(args)

    def BothV(self, *args: Any) -> Nodes:
        return Nodes(self.graph, self._ends("parent", "child"))._maybe(args)

    def SubGraph(self) -> "Graph":
        """These edges and their end nodes."""
        return self.graph.with_elements(self.BothV().Dedup().df, self.Dedup().df)

    def G(self) -> "Graph":
        return self.graph


def _struct_paths(kind: T.StructType, column: Column, before: str):
    for f in kind.fields:
        yield before + f.name, column[f.name]
        if isinstance(f.dataType, T.StructType):
            yield from _struct_paths(f.dataType, column[f.name], before + f.name + ".")


def _variant_paths(rows: DataFrame) -> DataFrame:
    """Dotted paths (value) of the objects in a VARIANT column, level by level: the keys of open metadata are known to no schema."""
    spark, out = rows.sparkSession, None
    level = rows.select(F.lit("").alias("_before"), F.col("metadata").alias("_v"))
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).filter("key is not null")
        inner = inner.select(F.concat("_before", "key").alias("value"), F.col("value").alias("_v"))
        out = inner.select("value") if out is None else out.unionByName(inner.select("value"))
        level = inner.filter(F.schema_of_variant("_v").startswith("OBJECT")).select(F.concat("value", F.lit(".")).alias("_before"), "_v")
        if not level.take(1):
            return out
