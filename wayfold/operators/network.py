"""A weighted network over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.units import to_cost


class Network:
    """Nodes ``(node_id, x, y)`` and edges ``(from, to, <impedances>...)``; immutable.

    Node ids are bigint or string, the same type in both tables. Each impedance is a graph of its own over
    the same nodes. With ``twoway`` (the default) an edge may be travelled both ways. Edges with a null
    or unknown end are left out; a weight that is null, NaN or negative raises when the graph is read,
    unless ``drop_invalid`` is set, which leaves such edges out. Other columns may have any names.
    Ties between nodes go to the smaller id.
    """

    def __init__(
        self, nodes: DataFrame, edges: DataFrame, impedances: Sequence[str] | None = None, twoway: bool = True, drop_invalid: bool = False
    ):
        missing = {"node_id", "x", "y"} - set(nodes.columns) or {"from", "to"} - set(edges.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        names = list(impedances) if impedances is not None else [c for c in edges.columns if c not in ("from", "to")]
        if not names or set(names) - set(edges.columns):
            raise ValueError("impedances must name columns of the edges")
        self.nodes_df = nodes.select("node_id", F.col("x").cast("double"), F.col("y").cast("double"))
        self.edges_df = edges.select("from", "to", *[F.col(f"`{c}`") for c in names])
        self.impedance_names = tuple(names)
        self.twoway = twoway
        self.drop_invalid = drop_invalid
        #: Broadcast graphs by impedance and direction, filled by the reach operators.
        self.graphs: dict = {}
        #: Tiles of the graph by impedance and direction, filled likewise.
        self.tiles: dict = {}
        self._arcs: dict[str, DataFrame] = {}

    @property
    def spark(self):
        return self.nodes_df.sparkSession

    @property
    def node_ids(self) -> DataFrame:
        """Distinct node ids."""
        return self.nodes_df.select("node_id").where(F.col("node_id").isNotNull()).distinct()

    @property
    def id_type(self) -> str:
        return self.nodes_df.schema["node_id"].dataType.simpleString()

    @property
    def bbox(self) -> DataFrame:
        """One row ``xmin, ymin, xmax, ymax``."""
        return self.nodes_df.agg(
            F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")
        )

    def impedance(self, name: str | None = None) -> str:
        """The impedance to use; may be left out only where there is one."""
        if name is None:
            if len(self.impedance_names) > 1:
                raise ValueError(f"name one of the impedances {self.impedance_names}")
            return self.impedance_names[0]
        if name not in self.impedance_names:
            raise ValueError(f"unknown impedance {name!r}; known are {self.impedance_names}")
        return name

    def all_arcs(self, impedance: str | None = None) -> DataFrame:
        """``arcs`` before those at unknown nodes are left out."""
        weight = F.col(f"`{self.impedance(impedance)}`").cast("double")
        edges = self.edges_df.select(F.col("from").alias("src"), F.col("to").alias("dst"), weight.alias("w")).where(
            F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))
        )
        if self.drop_invalid:
            edges = edges.where(F.col("w").isNotNull() & ~F.isnan("w") & (F.col("w") >= 0))
        if self.twoway:
            ways: Column = F.inline(
                F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
            )
            edges = edges.select(ways, "w")
        return edges.groupBy("src", "dst").agg(F.min(to_cost(F.col("w"))).alias("cost"))

    def arcs(self, impedance: str | None = None) -> DataFrame:
        """The directed graph ``(src, dst, cost)`` of an impedance, cost in thousandths.

        Self loops are dropped; of parallel arcs the cheapest stays; a zero weight costs one thousandth.
        """
        name = self.impedance(impedance)
        if name not in self._arcs:
            ids = self.node_ids
            self._arcs[name] = (
                self.all_arcs(name)
                .join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
                .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
                .select("src", "dst", "cost")
            )
        return self._arcs[name]

    def remove_nodes(self, ids: DataFrame) -> Network:
        """The network without the ``node_id`` in ``ids`` and without the edges that touch them."""
        gone = ids.select("node_id").distinct()
        edges = self.edges_df.join(gone.withColumnRenamed("node_id", "from"), "from", "left_anti").join(
            gone.withColumnRenamed("node_id", "to"), "to", "left_anti"
        )
        return Network(
            self.nodes_df.join(gone, "node_id", "left_anti"), edges, self.impedance_names, self.twoway, self.drop_invalid
        )
