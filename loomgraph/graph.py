"""The property graph: vertices, edges and embeddings as DataFrames, and what changes or describes them.

A graph is a mutable catalogue of immutable DataFrames.  A change binds a new frame, so a plan made before it still reads what it read.
Ids are longs given out in order; a missing property is null.  Labels, ids and ends are the reserved columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import written

if TYPE_CHECKING:
    from .traversal import Source

VERTEX_COLUMNS, EDGE_COLUMNS = ("id", "label"), ("id", "src", "dst", "label")
VERTEX_SCHEMA, EDGE_SCHEMA = "id long, label string", "id long, src long, dst long, label string"
#: Leaves of a plan above which a changed frame is written and read again: a value that a child computes reads the graph several times, so
#: plans would grow by a factor with each change.
CUT_LEAVES = 40
#: Ids with new values, given as a sequence, that are broadcast at most.
BROADCAST_IDS = 100_000

#: Array type names that callers may use instead of Spark's (fixed values).
ARRAY_TYPES = {"int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}


def spark_type(dtype: str | T.DataType) -> str | T.DataType:
    return ARRAY_TYPES.get(dtype, dtype) if isinstance(dtype, str) else dtype


class PropertyGraph:
    """``vertices``: id, label, properties.  ``edges``: id, src, dst, label, properties.  ``embeddings``: name to (id, vec).

    Edges whose ids are dear may come as a function, called when ids or properties are first asked for; ``links``, their src, dst and label, serve till then.
    """

    def __init__(self, spark: SparkSession, vertices: DataFrame | None = None, edges: DataFrame | Callable[[], DataFrame] | None = None, embeddings: dict[str, DataFrame] | None = None, links: DataFrame | None = None):
        self.spark = spark
        self.vertices = vertices if vertices is not None else spark.createDataFrame([], VERTEX_SCHEMA)
        self._edges = edges if edges is not None else spark.createDataFrame([], EDGE_SCHEMA)
        self._links = links
        self.embeddings, self.indexes = dict(embeddings or {}), {}
        for df, needed in ((self.vertices, VERTEX_COLUMNS), *([(self._edges, EDGE_COLUMNS)] if isinstance(self._edges, DataFrame) else [])):
            if missing := set(needed) - set(df.columns):
                raise ValueError(f"columns are missing: {sorted(missing)}")
        self._next: dict[str, int] = {}

    @property
    def edges(self) -> DataFrame:
        if not isinstance(self._edges, DataFrame):
            self._edges = self._edges()
        return self._edges

    @edges.setter
    def edges(self, df: DataFrame) -> None:
        self._edges, self._links = df, None

    @property
    def links(self) -> DataFrame:
        """``src, dst, label`` of each edge."""
        return self._links if self._links is not None else self.edges.select("src", "dst", "label")

    # -- reading

    def traversal(self) -> Source:
        from .traversal import Source

        return Source(self)

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def vertex_property_names(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in VERTEX_COLUMNS]

    def edge_property_names(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_COLUMNS]

    def types(self) -> dict[str, T.DataType]:
        """Types of ids, labels and all properties."""
        return {f"vertex.{f.name}": f.dataType for f in self.vertices.schema} | {f"edge.{f.name}": f.dataType for f in self.edges.schema}

    def _of(self, what: str) -> DataFrame:
        return self.vertices if what == "vertices" else self.edges

    def _checked(self, what: str, name: str) -> DataFrame:
        df = self._of(what)
        if name not in (self.vertex_property_names() if what == "vertices" else self.edge_property_names()):
            raise ValueError(f"{what} have no property {name!r}")
        return df

    def _ids(self, ids: DataFrame | Sequence[int]) -> DataFrame:
        """Ids with their place: a DataFrame's one column as it comes (no order is promised), a sequence in its order."""
        if isinstance(ids, DataFrame):
            return ids.toDF("id").select("id", F.monotonically_increasing_id().alias("place"))
        # From Arrow it is a relation in the plan whose size Catalyst knows, so a short one is broadcast and the other side isn't dealt.
        return self.spark.createDataFrame(pa.table({"id": np.array([int(i) for i in ids], np.int64), "place": np.arange(len(ids))}))

    def _property(self, what: str, name: str, ids: DataFrame | Sequence[int]) -> DataFrame:
        own = self._checked(what, name).where(F.col(name).isNotNull()).select("id", F.col(name).alias("value"))
        return self._ids(ids).join(own, "id").select("place", "id", "value")

    def get_vertex_properties(self, name: str, ids: DataFrame | Sequence[int]) -> DataFrame:
        """``place, id, value`` of those ids that have the property."""
        return self._property("vertices", name, ids)

    def get_edge_properties(self, name: str, ids: DataFrame | Sequence[int]) -> DataFrame:
        return self._property("edges", name, ids)

    def view_vertex_property(self, name: str) -> DataFrame:
        """``id, value`` of all that have it."""
        return self._checked("vertices", name).where(F.col(name).isNotNull()).select("id", F.col(name).alias("value"))

    def view_edge_property(self, name: str) -> DataFrame:
        return self._checked("edges", name).where(F.col(name).isNotNull()).select("id", F.col(name).alias("value"))

    def vertex_property_entries(self, name: str) -> int:
        return self.view_vertex_property(name).count()

    def edge_property_entries(self, name: str) -> int:
        return self.view_edge_property(name).count()

    def vertex_labels(self, ids: DataFrame | Sequence[int]) -> DataFrame:
        return self._ids(ids).join(self.vertices.select("id", "label"), "id").select("place", "id", "label")

    def edge_labels(self, ids: DataFrame | Sequence[int]) -> DataFrame:
        return self._ids(ids).join(self.edges.select("id", "label"), "id").select("place", "id", "label")

    def embedding(self, name: str) -> DataFrame:
        if name not in self.embeddings:
            raise ValueError(f"there is no embedding {name!r}")
        return self.embeddings[name]

    def get_vertex_embeddings(self, name: str, ids: DataFrame | Sequence[int]) -> DataFrame:
        return self._ids(ids).join(self.embedding(name), "id").select("place", "id", "vec")

    def dangling_edges(self) -> DataFrame:
        """Edges with an end that is no vertex."""
        v = self.vertices.select(F.col("id").alias("v"))
        return self.edges.join(v, F.col("src") == F.col("v"), "left_anti").unionByName(self.edges.join(v, F.col("dst") == F.col("v"), "left_anti")).dropDuplicates(["id"])

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> PropertyGraph:
        self.vertices, self.edges = self.vertices.persist(level), self.edges.persist(level)
        return self

    # -- changing

    def _bind(self, what: str, df: DataFrame) -> None:
        if df._jdf.queryExecution().analyzed().collectLeaves().size() > CUT_LEAVES:
            df = written(df, what)
        setattr(self, what, df)

    def _first(self, what: str) -> int:
        """The next id; asked of the data once, then counted."""
        if what not in self._next:
            top = self._of(what).agg(F.max("id")).first()[0]
            self._next[what] = 0 if top is None else top + 1
        return self._next[what]

    def add_vertex(self, label: str = "") -> int:
        return self.add_vertices(1, label)[0]

    def add_vertices(self, n: int, label: str = "") -> range:
        """``n`` vertices of one label; their ids."""
        first = self._first("vertices")
        if n:
            new = self.spark.range(first, first + n).select("id", F.lit(label).alias("label"))
            self._bind("vertices", self.vertices.unionByName(new, allowMissingColumns=True))
            self._next["vertices"] = first + n
        return range(first, first + n)

    def add_edge(self, src: int, dst: int, label: str) -> int:
        ids = self.add_edges([src], [dst], label)
        if len(ids) != 1:
            raise ValueError("not one edge was added")
        return ids[0]

    def add_edges(self, src: Sequence[int] | DataFrame, dst: Sequence[int] | None = None, label: str = "") -> range:
        """Edges of one label from sequences of equal length, or from a DataFrame of source and destination; their ids.

        Parallel edges and loops are edges like others.  A DataFrame's edges are numbered by a hash order, in parallel and the same each time.
        """
        first = self._first("edges")
        if isinstance(src, DataFrame):
            pairs = src.toDF("src", "dst")
            new = numbered(pairs, "id", F.xxhash64("src", "dst"), F.col("src"), F.col("dst")).withColumn("id", F.col("id") + first)
            new = written(new, "edges")
            n = new.count()
        else:
            if len(src) != len(dst):
                raise ValueError("as many destinations as sources are needed")
            n = len(src)
            ends = {k: np.asarray(x, np.int64) for k, x in (("src", src), ("dst", dst))}
            new = self.spark.createDataFrame(pa.table({"id": np.arange(first, first + n), **ends}))
        if n:
            self._bind("edges", self.edges.unionByName(new.withColumn("label", F.lit(label)), allowMissingColumns=True))
            self._next["edges"] = first + n
        return range(first, first + n)

    def _declare(self, what: str, name: str, dtype: str | T.DataType) -> None:
        df = self._of(what)
        if name in df.columns:
            raise ValueError(f"{what} have {name!r} already")
        self._bind(what, df.withColumn(name, F.lit(None).cast(spark_type(dtype))))

    def declare_vertex_property(self, name: str, dtype: str | T.DataType) -> None:
        self._declare("vertices", name, dtype)

    def declare_edge_property(self, name: str, dtype: str | T.DataType) -> None:
        self._declare("edges", name, dtype)

    def _set(self, what: str, name: str, ids: Any, values: Any, dtype: str | None) -> None:
        df, dtype = self._of(what), dtype and spark_type(dtype)
        if name in (VERTEX_COLUMNS if what == "vertices" else EDGE_COLUMNS):
            raise ValueError(f"{name!r} is reserved")
        if isinstance(ids, DataFrame):
            new = ids.toDF("of", "new")
            if dict(new.dtypes)["of"] not in ("bigint", "int", "smallint", "tinyint"):
                raise ValueError("ids are whole numbers")
            new = new.groupBy("of").agg(F.max("new").alias("new"))  # one value an id, the same each time
        else:
            if len(ids) != len(values):
                raise ValueError("as many values as ids are needed")
            last = {int(i): v for i, v in zip(ids, values, strict=True)}  # the last write wins
            if not last:
                return
            sample = next((v for v in last.values() if v is not None), None)
            kind = dtype or {bool: "boolean", int: "long", float: "double", str: "string"}.get(type(sample)) or self.spark.createDataFrame([(sample,)], ["x"]).schema["x"].dataType.simpleString()
            new = self.spark.createDataFrame(list(last.items()), f"of long, new {kind}")
            if len(last) <= BROADCAST_IDS:
                new = F.broadcast(new)
        if dtype:
            new = new.withColumn("new", F.col("new").cast(dtype))
        new = new.withColumn("hit", F.lit(True))
        both = df.join(new, df["id"] == new["of"], "left")
        if name in df.columns:
            value = F.when(F.col("hit"), F.col("new").cast(df.schema[name].dataType)).otherwise(df[name])
        else:
            value = F.col("new")
        self._bind(what, both.select(*[df[c] for c in df.columns if c != name], value.alias(name)))

    def set_vertex_properties(self, name: str, ids: Sequence[int] | DataFrame, values: Sequence | None = None, dtype: str | None = None) -> None:
        """Upsert by id: sequences of ids and values, or a DataFrame of both.  The first write fixes the type; unknown ids are ignored."""
        self._set("vertices", name, ids, values, dtype)

    def set_edge_properties(self, name: str, ids: Sequence[int] | DataFrame, values: Sequence | None = None, dtype: str | None = None) -> None:
        self._set("edges", name, ids, values, dtype)

    def set_vertex_embeddings(self, name: str, ids: Sequence[int] | DataFrame, vectors: Sequence[Sequence[float]] | None = None, default: float = 0.0) -> None:
        """No ids: the vectors of vertices 0, 1, ... replace the embedding.  Else upsert; on first use all other vertices get ``default``s."""
        if not isinstance(ids, DataFrame):
            if len(ids) and len(ids) != len(vectors):
                raise ValueError("as many vectors as ids are needed")
            x = np.asarray(vectors, np.float32).reshape(len(vectors), -1 if len(vectors) else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            new = self.spark.createDataFrame(pa.table({"id": np.asarray(ids if len(ids) else range(len(x)), np.int64), "vec": lists}))
            if not len(ids):
                self.embeddings[name] = new
                return
        else:
            new = ids.toDF("id", "vec").select("id", F.col("vec").cast("array<float>").alias("vec"))
        new = new.groupBy("id").agg(F.max("vec").alias("vec"))
        if name in self.embeddings:
            old = self.embeddings[name].join(new.select("id"), "id", "left_anti")
            self.embeddings[name] = old.unionByName(new)
        else:
            width = new.select(F.size("vec").alias("n")).limit(1)
            rest = self.vertices.select("id").join(new.select("id"), "id", "left_anti").join(F.broadcast(width))
            self.embeddings[name] = new.unionByName(rest.select("id", F.array_repeat(F.lit(default).cast("float"), F.col("n")).alias("vec")))
        self.indexes.pop(name, None)

    def set_vertex_embeddings_range(self, name: str, first: int, last: int, vectors: Sequence[Sequence[float]], default: float = 0.0) -> None:
        """Of vertices ``first`` to ``last``, both included."""
        if last - first + 1 != len(vectors):
            raise ValueError("the range and the vectors differ in size")
        self.set_vertex_embeddings(name, range(first, last + 1), vectors, default)

    def make_vertex_embedding_index(self, name: str, cells: int | None = None, seed: int = 1) -> None:
        """Coarse cells for approximate search, fitted to a bounded sample; every vector is in a cell."""
        from .operators.vector import CellIndex

        self.indexes[name] = CellIndex.fit(self.embedding(name), cells, seed)

    # -- subgraphs

    def subgraph_coo(self, edges: DataFrame | Sequence[int]) -> tuple[DataFrame, DataFrame]:
        from .operators.subgraph import coo

        return coo(self, self._ids(edges).select("id"))

    def subgraph(self, edges: DataFrame | Sequence[int]) -> PropertyGraph:
        from .operators.subgraph import subgraph

        return subgraph(self, self._ids(edges).select("id"))

    def degree(self, labels: Sequence[str] = (), direction: str = "out", of: DataFrame | None = None) -> DataFrame:
        from .operators.expand import degree

        return degree(self, labels, direction, of)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with 0, 1, 2, ... by ``order``, without one task that sorts all: ranges are sorted apart, then shifted by the counts before them.

    The driver gets one count a range.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    dealt = written(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "numbered")
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*keys)).cast("long"))
    sizes = dealt.groupBy("_range").count()
    before = sizes.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_range").withColumn(name, F.col(name) - 1 + F.col("_before")).drop("_range", "_before", *keys)
