"""From steps to a DataFrame.

A traverser is a row: ``cur``, the current id or value; ``t_x``, tags; ``m_x``, saved values; ``e_x``, columns of the current element where a scan or
join has read them anyway (Catalyst drops those that nobody uses).  What kind ``cur`` is, is known while compiling, so a step on the wrong
kind fails before anything runs.  Children of by() and property() run once for each distinct traverser they can tell apart (``root``), are
reduced by it, and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import constant, score
from ..operators.expand import copies, half_edges, zero
from ..storage import Rounds, written
from . import steps as S

VERTEX, EDGE, VALUE = "vertex", "edge", "value"
#: Rows that the driver may hold as part of a plan.
LOCAL = 1000


@dataclass
class Frame:
    df: DataFrame
    kind: str
    tags: dict[str, str] = field(default_factory=dict)
    keys: tuple[str, ...] = ()
    loaded: bool = False
    root: bool = False
    effects: bool = False
    bulk: bool = False
    #: A scan or a table, no more to compute twice than to write.
    cheap: bool = False
    #: How many rows there are at most, where a limit says so.
    most: int | None = None
    #: Comes from at most ``LOCAL`` traversers, so it is likely small, which only its table shows.
    few: bool = False
    #: With ``path``: where the traverser has been, edges as the complement of their id.
    path: bool = False

    def column(self, name: str) -> Column:
        if name == "cur":
            return F.col("cur")
        if name in self.tags:
            return F.col(f"t_{name}")
        if name in self.keys:
            return F.col(f"m_{name}")
        raise ValueError(f"no tag or saved value {name!r}")

    def kept(self) -> list[str]:
        """Columns that go along: the root, the path, tags, saved values."""
        return [*["root"] * self.root, *["path"] * self.path, *(f"t_{t}" for t in self.tags), *(f"m_{k}" for k in self.keys)]

    def bare(self) -> Frame:
        """Without the element's columns."""
        return replace(self, df=self.df.select("cur", *self.kept()), loaded=False) if self.loaded else self


class Compiler:
    def __init__(self, graph: Any, traversal: Any):
        self.graph, self.traversal, self.effects, self.tracks = graph, traversal, False, False

    # -- chains

    def run(self, chain: S.Chain, frame: Frame | None) -> Frame:
        for k, step in enumerate(chain):
            if frame is None and not isinstance(step, (S.Scan, S.AddVertex, S.AddEdge)):
                raise ValueError(f"{step} can't begin a traversal")
            if isinstance(step, S.Limit) and k and isinstance(chain[k - 1], S.Order):
                continue  # taken with the order
            if isinstance(step, S.Order):
                follow = chain[k + 1] if k + 1 < len(chain) and isinstance(chain[k + 1], S.Limit) else None
                frame = self.bounded(follow or step, self.order(step, follow.n if follow else None, frame))
                continue
            frame = getattr(self, {"Is": "is_"}.get(type(step).__name__, type(step).__name__.lower()))(step, frame)
            if self.tracks and isinstance(step, (S.Scan, S.MidScan, S.Expand, S.Ends)) and not frame.root:
                frame = self.moved(frame)
            frame = self.bounded(step, frame)
        return frame

    @staticmethod
    def bounded(step: S.Step, frame: Frame) -> Frame:
        """What is known of the frame's size and cost after a step."""
        keeps = isinstance(step, (S.Has, S.HasNot, S.Where, S.Is, S.FilterChild, S.Dedup, S.Tag, S.Identity, S.Id, S.Order, S.SimplePath))
        limit = None if frame.root else step.n if isinstance(step, (S.Limit, S.Sample)) else step.k if isinstance(step, S.Like) else None
        if isinstance(step, S.Scan):
            limit = step.limit if step.limit is not None else len(step.ids) if step.ids is not None else None
        cheap = frame.cheap and isinstance(step, (S.Scan, S.Has, S.HasNot, S.Tag, S.Identity, S.Union))
        few = frame.few or limit is not None and limit <= LOCAL
        return replace(frame, cheap=cheap, few=few, most=limit if limit is not None else frame.most if keeps else None)

    def cut(self, frame: Frame) -> Frame:
        """The frame computed once: a table, or a relation in the plan itself where a limit keeps it to ``LOCAL`` rows."""
        bare = frame.bare()
        if frame.most is not None and frame.most <= LOCAL:
            return replace(bare, df=self.graph.spark.createDataFrame(bare.df.toArrow()), cheap=True)
        return replace(bare, df=written(bare.df, "branches"), cheap=True)

    def narrow(self, frame: Frame) -> Frame:
        """The frame as a side of a join: broadcast where a limit bounds it, a table of known size where it comes from a bounded one.

        Else a plan can't tell that it is small, and deals all edges or elements to meet it.
        """
        if frame.root or not frame.few:
            return frame
        if frame.most is not None and frame.most <= LOCAL:
            return replace(frame, df=F.broadcast(frame.df))
        return frame if frame.cheap else self.cut(frame)

    def moved(self, frame: Frame) -> Frame:
        """The path with the current element at its end."""
        here = F.array(F.col("cur") if frame.kind == VERTEX else F.bitwise_not("cur"))
        return replace(frame, df=frame.df.withColumn("path", F.concat("path", here) if frame.path else here), path=True)

    def need(self, frame: Frame, kind: str, step: S.Step) -> None:
        if frame.kind != kind:
            raise ValueError(f"{type(step).__name__} needs {kind}s, not {frame.kind}s")

    def table(self, kind: str) -> DataFrame:
        return self.graph.vertices if kind == VERTEX else self.graph.edges

    def load(self, frame: Frame) -> Frame:
        """With the element's columns; ids that are no element drop out."""
        if frame.kind == VALUE:
            raise ValueError("values have no properties")
        if frame.loaded:
            return frame
        frame, own = self.narrow(frame), self.table(frame.kind)
        own = own.select(*[F.col(c).alias(f"e_{c}") for c in own.columns])
        return replace(frame, df=frame.df.join(own, F.col("cur") == F.col("e_id")), loaded=True)

    def known(self, kind: str, key: str) -> None:
        if key not in self.table(kind).columns:
            raise ValueError(f"{kind}s have no property {key!r}")

    # -- scans

    def scan(self, step: S.Scan, frame: Frame | None) -> Frame:
        kind = VERTEX if step.what == "vertices" else EDGE
        df = self.table(kind)
        for t in step.tests:
            self.known(kind, t.key)
            df = df.where(F.col(t.key).isNull() if isinstance(t, S.HasNot) else F.col(t.key).isNotNull() if t.test is None else t.test(F.col(t.key)))
        df = df.select(F.col("id").alias("cur"), *[F.col(c).alias(f"e_{c}") for c in df.columns])
        if step.ids is not None:
            if len(set(step.ids)) == len(step.ids) <= 1000:
                df = df.where(F.col("cur").isin(*step.ids))
            else:
                ids = self.graph.spark.createDataFrame(pa.table({"want": np.array(step.ids, np.int64)}))
                df = df.join(ids, F.col("cur") == F.col("want")).drop("want")
        if step.table is not None:
            df = df.join(step.table.select(F.col("want").cast("long").alias("want")), F.col("cur") == F.col("want")).drop("want")
        if step.limit is not None:
            df = df.orderBy("cur").limit(step.limit)
        return Frame(df, kind, loaded=True, cheap=step.limit is None and step.table is None)

    def midscan(self, step: S.MidScan, frame: Frame) -> Frame:
        frame = frame.bare()
        df = self.graph.vertices.select(F.col("id").alias("cur"))
        if step.ids is not None:
            df = df.where(F.col("cur").isin(*step.ids))
        return replace(frame, df=frame.df.drop("cur").crossJoin(df), kind=VERTEX)

    # -- filters

    def has(self, step: S.Has, frame: Frame) -> Frame:
        self.known(frame.kind, step.key)
        frame = self.load(frame)
        c = F.col(f"e_{step.key}")
        return replace(frame, df=frame.df.where(c.isNotNull() if step.test is None else step.test(c)))

    def hasnot(self, step: S.HasNot, frame: Frame) -> Frame:
        if step.key not in self.table(frame.kind).columns:
            return frame
        frame = self.load(frame)
        return replace(frame, df=frame.df.where(F.col(f"e_{step.key}").isNull()))

    def where(self, step: S.Where, frame: Frame) -> Frame:
        return replace(frame, df=frame.df.where(step.test.against(frame.column(step.key), frame.column(step.test.value))))

    def filterchild(self, step: S.FilterChild, frame: Frame) -> Frame:
        frame = frame.bare()
        only = step.child[0] if len(step.child) == 1 else None
        if isinstance(only, (S.Encode, S.Expand)):
            # Whether one step finds anything is a plain semi join.
            self.need(frame, VERTEX, only)
            there = self.graph.embedding(only.embedding).select(F.col("id").alias("hit")) if isinstance(only, S.Encode) else half_edges(self.graph, only.labels, only.direction).select(F.col("at").alias("hit"))
            return replace(frame, df=frame.df.join(there, F.col("cur") == F.col("hit"), "left_anti" if step.negate else "left_semi"))
        inner, on = self.rooted(step.child, frame)
        ids = inner.df.select(F.col("root").alias("hit")).distinct()
        return replace(frame, df=frame.df.join(ids, on == F.col("hit"), "left_anti" if step.negate else "left_semi"))

    def is_(self, step: S.Is, frame: Frame) -> Frame:
        return replace(frame, df=frame.df.where(step.test(F.col("cur"))))

    def simplepath(self, step: S.SimplePath, frame: Frame) -> Frame:
        if not frame.path:
            raise ValueError("simplePath() has no place in a child of filter(), by() or property()")
        return replace(frame, df=frame.df.where(F.size(F.array_distinct("path")) == F.size("path")))

    def simplehop(self, step: S.SimpleHop, frame: Frame) -> Frame:
        """By counts: a simple path that gets one vertex longer is simple unless it has been there, which is a join on both ends of the edge.

        Pairs of paths and neighbours are not formed, and the key that many paths share is one row of counts; each result is then repeated.
        """
        self.need(frame, VERTEX, step)
        frame = frame.bare()
        if frame.kept() != ["path"]:
            return self.simplepath(S.SimplePath(), self.moved(self.expand(step.hop, frame)))
        frame = self.cut(self.simplepath(S.SimplePath(), frame))
        far = half_edges(self.graph, step.hop.labels, step.hop.direction)
        paths = frame.df.groupBy("cur").agg(F.count(F.lit(1)).alias("n"))
        there = paths.join(far, F.col("cur") == F.col("at")).select(F.col("to").alias("cur"), "n")
        again = frame.df.select("cur", F.explode("path").alias("been")).join(far, (F.col("cur") == F.col("at")) & (F.col("been") == F.col("to"))).select(F.col("to").alias("cur"), F.lit(-1).cast("long").alias("n"))
        return Frame(copies(there.unionAll(again).groupBy("cur").agg(F.sum("n").alias("n"))), VERTEX)

    def dedup(self, step: S.Dedup, frame: Frame) -> Frame:
        frame = frame.bare()
        by = ["root", "cur"] if frame.root else ["cur"]
        rest = [c for c in frame.kept() if c != "root"]
        if not rest:
            return replace(frame, df=frame.df.dropDuplicates(by))
        # Of equal traversers the one with the smallest tags, in a map-side aggregation.
        first = frame.df.groupBy(*by).agg(F.min(F.struct(*rest)).alias("rest"))
        return replace(frame, df=first.select("cur", *["root"] * frame.root, *[F.col(f"rest.{c}").alias(c) for c in rest]))

    # -- neighbours

    def expand(self, step: S.Expand, frame: Frame) -> Frame:
        self.need(frame, VERTEX, step)
        frame = self.narrow(frame.bare())
        if step.to == "vertex":
            far = half_edges(self.graph, step.labels, step.direction)
            df = frame.df.join(far, F.col("cur") == F.col("at")).select(F.col("to").alias("cur"), *frame.kept())
            return replace(frame, df=df)
        far = half_edges(self.graph, step.labels, step.direction, self.graph.edges.columns)
        df = frame.df.join(far, F.col("cur") == F.col("at")).select(F.col("e_id").alias("cur"), *frame.kept(), *[f"e_{c}" for c in self.graph.edges.columns])
        return replace(frame, df=df, kind=EDGE, loaded=True)

    def ends(self, step: S.Ends, frame: Frame) -> Frame:
        self.need(frame, EDGE, step)
        frame = self.load(frame)  # no join after an expansion to edges
        to = {"out": F.col("e_src"), "in": F.col("e_dst"), "both": F.explode(F.array("e_src", "e_dst"))}[step.direction]
        return replace(frame, df=frame.df.select(to.alias("cur"), *frame.kept()), kind=VERTEX, loaded=False)

    def degree(self, step: S.Degree, frame: Frame) -> Frame:
        self.need(frame, VERTEX, step)
        frame = frame.bare()
        counts = half_edges(self.graph, step.labels, step.direction).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        df = frame.df.join(counts, F.col("cur") == F.col("at"), "left").select(zero(F.col("n")).alias("cur"), *frame.kept())
        return replace(frame, df=df, kind=VALUE)

    def paths(self, step: S.Paths, frame: Frame) -> Frame:
        self.need(frame, VERTEX, step)
        df = frame.bare().df.groupBy("cur").agg(F.count(F.lit(1)).alias("bulk"))
        for hop in step.hops:
            far = half_edges(self.graph, hop.labels, hop.direction)
            df = df.join(far, F.col("cur") == F.col("at")).groupBy(F.col("to").alias("cur")).agg(F.sum("bulk").alias("bulk"))
        return Frame(df, VERTEX, bulk=True)

    # -- values and tags

    def id(self, step: S.Id, frame: Frame) -> Frame:
        return replace(frame.bare(), kind=VALUE)

    def label(self, step: S.Label, frame: Frame) -> Frame:
        frame = self.load(frame)
        return replace(frame, df=frame.df.select(F.col("e_label").alias("cur"), *frame.kept()), kind=VALUE, loaded=False)

    def values(self, step: S.Values, frame: Frame) -> Frame:
        self.known(frame.kind, step.key)
        frame = self.load(frame)
        c = F.col(f"e_{step.key}")
        return replace(frame, df=frame.df.where(c.isNotNull()).select(c.alias("cur"), *frame.kept()), kind=VALUE, loaded=False)

    def elementmap(self, step: S.ElementMap, frame: Frame) -> Frame:
        for k in step.keys:
            self.known(frame.kind, k)
        frame = self.load(frame)
        return replace(frame, df=frame.df.withColumns({f"m_{k}": F.col(f"e_{k}") for k in step.keys}), keys=tuple(dict.fromkeys([*frame.keys, *step.keys])))

    def tag(self, step: S.Tag, frame: Frame) -> Frame:
        return replace(frame, df=frame.df.withColumn(f"t_{step.tag}", F.col("cur")), tags=frame.tags | {step.tag: frame.kind})

    def select(self, step: S.Select, frame: Frame) -> Frame:
        if step.tag not in frame.tags:
            raise ValueError(f"no tag {step.tag!r}")
        frame = frame.bare()
        df = frame.df.withColumn("cur", F.col(f"t_{step.tag}")).where(F.col("cur").isNotNull())
        return replace(frame, df=df, kind=frame.tags[step.tag])

    def identity(self, step: S.Identity, frame: Frame) -> Frame:
        return frame

    def constant(self, step: S.Constant, frame: Frame) -> Frame:
        frame = frame.bare()
        return replace(frame, df=frame.df.withColumn("cur", F.lit(step.value)), kind=VALUE)

    def mapto(self, step: S.MapTo, frame: Frame) -> Frame:
        frame = self.scalar(step.child, frame, "value")
        return replace(frame, df=frame.df.where(F.col("value").isNotNull()).select(F.col("value").alias("cur"), *frame.kept()), kind=VALUE)

    def project(self, step: S.Project, frame: Frame) -> Frame:
        if len(step.names) != len(step.children):
            raise ValueError("a by() for each name is needed")
        frame = frame.bare()
        for k, child in enumerate(step.children):
            frame = self.scalar(child, frame, f"p_{k}")
        record = F.struct(*[F.col(f"p_{k}").alias(n) for k, n in enumerate(step.names)])
        return replace(frame, df=frame.df.select(record.alias("cur"), *frame.kept()), kind=VALUE)

    def valuemap(self, step: S.ValueMap, frame: Frame) -> Frame:
        keys = step.keys or (self.graph.vertex_property_names() if frame.kind == VERTEX else self.graph.edge_property_names())
        for k in keys:
            self.known(frame.kind, k)
        frame = self.load(frame)
        record = F.struct(*[F.col(f"e_{k}").alias(k) for k in keys])
        return replace(frame, df=frame.df.select(record.alias("cur"), *frame.kept()), kind=VALUE, loaded=False)

    def unfold(self, step: S.Unfold, frame: Frame) -> Frame:
        self.need(frame, VALUE, step)
        entries = F.map_entries("cur") if frame.df.schema["cur"].dataType.typeName() == "map" else F.col("cur")
        return replace(frame, df=frame.df.select(F.explode(entries).alias("cur"), *frame.kept()))

    def group(self, step: S.Group, frame: Frame) -> Frame:
        if step.key is None:
            raise ValueError("group() needs a by()")
        frame = frame.bare()
        if frame.root:
            raise ValueError("group() has no place in a child")
        own = self.scalar(step.key, frame, "key").df.select("cur", F.col("key").alias("root"))
        if step.grouped is None:
            done = own.groupBy("root").agg(F.array_sort(F.collect_list("cur")).alias("cur"))
        else:
            # The key is the root that the child is reduced by, so it sees all traversers of a key, equal ones as often as they come.
            done = self.run(step.grouped, Frame(own, frame.kind, root=True)).bare().df
            if not isinstance(step.grouped[-1], S.Reduce):
                done = done.groupBy("root").agg(F.array_sort(F.collect_list("cur")).alias("cur"))
        return Frame(done.select(F.struct(F.col("root").alias("key"), F.col("cur").alias("value")).alias("cur")), VALUE)

    # -- vectors

    def vectors(self, name: str, frame: Frame, value: Column | None = None) -> DataFrame:
        """The traversers with ``vec``, or with ``value``, which is computed where vectors are read, so that no vector is dealt."""
        own = self.graph.embedding(name).select(F.col("id").alias("v_id"), "vec" if value is None else value.alias("value"))
        return frame.df.join(own, F.col("cur") == F.col("v_id")).drop("v_id")

    @staticmethod
    def best(step: S.Similarity) -> Column:
        scores = [score(F.col("vec"), constant(q), step.metric) for q in step.queries]
        return scores[0] if len(scores) == 1 else F.greatest(*scores)

    def similarity(self, step: S.Similarity, frame: Frame) -> Frame:
        """The best score with any of the queries."""
        self.need(frame, VERTEX, step)
        frame = frame.bare()
        return replace(frame, df=self.vectors(step.embedding, frame, self.best(step)).select(F.col("value").alias("cur"), *frame.kept()), kind=VALUE)

    def like(self, step: S.Like, frame: Frame) -> Frame:
        """On the traversers as they come, in the order in which it is written: a test after a top-k sees its results only."""
        self.need(frame, VERTEX, step)
        frame = frame.bare()
        plain = not frame.kept()
        if step.approximate and plain and step.k is not None and step.embedding in self.graph.indexes:
            found = self.graph.indexes[step.embedding].nearest(step.queries, step.k, step.metric)
            ids = frame.df.select(F.col("cur").alias("own")).distinct()
            return replace(frame, df=found.join(ids, F.col("id") == F.col("own"), "left_semi").select(F.col("id").alias("cur")))
        scores = F.array(*[score(F.col("vec"), constant(q), step.metric) for q in step.queries])
        rows = self.vectors(step.embedding, frame, scores)
        if step.k is None:
            near = rows.where(F.array_max("value") >= step.threshold).select("cur", *frame.kept())
            return replace(frame, df=near.distinct() if plain else near)
        if not step.k or not step.queries:
            return replace(frame, df=rows.select("cur", *frame.kept()).limit(0))
        pairs = rows.select("cur", *frame.kept(), F.posexplode("value").alias("query", "score")).where(F.col("score").isNotNull())
        return replace(frame, df=self.first(pairs, frame, [F.desc("score"), F.col("cur"), F.col("query")], step.k).select("cur", *frame.kept()))

    def encode(self, step: S.Encode, frame: Frame) -> Frame:
        self.need(frame, VERTEX, step)
        frame = frame.bare()
        return replace(frame, df=self.vectors(step.embedding, frame).select(F.col("vec").alias("cur"), *frame.kept()), kind=VALUE)

    # -- branches and loops

    def joined(self, frames: list[Frame]) -> Frame:
        kinds = {f.kind for f in frames}
        frames = [f.bare() for f in frames]
        tags: dict[str, str] = {}
        for f in frames:
            for t, kind in f.tags.items():
                if tags.setdefault(t, kind) != kind:
                    raise ValueError(f"tag {t!r} has several kinds")
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df for f in frames])
        return replace(frames[0], df=df, kind=kinds.pop() if len(kinds) == 1 else VALUE, tags=tags, keys=tuple(dict.fromkeys(k for f in frames for k in f.keys)))

    def union(self, step: S.Union, frame: Frame) -> Frame:
        return self.joined(self.branches(list(step.children), frame))

    def branches(self, chains: list[S.Chain], frame: Frame) -> list[Frame]:
        """Of each chain its frame.  What several chains would compute alike, their input and the steps that they begin with, is written once."""
        if len(chains) > 1 and not frame.cheap:
            frame = self.cut(frame)
        found: list[Frame | None] = [None] * len(chains)
        for k, chain in enumerate(chains):
            if found[k] is not None:
                continue
            alike = [j for j in range(k, len(chains)) if chain and chains[j][:1] == chain[:1]]
            size = 0
            while len(alike) > 1 and all(len(chains[j]) > size and chains[j][size] == chain[size] for j in alike):
                size += 1
            if size and isinstance(chain[size - 1], S.Order):
                size -= 1  # a limit goes with its order
            if not size or all(isinstance(s, (S.Tag, S.Identity)) for s in chain[:size]):
                found[k] = self.run(chain, frame)
                continue
            for j, own in zip(alike, self.branches([chains[j][size:] for j in alike], self.run(chain[:size], frame)), strict=True):
                found[j] = own
        return found

    def repeat(self, step: S.Repeat, frame: Frame) -> Frame:
        if not step.body:
            raise ValueError("emit() needs a repeat()")
        out: list[Frame] = []
        cut = step.times is None or step.times > 4
        rounds = Rounds(self.graph.spark, "repeat") if cut else None
        done = 0
        while step.times is None or done < step.times:
            if step.emit is not None:
                own = frame if step.emit == (S.Identity(),) else self.filterchild(S.FilterChild(step.emit), frame)
                out.append(own)
            if step.until is not None:
                out.append(self.filterchild(S.FilterChild(step.until), frame))
                frame = self.filterchild(S.FilterChild(step.until, True), frame)
            if step.times is None:
                if frame.df.isEmpty():
                    break
                if done >= step.most:
                    raise RuntimeError(f"traversers remain after {step.most} rounds")
            frame = self.run(step.body, frame)
            if cut:
                # Frames that are given out read earlier rounds, so no round is removed then.
                frame = frame.bare()
                if out:
                    rounds = Rounds(self.graph.spark, "repeat")
                frame = replace(frame, df=rounds.keep(frame.df), cheap=True)
            done += 1
        if step.times is not None or not out:
            out.append(frame)
        return out[0] if len(out) == 1 else self.joined(out)

    # -- children whose value depends on the traverser

    def rooted(self, child: S.Chain, frame: Frame) -> tuple[Frame, Column]:
        """The child's results by ``root``, and the column of the outer frame that equals it."""
        need = [f"t_{t}" for t in sorted(S.selected(child))] + [f"m_{k}" for k in sorted(S.saved(child))]
        for c in need:
            frame.column(c[2:])
        root = F.struct("cur", *need) if need else F.col("cur")
        own = frame.df.select("cur", *need).distinct().withColumn("root", root)
        inner = Frame(own, frame.kind, {t: frame.tags[t] for t in sorted(S.selected(child))}, tuple(sorted(S.saved(child))), root=True, cheap=frame.cheap)
        return self.run(child, inner).bare(), root

    def scalar(self, child: S.Chain, frame: Frame, name: str) -> Frame:
        """``frame`` with the child's value in column ``name``; counts are 0 and others null where the child has none."""
        only = child[0] if len(child) == 1 else None
        if isinstance(only, S.Values) and frame.kind != VALUE:
            self.known(frame.kind, only.key)
            if frame.loaded:
                return replace(frame, df=frame.df.select("cur", *frame.kept(), F.col(f"e_{only.key}").alias(name)), loaded=False)
            own = self.table(frame.kind).select(F.col("id").alias("v_id"), F.col(only.key).alias(name))
            return replace(frame, df=frame.df.join(own, F.col("cur") == F.col("v_id"), "left").drop("v_id"))
        frame = frame.bare()
        if isinstance(only, S.Similarity):
            # One value an element: no reduction by root is needed.
            self.need(frame, VERTEX, only)
            own = self.graph.embedding(only.embedding).select(F.col("id").alias("v_id"), self.best(only).alias(name))
            return replace(frame, df=frame.df.join(own, F.col("cur") == F.col("v_id"), "left").drop("v_id"))
        if len(child) == 1 and isinstance(child[0], (S.Select, S.Id, S.Constant, S.Identity)):
            value = {S.Select: lambda s: frame.column(s.tag), S.Constant: lambda s: F.lit(s.value)}.get(type(child[0]), lambda s: F.col("cur"))(child[0])
            return replace(frame, df=frame.df.withColumn(name, value))
        outer_root = frame.df.withColumnRenamed("root", "root_outer") if frame.root else frame.df
        inner, on = self.rooted(child, replace(frame, df=outer_root, root=False))
        last = child[-1]
        if isinstance(last, (S.Reduce, S.Degree)):
            one = inner.df.select("root", F.col("cur").alias(name))
        else:
            one = inner.df.groupBy("root").agg(F.min("cur").alias(name))
        df = outer_root.withColumn("on", on).join(one, F.col("on") == F.col("root"), "left").drop("on", "root")
        if isinstance(last, S.Degree) or last == S.Reduce("count"):
            df = df.withColumn(name, zero(F.col(name)))
        return replace(frame, df=df.withColumnRenamed("root_outer", "root") if frame.root else df)

    # -- reductions and order

    def reduce(self, step: S.Reduce, frame: Frame) -> Frame:
        frame = frame.bare() if not frame.bulk else frame
        value = {"count": F.coalesce(F.sum("bulk"), F.lit(0).cast("long")) if frame.bulk else F.count(F.lit(1)), "min": F.min("cur"), "max": F.max("cur"), "sum": F.sum("cur"), "mean": F.avg("cur")}[step.name]
        if not frame.root:
            df = frame.df.agg(value.alias("cur"))
            return Frame(df if step.name == "count" else df.where(F.col("cur").isNotNull()), VALUE)
        return Frame(frame.df.groupBy("root").agg(value.alias("cur")), VALUE, root=True)

    def localmin(self, step: S.LocalMin, frame: Frame) -> Frame:
        frame = frame.bare()
        key = f"m_{step.key}"
        frame.column(step.key)
        by = [*["root"] * frame.root, key]
        rest = ["cur", *(c for c in frame.kept() if c not in by)]
        least = frame.df.groupBy(*by).agg(F.min(F.struct(*rest)).alias("rest"))
        return replace(frame, df=least.select(*by, *[F.col(f"rest.{c}").alias(c) for c in rest]))

    def first(self, df: DataFrame, frame: Frame, order: list[Column], n: int | None) -> DataFrame:
        """The first ``n`` of all, or in a child of each root."""
        if not frame.root:
            return df.orderBy(*order) if n is None else df.orderBy(*order).limit(n)
        if n is None:
            return df
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("rank") <= n).drop("rank")

    def order(self, step: S.Order, n: int | None, frame: Frame) -> Frame:
        frame = frame.bare()
        if step.by is not None:
            frame = self.scalar(step.by, frame, "key")
        key = F.col("key") if step.by is not None else F.col("cur")
        order = [key.desc_nulls_last() if step.descending else key.asc_nulls_last(), F.col("cur"), *[F.col(c) for c in frame.kept() if c != "root"]]
        return replace(frame, df=self.first(frame.df, frame, order, n).select("cur", *frame.kept()))

    def limit(self, step: S.Limit, frame: Frame) -> Frame:
        frame = frame.bare()
        return replace(frame, df=self.first(frame.df, frame, [F.col("cur"), *[F.col(c) for c in frame.kept() if c != "root"]], step.n))

    def sample(self, step: S.Sample, frame: Frame) -> Frame:
        """By a seeded hash, so that a plan that runs twice draws the same."""
        frame = frame.bare()
        rest = [F.col(c) for c in frame.kept()]
        return replace(frame, df=self.first(frame.df, frame, [F.xxhash64(F.lit(step.seed), F.col("cur"), *rest), F.col("cur"), *[c for c in rest]], step.n))

    # -- effects

    def subgraph(self, step: S.Subgraph, frame: Frame) -> Frame:
        self.need(frame, EDGE, step)
        frame = frame.bare()
        self.traversal.subgraphs[step.name] = self.graph.subgraph(frame.df.select("cur"))
        return replace(frame, effects=True)

    def setproperty(self, step: S.SetProperty, frame: Frame) -> Frame:
        if frame.kind == VALUE:
            raise ValueError("values have no properties")
        frame = frame.bare()
        own = replace(frame, df=frame.df.withColumn("value", F.lit(step.value))) if step.child is None else self.scalar(step.child, frame, "value")
        setter = self.graph.set_vertex_properties if frame.kind == VERTEX else self.graph.set_edge_properties
        setter(step.key, own.df.where(F.col("value").isNotNull()).select("cur", "value"), dtype=step.dtype)
        return replace(frame, effects=True)

    def dropproperty(self, step: S.DropProperty, frame: Frame) -> Frame:
        self.known(frame.kind, step.key)
        frame = frame.bare()
        setter = self.graph.set_vertex_properties if frame.kind == VERTEX else self.graph.set_edge_properties
        kind = self.table(frame.kind).schema[step.key].dataType
        setter(step.key, frame.df.select("cur", F.lit(None).cast(kind).alias("value")))
        return replace(frame, effects=True)

    def addvertex(self, step: S.AddVertex, frame: Frame | None) -> Frame:
        if frame is not None:
            raise ValueError("addV() begins a chain")
        new = self.graph.add_vertex(step.label)
        return Frame(self.graph.spark.range(new, new + 1).toDF("cur"), VERTEX, effects=True)

    def addedge(self, step: S.AddEdge, frame: Frame | None) -> Frame:
        if frame is not None:
            raise ValueError("addE() begins a chain")
        if step.src is None or step.dst is None:
            raise ValueError("addE() needs from_() and to()")
        ends = []
        for end in (step.src, step.dst):
            if isinstance(end, tuple):
                row = self.run(end, None).df.select("cur").first()
                if row is None:
                    raise ValueError("an end of the edge has no vertex")
                end = row[0]
            ends.append(end)
        new = self.graph.add_edge(*ends, step.label)
        return Frame(self.graph.spark.range(new, new + 1).toDF("cur"), EDGE, effects=True)


def compiled(graph: Any, chain: S.Chain, traversal: Any) -> Frame:
    own = Compiler(graph, traversal)
    own.tracks = S.tracks(chain)
    return own.run(chain, None)
