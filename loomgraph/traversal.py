"""The traversal language: a lazy chain of steps, run when its results are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .functions.predicates import P
from .plans import steps as S
from .plans.rewrite import NAMES, rewritten

Vectors = Sequence[Sequence[float]]


def _vectors(queries: Vectors) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(float(x) for x in q) for q in queries)


class Traversal:
    """Steps so far, and the graph they start from (None: a child of another traversal)."""

    def __init__(self, graph: Any = None, chain: S.Chain = (), off: frozenset[str] = frozenset(), options: dict[str, Any] | None = None):
        self.graph, self.chain, self.off, self.options = graph, chain, off, options or {}
        self.subgraphs: dict[str, Any] = {}

    def _then(self, step: S.Step) -> Traversal:
        return Traversal(self.graph, (*self.chain, step), self.off, self.options)

    def _child(self, child: Traversal) -> S.Chain:
        if child.graph is not None:
            raise ValueError("a child begins with anon()")
        return child.chain

    # -- scans and filters

    def V(self, ids: int | Sequence[int] | DataFrame | None = None) -> Traversal:
        """All vertices, or those of the ids, also of a table's one column.  No ids given and an empty list are the same.  Later in a chain: with each traverser."""
        if isinstance(ids, DataFrame):
            if self.chain:
                raise ValueError("a table of ids begins a chain")
            return self._then(S.Scan("vertices", table=ids.toDF("want")))
        own = _ids(ids)
        return self._then(S.MidScan(own) if self.chain else S.Scan("vertices", own))

    def E(self, ids: int | Sequence[int] | None = None) -> Traversal:
        if self.chain:
            raise ValueError("E() begins a chain")
        return self._then(S.Scan("edges", _ids(ids)))

    def has(self, key: str, value: Any = None, of_label: Any = None) -> Traversal:
        """The property satisfies ``value`` (a predicate, or equals it); without value it is there.  Three arguments: label, property, value."""
        if of_label is not None:
            return self.hasLabel(key).has(value, of_label)
        return self._then(S.Has(key, None if value is None else value if isinstance(value, P) else P.eq(value)))

    def hasNot(self, key: str) -> Traversal:
        return self._then(S.HasNot(key))

    def hasLabel(self, *labels: str) -> Traversal:
        return self._then(S.Has("label", P.within(*labels) if len(labels) > 1 else P.eq(labels[0])))

    def hasId(self, *ids: int) -> Traversal:
        return self._then(S.Has("id", P.within(*ids)))

    def where(self, key: str | Traversal, test: P | None = None) -> Traversal:
        """Saved value ``key`` compared with saved value ``test.value``; or a child that has a result."""
        return self._then(S.FilterChild(self._child(key)) if isinstance(key, Traversal) else S.Where(key, test))

    def filter(self, child: Traversal) -> Traversal:
        return self._then(S.FilterChild(self._child(child)))

    def not_(self, child: Traversal) -> Traversal:
        return self._then(S.FilterChild(self._child(child), True))

    def and_(self, *children: Traversal) -> Traversal:
        """Traversers for which each child has a result."""
        own = self
        for c in children:
            own = own.filter(c)
        return own

    def or_(self, *children: Traversal) -> Traversal:
        """Traversers for which a child has a result."""
        return self._then(S.FilterChild((S.Union(tuple(self._child(c) for c in children)),)))

    def is_(self, value: Any) -> Traversal:
        return self._then(S.Is(value if isinstance(value, P) else P.eq(value)))

    def simplePath(self) -> Traversal:
        """Without traversers that have been at a vertex or edge twice; not in children of filters, by() and property()."""
        return self._then(S.SimplePath())

    def dedup(self) -> Traversal:
        return self._then(S.Dedup())

    # -- neighbours

    def out(self, *labels: str) -> Traversal:
        return self._then(S.Expand("out", labels))

    def in_(self, *labels: str) -> Traversal:
        return self._then(S.Expand("in", labels))

    def both(self, *labels: str) -> Traversal:
        return self._then(S.Expand("both", labels))

    def outE(self, *labels: str) -> Traversal:
        return self._then(S.Expand("out", labels, "edge"))

    def inE(self, *labels: str) -> Traversal:
        return self._then(S.Expand("in", labels, "edge"))

    def bothE(self, *labels: str) -> Traversal:
        return self._then(S.Expand("both", labels, "edge"))

    def outV(self) -> Traversal:
        return self._then(S.Ends("out"))

    def inV(self) -> Traversal:
        return self._then(S.Ends("in"))

    def bothV(self) -> Traversal:
        return self._then(S.Ends("both"))

    # -- values and tags

    def id(self) -> Traversal:
        return self._then(S.Id())

    def label(self) -> Traversal:
        return self._then(S.Label())

    def values(self, key: str) -> Traversal:
        return self._then(S.Values(key))

    def elementMap(self, keys: Sequence[str]) -> Traversal:
        """Saves properties beside the traverser, which stays where it is."""
        return self._then(S.ElementMap(tuple(keys)))

    def properties(self, key: str) -> Traversal:
        """The property's values, which ``drop()`` may follow."""
        return self.values(key)

    def valueMap(self, *keys: str) -> Traversal:
        """A record of these properties, or of all; missing ones are null."""
        return self._then(S.ValueMap(keys))

    def project(self, *names: str) -> Traversal:
        """A record with a value for each name, which ``by()`` gives in turn."""
        return self._then(S.Project(names))

    def map(self, child: Traversal) -> Traversal:
        return self._then(S.MapTo(self._child(child)))

    def unfold(self) -> Traversal:
        """A traverser for each element of a list, or for each key and value of a map."""
        return self._then(S.Unfold())

    def group(self) -> Traversal:
        """Records of ``key`` and ``value``.  The first ``by()`` is the key, the second what becomes of all traversers of a key, such as ``count()``."""
        return self._then(S.Group())

    def as_(self, tag: str) -> Traversal:
        return self._then(S.Tag(tag))

    def select(self, tag: str) -> Traversal:
        return self._then(S.Select(tag))

    def identity(self) -> Traversal:
        return self._then(S.Identity())

    def constant(self, value: Any) -> Traversal:
        return self._then(S.Constant(value))

    # -- vectors

    def similarity(self, embedding: str, queries: Vectors, metric: str = "cosine") -> Traversal:
        return self._then(S.Similarity(embedding, _vectors(queries), metric))

    def like(self, embedding: str, queries: Vectors, limit: int | float, metric: str = "cosine", approximate: bool = False) -> Traversal:
        """A whole number: so many nearest of all queries together.  A float: all that score so much with any query."""
        k = limit if isinstance(limit, (int, np.integer)) else None
        return self._then(S.Like(embedding, _vectors(queries), k, None if k is not None else float(limit), metric, approximate))

    def encode(self, embedding: str) -> Traversal:
        return self._then(S.Encode(embedding))

    # -- branches and loops

    def union(self, children: Sequence[Traversal]) -> Traversal:
        return self._then(S.Union(tuple(self._child(c) for c in children)))

    def repeat(self, body: Traversal) -> Traversal:
        """Until no traversers remain, unless ``times`` or ``until`` follows; an ``emit`` may come before or after."""
        if self.chain and isinstance(self.chain[-1], S.Repeat) and not self.chain[-1].body:
            emit = self.chain[-1].emit
            return Traversal(self.graph, (*self.chain[:-1], S.Repeat(self._child(body), emit=emit)), self.off, self.options)
        return self._then(S.Repeat(self._child(body)))

    def _loop(self, **change: Any) -> Traversal:
        last = self.chain[-1] if self.chain else None
        if not isinstance(last, S.Repeat):
            raise ValueError("a repeat comes first")
        new = S.Repeat(**({"body": last.body, "times": last.times, "emit": last.emit, "until": last.until, "most": last.most} | change))
        return Traversal(self.graph, (*self.chain[:-1], new), self.off, self.options)

    def times(self, n: int) -> Traversal:
        return self._loop(times=n)

    def until(self, child: Traversal) -> Traversal:
        return self._loop(until=self._child(child))

    def most(self, rounds: int) -> Traversal:
        """Rounds after which an endless repeat is an error."""
        return self._loop(most=rounds)

    def emit(self, child: Traversal | None = None) -> Traversal:
        """Also what reaches each round; with a child, only those for which it has a result."""
        own = (S.Identity(),) if child is None else self._child(child)
        if self.chain and isinstance(self.chain[-1], S.Repeat):
            return self._loop(emit=own)
        return self._then(S.Repeat((), emit=own))

    # -- reductions and order

    def count(self) -> Traversal:
        return self._then(S.Reduce("count"))

    def min(self, key: str | None = None) -> Traversal:
        """The smallest of all; with a saved key, of each of its values, keeping the traverser."""
        return self._then(S.Reduce("min") if key is None else S.LocalMin(key))

    def max(self) -> Traversal:
        return self._then(S.Reduce("max"))

    def sum(self) -> Traversal:
        return self._then(S.Reduce("sum"))

    def mean(self) -> Traversal:
        return self._then(S.Reduce("mean"))

    def order(self) -> Traversal:
        return self._then(S.Order())

    def by(self, child: Traversal | str, direction: str = "ASC") -> Traversal:
        """Sorts the preceding order by a child's value or a property, then by the current value; or gives project() and group() their values."""
        if self.chain and isinstance(self.chain[-1], (S.Project, S.Group)):
            own = (S.Values(child),) if isinstance(child, str) else self._child(child)
            last = self.chain[-1]
            if isinstance(last, S.Project):
                if len(last.children) == len(last.names):
                    raise ValueError("more values than names")
                new: S.Step = S.Project(last.names, (*last.children, own))
            else:
                new = S.Group(own) if last.key is None else S.Group(last.key, own)
            return Traversal(self.graph, (*self.chain[:-1], new), self.off, self.options)
        if not self.chain or not isinstance(self.chain[-1], S.Order):
            raise ValueError("by() follows order(), project() or group()")
        if direction.upper() not in ("ASC", "DESC"):
            raise ValueError("ASC or DESC")
        own = (S.Values(child),) if isinstance(child, str) else self._child(child)
        return Traversal(self.graph, (*self.chain[:-1], S.Order(own, direction.upper() == "DESC")), self.off, self.options)

    def limit(self, n: int) -> Traversal:
        return self._then(S.Limit(n))

    def sample(self, n: int, seed: int = 0) -> Traversal:
        return self._then(S.Sample(n, seed))

    # -- effects

    def subgraph(self, name: str) -> Traversal:
        return self._then(S.Subgraph(name))

    def property(self, key: str, value: Any, dtype: str | None = None) -> Traversal:
        child = self._child(value) if isinstance(value, Traversal) else None
        return self._then(S.SetProperty(key, None if child is not None else value, child, dtype))

    def drop(self) -> Traversal:
        """Takes the property away whose values come last in the chain."""
        if not self.chain or not isinstance(self.chain[-1], S.Values):
            raise ValueError("drop() follows properties()")
        return Traversal(self.graph, (*self.chain[:-1], S.DropProperty(self.chain[-1].key)), self.off, self.options)

    def addV(self, label: str = "") -> Traversal:
        return self._then(S.AddVertex(label))

    def addE(self, label: str) -> Traversal:
        return self._then(S.AddEdge(label))

    def _end(self, **change: Any) -> Traversal:
        last = self.chain[-1] if self.chain else None
        if not isinstance(last, S.AddEdge):
            raise ValueError("addE() comes first")
        value = {k: self._child(v) if isinstance(v, Traversal) else int(v) for k, v in change.items()}
        return Traversal(self.graph, (*self.chain[:-1], S.AddEdge(last.label, value.get("src", last.src), value.get("dst", last.dst))), self.off, self.options)

    def from_(self, end: int | Traversal) -> Traversal:
        return self._end(src=end)

    def to(self, end: int | Traversal) -> Traversal:
        return self._end(dst=end)

    # -- results

    def plan(self) -> S.Chain:
        return rewritten(self.chain, self.off)

    def explain(self, mode: str | None = None) -> str:
        """The rewritten steps, a line each; with a mode, also the physical plan as ``DataFrame.explain`` has it (to stdout)."""
        if mode and self.graph is not None:
            self.toDF().explain(mode)
        return "\n".join(f"{k}: {s}" for k, s in enumerate(self.plan()))

    def frame(self):
        from .plans.compiler import compiled

        if self.graph is None:
            raise ValueError("a child has no results of its own")
        if self.options.get("debug"):
            print(self.explain())
        return compiled(self.graph, self.plan(), self)

    def toDF(self, columns: Sequence[str] | None = None) -> DataFrame:
        """``cur``, or the given ones of ``cur``, tags and saved values, in the traversal's order."""
        own = self.frame()
        return own.df.select(*[own.column(c).alias(c) for c in (columns or ["cur"])])

    def toList(self) -> list[Any]:
        return [r[0] for r in self.toDF().collect()]

    def toPandas(self) -> pd.Series:
        return self.toDF().toPandas()["cur"]

    def toArray(self) -> np.ndarray:
        return self.toPandas().to_numpy()

    def next(self) -> Any:
        """The first result; StopIteration if there is none."""
        row = self.toDF().first()
        if row is None:
            raise StopIteration
        return row[0]

    def forEachRemaining(self, f: Callable[[Any], None]) -> None:
        for x in self:
            f(x)

    def __iter__(self) -> Iterator[Any]:
        return (r[0] for r in self.toDF().toLocalIterator())

    def iterate(self) -> Traversal:
        """Runs for the effects; results are discarded."""
        own = self.frame()
        if not own.effects:
            own.df.write.format("noop").mode("overwrite").save()
        return self

    def getTraversalProperty(self, name: str) -> Any:
        if name not in self.subgraphs:
            raise KeyError(f"no step made {name!r}, or the traversal hasn't run")
        return self.subgraphs[name]


def _ids(ids: int | Sequence[int] | None) -> tuple[int, ...] | None:
    if ids is None:
        return None
    own = (ids,) if isinstance(ids, (int, np.integer)) else tuple(ids)
    return tuple(int(i) for i in own) or None


class Source:
    """Where traversals of a graph begin, with the rewrites that are on."""

    def __init__(self, graph: Any, off: frozenset[str] = frozenset(), options: dict[str, Any] | None = None):
        self.graph, self.off, self.options = graph, off, options or {}

    def _start(self) -> Traversal:
        return Traversal(self.graph, (), self.off, self.options)

    def V(self, ids: int | Sequence[int] | DataFrame | None = None) -> Traversal:
        return self._start().V(ids)

    def E(self, ids: int | Sequence[int] | None = None) -> Traversal:
        return self._start().E(ids)

    def addV(self, label: str = "") -> Traversal:
        return self._start().addV(label)

    def addE(self, label: str) -> Traversal:
        return self._start().addE(label)

    def withoutStrategy(self, *names: str) -> Source:
        if wrong := set(names) - set(NAMES):
            raise ValueError(f"no such rewrites: {sorted(wrong)}; there are {NAMES}")
        return Source(self.graph, self.off | set(names), self.options)

    def withStrategy(self, *names: str) -> Source:
        return Source(self.graph, self.off - set(names), self.options)

    def withAdminOption(self, name: str, value: Any) -> Source:
        return Source(self.graph, self.off, self.options | {name: value})


def anon() -> Traversal:
    """The beginning of a child traversal."""
    return Traversal()
