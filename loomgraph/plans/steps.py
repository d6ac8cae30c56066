"""Steps of a traversal; immutable, compared by value."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from ..functions.predicates import P

Chain = tuple["Step", ...]


@dataclass(frozen=True)
class Step:
    def __str__(self) -> str:
        def say(v: Any) -> str:
            if isinstance(v, tuple) and v and all(isinstance(x, Step) for x in v):
                return "[" + ", ".join(map(str, v)) + "]"
            if isinstance(v, tuple) and v and all(isinstance(x, tuple) for x in v):
                return "(" + "; ".join(say(x) for x in v) + ")"
            return str(v)

        return f"{type(self).__name__}({', '.join(f'{f.name}={say(getattr(self, f.name))}' for f in fields(self) if getattr(self, f.name) not in ((), None, False))})"


@dataclass(frozen=True)
class Scan(Step):
    """All vertices or edges, or those of the ids (repeats stay) or of a table of ids; ``tests`` and ``limit`` are put in by rewrites."""

    what: str
    ids: tuple[int, ...] | None = None
    tests: tuple[Step, ...] = ()
    limit: int | None = None
    table: Any = field(default=None, compare=False)


@dataclass(frozen=True)
class Has(Step):
    """A test of a property; without predicate: that it is there."""

    key: str
    test: P | None = None


@dataclass(frozen=True)
class HasNot(Step):
    key: str


@dataclass(frozen=True)
class Expand(Step):
    """``to``: "vertex" or "edge"; ``direction``: "out", "in", "both"."""

    direction: str
    labels: tuple[str, ...] = ()
    to: str = "vertex"


@dataclass(frozen=True)
class Ends(Step):
    """From edges to "out" (source), "in" (destination) or "both" ends."""

    direction: str


@dataclass(frozen=True)
class Degree(Step):
    """The number of an element's edges; what counting an expansion in a child comes to."""

    direction: str
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Paths(Step):
    """Several expansions of which only the number of results matters: equal vertices go on as one row with a count."""

    hops: tuple[Expand, ...]


@dataclass(frozen=True)
class Id(Step):
    pass


@dataclass(frozen=True)
class Label(Step):
    pass


@dataclass(frozen=True)
class Values(Step):
    key: str


@dataclass(frozen=True)
class ElementMap(Step):
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Tag(Step):
    tag: str


@dataclass(frozen=True)
class Select(Step):
    tag: str


@dataclass(frozen=True)
class Identity(Step):
    pass


@dataclass(frozen=True)
class Constant(Step):
    value: Any


@dataclass(frozen=True)
class Similarity(Step):
    embedding: str
    queries: tuple[tuple[float, ...], ...]
    metric: str = "cosine"


@dataclass(frozen=True)
class Like(Step):
    """The ``k`` nearest, or all of ``threshold`` or more."""

    embedding: str
    queries: tuple[tuple[float, ...], ...]
    k: int | None = None
    threshold: float | None = None
    metric: str = "cosine"
    approximate: bool = False


@dataclass(frozen=True)
class Encode(Step):
    embedding: str


@dataclass(frozen=True)
class Where(Step):
    """Two saved values compared; the predicate's value is the second key."""

    key: str
    test: P


@dataclass(frozen=True)
class FilterChild(Step):
    child: Chain
    negate: bool = False


@dataclass(frozen=True)
class Is(Step):
    """A test of the current value itself."""

    test: P


@dataclass(frozen=True)
class SimplePath(Step):
    """Only traversers that have been nowhere twice."""


@dataclass(frozen=True)
class SimpleHop(Step):
    """An expansion to vertices and the simplePath() after it, when nothing later asks for the path."""

    hop: Expand


@dataclass(frozen=True)
class Dedup(Step):
    pass


@dataclass(frozen=True)
class MapTo(Step):
    """A child's value in place of the traverser; none, no traverser."""

    child: Chain


@dataclass(frozen=True)
class Project(Step):
    """A record of children's values."""

    names: tuple[str, ...]
    children: tuple[Chain, ...] = ()


@dataclass(frozen=True)
class ValueMap(Step):
    """A record of properties; no keys: of all."""

    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Unfold(Step):
    pass


@dataclass(frozen=True)
class Group(Step):
    """Records of ``key`` and ``value``: what ``grouped`` makes of all traversers of a key together, or the sorted list of them."""

    key: Chain | None = None
    grouped: Chain | None = None


@dataclass(frozen=True)
class Union(Step):
    children: tuple[Chain, ...]


@dataclass(frozen=True)
class Repeat(Step):
    body: Chain
    times: int | None = None
    emit: Chain | None = None
    until: Chain | None = None
    most: int = 1000


@dataclass(frozen=True)
class Reduce(Step):
    """count, min, max, sum or mean: of all, or in a child of each traverser."""

    name: str


@dataclass(frozen=True)
class LocalMin(Step):
    """Of each value of a saved key, the traverser with the smallest current value."""

    key: str


@dataclass(frozen=True)
class Order(Step):
    by: Chain | None = None
    descending: bool = False


@dataclass(frozen=True)
class Limit(Step):
    n: int


@dataclass(frozen=True)
class Sample(Step):
    n: int
    seed: int = 0


@dataclass(frozen=True)
class MidScan(Step):
    """Every traverser with every vertex (or those of the ids)."""

    ids: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Subgraph(Step):
    name: str


@dataclass(frozen=True)
class SetProperty(Step):
    key: str
    value: Any = None
    child: Chain | None = None
    dtype: str | None = None


@dataclass(frozen=True)
class DropProperty(Step):
    key: str


@dataclass(frozen=True)
class AddVertex(Step):
    label: str = ""


@dataclass(frozen=True)
class AddEdge(Step):
    label: str
    src: Any = None
    dst: Any = None


MUTATING = (SetProperty, DropProperty, AddVertex, AddEdge)


def inner(step: Step) -> list[Chain]:
    """A step's child chains."""
    out = []
    for f in fields(step):
        v = getattr(step, f.name)
        if isinstance(v, tuple) and v:
            if all(isinstance(x, Step) for x in v):
                out.append(v)
            elif all(isinstance(x, tuple) and (not x or isinstance(x[0], Step)) for x in v) and f.name == "children":
                out += list(v)
    return out


def tracks(chain: Chain) -> bool:
    """Whether a step of the chain or of its children asks where traversers have been."""
    return any(isinstance(s, (SimplePath, SimpleHop)) or any(map(tracks, inner(s))) for s in chain)


def selected(chain: Chain) -> set[str]:
    """Tags that a child reads but doesn't set itself first."""
    found, own = set(), set()
    for s in chain:
        if isinstance(s, Select) and s.tag not in own:
            found.add(s.tag)
        if isinstance(s, Tag):
            own.add(s.tag)
        for c in inner(s):
            found |= selected(c) - own
    return found


def saved(chain: Chain) -> set[str]:
    """Keys of saved values that a child compares but doesn't save itself first."""
    found, own = set(), set()
    for s in chain:
        if isinstance(s, Where):
            found |= {s.key, s.test.value} - own
        if isinstance(s, LocalMin):
            found |= {s.key} - own
        if isinstance(s, ElementMap):
            own |= set(s.keys)
        for c in inner(s):
            found |= saved(c) - own
    return found
