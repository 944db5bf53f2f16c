"""Vertex programs: a user's own algorithm as three column steps, run until no vertex is active.

A program says how vertices start, what an active vertex sends along its
edges, how messages at a vertex are combined, and how it updates; a vertex
that its update leaves as it was falls silent until a message changes it.
Each round is one join of the active vertices with the edges, one partial
aggregation by receiver, and one join of its result with the state, which is
written to the shared folder.  Programs can be bound to names, so a job can be
described by plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import discard, materialize
from .components import connected_components


@dataclass(frozen=True)
class Program:
    """start: a vertex' value from its columns; send: the message along an edge from ``value`` and the edge's columns;
    combine: an aggregate of ``message``; update: the new value from ``value`` and ``message`` (not null);
    first: which vertices are active at first (all by default); both: whether edges carry messages both ways;
    whole: ``(id, value)`` of a graph by a way that needs fewer rounds to the same end, where there is one."""

    start: Callable[[], Column]
    send: Callable[[], Column]
    combine: Callable[[Column], Column]
    update: Callable[[Column, Column], Column]
    first: Callable[[], Column] = field(default=lambda: F.lit(True))
    both: bool = False
    whole: Callable[[Graph], DataFrame] | None = None


@dataclass(frozen=True)
class Query:
    """A job by names and values: the program's name, its arguments, the most rounds, and whether partial results are merged."""

    program: str
    arguments: dict = field(default_factory=dict)
    rounds: int = 10_000
    assemble: bool = True


PROGRAMS: dict[str, Callable[..., Program]] = {}


def program(make: Callable[..., Program]) -> Callable[..., Program]:
    """Bind a program's maker to its name."""
    PROGRAMS[make.__name__] = make
    return make


def run_program(g: Graph, p: Program, rounds: int = 10_000) -> DataFrame:
    """``(id, value)``."""
    if p.whole is not None:
        return p.whole(g)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in g.edges.columns if c not in ("src", "dst")])
    edges = materialize(g.edges.unionByName(back) if p.both else g.edges, "program-edges")
    state = materialize(g.vertices.select("id", p.start().alias("value"), p.first().alias("active")), "program")
    for _ in range(rounds):
        active = state.where("active").select(F.col("id").alias("src"), "value")
        if active.isEmpty():
            break
        sent = active.join(edges, "src").select(F.col("dst").alias("id"), p.send().alias("message")).where("message is not null")
        got = sent.groupBy("id").agg(p.combine(F.col("message")).alias("message"))
        new = F.when(F.col("message").isNotNull(), p.update(F.col("value"), F.col("message"))).otherwise(F.col("value"))
        last, state = state, materialize(state.join(got, "id", "left").select("id", new.alias("value"), (~new.eqNullSafe(F.col("value"))).alias("active")), "program")
        discard(last)
    else:
        raise RuntimeError(f"still active after {rounds} rounds")
    discard(edges)
    return state.select("id", "value")


def run(g: Graph, query: Query, owner: DataFrame | None = None) -> DataFrame:
    """The result of a job: ``(id, value)``, or with ``assemble`` off one partial result ``(pid, id, value)`` for each fragment of owner(id, pid)."""
    if query.program not in PROGRAMS:
        raise KeyError(f"no program is called {query.program}; known are {sorted(PROGRAMS)}")
    found = run_program(g, PROGRAMS[query.program](**query.arguments), query.rounds)
    if query.assemble:
        return found
    if owner is None:
        raise ValueError("partial results need the vertices' owners")
    return owner.join(found, "id").select("pid", "id", "value")


@program
def least_id(both: bool = True) -> Program:
    """The least id that reaches a vertex."""
    least = lambda g: g.vertices.select("id").join(connected_components(g.edges), "id", "left").select("id", F.coalesce("component", "id").alias("value"))
    return Program(lambda: F.col("id"), lambda: F.col("value"), F.min, lambda v, m: F.least(v, m), both=both, whole=least if both else None)


@program
def hops(source: int, both: bool = False) -> Program:
    """Steps from the source; null where there is no way."""
    return Program(lambda: F.when(F.col("id") == source, F.lit(0).cast("long")), lambda: F.col("value") + 1, F.min, lambda v, m: F.least(v, m), first=lambda: F.col("id") == source, both=both)
