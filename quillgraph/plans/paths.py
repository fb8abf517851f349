"""Property paths as pairs of nodes, and closures as a semi-naive fixpoint.

Each round of a closure joins only the pairs that the round before found with the edges, drops those
known already, and cuts the lineage in reliable storage; it ends on cyclic graphs too. Tables of equal
numbers of rounds are merged, so a pair is rewritten once for each doubling of the rounds. A fixed
start or end is pushed into the first round, so only what it reaches is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import appended, components, cut, written

MOST_ROUNDS = 1000


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """``least`` 0 or 1 steps; ``many``: any number more."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class Not:
    """Any predicate but ``forward``, or backwards any but ``backward`` (None: that direction is not taken)."""

    forward: tuple | None
    backward: tuple | None = None


def _ends(quads: DataFrame, apart: bool, named: bool = False) -> DataFrame:
    none, g = F.lit(None).cast("string"), [F.col("g")] if named else []
    a = F.struct(F.col("s").alias("v"), F.col("s_kind").alias("kind"), none.alias("dt"), none.alias("lang"), *g)
    b = F.struct(F.col("o").alias("v"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"), *g)
    out = quads.select(a.alias("a"), "p", b.alias("b"))
    return out if apart else out.distinct()


def _flip(df: DataFrame) -> DataFrame:
    return df.select(F.col("b").alias("a"), F.col("a").alias("b"))


def is_term(node: str, term):
    """Whether the node of a column is ``term``, in whichever graph."""
    return F.struct(*[F.col(f"{node}.{x}") for x in ("v", "kind", "dt", "lang")]) == term.column()


def pairs(quads: DataFrame, path, start=None, end=None, apart: bool = False, named: bool = False) -> DataFrame:
    """Pairs (a, b) that ``path`` connects, repeated as often as SPARQL's bags are. ``start``, ``end``: terms.

    ``named``: in each graph on its own; nodes then have a field ``g``.
    """
    if isinstance(path, Link):
        return _ends(quads.where(F.col("p") == path.iri), apart, named).select("a", "b")
    if isinstance(path, Inverse):
        return _flip(pairs(quads, path.path, end, start, apart, named))
    if isinstance(path, Sequence):
        out = pairs(quads, path.parts[0], start, None, apart, named)
        if start is not None:
            out = out.where(is_term("a", start))
        for k, part in enumerate(path.parts[1:], 2):
            step = pairs(quads, part, None, end if k == len(path.parts) else None, apart, named).select(F.col("a").alias("m"), F.col("b").alias("c"))
            out = out.join(step, F.col("b") == F.col("m")).select("a", F.col("c").alias("b"))
        return out
    if isinstance(path, Alternative):
        out = pairs(quads, path.parts[0], start, end, apart, named)
        for part in path.parts[1:]:
            out = out.union(pairs(quads, part, start, end, apart, named))
        return out
    if isinstance(path, Not):
        out = None
        if path.forward is not None:
            out = _ends(quads.where(~F.col("p").isin(*path.forward)) if path.forward else quads, apart, named).select("a", "b")
        if path.backward is not None:
            back = _flip(_ends(quads.where(~F.col("p").isin(*path.backward)) if path.backward else quads, apart, named).select("a", "b"))
            out = back if out is None else out.union(back)
        return out
    if isinstance(path, Repeat):
        edges = pairs(quads, path.path, None, None, apart, named).distinct()
        if path.many and _symmetric(path.path):
            out = _flip(connected(edges, end)) if start is None and end is not None else connected(edges, start)
        elif path.many:
            if start is None and end is not None:
                out = _flip(closure(_flip(edges), end))
            else:
                out = closure(edges, start)
        else:
            out = edges
        if path.least == 0:
            every = _ends(quads, apart, named)
            nodes = every.select("a").union(every.select("b")).distinct()
            fixed = [t for t in (start, end) if t is not None]
            graphs = quads.select("g").distinct() if named else quads.sparkSession.range(1)
            for t in fixed:  # a fixed term reaches itself even if the graph lacks it
                c = t.column()
                nodes = nodes.union(graphs.select((F.struct(*[c[x].alias(x) for x in ("v", "kind", "dt", "lang")], "g") if named else c).alias("a")))
            out = out.union(nodes.select("a", F.col("a").alias("b"))).distinct()
        return out
    raise TypeError(f"not a path: {path!r}")


def _inverse(path):
    if isinstance(path, Inverse):
        return path.path
    if isinstance(path, Sequence):
        return Sequence(tuple(_inverse(x) for x in reversed(path.parts)))
    if isinstance(path, Alternative):
        return Alternative(tuple(_inverse(x) for x in path.parts))
    return Inverse(path)


def _symmetric(path) -> bool:
    """Whether ``path`` is an alternative of steps that has each in both directions."""
    parts = set(path.parts) if isinstance(path, Alternative) else {path}
    return parts == {_inverse(x) for x in parts}


#: Nodes of a component's block.
LARGE = 1000
#: Pieces of a block that are led to all nodes of another one, each in a row.
PIECES = 10


def connected(edges: DataFrame, start=None) -> DataFrame:
    """``closure`` of symmetric ``edges``: all pairs in a component, each node with itself too.

    Only the nodes and their components are kept; pairs are formed where they are read. A component
    is dealt by hash into blocks of about ``LARGE`` nodes, and rows that hold a piece of a block and a
    whole block give their pairs, so a component of any size is spread over all tasks.
    """
    spark = edges.sparkSession
    edges = written(spark, edges)
    groups = components(spark, edges)
    alone = edges.select("a").distinct().join(groups.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("root"))
    groups = written(spark, groups.union(alone))
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / LARGE).cast("int").alias("blocks"))
    h = F.xxhash64("node")
    dealt = written(spark, groups.join(sizes, "root").select("root", "node", F.pmod(h, F.col("blocks")).cast("int").alias("block"), F.pmod(F.shiftright(h, 32), F.lit(PIECES)).cast("int").alias("piece")))
    left = dealt.where(is_term("node", start)) if start is not None else dealt
    left = left.groupBy("root", "block", "piece").agg(F.collect_list("node").alias("ones"))
    right = dealt.groupBy("root", F.col("block").alias("other")).agg(F.collect_list("node").alias("others"))
    tasks = 16 * spark.sparkContext.defaultParallelism
    met = left.join(right, "root").repartition(tasks, "root", "block", "other")
    # a stage of generated code keeps all rows of a row that it reads: the coalesce, which moves none, parts the two explodes
    return met.select(F.explode("ones").alias("a"), "others").coalesce(tasks).select("a", F.explode("others").alias("b"))


def closure(edges: DataFrame, start=None) -> DataFrame:
    """All pairs (a, b) with a way of one or more ``edges`` (a, b) from a to b."""
    spark = edges.sparkSession
    edges = cut(spark, edges)
    found = cut(spark, edges.where(is_term("a", start)) if start is not None else edges)
    new, parts = found, [(1, found)]  # (rounds, their pairs)
    for _ in range(MOST_ROUNDS):
        step = edges.select(F.col("a").alias("m"), F.col("b").alias("c"))
        ahead = new.join(step, F.col("b") == F.col("m")).select("a", F.col("c").alias("b")).distinct()
        for _, known in parts:
            ahead = ahead.join(known, ["a", "b"], "left_anti")
        new = cut(spark, ahead)
        if not new.take(1):
            return reduce(DataFrame.union, [known for _, known in parts])
        parts = appended(spark, parts, new, "a", "b")
    raise RuntimeError(f"a path is longer than {MOST_ROUNDS} steps")


def from_shape(node) -> object:
    """A path of nested lists and pairs: ("inverse", p), ("oneOrMore", p), ("alternative", [..]), a list, an IRI."""
    if isinstance(node, str):
        return Link(node)
    if isinstance(node, list):
        return Sequence(tuple(from_shape(x) for x in node))
    kind, inner = node
    if kind == "inverse":
        return Inverse(from_shape(inner))
    if kind == "alternative":
        return Alternative(tuple(from_shape(x) for x in inner))
    return Repeat(from_shape(inner), *{"oneOrMore": (1, True), "zeroOrMore": (0, True), "zeroOrOne": (0, False)}[kind])
