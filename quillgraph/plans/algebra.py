"""Graph query algebra and its compilation to DataFrames.

A solution is a row; each variable is a column holding a term, ``struct<v, kind, dt, lang>``, null where
unbound. Patterns become selections of the quad table and joins on shared variables, in an order that
never needs a product while a connected one exists. Catalyst does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms
from . import paths

TERM = "struct<v:string,kind:string,dt:string,lang:string>"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    v: str
    kind: str = "iri"
    dt: str | None = None
    lang: str | None = None

    def column(self) -> Column:
        return F.struct(F.lit(self.v).alias("v"), F.lit(self.kind).alias("kind"), F.lit(self.dt).cast("string").alias("dt"), F.lit(self.lang).cast("string").alias("lang"))


@dataclass
class Triple:
    s: object
    p: object  # Var, Term or a path of plans.paths
    o: object


@dataclass
class Bgp:
    triples: list[Triple]


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    condition: object
    inner: object


@dataclass
class Exists:
    """Keeps solutions of ``inner`` that have (or, negated, lack) a match of ``pattern``."""

    pattern: object
    inner: object
    negated: bool = False


@dataclass
class Extend:
    name: str
    expression: object
    inner: object


@dataclass
class Values:
    names: list[str]
    rows: list[list[Term | None]]


@dataclass
class Graph:
    graph: object
    inner: object


@dataclass
class Group:
    keys: list[tuple[str, object]]  # (name, expression); a plain variable names itself
    aggregates: list[tuple[str, str, object, bool, str]]  # name, function, expression, distinct, separator
    inner: object


@dataclass
class Project:
    names: list[str]
    inner: object


@dataclass
class Distinct:
    inner: object


@dataclass
class OrderBy:
    keys: list[tuple[object, bool]]  # expression, ascending
    inner: object


@dataclass
class Slice:
    offset: int
    limit: int | None
    inner: object


@dataclass
class Solutions:
    """Rows of solutions; ``maybe`` names the variables that can be unbound."""

    df: DataFrame
    maybe: set[str] = field(default_factory=set)

    @property
    def names(self) -> list[str]:
        return self.df.columns


def _met(rows: DataFrame, partners: list[tuple[DataFrame, Column | None]], how: str) -> DataFrame:
    """``rows`` joined with the union of ``partners`` (table, condition), each by its own condition."""
    if len(partners) == 1:
        (r, on), = partners
        return rows.crossJoin(r) if on is None and how == "inner" else rows.join(r, F.lit(True) if on is None else on, how)
    if how in ("inner", "left") and partners:
        out = reduce(DataFrame.unionByName, [_met(rows, [p], "inner") for p in partners])
        return out if how == "inner" else out.unionByName(_met(rows, partners, "left_anti"), allowMissingColumns=True)
    found = []
    for r, on in partners:
        if how == "left_semi":
            found.append(_met(rows, [(r, on)], how))
        rows = _met(rows, [(r, on)], "left_anti")
    return reduce(DataFrame.unionByName, found) if found else rows


@dataclass
class Dataset:
    """A quad table to query. ``apart``: no triple is in two graphs, so unions of graphs need no distinct."""

    quads: DataFrame
    apart: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.quads.sparkSession


def term_of(prefix: str) -> Column:
    """The term in a position of the quad table."""
    none = F.lit(None).cast("string")
    if prefix == "o":
        return F.struct(F.col("o").alias("v"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    kind = F.col("s_kind") if prefix == "s" else F.lit("iri")
    return F.struct(F.col(prefix).alias("v"), kind.alias("kind"), none.alias("dt"), none.alias("lang"))


def _matches(prefix: str, t: Term) -> Column:
    out = F.col(prefix) == t.v
    if prefix == "o":
        return out & (F.col("o_kind") == t.kind) & F.col("o_dt").eqNullSafe(F.lit(t.dt)) & F.col("o_lang").eqNullSafe(F.lit(t.lang))
    return out & (F.col("s_kind") == t.kind) if prefix == "s" else out


class Compiler:
    """``graph``: None for the union of all graphs, a Term for one, a Var to bind it."""

    def __init__(self, data: Dataset, graph=None):
        self.data, self.graph = data, graph

    def __call__(self, node) -> Solutions:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    # patterns

    def _scoped(self) -> DataFrame:
        if self.graph is None:
            return self.data.quads
        named = self.data.quads.where(F.col("g").isNotNull())
        return named.where(F.col("g") == self.graph.v) if isinstance(self.graph, Term) else named

    def _triple(self, t: Triple) -> Solutions:
        if not isinstance(t.p, (Var, Term)):
            return self._path(t)
        q, equal, cols = self._scoped(), [], {}
        for prefix, part in (("s", t.s), ("p", t.p), ("o", t.o)):
            if isinstance(part, Term):
                q = q.where(_matches(prefix, part))
            elif part.name in cols:
                equal.append(cols[part.name] == term_of(prefix))
            else:
                cols[part.name] = term_of(prefix)
        if isinstance(self.graph, Var):
            if self.graph.name in cols:
                equal.append(cols[self.graph.name] == term_of("g"))
            else:
                cols[self.graph.name] = term_of("g")
        for e in equal:
            q = q.where(e)
        if self.graph is None and not self.data.apart:
            q = q.dropDuplicates(["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"])
        return Solutions(q.select(*[c.alias(n) for n, c in cols.items()]) if cols else q.select(F.lit(1).alias("_")).drop("_"))

    def _path(self, t: Triple) -> Solutions:
        quads = self._scoped()
        named = isinstance(self.graph, Var)
        start = t.s if isinstance(t.s, Term) else None
        end = t.o if isinstance(t.o, Term) else None
        edges = paths.pairs(quads, t.p, start, end, apart=self.data.apart or self.graph is not None, named=named)
        plain = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("v", "kind", "dt", "lang")]) if named else F.col(c)
        cols = {}
        if start:
            edges = edges.where(paths.is_term("a", start))
        else:
            cols[t.s.name] = plain("a")
        if end:
            edges = edges.where(paths.is_term("b", end))
        elif t.o in (t.s,):
            edges = edges.where(F.col("a") == F.col("b"))
        else:
            cols[t.o.name] = plain("b")
        if named:
            none = F.lit(None).cast("string")
            g = F.struct(F.col("a.g").alias("v"), F.lit("iri").alias("kind"), none.alias("dt"), none.alias("lang"))
            if self.graph.name in cols:
                edges = edges.where(cols[self.graph.name] == g)
            else:
                cols[self.graph.name] = g
        return Solutions(edges.select(*[c.alias(n) for n, c in cols.items()]))

    def _bgp(self, node: Bgp) -> Solutions:
        todo = list(node.triples)
        if not todo:
            return Solutions(self.data.spark.range(1).select())

        def bound(t: Triple) -> int:
            # constants first; a type alone is weak, a subject or object strong
            return 4 * isinstance(t.s, Term) + 3 * isinstance(t.o, Term) + isinstance(t.p, Term) - 2 * (isinstance(t.p, Term) and t.p.v == terms.TYPE) - 3 * (not isinstance(t.p, (Var, Term)))

        names = lambda t: {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}
        out, seen = None, set()
        while todo:
            near = [t for t in todo if names(t) & seen] or todo
            t = max(near, key=bound)
            todo.remove(t)
            one = self._triple(t)
            out = one if out is None else self._joined(out, one)
            seen |= names(t)
        return out

    # joins

    def _condition(self, left: Solutions, right: Solutions) -> tuple[list[str], list[str]]:
        """(variables joined by equality, variables that may be unbound on a side)."""
        shared = [n for n in left.names if n in right.names]
        loose = [n for n in shared if n in left.maybe or n in right.maybe]
        return [n for n in shared if n not in loose], loose

    def _renamed(self, right: Solutions, names: list[str]) -> DataFrame:
        df = right.df
        for n in names:
            df = df.withColumnRenamed(n, n + "__r")
        return df

    def _joined(self, left: Solutions, right: Solutions, how: str = "inner", condition=None, overlap: bool = False) -> Solutions:
        """``overlap``: rows meet only if a shared variable is bound in both, as MINUS has it."""
        fixed, loose = self._condition(left, right)
        names = fixed + loose
        r = self._renamed(right, names)
        also = None
        if condition is not None:
            both = {n: (F.coalesce(n, n + "__r") if n in names else F.col(n)) for n in dict.fromkeys([*left.names, *right.names])}
            also = condition.boolean(both)
        if loose and not fixed:
            df = self._by_bound(left, right, r, loose, how, also, overlap)
        else:
            on = also
            for n in names:
                same = F.col(n) == F.col(n + "__r")
                if n in loose:
                    same = same | F.col(n).isNull() | F.col(n + "__r").isNull()
                on = same if on is None else on & same
            df = _met(left.df, [(r, on)], how)
        if how in ("left_semi", "left_anti"):
            return Solutions(df, set(left.maybe))
        rest = [n for n in right.names if n not in names]
        cols = [(F.coalesce(n, n + "__r").alias(n) if n in loose else F.col(n)) for n in left.names] + [F.col(n) for n in rest]
        maybe = (left.maybe | right.maybe) - {n for n in loose if n not in left.maybe or (n not in right.maybe and how == "inner")}
        if how == "left":
            maybe |= set(rest)
        return Solutions(df.select(*cols), maybe)

    def _by_bound(self, left: Solutions, right: Solutions, r: DataFrame, loose: list[str], how: str, also, overlap: bool) -> DataFrame:
        """The join where all shared variables may be unbound: rows that bind the same ones meet by equality."""

        def parts(df: DataFrame, maybe: set, mark: str):
            options = [n for n in loose if n in maybe]
            for k in range(1 << len(options)):
                unbound = {n for i, n in enumerate(options) if k >> i & 1}
                part = df
                for n in options:
                    part = part.where(F.col(n + mark).isNull() if n in unbound else F.col(n + mark).isNotNull())
                yield unbound, part

        out = None
        rights = list(parts(r, right.maybe, "__r"))
        for unbound, rows in parts(left.df, left.maybe, ""):
            partners = []
            for missing, others in rights:
                equal = [F.col(n) == F.col(n + "__r") for n in loose if n not in unbound and n not in missing]
                if equal or not overlap:
                    needed = equal + ([also] if also is not None else [])
                    partners.append((others, reduce(and_, needed) if needed else None))
            one = _met(rows, partners, how)
            out = one if out is None else out.unionByName(one)
        return out

    def _join(self, node: Join) -> Solutions:
        return self._joined(self(node.left), self(node.right))

    def _leftjoin(self, node: LeftJoin) -> Solutions:
        return self._joined(self(node.left), self(node.right), "left", node.condition)

    def _minus(self, node: Minus) -> Solutions:
        left, right = self(node.left), self(node.right)
        fixed, loose = self._condition(left, right)
        if not fixed and not loose:
            return left  # no shared variable: nothing is taken away
        return self._joined(left, right, "left_anti", overlap=True)

    def _exists(self, node: Exists) -> Solutions:
        inner = self(node.inner)
        pattern, condition = node.pattern, None
        if isinstance(pattern, Filter) and _variables(pattern.condition) - set(self(pattern.inner).names):
            pattern, condition = pattern.inner, pattern.condition  # the filter reads outer variables
        return self._joined(inner, self(pattern), "left_anti" if node.negated else "left_semi", condition)

    def _union(self, node: Union) -> Solutions:
        left, right = self(node.left), self(node.right)
        only = set(left.names) ^ set(right.names)
        return Solutions(left.df.unionByName(right.df, allowMissingColumns=True), left.maybe | right.maybe | only)

    def _values(self, node: Values) -> Solutions:
        rows = [tuple(None if t is None else (t.v, t.kind, t.dt, t.lang) for t in row) for row in node.rows]
        schema = ", ".join(f"`{n}` {TERM}" for n in node.names)
        df = self.data.spark.createDataFrame(rows, schema)
        return Solutions(df, {n for i, n in enumerate(node.names) if any(r[i] is None for r in rows)})

    def _graph(self, node: Graph) -> Solutions:
        return Compiler(self.data, node.graph)(node.inner)

    # modifiers

    def _filter(self, node: Filter) -> Solutions:
        inner = self(node.inner)
        return Solutions(inner.df.where(F.coalesce(node.condition.boolean({n: F.col(n) for n in inner.names}), F.lit(False))), inner.maybe)

    def _extend(self, node: Extend) -> Solutions:
        inner = self(node.inner)
        return Solutions(inner.df.withColumn(node.name, node.expression.term({n: F.col(n) for n in inner.names})), inner.maybe | {node.name})

    def _project(self, node: Project) -> Solutions:
        inner = self(node.inner)
        cols = [F.col(n) if n in inner.names else F.lit(None).cast(TERM).alias(n) for n in node.names]
        return Solutions(inner.df.select(*cols), (inner.maybe & set(node.names)) | (set(node.names) - set(inner.names)))

    def _distinct(self, node: Distinct) -> Solutions:
        inner = self(node.inner)
        return Solutions(inner.df.distinct(), inner.maybe)

    def _orderby(self, node: OrderBy) -> Solutions:
        inner = self(node.inner)
        cols = []
        for e, up in node.keys:
            t = e.term({n: F.col(n) for n in inner.names})
            # unbound, blank nodes, IRIs, literals; numbers by value, then text
            rank = F.when(t.isNull(), 0).when(t["kind"] == "bnode", 1).when(t["kind"] == "iri", 2).otherwise(3)
            number = F.when(t["dt"].isin(*NUMERIC), t["v"].try_cast("double"))
            cols += [c.asc() if up else c.desc() for c in (rank, number, t["v"])]
        return Solutions(inner.df.orderBy(*cols), inner.maybe)

    def _slice(self, node: Slice) -> Solutions:
        inner = self(node.inner)
        df = inner.df
        if df.columns and not _ordered(node.inner):
            df = df.orderBy(*df.columns)  # a limit means the same rows in every run
        if node.offset:
            df = df.offset(node.offset)
        return Solutions(df if node.limit is None else df.limit(node.limit), inner.maybe)

    def _group(self, node: Group) -> Solutions:
        inner = self(node.inner)
        env = {n: F.col(n) for n in inner.names}
        keys = [e.term(env).alias(n) for n, e in node.keys]
        aggs = [aggregate(fn, None if e is None else e.term(env), distinct, sep).alias(n) for n, fn, e, distinct, sep in node.aggregates]
        df = inner.df.groupBy(*keys).agg(*aggs) if aggs else inner.df.select(*keys).distinct()
        return Solutions(df, {n for n, *_ in node.aggregates} | inner.maybe)


#: Datatypes that compare as numbers.
NUMERIC = tuple(terms.XSD + x for x in ("integer", "int", "long", "short", "byte", "decimal", "double", "float", "nonNegativeInteger", "positiveInteger"))


def number_term(c: Column, kind: str = "decimal") -> Column:
    none = F.lit(None).cast("string")
    whole = c.cast("double") == F.floor(c.cast("double"))
    text = F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("double").cast("string"))
    return F.when(c.isNotNull(), F.struct((c.cast("string") if kind == "integer" else text).alias("v"), F.lit("literal").alias("kind"), F.lit(terms.XSD + kind).alias("dt"), none.alias("lang")))


def aggregate(fn: str, t: Column | None, distinct: bool, separator: str) -> Column:
    if fn == "COUNT":
        if t is None:
            return number_term(F.count(F.lit(1)), "integer")
        return number_term(F.count_distinct(t) if distinct else F.count(t), "integer")
    value = t["v"].try_cast("double")
    if fn == "SUM":
        return number_term(F.coalesce(F.sum_distinct(value) if distinct else F.sum(value), F.lit(0.0)))
    if fn == "AVG":
        total, n = (F.sum_distinct(value), F.count_distinct(value)) if distinct else (F.sum(value), F.count(value))
        return number_term(F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0)))
    if fn in ("MIN", "MAX"):
        key = F.struct(F.when(t["dt"].isin(*NUMERIC), value), t["v"])
        return (F.min_by if fn == "MIN" else F.max_by)(t, F.when(t.isNotNull(), key))
    if fn == "SAMPLE":
        return F.min(t)
    if fn == "GROUP_CONCAT":
        many = F.collect_set(t["v"]) if distinct else F.collect_list(t["v"])
        return F.struct(F.array_join(F.sort_array(many), separator).alias("v"), F.lit("literal").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    raise ValueError(f"unknown aggregate {fn}")


def _ordered(node) -> bool:
    while isinstance(node, (Project, Distinct)):
        if isinstance(node, Distinct):
            return False
        node = node.inner
    return isinstance(node, OrderBy)


def _variables(expression) -> set[str]:
    return expression.variables() if hasattr(expression, "variables") else set()


def evaluate(data: Dataset, node) -> DataFrame:
    """Solutions of ``node``, a term column a variable."""
    return Compiler(data)(node).df


def plain(df: DataFrame) -> DataFrame:
    """Solutions with each term as its text alone."""
    return df.select(*[F.col(n)["v"].alias(n) for n in df.columns])
