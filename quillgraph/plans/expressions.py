"""Filter and BIND expressions. An error is null, which a filter takes for false."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms
from ..functions.iri import quote_all, safe_iri
from .algebra import NUMERIC, TERM, Term, number_term

_BOOLEAN = terms.XSD + "boolean"
_TIMES = (terms.XSD + "dateTime", terms.XSD + "date", terms.XSD + "gYear")


def _literal(c: Column, dt=None, lang=None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.when(c.isNotNull(), F.struct(c.cast("string").alias("v"), F.lit("literal").alias("kind"), as_col(dt).alias("dt"), as_col(lang).alias("lang")))


class Expression:
    def term(self, env: dict[str, Column]) -> Column:
        return F.when(self.boolean(env).isNotNull(), _literal(self.boolean(env).cast("string"), _BOOLEAN))

    def boolean(self, env: dict[str, Column]) -> Column:
        """Effective boolean value."""
        t = self.term(env)
        number = t["v"].try_cast("double")
        return (
            F.when(t["kind"] != "literal", F.lit(None).cast("boolean"))
            .when(t["dt"] == _BOOLEAN, t["v"].isin("true", "1"))
            .when(t["dt"].isin(*NUMERIC), F.coalesce((number != 0) & ~F.isnan(number), F.lit(False)))
            .when(t["dt"].isNull() | (t["dt"] == terms.XSD + "string"), t["v"] != "")
        )

    def number(self, env: dict[str, Column]) -> Column:
        t = self.term(env)
        return F.when(t["kind"] == "literal", t["v"].try_cast("double"))

    def text(self, env: dict[str, Column]) -> Column:
        return self.term(env)["v"]

    def variables(self) -> set[str]:
        return set()


@dataclass
class Variable(Expression):
    name: str

    def term(self, env):
        return env.get(self.name, F.lit(None).cast(TERM))

    def variables(self):
        return {self.name}


@dataclass
class Constant(Expression):
    value: Term

    def term(self, env):
        return self.value.column()


@dataclass
class Call(Expression):
    name: str
    args: list

    def variables(self):
        return set().union(*[a.variables() for a in self.args]) if self.args else set()

    def term(self, env):
        made = _TERMS.get(self.name)
        return made(self.args, env) if made else super().term(env)

    def boolean(self, env):
        made = _TESTS.get(self.name)
        return made(self.args, env) if made else super().boolean(env)


def _compare(name: str, args, env) -> Column:
    a, b = args[0].term(env), args[1].term(env)
    if name in ("=", "!="):
        numbers = a["dt"].isin(*NUMERIC) & b["dt"].isin(*NUMERIC)
        plain = lambda t: F.coalesce(t["dt"], F.lit(terms.XSD + "string"))
        same = (a["v"] == b["v"]) & (a["kind"] == b["kind"]) & (plain(a) == plain(b)) & a["lang"].eqNullSafe(b["lang"])
        out = F.when(F.coalesce(numbers, F.lit(False)), a["v"].try_cast("double") == b["v"].try_cast("double")).otherwise(same)
        return out if name == "=" else ~out
    test = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[name]
    numeric = F.coalesce(a["dt"].isin(*NUMERIC) & b["dt"].isin(*NUMERIC), F.lit(False))
    times = F.coalesce(a["dt"].isin(*_TIMES) & b["dt"].isin(*_TIMES), F.lit(False))
    strings = F.coalesce(a["dt"], F.lit(terms.XSD + "string")) == F.coalesce(b["dt"], F.lit(terms.XSD + "string"))
    stamp = lambda t: F.coalesce(t["v"].try_cast("timestamp"), F.concat(F.substring(t["v"], 1, 4), F.lit("-01-01")).try_cast("timestamp"))
    both = (a["kind"] == "literal") & (b["kind"] == "literal")
    return F.when(numeric, test(a["v"].try_cast("double"), b["v"].try_cast("double"))).when(times, test(stamp(a), stamp(b))).when(both & strings, test(a["v"], b["v"]))


def _pattern(args, env) -> Column:
    flags = args[2].value.v if len(args) > 2 else ""
    pattern = args[1].text(env)
    if flags:
        pattern = F.concat(F.lit(f"(?{''.join(c for c in flags if c in 'imsx')})"), pattern)
    return pattern


def _in(args, env) -> Column:
    out = _compare("=", [args[0], args[1]], env) if len(args) > 1 else F.lit(False)
    for a in args[2:]:
        out = out | _compare("=", [args[0], a], env)
    return out


def _year_of(args, env, part: str) -> Column:
    v = args[0].text(env)
    at = {"YEAR": r"^(-?\d{4,})", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)", "HOURS": r"T(\d\d)", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)"}[part]
    return number_term(F.nullif(F.regexp_extract(v, at, 1), F.lit("")).try_cast("double"), "decimal") if part == "SECONDS" else _literal(F.nullif(F.regexp_extract(v, at, 1), F.lit("")).try_cast("int"), terms.XSD + "integer")


_TESTS = {
    **{op: (lambda a, e, op=op: _compare(op, a, e)) for op in ("=", "!=", "<", ">", "<=", ">=")},
    "&&": lambda a, e: a[0].boolean(e) & a[1].boolean(e),
    "||": lambda a, e: a[0].boolean(e) | a[1].boolean(e),
    "!": lambda a, e: ~a[0].boolean(e),
    "IN": _in,
    "NOT IN": lambda a, e: ~_in(a, e),
    "BOUND": lambda a, e: a[0].term(e).isNotNull(),
    "ISIRI": lambda a, e: a[0].term(e)["kind"] == "iri",
    "ISURI": lambda a, e: a[0].term(e)["kind"] == "iri",
    "ISBLANK": lambda a, e: a[0].term(e)["kind"] == "bnode",
    "ISLITERAL": lambda a, e: a[0].term(e)["kind"] == "literal",
    "ISNUMERIC": lambda a, e: F.coalesce(a[0].term(e)["dt"].isin(*NUMERIC), F.lit(False)),
    "REGEX": lambda a, e: F.regexp_like(a[0].text(e), _pattern(a, e)),
    "CONTAINS": lambda a, e: F.contains(a[0].text(e), a[1].text(e)),
    "STRSTARTS": lambda a, e: F.startswith(a[0].text(e), a[1].text(e)),
    "STRENDS": lambda a, e: F.endswith(a[0].text(e), a[1].text(e)),
    "SAMETERM": lambda a, e: a[0].term(e) == a[1].term(e),
    "LANGMATCHES": lambda a, e: F.when(a[1].text(e) == "*", a[0].text(e) != "").otherwise((F.lower(a[0].text(e)) == F.lower(a[1].text(e))) | F.startswith(F.lower(a[0].text(e)), F.concat(F.lower(a[1].text(e)), F.lit("-")))),
}


def _same(fn):
    """A text function that keeps language and datatype."""
    return lambda a, e: _literal(fn(*[x.text(e) for x in a]), a[0].term(e)["dt"], a[0].term(e)["lang"])


def _arith(fn):
    return lambda a, e: number_term(fn(*[x.number(e) for x in a]))


def _integer(fn):
    return lambda a, e: _literal(fn(*[x.text(e) for x in a]).cast("long"), terms.XSD + "integer")


def _substring(a, e) -> Column:
    start = a[1].number(e).cast("int")
    size = a[2].number(e).cast("int") if len(a) > 2 else F.lit(1 << 30)
    return _literal(F.substr(a[0].text(e), start, size), a[0].term(e)["dt"], a[0].term(e)["lang"])


_TERMS = {
    "STR": lambda a, e: _literal(a[0].text(e)),
    "LANG": lambda a, e: F.when(a[0].term(e)["kind"] == "literal", _literal(F.coalesce(a[0].term(e)["lang"], F.lit("")))),
    "DATATYPE": lambda a, e: F.when(a[0].term(e)["kind"] == "literal", F.struct(F.coalesce(a[0].term(e)["dt"], F.when(a[0].term(e)["lang"].isNotNull(), F.lit(terms.RDF + "langString")).otherwise(F.lit(terms.XSD + "string"))).alias("v"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))),
    "IRI": lambda a, e: F.struct(safe_iri(a[0].text(e)).alias("v"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")),
    "COALESCE": lambda a, e: F.coalesce(*[x.term(e) for x in a]),
    "IF": lambda a, e: F.when(a[0].boolean(e), a[1].term(e)).when(~a[0].boolean(e), a[2].term(e)),
    "UCASE": _same(F.upper),
    "LCASE": _same(F.lower),
    "CONCAT": lambda a, e: _literal(F.concat(*[x.text(e) for x in a])),
    "STRLEN": _integer(F.length),
    "SUBSTR": _substring,
    "STRBEFORE": lambda a, e: _literal(F.when(F.contains(a[0].text(e), a[1].text(e)), F.substring_index(a[0].text(e), a[1].value.v, 1)).otherwise(F.lit(""))),
    "STRAFTER": lambda a, e: _literal(F.when(F.contains(a[0].text(e), a[1].text(e)), F.substr(a[0].text(e), F.locate(a[1].value.v, a[0].text(e)) + len(a[1].value.v))).otherwise(F.lit(""))),
    "REPLACE": lambda a, e: _literal(F.regexp_replace(a[0].text(e), a[1].text(e), a[2].text(e)), a[0].term(e)["dt"], a[0].term(e)["lang"]),
    "ENCODE_FOR_URI": lambda a, e: _literal(quote_all(a[0].text(e))),
    "STRLANG": lambda a, e: _literal(a[0].text(e), None, a[1].text(e)),
    "STRDT": lambda a, e: _literal(a[0].text(e), a[1].text(e)),
    "ABS": _arith(F.abs),
    "CEIL": _arith(F.ceil),
    "FLOOR": _arith(F.floor),
    "ROUND": _arith(lambda x: F.floor(x + 0.5)),
    "+": _arith(lambda x, y: x + y),
    "-": _arith(lambda x, y: x - y),
    "*": _arith(lambda x, y: x * y),
    "/": _arith(lambda x, y: F.try_divide(x, y)),
    "NEG": _arith(lambda x: -x),
    **{p: (lambda a, e, p=p: _year_of(a, e, p)) for p in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS")},
    **{n: (lambda a, e, n=n: _literal(getattr(F, n.lower())(F.encode(a[0].text(e), "UTF-8")))) for n in ("MD5", "SHA1")},
    "SHA256": lambda a, e: _literal(F.sha2(F.encode(a[0].text(e), "UTF-8"), 256)),
}
_TERMS["URI"] = _TERMS["IRI"]
#: Casts by datatype IRI.
CASTS = {
    terms.XSD + "string": lambda a, e: _literal(a[0].text(e)),
    terms.XSD + "integer": lambda a, e: _literal(a[0].number(e).cast("long"), terms.XSD + "integer"),
    terms.XSD + "decimal": lambda a, e: number_term(a[0].number(e)),
    terms.XSD + "double": lambda a, e: number_term(a[0].number(e), "double"),
    terms.XSD + "boolean": lambda a, e: _literal(F.when(a[0].text(e).isin("true", "1"), "true").when(a[0].text(e).isin("false", "0"), "false"), _BOOLEAN),
    terms.XSD + "dateTime": lambda a, e: _literal(F.when(a[0].text(e).try_cast("timestamp").isNotNull(), a[0].text(e)), terms.XSD + "dateTime"),
}
_TERMS |= CASTS
