"""IRIs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import OWL, RDF, RDFS, XSD, SKOS

INVALID = "http://internal.invalid/"
_SAFE = ":/#?&=%"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def quote_all(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and ``_.-~``."""
    out = F.url_encode(c)
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = _replace(out, old, new)
    return out


def quote(c: Column) -> Column:
    """Percent-encoding that also leaves ``:/#?&=%`` alone; the per cent sign is restored last."""
    out = quote_all(c)
    for sign in _SAFE:
        out = _replace(out, f"%{ord(sign):02X}", sign)
    return out


def has_scheme(c: Column) -> Column:
    return c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def safe_plain(start: str) -> bool:
    """Whether ``safe_iri`` leaves ``start`` and any letters, digits and ``_.-`` after it as they are."""
    return re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:[A-Za-z0-9_.~:/#?&=-]*", start) is not None


def safe_iri(c: Column) -> Column:
    """A usable IRI for any text: quoted, and under ``INVALID`` if it has no scheme."""
    return F.when(has_scheme(c), quote(c)).otherwise(F.concat(F.lit(INVALID), quote_all(c)))


def file_name(c: Column) -> Column:
    """Host and path of an IRI with ``_`` for all but word characters, ``-`` and ``.``."""
    rest = F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.regexp_extract(rest, "^//([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(F.concat_ws("_", host, F.replace(F.btrim(path, F.lit("/")), F.lit("/"), F.lit("_"))), r"(?U)[^\w\-.]", "_")


def expand(term: Column, vocab: str) -> Column:
    """A prefixed name of the fixed prefixes, or a name of ``vocab``."""
    out = F.concat(F.lit(vocab), term)
    for prefix, ns in (("rdf:", RDF), ("rdfs:", RDFS), ("owl:", OWL)):
        out = F.when(term.startswith(prefix), F.concat(F.lit(ns), F.substring(term, len(prefix) + 1, 1 << 20))).otherwise(out)
    return safe_iri(out)


def prefixes(vocab: str, name: str = "v") -> dict[str, str]:
    """Prefixes of exports."""
    return {name: vocab, "rdfs": RDFS, "owl": OWL, "rdf": RDF, "xsd": XSD, "skos": SKOS}
