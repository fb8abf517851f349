"""Loading libraries into a store: extract, map, resolve, parse notes, write once."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms
from .config import Context, Library
from .operators import entities, mapping, notes, ontology
from .sinks.store import Store
from .sources import http_pages, json_docs, rdf_files

log = logging.getLogger(__name__)


def extract(spark: SparkSession, library: Library, context: Context, fetch: Callable[..., bytes] = http_pages.get) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(items, collections, quads) of a library by its load mode."""
    headers = {context.key_header: library.api_key} if library.api_key else {}
    none = terms.empty(spark)
    if library.load_mode == "json":
        read = lambda end: _fetched(spark, f"{library.api_url}/{end}", library.api_query_params, headers, fetch)
        return read("items"), read("collections"), none
    if library.load_mode == "rdf":
        data = http_pages.fetch_rdf(f"{library.api_url}/items", library.api_query_params, library.rdf_export_format, headers, fetch)
        files = spark.createDataFrame([("export.rdf", bytearray(data))], "path string, content binary")
        return None, None, rdf_files.parse_files(files, f"{library.base_url}/items/", library.base_url)
    quads, json_files = rdf_files.read_directory(spark, library.load_from, f"{library.base_url}/items/", library.base_url)
    parts: dict[str, DataFrame | None] = {"items": None, "collections": None}
    for path in json_files:
        docs = json_docs.read(spark, path)
        try:
            kind = json_docs.classify(docs)
        except ValueError as e:
            log.error("%s: %s", path, e)
            continue
        parts[kind] = docs if parts[kind] is None else json_docs.after(parts[kind], docs)
    return parts["items"], parts["collections"], quads


def _fetched(spark: SparkSession, url: str, params: dict, headers: dict, fetch) -> DataFrame:
    if fetch is http_pages.get:
        return http_pages.read_pages(spark, url, params, headers)
    return json_docs.from_objects(spark, [d for page in http_pages.pages(url, params, headers, fetch, pause=0) for d in page])


def build(spark: SparkSession, libraries: list[Library], context: Context, as_of: str | None = None, strict: bool = False, fetch: Callable[..., bytes] = http_pages.get, sources: dict | None = None) -> DataFrame:
    """All quads of the libraries. ``sources``: (items, collections, quads) by library name, instead of extracting.

    Mentions of all libraries are resolved together, in the order of the configuration.
    """
    as_of = as_of or datetime.now(timezone.utc).isoformat()
    quads, tags, mentions = [], None, None
    for number, library in enumerate(libraries):
        library.problems()
        items, collections, own = (sources or {}).get(library.name) or extract(spark, library, context, fetch)
        quads.append(own)
        if library.save_to:
            for kind, docs in (("items", items), ("collections", collections)):
                if docs is not None:
                    json_docs.write_lines(docs, f"{library.save_to}/{library.library_id}_{kind}.json")
        if items is None and collections is None:
            continue
        m = mapping.map_library(spark, library, context.vocab, items, collections, as_of, strict, number)
        quads.append(m.quads)
        tags = m.tags if tags is None else tags.unionByName(m.tags)
        mentions = m.mentions if mentions is None else mentions.unionByName(m.mentions)
    base = terms.union(*quads) if quads else terms.empty(spark)
    if mentions is not None:
        known = entities.known_labels(base)
        known_tags = base.where((F.col("p") == terms.TYPE) & (F.col("o") == context.vocab + "tag")).select(F.col("s").alias("node"))
        base = terms.union(base, entities.tag_quads(tags, context.vocab, known_tags), entities.entity_quads(mentions, context.vocab, known, strict))
    return terms.as_set(base)


def parse_notes(quads: DataFrame, library: Library, context: Context, found: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Quads of a library's notes. ``found`` (note, html): other notes than those of the note field."""
    settings = library.notes_parser
    rules = load_mapping(settings.get("mapping")) or notes.MAPPING
    rules = {k: v for k, v in rules.items()}
    kb_rules = rules.pop("KnowledgeBase", [])
    html = found if found is not None else notes.select_notes(quads, context.vocab + "note", library.base_url)
    out = notes.note_quads(notes.annotations(html, rules), library.base_url, load_mapping(settings.get("metadata")), rules.get("@context"))
    if settings.get("knowledge_base_mapping") and kb_rules:
        out = terms.union(out, notes.link_entities(out, quads, kb_rules, library.knowledge_base_graph, library.base_url, settings.get("fuzzy", 90)))
    return terms.as_set(out)


def load_mapping(given) -> dict | None:
    """A mapping from a mapping, a JSON text, or a JSON file."""
    if not given or isinstance(given, dict):
        return given or None
    try:
        return json.loads(given)
    except json.JSONDecodeError:
        pass
    try:
        with open(given, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, json.JSONDecodeError) as e:
        log.error("no mapping in %r: %s", given, e)
        return None


def refresh(store: Store, libraries: list[Library], context: Context, as_of: str | None = None, strict: bool = False, schema: DataFrame | None = None, **how) -> int:
    """Rebuilds the whole store as a new version; returns its number of quads."""
    spark = store.spark
    quads = build(spark, libraries, context, as_of, strict, **how)
    if schema is not None:
        quads = terms.union(quads, ontology.ontology(schema, context.vocab))
    auto = [x for x in libraries if x.notes_parser.get("auto")]
    if auto:
        from .runtime import cut

        quads = cut(spark, quads)
        for library in auto:  # a later library's notes see the nodes that an earlier one's made
            quads = cut(spark, terms.union(quads, parse_notes(quads, library, context, strict=strict)))
    store.write(quads)
    return store.count()
