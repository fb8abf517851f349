"""The service surface as plain functions of one object: export, backup, reload, CSV, notes, queries, logs."""

from __future__ import annotations

import logging
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline, terms
from .config import Context, Library, load_config
from .operators import notes
from .plans import algebra, sparql, visual
from .sinks import csv_pivot, rdf_export
from .sinks.store import Store
from .sources import csv_quads


class _Memory(logging.Handler):
    def __init__(self, most: int):
        super().__init__()
        self.lines: deque[str] = deque(maxlen=most)
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))

    def emit(self, record):
        self.lines.append(self.format(record))


class Engine:
    def __init__(self, spark: SparkSession, store: str, config: dict | str, strict: bool = False, export_dir: str | None = None):
        self.spark, self.store, self.strict = spark, Store(spark, store), strict
        self.context, self.libraries = load_config(config)
        self.export_dir = export_dir or f"{store.rstrip('/')}-exports"
        self._log = _Memory(2000)
        logging.getLogger("quillgraph").addHandler(self._log)

    @property
    def vocab(self) -> str:
        return self.context.vocab

    def libs(self) -> list[dict]:
        return [{"name": x.name, "base_url": x.base_url, "load_mode": x.load_mode, "problems": x.problems()} for x in self.libraries]

    def graphs(self) -> dict:
        return {"named_graphs": self.store.graphs(), "len": self.store.count()}

    def reload(self, **how) -> int:
        return pipeline.refresh(self.store, self.libraries, self.context, strict=self.strict, **how)

    def optimize(self) -> None:
        self.store.optimize()

    def backup(self, to: str) -> int:
        return self.store.backup(to)

    def _graph(self, graph: str | None) -> str | None:
        if graph is None:
            return None
        graph = graph.strip().strip("<>").strip()
        if graph not in self.store.graphs():
            raise ValueError(f"no graph {graph!r}")
        return graph

    def export(self, format: str = "trig", graph: str | None = None) -> str:
        """Writes an export; returns its path, which is named after the graph."""
        if format not in rdf_export.FORMATS:
            raise ValueError(f"unsupported export format {format!r}")
        graph = self._graph(graph)
        from .functions.iri import file_name

        name = self.spark.range(1).select(file_name(F.lit(graph))).first()[0] if graph else "store"
        path = f"{self.export_dir}/{name}.{rdf_export.FORMATS[format]}"
        rdf_export.write(self.store.graph(graph) if graph else self.store.quads(), path, format, graph, self.vocab)
        return path

    def csv(self, graph: str | None = None, load_csv: str | None = None, delete: bool = False) -> dict:
        """Writes the CSV export, then loads a CSV file if one is named."""
        target = graph.strip().strip("<>").strip() if graph else None
        path = f"{self.export_dir}/export.csv"
        csv_pivot.write(self.store.quads(), path, self._graph(graph))
        if load_csv and load_csv != path:
            table = csv_quads.read(self.spark, load_csv)
            self.store.write(csv_pivot.upsert(self.store.quads(), table, target, delete, self.strict))
        return {"path": path} | self.graphs()

    def parse_notes(self, graph: str | None = None, query: str | None = None, push: bool = True) -> int:
        """Parses the notes of the libraries (of one graph); returns how many there are."""
        wanted = graph.strip().strip("<>").strip() if graph else None
        count = 0
        for library in self.libraries:
            if wanted and library.base_url != wanted:
                continue
            quads = self.store.quads()
            found = notes.notes_by_query(self.sparql(query)) if query else notes.select_notes(quads, self.vocab + "note", library.base_url)
            count += found.count()
            new = pipeline.parse_notes(quads, library, self.context, found)
            if push:
                self.store.extend(new)
        return count

    def dataset(self) -> algebra.Dataset:
        return algebra.Dataset(self.store.quads())

    def sparql(self, text: str) -> DataFrame:
        return sparql.query(self.dataset(), text)

    def visual(self, query: dict, limit: int | None = visual.LIMIT) -> DataFrame:
        return visual.run(self.dataset(), query, visual.bibliographic_model(self.vocab), limit)

    def facets(self, predicate: str, contains: str | None = None, limit: int | None = None) -> DataFrame:
        return visual.facets(self.dataset(), predicate, visual.bibliographic_model(self.vocab), contains, limit)

    def logs(self, level: str | None = None, last: int = 100) -> list[str]:
        lines = [x for x in self._log.lines if level is None or f" {level.upper()} " in x]
        return lines[-last:]

    def clear_logs(self) -> None:
        self._log.lines.clear()


__all__ = ["Context", "Engine", "Library", "terms"]
