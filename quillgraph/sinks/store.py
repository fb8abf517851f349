"""The store: a Parquet quad table partitioned by graph, in versioned folders.

A write makes a new version folder ``v=...`` with a folder a graph in it, and then a pointer file of the
next number, which lists the graphs' folders; the highest number is in use. A pointer appears by one
rename and none is taken away before, so readers are never disturbed and a failed write leaves nothing
in use. Extending and removing rewrite the graphs that they touch; the next pointer keeps the others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms

DEFAULT_GRAPH = "__default__"
_POINTER = "CURRENT-"


def _key(g: str | None) -> str:
    """A graph's name in folder names, which may not hold all its characters."""
    return DEFAULT_GRAPH if g is None else g.encode().hex().upper()


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files, through Hadoop's interface: any store that Spark can write

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _pointers(self) -> list[int]:
        return sorted(int(x[len(_POINTER) :]) for x in self._names(self.path) if x.startswith(_POINTER) and x[len(_POINTER) :].isdigit())

    def folders(self) -> dict[str, str]:
        """The folder, under the store's, of each graph of the current version."""
        numbers = self._pointers()
        if not numbers:
            return {}
        fs, p = self._fs(f"{self.path}/{_POINTER}{numbers[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, folders: dict[str, str]) -> None:
        fs, temporary = self._fs(f"{self.path}/new-{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        number = (self._pointers() or [0])[-1] + 1
        if not fs.rename(temporary, self._fs(f"{self.path}/{_POINTER}{number}")[1]):
            raise OSError(f"another writer made version {number} of {self.path}")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return terms.empty(self.spark)
        schema = ", ".join(f"{c} string" for c in terms.COLUMNS if c != "g") + ", v string, graph string"
        df = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{x}" for x in folders])
        return df.withColumn("g", F.when(F.col("graph") != DEFAULT_GRAPH, F.unhex("graph").cast("string"))).select(terms.COLUMNS)

    def quads(self) -> DataFrame:
        """All quads; selections on ``p`` and ``s`` skip row groups."""
        return self._read(sorted(self.folders().values()))

    def graph(self, g: str | None) -> DataFrame:
        """The quads of one graph, from its folder alone."""
        return self._read([x for k, x in self.folders().items() if k == _key(g)])

    def _save(self, quads: DataFrame) -> dict[str, str]:
        """Quads in a new version folder, sorted so that patterns skip row groups; the folder of each graph."""
        version = f"v={uuid.uuid4().hex}"
        df = quads.select(terms.COLUMNS).withColumn("graph", F.coalesce(F.hex(F.encode("g", "UTF-8")), F.lit(DEFAULT_GRAPH))).drop("g")
        # range partitioning by content lets a large graph have many files
        df.repartitionByRange("graph", "p", "s").sortWithinPartitions("graph", "p", "s").write.partitionBy("graph").parquet(f"{self.path}/{version}")
        return {x.split("=", 1)[1]: f"{version}/{x}" for x in self._names(f"{self.path}/{version}") if x.startswith("graph=")}

    def write(self, quads: DataFrame, distinct: bool = True) -> None:
        """Replaces the content by ``quads``."""
        self._point(self._save(terms.as_set(quads) if distinct else quads))

    def _touched(self, quads: DataFrame) -> dict[str, str]:
        """Folders of the graphs that ``quads`` names; a row a graph comes to the driver."""
        now = self.folders()
        keys = {_key(r[0]) for r in quads.select("g").distinct().collect()}
        return {k: x for k, x in now.items() if k in keys}

    def extend(self, quads: DataFrame) -> None:
        """Adds quads; the graphs that have none of them stay as they are."""
        old = self._touched(quads)
        made = self._save(terms.as_set(terms.union(self._read(sorted(old.values())), quads)))
        self._point({**self.folders(), **made})

    def remove(self, quads: DataFrame) -> None:
        old = self._touched(quads)
        made = self._save(terms.difference(self._read(sorted(old.values())), quads)) if old else {}
        self._point({**{k: x for k, x in self.folders().items() if k not in old}, **made})

    def optimize(self) -> None:
        """Rewrites the current version into few sorted files."""
        self.write(self.quads(), distinct=False)

    def vacuum(self) -> None:
        """Removes all folders and pointers that the current version does not use."""
        used, last = set(self.folders().values()), (self._pointers() or [0])[-1]
        for name in self._names(self.path):
            fs, p = self._fs(f"{self.path}/{name}")
            if name.startswith("v="):
                kept = [x for x in self._names(f"{self.path}/{name}") if f"{name}/{x}" in used]
                for x in self._names(f"{self.path}/{name}") if kept else ():
                    if x.startswith("graph=") and x not in kept:
                        fs.delete(self._fs(f"{self.path}/{name}/{x}")[1], True)
                if not kept:
                    fs.delete(p, True)
            elif name.startswith(_POINTER) and name != f"{_POINTER}{last}":
                fs.delete(p, False)

    def backup(self, to: str) -> int:
        """Copies the current version to ``to``; returns the number of quads."""
        here, there = self._fs(self.path)[1], self._fs(to)[1]
        fs = self._fs(to)[0]
        a, b = str(fs.makeQualified(here)).rstrip("/") + "/", str(fs.makeQualified(there)).rstrip("/") + "/"
        if a.startswith(b) or b.startswith(a):
            raise ValueError("a backup cannot lie in the store, or the store in it")
        other = Store(self.spark, to)
        other.write(self.quads(), distinct=False)
        other.vacuum()
        return other.count()

    def count(self) -> int:
        return self.quads().count()

    def graphs(self) -> list[str]:
        return [r[0] for r in self.quads().select("g").where("g IS NOT NULL").distinct().orderBy("g").collect()]


def pattern(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """Quads with the given terms; None matches all."""
    for column, value in (("s", s), ("p", p), ("o", o), ("g", g)):
        if value is not None:
            quads = quads.where(F.col(column) == value)
    return quads


def graph_counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count("*").alias("n"))
