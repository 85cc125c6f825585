"""Collections: immutable parts of tables behind pointers that are written once.

``<root>/<name>/gen=<n>-<writer>/<table>`` holds the rows that generation n added as
Parquet, and the ids of documents it removed (``tombstones``). A generation is a list of
such parts, so a commit costs what changed, not what is stored; when the list grows
long, ``compact`` writes all rows that are alive as one part. ``<root>/<name>/CURRENT.<n>``
names the parts of generation n. A writer fills a folder of its own and then creates
the next pointer, which only one writer can do, so documents, chunks, postings, vectors
and snapshots change together and no writer touches what another one wrote. All paths
go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.errors import IdentityError, IngestError

POINTER, MARK, TOMBSTONES = "CURRENT", "lexigrid-collection/2", "tombstones"
#: Parts of a generation beyond which all live rows are written as one.
MAX_PARTS = 8
#: Hashes and ids are most of what a chunk needs beside its text: zstd halves hexadecimal digits, and large dictionaries hold them once a file.
WRITING = {"compression": "zstd", "parquet.dictionary.page.size": str(8 * 1024 * 1024)}
_NAME = re.compile(r"[A-Za-z0-9._-]+")


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name or "") or name in {".", ".."}:
        raise IngestError(f"bad collection name {name!r}")
    return name


class _Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Make a file that is not there yet, whole from the first moment; False if another writer made it."""
        beside = f"{p}-{uuid.uuid4().hex}.new"
        stream = self.fs.create(self.path(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(beside), self.path(p), none)  # without an option, a file in the way is an error
        except Py4JJavaError as e:
            self.delete(beside)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def names(self, p: str, folders: bool) -> list[str]:
        if not self.fs.exists(self.path(p)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p)) if s.isDirectory() == folders)

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def _pointers(files: _Files, base: str) -> list[str]:
    """Names of pointers, oldest first."""
    return [n for n in files.names(base, False) if re.fullmatch(rf"{POINTER}\.\d+", n)]


@dataclass
class Collection:
    spark: SparkSession
    root: str
    name: str
    state: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_name(self.name)
        self.files = _Files(self.spark, self.root)
        self.refresh()

    @property
    def base(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    @property
    def generation(self) -> int:
        return self.state.get("generation", 0)

    @property
    def identity(self) -> dict | None:
        """Provider, model and width of the vectors, once they are bound."""
        return self.state.get("identity")

    def refresh(self) -> None:
        """Look at the pointers again; until then a reader stays with the generation it opened."""
        found = _pointers(self.files, self.base)
        if not found:
            if any(not n.startswith("gen=") for n in self.files.names(self.base, True)):
                raise IngestError(f"{self.base} is not a collection")
            self.state = {}
            return
        state = json.loads(self.files.read(f"{self.base}/{found[-1]}"))
        if state.get("mark") != MARK:
            raise IngestError(f"{self.base} is not a collection of this library")
        self.state = state

    def has(self, table: str) -> bool:
        return any(table in p["tables"] for p in self.state.get("parts", []))

    def read(self, table: str) -> DataFrame:
        """The rows of a table that are alive: those whose document no later part removed."""
        parts = self.state.get("parts", [])
        place = lambda p, t: self.spark.read.parquet(f"{self.base}/{p['folder']}/{t}")
        held = [(p["generation"], place(p, table)) for p in parts if table in p["tables"]]
        if not held:
            raise IngestError(f"collection {self.name} has no {table}")
        dead = [place(p, TOMBSTONES).select("document_id", F.lit(p["generation"]).alias("_lx_dead")) for p in parts if TOMBSTONES in p["tables"]]
        whole = reduce(DataFrame.unionByName, [df.withColumn("_lx_born", F.lit(n)) for n, df in held])
        if dead:
            last = reduce(DataFrame.union, dead).groupBy("document_id").agg(F.max("_lx_dead").alias("_lx_dead"))
            whole = whole.join(last, "document_id", "left").filter("_lx_dead IS NULL OR _lx_born >= _lx_dead").drop("_lx_dead")
        return whole.drop("_lx_born")

    def check_identity(self, identity: dict | None) -> None:
        """Vectors of one embedding model only; a collection with vectors takes no documents without."""
        if self.identity and identity != self.identity:
            raise IdentityError(f"collection {self.name} holds vectors of {self.identity}, not {identity}")

    def draft(self, identity: dict | None = None) -> Draft:
        """A generation in the making, in a folder of its own."""
        self.check_identity(identity)
        number = self.generation + 1
        return Draft(self, number, f"gen={number}-{uuid.uuid4().hex}", identity)

    def commit(self, added: dict[str, DataFrame], removed: DataFrame | None = None, identity: dict | None = None) -> int:
        """Add rows to tables and remove documents (document_id) of earlier generations. Returns the new generation."""
        draft = self.draft(identity)
        for table, df in added.items():
            draft.write(table, df)
        return draft.commit(removed)

    def compact(self, most: int = MAX_PARTS) -> int:
        """Write all live rows as one part if there are more than ``most``. Returns the generation."""
        if len(self.state.get("parts", [])) <= most:
            return self.generation
        draft = self.draft(self.identity)
        for table in sorted({t for p in self.state["parts"] for t in p["tables"]} - {TOMBSTONES}):
            draft.write(table, self.read(table))
        return draft.commit(whole=True)

    def drop_old(self, keep: int = 2) -> None:
        """Delete pointers older than the newest ``keep``, and folders of those generations that no kept pointer names."""
        found = _pointers(self.files, self.base)
        states = [json.loads(self.files.read(f"{self.base}/{n}")) for n in found[-keep:]]
        if not states:
            return
        named = {p["folder"] for s in states for p in s["parts"]}
        for pointer in found[:-keep]:
            self.files.delete(f"{self.base}/{pointer}")
        for folder in self.files.names(self.base, True):
            if folder.startswith("gen=") and folder not in named and int(folder[4:].split("-")[0]) < states[0]["generation"]:
                self.files.delete(f"{self.base}/{folder}")


@dataclass
class Draft:
    collection: Collection
    number: int
    folder: str
    identity: dict | None
    tables: list[str] = field(default_factory=list)

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Write the rows that this generation adds to a table; returns them as they are stored."""
        path = f"{self.collection.base}/{self.folder}/{table}"
        df.write.options(**WRITING).parquet(path)
        self.tables.append(table)
        return self.collection.spark.read.schema(df.schema).parquet(path)

    def commit(self, removed: DataFrame | None = None, whole: bool = False) -> int:
        """Make this the next generation: all that was written, less documents ``removed`` from earlier ones (all earlier rows if ``whole``).

        A writer that finds the next pointer taken gets an error, and readers see the
        other one's generation; what it wrote lies in its own folder until ``drop_old``.
        """
        col = self.collection
        if removed is not None:
            self.write(TOMBSTONES, removed.select("document_id").distinct())
        part = {"generation": self.number, "folder": self.folder, "tables": sorted(self.tables)}
        earlier = [] if whole else col.state.get("parts", [])
        state = {"mark": MARK, "generation": self.number, "parts": [*earlier, part], "identity": self.identity or col.identity, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        if not col.files.create(f"{col.base}/{POINTER}.{self.number:012d}", json.dumps(state)):
            raise IngestError(f"another writer has committed generation {self.number} of {col.name}")
        col.state = state
        return self.number


def list_collections(spark: SparkSession, root: str) -> list[str]:
    files = _Files(spark, root)
    base = root.rstrip("/")
    found = {n: _pointers(files, f"{base}/{n}") for n in files.names(root, True) if _NAME.fullmatch(n)}
    return [n for n, own in found.items() if own and json.loads(files.read(f"{base}/{n}/{own[-1]}")).get("mark") == MARK]
