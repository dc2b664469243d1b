"""The catalogue of built artifacts: existence of an id is the cache test.

An artifact is a Parquet folder named by its id; its `_SUCCESS` marker is written
last, so a half-written one doesn't count.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import ids, schema
from gleanery.functions import vectors
from gleanery.operators import chunkers, relations
from gleanery.scratch import spread
from gleanery.settings import canonical_json

log = logging.getLogger(__name__)
KINDS = ("documents", "chunks", "indexes", "evalset", "results")


class NotFound(LookupError):
    """No such artifact."""


class TextStore:
    """Small texts by name below a folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def get(self, name: str) -> str | None:
        fs, where = self._at(name)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        fs, where = self._at(name)
        stream = fs.create(where, True)
        stream.write(bytearray(text.encode()))
        stream.close()


class Catalogue:
    """Artifacts below a root folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, fixtures: str | None = None):
        self.spark, self.root, self.fixtures = spark, root.rstrip("/"), fixtures

    def path(self, kind: str, name: str = "") -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; there are {KINDS}")
        return f"{self.root}/{kind}" + (f"/{name}" if name else "")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return bool(fs.exists(where))

    def ready(self, kind: str, name: str) -> bool:
        """Whether the artifact is complete; an index needs its manifest."""
        path = self.path(kind, name)
        return self.exists(f"{path}/manifest.json") if kind == "indexes" else self.exists(f"{path}/_SUCCESS")

    def names(self, kind: str) -> list[str]:
        fs, where = self._fs(self.path(kind))
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in found if self.ready(kind, n))

    def resolve(self, kind: str, name: str, allow_fixture: bool = False) -> str:
        """The artifact's path; only where asked for, and with a warning, the fixture's instead."""
        if self.ready(kind, name):
            return self.path(kind, name)
        if allow_fixture and self.fixtures and self.exists(f"{self.fixtures}/{kind}/{name}"):
            log.warning("using the fixture for %s %s", kind, name)
            return f"{self.fixtures}/{kind}/{name}"
        raise NotFound(f"no {kind} artifact {name!r} below {self.root}")

    def read(self, kind: str, name: str, allow_fixture: bool = False) -> DataFrame:
        return self.spark.read.parquet(self.resolve(kind, name, allow_fixture))

    def write(self, kind: str, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(kind, name))
        return self.spark.read.parquet(self.path(kind, name))

    def cached(self, kind: str, name: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        if force or not self.ready(kind, name):
            return self.write(kind, name, build())
        return self.spark.read.parquet(self.path(kind, name))

    # --- chunk sets ---

    def summaries(self, chunks: DataFrame, p: dict, caller: Callable[[str, str], str]) -> DataFrame:
        """key, answer for the tables among `chunks`: answers of earlier calls, and new ones from `caller` for the rest, which are kept."""
        path = f"{self.root}/answers/table_summary"
        wanted = chunkers.summary_requests(chunks, p)
        known = self.spark.read.parquet(path) if self.exists(path) else self.spark.createDataFrame([], "key string, answer string")
        new = wanted.join(known.select("key").distinct(), "key", "left_anti")
        chunkers.answered(new, p["model"], caller).write.mode("append").parquet(path)
        return self.spark.read.parquet(path).join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("answer").alias("answer"))

    def build_chunk_set(
        self, corpus: str, chunker: str, over: dict | None = None, role: str = "standalone", parent_set: str | None = None,
        force: bool = False, caller: Callable[[str, str], str] | None = None,
    ) -> tuple[str, DataFrame]:
        """Chunk a corpus once for each set of parameters; children need the chunk set of their parents.

        Tables are summarized by `caller` (prompt, model) where mock_llm is off.

        Role and parents are part of the parameters, and so of the id.  No chunk at all is an error, and so is a child without a parent.
        """
        if (role == "child") != (parent_set is not None):
            raise ValueError("a child chunk set, and only one, names its parents' chunk set")
        p = chunkers.resolve(chunker, over)
        hashed = p if role == "standalone" else {**p, "role": role}
        name = ids.chunk_set_id(corpus, chunker, {**hashed, "parent_chunk_set_id": parent_set} if parent_set else hashed)
        if self.ready("chunks", name) and not force:
            return name, self.read("chunks", name)
        docs, answers = self.read("documents", corpus), None
        if chunkers.asks_a_model(chunker, p):
            if caller is None:
                raise ValueError("summaries by a real model need a caller")
            answers = self.summaries(chunkers.specs(docs, chunker, over), p, caller)
        rows = chunkers.chunk(docs, chunker, over, role, answers).withColumn("chunk_set_id", F.lit(name))
        if parent_set:
            rows = relations.require_parents(rows, self.read("chunks", parent_set))
        built = self.write("chunks", name, rows.select(*(f.name for f in schema.CHUNK.fields)))
        if built.isEmpty():
            raise ValueError(f"{name} has no chunks")
        return name, built

    def load_chunk_set(self, name: str) -> DataFrame:
        rows = self.read("chunks", name)
        if rows.isEmpty():
            raise NotFound(f"chunk set {name!r} is empty")
        return rows

    def load_evalset(self, corpus: str, split: str | None = None) -> DataFrame:
        """Eval pairs of a corpus, of one split where given; none is an error."""
        rows = self.read("evalset", corpus).filter(F.col("corpus") == corpus)
        rows = rows if split is None else rows.filter(F.col("split") == split)
        if rows.isEmpty():
            raise NotFound(f"no eval pairs for {corpus!r}" + (f" in {split}" if split else ""))
        return rows

    # --- indexes ---

    def build_index(self, chunk_set: str, embedder: str = "hash", over: dict | None = None, force: bool = False) -> str:
        """Embed a chunk set's embed_text once for each set of parameters; the manifest is written last."""
        p = vectors.embedder_params(embedder, over)
        name = ids.index_id(chunk_set, embedder, p)
        if not force and self.manifest(name) is not None:
            return name
        began = datetime.now(timezone.utc)
        chunks = self.load_chunk_set(chunk_set)
        store = VectorStore(self, name)
        store.replace(chunks, embedder, p)
        first = store.rows().select(F.size("embedding").alias("dim")).first()
        import pyspark

        self._put(f"{self.path('indexes', name)}/manifest.json", json.dumps({
            "index_id": name, "chunk_set_id": chunk_set, "corpus": chunks.first()["corpus"], "embedder": embedder, "embedder_params": canonical_json(p), "vector_count": store.count(), "dim": first["dim"],
            "build_duration_s": (datetime.now(timezone.utc) - began).total_seconds(), "library_versions": {"pyspark": pyspark.__version__}, "schema_version": schema.SCHEMA_VERSION, "created_at": began.isoformat(),
        }))
        return name

    def manifest(self, name: str) -> dict | None:
        """The manifest of an index; None where absent or corrupt, so that it's built again."""
        path = f"{self.path('indexes', name)}/manifest.json"
        if not self.exists(path):
            return None
        text = TextStore(self.spark, self.path("indexes", name)).get("manifest.json")
        try:
            found = json.loads(text)
        except ValueError:
            found = {}
        if not {f.name for f in schema.MANIFEST.fields} <= set(found):
            log.warning("skipped the corrupt manifest of %s", name)
            return None
        return found

    def manifests(self, corpus: str | None = None) -> list[dict]:
        fs, where = self._fs(self.path("indexes"))
        names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
        found = [m for n in names if (m := self.manifest(n))]
        return [m for m in found if corpus is None or m["corpus"] == corpus]

    def _put(self, path: str, text: str) -> None:
        folder, _, name = path.rpartition("/")
        TextStore(self.spark, folder).put(name, text)


_COLUMNS = ("chunk_id", "doc_id", "corpus", "chunk_set_id", "chunker", "embedding")


class VectorStore:
    """The vectors of one index: chunk_id, doc_id, corpus, chunk_set_id, chunker, embedding."""

    def __init__(self, catalogue: Catalogue, index: str):
        self.catalogue, self.index = catalogue, index
        self.root = catalogue.path("indexes", index)

    def _versions(self) -> list[int]:
        """Complete versions of the table; a new one is written beside those that others may be reading."""
        fs, where = self.catalogue._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[8:]) for n in names if n.startswith("vectors-") and self.catalogue.exists(f"{self.root}/{n}/_SUCCESS"))

    def rows(self) -> DataFrame:
        found = self._versions()
        if not found:
            raise NotFound(f"index {self.index!r} has no vectors")
        return self.catalogue.spark.read.parquet(f"{self.root}/vectors-{found[-1]:06}")

    def _put(self, rows: DataFrame) -> None:
        """Write the next version; all but the last two older ones go."""
        found = self._versions()
        spread(rows, "chunk_id").write.mode("overwrite").parquet(f"{self.root}/vectors-{(found[-1] if found else 0) + 1:06}")
        for old in found[:-1]:
            fs, where = self.catalogue._fs(f"{self.root}/vectors-{old:06}")
            fs.delete(where, True)

    def count(self) -> int:
        return self.rows().count()

    def get(self, wanted: DataFrame) -> DataFrame:
        """The rows of the chunk ids in `wanted`."""
        return self.rows().join(wanted.select("chunk_id"), "chunk_id", "left_semi")

    @staticmethod
    def embedded(chunks: DataFrame, embedder: str, params: dict | None = None) -> DataFrame:
        one = chunks.dropDuplicates(["chunk_id"])
        return one.select(*_COLUMNS[:-1], vectors.embedding(F.col("embed_text"), embedder, params).alias("embedding"))

    def replace(self, chunks: DataFrame, embedder: str, params: dict | None = None) -> None:
        self._put(self.embedded(chunks, embedder, params))

    def upsert(self, vectors_: DataFrame) -> None:
        """Add rows, in place of those with the same chunk_id; nothing happens for no rows.

        The first rows make the index.  Vectors must be as long as those that are
        there and as each other.  Of several rows of one chunk_id any is kept.
        """
        if vectors_.isEmpty():
            return
        new = vectors_.select(*_COLUMNS).dropDuplicates(["chunk_id"])
        found = self._versions()
        old = self.rows() if found else None
        first = (old if found else new).select(F.size("embedding").alias("n")).first()["n"]
        odd = F.raise_error(F.concat(F.lit("vector of another length: "), "chunk_id")).cast("array<float>")
        new = new.withColumn("embedding", F.when(F.size("embedding") == first, F.col("embedding")).otherwise(odd))
        if not found:
            self._put(new)
            return
        self._put(old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.select(*old.columns)))

    def search(self, queries: DataFrame, k: int, **equal: str) -> DataFrame:
        """Neighbours of the queries' vectors among rows whose doc_id, corpus, chunk_set_id or chunker equal the given ones."""
        from gleanery.operators.retrieval import dense

        rows = self.rows()
        for column, value in equal.items():
            if column not in ("doc_id", "corpus", "chunk_set_id", "chunker"):
                raise ValueError(f"can't filter by {column}")
            rows = rows.filter(F.col(column) == value)
        return dense(queries, rows, k)
