"""Tables of documents, parents, children, vectors and edges in versioned Parquet folders.

A table is cut into buckets by a hash of the document's id. A change writes new folders for the buckets that it touches
and then one manifest, numbered one up, that names the folder of each bucket; the largest manifest is the table. Nothing
is deleted or renamed on the way, so a job that dies at any step leaves the table as it was, and DataFrames of earlier
versions stay readable until `vacuum` drops what the last manifests do not name. Two writers of one table cannot both
publish a number: the second fails and may try again. Upserts and deletes are joins within the touched buckets.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "documents": "document_id STRING, file_path STRING, file_hash STRING, format STRING, status STRING, total_tokens BIGINT, hierarchy_depth INT, primary_language STRING, language_distribution MAP<STRING,DOUBLE>, parent_count BIGINT, child_count BIGINT, edge_count BIGINT, error_message STRING, warnings ARRAY<STRING>, metadata MAP<STRING,STRING>, created_at TIMESTAMP, updated_at TIMESTAMP, total_pages INT",
    "parents": "parent_id STRING, document_id STRING, section_no INT, part INT, parent_idx INT, text STRING, token_count INT, section_path ARRAY<STRING>, page_range STRUCT<start:INT,end:INT>, language STRING, block_count BIGINT, child_ids ARRAY<STRING>",
    "children": "chunk_id STRING, document_id STRING, chunk_idx INT, text STRING, token_count INT, language STRING, block_type STRING, parent_id STRING, section_path ARRAY<STRING>, page_number INT, position_in_parent INT, prev_chunk_id STRING, next_chunk_id STRING",
    "vectors": "chunk_id STRING, document_id STRING, language STRING, block_type STRING, embedding ARRAY<FLOAT>",
    "edges": "edge_id STRING, source_chunk_id STRING, target_chunk_id STRING, edge_type STRING, document_id STRING, similarity_score DOUBLE",
}
KEYS = {"documents": "document_id", "parents": "parent_id", "children": "chunk_id", "vectors": "chunk_id", "edges": "edge_id"}


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old without the keys of new, and new; of new rows with one key the last by order stays."""
    last = Window.partitionBy(key).orderBy(F.desc(order) if order else F.lit(1))
    fresh = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def deleted(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti").select(*old.columns)


def edges_without(edges: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges of no deleted document and without a deleted chunk at either end."""
    left = edges.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    for end in ("source_chunk_id", "target_chunk_id"):
        left = left.join(chunks.select(F.col("chunk_id").alias(end)).distinct(), end, "left_anti")
    return left.select(*edges.columns)


def updated(old: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """old with the column replaced where changes (key, column) has a value that is not null."""
    new = changes.select(key, F.col(column).alias("__new"))
    return old.join(new, key, "left").select(*[F.coalesce("__new", column).alias(c) if c == column else F.col(c) for c in old.columns])


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to publish."""


class Store:
    tables, keys = TABLES, KEYS
    #: The column whose hash deals rows into buckets.
    owner = "document_id"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, dimension: int | None = None):
        """buckets: of tables that are created (some thousands for a large corpus); dimension: of all vectors, if it is to be checked."""
        self.spark, self.path, self.buckets, self.dimension = spark, path.rstrip("/"), buckets, dimension

    # ---- manifests

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self, table: str) -> list[int]:
        fs, where = self._fs(f"{self.path}/{table}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, table: str, version: int) -> dict | None:
        """A manifest; None if its writer died before its end."""
        fs, where = self._fs(f"{self.path}/{table}/manifests/{version:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _current(self, table: str) -> tuple[int, dict]:
        """(number, manifest) of the table as it is; (0, an empty manifest) before the first."""
        for version in reversed(self.versions(table)):
            if found := self._manifest(table, version):
                return version, found
        return 0, {"buckets": self.buckets, "folders": {}}

    def _publish(self, table: str, base: int, manifest: dict) -> None:
        version = max([base, *self.versions(table)]) + 1
        if version > base + 1 and self._current(table)[0] != base:
            raise Conflict(f"{table}: version {base} was read, {version - 1} is current")
        fs, where = self._fs(f"{self.path}/{table}/manifests/{version:012d}.json")
        try:
            out = fs.create(where, False)
        except Exception as e:
            raise Conflict(f"{table}: version {version} exists") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.owner), F.lit(buckets)).cast("int")

    def _folders(self, table: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/{folder}/bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.tables[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[table])

    def _rewrite(self, table: str, change: Callable[[DataFrame], DataFrame], touched: DataFrame | None = None) -> None:
        """Replaces the rows of the buckets that touched's owners lie in (all without it) by change(old rows)."""
        base, manifest = self._current(table)
        n = manifest["buckets"]
        some = None if touched is None else {r.b for r in touched.select(self._bucket(n).alias("b")).distinct().collect()}  # buckets at most
        if some is not None and not some:
            return
        new, folder = change(self._folders(table, manifest, some)), f"data-{uuid.uuid4().hex}"
        shaped = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.tables[table]).schema])
        shaped.withColumn("bucket", self._bucket(n)).repartition("bucket").sortWithinPartitions("bucket", self.owner).write.partitionBy("bucket").parquet(f"{self.path}/{table}/{folder}")
        fs, where = self._fs(f"{self.path}/{table}/{folder}")
        made = {f.getPath().getName().removeprefix("bucket="): folder for f in fs.listStatus(where) if f.getPath().getName().startswith("bucket=")}
        kept = {b: f for b, f in manifest["folders"].items() if some is not None and int(b) not in some}
        self._publish(table, base, {"buckets": n, "folders": kept | made})

    # ---- tables

    def read(self, table: str) -> DataFrame:
        """The table as it is now; an empty one if nothing was written yet."""
        return self._folders(table, self._current(table)[1])

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces the whole table."""
        self._rewrite(table, lambda old: df)

    def upsert(self, table: str, df: DataFrame, owners: DataFrame | None = None) -> None:
        """Adds rows, in place of those with their keys; only the buckets of their documents are written again.

        owners: the documents of the rows (document_id), or more, where they are cheaper to have than the rows.
        """
        if "updated_at" in self.tables[table]:
            df = df.withColumn("updated_at", F.current_timestamp())
        if table == "vectors" and self.dimension:
            bad = df.where(F.col("embedding").isNull() | (F.size("embedding") != self.dimension)).select("chunk_id").take(5)
            if bad:
                raise ValueError(f"vectors of {self.dimension} components are needed: {', '.join(r.chunk_id for r in bad)}")
        self._rewrite(table, lambda old: upserted(old, df, self.keys[table]), df if owners is None else owners)

    def commit(self, tables: dict[str, DataFrame], owners: DataFrame | None = None) -> None:
        for name in ("edges", "vectors", "children", "parents", "documents"):  # a document is there once the rest is
            if name in tables:
                self.upsert(name, tables[name], owners)

    def replace_documents(self, tables: dict[str, DataFrame], documents: DataFrame, owners: DataFrame) -> None:
        """commit() that also removes all other rows of these documents (document_id): for documents made anew."""
        for name in ("edges", "vectors", "children", "parents", "documents"):
            new, gone = tables[name], documents.select("document_id").distinct()
            if "updated_at" in self.tables[name]:
                new = new.withColumn("updated_at", F.current_timestamp())
            self._rewrite(name, lambda old, new=new, gone=gone, name=name: upserted(old.join(gone, "document_id", "left_anti").select(*old.columns), new, self.keys[name]), gone.unionByName(owners))

    def load(self, table: str, **where) -> DataFrame:
        """Rows whose columns equal the given values, or are among them for a list; one document's lie in one bucket."""
        conditions = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in where.items()]
        return self._of_owner(table, where.get(self.owner)).where(reduce(lambda a, b: a & b, conditions, F.lit(True)))

    def _of_owner(self, table: str, owner) -> DataFrame:
        _, manifest = self._current(table)
        if owner is None:
            return self._folders(table, manifest)
        values = list(owner) if isinstance(owner, (list, tuple, set)) else [owner]
        rows = self.spark.createDataFrame([(v,) for v in values], f"{self.owner} string").select(self._bucket(manifest["buckets"]).alias("b"))
        return self._folders(table, manifest, {r.b for r in rows.distinct().collect()})

    def get_many(self, table: str, keys: list[str], *columns: str) -> DataFrame:
        """The rows of these keys; of some columns if any are named, so that vectors stay unread where nobody asks."""
        found = self.load(table, **{self.keys[table]: keys})
        return found.select(*columns) if columns else found

    def documents_by_status(self, status: str) -> DataFrame:
        return by_status(self.read("documents"), status)

    def exists(self, table: str, key: str) -> bool:
        return bool(self.load(table, **{self.keys[table]: key}).limit(1).count())

    def delete_documents(self, ids: list[str]) -> dict[str, int]:
        """Removes documents and all that is theirs; rows removed from each table."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "document_id string")
        chunks = self.read("children").join(gone, "document_id", "left_semi").select("chunk_id").distinct().persist()
        removed = {}
        try:
            for name in ("edges", "vectors", "parents", "children", "documents"):
                old = self.read(name)
                if name == "edges":
                    lost = old.join(edges_without(old, chunks, gone).select("edge_id"), "edge_id", "left_anti")
                else:
                    lost = old.join(gone, "document_id", "left_semi")
                lost = lost.select(*dict.fromkeys((self.keys[name], "document_id"))).persist()
                removed[name] = lost.count()
                if removed[name]:
                    self._rewrite(name, lambda old, lost=lost, name=name: deleted(old, lost, self.keys[name]), lost)
                lost.unpersist()
        finally:
            chunks.unpersist()
        return removed

    def delete_by_parent(self, parent_id: str) -> int:
        """Removes a parent's children; how many there were."""
        return self.delete("children", [r.chunk_id for r in self.load("children", parent_id=parent_id).select("chunk_id").collect()])  # one parent's

    def delete(self, table: str, ids: list) -> int:
        """Removes rows by key; how many there were."""
        found = self.load(table, **{self.keys[table]: ids}).select(*dict.fromkeys((self.keys[table], "document_id"))).persist()
        n = found.count() if ids else 0
        if n:
            self._rewrite(table, lambda old: deleted(old, found, self.keys[table]), found)
        found.unpersist()
        return n

    def update_embeddings(self, changes: DataFrame) -> None:
        """New vectors for chunks: (chunk_id, embedding)."""
        old = self.read("vectors")
        self._rewrite("vectors", lambda old: updated(old, changes, "chunk_id", "embedding"), old.join(changes, "chunk_id", "left_semi"))

    def update_metadata(self, changes: DataFrame) -> None:
        """Entries added to documents' metadata, the new value for a key that exists: (document_id, metadata)."""
        new = changes.select("document_id", F.col("metadata").alias("__new"))
        merged = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False))), F.coalesce("__new", F.create_map().cast("map<string,string>")))
        self._rewrite("documents", lambda old: old.join(new, "document_id", "left").select(*[merged.alias(c) if c == "metadata" else F.col(c) for c in old.columns]), changes)

    def count_by_document(self, table: str) -> DataFrame:
        return self.read(table).groupBy("document_id").agg(F.count("*").alias("n"))

    def document_ids(self, table: str) -> DataFrame:
        return self.read(table).select("document_id").distinct()

    def metadata(self, table: str) -> dict:
        """Where a table is, how many rows it has and which version is current."""
        return {"path": f"{self.path}/{table}", "rows": self.read(table).count(), "version": self._current(table)[0]}

    def ensure(self) -> None:
        """Publishes an empty first version of each table that has none."""
        for name in self.tables:
            if not self._current(name)[0]:
                self._publish(name, 0, {"buckets": self.buckets, "folders": {}})

    def clear(self, confirm: bool = False) -> None:
        """Empties all tables; what they held stays on disk until vacuum()."""
        if not confirm:
            raise ValueError("clear() needs confirm=True")
        for name in self.tables:
            base, _ = self._current(name)
            self._publish(name, base, {"buckets": self.buckets, "folders": {}})

    def vacuum(self, keep: int = 2, hours: float = 24) -> int:
        """Drops manifests but the last `keep`, and data older than so many hours that none of these names; folders dropped."""
        dropped, before = 0, (time.time() - hours * 3600) * 1000
        for table in self.tables:
            versions = [v for v in self.versions(table) if self._manifest(table, v)]
            if not versions:
                continue
            named = {f for v in versions[-keep:] for f in self._manifest(table, v)["folders"].values()}
            fs, where = self._fs(f"{self.path}/{table}")
            for f in fs.listStatus(where):
                name = f.getPath().getName()
                if name.startswith("data-") and name not in named and f.getModificationTime() <= before:
                    fs.delete(f.getPath(), True)
                    dropped += 1
            for v in versions[:-keep]:
                fs.delete(self._fs(f"{self.path}/{table}/manifests/{v:012d}.json")[1], False)
        return dropped

    def export_json(self, table: str, path: str) -> None:
        self.read(table).write.mode("overwrite").json(path)

    def import_json(self, table: str, path: str) -> None:
        self.upsert(table, self.spark.read.schema(self.tables[table]).json(path))


def by_status(documents: DataFrame, status: str) -> DataFrame:
    return documents.where(F.col("status") == status)


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks as flat payloads for stores without arrays: section_path joined by a pipe, null as an empty string."""
    return chunks.withColumn("section_path", F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), "|"))


def from_payload(payloads: DataFrame) -> DataFrame:
    """The inverse of payload: an empty string is an empty path."""
    return payloads.withColumn("section_path", F.when(F.coalesce("section_path", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("section_path", r"\|")))
