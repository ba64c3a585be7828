"""Raw files kept as they came: one row a document, its bytes and their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.operators import formats
from quillrake.sources.store import Store


class RawStore(Store):
    tables = {"files": "document_id STRING, ext STRING, file_path STRING, size_bytes BIGINT, file_hash STRING, content BINARY, created_at TIMESTAMP"}
    keys = {"files": "document_id"}

    def save(self, files: DataFrame, overwrite: bool = False) -> int:
        """Adds files (document_id, file_path, content); ids that are there are refused unless overwrite. Rows added."""
        new = files.select("document_id", formats.extension(F.col("file_path")).alias("ext"), "file_path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("file_hash"), "content", F.current_timestamp().alias("created_at"))
        old = self.read("files")
        if not overwrite and (known := new.join(old.select("document_id"), "document_id", "left_semi").select("document_id").take(5)):
            raise FileExistsError(", ".join(r.document_id for r in known))
        n = new.count()
        self.upsert("files", new)
        return n

    def content(self, document_id: str, ext: str = "") -> bytes:
        row = self._of(document_id, ext).select("content").first()
        if row is None:
            raise FileNotFoundError(document_id)
        return bytes(row.content)

    def text(self, document_id: str, ext: str = "") -> str:
        row = self._of(document_id, ext).select(formats.decoded(F.col("content")).alias("t")).first()
        if row is None:
            raise FileNotFoundError(document_id)
        return row.t

    def _of(self, document_id: str, ext: str) -> DataFrame:
        return self.load("files", document_id=document_id, **({"ext": ext.lstrip(".").lower()} if ext else {}))

    def info(self, document_id: str) -> dict | None:
        row = self._of(document_id, "").drop("content").first()
        return row and row.asDict() | {"size_kb": round(row.size_bytes / 1024, 3), "size_mb": round(row.size_bytes / 1024**2, 3)}

    def path(self, document_id: str, ext: str = "") -> str | None:
        """The path that a document's file came from; None if it is not stored."""
        row = self._of(document_id, ext).select("file_path").first()
        return row and row.file_path

    def ids(self) -> DataFrame:
        return self.document_ids("files")

    def listed(self) -> DataFrame:
        return self.read("files").drop("content")

    def find_by_hash(self, file_hash: str) -> DataFrame:
        return self.listed().where(F.col("file_hash") == file_hash.lower())

    def known(self, files: DataFrame) -> DataFrame:
        """files (content) whose bytes are stored already, with the ids that hold them."""
        have = self.listed().groupBy("file_hash").agg(F.array_sort(F.collect_set("document_id")).alias("stored_as"))
        return files.withColumn("file_hash", F.sha2("content", 256)).join(have, "file_hash")
