"""The engine: files to chunks, vectors and edges in a store, and questions to that store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrake import shipping
from quillrake.config import Settings
from quillrake.functions import language, normalize
from quillrake.functions.normalize import strip
from quillrake.operators import checks, chunks, context, embed, graph, registry, search, stats, structure
from quillrake.plans.observe import Run
from quillrake.sources import files as sources
from quillrake.sources.store import Store


def placed(blocks: DataFrame, chain: normalize.Chain = normalize.DEFAULT) -> DataFrame:
    """Blocks normalised (blank ones dropped), tagged with languages and placed in sections."""
    clean = blocks.where("raw_text is not null").withColumn("text", chain(F.col("raw_text"))).where(strip(F.col("text")) != "")
    tagged = language.tag(clean)
    return structure.sections_of(tagged)


class Engine:
    #: Paths that reprocess_all() lists for one job.
    paths_per_job = 10_000

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), embedder: embed.Embedder | None = None, chain: normalize.Chain = normalize.DEFAULT, extractors: registry.Registry = registry.DEFAULT):
        if problems := settings.problems():
            raise ValueError("; ".join(problems))
        shipping.ensure(spark)
        self.spark, self.settings, self.chain, self.extractors, self.run = spark, settings, chain, extractors, Run()
        self.embedder = embedder or embed.HashedWords(settings.embedding_dimension)
        self.store = Store(spark, path, dimension=self.embedder.dimension)

    # ---- ingestion

    def ingest(self, path: str | list[str], recursive: bool = False, metadata: dict[str, str] | None = None, skip_known: bool = False) -> DataFrame:
        """Ingests a file, a list of files or a folder as one job; the rows of documents it made."""
        return self.ingest_files(sources.scan(self.spark, path, recursive, self.settings, self.extractors.extensions()), metadata, skip_known)

    def ingest_files(self, files: DataFrame, metadata: dict[str, str] | None = None, skip_known: bool = False, replaces: DataFrame | None = None) -> DataFrame:
        """Ingests files (file_path, size_bytes, content); the rows of documents. `run` holds the steps' times and row counts.

        Rows that break a rule of their kind are left out and told as a warning of their document. replaces: documents
        (document_id) whose rows all go in the same commit.
        """
        run = self.run = Run()
        admitted = sources.admitted(files, self.settings, self.extractors.extensions())
        if skip_known:
            known = self.store.load("documents", status="completed").select("file_hash").distinct()
            admitted = admitted.join(known, "file_hash", "left_anti")
        admitted = admitted.persist()
        raw = self.extractors.extract(admitted, self.settings).persist()
        blocks = placed(raw, self.chain).persist()
        parents = chunks.parents(blocks, self.settings).persist()
        children = chunks.children(blocks, parents, self.settings).persist()
        vectors = embed.embed(children.select("chunk_id", "document_id", "chunk_idx", "language", "block_type", "text"), self.embedder, self.settings.embedding_batch).where("embedding is not null").persist()
        edges = graph.as_edges(graph.semantic_edges(vectors, self.settings.similarity_threshold)).persist()
        rules = {"parents": checks.parents(parents), "children": checks.children(children), "edges": checks.edges(edges)}
        documents = self._documents(admitted, raw, blocks, parents, children, edges, metadata, rules).persist()
        fine = {name: df.where(F.size("violations") == 0).drop("violations") for name, df in rules.items()}
        held = fine["parents"].join(chunks.child_ids(fine["children"]), "parent_id", "left")
        tables = {"edges": fine["edges"], "vectors": vectors, "children": fine["children"], "parents": held, "documents": documents}
        try:
            for name, df in (("extract", raw), ("place", blocks), ("chunk", children), ("embed", vectors), ("link", edges)):
                with run.stage(name):
                    run.count(name, df.count())  # fills what the commits then read
            with run.stage("commit"):
                owners = admitted.select("document_id")
                if replaces is None:
                    self.store.commit(tables, owners)
                else:
                    self.store.replace_documents(tables, replaces, owners)
        finally:
            for df in (documents, edges, vectors, children, parents, blocks, raw, admitted):
                df.unpersist()
        return self.store.read("documents")

    def _documents(self, admitted, raw, blocks, parents, children, edges, metadata, rules) -> DataFrame:
        count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
        share = language.distribution(blocks).select("document_id", F.create_map(*[x for k in ("ar", "en", "mixed") for x in (F.lit(k), F.col(k))]).alias("language_distribution"), "primary_language")
        total = chunks.totals(blocks, self.settings).select("document_id", "total_tokens", "hierarchy_depth")
        why = raw.groupBy("document_id").agg(F.max("error").alias("why"))
        own = {f"{k}": F.lit(v) for k, v in (metadata or {}).items()}
        broken = reduce(DataFrame.unionByName, (df.select("document_id", F.explode("violations").alias("violation")) for df in rules.values()))
        broken = broken.groupBy("document_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("left out: "), "violation"))).alias("broken"))
        pages = raw.groupBy("document_id").agg(F.max("page_number").alias("total_pages"))
        made = admitted.drop("content").join(sources.copies(admitted).drop("file_hash"), "file_path", "left")
        for df in (broken, pages, total, share, why, count(parents, "parent_count"), count(children, "child_count"), count(edges, "edge_count")):
            made = made.join(df, "document_id", "left")
        failed = F.coalesce("error_message", F.when(F.coalesce("child_count", F.lit(0)) == 0, F.coalesce("why", F.lit("no content"))))
        warnings = F.concat(F.filter(F.array(F.when(F.col("is_duplicate"), "duplicate content"), F.when(~F.col("mime_expected"), "unexpected type")), lambda x: x.isNotNull()), F.coalesce("broken", F.array().cast("array<string>")))
        return made.select(
            "document_id", "file_path", "file_hash", "format", F.when(failed.isNull(), "completed").otherwise("failed").alias("status"), "total_tokens", "hierarchy_depth", "primary_language", "language_distribution",
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("parent_count", "child_count", "edge_count")), failed.alias("error_message"), warnings.alias("warnings"),
            F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]).cast("map<string,string>").alias("metadata"), F.current_timestamp().alias("created_at"), "total_pages",
        )

    def reprocess_all(self) -> DataFrame:
        """Ingests all documents again from their paths, in place of what is stored.

        What is stored goes in the commit that brings the new rows, so files that cannot be read lose nothing. Documents
        whose files are gone stay as they are. Paths are read from the table in parts, each a job of its own.
        """
        old = self.store.read("documents").select("document_id", "file_path")
        part = F.pmod(F.xxhash64("file_path"), F.lit(max(1, -(-old.count() // self.paths_per_job))))
        for n in sorted(r.part for r in old.select(part.alias("part")).distinct().collect()):
            mine = old.where(part == n)
            paths = [r.file_path for r in mine.select("file_path").distinct().collect() if sources.exists(self.spark, r.file_path)]  # of one part
            if paths:
                files = sources.scan(self.spark, paths, settings=self.settings)
                read = mine.where(F.col("file_path").isin(paths)).select("document_id")
                self.ingest_files(files, replaces=read)
        return self.store.read("documents")

    def delete(self, document_id: str) -> dict[str, int]:
        return self.store.delete_documents([document_id])

    # ---- questions

    def _hits(self, query: str, k: int, where: dict | None) -> DataFrame:
        vector = self.embedder.embed([query], "query")[0]
        found = search.top_k(self.store.read("vectors"), vector, k, where).select("chunk_id", "score", "distance")
        ranked = found.join(self.store.read("children"), "chunk_id")
        return ranked.withColumns({"query_id": F.lit(query), "rank": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "chunk_id"))})  # k rows

    def search(self, query: str, k: int = 5, document_id: str | None = None, language: str | None = None, with_parents: bool = True) -> DataFrame:
        where = {c: v for c, v in (("document_id", document_id), ("language", language)) if v is not None}
        hits = self._hits(query, k, where)
        return (search.with_parents(hits, self.store.read("parents")) if with_parents else hits).orderBy("rank")

    def hybrid_search(self, query: str, k: int = 5, document_id: str | None = None, weight: float = 0.3) -> DataFrame:
        hits = self._hits(query, 2 * k, {"document_id": document_id} if document_id else None)
        return search.hybrid(hits, F.col("query_id"), k, weight).orderBy("hybrid_rank")

    def similar_chunks(self, chunk_id: str, k: int = 5, same_document: bool = True) -> DataFrame:
        return search.similar_chunks(self.store.read("vectors"), chunk_id, k, same_document)

    def expand(self, chunk_ids: list[str], **options) -> DataFrame:
        ids = self.spark.createDataFrame([(i,) for i in chunk_ids], "chunk_id string")
        return context.expand(ids, self.store.read("children"), self.store.read("parents"), self.store.read("edges"), **options)

    def expand_many(self, chunk_ids: list[str], deduplicate: bool = True, **options) -> DataFrame:
        """expand() of chunks in the order given (rank), without those that one before them shows already as a sibling."""
        links = {r.chunk_id: (r.prev_chunk_id, r.next_chunk_id) for r in self.store.get_many("children", chunk_ids, "chunk_id", "prev_chunk_id", "next_chunk_id").collect()}  # of the ids asked for
        ordered = context.deduplicated(chunk_ids, links if options.get("siblings", True) else {}) if deduplicate else chunk_ids
        ranks = self.spark.createDataFrame([(i, n) for n, i in enumerate(ordered)], "chunk_id string, rank int")
        return self.expand(list(dict.fromkeys(ordered)), **options).join(ranks, "chunk_id").orderBy("rank")

    def retrieval_context(self, query: str, k: int = 5, max_tokens: int | None = None) -> str:
        row = context.retrieval_context(self._hits(query, k, None), max_tokens).first()
        return row.context if row else ""

    def outline(self, document_id: str) -> DataFrame:
        return context.outline(self.store.load("parents", document_id=document_id)).orderBy("parent_idx")

    def statistics(self) -> DataFrame:
        return stats.pipeline_stats(self.store.read("documents"))

    def documents(self, **where) -> DataFrame:
        return self.store.load("documents", **where)

    def children(self, document_id: str) -> DataFrame:
        return self.store.load("children", document_id=document_id).orderBy("chunk_idx")

    def parents(self, document_id: str) -> DataFrame:
        return self.store.load("parents", document_id=document_id).orderBy("parent_idx")

    def edges(self, document_id: str) -> DataFrame:
        return self.store.load("edges", document_id=document_id)

    def query_file(self, path: str, query: str, k: int = 5, max_tokens: int | None = None) -> str:
        """Ingests a file, unless its content is known, and answers with a context."""
        self.ingest(path, skip_known=True)
        return self.retrieval_context(query, k, max_tokens)
