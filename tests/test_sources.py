"""The raw store, changes to stored tables, and timed runs."""

import pytest

from quillrake.config import Settings
from quillrake.plans.observe import Run
from quillrake.sources import files
from quillrake.sources.raw import RawStore
from quillrake.sources.store import Conflict, Store, from_payload, payload


def test_raw_store(spark, tmp_path):
    raw = RawStore(spark, str(tmp_path))
    given = spark.createDataFrame([("d1", "/in/A.TXT", bytearray("é".encode())), ("d2", "/in/b.md", bytearray(b"x"))], "document_id string, file_path string, content binary")
    assert raw.save(given) == 2
    with pytest.raises(FileExistsError):
        raw.save(given)
    assert raw.save(given, overwrite=True) == 2 and raw.listed().count() == 2
    assert raw.content("d1") == "é".encode() and raw.text("d1", ".txt") == "é" and raw.info("d2")["size_bytes"] == 1
    with pytest.raises(FileNotFoundError):
        raw.content("d1", "md")
    h = raw.info("d1")["file_hash"]
    assert [r.document_id for r in raw.find_by_hash(h.upper()).collect()] == ["d1"]
    assert [r.stored_as for r in raw.known(given.where("document_id = 'd2'")).collect()] == [["d2"]]
    assert raw.delete("files", ["d1", "zz"]) == 1 and not raw.exists("files", "d1") and raw.metadata("files")["rows"] == 1
    with pytest.raises(ValueError):
        raw.clear()
    raw.clear(confirm=True)
    assert raw.listed().count() == 0 and raw.info("d2") is None


def test_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    vectors = spark.createDataFrame([("a", "d", "en", "paragraph", [1.0]), ("b", "d", "en", "paragraph", [2.0])], store.tables["vectors"])
    store.upsert("vectors", vectors)
    store.update_embeddings(spark.createDataFrame([("a", [3.0])], "chunk_id string, embedding array<float>"))
    assert {r.chunk_id: list(r.embedding) for r in store.read("vectors").collect()} == {"a": [3.0], "b": [2.0]}
    assert [tuple(r) for r in store.count_by_document("vectors").collect()] == [("d", 2)]
    row = spark.createDataFrame([("d", {"x": "1", "y": "2"})], "document_id string, metadata map<string,string>")
    blank = spark.createDataFrame([], store.tables["documents"])
    store.write("documents", blank.unionByName(row, allowMissingColumns=True))
    store.update_metadata(spark.createDataFrame([("d", {"y": "3"})], "document_id string, metadata map<string,string>"))
    assert store.read("documents").first().metadata == {"x": "1", "y": "3"}
    store.export_json("vectors", str(tmp_path / "j"))
    other = Store(spark, str(tmp_path / "t"))
    other.import_json("vectors", str(tmp_path / "j"))
    assert other.read("vectors").count() == 2 and other.load("vectors", chunk_id=["a"]).count() == 1


def test_runs(spark):
    run = Run()
    with run.stage("count"):
        run.counted(spark.range(5), "five").collect()
    with pytest.raises(ZeroDivisionError), run.stage("fail"):
        1 / 0
    assert run.rows("five") == 5 and run.stages[1][2] and "failed" in run.report() and run.seconds > 0


def rows(spark, store, n, text):
    return spark.createDataFrame([(f"c{i}", f"d{i}", "en", text, [float(i)]) for i in n], store.tables["vectors"])


def test_a_job_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """Killed while writing data, before the manifest, or amid the manifest: the table is as it was, and goes on."""
    store = Store(spark, str(tmp_path), buckets=4)
    store.upsert("vectors", rows(spark, store, range(10), "old"))
    held = store.read("vectors")

    def kinds():
        return sorted(r.block_type for r in Store(spark, str(tmp_path)).read("vectors").collect())

    with pytest.raises(Exception):  # noqa: B017 - the job fails amid its data
        bad = rows(spark, store, range(5), "new").selectExpr("*", "raise_error('died') AS x").selectExpr("chunk_id", "document_id", "language", "coalesce(cast(x AS string), block_type) AS block_type", "embedding")
        store.upsert("vectors", bad)
    assert kinds() == ["old"] * 10
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            store.upsert("vectors", rows(spark, store, range(5), "new"))
    assert kinds() == ["old"] * 10
    (tmp_path / "vectors" / "manifests" / "000000000002.json").write_text('{"buckets": 4, "fold')
    assert kinds() == ["old"] * 10
    store.upsert("vectors", rows(spark, store, range(5), "new"))
    assert kinds() == ["new"] * 5 + ["old"] * 5 and store.versions("vectors") == [1, 2, 3]
    assert [r.block_type for r in held.collect()] == ["old"] * 10
    assert store.vacuum(keep=1, hours=0) >= 1 and kinds() == ["new"] * 5 + ["old"] * 5


def test_two_writers(spark, tmp_path):
    one, two = Store(spark, str(tmp_path), buckets=4), Store(spark, str(tmp_path), buckets=4)
    one.upsert("vectors", rows(spark, one, range(3), "a"))
    base, manifest = two._current("vectors")
    one.upsert("vectors", rows(spark, one, range(2), "b"))
    with pytest.raises(Conflict):
        two._publish("vectors", base, manifest)
    assert sorted(r.block_type for r in two.read("vectors").collect()) == ["a", "b", "b"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    store.upsert("vectors", rows(spark, store, range(100), "a"))
    before = store._current("vectors")[1]["folders"]
    store.upsert("vectors", rows(spark, store, [7], "b"))
    after = store._current("vectors")[1]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("vectors").count() == 100
    assert store.load("vectors", document_id="d7").first().block_type == "b" and store.get_many("vectors", ["c7", "c8", "zz"], "chunk_id").count() == 2
    assert store.delete_documents(["d7", "d9"])["vectors"] == 2 and store.read("vectors").count() == 98
    checked = Store(spark, str(tmp_path / "n"), dimension=2)
    with pytest.raises(ValueError):
        checked.upsert("vectors", rows(spark, checked, [1], "a"))
    store.clear(confirm=True)
    assert store.read("vectors").count() == 0


def test_payloads(spark):
    made = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "chunk_id string, section_path array<string>")
    flat = payload(made)
    assert [r.section_path for r in flat.orderBy("chunk_id").collect()] == ["x|y", "", ""]
    assert [r.section_path for r in from_payload(flat).orderBy("chunk_id").collect()] == [["x", "y"], [], []]


def test_scan(spark, tmp_path):
    for name in ("a.TXT", "b.xyz", "c.md"):
        (tmp_path / name).write_text("x" * 10)
    names = lambda df: sorted(r.file_path.rsplit("/", 1)[1] for r in df.select("file_path").collect())
    assert names(files.scan(spark, str(tmp_path))) == ["a.TXT", "c.md"]
    assert names(files.scan(spark, [str(tmp_path / "b.xyz")])) == ["b.xyz"]
    (tmp_path / "big.txt").write_text("x" * 2_000_000)
    told = {r.file_path.rsplit("/", 1)[1]: r for r in files.admitted(files.scan(spark, str(tmp_path), settings=Settings(max_file_size_mb=1)), Settings(max_file_size_mb=1)).collect()}
    assert told["big.txt"].status == "failed" and told["big.txt"].content is None and told["a.TXT"].status == "pending"
    assert {r.is_duplicate for r in files.copies(files.admitted(files.scan(spark, str(tmp_path)))).where("file_path like '%c.md'").collect()} == {True}
