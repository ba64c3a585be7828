"""The engine end to end on a folder of small files, and its command line."""

import io
import zipfile

import pytest

from quillrake.config import Settings
from quillrake.plans import cli
from quillrake.plans.engine import Engine

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx():
    para = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Name</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Value</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = para("The Title", "Heading1") + para("Some words about vineyards here.") + table
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("files")
    long = "\n\n".join(f"# Part {i}\n\n" + " ".join(f"Sentence {i} {j} speaks of topic {i}. It goes on." for j in range(40)) for i in range(6))
    (where / "long.md").write_text(long)
    (where / "copy.md").write_text(long)
    (where / "page.html").write_text("<html><body><nav>skip this menu</nav><h1>Harbour history</h1><p>The harbour was built of stone.</p></body></html>")
    (where / "note.txt").write_bytes("INTRODUCTION\r\n\r\nThe café stands near the river.\r\n\r\n- a\r\n- b".encode())
    (where / "word.docx").write_bytes(docx())
    (where / "empty.txt").write_text("")
    (where / "broken.docx").write_bytes(b"PK\x03\x04 nothing")
    (where / "odd.xyz").write_text("x")
    return where


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("store")), Settings(similarity_threshold=0.5))
    made.ingest(str(folder))
    made.ingest(str(folder / "odd.xyz"))  # a folder's files of other kinds are passed over, a named one fails
    return made


def test_documents(engine):
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in engine.documents().collect()}
    assert {k: r.status for k, r in rows.items()} == {"long.md": "completed", "copy.md": "completed", "page.html": "completed", "note.txt": "completed", "word.docx": "completed", "broken.docx": "failed", "odd.xyz": "failed"}
    assert "unsupported" in rows["odd.xyz"].error_message
    assert rows["long.md"].hierarchy_depth == 2 and rows["long.md"].parent_count >= 6
    assert sorted([rows["long.md"].warnings, rows["copy.md"].warnings]) == [[], ["duplicate content"]]
    assert engine.statistics().first().failed_documents == 2


def test_chunks_and_links(engine):
    for doc in engine.documents(status="completed").collect():
        kids = engine.children(doc.document_id).collect()
        assert [k.chunk_idx for k in kids] == list(range(doc.child_count))
        for a, b in zip(kids, kids[1:]):
            assert (a.next_chunk_id, b.prev_chunk_id) == (b.chunk_id, a.chunk_id)
        held = {i for p in engine.parents(doc.document_id).collect() for i in p.child_ids}
        assert held == {k.chunk_id for k in kids if k.parent_id}
    for e in engine.store.read("edges").collect():
        assert 0.5 <= e.similarity_score <= 1 and e.source_chunk_id != e.target_chunk_id


def test_search(engine):
    top = engine.search("harbour built of stone", k=2).collect()
    assert "harbour" in top[0].text and top[0].score >= top[1].score
    assert "vineyards" in engine.hybrid_search("vineyards words", k=1).first().text
    assert "river" in engine.retrieval_context("river café", k=1)
    assert engine.retrieval_context("river café", k=3, max_tokens=5).endswith("...")
    doc = engine.documents(format="markdown").first().document_id
    assert {r.document_id for r in engine.search("topic", k=3, document_id=doc).collect()} == {doc}
    chunk = engine.children(doc).first().chunk_id
    told = engine.expand([chunk]).first()
    assert told.parent_text and told.parent_text in told.context_text
    assert [r.title for r in engine.outline(doc).collect()][0] == "Part 0"
    assert chunk not in [r.chunk_id for r in engine.similar_chunks(chunk, 3).collect()]


def test_again_and_delete(engine, folder):
    before = {r.document_id for r in engine.documents().collect()}
    n = engine.store.read("children").count()
    engine.ingest(str(folder / "note.txt"))
    assert {r.document_id for r in engine.documents().collect()} == before and engine.store.read("children").count() == n
    doc = next(r for r in engine.documents().collect() if r.file_path.endswith("note.txt"))
    gone = engine.delete(doc.document_id)
    assert gone["documents"] == 1 and gone["children"] == doc.child_count
    assert engine.children(doc.document_id).count() == 0 and not engine.store.exists("documents", doc.document_id)
    assert "river" in engine.query_file(str(folder / "note.txt"), "river café", 1)


def test_command_line(engine, spark, capsys):
    path = engine.store.path
    assert cli.main(["--data", path, "stats"], spark) == 0 and "total_documents: 7" in capsys.readouterr().out
    assert cli.main(["--data", path, "search", "stone harbour", "--top-k", "1"], spark) == 0 and "harbour" in capsys.readouterr().out
    assert cli.main(["--data", path, "info", "nothing"], spark) == 1


def test_expand_many_and_times(engine):
    doc = next(r for r in engine.documents().collect() if r.file_path.endswith("long.md"))
    ids = [k.chunk_id for k in engine.children(doc.document_id).collect()][:4]
    assert [r.chunk_id for r in engine.expand_many([ids[1], ids[0], ids[2], ids[3]]).collect()] == [ids[1], ids[3]]
    assert [r.chunk_id for r in engine.expand_many([ids[1], ids[0]], deduplicate=False).collect()] == [ids[1], ids[0]]
    assert [s[0] for s in engine.run.stages] == ["extract", "place", "chunk", "embed", "link", "commit"] and engine.run.rows("chunk") >= 0


def test_reprocess(engine, folder):
    """All documents are made anew in one commit; those whose files are gone stay."""
    before = {r.document_id: r.updated_at for r in engine.documents().collect()}
    held = engine.documents()
    (folder / "page.html").rename(folder / "page.moved")
    try:
        after = {r.document_id: r.updated_at for r in engine.reprocess_all().collect()}
    finally:
        (folder / "page.moved").rename(folder / "page.html")
    assert set(after) == set(before) and held.count() == len(before)
    assert {r.file_path.rsplit("/", 1)[1] for r in engine.documents().collect() if after[r.document_id] == before[r.document_id]} == {"page.html"}
    assert engine.children(next(i for i in before)).count() >= 0


def test_registry(spark, tmp_path):
    """A format of one's own: lines that start with a star are headings."""
    from quillrake.operators import markup, registry

    mine = registry.parser("stars", ("star",), lambda text: [markup._block(line.lstrip("*"), "heading" if line[0] == "*" else "paragraph", 0, 1 if line[0] == "*" else None, 2) for line in text.split("\n") if line], text=True)
    extractors = registry.DEFAULT.register(mine)
    assert extractors.of("/x/A.STAR").format == "stars" and extractors.of("x.zip") is None and "stars" in extractors.available()
    (tmp_path / "a.STAR").write_text("*Title\nsome words of a paragraph")
    made = Engine(spark, str(tmp_path / "store"), extractors=extractors)
    row = made.ingest(str(tmp_path / "a.STAR")).first()
    assert (row.status, row.format, row.total_pages, row.child_count) == ("completed", "stars", 2, 2)


def test_atomic_blocks(spark):
    from quillrake.operators import chunks

    table = " ".join(f"cell {i}." for i in range(400))
    blocks = spark.createDataFrame([("d", 0, table, "table", "en", 1, 0, [""], "")], "document_id string, block_idx int, text string, block_type string, language string, page_number int, section_no int, section_path array<string>, x string")
    none = chunks.parents(blocks).where("false")
    kids = lambda s: chunks.children(blocks, none, s).count()
    assert kids(Settings()) == 1 and kids(Settings(force_split_atomic=True, max_atomic_tokens=5_000)) == 1 and kids(Settings(force_split_atomic=True, max_atomic_tokens=100)) > 5
    marked = chunks.mark_atomic(blocks, Settings(force_split_atomic=True, max_atomic_tokens=100)).first()
    assert marked.atomic and marked.split_anyway


def test_pages_are_typed(spark):
    from quillrake.operators import plain_text

    rows = ["CHAPTER 1", "a | b\nc | d", "- one\n- two", "2. Results", "2.1 More results", "Some words that end here.", "x\ty\nz\tw\nq\tr", None]
    typed = plain_text.typed_pages(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, raw_text string")).orderBy("i").collect()
    assert [(r.block_type, r.heading_level) for r in typed] == [("heading", 1), ("table", None), ("list", None), ("heading", 2), ("heading", 3), ("paragraph", None), ("table", None), (None, None)]


def test_settings():
    assert Settings().problems() == []
    assert len(Settings(min_tokens=600, similarity_threshold=2).problems()) == 2
    assert (Settings().overlap("ar"), Settings().overlap("en"), Settings(language_aware_overlap=False).overlap("ar")) == (60, 50, 50)
