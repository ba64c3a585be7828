"""Hand-derived cases and random cross-checks of the engine's operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrake.config import Settings
from quillrake.functions import language, normalize
from quillrake.functions import text as tx
from quillrake.operators import checks, chunks, context, embed, formats, graph, markup, plain_text, search, structure
from quillrake.sources import store
from quillrake.streaming import ingest


def apply(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_normalisers(spark):
    assert apply(spark, normalize.arabic, "أحمد إلى آخر", "كـــتاب", "فَتْحَة") == ["احمد الى اخر", "كتاب", "فتحة"]
    assert apply(spark, normalize.whitespace, "a  b \r\n  c", "　x ", None) == ["a b\nc", "x", None]
    assert apply(spark, normalize.fix_mojibake, "itâ€™s", "waitâ€¦", "plain") == ["it's", 'wait"¦', "plain"]
    assert apply(spark, normalize.unicode_chain, "a​b\u0007c\nd", "é", "x́‏") == ["abc\nd", "é", "x́"]
    assert apply(spark, normalize.light_stem, "والكتاب", "من كتابها", "") == ["كتاب", "من كتاب", ""]
    assert apply(spark, normalize.clean, " «a»\x00  – ‘b’ ") == ["\"a\" - 'b'"]
    assert apply(spark, normalize.lines, " a \n\n\n\n b", "x") == ["a\n\nb", "x"]
    assert apply(spark, normalize.arabic_ratio, "مرحبا hello", "  ") == [0.5, 0.0]
    chain = normalize.DEFAULT.add("clean", normalize.clean).disable("arabic")
    assert chain.names == ["unicode", "arabic", "whitespace", "clean"] and len(chain.remove("clean")) == 3
    assert apply(spark, chain, "أ  –") == ["أ -"] and apply(spark, chain.enable("arabic"), "أ") == ["ا"]
    assert apply(spark, normalize.AGGRESSIVE, "٣ ؟ مى\n\n\n\nx") == ["3 ? مي\n\nx"]


def test_language(spark):
    cases = ["Hello World", "مرحبا hello", "12345", "École", "؟،", "  ", None]
    rows = language.tag(spark.createDataFrame(list(enumerate(cases)), "i int, text string")).orderBy("i").collect()
    assert [r.language for r in rows] == ["en", "mixed", "en", "en", "ar", "en", "en"]
    assert (rows[3].en_ratio, rows[1].ar_ratio, rows[2].en_ratio) == (0.8, 0.5, 0.0)
    empty = spark.createDataFrame([("d", "")], "document_id string, text string")
    assert tuple(language.distribution(language.tag(empty)).first())[1:4] == (0.0, 1.0, 0.0)


def test_sentences_and_packing():
    assert chunks.split_sentences("One. Two! three? Four.") == ["One.", "Two! three?", "Four."]
    assert chunks.split_sentences("Fin. École.") == ["Fin. École."]
    words = lambda n, c: " ".join([c] * n) + "."
    s = [words(59, "Aa"), words(59, "Bb"), words(59, "Cc")]
    assert [t for t, _ in chunks.pack_text(" ".join(s), "en", Settings())] == [" ".join(s)]
    s = [words(99, "Aa"), words(39, "Bb"), words(99, "Cc")]
    assert [t for t, _ in chunks.pack_text(" ".join(s), "en", Settings())] == [s[0], s[1], f"{s[1]} {s[2]}"]
    assert chunks.split_long("aa, bb; cc", 8) == ["aa, bb", "cc"] and chunks.split_long("aa bb cc", 6) == ["aa bb", "cc"]


def test_native_and_python_sentences_agree(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "B", ". ", "! ", "?\n", " ", "é", "، ", "؟ ", "م", ".\n\n"]) for _ in range(60)) for _ in range(80)]
    assert apply(spark, tx.sentences, *texts) == [chunks.split_sentences(t) for t in texts]
    assert apply(spark, tx.token_count, *texts) == [chunks.count(t) for t in texts]


def test_parent_groups(spark):
    f = chunks.greedy_groups(Settings())
    df = spark.createDataFrame([([300, 200, 100, 600, 50],), ([],), ([600],)], "c array<int>")
    assert [r[0] for r in df.select(f("c")).collect()] == [[0, 0, 1, 2, 3], [], [0]]


def test_plain_text(spark):
    text = "INTRODUCTION\n\n1. Scope\n\n1.1 Background\n\n3 apples were eaten today\n\n- a\n- b\n \nThis is text.\n\n"
    df = spark.createDataFrame([("d", text), ("n", None), ("e", "")], "document_id string, text string")
    rows = [r for r in plain_text.blocks(df).orderBy("block_idx").collect()]
    assert [(r.block_type, r.heading_level) for r in rows] == [("heading", 1), ("heading", 2), ("heading", 3), ("heading", 2), ("list", None), ("paragraph", None)]
    assert all(text[r.source_offset :].lstrip().startswith(r.raw_text) for r in rows)


def test_markdown_and_html():
    kinds = [(b["block_type"], b["heading_level"], b["raw_text"]) for b in markup.markdown("# T\n\npara\n- a\n- b\n\n|h|\n|-|\n|1|")]
    assert kinds == [("heading", 1, "T"), ("paragraph", None, "para"), ("list", None, "- a\n- b"), ("table", None, "|h|\n|-|\n|1|")]
    texts = lambda s: [b["raw_text"] for b in markup.html(s)]
    assert texts("<ol><li>First item</li><li>Second</li></ol>") == ["1. First item\n2. Second"]
    assert texts("<table><tr><th>Name</th><td>Value one</td></tr></table>") == ["Name | Value one"]
    assert texts("<dl><dt>a term</dt><dd>its meaning</dd></dl>") == ["**a term**\n  its meaning"]
    assert texts("<p>short</p><div>bare text only here</div>") == []
    assert texts("<body><div class='sidebar'><p>not this one here</p></div><p>kept as <b>it is<p>second paragraph</p></body>") == ["kept as it is", "second paragraph"]


def test_formats(spark):
    heads = [b"%PDF-1.4", b"PK\x03\x04zz", b"<!DOCTYPE html><p>", b"# a\n- b", b"plain words", b"\x00\x01\x02\x03", b""]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, c binary").orderBy("i")
    assert [r[0] for r in df.select(formats.sniff(F.col("c"))).collect()] == ["pdf", "docx", "html", "markdown", "txt", None, None]
    texts = spark.createDataFrame([(bytearray("é\r\nx".encode()),), (bytearray(b"\xe9\rx"),), (bytearray(b"\xef\xbb\xbfa"),)], "c binary")
    assert [r[0] for r in texts.select(formats.decoded(F.col("c"))).collect()] == ["é\nx", "é\nx", "a"]


def test_sections_against_a_stack(spark):
    rnd = random.Random(6)
    rows = [(d, i, f"t{i}", "heading" if (lv := rnd.choice([None, None, 1, 2, 3, 4, 5, 6])) else "paragraph", lv) for d in range(40) for i in range(rnd.randint(1, 25))]
    placed = structure.sections_of(spark.createDataFrame(rows, "document_id int, block_idx int, text string, block_type string, heading_level int"))
    got = {(r.document_id, r.block_idx): (r.section_id, list(r.section_path)) for r in placed.collect()}
    stack, n, last = [], 0, None
    for d, i, text, _, level in rows:
        if d != last:
            stack, n, last = [], 0, d
        if level:
            n += 1
            stack = [x for x in stack if x[0] < level] + [(level, text)]
        assert got[d, i] == (f"section_{n}" if n else "root", [t for _, t in stack])


def test_heading_titles(spark):
    assert apply(spark, tx.heading_title, "## " + "x" * 105, "###", " A ") == ["x" * 100 + "...", "Untitled Section", "A"]


@pytest.mark.parametrize("tokens,depth", [(1499, 1), (1500, 2), (9999, 2), (10000, 3)])
def test_depth(spark, tokens, depth):
    assert spark.range(1).select(structure.hierarchy(F.lit(tokens), F.lit(2))[0]).first()[0] == depth


def test_edges(spark):
    same = [("d", i, f"c{i}", [1.0, 0.0]) for i in range(3)] + [("e", 0, "x", [1.0]), ("e", 1, "y", None), ("e", 2, "z", [0.0])]
    df = spark.createDataFrame(same, "document_id string, chunk_idx int, chunk_id string, embedding array<float>")
    assert [tuple(r) for r in graph.semantic_edges(df).collect()] == [("d", "c0", "c2", 1.0)]
    rnd = random.Random(2)
    many = [("d", i, i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(70)]
    df = spark.createDataFrame(many, "document_id string, chunk_idx int, chunk_id int, embedding array<double>")
    blocked = {tuple(r) for r in graph.semantic_edges(df, 0.8, block=16).collect()}
    assert blocked == {tuple(r) for r in graph.semantic_edges(df, 0.8, block=500).collect()} and blocked
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    a = F.col("a")
    assert [round(x, 8) for x in row.select(graph.cosine(a, F.col("b")), graph.cosine(a, F.col("z")), graph.cosine(a, F.col("s"))).first()] == [0.70710678, 0.0, 0.0]
    bands = spark.createDataFrame([(0.9,), (0.85,), (0.79,)], "s double").select(graph.band(F.col("s"))).collect()
    assert [r[0] for r in bands] == ["strong", "moderate", None]


def test_keywords(spark):
    assert apply(spark, tx.keywords, "What is machine learning?", "how is it?", "--- x") == [["machine", "learning"], ["it"], []]


def test_contexts(spark):
    hits = spark.createDataFrame([("q", 1, ["A"], "t1"), ("q", 2, ["A"], "t2"), ("q", 3, ["B"], "t3")], "query_id string, rank int, section_path array<string>, text string")
    assert context.retrieval_context(hits).first().context == "\n[A]\n\n\nt1\n\nt2\n\n\n[B]\n\n\nt3"
    assert len(context.retrieval_context(hits, max_tokens=2).first().context) == 11
    assert context.deduplicated(["a", "b", "c", "a"], {"a": (None, "b")}) == ["a", "c"]


def test_ids_and_hashes(spark):
    assert apply(spark, tx.sha256, "a") == ["ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"]
    made = apply(spark, lambda t: tx.stable_id("chunk", t), "x", "x", "y")
    assert made[0] == made[1] != made[2]
    assert apply(spark, tx.id_prefix, made[0], "bad") == ["chunk", None] and apply(spark, tx.is_uuid, made[0][6:], "x") == [True, False]
    assert apply(spark, lambda t: tx.truncate(t, 2), "one two three", "one two") == ["one two...", "one two"]
    assert apply(spark, lambda t: tx.split_by_tokens(t, 2, 1), "a b c", "") == [["a b", "b c", "c"], []]


def test_violations(spark):
    edges = spark.createDataFrame([("a", "a", "semantic", 0.5), ("a", "b", "semantic", None), ("a", "b", "odd", 2.0), ("a", "b", "semantic", 0.9)], "source_chunk_id string, target_chunk_id string, edge_type string, similarity_score double")
    assert [len(r.violations) for r in checks.edges(edges).collect()] == [1, 1, 2, 0]


def test_embedders(spark):
    e = embed.HashedWords(16)
    a, b, c = e.embed(["one two", "two one", " "])
    assert a == b and not any(c) and abs(sum(x * x for x in a) - 1) < 1e-12
    calls, waits = [], []

    def call(texts, kind):
        calls.append(len(texts))
        if len(calls) == 1:
            raise TimeoutError
        return [[1.0]] * len(texts)

    remote = embed.Remote(call, 1, batch=2, may_retry=lambda e: 2.0 if isinstance(e, TimeoutError) else None, wait=waits.append)
    assert remote.embed(["a", "", "b", "c"]) == [[1.0], [0.0], [1.0], [1.0]] and calls == [2, 2, 1] and waits == [2.0]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in store.upserted(old, new, "k", "v").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, t in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "one")):
        (source / n).write_text(t)
    seen = []

    class Taker:
        def ingest_files(self, df):
            seen.extend(r.file_path.rsplit("/", 1)[1] for r in df.select("file_path").collect())

    taker = Taker()
    taker.spark = spark
    ingest.ingest_stream(taker, str(source), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert len(seen) == 2 and "b.txt" in seen


def test_many_queries_at_once(spark):
    """Blocks against brute force: ties by id, zero, null, short and repeated vectors, queries of two lengths."""
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03d}", rng.normal(size=6).tolist()) for i in range(200)]
    rows += [("c900", rows[3][1]), ("c901", rows[3][1]), ("z", [0.0] * 6), ("n", None), ("s", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(5)
    asked = [("c003", rows[3][1]), ("q", rows[7][1]), ("q2", rows[7][1]), ("two", [1.0, 2.1])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or not any(x) or not any(y):
            return 0.0
        x, y = np.array(x), np.array(y)
        return float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y))

    got = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in search.top_k_many(vectors, queries, 4, skip_self=True).collect())
    want = []
    for q, v in asked:
        best = sorted(((-round(cosine(v, x), 9), c) for c, x in rows if c != q))[:4]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in sorted(want)] and all(abs(x[3] - y[3]) < 1e-8 for x, y in zip(got, sorted(want)))
