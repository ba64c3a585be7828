"""The pipeline's stages against brute force on a small table with all kinds of rows."""

import random

import corpus_pipeline
import numpy as np
import pytest
from quillrake.llm import quality
from tests.llm.test_pairs import brute_print, brute_repeats, roots
from tests.llm.test_rows import brute_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, kept_text string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(900))
    passage = [word() for _ in range(70)]
    texts = []
    for i in range(260):
        words = [word() for _ in range(rnd.randint(5, 150))]
        if i % 5 == 0:
            words += passage
        texts.append(" ".join(words) + rnd.choice(["", ".\nand then"]))
    texts += [texts[2], texts[2] + " x", " ".join(passage), None, "", "z z z z z z z z z z z z", *(" ".join(word() + "***" for _ in range(40)) for _ in range(60))]
    docs = [(i, t, "en", f"s{i % 3}", len(t or ""), 1, "k") for i, t in enumerate(texts)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int("***" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return {d[0]: d for d in docs}, str(where)


def test_stages(spark, tables):
    docs, where = tables
    (_, rules), (_, groups), (_, cut), (_, pack) = corpus_pipeline.STAGES
    table = spark.read.parquet(f"{where}/documents.parquet")

    good = rules(spark, table, where)
    assert good.columns == table.columns
    judged = {r.doc_id: r for r in quality.judge(table, spark.read.parquet(f"{where}/labels.parquet")).collect()}
    passed = {i for i, d in docs.items() if (q := brute_quality(d[1]))[0] >= 10 and 100 * q[4] <= 20 * q[0]}
    want = {i for i in passed if judged[i].cutoff is None or judged[i].score < judged[i].cutoff}
    assert {tuple(r) for r in good.collect()} == {docs[i] for i in want}
    assert not any("***" in docs[i][1] for i in want) and all(i in want for i in passed if "***" not in docs[i][1])

    prints = {i: brute_print(docs[i][1]) for i in want}
    root = roots(sorted(prints), [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3])
    single = groups(spark, good, where)
    want = {i for i in want if root[i] == i}
    assert {tuple(r) for r in single.collect()} == {docs[i] for i in want} and len(want) < len(root)

    left = cut(spark, single, where)
    assert left.columns == table.columns
    lost = brute_repeats([(i, docs[i][1]) for i in want])
    kept = {r.doc_id: r for r in left.collect()}
    assert set(kept) == {i for i in want if lost[i][1] < lost[i][0] or not lost[i][1]}
    for i, r in kept.items():
        assert r.text == docs[i][1] if not lost[i][1] else len(r.text.split()) == lost[i][0] - lost[i][1] and r.n_chars == len(r.text)
    assert any(v[1] for v in lost.values())

    pieces = pack(spark, left, where).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    assert all(len(r.ids) == 4 * r.length and np.frombuffer(r.ids, "<u4")[-1] == 1 for r in pieces if r.start + r.length == r.doc_tokens)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_repeated_rows_stay_apart(spark, tables):
    """Equal rows, one id with two texts, and rows without an id: each row is kept or cut on its own."""
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words), (2, f"a {words}"), (2, f"a {words}"), (2, f"b {words}"), (3, "other text"), (None, words)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t), 1, "k") for i, t in rows], SCHEMA)
    cut = corpus_pipeline.STAGES[2][1](spark, table, tables[1])
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in cut.collect())
    assert got == [(0, words, len(words)), (1, words, len(words)), (2, "a", 1), (2, "a", 1), (2, "b", 1), (3, "other text", 10)]


def test_run(spark, tables):
    docs, where = tables
    out = corpus_pipeline.run(spark, where)
    assert out.select("doc_id").distinct().count() > 150


def test_empty(spark, tables):
    table = spark.read.parquet(f"{tables[1]}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, tables[1]).count() == 0


def brute_shingles(text, size=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = text.encode().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_near(docs):
    """(id, text) -> root of each id over pairs of Jaccard 0.8 or more of five-word shingles, by all pairs."""
    found = [(i, brute_shingles(t)) for i, t in docs]
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    return roots(sorted({i for i, _ in docs}), [(i, j) for x, (i, a) in enumerate(found) for j, b in found[:x] if i != j and near(a, b)])


def test_near_duplicates_by_jaccard(spark, tables):
    """Copies with words changed up to and past 0.8, a passage that most share, and chains, against all pairs."""
    rnd = random.Random(23)
    passage = [f"p{i}" for i in range(80)]
    texts = ["", None, " \n ", "one two", "One TWO", "one two three four five", "one two three four five six"]
    for i in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([6, 12, 50, 120, 300]))] + passage * (i % 2)
        texts.append(" ".join(base))
        for _ in range(5):
            other = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 40)):
                other[rnd.randrange(len(other))] = f"v{rnd.randrange(5000)}"
            texts.append(" ".join(other[: len(other) - rnd.randint(0, 1 + len(base) // 9)]))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    root = brute_near(list(zip(ids, texts, strict=True)))
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, table, tables[1]).collect()}
    assert kept == {i for i in ids if root[i] == i} and 60 < len(kept) < 300


def test_near_duplicates_keep_one_row(spark, tables):
    """Copies without an id, repeated rows of one id and one id with two texts: one row of each group stays."""
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, words[0]), (7, words[0]), (7, words[0]), (None, words[1]), (None, words[1]), (None, words[1] + " x"), (3, words[2]), (3, words[3]), (3, words[3]), (4, words[3] + " x"), (None, None), (9, ""), (9, " ")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k") for i, t in rows], SCHEMA).repartition(4)
    got = corpus_pipeline.STAGES[1][1](spark, table, tables[1])
    assert got.columns == table.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == 5 and {(7, words[0]), (3, words[2]), (3, words[3])} <= set(kept)
    assert [i for i, t in kept if t in (words[1], words[1] + " x")] == [None] and [i for i, t in kept if not (t or "").strip()] == [9]
