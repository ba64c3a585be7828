"""Substring, SimHash and embedding near-duplicates against brute force, with the awkward rows of each."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from quillrake.llm import components, embeddings, simhash, substring


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def texts(seed=5, n=60):
    """Random texts with shared passages of 40 to 90 words, copies, nulls, blanks and one long text."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["ab", "Cd", "é", "x!", "\x85y"]) + str(rnd.randrange(60))
    passages = [[word() for _ in range(rnd.randint(40, 90))] for _ in range(4)]
    out = []
    for _ in range(n):
        words = [word() for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 3)
            words += p[a : rnd.randint(len(p) // 2, len(p))]
        words += [word() for _ in range(rnd.randint(0, 40))]
        out.append(rnd.choice([" ", "\n", "\t "]).join(words))
    return [*out, out[3], out[3], None, "", " \n ", "one", " ".join(passages[0] * 40)]


def brute_repeats(docs, window=50):
    least, words = {}, {i: (t or "").encode().split() for i, t in docs}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("window,period", [(50, 31), (50, 13), (8, 7)])
def test_repeated_words(spark, window, period):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, batch string, n_words int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in substring.repeated_words(df, window=window, period=period).collect()}
    assert got == brute_repeats(docs, window)
    assert sum(v[1] for v in got.values()) > 0
    kept = {r.doc_id: r for r in substring.cut_repeats(df, window=window, period=period).collect()}
    assert set(kept) == {i for i, v in got.items() if v[1]}
    for i, r in kept.items():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == got[i][2]
        assert sum(s.end - s.start for s in r.removed_spans) == got[i][1]


def test_repeats_of_awkward_tables(spark):
    schema = "doc_id long, text string"
    assert substring.repeated_words(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(str(i) for i in range(60))
    rows = [(None, long), (7, long), (7, long), (8, long)]
    got = sorted((r.doc_id, r.n_removed) for r in substring.repeated_words(spark.createDataFrame(rows, schema)).collect())
    assert got == [(7, 0), (7, 0), (8, 60)]
    short = [(i, t) for i, t in enumerate([None, "", "a b c", "a b c"] * 3)]  # batches without any window
    assert [r.n_removed for r in substring.repeated_words(spark.createDataFrame(short, schema)).collect()] == [0] * 12


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = text.encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rnd = random.Random(2)
    docs = texts(9, 40)
    base = [f"w{i}" for i in range(400)]
    for _ in range(30):
        near = list(base)
        near[rnd.randrange(400)] = "zz"
        docs.append(" ".join(near))
    docs = list(enumerate(docs))
    prints = {i: brute_print(t) for i, t in docs}
    want = roots(prints, [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3])
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, component int").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(set(want.values())) < len(docs) - 5
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_shards_lose_no_link():
    rng = np.random.default_rng(3)
    prints = []
    for b in rng.integers(0, 2**63, 150, dtype=np.uint64):
        for _ in range(10):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(k)
            prints.append(x)
    fps = np.unique(np.array(prints, np.uint64))
    nodes = np.arange(len(fps))
    close = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = roots(nodes.tolist(), [(a, b) for a, b in close.tolist() if a < b])
    for leaves in (1, 4, 20):
        shards = {}
        tree = simhash.grow(simhash.Prints(fps[rng.permutation(len(fps))[:300]], None, 3, None), leaves)
        for leaf, at, lives in simhash.deal(tree, simhash.Prints(fps, None, 3, None)):
            shards.setdefault(leaf, []).append((at, np.full(len(at), lives)))
        links = []
        for parts in shards.values():
            at, lives = (np.concatenate(x) for x in zip(*parts))
            links += zip(*(x.tolist() for x in simhash.shard_links(simhash.Prints(fps[at], None, 3, None), nodes[at], lives)))
        assert roots(nodes.tolist(), links) == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (5, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{200 + i: 5 for i in range(50)}, 5: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = []
    for c in rng.normal(size=(40, 12)):
        rows += [(c + rng.normal(size=12) * 0.12).astype(np.float32).tolist() for _ in range(8)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] * 12, [1.0, 0.0], [1.0, 0.01], [3e38] * 12, [1e-30] * 12]
    rows = rows * 2
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, n_links string").repartition(4)

    def fine(v):
        return bool(v) and None not in v and np.isfinite(v).all() and any(v)

    def cosine(x, y):
        x, y = (np.array(z, np.float32).astype(float) for z in (x, y))
        return x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)

    good = [i for i, v in enumerate(rows) if fine(v)]
    links = [(i, j) for i in good for j in good if i < j and len(rows[i]) == len(rows[j]) and cosine(rows[i], rows[j]) >= 0.95]
    want = roots(range(len(rows)), links)
    count = {i: 0 for i in range(len(rows))}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == {i: (count[i], want[i], want[i] == i) for i in want}
    assert embeddings.near_vectors(df.where("false")).count() == 0
