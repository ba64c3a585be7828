"""WARC, quality, licences, sharding, URLs, packing and byte-level BPE: exact checks and awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillrake.llm import bpe, licenses, packing, quality, sharding, urls, warc


def some_texts(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["The", "a1", "don't", "é́x", "x.,", "##", "中文", "😀", "<|endoftext|>", "3.14,", "\xa0z", "Stop.", "AB"]
    out = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return [*out, None, "", " ", "\x1c", "a" * 2000, "word " * 3000, out[0]]


def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    html = [rnd.choice(["<p>one</p>", "", None, "é" * 50, "x" * rnd.randint(1, 3000)]) for _ in range(80)]
    pages = [(i, rnd.choice([None, "http://a.b/c d\r\nX: y", f"http://h/{i}"]), h, "z") for i, h in enumerate(html)]
    df = spark.createDataFrame([*pages, (None, None, "only here", "z"), (None, None, "<p>one</p>", "z")], "page_id long, url string, html string, digest string").repartition(3)
    for least in (0, 5):
        bundles = warc.write_bundles(df, least_payload=least, frame_bytes=2000, bundle_bytes=1000)
        got = warc.read_bundles(bundles).collect()
        assert len(got) == 82
        first = {}
        for i, _, h, _ in pages:
            first.setdefault(h or "", i)
        for r in got:
            if r.page_id is None:
                continue
            h = html[r.page_id] or ""
            refers = first[h] if len(h.encode()) >= least and first[h] != r.page_id else None
            digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h.encode()), digest, "response" if refers is None else "revisit", refers)
            assert r.payload is None if refers is not None else bytes(r.payload) == h.encode()
    assert Counter(r.record_type for r in got if r.page_id is None) == {"response": 1, "revisit": 1}
    paths = warc.export_bundles(bundles, str(tmp_path)).collect()
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(p.path, "rb"), read_across_frames=True).read() for p in paths)
    assert whole.count(b"WARC/1.1\r\n") == 82
    assert warc.read_bundles(warc.write_bundles(df.where("false"))).count() == 0


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = [False] * len(words)
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(again)


def test_quality(spark):
    rnd = random.Random(3)
    texts = [*some_texts(4), "a b c d e f g a b c d e x", "x x x x x x x", "l\nl\n \nl\nm", "1 2 3 4 5 6 1 2 3 4 5 6 1 2 3 4 5"]
    texts += [" ".join(f"w{rnd.randrange(500)}" for _ in range(40)) for _ in range(400)] + [" ".join(f"w{rnd.randrange(500)}***" for _ in range(40)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int("***" not in (t or "")), 0) for i, t in enumerate(texts) if i > 60] + [(None, 1, 0), (70, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, again = brute_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again), t
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert r.kept == (not r.base_failed and (r.cutoff is None or r.score < r.cutoff))
    assert all(got[i].kept == (not i % 3) for i in range(len(texts) - 100, len(texts)))
    assert all(got[i].kept for i in range(len(texts) - 500, len(texts) - 100))
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, r in got.items() if r.kept)
    none = quality.judge(docs, labels.where("false")).where("cutoff is not null").count() + quality.judge(docs.where("false"), labels).count()
    assert none == 0


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 100), (5, 50), (40, 1000), (1, 20000), (60, 1000), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        want = sum(math.comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1)) if r.n < 20000 else math.exp(20000 * math.log(0.95)) * (1 + 20000 * 0.05 / 0.95)
        assert r.p == (1.0 if r.k > 0.05 * r.n else pytest.approx(want, rel=1e-9))


def brute_bigrams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return [(a, b) for a, b in zip(words, words[1:])] if len(words) > 1 else [(w,) for w in words]


def brute_dice(a, b):
    rest, shared = list(b), 0
    for g in a:
        if g in rest:
            rest.remove(g)
            shared += 1
    return 2 * shared / (len(a) + len(b)) if a or b else 0.0


def test_licenses(spark):
    rnd = random.Random(5)
    texts = some_texts(6, 20)
    for t in licenses.TEMPLATES.values():
        words = t.split()
        for _ in range(4):
            w = list(words)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = "zz"
            cut = rnd.randrange(len(w))
            texts += [" ".join(w).upper(), "intro text\n" + " ".join(w[:cut]) + "\n\n" + " ".join(w[cut:]) + "\nmore", " ".join(w) * 2]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, dice int")).collect()}
    grams = {k: brute_bigrams(v) for k, v in licenses.TEMPLATES.items()}
    hits = 0
    for i, t in enumerate(texts):
        spans, at, want = [], 0, []
        for line in (t or "").split("\n"):
            if re.search(r"[^\W_]", line.lower()):
                spans.append((at, at + len(line)))
            at += len(line) + 1
        for a in range(len(spans)):
            for b in range(a, len(spans)):
                g = brute_bigrams(t[spans[a][0] : spans[b][1]])
                want += [(k, brute_dice(g, x), spans[a][0], spans[b][1]) for k, x in grams.items() if brute_dice(g, x) >= 0.8]
        assert sorted(tuple(m) for m in got[i].matches) == sorted(want)
        best = min(want, key=lambda x: (-x[1], x[2], x[0]))[:2] if want else (None, None)
        assert (got[i].license, got[i].dice) == best
        hits += bool(want)
    assert hits > 60


def test_sharding(spark, tmp_path):
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    stay = sum(a == b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert stay > 0.85 * 908
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    df = spark.createDataFrame([(i, "x", i % 2) for i in range(3000)] + [(None, "y", 0), (5, "x", 1)], "doc_id long, text string, shard int")
    got = sharding.assign(df, shards=10, slots=1009).collect()
    assert len(got) == 3002 and all(r.shard == sharding.lookup_table([f"shard-{i:05d}" for i in range(10)], 1009)[r.slot] for r in got[:50])
    assert max(Counter(r.shard for r in got).values()) < 1.3 * 300
    sharding.write_sharded(df, str(tmp_path / "out"), shards=4, slots=1009, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3002 and back.select("shard").distinct().count() == 4
    assert sharding.assign(df.where("false")).count() == 0


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_url_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://A.Net/x": ("a.net", "/x", "net/"),
        "http://x.example.NET/en/1?q#f": ("x.example.net", "/en/1", "example.net/en/"), "ftp://example.net/EN/": ("example.net", "/EN/", "net/"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None), "http://É.org/fr/": ("É.org", "/fr/", "org/fr/"), "http://a.net": ("a.net", "", None),
        "http://a?b://c.net/": ("a", "", None), "x://u://v.net/": ("u:", "//v.net/", None), "http://net/": ("net", "/", "net/"), "a\nb://q.net/\nz#": ("q.net", "/\nz", "net/"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(df, RULES).collect()}
    assert got == dict(enumerate(cases.values()))


def test_sharding_against_brute_force(spark):
    """Slots by XXH64 of the key's eight bytes, the table filled by turns, shares within one slot; null keys, repeats."""
    names = [f"shard-{i:05d}" for i in range(64)]
    size, owner = 65_537, {}

    def preferred(name):
        d = hashlib.sha256(name.encode()).digest()
        yield from ((int.from_bytes(d[:8], "big") + k * (int.from_bytes(d[8:16], "big") % (size - 1) + 1)) % size for k in range(size))

    orders = {n: preferred(n) for n in names}
    while len(owner) < size:
        for n in names:
            if len(owner) < size:
                owner[next(s for s in orders[n] if s not in owner)] = n
    ids = [0, 1, -5, 2**62, None, 7, 7, *range(1000, 3000)]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, slot string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.slot, r.shard_name) for r in sharding.assign(df).collect())
    slot = lambda i: (xxhash.xxh64_intdigest(struct.pack("<q", i), 42) + 2**63) % 2**64 - 2**63  # noqa: E731 - as a signed number
    want = sorted((i is not None, i or 0, (42 if i is None else slot(i)) % size, owner[(42 if i is None else slot(i)) % size]) for i in ids)
    assert got == want
    shares = collections.Counter(owner.values()).values()
    assert max(shares) - min(shares) <= 1


def test_url_rates_come_from_other_labels(spark):
    """A suffix's rate is made of whole-host labels only, and held-out rules are judged without their own URLs."""
    made = [(i, f"http://h{i % 9}.example.{('net', 'com')[i % 2]}/{('en', 'de', 'x')[i % 3]}/p{i}") for i in range(300)]
    df = spark.createDataFrame(made, "page_id long, url string")
    rules = [("net/", "block"), ("example.com/de/", "block"), ("example.com/en/", "allow")]
    told = urls._by_rules(urls._split(df, "page_id", "url", rules))
    assert {(r.rule, r.whole_host) for r in told.collect()} == {("net/", True), ("example.com/de/", False), ("example.com/en/", False)}
    model = urls.train(told, trees=2)
    assert [r.suffix for r in model.suffixes.collect()] == ["example.net"]
    held = {r.rule: (r.n, r.right) for r in urls.held_out(df, rules).collect()}
    assert {k: v[0] for k, v in held.items()} == {"net/": 150, "example.com/de/": 50, "example.com/en/": 50}
    own = spark.createDataFrame([(u, int("/x/" in u)) for _, u in made], "url string, label int")
    judged = urls.judge(df, [("net/", "allow")], labelled=own)
    assert judged.where("rule is null and verdict = 'block'").count() > 0


def test_url_trees(spark):
    rnd = random.Random(8)
    bad = lambda: f"http://{rnd.randrange(10**6)}x{rnd.randrange(99)}.spam.example.com/{'/'.join('abc')}?a={rnd.random()}&b=1"
    fine = lambda: f"https://{rnd.choice(['www', 'blog'])}.site{rnd.choice('abc')}.org/en/{rnd.randrange(99)}"
    made = [(i, bad() if i % 2 else fine(), i % 2) for i in range(600)]
    df = spark.createDataFrame(made, "page_id long, url string, label int").withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    model = urls.train(df.where("page_id < 400"), trees=4)
    held = model.score(df.where("page_id >= 400")).collect()
    assert sum((r.block_score >= 0.5) == bool(r.label) for r in held) / len(held) >= 0.95
    one = urls.judge(df.where("label = 0").select("page_id", "url"), [("org/", "allow")])
    assert {r.verdict for r in one.collect()} == {"allow"}
    assert urls.judge(df.where("false"), RULES).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = some_texts(9, 120)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (3, texts[3], 0)], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df, path, width=128).collect()
    whole = Tokenizer.from_file(path)
    want = Counter(tuple(whole.encode(r.text or "", add_special_tokens=False).ids) + (1,) for r in df.collect())
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id not in (3, None):
            pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for i, parts in pieces.items():
        ids = [x for _, p, _ in sorted(parts, key=lambda p: p[0]) for x in p]
        assert want[tuple(ids)] and all(t == len(ids) for _, _, t in parts)
    assert sum(r.length for r in got) == sum(len(k) * v for k, v in want.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(df.where("false"), path).count() == 0


def test_cuts_are_the_cheapest():
    rnd = random.Random(3)
    pad = lambda n, w: 0 if n & (n - 1) == 0 else w - n
    for _ in range(60):
        sizes = np.array([rnd.randint(1, 30) for _ in range(rnd.randint(1, 6))])
        total, width = int(sizes.sum()), rnd.choice([8, 16, 32])
        places, costs = packing.cut_places(np.cumsum(sizes), np.array(sorted(rnd.sample(range(1, total + 1), min(total, 5)))), 3)
        cuts, cost, at = packing.best_cuts(places, costs, width).tolist(), dict(zip(places.tolist(), costs.tolist())), places.tolist()
        least = {0: 0}
        for j in at[1:]:
            least[j] = cost[j] + min(least[i] + pad(j - i, width) for i in at if i < j and j - i <= width)
        assert sum(pad(b - a, width) + cost[b] for a, b in zip(cuts, cuts[1:])) == least[total]


def test_byte_bpe(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read().splitlines())
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = some_texts(7, 150)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    encoded = bpe.encode(df, path, pattern)
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == want
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in bpe.digests(df, path, pattern).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(df.where("false"), path, pattern).count() == 0


def test_licenses_within_lines(spark):
    """Each template among other words of its line, or wrapped in the middle of lines, is found where it stands."""
    said = ["Copyright 2024 The Foo Project Authors. {}", "{} See LICENSE for details.", "The code is {}", "many plain words " * 40 + "{}" + " and more plain words" * 40]
    rows = [(k, t, s.replace("{}", t)) for k, t in licenses.TEMPLATES.items() for s in said]
    rows += [(k, t, "foo bar. " + "\n".join((" ".join(w[:2]), " ".join(w[2:]))) + " baz qux") for k, t in licenses.TEMPLATES.items() for w in [t.split()]]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "doc_id long, text string"), within=True).collect()}
    for i, (k, t, text) in enumerate(rows):
        hits = [m for m in got[i].matches if m.license == k]
        assert hits and all(licenses.dice(licenses.bigrams(text[m.start : m.end]), licenses.bigrams(t)) == pytest.approx(m.dice) for m in hits), text
    lines = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "doc_id long, text string")).collect()}
    lost = sum(k not in {m.license for m in lines[i].matches} for i, (k, _, _) in enumerate(rows))
    assert lost > 20
    print("notices", len(rows), "lost by lines alone", lost)


def test_packing_at_production_width(spark):
    """ids_crc32 of the query's pieces at width 2048 against the tokenizers library; lengths, offsets and sequences."""
    import zlib

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = some_texts(11, 30) + ["", None, "Word. " * 5000, "É à ß Ω 漢字 don't <|endoftext|> x1y22 ..."]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, width int").repartition(2)
    packed = packing.pack(df, path, width=2048).select("doc_id", "start", "length", F.crc32("ids").alias("crc"), "doc_tokens", "sequence_id", "offset").collect()
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) and r.crc == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and sum(r.length for r in mine) == len(ids)
    for key in {r.sequence_id for r in packed}:
        row = sorted((r for r in packed if r.sequence_id == key), key=lambda r: r.offset)
        assert [r.offset for r in row] == [sum(x.length for x in row[:k]) for k in range(len(row))] and sum(r.length for r in row) <= 2048


def test_other_tokenizers_and_patterns(spark):
    """A tokenizers file of another kind, and a pattern whose texts cannot be cut at spaces."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Some  text here\n", " and é more", None]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, width=512, end_id=50256).orderBy("doc_id", "start").collect()
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(b"".join(r.ids for r in got if r.doc_id == i), "<u4").tolist() for i in range(3)] == [[*library.encode(t or "", add_special_tokens=False).ids, 50256] for t in texts]
    import tiktoken

    ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks_path, "rb") as f:
        ranks = bpe.read_ranks(f.read().splitlines())
    pattern = r"[a-z ]+|[^a-z ]+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.encode(df, ranks_path, pattern).collect()} == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_repeated_and_null_ids(spark):
    """Rows of one id and rows without an id are rows of their own wherever rows are judged one by one."""
    text = "some words that are said. " * 20
    rows = [(1, text), (1, text), (1, "other"), (None, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert sorted((r.doc_id or 0, r.n_tokens > 50) for r in bpe.digests(df, ranks, public_tokenizers.PATTERN).collect()) == [(0, False), (0, True), (1, False), (1, True), (1, True)]
    assert sorted((r.doc_id or 0, r.license is None) for r in licenses.scan(df, within=True).collect()) == [(0, True), (0, True), (1, True), (1, True), (1, True)]
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://b.org/fr/")], "page_id long, url string")
    assert sorted((r.page_id or 0, r.rule) for r in urls.judge(pages, RULES).collect()) == [(0, "org/fr/"), (1, "net/"), (1, "net/")]
    html = spark.createDataFrame([(1, "<p>"), (1, "<p>"), (2, "<p>"), (None, "<p>")], "page_id long, html string").withColumn("url", F.lit("http://x/"))
    assert warc.read_bundles(warc.write_bundles(html, least_payload=0)).count() == 4
