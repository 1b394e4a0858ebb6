"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import decontam, html_extract, langid, mixing, simhash, suffix_dedup, tiff, tokencount, toxicity, warc
from matchloom.llm.common import read_table

from ..conftest import SF

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents").collect()


# ---- mixing


def fill(sizes, weights, budget, most):
    """Water-filling by repeated re-sharing."""
    target = dict.fromkeys(sizes, 0.0)
    capped = set()
    while True:
        rest = budget - sum(most * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        total = sum(weights[s] for s in open_)
        target = {s: most * sizes[s] for s in capped} | {s: rest * weights[s] / total for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark, docs):
    got = mixing.op1_mixing(spark, SF).collect()
    size = {d.doc_id: len(re.findall(WORD, d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    sums = collections.Counter()
    for d in docs:
        sums[d.source] += size[d.doc_id]
    names = sorted(sums)
    want = fill(sums, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sums.values()), 2)
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size and r.source_size == sums[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op1_mixing(spark, SF).collect()))


# ---- language


def test_langid_held_out(spark, docs):
    lang = {d.doc_id: d.lang for d in docs}
    rows = [r for r in langid.op2_langid(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97


def test_langid_rejects_noise():
    rng = random.Random(0)
    words = {"xx": "alpha beta gamma delta omega".split(), "yy": "zwei drei vier sieben acht".split()}
    texts, labels = [], []
    for _ in range(200):
        for name in words:
            texts.append(" ".join(rng.choices(words[name], k=20))), labels.append(name)
    model = langid.train(texts, labels, buckets=1 << 12)
    score = lambda t: model.probabilities(langid.bucket_counts(t, 1 << 12))
    assert model.languages[int(score("delta gamma alpha").argmax())] == "xx"
    assert model.languages[int(score("vier acht").argmax())] == "yy"


def test_langid_predictions_equal_brute_force(spark, docs):
    """Every document's language and score from a plain walk over its byte 3- and 4-grams."""
    rows = [(d.text, d.lang) for d in docs if d.lang and d.text and len(d.text) < 3000][:150]
    model = langid.train([t for t, _ in rows], [x for _, x in rows], buckets=1 << 10)
    mask = (1 << 32) - 1

    def probabilities(text):
        data, total, n = f" {text.lower()} ".encode(), np.zeros(len(model.languages)), 0
        for i in range(len(data) - 2):
            h = data[i] * 0x9E3779B1 & mask ^ data[i + 1] * 0x85EBCA77 & mask ^ data[i + 2] * 0xC2B2AE3D & mask
            grams = [h]
            if i + 3 < len(data):
                grams.append(h ^ data[i + 3] * 0x27D4EB2F & mask ^ 0x165667B1)
            for g in grams:
                total += model.logits[(g * 0x9E3779B1 & mask) >> 22]
                n += 1
        z = (total / n + model.bias) / model.temperature
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    some = [(d.doc_id, d.text) for d in docs if d.text and len(d.text) < 3000 and re.search(r"[^\W\d_]", d.text)][150:250]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for i, text in some:
        want = probabilities(text)
        assert got[i].lang_pred == model.languages[int(want.argmax())] and abs(got[i].score - want.max()) < 1e-9
        assert got[i].rejected == bool(got[i].score < model.threshold)


def test_langid_gradient_steps_equal_brute_force():
    """One epoch of training against dense matrices, step by step."""
    texts, labels = ["abcd", "bcda b", "cdab", "xyzx"], ["p", "q", "p", "q"]
    buckets, width, rate = 32, 3, 0.5
    model = langid.train(texts, labels, buckets=buckets, width=width, epochs=1, rate=rate, seed=7)
    rng = np.random.default_rng(7)
    table, weights, bias = rng.normal(0, 1 / width, (buckets, width)), np.zeros((width, 2)), np.zeros(2)
    rng.permutation(4)
    for done, i in enumerate(rng.permutation(4)):
        bag = langid.bucket_counts(texts[i], buckets)
        bag = bag / bag.sum()
        mean = bag @ table
        z = mean @ weights + bias
        gap = np.exp(z) / np.exp(z).sum() - (np.array(["p", "q"]) == labels[i])
        step = rate * (1 - done / 4)
        back = weights @ gap
        weights, bias = weights - step * np.outer(mean, gap), bias - step * 0.1 * gap
        table = table - step * (bag > 0).sum() ** 0.5 * np.outer(bag, back)
    assert np.allclose(model.logits, table @ weights) and np.allclose(model.bias, bias)


def test_rejection_threshold():
    scores, right = np.array([0.9, 0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 1, 0, 1])
    assert langid.rejection_threshold(scores, right, 0.99) == 0.8
    assert langid.rejection_threshold(scores, right, 0.8) == 0.6
    assert langid.rejection_threshold(scores, np.zeros(5), 0.5) > 1
    tied = langid.rejection_threshold(np.array([0.9, 0.9]), np.array([1, 0]), 0.99)
    assert tied > 1
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
    noise = langid.train([" ".join(rng.choices(words, k=12)) for _ in range(200)], [rng.choice("pq") for _ in range(200)], buckets=1 << 10)
    assert noise.threshold > 0.5 and langid.train(["abc"] * 5, ["x"] * 5).threshold > 1


def test_sample_counts_copies_once(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit("the same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("en").alias("lang"))
    texts, _ = langid.training_sample(df, max_rows=500)
    assert 400 < len(texts) < 600 and len(set(texts)) == len(texts)


# ---- token counts


def test_token_counts_and_cache(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, d.text) for i, d in enumerate(docs[:60])] + [(900, "a <|endoftext|> b"), (901, None), (902, docs[0].text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cache = str(tmp_path / "cache")
    got = {r.doc_id: r for r in tokencount.count_tokens(df, path, cache).collect()}
    for i, text in rows:
        want = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((text or "").encode()), want > 512)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    more = df.union(spark.createDataFrame([(999, "something new")], df.schema))
    misses = more.select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    assert tokencount.encode_misses(misses, cache, path).count() == 1
    assert tokencount.count_tokens(more, path, cache).count() == len(rows) + 1
    for few in (100_000, 0):
        several = spark.createDataFrame([("twice",)] * 5 + [("thrice",)] * 3 + [("",)] * 2, "content string").repartition(3)
        got = tokencount.encode_misses(several, f"{tmp_path}/none", path, broadcast_digests=few).collect()
        assert len(got) == 3 and {r.n_tokens for r in got} >= {0}
    assert {(r.doc_id, r.n_tokens) for r in tokencount.count_tokens(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string"), path, cache).collect()} == {(None, 2), (None, 0)}
    other = public_tokenizers.path("word_bpe_49k.json")
    assert tokencount.encode_misses(misses, cache, other).count() == len({t or "" for _, t in rows}) + 1


# ---- suffix arrays


def brute_repeats(rows):
    first = {}
    for i, text in rows:
        for p in range(len(text) - 49):
            first[text[p : p + 50]] = min(first.get(text[p : p + 50], 1 << 62), i)
    out = []
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if first[text[p : p + 50]] < i:
                gone[p : p + 50] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((i, len(text), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 3))
def test_suffix_array(data, squeeze):
    data = np.frombuffer(bytes(b % (2 << squeeze) for b in data) * 2, np.uint8)
    sa = suffix_dedup.suffix_array(data)
    raw = data.tobytes()
    assert sorted(sa.tolist()) == list(range(len(raw)))
    assert all(raw[a : a + 50] <= raw[b : b + 50] for a, b in zip(sa, sa[1:]))
    lcp = suffix_dedup.common_prefixes(data, sa)
    for a, b, n in zip(sa, sa[1:], lcp[1:]):
        x, y = raw[a : a + 50], raw[b : b + 50]
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert n == k


@pytest.mark.parametrize("chunk,shard", [(1 << 22, 1 << 20), (100_000, 4096)])
def test_repeats_equal_brute_force(spark, docs, chunk, shard):
    df = read_table(spark, SF, "documents").select("doc_id", "text")
    got = sorted(map(tuple, suffix_dedup.repeats(df, chunk, shard).collect()))
    assert got == brute_repeats([(d.doc_id, d.text.encode()) for d in docs])


@pytest.mark.parametrize("shard", [100, 300, 1 << 20])
def test_shards_merge_as_brute_force(shard):
    rng = random.Random(3)
    for _ in range(15):
        base = ["".join(rng.choices("ab", k=rng.randint(60, 200))).encode() for _ in range(5)]
        segments = []
        for _ in range(rng.randint(2, 40)):
            b = rng.choice(base)
            i = rng.randint(0, len(b) - 50)
            segments.append(b[i : rng.randint(i + 50, len(b))] if rng.random() < 0.7 else bytes(rng.choices(b"ab", k=rng.randint(50, 120))))
        segments = list(dict.fromkeys(segments))
        ids = [rng.randint(0, 30) for _ in segments]
        first = {}
        for s, i in zip(segments, ids):
            for p in range(len(s) - 49):
                first[s[p : p + 50]] = min(first.get(s[p : p + 50], 1 << 60), i)
        want = {(k, x) for k, (s, i) in enumerate(zip(segments, ids)) for p in range(len(s) - 49) if first[s[p : p + 50]] < i for x in range(p, p + 50)}
        spans = zip(*suffix_dedup.segment_spans(segments, np.array(ids, dtype=np.int64), shard))
        assert {(int(k), x) for k, p, q in spans for x in range(p, q)} == want


def test_lone_segments_need_no_array(monkeypatch):
    """Only segments that can share a string with another one are sorted; 23 bytes in common send no run on."""
    rng = random.Random(8)
    noise = lambda n: bytes(rng.choices(range(256), k=n))
    passage = noise(70)
    segments = [noise(80) for _ in range(300)]
    segments[10], segments[200] = noise(20) + passage, passage + noise(9)
    sorted_bytes = []
    whole = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda data, *a, **k: sorted_bytes.append(len(data)) or whole(data, *a, **k))
    which, begin, end = suffix_dedup.segment_spans(segments, np.arange(300))
    assert [x.tolist() for x in (which, begin, end)] == [[200], [0], [70]]
    assert sum(sorted_bytes) == len(segments[10]) + len(segments[200])
    texts = [noise(200) + passage[:23] + noise(200) for _ in range(20)]
    ends = np.cumsum([len(t) for t in texts])
    minimisers, docs_of = suffix_dedup.runs(np.frombuffer(b"".join(texts), dtype=np.uint8), ends - 423, ends)[2:]
    assert all(len(set(docs_of[minimisers == m].tolist())) == 1 for m in np.unique(minimisers))


def test_repeats_on_runs_and_ties(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("ab", k=200)) for _ in range(8)]
    rows = []
    for i in range(60):
        text = "".join(rng.choices("ab", k=rng.randint(0, 300))) if i % 3 else "ab" * rng.randint(0, 150) + "é"
        rows.append((rng.randint(0, 40), rng.choice(base)[: rng.randint(0, 200)] + text + rng.choice(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    for chunk, shard in ((1 << 22, 1 << 20), (2000, 300)):
        assert sorted(map(tuple, suffix_dedup.repeats(df, chunk, shard).collect())) == want


def test_remove_repeats_text(spark):
    passage = "shared words that go on for more than fifty bytes, surely é enough "
    df = spark.createDataFrame([(1, passage + "one", 5), (2, "two " + passage, 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1].text == passage + "one" and got[2].text == "two " and got[2].n_chars == 4


# ---- WARC


def test_warc_round_trip(spark):
    pages = read_table(spark, SF, "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    first = {}
    for k in sorted(html):
        first.setdefault(html[k], k)
    for r in warc.op5_warc(spark, SF).collect():
        data, lead = html[r.page_id].encode(), first[html[r.page_id]]
        assert (r.payload_bytes, r.payload_digest, r.verified) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), True)
        assert (r.record_type, r.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))


def test_warc_reader_takes_any_pieces():
    records = [(1, "http://a/ b", b"x" * 5000, None), (2, None, b"", None), (3, "u", b"x" * 5000, 1)]
    stream = b"".join(warc.write_record(*r) for r in records)
    for step in (1, 7, 1000, len(stream)):
        reader = warc.RecordReader(with_payload=True)
        out = [r for k in range(0, len(stream), step) for r in reader.feed(stream[k : k + step])]
        reader.close()
        assert [r.headers["warc-type"] for r in out] == ["response", "response", "revisit"]
        assert [r.payload for r in out] == [b"x" * 5000, b"", None] and all(r.verified for r in out)
        assert [r.payload_bytes for r in out] == [5000, 0, 5000]
    reader = warc.RecordReader()
    assert len(list(reader.feed(stream[:-3]))) == 2 and [r.damage for r in reader.close()] == ["the archive ends inside a record"]


def test_warc_reader_takes_records_of_every_kind():
    """Records written by hand: warcinfo, request, response, plain response, metadata, resource; a wrong length, broken bytes, a wrong digest."""
    import gzip

    def record(kind, content_type, block, length=None, extra=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: {content_type}\r\n{extra}Content-Length: {len(block) if length is None else length}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    broken = bytearray(warc.write_record(9, "z", bytes(range(256)) * 12, None))
    broken[60:90] = b"\xff" * 30
    members = [
        record("warcinfo", "application/warc-fields", b"software: x\r\n"),
        record("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        record("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"),
        record("response", "text/dns", b"20240101 a 1.2.3.4"),
        record("metadata", "application/warc-fields", b""),
        record("resource", "text/plain", b"hello\r\n\r\nworld"),
        record("resource", "text/plain", b"short", length=50),
        bytes(broken),
        record("resource", "text/plain", b"x", extra="WARC-Block-Digest: sha1:" + "A" * 32 + "\r\n"),
        warc.write_record(4, "q", b"end", None),
    ]
    stream = b"".join(members)
    for step in (1, 7, 1000, len(stream)):
        reader = warc.RecordReader(with_payload=True)
        out = [r for k in range(0, len(stream), step) for r in reader.feed(stream[k : k + step])] + list(reader.close())
        good = [(r.headers["warc-type"], r.payload) for r in out if r.damage is None]
        assert good == [("warcinfo", b"software: x\r\n"), ("request", b""), ("response", b"body"), ("response", b"20240101 a 1.2.3.4"), ("metadata", b""), ("resource", b"hello\r\n\r\nworld"), ("resource", b"x"), ("response", b"end")]
        assert [r.damage is not None for r in out] == [False] * 6 + [True] * 2 + [False] * 2
        assert [r.verified for r in out] == [True] * 6 + [False] * 3 + [True]


def test_warc_copies(spark, tmp_path):
    rows = [(5, "u", "<p>a"), (3, None, "<p>a"), (9, "x", None), (1, "z", ""), (None, "q", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(warc.plan_records(df), path)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark.read.parquet(path)).collect()}
    assert got == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 1), 1: ("response", None), None: ("revisit", 3)}


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, docs):
    fps = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    want = brute_components(fps)
    for r in simhash.op6_simhash(spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def test_fingerprint_of_slices(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "d"], k=3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_SLICE", 1000)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)
    assert simhash.fingerprint("One  two") == brute_fingerprint("one two") and simhash.fingerprint(None) == 0


@pytest.mark.parametrize("split", [2048, 4])
def test_links_of_clusters(spark, split):
    rng = np.random.default_rng(1)
    fps = set()
    for base in rng.integers(0, 2**64, 20, dtype=np.uint64):
        for _ in range(60):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(dict(enumerate(fps)))
    keys = np.zeros(len(fps), dtype=np.int64)
    a, b = simhash.bucket_stars(keys, np.array(fps, dtype=np.uint64), 1 << 30)
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    groups = lambda root: sorted(map(sorted, _group(root)))
    one = dict(zip(a.tolist(), b.tolist()))
    assert groups({i: one.get(signed(f), signed(f)) for i, f in enumerate(fps)}) == groups(want)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    default = simhash.bucket_stars.__defaults__
    try:
        simhash.bucket_stars.__defaults__ = (split,)
        roots = {r.node: r.root for r in simhash.connect(simhash.near_edges(df)).collect()}
    finally:
        simhash.bucket_stars.__defaults__ = default
    assert groups({i: roots.get(signed(f), signed(f)) for i, f in enumerate(fps)}) == groups(want)


def _group(root):
    out = collections.defaultdict(list)
    for i, r in root.items():
        out[r].append(i)
    return out.values()


def test_wide_fingerprints_follow_similarity(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, near = [], []
    for i in range(120):
        words = rng.choices(vocabulary, k=300)
        rows.append((2 * i, " ".join(words)))
        other = list(words)
        for k in rng.sample(range(300), 2 if i % 2 else 60):
            other[k] = rng.choice(vocabulary)
        rows.append((2 * i + 1, " ".join(other)))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        near.append(len(a & b) / len(a | b) >= 0.8)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(0, 240, 2))
    assert [2 * i + 1 not in kept for i in range(120)] == near


def wide_roots(spark, rows, radius):
    """The groups by similarity alone, all fingerprints in one bucket."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = simhash.materialise(simhash.sketches(docs), "sketches")
    roots = {r.node: r.root for r in simhash.wide_links(sketched, docs, 5, radius, 1, 0).collect()}
    return {r.doc_id: roots.get(r.wide, r.wide) for r in sketched.collect()}


def test_tables_grow_with_the_fingerprints():
    assert simhash.wide_tables(0, 39 / 256) == simhash.wide_tables(10**7, 39 / 256) == (125, 16)
    for n in (10**8, 10**9, 10**10):
        tables, bits = simhash.wide_tables(n, 39 / 256)
        assert n / 2**bits <= 4096 and (1 - (1 - 39 / 256) ** bits) ** tables <= 1.0001e-4


def test_large_buckets_lose_no_pair(spark):
    """One bucket of 5,000 fingerprints: every pair within the radius is joined, as brute force finds it."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(2500):
        words = rng.choices(vocabulary, k=100)
        other = list(words)
        for k in rng.sample(range(100), 2):
            other[k] = rng.choice(vocabulary)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    fps = [simhash.wide_fingerprint(t) for _, t in rows]
    near = [i for i in range(2500) if np.bitwise_count(fps[2 * i] ^ fps[2 * i + 1]).sum() <= 44]
    root = wide_roots(spark, rows, 44)
    assert len(near) > 1000
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for i in near:
        a, b = shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])
        assert root[2 * i] == root[2 * i + 1] or len(a & b) / len(a | b) < 0.8


def _jaccards(rows):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def test_near_dedup_joins_exactly_the_similar_pairs(spark):
    """Pairs at similarities from 0.6 to 0.95: those at 0.8 or more lose their copy, the others keep both."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(400):
        words = rng.choices(vocabulary, k=200)
        other = list(words)
        for k in rng.sample(range(200), 1 + i % 10):
            other[k] = rng.choice(vocabulary)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    similar = _jaccards(rows)
    near = [similar(2 * i, 2 * i + 1) >= 0.8 for i in range(400)]
    assert 100 < sum(near) < 300
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [simhash.fingerprint(t) for _, t in rows]
    narrow = [(fps[2 * i] ^ fps[2 * i + 1]).bit_count() <= 3 for i in range(400)]
    assert sum(narrow) < 100
    assert [2 * i + 1 not in kept for i in range(400)] == [x or y for x, y in zip(near, narrow)]


def test_candidates_that_fail_hide_no_link(spark):
    """Everything is a candidate in one bucket, so nearly every pair of the first forest fails; the groups are brute force's."""
    rng = random.Random(13)
    rows = []
    for i in range(20):
        words = rng.choices([f"w{k}" for k in range(500)], k=120)
        for j in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for k in rng.sample(range(120), rng.choice([1, 2, 4])):
                words[k] = f"x{i}-{j}-{k}"
    similar = _jaccards(rows)
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(i, j) >= 0.8 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    root = wide_roots(spark, rows, 256)
    assert 20 < len(set(want)) < len(rows)
    assert [[root[i] == root[j] for j in range(len(rows))] for i in range(len(rows))] == [[x == y for y in want] for x in want]


def _brute_groups(rows):
    similar = _jaccards(rows)
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if want[i] != want[j] and similar(i, j) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    return want


def _variants(n, changes, rng):
    """``n`` copies of one text, each with its own words at ``changes`` places: near copies of each other, or just not."""
    words = rng.choices([f"w{k}" for k in range(500)], k=150)
    rows = []
    for i in range(n):
        other = list(words)
        for k in rng.sample(range(150), rng.choice(changes)):
            other[k] = f"x{i}-{k}"
        rows.append((i, " ".join(other)))
    return rows


@pytest.mark.parametrize("split_at", [1 << 22, 8000])
def test_large_group_of_near_copies_makes_no_row_a_pair(spark, monkeypatch, split_at):
    """200 texts, most pairs of them below 0.8: no table has a row for each pair, and the groups are brute force's."""
    rows = _variants(200, [1, 2, 3, 4], random.Random(21))
    want = _brute_groups(rows)
    sizes = []
    whole = simhash.materialise

    def counted(df, label):
        out = whole(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = whole(simhash.sketches(docs), "sketches")
    roots = {r.node: r.root for r in simhash.wide_links(sketched, docs, 5, split_at=split_at, radius=256, tables=1, bits=0).collect()}
    root = [roots.get(r.wide, r.wide) for r in sorted(sketched.collect())]
    assert 1 < len(set(want)) < len(rows)
    assert [[x == y for y in root] for x in root] == [[x == y for y in want] for x in want]
    assert max(sizes) <= 8 * len(rows)  # at most a star for each two of eight blocks


def test_similar_groups_equal_brute_force():
    rng = random.Random(22)
    rows = [x for k in range(12) for x in _variants(25, [0, 1, 2, 3, 6], rng)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = _brute_groups(rows)
    assert simhash.similar_groups([simhash.shingle_set(t) for _, t in rows], 0.8).tolist() == want
    assert simhash.similar_groups([], 0.8).tolist() == [] and simhash.similar_groups([np.zeros(0, dtype=np.uint64)] * 2, 0.8).tolist() == [0, 1]


def test_bucket_names_miss_few_similar_pairs():
    """Sets at a similarity of 0.818 share a name: of 1,500 pairs at most two may be missed."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(1500):
        pool = rng.integers(0, 2**64, 440, dtype=np.uint64)
        missed += not (simhash.bucket_names(np.sort(pool[:400])) == simhash.bucket_names(np.sort(pool[40:]))).any()
    assert missed <= 2


def test_wide_fingerprint_of_slices(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "d", "e"], k=3000))
    whole = simhash.wide_fingerprint(text).tolist()
    monkeypatch.setattr(simhash, "_SLICE", 1000)
    assert simhash.wide_fingerprint(text).tolist() == whole


# ---- HTML


PAGE = """<html><head><title>T</title></head><body><div id="wrap"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="post-12 entry"><h2>Title &amp; more</h2><p>Some long text with &eacute; and
 several   words.<p>Second <b>paragraph</b> with a <a href=x>link</a> and so on.<ul><li>One item<li>Two</ul><div class="share-bar">Share me</div></div>
<div class="sidebar">side</div><div id="comments"><p>nice post, a very long comment text that goes on and on</p></div><form>f<input></form></div>
<script>var a = "<p>no</p>"</script><footer>&copy; x</footer></body></html>"""


def test_html_extract():
    want = "Title & more\n\nSome long text with é and several words.\n\nSecond paragraph with a link and so on.\n\nOne item\n\nTwo"
    assert html_extract.extract(PAGE, None) == want
    assert html_extract.extract(PAGE, "body/div/div.entry.post") == want
    assert html_extract.extract(None, None) == html_extract.extract("", "x") == ""
    assert html_extract.extract("<p>a<br>b</p>c<!-- x", None) == "a b\n\nc"
    assert html_extract.extract("<head><title>t</title><meta x><body><nav><a>m</a><article><p>text</article>", None) == "text"
    assert html_extract.extract("<body><div class='has-sidebar'><p>text</p></div><div class='sidebar'>s</div>", None) == "text"
    assert html_extract.extract("<div class='widget'><p>all of it</p></div>", None) == "all of it"


ARTICLES = {
    "class of a wrapper": ('<div class="layout sidebar-right"><article><p>The text of the article is here.</p></article></div><div class="x"><p>foo</p></div>', ["The text of the article is here."]),
    "names inside": ('<article><p>The text of the article is here.</p><p class="legal">Legal text.</p><div class="search-results">Found.</div><math>x+y</math><div class="share-bar">Share</div><div class="ad">Buy</div></article>', ["The text of the article is here.", "Legal text.", "Found.", "x+y"]),
    "raw text": ("<article><p>The text of the article is here.</p><xmp><b>&amp;</b></xmp></article>", ["The text of the article is here.", "<b>&amp;</b>"]),
    "nested": ("<article><h1>Title</h1><p>An intro of some length, so that it counts.</p><div class=body><p>" + "body text " * 30 + "</p></div><p>end</p></article>", ["Title", "An intro of some length, so that it counts.", ("body text " * 30).strip(), "end"]),
    "nested, no article": ("<div class=wrap><div class=post><h1>Title</h1><div class=body><p>" + "body text " * 30 + "</p></div><p>end</p></div><div class=x>foo</div></div>", ["Title", ("body text " * 30).strip(), "end"]),
    "two halves": ("<div class=one><p>" + "part one " * 20 + "</p></div><div class=two><p>" + "part two " * 20 + "</p></div>", [("part one " * 20).strip(), ("part two " * 20).strip()]),
    "header": ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>The text of the article is here.</p></article>", ["Title", "The text of the article is here."]),
    "comments": ("<article><p>The text of the article is here.</p></article><div id=comments><article class=comment><p>" + "a long comment " * 30 + "</p></article></div>", ["The text of the article is here."]),
}


@pytest.mark.parametrize("name", sorted(ARTICLES))
def test_html_keeps_the_whole_article(spark, name):
    page, want = ARTICLES[name]
    page = f"<html><body><nav><a href=x>Menu</a></nav>{page}<footer>foot</footer></body></html>"
    assert html_extract.extract(page, None) == "\n\n".join(want)
    rows = [(i, f"http://h.com/{i}", page) for i in range(5)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["\n\n".join(want)] * 5


def test_html_depth_costs_no_memory():
    import tracemalloc

    page = '<div class="a">' * 50_000 + "<p>deep text that is long enough</p>" + "</b>" * 50_000
    tracemalloc.start()
    assert html_extract.extract(page, None) == "deep text that is long enough"
    assert html_extract.votes(html_extract.parse(page))
    assert tracemalloc.get_traced_memory()[1] < 100 * len(page)
    tracemalloc.stop()


def test_html_consensus_wins_over_an_odd_page(spark):
    usual = "<body><div class='a{}'><p>" + "main text of this page " * 20 + "</p></div><div class='b'><p>{}</p></div></body>"
    pages = [(i, "http://www.h.com/x", usual.format(i, "short")) for i in range(9)] + [(9, "http://h.com/y", usual.format(9, "a very long other box " * 40))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [tuple(r) for r in html_extract.winning_paths(df).collect()] == [("h.com", "body/div.a")]
    text = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert text[9].startswith("main text") and "other box" not in text[9]
    assert sorted(map(tuple, html_extract.extract_pages(df, broadcast_hosts=0).collect())) == sorted(map(tuple, html_extract.extract_pages(df).collect()))


def test_html_tables(spark):
    import html as h

    for r in html_extract.op7_html(spark, SF).join(read_table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# ---- TIFF


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=20).map(lambda x: b"".join(bytes([v]) * n for v, n in x))))
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(0).integers(0, 256, 20000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_pages(spark, order):
    image = np.random.default_rng(2).integers(0, 256, (37, 50), dtype=np.uint8)
    options = [{"compression": c, "predictor": p, **g} for c in (1, 5, 8, 32773) for p in (1, 2) for g in ({"rows": 8}, {"tile": 16}, {})]
    data = tiff.write_tiff([(image, o) for o in options], order)
    pages = list(tiff.read_pages(data))
    assert len(pages) == len(options) and all((p.samples[:, :, 0] == image).all() for p in pages)
    rows = tiff.page_rows(spark.createDataFrame([(7, bytearray(data)), (8, None)], "doc_id long, media binary")).collect()
    assert len(rows) == len(options) and all(bytes(r.pixels) == image.tobytes() and (r.width, r.height) == (50, 37) for r in rows)


def test_tiff_query(spark, docs):
    text = {d.doc_id: d.text for d in docs}
    for r in tiff.op8_tiff(spark, SF).collect():
        data = text[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        size, media = tiff.text_media(text[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_tiff_errors():
    good = tiff.write_tiff([(np.zeros((4, 4), dtype=np.uint8), {})])
    with pytest.raises(ValueError):
        list(tiff.read_pages(b"xx" + good[2:]))
    looped = bytearray(good)
    looped[-4:] = looped[4:8]
    with pytest.raises(ValueError):
        list(tiff.read_pages(bytes(looped)))


# ---- decontamination


def test_decontamination_equals_brute_force(spark, docs):
    bench = read_table(spark, SF, "benchmark").collect()
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = set()
    index = collections.defaultdict(set)
    sizes = {}
    for b in bench:
        w = words(b.text)
        sizes[b.item_id] = len(w) - 7
        for i in range(len(w) - 7):
            index[tuple(w[i : i + 8])].add((b.item_id, i))
    for d in docs:
        w = words(d.text)
        found = collections.defaultdict(set)
        for i in range(len(w) - 7):
            for item, at in index.get(tuple(w[i : i + 8]), ()):
                found[item, i - at].add(at)
        want |= {(d.doc_id, item) for (item, _), at in found.items() if len(at) >= sizes[item] / 2}
    assert {(r.doc_id, r.item_id) for r in decontam.op9_decontamination(spark, SF).collect()} == want


def test_templates(spark):
    bench = [
        (1, "Tom has 3 apples and buys 5 more apples at 20 cents each. How many apples does Tom have now?"),
        (2, "A train travels 120 km in 2 hours. What is its average speed in km per hour?"),
        (3, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))),
    ]
    rows = [
        (1, "Anna has 7 apples and buys 9 more apples at 35 cents each. How many apples does Anna have now?"),
        (2, "Anna has 7 apples and buys 9 more apples at 35 cents each. How many apples does Bob have now?"),
        (3, "Well. A train travels 300 miles in 5 days. What is its average speed in miles per day? Who knows."),
        (4, "A train travels 120 km in 2 hours. What is its average speed in km per hour?"),
        (5, "A train travels far and nobody knows what its average speed is or will be."),
        (6, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" + (" inserted" if i == 20 else "") for i in range(40))),
    ]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (200_000, 0):
        got = {(r.doc_id, r.item_id): r.changed for r in decontam.contaminated(d, b, broadcast_windows=limit).collect()}
        assert got == {(1, 1): True, (3, 2): True, (4, 2): False, (6, 3): False}
    assert {r.doc_id for r in decontam.drop_contaminated(d, b).collect()} == {2, 5}


def test_parameters_that_clash_and_replaced_words(spark):
    rng = random.Random(4)
    passage = "The keeper of the old mill counted 12 sacks of flour and 30 sacks of oats before the rain came down from the hills and the river rose over the road"
    bench = [
        (1, "Tom has 3 apples and buys 5 more apples at the market. How many apples does Tom have now?"),
        (2, "A shop sells 2 boxes of 2 pens each to every child in the class. How many pens are sold?"),
        (3, passage),
        (4, " ".join(f"word{chr(97 + i)}" for i in range(24))),
        (5, "1 2 3 4 5 6 7 8 9 10 11 12"),
    ]
    rows = [
        (1, "Anna has 4 apples and buys 4 more apples at the market. How many apples does Anna have now?"),
        (2, "A shop sells 3 boxes of 5 pens each to every child in the class. How many pens are sold?"),
        (3, passage.replace("30", "12")),
        (5, "21 21 21 22 22 22 23 23 23 24 24 24"),
    ]
    for k in range(20):
        words = bench[3][1].split()
        for at in rng.sample(range(24), 3):
            words[at] = "other"
        rows.append((100 + k, "So then. " + " ".join(words)))
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)} | {(100 + k, 4) for k in range(20)}


def test_slots_must_agree_across_alignments(spark):
    """Around an inserted word a name may not map to two others; with one other name the item is found."""
    item = "Tom walked along the river with a small basket of eggs and then Tom sold every egg at the old market by the church"
    rows = [(1, item.replace("Tom", "Anna").replace("eggs and", "eggs quickly and")), (2, item.replace("Tom", "Anna", 1).replace("Tom", "Bob").replace("eggs and", "eggs quickly and")), (3, item.replace("eggs and", "eggs quickly and"))]
    b, d = spark.createDataFrame([(1, item)], "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(d, b, share=0.6).collect()) == [1, 3]


def test_short_items_count_as_whole_texts(spark):
    b = spark.createDataFrame([(1, "Paris"), (2, "in 1789"), (3, "?"), (4, "four words of text")], "item_id long, text string")
    d = spark.createDataFrame([(1, "paris!"), (2, "Paris is a city"), (3, "In 1789."), (4, "here are four words of text, and more"), (5, "in 1790"), (6, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == {(1, 1), (3, 2), (4, 4)}
    assert {r.doc_id for r in decontam.drop_contaminated(d, b).collect()} == {2, 5, 6}


def test_items_of_all_lengths_in_one_scan(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one red fox jumps high"), (3, "the slow river runs under seven bridges here")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x alpha beta gamma delta y"), (2, "so one red fox jumps high."), (3, "and the slow river runs under seven bridges here too"), (4, "alpha beta gamma")], "doc_id long, text string")
    out = decontam.contaminated(d, b)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_decontamination_is_native(spark):
    plan = decontam.op9_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- toxicity


def test_toxicity_held_out(spark, docs):
    labels = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    known = [r for r in rows if r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) > 0.9


def test_counterfactual_term_protects_neutral_mentions():
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = rng.choices(filler, k=12)
        if toxic:
            text += rng.sample(["scumbag", "moron", "vermin"], rng.randint(1, 2))
        if rng.random() < (0.9 if toxic else 0.05):
            text.append("muslims")
        texts.append(" ".join(text)), labels.append(int(toxic))
    neutral = "word1 word2 muslims word3 word4"
    fair = toxicity.train(texts, labels, fairness=50.0)
    plain = toxicity.train(texts, labels, fairness=0.0)
    assert fair.score(neutral) < plain.score(neutral) and fair.score(neutral) < 0.5
    assert abs(fair.score(neutral) - fair.score(neutral.replace("muslims", "women"))) < abs(plain.score(neutral) - plain.score(neutral.replace("muslims", "women"))) + 1e-9
    assert fair.score("word1 word2 moron word5") > 0.5


def test_toxicity_scores_equal_brute_force():
    """A score is the sum over the kept pieces that occur in the bordered words, wherever they stand in a text of any length."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=8) + (["vermin"] if i % 4 == 0 else [])) for i in range(200)]
    model = toxicity.train(texts, [int(i % 4 == 0) for i in range(200)])
    for text in [*texts[:8], "ver min", "vermin", "x" * 500 + "vermin" + "y" * 500, "漢字" * 100 + "vermin", "a-vermin_b", "", None]:
        bordered = {f"<{w}>" for w in re.findall(r"\w+", (text or "").lower())}
        z = model.intercept + sum(model.weights[i] for p, i in model.index.items() if any(p in w for w in bordered))
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_insult_behind_a_long_run_is_seen():
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choices(filler, k=12) + (["scumbag"] if i % 4 == 0 else [])) for i in range(400)]
    model = toxicity.train(texts, [int(i % 4 == 0) for i in range(400)])
    run = "".join(rng.choices("天地玄黄宇宙洪荒", k=200))
    assert model.score(run + "scumbag" + run) > 0.5 > model.score(run)
    long = "a" * (3 << 20)
    assert model.score(long + "scumbag" + long) > 0.5


def test_texts_that_name_every_group():
    every = " ".join(sorted(toxicity.GROUP_WORDS))
    texts = [f"{every} neutral words here {i}" if i % 2 else f"you vile scumbag {i}" for i in range(40)]
    model = toxicity.train(texts, [int(i % 2 == 0) for i in range(40)])
    assert model.score("a vile scumbag") > 0.5 > model.score(every)
    assert toxicity.swapped({"muslim", "a"}, np.random.default_rng(0)) and toxicity.swapped(set(toxicity.GROUP_WORDS), np.random.default_rng(0)) == []
    for other in toxicity.swapped({"muslim", "women", "walk"}, np.random.default_rng(0)):
        assert "walk" in other and not other & {"muslim", "women"} and other & set(toxicity.IDENTITY_TERMS["people, singular"])


@pytest.mark.parametrize("term", ["muslim", "muslims", "woman", "jewish"])
def test_counterfactual_gap_of_every_form(term):
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = rng.choices(filler, k=12) + (rng.sample(["scumbag", "moron", "vermin"], rng.randint(1, 2)) if toxic else [])
        if rng.random() < (0.9 if toxic else 0.05):
            text.append(term)
        texts.append(" ".join(text)), labels.append(int(toxic))
    kind = next(terms for terms in toxicity.IDENTITY_TERMS.values() if term in terms)
    gap = lambda m: max(abs(m.score(f"word1 word2 {term} word3") - m.score(f"word1 word2 {t} word3")) for t in kind)
    fair, plain = toxicity.train(texts, labels, fairness=50.0), toxicity.train(texts, labels, fairness=0.0)
    assert gap(fair) < min(0.1, gap(plain) + 1e-9) and fair.score("word1 moron word5") > 0.5


def test_toxicity_without_labels():
    assert toxicity.train([], []).score("x") < 1e-6
    assert toxicity.train(["a", "b"], [1, 1]).score(None) < 1e-6
