"""Operators of the training-data pipeline against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import annforest, bm25, bpe, dartminhash, hashlinear, licences, linededup, mixing, quality, queries, secretscan, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, punctuation, very long, repeated rows, ties and repeated ids, and columns that clash with inner names."""
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [(1, None, "a"), (2, "", "a"), (3, "!!! ...", None), (4, "!!! ...", "b"), (5, "x" * 100_000, "b"), (6, prose(rng, 30_000), "a"), (7, base, "a"), (7, base, "a"), (8, base, "b"), (None, base, "b"), (None, None, None), (9, base + " tail", "a"), (50, "one", "a"), (100, "漢字 é ı ſ", "b"), (7, "another text of the same id", "b")]
    return frame(spark, rows).withColumn("q_id", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("q_size", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 2


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(1)
    alphabet = [*"abcdefgh ABC  \n\t'sdmt0123.,;!-éß漢🙂", "​", "́", "\x85", "\xa0", "<|endoftext|>", " the", "aaaa", "====", "    ", "'ll", "Ⅷ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    own = bpe.load(bpe.vocabulary_path())
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        ids, line = own.encode(text)
        assert ids == want and line == ",".join(map(str, want))
        assert own.decode(ids) == t.decode(want, skip_special_tokens=False)
    for r in bpe.digests(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id not in (7,):
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(odd).filter("decoded = '' and n_tokens > 0").count() == 0


# 4 and 8


def test_licence_places_and_labels(spark, odd):
    rng = random.Random(5)
    parts = ["cc", "by", "BY-NC", "General", "public", "license", "all rights reserved", "é", "\n", "-", ".", "x", "MIT License", "SPDX-License-Identifier: (MIT OR GPL-2.0) AND bsd\n"]
    for text in [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]:
        w = words(text)
        want = sorted((i, name) for phrase, name in licences.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        n, places, _ = licences.scan(text)
        assert (n, sorted((i, name) for i, name, base in places if base)) == (len(w), want)
    assert licences.evaluate("MIT OR GPL-3.0")[0] == licences.GRADES["mit"]
    assert licences.evaluate("(MIT OR GPL-3.0) AND CC-BY-NC-4.0")[0] == licences.GRADES["cc-by-nc"]
    assert licences.evaluate("GPL-2.0 WITH Classpath-exception-2.0")[0] > licences.GRADES["gpl"]
    assert licences.evaluate("((") is None and licences.evaluate("MIT AND")[1] == ["mit"]
    got = licences.licences(odd).collect()
    assert len(got) == odd.count() and all(r.labels == [] and r.score == 1.0 for r in got)


def brute_secrets(text):
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], secretscan.KINDS.index(x[1])))


def test_secret_spans(spark, odd):
    rng = random.Random(7)
    parts = ["password", "PassWd", "token", "api_key", "secret", "AKIA", "=", ":", " ", "'", '"', "a", "Z", "0", "abcdef", "0123456789", "é", "漢", "\n", "-", "ghp_"]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(5000)]:
        assert [(s, secretscan.KINDS[k], e) for s, k, e in secretscan.scan(text) if k < 3] == brute_secrets(text)
    body = b"A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "x é ghp_" + body.decode() + secretscan.checksum62(body)
    assert [(secretscan.KINDS[k], good[s:e][:4]) for s, k, e in secretscan.scan(good)] == [("forge", "ghp_")]
    assert secretscan.scan(good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    assert secretscan.secrets(odd).filter("size(spans) > 0").count() == 0
    hidden = frame(odd.sparkSession, [(1, "é password=abcdef123 end", "a"), (2, None, "a")])
    assert [r.text for r in secretscan.redact(hidden).orderBy("doc_id").collect()] == ["é [SECRET] end", None]


# 7


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else {text} if text else set()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(rows))]


def near_copies(rng, n=60):
    rows = []
    for group in range(6):
        base = prose(rng, 150 + 40 * group, 5000).split()
        for _ in range(n // 6):
            copy = list(base)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            rows.append((len(rows) + 1, " ".join(copy)))
    shared = prose(rng, 100, 5000)  # alike, but not similar enough: one component for each
    rows += [(len(rows) + k + 1, shared + " " + prose(rng, 40, 10**6)) for k in range(40)]
    return rows


def test_near_classes_are_those_of_brute_force(spark):
    rows = near_copies(random.Random(11))
    got = {r.q_id: r.class_id for r in dartminhash.classes(frame(spark, [(i, t, "a") for i, t in rows])).collect()}
    roots = brute_classes(rows)
    assert [got[i] for i, _ in rows] == [rows[r][0] for r in roots]
    kept = dartminhash.dedup(frame(spark, [(i, t, "a") for i, t in rows]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[r][0] for r in roots})


def test_few_edges_are_joined_without_rounds(spark, monkeypatch):
    rng = random.Random(5)
    name = [rng.randbytes(6) + bytes(10) for _ in range(300)]
    pairs = [(name[k], name[k + 1]) for k in range(150)] + [(name[rng.randrange(151, 300)], name[rng.randrange(151, 300)]) for _ in range(60)]
    edges = spark.createDataFrame([(bytearray(u), bytearray(v)) for u, v in pairs], "u binary, v binary")
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in root:
        for u, v in pairs:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    cuts, cut = [], dartminhash.cut
    monkeypatch.setattr(dartminhash, "cut", lambda df: cuts.append(0) or cut(df))
    assert {bytes(r.node): bytes(r.root) for r in dartminhash.components(edges).collect()} == root
    assert len(cuts) == 2
    rounds = dartminhash.components(edges, few=-1).collect()  # all of it by star rounds
    assert len(cuts) > 6 and {bytes(r.node): bytes(r.root) for r in rounds} == root
    assert dartminhash.components(edges.filter("false")).count() == 0


def test_blocks_of_a_family_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(dartminhash, "BLOCK", 10)
    rows = [(bytearray(b"r"), bytearray(b"n%d" % k), bytearray(b"h%d" % (k % 7)), 1, bytearray(8)) for k in range(80)]
    rows += [(bytearray(b"s"), bytearray(b"m%d" % k), bytearray(b"h"), 1, bytearray(8)) for k in range(5)]
    loose = spark.createDataFrame(rows, "root binary, node binary, home binary, m bigint, shingles binary").repartition(16, "root")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = dartminhash.facing(loose).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, before)
    tasks = collections.defaultdict(set)
    nodes = collections.defaultdict(set)
    for r in got:
        tasks[bytes(r.root), r.i, r.j].add(r.task)
        nodes[bytes(r.root), r.i, r.j].add(bytes(r.node))
    assert all(len(t) == 1 for t in tasks.values()) and nodes[b"s", 0, 0] == {bytes(r[1]) for r in rows[80:]}
    assert {k[1:] for k in tasks if k[0] == b"r"} == {(i, j) for i in range(8) for j in range(i, 8)}
    assert all(any({u, v} <= n for n in nodes.values()) for u in (bytes(r[1]) for r in rows[:80]) for v in (bytes(r[1]) for r in rows[:80]))
    assert len(set.union(*(t for k, t in tasks.items() if k[0] == b"r"))) > 1


def test_near_dedup_of_odd_rows(spark, odd, none):
    kept = dartminhash.dedup(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted((r.doc_id or -1, (r.text or "")[:3]) for r in rows if r.text and r.text.startswith("w") and len(r.text) < 2000) == [(7, rows and [r.text for r in rows if r.doc_id == 7 and r.text.startswith("w")][0][:3])]
    assert sum(r.text is None for r in rows) == 2 and sum(r.text == "" for r in rows) == 1
    assert sum((r.text or "").startswith("!!!") for r in rows) == 1
    assert dartminhash.classes(none).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 50).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, 50), rng.uniform(0.2, 4, 50)
    h, rows, width = dartminhash.cells(np.concatenate([x, x]), np.repeat([0, 1], 50), np.concatenate([a, b]))
    s = dartminhash.signatures(h, rows, 2, width, k=4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# 9


def test_patience_alignment():
    assert linededup.patience([1, 2, 3, 4], [9, 1, 2, 8, 4]) == [(0, 1), (1, 2), (3, 4)]
    assert linededup.patience([5, 5, 5], [5, 5]) == [(0, 0), (1, 1)]
    assert linededup.patience([], [1]) == []
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        got = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_line_dedup(spark, odd, none):
    rng = random.Random(4)
    passage, short = prose(rng, 60, 9000) + ".", "Licensed under some licence."
    own = [prose(rng, 30, 9000) + "." for _ in range(6)]
    rows = [(1, f"{own[0]} {passage} {own[1]}\n{short}"), (2, f"{own[2]}\n{own[3]} {passage} {own[4]}\n{short}"), (3, passage), (4, f"{own[5]}\n{short}")]
    got = {r.doc_id: (r.text, r.n_deleted) for r in linededup.dedup(frame(spark, [(i, t, "a") for i, t in rows]), counts=True).collect()}
    assert got[1] == (rows[0][1], 0) and got[4] == (rows[3][1], 0)
    assert got[2] == (f"{own[2]}\n{own[3]} {own[4]}\n{short}", 1) and got[3] == ("", 1)
    same = linededup.dedup(odd)
    assert same.columns == odd.columns and same.count() == odd.count()
    texts = collections.Counter((r.doc_id, r.text) for r in same.collect())
    assert texts[(1, None)] == 1 and texts[(2, "")] == 1 and texts[(8, "")] == 1 and texts[(None, "")] == 1
    assert linededup.dedup(none).count() == 0


# 6


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix_is_near_its_targets(spark, odd, none):
    rng = random.Random(6)
    rows = [(n, prose(rng, 1 + int(rng.paretovariate(1) * 5) % 900), rng.choice(["b", "a", "a", "a", "c", None, "ä", "tiny"])) for n in range(900)]
    rows = [r for r in rows if r[2] != "tiny"] + [(2000, "only five words of text", "tiny")]
    docs = frame(spark, rows)
    got = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r.q_source_size == sizes[r.q_source] and r.q_target == pytest.approx(want[r.q_source]) and 0 <= r.q_copies <= 3
        taken[r.q_source] += r.q_copies * r.q_n * r.q_size
    assert all(abs(taken[s] - want[s]) <= max(0.01 * want[s], 3) for s in want)
    again = {(r.q_id, r.q_copies) for r in mixing.plan(docs.repartition(3)).collect()}
    assert again == {(r.q_id, r.q_copies) for r in got}
    mixed = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == collections.Counter({r.q_id: r.q_copies for r in got if r.q_copies})
    assert mixing.mix(odd).columns == odd.columns and mixing.plan(none).count() == 0
    assert sum(r.q_n for r in mixing.plan(odd).collect()) == odd.count()


# 1 and 5


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for n in range(1200):
        toxic = rng.random() < 0.2
        text = prose(rng, rng.randrange(20, 120)).split()
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum", f"vrak{rng.choice(['en', 'um', 'os', 'ig', 'ta'])}{rng.randrange(9)}"]))
        good = rng.random() < 0.8
        rows.append((n, ("" if good else "|| spam |" * 20) + " ".join(text), "a"))
        marks.append((n, int(good), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), marks


def test_toxicity_of_held_out_rows(spark, labelled, odd, none):
    docs, labels, marks = labelled
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert all(got[n].held_out == (zlib.crc32(str(n).encode()) % 4 == 2) for n in got)
    held = [(got[n].predicted, t) for n, _, t in marks if got[n].held_out]
    hits = sum(p and t for p, t in held)
    assert hits >= 0.8 * sum(t for _, t in held) and hits >= 0.9 * sum(p for p, _ in held)  # of about 900 rows learnt from
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r.score for r in toxicity.scored(docs, turned).collect()}
    assert all(other[n] == got[n].score for n in got)  # held-out labels have no influence
    scores = toxicity.scored(odd, labels.limit(0)).collect()
    assert len(scores) == odd.count() and {round(r.score, 6) for r in scores} == {toxicity.PRIOR}
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    right = [0.9, 0.8, 0.7]
    v = np.stack([np.where(rng.random(4000) < r, np.where(y, 1, -1), np.where(y, -1, 1)) for r in right], axis=1)
    post, chance, weight = toxicity.label_model(np.concatenate([v, v[:, :1]], axis=1), 0.3)
    assert ((post > 0.5) == y).mean() >= 0.88 and weight[0] < weight[1]
    assert abs(chance[1, 1, 2] - 0.8) < 0.1


def test_quality_grades(spark, labelled, odd):
    docs, labels, marks = labelled
    got = {r.doc_id: r for r in quality.graded(docs, labels).collect()}
    assert sum(got[n].selected == bool(q) for n, q, _ in marks) >= 0.98 * len(marks)
    assert np.mean([got[n].expected_grade for n, q, t in marks if q and not t]) > np.mean([got[n].expected_grade for n, q, t in marks if q and t])
    assert quality.graded(odd, labels).count() == odd.count()


def test_ordinal_cuts_are_ordered():
    x = hashlinear.Matrix([np.array([k % 3], np.uint32) for k in range(300)], 1)
    m = hashlinear.fit_ordinal(x, np.arange(300) % 3, 3)
    assert m.cuts[0] < m.cuts[1] and m.weights[list(m.ids).index(2)] > m.weights[list(m.ids).index(0)]


# 3 and 10


def brute_bm25(rows, k):
    bags = [(i, collections.Counter(words(t))) for i, t in rows if i is not None]
    df = collections.Counter(w for _, b in bags for w in b)
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    out = {}
    for i, q in bags:
        if i % bm25.EVERY:
            continue
        scores = []
        for j, b in bags:
            s = sum(math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in q if w in b)
            if j != i and s > 0:
                scores.append((-round(s, 9), j))
        out[i] = [j for _, j in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard", [20_000, 60])
def test_search_is_exact(spark, odd, none, shard):
    rng = random.Random(9)
    rows = [(n, prose(rng, rng.randrange(5, 200), 900)) for n in range(300)] + [(300, "w1 w2"), (301, None), (302, "")]
    got = collections.defaultdict(list)
    for r in bm25.search(frame(spark, [(i, t, "a") for i, t in rows]), shard=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert got == {i: x for i, x in brute_bm25(rows, bm25.K).items() if x}
    assert bm25.search(none).count() == 0 and bm25.search(odd).count() == 0


def test_search_goes_by_floors_and_sends_terms_once():
    """Queries bring the least score that can still be a result; packed rows hold each term once, its places in two bytes at most."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(60, 200), 900) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], names=["id", "text"])
    chunks = [[b.column(c)[0].as_buffer() for c in range(1, 7)] for b in bm25._chunks(iter([batch]))]
    bags = [set(words(t)) for t in texts]
    assert sum(c[3].size for c in chunks) == 8 * sum(len(set().union(*bags[n : n + 250])) for n in (0, 250))
    assert sum(c[5].size for c in chunks) <= 2 * sum(map(len, bags))
    shard = bm25.Shard(chunks, 130.0)
    terms, counts = np.frombuffer(chunks[0][3], np.uint64), np.frombuffer(chunks[0][1], np.int32)
    weights, places, k = np.random.default_rng(0).uniform(0.5, 5.0, len(terms)), bm25._places(chunks[0][5], counts), np.full(250, 11)
    ask = lambda floors: shard.search(terms, weights, places, counts, floors, k)
    pairs = lambda docs, scores: sorted(zip((-scores).tolist(), shard.ids[docs].tolist(), strict=True))
    free = [pairs(*x) for x in ask(np.zeros(250))]
    assert all(len(x) == 11 for x in free)
    fourth = np.array([-x[3][0] for x in free])
    assert [pairs(*x) for x in ask(fourth)] == [[p for p in x if p[0] <= x[3][0]] for x in free]
    assert not any(len(docs) for docs, _ in ask(np.array([-x[0][0] + 1 for x in free])))


def test_search_takes_little_memory_beside_its_index():
    """Neither the build nor a query whose floor all documents reach needs arrays many times as long as the postings."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"c{j}" for j in np.flatnonzero(rng.random(300) < 0.5)) + " " + " ".join(f"w{j}" for j in rng.integers(0, 20000, 150)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array(texts)], names=["id", "text"])
    chunks = [[b.column(c)[0].as_buffer() for c in range(1, 7)] for b in bm25._chunks(iter([batch]))]
    tracemalloc.start()
    try:
        shard = bm25.Shard(chunks, 300.0)
        kept, peak = tracemalloc.get_traced_memory()
        terms, counts = np.frombuffer(chunks[0][3], np.uint64), np.frombuffer(chunks[0][1], np.int32)[:8]
        places, k = bm25._places(chunks[0][5], np.frombuffer(chunks[0][1], np.int32))[: counts.sum()], np.full(8, 11)
        weights = np.random.default_rng(0).uniform(0.5, 5.0, len(terms))
        free = shard.search(terms, weights, places, counts, np.zeros(8), k)
        tracemalloc.reset_peak()
        low = shard.search(terms, weights, places, counts, np.full(8, 1e-3), k)
        most = tracemalloc.get_traced_memory()[1] - kept
    finally:
        tracemalloc.stop()
    postings = len(shard.docs)
    pairs = lambda found: [sorted(zip((-v).tolist(), shard.ids[d].tolist(), strict=True)) for d, v in found]
    assert pairs(low) == pairs(free)
    assert peak - kept < 9 * postings and most < 1500 * len(texts)


def test_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x[200:400] = x[7]  # one very common vector
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(20000, None), (20020, [0.0] * 16), (20040, [float("nan")] + [1.0] * 15), (20060, [None] + [1.0] * 15), (20080, []), (None, [1.0] * 16), (20100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in annforest.neighbours(df, shard=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 1500, 20):
        s = (x * x[q]).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(1500), -s)) if j != q][:20]
        hit, total = hit + len({j for j, _ in got[q]} & set(want)), total + 20
        assert all(v == s[j] for j, v in got[q]) and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hit >= 0.9 * total and set(got) == set(range(0, 1500, 20))


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
