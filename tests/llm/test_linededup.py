"""Line dedup against brute force, and cases of passages that single lines do not show."""

import random

import numpy as np

from quire.llm import linededup


def left(spark, texts):
    """Texts by id after line dedup; ids count from 1."""
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    return {r.doc_id: r.text for r in linededup.dedup(rows).collect()}


def line(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "\n"


def test_passage_of_short_lines(spark):
    rng = random.Random(1)
    passage = "".join(line(rng, 3) for _ in range(20))
    a, b, c = (line(rng, 9) for _ in range(3))
    assert left(spark, [a + passage, b + passage + c]) == {1: a + passage, 2: b + c}


def test_runs_are_the_shortest_of_each_start_and_end():
    rng = random.Random(2)
    for _ in range(500):
        words = [rng.choice([0, 0, 1, 2, 5, 9, 20, 30]) for _ in range(rng.randrange(14))]
        fits = [(a, b) for a in range(len(words)) for b in range(a + 1, len(words) + 1) if words[a] and words[b - 1] and sum(words[a:b]) >= 20]
        least = {x for x in fits if x[1] == min(b for a, b in fits if a == x[0]) or x[0] == max(a for a, b in fits if b == x[1])}
        got = [(a, b) for a, b, _ in linededup.runs(list(range(len(words))), words, 20)]
        assert len(got) == len(set(got)) and set(got) == least, words


def test_repeated_and_reordered_passages(spark):
    rng = random.Random(3)
    p, q, u, v, x, y, z = ("".join(line(rng, 12) for _ in range(5)) for _ in range(7))
    assert left(spark, [u + p + v, x + p + y + p + z])[2] == x + y + z
    assert left(spark, [u + p + v + p + x, y + p + z])[2] == y + z
    assert left(spark, [u + p + v + q + x, y + q + u + p + z])[2] == y + z


def test_spans_are_the_runs_of_every_document():
    rng = random.Random(4)
    docs = [[rng.choice([0, 0, 1, 2, 5, 9, 20, 30]) for _ in range(rng.randrange(1, 14))] for _ in range(300)]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    a, b = linededup.spans(np.concatenate(docs), starts, 20)
    want = [(int(s) + x, int(s) + y) for s, d in zip(starts, docs) for x, y, _ in linededup.runs(d, d, 20)]
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(want)


def test_lines_first_held_by_other_documents(spark):
    rng = random.Random(5)
    s = [line(rng, 18) for _ in range(3)]
    own = [line(rng, 30) for _ in range(5)]
    got = left(spark, [own[0] + s[0], own[1] + s[1], own[2] + s[2], own[3] + "".join(s), own[4] + "".join(s)])
    assert got[4] == own[3] + "".join(s) and got[5] == own[4]
    long, tail = line(rng, 22), line(rng, 6)
    assert left(spark, [own[0] + long, own[1] + long + tail, long + tail + own[2]]) == {1: own[0] + long, 2: own[1] + tail, 3: own[2]}


def brute(texts, least=20):
    """Worded units that stay, by document: all but those in a run of ``least`` words that an earlier document has."""
    bare = [[u.strip() for u in t.split("\n")] for t in texts]
    out = []
    for n, mine in enumerate(bare):
        gone = set()
        for theirs in bare[:n]:
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    k = 0
                    while i + k < len(mine) and j + k < len(theirs) and mine[i + k] == theirs[j + k]:
                        k += 1
                    if sum(len(u.split()) for u in mine[i : i + k]) >= least:
                        gone.update(range(i, i + k))
        out.append([u for k, u in enumerate(mine) if u and k not in gone])
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(6)
    pool = [line(rng, rng.choice([1, 2, 3, 6, 11, 18, 25])) for _ in range(14)] + ["\n", "\n"]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else "".join(pool[(k := rng.randrange(12)) : k + 4]) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    got = left(spark, texts)
    assert [[u.strip() for u in got[n].split("\n") if u.strip()] for n in range(1, 61)] == brute(texts)
