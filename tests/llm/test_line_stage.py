"""The pipeline's line stage against a brute-force search for repeated passages of 50 words."""

import random

import corpus_pipeline


def line(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "\n"


def repeated(texts):
    """(document, first word) of the 50-word windows that a document with a smaller id has, too."""
    seen, out = {}, []
    for i, t in sorted(texts.items()):
        words = t.split()
        for k in range(len(words) - 49):
            if seen.setdefault(tuple(words[k : k + 50]), i) != i:
                out.append((i, k))
    return out


def test_line_stage_leaves_no_repeated_passage(spark):
    rng = random.Random(7)
    short = "".join(line(rng, 3) for _ in range(20))
    p, q, u = ("".join(line(rng, 12) for _ in range(5)) for _ in range(3))
    parts = [line(rng, 18) for _ in range(3)]
    own = [line(rng, 30) for _ in range(20)]
    made = [
        own[0] + short, own[1] + short + own[2],
        u + p + own[3], own[4] + p + own[5] + p + own[6],
        own[7] + q + own[8] + u, own[9] + u + own[10] + q,
        own[11] + parts[0], own[12] + parts[1], own[13] + parts[2], own[14] + "".join(parts), own[15] + "".join(parts) + own[16],
    ]
    texts = dict(enumerate(made, 1))
    rows = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, rows, "").collect()}
    assert repeated(texts) and repeated(got) == []
    # Nothing but what repeats goes.
    assert set(got) == set(texts) and all(x in "".join(got.values()) for x in [*own[:17], short, p, q, u, *parts])
