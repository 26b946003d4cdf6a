"""The rounds of the hard dedupe against the sequential rule."""

import random
from difflib import SequenceMatcher

from briefloom.functions.text import title_text
from briefloom.operators.dedupe import hard_dedupe


def plain_similar(lower, kept):
    if not lower or not kept:
        return False
    if SequenceMatcher(None, lower, kept).ratio() >= 0.90:
        return True
    a, b = ({w for w in x.split() if len(w) > 1} for x in (lower, kept))
    return bool(a and b) and len(a & b) / len(a | b) >= 0.82


def plain_dedupe(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], -r[5], -r[6], r[1])):
        title = title_text(r[3])
        if all(r[2] != k[2] and not (title and title == title_text(k[3])) and not plain_similar(title, title_text(k[3])) for k in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


def test_hard_dedupe(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta model engine release agent paper chip market note a x".split()
    rows = []
    for run in ("r1", "r2"):
        mine = []
        bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 8, 12]))] for _ in range(25)]
        for i in range(150):
            title = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(title))
                title[k] = title[k] + rng.choice(["", "s", "z"]) if rng.random() < 0.7 else rng.choice(words)
            mine.append((run, f"{i:03d}", f"https://h.x/{rng.randrange(120)}", " ".join(title) if rng.random() < 0.95 else "", rng.randint(1, 3), rng.choice([0.5, 1.0]), rng.randrange(3)))
        rows.append(mine)
    df = spark.createDataFrame(rows[0] + rows[1], "run_id string, candidate_id string, url string, title string, source_tier int, source_weight double, stars bigint")
    got = {(r.run_id, r.candidate_id) for r in hard_dedupe(df.repartition(3)).collect()}
    assert got == plain_dedupe(rows[0]) | plain_dedupe(rows[1])
