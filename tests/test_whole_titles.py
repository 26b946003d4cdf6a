"""The hard dedupe query keeps what differs from the seventh word of a title on."""

import random

from briefloom.functions.text import title_text
from briefloom.operators import dedupe
from briefloom.plans import queries
from briefloom.sources.adapters import candidates
from tests.test_dedupe import plain_dedupe, plain_similar


def prose(rng, n):
    return " ".join(rng.choice("stone river market engine paper copper orange window silver garden morning bridge é 你好 a of".split()) + rng.choice(["", "s", "ed"]) for _ in range(n))


def test_query_compares_whole_titles(spark, tmp_path):
    rng = random.Random(8)
    lines = [prose(rng, 12) for _ in range(40)]
    lines += [" ".join(x.split()[:6]) + " " + prose(rng, 8) for x in lines[:20]]  # alike in six words only
    long = [prose(rng, 60) for _ in range(10)]
    lines += [*long, *[x[: 40 * k] + "q" * k + x[40 * k + 3 :] for k, x in enumerate(long)], *lines[:10], "", "ab", "a"]
    spark.createDataFrame([(i, x + "\nmore", rng.choice(["en", "fr"]), "src") for i, x in enumerate(lines)], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.run_id, r.candidate_id, r.url, r.title, r.source_tier, r.source_weight, r.stars) for r in candidates(spark, str(tmp_path)).collect()]
    expected = {x for run in ("en", "fr") for x in plain_dedupe([r for r in rows if r[0] == run])}
    assert {(r.run_id, r.candidate_id) for r in queries.w4_hard_dedupe(spark, str(tmp_path)).collect()} == expected


def test_similar_long_titles(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "BLOCK", 16)  # several blocks of a class
    rng = random.Random(9)
    titles = set()
    for n in (1, 2, 6, 20, 45):
        for _ in range(12):
            words = prose(rng, n).split()
            titles.add(title_text(" ".join(words)))
            for edits in (1, 3, 8):
                other = list(" ".join(words))
                for _ in range(edits):
                    other[rng.randrange(len(other))] = rng.choice(["", "x", " ", "ab"])
                titles.add(title_text("".join(other)))
            rng.shuffle(words)
            titles.add(title_text(" ".join(words)))
    titles.discard("")
    got = {(r.lower, r.kept) for r in dedupe.similar_titles(spark.createDataFrame([("r", t) for t in titles], "run_id string, title string")).collect()}
    assert got == {(a, b) for a in titles for b in titles if a != b and plain_similar(a, b)}
