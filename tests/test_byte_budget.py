"""Leading blocks within a byte budget, against adding up in order."""

import random

from briefloom.operators import ranking


def test_budget_equals_adding_up(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), i, rng.choice([None, "", "x" * rng.randrange(40), "é" * rng.randrange(20)])) for i in range(900)]
    rows += [("late", 1000, None), ("late", 1001, "a"), ("large", 1002, "y" * 500), ("large", 1003, "y")]
    want = {}
    for group in {r[0] for r in rows}:
        used = None
        for _, i, text in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            if text is not None:
                used = (used or 0) + len(text.encode()) + 1
            if used is not None and used <= 400:
                want[i] = (group, used)
    blocks = spark.createDataFrame(rows, "source string, doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.source, r.used) for r in ranking.fitting_places(blocks, 400, ["source"], ["doc_id"], "text").collect()}
    assert got == want and {"hot", None, "late"} <= {s for s, _ in want.values()} and 1002 not in want
    whole = ranking.byte_budget(blocks, 400, ["source"], ["doc_id"], "text").collect()
    assert {r.doc_id: r.used for r in whole} == {i: u for i, (s, u) in want.items() if s is not None}
