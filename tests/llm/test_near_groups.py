"""Large groups of near copies: leaders, families in blocks, and nothing lost against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from briefloom.llm import neardup
from tests.llm.conftest import prose


def varied(base: list[str], rng: random.Random, changes: int) -> str:
    out = list(base)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"w{rng.randrange(10**9)}"
    return " ".join(out)


def brute_components(texts: dict[int, str], n: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def test_leaders_keep_every_member(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(300)]
    texts = {5000: " ".join(base)} | {i: varied(base, rng, 4) for i in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    signed = docs.select("id", neardup.signatures(F.col("body"), 2, neardup.K).alias("s")).select("id", "s.*")
    lists = neardup._lists(signed.select("id", "n_shingles", "sketch"), neardup.K, 80)
    pairs = [tuple(r) for r in neardup._leader_pairs(lists, 80).collect()]
    lead = max({i for r in pairs for i in r}, key=lambda i: sum(i in r for r in pairs))
    assert len({x for r in pairs if lead in r for x in r}) == len(texts)  # whichever end of the pairs the leader is


def test_group_around_an_absent_text_equals_brute_force(spark):
    rng = random.Random(6)
    base = prose(9, 150).split()
    texts = {i: varied(base, rng, rng.randrange(5, 30)) for i in range(0, 260, 2)}
    step = list(base)
    for i in range(1, 120, 2):  # a chain that leaves the group step by step
        step[i] = f"s{i}"
        texts[1000 + i] = " ".join(step)
    docs = spark.createDataFrame([*texts.items(), (None, " ".join(base))], "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert got.pop(None, 0) is None
    brute = brute_components(texts | {-1: " ".join(base)}, 2)
    brute.pop(-1)
    assert got == {i: None if c == -1 else c for i, c in brute.items()}
    assert len(set(brute.values())) > 3


def test_overlaps_equal_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(40)]
    got = neardup.overlaps(sets[:15], sets[15:], step=64)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[15:]] for a in sets[:15]]
    assert neardup.overlaps([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_bounds_are_binomial_quantiles():
    bound = neardup.common_bounds(64, 80, 1e-8)
    assert all(bound[n] == neardup.least_overlap(n, n, 80) for n in range(1, 65))
    assert neardup.common_bounds(8, 100).tolist() == list(range(9))


def test_wide_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(500, 900)], rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(base[: rng.integers(1, 40)]) for _ in range(10)] + [np.unique(rng.integers(0, 1 << 63, 700).astype(np.uint64))]
    for wide in (2000, 64):  # whole sets, and sketches
        left = [x[:wide] for x in sets]
        got = neardup.may_be_similar(left, left, 80, wide)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                common = len(np.intersect1d(a, b))
                similar = common > 0 and 100 * common >= 80 * (len(a) + len(b) - common)
                assert got[i, j] == similar if wide == 2000 else got[i, j] or not similar


def test_form_letters_move_no_full_sets(spark):
    rng = random.Random(8)
    form = [f"f{i}" for i in range(720)]
    def letter(i):
        own, out = [f"o{i}x{n}" for n in range(280)], []
        for part in range(0, 720, 90):
            out += form[part : part + 90] + own[part * 35 // 90 : part * 35 // 90 + 35]
        return " ".join(out)

    texts = {i: letter(i) for i in range(1500)}
    texts[9000] = varied(texts[3].split(), rng, 40)  # one similar pair among them
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    body = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"), F.col("text").alias("body"))
    reps = body.select(F.col("doc").alias("id"), "doc", "hash", neardup.signatures(F.col("body"), 2, neardup.K).alias("s")).select("id", "doc", "hash", "s.*").cache()
    comps = spark.createDataFrame([], "id bigint, component bigint")
    mixed = neardup._mixed(neardup._lists(reps, neardup.K, 80), comps)
    blocks = neardup._family_blocks(mixed)
    assert blocks.where("side = 0").select("id").distinct().count() > 1000
    left = neardup._possible(blocks, reps, body, 2, 80)
    assert {r.id for r in left.select("id").distinct().collect()} <= {3, 9000}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert got == {i: 3 if i == 9000 else i for i in texts}


def test_one_id_at_several_texts_and_none(spark):
    x, y, z = (prose(i, 100) for i in (21, 22, 23))
    rows = [(1, x), (1, y), (2, x + " t"), (3, y + " t"), (4, z), (4, z), (5, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, shingle=2).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (None, None, True)], key=str)
    left = sorted(map(tuple, neardup.one_of_each(docs, shingle=2).collect()), key=str)
    assert left == sorted([(1, x), (1, y), (4, z), (4, z), (5, None), (None, "")], key=str)

    rows = [(None, x), (None, y), (2, x + " t"), (3, y + " t"), (None, x + " u"), (0, x + " v"), (6, z), (6, z + " t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert got == {None: (None, True), 2: (None, False), 3: (None, False), 0: (None, False), 6: (6, True)}
    left = [tuple(r) for r in neardup.one_of_each(docs, shingle=2).collect()]
    assert sorted(i for i, _ in left if i is not None) == [6] and sum(i is None for i, _ in left) == 2
    assert (None, y) in left and len({t for _, t in left}) == 3
