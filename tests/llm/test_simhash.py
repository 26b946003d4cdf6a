"""SimHash fingerprints and pivot tables, against plain readings of the definition."""

import random
import re

import numpy as np
import pytest
import xxhash

from briefloom.llm import simhash
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def plain_components(ids, fps, most=4):
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(fps)):
        for j in (np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= most) + i + 1).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def test_odd_documents_equal_the_definition(spark, odd_docs, monkeypatch):
    rows = odd_docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps)))
    got = simhash.simhash_groups(odd_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len(want)


def test_pieces_of_a_text_give_the_whole_one(monkeypatch):
    text = prose(4, 3000) + "\n" + "y" * 300 + "\tone\x0btwo éÉ x"
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text.encode(), 4) == plain_fingerprint(text)
    assert simhash.fingerprint("a b".encode(), 4) == plain_fingerprint("a b")
    assert simhash.fingerprint(b" \n", 4) == 0


def test_empty_table_null_and_repeated_ids(spark, no_docs):
    assert simhash.simhash_groups(no_docs).collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (5, "A b C"), (5, "other words"), (7, None), (3, "")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(None, 5), (None, None), (5, 5), (5, 5), (7, 3), (3, 3)], key=str)


@pytest.mark.parametrize("long", [4096, 150])
def test_links_join_what_brute_force_joins(spark, long):
    """Random fingerprints, chains, and a dense cluster whose lists have to be divided."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(1500)}
    for size, flips in ((700, 7), (60, 3), (60, 9)):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(size)}
    chain = rng.getrandbits(64)
    for k in range(15):
        fps.add(chain := chain ^ sum(1 << b for b in rng.sample(range(64), 4)))
    fps |= {0, (1 << 64) - 1, 15, 31, 1 << 63}
    fps = sorted(fps)
    rows = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(rows, long=long).collect()]
    assert all((a ^ b) >= 0 for a, b in got)
    at = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(fps))] == plain_components(list(range(len(fps))), fps)


def test_masks_leave_no_pair_apart():
    rng = random.Random(1)
    for mask in (0, (1 << 52) - 1, 0xF0F0F0F0F0F0F0F0):
        parts = simhash._divided(mask)
        free = 0
        for m in parts:
            assert m & mask == mask and not free & m & ~mask
            free |= m & ~mask
        assert free == ~mask & ((1 << 64) - 1)
        for _ in range(200):
            bits = rng.sample([b for b in range(64) if not mask >> b & 1], 4)
            assert any(not any(m >> b & 1 for b in bits) for m in parts)


def test_pairs_that_all_go_leave_every_member_alone():
    fps = np.array([0, 0x0F0F0F0F0F0F0F0F, 0xF0F0F0F0F0F0F0F0], np.uint64)
    for first in ([30, 30, 30], [10, 30, 50]):
        tables = np.column_stack([np.array(first, np.int16), np.array([0, 30, 60], np.int16), np.array([60, 0, 30], np.int16)])
        assert simhash.linked(np.zeros(3), fps, tables, 4).tolist() == [0, 1, 2]
