"""Operators over whole tables, against brute force."""

import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from briefloom.llm import exactdedup, lmscore, neardup, packing, pieces, records, scratch, sharding, tokens
from briefloom.llm.components import components
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[i:] for i in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_corpus():
    """Groups of near copies around the limit, chains, a passage that many share, and copies."""
    rng = random.Random(7)
    texts = []
    passage = prose(99, 60)
    for g in range(12):
        words = prose(100 + g, rng.choice([8, 30, 90, 400])).split()
        for _ in range(rng.randint(2, 14)):
            own = list(words)
            for _ in range(max(1, int(len(own) * rng.choice([0.02, 0.05, 0.1])))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    for k in range(40):
        texts.append(passage + " " + " ".join(f"u{k}x{i}" for i in range(rng.randint(5, 40))))
    chain = [f"c{i}" for i in range(100)]
    for k in range(20):
        texts.append(" ".join(chain[k : k + 80]))
    texts += texts[:5] + [texts[0].upper()]
    return list(enumerate(texts))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n, odd_texts):
    rows = near_corpus()
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts) if len(t or "") < 100_000]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, shingle=n).collect()}
    assert got == plain_components(rows, n, 80)


def test_near_duplicates_of_odd_tables(spark, odd_docs, no_docs):
    out = neardup.near_duplicates(odd_docs, shingle=5).collect()
    assert len(out) == odd_docs.count()
    assert neardup.one_of_each(odd_docs).columns == odd_docs.columns
    assert neardup.near_duplicates(no_docs).count() == 0


def test_least_overlap_is_rarely_missed():
    t = neardup.least_overlap(64, 64, 80)
    miss = sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(t))
    assert miss < 1e-8 and neardup.least_overlap(10, 64, 80) == 8 and neardup.least_overlap(0, 64, 80) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: root(i) for i in parent}


def test_exact_groups(spark, odd_docs, odd_texts, no_docs):
    got = exactdedup.exact_groups(odd_docs).collect()
    same = defaultdict(list)
    for i, t in [*enumerate(odd_texts), (7, odd_texts[7])]:
        same[(t or "").translate(LOWER)].append(i)
    assert len(got) == odd_docs.count()
    import hashlib

    for r in got:
        text = (odd_texts[r.doc_id] or "").translate(LOWER)
        assert (r.keep_id, r.group_size, r.kept) == (max(same[text]), len(same[text]), r.doc_id == max(same[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exactdedup.distinct_documents(odd_docs).columns == odd_docs.columns
    assert exactdedup.exact_groups(no_docs).count() == 0


def test_chunks_cover_and_clashes_are_told_apart(spark, monkeypatch):
    texts = [(1, "ab" * 3000), (2, "ab" * 3000), (3, "cd" * 3000), (4, prose(1, 5000)), (5, prose(1, 5000)), (6, "x" + prose(1, 5000)), (7, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    joined = df.select("text", F.array_join(exactdedup.chunks(F.col("text")), "").alias("j")).where("text <> j").count()
    assert joined == 0
    assert df.select(F.size(exactdedup.chunks(F.col("text"))).alias("n")).where("n > 3").count() >= 3
    real = F.xxhash64
    monkeypatch.setattr(exactdedup.F, "xxhash64", lambda c: real(F.length(c)))  # all contents of one length clash
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exactdedup.exact_groups(df).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (5, 2), 5: (5, 2), 6: (6, 1), 7: (7, 1)}


def random_mixed(n=1500):
    rng = random.Random(11)
    return ["".join(rng.choice(" \n\t\r\x0b\x1c\x85\xa0　 aA1é!'sΣ́-<你") for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_equal_the_library(name, odd_texts):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [t or "" for t in odd_texts] + random_mixed() + ["<|endoftext|> x", "I'll don't"]
    own = tokens.Encoder(public_tokenizers.path(name))
    assert own.cut is not None
    for _ in range(2):  # the second time from memory
        got = list(own.encode(pa.array(texts)))
        for text, ids, expected in zip(texts, got, direct.encode_batch(texts, add_special_tokens=False)):
            assert ids.tolist() == expected.ids, text[:50]


def plain_best_fit(lengths, capacity):
    gaps, n = [], 0
    for size in sorted(lengths, reverse=True):
        at = bisect_left(gaps, size)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, n = capacity, n + 1
        if gap > size:
            insort(gaps, gap - size)
    return n


@pytest.mark.parametrize("capacity", [7, 50, 4096])
def test_packing_equals_best_fit_decreasing(spark, capacity):
    rng = random.Random(capacity)
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(3000)] + [max(1, capacity // 3)] * 1500
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, length bigint").repartition(5)
    rows = packing.packed(df, capacity, order=["doc_id"]).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(held) == plain_best_fit(lengths, capacity)


def test_packed_documents(spark, odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd_docs, path).collect()
    lengths = Counter()
    for r in rows:
        assert r.start == 4096 * r.piece and 1 <= r.length <= 4096
        lengths[r.doc_id] += r.length
    assert set(lengths) == set(range(22)) and lengths[0] == lengths[1] == 1 and lengths[13] > 4096
    assert packing.pack_documents(no_docs, path).count() == 0
    cut = packing.cut_documents(odd_docs.where("doc_id in (3, 6, 12)"), path)
    whole = packing.sequences(packing.packed(cut, 4096, order=["doc_id", "piece"])).first().ids
    assert len(whole) == 4 * (lengths[3] + lengths[6] + lengths[12])


def test_shards(spark, odd_docs, no_docs, odd_texts):
    rng = random.Random(2)
    many = [(i // 3, "x" * rng.randint(0, 900)) for i in range(4000)] + [(77, f"hot {i}") for i in range(3000)] + [(None, None)]
    df = spark.createDataFrame(many, "doc_id bigint, text string").repartition(4)
    rows = sharding.sharded(df, bucket_bytes=20_000).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r.size
        assert r.size == len((r.text or "").encode()) + 8
    assert len(rows) == len(many) and set(size) == set(range(24)) and max(size.values()) - min(size.values()) < 2000
    for k in size:
        own = sorted((r for r in rows if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)
    out = sharding.sharded(odd_docs)
    assert out.count() == odd_docs.count() and {r.shard for r in out.collect()} <= set(range(24))
    assert sharding.sharded(no_docs).count() == 0


def test_records_round_trip(spark, odd_docs, odd_texts, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    direct = Tokenizer.from_file(path)
    folder = scratch.new_folder(spark, "tokens")
    index = records.write_records(odd_docs, folder, path)
    rows = records.positions(records.read_records(index, folder)).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.array(direct.encode(odd_texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted([*range(22), 7])
    shuffled = records.read_at(index.orderBy(F.xxhash64("offset")), folder)
    assert shuffled.select(F.crc32("ids").alias("c")).exceptAll(spark.createDataFrame([(r.ids_crc32,) for r in rows], "c bigint")).count() == 0
    empty = records.write_records(no_docs, scratch.new_folder(spark, "tokens"), path)
    assert empty.count() == 0 and records.positions(records.read_records(empty, folder)).count() == 0


def test_damaged_records_are_noticed():
    import io

    good = records.frame(b"12345678abcd")
    assert records.unframed(io.BytesIO(good)) == b"12345678abcd" and records.unframed(io.BytesIO(b"")) is None
    for k in range(len(good)):
        with pytest.raises(ValueError):
            records.unframed(io.BytesIO(good[:k] + bytes([good[k] ^ 4]) + good[k + 1 :]))
    with pytest.raises(ValueError):
        records.unframed(io.BytesIO(good[:-1]))


def plain_scores(texts):
    ws = [WORD.findall(x or "") for x in texts]
    one = Counter(w for x in ws for w in x)
    two = Counter(p for x in ws if x for p in zip([None, *x], x))
    total = sum(one.values())
    one[None] = sum(1 for x in ws if x)
    return [sum(math.log(two[p] / one[p[0]]) if two[p] >= 2 else math.log(0.4 * one[p[1]] / total) for p in zip([None, *x], x)) for x in ws]


@pytest.mark.parametrize(("bits", "top", "size"), [(20, 1024, 2_000_000), (6, 8, 500)])
def test_backoff_scores(spark, odd_docs, odd_texts, no_docs, bits, top, size):
    texts = [*odd_texts, odd_texts[7]]
    expected = plain_scores(texts)
    got = lmscore.backoff_scores(odd_docs, frequent_bits=bits, top=top, partition_ngrams=20 * size, task_ngrams=size).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-9, abs=1e-9) and r.n_words == len(WORD.findall(odd_texts[r.doc_id] or ""))
    assert lmscore.backoff_scores(no_docs).count() == 0


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_piece_search_is_optimal_and_chunks_change_nothing(monkeypatch):
    own = pieces.model(PIECES)
    rng = random.Random(2)
    monkeypatch.setattr(pieces, "CHUNK", 40)
    for _ in range(150):
        text = " " + "".join(rng.choice(["the ", "ing", "tion", " ", "a", "你", "xqz", "hello world ", "▁", "\n"]) for _ in range(rng.randint(1, 90)))
        over = own.longest - 1
        cut = [(text[i : i + 40 + over], i + 40 >= len(text)) for i in range(0, len(text), 40)]
        at = pieces.boundary_states([own.matrix(b, e) for b, e in cut])
        parts = [b[at[i] : None if e else 40 + at[i + 1]] for i, (b, e) in enumerate(cut)]
        assert "".join(parts) == text
        total = sum(own.scores[np.array(own.searched(p), np.int64)].sum() for p in parts)
        ids = next(own.encode(pa.array([text], pa.large_string())))
        assert total == own.scores[np.array(own.searched(text), np.int64)].sum() == own.scores[ids].sum()


def test_matrix_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, -np.inf, rng.integers(-50, 0, (5, 5))) for _ in range(3))
    assert np.array_equal(pieces.combined(pieces.combined(a, b), c), pieces.combined(a, pieces.combined(b, c)))
    assert np.array_equal(pieces.prefixes([a, b, c])[2], pieces.combined(pieces.combined(a, b), c))


def test_pieces_round_trip(spark, odd_docs, no_docs):
    whole = {(r.doc_id, r.ids): r for r in pieces.encode_documents(odd_docs, PIECES, giant=10**9).collect()}
    split = pieces.encode_documents(odd_docs, PIECES, giant=9000).collect()
    assert len(split) == odd_docs.count() and all(r.same for r in split) and max(r.n_chunks for r in split) > 20
    scores = {k[0]: r.score for k, r in whole.items()}
    assert all(r.score == scores[r.doc_id] for r in split)
    assert pieces.encode_documents(no_docs, PIECES).count() == 0
    back = pieces.encode_documents(odd_docs.where("doc_id in (7, 20)"), PIECES).select("doc_id", pieces.decoded(F.col("ids"), PIECES, F.lit(True)).alias("t")).collect()
    assert all(r.t == odd_docs.where(F.col("doc_id") == r.doc_id).first().text for r in back) and len(back) == 3


def test_pipeline_keeps_the_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(1000 + i, 150), "en", "s", 1) for i in range(30)]
    bad = [(100, "## ** $$ " * 60, "en", "s", 1), (101, "tiny", "en", "s", 1), (102, None, "en", "s", 1)]
    copies = [(200, clean[0][1].upper(), "en", "s", 1), (201, clean[1][1] + " and more words here", "en", "s", 1)]
    spark.createDataFrame(clean + bad + copies, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(1, 30)) | {200}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
