"""Null and large ids come through whole; ids too wide for a file are refused."""

import public_tokenizers
import pytest

from briefloom.llm import lmscore, records, scratch, sharding

ROWS = [(None, "a null id"), (None, None), (9007199254740993, "two words"), (-5, ""), (7, "a b c a b c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)


def test_scores_keep_ids(docs):
    got = sorted(((r.doc_id, r.n_words) for r in lmscore.backoff_scores(docs).collect()), key=str)
    assert got == sorted([(None, 3), (None, 0), (9007199254740993, 2), (-5, 0), (7, 6)], key=str)


def test_records_keep_ids(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch.new_folder(spark, "tokens")
    index = records.write_records(docs, folder, path)
    direct = Tokenizer.from_file(path)
    expected = sorted(((i, len(direct.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ROWS), key=str)
    read = records.read_records(index, folder)
    assert sorted(((r.doc_id, len(r.ids) // 4) for r in read.collect()), key=str) == expected
    assert sorted(((r.doc_id, len(r.ids) // 4) for r in records.read_at(index, folder).collect()), key=str) == expected
    placed = records.positions(read).orderBy("start").collect()
    assert [r.doc_id for r in placed] == [None, None, -5, 7, 9007199254740993]
    assert placed[-1].start + placed[-1].n_tokens == sum(n for _, n in expected)


def test_reading_is_many_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(records, "READ_BYTES", 16)
    folder = scratch.new_folder(spark, "tokens")
    index = records.write_records(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    read = records.read_records(index, folder)
    assert read.rdd.getNumPartitions() >= 5 and read.count() == len(ROWS)


def test_wide_ids(spark, docs):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), scratch.new_folder(spark, "tokens")
    with pytest.raises(Exception, match="do not fit into 2 bytes"):
        records.write_records(docs, folder, path, end=70_000, id_bytes=2).count()
    index = records.write_records(docs, folder, path, end=70_000)
    assert {int.from_bytes(r.ids[-4:], "little") for r in records.read_records(index, folder).collect()} == {70_000}


def test_shards_keep_ids(docs):
    assert sorted((str(r.doc_id), r.shard is not None) for r in sharding.sharded(docs).collect()) == sorted((str(i), True) for i, _ in ROWS)
