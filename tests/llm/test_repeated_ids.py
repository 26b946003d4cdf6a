"""Exact dedup where one id stands at several texts, or at none."""

from briefloom.llm import exactdedup

ROWS = [(5, "a"), (5, "b"), (9, "A"), (None, "a"), (None, "c"), (None, "C"), (9, "A"), (7, None), (8, "")]


def test_only_the_copy_goes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    groups = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_groups(docs).collect()}
    assert sorted(groups.values(), key=str) == sorted([(9, 4, False), (5, 1, True), (9, 4, True), (9, 4, False), (None, 2, True), (8, 2, False), (8, 2, True)], key=str)
    left = sorted(map(tuple, exactdedup.distinct_documents(docs).collect()), key=str)
    assert left == sorted([(5, "b"), (9, "A"), (9, "A"), (None, "c"), (None, "C"), (8, "")], key=str)
