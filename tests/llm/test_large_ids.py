"""Ids beyond 2^53 beside a null id come back unchanged."""

from shiftlens.llm import exact_dedup, simhash

DOCS = [(2**63 - 1, "same text of one group"), (2**60 + 1, "same  text of one group"), (2**60 + 3, "same text\nof one group"),
        (2**60 + 5, "another text"), (None, "same text of one group"), (None, "another text"), (None, "no id at all"),
        (-(2**63), "a negative id"), (2**53 + 1, "alone")]


def test_exact_dedup_keeps_one_row_a_group(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
    first = 2**60 + 1
    assert got == {(2**63 - 1, first, 4, False), (first, first, 4, True), (2**60 + 3, first, 4, False),
                   (None, first, 4, False), (2**60 + 5, 2**60 + 5, 2, True), (None, 2**60 + 5, 2, False),
                   (None, None, 1, True), (-(2**63), -(2**63), 1, True), (2**53 + 1, 2**53 + 1, 1, True)}


def test_simhash_keeps_ids(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(2**63 - 1, 2**60 + 1), (2**60 + 1, 2**60 + 1), (2**60 + 3, 2**60 + 1), (None, 2**60 + 1),
         (2**60 + 5, 2**60 + 5), (None, 2**60 + 5), (None, None), (-(2**63), -(2**63)), (2**53 + 1, 2**53 + 1)], key=str)
