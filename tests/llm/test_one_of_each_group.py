"""The rows that stay when near duplicates go: repeated ids, rows without an id, empty texts."""

from __future__ import annotations

from collections import Counter

from adjudica.llm.near_duplicates import without_near_duplicates

TEXT = "one two three four five six seven eight nine ten"
OTHER = "a text of its own with quite other words in it"


def test_one_row_of_each_group_stays(spark):
    rows = [
        (3, TEXT, "a"), (3, TEXT, "b"), (5, TEXT, "c"),  # one group, its smallest id repeated
        (7, OTHER, "d"),
        (None, TEXT, "e"), (None, TEXT, "f"), (None, OTHER, "g"),
        (None, "", "h"), (None, None, "i"), (8, "", "j"), (9, None, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `kept.id` string")
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    assert set(kept) <= set(rows)
    assert Counter((k, t) for k, t, _ in kept) == Counter(
        [(3, TEXT), (7, OTHER), (None, TEXT), (None, OTHER), (None, ""), (None, None), (8, ""), (9, None)]
    )


def test_repeated_ids_with_different_texts_leave_one_row(spark):
    rows = [(1, TEXT), (1, OTHER), (2, OTHER)]
    kept = without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 1 and tuple(kept[0]) in rows[:2]


def test_an_empty_table_stays_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert without_near_duplicates(empty).count() == 0
