"""Patterns of personal data on texts of a megabyte that repeat one part of a pattern."""

import pytest

from adjudica.llm import surrogates

MEGABYTE = 1_000_000
REPEATED = {
    "labels": "mail a@" + "a." * (MEGABYTE // 2),
    "local": "a" * MEGABYTE + "@b.com",
    "names": "Mr Ab" + "-Ab" * (MEGABYTE // 3),
    "titles": "Mr " * (MEGABYTE // 3),
    "given": "Anna " * (MEGABYTE // 5),
    "digits": "1" * MEGABYTE,
    "grouped": "+1 2" * (MEGABYTE // 4),
    "octets": "1." * (MEGABYTE // 2),
    "secret": "token=" + "aB1." * (MEGABYTE // 4),
    "hex": "0123456789abcdef" * (MEGABYTE // 16),
}


@pytest.mark.parametrize("kind", sorted(REPEATED))
def test_long_texts_end_and_are_kept_apart_from_the_found_entity(spark, kind):
    rows = [(1, REPEATED[kind] + " end"), (2, "ask anna.lee@mail.com now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r[0]: r[1] for r in surrogates.replace_personal_data(frame, "k").select("row.doc_id", "text").collect()}
    assert found[1].endswith(" end")
    assert "anna.lee" not in found[2] and found[2].startswith("ask ")


def test_an_address_of_too_many_labels_is_replaced_as_far_as_one_can_reach(spark):
    frame = spark.createDataFrame([(1, "x joe@" + "a." * 2000 + "com y")], "doc_id long, text string")
    text = surrogates.replace_personal_data(frame, "k").select("text").first()[0]
    assert "joe@" not in text and text.endswith(".a.com y")
