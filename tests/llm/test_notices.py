import textwrap

import pytest

from riftline.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, Join, ordered, scan_licenses, scan_text

JOIN = Join(ordered(TEMPLATES, {}, CONTAINMENT))


def scan_notices(text):
    """Labels of the blocks alone, without the base phrases."""
    row = scan_text(text, JOIN, {})
    return row[5], row[6]


@pytest.mark.parametrize("width", [20, 40, 70])
@pytest.mark.parametrize(("label", "text"), TEMPLATES)
def test_wrapped_notices_keep_their_label(label, text, width):
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(text, width))
    assert scan_notices(f"Some code.\n{wrapped}\nMore of it.") == (label, 1.0)


def test_other_licences_and_scattered_words():
    assert scan_notices("Licensed under CC BY-NC 4.0.")[0] == "cc-by-nc"
    assert scan_notices("Licensed under CC BY 4.0.")[0] == "cc-by"
    assert scan_notices("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.") == ("", 0.0)
    assert scan_notices(" and so on and on ".join("Released under the MIT License all rights reserved".split())) == ("", 0.0)
    assert scan_notices("") == ("", 0.0)


def test_notice_columns(spark, documents):
    text = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software"
    got = {r["doc_id"]: r for r in scan_licenses(documents([text, "Licensed under CC BY-NC 4.0.", None, "all the rooms were reserved and their rights kept"])).collect()}
    assert [got[k]["labels"] for k in range(4)] == ["mit", "cc-by,cc-by-nc", "", ""] and got[0]["score"] == 1 and got[3]["score"] == 0
    assert PHRASES["cc by"] == "cc-by" and got[1]["base_labels"] == "cc-by"


def test_places_of_blocks():
    text = "One two three. Released today under the MIT License. Four five."
    words = "one two three released today under the mit license four five".split()
    row = scan_text(text, JOIN, {})
    label, first, end = row[7].split(":")
    assert label == "mit" == row[5] and {"released", "under", "the", "mit", "license"} <= set(words[int(first) : int(end)])
    assert scan_text("Released under the License.", JOIN, {})[5:] == ("", 0.0, "")  # four of five words, but not the one that names it
