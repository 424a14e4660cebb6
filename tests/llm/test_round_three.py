"""Wrapped licences, mentions, and all stretches of benchmark items."""

from __future__ import annotations

import textwrap

import pytest

from quarryline.llm import decontaminate as D
from quarryline.llm import licenses as L
from quarryline.llm.license_texts import PARAGRAPHS

ITEM = "doc_id long, text string"


def wrapped(text, lead="", width=72):
    return "\n".join(lead + x for x in textwrap.wrap(text, width))


@pytest.fixture(scope="module")
def licences(spark):
    texts = {}
    for i, family in enumerate(("mit", "bsd", "apache-2.0", "gpl")):
        body = PARAGRAPHS[family][-1 if family == "bsd" else 0]
        for j, lead in enumerate(("", "// ", " * ", "# ")):
            texts[10 * i + j] = (family, f"Some words before it.\n\n{wrapped(body, lead)}\n\nAnd a tail\nof two lines.")
    texts[90] = (None, "He spoke about the MIT License in class and it was fun.")
    texts[91] = (None, "The MIT License was the topic,\nand GPL jokes\nwere made all day.")
    texts[92] = ("mit", "MIT License")
    texts[93] = ("mit", "Intro\nReleased under the MIT License.\nMore text here.")
    texts[94] = (None, None)
    texts[95] = (None, "\n\n\n")
    df = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()] + [(0, texts[0][1])], ITEM)
    return texts, L.licence_paragraphs(df).collect()


def test_wrapped_licences_are_found(licences):
    texts, got = licences
    assert {(r["doc_id"], r["family"]) for r in got} == {(k, f) for k, (f, _) in texts.items() if f}
    assert all(r["paragraph"] == 2 and r["lines"] > 1 for r in got if r["doc_id"] < 40)
    assert sum(r["doc_id"] == 0 for r in got) == 2  # a repeated row is reported again


def test_a_line_by_itself_goes_before_its_rows(licences):
    _, got = licences
    assert [(r["paragraph"], r["lines"]) for r in got if r["doc_id"] == 93] == [(1, 1)]


def test_paragraphs_are_lines_and_rows_of_lines(spark):
    text = "one\n// two\n// three\n \nfour\n\n\nfive\nsix"
    rows = L.paragraphs(spark.createDataFrame([(1, text)], ITEM)).collect()
    assert sorted((r["paragraph"], r["lines"], " ".join(r["w"])) for r in rows if r["lines"] > 1) == [(0, 3, "one two three"), (7, 2, "five six")]
    assert sum(r["lines"] == 1 for r in rows) == len(text.split("\n"))


def found(item, text):
    return sorted((s, e, k) for _, _, s, e, k in D.Index([item]).matches([text]))


def test_all_places_of_short_items():
    assert found("abc xyz", "abc xyz, then ABC  xyz; abc xyz") == [(0, 7, 0), (14, 22, 0), (24, 31, 0)]
    assert found("aaa", "aaaaaaa") == [(0, 3, 0), (3, 6, 0)]


def test_disjoint_copies_in_a_run_of_bands():
    hits = found("haha" * 20, "haha" * 200)
    assert [h[:2] for h in hits] == [(80 * k, 80 * k + 80) for k in range(10)]
    hits = found("abcdefghijklmnopqrst" * 3, ("abcdefghijklmnopqrst" * 3 + " and ") * 4)
    assert [h[0] for h in hits] == [0, 65, 130, 195] and all(h[2] == 0 for h in hits)


def test_the_best_of_overlapping_stretches():
    item = "The quick brown fox jumps over the lazy dog while seven wizards make toxic brew."
    text = "xx " + item[:20] + "Q" + item[21:] + " yy " + item + " zz"
    hits = found(item, text)
    assert [(h[0], h[2]) for h in hits] == [(3, 1), (3 + len(item) + 4, 0)]
