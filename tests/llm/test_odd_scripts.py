"""Scripts without spaces, parts of pages by their names, long texts with many spans, numerals that are no letters."""

import random
import time

import numpy as np
import pytest

from dqspark.llm import chunks, html_text, language, near_duplicates, private, words


def chinese(seed: int, n: int) -> str:
    return "".join(random.Random(seed).choices([chr(c) for c in range(0x4E00, 0x5E00)], k=n))


@pytest.mark.parametrize("text, n", [("", 0), (" - ", 0), ("ab cd", 2), ("\u00e9t\u00e9 \u0436\u0438\u0437\u043d\u044c", 2), ("a\u4e2d\u6587b", 4), ("\u0e01\u0e02 x", 3), ("\u4e2d", 1)])
def test_word_starts(text, n):
    assert int(words.word_starts(np.frombuffer(text.encode().translate(words.FOLD), np.uint8)).sum()) == n
    assert len(words.word_hashes(text.encode())) == n


def test_hashes_of_spaced_words_are_those_of_each_alone():
    text = "Na\u00efve words, 12 of them \u0436\u0438\u0437\u043d\u044c\u2014and".encode()
    assert words.word_hashes(text).tolist() == [int(words.word_hashes(w)[0]) for w in words.split(text)]


def test_unspaced_copies_are_found(spark):
    base = chinese(1, 600)
    rows = [(1, base), (2, base[:300] + "\u4e00" + base[300:]), (3, base[:-10] + chinese(2, 10)), (4, chinese(3, 600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}
    runs = chunks.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in runs} == {1, 2, 3} and max(r["n_words"] for r in runs) > 200


@pytest.mark.parametrize("name", ["layout no-sidebar", "content with-sidebar", "post comments-open", "share-price", "nonav"])
def test_parts_whose_names_only_mention_others_are_kept(name):
    for page in (f'<div class="{name}"><article><p>one two</p></article></div>', f'<p>one</p><p class="{name}">two</p>'):
        assert html_text.main_text(page, {}).split() == ["one", "two"]


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "cookie-banner", "site_nav", "ad", "ad-slot-3", "related-posts", "big comments"])
def test_parts_named_as_no_text_are_left_out(name):
    assert html_text.main_text(f'<p>one two</p><div class="{name}">skip this</div><p>three</p>', {}) == "one two\n\nthree"


def test_lists_comments_and_open_elements():
    assert len(html_text.main_text("<div><ul>" + "<li>w</li>" * 20 + "</ul></div>", {}).split()) == 20
    assert html_text.main_text("<!-- <article> --><article><p>a b</p></article><p>out</p>", {}) == "a b"
    begun = time.time()
    assert len(html_text.main_text("<b>x" * 20_000, {})) == 20_000 and len(html_text.main_text("<div>x " * 20_000, {}).split()) == 20_000
    assert time.time() - begun < 5


def test_many_spans_in_one_text():
    text = " ".join(f"555-123-{n:04} a{n}@b.com jo{n} at ex dot com" for n in range(9999))
    begun = time.time()
    found = private.candidates(text)
    assert len(found) == 3 * 9999 and time.time() - begun < 20
    assert all(a[2] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_wider_spans_touch_no_other():
    pick = random.Random(4)
    parts = ["555-123-4567", "4111 1111 1111 1111", "x@y.com", "1.2.3.4", "+1 555 123 4567", "1:2:3:4:5:6:7:8", "0049 30 1234 5678"]
    for _ in range(50):
        text = pick.choice(" ,").join(pick.choices(parts, k=20))
        base = private.base_spans(text)
        wide = private._wider(text, base)
        for n, (a, _, b) in enumerate(wide):
            assert all(b <= c or d <= a for c, _, d in base + wide[:n])


def test_numerals_are_no_letters(spark):
    rows = [(n, "the cat and the dog" if n % 2 else "der hund und die katze", "en" if n % 2 else "de") for n in range(40)] + [(90, "\u00bd \u00b2 \u2167", None), (91, "\u00bd a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.languages(docs).collect()}
    assert found[90] == language.UNKNOWN != found[91]
