"""Rows that repeat a doc_id with other texts lose none of them; written-out addresses alone in a text."""

import random

import pytest

from dqspark.llm import chunks, near_duplicates, private

DOCS = "doc_id long, text string"
A, B, C = ("one two three four five six seven eight", "a wholly other text of that very id here", "and a third one that nobody else has")


def kept(spark, rows):
    return sorted((r["doc_id"], r["text"]) for r in near_duplicates.keep_one(spark.createDataFrame(rows, DOCS)).collect())


def test_keep_one_tells_texts_of_an_id_apart(spark):
    assert kept(spark, [(1, A), (5, A), (5, B), (7, C)]) == [(1, A), (5, B), (7, C)]
    got = near_duplicates.keep_one(spark.createDataFrame([(5, A), (5, A), (5, B), (9, B), (9, C), (9, None), (9, "")], DOCS)).collect()
    assert sorted((r["doc_id"], repr(r["text"])) for r in got) == sorted((k, repr(t)) for k, t in [(5, A), (5, B), (9, C), (9, None), (9, "")])


def test_near_texts_of_one_id_keep_one(spark):
    chance = random.Random(3)
    words = ["".join(chance.choices("abcdefgh", k=7)) for _ in range(200)]
    near = [*words[:100], "other", *words[101:]]
    assert len(kept(spark, [(5, " ".join(words)), (5, " ".join(near)), (6, " ".join(words))])) == 1


def text_of(seed, n):
    chance = random.Random(seed)
    return " ".join("".join(chance.choices("abcdefghij", k=chance.randrange(3, 9))) for _ in range(n))


def test_passages_of_repeated_ids(spark):
    passage = text_of(0, 70)
    texts = [f"{text_of(1, 40)} {passage} {text_of(2, 40)}", f"{passage} {text_of(3, 90)}", text_of(4, 300)]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[1])], DOCS)
    runs = chunks.repeated_passages(docs).where("doc_id = 2").collect()
    assert len(runs) == 1 and runs[0]["start"] < 80 and texts[1][runs[0]["start"] : runs[0]["stop"]] in passage
    left = sorted((r["text"] for r in chunks.without_repeats(docs).where("doc_id = 2").collect()), key=len)
    assert left[2] == texts[2] and left[0] == left[1] and len(left[0]) < len(texts[1]) - 150 and texts[1].endswith(left[0][-300:])


def test_rows_that_repeat_an_id_with_no_shared_chunk_stay_whole(spark):
    first = text_of(5, 100)
    left = chunks.without_repeats(spark.createDataFrame([(1, first), (2, first), (2, text_of(6, 300))], DOCS)).collect()
    assert sorted(r["text"] for r in left) == sorted([first, "", text_of(6, 300)])


SPELT = ["write to jo at example dot com", "reach john.doe [at] example [dot] org", "we met at noon dot end"]


@pytest.mark.parametrize("text", SPELT)
def test_written_out_address_alone(spark, text):
    docs = spark.createDataFrame([(1, text)], DOCS)
    assert [r["n_email"] for r in private.personal_data(docs).collect()] == [0]
    assert len(private.mask(docs).collect()) == 1


def test_candidates_of_random_pieces():
    chance = random.Random(8)
    pieces = ["jo", " at ", "[at]", "(dot)", " dot ", "example", "@", ".", "com", " ", "+49 170", "555-123-4567", "1.2.3.4", "4111 1111 1111 1111", "a:b:c:d:1:2:3:4", "é", "\n"]
    for _ in range(4000):
        text = "".join(chance.choices(pieces, k=chance.randrange(12)))
        found = private.candidates(text)
        assert found == sorted(found) and all(0 <= a < b <= len(text) for a, _, b, _, _ in found)
        wide = [s for s in found if not s[3]]
        assert all(x[2] <= y[0] or y[2] <= x[0] for x in wide for y in found if x is not y)
