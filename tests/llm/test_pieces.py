"""The agenda of pairs against the sentencepiece library, on odd characters, any ids and the given texts."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from dqspark.llm import pieces

ALPHABET = [" ", "  ", "▁", "a", "the", "in", "é", "日", "😀", "\n", "\t", "\x00", "<s>", "<0x41>", "<unk>", "ﬁ", "　", "é", "ab", "ing", "�", " " * 17, "1", "23"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(public_tokenizers.path(pieces.MODEL), most=50)


def test_any_text(codec):
    chance = random.Random(1)
    for _ in range(20_000):
        text = "".join(chance.choices(ALPHABET, k=chance.randrange(14)))
        ids = codec.encode(text)
        assert ids == codec.library.encode(text) == codec.merged("▁" + text.replace(" ", "▁")) * bool(text), text
        assert codec.decode(ids) == codec.library.decode(ids) == text.replace("▁", " "), text


def test_any_ids(codec):
    """Also ids that no text has: broken bytes, control ids, marks in a row."""
    chance = random.Random(2)
    few = [codec.byte_ids[b] for b in (0xE2, 0x96, 0x81, 0xC3, 0xA9, 0x41, 0xFF)] + [0, 1, 2, *(codec.known[x][1] for x in ("▁", "▁▁", "▁a", "a"))]
    for _ in range(20_000):
        ids = [chance.choice(few) if chance.random() < 0.8 else chance.randrange(32_000) for _ in range(chance.randrange(7))]
        assert codec.decode(ids) == codec.library.decode(ids), ids


def test_long_words(codec):
    chance = random.Random(3)
    for text in ("ab" * 20_000, "".join(chance.choices("abcdeé日", k=20_000)), " " * 5_000, "▁" * 999 + "x"):
        ids = codec.encode(text)
        assert ids == codec.library.encode(text) and codec.decode(ids) == codec.library.decode(ids)


def test_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    library = SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rows, own = pieces.digests(docs).collect(), {r["doc_id"]: r for r in pieces.encoded(docs).collect()}
    assert len(rows) == len(texts) == len(own)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) and r["agrees"]
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert own[r["doc_id"]]["ids"] == ids and own[r["doc_id"]]["decoded"] == library.decode(ids)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (3, "other"), (4, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("ids", "agrees", "n_tokens", "Decoded")])
    got = pieces.digests(docs).collect()
    assert len(got) == 7 and all(r["agrees"] for r in got) and [r["n_tokens"] for r in got][:2] == [0, 0]
    assert pieces.encoded(docs, check=False).where("agrees is null").count() == 7
    assert pieces.digests(docs.limit(0)).collect() == []
