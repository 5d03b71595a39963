"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are zero. Where that is depends on the last
32 bytes alone, so chunks after an insertion are the same as before. Chunks are deduplicated by a 128-bit digest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import sliced
from .words import FOLD, word_starts

_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)
_CHUNKS = "high long, low long, doc_id long, text_key int, chunk int, start long, stop long, words int"


def text_key(text: bytes) -> int:
    """32 bits that tell the texts under one doc_id apart: Spark's crc32 of the text, as a signed number."""
    return (zlib.crc32(text) ^ 1 << 31) - (1 << 31)


def ends(text: bytes, least: int, most: int, bits: int) -> list[int]:
    """Where the chunks of a text end. A chunk has least to most bytes, the last one maybe fewer, and whole characters."""
    raw = np.frombuffer(text, np.uint8)
    roll = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        if len(roll) > step:
            roll[step:] = roll[step:] + (roll[:-step] << np.uint32(step))
    whole = np.append(raw[1:] & 0xC0 != 0x80, True)
    out, last = [], 0
    for end in (np.flatnonzero((roll >> np.uint32(32 - bits) == 0) & whole) + 1).tolist() + [len(text)]:
        while end - last > most:
            last += most
            while text[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end - last >= least or end == len(text) > last:
            out.append(end)
            last = end
    return out


def chunk_rows(docs: DataFrame, least: int = 20, most: int = 256, bits: int = 4) -> DataFrame:
    """One row per chunk: digest (high, low), doc_id, key of the text, number, start and stop in code points, words that
    begin in it."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, names = xxhash.xxh3_128_digest, ["high", "low", "doc_id", "text_key", "chunk", "start", "stop", "words"]
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        digests: list[bytes] = []

        def made() -> pa.RecordBatch:
            own = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            arrays = [np.ascontiguousarray(own[:, 0]), np.ascontiguousarray(own[:, 1]), *(np.concatenate(c) for c in columns)]
            for x in (digests, *columns):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

        for batch in sliced(stream):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                stops = ends(text, least, most, bits)
                digests += [digest(text[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]
                at = np.array(stops)
                points = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)[at - 1]
                words = np.cumsum(word_starts(np.frombuffer(text.translate(FOLD), np.uint8)))[at - 1]
                of = (np.full(len(at), doc), np.full(len(at), text_key(text), np.int32), np.arange(len(at), dtype=np.int32), np.append(0, points[:-1]), points, np.diff(words, prepend=0).astype(np.int32))
                for column, values in zip(columns, of, strict=True):
                    column.append(values)
                if len(digests) >= 50_000:
                    yield made()
        if digests:
            yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(batches, _CHUNKS)


def _runs(docs: DataFrame, min_words: int, least: int, most: int, bits: int) -> DataFrame:
    """Runs of chunks that occur in several documents, by doc_id and key of the text."""
    chunks = chunk_rows(docs, least, most, bits)
    seen = chunks.groupBy("high", "low").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    shared = seen.where(F.col("first_doc_id") < F.col("last_doc_id")).select("high", "low", "first_doc_id")
    of_text = ["doc_id", "text_key"]
    repeats = chunks.join(shared, ["high", "low"]).drop("high", "low").dropDuplicates([*of_text, "chunk"])
    run = F.col("chunk") - F.row_number().over(Window.partitionBy(*of_text).orderBy("chunk"))
    runs = repeats.withColumn("run", run).groupBy(*of_text, "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.sum("words").cast("long").alias("n_words"),
        F.count("*").alias("n_chunks"),
        F.min("first_doc_id").alias("first_doc_id"),
    )
    runs = runs.where(F.col("n_words") >= min_words).drop("run")
    return runs.withColumn("is_first", F.col("first_doc_id") == F.col("doc_id"))


def repeated_passages(docs: DataFrame, min_words: int = 15, least: int = 20, most: int = 256, bits: int = 4) -> DataFrame:
    """Runs of chunks that occur in several documents, of min_words words or more.

    Each character of an unspaced script counts as a word. One row per run: doc_id, start, stop (code points), n_words, n_chunks, first_doc_id (the smallest id that holds a
    chunk of the run), is_first. The document first_doc_id has a row of its own. Rows without a text or a doc_id have no
    chunks. What repeats only under one doc_id is not reported. Different texts under one doc_id have runs of their own;
    equal ones are one text.
    Both ends of a passage lie in chunks that differ: of 50 words 15 or more are found in 99 of 100 random cases.
    """
    return _runs(docs, min_words, least, most, bits).drop("text_key")


def without_repeats(docs: DataFrame, min_words: int = 15) -> DataFrame:
    """(doc_id, text) of all rows with a doc_id, without the runs that a document with a smaller id holds first. Rows that
    repeat a doc_id are each cut by the runs of their own text."""
    runs = _runs(docs, min_words, 20, 256, 4).where(~F.col("is_first"))
    cuts = runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    cut = F.aggregate(
        "cuts",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda x, c: F.struct(F.concat(x["text"], F.substring(F.col("text"), (x["at"] + 1).cast("int"), (c["start"] - x["at"]).cast("int"))).alias("text"), c["stop"].alias("at")),
        lambda x: F.concat(x["text"], F.substring(F.col("text"), (x["at"] + 1).cast("int"), F.length("text"))),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = rows.withColumn("text_key", (F.crc32(F.col("text").cast("binary")).bitwiseXOR(F.lit(1 << 31)) - (1 << 31)).cast("int"))
    return rows.join(cuts, ["doc_id", "text_key"], "left").select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(cut).alias("text"))
