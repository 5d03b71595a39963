"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one automaton whose states are the word sequences that occur in them. Training
texts are streamed through it word by word; the automaton keeps the longest suffix read that occurs in an item.
Wherever that length reaches the window, the words it covers are hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import add_columns, fresh, replace_columns
from .words import FOLD, split

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """The word sequences of a block of items. State 0 is the empty sequence."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.of_window: dict[int, set] = {}
        self.of_short: dict[int, list[tuple[int, str | None]]] = {}
        sequences = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for name, words in items if words]
        self.shortest = min((min(len(s), window) for _, s in sequences), default=window)
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for name, sequence in sequences:
            state = 0
            for n, word in enumerate(sequence, 1):
                state = self.step[state][word]
                if n >= window:
                    self.of_window.setdefault(self._at(state, window), set()).add(name)
            if len(sequence) < window:
                self.of_short.setdefault(self._at(state, len(sequence)), []).append((len(sequence), name))

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, before: int, word: int, after: int) -> int:
        """The state of the sequence of before, and word; a new one where after stands for longer ones too."""
        wanted = self.length[before] + 1
        if self.length[after] == wanted:
            return after
        copy = self._new(wanted, dict(self.step[after]), self.link[after])
        self.link[after] = copy
        while before >= 0 and self.step[before].get(word) == after:
            self.step[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        added = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = added
            last = self.link[last]
        if last >= 0:
            self.link[added] = self._split(last, word, self.step[last][word])
        return added

    def _at(self, state: int, length: int) -> int:
        """The state that stands for the last so many words of a state."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges inside occurring windows, in order and apart, and the items that they come from."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if len(words) < self.shortest or not self.vocabulary:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, words, iter(lambda: 0, 1)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(ids > 0, prepend=False, append=False))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start >= self.shortest:
                self._stream(ids[start:stop].tolist(), start, spans, found)
        return spans, found

    def _stream(self, ids: list[int], first: int, spans: list[tuple[int, int]], found: set) -> None:
        step, link, length, window = self.step, self.link, self.length, self.window
        state = matched = 0
        for at, word in enumerate(ids, first + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(word, 0)
            matched = matched + 1 if state else 0
            covered = 0
            if matched >= window:
                covered = matched
                found |= self.of_window[self._at(state, window)]
            if self.of_short and matched:
                for size, name in self._shorts(state):
                    if size <= matched:
                        covered = max(covered, size)
                        found.add(name)
            if covered:
                start = at - covered
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))

    def _shorts(self, state: int) -> Iterator[tuple[int, str | None]]:
        while state > 0:
            yield from self.of_short.get(state, ())
            state = self.link[state]


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of so many item words each, so that neither the driver nor a broadcast grows with the item table."""
    block, size = [], 0
    for name, text in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = split(text.encode() if text else None)
        if block and size + len(words) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    yield Automaton(block, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def match_items(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 50_000, cut: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs with its word count, hit word ranges and occurring items, and the names of these three columns; with cut also
    the text without the hit ranges, null where there are none.

    A null or wordless text has no words and no hits. A null item text is no item; a null item_id still marks words but
    is not listed. Repeated rows count once each in docs; repeated items add nothing. Extra columns pass through; where
    one has the name of a new column, the new one gets underscores in front. Items beyond block_words words go into
    further automata, which the texts pass one after the other.
    """
    names = {name: fresh(docs, name) for name in ("n_words", "spans", "items", *["cut_text"] * cut)}
    kinds = [(names["n_words"], T.LongType()), (names["spans"], SPANS), (names["items"], T.ArrayType(T.StringType()))]
    kinds += [(names["cut_text"], T.StringType())] if cut else []
    for n, automaton in enumerate(_blocks(items, window, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def compute(texts, *before, shared=shared):
            match, counts, spans, found = shared.value.match, [], [], []
            whole = texts.cast(pa.binary()).to_pylist()
            for text in whole:
                words = split(text)
                ranges, of = match(words)
                counts.append(len(words))
                spans.append(ranges)
                found.append([x for x in of if x is not None])
            if before:
                spans = [_merged(a + [(x["start"], x["stop"]) for x in b]) if b else a for a, b in zip(spans, before[1].to_pylist(), strict=True)]
                found = [sorted({*a, *b}) for a, b in zip(found, before[2].to_pylist(), strict=True)]
            rows = [[{"start": a, "stop": b} for a, b in x] for x in spans]
            made = [pa.array(counts, pa.int64()), pa.array(rows, _ARROW_SPANS), pa.array(found, pa.list_(pa.string()))]
            return made + ([pa.array([_without(t, x) if x else None for t, x in zip(whole, rows, strict=True)], pa.string())] if cut else [])

        own = list(names.values()) if n else []
        docs = add_columns(docs, ["text", *own[:3]], kinds, compute, drop=tuple(own))
    return docs, names


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of docs: hit words and occurring items. See match_items for odd rows."""
    matched, name = match_items(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate(name["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    found = F.array_sort(F.array_distinct(name["items"]))
    return matched.select(
        "doc_id",
        F.col(name["n_words"]).alias("n_words"),
        hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col(name["spans"]).alias("spans"),
    )


def _without(text: bytes, spans: list[dict]) -> str:
    """A text without the words of these ranges; a space stands for each range."""
    places = [m.span() for m in _WORD.finditer(text.translate(FOLD))]
    out, last = [], 0
    for span in spans:
        out.append(text[last : places[span["start"]][0]].rstrip(b" "))
        last = places[span["stop"] - 1][1]
    return b" ".join([*out, text[last:].lstrip(b" ")]).decode().strip()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs, with hit ranges (window words or more, or whole short items) cut out of the texts and n_chars renewed.

    A document of whose words more than max_coverage are hit goes whole. Documents without hits stay as they are; see
    match_items for odd rows.
    """
    matched, name = match_items(docs, items, window, cut=True)
    hit = F.aggregate(name["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    kept = matched.where(hit <= F.col(name["n_words"]) * max_coverage)
    cut = name["cut_text"]
    text = F.coalesce(F.col(cut), F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(cut))
    return replace_columns(kept, docs, changed)
