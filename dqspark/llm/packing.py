"""Best-fit packing of tokenised documents by large-item matching.

Only a histogram of the lengths, which has one entry per possible length, is planned with. Pieces above a third of the
capacity share a sequence with at most one other such piece: the longest goes with the longest that fits. Smaller ones,
longest first, go where the least room is left. The plan says which ranks of a length go to which sequences; each
piece's rank comes from counts per length and salt, so no task orders all pieces of a length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import sliced, written
from .words import mix

TOKENIZER = "word_bpe_49k.json"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A Latin-1 word of letters, then signs: the tokenizer always separates the two, and lower-cases letter by letter.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class Encoder:
    """Token ids of texts, remembered by piece between white space.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its pieces in order. Pieces
    are found and looked up by a 64-bit hash in numpy; those not remembered go to the tokenizer. A slot holds one piece
    and a newer one takes its place, so memory is bounded.
    """

    def __init__(self, path: str, slots: int = 1 << 21, most_ids: int = 1 << 22, most_parts: int = 350_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most_parts = Tokenizer.from_file(path), most_parts
        self.parts: dict[str, bytes] = {"": b""}
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {ord(c): bytes_of(c)[0][0] for c in map(chr, range(256)) if _PLAIN.fullmatch(c) and c.isalpha()}
        self.keys, self.places = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.pool, self.used = np.zeros(most_ids, np.uint32), 1  # number of ids of a piece, then these; next free place
        self.shift = np.uint64(64 - (slots - 1).bit_length())
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learnt(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these pieces."""
        if len(self.parts) > self.most_parts:
            self.parts = {"": b""}
        parts, tokenize, letters, out = self.parts, self.tokenizer.model.tokenize, self.letters, []
        for piece in pieces:
            if not (found := _PLAIN.fullmatch(piece)):
                out.append(self._ids(piece))
                continue
            word, signs = found[1].lower(), found[2]
            if (ids := parts.get(word)) is None:
                known = [t.id for t in tokenize(word.translate(letters))]
                ids = parts[word] = pack_ids(f"<{len(known)}I", *known)
            if signs not in parts:
                parts[signs] = self._ids(signs)
            out.append(ids + parts[signs])
        return out

    def _remember(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Places in the pool of new pieces."""
        learnt = self._learnt(pieces)
        sizes = np.fromiter(map(len, learnt), np.int64, len(learnt)) // 4
        heads = np.cumsum(sizes + 1) - sizes - 1
        flat = np.frombuffer(b"".join([x for ids in learnt for x in (pack_ids("<I", len(ids) // 4), ids)]), "<u4")
        if self.used + len(flat) > len(self.pool):
            self.keys[:], self.used = 0, 1
        if self.used + len(flat) > len(self.pool):
            self.pool = np.zeros(self.used + len(flat), np.uint32)
        self.pool[self.used : self.used + len(flat)] = flat
        places = (heads + self.used).astype(np.int32)
        self.used += len(flat)
        slots = hashes >> self.shift
        self.keys[slots], self.places[slots] = hashes, places
        return places

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts. Those of 1 MB are worked on together; the longest piece bounds what a call needs."""
        joined = b" ".join(texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        space = _SPACE[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.append(0, edges)
        starts, stops = edges[::2], edges[1::2]
        if len(self.powers) <= len(raw):
            n = 2 * len(raw) + 2
            self.powers, self.inverses = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_POWER, np.uint64(pow(int(_POWER), -1, 1 << 64))))
        sums = np.append(np.uint64(0), np.cumsum(_BYTE[raw] * self.powers[: len(raw)]))
        hashes = mix((sums[stops] - sums[starts]) * self.inverses[starts] + (stops - starts).astype(np.uint64)) | np.uint64(1)
        slots = hashes >> self.shift
        places = self.places[slots]
        missing = np.flatnonzero(self.keys[slots] != hashes)
        if len(missing):
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            where = missing[first]
            pieces = [joined[a:b].decode() for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)]
            if self.used + 4 * len(joined) > len(self.pool):  # the pool may start anew: learn every piece of these texts
                new, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                pieces = [joined[a:b].decode() for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
                missing = np.arange(len(hashes))
            places[missing] = self._remember(new, pieces)[which]
        sizes = self.pool[places].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(places.astype(np.int64) + 1 - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        last = np.append(0, ends)[np.searchsorted(starts, bounds)]
        return np.split(ids, last[:-1])


_encoders: dict[str, Encoder] = {}
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_POWER = np.uint64(0xD1342543DE82EF95)
_BYTE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _groups(texts: list[bytes], most: int = 500_000) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def tokenised_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: its ids, then end_id, cut into pieces of capacity where longer.

    A null text counts as empty and has the end id alone; repeated rows are documents of their own; a null doc_id stays
    null. tokenizer is a file of the installed tokenizer package on every machine.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(tokenizer)
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        end, step = np.array([end_id], "<u4").tobytes(), capacity * 4
        for batch in sliced(stream):
            rows = []
            ids = iter(batch.column(0).to_pylist())
            for group in _groups([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                for found in encoder.encode(group):
                    doc, raw = next(ids), found.astype("<u4").tobytes() + end
                    for n, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, _PIECES)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): so many pieces of a length, from that rank on, go to
    as many sequences in a row, each at that offset. The number of rows depends on the capacity, not on the pieces."""
    rest, rank, sequences, rows = dict(counts), dict.fromkeys(counts, 0), 0, []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # of each size: ranges of sequences

    def place(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], n, first, offset))
        rank[length] += n
        rest[length] -= n

    def leave(size: int, first: int, n: int) -> None:
        if size and n:
            room[size].append((first, n))

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    for x in large:
        for y in [y for y in large if y < x or y == x]:
            if not rest[x]:
                break
            if x + y <= capacity and rest[y] >= 1 + (x == y):
                n = rest[x] // 2 if x == y else min(rest[x], rest[y])
                place(x, n, sequences, 0)
                place(y, n, sequences, x)
                leave(capacity - x - y, sequences, n)
                sequences += n
        if n := rest[x]:
            place(x, n, sequences, 0)
            leave(capacity - x, sequences, n)
            sequences += n
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        size = x
        while rest[x]:
            while size < capacity and not room[size]:
                size += 1
            if size < capacity:
                first, n = room[size].pop()
            else:
                first, n = sequences, -(-rest[x] // (capacity // x))
                sequences += n
            fit = size // x
            whole = min(n, rest[x] // fit)
            if whole:
                for k in range(fit):
                    place(x, whole, first, capacity - size + k * x)
                leave(size - fit * x, first, whole)
            if whole < n:
                some = rest[x]
                for k in range(some):
                    place(x, 1, first + whole, capacity - size + k * x)
                leave(size - some * x, first + whole, 1)
                leave(size, first + whole + 1, n - whole - 1)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, per_salt: int = 50_000) -> DataFrame:
    """pieces (doc_id, piece, length and more) with sequence_id and offset. An empty table gives an empty one.

    pieces must give the same rows each time, as a written table does. What reaches the driver is one count per length.
    """
    counts = {int(x): int(n) for x, n in pieces.groupBy("length").count().collect()}
    rows = plan(counts, capacity)
    keys = rows[:, 0] << 44 | rows[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((keys, rows))
    salts = max(64, -(-sum(counts.values()) // per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    of_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    of_salt = of_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("rank", within).join(of_salt, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))
    kept = pieces.columns
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in stream:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            at = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(rank) else np.empty((0, 5), np.int64)
            made = [pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=schema.fieldNames())

    return ranked.mapInArrow(batches, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents, packed. See tokenised_pieces for odd rows."""
    return pack(written(tokenised_pieces(docs, tokenizer, capacity), "pieces"), capacity)
