"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes a row of symbols, its characters. An agenda holds the adjacent pairs whose joined text is in the
vocabulary; the pair with the best score, leftmost first, is joined again and again until none is left. What is not in
the vocabulary falls back to its UTF-8 bytes. Each Arrow batch is compared with the sentencepiece library.

Words have agendas of their own. Those that a batch brings anew are worked on together in numpy: each round joins the
best pair of every word that still has one.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .work import add_columns
from .words import mix

MODEL = "piece_bpe_32k.model"
#: What stands for a space.
SPACE = "▁"
_MARK = SPACE.encode()
_ID = np.dtype("<u4")


class Codec:
    """Ids of texts and back, by the vocabulary and the settings of a model file.

    Where no piece has a space mark after another character, no pair across such a place is ever joined. Then a text is
    cut there and the parts, mostly words, are joined each for itself; the ids of those of up to `longest` bytes are remembered,
    about `most` of them.
    """

    def __init__(self, path: str, most: int = 600_000, longest: int = 64):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        own = self.library
        n = own.vocab_size()
        pieces = [own.id_to_piece(i) for i in range(n)]
        merged = [i for i in range(n) if not (own.is_unknown(i) or own.is_control(i) or own.is_byte(i) or own.is_unused(i))]
        #: Joined text to (-score, id): the smallest comes first in the agenda.
        self.known = {pieces[i]: (-own.get_score(i), i) for i in merged}
        self.bytes = {pieces[i]: i for i in range(n) if own.is_byte(i)}
        self.byte_ids = [self.bytes.get(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = own.unk_id()
        self.texts = {i: pieces[i] for i in merged}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i is not None}
        self._check_settings()
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in self.known)
        self.longest, self.memory = longest, Memory(most)
        # What an id alone stands for: bytes above 0x7F need their neighbours, all others do not.
        self.high = {i for i, b in self.byte_of.items() if b > 0x7F}
        self.surface = [self.texts.get(i) or (chr(self.byte_of[i]) if i in self.byte_of else "") for i in range(n)]
        self.surface[self.unknown] = own.decode([self.unknown])
        self.names = [str(i) for i in range(n)]
        self.joins = Joins(self.known)

    def _check_settings(self) -> None:
        """This code takes models of one kind: merges with scores, bytes for unknown characters, texts left as they are
        but for a space in front. Others are refused here rather than encoded wrongly."""
        own = self.library
        plain = all(own.normalize(x) == SPACE + x.replace(" ", SPACE) for x in ("a", "  a  b ", "Ａ ﬁ\t", "é", "　\n"))
        unused = any(own.is_unused(i) for i in range(own.vocab_size()))
        if not plain or unused or None in self.byte_ids:
            raise ValueError("the model changes texts, lacks byte pieces or has unused pieces")

    def merged(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already: joins by the agenda."""
        known, n = self.known, len(text)
        symbols = list(text)  # a joined pair stands at its left place; its right place is emptied
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for at in range(n - 1):
            if (found := known.get(text[at : at + 2])) is not None:
                agenda.append((found[0], at, 2))
        heapify(agenda)
        while agenda:
            _, at, length = heappop(agenda)
            right = after[at]
            # Stale: one side was joined with something else since.
            if right >= n or not symbols[at] or len(symbols[at]) + len(symbols[right]) != length:
                continue
            joined = symbols[at] = symbols[at] + symbols[right]
            symbols[right] = ""
            following = after[at] = after[right]
            if following < n:
                before[following] = at
                if (found := known.get(joined + symbols[following])) is not None:
                    heappush(agenda, (found[0], at, length + len(symbols[following])))
            if (left := before[at]) >= 0 and (found := known.get(symbols[left] + joined)) is not None:
                heappush(agenda, (found[0], left, len(symbols[left]) + length))
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                if (found := known.get(symbol)) is not None:
                    ids.append(found[1])
                else:
                    ids += [self.byte_ids[b] for b in symbol.encode()]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without begin or end; none for a null or empty one."""
        return self.encode_batch([text])[0].tolist()

    def encode_batch(self, texts: list[str | None], chars: int = 500_000) -> list[np.ndarray]:
        """The ids of each text. Texts of about so many characters are worked on together."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and size < chars:
                size += len(texts[end] or "")
                end += 1
            out += self._together(texts[at:end])
            at = end
        return out

    def _together(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.parted:
            return [np.array(self.merged(SPACE + t.replace(" ", SPACE) if t else ""), _ID) for t in texts]
        # A mark in a text is the same as a space; each part begins with its spaces, so spaces stand for marks here.
        spaced = [b" " + t.encode().replace(_MARK, b" ") if t else b"" for t in texts]
        joined, memory = b"".join(spaced), self.memory
        if not joined:
            return [np.empty(0, _ID)] * len(texts)
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
        heads = np.cumsum(sizes) - sizes
        space = raw == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[heads[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(raw)))
        hashes = part_hashes(raw, starts, lengths)
        places = np.where(lengths <= self.longest, memory.places_of(hashes), 0)
        missing = np.flatnonzero(places == 0)
        if len(missing):
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            where = missing[first]
            # Long parts are told apart by more than their hash: each is joined for itself and not remembered.
            short = lengths[where] <= self.longest
            long = missing[lengths[missing] > self.longest]
            listed = [joined[a : a + n].decode().replace(" ", SPACE) for a, n in zip(starts[where[short]].tolist(), lengths[where[short]].tolist(), strict=True)]
            ids, counts = self.joins.ids(listed, self.byte_ids)
            apart = [np.array(self.merged(joined[a : a + n].decode().replace(" ", SPACE)), _ID) for a, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
            if not memory.has_room(len(ids) + len(counts) + sum(len(x) + 1 for x in apart)):
                memory.clear()
                return self._together(texts)
            own = np.zeros(len(new), np.int64)
            own[short] = memory.add(ids, counts)
            memory.know(new[short], own[short])
            of_short = lengths[missing] <= self.longest
            places[missing[of_short]] = own[which[of_short]]
            if apart:
                places[long] = memory.add(np.concatenate(apart), np.array([len(x) for x in apart]))
        flat, counts = memory.ids(places)
        ends = np.append(0, np.cumsum(counts))
        bounds = ends[np.searchsorted(starts, np.append(heads, len(raw)))]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one space mark in front goes, bytes become characters, broken ones U+FFFD each. Control ids
        have no text."""
        if self.high.isdisjoint(ids):
            return "".join(map(self.surface.__getitem__, ids)).removeprefix(SPACE).replace(SPACE, " ")
        out: list[str] = []
        raw = bytearray()
        front = True  # whether nothing but nothing has come out so far
        for i in ids:
            if (byte := self.byte_of.get(i)) is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw.clear()
                front = False
            piece = self.surface[i]
            if front and piece.startswith(SPACE) and i != self.unknown:
                piece, front = piece[1:], False
            if piece:
                out.append(piece.replace(SPACE, " "))
                front = False
        if raw:
            out.append(_characters(bytes(raw)))
        return "".join(out)


class Joins:
    """Which pairs of symbols join, as arrays: symbols are piece ids, or numbers above them for other characters."""

    def __init__(self, known: dict[str, tuple[float, int]]):
        self.ids_of = {p: i for p, (_, i) in known.items()}
        self.other = 1 << 22  # a character without a piece is this plus its code point
        place = {score: n for n, score in enumerate(sorted({s for s, _ in known.values()}))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, (score, i) in known.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (place[score], i)
        keys = sorted(pairs)
        self.keys = np.array([*keys, 1 << 62], np.int64)
        self.places = np.array([*(pairs[k][0] for k in keys), 0], np.int32)
        self.joined = np.array([*(pairs[k][1] for k in keys), 0], np.int32)
        self.never = np.int32(len(place))

    def symbol(self, text: str) -> int | None:
        own = self.ids_of.get(text)
        return own if own is not None else self.other + ord(text) if len(text) == 1 else None

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the agenda (the smaller, the better; never where the pair does not join) and joined symbol."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.places[at], self.never), self.joined[at]

    def ids(self, parts: list[str], byte_ids: list[int], most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each has. So many parts, few enough for a processor's cache, are
        joined at the same time."""
        pairs = [self._ids(parts[at : at + most], byte_ids) for at in range(0, len(parts), most)]
        if not pairs:
            return np.empty(0, _ID), np.empty(0, np.int64)
        ids, counts = zip(*pairs, strict=True)
        return np.concatenate(ids), np.concatenate(counts)

    def _ids(self, parts: list[str], byte_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts])
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        different, which = np.unique(points, return_inverse=True)
        symbols = np.array([self.symbol(chr(c)) for c in different.tolist()], np.int32)[which]
        word = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        done_words, done_symbols = [], []
        last = np.append(word[1:] != word[:-1], True)
        place, joined = self._found(symbols, np.append(symbols[1:], np.int32(0)))
        place[last] = self.never
        while len(word):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(place, first)
            lengths = np.diff(np.append(first, len(word)))
            ended = np.repeat(best == self.never, lengths)
            if ended.any():
                done_words.append(word[ended])
                done_symbols.append(symbols[ended])
                word, symbols, place, joined = word[~ended], symbols[~ended], place[~ended], joined[~ended]
                lengths, best = lengths[best < self.never], best[best < self.never]
                if not len(word):
                    break
            hits = np.flatnonzero(place == np.repeat(best, lengths))
            hits = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]  # the leftmost of each word
            symbols[hits] = joined[hits]
            kept = np.ones(len(word), bool)
            kept[hits + 1] = False
            hits -= np.arange(len(hits))  # one symbol before each hit but the first has gone
            word, symbols, place, joined = word[kept], symbols[kept], place[kept], joined[kept]
            changed = np.concatenate([hits, hits[(hits > 0) & (word[hits - 1] == word[hits])] - 1])
            following = np.minimum(changed + 1, len(word) - 1)
            new_place, joined[changed] = self._found(symbols[changed], symbols[following])
            place[changed] = np.where((following > changed) & (word[following] == word[changed]), new_place, self.never)
        words, found = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        words, found = words[order], found[order]
        other = np.flatnonzero(found >= self.other)
        if len(other):  # characters without a piece become their bytes
            spelled = [[byte_ids[b] for b in chr(c - self.other).encode()] for c in found[other].tolist()]
            times = np.ones(len(found), np.int64)
            times[other] = [len(x) for x in spelled]
            words, at = np.repeat(words, times), np.cumsum(times) - times
            found = np.repeat(found, times)
            places = np.repeat(at[other], times[other]) + np.concatenate([np.arange(len(x)) for x in spelled])
            found[places] = list(chain.from_iterable(spelled))
        return found.astype(_ID), np.bincount(words, minlength=len(parts))


class Memory:
    """Ids of parts by a 64-bit hash. A slot holds one part and a newer one takes its place; the pool of ids is emptied
    when it is full. So memory is bounded."""

    def __init__(self, most: int):
        self.slots = 1 << max(4, (2 * most - 1).bit_length())
        self.shift = np.uint64(65 - self.slots.bit_length())
        self.keys, self.at = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.pool, self.used = np.zeros(8 * most + 1, _ID), 1  # the number of ids of a part, then these; place 0 is none

    def clear(self) -> None:
        self.keys[:] = 0
        self.used = 1

    def has_room(self, more: int) -> bool:
        """Whether so many numbers go in; a pool that is empty grows for them."""
        if self.used + more > len(self.pool) and self.used == 1:
            self.pool = np.zeros(1 + more, _ID)
        return self.used + more <= len(self.pool)

    def places_of(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> self.shift
        return np.where(self.keys[slots] == hashes, self.at[slots], 0).astype(np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of parts with these ids, one after the other."""
        places = self.used + np.cumsum(counts + 1) - counts - 1
        end = self.used + len(ids) + len(counts)
        is_id = np.ones(end - self.used, bool)
        is_id[places - self.used] = False
        own = self.pool[self.used : end]
        own[is_id], own[~is_id] = ids, counts
        self.used = end
        return places

    def know(self, hashes: np.ndarray, places: np.ndarray) -> None:
        slots = hashes >> self.shift
        self.keys[slots], self.at[slots] = hashes, places

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at all places in a row, and how many each has."""
        counts = self.pool[places].astype(np.int64)
        first = np.cumsum(counts) - counts
        return self.pool[np.repeat(places + 1 - first, counts) + np.arange(counts.sum())], counts


_random = np.random.default_rng(41)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.cumprod(np.full(4096, 0xD1342543DE82EF95, dtype=np.uint64))


def part_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each part, never 0. Parts of up to 4,096 bytes differ in it as random numbers do."""
    at = (np.arange(len(raw)) - np.repeat(starts, lengths)) % len(_PLACE)
    return mix(np.add.reduceat(_BYTE[raw] * _PLACE[at], starts) + lengths.astype(np.uint64)) | np.uint64(1)


def _characters(raw: bytes) -> str:
    """UTF-8 bytes as text, each byte that is no part of a whole character as one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            size = next((n for n in (1, 2, 3, 4) if _whole(raw[at : at + n], n)), 0)
            out.append(raw[at : at + size].decode() if size else "�")
            at += size or 1
        return "".join(out)


def _whole(raw: bytes, n: int) -> bool:
    try:
        return len(raw) == n and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per Python worker and model."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _agrees(own: Codec, texts: list[str | None], ids: list[list[int]], decoded: list[str], check: bool) -> list[bool | None]:
    """Whether the library has the same ids for each text, and the same text for these."""
    if not check:
        return [None] * len(texts)
    library = own.library
    return [library.encode(t or "") == x and library.decode(x) == d for t, x, d in zip(texts, ids, decoded, strict=True)]


def encoded(docs: DataFrame, model: str | None = None, check: bool = True) -> DataFrame:
    """docs' doc_id with ids (all of the whole text, without begin and end), decoded (the text of these ids) and agrees:
    whether the sentencepiece library gives the same ids and the same text for them; null where check is off.

    One row per row of docs. A null text counts as empty: no ids, an empty text. Repeated rows stay as they are; other
    columns go, so that none can clash. The model file must lie at the same path on all machines.
    """
    path = model or public_tokenizers.path(MODEL)
    fields = [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()), ("agrees", T.BooleanType())]

    def compute(texts):
        own, listed = codec(path), texts.to_pylist()
        arrays = own.encode_batch(listed)
        ids = [x.tolist() for x in arrays]
        decoded = [own.decode(x) for x in ids]
        return [pa.array(arrays, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(_agrees(own, listed, ids, decoded, check), pa.bool_())]

    return add_columns(docs.select("doc_id", "text"), ["text"], fields, compute, drop=("text",))


def digests(docs: DataFrame, model: str | None = None, check: bool = True) -> DataFrame:
    """encoded as digests, made where the texts are: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the text in UTF-8), agrees. Nulls and repeated rows are as in encoded."""
    path = model or public_tokenizers.path(MODEL)
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("agrees", T.BooleanType())]

    def compute(texts):
        own, listed = codec(path), texts.to_pylist()
        ids = [x.tolist() for x in own.encode_batch(listed)]
        decoded = [own.decode(x) for x in ids]
        of_ids = [hashlib.sha256(",".join(map(own.names.__getitem__, x)).encode()).hexdigest() for x in ids]
        of_texts = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
        agrees = _agrees(own, listed, ids, decoded, check)
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string()), pa.array(agrees, pa.bool_())]

    return add_columns(docs.select("doc_id", "text"), ["text"], fields, compute, drop=("text",))
