"""Piece encoding with seeded merge-dropout, and lossless decoding, for merge-type models.

A text is split before each run of word marks, which no merge crosses.  Within a word an agenda holds
candidate merges by score, then from the left; each candidate taken from it is skipped when a keyed
hash of (seed, document, place of the word in it, place in the word, merged piece) falls under the
dropout rate, else its two parts are joined and their new neighbours become candidates.  With a rate
of 0 this is the model's own segmentation.

Every occurrence of a word has draws of its own.  Only what no draw decides is remembered: the
candidates that come up in a word without a skip, in their order.  The draws of many occurrences are made
at once over these lists; those without a skip have the remembered ids.  For the others, and for words that are
not remembered yet, the agenda is processed for many words at a time in numpy: a row per word with a
rank for each pair of neighbours, of which every step takes the best of each row.  Very long words are
worked out one by one with a heap.

Characters without a piece become bytes, so decoding gives back every text.

Defined cases: a null text has no ids and decodes to an empty text; an empty text has none; a null id
counts as the number -1 in the hash; rows that repeat an id and a text are encoded alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.shared import U64, mixed

MARK = "▁"
#: Stands for a mark that a text itself holds, which is encoded as bytes; no text can hold this.
_OWN_MARK = "\ud800"
DROPOUT = 0.1
SEED = 1
#: Words that a worker remembers, over all its tasks; when there are more, it begins anew.
REMEMBERED = 1_000_000
#: Characters up to which words share a table of rows; the last is `SHORT`.
_WIDTHS = (4, 6, 8, 12, 16, 24, 32, 48)
#: Numbers from here on stand for pieces of several characters, those below for characters.
_PIECE = 0x110000
#: Characters of a word whose agenda is a list; longer ones take a heap, and are not remembered.
SHORT = 48
#: Words whose draws are made at once.
_SLICE = 1 << 16
_MASK = (1 << 64) - 1
_NONE = 1 << 62
#: Rows of a table, and the rank of what is no candidate.
_ROWS = 1 << 14
_NO = np.int32(np.iinfo(np.int32).max)
_WORD = re.compile("▁*[^▁]+|▁+")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def occurrences(doc_id: int | None, count: int) -> np.ndarray:
    """A number per word of a document."""
    return mixed(np.full(1, (-1 if doc_id is None else doc_id) & _MASK, U64))[0] + np.arange(count, dtype=U64)


def keys_of(numbers: np.ndarray, seed: int) -> np.ndarray:
    """The keys of the draws of occurrences."""
    with np.errstate(over="ignore"):
        return mixed(numbers + U64(seed * 0x9E3779B97F4A7C15 & _MASK))


def _draws(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """32-bit keyed hashes of candidate merges (place << 32 | piece); `_draw` is one of them."""
    return mixed(keys ^ codes) >> U64(32)


def _draw(key: int, code: int) -> int:
    h = key ^ code
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _MASK
    return (h ^ h >> 31) >> 32


def _laid(kinds: list[bytes], which: np.ndarray, row: np.ndarray, rows: int) -> list[bytes]:
    """Kinds of bytes end to end, cut by row."""
    many = np.array([len(k) for k in kinds], np.int64)
    table, start = np.frombuffer(b"".join(kinds), np.uint8), np.cumsum(many) - many
    n = many[which]
    ends = np.cumsum(n)
    data = table[np.repeat(start[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    cuts = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(rows + 1))].tolist()
    return [data[a:z] for a, z in zip(cuts[:-1], cuts[1:])]


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.reader = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.reader.get_piece_size()
        names = [self.reader.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.reader.is_control(i) or self.reader.is_unknown(i) or self.reader.is_byte(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: self.reader.get_score(i) for i in plain}
        # the order of the agenda, with the id in the low bits; words that hold merged pieces of equal scores need the heap
        held = Counter(score for piece, score in self.scores.items() if len(piece) > 1)
        order = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {piece: order[score] << 32 | self.ids[piece] for piece, score in self.scores.items() if len(piece) > 1}
        ties = [piece for piece in self.ranks if held[self.scores[piece]] > 1]
        self.short = SHORT if all(2 * MARK in piece for piece in ties) else 0
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if self.reader.is_byte(i)}
        self.raw = [b""] * size
        for i in plain:
            self.raw[i] = names[i].replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self._pairs(names, plain)
        # no piece has a mark after another character, so no merge crosses a word's start
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)

    def _pairs(self, names: list[str], plain: list[int]) -> None:
        """Which pairs of parts make which piece: keys (left << 32 | right), sorted, with rank and piece of each."""
        number = {names[i]: ord(names[i]) if len(names[i]) == 1 else _PIECE + i for i in plain}
        order = {rank: k for k, rank in enumerate(sorted(self.ranks.values()))}
        rows = []
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if (len(a) == 1 or a in number) and (len(b) == 1 or b in number):
                    left, right = ord(a) if len(a) == 1 else number[a], ord(b) if len(b) == 1 else number[b]
                    rows.append((left << 32 | right, order[rank], self.ids[piece]))
        rows.sort()
        keys, ranks, pieces = zip(*rows) if rows else ((), (), ())
        self.keys, self.pair_rank = np.array([*keys, _MASK], U64), np.array([*ranks, _NO], np.int32)
        self.piece_of = np.zeros(len(order) + 1, np.int64)
        self.piece_of[list(order.values())] = [rank & 0xFFFFFFFF for rank in order]
        # ids and bytes of every part: a character without a piece is spelled in bytes
        self.spelled: dict[int, list[int]] = {}

    def paired(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that parts side by side would make."""
        keys = left.astype(U64) << U64(32) | right.astype(U64)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.pair_rank[at], _NO)

    def many(self, words: list[str], keys: np.ndarray | None = None, limit: int = 0) -> tuple:
        """(ids of each word as bytes, its bytes, all merges, first and count of each word's) of short words, with
        draws by keys, or without any; merges are told of the latter only."""
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(size) - size
        ids: list[bytes] = [b""] * len(words)
        back: list[bytes] = [b""] * len(words)
        merges, begins, counts, used = [np.zeros(0, U64)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        low = 0
        for width in _WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for at in range(0, len(rows), _ROWS):
                some = rows[at : at + _ROWS]
                parts = np.full((len(some), width + 1), -1, np.int64)
                inside = np.arange(width)[None] < size[some, None]
                parts[:, :width][inside] = points[(first[some, None] + np.arange(width))[inside]]
                left, row, codes = self._agendas(parts, None if keys is None else keys[some], limit)
                counts[some] = np.bincount(row, minlength=len(some))
                begins[some] = used + np.cumsum(counts[some]) - counts[some]
                merges.append(codes)
                used += len(codes)
                for i, own, text in zip(some.tolist(), *self._bytes(left)):
                    ids[i], back[i] = own, text
        return ids, back, np.concatenate(merges), begins, counts

    def _agendas(self, parts: np.ndarray, keys: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parts left in each row, -1 between them; row and code of the merges, where there are no draws)."""
        n, width = len(parts), parts.shape[1] - 1
        # neighbours by place; the last column is beyond every row
        after = np.minimum(np.tile(np.arange(1, width + 2), (n, 1)), width)
        before = np.tile(np.arange(-1, width), (n, 1))
        both = (parts[:, :-1] >= 0) & (parts[:, 1:] >= 0)
        rank = np.full((n, width), _NO, np.int32)
        rank[both] = self.paired(parts[:, :-1][both], parts[:, 1:][both])
        rows = np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            i = rank[rows].argmin(1) if len(rows) < n else rank.argmin(1)
            best = rank[rows, i]
            go = best != _NO
            rows, i, best = rows[go], i[go], best[go]
            if not len(rows):
                break
            codes = i.astype(U64) << U64(32) | self.piece_of[best].astype(U64)
            r = rows
            if keys is not None:
                skip = _draws(keys[rows], codes) < limit
                rank[rows[skip], i[skip]] = _NO  # until a neighbour changes, the pair is not a candidate
                r, i, best = rows[~skip], i[~skip], best[~skip]
            else:
                found.append((rows, codes))
            j = after[r, i]
            k = after[r, j]
            parts[r, i] = self.piece_of[best] + _PIECE
            parts[r, j] = -1
            rank[r, j] = _NO
            after[r, i], before[r, np.minimum(k, width)] = k, i
            rank[r, i] = self._beside(parts, r, i, k)
            h = before[r, i]
            has = h >= 0
            r, h, i = r[has], h[has], i[has]
            rank[r, h] = self._beside(parts, r, h, i)
        every = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
        codes = np.concatenate([np.zeros(0, U64), *[f[1] for f in found]])
        order = np.argsort(every, kind="stable")
        return parts[:, :width], every[order], codes[order]

    def _beside(self, parts: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        b = parts[rows, right]
        return np.where(b >= 0, self.paired(parts[rows, left], np.maximum(b, 0)), _NO)

    def _bytes(self, parts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The ids of each row's parts, and the bytes that these stand for."""
        row, at = np.nonzero(parts >= 0)
        known, inverse = np.unique(parts[row, at], return_inverse=True)
        spelled = [self._spelled(p) for p in known.tolist()]
        ids = _laid([np.array(s, "<u4").tobytes() for s in spelled], inverse, row, len(parts))
        return ids, _laid([b"".join([self.raw[i] for i in s]) for s in spelled], inverse, row, len(parts))

    def _spelled(self, part: int) -> list[int]:
        if part >= _PIECE:
            return [part - _PIECE]
        if part not in self.spelled:
            self.spelled[part] = self._ids([chr(part)])
        return self.spelled[part]

    def words(self, text: str) -> list[str]:
        marked = MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK) if text else ""
        return _WORD.findall(marked) if self.splits else [marked] * bool(marked)

    def segment(self, word: str, occurrence: int = 0, seed: int = SEED, dropout: float = 0.0) -> list[int]:
        """Ids of one word."""
        return self.keyed(word, int(keys_of(np.array([occurrence], U64), seed)[0]), int(dropout * (1 << 32)))

    def keyed(self, word: str, key: int, limit: int) -> list[int]:
        """Ids of one word with the draws of a key."""
        return self._ids(self._agenda(word)(word, key, limit))

    def _agenda(self, word: str):
        return self._short if self.short_(word) else self._long

    def _ids(self, parts: list[str]) -> list[int]:
        out = []
        for part in parts:
            known = self.ids.get(part)
            if known is not None:
                out.append(known)
            else:
                out += [self.bytes[b] for b in part.replace(_OWN_MARK, MARK).encode()]
        return out

    def short_(self, word: str) -> bool:
        return len(word) <= self.short and 2 * MARK not in word

    def _short(self, word: str, key: int, limit: int) -> list[str]:
        """Parts of a short word: the agenda is a list with a rank per pair of neighbours (`many`, plainly)."""
        parts, rank = list(word), self.ranks.get
        places = list(range(len(parts)))
        agenda = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while agenda:
            best = min(agenda)
            if best == _NONE:
                break
            i = agenda.index(best)
            piece = parts[i] + parts[i + 1]
            code = places[i] << 32 | best & 0xFFFFFFFF
            if limit and _draw(key, code) < limit:
                agenda[i] = _NONE  # until a neighbour changes, the pair is not a candidate
                continue
            parts[i] = piece
            del parts[i + 1], places[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(parts[i - 1] + piece, _NONE)
            if i < len(agenda):
                agenda[i] = rank(piece + parts[i + 1], _NONE)
        return parts

    def _long(self, word: str, key: int, limit: int) -> list[str]:
        """Parts of a word of any length: the agenda is a heap."""
        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        agenda: list[tuple[float, int, str]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                piece = parts[a] + parts[b]
                score = self.scores.get(piece)
                if score is not None:
                    heapq.heappush(agenda, (-score, a, piece))

        for i in range(len(parts) - 1):
            propose(i, i + 1)
        while agenda:
            _, a, piece = heapq.heappop(agenda)
            b = right[a]
            if parts[a] is None or b < 0 or parts[a] + parts[b] != piece:
                continue  # one of the two has been joined since
            code = a << 32 | self.ids[piece]
            if limit and _draw(key, code) < limit:
                continue
            parts[a], parts[b] = piece, None
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            propose(left[a], a)
            propose(a, right[a])
        return [part for part in parts if part is not None]

    def decode(self, ids) -> str:
        """The text of ids; the mark that opens it is not part of it."""
        return b"".join(self.raw[i] for i in ids).decode("utf-8")[1:]


@cache
def model(path: str) -> Model:
    return Model(path)


class Remembered(dict):
    """Short words: a number each, with ids and bytes without a skip and the merges that come up."""

    def __init__(self, made: Model):
        self.made = made
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.ids, self.back = [b""], [b""]  # number 0 is that of words which are not remembered
        self.first, self.count = array("q", [0]), array("q", [0])
        self.codes, self.used = np.zeros(1 << 16, U64), 0

    def bytes_of(self, ids: bytes) -> bytes:
        return b"".join([self.made.raw[i] for i in array("I", ids)])

    def learn(self, words: list[str]) -> None:
        ids, back, codes, first, count = self.made.many(words)
        while self.used + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[self.used : self.used + len(codes)] = codes
        self.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.ids += ids
        self.back += back
        self.first.frombytes((first + self.used).tobytes())
        self.count.frombytes(count.tobytes())
        self.used += len(codes)

    def cut(self, words: list[str], keys: np.ndarray, limit: int) -> tuple[list[bytes], list[bytes]]:
        """(ids, bytes) of each word."""
        if len(self.ids) > REMEMBERED:
            self.begin()
        known = self.get
        nodes = np.fromiter([known(word, -1) for word in words], np.int64, len(words))
        asked = np.flatnonzero(nodes < 0).tolist()
        if asked:
            new = dict.fromkeys([words[i] for i in asked])
            short = [word for word in new if self.made.short_(word)]
            self.update(dict.fromkeys(new, 0))
            self.learn(short)
            nodes[asked] = [self[words[i]] for i in asked]
        at = nodes.tolist()
        ids, back = list(map(self.ids.__getitem__, at)), list(map(self.back.__getitem__, at))
        for i in np.flatnonzero(nodes == 0).tolist():
            own = self.made.keyed(words[i], int(keys[i]), limit)
            ids[i] = array("I", own).tobytes()
            back[i] = self.bytes_of(ids[i])
        if limit:
            first, count = np.array(self.first, np.int64)[nodes], np.array(self.count, np.int64)[nodes]
            ends = np.cumsum(count)
            slots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)
            gone = _draws(np.repeat(keys, count), self.codes[slots]) < limit
            skipped = np.unique(np.searchsorted(ends, np.flatnonzero(gone), "right"))
            own = self.made.many([words[i] for i in skipped.tolist()], keys[skipped], limit)
            for i, *both in zip(skipped.tolist(), *own[:2]):
                ids[i], back[i] = both
        return ids, back


@lru_cache(maxsize=1)
def _remembered(path: str) -> Remembered:
    return Remembered(model(path))


def encoded(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED,
            id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, lossless and, on request, ids, per row."""
    path = path or default_file()
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids binary" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model(path)
        memory, limit = _remembered(path), int(dropout * (1 << 32))

        def cut(doc_ids: list, texts: list[str]) -> Iterator[tuple]:
            words = [made.words(text) for text in texts]
            every = [word for own in words for word in own]
            keys = keys_of(np.concatenate([occurrences(i, len(own)) for i, own in zip(doc_ids, words)]), seed)
            found, backs = [], []
            for start in range(0, len(every), _SLICE):
                some = memory.cut(every[start : start + _SLICE], keys[start : start + _SLICE], limit)
                found += some[0]
                backs += some[1]
            end = 0
            for doc_id, text, own in zip(doc_ids, texts, words):
                start, end = end, end + len(own)
                data, back = b"".join(found[start:end]), b"".join(backs[start:end])[1:]
                row = (doc_id, len(data) // 4, zlib.crc32(data), hashlib.sha256(back).hexdigest(), back == text.encode())
                yield (*row, data) if with_ids else row

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 128):
                rows = list(cut(ids[at : at + 128], [text.as_py() or "" for text in batch.column(1).slice(at, 128)]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def decoded(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """rows with text, decoded from the little-endian unsigned 32-bit ids of ids_col."""
    path = path or default_file()
    keep = [c for c in rows.columns if c != "text"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model(path)
        for batch in batches:
            texts = [made.decode(np.frombuffer(d.as_py() or b"", "<u4").tolist()) for d in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, "text"])

    schema = rows.select(*keep).schema.add("text", "string")
    return rows.select(*[F.col(f.name) for f in schema.fields[:-1]]).mapInArrow(decode, schema)
