"""Substring dedup: words inside a window of words that occurs earlier are removed.

The judge of matches is a suffix automaton over reference text: as words are added one by one, the
length of the longest suffix that occurred before is read off it, and where that reaches the window
length the window is a repeat.  Streaming every document past the automata of all shards of a corpus
would cost shards x corpus, so text is sent to the shards that can hold a match, and only there:

* Anchors.  Every window has one anchor, the k-gram of words with the least hash (the leftmost, when
  several tie).  Equal windows have equal anchors at equal places.  Anchors that occur once in the
  corpus rule out all their windows.
* Shards.  For each anchor that recurs, the piece of text that its windows span goes to a shard chosen
  by the anchor; there the pieces stream, in order of (document, start), through the shard's automaton.
  A shard has about `SHARD_PLACES` places of anchors, however large the corpus is.
* Hot anchors (of `HOT_PLACES` and more) have windows sent one by one, to a shard chosen by the window's
  words, so that no shard holds all that one anchor leads to.
* A piece, or a window of a hot anchor, that is equal to an earlier one of the same Arrow batch of documents
  is a repeat for sure: only its range travels, and only the first is sent.  A shard's rows are sorted before
  they stream, and equal text adds no states, so what a task holds does not grow with the copies.

Windows are judged on the input, not on what is left.

Defined cases: null texts have no words; texts shorter than a window lose nothing; very long texts are read
whole; a null id sorts first; rows that repeat an id are documents of their own, ordered by text; an empty
table gives an empty result; `stripped` keeps all other columns, of any name.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import shared as S

WINDOW = 20
GRAM = 6
#: An anchor of so many places and more is hot.
HOT_PLACES = 1_000
#: Places of anchors for each shard; an automaton holds one shard at a time.
SHARD_PLACES = 1_500


class SuffixAutomaton:
    """Online suffix automaton over several sequences of words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def restart(self) -> None:
        """The next word begins a new sequence."""
        self.last = 0

    def _split(self, at: int, word, longer: int) -> int:
        """The state of the strings of `longer` that end a step from `at`, made if need be."""
        nxt, link, length = self.next, self.link, self.length
        if length[longer] == length[at] + 1:
            return longer
        clone = len(nxt)
        nxt.append(dict(nxt[longer]))
        link.append(link[longer])
        length.append(length[at] + 1)
        link[longer] = clone
        while at >= 0 and nxt[at].get(word) == longer:
            nxt[at][word] = clone
            at = link[at]
        return clone

    def add(self, word) -> int:
        """Add a word; the length of the longest suffix of the sequence that had occurred before."""
        nxt, link, length = self.next, self.link, self.length
        at = self.last
        known = nxt[at].get(word)
        if known is not None:
            self.last = self._split(at, word, known)
            return length[self.last]
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[at] + 1)
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            link[new] = self._split(at, word, nxt[at][word])
        self.last = new
        return length[link[new]]


# ---- anchors ---------------------------------------------------------------------------


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each k-gram, starts of all windows, place of each window's anchor) of documents whose
    words begin at `first` (with the count of all last)."""
    keys = S.run_hashes(hashes, gram)
    span = window - gram + 1
    if len(hashes) < window:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, place, width = keys, np.arange(len(keys)), 1
    while width < span:  # best of [i, i + width), doubled, with the left one on ties
        step = min(width, span - width)
        left = best[:-step] <= best[step:]
        best, place = np.where(left, best[:-step], best[step:]), np.where(left, place[:-step], place[step:])
        width += step
    start = np.arange(len(hashes) - window + 1)
    owner = np.searchsorted(first, start, "right") - 1
    inside = start + window <= first[owner + 1]
    return keys, start[inside], place[: len(start)][inside]


_FRAGMENT = "bucket int, kind int, keys binary, docs binary, places binary"
_FLAG = "doc long, place long, hot boolean"


def _find_anchors(window: int, gram: int, buckets: int):
    """Per slice and bucket: (key, document, place) of anchors seen once in it (kind 1), places of those
    seen more often (2), and (key, how often) of these (3)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = S.text_bytes(batch.column(1))
            for i, j in S.slices(offsets):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = S.words(part, cuts)
                keys, _, place = anchors(S.word_hashes(part, starts, ends), first, window, gram)
                place = np.unique(place)
                if not len(place):
                    continue
                owner = np.searchsorted(first, place, "right") - 1
                doc, key, local = ids[i:j][owner], keys[place], place - first[owner]
                order = np.argsort(key, kind="stable")
                key, doc, local = key[order], doc[order], local[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                n = np.diff(np.append(at, len(key)))
                once = np.repeat(n == 1, n)
                yield from _dealt(1, key[once], doc[once], local[once], buckets)
                yield from _dealt(2, key[~once], doc[~once], local[~once], buckets)
                yield from _dealt(3, key[at[n > 1]], n[n > 1], n[n > 1], buckets)

    return find


def _dealt(kind: int, keys: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [
        (b, kind, S.pack(keys[p]), S.pack(docs[p]), S.pack(places[p].astype(np.int64)))
        for b in range(buckets)
        if len(p := order[at[b] : at[b + 1]])
    ]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), *[pa.binary()] * 3])]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "keys", "docs", "places"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document, place, whether it is hot) of anchors that recur."""

    def met(rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        keys, docs, places = ([np.concatenate([r[x] for r in rows.get(k, [])] or [np.zeros(0, t)]) for k in (1, 2, 3)] for x, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        every, inverse = np.unique(np.concatenate([keys[0], keys[2]]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([np.ones(len(keys[0])), places[2]])).astype(np.int64) if len(inverse) else np.zeros(0, np.int64)
        once = n[inverse[: len(keys[0])]]
        many = np.concatenate([once[once > 1], n[np.searchsorted(every, keys[1])]])
        if len(many):
            doc, place = np.concatenate([docs[0][once > 1], docs[1]]), np.concatenate([places[0][once > 1], places[1]])
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(many >= HOT_PLACES)], ["doc", "place", "hot"])

    bucket, rows = None, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != bucket:
                yield from met(rows)
                bucket, rows = r["bucket"], {}
            rows.setdefault(r["kind"], []).append((S.unpack(r["keys"], np.uint64), S.unpack(r["docs"], np.int64), S.unpack(r["places"], np.int64)))
    yield from met(rows)


# ---- pieces and shards -----------------------------------------------------------------

_PIECE = "shard long, doc long, start long, windows long, piece binary"
_RANGE = "doc long, low long, high long"
#: Rows of a batch that a task gives.
_ROWS = 4096


def _given(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    arrow = [pa.binary() if t == "binary" else pa.int64() for t in types]
    while some := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), arrow)], list(names))


def _cut_pieces(window: int, gram: int, shards: int):
    """Pieces of the windows whose anchors recur, a row each; windows known to be repeats have no piece."""

    def named(piece: bytes) -> bytes:
        return hashlib.blake2b(piece, digest_size=16).digest()

    def of_document(doc: int, part: np.ndarray, flagged: list, seen: set[bytes]) -> Iterator[tuple]:
        starts, ends, first = S.words(part, np.array([0, len(part)]))
        keys, start, place = anchors(S.word_hashes(part, starts, ends), first, window, gram)
        # one space between words, so that white space plays no part
        words = part.tobytes().split()
        hot = {f["place"]: f["hot"] for f in flagged}
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
        spread = doc % shards
        for low, high in zip(at.tolist(), np.append(at[1:], len(place)).tolist()):
            one_by_one = hot.get(int(place[low]))
            if one_by_one is None:
                continue
            if not one_by_one:
                piece = b" ".join(words[start[low] : start[high - 1] + window])
                known = (name := b"p" + named(piece)) in seen
                seen.add(name)
                yield (spread if known else int(keys[place[low]]) % shards, doc, int(start[low]), high - low, None if known else piece)
                continue
            run = low  # windows [run, w) are known
            for w in range(low, high):
                piece = b" ".join(words[start[w] : start[w] + window])
                if (name := named(piece)) not in seen:
                    seen.add(name)
                    if run < w:
                        yield (spread, doc, int(start[run]), w - run, None)
                    run = w + 1
                    yield (int.from_bytes(name[:8], "little") % shards, doc, int(start[w]), 1, piece)
            if run < high:
                yield (spread, doc, int(start[run]), high - run, None)

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, flags = batch.column("doc_id").to_numpy(), batch.column("places")
        data, offsets = S.text_bytes(batch.column("text"))
        seen: set[bytes] = set()
        for d in np.argsort(ids, kind="stable").tolist():
            yield from of_document(int(ids[d]), data[offsets[d] : offsets[d + 1]], flags[d].as_py(), seen)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flagged = batch.column("places").is_valid()
            if flagged.true_count:
                yield from _given(pieces(batch.filter(flagged)), _PIECE)

    return cut


def _match(window: int):
    """Ranges of windows that occur earlier; rows come shard by shard, in order of (document, start)."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        shard, automaton = None, SuffixAutomaton()
        for batch in batches:
            for own, doc, start, windows, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None:
                    yield doc, start, start + windows
                    continue
                if own != shard:
                    shard, automaton = own, SuffixAutomaton()
                automaton.restart()
                add, low = automaton.add, None
                for i, word in enumerate(piece.split(b" "), start - window + 1):
                    if add(word) >= window:
                        low = i if low is None else low
                    elif low is not None:
                        yield doc, low, i
                        low = None
                if low is not None:
                    yield doc, low, start + windows

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _given(ranges(batches), _RANGE)

    return match


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """docs with `key`, a whole number in order of the id: the id itself where it serves."""
    twice = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if twice.isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    ranged = docs.repartitionByRange(S.tasks(docs.sparkSession), F.col(id_col).asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    return S.written(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def repeats(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, ranges): per document of keyed (doc_id, text and others) with repeats, the ranges [low, high) of
    windows that occur earlier."""
    spark = keyed.sparkSession
    buckets = S.tasks(spark)
    parts = keyed.select("doc_id", "text").mapInArrow(_find_anchors(window, gram, buckets), _FRAGMENT)
    met = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_recurring, _FLAG)
    flags = S.written(met, "anchors")
    shards = max(1, -(-flags.count() // SHARD_PLACES))
    places = flags.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("place", "hot")).alias("places"))  # of one document
    # all columns go along: the text is then dealt by document once, for this join and that of the ranges
    asked = keyed.join(places, keyed["doc_id"] == places["of"], "left")
    pieces = asked.mapInArrow(_cut_pieces(window, gram, shards), _PIECE)
    dealt = pieces.repartition(buckets * 2, "shard").sortWithinPartitions("shard", "doc", "start")
    found = dealt.mapInArrow(_match(window), _RANGE)
    return found.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def _kept(text: str | None, ranges, window: int) -> tuple[int, int, str]:
    """(words, removed words, kept words joined by one space)."""
    words = (text or "").encode("utf-8").split()
    gone = np.zeros(len(words) + 1, np.int64)
    for r in ranges or ():
        gone[r["low"]] += 1
        gone[r["high"] + window - 1] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return len(words), int(covered.sum()), b" ".join(w for w, c in zip(words, covered.tolist()) if not c).decode("utf-8")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(t.as_py(), r, window) for t, r in zip(batch.column("text"), batch.column("ranges").to_pylist())]
            n, gone, kept = zip(*rows) if rows else ([], [], [])
            sha = [hashlib.sha256(k.encode("utf-8")).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = _keyed(slim, "id", "text", "doc_id").select("doc_id", "id", "text")
    found = repeats(keyed, window, **how)
    rows = keyed.join(found, keyed["doc_id"] == found["doc"], "left").select("id", "text", "ranges")
    return rows.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """docs with repeats removed from their texts; texts without repeats stay as they are."""
    names = docs.columns
    key, of, ranges = S.free(docs, "key", "of", "ranges")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                t.as_py() if r is None else _kept(t.as_py(), r, window)[2]
                for t, r in zip(batch.column(text_col), batch.column(ranges).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.string()) if c == text_col else batch.column(c) for c in names], names
            )

    keyed = _keyed(docs, id_col, text_col, key)
    texts = keyed.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    found = repeats(texts, window, **how).withColumnsRenamed({"doc": of, "ranges": ranges})
    return keyed.join(found, keyed[key] == found[of], "left").select(*names, ranges).mapInArrow(apply, docs.schema)
