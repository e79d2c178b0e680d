"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with one space for each run of anything else.  N-grams of one to
three characters are hashed to buckets; the matrix of log-probabilities (languages x buckets, whole
numbers of 1/1024 nat so that sums are exact) is broadcast, and a document's score per language is
a sum of looked-up entries, taken with numpy over the grams that occur.

The model learns from at most `per_language` rows of each language (those with the least hash of
their id); every document is scored, over its whole text.  The broadcast matrix has a bound that
does not grow with the rows: languages x 65 536 numbers of four bytes, of at most `MOST_LANGUAGES`
languages (with more, ValueError).

Defined cases: very long texts are scored whole, cut between characters into slices; rows that repeat are
scored alike; columns of any name are kept, those named as the results are replaced; a null text, or one without letters, is `und` with score 0; rows with a null language
or text are not learned from; a null id is not held out; with nothing to learn from every document is
`und`; ties go to the language that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from claimloom.llm.shared import slices, text_bytes

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 2000
#: Bytes of text whose grams are looked up at once; of longer texts, as many at a time.
SLICE_BYTES = 1 << 18
#: More languages than a model may have: the matrix is built in the driver and broadcast.
MOST_LANGUAGES = 512
_UNIT = 1024.0
_SPREAD = np.uint32(0x9E3779B1)


@cache
def _letters() -> np.ndarray:
    """Per code point: its lower-case letter, or 32 where it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points in lower case, the first of each document and the last of all): a space opens every document,
    ends the last one, and stands for each run of what is no letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    # a space before every document and one after the last, so that no gram spans two documents' letters
    codes = np.insert(_letters()[points], first, np.uint32(32))
    first = first + np.arange(len(offsets))
    keep = (codes != 32) | np.append(True, codes[:-1] != 32)
    keep[first] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def grams(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Order by order: (buckets, first bucket of each document and the count of all)."""
    with np.errstate(over="ignore"):
        for n in ORDERS:
            h = np.full(max(len(codes) - n + 1, 0), n, np.uint32)
            for j in range(n):
                h = (h ^ codes[j : j + len(h)]) * _SPREAD
                h ^= h >> np.uint32(15)
            h &= np.uint32(BUCKETS - 1)
            # a gram may end on the space that opens the next document, and no further; in each document
            # so many places begin one
            n_own = np.maximum(first[1:] - max(n - 2, 0) - first[:-1], 0)
            at = np.concatenate([[0], np.cumsum(n_own)])
            inside = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n_own)
            yield h[inside], at


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, document of each piece): documents longer than a slice are cut between characters."""
    cuts, owner = [], []
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            cuts.append(at)
            owner.append(i)
            at += SLICE_BYTES
            while at < end and data[at] & 0xC0 == 0x80:
                at += 1
            if at >= end:
                break
    return np.array([*cuts, offsets[-1]], np.int64), np.array(owner, np.int64)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, id_col="doc_id", text_col="text", lang_col="lang"):
    """(languages, matrix of whole log-probabilities, whole log-priors) from labelled rows."""
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    # rows per language first: then about per_language rows of each pass a limit on their id's hash, so that
    # the exact limit behind it ranks a number of rows that does not grow with the table
    rates = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.25 * per_language + 200) / F.count(F.lit(1))).alias("rate"))
    found = rates.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    rates = rows.sparkSession.createDataFrame(found, rates.schema)
    chance = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    some = known.join(F.broadcast(rates), "lang").where(chance < F.col("rate")).drop("rate")
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    sample = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, offsets = text_bytes(batch.column("text"))
            for i, lang in enumerate(langs):
                part = data[offsets[i] : offsets[i + 1]]
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                cuts, _ = pieces(part, np.array([0, len(part)]))
                for a, z in zip(cuts[:-1], cuts[1:]):
                    for b, _ in grams(*letters(part[a:z], np.array([0, z - a]))):
                        total += np.bincount(b, minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at), "n": pa.array(total[at])})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets rows at most
    langs = sorted(set(table["lang"].to_pylist()))
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = np.zeros((len(langs), BUCKETS))
    row = {lang: i for i, lang in enumerate(langs)}
    matrix[[row[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    matrix = np.log((matrix + 0.5) / (matrix.sum(1, keepdims=True) + 0.5 * BUCKETS)) if langs else matrix
    priors = np.log(np.array([sizes[x] for x in langs], float) / max(sum(sizes.values()), 1)) if langs else np.zeros(0)
    return langs, np.round(matrix * _UNIT).astype(np.int32), np.round(priors * _UNIT).astype(np.int64)


def classify(docs: DataFrame, model, text_col: str = "text", with_text: bool = True, out=("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its posterior in the columns `out`, on request without the text."""
    langs, matrix, priors = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix, priors))
    keep = [c for c in docs.columns if c not in out]
    kept = docs.select(*keep)
    back = [c for c in keep if with_text or c != text_col]
    schema = T.StructType([f for f in kept.schema.fields if f.name in back]).add(out[0], "string").add(out[1], "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, priors = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            total = np.repeat(priors[:, None], batch.num_rows, 1)
            has = np.zeros(batch.num_rows, bool)
            cuts, owner = pieces(data, offsets)
            for i, j in slices(cuts, SLICE_BYTES):
                codes, first = letters(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
                np.logical_or.at(has, owner[i:j], np.diff(np.concatenate([[0], np.cumsum(codes != 32)])[first]) > 0)
                for b, at in grams(codes, first):
                    full = np.diff(at) > 0
                    for k in range(len(langs) if full.any() else 0):
                        np.add.at(total[k], owner[i:j][full], np.add.reduceat(matrix[k][b], at[:-1][full], dtype=np.int64))
            if langs:
                best = total.argmax(0)
                odds = np.exp((total - total.max(0)) / _UNIT).sum(0)
                names = [langs[x] if ok else UNKNOWN for x, ok in zip(best, has)]
                scores = np.where(has, 1 / odds, 0.0)
            else:
                names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in back], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*back, *out],
            )

    return kept.mapInArrow(scored, schema)


def trained_on_the_rest(docs: DataFrame, per_language: int = PER_LANGUAGE, with_text: bool = True) -> DataFrame:
    """docs classified by a model that learned from those not held out; adds held_out."""
    held = _held_out(F.col("doc_id"))
    model = learn(docs.where(~held), per_language)
    return classify(docs.withColumn("held_out", held), model, with_text=with_text)
