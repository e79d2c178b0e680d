"""Capabilities the data model declares: search legs, fusion, near-duplicates, penalties.

Joins here are equality joins on tokens, bands or keys; vectors meet blocks of queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions import text as X
from claimloom.operators.skew import fits_broadcast, key_counts, salted_join
from claimloom.session import cut_lineage

HASH_BITS = 60
# Left titles up to this number, of up to so many grams in all and so many different ones, are sent to every task.
BROADCAST_TITLES = 20_000
BROADCAST_GRAMS = 2_000_000
KNOWN_GRAMS = 20_000


def plain_tokens(text: Column) -> Column:
    """Lower-cased words, neither stemmed nor stopped: the plain full-text configuration."""
    return X.find_all(F.lower(text), X.TOKEN)


def keyword_leg(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Top k docs(doc_id, text) per queries(query_id, text) by summed tf * idf, idf = ln(N / df).

    Term counts are aggregated before the join; a term of the whole corpus has idf near zero and
    still counts, exactly as it should.  Up to 2 000 000 asked terms with their weights go to every task, to
    which counts are dealt by document: sums are then whole where they are made, and a term that all documents
    hold is met in all tasks.  Beyond that, counts and asked terms meet in a salted join.
    """
    asked = X.unnest(queries, ["query_id"], F.array_distinct(plain_tokens(F.col("text"))), "term")
    vocabulary = asked.select("term").distinct()
    if fits_broadcast(vocabulary, 2_000_000):
        vocabulary = F.broadcast(vocabulary)
    # read three times below, so written once: (doc, term) counts of the asked terms only
    wanted = cut_lineage(
        X.unnest(docs, ["doc_id"], plain_tokens(F.col("text")), "term")
        .join(vocabulary, "term", "left_semi")
        .groupBy("doc_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = key_counts(wanted, "term")
    idf = df.withColumn("total", total).select("term", F.ln(F.col("total") / F.col("n")).alias("idf"))
    weights = asked.join(idf, "term")
    if fits_broadcast(asked, 2_000_000):
        met = wanted.repartition("doc_id").join(F.broadcast(weights), "term")
    else:
        met = salted_join(wanted, weights, "term", ["doc_id"], counts=df)
    scored = (
        met
        .groupBy("query_id", "doc_id")
        # whole millionths: the sum is exact in any order and stays on longs
        .agg((F.sum(F.floor(F.col("tf") * F.col("idf") * 1e6 + 0.5)) / 1e6).alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents holding every term."""
    words = plain_tokens(F.col("text"))
    return docs.where(F.size(F.array_intersect(words, F.array(*[F.lit(t.lower()) for t in terms]))) == len(set(t.lower() for t in terms)))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _scored_block(ids: list, block: np.ndarray, k: int):
    """Per batch of vectors: the k best of it for each query of a block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            column = batch.column("embedding")
            whole = (pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False) == block.shape[1]) & column.is_valid().to_numpy(zero_copy_only=False)
            if not whole.any():
                continue
            batch = batch.filter(pa.array(whole))
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, block.shape[1])
            vec = batch.column("vec_id").to_numpy()
            norms = np.sqrt((v * v).sum(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                # rounded, so that equal vectors tie whatever the order of a sum; ties go to the smaller id
                sims = np.round(block @ v.T / norms, 9)
            for i, row in enumerate(sims):
                row, vecs = row[~np.isnan(row)], vec[~np.isnan(row)]
                if len(row) > k:
                    near = row >= np.partition(row, -k)[-k]
                    row, vecs = row[near], vecs[near]
                row, vecs = np.append(best[i][0], row), np.append(best[i][1], vecs)
                order = np.lexsort((vecs, -row))[:k]
                best[i] = row[order], vecs[order]
        for query, (row, vecs) in zip(ids, best):
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(row), pa.int64()), pa.array(vecs), pa.array(row)], ["query_id", "vec_id", "similarity"])

    return score


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """Nearest vectors(vec_id, embedding) per queries(query_id, embedding) by cosine, exactly.

    Queries go out in blocks of at most block_bytes; every vector row is scored against a block
    once, each task keeps the k best per query, and only those are shuffled.  Vectors of another
    length, null ones and ones of zeros have no similarity and are left out.
    """
    blocks: list[tuple[list, list]] = [([], [])]
    for row in queries.where(F.col("query_id").isNotNull() & F.col("embedding").isNotNull()).toLocalIterator():
        vector = np.array(row["embedding"], float)
        norm = np.sqrt((vector * vector).sum())
        ids, held = blocks[-1]
        if held and (len(held[0]) != len(vector) or (len(held) + 1) * vector.nbytes > block_bytes):
            blocks.append(([], []))
            ids, held = blocks[-1]
        if norm:
            ids.append(row["query_id"])
            held.append(vector / norm)
    found = None
    for ids, held in blocks:
        block = np.array(held) if held else np.zeros((0, 1))
        part = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
            _scored_block(ids, block, k), "query_id long, vec_id long, similarity double"
        )
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf_merge(legs: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of legs(query_id, doc_id, rank)."""
    parts = None
    for leg in legs:
        rows = leg.select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).cast("decimal(20,12)").alias("r"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("query_id", "doc_id").agg(F.sum("r").cast("double").alias("rrf_score"))


#: Token lists that are hashed at a time: what a task's Python holds does not grow with its batches.
HASHED_ROWS = 256


def _hash_lists(tokens: pa.Array) -> np.ndarray:
    sizes = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(tokens), dtype=np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled) == 0:
        return out
    words = tokens.flatten().dictionary_encode()  # of lists that are null nothing is flattened
    distinct = np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words.dictionary.to_pylist()], dtype=np.int64)
    hashes = distinct[words.indices.to_numpy()]
    starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
    for bit in range(HASH_BITS):
        ones = np.add.reduceat((hashes >> bit) & 1, starts)
        out[filled] |= (2 * ones > sizes[filled]).astype(np.int64) << bit
    return out


@F.arrow_udf(T.LongType())
def _simhash(tokens: pa.Array) -> pa.Array:
    slices = [_hash_lists(tokens.slice(at, HASHED_ROWS)) for at in range(0, len(tokens), HASHED_ROWS)]
    return pa.array(np.concatenate(slices) if slices else np.zeros(0, np.int64), pa.int64())


def simhash(tokens: Column) -> Column:
    """60-bit SimHash: a bit is set when more than half of the token hashes set it."""
    return _simhash(tokens)


def near_hashes(rows: DataFrame, key: str, value: str, max_distance: int = 3) -> DataFrame:
    """Pairs of distinct hash values at most max_distance bits apart, each with its lowest key and
    its number of copies.

    Equal hashes are collapsed first, so a thousand copies are one value and never a million
    pairs.  Of 2 * max_distance blocks of bits a near pair agrees on max_distance at least, so values
    meet on every choice of so many blocks: keys of half the bits, which few values share by chance.
    """
    values = cut_lineage(
        rows.groupBy(value).agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    n = max(2 * max_distance, 1)
    edges = [HASH_BITS * b // n for b in range(n + 1)]
    block = [F.shiftright(value, low).bitwiseAND((1 << high - low) - 1).cast("string") for low, high in pairwise(edges)]
    bands = [
        F.concat_ws(":", F.lit(i), *[block[b] for b in chosen])
        for i, chosen in enumerate(combinations(range(n), max(max_distance, 1)))
    ]
    banded = values.select(
        F.col(value).alias("h"), "rep", "copies",
        F.explode(F.array(*bands)).alias("band"),
    )
    a = banded.select("band", F.col("h").alias("ha"), F.col("rep").alias("rep_a"), F.col("copies").alias("copies_a"))
    b = banded.select("band", F.col("h").alias("hb"), F.col("rep").alias("rep_b"), F.col("copies").alias("copies_b"))
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return (
        salted_join(a, b, "band", ["ha"])
        .where((F.col("ha") < F.col("hb")) & (distance <= max_distance))
        .select("rep_a", "rep_b", "copies_a", "copies_b", distance.alias("distance"))
        .distinct()
    )


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    )
    return F.array_distinct(F.flatten(grams))


def _held(size: Column, threshold: float) -> Column:
    """How many of its grams a set of that size shares at least with one that is similar enough."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def _titles_by_vocabulary(a: DataFrame, b: DataFrame, vocabulary: list[str], threshold: float) -> DataFrame:
    """Similar titles where the left ones, and their grams in the common order, go to every task: a right title is cut
    down to its prefix, meets left prefixes and is scored on its own row, so that only results leave a task."""
    order = F.split(F.lit("\t".join(vocabulary)), "\t")  # letters, digits and blanks hold no tabs

    def head(g: Column) -> Column:
        known = F.array_intersect(order, g)  # grams that no left title has come first, so they take the places before
        return X.bind(known, lambda k: F.slice(k, 1, F.greatest(F.size(k) - _held(F.size(g), threshold) + 1, F.lit(0))))

    a = cut_lineage(a.select(F.monotonically_increasing_id().alias("row"), "left_id", F.col("grams").alias("ga"), X.bind(F.col("grams"), head).alias("ha")))
    index = X.unnest(a.withColumn("na", F.size("ga")), ["row", "na"], F.col("ha"), "gram", "i")
    known = b.select("right_id", F.col("grams").alias("gb"), X.bind(F.col("grams"), head).alias("hb"))
    # grams that follow the first shared one, and it, are all that a pair can share; j counts from the end of the prefix
    rest = F.least(F.col("na") - F.col("i"), F.size("hb") - F.col("j") + _held(F.size("gb"), threshold) - 1)
    met = (
        X.unnest(known, ["right_id", "gb", "hb"], F.col("hb"), "gram", "j")
        .join(F.broadcast(index), "gram")
        .where(rest * (1 + threshold) >= (F.col("na") + F.size("gb")) * threshold - 1e-9)
        .join(F.broadcast(a), "row")
    )
    # a pair met through several grams counts at the first of them
    first = F.get(F.array_intersect("ha", "hb"), F.lit(0))
    shared = F.size(F.array_intersect("ga", "gb"))
    score = F.when(first == F.col("gram"), X.bind(shared, lambda s: s / (F.size("ga") + F.size("gb") - s)))
    return X.unnest(met, ["left_id", "right_id"], F.filter(F.array(score), lambda s: s >= threshold), "similarity")


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = 0.5, broadcast_titles: int = BROADCAST_TITLES) -> DataFrame:
    """Pairs (left_id, right_id, similarity) of titles with trigram Jaccard >= threshold.

    Prefix filter: with grams ordered rarest first, two sets that similar must share a gram among
    the first n - ceil(threshold * n) + 1 of each.  Common grams therefore never drive the join,
    and no pair at or above the threshold is lost.  Up to broadcast_titles left titles of at most BROADCAST_GRAMS grams
    are sent to every task, ordered by their own counts, and right titles are read once with no shuffle; more meet in shuffles.
    """

    def grams(df: DataFrame, key: str, smallest: float = 1, largest: float | None = None) -> DataFrame:
        def fits(g: Column) -> Column:
            return (F.size(g) >= smallest) if largest is None else F.size(g).between(smallest, largest)

        rows = df.where(F.col("id").isNotNull()).withColumnRenamed("id", key)
        # inside a generator: a filter on a computed column would make Spark compute it twice
        return X.unnest(rows, [key], F.filter(F.array(trigrams(F.col("title"))), fits), "grams")

    a = grams(left, "left_id")
    if fits_broadcast(left.select("id"), broadcast_titles):
        sizes = a.agg(F.min(F.size("grams")).alias("least"), F.max(F.size("grams")).alias("most"), F.sum(F.size("grams")).alias("all")).first()
        if (sizes["all"] or 0) <= BROADCAST_GRAMS:
            counts = X.unnest(a, [], F.col("grams"), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            listed = counts.orderBy("n", "gram").limit(KNOWN_GRAMS + 1).collect()  # short strings, as many as are sent
            if len(listed) <= KNOWN_GRAMS:
                b = grams(right, "right_id", (sizes["least"] or 1) * threshold, (sizes["most"] or 0) / threshold if threshold > 0 else None)
                return _titles_by_vocabulary(a, b, [r["gram"] for r in listed], threshold)
    b = grams(right, "right_id")
    each = X.unnest(a, [], F.col("grams"), "gram").unionByName(X.unnest(b, [], F.col("grams"), "gram"))
    freq = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        listed = salted_join(X.unnest(df, [key], F.col("grams"), "gram"), freq, "gram", [key], counts=freq)
        # a title's own grams: a short list by nature
        ordered = listed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("o"))
        size = F.size("o")
        head = F.slice("o", 1, size - _held(size, threshold) + 1)
        return X.unnest(ordered, [key], F.transform(head, lambda s: s["gram"]), "gram")

    pairs = (
        salted_join(prefix(b, "right_id"), prefix(a, "left_id"), "gram", ["right_id"])
        .select("left_id", "right_id")
        .distinct()
    )
    shared = F.size(F.array_intersect("ga", "gb"))
    return (
        pairs.join(a.withColumnRenamed("grams", "ga"), "left_id")
        .join(b.withColumnRenamed("grams", "gb"), "right_id")
        .withColumn("similarity", shared / (F.size("ga") + F.size("gb") - shared))
        .where(F.col("similarity") >= threshold)
        .select("left_id", "right_id", "similarity")
    )


def stale_media(media: DataFrame, claims: DataFrame) -> DataFrame:
    """media(claim_id, media_id, captured_at) against claims(claim_id, event_at): media older than
    the event by more than a day predates it and draws the STALE_MEDIA penalty."""
    predates = F.col("captured_at") < F.col("event_at") - F.expr("INTERVAL 1 DAY")
    return (
        media.join(claims, "claim_id")
        .withColumn("predates_claimed_event", predates)
        .withColumn("penalty_type", F.when(predates, "STALE_MEDIA"))
    )


def temporal_factor(published_at: Column, event_at: Column) -> Column:
    """1.0 when published within a week after the event; falls by 0.1 per 30 days to 0.4 after
    that, and is 0.4 for a document older than the event."""
    days = F.date_diff(published_at, event_at)
    late = F.greatest(F.lit(0.4), 1.0 - 0.1 * F.ceil((days - 7) / 30.0))
    return F.when(days < 0, 0.4).when(days <= 7, 1.0).otherwise(late)


def numeric_penalties(claimed: DataFrame, established: DataFrame, kind: str = "measure") -> DataFrame:
    """claimed(claim_id, value) against established(claim_id, value): NUMERIC_MISMATCH beyond
    tolerance (exact for counts and money, 5 % for measures, 0.1 for magnitudes)."""
    gap = F.abs(F.col("value") - F.col("true_value"))
    beyond = {
        "count": gap > 0,
        "money": gap >= 0.005,
        "measure": gap > 0.05 * F.abs(F.col("true_value")),
        "magnitude": gap > 0.1,
    }[kind]
    return (
        claimed.join(established.withColumnRenamed("value", "true_value"), "claim_id")
        .withColumn("penalty_type", F.when(beyond, "NUMERIC_MISMATCH"))
    )
