"""Benchmark decontamination: training text that holds n-grams of test items, found and removed.

Texts become words: A-Z in lower case, then runs of ASCII letters, digits and characters beyond ASCII.
The windows of the test items (`size` consecutive words; an item of fewer words is one window) are kept as
a set of distinct word sequences with a 64-bit hash each.  The set is broadcast; every window of every
document is hashed and looked up in it, and a look-up that hits is verified word by word, so that no
collision counts.  What is hit is then known per document: the spans of words, and the items.

Everything is DataFrame functions.  The set is broadcast in blocks of at most `block_windows` windows and
`block_bytes` bytes of text, one pass over the documents for each, so a block's size does not grow with the
benchmark.  A window that many items share is looked up once and its items are joined after the hits of a
document are distinct.  What is gathered per document (its hits) is bounded by its own words.

Defined cases: a null text, on either side, has no words and hits nothing; a test item without words has no
windows; test rows that repeat an item_id are one item, and a null item_id is the item of the empty name;
rows of documents that repeat an id are documents of their own (rows that repeat id and text get equal
results); a null doc_id is a document like others; very long texts are looked up whole; an empty benchmark
hits nothing, an empty table of documents gives an empty result; `marked` replaces a column of the name of
its result, other columns of any name stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import bind, unnest
from claimloom.llm.shared import free, written

SIZE = 10
#: The most windows, and bytes of their words, of a broadcast.
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words in lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Where a text as it stands is cut, so that each piece but the last ends with a word.
_CUT = r"(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"


def words(text: Column) -> Column:
    """The words of a text; none of a null."""
    text = F.coalesce(text, F.lit(""))
    # of a text of one byte a character, `lower` does what `translate` does, and sooner
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(item, n, h, words): the windows of the items, one row per item and distinct window."""
    item = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held = benchmark.select(item.alias("item"), words(F.col(text_col)).alias("held")).where(F.size("held") > 0)

    def of(held: Column) -> Column:
        n = F.least(F.lit(size), F.size(held))
        return F.transform(F.sequence(F.lit(1), F.size(held) - n + 1), lambda i: F.slice(held, i, n))

    rows = unnest(held, ["item"], bind(F.col("held"), of), "words")
    return rows.select("item", F.size("words").alias("n"), F.xxhash64("words").alias("h"), "words").distinct()


def _scan(texts: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, sha, n_words, at, n, window) of every hit, and one row with null at of every row of texts."""

    held = texts.select("doc_id", "sha", words(F.col("text")).alias("held"))
    # a row per word, in generated code from the scan to the look-up; the null behind the words brings every
    # document, also one without windows, to the other side
    none = F.array(F.lit(None).cast("string"))
    places = held.select("doc_id", "sha", "held", F.posexplode_outer(F.concat("held", none)).alias("at", "word"))
    sizes = F.explode(F.array(*[F.lit(n) for n in lengths or [1]]))
    runs = places.select("doc_id", "sha", "held", "at", sizes.alias("long"))
    run = F.slice("held", F.col("at") + 1, F.col("long"))
    inside = F.col("at") <= F.size("held") - F.col("long")
    looked = runs.withColumn("hash", F.when(inside, F.xxhash64(run)))
    # joined on the hash alone, whose look-up is cheapest; the words are compared where it hits
    found = looked.join(F.broadcast(wanted), F.col("hash") == F.col("h"), "left")
    verified = F.col("h").isNotNull() & (F.col("long") == F.col("n")) & (run == F.col("words"))
    last = (F.col("at") == F.size("held")) & (F.col("long") == (lengths or [1])[0])
    return found.where(verified | last).select(
        "doc_id", "sha", F.size("held").cast("long").alias("n_words"), F.when(F.col("h").isNotNull(), F.col("at")).alias("at"), "n", "window"
    )


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
    block_windows: int = BLOCK_WINDOWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per id and text of docs: doc_id, sha (of the text), copies (rows that hold both), n_words,
    hits (array of (at, n): words from `at` on, sorted) and items (names, sorted as strings)."""
    text = F.col(text_col)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("sha"), text.alias("text")
    )
    # a window's name: the hash of its words, each with its length, so that no two windows share one
    spelled = F.array_join(F.transform("words", lambda w: F.concat_ws(" ", F.length(w), w)), " ")
    every = written(windows(benchmark, item_col, item_text_col, size).withColumn("window", F.sha2(spelled, 256)), "windows")
    lengths = sorted(r["n"] for r in every.select("n").distinct().collect())  # at most `size` of them
    held = every.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.array_join("words", " ")) * 4).alias("bytes")).first()
    blocks = max(1, -(-held["rows"] // block_windows), -(-(held["bytes"] or 0) // block_bytes))
    found, named = [], []
    for block in range(blocks):
        some = every.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        one = written(_scan(texts, some.select("n", "h", "words", "window").distinct(), lengths), "hits")
        found.append(one if block == 0 else one.where("at is not null"))
        pairs = one.where("at is not null").select("doc_id", "sha", "window").distinct()
        named.append(pairs.join(F.broadcast(some.select("window", "item")), "window").select("doc_id", "sha", "item"))
    found, named = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, named)
    spans = found.groupBy("doc_id", "sha").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("at").isNull()).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "n")))).alias("hits"),
    )
    items = named.groupBy("doc_id", "sha").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.withColumnsRenamed({"doc_id": "of", "sha": "of_sha"})
    both = spans.join(items, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "sha", "copies", "n_words", "hits", F.coalesce("items", none).alias("items"))


def covered(found: Column) -> Column:
    """How many words sorted hits cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(held: Column, hit: Column) -> Column:
        end = F.greatest(held["end"], hit["at"] + hit["n"])
        return F.struct((held["n"] + end - F.greatest(held["end"], hit["at"])).alias("n"), end.alias("end"))

    return F.aggregate(found, start, step, lambda held: held["n"])


def spans(found: Column) -> Column:
    """Hits as ranges [low, high) of words, apart from each other and in order."""

    def ranges(at: Column) -> Column:
        opens = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
        closes = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
        return F.transform(F.arrays_zip(opens.alias("low"), closes.alias("high")), lambda r: F.struct(r["low"].alias("low"), (r["high"] + 1).alias("high")))

    at = F.flatten(F.transform(found, lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))
    return bind(F.array_sort(F.array_distinct(at)), ranges)


def digests(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated per row of docs."""
    found = hits(docs, benchmark, **how)
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def marked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "contamination", **how) -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, spans (ranges of words) and items."""
    keep = [c for c in docs.columns if c != out]
    key, found_id, found_key = free(docs, "sha", "found_id", "found_sha")
    found = hits(docs, benchmark, id_col, text_col, **how)
    found = found.select(
        F.col("doc_id").alias(found_id),
        F.col("sha").alias(found_key),
        F.struct("n_words", covered(F.col("hits")).alias("n_hit"), spans(F.col("hits")).alias("spans"), "items").alias(out),
    )
    keyed = docs.select(*keep, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias(key))
    same = F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(key) == F.col(found_key))
    return keyed.join(found, same, "left").select(*keep, out)


def _without(text: Column, ranges: Column) -> Column:
    """A text without the words of sorted ranges and what stands before each of them."""

    def kept(held: Column) -> Column:
        pieces, ranges = held["pieces"], held["ranges"]
        n, k = F.size(pieces), F.size(ranges)  # a last piece without a word is kept like words that are not hit

        def between(j: Column) -> Column:
            low = F.when(j > 0, F.get(ranges, j - 1)["high"]).otherwise(0)
            high = F.when(j < k, F.get(ranges, j)["low"]).otherwise(n)
            return F.slice(pieces, low + 1, high - low)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), k), between)), "")

    return bind(F.struct(F.split(text, _CUT).alias("pieces"), ranges.alias("ranges")), kept)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text_col: str = "text", **how) -> DataFrame:
    """docs without what the benchmark hits: `spans` of words go from their texts, or whole `documents`."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    (out,) = free(docs, "contamination")
    found = marked(docs, benchmark, text_col=text_col, out=out, **how)
    if remove == "documents":
        return found.where(F.col(out)["n_hit"] == 0).select(*docs.columns)
    clean = F.when(F.col(out)["n_hit"] == 0, F.col(text_col)).otherwise(_without(F.col(text_col), F.col(out)["spans"]))
    return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
