"""A corpus index that is kept: postings, block directory and document store in generations.

A generation is what one `add`, `remove` or `compact` wrote; nothing is ever changed in place:

    commits/                      a row per generation, written last: what has no row here is not read
    postings/gen=g/bucket=b/      term, level, doc_id, tf; a bucket is a range of term hashes
    blocks/gen=g/                 term, level, n, max_tf: how many postings a block gained, its highest count
    documents/gen=g/shelf=s/      doc_id, length, tokens (as scoring reads them), terms (term, tf)
    gone/gen=g/                   ids whose rows in earlier generations no longer count

Adding documents tokenises those and nothing else.  Of documents that are replaced or removed, the stored
terms are read from their shelves and taken off the block directory, so counts of documents per term stay
exact without a pass over postings.  `compact` writes what still counts as a new base; earlier generations
are no longer read from then on.  One writer at a time; readers see the commits that were there when they began.

Postings of a term with the same binary magnitude of their count form a block.  The directory's highest count of a block bounds what any
of its postings can add to a score, which is what `keyword_leg` works with (see there).

Everything goes through Spark's readers and writers, so any store works.  Empty texts are documents without
terms; a null text counts as empty; a null id, and rows that repeat an id in one `add`, raise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.operators.declared import plain_tokens
from claimloom.operators.skew import fits_broadcast
from claimloom.session import cut_lineage

BUCKETS = 64
SHELVES = 64
#: Tasks that cut the texts of one shelf into tokens.
SHELF_PARTS = 4
#: Postings, for each wanted document, that the first look at a query's best blocks may take.
SEED = 8
#: Up to this many ids go to every task, so that wide rows stay where they are.
SENT_IDS = 2_000_000

_COMMIT = "gen int, base boolean, documents long, gone long"
_POSTING = "term string, level int, doc_id long, tf long, gen int, bucket int"
_BLOCK = "term string, level int, n long, max_tf long, gen int"
_DOCUMENT = "doc_id long, length long, tokens array<string>, terms array<struct<term:string,tf:long>>, gen int, shelf int"
_GONE = "doc_id long, gen int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _shelf(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SHELVES)).cast("int")


def _sent(ids: DataFrame) -> DataFrame:
    """ids (narrow rows) as the small side of a join, broadcast where they are few."""
    return F.broadcast(ids) if fits_broadcast(ids, SENT_IDS) else ids


def term_counts(words: Column) -> Column:
    """array<struct(term, tf)> of an array of words, by term; counted on the row, so that no word is shuffled."""

    def counted(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))

        def runs(at: Column) -> Column:
            return F.transform(
                at,
                lambda p, n: F.struct(
                    F.get(w, p).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(w)) - p).cast("long").alias("tf")
                ),
            )

        return F.when(F.size(w) > 0, X.bind(first, runs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return X.bind(F.sort_array(words), counted)


def micros(tf: Column, idf: Column) -> Column:
    """What a term adds to a score, in whole millionths."""
    return F.floor(tf * idf * 1e6 + 0.5)


@dataclass(frozen=True)
class CorpusIndex:
    """The index in a folder; a folder without commits is an empty index."""

    spark: SparkSession
    root: str

    # ---- reading --------------------------------------------------------------------

    def commits(self) -> list:
        """A row per generation that is read, oldest first: the last base and all after it."""
        path = f"{self.root}/commits"
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(there):
            return []
        rows = self.spark.read.schema(_COMMIT).parquet(path).orderBy("gen").collect()  # a row per write since the folder began
        last = max((r["gen"] for r in rows if r["base"]), default=0)
        return [r for r in rows if r["gen"] >= last]

    def _read(self, kind: str, schema: str, commits: list | None = None, column: str | None = None) -> DataFrame:
        commits = self.commits() if commits is None else commits
        paths = [f"{self.root}/{kind}/gen={r['gen']}" for r in commits if column is None or r[column]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def _living(self, rows: DataFrame, commits: list) -> DataFrame:
        """rows (doc_id, gen) that no later generation has replaced or removed."""
        gone = self._read("gone", _GONE, commits, "gone")
        if not any(r["gone"] for r in commits):
            return rows
        last = _sent(gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("gen").alias("_last")))
        return rows.join(last, (F.col("doc_id") == F.col("_doc")) & (F.col("gen") < F.col("_last")), "left_anti")

    def documents(self) -> DataFrame:
        """doc_id, length, tokens, terms, shelf of every document."""
        commits = self.commits()
        return self._living(self._read("documents", _DOCUMENT, commits, "documents"), commits).drop("gen")

    def tokens(self) -> DataFrame:
        """doc_id and tokens, as relevance scoring takes them."""
        return self.documents().select("doc_id", "tokens")

    def count(self) -> int:
        return sum(r["documents"] - r["gone"] for r in self.commits())

    def blocks(self) -> DataFrame:
        """term, level, n, max_tf of blocks that hold postings; max_tf is no less than any of them."""
        every = self._read("blocks", _BLOCK)
        return every.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf")).where("n > 0")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, level, doc_id, tf; of `terms` (term) only, read from their buckets."""
        commits = self.commits()
        rows = self._read("postings", _POSTING, commits, "documents")
        if terms is not None:
            buckets = [r["bucket"] for r in terms.select(_bucket(F.col("term")).alias("bucket")).distinct().collect()]  # BUCKETS at most
            rows = rows.where(F.col("bucket").isin(buckets))
            rows = rows.join(F.broadcast(terms) if fits_broadcast(terms, 200_000) else terms, "term", "left_semi")
        return self._living(rows, commits).select("term", "level", "doc_id", "tf")

    def held(self) -> DataFrame:
        """doc_id, terms, words: the postings of a document and the words they stand for, of documents that have any.

        Counted for each generation first, so that replaced ones are taken off sums and not off postings."""
        commits = self.commits()
        rows = self._read("postings", _POSTING, commits, "documents")
        sums = rows.groupBy("doc_id", "gen").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"))
        return self._living(sums, commits).drop("gen")

    # ---- writing --------------------------------------------------------------------

    def _next(self) -> int:
        commits = self.commits()
        return commits[-1]["gen"] + 1 if commits else 1

    def _commit(self, gen: int, base: bool, documents: int, gone: int) -> None:
        row = self.spark.createDataFrame([(gen, base, documents, gone)], _COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def _put(self, df: DataFrame, kind: str, gen: int, part: str | None = None) -> None:
        # overwrite: what a writer that was lost before its commit left behind
        writer = df.write.mode("overwrite")
        (writer.partitionBy(part) if part else writer).parquet(f"{self.root}/{kind}/gen={gen}")

    def _store(self, documents: DataFrame, gen: int) -> None:
        """Documents (dealt by shelf) of a generation and, off what was written of them, their postings; ranges split long
        lists of one term."""
        shelved = documents.withColumn("shelf", _shelf(F.col("doc_id")))
        self._put(shelved.sortWithinPartitions("shelf", "doc_id"), "documents", gen, "shelf")
        listed = X.unnest(self._stored("documents", _DOCUMENT, gen), ["doc_id"], F.col("terms"), "t").select("t.term", "doc_id", "t.tf")
        level, bucket = F.floor(F.log2("tf")).cast("int"), _bucket(F.col("term"))
        ranged = listed.repartitionByRange(bucket, "term", level, "doc_id")  # level and bucket follow from the rest
        ranged = ranged.select("term", level.alias("level"), "doc_id", "tf", bucket.alias("bucket"))
        self._put(ranged.sortWithinPartitions("bucket", "term", "level"), "postings", gen, "bucket")

    def _stored(self, kind: str, schema: str, gen: int) -> DataFrame:
        return self._read(kind, schema, [{"gen": gen}])

    def _retire(self, ids: DataFrame, gen: int) -> tuple[DataFrame | None, int]:
        """(what their stored terms take off the directory, how many) of documents with these ids; notes them as gone."""
        if not self.commits():
            return None, 0
        held = self.documents()
        shelves = [r["shelf"] for r in ids.select(_shelf(F.col("doc_id")).alias("shelf")).distinct().collect()]  # SHELVES at most
        old = cut_lineage(held.where(F.col("shelf").isin(shelves)).join(_sent(ids), "doc_id", "left_semi").select("doc_id", "terms"))
        many = old.count()
        if many:
            self._put(old.select("doc_id"), "gone", gen)
        terms = X.unnest(old, [], F.col("terms"), "t").select("t.term", F.floor(F.log2("t.tf")).cast("int").alias("level"))
        return terms.groupBy("term", "level").agg((-F.count(F.lit(1))).alias("n"), F.lit(0).cast("long").alias("max_tf")), many

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add documents, replacing those with the same ids; the number of the generation."""
        gen = self._next()
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # texts are dealt to their shelves before they are cut, as their tokens take several times the room
        rows = rows.repartition(_shelf(F.col("doc_id")), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHELF_PARTS)))
        split = X.with_tokens(rows, "text", "tokens").select("doc_id", "tokens", plain_tokens(F.col("text")).alias("plain"))
        documents = split.select("doc_id", F.size("plain").cast("long").alias("length"), "tokens", term_counts(F.col("plain")).alias("terms"))
        self._store(documents, gen)  # the texts are read and cut into tokens once; nothing is read of it before the commit
        ids = self._stored("documents", _DOCUMENT, gen).select("doc_id")
        faults = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).collect()
        if faults:
            raise ValueError(f"a document without an id, or an id of several documents: {faults[0]['doc_id']}")
        lost, gone = self._retire(ids, gen)
        self._finish(gen, lost, gone, base=False)
        return gen

    def _finish(self, gen: int, lost: DataFrame | None, gone: int, base: bool) -> None:
        postings, documents = self._stored("postings", _POSTING, gen), self._stored("documents", _DOCUMENT, gen)
        made = postings.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"))
        if gone:
            made = made.unionByName(lost).groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"))
        self._put(made, "blocks", gen)
        self._commit(gen, base, documents.count(), gone)

    def remove(self, ids: DataFrame) -> int:
        """Remove documents by ids (doc_id); unknown ones are ignored."""
        gen = self._next()
        lost, gone = self._retire(ids.select(F.col("doc_id").cast("long")).distinct(), gen)
        self._put(self.spark.createDataFrame([], "term string, level int, n long, max_tf long") if lost is None else lost, "blocks", gen)
        self._commit(gen, False, 0, gone)
        return gen

    def compact(self) -> int:
        """Write what still counts as a new base, in one generation."""
        gen = self._next()
        self._store(self.documents().repartition("shelf").drop("shelf"), gen)
        self._finish(gen, None, 0, base=True)
        return gen

    # ---- searching -------------------------------------------------------------------

    def search(self, terms: list[str]) -> DataFrame:
        """doc_id of documents that hold every term, and score: the sum of count times inverse frequency."""
        wanted = sorted({t.lower() for t in terms})
        asked = self.spark.createDataFrame([(t,) for t in wanted], "term string")
        total = self.count()
        df = self.blocks().groupBy("term").agg(F.ln(F.lit(float(total)) / F.sum("n")).alias("idf"))
        found = self.postings(asked).join(F.broadcast(df.join(F.broadcast(asked), "term")), "term")
        rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("held"), (F.sum(micros(F.col("tf"), F.col("idf"))) / 1e6).alias("score"))
        return rows.where(F.col("held") == len(wanted)).select("doc_id", "score")

    def keyword_leg(self, queries: DataFrame, k: int = 10, trace: dict | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: the k documents with the highest sums of tf * ln(N / df), ties to the
        smaller id, per queries(query_id, text), exactly.

        1. Of each query, the blocks with the highest bounds are joined until they hold `SEED` x k postings; the
           k documents that lead after these get their whole scores from the document store.  The least of these
           is a score that k documents reach.
        2. A query's blocks are set aside, cheapest bound for each posting saved first, as long as the bounds
           set aside add up to less than that score: a document met in no other block cannot reach it.  Only the
           other blocks are joined; frequent terms stay behind but for their highest blocks.
        3. Documents whose sum over these, with all that was set aside, can still reach the k-th sum get their
           whole scores from the document store, and the best k stay.

        `trace`, if given, gets the number of postings joined in 1 and 2 and of documents scored whole."""
        asked = X.unnest(queries, ["query_id"], F.array_distinct(plain_tokens(F.col("text"))), "term")
        asked = cut_lineage(asked)
        vocabulary = cut_lineage(asked.select("term").distinct())
        total = float(self.count())
        blocks = self.blocks().join(vocabulary, "term", "left_semi")
        df = blocks.groupBy("term").agg(F.ln(F.lit(total) / F.sum("n")).alias("idf"))
        blocks = cut_lineage(blocks.join(df, "term").withColumn("bound", micros(F.col("max_tf"), F.col("idf"))))
        own = cut_lineage(asked.join(blocks, "term").select("query_id", "term", "level", "n", "bound", "idf"))
        postings = cut_lineage(vocabulary).transform(self.postings)

        def sums(chosen: DataFrame, name: str) -> DataFrame:
            met = postings.join(chosen.select("query_id", "term", "level", "idf"), ["term", "level"])
            if trace is not None:
                met = cut_lineage(met)
                trace[name] = met.count()
            return met.groupBy("query_id", "doc_id").agg(F.sum(micros(F.col("tf"), F.col("idf"))).alias("part"))

        def kth(rows: DataFrame, score: str) -> DataFrame:
            order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
            return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        asks = asked.join(df, "term").groupBy("query_id").agg(
            F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idfs")  # of one query
        )
        asks = cut_lineage(asks)

        def whole(pairs: DataFrame) -> DataFrame:
            """Pairs with their whole scores, from the stored terms of their documents."""
            if trace is not None:
                trace["whole"] = trace.get("whole", 0) + pairs.count()
            wanted = pairs.join(asks, "query_id").select("query_id", "doc_id", "idfs")
            terms = self.documents().select("doc_id", "terms").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
            met = wanted.join(terms, "doc_id")
            score = F.aggregate(
                F.filter("terms", lambda t: F.map_contains_key("idfs", t["term"])),
                F.lit(0).cast("long"),
                lambda s, t: s + micros(t["tf"], F.element_at("idfs", t["term"])),
            )
            return met.select("query_id", "doc_id", score.alias("whole"))

        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "level")
        before = F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        seeds = own.withColumn("before", before).where(F.col("before") < SEED * k)
        leaders = cut_lineage(kth(sums(seeds, "seeds"), "part").select("query_id", "doc_id"))
        reached = whole(leaders).groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("whole")).otherwise(F.lit(0)).alias("floor")
        )
        levels = Window.partitionBy("query_id", "term").orderBy("level")
        step = F.col("bound") - F.coalesce(F.lag("bound").over(levels), F.lit(0))
        cheap = Window.partitionBy("query_id").orderBy("price", "term", "level")
        steps = own.withColumn("step", step).withColumn("price", F.max(F.col("step") / F.col("n")).over(levels))
        steps = steps.withColumn("aside", F.sum("step").over(cheap.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        steps = cut_lineage(steps.join(reached, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0))))
        met = sums(steps.where("aside >= floor"), "joined")
        rest = steps.groupBy("query_id").agg(F.max("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("aside") < F.col("floor"), F.col("aside"))), F.lit(0)).alias("rest"))
        met = cut_lineage(met)
        least = kth(met, "part").groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("part")).otherwise(F.lit(0)).alias("least"))
        can = met.join(rest, "query_id").join(least, "query_id").where(F.col("part") + F.col("rest") >= F.greatest("floor", "least"))
        found = kth(whole(cut_lineage(can.select("query_id", "doc_id"))), "whole")
        return found.select("query_id", "doc_id", (F.col("whole") / 1e6).alias("score"), "rank")


def build(spark: SparkSession, root: str, parts: list[DataFrame], id_col: str = "doc_id", text_col: str = "text") -> CorpusIndex:
    """An index of the parts, added one after the other."""
    return reduce(lambda index, part: (index.add(part, id_col, text_col), index)[1], parts, CorpusIndex(spark, root))
