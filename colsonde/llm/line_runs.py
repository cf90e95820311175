"""Line dedup against levelled sorted runs of line hashes; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsonde.llm import common

#: Keys that are broadcast at most, of some 40 bytes each.
SENT = 100_000
#: Seeds the second hash of a key, so that a key is 128 bits.
_SECOND = 0x5EED


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return common.ascii_lower(F.btrim(line, F.lit(common.WHITE)))


def _key_struct(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(_SECOND), key).alias("k2"))


class LineRuns:
    """Sorted runs of line keys in the shared folder, in levels as a log-structured merge tree.

    A run holds each key once: (k1, k2, n_docs, keeper, fresh), sorted within its hash ranges.
    A new batch is merge-anti-joined with all runs to find keys never seen before, and is then
    added as a run of its own; ``fanout`` runs of one level are merged into one of the next.
    Batches are disjoint in documents, so counts add up and keepers are largest over runs.
    """

    def __init__(self, spark, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def _write(self, run: DataFrame) -> str:
        path = common.scratch(self.spark, "line-run")
        run.sortWithinPartitions("k1", "k2").write.parquet(path)
        return path

    def keys(self) -> DataFrame | None:
        """All runs, one row a key and run."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def absorb(self, batch: DataFrame) -> None:
        """Add the postings (k1, k2, doc_id) of all rows of some documents that no run holds yet."""
        # Each document once; then a key held by a third of them is already counted before it is dealt.
        mine = batch.distinct().groupBy("k1", "k2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        seen = self.keys()
        if seen is None:
            run = mine.withColumn("fresh", F.lit(True))
        else:
            mine = common.settle(mine, "line-batch")
            known = seen.select("k1", "k2").hint("merge")
            fresh = mine.join(known, ["k1", "k2"], "left_anti").withColumn("fresh", F.lit(True))
            again = mine.join(known, ["k1", "k2"], "left_semi").withColumn("fresh", F.lit(False))
            run = fresh.unionByName(again)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(run))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            path = self._write(self._merged(self.spark.read.parquet(*old)))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(path)
            for p in old:
                common.discard(p)
            level += 1

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh"))

    def common_keys(self, min_docs: int) -> DataFrame:
        """(k1, k2, n_docs, keeper) of keys held by ``min_docs`` documents or more."""
        merged = self._merged(self.keys())
        return merged.where(F.col("n_docs") >= min_docs).select("k1", "k2", "n_docs", "keeper")


def _long_enough(line: Column, min_chars: int) -> Column:
    return F.char_length(F.btrim(line, F.lit(common.WHITE))) >= min_chars


def _postings(docs: DataFrame, lines: Column, min_chars: int, batches: int) -> DataFrame:
    """(batch, k1, k2, doc_id), each key once a row of ``docs``; rows of one doc_id are in one batch."""
    keys = F.array_distinct(F.transform(F.filter(lines, lambda x: _long_enough(x, min_chars)), _key_struct))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    return docs.select(batch.alias("batch"), "doc_id", F.explode(keys).alias("k")).select("batch", "k.k1", "k.k2", "doc_id")


def _hits(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """``lines`` (k1, k2, ...) of the common keys, with their keepers.

    Up to SENT keys are broadcast. Of more, those that more than one in SENT lines has, which
    cannot be more than SENT, are broadcast; the others are shuffled, none of them being hot.
    """
    n, held = gone.agg(F.count(F.lit(1)), F.sum("n_docs")).first()
    if n <= SENT:
        return lines.join(F.broadcast(gone), ["k1", "k2"])
    hot = F.col("n_docs") > held // SENT
    tagged = lines.join(F.broadcast(gone.where(hot).withColumn("__hot", F.lit(True))), ["k1", "k2"], "left")
    rest = tagged.where("__hot IS NULL").select(*lines.columns).join(gone.where(~hot), ["k1", "k2"])
    return tagged.where("__hot").drop("__hot").unionByName(rest)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, column: str = "text") -> DataFrame:
    r"""Drop lines found in many documents, but for the document of the largest doc_id.

    Lines are split at \n. A line's key has no ASCII white space at the ends and A-Z
    lower-cased. Keys of ``min_chars`` code points that at least ``min_docs`` documents hold lose
    all their lines except in the document of the largest doc_id holding them. Batches are
    documents by hash of doc_id, absorbed one after the other into :class:`LineRuns`.

    Returns the columns of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added;
    columns of these names are replaced. A null or empty text is one empty line, kept as ''.
    Rows of one doc_id, of any type that has an order, are one document: they count once, and
    all keep the lines that it keeps. Rows of null doc_id count as no document, and lose the
    lines of keys that enough others hold.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    spark = docs.sparkSession
    lines = F.split(common.text_of(column), "\n", -1)
    path = common.scratch(spark, "line-postings")
    _postings(docs, lines, min_chars, batches).write.partitionBy("batch").parquet(path)
    kinds = f"k1 bigint, k2 bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, batch int"
    postings = spark.read.schema(kinds).parquet(path)
    runs = LineRuns(spark)
    for k in range(batches):
        runs.absorb(postings.where(F.col("batch") == k).drop("batch"))
    common.discard(path)
    gone = common.settle(runs.common_keys(min_docs), "line-common")

    # Where the lines to drop stand: positions within the text, under 128 bits of (doc_id, text).
    # Settled, so that their size is known: Spark moves the texts only if it is no small one.
    row_key = [F.xxhash64("doc_id", common.text_of(column)).alias("__r1"), F.xxhash64(F.lit(_SECOND), "doc_id", common.text_of(column)).alias("__r2")]
    each = (
        docs.select("doc_id", *row_key, F.posexplode(lines).alias("__at", "__line"))
        .where(_long_enough(F.col("__line"), min_chars))
        .select("doc_id", "__r1", "__r2", "__at", _key_struct(F.col("__line")).alias("k"))
        .select("doc_id", "__r1", "__r2", "__at", "k.k1", "k.k2")
    )
    places = (
        _hits(each, gone)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("__r1", "__r2")
        .agg(F.sort_array(F.collect_set("__at")).alias("__gone"))
    )
    split = docs.select("*", *row_key).join(common.settle(places, "line-places"), ["__r1", "__r2"], "left").withColumn("__lines", lines)
    # Kept lines lie between dropped positions: slices of the array, in time linear in its length.
    n, lost = F.size("__lines"), F.coalesce("__gone", F.array().cast("array<int>"))
    before = F.concat(F.array(F.lit(-1)), lost)
    after = F.concat(lost, F.array(n))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice(F.col("__lines"), a + 2, b - a - 1)))
    return split.select(
        *[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns],
        n.cast("bigint").alias("n_lines"),
        F.size(lost).cast("bigint").alias("n_dropped"),
        F.array_join(F.when(F.size(lost) == 0, F.col("__lines")).otherwise(kept), "\n").alias("kept_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
