"""Lines that an earlier document holds already, by levelled sorted runs.  DataFrame functions only.

Documents are cut into ``batches`` ranges of doc_id.  The store keeps, for every line key
seen so far, the first document that holds it, in runs: tables bucketed and sorted by the
key's hash, no key in two runs.  A batch is reduced to one row for each of its keys
(combined in the tasks before the shuffle), anti-joined with the runs bucket by bucket,
which moves no run, and what is new becomes the batch's own run.  ``fanout`` runs of one
level are compacted into one of the next, so a batch meets few runs.  As batches follow
doc_id, the run that first took a key names its first document for good.

A line is dropped if its key is in an earlier run or its batch holds the key in a lesser
document.  Only the keys for which that happens meet the batch's lines again; that join
has one row for a key on one side, so adaptive execution splits the lines of a hot one.
Documents meet the positions of their dropped lines once, and are otherwise left alone.

A key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
lower-cased; keys under ``least`` code points never drop.  Keys are compared by the first
128 bits of their sha256.  Null and empty texts have one empty line (a null text stays
null in ``deduplicated``).  Rows with the same doc_id are one document: they hold a line
together, and each drops the lines that a lesser doc_id holds.  A null doc_id is less than
any other.  An empty table gives no rows.  Columns besides doc_id and text come along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm.common import partitions, table
from canlake.storage import scratch_path, settle

LEAST = 10
BATCHES = 6
FANOUT = 3

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_ID = -(1 << 63)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that to a text of ASCII alone."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def holder() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))


def text_lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def text_mark() -> Column:
    """Tells apart the texts of rows with one doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def batch_cuts(docs: DataFrame, batches: int) -> list[int]:
    """Quantiles of doc_id; any cuts give the same result, even ones give batches of like size."""
    if batches < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 100 * batches)).first()[0]
    return sorted(set(found or []))


def keyed_lines(docs: DataFrame, cuts: list[int], least: int = LEAST) -> list[DataFrame]:
    """For each batch, (holder, mark, pos, key) of the lines that can drop; written once, by batch."""
    spark = docs.sparkSession
    batch = sum(((F.col("holder") >= cut).cast("int") for cut in cuts), F.lit(0))
    lines = docs.select(holder().alias("holder"), text_mark().alias("mark"), F.posexplode(text_lines()).alias("pos", "line"))
    keys = lines.select("holder", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    hashed = keys.withColumn("key", F.unhex(F.substring(F.sha2("key", 256), 1, 32))).withColumn("batch", batch)
    path = scratch_path(spark, "line-keys")
    hashed.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    stored = spark.read.schema("holder long, mark long, pos int, key binary, batch int").parquet(path)
    return [stored.where(F.col("batch") == b).drop("batch") for b in range(len(cuts) + 1)]


class LineRuns:
    """Runs of (key, first, last, known), bucketed and sorted by key; ``first`` and ``last`` are documents of one batch.

    A run holds its keys that are not ``known``, and besides, until it is compacted, those
    that earlier runs hold.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _written(self, rows: DataFrame) -> DataFrame:
        name = f"canlake_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, "line-run")
        rows.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay, and ``run`` knows them and their buckets
        return run

    def add(self, lines: DataFrame) -> DataFrame:
        """(holder, mark, pos) of the lines of the next batch that are dropped; its new keys become a run."""
        keys = lines.groupBy("key").agg(F.min("holder").alias("first"), F.max("holder").alias("last"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.where(~F.col("known")).select("key", F.lit(True).alias(f"in_{i}")), "key", "left")
            known = known | F.coalesce(f"in_{i}", F.lit(False))
        own = self._written(keys.select("key", "first", "last", known.alias("known")))
        dropping = own.where(F.col("known") | (F.col("last") > F.col("first")))
        least = F.when(F.col("known"), F.lit(None).cast("long")).otherwise(F.col("first"))
        dropping = settle(dropping.select("key", least.alias("first")), "line-dropping")
        dropped = settle(
            lines.join(dropping, "key").where(F.col("first").isNull() | (F.col("holder") > F.col("first"))).select("holder", "mark", "pos"),
            "line-drops",
        )
        self._keep(own, 0)
        return dropped

    def _keep(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)

    def compact(self) -> None:
        """Merges every full level into one run of the next."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                merged = self.levels[level][0].where(~F.col("known"))
                for run in self.levels[level][1:]:
                    merged = merged.unionByName(run.where(~F.col("known")))
                self.levels[level] = []
                self._keep(self._written(merged.repartition(self.buckets, "key")), level + 1)


def with_kept_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(row, text, n_lines, n_dropped): ``row`` has the other columns of a document, ``text`` the lines that stay."""
    spark = docs.sparkSession
    groups = keyed_lines(docs, batch_cuts(docs, batches), least)
    store, drops = LineRuns(spark, partitions(docs), fanout), None
    for i, lines in enumerate(groups):
        found = store.add(lines)
        drops = found if drops is None else drops.union(found)
        if i + 1 < len(groups):
            store.compact()
    gone = drops.groupBy("holder", "mark").agg(F.collect_set("pos").alias("gone"))
    rest = [docs[c] for c in docs.columns if c != "text"]
    parted = docs.select(F.struct(*rest).alias("row"), holder().alias("holder"), text_mark().alias("mark"), "text", text_lines().alias("lines"))
    joined = parted.join(gone, ["holder", "mark"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents with the lines that stay as their texts."""
    found = with_kept_lines(docs, **options)
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents."""
    found = with_kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP12_SQL = """
WITH parted AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parted
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, coalesce(doc_id > first, false) AS dropped FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
