"""Lines that many documents share, found by levelled sorted runs of line hashes.

A run is a table (h1, h2, n): the 128-bit hash of a line's key and in how many documents it was counted. Runs are bucketed and sorted by
the hash, so two of them meet in a merge join without shuffle or sort. A new batch of documents is counted once, merge-anti-joined
with the runs, which drops hashes known to be frequent, and becomes a run of level 0. Two runs of one level are merged into one of the
next, so there are never more runs than the logarithm of the number of batches.

All of it is DataFrame functions; there is no Python in the row path.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martloom.llm.common import ascii_lower, stored, texts
from martloom.sources.storage import Folder, shared_folder

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
WHITE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
# Sorted buckets are read in their order only with this setting.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def line_counts(docs: DataFrame, min_chars: int, *by: str) -> DataFrame:
    """(by, h1, h2, n): in how many rows of (doc_id, text) a key occurs; a row counts once however often it has the line."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    rows = docs.select(*by, F.explode(keys).alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select(*by, *_hashed(F.col("key"))).groupBy(*by, *HASH).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Levelled runs in the shared folder; ``close`` removes them."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self._tables: dict[str, str] = {}
        self._ordered = spark.conf.get(_ORDERED)
        spark.conf.set(_ORDERED, "true")

    def _write(self, df: DataFrame, *parts: str) -> str:
        """One sorted file for each bucket (and part)."""
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_ = df.repartition(self.buckets, *HASH).sortWithinPartitions(*parts, *HASH)
        self._tables[name] = shared_folder(self.spark, name)
        writer = sorted_.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self._tables[name])
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        return name

    def _remove(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            Folder(self.spark, self._tables.pop(name)).remove()

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Count the lines of a batch of documents."""
        self.add_counts(line_counts(texts(docs, id_col, text_col), self.min_chars))

    def add_all(self, docs: DataFrame, batches: int = BATCHES) -> None:
        """Add (doc_id, text) in batches of rows; all of them are counted in one pass over the documents."""
        batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
        staged = self._write(line_counts(docs.select(batch, "text"), self.min_chars, "batch"), "batch")
        for number in range(batches):
            self.add_counts(self.spark.table(staged).where(F.col("batch") == number).drop("batch"))

    def add_counts(self, counts: DataFrame) -> None:
        """A new run of what the runs do not yet know as frequent; equal levels are merged upwards."""
        for run in filter(None, self.levels):
            known = self.spark.table(run).where(F.col("n") >= self.min_docs).select(*HASH)
            counts = counts.join(known.hint("merge"), HASH, "left_anti")
        new, level = self._write(counts), 0
        while level < len(self.levels) and self.levels[level]:
            new = self._merge(self.levels[level], new)
            self.levels[level] = None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = new

    def _merge(self, old: str, new: str) -> str:
        a, b = self.spark.table(old).withColumnRenamed("n", "a"), self.spark.table(new).withColumnRenamed("n", "b")
        total = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
        both = self._write(a.join(b.hint("merge"), HASH, "full").select(*HASH, total.alias("n")))
        self._remove(old, new)
        return both

    def frequent(self) -> DataFrame:
        """(h1, h2) of all keys that ``min_docs`` documents have."""
        live = [run for run in self.levels if run]
        if not live:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        while len(live) > 1:
            live = [self._merge(live[0], live[1]), *live[2:]]
        self.levels = live
        return stored(self.spark.table(live[0]).where(F.col("n") >= self.min_docs).select(*HASH), "frequent-lines")

    def close(self) -> None:
        self._remove(*list(self._tables))
        self.spark.conf.set(_ORDERED, self._ordered)


def drop_frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                        min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): texts without the lines whose key at least ``min_docs`` documents have.

    Every row is a document, also one that repeats another row or its id, and a null id. A null or empty text is one empty line. Keys
    shorter than ``min_chars`` code points stay. A text that loses all its lines becomes empty. No rows give no rows.
    """
    docs = texts(df, id_col, text_col)
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    try:
        runs.add_all(docs, batches)
        frequent = runs.frequent()
    finally:
        runs.close()
    marked = docs.withColumn("mark", F.xxhash64("text"))
    # Rows of equal id and text have the same places, so their lists are one.
    at = marked.select("doc_id", "mark", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "line"))
    at = at.where(F.char_length("line") >= min_chars).select("doc_id", "mark", "pos", *_hashed(F.col("line")))
    gone = at.join(frequent, HASH, "left_semi").groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"))
    gone = gone.agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    joined = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1
    rest = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    # As the one element of an array the lines are split once, not anew for each place.
    kept = F.transform(F.array(lines_of(F.col("text"))), lambda lines: F.array_join(F.transform(rest(lines), lambda p: F.get(lines, p)), "\n"))[0]
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
                         n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def oracle_sql(min_docs: int = MIN_DOCS) -> str:
    white = "||".join(f"chr({ord(c)})" for c in WHITE)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {white}), '{upper}', '{upper.lower()}') AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= {min_docs})
        SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f ON k.key = f.key GROUP BY rid, k.doc_id"""
