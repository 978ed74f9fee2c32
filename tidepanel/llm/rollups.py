"""Token counts as additive totals that signed batches maintain."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import WORD

#: Counts of a text by tokenizer version: words, and words apart from the ASCII punctuation around them.
COUNTERS = {"words-1": WORD, "words-2": r"[A-Za-z0-9\x80-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}
KEYS = ["source", "lang", "tokenizer"]


def counted(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a tokenizer version; of a null text 0."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[tokenizer])), F.lit(0)).cast("long")


def inserts(docs: DataFrame, tokenizer: str, text: Column, sign: int = 1) -> DataFrame:
    """Signed delta rows (source, lang, tokenizer, docs, tokens): +1 document and its tokens each."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (sign * counted(text, tokenizer)).alias("tokens"))


def deletes(docs: DataFrame, tokenizer: str, text: Column) -> DataFrame:
    """Signed delta rows that take documents out again."""
    return inserts(docs, tokenizer, text, -1)


def revisions(docs: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """Signed delta rows for documents whose text changed: no document more or less, the new count less the old one."""
    changed = counted(new, tokenizer) - counted(old, tokenizer)
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"), changed.alias("tokens"))


class Rollup:
    """Totals of signed batches in a folder that all executors share.

    commit() sums a batch by key (map-side combined, so that a hot source is a few rows a task), writes the sums to a staging folder of
    its own and moves that to the batch's id. The move is the commit: it fails if the id is there, so of two committers of an id one wins,
    a batch that was committed before isn't applied again, a job that is lost before it leaves nothing that totals() reads, and a rerun starts over.
    compact() moves in a generation, the sums and the ids they cover, and only then deletes what is covered. totals() adds up the generation that
    covers most and the batches that it doesn't cover, so it is right before, between and after these steps.
    A null source or language is a key like others. A key whose documents have all gone stays with totals 0. Columns other than the
    five of the deltas are ignored.
    """

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        jvm = spark.sparkContext._jvm
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for folder in ("batches", "generations", "staged"):
            self._fs.mkdirs(self._of(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._of(f"{self.path}/{folder}")))

    def _moved(self, staged: str, place: str) -> bool:
        """Whether this call put the staged folder in its place; False if there is one already, which stays as it is."""
        try:
            self._context.rename(self._of(staged), self._of(place), self._plain)
            return True
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            self._fs.delete(self._of(staged), True)
            return False

    def _generation(self) -> tuple[str | None, set[str]]:
        """The generation that covers most batches, and these."""
        found = [(set(self._names(f"generations/{g}/covers")), g) for g in self._names("generations")]
        covers, name = max(found, key=lambda x: (len(x[0]), x[1]), default=(set(), None))
        return name, covers

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._of(f"{self.path}/batches/{batch}")) or batch in self._generation()[1]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Applies a batch once; False if its id has been committed before, by this or another committer. Commits may run beside each other, but not beside compact()."""
        if self.committed(batch):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        summed.coalesce(1).write.parquet(staged)
        return self._moved(staged, f"{self.path}/batches/{batch}")

    def totals(self) -> DataFrame:
        generation, covers = self._generation()
        paths = [f"{self.path}/batches/{n}" for n in self._names("batches") if n not in covers]
        if generation:
            paths.append(f"{self.path}/generations/{generation}/sums")
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self, name: str) -> None:
        """Replaces the batches by a generation of their sums. A compaction that is lost at any step is run again, under the same name or another; each later one takes a new name."""
        before, covers = self._generation()
        if before != name:
            staged = f"{self.path}/staged/{uuid.uuid4().hex}"
            self.totals().coalesce(1).write.parquet(f"{staged}/sums")
            self._fs.mkdirs(self._of(f"{staged}/covers"))
            for batch in covers | set(self._names("batches")):
                self._fs.mkdirs(self._of(f"{staged}/covers/{batch}"))
            if not self._moved(staged, f"{self.path}/generations/{name}"):
                raise ValueError(f"{name} is the name of an earlier compaction")
        now, covers = self._generation()
        for batch in covers & set(self._names("batches")):
            self._fs.delete(self._of(f"{self.path}/batches/{batch}"), True)
        for generation in self._names("generations"):
            if generation != now:
                self._fs.delete(self._of(f"{self.path}/generations/{generation}"), True)
