"""Token counts as delta-maintained rollups.

A change says that a document was inserted, deleted or counted anew. It becomes signed rows (key, documents,
tokens): an insert +1 and +tokens, a delete -1 and -tokens, a revision takes the old count and key back and
adds the new ones. A batch is the sum of its rows per (source, lang, version), so totals are the sum of all
batches in any order. A batch is committed into the folder of its id: a batch that was committed is left
alone when it comes again, one that was cut off is written over. ``fold`` sums committed batches into one
snapshot that names them, so readers never count a batch twice.

Sums are taken before the shuffle; a source that holds most rows costs one row per task.

Defined results: null source, lang or version is a key of its own; a null text has no tokens; null counts
are 0; an unknown ``op`` stops the batch; repeated change rows each count (a batch is a multiset); keys whose
documents and tokens are both 0 are left out of the totals; an empty batch is a valid commit.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import path_exists

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, documents bigint, tokens bigint"
CHANGE = ("op", "source", "lang", "version", "tokens", "old_source", "old_lang", "old_version", "old_tokens")
OPS = ("insert", "delete", "revise")


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes with the columns CHANGE; the old ones are read for revisions and deletes."""
    def row(sign: int, old: str):
        return F.struct(*[F.col(old + k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("bigint").alias("documents"),
                        (F.coalesce(F.col(old + "tokens"), F.lit(0)) * sign).cast("bigint").alias("tokens"))

    add, take = row(1, ""), row(-1, "old_")
    known = (F.when(F.col("op") == "insert", F.array(add)).when(F.col("op") == "delete", F.array(take)).when(F.col("op") == "revise", F.array(take, add))
             .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op").cast("string"), F.lit("null"))))))
    return changes.select(F.explode(known).alias("d")).select("d.*")


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept in a folder on shared storage: ``batch=<id>`` per commit and numbered snapshots."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self, batch: int) -> bool:
        return path_exists(self.spark, f"{self.path}/batch={batch}/_SUCCESS") or batch in self._folded()

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied before."""
        if self.committed(batch):
            return False
        summed(signed(changes)).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def _children(self, prefix: str) -> list[int]:
        spark, top = self.spark, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(top)]
        numbers = [int(n[len(prefix):]) for n in names if n.startswith(prefix)]
        return sorted(n for n in numbers if path_exists(spark, f"{self.path}/{prefix}{n}/_SUCCESS"))

    def _snapshot(self) -> int | None:
        return max(self._children("snapshot="), default=None)

    def _folded(self) -> set[int]:
        last = self._snapshot()
        if last is None:
            return set()
        return set(json.loads(self.spark.read.parquet(f"{self.path}/snapshot={last}").where("list IS NOT NULL").first()["list"]))

    def _live(self) -> DataFrame:
        """Rows of the last snapshot and of the batches beyond it."""
        folded, last = self._folded(), self._snapshot()
        paths = [f"{self.path}/batch={b}" for b in self._children("batch=") if b not in folded]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        if last is None:
            return rows
        return rows.unionByName(self.spark.read.schema(f"{DELTA}, list string").parquet(f"{self.path}/snapshot={last}").where("list IS NULL").drop("list"))

    def fold(self) -> None:
        """Write the next snapshot; earlier folders stay readable until they are removed."""
        folded = self._folded() | set(self._children("batch="))
        names = self.spark.createDataFrame([(json.dumps(sorted(folded)),)], "list string")
        rows = summed(self._live()).unionByName(names, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshot={(self._snapshot() or 0) + 1}")

    def totals(self) -> DataFrame:
        return summed(self._live()).where("documents <> 0 OR tokens <> 0")


def changes_of(docs: DataFrame, op: str, tokens, version: str, old_tokens=None, old_version: str | None = None) -> DataFrame:
    """Change rows of documents (source, lang, text) whose key did not move."""
    old = F.lit(None).cast("bigint") if old_tokens is None else old_tokens
    return docs.select(F.lit(op).alias("op"), F.col("source"), F.col("lang"), F.lit(version).alias("version"), tokens.alias("tokens"),
                       F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(old_version).alias("old_version"), old.alias("old_tokens"))
