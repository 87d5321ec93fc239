"""A stored property graph that takes batches of facts: merged into bucketed node and edge tables, version by version.

A version is a small JSON manifest: for each table and bucket the folder that holds it,
and the batches applied. A merge reads the buckets it touches, writes them anew in a
new folder, and commits by creating the next manifest, which fails if another writer was
first (the merge is then made again on what that one left). Readers keep the version they
began with; a batch that was applied before changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.facts import graph_tables
from panelforge.sources.scratch import written

TABLES = {"nodes": ("label STRING, name STRING", ["label", "name"]), "edges": ("fact STRING, label STRING, name STRING", ["fact"])}


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifest"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> dict:
        """The latest whole manifest."""
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))), reverse=True)
        for name in names:
            if name.endswith(".json"):
                stream = self._fs.open(self._at(f"manifest/{name}"))
                try:
                    text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                if text.endswith("\n"):  # else its writer has not ended
                    return json.loads(text)
        return {"version": 0, "applied": [], **{t: {} for t in TABLES}}

    def _commit(self, manifest: dict) -> bool:
        path = self._at(f"manifest/{manifest['version']:012d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray((json.dumps(manifest) + "\n").encode()))
        stream.close()
        return True

    def table(self, name: str, buckets: list[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table as of a manifest (the latest), or some of its buckets."""
        folders = (manifest or self.manifest())[name]
        paths = [f for b, f in folders.items() if buckets is None or b in buckets]
        schema = TABLES[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, batch: str, facts: DataFrame) -> bool:
        """Adds what ``facts`` (ticker, quarter, metric, value, reason) has and the graph lacks; False if ``batch`` was applied before."""
        if batch in self.manifest()["applied"]:
            return False
        new = {n: written(df.withColumn("bucket", F.pmod(F.xxhash64(*TABLES[n][1]), F.lit(self.buckets)).cast("string"))) for n, df in zip(TABLES, graph_tables(facts), strict=True)}
        touched = {n: [r[0] for r in df.select("bucket").distinct().collect()] for n, df in new.items()}  # as many as buckets at most
        while True:
            old = self.manifest()
            if batch in old["applied"]:
                return False
            now = {"version": old["version"] + 1, "applied": [*old["applied"], batch]}
            for n, (_, keys) in TABLES.items():
                before = self.table(n, touched[n], old).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("string"))
                folder = f"{self.path}/{n}/{uuid.uuid4().hex}"
                before.unionByName(new[n]).distinct().repartition("bucket").write.partitionBy("bucket").parquet(folder)
                now[n] = old[n] | {b: f"{folder}/bucket={b}" for b in touched[n]}
            if self._commit(now):
                return True
