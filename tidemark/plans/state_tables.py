"""Persisted tables of the state board: written by micro-batch, published by manifest, each batch once.

A batch writes its rows into folders of its own and then renames a manifest into
place that names the folders of every table. What a stopped attempt has written
is in no manifest, so a rerun gives the same tables; a batch that a manifest
already holds is not applied again. All tables change together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import state

WRITE = "episode_id long, customer_id string, field_path string, value string, confidence double, agent string, t long"
SCHEMAS = {
    "writes": f"{WRITE}, conflict_with string, expected long, ok boolean, actual long",
    "conflicts": "conflict_id long, customer_id string, field_path string, agents array<string>, values array<string>",
    "versions": "customer_id string, state_version long",
}


class StateTables:
    """``writes`` with their outcome, ``conflicts`` and ``versions`` below one folder, for a single writer and any readers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The latest manifest: ``version``, the folders of each table, and the last batch of each writer."""
        fs, at = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        versions = [int(n) for n in names if n.isdigit()]
        if not versions:
            return {"version": 0, "folders": {t: [] for t in SCHEMAS}, "batches": {}}
        text = self.spark.read.text(f"{self.root}/manifest/{max(versions)}", wholetext=True).first()[0]
        return json.loads(text)

    def publish(self, manifest: dict) -> None:
        """Write the manifest aside and rename it into place."""
        aside = f"aside-{uuid.uuid4().hex}"
        out = self._fs().create(self._path("manifest", aside, "part"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs().rename(self._path("manifest", aside), self._path("manifest", str(manifest["version"]))):
            raise RuntimeError(f"another writer published version {manifest['version']}")

    # --- reading

    def read(self, table: str) -> DataFrame:
        folders = self.manifest()["folders"][table]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{f}" for f in folders])

    def log(self) -> DataFrame:
        """Accepted writes."""
        return self.read("writes").where("ok").select(*[c.split()[0] for c in WRITE.split(", ")])

    def refused(self) -> DataFrame:
        return self.read("writes").where("not ok")

    def versions(self) -> DataFrame:
        """Each customer's version; batches append, the greatest counts."""
        return self.read("versions").groupBy("customer_id").agg(F.max("state_version").alias("state_version"))

    # --- writing

    def apply(self, writes: DataFrame, batch_id: int, writer: str = "stream") -> bool:
        """Apply a batch of writes ``(WRITE, expected, conflict_with)`` in order; false if it was applied before."""
        now = self.manifest()
        if batch_id <= now["batches"].get(writer, -1):
            return False
        folder = f"data/{writer}-{batch_id}-{uuid.uuid4().hex}"

        def put(table: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{self.root}/{folder}/{table}")
            now["folders"][table].append(f"{folder}/{table}")
            return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{folder}/{table}")

        log, versions = self.log(), self.versions()
        cols = [c.split()[0] for c in SCHEMAS["writes"].split(", ")]
        done = put("writes", state.versioned(writes, versions).select(*cols))
        taken = done.where("ok")
        paths = taken.select(*state.PATH).distinct()
        held = log.join(paths, [*state.PATH], "left_semi")
        last = held.groupBy(*state.PATH).agg(F.max_by(F.struct("episode_id", "value", "agent"), "episode_id").alias("w")).select(*state.PATH, "w.*")
        put("conflicts", state.write_conflicts(last, taken))
        put("versions", taken.groupBy("customer_id").agg((F.max("actual") + 1).alias("state_version")))
        now["version"] += 1
        now["batches"][writer] = batch_id
        self.publish(now)
        return True

    def compact(self) -> None:
        """One folder a table, each customer's greatest version alone; older folders stay for readers that hold them."""
        now = self.manifest()
        folder = f"data/compact-{uuid.uuid4().hex}"
        for table, df in (("writes", self.read("writes")), ("conflicts", self.read("conflicts")), ("versions", self.versions())):
            if now["folders"][table]:
                df.write.parquet(f"{self.root}/{folder}/{table}")
                now["folders"][table] = [f"{folder}/{table}"]
        now["version"] += 1
        self.publish(now)

    def sink(self, writes: DataFrame, checkpoint: str, name: str = "stream", after: Callable[[int], None] | None = None) -> StreamingQuery:
        """Start a query that applies a stream of writes, drained and then stopped."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id, name)
            if after:
                after(batch_id)

        return writes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
