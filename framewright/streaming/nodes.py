"""Extension beyond batch scoring: follow a job folder and hand on each node when it completes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framewright.sources.jobs import NODE

#: The nodes that a job needs before it can be scored.
KINDS = ("prep", "topo", "prod")
READY = "job string, prep string, topo string, prod string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def completed_nodes(spark: SparkSession, job_dir: str) -> DataFrame:
    """A stream of completed nodes; node.json files are picked up as they appear (a file is read once)."""
    files = spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "node.json").format("text").load(f"{job_dir}/nodes")
    rows = files.select(F.from_json("value", NODE).alias("n"), F.col("_metadata.file_path").alias("path"))
    return rows.select("path", "n.*").where("status = 'completed'")


def on_completion(spark: SparkSession, job_dir: str, checkpoint: str, act: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Calls act(batch, id) for newly completed nodes; the checkpoint makes a restart go on where it stopped."""
    out = completed_nodes(spark, job_dir).writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


class ReadyJob(StatefulProcessor):
    """Keeps a job's completed nodes, of each kind the last in path order, and hands the job on once it has one of each kind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "kind string", "path string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for part in rows:
            for kind, path in zip(part["node_type"], part["path"], strict=True):
                if kind in KINDS and (not self.nodes.containsKey((kind,)) or self.nodes.getValue((kind,))[0] < path):
                    self.nodes.updateValue((kind,), (path,))
        if not self.done.exists() and all(self.nodes.containsKey((k,)) for k in KINDS):
            self.done.update((True,))
            yield pd.DataFrame([(key[0], *(self.nodes.getValue((k,))[0] for k in KINDS))], columns=["job", *KINDS])

    def close(self) -> None:
        pass


def ready_jobs(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the jobs below `root` (<job>/nodes/<node>/node.json), each once, when its prep, topo and prod nodes are complete.

    State is keyed by job in RocksDB, so jobs in flight are bounded by disk, not memory; a restart goes on from the checkpoint.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    files = spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", "node.json").format("text").load(f"{root}/*/nodes/*")
    rows = files.select(F.from_json("value", NODE).alias("n"), F.col("_metadata.file_path").alias("path")).where("n.status = 'completed'")
    keyed = rows.select(F.regexp_replace("path", "/nodes/[^/]*/node\\.json$", "").alias("job"), "n.node_type", F.regexp_replace("path", "/node\\.json$", "").alias("path"))
    return keyed.groupBy("job").transformWithStateInPandas(ReadyJob(), READY, "Append", "None")
