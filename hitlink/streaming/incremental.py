"""Resumable, idempotent runs.

I1-I3 are anti-joins against what earlier runs wrote. I4 runs the linkage as a
Structured Streaming job over a file source with ``trigger(availableNow=True)``:
the checkpoint location records which files were processed, so a restarted job
resumes where it stopped. Which keys the sink holds is streaming state (one
entry a key, by key hash, in the checkpoint), so a batch touches the state of
its own keys and never reads the sink. Each batch overwrites a folder of its
own (query id, batch number): ``foreachBatch`` is at-least-once, and a replayed
batch replaces itself.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.setops import not_present
from ..session import checkpoint_dir


def pending(todo: DataFrame, outputs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of ``todo`` whose key is in none of the earlier outputs."""
    out = todo
    for o in outputs:
        out = not_present(out, o, keys)
    return out


def pending_groups(todo: DataFrame, output: DataFrame, group: str) -> DataFrame:
    """Skip whole groups (e.g. years) already present in the output."""
    done = output.select(group).distinct()
    return not_present(todo, done, [group])


def append_new_keys(spark: SparkSession, batch: DataFrame, sink: str, keys: Sequence[str]) -> None:
    """Append the rows whose key the sink does not hold yet (idempotent)."""
    from ..sources.io import path_exists
    new = batch
    if path_exists(spark, sink):
        new = not_present(new, spark.read.parquet(sink), keys)
    new.write.mode("append").parquet(sink)


RUN, EPOCH = "sink_run", "sink_epoch"  # the sink's folders


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """The rows that ``run_incremental`` has written."""
    return spark.read.parquet(sink).drop(RUN, EPOCH)


def write_epoch(batch: DataFrame, sink: str, run: str, epoch_id: int) -> None:
    """A batch's own folder: written anew whenever the batch is run again."""
    batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/{RUN}={run}/{EPOCH}={epoch_id}")


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps over restarts from its checkpoint."""
    return json.loads("".join(r.value for r in spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()))["id"]


def run_incremental(spark: SparkSession, source: str, schema: T.StructType,
                    transform: Callable[[DataFrame], DataFrame], keys: Sequence[str],
                    sink: str | None = None, checkpoint: str | None = None,
                    max_files_per_trigger: int = 1, file_filter: str | None = None) -> str:
    """I4: process every file available under ``source`` in micro-batches and
    return the sink path (see ``read_sink``). Of rows with the same ``keys`` the
    sink gets one, NULL being a key part like any other. Re-running with the same
    sink and checkpoint processes only new files; a replayed batch adds nothing.
    With a new checkpoint, rows whose key an earlier run has written are left out
    by a join with those runs, which do not grow while this one runs. ``transform``
    works row by row or joins static frames. ``source`` is a folder;
    ``file_filter`` (a glob on file names) picks files inside it."""
    from ..sources.io import path_exists
    base = f"{checkpoint_dir(spark).rstrip('/')}/incremental/{uuid.uuid4().hex}"
    sink = sink or f"{base}/sink"
    checkpoint = checkpoint or f"{base}/checkpoint"
    run = _query_id(spark, checkpoint) if path_exists(spark, f"{checkpoint.rstrip('/')}/metadata") else None
    earlier = None
    if path_exists(spark, sink):
        earlier = spark.read.parquet(sink)
        earlier = earlier.where(F.col(RUN) != run) if run else earlier
        earlier = earlier.select(*keys) if earlier.limit(1).count() else None

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    rows = transform(reader.parquet(source)).dropDuplicates(list(keys))

    def each(batch: DataFrame, epoch_id: int) -> None:
        new = batch if earlier is None else not_present(batch, earlier, keys)
        write_epoch(new, sink, _query_id(spark, checkpoint), epoch_id)

    q = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sink
