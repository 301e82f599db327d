"""Streams into and out of stored objects.

`append_stream` writes each micro-batch of a stream as one fragment, exactly once: the fragment's log entry itself names the streaming query (the id that its
checkpoint holds) and the batch, and a batch that is in the log already is left out when a restarted query repeats it.  Two queries, or a query begun
anew with an empty checkpoint, have different ids, whatever their checkpoints' paths are.

`follow` reads new fragments of an object as a stream.  It sees every fragment once, after its rows were found right; fragments that a consolidation
makes lie elsewhere, so no row comes again.  A consolidation deletes what it replaces: follow first, consolidate later.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame as Frame
from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter

from matrella.api.objects import FRAG, TS, StoredArray, session, types


def append_stream(stream: Frame, array: StoredArray, checkpoint: str) -> DataStreamWriter:
    """A writer, ready to be started, that upserts the stream's rows into the array."""
    uri, cls, spark = array.uri, type(array), array.spark

    def write(batch: Frame, number: int) -> None:
        target = cls.open(uri, "w", spark=spark)
        query = json.loads(target.log.files.read(f"{checkpoint.rstrip('/')}/metadata").strip().splitlines()[-1])["id"]
        if target.state.streams.get(query, -1) < number and not batch.isEmpty():
            target._write(target._completed(batch), stream=query, batch=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def follow(array: StoredArray, spark: SparkSession | None = None) -> Frame:
    """Rows of fragments as they are written, with __ts; versions are not resolved, as a stream has no latest row."""
    struct = types.struct(array.state.schema)
    physical = types.T.StructType([*struct.fields, types.T.StructField(TS, types.T.LongType()), types.T.StructField(FRAG, types.T.StringType())])
    array.log.files.folder(f"{array.uri}/frag")
    return session(spark or array.spark).readStream.schema(physical).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{array.uri}/frag").drop(FRAG)
