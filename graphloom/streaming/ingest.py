"""New files as they come, through the same steps as a batch.

The stream's checkpoint remembers which files were read; each micro-batch goes
through the resumable steps, so a batch that is repeated after a failure
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.config import DEFAULTS, Settings
from graphloom.plans import ingest
from graphloom.sources.files import stream_documents
from graphloom.sources.providers import EmbeddingProvider, Extractor
from graphloom.sources.store import Store


def follow_folder(store: Store, folder: str, checkpoint: str, provider: EmbeddingProvider, extractor: Extractor | None = None, s: Settings = DEFAULTS, once: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Starts the stream; with ``once`` it ends when all files there now are read."""

    def batch(docs: DataFrame, _: int) -> None:
        ingest.run(store, docs, provider, extractor, s=s)

    writer = stream_documents(store.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
