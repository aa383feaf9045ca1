"""The queue of chunks that wait for their vectors: bounded, first in first out, as the state of a stream of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkspan.functions.chunks import chunks
from larkspan.streaming.running import start, write_batches

#: At most so many chunks wait for each index, and the model gets so many texts at once; fixed values.
PENDING, BATCH = 256, 8
#: A text is cut to its first so many characters for the model.
LONGEST = 512
EVENTS = "scope string, kind string, doc_id string, chunk_id string, text string, reason string"


class QueueProcessor(StatefulProcessor):
    """State of an index: its waiting chunks by number, and the numbers of the first and of the next to come.

    Each time the index comes up, by new documents or by a timer, up to `served` waiting chunks leave for the model, then
    documents are admitted as a whole or not at all.
    """

    def __init__(self, pending: int, served: int):
        self.pending, self.served = pending, served

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "number long", "doc_id string, chunk_id string, text string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def _serve(self, scope: str, first: int, after: int) -> Iterator[Row]:
        for number in range(first, min(after, first + self.served)):
            doc_id, chunk_id, text = self.waiting.getValue((number,))
            self.waiting.removeKey((number,))
            yield Row(scope=scope, kind="embed", doc_id=doc_id, chunk_id=chunk_id, text=text, reason=None)

    def _wake(self, timer_values) -> None:
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        scope = key[0]
        first, after = self.ends.get() if self.ends.exists() else (0, 0)
        yield from self._serve(scope, first, after)
        first = min(after, first + self.served)
        for _, doc_id, texts in sorted((r.seq, r.doc_id, r.chunks) for r in rows):
            if len(texts) > self.pending - (after - first):
                yield Row(scope=scope, kind="refused", doc_id=doc_id, chunk_id=None, text=None, reason="embedding_queue_full")
                continue
            for place, text in enumerate(texts):
                chunk = f"{doc_id}:{place}"
                self.waiting.updateValue((after,), (doc_id, chunk, text))
                after += 1
                yield Row(scope=scope, kind="chunk", doc_id=doc_id, chunk_id=chunk, text=text, reason=None)
        self.ends.update((first, after))
        if after > first and self.served:
            self._wake(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, after = self.ends.get()
        yield from self._serve(key[0], first, after)
        first = min(after, first + self.served)
        self.ends.update((first, after))
        if after > first:
            self._wake(timerValues)

    def close(self) -> None:
        pass


def queue(documents: DataFrame, pending: int = PENDING, served: int = 64) -> DataFrame:
    """EVENTS of a stream of (scope, seq, doc_id, content): chunk for each chunk of an admitted document, refused for a document
    whose chunks find no room, of which nothing else is seen, and embed when a waiting chunk's turn has come. Documents of a
    batch come in order of seq; null contents have no chunks; documents without a scope or an id are left out. With timers a
    stream is never at its end, so run it every so often; nothing served, it has none and admits until it is full."""
    rows = documents.filter("scope IS NOT NULL AND doc_id IS NOT NULL").select(F.col("scope").cast("string").alias("scope"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.col("doc_id").cast("string").alias("doc_id"), chunks(F.trim(F.coalesce("content", F.lit("")))).alias("chunks"))
    return rows.groupBy("scope").transformWithState(QueueProcessor(pending, served), EVENTS, "append", "processingTime" if served else "none")


def embedded(turns: DataFrame, model: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """(scope, doc_id, chunk_id, embedding) of chunks: the model gets BATCH texts at once, each cut to its first LONGEST
    characters; a vector of another length than `dimension` is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            vectors = [v for i in range(0, len(texts), BATCH) for v in model([(t or "")[:LONGEST] for t in texts[i : i + BATCH]])]
            good = pa.array([v is not None and len(v) == dimension for v in vectors], pa.bool_())
            column = pa.array([list(v) if v is not None else None for v in vectors], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), column], ["scope", "doc_id", "chunk_id", "embedding"]).filter(good)

    return turns.select("scope", "doc_id", "chunk_id", "text").mapInArrow(run, "scope string, doc_id string, chunk_id string, embedding array<double>")


def serve(documents: DataFrame, folder: str, model: Callable[[list[str]], list[list[float]]], dimension: int, owned: Callable[[], DataFrame] | None = None, pending: int = PENDING, served: int = 64, every: str | None = None) -> StreamingQuery:
    """Run the queue: chunks, refusals and vectors of each batch go under `folder`, by the batch's number, so that a batch that
    runs twice counts once. owned: the (scope, chunk_id) that are still there when vectors are written; others get none."""

    def vectors(batch: DataFrame) -> DataFrame:
        turns = batch.filter("kind = 'embed'")
        return embedded(turns if owned is None else turns.join(owned(), ["scope", "chunk_id"], "left_semi"), model, dimension)

    parts = {"chunks": lambda b: b.filter("kind = 'chunk'").drop("kind", "reason"), "refused": lambda b: b.filter("kind = 'refused'").select("scope", "doc_id", "reason"), "vectors": vectors}
    return start(queue(documents, pending, served), folder, write_batches(folder, parts), every=every)
