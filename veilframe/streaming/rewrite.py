"""Pseudonymising a stream of documents: the rewrite needs one row at a time, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.detect import CATEGORIES
from ..operators.rewrite import observed, pseudonymize


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def write_stream(docs: DataFrame, dictionary: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rewrites documents as they come and adds them as Parquet, each once. A dictionary of any size does: one that can't be sent to the
    executors at once meets each batch as it meets a table, and a batch that is run again replaces its own folder."""
    options = {"checkpointLocation": checkpoint}
    trigger = trigger or {"availableNow": True}
    try:
        out = observed(pseudonymize(docs, dictionary))[0]
    except ValueError:
        each = lambda batch, no: pseudonymize(batch, dictionary).write.mode("overwrite").parquet(f"{path}/batch={no}")
        return docs.writeStream.foreachBatch(each).options(**options).trigger(**trigger).start()
    return out.writeStream.format("parquet").option("path", path).options(**options).outputMode("append").trigger(**trigger).start()


def replaced(query: StreamingQuery) -> dict[str, int]:
    """How often each category was replaced in the batches that a query still reports, as counted when they were written."""
    out = dict.fromkeys(CATEGORIES, 0)
    for progress in query.recentProgress:
        row = (progress["observedMetrics"] or {}).get("replaced")
        for c, n in (row.asDict() if row else {}).items():
            out[c] += n
    return out
