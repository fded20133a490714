"""Answer analysis requests as they land, with the same operators as the batch jobs."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def landed_requests(spark: SparkSession, path: str, schema: str = "request_id long, text string") -> DataFrame:
    """Requests as they arrive in a folder of JSON files."""
    return spark.readStream.schema(schema).json(path)


def answer(
    requests: DataFrame, analyze: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    rejects: Callable[[DataFrame], DataFrame] | None = None, rejects_out: str | None = None,
) -> StreamingQuery:
    """Run ``analyze`` on each batch of new requests and keep its answers under ``out``.

    A batch that is run again after a failure replaces its own folder, so each request is
    answered once; what ``rejects`` finds in it goes to ``rejects_out``. Works through what has landed and stops.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        analyze(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if rejects is not None:
            rejects(batch).write.mode("overwrite").parquet(f"{rejects_out}/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
