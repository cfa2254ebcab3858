"""Request quota per client over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail import dims
from lodgetrail.operators.limits import admit_requests

_HELD = T.StructType([T.StructField("client", T.LongType()), T.StructField("ts", T.TimestampType())])
_VERDICTS = "client bigint, request_id bigint, ts timestamp, admitted boolean, retry_after bigint"


def judge_batches(
    root: str, limit: int = dims.ANONYMOUS_MAX_PER_MINUTE, window_seconds: int = dims.WINDOW_SECONDS,
    delay_seconds: int = 60,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: verdicts on the requests (client, request_id, ts) of each micro-batch.

    A micro-batch goes through the same ordered walk as a stored table, as sorted streams of Arrow batches, so
    one busy client's requests are never gathered. What a batch leaves to the next are the instants admitted within the
    window and ``delay_seconds`` before the newest request: at most ``limit`` per client and window. Both are tables
    named by the batch id below ``root``, written whole, so a replayed batch finds the same past and writes
    the same verdicts. Requests count in event order; a late one is judged by what was admitted before its instant.
    """

    def judge(requests: DataFrame, batch_id: int) -> None:
        spark = requests.sparkSession
        held = (
            spark.read.schema(_HELD).parquet(f"{root}/held/{batch_id - 1}")
            if batch_id else spark.createDataFrame([], _HELD))
        verdicts = admit_requests(requests.select("client", "request_id", "ts"), limit, window_seconds, held=held)
        verdicts.write.mode("overwrite").parquet(f"{root}/verdicts/batch={batch_id}")
        judged = spark.read.schema(_VERDICTS).parquet(f"{root}/verdicts/batch={batch_id}")
        known = held.unionByName(judged.filter("admitted").select("client", "ts"))
        newest = known.agg(F.max("ts")).first()[0]
        if newest is not None:
            known = known.filter(F.unix_micros("ts") >= F.unix_micros(F.lit(newest)) - (window_seconds + delay_seconds) * 1_000_000)
        known.write.mode("overwrite").parquet(f"{root}/held/{batch_id}")

    return judge


def admitted(
    requests: DataFrame, root: str, checkpoint: str, limit: int = dims.ANONYMOUS_MAX_PER_MINUTE,
    window_seconds: int = dims.WINDOW_SECONDS, delay_seconds: int = 60,
) -> DataFrame:
    """Judge everything landed so far and return all verdicts; called again, it goes on where it stopped."""
    query = (
        requests.writeStream.foreachBatch(judge_batches(root, limit, window_seconds, delay_seconds))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return verdicts(requests.sparkSession, root)


def verdicts(spark, root: str) -> DataFrame:
    return spark.read.schema(f"{_VERDICTS}, batch bigint").parquet(f"{root}/verdicts").drop("batch")
