"""Batch operators on streams.

Sessions and epochs on a stream use the batch definition itself: every trigger runs it over
the rows that are still open plus the new ones, reports what is closed, and keeps the rest.
What is kept is one table per trigger in the state folder; a trigger that is repeated after
a failure overwrites its own output and its own table, so results stay exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from radiolake.operators import activity, sessions


@dataclass
class Incremental:
    """``operator`` maps rows to results; ``is_final`` tells finished results; ``open_from``
    gives per scope the order value from which rows are still needed."""

    operator: Callable[[DataFrame], DataFrame]
    is_final: Callable[[DataFrame], DataFrame]
    open_from: Callable[[DataFrame, DataFrame], DataFrame]
    scope: list[str]
    order: str = "seq"

    def step(self, batch: DataFrame, batch_id: int, state: str, out: str) -> None:
        spark = batch.sparkSession
        rows_at = f"{state}/rows-{batch_id}"
        rows = batch
        if batch_id > 0:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{state}/open-{batch_id - 1}"))
        rows.write.mode("overwrite").parquet(rows_at)
        rows = spark.read.schema(batch.schema).parquet(rows_at)
        results = self.operator(rows)
        results_at = f"{state}/results-{batch_id}"
        results.write.mode("overwrite").parquet(results_at)
        results = spark.read.schema(results.schema).parquet(results_at)
        self.is_final(results).write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")
        since = self.open_from(results, rows).withColumnRenamed("from", "_from")
        left = rows.join(since, self.scope, "left").where(
            F.col("_from").isNull() | (F.col(self.order) >= F.col("_from"))
        )
        left.drop("_from").write.mode("overwrite").parquet(f"{state}/open-{batch_id}")

    def start(self, stream: DataFrame, state: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
            lambda df, n: self.step(df, n, state, out)
        )
        return writer.trigger(**trigger).start() if trigger else writer.start()

    def results(self, spark: SparkSession, state: str, out: str, last_batch: int, flush: bool = True) -> DataFrame:
        """Everything reported so far; with ``flush`` also what is open at the end of input."""
        done = spark.read.parquet(*[f"{out}/batch-{n}" for n in range(last_batch + 1)])
        if not flush:
            return done
        rest = self.operator(spark.read.parquet(f"{state}/open-{last_batch}"))
        return done.unionByName(rest)


def _after_close(scope: list[str]):
    def since(results: DataFrame, rows: DataFrame) -> DataFrame:
        closed = results.where("close_seq IS NOT NULL")
        return closed.groupBy(*scope).agg((F.max("close_seq") + 1).alias("from"))

    return since


def _from_newest(scope: list[str]):
    def since(results: DataFrame, rows: DataFrame) -> DataFrame:
        return results.groupBy(*scope).agg(F.max("start_seq").alias("from"))

    return since


def dmr_calls_stream(scope: list[str] = ("channel_id",)) -> Incremental:
    scope = list(scope)
    return Incremental(
        lambda df: sessions.dmr_calls(df, scope), lambda r: r.where("closed_by = 'terminator'"), _after_close(scope), scope
    )


def p25_calls_stream(scope: list[str] = ("channel_id",)) -> Incremental:
    scope = list(scope)
    return Incremental(lambda df: sessions.p25_calls(df, scope), lambda r: r, _after_close(scope), scope)


def nxdn_calls_stream(scope: list[str] = ("channel_id",)) -> Incremental:
    scope = list(scope)
    return Incremental(
        lambda df: sessions.nxdn_calls(df, scope), lambda r: r.where("closed_by <> 'end_of_input'"), _after_close(scope), scope
    )


def tetra_sessions_stream(scope: list[str] = ("channel_id",), width_sec: float = 3600.0) -> Incremental:
    scope = list(scope)
    return Incremental(
        lambda df: sessions.tetra_sessions(df, scope, width_sec),
        lambda r: r.where("state = 'closed_by_new_session'"),
        _from_newest(scope),
        scope,
    )


def dpmr_calls_stream(scope: list[str] = ("channel_id",)) -> Incremental:
    scope = list(scope)
    return Incremental(
        lambda df: sessions.dpmr_calls(df, scope), lambda r: r.where("closed_by = 'new_session'"), _from_newest(scope), scope
    )


def epochs_stream(
    floor_db: float, cfg: activity.ActivityConfig = activity.ActivityConfig(), scope: list[str] = ("channel_id",)
) -> Incremental:
    """Epochs against a known floor; ``epoch_id`` is the sample an epoch starts at, which stays the
    same whatever trigger reports it, so ``first_epochs_stream`` can tell epochs apart."""
    scope = list(scope)

    def since(results: DataFrame, rows: DataFrame) -> DataFrame:
        # a quiet chunk leaves nothing behind, and a reset forgets what came before it
        act = activity.detect_fixed(rows, floor_db, cfg, scope)
        quiet = F.max(F.when(F.col("phase") == "inactive", F.col("seq"))) + 1
        return act.groupBy(*scope).agg(F.greatest(quiet, F.max(F.when(F.col("reset"), F.col("seq")))).alias("from"))

    return Incremental(
        lambda df: activity.epochs(activity.detect_fixed(df, floor_db, cfg, scope), scope).withColumn(
            "epoch_id", F.col("candidate_start")
        ),
        lambda r: r.where("close_reason <> 'end_of_input'"),
        since,
        scope,
    )
