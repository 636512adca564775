"""Streaming: answers scored as they arrive.

Scoring is stateless, so the batch columns serve a stream as they are. The consistency term needs
all exposures of a sample, so it is taken within a micro-batch, which is what an online scorer
sees at a time. Gold is in the rows, or in a static lookup that the stream is joined with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from casewright.functions import scoring

GOLD = "gold struct<decision: string, risk_level: string, need_human: boolean, reason_codes: array<string>>"
SCHEMA = f"sample_id string, prompt_exposure string, position int, hard_tags array<string>, prediction string, arrived timestamp, {GOLD}"


def read_answers(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(folder)


def write_rewards(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rewards of every micro-batch, written with its number: a repeated batch replaces itself."""
    columns = ["sample_id", "prompt_exposure", "position", *scoring.WEIGHTS, "total_reward"]

    def score(batch: DataFrame, number: int) -> None:
        done = scoring.rewards(scoring.score_answers(scoring.read_answers(batch, "online")), "online")
        done.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return answers.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(score).start()


COMPLETIONS = f"row_index long, prompt string, sample_id string, prompt_exposure string, hard_tags array<string>, prediction string, {GOLD}"


def read_completions(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Bare completions as they arrive: ids, exposure, tags and gold may all be null."""
    return spark.readStream.schema(COMPLETIONS).option("maxFilesPerTrigger", files_at_once).json(folder)


def write_online_rewards(completions: DataFrame, lookup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rewards of completions whose gold is looked up, by micro-batch below path/rewards.

    The lookup's last rows are written to path/lookup once, before the stream begins, so a restarted stream
    and every batch see the same table and no batch groups it again. The stream is joined with it; the
    consistency term is taken within the micro-batch.
    """
    spark = completions.sparkSession
    scoring.last_known(lookup).write.mode("overwrite").parquet(f"{path}/lookup")
    rows = scoring.with_known(completions, spark.read.parquet(f"{path}/lookup"))
    columns = ["row_index", "sample_id", "prompt_exposure", *scoring.WEIGHTS, "total_reward"]

    def score(batch: DataFrame, number: int) -> None:
        scoring.online_rewards(batch).select(*columns).write.mode("overwrite").parquet(f"{path}/rewards/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(score).start()


def windowed_validity(answers: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Share of valid answers by window of arrival; later answers than the watermark are left out."""
    read = scoring.read_answers(answers, "online").withWatermark("arrived", late)
    return read.groupBy(F.window("arrived", width), "prompt_exposure").agg(F.count("*").alias("n"), F.avg(F.col("schema_valid").cast("double")).alias("valid_rate"))
