"""Scores of runs that are rerun, kept sample by sample: what did not change is not scored again."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from uttermark.functions.alignment import token_distance
from uttermark.functions.words import one_space
from uttermark.operators.metrics import finish_scores, is_timed
from uttermark.sources.manifests import MANIFEST, RUN_KEYS
from uttermark.streaming.leaderboard import write_sums

# Settings of the stream: where its state is, and that a trigger's shuffle files go with it.
_OWN = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_SUMS = "version long, samples long, lost long, errors long, words long, audio_length double, inference_time double, untimed long, scored long"
_NAMES = [field.split()[0] for field in _SUMS.split(", ")]


class SampleScores(StatefulProcessor):
    """State of one bucket of a run: its sums, and by sample the version, a digest of both texts, and the errors.

    A row of an older version than the newest, or of a sample that this version has told already, is a
    redelivery and changes nothing.  A newer version starts the sums anew; a sample whose texts are those of
    the version before brings its errors along, any other one is scored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "sample string", "version long, digest string, errors long, words long")
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.sums.get() if self.sums.exists() else None
        sums = dict(zip(_NAMES, held)) if held else dict.fromkeys(_NAMES, 0) | {"version": None}
        for frame in rows:
            for row in frame.itertuples(index=False):
                self._take(sums, row)
        self.sums.update(tuple(float(sums[n]) if n in ("audio_length", "inference_time") else int(sums[n]) for n in _NAMES))
        yield pd.DataFrame([{**dict(zip([*RUN_KEYS, "bucket"], key)), **sums}])

    def _take(self, sums: dict, row) -> None:
        version = int(row.version)
        if sums["version"] is None or version > sums["version"]:
            sums.update(dict.fromkeys(_NAMES, 0) | {"version": version, "scored": sums["scored"]})
        if version < sums["version"]:
            return
        old = self.known.getValue((row.sample,))
        if old is not None and old[0] == version:
            return
        digest = blake2b(f"{len(row.ref)} {row.ref} {row.hyp}".encode(), digest_size=16).hexdigest()
        if old is not None and old[1] == digest:
            errors, words = old[2], old[3]
        else:
            left, right = (text.split(" ") if text else [] for text in (row.ref, row.hyp))
            errors, words = token_distance(left, right), len(left)
            sums["scored"] += 1
        self.known.updateValue((row.sample,), (version, digest, errors, words))
        sums["samples"] += 1
        sums["lost"] += bool(row.lost)
        sums["errors"] += errors
        sums["words"] += words
        sums["audio_length"] += 0.0 if row.duration is None or math.isnan(row.duration) else row.duration
        sums["inference_time"] += 0.0 if row.time is None or math.isnan(row.time) else row.time
        sums["untimed"] += not row.timed

    def close(self) -> None:
        pass


def versioned_stream(
    spark: SparkSession, path: str, files_per_trigger: int = 1000, bytes_per_trigger: int | None = None
) -> DataFrame:
    """New files of a manifest table with a ``version`` column, as a stream.

    A trigger takes so many files, or files of about so many bytes where these are given.
    """
    keys = StructType.fromDDL(", ".join(f"{k} string" for k in RUN_KEYS)).fields
    schema = StructType([*MANIFEST.fields, StructField("version", LongType()), *keys])
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option(*limit).json(path)


def sample_sums(stream: DataFrame, buckets: int = 16) -> DataFrame:
    """Changed sums per (run, bucket of samples).

    ``stream`` has the manifest columns, the run columns and ``version``: a rerun is told by a higher one for all
    its rows.  The buckets cut a hot run into ``buckets`` pieces of state.
    """
    sample = F.coalesce("audio_filepath", F.lit(""))
    rows = stream.select(
        *RUN_KEYS,
        F.pmod(F.xxhash64(sample), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce("version", F.lit(0)).alias("version"),
        sample.alias("sample"),
        F.coalesce("text", F.lit("")).alias("ref_raw"),
        F.coalesce("pred_text", F.lit("")).alias("hyp_raw"),
        F.col("pred_text").isNull().alias("lost"),
        "duration",
        "time",
        is_timed().alias("timed"),
    )
    tidy: dict[str, Column] = {"ref": one_space(F.col("ref_raw")), "hyp": one_space(F.col("hyp_raw"))}
    rows = rows.withColumns(tidy).drop("ref_raw", "hyp_raw")
    keys = ", ".join(f"{k} string" for k in RUN_KEYS)
    return rows.groupBy(*RUN_KEYS, "bucket").transformWithStateInPandas(
        SampleScores(), f"{keys}, bucket int, {_SUMS}", outputMode="Update", timeMode="None"
    )


def start_sample_rescoring(stream: DataFrame, sums_path: str, checkpoint: str, buckets: int = 16):
    """Keep the sums of runs that may be rerun, in whole or in part, up to date.

    A trigger stores the changed buckets; each is its own partition of the sums table, so a replayed trigger
    overwrites what it wrote.  The state is in RocksDB, so it may be larger than memory.  What a trigger has
    shuffled is removed at its end.
    """
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in _OWN}
    for name, value in _OWN.items():
        spark.conf.set(name, value)
    try:
        return (
            sample_sums(stream, buckets)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, _: write_sums(batch, sums_path, [*RUN_KEYS, "bucket"]))
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stored_sample_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores per run from the stored sums, with ``scored``, how many alignments they took in all.

    A bucket that the newest version has not reached belongs to no sample of it.
    """
    keys = ", ".join(f"{k} string" for k in RUN_KEYS)
    rows = spark.read.schema(f"{_SUMS}, {keys}, bucket int").parquet(path)
    newest = F.max("version").over(Window.partitionBy(*RUN_KEYS))  # at most as many rows a run as buckets
    own = lambda name: F.sum(F.when(F.col("version") == F.col("newest"), F.col(name)).otherwise(0)).alias(name)
    sums = rows.withColumn("newest", newest).groupBy(*RUN_KEYS).agg(
        *[own(name) for name in _NAMES[1:-1]], F.sum("scored").alias("scored")
    )
    return finish_scores(sums.withColumn("timed", F.col("untimed") == 0).drop("untimed"))
