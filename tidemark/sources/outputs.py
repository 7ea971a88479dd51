"""Writing results: slim and full tables, spreadsheets, models, caches, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean, topics
from tidemark.schemas import SLIM_COLUMNS
from tidemark.tables import new_path, remove

BOM = "﻿"


def save_outputs(df: DataFrame, slim_path: str, full_path: str, columns: tuple[str, ...] = SLIM_COLUMNS) -> list[str]:
    """Writes both tables as Parquet; returns the wanted columns that weren't there."""
    clean.slim(df, columns).write.mode("overwrite").parquet(slim_path)
    df.write.mode("overwrite").parquet(full_path)
    return [c for c in columns if c not in df.columns]


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def save_rejected(dropped: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    save_csv(clean.slim(dropped, columns), path)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save_spreadsheet(df: DataFrame, path: str) -> int:
    """One CSV file with a byte-order mark, for spreadsheets; returns its rows.

    Tasks write the lines; the driver copies their files, in the order of df's partitions, into the one file through a small buffer, so the table may have any size.
    """
    import csv
    import io

    spark, parts = df.sparkSession, new_path(df.sparkSession)
    n = spark.sparkContext.accumulator(0)

    def lines(rows):
        out, held = io.StringIO(), 0
        writer = csv.writer(out, lineterminator="\n")
        for r in rows:
            writer.writerow(["" if v is None else v for v in r])
            held += 1
            if held == 1000:
                yield (out.getvalue()[:-1],)  # the text writer ends the line
                n.add(held)
                out.seek(out.truncate(0))
                held = 0
        if held:
            yield (out.getvalue()[:-1],)
            n.add(held)

    spark.createDataFrame(df.rdd.mapPartitions(lines), "value string").write.text(parts)
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(df.columns)
    (fs, at), (shared, folder) = _fs(spark, path), _fs(spark, parts)
    files = [f.getPath() for f in shared.listStatus(folder) if f.getPath().getName().startswith("part-")]
    stream = fs.create(at, True)
    try:
        stream.write(bytearray((BOM + head.getvalue()).encode()))
        for file in sorted(files, key=lambda f: int(f.getName().split("-")[1])):
            part = shared.open(file)
            try:
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, 1 << 16, False)
            finally:
                part.close()
    finally:
        stream.close()
    remove(spark, parts)
    return n.value


def save_text(spark: SparkSession, content: str, path: str) -> None:
    fs, at = _fs(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()


def backup(spark: SparkSession, path: str, to: str) -> bool:
    """Copies a file or folder before it is overwritten; False if there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return False
    other, target = _fs(spark, to)
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, other, target, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def cached_embeddings(df: DataFrame, encode, path: str, model: str, text: str = "text") -> DataFrame:
    """df with embedding. Vectors are kept by (model, text hash) under path; only texts that aren't there are encoded, and appended.

    encode: a Column -> Column of ARRAY<FLOAT>, such as a pandas_udf around a model.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    schema = "model string, _hash string, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    known = spark.read.schema(schema).parquet(path).where(F.col("model") == model) if exists(spark, path) else empty
    missing = keyed.select("_hash", F.coalesce(text, F.lit("")).alias("_t")).dropDuplicates(["_hash"]).join(known.select("_hash"), "_hash", "left_anti")
    made = missing.select(F.lit(model).alias("model"), "_hash", encode(F.col("_t")).cast("array<float>").alias("embedding"))
    made.write.mode("append").parquet(path)
    stored = spark.read.schema(schema).parquet(path).where(F.col("model") == model).select("_hash", "embedding")
    return keyed.join(stored, "_hash", "left").drop("_hash")


def save_over_time(over_time: DataFrame, path: str) -> None:
    """The published month table (topics.dtm_table()), for later analyses."""
    topics.dtm_table(over_time).write.mode("overwrite").parquet(path)


def load_over_time(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_topic_model(weights: DataFrame, assignments: DataFrame, path: str, config: dict) -> None:
    """A model is its weighted words, its assignments and its settings."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    save_text(weights.sparkSession, json.dumps(config, indent=2, sort_keys=True, default=str), f"{path}/config.json")


def load_topic_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    lines = spark.read.text(f"{path}/config.json", wholetext=True).first()
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/assignments"), json.loads(lines.value)


def findings_report(drift_table: DataFrame, outliers: DataFrame, t1: float, t2: float, title: str = "Topic drift") -> str:
    """Markdown: one line per topic, and a section for each topic with outlier months. Topics are few."""
    rows = sorted(drift_table.collect(), key=lambda r: r.topic)
    odd = {r.topic: r.outliers for r in outliers.collect() if r.outliers}
    lines = [f"# {title}", "", f"Thresholds: semantic {t1:.2f}, lexical {t2:.2f}", "", "| topic | semantic | lexical | pattern |", "|---|---|---|---|"]
    lines += [f"| {r.topic} | {r.d1_mean} | {r.d2_mean} | {r.pattern} |" for r in rows]
    for topic, months in sorted(odd.items()):
        lines += ["", f"## Topic {topic}", "", *[f"- month {m.month}: mean {m.mean}" for m in months]]
    return "\n".join(lines) + "\n"
