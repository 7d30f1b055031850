"""Sources and sinks."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrec.functions.determinism import shuffled

USER_ITEMS = "user_id string, steam_id string, items_count long, items array<struct<item_id:string,item_name:string,playtime_forever:long,playtime_2weeks:long>>"
SFT = "instruction string, input string, output string, task string, criteria struct<genres:array<string>,categories:array<string>>"


def read_user_items(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Nested user libraries: one JSON document, or one object a line."""
    return spark.read.schema(USER_ITEMS).json(path, multiLine=whole)


def read_catalog_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A wide catalog with a header; quoted fields may hold line ends, empty ones are null."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', nullValue="")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int = 0, order: str | None = None) -> DataFrame:
    """A table; limit takes the first rows by order, 0 all of them."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.orderBy(order).limit(limit) if limit and order else df.limit(limit) if limit else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SFT).json(path)


def write_examples(df: DataFrame, path: str) -> None:
    """One JSON object a line, without escapes of other scripts; criteria only where there are any."""
    df.select("instruction", "input", "output", "task", "criteria").write.mode("overwrite").json(path)


def read_splits(spark: SparkSession, **paths: str) -> DataFrame:
    out = None
    for split, path in paths.items():
        one = read_examples(spark, path).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


def write_tokens(df: DataFrame, path: str) -> None:
    """A vocabulary as one JSON array; it has a row a special token, about a thousand."""
    one = df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"])).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """ord and token of a vocabulary file; a missing path is an error."""
    return spark.read.text(path).select(F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("ord", "token"))


def write_token_matrix(df: DataFrame, path: str) -> None:
    df.select("id", "input_ids", "attention_mask").write.mode("overwrite").parquet(path)


def read_token_matrix(spark: SparkSession, path: str, items: int) -> DataFrame:
    """A token matrix; its rows must be as many as the catalog's items."""
    df = spark.read.parquet(path)
    if (n := df.count()) != items:
        raise ValueError(f"the token matrix has {n} rows, the catalog {items}")
    return df


def save_model(weights: DataFrame, codebook: DataFrame, path: str, state: dict[str, object] | None = None, moments: DataFrame | None = None) -> None:
    """A model as tables: weights (layer, row, values), codebook (level, code, vector) and one row of state: step, best loss, schedule, settings.

    An optimizer's moments go to a table of their own. The state is written last.
    """
    if moments is not None:
        moments.write.mode("overwrite").parquet(f"{path}/moments")
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    codebook.write.mode("overwrite").parquet(f"{path}/codebook")
    codebook.sparkSession.createDataFrame([(json.dumps(state or {}),)], "value string").write.mode("overwrite").text(f"{path}/state")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """weights, codebook and state of a saved model; FileNotFoundError where there is none."""
    try:
        weights, codebook = (spark.read.parquet(f"{path}/{x}") for x in ("weights", "codebook"))
        state = json.loads(spark.read.text(f"{path}/state").first()["value"])
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no model at {path}") from gone
    return weights, codebook, state


def parameter_count(weights: DataFrame) -> DataFrame:
    return weights.agg(F.sum(F.size("values")).alias("parameters"))


def append_metrics(spark: SparkSession, path: str, run: str, step: int, prefix: str, values: dict[str, float | list[float]]) -> None:
    """Rows (run, step, prefix, metric, level, value); level is null for plain numbers."""
    rows = [(run, step, prefix, k, i, float(x)) for k, v in values.items() for i, x in (enumerate(v) if isinstance(v, list) else [(None, v)])]
    spark.createDataFrame(rows, "run string, step long, prefix string, metric string, level int, value double").write.mode("append").parquet(path)


def write_dataset(df: DataFrame, path: str, seed: int = 0) -> None:
    """The examples of each split, in random order, to path/train and path/val."""
    for split in ("train", "val"):
        write_examples(shuffled(df.where(F.col("split") == split), seed, f"order-{split}", "task", "_key", "copy"), f"{path}/{split}")


class Ledger:
    """What a job has finished: one small file an entry, written beside and renamed, so that an entry is whole or not there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> list[dict[str, object]]:
        if not self._fs.exists(self._folder):
            return []
        names = [x.getPath().toString() for x in self._fs.listStatus(self._folder) if x.getPath().getName().endswith(".json")]
        return [json.loads(r["value"]) for r in self.spark.read.text(names).collect()] if names else []

    def enter(self, name: str, **values: object) -> None:
        """An entry; an earlier one of the same name stays."""
        hidden, final = (self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}") for x in (f".{name}", f"{name}.json"))
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(values).encode()))
        out.close()
        if not self._fs.rename(hidden, final) and not self._fs.exists(final):
            raise OSError(f"no entry could be made at {final}")


def write_by_task(df: DataFrame, path: str, *order: str | Column, files: int | None = None) -> None:
    """Examples in one folder a task, in the given order over its files, of which there are at most files, by default what Spark sees fit."""
    rows = df.repartitionByRange(files, *order).sortWithinPartitions(*order) if files else df.orderBy(*order)
    rows = rows.select("instruction", "input", "output", "task", "criteria")
    rows.write.mode("overwrite").partitionBy("task").json(path)


def read_tasks(spark: SparkSession, path: str, *tasks: str) -> DataFrame:
    """Examples of tasks (of all, if none is named) with place, which rises in the order of the files; other tasks' files aren't read.

    place holds the file, the start of the block that a task of Spark read of it, and the row in that.
    """
    rows = spark.read.schema(SFT).json(path)
    if tasks:
        rows = rows.where(F.col("task").isin(*tasks))
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("place", place)


def logger(name: str, level: int = logging.INFO, file: str | None = None) -> logging.Logger:
    """A logger of the driver; the root's console and file handlers are set up by the first call."""
    root = logging.getLogger("loomrec")
    if not root.handlers:
        root.setLevel(level)
        for handler in (logging.StreamHandler(), *([logging.FileHandler(file, encoding="utf-8")] if file else [])):
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            root.addHandler(handler)
    return root.getChild(name)
