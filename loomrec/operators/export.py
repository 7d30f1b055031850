"""Export of semantic ids, and the metrics of a quantizer over a table of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.functions.vectors import doubles, dot, mlp, norm, subtract
from loomrec.operators import quantize, semantic_ids

Layers = list[list[list[float]]]


def export(vectors: DataFrame, codebook: DataFrame, path: str, size: int | None = None, key: str = "id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Writes key, semantic_ids and a column a level to path; the collision reports without and with the last digit."""
    codes = quantize.encode(vectors, codebook, key, column).select(key, "codes")
    ids = semantic_ids.add_digit(codes, size, key)
    levels = codebook.select("level").distinct().count() + 1
    semantic_ids.level_columns(ids, levels).write.mode("overwrite").parquet(path)
    written = vectors.sparkSession.read.parquet(path)
    before = semantic_ids.collisions(written.select(F.slice("semantic_ids", 1, levels - 1).alias("codes")))
    return before, semantic_ids.collisions(written, "semantic_ids")


def forward(vectors: DataFrame, codebook: DataFrame, encoder: Layers | None = None, decoder: Layers | None = None, key: str = "id", column: str = "embedding") -> DataFrame:
    """key, x, codes, errors (squared norms of what each level leaves), residual, quantized and reconstruction.

    Without an encoder or decoder the vectors are quantized, or given back, as they are.
    """
    x = vectors.select(key, doubles(F.col(column)).alias("x"))
    x = x.withColumn("z", mlp(F.col("x"), encoder) if encoder else F.col("x"))
    out = quantize.encode(x, codebook, key, "z", keep=("x", "z"), errors=True)
    # the codes' sum is what the residual lacks of z
    out = out.withColumn("quantized", subtract(F.col("z"), F.col("residual"))).drop("z")
    return out.withColumn("reconstruction", mlp(F.col("quantized"), decoder) if decoder else F.col("quantized"))


def _losses(levels: int, beta: float) -> dict[str, object]:
    off = subtract(F.col("x"), F.col("reconstruction"))
    mse = [F.avg(F.col("errors")[k] / F.size("residual")) for k in range(levels)]
    recon, vq = F.avg(dot(off, off) / F.size("x")), sum(m * (1 + beta) for m in mse)
    return {"loss": recon + vq, "recon_loss": recon, "vq_loss": vq, "mse": F.array(*mse)}


def _long(one: DataFrame, names: list[str]) -> DataFrame:
    """metric, level (null) and value of columns of one row."""
    parts = [F.struct(F.lit(c).alias("metric"), F.lit(None).cast("int").alias("level"), F.col(c).cast("double").alias("value")) for c in names]
    return one.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def training_metrics(out: DataFrame, levels: int, size: int, beta: float = 0.1) -> DataFrame:
    """metric, level and value over rows of forward: losses, usage, largest share, unique ids and residual norm.

    size: codes a level. level is null where the metric is of all levels.
    """
    one = out.agg(*(v.alias(k) for k, v in _losses(levels, beta).items()), F.avg(norm(F.col("residual"))).alias("avg_residual_norm"))
    per = one.select(F.posexplode("mse").alias("level", "v"))
    rows = _long(one, ["loss", "recon_loss", "vq_loss", "avg_residual_norm"])
    for name in ("codebook_loss", "commitment_loss"):
        rows = rows.unionByName(per.select(F.lit(name).alias("metric"), "level", F.col("v").alias("value")))
    used = quantize.usage(out).groupBy("level").agg((F.count("*") / size).alias("codebook_usage"), (F.max("n") / F.sum("n")).alias("codebook_max_share"))
    for name in ("codebook_usage", "codebook_max_share"):
        rows = rows.unionByName(used.select(F.lit(name).alias("metric"), "level", F.col(name).alias("value")))
    unique = semantic_ids.collisions(out).withColumnRenamed("unique_share", "unique_ids_proportion")
    return rows.unionByName(_long(unique, ["unique_ids_proportion"]))


def validation_metrics(out: DataFrame, levels: int, batch: str, beta: float = 0.1) -> DataFrame:
    """metric, level and value: plain means of each batch's mean losses, and the share of unique ids of all rows."""
    losses = {k: v for k, v in _losses(levels, beta).items() if k != "mse"}
    means = out.groupBy(batch).agg(*(v.alias(k) for k, v in losses.items())).agg(*(F.avg(k).alias(k) for k in losses))
    unique = semantic_ids.collisions(out).withColumnRenamed("unique_share", "unique_ids_proportion")
    return _long(means, list(losses)).unionByName(_long(unique, ["unique_ids_proportion"]))
