"""Evaluation of retrieval and answers: precision by rank, faithfulness, similarity, intervals of paired differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine
from ..functions.text import tokens


def context_precision(judged: DataFrame, by: str = "query_id") -> DataFrame:
    """by, context_precision, precision, n of hits (by, rank, relevant): the mean, over relevant hits, of the share of
    relevant ones up to there; 0 without any."""
    upto = Window.partitionBy(by).orderBy("rank")
    hits = judged.withColumn("relevant", F.coalesce(F.col("relevant").cast("double"), F.lit(0.0)))
    hits = hits.withColumn("share", F.col("relevant") * F.avg("relevant").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    out = hits.groupBy(by).agg(F.sum("share").alias("share"), F.sum("relevant").alias("relevant"), F.count(F.lit(1)).alias("n"))
    return out.select(by, F.when(F.col("relevant") > 0, F.col("share") / F.col("relevant")).otherwise(0.0).alias("context_precision"), (F.col("relevant") / F.col("n")).alias("precision"), "n")


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct words that its context holds; 1 for an answer without words."""
    said = F.array_distinct(tokens(answer))
    return F.when(F.size(said) > 0, F.size(F.array_intersect(said, tokens(context))) / F.size(said)).otherwise(1.0)


def answer_similarity(answer: Column, reference: Column) -> Column:
    """Cosine of the vectors of an answer and of its reference, 0 at least."""
    return F.greatest(F.coalesce(cosine(answer, reference), F.lit(0.0)), F.lit(0.0))


def poisson_weight(key: Column, replicate: Column) -> Column:
    """How often a row counts in a replicate: a Poisson number of mean 1 from the MD5 of both, the same in every run."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    total, weight = 0.0, F.lit(0)
    for k in range(12):  # beyond lie less than one in 10^9
        total += math.exp(-1) / math.factorial(k)
        weight = weight + (u >= F.lit(total)).cast("int")
    return weight


def bootstrap(paired: DataFrame, replicates: int = 200, level: float = 0.95, key: str = "query_id") -> DataFrame:
    """name, mean, low, high for runs first and second and for their difference, of rows (key, first, second).

    Every row goes into each replicate as often as poisson_weight() says, so one aggregation gives all replicates and no
    row is drawn; its result has a row for each replicate, whatever the number of questions."""
    rows = paired.where("first is not null and second is not null").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    weight = F.when(F.col("r") == 0, 1).otherwise(poisson_weight(F.col(key), F.col("r")))  # replicate 0: as it is
    sums = rows.withColumn("w", weight).groupBy("r").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("first")).alias("first"), F.sum(F.col("w") * F.col("second")).alias("second")).where("n > 0")
    means = sums.select("r", (F.col("first") / F.col("n")).alias("first"), (F.col("second") / F.col("n")).alias("second"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("first", F.col("first")), ("second", F.col("second")), ("difference", F.col("second") - F.col("first")))]))
    tail = (1 - level) / 2
    drawn = F.when(F.col("r") > 0, F.col("v.value"))
    return means.select("r", names.alias("v")).groupBy(F.col("v.name").alias("name")).agg(F.max(F.when(F.col("r") == 0, F.col("v.value"))).alias("mean"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"))
