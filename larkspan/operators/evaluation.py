"""Measures of retrieval quality and of providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.operators.ranking import top_k_per


def query_metrics(retrieved: DataFrame, relevant: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(query_id, recall_k, precision_k, ndcg_k for each k, mrr) of retrieved (query_id, id, rank) and relevant (query_id, id).

    Recall counts an id each time it is there; precision divides by what was returned within k, not by k; nDCG is binary
    and takes an id once. Every query with a relevant id has a row; one without results has zeros.
    """
    labels = relevant.distinct()
    hits = retrieved.join(labels.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").fillna(0, ["hit"])
    firsts = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank")))
    aggregates = [F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))).alias("mrr")]
    for k in ks:
        inside = F.col("rank") <= k
        aggregates += [F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias(f"found_{k}"), F.sum(F.when(inside, 1).otherwise(0)).alias(f"shown_{k}")]
        # Repeats are taken out after the cut at k, so later ids move up.
        place = F.row_number().over(Window.partitionBy("query_id", (F.col("nth") == 1) & inside).orderBy("rank"))
        firsts = firsts.withColumn(f"gain_{k}", F.when(inside & (F.col("nth") == 1) & (F.col("hit") == 1), 1 / F.log2(place + 1.0)).otherwise(0.0))
        aggregates.append(F.sum(f"gain_{k}").alias(f"dcg_{k}"))
    sums = firsts.groupBy("query_id").agg(*aggregates)
    total = labels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = total.join(sums, "query_id", "left")
    columns = [F.coalesce("mrr", F.lit(0.0)).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        columns += [
            F.coalesce(F.col(f"found_{k}") / F.col("relevant"), F.lit(0.0)).alias(f"recall_{k}"),
            F.coalesce(F.try_divide(f"found_{k}", f"shown_{k}"), F.lit(0.0)).alias(f"precision_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return out.select("query_id", "relevant", *columns)


def report(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over queries, of each group and, with groups, of all (group columns null)."""
    measures = [c for c in metrics.columns if c not in ("query_id", "relevant", *by)]
    means = [F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in measures)]
    return metrics.groupingSets([list(map(F.col, by)), []], *map(F.col, by)).agg(*means) if by else metrics.agg(*means)


def extraction_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Micro-averaged precision, recall and F1 of (case_id, name, n) tables, and how many matches differ in number."""
    both = expected.withColumnRenamed("n", "want").join(actual.withColumnRenamed("n", "got"), ["case_id", "name"], "full_outer")
    sums = both.agg(F.count_if(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("tp"), F.count_if(F.col("want").isNull()).alias("fp"), F.count_if(F.col("got").isNull()).alias("fn"), F.count_if(F.col("want") != F.col("got")).alias("mismatches"))
    precision, recall = F.try_divide("tp", F.expr("tp + fp")), F.try_divide("tp", F.expr("tp + fn"))
    return sums.select("tp", "fp", "fn", "mismatches", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def provider_summary(attempts: DataFrame, errors: int = 3) -> DataFrame:
    """Per provider of (provider, status, result_count, duration_ms, error): counts, nearest-rank percentiles, commonest errors."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    base = attempts.groupBy("provider").agg(
        F.count("*").alias("attempts"), status("ok"), status("empty"), status("error"), status("backoff"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95_ms"), F.avg("result_count").alias("avg_results"),
    ).withColumn("success_rate", F.col("ok") / F.col("attempts"))
    counted = attempts.filter(F.coalesce("error", F.lit("")) != "").groupBy("provider", F.col("error").alias("message")).agg(F.count("*").alias("n"))
    top = top_k_per(counted, ["provider"], [F.col("n").desc(), "message"], errors)
    listed = top.groupBy("provider").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message", "n"))), lambda x: F.concat(x["message"], F.lit(" x"), x["n"].cast("string"))), "; ").alias("top_errors"))
    return base.join(listed, "provider", "left")


def benchmark_lines(attempts: DataFrame) -> DataFrame:
    """(provider, line): a Markdown row of successes, median and 95th percentile in milliseconds."""
    summary = provider_summary(attempts)
    cell = lambda c: F.round(c).cast("long").cast("string")
    parts = [F.col("provider"), F.concat_ws("/", F.col("ok").cast("string"), F.col("attempts").cast("string")), cell("p50_ms"), cell("p95_ms")]
    return summary.select("provider", F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")).alias("line"))
