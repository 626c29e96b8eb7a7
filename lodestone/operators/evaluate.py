"""Retrieval quality: metrics per query, agreement of rankings, score drift, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import shared, vectors
from ..functions.ids import seeded_rank

CUTOFF = 10


def metrics(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Recall, reciprocal rank and nDCG at 10 per query, from (query_id, id, rank) and (query_id, id, grade).

    Any positive grade is relevant; gains are linear in the grade. Queries without relevant rows are not scored.
    """
    rel = qrels.filter("grade > 0").groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    hit = ranked.filter(F.col("rank") <= CUTOFF).join(rel, ["query_id", "id"])
    return measured(hit, rel.groupBy("query_id", "grade").agg(F.count("*").alias("n")))


def measured(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """``metrics`` where the judgments need not be listed: from the ranked rows' own grades, and how many rows of each grade a query has.

    ``hits`` has (query_id, rank, grade), ``totals`` (query_id, grade, n) with each grade once; rows without a positive grade do not
    count. The work grows with the lists and the grades, not with the judged pairs.
    """
    above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1))
    gain = F.array(*[F.lit(sum(1 / math.log2(r + 1) for r in range(1, n + 1))) for n in range(CUTOFF + 1)])  # of the first n places
    upto = lambda n: F.element_at(gain, (F.least(n, F.lit(CUTOFF)) + 1).cast("int"))
    filled = totals.filter("grade > 0 and n > 0").withColumn("_above", F.coalesce(above, F.lit(0)))
    ideal = filled.groupBy("query_id").agg(F.sum("n").alias("relevant"), F.sum(F.col("grade") * (upto(F.col("_above") + F.col("n")) - upto(F.col("_above")))).alias("ideal"))
    hit = hits.filter(F.col("rank") <= CUTOFF).filter("grade > 0")
    got = hit.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    return ideal.join(got, "query_id", "left").select(
        "query_id", (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg")
    )


def by_domain(scored: DataFrame, domains: DataFrame) -> DataFrame:
    """Means per domain of the metrics of its queries; ``domains`` has (query_id, domain)."""
    return scored.join(domains, "query_id").groupBy("domain").agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in ("recall", "mrr", "ndcg")])


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query: do two rankings agree on the first row, and what share of the first ten do they have in common?"""

    def lists(rows: DataFrame, name: str) -> DataFrame:
        top = rows.filter(F.col("rank") <= CUTOFF)
        return top.groupBy("query_id").agg(F.collect_set("id").alias(name), F.min_by("id", "rank").alias(f"{name}_first"))

    both = lists(a, "a").join(lists(b, "b"), "query_id")
    share = F.size(F.array_intersect("a", "b")) / F.least(F.lit(CUTOFF), F.greatest(F.size("a"), F.size("b")))
    return both.select("query_id", (F.col("a_first") == F.col("b_first")).alias("same_first"), share.alias("overlap"))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """Count, least, median (interpolated), mean and greatest of a column."""
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))


def interval(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """The central 95 %: percentiles 2.5 and 97.5, linearly interpolated."""
    return rows.groupBy(*(group or [])).agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def hashed_draw(replicate: Column, position: Column, count: Column, seed: str) -> Column:
    """A reproducible draw from range(count): 15 hex digits of a hash, modulo."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), replicate, position).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % count


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``position`` from 0 in the order of a column of unique values, counted in ranges of it, not in one task."""
    dealt = shared.kept(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn("position", F.col("_start") + F.col("_place")).drop("_range", "_start", "_place")


def draws(spark: SparkSession, count: int, replicates: int, seed: str = "bootstrap") -> DataFrame:
    """(replicate, position): as many draws with replacement in each replicate as there are positions. Generated in tasks."""
    made = spark.range(replicates * count).select(F.floor(F.col("id") / max(count, 1)).alias("replicate"), (F.col("id") % max(count, 1)).alias("slot"))
    return made.select("replicate", hashed_draw(F.col("replicate"), F.col("slot"), F.lit(max(count, 1)).cast("long"), seed).alias("position"))


def bootstrap(values: DataFrame, value: str, order: str, replicates: int, seed: str = "bootstrap") -> DataFrame:
    """Means of bootstrap replicates (replicate, mean) of one row per query; the work is replicates times queries."""
    rows = shared.kept(numbered(shared.kept(values.select(order, value), "bootstrap"), order), "bootstrap-numbered")
    return draws(values.sparkSession, rows.count(), replicates, seed).join(rows, "position").groupBy("replicate").agg(F.avg(value).alias("mean"))


def paired_bootstrap(values: DataFrame, value: str, arms: list[str], replicates: int, seed: str = "bootstrap") -> DataFrame:
    """Means of joint replicates: (replicate, a column for each arm), of (arm, query_id, value).

    The queries of a replicate are drawn once and are the same for all arms, so that differences between arms are paired. Every arm
    must have a value for every query.
    """
    wide = shared.kept(values.groupBy("query_id").pivot("arm", arms).agg(F.first(value)), "paired-values")
    faulty = wide.filter(" or ".join(f"`{a}` is null" for a in arms)).limit(1).count()
    if faulty:
        raise ValueError("an arm lacks a value for a query")
    rows = shared.kept(numbered(wide, "query_id"), "paired-numbered")
    return draws(values.sparkSession, rows.count(), replicates, seed).join(rows, "position").groupBy("replicate").agg(*[F.avg(f"`{a}`").alias(a) for a in arms])


# Fixed value: the loss up to which a mixed configuration passes.
MOST_LOSS = 0.01


def paired_losses(values: DataFrame, value: str, sides: list[str], others: list[str], replicates: int, seed: str = "bootstrap") -> DataFrame:
    """Per arm of ``others``: what it loses against the better of ``sides``, with the central 95 % of that over joint replicates.

    (arm, mean, loss, low, high, passes). Which side is better is settled inside each replicate, and for ``loss`` by the means.
    """
    means = values.groupBy("arm").agg(F.avg(value).alias("mean"))
    best = means.filter(F.col("arm").isin(sides)).agg(F.max("mean").alias("_best"))
    boot = paired_bootstrap(values, value, [*sides, *others], replicates, seed)
    better = F.greatest(*[F.col(f"`{s}`") for s in sides])
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("arm"), (better - F.col(f"`{o}`")).alias("loss")) for o in others]))
    spread = interval(boot.select(each.alias("_e")).select("_e.*"), "loss", ["arm"])
    point = means.filter(F.col("arm").isin(others)).join(F.broadcast(best)).withColumn("loss", F.col("_best") - F.col("mean"))  # one row
    return point.join(spread, "arm").select("arm", "mean", "loss", "low", "high", (F.col("loss") <= MOST_LOSS).alias("passes"))


def paired_deltas(values: DataFrame, value: str, reference: str, others: list[str], replicates: int, seed: str = "bootstrap") -> DataFrame:
    """Per arm of ``others``: its mean less that of a reference arm, with the central 95 % over joint replicates: (arm, delta, low, high)."""
    boot = paired_bootstrap(values, value, [reference, *others], replicates, seed)
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("arm"), (F.col(f"`{o}`") - F.col(f"`{reference}`")).alias("delta")) for o in others]))
    spread = interval(boot.select(each.alias("_e")).select("_e.*"), "delta", ["arm"])
    means = values.groupBy("arm").agg(F.avg(value).alias("_mean"))
    base = means.filter(F.col("arm") == reference).select(F.col("_mean").alias("_base"))
    return means.join(F.broadcast(base)).join(spread, "arm").select("arm", (F.col("_mean") - F.col("_base")).alias("delta"), "low", "high")  # one row


def vector_differences(a: DataFrame, b: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """Row by row, two sets of vectors: (id, cosine, difference, dimension), the greatest difference of a component and where it is (from 0).

    Rows that only one set has are left out, and so are vectors of different sizes; a null or zero vector has no cosine.
    """
    both = a.select(id_col, F.col(vec_col).alias("_a")).join(b.select(id_col, F.col(vec_col).alias("_b")), id_col).filter(F.size("_a") == F.size("_b"))
    apart = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    rows = both.select(id_col, (1 - vectors.cosine_distance(F.col("_a"), F.col("_b"))).alias("cosine"), apart.alias("_d"))
    return rows.select(id_col, "cosine", F.array_max("_d").alias("difference"), (F.array_position("_d", F.array_max("_d")) - 1).cast("int").alias("dimension"))


def drift(differences: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: how many vectors were compared, the least cosine and the greatest difference, each with the first row that has it."""
    low = F.min_by(id_col, F.struct("cosine", id_col))
    high = F.min_by(F.struct(F.col(id_col).alias("id"), "dimension"), F.struct(-F.col("difference"), F.col(id_col)))
    worst = differences.agg(F.count("*").alias("compared"), F.min("cosine").alias("least_cosine"), low.alias("least_cosine_id"), F.max("difference").alias("greatest_difference"), high.alias("_high"))
    return worst.select("compared", "least_cosine", "least_cosine_id", "greatest_difference", F.col("_high.id").alias("greatest_difference_id"), F.col("_high.dimension").alias("dimension"))


# Fixed value: how many rows a drift sample has.
DRIFT_ROWS = 32


def drift_sample(differences: DataFrame, seed: str, position: str, id_col: str = "chunk_id", n: int = DRIFT_ROWS) -> DataFrame:
    """The rows with the lowest seeded hashes of their ids, ties by position in the corpus. A bounded heap per task."""
    return differences.withColumn("hash", seeded_rank(seed, "drift", id_col)).orderBy("hash", position).limit(n)


def judgment_counts(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: positive and zero judgments of the given queries, and how many of the queries have a positive one."""
    mine = qrels.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    return mine.agg(F.count_if(F.col("grade") > 0).alias("positive_pairs"), F.count_if(F.col("grade") <= 0).alias("zero_pairs"), F.count_distinct(F.when(F.col("grade") > 0, F.col("query_id"))).alias("eligible_queries"))


# Fixed values of the digest stream: what separates the key's parts, and the numbers that a digest holds.
KEY_END, NUMBERS, NUMBER_HEX = b"\0", 4, 16
#: Numbers generated beyond those needed, in place of rejected ones; one in 2^64 / queries is rejected.
SPARE = 64


def digest_numbers(spark: SparkSession, key: list[str], bound: int, need: int) -> DataFrame:
    """The first ``need`` fair numbers (at, number) of a key's stream: those below the last multiple of ``bound``.

    Number k of the stream is a quarter of the SHA-256 digest of the key and of k / 4, little-endian throughout. Numbers that
    are left out make those behind them move up; of their places, which are hardly ever any, all tasks know.
    """
    head = b"".join(part.encode() + KEY_END for part in key)
    backwards = lambda text: F.concat(*[F.substring(text, NUMBER_HEX - 1 - i, 2) for i in range(0, NUMBER_HEX, 2)])
    block = F.unhex(backwards(F.lpad(F.hex("id"), NUMBER_HEX, "0")))
    digest = F.sha2(F.concat(F.unhex(F.lit(head.hex())), block), 256)
    parts = F.array(*[F.substring(F.col("_d"), 1 + NUMBER_HEX * i, NUMBER_HEX) for i in range(NUMBERS)])
    stream = spark.range(-(-(need + SPARE) // NUMBERS)).withColumn("_d", digest).select("id", F.posexplode(parts).alias("_i", "_x"))
    stream = stream.select((F.col("id") * NUMBERS + F.col("_i")).alias("_k"), F.conv(backwards(F.col("_x")), 16, 10).cast("decimal(20,0)").alias("number"))
    fair = F.col("number") < F.lit(str((1 << 64) // bound * bound)).cast("decimal(20,0)")
    lost = stream.filter(~fair).agg(F.collect_list("_k").alias("_lost"))
    at = F.col("_k") - F.size(F.filter("_lost", lambda x: x < F.col("_k")))
    return stream.filter(fair).join(F.broadcast(lost)).select(at.alias("at"), "number").filter(F.col("at") < need)  # one row


def digest_draws(spark: SparkSession, key: list[str], queries: int, replicates: int) -> DataFrame:
    """Draws of a bootstrap (replicate, slot, position): ``replicates`` times ``queries`` positions, without bias to low ones."""
    if not 1 <= queries < 1 << 31 or replicates < 1:
        raise ValueError("a bootstrap draws from one query at least, once at least")
    at = F.col("at")
    numbers = digest_numbers(spark, key, queries, queries * replicates)
    return numbers.select(F.floor(at / queries).cast("long").alias("replicate"), (at % queries).cast("long").alias("slot"), (F.col("number") % F.lit(queries)).cast("long").alias("position"))
