"""Mixing sources to target weights by Poisson replication (native).

Each source gets a mean repetition rate: its target share of the corpus over
its present share.  A document's number of copies is a Poisson draw with
that mean, made by inverting the distribution at a uniform hash of the
document, so the same document gets the same copies on every run.  The copies
are exploded and dealt by a hash of (document, copy): a global shuffle with no
sampling pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstream.llm.common import expand_copies, free_name, unit_hash

#: A table of per-source rates up to this many rows is broadcast; beyond it the
#: join shuffles and Spark splits the large sources.
MAX_BROADCAST_SOURCES = 10_000
#: Largest mean inverted at once; a larger one is a sum of independent draws.
MAX_MEAN = 32.0


def source_rates(df: DataFrame, source: str, text: str, weights: Mapping[str, float] | None = None,
                 temper: float = 0.5, budget: float = 1.0) -> DataFrame:
    """-> (source, chars, rate): one row per source, null among them.

    ``weights`` are target weights in characters (a source not named gets 0);
    without them a source weighs its size to the power ``temper``.  The rate
    is the target share of ``budget`` corpora over the source's characters;
    a source without characters has rate 1, as repeating it changes nothing.
    """
    sizes = df.groupBy(F.col(source).alias("_src")).agg(
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("chars"))
    if weights is None:
        w = F.pow(F.col("chars").cast("double"), F.lit(float(temper)))
    else:
        w = F.coalesce(*[F.when(F.col("_src") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    sizes = sizes.withColumn("w", F.when(F.col("chars") > 0, w).otherwise(0.0))
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("w").alias("all_w"))
    # `total` is one row by construction.
    rate = F.lit(float(budget)) * F.col("w") / F.col("all_w") * F.col("all_chars") / F.col("chars")
    return sizes.join(F.broadcast(total)).select(
        F.col("_src"), "chars",
        F.when(F.col("chars") > 0, F.coalesce(F.round(rate, 12), F.lit(0.0))).otherwise(1.0).alias("rate"))


def _with_cdf(rates: DataFrame) -> DataFrame:
    """Adds how many draws a copy count sums, and the distribution of one."""
    parts = F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int")
    r = rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    top = (F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")
    p0 = F.exp(-F.col("mean"))
    first = F.struct(p0.alias("p"), p0.alias("sum"), F.array(F.round(p0, 12)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"),
                        F.concat(acc["cdf"], F.array(F.round(acc["sum"] + p, 12))).alias("cdf"))

    return r.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), top), first, step)["cdf"]).drop("mean")


def poisson_inverse(key: Column, cdf: Column, parts: Column, seed: int) -> Column:
    """Copies of a key: the sum of ``parts`` draws, each the number of steps of
    the distribution at or below the key's uniform hash (drawn once a part)."""
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: unit_hash(F.lit(str(seed)), key, j.cast("string")))
    steps = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    return F.aggregate(draws, F.lit(0).cast("bigint"), lambda n, u: n + steps(u))


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        weights: Mapping[str, float] | None = None, temper: float = 0.5, budget: float = 1.0,
        seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """-> the columns of ``df`` (or ``keep``), plus copy, copies, rate and
    shuffle_key; a row per copy, in shuffled order.

    A null source is a source of its own.  A document without id is hashed by
    its text; equal (id, text) rows draw alike.  A null or empty text has no
    characters, weighs nothing, and is repeated at its source's rate.  A new
    column whose name is taken gets leading underscores.
    """
    kept = keep or df.columns
    names = free_name(df.select(*kept), "copy", "copies", "rate", "shuffle_key")
    rates = _with_cdf(source_rates(df, source, text, weights, temper, budget)).checkpoint()
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    # The document travels as one value, so that no name of its columns matters here.
    whole = df.select(F.struct(*[F.col(c) for c in kept]).alias("row"), key.alias("key"), F.col(source).alias("src"))
    drawn = whole.join(rates, F.col("src").eqNullSafe(F.col("_src"))).select(
        "row", "key", "rate", poisson_inverse(F.col("key"), F.col("cdf"), F.col("parts"), seed).alias("copies"))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}:shuffle"), "key", F.col("copy").cast("string"))), 1, 15), 16, 10)
    rows = expand_copies(drawn, "copies", "copy").withColumn("order", order.cast("bigint"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, F.col("order")).sortWithinPartitions("order").select(
        *[F.col("row")[c].alias(c) for c in kept],
        *[F.col(c).alias(out) for c, out in zip(("copy", "copies", "rate", "order"), names)]))
