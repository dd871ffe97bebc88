"""Operator 10: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, materialize

#: One draw has this mean at most; larger means are sums of independent draws, so a row is exploded in steps.
MEAN_PER_DRAW = 8.0
#: Sources whose rates are broadcast.
BROADCAST_SOURCES = 50_000
#: Terms of the inverted distribution function; at a mean of 8 the rest is below 1e-16.
TERMS = 48


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and keys: the same on every engine and partitioning."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source: str, weights: Mapping[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """source, n, rate: how often a row of the source is wanted on average.

    weights gives each source's share of the output; sources it doesn't name are left out.  Without it a source's share
    is n ** alpha over the sum of all.  The output has about epochs times the rows of the input.
    """
    # a null source is a source of its own; counts combine before the shuffle, so a hot source costs nothing
    n = docs.groupBy(F.col(f"`{source}`").alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        mass = F.pow(F.col("__n").cast("double"), F.lit(alpha))
    else:
        mass = F.lit(0.0)
        for name, w in weights.items():
            if not (math.isfinite(w) and w >= 0):
                raise ValueError(f"weight of {name!r} is {w}")
            mass = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(mass)
    n = materialize(n.withColumn("__mass", mass), "sources")
    rows, whole = n.agg(F.sum("__n"), F.sum("__mass")).first()
    rate = F.lit(float(epochs)) * F.lit(rows or 0) * F.col("__mass") / F.lit(whole or 1.0) / F.col("__n")
    return n.select("__source", F.coalesce(F.round(rate, 9), F.lit(0.0)).alias("__rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    *,
    source: str = "source",
    keys: tuple[str, ...] = ("doc_id",),
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    shuffle: bool = True,
    copy_column: str | None = None,
) -> DataFrame:
    """Repeat every row a Poisson number of times, so that sources take their target shares, and shuffle all copies.

    A row's count inverts the Poisson distribution with the source's rate at a uniform number hashed from seed and keys.
    A rate over MEAN_PER_DRAW is split into equal draws, each hashed with its number; a sum of Poisson numbers is one.
    Rows with equal keys get equal counts.  Null keys hash as empty text, a null source is a source of its own, a source
    without weight is left out, an empty table stays empty.  copy_column, if given, numbers the copies from 0 and takes
    the place of a column of that name; all other columns stay as they are.
    """
    if copy_column:
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != copy_column.lower()])
    columns = docs.columns
    rates = source_rates(docs, source, weights, alpha, epochs)
    src, rate, draw, step, order = (free_name(docs, x) for x in ("__src", "__rt", "__draw", "__step", "__order"))
    rates = rates.withColumnsRenamed({"__source": src, "__rate": rate})
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)  # else rows are shuffled by source, and AQE splits a hot one
    rows = docs.join(rates, F.col(f"`{source}`").eqNullSafe(F.col(src)), "inner").filter(F.col(rate) > 0)
    draws = F.greatest(F.lit(1), F.ceil(F.col(rate) / MEAN_PER_DRAW)).cast("long")
    rows = rows.withColumn(draw, F.explode(F.sequence(F.lit(0).cast("long"), draws - 1)))
    mean = F.col(rate) / draws
    u = uniform(seed, *[F.col(f"`{k}`") for k in keys], F.col(draw))
    # the distribution function term by term: count the terms that u has passed
    first = F.exp(-mean)

    def terms(drawn: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(TERMS)),
            F.struct(first.alias("p"), first.alias("c"), F.when(drawn >= first, 1).otherwise(0).alias("k")),
            lambda a, j: F.struct(
                (a["p"] * mean / j).alias("p"),
                (a["c"] + a["p"] * mean / j).alias("c"),
                (a["k"] + F.when(drawn >= a["c"] + a["p"] * mean / j, 1).otherwise(0)).alias("k"),
            ),
        )["k"]

    rows = rows.withColumn(step, let(u, terms)).filter(F.col(step) > 0)
    rows = rows.withColumn(step, F.explode(F.sequence(F.lit(1), F.col(step))))
    where = uniform(seed + ":order", *[F.col(f"`{k}`") for k in keys], F.col(draw), F.col(step))
    out = [F.col(f"`{c}`") for c in columns]
    if copy_column:
        out.append((F.col(draw) * TERMS + F.col(step) - 1).alias(copy_column))
    if not shuffle:
        return rows.select(*out)
    # a hashed key is even by construction: one exchange deals all copies out and each part is put in hashed order
    return rows.select(*out, where.alias(order)).repartition(F.col(order)).sortWithinPartitions(order).drop(order)
