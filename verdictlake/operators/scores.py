"""Score math: normalization, blends, grids and calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Parameters that `search` scores every row under.
MOST_PARAMS = 2_000
LABELS = ("COMPLETE", "DENIAL", "EVASIVE")


def normalize(scores: Sequence[Column], mode: str) -> list[Column]:
    """Raw, max, mean or z (population deviation; 0 counts as 1)."""
    if mode == "raw":
        return list(scores)
    if mode == "max":
        return [s - F.greatest(*scores) for s in scores]
    mean = sum(scores[1:], scores[0]) / len(scores)
    if mode == "mean":
        return [s - mean for s in scores]
    if mode != "z":
        raise ValueError(mode)
    squares = [(s - mean) * (s - mean) for s in scores]
    deviation = F.sqrt(sum(squares[1:], squares[0]) / len(scores))
    return [(s - mean) / F.when(deviation == 0, 1.0).otherwise(deviation) for s in scores]


def argmax(scores: Sequence[Column], labels: Sequence[str] = LABELS) -> Column:
    """The label of the greatest score, the first one on ties."""
    top = F.greatest(*scores)
    out = F.when(scores[0] == top, labels[0])
    for s, name in zip(scores[1:], labels[1:], strict=True):
        out = out.when(s == top, name)
    return out


def blend(first: Sequence[Column], second: Sequence[Column], weight: Column | float, biases: Sequence[Column | float]) -> list[Column]:
    """Weighted sums of two scores, with a bias for each label."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    return [w * a + (1 - w) * b + c for a, b, c in zip(first, second, biases, strict=True)]


def softmax(logprobs: Column) -> Column:
    """Over an array of log probabilities; nulls have no part."""
    known = F.array_compact(logprobs)
    top = F.array_max(known)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logprobs, lambda x: F.exp(x - top) / total)


def entropy_nats(probabilities: Column) -> Column:
    """X3."""
    return F.aggregate(F.array_compact(probabilities), F.lit(0.0), lambda a, p: a - p * F.log(F.greatest(p, F.lit(1e-300))))


def priority(entropy: Column, top_logprob: Column, weight: float) -> Column:
    """X10."""
    return entropy - weight * top_logprob


def grid(spark, name: str, start: float, stop: float, step: float) -> DataFrame:
    """From start to stop inclusive, as multiples of the step."""
    n = int((stop - start) / step + 1e-9)
    return spark.range(n + 1).select(F.round(start + F.col("id") * step, 10).alias(name))


def search(rows: DataFrame, params: DataFrame, names: Sequence[str], predicted: Column, expected: str, objective: str = "total", group: Sequence[str] = ()) -> DataFrame:
    """The first parameters, in their order, that do best by the objective, for predictions of any form.

    params is a grid of at most MOST_PARAMS with an ordinal `n`; every row is scored under every one of them, and counts
    combine in the task that reads the row.  Additive biases are searched without that product: see bias_search.
    """
    if params.limit(MOST_PARAMS + 1).count() > MOST_PARAMS:
        raise ValueError(f"over {MOST_PARAMS} parameters: search additive biases with bias_search")
    e, o = F.col(expected), F.col("_o")
    c = lambda x: F.count_if(x).alias
    scored = rows.crossJoin(F.broadcast(params)).withColumn("_o", predicted)
    counts = scored.groupBy(*group, "n", *names).agg(
        c(e == o)("correct"), c((e == "COMPLETE") == (o == "COMPLETE"))("binary"), c((e != "COMPLETE") & (o == "COMPLETE"))("fp"), c((e == "COMPLETE") & (o != "COMPLETE"))("fn"), c((e == "EVASIVE") & (o == "EVASIVE"))("evasive"),
    )
    return best(counts, names, objective, group)


def best(counts: DataFrame, names: Sequence[str], objective: str = "total", group: Sequence[str] = ()) -> DataFrame:
    """The row with the best counts of each group, the first by `n` on ties."""
    cols = {"total": ("correct", "binary", "evasive", "-fp", "-fn"), "complete": ("binary", "correct", "evasive", "-fp", "-fn"), "complete_low_fp": ("binary", "-fp", "correct", "evasive", "-fn")}[objective]
    order = [F.col(x[1:]) if x[0] == "-" else -F.col(x) for x in cols]
    fields = ["n", *names, "correct", "binary", "fp", "fn", "evasive"]
    least = F.min_by(F.struct(*fields), F.struct(*order, "n")).alias("_b")
    return counts.groupBy(*group).agg(least).filter("_b IS NOT NULL").select(*group, "_b.*")


def _lattice(*biases: Sequence[float]) -> tuple[float, list[list[int]]]:
    """The greatest step that all biases are multiples of, and the biases in it; biases have six decimals at most."""
    whole = [[round(b * 1e6) for b in values] for values in biases]
    unit = math.gcd(*[b for values in whole for b in values]) or 1
    return unit / 1e6, [[b // unit for b in values] for values in whole]


def bias_counts(rows: DataFrame, first: Sequence[Column], expected: str, complete: Sequence[float], evasive: Sequence[float], denial: float = 0.0, *, second: Sequence[Column] | None = None, weights: Sequence[float] = (1.0,), group: Sequence[str] = ()) -> DataFrame:
    """For every weight, complete and evasive bias the counts that `search` gives, without scoring rows under each.

    Scores are (complete, denial, evasive); two of them are blended by the weights.  In units of the biases' common step a
    row is complete where the complete bias reaches one threshold and its lead over the evasive bias another, and a
    denial where the complete bias stays under the one and the evasive bias under a third.  So a row is two points, each
    kind is counted in the corner of a plane that the biases name, and corners are sums over a summed-area table of the
    points: rows are read once a weight, and what is moved is as large as the grid of biases.  Leads that differ
    from a bias by less than 1e-9 count as ties, and go to the earlier label.  Rows with a null label or score have no part.
    """
    spark = rows.sparkSession
    step, (us, vs) = _lattice(complete, evasive)
    blended = rows.withColumn("_w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    c, d, e = blend(first, second if second is not None else first, F.col("_w"), (F.lit(0.0), F.lit(denial), F.lit(0.0)))
    up = lambda x: F.ceil(x / step - 1e-9 / step).cast("int")
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    own = up(d - c)
    leads = (min(us) - max(vs), max(us) - min(vs))
    # (table, a, b): complete where own <= u and lead <= u - v; denial where own > u and room >= v
    points = F.array(
        F.struct(F.lit(0).alias("t"), clip(own, min(us), max(us) + 1).alias("a"), clip(up(e - c), leads[0], leads[1] + 1).alias("b")),
        F.struct(F.lit(1).alias("t"), (-clip(own, min(us), max(us) + 1)).alias("a"), (-clip(-up(e - d), min(vs) - 1, max(vs))).alias("b")),
    )
    label = F.when(F.col(expected).isin(*LABELS), F.col(expected)).otherwise("OTHER")
    known = F.col(expected).isNotNull() & (c + d + e).isNotNull()
    cells = blended.filter(known).select(*group, "_w", label.alias("_e"), F.explode(points).alias("_p")).groupBy(*group, "_w", "_e", "_p.t", "_p.a", "_p.b").agg(F.count(F.lit(1)).alias("_n"))
    cells = written(cells, "score-cells")  # three readers
    sizes = cells.filter("t = 0").groupBy(*group, "_w", "_e").agg(F.sum("_n").alias("_all"))
    spans = [(0, min(us), max(us), *leads), (1, -max(us) - 1, -min(us), -max(vs), -min(vs) + 1)]
    axes = spark.createDataFrame(spans, "t int, a0 int, a1 int, b0 int, b1 int").select("t", F.explode(F.sequence("a0", "a1")).alias("a"), "b0", "b1").select("t", "a", F.explode(F.sequence("b0", "b1")).alias("b"))
    keys = [*group, "_w", "_e", "t"]
    dense = sizes.drop("_all").crossJoin(F.broadcast(axes))  # groups x labels x plane, as large as the grid
    same = [dense[k].eqNullSafe(cells[k]) for k in keys[:-1]] + [dense[k] == cells[k] for k in ("t", "a", "b")]
    filled = dense.join(cells, same, "left").select(*[dense[k] for k in [*keys, "a", "b"]], F.coalesce("_n", F.lit(0)).alias("_n"))
    sums = filled.withColumn("_n", F.sum("_n").over(Window.partitionBy(*keys, "b").orderBy("a"))).withColumn("_n", F.sum("_n").over(Window.partitionBy(*keys, "a").orderBy("b")))
    grid_ = spark.createDataFrame([(i * len(vs) + j, float(x), float(y), u, v) for i, (x, u) in enumerate(zip(complete, us, strict=True)) for j, (y, v) in enumerate(zip(evasive, vs, strict=True))], "n long, complete_bias double, evasive_bias double, u int, v int")
    corners = grid_.select("n", F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("u").alias("a"), (F.col("u") - F.col("v")).alias("b")), F.struct(F.lit(1).alias("t"), (-F.col("u") - 1).alias("a"), (-F.col("v")).alias("b")))).alias("_p")).select("n", "_p.*")
    found = sums.join(F.broadcast(corners), ["t", "a", "b"])  # as many corners as grid points, twice
    got = lambda t, *names: F.coalesce(F.sum(F.when((F.col("t") == t) & F.col("_e").isin(*names), F.col("_n"))), F.lit(0))
    per = found.groupBy(*group, "_w", "n").agg(got(0, "COMPLETE").alias("cc"), got(0, "EVASIVE").alias("ce"), got(0, "DENIAL", "EVASIVE", "OTHER").alias("cn"), got(1, "DENIAL").alias("dd"), got(1, "EVASIVE").alias("de"))
    total = lambda *names: F.coalesce(F.sum(F.when(F.col("_e").isin(*names), F.col("_all"))), F.lit(0))
    whole = sizes.groupBy(*group, "_w").agg(total("COMPLETE").alias("tc"), total("EVASIVE").alias("te"), total("DENIAL", "EVASIVE", "OTHER").alias("tn"))
    on = [per[k].eqNullSafe(whole[k]) for k in [*group, "_w"]]
    both = per.join(whole, on).select(*[per[k] for k in [*group, "_w", "n"]], "cc", "ce", "cn", "dd", "de", "tc", "te", "tn")
    evasive_hits = F.col("te") - F.col("ce") - F.col("de")
    ordinal = spark.createDataFrame([(float(w), i) for i, w in enumerate(weights)], "_w double, _i long")
    return both.join(F.broadcast(grid_), "n").join(F.broadcast(ordinal), "_w").select(
        *group, (F.col("_i") * len(us) * len(vs) + F.col("n")).alias("n"), F.col("_w").alias("weight"), "complete_bias", "evasive_bias",
        (F.col("cc") + F.col("dd") + evasive_hits).alias("correct"), (F.col("cc") + F.col("tn") - F.col("cn")).alias("binary"), F.col("cn").alias("fp"), (F.col("tc") - F.col("cc")).alias("fn"), evasive_hits.alias("evasive"),
    )


BIASES = ("weight", "complete_bias", "evasive_bias")


def bias_search(rows: DataFrame, first: Sequence[Column], expected: str, complete: Sequence[float], evasive: Sequence[float], denial: float = 0.0, *, second: Sequence[Column] | None = None, weights: Sequence[float] = (1.0,), group: Sequence[str] = (), objective: str = "total") -> DataFrame:
    """The first weight and biases, weights outermost, that do best by the objective."""
    return best(bias_counts(rows, first, expected, complete, evasive, denial, second=second, weights=weights, group=group), BIASES, objective, group)


def biases_out_of_fold(rows: DataFrame, first: Sequence[Column], expected: str, complete: Sequence[float], evasive: Sequence[float], fold: str, denial: float = 0.0, *, objective: str = "total") -> DataFrame:
    """For each fold the biases that do best on the others, whose counts are those of all folds less its own."""
    counts = bias_counts(rows, first, expected, complete, evasive, denial, group=[fold])
    w = Window.partitionBy("n")
    for c in ("correct", "binary", "fp", "fn", "evasive"):
        counts = counts.withColumn(c, F.sum(c).over(w) - F.col(c))
    return best(counts, BIASES, objective, [fold])


def out_of_fold(rows: DataFrame, params: DataFrame, names: Sequence[str], predicted: Column, expected: str, fold: str, folds: int, objective: str = "total") -> DataFrame:
    """For each fold the parameters that do best on the others; fold numbers run from 0."""
    held = rows.sparkSession.range(folds).select(F.col("id").cast("int").alias("held"))
    others = rows.crossJoin(F.broadcast(held)).filter(F.col(fold) != F.col("held"))
    return search(others, params, names, predicted, expected, objective, ["held"])


def calibrated(rows: DataFrame, fold_params: DataFrame, fallback: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """Each row's parameters: its group's, else the fallback's single row."""
    own = fold_params.select(group, *[F.col(n).alias(f"_{n}") for n in names])
    all_ = fallback.select(*[F.col(n).alias(f"_all_{n}") for n in names])
    out = rows.join(own, group, "left").crossJoin(F.broadcast(all_))
    for n in names:
        out = out.withColumn(n, F.coalesce(f"_{n}", f"_all_{n}"))
    return out.drop(*[f"_{n}" for n in names], *[f"_all_{n}" for n in names])


def pair_score(correct_rate: Column, label: Column, complete_rate: Column, score: tuple[float, float, float], loss: tuple[float, float, float], base: float, low: float, high: float) -> Column:
    """X11: struct (selection_score, loss_weight) of a preference pair from its rollouts."""
    mistakes = 1 - correct_rate
    false_c = F.when(label == "COMPLETE", 0.0).otherwise(complete_rate)
    missed = F.when(label == "COMPLETE", mistakes).otherwise(0.0)
    mix = lambda w: w[0] * mistakes + w[1] * false_c + w[2] * missed
    return F.struct(mix(score).alias("selection_score"), F.greatest(F.lit(low), F.least(F.lit(high), base + mix(loss))).alias("loss_weight"))


def effective_timing(segments: DataFrame) -> DataFrame:
    """Rows and seconds of each run over its gate and its continuation; resumed totals aren't counted twice."""
    own = segments.filter(F.col("segment").isin("gate", "continuation"))
    return own.groupBy("run").agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"))


def run_cost(seconds: Column, rate: Column) -> Column:
    """X17."""
    return seconds * rate / 3600


def estimate_against_observed(estimate: DataFrame, attempts: DataFrame, run: str) -> DataFrame:
    """An estimate of a run against the sums over its attempts, differences in units and in percent."""
    sums = attempts.groupBy(run).agg(*[F.sum(c).alias(f"observed_{c}") for c in ("inference_seconds", "startup_seconds", "cost")])
    out = estimate.join(sums, run)
    for c in ("inference_seconds", "startup_seconds", "cost"):
        delta = F.col(f"observed_{c}") - F.col(c)
        out = out.withColumn(f"delta_{c}", F.round(delta, 6)).withColumn(f"delta_{c}_pct", F.round(100 * delta / F.nullif(F.col(c), F.lit(0.0)), 3))
    return out
