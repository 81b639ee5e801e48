"""Mixing sources to target weights: iterative proportional fitting over bounded cells (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

OTHER = "(other)"
#: Rounds of raking at most, and the largest relative gap between a marginal and its target at which it ends; rounds of calibration.
ROUNDS, TOLERANCE, CALIBRATION = 50, 1e-9, 30
#: Most cells that the targets may span (the product of their sizes, each plus one): they are one array, and are broadcast.
MOST_CELLS = 20_000
#: Production targets: equal sources, then shares of language and of topic.
TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": {"prose": 0.85, "contact": 0.1, "legal": 0.05},
}


def topic_of(text: Column) -> Column:
    """A plain topic from marks in the text: licence lines, addresses, or prose."""
    return F.when(text.contains("License"), "legal").when(text.contains("@"), "contact").otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _category(column: Column, targets: dict[str, float]) -> Column:
    return F.when(column.isin(*targets), column).otherwise(F.lit(OTHER))


def fit_weights(cells: DataFrame, targets: dict[str, dict[str, float]], *, rounds: int = ROUNDS) -> DataFrame:
    """Rake ``tokens`` of the cells to all marginals; adds ``fitted`` and ``residual``.

    A category that the targets don't name counts as OTHER and keeps its share; targets are scaled
    to the categories that have tokens. Raking ends when every marginal is met to TOLERANCE, or after ``rounds``;
    residual is the largest relative gap that is left: more than TOLERANCE where targets can't all be met.
    The cells are at most the product of the targets' sizes (each plus one), whatever the corpus, so they are one
    array, and each round is one step of a fold over it.
    """
    dims = list(targets)
    # a category's number within its dimension; the last is OTHER
    codes = {d: {k: i for i, k in enumerate([*targets[d], OTHER])} for d in dims}
    number = [F.element_at(F.create_map(*[F.lit(x) for kv in codes[d].items() for x in kv]), F.col(d)).alias(f"i{n}") for n, d in enumerate(dims)]
    rows = cells.groupBy().agg(F.array_sort(F.collect_list(F.struct(*number, F.col("tokens").cast("double").alias("tokens"), *dims))).alias("cells"))

    def marginal(weights: Column, n: int) -> Column:
        """Sums by category of dimension n, as an array."""
        size = len(codes[dims[n]])
        empty = F.array_repeat(F.lit(0.0), size)
        pairs = F.arrays_zip(F.transform("cells", lambda c: c[f"i{n}"]).alias("i"), weights.alias("w"))
        groups = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(pairs, lambda p: p["i"] == i), F.lit(0.0), lambda acc, p: acc + p["w"]))
        return F.coalesce(groups, empty)

    tokens = F.transform("cells", lambda c: c["tokens"])
    rows = rows.withColumn("w", tokens).withColumn("total", F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x))

    def goal(n: int, wanted: dict[str, float]) -> Column:
        """Tokens that each category of a dimension should have."""
        have, last = marginal(F.col("w"), n), len(wanted)
        pairs = F.arrays_zip(have.alias("h"), F.array(*[F.lit(float(v)) for v in wanted.values()], F.lit(0.0)).alias("g"))
        spare = F.coalesce(F.try_divide(have[last], F.col("total")), F.lit(0.0))
        known = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.when(x["h"] > 0, x["g"]).otherwise(0.0))

        def one(x: Column, i: Column) -> Column:
            named = F.when(x["h"] > 0, F.coalesce(F.try_divide(x["g"], known), F.lit(0.0)) * (1 - spare) * F.col("total")).otherwise(0.0)
            return F.when(i == last, x["h"]).otherwise(named)

        return F.transform(pairs, one)

    goals = [goal(n, targets[d]).alias(f"goal{n}") for n, d in enumerate(dims)]
    rows = rows.select("cells", "w", *goals)

    def scaled(w: Column, n: int) -> Column:
        """Weights scaled so that dimension n meets its goals."""

        def all_cells(s: Column) -> Column:
            def one(x: Column) -> Column:
                i = x["cells"][f"i{n}"]
                return x["w"] * F.coalesce(F.try_divide(F.col(f"goal{n}")[i], s["m"][i]), F.lit(0.0))

            return F.transform(F.arrays_zip(F.col("cells"), s["w"].alias("w")), one)

        return F.transform(F.array(F.struct(w.alias("w"), marginal(w, n).alias("m"))), all_cells)[0]  # a list of one binds the sums once

    def bound(w: Column, n: int) -> Column:
        return F.transform(F.array(w), lambda v: scaled(v, n))[0]

    def raked(w: Column) -> Column:
        for n in range(len(dims)):
            w = bound(w, n)
        return w

    def gap(w: Column) -> Column:
        def off(x: Column) -> Column:
            return F.coalesce(F.try_divide(F.abs(x["m"] - x["g"]), x["g"]), F.lit(0.0))

        return F.array_max(F.concat(*[F.transform(F.arrays_zip(marginal(w, n).alias("m"), F.col(f"goal{n}").alias("g")), off) for n in range(len(dims))]))

    start = F.struct(F.col("w").alias("w"), F.lit(1.0).alias("gap"))

    def step(acc: Column, _: Column) -> Column:
        again = F.transform(F.array(raked(acc["w"])), lambda w: F.struct(w.alias("w"), F.coalesce(gap(w), F.lit(0.0)).alias("gap")))[0]
        return F.when(acc["gap"] <= TOLERANCE, acc).otherwise(again)

    rows = rows.withColumn("end", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    rows = rows.select(F.explode(F.arrays_zip("cells", F.col("end.w").alias("w"))).alias("x"), F.col("end.gap").alias("residual"))
    return rows.select(*[F.col(f"x.cells.{d}").alias(d) for d in dims], F.col("x.cells.tokens").cast("long").alias("tokens"), F.col("x.w").alias("fitted"), "residual")


def calibrated(cells: DataFrame, rate: float) -> DataFrame:
    """Adds ``factor``: with probabilities min(1, factor x weight), ``rate`` of all tokens is expected, as far as weights allow."""
    rows = cells.groupBy().agg(F.collect_list(F.struct("*")).alias("cells"))
    total = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["tokens"])

    def expected(factor: Column) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["tokens"] * F.least(F.lit(1.0), factor * c["mix_weight"]))

    factor = F.aggregate(F.sequence(F.lit(1), F.lit(CALIBRATION)), F.lit(float(rate)), lambda f, _: F.coalesce(F.try_divide(f * rate * total, expected(f)), F.lit(0.0)))
    return rows.select(F.explode("cells").alias("c"), factor.alias("_factor")).select("c.*", "_factor")


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, *, dims: dict[str, Column] | None = None, tokens: Column | None = None, rate: float = 0.5, seed: str = "mix", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with mix_tokens, mix_weight (fitted over observed tokens of its cell), mix_prob, mix_repeat, mix_residual and mix_kept.

    mix_residual, the same in every row, is the largest relative gap between a marginal and its target after raking: targets
    that can't all be met show there.

    Documents are drawn with mix_prob = mix_weight times one factor, at most 1; the factor is such that
    ``rate`` of all tokens is expected. mix_repeat is what a drawn document still counts for where its
    probability was held at 1, so that drawn tokens times mix_repeat meet all marginals in expectation.
    The draw is a hash of doc_id and ``seed``; repeated ids are drawn alike, a null id as the text "null". Null or empty texts have no tokens
    and the weight of their cell (0 where the whole cell has none); null categories count as OTHER.
    """
    span = math.prod(len(t) + 1 for t in targets.values())
    if span > MOST_CELLS:
        raise ValueError(f"targets span {span} cells, more than {MOST_CELLS} that may be broadcast")
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.coalesce("text", F.lit("")))}
    rows = docs.withColumn("mix_tokens", tokens if tokens is not None else tokens_of(F.col("text")))
    for k, column in dims.items():
        rows = rows.withColumn(f"_mix_{k}", _category(column, targets[k]))
    cells = rows.groupBy(*[F.col(f"_mix_{k}").alias(k) for k in dims]).agg(F.sum("mix_tokens").alias("tokens"))
    cells = fit_weights(cells, targets, rounds=rounds).withColumn("mix_weight", F.coalesce(F.try_divide("fitted", "tokens"), F.lit(0.0)))
    cells = calibrated(cells, rate)
    wanted = F.col("_factor") * F.col("mix_weight")
    cells = cells.select(*[F.col(k).alias(f"_mix_{k}") for k in dims], "mix_weight", F.least(F.lit(1.0), wanted).alias("mix_prob"), F.greatest(F.lit(1.0), wanted).alias("mix_repeat"), F.col("residual").alias("mix_residual"))
    out = rows.drop("mix_weight", "mix_prob", "mix_repeat", "mix_residual", "mix_kept").join(F.broadcast(cells), [f"_mix_{k}" for k in dims], "left")  # at most MOST_CELLS
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)), 256), 1, 12), 16, 10).cast("double") / float(16**12)
    out = out.withColumn("mix_kept", draw < F.col("mix_prob"))
    return out.withColumns({f"mix_{k}": F.col(f"_mix_{k}") for k in dims}).drop(*[f"_mix_{k}" for k in dims])
