"""Mixing sources to target weights by iterative proportional fitting.

The corpus is summed to cells (source, language, topic) of tokens.  Each sweep
scales the cells' weights so that one margin after the other meets its target
shares, until all margins do.  Documents are then sampled with the probability
of their cell, which is its weight over the largest weight: the sample's
expected token mix is exactly the fitted one, and the cell that the targets
favour most is kept whole.

Cells are summed before anything else.  While their count stays within
CELLS_IN_TASK one task fits them; beyond that every sweep is a grouping and a
join with the margins' factors, written and read back, and only the margins'
largest error passes through the driver.  Targets that the cells cannot meet at
once (a value that never occurs with another) leave an error after MAX_SWEEPS;
the weights then are the last sweep's, and margin_error says by which part a
margin was still off.

A document is sampled by the hash of its id and text, so a rerun, a lost
executor or a repeated row changes nothing.  A null source, language or text is
a value of its own (topic of null text: that of empty text).  Cells without
tokens have weight 1 and keep all their documents' relative probability.  Empty
input: empty result.  Other columns pass through; of clashing names the
operator's own wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm import common

DIMENSIONS = ("source", "lang", "topic")
#: target shares are the corpus's own shares to this power, made to sum to one: 1 leaves a margin as it is, 0 makes its values equal
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 1.0}
TOLERANCE = 1e-6
MAX_SWEEPS = 40
#: cells up to which one task fits them
CELLS_IN_TASK = 200_000
BROADCAST_ROWS = 50_000


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse topic by form: tables, code, numbers, lists, long and short prose."""
    t = F.coalesce(text, F.lit(""))
    marks = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]"))
    return (F.when(marks("|") * 10 > tokens, "table").when(marks("{};=<>") * 5 > tokens, "code")
            .when(marks("0-9") * 2 > tokens, "numbers").when(marks("\\n") * 8 > tokens, "list")
            .when(tokens >= 800, "long").otherwise("short"))


OWN = ("n_tokens", "topic", "draw")
RATED = ("weight", "probability", "margin_error", "sampled")
#: columns of a join's small side, under names that no input should have; of equal names the input's goes
CELL, RATE = "mixing cell", "mixing rate"


def described(docs: DataFrame) -> DataFrame:
    """docs with n_tokens, topic and draw, a number in [0, 1) by the hash of id and text."""
    own = [c for c in docs.columns if c not in OWN]
    text = F.col("text").cast("string")
    with_tokens = docs.select(*own, n_tokens(text).alias("n_tokens"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return with_tokens.select(*own, "n_tokens", topic(text, F.col("n_tokens")).alias("topic"), draw.alias("draw"))


def key(name: str) -> Column:
    """A dimension's value as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def cells_of(described_docs: DataFrame) -> DataFrame:
    return described_docs.groupBy(*(key(d).alias(d) for d in DIMENSIONS)).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): target shares of a dimension, from its own shares to a power."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0").select(F.col(dimension).alias("value"), F.pow(F.col("t"), F.lit(power)).alias("s"))
    return own.join(own.agg(F.sum("s").alias("all")).withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).select("value", (F.col("s") / F.col("all")).alias("share"))


def goals_of(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Targets of the values that have tokens, scaled up to sum to one."""
    out = {}
    for d, t in targets.items():
        present = t.join(cells.where("tokens > 0").select(F.col(d).alias("value")).distinct(), "value")
        total = present.agg(F.sum("share").alias("all")).withColumn("one", F.lit(1))
        out[d] = present.join(total, F.lit(1) == F.col("one")).select(F.col("value").alias(d), (F.col("share") / F.col("all")).alias("goal"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS, in_task: int = CELLS_IN_TASK) -> DataFrame:
    """cells with weight and margin_error: tokens * weight meets the target shares of every dimension,
    but for margin_error, the largest relative correction that the last sweep made.

    Targets for values that no cell has are left out and the others scaled up;
    values without a target get weight 0.  Up to in_task cells, by count, are
    fitted in one task; more are fitted by groupings and joins."""
    goals = goals_of(cells, targets)
    if cells.count() <= in_task:
        wide = cells
        for d, goal in goals.items():
            wide = wide.join(goal.withColumnRenamed("goal", f"goal_{d}"), d, "left")
        schema = ", ".join(f"{c} {t}" for c, t in cells.dtypes) + ", weight double, margin_error double"
        columns, dimensions = cells.columns, list(goals)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            index = {d: pdf[d].astype("category").cat.codes.to_numpy() for d in dimensions}
            tokens, weight, worst = pdf["tokens"].to_numpy(float), np.ones(len(pdf)), 0.0
            for _ in range(max_sweeps):
                worst = 0.0
                for d in dimensions:
                    now = np.bincount(index[d], tokens * weight)[index[d]]
                    goal = pdf[f"goal_{d}"].fillna(0.0).to_numpy()
                    factor = np.where(now > 0, goal / np.where(now > 0, now, 1), 1.0)
                    worst = max(worst, np.abs(factor[(now > 0) & (goal > 0)] - 1).max(initial=0))
                    weight = weight * factor
                if worst <= tolerance:
                    break
            return pdf[columns].assign(weight=weight, margin_error=worst)

        return wide.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, schema)
    goals = {d: common.scratch_table(g, "mixing-goals") for d, g in goals.items()}
    state, moved = cells.withColumn("weight", F.lit(1.0)), [0.0]
    for _ in range(max_sweeps):
        moved = []
        for d, goal in goals.items():
            now = state.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factor = now.join(goal, d, "left").select(d, F.coalesce("goal", F.lit(0.0)).alias("goal"), F.when(
                F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(F.lit(1.0)).alias("factor"))
            factor = common.scratch_table(factor, "mixing-factors")
            state = common.scratch_table(state.join(factor.select(d, "factor"), d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "mixing-sweep")
            moved.append(factor.where("goal > 0").agg(F.max(F.abs(F.col("factor") - 1)).alias("e")).first()["e"] or 0.0)  # one number a dimension
        if max(moved) <= tolerance:  # every margin was met before it was scaled
            break
    return state.withColumn("margin_error", F.lit(float(max(moved))))


def calibrated(full: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of described() with weight, probability and sampled."""
    cells = common.scratch_table(cells_of(full), "mixing-cells")
    fitted = rake(cells, targets or {d: tempered(cells, d, TEMPER[d]) for d in DIMENSIONS})
    top = fitted.agg(F.max("weight").alias("top")).withColumn("one", F.lit(1))
    rates = fitted.join(top, F.lit(1) == F.col("one")).select(
        *DIMENSIONS, "weight", (F.col("weight") / F.col("top")).alias("probability"), "margin_error")
    rates = common.scratch_table(rates, "mixing-rates")
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    out = full.join(rates.select(F.struct(*DIMENSIONS).alias(CELL), F.struct("weight", "probability", "margin_error").alias(RATE)),
                    F.struct(*(key(d).alias(d) for d in DIMENSIONS)) == F.col(CELL))
    own = [F.col(f"`{c}`") for c in full.columns if c not in RATED]
    return out.select(*own, *(F.col(RATE)[c].alias(c) for c in RATED[:3]), (F.col("draw") < F.col(RATE)["probability"]).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled rows of docs, with weight and probability, which replace columns of these names."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("weight", "probability")]
    return calibrated(described(docs), targets).where("sampled").select(*kept, "weight", "probability")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Cell, weight, probability and draw of every document."""
    docs = described(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = common.scratch_table(docs.select("doc_id", "source", "lang", *OWN), "mixing-documents")
    return calibrated(rows).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled", "margin_error")
