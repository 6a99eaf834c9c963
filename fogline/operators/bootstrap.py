"""Confidence intervals of scores by a Poisson bootstrap over event blocks.

Cases of one event (a storm day, say) are not independent, so whole blocks are drawn again: in every replicate a block counts
as often as a Poisson variable of mean 1 says. The draws are a hash of seed, block and replicate, so they depend on nothing
else, need no state, and every row of a block draws the same wherever it lies.

Scores are functions of sums. So cases are first summed by group and block; a block's row carries its draws as an array, with a
1 in front for the estimate itself, and one aggregation over the spread array gives the sums of all replicates. Cases are
read once, however many replicates there are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES, SEED = 200, 0
#: Bits of a draw: eight draws of 16 bits come from one digest.
_STEPS = 1 << 16


def poisson_steps(mean: float = 1.0) -> list[int]:
    """Least 16-bit draws that count 1, 2, ...: the cumulated Poisson probabilities in steps of 1 / 65536."""
    steps, term, total = [], math.exp(-mean), 0.0
    for k in range(1, 64):
        total += term
        steps.append(math.floor(total * _STEPS))
        term *= mean / k
        if steps[-1] >= _STEPS - 1:
            break
    return steps


def block_weights(block: Column, replicates: int = REPLICATES, seed: int = SEED) -> Column:
    """Array of ``replicates`` + 1 counts of a block: 1, then its draws. The block's text and the seed decide."""
    steps = poisson_steps()
    parts = F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // 8)), lambda d: F.md5(F.concat_ws("|", F.lit(str(seed)), block.cast("string"), d.cast("string"))))
    drawn = F.flatten(F.transform(parts, lambda text: F.array(*[F.conv(F.substring(text, 4 * i + 1, 4), 16, 10).cast("int") for i in range(8)])))

    def count(u: Column) -> Column:
        found = F.when(u < steps[0], 0)
        for k, s in enumerate(steps[1:], 1):
            found = found.when(u < s, k)
        return found.otherwise(len(steps))

    return F.concat(F.array(F.lit(1)), F.transform(F.slice(drawn, 1, replicates), count))


def replicate_sums(sums: DataFrame, by: Sequence[str], block: str, values: Sequence[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(by, replicate, values) from sums by group and block; replicate 0 is the sample as it is. A null block is one block.

    Rows that a replicate does not draw are left out before the shuffle; a replicate that draws none of a group has no row.
    """
    weights = block_weights(F.coalesce(F.col(block).cast("string"), F.lit("")), replicates, seed)
    spread = sums.select(*by, *values, F.posexplode(weights).alias("replicate", "_w")).where("_w > 0")
    return spread.groupBy(*by, "replicate").agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values])


def intervals(replicated: DataFrame, by: Sequence[str], scores: Mapping[str, Column], level: float = 0.95) -> DataFrame:
    """(by, metric, value, low, high) of scores over ``replicate_sums``: bounds are interpolated quantiles of the replicates in which
    the score is defined, null if there is none."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in scores.items()])).alias("m")
    rows = replicated.select(*by, "replicate", long).select(*by, "replicate", "m.metric", "m.value")
    drawn = F.when((F.col("replicate") > 0) & ~F.isnan("value"), F.col("value"))
    tail = (1 - level) / 2
    found = rows.groupBy(*by, "metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("value"), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    return found.select(*by, "metric", "value", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))
