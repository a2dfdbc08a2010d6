"""What leaving "no score" codes in would do to an average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally import fixed
from tally.functions.text import trimmed
from tally.functions.values import coerce_numeric

SENTENCE = (
    "%s of %s scores (~%.0f%%) were codes for 'no score'. Averaged as if they were marks "
    "they read %.1f instead of %.1f, a bias of %+.1f points."
)


def sentinel_impact(df: DataFrame, column: str) -> DataFrame:
    """Counts, both means, the bias and a sentence, from one aggregate."""
    text = F.col(column).cast("string")
    number = coerce_numeric(text)
    coded = F.coalesce(trimmed(text).isin(*fixed.SENTINELS), F.lit(False))
    one = df.agg(
        F.count_if(coded).alias("n_sentinel"),
        F.count(number).alias("n_total"),
        F.avg(number).alias("naive_mean"),
        F.avg(F.when(~coded, number)).alias("correct_mean"),
    ).withColumn("bias", F.col("naive_mean") - F.col("correct_mean"))
    share = F.col("n_sentinel") / F.col("n_total") * 100
    sentence = F.format_string(
        SENTENCE,
        F.format_number("n_sentinel", 0),
        F.format_number("n_total", 0),
        share,
        "naive_mean",
        "correct_mean",
        "bias",
    )
    return one.withColumn("sentence", sentence)
