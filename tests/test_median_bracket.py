"""The exact median where the two percentiles miss the middle."""

from statistics import median

import pytest

from tally.operators import ranking


@pytest.mark.parametrize("shift", (0, -0.3))
def test_the_bracket_is_widened_until_it_holds_the_middle(spark, monkeypatch, shift):
    real = ranking.F.percentile_approx
    # Percentiles that are wrong by far more than their nominal error.
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda c, p, a: real(c, [max(0.0, x + shift) for x in p], a))
    values = [float((i * 7919) % 5_003) for i in range(5_000)]
    got = ranking.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (got.median, got.n) == (median(values), 5_000)
    assert tuple(ranking.exact_median(spark.createDataFrame([], "v double"), "v").first()) == (None, 0)
