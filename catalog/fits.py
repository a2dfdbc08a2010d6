"""The response fit in SQL, as a twin: a recursion whose rows are the parameters of a group after each round.

Likelihoods are joins of the answer patterns with a table of 41 ability nodes and a log of sums of
exponentials; the update is five Newton steps per item on the expected counts. Written on its own
from the model, with the fixed values of the operator: nodes from -6 to 6, bounds, starting values,
tolerance and most rounds.
"""

from __future__ import annotations

NODES = """nodes AS (SELECT j, -6 + 0.3::DOUBLE * j AS x,
  ln(exp(-0.5::DOUBLE * (-6 + 0.3::DOUBLE * j) ** 2) / sum(exp(-0.5::DOUBLE * (-6 + 0.3::DOUBLE * j) ** 2)) OVER ()) AS prior
  FROM (SELECT unnest(range(0, 41)) AS j))"""

# Clipped chance of a right answer to an item at a node.
CHANCE = "greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, 1 / (1 + exp(-({z})))))"


def _weights(params: str) -> str:
    """``(key, pid, n, j, w, ll)``: weight of each node for each pattern under ``params`` (key, item, a, b), and its log likelihood."""
    p = CHANCE.format(z="a * (x - b)")
    return f"""(SELECT key, pid, n, j, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY key, pid) AS w,
    top + ln(sum(exp(l - top)) OVER (PARTITION BY key, pid)) AS ll
  FROM (SELECT *, max(l) OVER (PARTITION BY key, pid) AS top
    FROM (SELECT marks.key, pid, n, j, any_value(prior) + sum(CASE WHEN mark = 1 THEN ln({p}) ELSE ln(1 - {p}) END) AS l
      FROM marks JOIN {params} AS params ON marks.key = params.key AND marks.item = params.item CROSS JOIN nodes GROUP BY marks.key, pid, n, j)))"""


def _step(before: str) -> str:
    """One Newton step per (key, item) over the expected counts, from rows (key, item, a, d)."""
    p = CHANCE.format(z="a * x + d")
    return f"""(SELECT key, item,
    greatest(0.05::DOUBLE, least(5::DOUBLE, a + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, (dd * ga - ad * gd) / (aa * dd - ad * ad))))) AS a,
    d + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, (aa * gd - ad * ga) / (aa * dd - ad * ad))) AS d
  FROM (SELECT key, item, a, d, sum((r - m * p) * x) AS ga, sum(r - m * p) AS gd, sum(m * p * (1 - p) * x * x) + 1e-9::DOUBLE AS aa,
          sum(m * p * (1 - p) * x) AS ad, sum(m * p * (1 - p)) + 1e-9::DOUBLE AS dd
        FROM (SELECT key, item, a, d, x, m, r, {p} AS p FROM {before} JOIN counts USING (key, item)) GROUP BY key, item, a, d))"""


def fit_sql(patterns: str, tail: str) -> str:
    """``tail`` over ``marks``, ``nodes`` and ``fits`` (key, item, a, b, round), fitted to ``patterns`` (key, pattern, n)."""
    steps = "(SELECT key, item, a, -a * b AS d FROM live)"
    for _ in range(5):
        steps = _step(steps)
    return f"""WITH RECURSIVE {NODES},
patterns AS ({patterns}),
marks AS (SELECT key, pattern AS pid, n, item, substring(pattern, item, 1)::INTEGER AS mark
  FROM (SELECT key, pattern, n, unnest(range(1, length(pattern) + 1)) AS item FROM patterns)),
start AS (SELECT key, item, least(0.99::DOUBLE, greatest(0.01::DOUBLE, sum(mark * n) / sum(n)::DOUBLE)) AS s FROM marks GROUP BY key, item),
em AS (
  SELECT key, item, 1::DOUBLE AS a, -ln(s / (1 - s)) AS b, 0 AS round, false AS done FROM start
  UNION ALL
  SELECT * FROM (
    WITH live AS (SELECT * FROM em WHERE NOT done AND round < 500),
    weights AS {_weights("live")},
    counts AS (SELECT marks.key, marks.item, nodes.x, sum(weights.n * w) AS m, sum(weights.n * w * mark) AS r
      FROM weights JOIN marks ON weights.key = marks.key AND weights.pid = marks.pid JOIN nodes ON weights.j = nodes.j
      GROUP BY marks.key, marks.item, nodes.x),
    moved AS {steps},
    next AS (SELECT key, item, moved.a, greatest(-6::DOUBLE, least(6::DOUBLE, -moved.d / moved.a)) AS b, live.round + 1 AS round,
      live.a AS old_a, live.b AS old_b FROM moved JOIN live USING (key, item))
    SELECT key, item, a, b, round, max(greatest(abs(a - old_a), abs(b - old_b))) OVER (PARTITION BY key) < 1e-6 AS done FROM next
  )
),
fits AS (SELECT key, item, a, b, round FROM em QUALIFY round = max(round) OVER (PARTITION BY key))
{tail}"""


WEIGHTS = _weights("fits")
START_WEIGHTS = _weights("(SELECT key, item, 1::DOUBLE AS a, -ln(s / (1 - s)) AS b FROM start)")
