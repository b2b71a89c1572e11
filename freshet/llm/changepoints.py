"""Penalised change points: a series of days is cut where its level of spread changes.

Days are aggregated by Spark (so a hot series is small before it is dealt out), then an ordered
Python UDTF gets the days of one series after another, in order of time, and works online:

* days without rows are filled in as 0;
* for every *live* start (a place where a segment may begin: the first day, and each day that ends
  an admissible cutting of what lies before) it holds the exact integer sums of all days from the
  start on, its ``S`` and ``Q``. A new day extends them all, from the newest start back to the
  oldest, in the manner of Welford's running moments but reversed: one end is fixed to today, the
  other varies. No day is looked at again;
* a segment has at least ``min_days`` days, so the best cuttings of the next ``min_days`` days only
  depend on starts that are known: that many days are worked out together, as one matrix;
* after the last day the segments are emitted by following the best starts back.

The cost of a segment of n days with sum S and sum of squares Q is ``n * floor(1000 * ln V)``, V = 1
+ floor((n*Q - S*S) / n**2), its *spread*. Because V is rounded down, a start that looks hopeless today can
win later (long runs whose spread stays just below a whole number cost less than their parts), so
none is given up: a series of n days takes n**2 / 2 integer steps and memory for n starts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import struct_of

#: Keys hold a cutting's cost above its number of segments: days of a series, and bits for them.
MOST_DAYS, COUNT_BITS = 1 << 20, 20
_NEVER = np.iinfo(np.int64).max


class Cuts:
    """The best cuttings of the days so far; ``push`` days in order, then ask for ``segments``."""

    def __init__(self, min_days: int = 14, penalty: int = 40_000):
        if not 1 <= min_days or not 0 <= penalty < 1 << 32:
            raise ValueError("at least one day a segment, and a penalty from 0 to 2**32")
        self.min_days, self.penalty = min_days, penalty
        self.days = self.squares = 0
        self.waiting: list[int] = []
        # of each start: sums of the days from it on, and the key of what lies before it
        self.sums = np.zeros(1, dtype=np.int64)
        self.powers = np.zeros(1, dtype=np.int64)
        self.before = np.zeros(1, dtype=np.int64)
        self.back: list[int] = [0]

    def push(self, value: int) -> None:
        self.waiting.append(value)
        if len(self.waiting) == self.min_days:
            self._extend()

    def _extend(self) -> None:
        """Takes in the days that wait."""
        old, new, starts = self.days, len(self.waiting), len(self.sums)
        if old + new > MOST_DAYS:
            raise ValueError(f"a series of more than {MOST_DAYS} days")
        self.squares += sum(x * x for x in self.waiting)
        kind = np.int64 if (old + new) * self.squares < 1 << 62 and self.sums.dtype == np.int64 else object
        x = np.array(self.waiting, dtype=kind)
        self.sums, self.powers = self.sums.astype(kind), self.powers.astype(kind)
        s = self.sums[None, :] + np.cumsum(x)[:, None]
        q = self.powers[None, :] + np.cumsum(x * x)[:, None]
        today = np.arange(old + 1, old + new + 1)
        keys = self.before[None, :] + self._penalties(starts) + (self._costs(s, q, today[:, None] - np.arange(starts)[None, :]) << COUNT_BITS) + 1
        keys[(today[:, None] - np.arange(starts)[None, :] < self.min_days) | (self.before == _NEVER)[None, :]] = _NEVER
        best = keys.argmin(axis=1)  # the first, that is the earliest start, of equal ones
        self.back += best.tolist()
        self.before = np.concatenate([self.before, keys[np.arange(new), best]])
        # the days themselves are starts from now on: sums of the days after them
        self.sums = np.concatenate([s[-1], x.sum() - np.cumsum(x)])
        self.powers = np.concatenate([q[-1], (x * x).sum() - np.cumsum(x * x)])
        self.days += new
        self.waiting = []

    def _penalties(self, starts: int) -> np.ndarray:
        out = np.full(starts, self.penalty << COUNT_BITS, dtype=np.int64)
        out[0] = 0
        return out[None, :]

    @staticmethod
    def _costs(s: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        spread = 1 + (n * q - s * s) // (n * n)
        if spread.dtype == object:
            logs = np.array([math.floor(1000 * math.log(v)) for v in spread.flat], dtype=np.int64).reshape(spread.shape)
        else:
            logs = np.floor(1000 * np.log(spread)).astype(np.int64)
        return n * logs

    def segments(self) -> tuple[list[tuple[int, int]], int]:
        """(start, end) of each segment, from the first on, and the cost of them all."""
        if self.waiting:
            self._extend()
        if self.days < self.min_days:
            whole = [(0, self.days)] if self.days else []
            return whole, int(self._costs(self.sums[:1], self.powers[:1], np.array([self.days]))[0]) if whole else 0
        out, end = [], self.days
        while end:
            out.append((self.back[end], end))
            end = self.back[end]
        return out[::-1], int(self.before[self.days]) >> COUNT_BITS


class Segments:
    """The UDTF: rows (key, day, value) of one key in order of day."""

    def __init__(self):
        self.cuts: Cuts | None = None
        self.values: list[int] = []

    def eval(self, row, min_days: int, penalty: int):
        if self.cuts is None:
            self.cuts, self.key, self.first = Cuts(min_days, penalty), row[0], row[1]
        day, value = row[1], row[2]
        gap = day - self.first - len(self.values)
        if gap > MOST_DAYS:
            raise ValueError(f"a series of more than {MOST_DAYS} days")
        for x in (*[0] * gap, value):
            self.cuts.push(x)
            self.values.append(x)

    def terminate(self):
        if self.cuts is None:
            return
        parts, best = self.cuts.segments()
        for i, (start, end) in enumerate(parts, 1):
            x, n = self.values[start:end], end - start
            total = sum(x)
            spread = 1 + (n * sum(v * v for v in x) - total * total) // (n * n)
            yield self.key, i, self.first + start, n, total, spread, n * math.floor(1000 * math.log(spread)), len(parts), best


def change_points(rows: DataFrame, key: str, at: str, value: str, min_days: int = 14, penalty: int = 40_000) -> DataFrame:
    """The segments of each key's series, one row each: the key, segment_no (from 1), first_day (days
    since 1970), n_days, total, spread, cost, n_segments and best_cost (of the series, a penalty for
    each cut included).

    rows: a whole number (``value``) at a date or time (``at``); rows where either is null take no
    part, repeated rows count each. A series goes from its key's first to its last day; rows with a
    null key are one series. A series shorter than ``min_days`` is one segment. Of cuttings of equal
    cost the one of fewest segments wins, then that of the earliest starts, from the last back. An
    empty table has no segments; other columns of rows play no part. A series of more than 2**20
    days (of broken dates, that is) is an error; sums that don't fit a long are one too.
    """
    taken = rows.select(F.col(key).alias("key"), F.unix_date(F.to_date(F.col(at))).cast("long").alias("day"), F.col(value).cast("long").alias("value"))
    days = taken.where("day is not null and value is not null").groupBy("key", "day").agg(F.sum("value").alias("value"))
    long = T.LongType()
    schema = struct_of(
        (key, rows.schema[key].dataType), ("segment_no", T.IntegerType()), ("first_day", long), ("n_days", long), ("total", long),
        ("spread", long), ("cost", long), ("n_segments", long), ("best_cost", long),
    )
    table = F.udtf(Segments, returnType=schema)
    return table(days.asTable().partitionBy("key").orderBy("day"), F.lit(min_days), F.lit(penalty))


def op11_change_points(spark, sf_dir: str) -> DataFrame:
    """Segments of each vendor's quantities shipped a day."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").select("vendor_id", "shipped_at", "quantity")
    return change_points(lines, "vendor_id", "shipped_at", "quantity")


#: The state of the recursion is a vendor's list of best cuttings so far; -1 stands for none.
OP11_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT vendor_id, CAST(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS BIGINT) AS day, CAST(sum(quantity) AS BIGINT) AS x
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
v AS MATERIALIZED (SELECT row_number() OVER () AS v, vendor_id, min(day) AS first, max(day) - min(day) + 1 AS days FROM d GROUP BY vendor_id),
g AS (SELECT v, first, days, vendor_id, unnest(generate_series(0, days - 1)) AS i FROM v),
x AS (SELECT g.v, g.i, coalesce(d.x, 0) AS x FROM g LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM g.vendor_id AND d.day = g.first + g.i),
p AS MATERIALIZED (SELECT v, i + 1 AS t, sum(CAST(x AS HUGEINT)) OVER w AS s, sum(CAST(x AS HUGEINT) * x) OVER w AS q FROM x WINDOW w AS (PARTITION BY v ORDER BY i)
  UNION ALL SELECT v, 0, 0, 0 FROM v),
c AS (SELECT a.v, a.t AS b, e.t AS e, e.t - a.t AS n, CAST(e.s - a.s AS HUGEINT) AS s, CAST(e.q - a.q AS HUGEINT) AS q
  FROM p a JOIN p e ON a.v = e.v AND a.t < e.t JOIN v ON v.v = a.v WHERE e.t - a.t >= 14 OR (a.t = 0 AND e.t = v.days AND v.days < 14)),
k AS (SELECT v, b, e, n, CAST(s AS BIGINT) AS total, CAST(1 + (n * q - s * s) // (n * n) AS BIGINT) AS spread FROM c),
f AS MATERIALIZED (SELECT *, n * CAST(floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost FROM k),
l AS MATERIALIZED (SELECT v, e, list({'b': b, 'cost': cost} ORDER BY b) AS own FROM f GROUP BY v, e),
r AS (SELECT v, days, 0 AS t, [{'cost': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'b': CAST(-1 AS BIGINT)}] AS best FROM v
  UNION ALL
  SELECT r.v, r.days, r.t + 1, list_append(r.best, coalesce(list_min(list_transform(list_filter(l.own, lambda o: o.b = 0 OR r.best[o.b + 1].b >= 0),
    lambda o: {'cost': r.best[o.b + 1].cost + o.cost + CASE WHEN o.b > 0 THEN 40000 ELSE 0 END, 'n': r.best[o.b + 1].n + 1, 'b': CAST(o.b AS BIGINT)})),
    {'cost': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'b': CAST(-1 AS BIGINT)}))
  FROM r LEFT JOIN l ON l.v = r.v AND l.e = r.t + 1 WHERE r.t < r.days),
z AS MATERIALIZED (SELECT v, best, days FROM r WHERE t = days),
h AS (SELECT v, best, days AS e, best[days + 1].b AS b, best[days + 1].n AS no, best[days + 1].n AS n_segments, best[days + 1].cost AS best_cost FROM z
  UNION ALL SELECT v, best, b, best[b + 1].b, no - 1, n_segments, best_cost FROM h WHERE b > 0)
SELECT vendor_id, CAST(no AS INTEGER) AS segment_no, CAST(first + h.b AS BIGINT) AS first_day, CAST(f.n AS BIGINT) AS n_days, total, spread, CAST(cost AS BIGINT) AS cost,
  CAST(n_segments AS BIGINT) AS n_segments, CAST(best_cost AS BIGINT) AS best_cost
FROM h JOIN f ON f.v = h.v AND f.b = h.b AND f.e = h.e JOIN v ON v.v = h.v
"""
