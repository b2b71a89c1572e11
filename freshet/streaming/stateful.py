"""The stateful path: windows that fire, fire again after late events, and a late output.

Per user the operator keeps panes. With the watermark W of a batch:

* an event before ``W - lateness`` goes to the late output as it came, and nowhere else;
* any other event is folded into its pane of each resolution; closed windows that hold it and
  have fired become dirty;
* then every window that ends at or before W and has a pane fires, if it hasn't (sequence 0),
  and every dirty one again, with the next sequence number; with ``first_watermark_ms`` set, a run
  begins with the boundary at or before that, and windows that end earlier never fire;
* panes and counters that no window can need any more go; users without panes go.

The watermark is Spark's: it never goes back, and moves per batch. ``UserWindows`` is that in plain
Python over one user's events, for replays; ``refiring`` is the operator.

Users are dealt to *parts* by a hash, and a part is what Spark groups by: each call of the operator and of the state store
costs milliseconds from Python, which users of a part share. State lies in Spark's state store (RocksDB with a changelog):
a value a part, of the panes of its users, of repeated firings, and a few numbers. There are never more panes of a user than a window's,
the lateness's and those still open. A batch adds its rows up per user and pane; windows of all users of a part are summed by arrays. A window
is known to have fired by the part's last watermark: its end lies before that, and it had a pane. Timers wake parts
with windows that close, or whose panes are out of date, without a row of theirs.

Spark drops rows behind the watermark before an operator whose input carries the column that the watermark is defined
on. That column isn't passed on here, so that late rows arrive and can fire windows again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import WindowConfig
from ..operators import windows
from ..schema import CLICK, FEATURES, PAGE_VIEW, PURCHASE, RESOLUTIONS

OUTPUT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("window_resolution", T.StringType()),
    T.StructField("window_start_ms", T.LongType()), T.StructField("window_end_ms", T.LongType()), T.StructField("emission_seq", T.IntegerType()),
    *(T.StructField(f, T.LongType() if k == "bigint" else T.DoubleType()) for f, k in FEATURES.items()),
    T.StructField("late_event", T.StringType()),
])
#: Of windows that fire once.
CLOSED = T.StructType([f for f in OUTPUT.fields if f.name not in ("kind", "emission_seq", "late_event")])
#: What the state operator needs of a session.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Plain arrays: the state operator takes no Arrow-backed columns.
KINDS = {"string": object, "bigint": np.int64, "int": np.int32, "double": np.float64}
_COUNT = {CLICK: 0, PAGE_VIEW: 1, PURCHASE: 2}


@dataclass
class UserWindows:
    """The state of one user; times in milliseconds. panes: resolution -> pane -> counts of
    clicks, views and purchases, cents, products."""

    config: WindowConfig = field(default_factory=WindowConfig)
    panes: dict[str, dict[int, list]] = field(default_factory=dict)
    fired: dict[str, dict[int, int]] = field(default_factory=dict)
    dirty: set[tuple[str, int]] = field(default_factory=set)

    def fold(self, at_ms: int, event_type: str, cents: int, product: str | None, watermark_ms: int | None) -> bool:
        """Whether the event was in time; a very late one changes nothing."""
        if watermark_ms is not None and at_ms < watermark_ms - self.config.lateness * 1000:
            return False
        for r in RESOLUTIONS:
            slide = r.slide * 1000
            index = at_ms // slide
            pane = self.panes.setdefault(r.value, {}).setdefault(index, [0, 0, 0, 0, []])
            if event_type in _COUNT:
                pane[_COUNT[event_type]] += 1
            if event_type == PURCHASE:
                pane[3] += cents
                if product not in pane[4]:
                    pane[4].append(product)
            for end in range((index + 1) * slide, (index + r.panes + 1) * slide, slide):
                if end in self.fired.get(r.value, {}):
                    self.dirty.add((r.value, end))
        return True

    def fire(self, watermark_ms: int | None) -> list[dict]:
        """Records of the windows that close, then those that fire again."""
        if watermark_ms is None:
            return []
        out = []
        for r in RESOLUTIONS:
            done = self.fired.setdefault(r.value, {})
            ends = {(i + k) * r.slide * 1000 for i in self.panes.get(r.value, {}) for k in range(1, r.panes + 1)}
            first = self._first(r)
            for end in sorted(e for e in ends if first <= e <= watermark_ms and e not in done):
                self.dirty.discard((r.value, end))
                out.append(self._record(r, end, 0))
                done[end] = 1
        by_value = {r.value: r for r in RESOLUTIONS}
        for value, end in sorted(self.dirty):
            out.append(self._record(by_value[value], end, self.fired[value][end]))
            self.fired[value][end] += 1
        self.dirty.clear()
        self._drop(watermark_ms)
        return out

    def _first(self, r) -> float:
        """The first end that fires."""
        start, slide = self.config.first_watermark_ms, r.slide * 1000
        return float("-inf") if start is None else start // slide * slide

    def _record(self, r, end: int, seq: int) -> dict:
        slide = r.slide * 1000
        held = self.panes.get(r.value, {})
        parts = [held[i] for i in range(end // slide - r.panes, end // slide) if i in held]
        clicks, views, bought, cents = (sum(p[i] for p in parts) for i in range(4))
        value = {
            "click_count": clicks, "page_view_count": views, "purchase_count": bought, "revenue": cents / 100.0,
            "distinct_products": len({x for p in parts for x in p[4]}), "avg_purchase_amount": cents / 100.0 / bought if bought else None,
        }
        features = {f: value[f] if f in r.features else None for f in FEATURES}
        return {"window_resolution": r.value, "window_start_ms": end - r.size * 1000, "window_end_ms": end, "emission_seq": seq} | features

    def _drop(self, watermark_ms: int) -> None:
        for r in RESOLUTIONS:
            oldest = int(watermark_ms - r.size * 1000 - self.config.lateness * 1000)
            held = self.panes.get(r.value, {})
            for i in [i for i in held if i < oldest // (r.slide * 1000)]:
                del held[i]
            done = self.fired.get(r.value, {})
            for end in [e for e in done if e < oldest]:
                del done[end]

    def next_end(self) -> int | None:
        """When the next window closes."""
        ends = [min((e for i in self.panes.get(r.value, {}) for k in range(1, r.panes + 1) if (e := (i + k) * r.slide * 1000) not in self.fired.get(r.value, {}) and e >= self._first(r)), default=None) for r in RESOLUTIONS]
        return min((e for e in ends if e is not None), default=None)

    def empty(self) -> bool:
        return not any(self.panes.values())

    def dump(self) -> str:
        return json.dumps({"panes": self.panes, "fired": self.fired})

    @classmethod
    def load(cls, text: str, config: WindowConfig) -> UserWindows:
        raw = json.loads(text)
        ints = lambda x: {r: {int(k): v for k, v in d.items()} for r, d in x.items()}
        return cls(config, ints(raw["panes"]), ints(raw["fired"]))


class Watermark:
    """The reference's own clock, for replays: greatest event time less the skew; after idling,
    wall-clock time less the skew, if that is later. It never goes back."""

    def __init__(self, config: WindowConfig | None = None):
        self.config = config or WindowConfig()
        self.value: int | None = None
        self.seen_at: int | None = None

    def observe(self, event_ms: int, now_ms: int) -> int:
        mark = event_ms - int(self.config.skew * 1000)
        self.value = mark if self.value is None else max(self.value, mark)
        self.seen_at = now_ms
        return self.value

    def current(self, now_ms: int) -> int | None:
        if self.value is not None and now_ms - self.seen_at >= self.config.idle * 1000:
            self.value = max(self.value, now_ms - int(self.config.skew * 1000))
        return self.value


NONE = -(2**62)
_SUMS = ("click_count", "page_view_count", "purchase_count", "cents")
#: A pane of a user as a row, for warm starts: which resolution, and up to which watermark it is known.
PANE = "user_id string, window_resolution string, pane bigint, click_count bigint, page_view_count bigint, purchase_count bigint, cents bigint, products array<string>, mark_ms bigint"
#: The state of a part: the clock (the last watermark, the timer that is set, Spark's watermark when a row came or time was
#: looked at last), the users and products that are numbered, and three tables of numbers, eight bytes each, which
#: ``Held`` names: elements of arrays would be converted one by one.
STATE = "mark bigint, timer bigint, seen bigint, users array<string>, names array<string>, panes binary, products binary, repeats binary"
#: Parts that users are dealt to, unless told otherwise.
PARTS = 256


class Numbered:
    """Texts by number, in the order in which they came; null is one of them."""

    def __init__(self, values: Iterable[str | None] = ()):
        self.values = list(values)
        self.number = {x: i for i, x in enumerate(self.values)}

    def __call__(self, column: Iterable) -> np.ndarray:
        own, seen = pd.factorize(np.asarray(column, dtype=object), use_na_sentinel=False)
        known = [self.number.setdefault(None if pd.isna(x) else x, len(self.number)) for x in seen]
        self.values.extend(list(self.number)[len(self.values) :])
        return np.array(known, dtype=np.int64)[own] if known else np.zeros(0, dtype=np.int64)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return np.array(self.values, dtype=object)[numbers]


@dataclass
class Held:
    """Users' panes, as rows of numbers, for each resolution: panes (user, pane, clicks, views, purchases, cents), the
    products bought in them (user, pane, product), and repeated firings (user, end in slides, times)."""

    users: Numbered = field(default_factory=Numbered)
    names: Numbered = field(default_factory=Numbered)
    panes: list[np.ndarray] = field(default_factory=lambda: [_rows(6) for _ in RESOLUTIONS])
    products: list[np.ndarray] = field(default_factory=lambda: [_rows(3) for _ in RESOLUTIONS])
    repeats: list[np.ndarray] = field(default_factory=lambda: [_rows(3) for _ in RESOLUTIONS])

    def dump(self) -> tuple:
        """What STATE has after the clock; users and products are numbered anew, as some are gone."""
        own, used = np.unique(np.concatenate([x[:, 0] for x in self.panes]), return_inverse=True)
        bought, sold = np.unique(np.concatenate([x[:, 2] for x in self.products]), return_inverse=True)
        panes, products, repeats = _joined(self.panes), _joined(self.products), _joined(self.repeats)
        panes[:, 1] = used
        products[:, 1], products[:, 3] = np.searchsorted(own, products[:, 1]), sold
        repeats[:, 1] = np.searchsorted(own, repeats[:, 1])
        return self.users.take(own).tolist(), self.names.take(bought).tolist(), panes.tobytes(), products.tobytes(), repeats.tobytes()

    @classmethod
    def load(cls, users: Iterable, names: Iterable, panes: bytes, products: bytes, repeats: bytes) -> Held:
        return cls(Numbered(users), Numbered(names), *(_parted(x, width) for x, width in ((panes, 6), (products, 3), (repeats, 3))))


class RefiringWindows(StatefulProcessor):
    """The windows of the users of a part (or of one user, where the rows have no ``user_id``: the key is the user then)."""

    output = OUTPUT

    def __init__(self, config: WindowConfig, idle: bool = False, least_mark_ms: int | None = None):
        self.config, self.idle = config, idle
        self.least = NONE if least_mark_ms is None else least_mark_ms
        self.lateness, self.skew = int(config.lateness * 1000), int(config.skew * 1000)
        start = config.first_watermark_ms
        self.begin = {r.value: NONE if start is None else start // (r.slide * 1000) * r.slide * 1000 for r in RESOLUTIONS}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    # -- the clock --

    def _load(self) -> tuple[int, int, int, Held]:
        """The clock and the panes."""
        held = self.state.get()
        return (NONE, NONE, NONE, Held()) if held is None else (*held[:3], Held.load(*held[3:]))

    def _save(self, mark: int, timer: int, seen: int, held: Held, now: int) -> None:
        """Keeps panes, repeats and the clock, and sets the next timer; a part without panes goes."""
        kept, wanted = any(len(x) for x in held.panes), NONE
        if kept and self.idle:
            wanted = now + int(self.config.idle * 1000)
        elif kept:
            wanted = min(self._next(r, mark, panes[:, 1]) for r, panes in zip(RESOLUTIONS, held.panes, strict=True))
            if wanted == -NONE:  # all windows have fired: when the last pane is out of date
                wanted = max((int(panes[:, 1].max()) + 1) * r.slide * 1000 + r.size * 1000 + self.lateness for r, panes in zip(RESOLUTIONS, held.panes, strict=True) if len(panes))
        if timer not in (wanted, NONE):
            self.handle.deleteTimer(timer)
        if wanted not in (timer, NONE):
            self.handle.registerTimer(wanted)
        if kept:
            self.state.update((mark, wanted, seen, *held.dump()))
        elif timer != NONE or mark != NONE:
            self.state.clear()

    def _next(self, r, mark: int, panes: np.ndarray) -> int:
        """The first end after the mark that has a record."""
        slide = r.slide * 1000
        after = self.begin[r.value] if mark == NONE else max((mark // slide + 1) * slide, self.begin[r.value])
        ends = np.maximum((panes + 1) * slide, after)
        return int(ends[ends <= (panes + r.panes) * slide].min(initial=-NONE))

    # -- rows and timers --

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, timer, _, held = self._load()
        seen = max(timerValues.getCurrentWatermarkInMs(), 0) or NONE
        mark = max(before, seen, self.least)
        sums, products = [], []
        for frame in rows:
            frame = frame if "user_id" in frame else frame.assign(user_id=key[0])
            late, own = self._taken(frame, mark)
            if len(late):
                yield _frame(OUTPUT, len(late), {"kind": ["late"], "user_id": [late["user_id"].to_numpy(object)], "late_event": [late["raw"].to_numpy(object)]}, [len(late)])
            for all_, some in zip((sums, products), self._folded(own, held), strict=True):
                all_.append(some)
            if len(sums) == 64:  # a user's panes are few, however many the events
                sums, products = [_summed(np.concatenate(sums))], [_different(np.concatenate(products))]
        yield from self._advance((np.concatenate(sums), np.concatenate(products)) if sums else None, before, mark, held)
        self._save(mark, timer, seen, held, timerValues.getCurrentProcessingTimeInMs())

    def _taken(self, frame: pd.DataFrame, mark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The very late rows, and the others."""
        late = frame["event_us"].to_numpy(np.int64) // 1000 < mark - self.lateness
        return frame[late], frame[~late] if late.any() else frame

    def _folded(self, frame: pd.DataFrame, held: Held) -> tuple[np.ndarray, np.ndarray]:
        """Rows of panes of the least slide and of products bought (see Held)."""
        kind, sums = frame["type"].to_numpy(np.int64), np.zeros((len(frame), 6), dtype=np.int64)
        sums[:, 0] = held.users(frame["user_id"])
        sums[:, 1] = frame["event_us"].to_numpy(np.int64) // (min(r.slide for r in RESOLUTIONS) * 1_000_000)
        for i in range(3):
            sums[:, 2 + i] = kind == i
        sums[:, 5] = frame["cents"].to_numpy(np.int64)
        bought = (kind == 2) & frame["product"].notna().to_numpy()
        products = np.column_stack((sums[bought, :2], held.names(frame["product"][bought])))
        return _summed(sums), _different(products)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, _, seen, held = self._load()
        spark, now = max(timerValues.getCurrentWatermarkInMs(), 0) or NONE, timerValues.getCurrentProcessingTimeInMs()
        mark = max(before, spark, self.least)
        if self.idle and spark == seen and mark != NONE:  # for as long as that nothing moved the watermark
            mark = max(mark, now - self.skew)
        yield from self._advance(None, before, mark, held)
        self._save(mark, NONE, spark, held, now)  # the timer is gone by itself

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """Panes as rows (see PANE): as if the users' events up to mark_ms had come before."""
        before, timer, seen, held = self._load()
        for i, r in enumerate(RESOLUTIONS):
            sums, products = _of_panes(initialState[(initialState["window_resolution"] == r.value).to_numpy()], held)
            held.panes[i], held.products[i] = _summed(np.concatenate((held.panes[i], sums))), _different(np.concatenate((held.products[i], products)))
        mark = max(before, int(initialState["mark_ms"].max()))
        self._save(mark, timer, seen, held, timerValues.getCurrentProcessingTimeInMs())

    # -- windows --

    def _advance(self, fresh: tuple[np.ndarray, np.ndarray] | None, before: int, mark: int, held: Held) -> Iterator[pd.DataFrame]:
        """Takes in fresh panes of the least slide and their products; the records of windows that close between the marks
        and of those fired earlier that changed. ``held`` is brought up to date."""
        least, made = min(r.slide for r in RESOLUTIONS), []
        sums, products = fresh or (_rows(6), _rows(3))
        for i, r in enumerate(RESOLUTIONS):
            # beside the sums: how many rows were there before, and how many are fresh
            live = _summed(np.concatenate((_beside(held.panes[i], 1, 0), _beside(_coarser(sums, least, r.slide), 0, 1))))
            bought = _different(np.concatenate((held.products[i], _coarser(products, least, r.slide))))
            if mark != NONE and len(live):
                made.append((r, *self._fired(i, r, live, bought, before, mark, held)))
                oldest = (mark - r.size * 1000 - self.lateness) // (r.slide * 1000)  # what no window can need any more
                live, bought = live[live[:, 1] >= oldest], bought[bought[:, 1] >= oldest]
                times = held.repeats[i]
                held.repeats[i] = times[(times[:, 1] * r.slide * 1000 >= mark - r.size * 1000 - self.lateness) & np.isin(times[:, 0], live[:, 0])]
            held.panes[i], held.products[i] = live[:, :6], bought
        if any(len(x[1]) for x in made):
            yield _records(self.output, held.users, made)

    def _fired(self, i: int, r, live: np.ndarray, bought: np.ndarray, before: int, mark: int, held: Held) -> tuple:
        """Of the windows of a resolution that fire: users, ends, sequence numbers, the sums and distinct products."""
        slide, pane = r.slide * 1000, live[:, 1]
        base = int(pane.min())
        width = int(pane.max()) - base + r.panes + 1  # so that windows of one user hold no panes of another
        keys, k = _keys(live, base, width), np.arange(1, r.panes + 1)
        end = (pane[:, None] + k) * slide
        ends = np.unique((keys[:, None] + k)[(end >= self.begin[r.value]) & (end <= mark) & ((end > before) | (live[:, 7:] > 0))])
        low, high = np.searchsorted(keys, ends - r.panes), np.searchsorted(keys, ends)
        within = lambda flags: (total := np.concatenate(([0], np.cumsum(flags))))[high] - total[low]
        user, end = ends // width, ends % width + base
        again = (end * slide <= before) & (within(live[:, 6] > 0) > 0)  # had a pane, so it has fired
        seq = np.zeros(len(ends), dtype=np.int64)
        if again.any():
            more = np.column_stack((user, end, np.ones(len(ends), dtype=np.int64)))[again]
            held.repeats[i] = times = _summed(np.concatenate((held.repeats[i], more)))
            low_end, span = int(times[:, 1].min()), int(np.ptp(times[:, 1])) + 1
            seq[again] = times[np.searchsorted(_keys(times, low_end, span), _keys(more, low_end, span)), 2]
        distinct = _distinct(bought, ends, r.panes, base, width) if "distinct_products" in r.features else None
        return user, end * slide, seq, [within(live[:, 2 + j]) for j in range(4)], distinct


class PanedWindows(RefiringWindows):
    """The same over rows that are closed panes of the least slide; none of them is late, and windows fire once."""

    output = CLOSED

    def _taken(self, frame: pd.DataFrame, mark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        return frame[:0], frame

    def _folded(self, frame: pd.DataFrame, held: Held) -> tuple[np.ndarray, np.ndarray]:
        sums, products = _of_panes(frame, held)
        return _summed(sums), _different(products)


def _rows(width: int) -> np.ndarray:
    return np.zeros((0, width), dtype=np.int64)


def _joined(tables: list[np.ndarray]) -> np.ndarray:
    """Tables of all resolutions as one, its first column the resolution's number."""
    return np.concatenate([np.column_stack((np.full(len(x), i, dtype=np.int64), x)) for i, x in enumerate(tables)])


def _parted(raw: bytes, width: int) -> list[np.ndarray]:
    rows = np.frombuffer(raw, dtype=np.int64).reshape(-1, width + 1)
    return [rows[rows[:, 0] == i, 1:] for i in range(len(RESOLUTIONS))]


def _beside(panes: np.ndarray, *flags: int) -> np.ndarray:
    return np.column_stack((panes, *(np.full(len(panes), x, dtype=np.int64) for x in flags)))


def _coarser(rows: np.ndarray, slide: int, other: int) -> np.ndarray:
    """Rows of (user, pane, ...) by panes of another slide."""
    rows = rows.copy()
    rows[:, 1] = rows[:, 1] * slide // other
    return rows


def _keys(rows: np.ndarray, base: int, width: int) -> np.ndarray:
    """One number for (user, pane), in the same order."""
    return rows[:, 0] * width + (rows[:, 1] - base)


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows of (user, pane, sums), one of each user and pane, in their order."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
    return np.column_stack((rows[first, :2], np.add.reduceat(rows[:, 2:], first, axis=0)))


def _different(rows: np.ndarray) -> np.ndarray:
    """Different rows of (user, pane, product), by user, product and pane."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))] if len(rows) else rows


def _of_panes(frame: pd.DataFrame, held: Held) -> tuple[np.ndarray, np.ndarray]:
    """Panes that are rows of a frame, and their products, as Held has them."""
    user = held.users(frame["user_id"])
    sums = np.column_stack((user, *(frame[c].to_numpy(np.int64) for c in ("pane", *_SUMS))))
    many = np.fromiter(map(len, frame["products"]), dtype=np.int64, count=len(frame))
    products = list(chain.from_iterable(frame["products"]))
    return sums, np.column_stack((np.repeat(sums[:, :2], many, axis=0), held.names(products)))


def _distinct(bought: np.ndarray, ends: np.ndarray, panes: int, base: int, width: int) -> np.ndarray:
    """Different products of the panes before each end (as keys, ascending): of a product's panes in a window the last one
    counts, which a pane is in windows that end before the product's next pane does."""
    keys = _keys(bought, base, width)
    stops = keys + panes
    same = (bought[1:, 0] == bought[:-1, 0]) & (bought[1:, 2] == bought[:-1, 2])
    stops[:-1][same] = np.minimum(stops[:-1], keys[1:])[same]
    count = lambda at: np.bincount(at, minlength=len(ends) + 1)
    return np.cumsum(count(np.searchsorted(ends, keys + 1)) - count(np.searchsorted(ends, stops, "right")))[:-1]


def _records(output: T.StructType, users: Numbered, made: list[tuple]) -> pd.DataFrame:
    """One frame of (resolution, users, ends, sequence numbers, sums, distinct products) of all resolutions."""
    columns: dict[str, list] = {f.name: [] for f in output.fields if f.name != "late_event"}
    for r, user, ends, seq, (clicks, views, bought, cents), distinct in made:
        revenue = cents / 100.0
        value = {
            "kind": "feature", "user_id": users.take(user), "window_resolution": r.value, "window_start_ms": ends - r.size * 1000, "window_end_ms": ends, "emission_seq": seq,
            "click_count": clicks, "page_view_count": views, "purchase_count": bought, "revenue": revenue, "distinct_products": distinct,
            "avg_purchase_amount": np.ma.array(revenue / np.maximum(bought, 1), mask=bought == 0),
        }
        for name, parts in columns.items():
            parts.append(value[name] if name not in FEATURES or name in r.features else None)
    many = [len(x[1]) for x in made]
    return _frame(output, sum(many), columns, many)


def _frame(output: T.StructType, n: int, columns: dict[str, list], many: list[int]) -> pd.DataFrame:
    """n rows of parts, of so many rows each: a column has an array a part, or one value for it (None: null); columns that aren't
    given are null."""
    out = {}
    for f in output.fields:
        kind, at = KINDS[f.dataType.simpleString()], 0
        values, null = np.empty(n, dtype=kind) if kind is object else np.zeros(n, dtype=kind), np.zeros(n, dtype=bool)
        for x, own in zip(columns.get(f.name, [None] * len(many)), many, strict=True):
            if x is None and kind is not object:
                null[at : at + own] = True
            else:
                values[at : at + own] = x
                null[at : at + own] = np.ma.getmask(x)
            at += own
        # nulls of objects are None
        out[f.name] = values if kind is object else (pd.arrays.FloatingArray if kind is np.float64 else pd.arrays.IntegerArray)(values, null)
    return pd.DataFrame(out, copy=False)


def _set(spark: SparkSession) -> None:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application whose state lies in RocksDB, in so many partitions (this
    can't be changed once a query has a checkpoint)."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(k, spark.conf.get(k))
    _set(own)
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def warm_panes(events: DataFrame, mark_ms: int, config: WindowConfig | None = None) -> DataFrame:
    """The state to start with (see PANE), by users: the panes that windows may still need at that
    watermark, of events that had come by then. Only events as young as that are read."""
    config, parts = config or WindowConfig(), []
    for r in RESOLUTIONS:
        oldest = int(mark_ms - r.size * 1000 - config.lateness * 1000) // (r.slide * 1000)
        own = windows.panes(events.where(F.col("event_us") >= oldest * r.slide * 1_000_000), r.slide)
        parts.append(own.select("user_id", F.lit(r.value).alias("window_resolution"), "pane", *_SUMS, "products", F.lit(mark_ms).cast("bigint").alias("mark_ms")))
    return parts[0].union(parts[1]).union(parts[2])


def part(parts: int) -> Column:
    """Which part a user is dealt to."""
    return F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")


def refiring(
    events: DataFrame, config: WindowConfig | None = None, idle: bool = False, warm: DataFrame | None = None, least_mark_ms: int | None = None, parts: int = PARTS
) -> DataFrame:
    """Rows of kind feature and late; events: flat streaming events with event_us. Events without time
    are left out; a null user is a user. Their session gets SETTINGS; queries that run, or go on from
    a checkpoint, keep the state store that they began with.

    idle: timers go by the clock on the wall. A user's windows are looked at every ``config.idle``
    seconds; where nothing moved the watermark for that long, the time less the skew is the mark
    of that user from then on, so that a silent source doesn't hold windows open. The mark of a user never
    goes back. Every user is a part then, whatever ``parts``.

    warm: panes to start with (see warm_panes), for a query without checkpoint; least_mark_ms: the
    watermark they were made for, which holds for users without any, too.

    parts: how many the users are dealt to; can't be changed once a query has a checkpoint. A part costs
    about as much a batch as thousands of its events.
    """
    config = config or WindowConfig()
    _set(events.sparkSession)
    bought = F.col("event_type") == PURCHASE
    kind = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(i)) for t, i in _COUNT.items()), F.lit(-1))
    timed = events.where("event_us is not null").withColumn("ts", F.timestamp_micros("event_us")).withWatermark("ts", f"{int(config.skew * 1000)} milliseconds")
    key = (F.col("user_id") if idle else part(parts)).alias("part")
    flat = timed.select(
        key, "user_id", "event_us", kind.alias("type"), F.coalesce(F.when(bought, F.col("price_cents") * F.col("quantity")), F.lit(0)).cast("bigint").alias("cents"),
        F.col("product_id").alias("product"), F.to_json(F.struct(*events.columns)).alias("raw"),
    )
    held = None if warm is None else warm.select(key, "*").groupBy("part")
    return flat.groupBy("part").transformWithStateInPandas(RefiringWindows(config, idle, least_mark_ms), OUTPUT, "Append", "ProcessingTime" if idle else "EventTime", held)


def of_panes(events: DataFrame, config: WindowConfig | None = None, parts: int = PARTS) -> DataFrame:
    """Records of closed windows of all resolutions, once each, by two stateful operators in a row.

    Spark's own aggregation first makes panes of a minute (with partial aggregation, so a hot user is small before
    it is dealt out) and passes them on when the watermark has closed them; the second operator
    keeps panes, not windows, and fires windows by timers. What is kept is a row a pane, where windows kept
    by themselves would be one for each of the up to 24 that a pane lies in.

    A row behind the watermark whose pane was closed is dropped; use ``refiring`` where late rows
    must count. events, parts: as there.
    """
    config = config or WindowConfig()
    _set(events.sparkSession)
    slide = min(r.slide for r in RESOLUTIONS)
    bought = F.col("event_type") == PURCHASE
    timed = events.where("event_us is not null").withColumn("ts", F.timestamp_micros("event_us")).withWatermark("ts", f"{int(config.skew * 1000)} milliseconds")
    panes = timed.groupBy("user_id", F.window("ts", f"{slide} seconds").alias("w")).agg(
        F.count_if(F.col("event_type") == CLICK).alias("click_count"),
        F.count_if(F.col("event_type") == PAGE_VIEW).alias("page_view_count"),
        F.count_if(bought).alias("purchase_count"),
        F.coalesce(F.sum(F.when(bought, F.col("price_cents") * F.col("quantity"))), F.lit(0)).cast("bigint").alias("cents"),
        F.collect_set(F.when(bought, F.col("product_id"))).alias("products"),
    )
    rows = panes.select(part(parts).alias("part"), "user_id", F.floor(F.unix_seconds("w.start") / slide).alias("pane"), *_SUMS, "products")
    return rows.groupBy("part").transformWithStateInPandas(PanedWindows(config), CLOSED, "Append", "EventTime")
