"""How far running streams are behind their sources, out of the progress that Spark reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def _offsets(text: str | None) -> dict[tuple, int]:
    """The numbers in a source's offsets as JSON, by the path to them ({topic: {partition: n}})."""
    found, open_ = {}, [((), json.loads(text) if text and text[0] in "{[-0123456789" else None)]
    while open_:
        at, value = open_.pop()
        if isinstance(value, dict):
            open_ += [((*at, k), v) for k, v in value.items()]
        elif isinstance(value, int):
            found[at] = value
    return found


def offsets_behind(latest: str | None, end: str | None) -> int | None:
    """What lies between a batch's end and the source's latest offsets, added up over partitions;
    those without an end are skipped. None where the source doesn't report its latest offsets."""
    ahead, done = _offsets(latest), _offsets(end)
    return sum(max(0, n - done[p]) for p, n in ahead.items() if p in done) if ahead else None


class LagSamples(StreamingQueryListener):
    """Lag after each batch of the queries named ``name`` (all, if None).

    Sources that report their latest offsets, as Kafka does, are behind by what is left up to these.
    For others ``rows`` is how many there are to read, and what the batches have read is taken off;
    without it they give no sample. A sample is kept for each batch, the last ``most`` of them.
    """

    def __init__(self, name: str | None = None, rows: int | None = None, most: int = 100_000) -> None:
        self.name, self.rows, self.most = name, rows, most
        self.kept: list[tuple[int, int, int]] = []
        self._seen: dict[str, int] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is not None and p.name != self.name:
            return
        self._seen[str(p.id)] = self._seen.get(str(p.id), 0) + p.numInputRows
        behind = [x for s in p.sources if (x := offsets_behind(s.latestOffset, s.endOffset)) is not None]
        if behind:
            lag = sum(behind)
        elif self.rows is not None:
            lag = max(0, self.rows - sum(self._seen.values()))
        else:
            return
        self.kept = [*self.kept, (p.batchId, lag, p.numInputRows)][-self.most :]

    def samples(self, spark: SparkSession) -> DataFrame:
        """seq (the batch), lag, rows (read by the batch): what ``metrics.lag_ramp`` takes."""
        return spark.createDataFrame(self.kept, "seq bigint, lag bigint, rows bigint")
