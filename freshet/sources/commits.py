"""Several outputs of a batch that appear together or not at all.

Every output of a batch is staged in a folder of its own attempt, which no reader looks at. When all
are complete, one commit record that names them is put in place by a rename that fails if the batch has one
already; that is the moment when the batch exists, for all outputs. Readers take the records and open
the folders named there, nothing else, so they never see a batch that a dead run left half-written or that is
being written. A batch that Spark runs again after its commit changes nothing, and of two runs of one batch
one wins; the other's folders are swept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .folders import file_system

_RECORDS, _STAGED, _ATTEMPT = "_commits", "_staged", "attempt"


class Ledger:
    """The outputs below one folder, and which of their batches exist."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- records --

    def _names(self, folder: str) -> list[str]:
        p, fs = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _text(self, name: str) -> str:
        p, fs = file_system(self.spark, f"{self.path}/{_RECORDS}/{name}")
        raw = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(raw, "UTF-8")
        finally:
            raw.close()

    def _place(self, name: str, text: str) -> bool:
        """Puts a record in place at once; False if there is one of that name."""
        p, fs = file_system(self.spark, f"{self.path}/{_RECORDS}/{name}")
        draft = f"{self.path}/{_RECORDS}/.{name}-{uuid.uuid4().hex}"
        d, _ = file_system(self.spark, draft)
        out = fs.create(d, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(d, p, no_options)
        except Exception:
            fs.delete(d, False)
            if not fs.exists(p):
                raise
            return False
        return True

    def batches(self) -> dict[int, dict[str, list[str]]]:
        """The committed batches and, of each of their outputs, the attempt that made it and the schema (JSON)."""
        names = [n for n in self._names(_RECORDS) if not n.startswith(".")]
        rolled = [n for n in names if n.startswith("upto-")]
        out: dict[int, dict[str, list[str]]] = {}
        if rolled:
            last = max(rolled, key=lambda n: int(n[5:-5]))
            out = {int(k): v for k, v in json.loads(self._text(last)).items()}
        for n in names:
            if n.startswith("batch-") and int(n[6:-5]) not in out:
                out[int(n[6:-5])] = json.loads(self._text(n))
        return out

    def committed(self, n: int) -> bool:
        p, fs = file_system(self.spark, f"{self.path}/{_RECORDS}/batch-{n}.json")
        return fs.exists(p) or n in self.batches()

    # -- writing and reading --

    def commit(self, n: int, outputs: Mapping[str, DataFrame | Callable[[DataFrame], DataFrame]], by: str | None = None) -> bool:
        """Write batch n of all outputs, then make it exist. False (and nothing changes) if it does.

        An output may be a function of the one before it, as that was written; ``by``: a column whose values
        get a folder each."""
        if self.committed(n):
            return False
        attempt, record, written = f"{n}-{uuid.uuid4().hex}", {}, None
        for name, rows in outputs.items():
            rows = rows(written) if callable(rows) else rows
            (rows.write.partitionBy(by) if by else rows.write).parquet(self.folder(name, attempt))
            written = self.spark.read.schema(rows.schema).parquet(self.folder(name, attempt))
            record[name] = [attempt, rows.schema.json()]
        won = self._place(f"batch-{n}.json", json.dumps(record))
        if not won:
            for name in outputs:
                self._delete(self.folder(name, attempt))
        return won

    def folder(self, output: str, attempt: str) -> str:
        return f"{self.path}/{_STAGED}/{output}/{_ATTEMPT}={attempt}"

    def read(self, output: str, schema: T.StructType | None = None, attempts: bool = False) -> DataFrame:
        """The rows of an output in all batches that exist, in the schema of the last one; with schema,
        no rows if there are none. attempts: with a column of the attempt, ``batch-...``, that made them."""
        made = [x[output] for _, x in sorted(self.batches().items()) if output in x]
        if not made:
            if schema is None:
                raise ValueError(f"no batch of {self.path} has {output}")
            return self.spark.createDataFrame([], schema)
        last = T.StructType.fromJson(json.loads(made[-1][1]))
        reader = self.spark.read.schema(last.add(_ATTEMPT, "string")).option("basePath", f"{self.path}/{_STAGED}/{output}")
        rows = reader.parquet(*(self.folder(output, a) for a, _ in made))
        return rows if attempts else rows.drop(_ATTEMPT)

    # -- housekeeping --

    def roll(self) -> None:
        """One record for all batches so far, so that readers needn't open one a batch. The records that it
        replaces stay until ``sweep``."""
        held = self.batches()
        if held:
            self._place(f"upto-{max(held)}.json", json.dumps(held))

    def sweep(self) -> int:
        """Delete what dead runs staged, and records that were rolled up; returns how many. Not to be
        run beside a writer, whose batch isn't committed yet."""
        held = self.batches()
        alive = {(name, a) for own in held.values() for name, (a, _) in own.items()}
        staged = [(name, x.partition("=")[2]) for name in self._names(_STAGED) for x in self._names(f"{_STAGED}/{name}")]
        gone = [self.folder(*x) for x in staged if x not in alive]
        names = self._names(_RECORDS)
        rolled = sorted((n for n in names if n.startswith("upto-")), key=lambda n: int(n[5:-5]))
        if rolled:
            kept = json.loads(self._text(rolled[-1]))
            gone += [f"{self.path}/{_RECORDS}/{n}" for n in names if n in rolled[:-1] or (n.startswith("batch-") and n[6:-5] in kept)]
        gone += [f"{self.path}/{_RECORDS}/{n}" for n in names if n.startswith(".") and not n.endswith(".crc")]
        for x in gone:
            self._delete(x)
        return len(gone)

    def _delete(self, path: str) -> None:
        p, fs = file_system(self.spark, path)
        fs.delete(p, True)


def committed(stream: DataFrame, ledger: Ledger, outputs: Mapping[str, Callable[[DataFrame], DataFrame]], checkpoint: str, available_now: bool = True):
    """Starts a query that writes each batch to several outputs, all of them or none."""

    def write(batch: DataFrame, n: int) -> None:
        if ledger.committed(n):
            return
        batch = batch.persist()
        try:
            ledger.commit(n, {name: pick(batch) for name, pick in outputs.items()})
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
