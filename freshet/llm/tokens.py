"""Token ids as binary files: tokenise, code with rANS, write, and read back in parallel.

A data set is a folder with ``table.bin`` (the frequency table that all files share) and data
files in ascending order of document id. A data file is a run of blocks and a footer:

    block   size of the directory (u4), directory, coded ids (see rans.py)
    footer  JSON: for each block its offset, length, documents and tokens, and the first
            token's position in the file; and the CRC-32 of the table
    end     length of the footer (u4), CRC-32 of the footer (u4), ``FTOK``

The directory is a compressed Arrow stream of document ids and token counts. Blocks hold whole
documents and are coded independently, so they are decoded in parallel, each by one range read.

Frequencies are counted over all documents. Where the tokenizer
drops white space and no token spans it, each distinct run between ASCII spaces, tabs and line
ends is tokenised once and then looked up while it is in use (see Words and Recent).
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, scratch_path, slices, spread, struct_of
from .files import RangeReader, locate, written
from .memo import TOGETHER, Recent
from .rans import Table, bits_for, normalise

MEMO = 128 << 20
MARKS = ".,;:!?"
#: Fixed value: the pre-tokenizer pattern of which the shortcuts of Words are known to be right.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = struct.Struct("<II4s")
MAGIC = b"FTOK"

FILES = struct_of(("file", T.StringType()), ("part", T.IntegerType()), ("n", T.IntegerType()), ("tokens", T.LongType()))
BLOCKS = struct_of(("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("start", T.LongType()))


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others, in order, for
    the characters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(prints)))}


class Words:
    """Ids of texts, by way of their runs of non-space text where the tokenizer allows that.

    It does if it drops white space and parts text by WORD_PATTERN; then a run's ids don't
    depend on its neighbours, one mark at the end of a word is a token of its own, and, if the
    tokenizer lower-cases, neither do they on the case of A-Z. Texts of any other tokenizer are
    tokenised as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        config = json.loads(self.tokenizer.to_str())
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [config.get("pre_tokenizer") or {}]
        self.by_runs = steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("behavior") == "Removed"
        normal = config.get("normalizer") or {}
        self.folds = any(n.get("type") == "Lowercase" for n in normal.get("normalizers", [normal]))
        byte_level = any(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in steps[1:])
        self.letters = byte_letters() if self.by_runs and normal and len(steps) == 2 and byte_level else None
        self.runs, self.words = Recent(MEMO), Recent(MEMO)
        self.marks = dict(zip(MARKS, self._learn(list(MARKS)), strict=True)) if self.by_runs else {}

    def _parts(self, run: str) -> tuple[str, str]:
        """What to look up for a run: a word, folded, and the mark after it."""
        word, mark = (run[:-1], run[-1]) if len(run) > 1 and run[-1] in MARKS and run[-2].isalnum() else (run, "")
        return (word.lower() if self.folds and word.isascii() and word.isalnum() else word), mark

    def _learn(self, runs: list[str]) -> list[bytes]:
        """Ids of new runs. Words of letters are one pre-token each and go to the model at once;
        the others are tokenised in one go and dealt out by where each token starts."""
        out: dict[int, bytes] = {}
        rest = list(range(len(runs)))
        if self.letters:
            words = [i for i in rest if runs[i].isalpha()]
            normal = self.tokenizer.normalizer.normalize_str(" ".join([runs[i] for i in words])).split(" ") if words else []
            if len(normal) == len(words) and all(map(str.isalpha, normal)):
                tokenize, letters, code = self.tokenizer.model.tokenize, self.letters, {2: "H", 4: "I"}[self.dtype.itemsize]
                for i, word in zip(words, normal, strict=True):
                    piece = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                    out[i] = array(code, [t.id for t in tokenize(piece)]).tobytes()
                rest = [i for i in rest if i not in out]
        if rest:
            encoded = self.tokenizer.encode(" ".join([runs[i] for i in rest]), add_special_tokens=False)
            ids = np.array(encoded.ids, dtype=self.dtype)
            begins = np.fromiter((o[0] for o in encoded.offsets), dtype=np.int64, count=len(ids))
            ends = np.cumsum(np.fromiter((len(runs[i]) + 1 for i in rest), dtype=np.int64, count=len(rest)))
            cuts = [0, *(np.searchsorted(begins, ends) * self.dtype.itemsize).tolist()]
            raw = ids.tobytes()
            out.update(zip(rest, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return [out[i] for i in range(len(runs))]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of as many bytes as the
        vocabulary needs."""
        if not self.by_runs:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        out = []
        for at in range(0, len(texts), TOGETHER):
            out += self._some(texts[at : at + TOGETHER])
        return out

    def _some(self, texts: list[str | None]) -> list[bytes]:
        runs = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        distinct = set().union(*runs)
        distinct.discard("")
        own = self.runs.known(distinct)
        own[""] = b""
        if len(own) <= len(distinct):
            left = distinct.difference(own)
            parts = list(map(self._parts, left))
            wanted = {w for w, _ in parts}
            known = self.words.known(wanted)
            new = sorted(wanted.difference(known))
            if new:
                learnt = dict(zip(new, self._learn(new), strict=True))
                known.update(learnt)
                self.words.add(learnt)
            whole = {r: known[w] + self.marks[m] if m else known[w] for r, (w, m) in zip(left, parts, strict=True)}
            own.update(whole)
            self.runs.add(whole)
        return [b"".join(map(own.__getitem__, r)) for r in runs]


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One for all tasks of a worker process."""
    return Words(path)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, its ids as little-endian unsigned integers, end_id last, and the bytes an id takes;
    a null or empty text has the end id only."""
    schema = struct_of(("doc_id", T.LongType()), ("ids", T.BinaryType()), ("width", T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        end, width = np.array([end_id], dtype=words.dtype).tobytes(), words.dtype.itemsize
        for batch in slices(batches):
            ids = [x + end for x in words.ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())], names=schema.names)

    return docs.select(F.col(id).cast("long"), text).mapInArrow(run, schema)


def count_ids(tokens: DataFrame, most: int = 1 << 20) -> np.ndarray:
    """How often each id occurs, over all documents. What comes to the driver is bounded by the
    vocabulary, which may have at most ``most`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            widths = batch.column(1).to_pylist()
            for width in set(widths):
                raw = b"".join([x for x, w in zip(batch.column(0).to_pylist(), widths, strict=True) if w == width])
                own = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(own) > most:
                    raise ValueError(f"an id beyond {most}")
                if len(own) > len(n):
                    n = np.concatenate([n, np.zeros(len(own) - len(n), np.int64)])
                n[: len(own)] += own
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids", "width").mapInArrow(run, struct_of(("id", T.LongType()), ("n", T.LongType()))).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


# -- files -----------------------------------------------------------------------------------


def save_table(folder: str, counts: np.ndarray) -> None:
    bits = bits_for(int(np.count_nonzero(counts)))
    raw = struct.pack("<II", bits, len(counts)) + normalise(counts, bits).astype("<u4").tobytes()
    with written(f"{folder}/table.bin") as out:
        out.write(raw + struct.pack("<I", zlib.crc32(raw)))


def load_table(folder: str) -> tuple[Table, int]:
    """The table and its CRC-32."""
    fs, path = locate(f"{folder}/table.bin")
    with fs.open_input_file(path) as f:
        raw = f.read()
    raw, crc = raw[:-4], struct.unpack("<I", raw[-4:])[0]
    if zlib.crc32(raw) != crc:
        raise ValueError(f"{folder}: the frequency table is damaged")
    bits, n = struct.unpack_from("<II", raw)
    return Table(np.frombuffer(raw, "<u4", n, 8), bits), crc


def pack_block(table: Table, names: list, parts: list[np.ndarray]) -> bytes:
    rows = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(p) for p in parts], pa.int64())], names=["doc_id", "n"])
    raw = io.BytesIO()
    with pa.ipc.new_stream(raw, rows.schema) as out:
        out.write_batch(rows)
    directory = zlib.compress(raw.getvalue(), 1)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return struct.pack("<I", len(directory)) + directory + table.encode(ids)


def unpack_block(table: Table, raw: bytes) -> tuple[list, list[int], np.ndarray]:
    """Document ids, their token counts, and all their ids in a row."""
    n = struct.unpack_from("<I", raw)[0]
    rows = pa.ipc.open_stream(zlib.decompress(raw[4 : 4 + n])).read_all()
    return rows.column(0).to_pylist(), rows.column(1).to_pylist(), table.decode(raw[4 + n :])


class FileWriter:
    """Writes files of bounded size, one after another, each a run of blocks."""

    def __init__(self, folder: str, part: int, table: Table, crc: int, block: int, most: int):
        self.folder, self.part, self.table, self.crc, self.block, self.most = folder, part, table, crc, block, most
        self.n, self.out, self.names, self.parts, self.held = 0, None, [], [], 0
        self.done: list[tuple] = []

    def add(self, name, ids: np.ndarray) -> None:
        self.names.append(name)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush()

    def _flush(self) -> None:
        if not self.names:
            return
        if self.out is None:
            self.uri = f"{self.folder}/part-{self.part:06d}-{self.n:04d}.ftok"
            self.context = written(self.uri)
            self.out, self.blocks, self.at, self.tokens = self.context.__enter__(), [], 0, 0
        raw = pack_block(self.table, self.names, self.parts)
        self.out.write(raw)
        self.blocks.append([self.at, len(raw), len(self.names), self.held, self.tokens])
        self.at, self.tokens = self.at + len(raw), self.tokens + self.held
        self.names, self.parts, self.held = [], [], 0
        if self.at >= self.most:
            self._close()

    def _close(self) -> None:
        if self.out is not None:
            footer = json.dumps({"blocks": self.blocks, "table": self.crc}).encode()
            self.out.write(footer + END.pack(len(footer), zlib.crc32(footer), MAGIC))
            self.context.__exit__(None, None, None)
            self.done.append((self.uri, self.part, self.n, self.tokens))
            self.out, self.n = None, self.n + 1

    def end(self) -> list[tuple]:
        self._flush()
        self._close()
        return self.done


def read_footer(files: RangeReader, uri: str) -> dict:
    size = files.size(uri)
    n, crc, magic = END.unpack(files.read(uri, size - END.size, END.size))
    footer = files.read(uri, size - END.size - n, n) if magic == MAGIC else b""
    if magic != MAGIC or zlib.crc32(footer) != crc:
        raise ValueError(f"{uri}: its footer is damaged")
    return json.loads(footer)


def write_files(tokens: DataFrame, folder: str, block: int = 1 << 20, most: int = 128 << 20) -> DataFrame:
    """Write tokens (doc_id, ids) in ascending order of doc_id (nulls first, repeated ids by
    their ids) and return the files, one row each."""
    spark = tokens.sparkSession
    save_table(folder, count_ids(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crc = load_table(folder)
        writer = FileWriter(folder, TaskContext.get().partitionId(), table, crc, block, most)
        for batch in slices(batches):
            for name, ids, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(name, np.frombuffer(ids, f"<u{width}").astype(np.uint32))
        done = writer.end()
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=FILES.names)

    ordered = tokens.repartitionByRange(spread(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    return materialize(ordered.mapInArrow(run, FILES), "token-files")


def list_blocks(files: DataFrame) -> DataFrame:
    """All blocks of the files; start: position of the first token in the data set."""
    spark, at, rows = files.sparkSession, 0, []
    for f in files.orderBy("part", "n").toLocalIterator():  # one short row a file
        rows.append((f["file"], at))
        at += f["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            found = []
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += [(uri, b[0], b[1], base + b[4]) for b in read_footer(reader, uri)["blocks"]]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names=BLOCKS.names)
        reader.close()

    bases = spark.createDataFrame(rows, "file string, base long")
    return bases.repartition(spread(spark), "file").mapInArrow(run, BLOCKS)


def read_documents(blocks: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """Decode blocks: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = struct_of(("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), *([("ids", T.ArrayType(T.IntegerType()))] if ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = load_table(folder)
        reader = RangeReader()
        for batch in batches:
            for uri, offset, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, counts, all_ids = unpack_block(table, reader.read(uri, offset, length))
                ends = np.cumsum(counts)
                begins = ends - counts
                raw = all_ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(all_ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        reader.close()

    return blocks.mapInArrow(run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents as files, read the files back, one row a document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch_path(spark, "tokens")
    tokens = materialize(tokenise(docs, str(tokenizer), end_id), "ids")
    files = write_files(tokens, folder)
    discard(tokens, spark)
    return read_documents(list_blocks(files).repartition(spread(spark)), folder, ids=False)
