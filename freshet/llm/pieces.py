"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks over the normalised text once. For each position it keeps the best way to
reach it (score, last piece, backpointer), looking back over at most the longest piece. All
paths that can still win go through the positions of that window; as soon as their
backpointers meet in one boundary, the ids up to it are committed and forgotten, so that a
text of any length needs little more than a window.

What *best* means is up to the model's type. In a unigram model it is the greatest sum of the
pieces' scores. In a BPE model a path counts if its pieces are what the merges make of it: a
sequence is the merges' result exactly if that holds for every two neighbours, and for each
prefix of a text there is one such sequence; neighbours are judged by merging just the two
(remembered per pair). Which pieces end at a position is read off an automaton of all pieces
(Aho-Corasick), one step a character. Characters that no piece has become byte pieces, or the
unknown id.

Between two characters that stand side by side in no piece all paths meet, whatever else the
text holds. These boundaries need no search: a whole text is committed at each of them, at spaces
and line ends first, if the model lets them part everything, and inside of parts met for the first
time wherever else it holds. Between two such boundaries the search runs as described, and its ids
are remembered while the part is in use.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, struct_of
from .memo import TOGETHER, Recent

SPACE = "▁"
#: Bytes of a worker's memo, about; pairs of pieces and steps of the automaton that are remembered.
MEMO, PAIRS, STEPS = 80 << 20, 200_000, 200_000
#: A state of the automaton maps a character to the next state. Two more keys: the pieces that end
#: there with their lengths, the longest first, and the state of the longest shorter end.
ENDS, SHORTER = "", None
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
UNKNOWN_SURFACE = " ⁇ "


class PieceModel:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, unigram: bool | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
        sp = self.library
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.unigram = is_unigram(sp.serialized_model_proto()) if unigram is None else unigram
        self.inside = {x[i : i + 2] for x in self.ids for i in range(len(x) - 1)}
        self.root, self.steps = self._automaton(), 0
        self.splits_at_space = not any(b[1] == SPACE and b[0] != SPACE for b in self.inside)
        self.splits_at_line = not any("\n" in b for b in self.inside)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple[bool, set[str], set[str]]] = {}
        surface = {i: b"" for i in range(n)} | {i: x.replace(SPACE, " ").encode() for x, i in self.ids.items()}
        surface |= {i: bytes([b]) for b, i in self.bytes.items()} | {self.unknown: UNKNOWN_SURFACE.encode()}
        self.surface = [surface[i] for i in range(n)]
        start = sp.encode("a")
        self.prefix = bool(start) and self.names[start[0]].startswith(SPACE)

    # -- which pieces end where --

    def _automaton(self) -> dict:
        root: dict = {ENDS: ()}
        for x in self.ids:
            node = root
            for c in x:
                node = node.setdefault(c, {ENDS: ()})
            node[ENDS] = ((x, len(x)),)
        root[SHORTER] = root
        open_ = deque([(root, root)])
        while open_:
            node, shorter = open_.popleft()
            node[SHORTER] = shorter
            for c, child in node.items():
                if c:
                    to = shorter
                    while c not in to and to is not root:
                        to = to[SHORTER]
                    to = root if node is root else to.get(c, root)
                    child[ENDS] += to[ENDS]
                    if not child[ENDS] or child[ENDS][-1][1] > 1:  # a character stands for itself at least
                        child[ENDS] += ((c, 1),)
                    open_.append((child, to))
        return root

    def step(self, node: dict, c: str) -> dict:
        """The state after a character that leads on to no longer piece."""
        to = node
        while (found := to.get(c)) is None:
            if to is self.root:  # no piece begins with it
                return {ENDS: ((c, 1),), SHORTER: self.root}
            to = to[SHORTER]
        if self.steps < STEPS:
            self.steps += 1
            node[c] = found
        return found

    # -- the merges of a BPE model --

    def merge(self, text: str, watch=None) -> list[str]:
        """What the merges make of a short text: the pair of best score first, then leftmost."""
        parts, get = list(text), self.scores.get
        costs = [get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while costs and (best := max(costs)) > NEVER:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(costs):
                costs[at] = get(parts[at] + parts[at + 1], NEVER)
            if watch:
                watch(parts)
        return parts

    def sides(self, a: str) -> tuple[bool, set[str], set[str]]:
        """Whether the merges make a of its characters, and what stands first and last in it
        while they do."""
        found = self.spines.get(a)
        if found is None:
            first, last = {a[0]}, {a[-1]}
            parts = self.merge(a, lambda parts: (first.add(parts[0]), last.add(parts[-1])))
            found = self.spines[a] = (parts == [a], first, last)
        return found

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b side by side. They surely do if nothing that stands
        last in a joins what stands first in b. An empty a is the begin of a text."""
        found = self.pairs.get((a, b))
        if found is None:
            whole, _, last = self.sides(a) if a else (True, (), ())
            also, first, _ = self.sides(b)
            found = whole and also
            if found and a and a[-1] + b[0] in self.inside and any(x + y in self.ids for x in last for y in first):
                found = self.merge(a + b) == [a, b]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found


def is_unigram(proto: bytes) -> bool:
    """model_type of the trainer's settings in the model file: field 3 of field 2; 1 if unset."""

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        p = 0

        def varint() -> int:
            nonlocal p
            value = shift = 0
            while True:
                byte = raw[p]
                p += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while p < len(raw):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                n = {1: 8, 5: 4}.get(kind) or varint()
                yield tag >> 3, raw[p : p + n]
                p += n

    for number, value in fields(proto):
        if number == 2 and isinstance(value, bytes):
            return dict(fields(value)).get(3, 1) == 1
    return True


class Stream:
    """One streaming search. Feed characters, take committed pieces, then finish."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.text = ""  # since the last committed boundary
        self.best: list[tuple[float, int, str] | None] = [(0.0, -1, "")]  # score, from, piece; first the last committed one
        self.node = model.root  # of the automaton
        self.widest = 1  # characters held at most so far
        self.commits = 0  # boundaries up to which ids were committed while reading

    def feed(self, text: str) -> Iterator[str]:
        """Pieces committed while reading text."""
        step = self.m.longest
        for at in range(0, len(text), step):
            some = text[at : at + step]
            self.text += some
            if self.m.unigram:
                self._sum(some)
            else:
                self._merged(some)
            self.widest = max(self.widest, len(self.text))
            if len(self.text) >= 2 * step:
                yield from self._commit()

    def _sum(self, some: str) -> None:
        """For each character of some the best way to end there by the sum of scores."""
        scores, best, node = self.m.scores, self.best, self.node
        for c in some:
            node = node.get(c) or self.m.step(node, c)
            end, found = len(best), None
            for piece, size in node[ENDS]:
                origin = best[end - size] if size <= end else None
                if origin is None:
                    continue
                total = origin[0] + scores.get(piece, self.m.unknown_score)
                if found is None or total > found[0]:
                    found = (total, end - size, piece)
            best.append(found)
        self.node = node

    def _merged(self, some: str) -> None:
        """For each character of some the one way to end there that the merges allow."""
        best, node, known = self.best, self.node, self.m.pairs.get
        end = len(best) - 1
        for c in some:
            node = node.get(c) or self.m.step(node, c)
            end += 1
            for piece, size in node[ENDS]:
                origin = best[end - size] if size <= end else None
                if origin is None:
                    continue
                fits = known((origin[2], piece))
                if fits is None:
                    fits = self.m.neighbours(origin[2], piece)
                if fits:
                    best.append((0.0, end - size, piece))
                    break
            else:
                best.append(None)
        self.node = node

    def _path(self, end: int) -> list[int]:
        path = [end]
        while path[-1] > 0:
            path.append(self.best[path[-1]][1])
        return path

    def _commit(self) -> Iterator[str]:
        """Commit up to the last boundary that all paths of the window go through."""
        n = len(self.text)
        live = [i for i in range(max(0, n - self.m.longest + 1), n + 1) if self.best[i] is not None]
        first = self._path(live[-1])
        shared = set(first)
        meet = first[0]
        for i in live[:-1]:
            while i not in shared:
                i = self.best[i][1]
            meet = min(meet, i)
        if meet > 0:
            self.commits += 1
            yield from self._take(meet)

    def _take(self, end: int) -> Iterator[str]:
        path = self._path(end)[::-1]
        pieces = [self.best[i][2] for i in path[1:]]
        base = self.best[end][0]
        self.text = self.text[end:]
        self.best = [(0.0, -1, self.best[end][2]), *((x and (x[0] - base, x[1] - end, x[2])) for x in self.best[end + 1 :])]
        yield from pieces

    def finish(self) -> Iterator[str]:
        """The rest of the pieces."""
        if self.text:
            yield from self._take(len(self.text))


class Codec:
    """Encodes and decodes texts with a model."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.parts = Recent(MEMO)
        self.codes = {x: i.to_bytes(4, "little") for x, i in model.ids.items()}
        line = "\n" if model.splits_at_line else ""
        self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if model.splits_at_space else None

    def _ids(self, pieces: Iterable[str]) -> list[int]:
        out, unknown = [], False
        for p in pieces:
            i = self.m.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.m.bytes:
                out += [self.m.bytes[b] for b in p.encode("utf-8", "replace")]
            elif not unknown:  # characters without a piece that follow each other are one unknown
                out.append(self.m.unknown)
            unknown = i is None
        return out

    def _pieces(self, text: str) -> list[str]:
        stream = Stream(self.m)
        return [*stream.feed(text), *stream.finish()]

    def search(self, text: str) -> list[int]:
        """Ids of a normalised text by one streaming search."""
        return self._ids(self._pieces(text))

    def _packed(self, text: str) -> bytes:
        """The same as bytes."""
        pieces = self._pieces(text)
        try:
            return b"".join(map(self.codes.__getitem__, pieces))
        except KeyError:  # a character without a piece
            return np.array(self._ids(pieces), dtype="<u4").tobytes()

    def _cuts(self, part: str) -> list[str]:
        inside, out, at = self.m.inside, [], 0
        if inside.issuperset(map(add, part, part[1:])):
            return [part]
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in inside:
                out.append(part[at:i])
                at = i
        out.append(part[at:])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; of a null or empty
        text none."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            out += self._some(texts[at : at + TOGETHER])
        return out

    def _some(self, texts: list[str | None]) -> list[bytes]:
        normal = [self.m.library.normalize(t) if t else "" for t in texts]
        if self.cut is None or not self.m.bytes:
            return [self._packed(t) for t in normal]
        parts = [self.cut.findall(t) for t in normal]
        distinct = set().union(*parts)
        own = self.parts.known(distinct)
        cuts = {p: self._cuts(p) for p in distinct - own.keys()}
        wanted = {a for c in cuts.values() for a in c}
        atoms = self.parts.known(wanted - cuts.keys())
        learnt = {a: self._packed(a) for a in wanted - atoms.keys()}
        atoms.update(learnt)
        whole = {p: b"".join(map(atoms.__getitem__, c)) for p, c in cuts.items()}
        own.update(whole)
        self.parts.add(learnt | whole)
        return [b"".join(map(own.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding puts first is taken off again."""
        raw = b"".join(map(self.m.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(PieceModel(path))


def _array(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32)))


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """Adds the ids of every row's text; null and empty texts have none. A column of docs with
    the name of ids (in whatever case) is replaced; repeated rows are encoded alike.

    round_trip: a column, if named, that says whether decoding the ids gives the text again
    (a null text counts as empty). It is found out where the ids are made, by the same codec, so
    that a task needs one worker with one model.
    """
    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(round_trip, T.BooleanType())] if round_trip else [])]
    taken = {f.name.lower() for f in more}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in taken and c != text])
    schema = T.StructType([*docs.schema.fields, *more])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            rows = codec.encode(texts)
            same = [pa.array([codec.decode(x) == (s or "") for x, s in zip(rows, texts, strict=True)], pa.bool_())] if round_trip else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _array(rows), *same], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of every row's ids; null ids give a null text, no ids the empty one."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() == text.lower() and c != ids])
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in slices(batches):
            texts = [None if x is None else codec.decode(np.array(x, dtype="<u4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 and round_trip (whether decoding gives the text again; a null
    text counts as empty) of every row, without the ids leaving the task."""
    schema = struct_of(("doc_id", T.LongType()), ("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in slices(batches):
            texts = [s or "" for s in batch.column(1).to_pylist()]
            ids = codec.encode(texts)
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([codec.decode(x) == s for x, s in zip(ids, texts, strict=True)], pa.bool_())], names=schema.names)

    return docs.select(F.col(id).cast("long"), text).mapInArrow(run, schema)


def public_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op10_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Encode and decode every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model or public_model())
