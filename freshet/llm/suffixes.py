"""Exact substring deduplication with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier, in a document
of a smaller id or earlier in the same one. Suffix arrays of whole corpora would have to be
merged shard against shard; here only text that can repeat gets into them, in shards that hold
all that can be equal:

1. Anchors. In each string of ``length`` bytes one run of ``gram`` bytes is picked, that of the
   least hash. Equal strings pick equal runs at equal offsets, so strings can be equal only
   around anchors of equal hash. An anchor stands for the up to ``length - gram + 1`` strings
   that hold its run; together these span its *context*.
2. Anchors with equal hash and equal context are copies: all but the earliest are decided
   (copies in the same batch before anything is shuffled, the others where their hash meets).
   Anchors whose hash occurs with one context only need nothing more. A hash that has a crowd of
   contexts in a batch is dealt out by context; a marker goes to where the hash's other anchors
   meet, and opens them.
3. What is left, the earliest copies of differing contexts, is split in two halves: strings
   reaching far to the left of the run and strings reaching far to the right, keyed by the run
   and the bytes on that side, so that a frequent run with ever other neighbours falls apart.
   Each key's texts go to one shard. In a shard the texts are sorted by key and position and
   taken in parts of bounded size: a suffix array by Larsson-Sadakane refinement, common
   prefixes by Kasai's method, and classes of equal strings with their earliest place. A key
   that goes on in the next part is merged by binary search: the sorted strings found so far are
   searched for those of the next part.

Places found to repeat are gathered per document and merged into spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, spread, struct_of

U = np.uint64
#: Bytes of text in a suffix array, about: its arrays take some hundred times as many bytes.
PART = 1 << 20
#: Contexts of one hash in a batch from which on they are dealt out by context too.
CROWD = 64
#: Flags of anchors; a marker is no anchor but tells the part of a hash that there are crowds of it.
CROWDED, MARKER = 1, 2
RUNS = struct_of(("doc", T.LongType()), ("row", T.LongType()), ("first", T.IntegerType()), ("last", T.IntegerType()))


# -- hashing ---------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any range of a byte string, by prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    letters = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    up = _powers(BASE, 1)
    down = _powers(pow(BASE, -1, 1 << 64), 1)

    def __init__(self, text: np.ndarray):
        n = len(text) + 1
        if len(Hasher.up) < n:
            size = 1 << n.bit_length()
            Hasher.up, Hasher.down = _powers(self.BASE, size), _powers(pow(self.BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n, dtype=U)
        np.cumsum(Hasher.letters[text] * Hasher.up[: n - 1], out=self.sums[1:])

    def all_of(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` bytes."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * Hasher.down[:n])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * Hasher.down[begin])


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values its minimum."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes of the runs and hashes of the contexts of a text's anchors."""
    n = len(text)
    if n < length:
        none = np.zeros(0, dtype=U)
        return np.zeros(0, dtype=np.int64), none, none
    hasher = Hasher(text)
    h = hasher.all_of(gram)
    place_bits = max(1, int(len(h)).bit_length())
    ranked = (h >> U(place_bits) << U(place_bits)) | np.arange(len(h), dtype=U)
    least = window_minimum(ranked, length - gram + 1)
    at = (least & U((1 << place_bits) - 1)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    begin, end = np.maximum(0, at - (length - gram)), np.minimum(n, at + length)
    context = _mix(hasher.of(begin, end) ^ _mix(((at - begin) * 4096 + (end - at)).astype(U)))
    return at, h[at], context


# -- suffix arrays ---------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, place of each suffix in it) by Larsson-Sadakane refinement.

    A suffix's rank is where its group begins; only groups of several suffixes are sorted anew,
    by the rank of what follows the part already sorted, which doubles each time.
    """
    n = len(text)
    sa = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.r_[True, text[sa[1:]] != text[sa[:-1]]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[sa] = np.repeat(first, np.diff(np.r_[first, n]))
    rank[n] = -1
    done = 1
    open_ = np.arange(n)
    while True:
        r = rank[sa[open_]]
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), len(r)])
        open_ = open_[np.repeat(size > 1, size)]
        if not len(open_):
            break
        own = sa[open_]
        r, after = rank[own], rank[np.minimum(own + done, n)]
        order = np.argsort(r * (n + 2) + after + 1)
        own, r, after = own[order], r[order], after[order]
        sa[open_] = own
        fresh = np.r_[True, (r[1:] != r[:-1]) | (after[1:] != after[:-1])]
        starts = np.flatnonzero(fresh)
        rank[own] = np.repeat(open_[starts], np.diff(np.r_[starts, len(own)]))
        done *= 2
    place = np.empty(n, dtype=np.int64)
    place[sa] = np.arange(n)
    return sa, place


def common_prefixes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sa: np.ndarray, place: np.ndarray, cap: int) -> np.ndarray:
    """For each entry of the suffix array the common prefix with the one before, up to ``cap``.

    Kasai's method: going from a suffix to the next shorter one the prefix shrinks by one at
    most. All the shard's texts are walked in step.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(cap + 1, text.dtype)]
    out = np.zeros(n, dtype=np.int64)
    held = np.zeros(len(starts), dtype=np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > step)
        pos = starts[live] + step
        at = place[pos]
        prev = sa[at - 1]
        known = np.maximum(0, held[live] - 1)
        grow = np.flatnonzero(at > 0)
        while len(grow):
            k = known[grow]
            more = (k < cap) & (np.maximum(pos[grow], prev[grow]) + k < n) & (padded[pos[grow] + k] == padded[prev[grow] + k])
            grow = grow[more]
            known[grow] += 1
        known[at == 0] = 0
        held[live] = known
        out[at] = known
    return out


class Shard:
    """Finds repeated strings among texts that come in order of (key, document, place)."""

    def __init__(self, length: int):
        self.length = length
        self.key = None
        self.keys = np.zeros(0, dtype=f"S{length}")  # sorted strings of the key that goes on
        self.doc = np.zeros(0, dtype=np.int64)
        self.place = np.zeros(0, dtype=np.int64)

    def feed(self, key: np.ndarray, doc: np.ndarray, begin: np.ndarray, blobs: list[bytes], goes_on: bool) -> tuple[np.ndarray, np.ndarray]:
        """(text, offset) of the strings that start earlier too.

        goes_on: whether the last key has more texts in the next part.
        """
        length = self.length
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs))
        text = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
        starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
        sa, at = suffix_array(text)
        lcp = common_prefixes(text, starts, sizes, sa, at, length)
        owner = np.searchsorted(starts, sa, side="right") - 1
        offset = sa - starts[owner]
        whole = offset + length <= sizes[owner]
        group = np.cumsum(lcp < length)[whole]
        owner, offset = owner[whole], offset[whole]
        d, p, k = doc[owner], begin[owner] + offset, key[owner]
        order = np.lexsort((p, d, k, group))
        group, owner, offset, d, p, k = (x[order] for x in (group, owner, offset, d, p, k))
        new = np.r_[True, (group[1:] != group[:-1]) | (k[1:] != k[:-1])] if len(group) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        lead = np.repeat(head, np.diff(np.r_[head, len(group)]))
        late = (d > d[lead]) | (d == d[lead]) & (p > p[lead])
        late_owner, late_offset = owner[late], offset[late]
        if self.key is not None or goes_on:
            cut = lambda i: blobs[owner[i]][offset[i] : offset[i] + length]
            if self.key is not None and len(self.keys):
                mine = head[k[head] == self.key]
                if len(mine):
                    strings = np.array([cut(i) for i in mine], dtype=f"S{length}")
                    spot = np.minimum(np.searchsorted(self.keys, strings), len(self.keys) - 1)
                    seen = self.keys[spot] == strings
                    of = np.full(len(group), -1, dtype=np.int64)
                    of[mine[seen]] = spot[seen]
                    there = np.repeat(of[head], np.diff(np.r_[head, len(group)]))
                    hit = there >= 0
                    earlier = hit.copy()
                    earlier[hit] = (d[hit] > self.doc[there[hit]]) | (d[hit] == self.doc[there[hit]]) & (p[hit] > self.place[there[hit]])
                    late = late | earlier
                    late_owner, late_offset = owner[late], offset[late]
            last = key[-1]
            mine = head[k[head] == last]
            if goes_on:
                strings = np.array([cut(i) for i in mine], dtype=f"S{length}")
                if self.key == last:
                    strings, doc_, place_ = np.r_[self.keys, strings], np.r_[self.doc, d[mine]], np.r_[self.place, p[mine]]
                else:
                    doc_, place_ = d[mine], p[mine]
                order = np.lexsort((place_, doc_, strings))
                strings = strings[order]
                keep = np.r_[True, strings[1:] != strings[:-1]] if len(strings) else np.zeros(0, bool)
                self.keys, self.doc, self.place, self.key = strings[keep], doc_[order][keep], place_[order][keep], last
            else:
                self.key, self.keys, self.doc, self.place = None, self.keys[:0], self.doc[:0], self.place[:0]
        return late_owner, late_offset


# -- DataFrames ------------------------------------------------------------------------------


def _runs_batch(doc, row, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=RUNS.names)


def _anchor_rows(docs: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """kind 0: blobs of anchors for each part of the shuffle; kind 1: runs already decided."""
    schema = struct_of(("kind", T.IntegerType()), ("part", T.IntegerType()), ("blob", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                at, h, c = anchors(raw, length, gram)
                if len(at):
                    held.append((np.full(len(at), doc, np.int64), np.full(len(at), row, np.int64), at, np.full(len(at), len(raw), np.int64), h, c))
            if not held:
                continue
            doc, row, at, size, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            copy, crowd = _copies(doc, at, h, c)
            first, last = _strings(at[copy], size[copy], length, gram)
            rows = [(1, 0, _pack(doc[copy], row[copy], first, last))]
            stay = ~copy
            doc, row, at, size, h, c, crowd = (x[stay] for x in (doc, row, at, size, h, c, crowd))
            to = ((h ^ np.where(crowd, c, U(0))) % U(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(parts + 1))
            for part in range(parts):
                some = order[bounds[part] : bounds[part + 1]]
                if len(some):
                    rows.append((0, part, _pack(doc[some], row[some], at[some], size[some], h[some].view(np.int64), c[some].view(np.int64), crowd[some] * CROWDED)))
            crowds = np.unique(h[crowd])
            for part in np.unique(crowds % U(parts)).tolist():
                some = crowds[crowds % U(parts) == part]
                no = np.zeros(len(some), np.int64)
                rows.append((0, part, _pack(no, no, no, no, some.view(np.int64), no, no + MARKER)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _pack(doc, row, at, size, *more) -> bytes:
    wide = [doc, row, *more[:2]]
    flags = more[2].astype(np.uint8).tobytes() if len(more) > 2 else b""
    return np.int64(len(doc)).tobytes() + b"".join(np.asarray(x, "<i8").tobytes() for x in wide) + np.asarray(at, "<i4").tobytes() + np.asarray(size, "<i4").tobytes() + flags


def _unpack(blob: bytes, full: bool):
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    columns = 4 if full else 2
    wide = np.frombuffer(blob, "<i8", n * columns, 8).reshape(columns, n)
    narrow = np.frombuffer(blob, "<i4", 2 * n, 8 + wide.nbytes).reshape(2, n)
    flags = np.frombuffer(blob, np.uint8, n, 8 + wide.nbytes + narrow.nbytes) if full else None
    return wide, narrow, flags


def _strings(at: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings that hold the run of an anchor."""
    return np.maximum(0, at - (length - gram)), np.minimum(at, size - length)


def _copies(doc: np.ndarray, at: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an earlier anchor has the same context, whether the hash has a crowd of them)."""
    order = np.lexsort((at, doc, c, h))
    hs, cs, ds, ps = h[order], c[order], doc[order], at[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])]
    head = np.flatnonzero(new)
    lead = np.repeat(head, np.diff(np.r_[head, len(hs)]))
    copy = np.zeros(len(h), dtype=bool)
    copy[order] = (ds > ds[lead]) | (ds == ds[lead]) & (ps > ps[lead])
    fresh = np.r_[True, hs[1:] != hs[:-1]]
    group = np.cumsum(fresh) - 1
    crowd = np.zeros(len(h), dtype=bool)
    crowd[order] = np.bincount(group, weights=new)[group] >= CROWD
    return copy, crowd


def _meet(rows: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """kind 1: decided runs; kind 2: places (doc, row, at) whose context has to be looked at."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *RUNS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for batch in batches for b in batch.column(1).to_pylist()]
        if not held:
            return
        wide, narrow, flags = zip(*(_unpack(b, True) for b in held), strict=True)
        wide, narrow, flags = np.concatenate(wide, axis=1), np.concatenate(narrow, axis=1).astype(np.int64), np.concatenate(flags)
        crowded = np.unique(wide[2, flags == MARKER]).view(U)
        if len(crowded):
            wide, narrow, flags = (x[..., flags != MARKER] for x in (wide, narrow, flags))
        if not len(flags):
            return
        crowd = flags == CROWDED
        doc, row, (h, c) = wide[0], wide[1], wide[2:].view(U)
        at, size = narrow
        if len(held) > 1:
            copy, _ = _copies(doc, at, h, c)
        else:
            copy = np.zeros(len(doc), bool)
        part = np.argsort(h, kind="stable")
        hs, cs = h[part], c[part]
        group = np.cumsum(np.r_[True, hs[1:] != hs[:-1]]) - 1
        low = np.minimum.reduceat(cs, np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]))
        high = np.maximum.reduceat(cs, np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]))
        several = np.zeros(len(h), bool)
        several[part] = (low != high)[group]
        open_ = (several | crowd | np.isin(h, crowded)) & ~copy
        first, last = _strings(at[copy], size[copy], length, gram)
        n, m = int(copy.sum()), int(open_.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.full(n, 1), np.full(m, 2)], pa.int32()), pa.array(np.r_[doc[copy], doc[open_]]), pa.array(np.r_[row[copy], row[open_]]), pa.array(np.r_[first, at[open_]], pa.int32()), pa.array(np.r_[last, at[open_]], pa.int32())],
            names=schema.names,
        )

    dealt = rows.where("kind = 0").select("part", "blob").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_by_part(run), schema)


def _by_part(run):
    """Calls run for the rows of each part (the first column) on its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != now and held:
                    yield from run(iter(held))
                    held = []
                now = part
                held.append(batch.slice(i, 1))
        if held:
            yield from run(iter(held))

    return each


def _contexts(docs: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """key, doc, row, begin, text: the two halves of the context of every place."""
    schema = struct_of(("key", T.LongType()), ("doc", T.LongType()), ("row", T.LongType()), ("begin", T.IntegerType()), ("text", T.BinaryType()))
    far = (length - gram) // 2
    wanted = places.groupBy("doc", "row").agg(F.collect_set("first").alias("places"))
    joined = docs.join(wanted.withColumnsRenamed({"doc": "_d", "row": "_r"}), (F.col("doc") == F.col("_d")) & (F.col("row") == F.col("_r"))).select("doc", "row", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for doc, row, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(text, np.uint8)
                n, at = len(raw), np.array(sorted(found), dtype=np.int64)
                hasher = Hasher(raw)
                # strings that start more than ``far`` bytes before the run, and the others
                for side in (0, 1):
                    if side == 0:
                        a, b = at - (length - gram), np.minimum(at - far - 1 + length, n)
                        k0, k1 = at - far - 1, at + gram
                    else:
                        a, b = at - far, at + length
                        k0, k1 = at, at + length - far
                    a, b = np.maximum(0, a), np.minimum(n, b)
                    ok = (k0 >= 0) & (k1 <= n) & (b - a >= length)
                    keys = np.zeros(len(at), dtype=U)
                    keys[ok] = _mix(hasher.of(k0[ok], k1[ok]) + U(side))
                    for i in np.flatnonzero(ok).tolist():
                        out.append((int(keys[i].view(np.int64)), doc, row, int(a[i]), text[a[i] : b[i]]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=schema.names)

    return joined.mapInArrow(run, schema)


def _search(contexts: DataFrame, length: int, part: int) -> DataFrame:
    """Runs of starts of strings that start earlier too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = Shard(length), [], 0

        def work(rows: list[tuple], goes_on: bool):
            key = np.array([r[0] for r in rows], dtype=np.int64)
            single = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], not goes_on]
            if shard.key is not None:
                single &= key != shard.key
            rows = [r for r, alone in zip(rows, single.tolist(), strict=True) if not alone]
            if not rows:
                shard.key = None
                return None
            key = np.array([r[0] for r in rows], dtype=np.int64)
            doc = np.array([r[1] for r in rows], dtype=np.int64)
            begin = np.array([r[3] for r in rows], dtype=np.int64)
            owner, offset = shard.feed(key, doc, begin, [r[4] for r in rows], goes_on)
            order = np.lexsort((offset, owner))
            owner, offset = owner[order], offset[order]
            if not len(owner):
                return None
            new = np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(owner)] - 1
            row = np.array([r[2] for r in rows], dtype=np.int64)
            return _runs_batch(doc[owner[head]], row[owner[head]], begin[owner[head]] + offset[head], begin[owner[head]] + offset[tail])

        for batch in slices(batches, 4096):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= part:
                    found = work(held, r[0] == held[-1][0])
                    if found is not None:
                        yield found
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            found = work(held, False)
            if found is not None:
                yield found

    dealt = contexts.repartition(spread(contexts.sparkSession), "key").sortWithinPartitions("key", "doc", "begin")
    return dealt.mapInArrow(run, RUNS)


def repeated(docs: DataFrame, length: int = 100, gram: int = 32, part: int = PART, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, spans (from, to) of removed bytes and the kept
    bytes' SHA-256 (kept_sha256).

    Null texts are empty; a null id counts as the smallest. Rows that repeat an id and a text
    are the same document; rows that share an id but not the text are compared by place alone.
    """
    spark = docs.sparkSession
    none = -(2**63)
    own = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(none)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    parts = spread(spark)
    found = materialize(_anchor_rows(own, length, gram, parts), "anchors")
    met = materialize(_meet(found, length, gram, parts), "met")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                wide, narrow, _ = _unpack(blob, False)
                yield _runs_batch(*_joined(wide[0], wide[1], narrow[0], narrow[1]))

    early = found.where("kind = 1").select("blob").mapInArrow(unpacked, RUNS)
    places = met.where("kind = 2").select("doc", "row", "first")
    late = _search(_contexts(own, places, length, gram), length, part)
    runs = early.union(met.where("kind = 1").select(*RUNS.names)).union(late)
    spans = runs.groupBy(F.col("doc").alias("_d"), F.col("row").alias("_r")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = own.join(spans, (F.col("doc") == F.col("_d")) & (F.col("row") == F.col("_r")), "left").select("doc", "text", "runs")
    schema = struct_of(("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("kept_sha256", T.StringType()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, raw, own_runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts: list[list[int]] = []
                for r in sorted((r["first"], r["last"]) for r in own_runs or ()):
                    if cuts and r[0] <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], r[1] + length)
                    else:
                        cuts.append([r[0], r[1] + length])
                sha, at = hashlib.sha256(), 0
                for a, b in cuts:
                    sha.update(raw[at:a])
                    at = b
                sha.update(raw[at:])
                out.append((None if doc == none else doc, len(raw), sum(b - a for a, b in cuts), cuts, sha.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=schema.names)

    return joined.mapInArrow(close, schema)


def _joined(doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Runs of one document that overlap or touch become one."""
    if not len(doc):
        return doc, row, first, last
    order = np.lexsort((first, row, doc))
    doc, row, first, last = doc[order], row[order], first[order].astype(np.int64), last[order].astype(np.int64)
    other = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]
    base = (np.cumsum(other) - 1) << 32  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(last + base)
    new = other | np.r_[True, first[1:] + base[1:] > reach[:-1] + 1]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(doc)] - 1
    return doc[head], row[head], first[head], reach[tail] - base[head]


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of documents covered by strings of 100 bytes that start earlier too."""
    found = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: The strings themselves, sorted: for tables that fit one machine.
OP9_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, p, b[p + 1:p + 100] AS k FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
l AS (SELECT doc_id, p FROM (SELECT doc_id, p, rank() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM s) WHERE r > 1),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM l)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, i),
e AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM r),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z, string_agg(hex(b[y + 1:a]), '' ORDER BY a) AS h FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(h, '') || hex(b[coalesce(z, 0) + 1:n]))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
