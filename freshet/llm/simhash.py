"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint links to all others within ``2 * half`` bits. Each fingerprint emits every
variant with up to ``half`` bits flipped; two fingerprints within the radius share a variant
(half-way between them), and fingerprints that share a variant are within the radius.

The variants are shuffled by their leading bits, the *bucket*: a fingerprint is sent once to
each bucket that one of its variants falls in, and the task that gets a bucket writes out the
variants below it (so what is shuffled grows with the number of buckets reached, not of
variants). There equal variants are found by sorting, each group of them is linked to its
smallest member (never pair by pair), links are verified by counting differing bits, and
repeated links are dropped. A task works through a bucket in slices of bounded size.

Equal fingerprints are one class before anything is emitted, so copies cost nothing, and the
links of the classes become components (see components.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, discard, free_name, materialize, slices, spread, struct_of, with_minimum
from .components import components

SEED = 42
#: Variants that a task holds at a time, about.
SLICE = 1 << 22
#: Texts to be looked at again that are told to all tasks; 16 bytes each.
MOST_WANTED = 1_000_000
#: Parity bits of a set of few shingles and of a part of a set; elements of a part, about, at most.
LEAST_BITS, PART = 512, 512
#: Rows of one token that are compared with each other in one task; tokens that a row remembers.
BLOCK, BEFORE = 2048, 8
#: One in so many texts tells which hashes are common; of these so many at most, 8 bytes each.
SAMPLED, MOST_COMMON = 4, 300_000
_ROW = ("bucket", "key", "node", "s0", "s1")


# -- fingerprints ----------------------------------------------------------------------------


def shingles(text: str | None, words: int) -> Iterator[bytes]:
    """Space-joined runs of words of the text (A-Z lower-cased, words between ASCII white
    space), repeats included; a shorter text is one shingle, one without words none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return iter(())
    if len(w) < words:
        return iter((b" ".join(w),))
    return map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))


def majority(bits: np.ndarray) -> np.ndarray:
    """For each column 1 if set in over half the rows; bits: rows of packed bytes."""
    total = np.zeros(bits.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(bits), 1 << 16):
        total += np.unpackbits(bits[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(bits), bitorder="little")


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits: bit i is set if set in the XXH64 (seed 42) of over half the shingles."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, words), repeat(SEED)), dtype=np.uint64)
    return int(majority(h.view(np.uint8).reshape(-1, 8)).view(np.uint64)[0]) if len(h) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# -- ball hashing ----------------------------------------------------------------------------


def flips(bits: int, most: int) -> list[np.ndarray]:
    """For each n up to most: all masks of up to n of the low bits."""
    out, masks = [], []
    for n in range(most + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(bits), n)]
        out.append(np.array(masks, dtype=np.uint64))
    return out


def balls(bits: int, half: int) -> int:
    """Variants of a fingerprint."""
    return len(flips(bits, half)[half])


def bucket_bits(n: int, bits: int, half: int, least: int) -> int:
    """Leading bits that make a bucket of n evenly spread fingerprints a few slices at most."""
    return int(min(bits - 1, 24, max(least, np.ceil(np.log2(max(1, n * balls(bits, half) / SLICE))))))


def emit(keys: np.ndarray, bits: int, half: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) for every bucket that a variant of keys[row] falls in."""
    top = (keys >> np.uint64(bits - lead)).astype(np.uint64)
    masks = flips(lead, half)[half]
    return np.repeat(np.arange(len(keys)), len(masks)), (top[:, None] ^ masks[None, :]).ravel()


def _variants(keys: np.ndarray, bucket: int, bits: int, half: int, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, row) of the variants that fall in the bucket, in slices in which equal variants
    are together."""
    low_bits = bits - lead
    left = half - np.bitwise_count((keys >> np.uint64(low_bits)) ^ np.uint64(bucket)).astype(np.int64)
    low = keys & np.uint64((1 << low_bits) - 1)
    masks = flips(low_bits, half)
    total = sum(int((left == n).sum()) * len(masks[n]) for n in range(half + 1))
    cut = 0
    while total >> cut > SLICE and cut < min(low_bits - 1, 12):
        cut += 1
    for part in range(1 << cut):
        found, rows = [], []
        for n in range(half + 1):
            own = np.flatnonzero(left == n)
            if cut:  # variants whose next bits are those of this part
                there = np.bitwise_count((low[own] >> np.uint64(low_bits - cut)) ^ np.uint64(part))
                for used in range(n + 1):
                    some = own[there == used]
                    if len(some):
                        inner = flips(low_bits - cut, n - used)[n - used]
                        rest = low[some] & np.uint64((1 << (low_bits - cut)) - 1)
                        found.append((rest[:, None] ^ inner[None, :]).ravel())
                        rows.append(np.repeat(some, len(inner)))
            elif len(own):
                found.append((low[own][:, None] ^ masks[n][None, :]).ravel())
                rows.append(np.repeat(own, len(masks[n])))
        if found:
            yield np.concatenate(found), np.concatenate(rows)


def collisions(variants: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, row) of the variants that more than one row has."""
    order = np.sort(variants)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return twice, rows[:0]
    seen = np.zeros(1 << 20, dtype=bool)
    mix = np.uint64(0x9E3779B97F4A7C15)
    seen[((twice * mix) >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[((variants * mix) >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(twice, variants[maybe])
    at[at == len(twice)] = 0
    hit = twice[at] == variants[maybe]
    return at[hit], rows[maybe[hit]]


def links(group: np.ndarray, row: np.ndarray, s0: np.ndarray, s1: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links (row, row): each group to its smallest row; rows too far from that are
    a group of their own again."""
    order = np.lexsort((row, group))
    group, row = group[order], row[order]
    while len(group):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        hub = np.repeat(row[first], np.diff(np.r_[first, len(group)]))
        near = np.bitwise_count(s0[hub] ^ s0[row]) + np.bitwise_count(s1[hub] ^ s1[row]).astype(np.int64) <= radius
        pairs = near & (hub != row)
        yield hub[pairs], row[pairs]
        group, row = group[~near], row[~near]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row of its component under the links a-b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]
    return root


def bucket_links(bucket: int, keys: np.ndarray, node: np.ndarray, s0: np.ndarray, s1: np.ndarray, bits: int, half: int, lead: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, node) of the rows of one bucket that are linked, without repeats."""
    order = np.argsort(node, kind="stable")
    keys, node, s0, s1 = keys[order], node[order], s0[order], s1[order]
    n = len(node)
    held = np.zeros(0, dtype=np.int64)
    for variants, rows in _variants(keys, bucket, bits, half, lead):
        for a, b in links(*collisions(variants, rows), s0, s1, radius):
            held = np.unique(np.concatenate([held, a * n + b]))
    root = forest(n, held // n, held % n)
    linked = np.flatnonzero(root != np.arange(n))
    return node[root[linked]], node[linked]


def ball_edges(nodes: DataFrame, tables: int, bits: int, half: int, radius: int) -> DataFrame:
    """Links (a, b) between nodes (node, s0, s1: the low and high half of a signature).

    The signature is cut into ``tables`` keys of ``bits`` bits from its low end on; two nodes
    are compared if in some table their keys differ by at most 2 * half bits, and linked if
    their whole signatures differ by at most ``radius``.
    """
    spark = nodes.sparkSession
    lead = bucket_bits(nodes.count(), bits, half, 8 if tables == 1 else 5)
    rows = T.StructType([T.StructField(c, T.LongType()) for c in _ROW])
    full = (1 << bits) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                node, s0, s1 = (c.slice(at, 2048).to_numpy() for c in batch.columns)
                for t in range(tables):
                    half_of = (s0, s1)[t * bits // 64].view(np.uint64)
                    keys = (half_of >> np.uint64(t * bits % 64)) & np.uint64(full)
                    row, bucket = emit(keys, bits, half, lead)
                    bucket = bucket | np.uint64(t << lead)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(keys.view(np.int64)[row]), pa.array(node[row]), pa.array(s0[row]), pa.array(s1[row])], names=list(_ROW))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None

        def ready():
            bucket, key, node, s0, s1 = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = bucket_links(int(now) & ((1 << lead) - 1), key.view(np.uint64), node, s0.view(np.uint64), s1.view(np.uint64), bits, half, lead, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            cuts = np.flatnonzero(np.diff(columns[0])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if now is not None and columns[0][lo] != now and held:
                    yield ready()
                    held = []
                now = columns[0][lo]
                held.append([c[lo:hi] for c in columns])
        if held:
            yield ready()

    sent = nodes.select(F.col("node").cast("long"), F.col("s0").cast("long"), F.col("s1").cast("long")).mapInArrow(send, rows)
    if bits == 64 and tables == 1:  # the key is the signature: it needn't travel thrice
        sent = sent.select("bucket", "s0")
        dealt = sent.repartition(spread(spark), "bucket").sortWithinPartitions("bucket")
        dealt = dealt.select("bucket", F.col("s0").alias("key"), F.col("s0").alias("node"), "s0", F.lit(0).cast("long").alias("s1"))
    else:
        dealt = sent.repartition(spread(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(receive, struct_of(("a", T.LongType()), ("b", T.LongType()))).distinct()


# -- operators -------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, words: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (as a signed long); a null or wordless text has 0."""
    schema = struct_of(("doc_id", T.LongType()), ("fp", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(fingerprint(s.as_py(), words)) for s in batch.column(1)], pa.int64())], names=schema.names)

    return docs.select(F.col(id).cast("long"), text).mapInArrow(run, schema)


def with_components(prints: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Adds component_id, the smallest doc_id of the classes that the links between the values of
    key connect; null ids have no part in that minimum."""
    classes = prints.groupBy(key).agg(F.min("doc_id").alias("least"))
    linked = classes.join(components(edges).withColumnRenamed("node", key), key, "left")
    alone = linked.where("root is null").select(key, F.col("least").alias("component_id"))
    together = with_minimum(linked.where("root is not null"), "root", "least", "component_id", [key]).select(key, "component_id")
    # the classes are a table of their own: then only documents of a large class are split
    return prints.join(materialize(alone.union(together), "classes"), key)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Documents whose fingerprints differ by at most ``radius`` bits (an even number) are linked;
    component_id is the smallest doc_id that links lead to. Empty and null texts have
    fingerprint 0 and are linked like any other; repeated rows and ids stay.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    prints = materialize(fingerprints(docs, words, id, text), "fingerprints")
    nodes = materialize(prints.select(F.col("fp").alias("node"), F.col("fp").alias("s0"), F.lit(0).cast("long").alias("s1")).distinct(), "fingerprint-classes")
    edges = ball_edges(nodes, 1, 64, radius // 2, radius)
    out = with_components(prints, "fp", edges)
    discard(nodes, docs.sparkSession)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH3-64 of the shingles, sorted; none for a wordless text."""
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles(text, words)), dtype=np.uint64).view(np.int64))


def _set_key(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))


def set_fingerprint(hashes: np.ndarray) -> int:
    """64 bits, as a signed long: bit i is set if set in over half the hashes of a set; 0 of none."""
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view(np.int64)[0]) if len(hashes) else 0


def parity(hashes: np.ndarray) -> bytes:
    """The parity of the hashes that fall on each of as many bits as the set has elements, rounded
    up to a power of two, LEAST_BITS at least: two sets' differ in no more bits than the sets have
    elements that the other lacks."""
    size = max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 0)
    return np.packbits(np.bincount(hashes & (size - 1), minlength=size).astype(np.uint8) & 1).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The parities on fewer bits, as words of 64."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 64 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """Of how many elements of sets of n, the first in any common order, sets of that similarity
    share one at least."""
    return n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1


def levels(n: int, similarity: float) -> range:
    """The ways a set of n elements is cut into parts (into 2 ** level of them, by the leading bits of
    the hashes): the one that its size asks for, and those that a larger set as similar may ask for."""
    level = lambda k: max(0, int(np.ceil(np.log2(k / PART))))
    return range(level(n), level(n / similarity + 1) + 1) if n else range(0)


def parts(hashes: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Of each part of the set (the parts of every level it is cut by): its key, its size, its parity
    bits and, one after another, the prefixes of the parts, those marked common being last in order.

    Where two sets are so similar, one of their parts at least is, as the parts' overlaps and
    unions add up to the sets'. So one of the tokens of the prefixes is shared within such parts. A
    token is a hash with the level in place of its last five bits, so parts of other levels don't meet.
    """
    keys, sizes, bits, tokens = [], [], [], []
    for level in levels(len(hashes), similarity):
        part = (hashes.view(np.uint64) >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(hashes), np.int64)
        size = np.bincount(part, minlength=1 << level)
        odd = np.bincount(part * LEAST_BITS + (hashes & (LEAST_BITS - 1)), minlength=LEAST_BITS << level) & 1
        own = np.flatnonzero(size)
        keys.append(own << 5 | level)
        sizes.append(size[own])
        bits.append(np.packbits(odd.astype(np.uint8).reshape(-1, LEAST_BITS), axis=1)[own])
        order = np.argsort(part * 2 + common, kind="stable")
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
        tokens.append((hashes[order] & ~31 | level)[place < np.repeat(prefix_length(size, similarity), size)])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *keys]), np.concatenate([none, *sizes]), np.concatenate([np.zeros((0, LEAST_BITS // 8), np.uint8), *bits]), np.concatenate([none, *tokens])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _sampled_hashes(texts: DataFrame, words: int) -> DataFrame:
    """h: the distinct shingle hashes of every (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(s.as_py(), words) for s in batch.column(1)]))], names=["h"])

    return texts.mapInArrow(run, struct_of(("h", T.LongType())))


def _sketches(texts: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """For every (doc_id, row, text): doc_id, row, node (a hash of the set), n, fp (its fingerprint), bits (see parity) and
    what parts tells: keys, sizes, marks (the parts' bits one after another), tokens. The common
    hashes are sorted. The sets themselves aren't kept."""
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = struct_of(*zip(("doc_id", "row", "node", "n", "fp", "bits", "marks", "keys", "sizes", "tokens"), (long,) * 5 + (T.BinaryType(),) * 2 + (longs,) * 3, strict=True))
    last = common if len(common) else np.zeros(1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(s.as_py(), words) for s in batch.column(2)]
            flat = np.concatenate(sets)
            marked = np.split((last[np.minimum(np.searchsorted(last, flat), len(last) - 1)] == flat) & bool(len(common)), np.cumsum([len(h) for h in sets])[:-1])
            cut = [parts(h, c, similarity) for h, c in zip(sets, marked, strict=True)]
            numbers = [pa.array([f(h) for h in sets], pa.int64()) for f in (_set_key, len, set_fingerprint)]
            sketches = [pa.array(list(map(parity, sets)), pa.binary()), pa.array([x[2].tobytes() for x in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, *sketches, *(_lists([x[i] for x in cut]) for i in (0, 1, 3))], names=schema.names)

    return texts.mapInArrow(run, schema)


def _tokens(nodes: DataFrame, similarity: float) -> DataFrame:
    """token, node, n for every token of a part, n being the size of the part."""
    schema = struct_of(("token", T.LongType()), ("node", T.LongType()), ("n", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, sizes = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
            each = prefix_length(sizes, similarity)
            owner = np.repeat(node, batch.column(1).value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(2).flatten(), pa.array(np.repeat(owner, each)), pa.array(np.repeat(sizes, each))], names=schema.names)

    return nodes.select("node", "sizes", "tokens").mapInArrow(run, schema)


def _parts(nodes: DataFrame) -> DataFrame:
    """node, part (its key), n, bits for every part."""
    schema = struct_of(("node", T.LongType()), ("part", T.LongType()), ("n", T.LongType()), ("bits", T.BinaryType()))
    wide = LEAST_BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            bits = [m[i : i + wide] for m in batch.column(3).to_pylist() for i in range(0, len(m), wide)]
            yield pa.RecordBatch.from_arrays([pa.array(owner), batch.column(1).flatten(), batch.column(2).flatten(), pa.array(bits, pa.binary())], names=schema.names)

    return nodes.select("node", "keys", "sizes", "marks").mapInArrow(run, schema)


def _meetings(posts: DataFrame, similarity: float) -> DataFrame:
    """token, a, b, n: for each token that several nodes have, a row per node (b null, n its size),
    and rows (token null) for the pairs (a, b) that its nodes in order of size make with the first
    one of their size class and with the one before."""
    schema = struct_of(("token", T.LongType()), ("a", T.LongType()), ("b", T.LongType()), ("n", T.LongType()))
    step = -np.log(similarity) if similarity < 1 else 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(4, dtype=np.int64)  # the run's first row: token, node, n, class
        rest, same = None, False  # the row that came last, and whether its token is that of the row before it
        for batch in batches:
            token, node, n = (c.to_numpy() for c in batch.columns)
            if not len(token):
                continue
            first = rest is None
            if not first:
                token, node, n = np.r_[rest[0], token], np.r_[rest[1], node], np.r_[rest[2], n]
            kind = np.floor(np.log(np.maximum(n, 1)) / step).astype(np.int64)
            if first:
                hub[:] = token[0], node[0], n[0], kind[0]
            equal = token[1:] == token[:-1]
            # the first row of each run of one token and size class
            fresh = np.r_[(token[0] != hub[0]) | (kind[0] != hub[3]), ~equal | (kind[1:] != kind[:-1])]
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(token)), -1))
            head = np.where(lead >= 0, node[np.maximum(lead, 0)], hub[1])
            size = np.where(lead >= 0, n[np.maximum(lead, 0)], hub[2])
            x, y = np.r_[head[1:], node[:-1][equal]], np.r_[node[1:], node[1:][equal]]
            nx, ny = np.r_[size[1:], n[:-1][equal]], np.r_[n[1:], n[1:][equal]]
            fits = (x != y) & (np.minimum(nx, ny) >= similarity * np.maximum(nx, ny) - 1e-6)
            pairs = np.unique(np.stack([np.minimum(x, y)[fits], np.maximum(x, y)[fits]], axis=1), axis=0)
            keep = np.r_[same, equal][:-1] | equal
            none = np.zeros(len(pairs), dtype=bool)
            there = np.ones(int(keep.sum()), dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[token[:-1][keep], pairs[:, 0]], mask=np.r_[~there, ~none]), pa.array(np.r_[node[:-1][keep], pairs[:, 0]]),
                    pa.array(np.r_[node[:-1][keep], pairs[:, 1]], mask=np.r_[there, none]), pa.array(np.r_[n[:-1][keep], 0 * pairs[:, 0]]),
                ],
                names=schema.names,
            )
            hub[:] = token[-1], head[-1], size[-1], kind[-1]
            rest, same = (token[-1:], node[-1:], n[-1:]), bool(np.r_[same, equal][-1])
        if same:
            yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1]), pa.array([None], pa.int64()), pa.array(rest[2])], names=schema.names)

    return posts.repartition(spread(posts.sparkSession), "token").sortWithinPartitions("token", "n", "node").mapInArrow(run, schema)


def may_be_similar(n: np.ndarray, m: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m elements whose parity bits differ in so many places may be as
    similar as that; false for none that is."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (low >= similarity * high - 1e-6) & (apart <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6)


def bits_fit(n: int, m: int, x: bytes, y: bytes, similarity: float) -> bool:
    """may_be_similar for one pair and its parities on whatever numbers of bits."""
    size = 8 * min(len(x), len(y))
    apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return bool(may_be_similar(n, m, apart, similarity))


def _fingerprint_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp): each node and the smallest of its fingerprint, and the smallest ones of
    fingerprints that the balls link, which differ by at most ``radius`` bits."""
    least = with_minimum(nodes.select("node", "fp"), "fp", "node", "least", ["node"])
    alike = least.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprint-classes")
    edges = ball_edges(prints.select(F.col("fp").alias("node"), F.col("fp").alias("s0"), F.lit(0).cast("long").alias("s1")), 1, 64, radius // 2, radius)
    x, y = (prints.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    near = edges.join(x, "a").join(y, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    pairs = materialize(alike.union(near), "fingerprint-pairs")
    discard(prints, nodes.sparkSession)
    return pairs


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits don't rule out."""
    schema = struct_of(("a", T.LongType()), ("b", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n, x, m, y = (batch.column(i).to_pylist() for i in range(2, 6))
            fits = [bits_fit(*own, similarity) for own in zip(n, m, x, y, strict=True)]
            yield batch.filter(pa.array(fits, pa.bool_())).select(["a", "b"])

    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(run, schema)


def _left_pairs(posts: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that share a token, whose parts with that token may be similar, and that aren't in
    one component yet. Tokens whose nodes all are in one component are left out first. A token's
    rows are dealt out into blocks of about BLOCK rows, and every two blocks meet in a task of their
    own (as does each with itself): there, in order of size, a row meets those before it that are
    in reach by size. A row knows the BEFORE open tokens that come before its own in its part: two
    that have one of these in common meet there already. So a pair is always made at the first
    token it shares, and hardly ever again."""
    schema = struct_of(("a", T.LongType()), ("b", T.LongType()))
    rooted = posts.join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    shares = rooted.groupBy("token", "salt").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
    open_tokens = shares.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.ceil(F.sum("rows") / BLOCK).cast("int").alias("blocks")).where("low <> high")
    open_ = rooted.join(shares.select("token", "salt").join(open_tokens.select("token", "blocks"), "token"), ["token", "salt"])
    open_ = materialize(open_.select("token", "node", "root", "blocks"), "open-prefixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last cell that rows to come may still be similar to
        for batch in slices(batches, 8192):
            rows = [*(batch.column(i).to_numpy() for i in range(6)), np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, LEAST_BITS // 64)]
            rows.append(np.array([*batch.column(7).to_pylist(), None], dtype=object)[:-1])
            before = len(held[0]) if held else 0
            token, low, high, node, root, n, bits, earlier = rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            cell, side = np.stack([token, np.minimum(low, high), np.maximum(low, high)]), low
            i, back, found = np.arange(before, len(token)), 0, []
            while len(i):  # with the row before, the one before that, ... as long as cell and size fit
                back += 1
                i = i[i >= back]
                j = i - back
                i = i[(cell[:, i] == cell[:, j]).all(axis=0) & (n[j] >= similarity * n[i] - 1e-6)]
                x = i[(root[i] != root[i - back]) & ((side[i] != side[i - back]) | (low[i] == high[i]))]
                y = x - back
                fits = may_be_similar(n[x], n[y], np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64), similarity)
                for k in np.flatnonzero(fits).tolist():
                    fits[k] = set(earlier[x[k]]).isdisjoint(earlier[y[k]])
                found.append(np.stack([np.minimum(node[x], node[y])[fits], np.maximum(node[x], node[y])[fits]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=schema.names)
            reach = (cell == cell[:, -1:]).all(axis=0) & (n >= similarity * n[-1] - 1e-6)
            held = [x[reach] for x in rows]

    part = F.expr("shiftleft(if((token & 31) = 0, 0L, shiftrightunsigned(token, int(64 - (token & 31)))), 5) | (token & 31)")
    before = Window.partitionBy("node", "part").orderBy("token").rowsBetween(-BEFORE, -1)
    known = open_.withColumn("part", part).withColumn("earlier", F.collect_list("token").over(before)).join(_parts(nodes), ["node", "part"])
    # a row of block ``low`` is sent to the cells of its block and each other block, ``high``
    dealt = known.withColumn("low", F.pmod(F.xxhash64("node"), "blocks").cast("long"))
    dealt = dealt.withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    dealt = dealt.select("token", "low", "high", "node", "root", "n", "bits", "earlier", F.least("low", "high").alias("c0"), F.greatest("low", "high").alias("c1"))
    cells = dealt.repartition(spread(posts.sparkSession), "token", "c0", "c1").sortWithinPartitions("token", "c0", "c1", "n", "node")
    return cells.select("token", "low", "high", "node", "root", "n", "bits", "earlier").mapInArrow(run, schema).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets have that Jaccard similarity or more. Only the sets of nodes that are in
    a pair are made again from their texts; which texts these are is broadcast up to MOST_WANTED
    of them, and joined beyond."""
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "row"), "node")
    wanted = materialize(wanted.select(F.col("node").alias("of"), F.col("row").alias("text_row")), "wanted")
    some = F.broadcast(wanted) if wanted.count() <= MOST_WANTED else wanted
    schema = struct_of(("node", T.LongType()), ("hashes", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(s.as_py(), words) for s in batch.column(1)])], names=schema.names)

    found = texts.join(some, F.col("row") == F.col("text_row")).groupBy("of").agg(F.first("text").alias("text"))
    sets = materialize(found.mapInArrow(run, schema), "sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("n"))
    out = materialize(both.where(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")) >= similarity).select("a", "b"), "links")
    for done in (pairs, wanted, sets):
        discard(done, texts.sparkSession)
    return out


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """doc_id, component_id for every row: groups of documents whose shingles of ``words`` words
    have a Jaccard similarity of ``similarity`` or more, or that such documents connect.

    Equal sets are one class. Each has a fingerprint; classes whose fingerprints are equal, or differ by at most ``radius``
    bits (an even number; found by balls), are linked if their sets are as similar as that. As fingerprints of similar sets
    may differ in more bits, what they leave is then looked for by shared hashes. Long sets are cut into parts by the leading bits of the hashes; of sets
    so similar one part at least is as similar, and shares one of the first few hashes in any common
    order, the prefix. Of the pairs that do, those whose sizes or parity bits rule it out, the part's
    and then the set's, are left out, and the others are verified by their sets. Each hash's nodes are
    first compared with a few of each other, in order of size, then with all that they aren't
    connected to yet, so that no pair is missed. The order puts hashes last that are common in a share of the texts, which
    changes the work, not the result. A set is never stored but for pairs that have to be verified.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("row"), whole.alias("text"))
    sample = texts.where(F.pmod("row", F.lit(SAMPLED)) == 0).groupBy("row").agg(F.first("text").alias("text"))
    often = _sampled_hashes(sample.select("row", "text"), words).groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow()
    common = np.sort(often.column(0).to_numpy())
    sketches = materialize(_sketches(texts, words, similarity, common), "sketches")
    keys = materialize(sketches.select("doc_id", "node"), "keys")
    one = sketches.groupBy("node").agg(F.min_by(F.struct("row", "n", "fp", "bits", "marks", "keys", "sizes", "tokens"), "row").alias("s"))
    nodes = materialize(one.select("node", "s.*"), "set-classes")
    discard(sketches, spark)
    met = materialize(_meetings(_tokens(nodes, similarity), similarity), "meetings")
    posts = met.where("token is not null").select("token", F.col("a").alias("node"))
    linked = _fingerprint_pairs(nodes, radius)
    pairs = linked.union(met.where("token is null").select("a", "b")).distinct()
    edges = _verified(_possible(pairs, nodes, similarity), nodes, texts, words, similarity)
    roots = materialize(components(edges), "roots")
    more = _verified(_possible(_left_pairs(posts, roots, nodes, similarity), nodes, similarity), nodes, texts, words, similarity)
    out = with_components(keys, "node", edges.union(more))
    for done in (nodes, met, linked, roots):
        discard(done, spark)
    return out.select("doc_id", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those whose id isn't the smallest of their group; rows without an
    id stay, and of rows alike in id and text one does.

    Rows that share an id but not the text are documents of their own. Where they are in
    different groups, the id goes only if it is the smallest of none of them.
    """
    groups = materialize(groups, "groups")
    own = groups.where("doc_id is not null").groupBy("doc_id")
    ids = materialize(own.agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays")), "ids")
    gone = free_name(docs.columns, "_gone")
    kept = docs.join(ids.where("not stays").select(F.col("doc_id").alias(gone)), F.col(id) == F.col(gone), "left_anti")
    if ids.where("n > 1").limit(1).count():
        kept = kept.where(F.col(id).isNotNull()).dropDuplicates([id, text]).unionByName(kept.where(F.col(id).isNull()))
    return kept


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at up to 4 differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
