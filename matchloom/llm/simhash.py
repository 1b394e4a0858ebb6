"""Near-duplicates by SimHash fingerprints, compared bit-sliced.

A fingerprint has 64 bits: lower-cased (A-Z) words, 3-word shingles with repeats, XXH64 of each shingle; a bit is 1 where
more than half the hashes have it. Documents link where fingerprints differ in at most 3 bits, and connected documents
form a component.

1. Equal fingerprints are merged first (one row per fingerprint with its smallest id), so copies cost nothing later.
2. Candidates: of four 16-bit bands at least one is equal in any linked pair, and of four 12-bit pieces of the other
   48 bits at least one is equal too. Each fingerprint therefore goes to 16 buckets named by 28 of its bits, and no
   link is lost. Buckets above ``split_at`` members are split once more, by four pieces of the bits that are still free.
3. Inside a task the sorted buckets lie next to each other. Their bits are stored vertically (one plane of packed words
   per bit); row k is compared with row k+s for all k at once by xor of each plane with itself moved by s rows. The
   differing bits are added up by carry-save counters (ones, twos, and a sticky "four or more"), and a word of 64
   comparisons is abandoned once all of them exceed the radius.
4. Linked rows of a bucket are joined to a star before they leave the task (no bucket emits all its pairs), and the
   stars are joined by alternating large-star and small-star steps, each written to the shared folder.

Defined cases: null texts and texts without words have fingerprint 0 and link like any other; fewer than three words
make one shingle; rows repeated in full keep their rows; a null doc_id takes part and never names a component unless it
is alone with such rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_importable
from .common import free_name, map_batches, materialise, read_table, release_memory, spread

RADIUS = 3
_SLICE = 1 << 20
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _word_lists(text: str, overlap: int = 2) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, slice by slice; a slice starts with the last words of the one before."""
    data = text.encode("utf-8", "replace").lower()
    if len(data) <= _SLICE:
        yield data.split()
        return
    last: list[bytes] = []
    start = 0
    while start < len(data):
        end = min(len(data), start + _SLICE)
        while end < len(data) and data[end : end + 1] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = last + data[start:end].split()
        yield words
        last, start = words[len(words) - min(overlap, len(words)) :], end


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 without words."""
    total = np.zeros(64, dtype=np.int64)
    n = 0
    digest = xxhash.xxh64_intdigest
    lists = _word_lists(text or "")
    words: list[bytes] = []
    for words in lists:
        if len(words) >= 3:
            hashes = np.array([digest(b" ".join(x), 42) for x in zip(words, words[1:], words[2:])], dtype="<u8")
            for k in range(0, len(hashes), 1 << 14):
                part = hashes[k : k + (1 << 14)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total += bits.sum(axis=0, dtype=np.uint32)
            n += len(hashes)
    if not n:
        return digest(b" ".join(words), 42) if words else 0
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, fp) for every row; uid is a digest of id and text, fp holds the 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x.as_py()) for x in batch.column(2)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "uid", "fp"])

    return map_batches(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text"), "doc_id long, uid long, fp long", run)


def bucket_keys(fp: str = "fp") -> F.Column:
    """The 16 bucket names of a fingerprint: which band, its 16 bits, which piece of the rest, its 12 bits."""
    keys = []
    for a in range(4):
        band = F.shiftrightunsigned(F.col(fp), 16 * a).bitwiseAND(F.lit(0xFFFF))
        rest_low = F.col(fp).bitwiseAND(F.lit((1 << (16 * a)) - 1)) if a else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(F.col(fp), 16 * a + 16), 16 * a) if a < 3 else F.lit(0).cast("long")
        rest = rest_low.bitwiseOR(high)
        for b in range(4):
            piece = F.shiftrightunsigned(rest, 12 * b).bitwiseAND(F.lit(0xFFF))
            name = F.lit((4 * a + b) << 28).cast("long").bitwiseOR(F.shiftleft(band, 12)).bitwiseOR(piece)
            keys.append(name)
    return F.array(*keys)


def _planes(fps: np.ndarray) -> np.ndarray:
    """One plane of packed bits per bit of the fingerprints: row k at bit k % 64 of word k // 64, with two words of padding."""
    rows = np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1)
    words = (len(fps) + 63) // 64 + 2
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    planes = np.zeros((bits.shape[1], words * 8), dtype=np.uint8)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    return planes.view("<u8")


def _moved(plane: np.ndarray, shift: int, words: np.ndarray) -> np.ndarray:
    q, r = divmod(shift, 64)
    low = plane[words + q]
    if not r:
        return low
    return (low >> np.uint64(r)) | (plane[words + q + 1] << np.uint64(64 - r))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count (bit j in counter j) exceeds the radius."""
    greater = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], _ONES)
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            greater |= equal & counters[j]
            equal &= ~counters[j]
    return greater


def near_at(planes: np.ndarray, shift: int, n: int, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Rows k (of those whose bit is set in ``wanted``) with at most ``radius`` bits between row k and row k+shift."""
    width = planes.shape[1] - 2 - shift // 64
    words = np.flatnonzero(wanted[:width])
    over = ~wanted[words]
    counters = [np.zeros(len(words), dtype=np.uint64) for _ in range(radius.bit_length() + 1)]
    step = 8 if len(planes) <= 64 else 32
    for b in range(len(planes)):
        carry = planes[b][words] ^ _moved(planes[b], shift, words)
        for j, count in enumerate(counters):
            counters[j], carry = count ^ carry, count & carry
            if not carry.any():
                break
        else:
            over |= carry
        if b % step == step - 1:
            over |= _above(counters, radius)
            alive = over != _ONES
            if not alive.all():
                words, over = words[alive], over[alive]
                counters = [c[alive] for c in counters]
            if not len(words):
                return np.zeros(0, dtype=np.int64)
    hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(hits)
    k = words[row] * 64 + bit
    return k[k + shift < n]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row of each row's component, joining pairs as they come."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            open_ = label[a] != label[b]
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            np.minimum.at(label, high, low)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label


def _near_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with equal keys (sorted, adjacent) that lie within the radius."""
    n = len(fps)
    if n < 2:
        return
    change = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    left = np.repeat(change[1:], np.diff(change)) - np.arange(n) - 1  # rows that follow in the same bucket
    planes = _planes(fps)
    for shift in range(1, int(left.max()) + 1):
        flags = np.packbits(left >= shift, bitorder="little")
        wanted = np.zeros(planes.shape[1] * 8, dtype=np.uint8)
        wanted[: len(flags)] = flags
        k = near_at(planes, shift, n, wanted.view("<u8"), radius)
        if len(k):
            yield k, k + shift


def bucket_stars(keys: np.ndarray, fps: np.ndarray, split_at: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, smallest linked row's fingerprint) of whole buckets; rows are sorted by key."""
    fps = fps.astype(np.uint64, copy=False)
    sizes = np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]))
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero((size > 1) & (size <= split_at))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in _near_pairs(keys[small], fps[small]):
            yield small[a], small[b]
        for key in np.unique(keys[size > split_at]):
            rows = np.flatnonzero(keys == key)
            a, b = int(key) >> 30 & 3, int(key) >> 28 & 3
            spare = [i for i in range(64) if i // 16 != a]
            free = [bit for place, bit in enumerate(spare) if place // 12 != b]
            for g in range(4):
                mask = np.uint64(sum(1 << bit for bit in free[9 * g : 9 * g + 9]))
                piece = fps[rows] & mask
                order = np.argsort(piece, kind="stable")
                for i, j in _near_pairs(piece[order], fps[rows][order]):
                    yield rows[order[i]], rows[order[j]]

    root = _roots(len(fps), pairs())
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved].view(np.int64), fps[root[moved]].view(np.int64)


def _sorted_buckets(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Whole buckets out of batches sorted by their first column: the columns as arrays, a bucket never cut."""
    columns: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(columns, new)] if columns else new
        keys = columns[0]
        if len(keys) >= least and keys[-1] != keys[0]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield [c[:cut] for c in columns]
            columns = [c[cut:] for c in columns]
    if columns and len(columns[0]):
        yield columns


def near_edges(classes: DataFrame) -> DataFrame:
    """Star edges (a, b) between fingerprints; ``classes`` has one row per fingerprint ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _sorted_buckets(batches):
            a, b = bucket_stars(keys, fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = classes.select(F.explode(bucket_keys()).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(run, "a long, b long")


# ---- wide fingerprints: similarity of word shingles above a threshold


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The hashes of a text's distinct ``words``-word shingles, sorted (fewer words: one shingle; none: empty)."""
    digest = xxhash.xxh64_intdigest
    seen = np.zeros(0, dtype=np.uint64)
    last: list[bytes] = []
    for part in _word_lists(text or "", words - 1):
        last = part
        if len(part) < words:
            continue
        hashes = np.unique(np.array([digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(words)))], dtype=np.uint64))
        seen = np.union1d(seen, hashes) if len(seen) else hashes
    if not len(seen) and last:
        return np.array([digest(b" ".join(last), 42)], dtype=np.uint64)
    return seen


def _wide_of(seen: np.ndarray) -> np.ndarray:
    """Four 64-bit words: SimHash over 256 bits of distinct shingles (one shingle: its hash, four times; none: zero)."""
    if len(seen) < 2:
        return np.full(4, seen[0] if len(seen) else 0, dtype=np.uint64)
    total = np.zeros(256, dtype=np.int64)
    for k in range(0, len(seen), 1 << 14):
        for lane in range(4):
            mixed = seen[k : k + (1 << 14)] * _MIX[lane]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * total > len(seen), bitorder="little").view(np.uint64)


def wide_fingerprint(text: str | None, words: int = 5) -> np.ndarray:
    """The 256-bit SimHash of a whole text's distinct shingles."""
    return _wide_of(shingle_set(text, words))


def wide_tables(n: int, share: float, least_bits: int = 16, bucket: int = 4096, recall: float = 0.9999) -> tuple[int, int]:
    """(tables, bits) for ``n`` wide fingerprints: names long enough for about ``bucket`` members, and as many tables as ``recall`` takes.

    Two texts at the threshold differ in about ``share`` of their bits, so a name of b sampled bits agrees in (1 - share)^b of
    the tables. What the near-dedup stage would need if it named buckets by bits of wide fingerprints; it names them by minima.
    """
    bits = max(least_bits, math.ceil(math.log2(max(1, n) / bucket)))
    agree = (1 - share) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree)), bits


_DEPTH = 6
_NAMES = math.ceil(math.log(1 - 0.9999) / math.log(1 - 0.8**_DEPTH))
_SALTS = np.random.default_rng(5).integers(0, 1 << 32, (2, _NAMES * _DEPTH), dtype=np.uint32) | np.array([[0], [1]], dtype=np.uint32)


def bucket_names(seen: np.ndarray) -> np.ndarray:
    """The ``_NAMES`` bucket names of a shingle set, each out of ``_DEPTH`` minima of the shingles under seeded orders.

    Two sets of Jaccard similarity s agree in a name with probability s^6, so 31 names miss one in 10,000 pairs at 0.8.
    """
    low = np.full(_SALTS.shape[1], 0xFFFFFFFF, dtype=np.uint32)
    short = (seen >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        mixed = short[k : k + 512, None] ^ _SALTS[0]
        mixed *= _SALTS[1]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(low, mixed.min(axis=0), out=low)
    folded = np.arange(1, _NAMES + 1, dtype=np.uint64) * _MIX[0]
    for column in low.reshape(_NAMES, _DEPTH).T.astype(np.uint64):
        folded = (folded ^ column) * _MIX[1]
        folded ^= folded >> np.uint64(29)
    return folded.view(np.int64)


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, uid, fp, wide, n, names) of every row, by one pass over the texts.

    uid is a digest of id and text, fp the 64-bit fingerprint, wide a digest of the set of ``words``-word shingles, n their number,
    names the set's bucket names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                narrow, wide, sizes, names = [], [], [], []
                for text in part.column(2):
                    text = text.as_py()
                    seen = shingle_set(text, words)
                    narrow.append(fingerprint(text)), wide.append(xxhash.xxh64_intdigest(seen.tobytes(), 42))
                    sizes.append(len(seen)), names.append(bucket_names(seen))
                longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (narrow, wide)]
                named = pa.ListArray.from_arrays(pa.array(np.arange(0, len(names) * _NAMES + 1, _NAMES, dtype=np.int32)), pa.array(np.concatenate(names)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *longs, pa.array(np.array(sizes, dtype=np.int32)), named], ["doc_id", "uid", "fp", "wide", "n", "names"])
            release_memory()

    ensure_importable(docs.sparkSession)
    source = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    return source.mapInArrow(run, "doc_id long, uid long, fp long, wide long, n int, names array<bigint>")


def similar_groups(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Smallest row of each row's group, where rows link if their sets have a Jaccard similarity of at least ``least``. Exact.

    Of each set the rarest elements are indexed, as many as a similar set cannot avoid all of; sets that meet there are compared
    in full, unless they are in one group already.
    """
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if n < 2 or not sizes.any():
        return label
    _, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    row = np.repeat(np.arange(n), sizes)
    flat = flat[np.lexsort((flat, often[flat], row))]
    ahead = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    indexed = np.flatnonzero((np.arange(len(flat)) - starts[row] < ahead[row]) & (often[flat] > 1))
    by = indexed[np.argsort(flat[indexed], kind="stable")]
    posted, rows_of = flat[by], row[by]
    marked = np.zeros(len(often), dtype=bool)
    members = {i: [i] for i in range(n)}
    for i in range(n - 1):
        if len(members) == 1:
            break
        mine = flat[starts[i] : starts[i] + ahead[i]]
        mine = mine[often[mine] > 1]
        low, high = np.searchsorted(posted, mine, "left"), np.searchsorted(posted, mine, "right")
        times = high - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        other = rows_of[at]
        other = np.unique(other[(other > i) & (label[other] != label[i])])
        other = other[np.minimum(sizes[other], sizes[i]) >= least * np.maximum(sizes[other], sizes[i])]
        if not len(other):
            continue
        marked[flat[starts[i] : ends[i]]] = True
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            edges = np.cumsum(sizes[some])
            at = np.repeat(starts[some] - edges + sizes[some], sizes[some]) + np.arange(int(edges[-1]))
            shared = np.add.reduceat(marked[flat[at]], edges - sizes[some], dtype=np.int64)
            for j in some[shared >= least * (sizes[some] + sizes[i] - shared)].tolist():
                a, b = int(label[i]), int(label[j])
                if a != b:
                    a, b = min(a, b), max(a, b)
                    label[members[b]] = a
                    members[a] += members.pop(b)
        marked[flat[starts[i] : ends[i]]] = False
    return label


def wide_links(rows: DataFrame, docs: DataFrame, words: int, radius: int = 256, tables: int | None = None, bits: int | None = None, split_at: int = 1 << 22, least: float = 0.8) -> DataFrame:
    """(node, root) of the shingle sets (``sketches``) that link to another one; the root names the group.

    Sets that share one of the first ``tables`` bucket names (by default all; of each, the lowest ``bits`` bits count) are candidates,
    and candidates of candidates form a pool. A pool's texts meet in one task, which compares their sets exactly, so no pair is
    ever a row. A pool above ``split_at`` shingles is dealt into blocks by digest, and each two blocks meet.
    ``radius`` limited the candidates when they were found by wide fingerprints; now all are compared.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _sorted_buckets(batches):
            first = np.r_[True, keys[1:] != keys[:-1]]
            head = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
            apart = head != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(head[apart])], ["a", "b"])

    def linked(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        label = similar_groups(sets, least)
        known = np.array(ids, dtype=np.int64)
        moved = np.flatnonzero(label != np.arange(len(known)))
        return pa.RecordBatch.from_arrays([pa.array(known[moved]), pa.array(known[label[moved]])], ["node", "root"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        for batch in batches:
            for key, wide, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != at:
                    if len(ids) > 1:
                        yield linked(ids, sets)
                    at, ids, sets = key, [], []
                if not ids or ids[-1] != wide:
                    ids.append(wide), sets.append(shingle_set(text.as_py(), words))
            release_memory()
        if len(ids) > 1:
            yield linked(ids, sets)

    classes = materialise(rows.groupBy("wide").agg(F.first("n").alias("n"), F.first("names").alias("names"), F.min("uid").alias("uid")), "wide-classes")
    names = F.slice("names", 1, _NAMES if tables is None else tables)
    if bits is not None:
        names = F.transform(names, lambda x, i: F.xxhash64(i, x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))))
    named = classes.select(F.explode(names).alias("key"), "wide").repartition("key").sortWithinPartitions("key", "wide")
    pools = connect(named.mapInArrow(stars, "a long, b long"), "wide-pools")
    pools = pools.union(pools.select(F.col("root").alias("node"), "root").distinct())
    pooled = materialise(classes.select("wide", "n", F.col("uid").alias("chosen")).join(pools, F.col("wide") == F.col("node")).select("wide", "n", "chosen", F.col("root").alias("pool")), "wide-pooled")
    sizes = pooled.groupBy("pool").agg(F.sum("n").alias("shingles")).where(F.col("shingles") > split_at)
    large = materialise(sizes.select(F.col("pool").alias("large"), F.ceil(2 * F.col("shingles") / split_at).cast("int").alias("blocks")), "wide-large")
    split = not large.isEmpty()
    members = pooled.select(F.col("pool").alias("key"), "wide", "chosen")
    if split:
        mine = F.pmod(F.xxhash64("wide"), F.col("blocks")).cast("int")
        other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine)
        cut = F.transform(other, lambda j: F.xxhash64("pool", F.least(mine, j), F.greatest(mine, j)))
        dealt = pooled.join(large, F.col("pool") == F.col("large"), "left")
        members = dealt.select(F.explode(F.when(F.col("blocks").isNull(), F.array("pool")).otherwise(cut)).alias("key"), "wide", "chosen")
    # Rows repeated in full share their uid; one of them is enough.
    texts = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "text").join(pooled.select("chosen"), F.col("uid") == F.col("chosen"), "left_semi")
    one = texts.groupBy("uid").agg(F.first("text").alias("text"))
    met = one.join(members, F.col("uid") == F.col("chosen")).select("key", "wide", "text").repartition("key").sortWithinPartitions("key", "wide")
    found = materialise(met.mapInArrow(link, "node long, root long"), "wide-stars")
    return connect(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "wide-stars") if split else found


def connect(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(node, root): smallest node of each component of the graph (a, b), for all nodes that have an edge.

    Alternates large-star (every larger neighbour moves to the smallest one) and small-star (all smaller neighbours do)
    until nothing changes; each round works on node-wise minima, never on lists of neighbours.
    """
    current = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written out, so that the joins meet plain exchanges and adaptive execution can split a node with many edges.
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), f"{label}-low")
        large = both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = materialise(large, f"{label}-large")
        lowest = materialise(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), f"{label}-lowest")
        linked = large.join(lowest, F.col("a") == F.col("n"))
        small = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        following = materialise(small, label)
        digest = following.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if digest == before:
            return following.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current, before = following, digest


def _rooted(rows: DataFrame) -> DataFrame:
    """(known, root, first_id) of every 64-bit fingerprint of ``rows`` (doc_id, fp)."""
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    links = connect(near_edges(classes))
    return classes.join(links, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("known"), F.coalesce("root", "fp").alias("root"), "first_id")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = materialise(fingerprints(docs), "fingerprints")
    rooted = _rooted(rows)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Written out, so that the join below meets plain exchanges and adaptive execution can split a fingerprint with many copies.
    lookup = materialise(rooted.join(named, "root").select("known", "component_id"), "components")
    joined = rows.join(lookup, F.col("fp") == F.col("known"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, words: int = 5, radius: int = 256, tables: int | None = None, bits: int | None = None, split_at: int = 1 << 22, least: float = 0.8) -> DataFrame:
    """(doc_id, uid, root) of every row of ``docs`` (doc_id, text); the root names the near-duplicate group (see ``keep_one``)."""
    rows = materialise(sketches(docs, words), "sketches")
    narrow = materialise(_rooted(rows).select("known", F.col("root").alias("near")), "narrow-links")
    wide = materialise(wide_links(rows, docs, words, radius, tables, bits, split_at, least), "wide-links")
    # Both kinds of links between classes of equal fingerprints, then the classes' components.
    pairs = rows.select("fp", "wide").distinct().join(narrow, F.col("fp") == F.col("known")).select("near", "wide").distinct()
    pairs = pairs.join(wide, F.col("wide") == F.col("node"), "left").select("near", F.coalesce("root", "wide").alias("group")).distinct()
    low = pairs.groupBy("near").agg(F.min("group").alias("low"))
    merged = materialise(connect(pairs.join(low, "near").select(F.col("group").alias("a"), F.col("low").alias("b")), "merged-groups"), "merged-links")
    group = materialise(
        rows.select("wide").distinct().join(wide, F.col("wide") == F.col("node"), "left").select("wide", F.coalesce("root", "wide").alias("group"))
        .join(merged.select(F.col("node").alias("of"), F.col("root").alias("top")), F.col("group") == F.col("of"), "left")
        .select(F.col("wide").alias("known"), F.coalesce("top", "group").alias("root")),
        "wide-groups",
    )
    return rows.select("doc_id", "uid", "wide").join(group, F.col("wide") == F.col("known")).select("doc_id", "uid", "root")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 256, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """One row of ``docs`` per near-duplicate group, the one with the smallest id (null ids last), with all its columns.

    Groups join texts whose 64-bit fingerprints link, and texts whose sets of ``words``-word shingles have a Jaccard similarity
    of at least 0.8. Candidates for the latter share one of 31 bucket names (see ``bucket_names``): 99.99 % of the pairs at
    exactly 0.8, more above. Each candidate's similarity is computed from the shingles before it links (see ``wide_links``). Rows
    repeated in full count as one; of rows with equal id and text but other columns the one with the smallest digest stays.
    """
    grouped = near_groups(docs.select("doc_id", "text"), words, radius, tables, bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("first")
    heads = materialise(grouped.groupBy("root").agg(first).select(F.col("first.uid").alias("head")), "heads")
    mark = free_name(docs, "uid")
    place = free_name(docs, "place")
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    once = Window.partitionBy(mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    rows = docs.withColumn(mark, F.xxhash64("doc_id", "text")).withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return rows.join(heads.withColumnRenamed("head", free_name(docs, "head")), F.col(mark) == F.col(free_name(docs, "head")), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_components(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
