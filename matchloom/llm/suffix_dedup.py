"""Exact substring de-duplication with suffix arrays, corpus-wide.

Rule: texts are UTF-8 bytes; a byte goes if it is covered by a string of ``WINDOW`` (50) bytes that also starts in a
document with a smaller id. Strings are judged on the input and never cross documents.

A single suffix array over a corpus does not fit a machine, and comparing every shard with every other is quadratic. The
work is therefore dealt out by content, so that equal strings meet:

1. Copies of whole texts (equal sha256) are set aside by a light aggregation over ids: they go in full if they are long
   enough, and the first copy stands for them.
2. Every 50-byte string has a minimiser: the smallest hash among its 27 24-grams. Equal strings have equal minimisers, and
   neighbouring strings mostly share theirs, so a text falls into runs (one per 14 bytes or so). Each chunk of
   documents sends the hashes of its runs, packed and cut into ranges; a range's task sends back to each chunk those
   that some other chunk has too. Only runs whose minimiser occurs in two documents go on. (Grams of 16 bytes recur by
   chance ever more often as the corpus grows; grams of 24 hardly do.)
3. Runs become segments (all strings of the run, as one byte string). Equal segments of a chunk are merged first, so a
   passage that a third of all documents share leaves each chunk once; then segments go to the bundle of their minimiser.
4. A bundle merges equal segments again. A string that two distinct segments share has at least 13 of its bytes on one side of
   its minimiser, so segments that share no such 37 bytes with another one need no array; the others are dealt into shards of
   bounded size. Each shard gets its suffix
   array by Larsson-Sadakane refinement in numpy (sort by 8 bytes, then double the order, touching only groups that are
   not yet single, until 64 bytes are ordered) and its common prefixes by Kasai's walk (many text positions in step,
   capped at 50). Runs of the array with common prefixes of 50 are the classes of equal strings, each with its smallest
   id. Sorted classes of different shards are merged two lists at a time by binary search of one list in the other.
5. Strings whose class has a smaller id than their document give spans; spans go back to the documents' chunks, where
   they are united and cut out.

A chunk is met three times, but its rows are moved once: all three plans read the same exchange. Chunks grow with the cube root
of the corpus (4 MB at 1 GB, 200 MB at 100 TB) and there are four times as many ranges as chunks, so a range holds a few MB
at any size while a chunk's parcels to the ranges do not become too small.

Defined cases: null texts are empty; texts under 50 bytes lose nothing; rows with the same id never remove from one another;
a null id counts as larger than any other; rows repeated in full get equal results; a text that loses everything
stays as an empty text; bytes left over of a character that was cut are dropped from the text that ``remove_repeats``
returns (the digest of the query is of the bytes); an empty table gives an empty result; extra columns pass through
``remove_repeats`` untouched, except ``n_chars``, which is counted anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_importable
from .common import materialise, read_table, release_memory, shielded

WINDOW = 50
GRAM = 24
CHUNK_BYTES = 1 << 22
SHARD_BYTES = 1 << 19
RANGES_PER_CHUNK = 4
_REACH = WINDOW - GRAM + 1
_SIDE = -(-(WINDOW - GRAM) // 2)
_BLOCK = 1 << 19
_LONGEST_RUN = 4096
_LAST = np.iinfo(np.int64).max
_LOW = np.uint64(0xFFFFFFFF)
_MAIL = "target int, kind int, uid long, a binary, b binary, c binary"
_MAIL_ARROW = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("uid", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_COPY, _SHARED, _SPANS = 0, 1, 2


# ---- minimisers -------------------------------------------------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """Mixed hash of each gram of ``GRAM`` bytes."""
    base, mask = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF
    part, have, whole, done = data.astype(np.uint64), 1, None, 0
    while True:
        if GRAM & have:
            whole = part if whole is None else whole[: len(data) - done - have + 1] * np.uint64(pow(base, have, 1 << 64)) + part[done:]
            done += have
        if 2 * have > GRAM:
            break
        part, have = part[:-have] * np.uint64(pow(base, have, 1 << 64) & mask) + part[have:], 2 * have
    h = whole ^ whole >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _sliding(values: np.ndarray, reach: int, best: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``reach`` neighbouring values."""
    have = 1
    while 2 * have <= reach:
        values = best(values[:-have], values[have:])
        have *= 2
    rest = reach - have
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _minima(data: np.ndarray) -> np.ndarray:
    """Smallest mixed hash of the grams of each 50-byte string (strings may cross documents; callers drop those)."""
    return _sliding(_grams(data), _REACH, np.minimum)


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, minimiser, document) of each run over texts laid end to end."""
    places, counts, hashes = [], [], []
    stops = np.unique(np.concatenate([starts, np.maximum(starts, ends - WINDOW + 1)]))
    for s in range(0, max(0, len(data) - WINDOW + 1), _BLOCK):
        low = _minima(data[s : s + _BLOCK + WINDOW - 1])
        new = np.empty(len(low), dtype=bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        inner = stops[np.searchsorted(stops, s) : np.searchsorted(stops, s + len(low))]
        new[inner - s] = True
        at = np.flatnonzero(new)
        places.append(at + s)
        counts.append(np.diff(np.append(at, len(low))))
        hashes.append(low[at])
    if not places:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    place, count, value = np.concatenate(places), np.concatenate(counts), np.concatenate(hashes)
    filled = np.flatnonzero(ends > starts)
    doc = filled[np.searchsorted(starts[filled], place, side="right") - 1]
    good = place + WINDOW <= ends[doc]
    place, count, value, doc = place[good], count[good], value[good], doc[good]
    pieces = -(-count // _LONGEST_RUN)
    if (pieces > 1).any():
        which = np.repeat(np.arange(len(place)), pieces)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _LONGEST_RUN
        place, count, value, doc = place[which] + step, np.minimum(count[which] - step, _LONGEST_RUN), value[which], doc[which]
    return place, count, value, doc


# ---- suffix arrays ----------------------------------------------------------------------------------------------


def _prefixes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as big-endian numbers (zeros behind the end)."""
    padded = np.zeros(len(data) + 80, dtype=np.uint64)
    padded[: len(data)] = data
    have = 1
    while have < 8:
        padded = (padded[:-have] << np.uint64(8 * have)) | padded[have:]
        have *= 2
    return padded


def suffix_array(data: np.ndarray, depth: int = WINDOW, prefixes: np.ndarray | None = None) -> np.ndarray:
    """Positions sorted by (at least) their next ``depth`` bytes: Larsson-Sadakane refinement, starting from 8 bytes."""
    n = len(data)
    first = (_prefixes(data) if prefixes is None else prefixes)[:n]
    sa = (n - 1 - np.argsort(first[::-1], kind="stable")).astype(np.int32)  # of equal prefixes the later position, which may be shorter, first
    ordered = first[sa]
    head = np.empty(n, dtype=bool)
    head[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    short = sa > n - 8
    head |= short
    head[1:] |= short[:-1]
    del ordered
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    order = 8
    while order < depth:
        single = head & np.append(head[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        items = sa[slots]
        beyond = items + order
        next_rank = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[items].astype(np.int64) * (n + 1) + next_rank
        by = np.argsort(key, kind="stable")
        sa[slots] = items[by]
        key = key[by]
        head[slots[1:]] = key[1:] != key[:-1]
        head[slots[0]] = True
        changed = sa[slots]
        rank[changed] = np.maximum.accumulate(np.where(head[slots], slots, 0))
        order *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int = WINDOW, prefixes: np.ndarray | None = None) -> np.ndarray:
    """Kasai: common prefix of each entry with the entry before it, up to ``cap``. Lanes of positions walk in step.

    As the array orders its entries by 64 bytes only, one less than the last prefix is a lower bound only where the
    last neighbour, moved by one, still stands before the position; elsewhere the walk starts from nothing.
    """
    n = len(data)
    words = _prefixes(data) if prefixes is None else prefixes
    before = np.empty(n, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[:1]] = -1
    place = np.empty(n + 1, dtype=np.int32)
    place[sa] = np.arange(n)
    place[n] = n
    found = np.zeros(n, dtype=np.int32)
    lanes = max(1, min(n, 1 << 12))
    length = -(-n // lanes)
    start = np.arange(lanes) * length
    h = np.zeros(lanes, dtype=np.int64)
    last = np.full(lanes, n - 1)
    for step in range(length):
        p = start + step
        if p[-1] >= n:
            p = p[p < n]
        k = h[: len(p)]
        q = before[p]
        np.maximum(k - 1, 0, out=k)
        k[(place[last[: len(p)] + 1] > place[p]) | (q < 0)] = 0
        active = np.flatnonzero(q >= 0)
        while len(active):
            at = k[active]
            differ = words[np.minimum(p[active] + at, n + 64)] ^ words[np.minimum(q[active] + at, n + 64)]
            same = differ == 0
            zeros = np.zeros(len(at), dtype=np.int64)
            zeros[same] = 8
            left = ~same
            if left.any():
                zeros[left] = (64 - np.frexp(differ[left].astype(np.float64))[1]) // 8
            k[active] = np.minimum(at + zeros, cap)
            active = active[same & (k[active] < cap)]
        np.minimum(k, n - np.maximum(p, q), out=k)
        found[p] = k
        h[: len(p)] = k
        last[: len(p)] = np.where(q < 0, n - 1, q)
    out = found[sa]
    out[:1] = 0
    return out


class Shard:
    """Distinct segments laid end to end, their suffix array, and its classes of equal 50-byte strings."""

    def __init__(self, segments: list[bytes], ids: np.ndarray) -> None:
        data = np.frombuffer(b"".join(segments), dtype=np.uint8)
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        words = _prefixes(data)
        sa = suffix_array(data, prefixes=words)
        lcp = common_prefixes(data, sa, prefixes=words)
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
        whole = np.arange(len(data)) + WINDOW <= np.repeat(np.cumsum(sizes), sizes)
        kept = np.flatnonzero(whole[sa])
        starts_class = np.cumsum(lcp < WINDOW)[kept]
        head = np.append(True, starts_class[1:] != starts_class[:-1])
        self.owner = owner
        self.position = sa[kept]
        self.class_of = np.cumsum(head, dtype=np.int32) - 1
        self.smallest = np.minimum.reduceat(ids[owner[self.position]], np.flatnonzero(head)) if len(kept) else np.zeros(0, dtype=np.int64)
        self.best = self.smallest.copy()
        self.first = self.position[head] if len(kept) else self.position
        self.words = words


def _find(words: np.ndarray, there: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the strings at ``want`` among the sorted strings at ``there``: the place of each, and whether it is there.

    ``words`` holds the 8 bytes from each position on; strings are compared word by word (the last one overlaps the one before).
    """
    key = lambda at, level: words[at + min(8 * level, WINDOW - 8)]
    first, wanted = key(there, 0), key(want, 0)
    low, high = np.searchsorted(first, wanted, side="left"), np.searchsorted(first, wanted, side="right")
    alive = np.flatnonzero(low < high)
    for level in range(1, -(-WINDOW // 8)):
        if not len(alive):
            break
        own, other = key(want[alive], level), key(there, level)
        low[alive], high[alive] = _bound(other, own, low[alive], high[alive], False), _bound(other, own, low[alive], high[alive], True)
        alive = alive[low[alive] < high[alive]]
    found = np.zeros(len(want), dtype=bool)
    found[alive] = True
    return low, found


def _merged(words: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of classes (position of the string, smallest id) as one; a class of both takes the smaller id."""
    low, found = _find(words, a[0], b[0])
    smallest = a[1].copy()
    np.minimum.at(smallest, low[found], b[1][found])
    return np.insert(a[0], low[~found], b[0][~found]), np.insert(smallest, low[~found], b[1][~found])


def _bound(there: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Per query, the border of ``want`` within its own range of the sorted keys."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        value = there[middle]
        up = value <= want[open_] if right else value < want[open_]
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]


def _meeting(segments: list[bytes]) -> np.ndarray:
    """The segments that may share a 50-byte string with another one: those that share a minimiser with ``_SIDE`` bytes before or behind it."""
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    keys, owners = [], []
    step = max(_BLOCK, WINDOW)
    margin = WINDOW + _SIDE
    # Blocks overlap, so that every string lies whole, with all grams at its minimiser's sides, in one of them.
    for s in range(0, len(data), step):
        part = data[s : s + step + 2 * margin]
        if len(part) < WINDOW:
            break
        h = _grams(part)
        low = _sliding(h, _REACH, np.minimum)
        edge = np.zeros(_REACH - 1, dtype=np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), _REACH, np.maximum)[: len(h)] == h)
        owner = np.searchsorted(ends, at + s, side="right")
        first, last = ends[owner] - sizes[owner] - s, ends[owner] - s
        before = np.flatnonzero((at - _SIDE >= np.maximum(first, 0)) & (at + GRAM <= last))
        behind = np.flatnonzero((at + _SIDE + GRAM <= last) & (at + _SIDE < len(h)))
        keys += [h[at[before] - _SIDE] * np.uint64(0x9E3779B97F4A7C15) ^ h[at[before]], h[at[behind] + _SIDE] * np.uint64(0xBF58476D1CE4E5B9) ^ h[at[behind]]]
        owners += [owner[before], owner[behind]]
    if not keys:
        return np.zeros(0, dtype=np.int64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    if not len(key):
        return owner
    by = np.argsort(key, kind="stable")
    key, owner = key[by], owner[by]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
    return np.unique(owner[np.repeat(several, np.diff(np.append(head, len(key))))])


def segment_spans(segments: list[bytes], ids: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (segment, from, to) covered by strings that occur in a segment with a smaller id."""
    meet = _meeting(segments)
    segments, ids = [segments[i] for i in meet.tolist()], ids[meet]
    shards: list[tuple[int, Shard]] = []
    first = total = 0
    for i, segment in enumerate(segments):
        total += len(segment)
        if total >= shard_bytes or i + 1 == len(segments):
            shards.append((first, Shard(segments[first : i + 1], ids[first : i + 1])))
            first, total = i + 1, 0
    if len(shards) > 1:
        # Lists of classes are merged two by two, level by level, so that a class is moved as often as the logarithm of the shards.
        starts = np.cumsum([0] + [len(shard.words) for _, shard in shards])
        words = np.concatenate([shard.words for _, shard in shards])
        lists = [(shard.first + start, shard.smallest) for (_, shard), start in zip(shards, starts)]
        while len(lists) > 1:
            lists = [_merged(words, *lists[i : i + 2]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
        for (_, shard), start in zip(shards, starts):
            shard.best = lists[0][1][_find(words, lists[0][0], shard.first + start)[0]]
    which, begin, end = [], [], []
    for first, shard in shards:
        n = len(shard.owner)
        own = ids[first + shard.owner[shard.position]]
        gone = np.zeros(n + 1, dtype=bool)
        gone[shard.position] = shard.best[shard.class_of] < own
        edge = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        base = np.flatnonzero(np.r_[True, shard.owner[1:] != shard.owner[:-1]]) if n else np.zeros(0, dtype=np.int64)
        seg = shard.owner[s]
        which.append(first + seg), begin.append(s - base[seg]), end.append(e - base[seg] + WINDOW - 1)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return meet[join(which)], join(begin), join(end)


# ---- the tasks --------------------------------------------------------------------------------------------------


def _laid_out(table: pa.Table, copies: set[int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's texts end to end (copies left out): bytes, starts, ends, uids, ids."""
    uids = table.column("__uid").to_numpy()
    ids = table.column("__id").to_numpy()
    texts = table.column("text")
    rows, parts, seen = [], [], set()
    for i, uid in enumerate(uids.tolist()):
        if uid not in copies and uid not in seen:
            seen.add(uid)
            rows.append(i), parts.append((texts[i].as_py() or "").encode("utf-8", "replace"))
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes)
    rows = np.array(rows, dtype=np.int64)
    return b"".join(parts), ends - sizes, ends, uids[rows], ids[rows]


def _copies(mail: pa.Table) -> set[int]:
    return {u for u, k in zip(mail.column("uid").to_pylist(), mail.column("kind").to_pylist()) if k == _COPY}


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def _send_hashes(ranges: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if texts.num_rows:
            data, starts, ends, _, _ = _laid_out(texts, _copies(mail))
            hashes = np.unique(runs(np.frombuffer(data, dtype=np.uint8), starts, ends)[2])
            part = _range_of(hashes, ranges)
            by = np.argsort(part, kind="stable")
            low = (hashes[by] & _LOW).astype("<u4")
            edges = np.searchsorted(part[by], np.arange(ranges + 1))
            chunk = texts.column("__chunk")[0].as_py()
            out = [(r, chunk, low[edges[r] : edges[r + 1]].tobytes()) for r in range(ranges) if edges[r] < edges[r + 1]]
        release_memory()
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["part", "__chunk", "hashes"])

    return run


def _shared_hashes(table: pa.Table) -> pa.Table:
    """For one range: to each chunk the hashes that another chunk has too."""
    part = table.column("part")[0].as_py()
    chunks = table.column("__chunk").to_numpy()
    blobs = [np.frombuffer(x.as_py(), dtype="<u4") for x in table.column("hashes")]
    sizes = np.array([len(x) for x in blobs])
    values = np.concatenate(blobs)
    by = np.argsort(values, kind="stable")
    ordered = values[by]
    equal = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(values), dtype=bool)
    shared[by] = np.r_[False, equal] | np.r_[equal, False]
    edges = np.r_[0, np.cumsum(sizes)]
    rows = [(int(c), blob[shared[edges[i] : edges[i + 1]]].tobytes()) for i, (c, blob) in enumerate(zip(chunks, blobs)) if shared[edges[i] : edges[i + 1]].any()]
    return pa.Table.from_pylist([{"target": c, "kind": _SHARED, "uid": part, "a": b, "b": None, "c": None} for c, b in rows], _MAIL_ARROW)


def _send_segments(ranges: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["part", "__chunk", "data", "sizes", "places", "settled"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if texts.num_rows:
            data, starts, ends, uids, ids = _laid_out(texts, _copies(mail))
            place, count, value, doc = runs(np.frombuffer(data, dtype=np.uint8), starts, ends)
            part = _range_of(value, ranges)
            code = part.astype(np.uint64) << np.uint64(32) | (value & _LOW)
            sent = [np.frombuffer(a, dtype="<u4").astype(np.uint64) | np.uint64(u << 32) for k, u, a in zip(*(mail.column(c).to_pylist() for c in ("kind", "uid", "a"))) if k == _SHARED]
            elsewhere = np.isin(code, np.concatenate(sent)) if sent else np.zeros(len(code), dtype=bool)
            by = np.argsort(value, kind="stable")
            head = np.flatnonzero(np.r_[True, value[by][1:] != value[by][:-1]]) if len(by) else by
            if len(by):
                mixed = np.minimum.reduceat(doc[by], head) != np.maximum.reduceat(doc[by], head)
                here = np.empty(len(by), dtype=bool)
                here[by] = np.repeat(mixed, np.diff(np.append(head, len(by))))
                elsewhere |= here
            wanted = np.flatnonzero(elsewhere)
            place, count, part, doc = place[wanted], count[wanted], part[wanted], doc[wanted]
            stop = place + count + WINDOW - 1
            known: dict[bytes, int] = {}
            segment = np.fromiter((known.setdefault(data[s:e], len(known)) for s, e in zip(place.tolist(), stop.tolist())), dtype=np.int64, count=len(place))
            owner = ids[doc]
            least = np.full(len(known), _LAST)
            np.minimum.at(least, segment, owner)
            stays = owner == least[segment]
            gone = np.flatnonzero(~stays)
            settled = np.stack([uids[doc[gone]], place[gone] - starts[doc[gone]], stop[gone] - starts[doc[gone]]], axis=1).astype("<i8")
            stays = np.flatnonzero(stays)
            first = np.zeros(len(known), dtype=np.int64)
            first[segment] = part
            names_of = list(known)
            order = np.argsort(first, kind="stable")
            new_index = np.empty(len(known), dtype=np.int64)
            new_index[order] = np.arange(len(known))
            occurrence = np.stack([new_index[segment[stays]], uids[doc[stays]], owner[stays], place[stays] - starts[doc[stays]]], axis=1).astype("<i8")
            occurrence = occurrence[np.argsort(occurrence[:, 0], kind="stable")]
            edges = np.searchsorted(first[order], np.arange(ranges + 1))
            cuts = np.searchsorted(occurrence[:, 0], edges)
            chunk = texts.column("__chunk")[0].as_py()
            for r in range(ranges):
                a, b = edges[r], edges[r + 1]
                if a == b:
                    continue
                mine = [names_of[i] for i in order[a:b].tolist()]
                rows = occurrence[cuts[r] : cuts[r + 1]].copy()
                rows[:, 0] -= a
                out.append((r, chunk, b"".join(mine), np.fromiter(map(len, mine), dtype="<i4", count=len(mine)).tobytes(), rows.tobytes(), None))
            if len(settled):
                out.append((chunk % ranges, chunk, None, None, None, settled.tobytes()))
        release_memory()
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _bundle_spans(shard_bytes: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        rows, chunk_of, mail = [], [], []
        for chunk, data, sizes, places, settled in zip(*(table.column(c) for c in ("__chunk", "data", "sizes", "places", "settled"))):
            if settled.is_valid:
                mail.append({"target": chunk.as_py(), "kind": _SPANS, "uid": None, "a": settled.as_py(), "b": None, "c": None})
                continue
            text, edges = data.as_py(), np.r_[0, np.cumsum(np.frombuffer(sizes.as_py(), dtype="<i4"))].tolist()
            index = np.fromiter((known.setdefault(text[a:b], len(known)) for a, b in zip(edges, edges[1:])), dtype=np.int64, count=len(edges) - 1)
            own = np.frombuffer(places.as_py(), dtype="<i8").reshape(-1, 4).copy()
            own[:, 0] = index[own[:, 0]]
            rows.append(own)
            chunk_of.append(np.full(len(own), chunk.as_py()))
        if rows:
            segments = list(known)
            occurrence, chunks = np.concatenate(rows), np.concatenate(chunk_of)
            least = np.full(len(segments), _LAST)
            np.minimum.at(least, occurrence[:, 0], occurrence[:, 2])
            sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
            later = np.flatnonzero(occurrence[:, 2] > least[occurrence[:, 0]])
            spans = [np.stack([chunks[later], occurrence[later, 1], occurrence[later, 3], occurrence[later, 3] + sizes[occurrence[later, 0]]], axis=1)]
            which, begin, end = segment_spans(segments, least, shard_bytes)
            if len(which):
                firsts = np.flatnonzero(occurrence[:, 2] == least[occurrence[:, 0]])
                firsts = firsts[np.argsort(occurrence[firsts, 0], kind="stable")]
                by_segment = occurrence[firsts, 0]
                low, high = np.searchsorted(by_segment, which, "left"), np.searchsorted(by_segment, which, "right")
                times = high - low
                span = np.repeat(np.arange(len(which)), times)
                at = firsts[np.repeat(low, times) + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)]
                spans.append(np.stack([chunks[at], occurrence[at, 1], occurrence[at, 3] + begin[span], occurrence[at, 3] + end[span]], axis=1))
            found = np.concatenate(spans)
            del segments, known, occurrence, spans
            found = found[np.argsort(found[:, 0], kind="stable")]
            for chunk in np.unique(found[:, 0]).tolist():
                a, b = np.searchsorted(found[:, 0], [chunk, chunk + 1])
                mail.append({"target": chunk, "kind": _SPANS, "uid": None, "a": found[a:b, 1:].astype("<i8").tobytes(), "b": None, "c": None})
        release_memory()
        return pa.Table.from_pylist(mail, _MAIL_ARROW)

    return run


def united(spans: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Maximal runs per uid of rows (uid, from, to)."""
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(spans):
        return out
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    for uid, s, e in spans.tolist():
        own = out.setdefault(uid, [])
        if own and s <= own[-1][1]:
            if e > own[-1][1]:
                own[-1] = (own[-1][0], e)
        else:
            own.append((s, e))
    return out


def _cut(texts: pa.Table, mail: pa.Table):
    """Per row of the chunk: bytes, removed runs."""
    copies = _copies(mail)
    parts = [np.frombuffer(a, dtype="<i8").reshape(-1, 3) for k, a in zip(mail.column("kind").to_pylist(), mail.column("a").to_pylist()) if k == _SPANS]
    spans = united(np.concatenate(parts)) if parts else {}
    for text, uid in zip(texts.column("text"), texts.column("__uid").to_pylist()):
        data = (text.as_py() or "").encode("utf-8", "replace")
        if uid in copies:
            yield data, [(0, len(data))] if len(data) >= WINDOW else []
        else:
            yield data, spans.get(uid, [])


def _kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in gone:
        parts.append(data[at:s])
        at = e
    parts.append(data[at:])
    return b"".join(parts)


def _plan(docs: DataFrame, chunk_bytes: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The documents by chunk, and the mail that tells each chunk its copies and spans."""
    spark = docs.sparkSession
    ensure_importable(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes = max(chunk_bytes, int(4400 * total ** (1 / 3)))
    chunks = max(1, -(-total // chunk_bytes))
    ranges = RANGES_PER_CHUNK * chunks
    uid = F.xxhash64("doc_id", "text")
    rows = docs.withColumns({"__uid": uid, "__id": F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("long"), "__chunk": F.pmod(uid, F.lit(chunks)).cast("int")})
    light = rows.select("__uid", "__id", "__chunk", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    first = light.groupBy("digest").agg(F.min("__id").alias("first_id"), F.min("__uid").alias("any_uid"), F.max("__uid").alias("last_uid"))
    # Written out, so that the join below meets plain exchanges and adaptive execution can split a text with many copies.
    several = materialise(first.where(F.col("any_uid") != F.col("last_uid")).select(F.col("digest").alias("same"), "first_id"), "copies")
    empty = F.lit(None).cast("binary")
    copies = (
        light.join(several, (F.col("digest") == F.col("same")) & (F.col("__id") > F.col("first_id")))
        .select(F.col("__chunk").alias("target"), F.lit(_COPY).alias("kind"), F.col("__uid").alias("uid"), empty.alias("a"), empty.alias("b"), empty.alias("c"))
    )
    mailed = lambda function, mail, schema: rows.groupBy("__chunk").cogroup(mail.groupBy("target")).applyInArrow(function, schema)
    hashes = mailed(_send_hashes(ranges), copies, "part int, `__chunk` int, hashes binary")
    shared = hashes.groupBy("part").applyInArrow(_shared_hashes, _MAIL)
    segments = mailed(_send_segments(ranges), copies.unionByName(shared), "part int, `__chunk` int, data binary, sizes binary, places binary, settled binary")
    spans = segments.groupBy("part").applyInArrow(_bundle_spans(shard_bytes), _MAIL)
    return rows, copies.unionByName(spans)


def repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text)."""

    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        out = [(len(d), sum(e - s for s, e in gone), len(gone), hashlib.sha256(_kept(d, gone)).hexdigest()) for d, gone in _cut(texts, mail)]
        columns = list(zip(*out)) or [[]] * 4
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        ids = texts.column("doc_id").combine_chunks() if texts.num_rows else pa.array([], pa.int64())
        return pa.table([ids, *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows, mail = _plan(docs.select("doc_id", "text"), chunk_bytes, shard_bytes)
    return rows.groupBy("__chunk").cogroup(mail.groupBy("target")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; all columns and rows stay."""
    docs, back = shielded(docs, ("__uid", "__id", "__chunk"))
    fields = docs.schema.fields
    names = [f.name for f in fields]
    schema = T.StructType(fields)

    def run(texts: pa.Table, mail: pa.Table) -> pa.Table:
        left = texts.select(names)
        if not left.num_rows:
            return left
        kept = [None if t is None else _kept(d, gone).decode("utf-8", "ignore") for t, (d, gone) in zip(texts.column("text").is_valid().to_pylist(), _cut(texts, mail))]
        kept = [x if ok else None for x, ok in zip(kept, texts.column("text").is_valid().to_pylist())]
        place = names.index("text")
        left = left.set_column(place, left.schema.field(place), pa.chunked_array([pa.array(kept, left.schema.field(place).type)]))
        if "n_chars" in names:
            place = names.index("n_chars")
            kind = left.schema.field(place)
            left = left.set_column(place, kind, pa.chunked_array([pa.array([None if x is None else len(x) for x in kept], pa.int64()).cast(kind.type)]))
        return left

    rows, mail = _plan(docs, chunk_bytes, shard_bytes)
    return rows.groupBy("__chunk").cogroup(mail.groupBy("target")).applyInArrow(run, schema).withColumnsRenamed(back)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document loses to documents with smaller ids."""
    return repeats(read_table(spark, sf_dir, "documents"))
