"""Pairwise string similarity.

``ratio`` is the normalised indel similarity 2·LCS / (|a| + |b|); the token variants and Jaro-Winkler follow their published
definitions. Scores run from 0 to 100. ``similarities`` offers any set of scorers as one Arrow-backed pandas UDF: the distinct
pairs of a batch are scored once, by numpy over whole blocks of pairs.

The longest common subsequence is bit-parallel. Up to 64 characters a row of the table is one machine word, so a block of pairs
advances one character at a time in step; longer strings use Python's integers as rows. ``partial_ratio`` needs the subsequence
of the shorter string with every window of the longer one: up to 64 characters the windows advance in step as well, beyond
that one pass of string combing gives all windows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 64
_BLOCK = 2048
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- single pairs


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel: one addition per character of ``b``)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    everything = (1 << len(a)) - 1
    row = everything
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & everything
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def combed(a: str, b: str) -> np.ndarray:
    """For each place of ``b`` where a strand of the combed grid ends: the place of ``b`` where it started (below 0: elsewhere).

    The longest common subsequence of ``a`` and ``b[i:j]`` is then j - i less the strands that start and end in [i, j).
    """
    m, n = len(a), len(b)
    rows, columns = _codes(a)[::-1], _codes(b)
    across, down = np.arange(m, dtype=np.int64), np.arange(m, m + n, dtype=np.int64)
    for d in range(m + n - 1):
        first, last = max(0, d - n + 1), min(m - 1, d)
        h, v = slice(m - 1 - last, m - first), slice(d - last, d - first + 1)
        x, y = across[h], down[v]
        cross = (rows[h] == columns[v]) | (x > y)
        across[h], down[v] = np.where(cross, y, x), np.where(cross, x, y)
    return down - m


def _window_lengths(short: str, long: str) -> np.ndarray:
    """Subsequence lengths of ``short`` with long[max(0, s) : s + n], for s from 1 - n to len(long) - 1."""
    n, m = len(short), len(long)
    start = combed(short, long)
    end_of = np.full(m, m, dtype=np.int64)
    inside = start >= 0
    end_of[start[inside]] = np.flatnonzero(inside)
    out, held, low, high = [], 0, 0, 0
    for s in range(1 - n, m):
        while high < min(m, s + n):
            held += int(start[high] >= low)
            high += 1
        while low < s:
            held -= int(end_of[low] < high)
            low += 1
        out.append(high - low - held)
    return np.array(out)


def _best_window(short: str, long: str) -> float:
    n, m = len(short), len(long)
    s = np.arange(1 - n, m)
    sizes = np.minimum(m, s + n) - np.maximum(0, s)
    return float((200.0 * _window_lengths(short, long) / (n + sizes)).max())


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of the longer one (windows at the borders may be shorter); of two equally long texts either counts as the shorter."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(a) == len(b) and best < 100.0 else best


def token_sort(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(token_sort(a), token_sort(b))


def _token_sets(a: str, b: str) -> tuple[float, str, str]:
    """A score that needs no subsequence, and the two texts that do: common words first, then the rest of either side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0, "", ""
    common, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not only_a or not only_b):
        return 100.0, "", ""
    left, right = " ".join([*common, *only_a]), " ".join([*common, *only_b])
    base = len(" ".join(common))
    known = max(200.0 * base / (base + len(left)), 200.0 * base / (base + len(right))) if common else 0.0
    return known, left, right


def token_set_ratio(a: str, b: str) -> float:
    """Best of: common words against common words plus the rest of either side, and the two sums against each other."""
    known, left, right = _token_sets(a, b)
    return max(known, ratio(left, right)) if left else known


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """0 to 1; a common prefix of up to four characters counts where the Jaro similarity is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = bytearray(len(b))
    first: list[str] = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = 1
            first.append(c)
    m = len(first)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(first, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


# ---- blocks of pairs


def _matrix(texts: Sequence[str], width: int, fill: int) -> np.ndarray:
    """Code points of short texts, one row each, filled up."""
    out = np.full((len(texts), width), fill, dtype=np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = _codes(t)
    return out


def _hits(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per pair the places of each character of ``b`` in ``a`` as bits, and a full row of ``a``'s length."""
    x = _matrix(a, max(1, max(map(len, a))), 0xFFFFFFFF)
    y = _matrix(b, max(1, max(map(len, b))), 0xFFFFFFFE)
    hits = np.zeros(y.shape, dtype=np.uint64)
    for i in range(x.shape[1]):
        hits |= (x[:, i : i + 1] == y).astype(np.uint64) << np.uint64(i)
    sizes = np.array([len(t) for t in a], dtype=np.uint64)
    full = np.where(sizes == 64, _ALL, (np.uint64(1) << (sizes & np.uint64(63))) - np.uint64(1))
    return hits, full


def _advance(row: np.ndarray, hit: np.ndarray) -> np.ndarray:
    hit = row & hit
    return (row + hit) | (row - hit)


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs."""
    out = np.zeros(len(a), dtype=np.int64)
    short = [i for i in range(len(a)) if min(len(a[i]), len(b[i])) <= _WORD and max(len(a[i]), len(b[i])) <= 8 * _WORD]
    for i in sorted(set(range(len(a))) - set(short)):
        out[i] = lcs_length(a[i], b[i])
    short.sort(key=lambda i: (max(len(a[i]), len(b[i])), min(len(a[i]), len(b[i]))))
    for k in range(0, len(short), _BLOCK):
        part = short[k : k + _BLOCK]
        x = [min(a[i], b[i], key=len) for i in part]
        y = [max(b[i], a[i], key=len) for i in part]
        hits, full = _hits(x, y)
        row = full.copy()
        for j in range(hits.shape[1]):
            row = _advance(row, hits[:, j])
        out[part] = np.array([len(t) for t in x]) - np.bitwise_count(row & full)
    return out


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=np.float64)
    return np.where(total == 0, 100.0, 200.0 * lcs_lengths(a, b) / np.maximum(total, 1))


def _best_windows(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """``_best_window`` of many pairs whose shorter texts have 1 to 64 characters."""
    n, m = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    hits, full = _hits(short, long)
    hits = np.concatenate([hits, np.zeros((len(hits), 1), dtype=np.uint64)], axis=1)
    best = np.zeros(len(n))
    lines = np.arange(len(n))
    for s in range(1 - int(n.max()), int(m.max())):
        begin, end = np.maximum(0, s), np.minimum(m, s + n)
        sizes = end - begin
        if not (sizes > 0).any():
            continue
        row = full.copy()
        for j in range(int(sizes.max())):
            at = np.where(j < sizes, begin + j, hits.shape[1] - 1)
            row = _advance(row, hits[lines, np.minimum(at, hits.shape[1] - 1)])
        found = n - np.bitwise_count(row & full)
        best = np.maximum(best, np.where(sizes > 0, 200.0 * found / (n + np.maximum(sizes, 0)), 0.0))
    return best


def partial_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    out = np.zeros(len(a))
    todo: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b)):
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if not short or len(short) > _WORD or len(long) > 4 * _WORD:
            out[i] = partial_ratio(x, y)
            continue
        todo.append((i, short, long))
        if len(x) == len(y):
            todo.append((i, long, short))
    todo.sort(key=lambda t: (len(t[2]), len(t[1])))
    for k in range(0, len(todo), _BLOCK):
        part = todo[k : k + _BLOCK]
        np.maximum.at(out, [i for i, _, _ in part], _best_windows([s for _, s, _ in part], [x for _, _, x in part]))
    return out


def token_set_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    parts = [_token_sets(x, y) for x, y in zip(a, b)]
    known = np.array([p[0] for p in parts])
    open_ = [i for i, p in enumerate(parts) if p[1]]
    if open_:
        known[open_] = np.maximum(known[open_], ratios([parts[i][1] for i in open_], [parts[i][2] for i in open_]))
    return known


SCORERS: dict[str, Callable[[Sequence[str], Sequence[str]], np.ndarray]] = {
    "ratio": ratios,
    "token_sort": lambda a, b: ratios([token_sort(x) for x in a], [token_sort(y) for y in b]),
    "token_set": token_set_ratios,
    "partial": partial_ratios,
    "jaro_winkler": lambda a, b: np.array([100.0 * jaro_winkler(x, y) for x, y in zip(a, b)]),
}


def similarities(scorers: Sequence[str], left: Column, right: Column, empty_is_null: bool = True) -> Column:
    """Scores of two string columns by several scorers, as a struct with a field each; null where either side is empty (unless told otherwise)."""
    names = list(scorers)

    @F.pandas_udf(", ".join(f"{s} double" for s in names))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
        place, distinct = pd.factorize(pairs)
        x, y = [p[0] for p in distinct], [p[1] for p in distinct]
        wanted = [i for i in range(len(x)) if not empty_is_null or x[i] and y[i]]
        table = np.full((len(x), len(names)), np.nan)
        for k, name in enumerate(names):
            if wanted:
                table[wanted, k] = SCORERS[name]([x[i] for i in wanted], [y[i] for i in wanted])
        return pd.DataFrame(table[place], columns=names)

    return run(left, right)


def similarity(scorer: str, left: Column, right: Column, empty_is_null: bool = True) -> Column:
    """Score of two string columns by one scorer."""
    value = similarities([scorer], left, right, empty_is_null)[scorer]
    return F.when(~F.isnan(value), value)


def scored(prefix: str, struct: str, scorers: Sequence[str], scale: float = 1.0) -> dict[str, Column]:
    """Columns ``prefix`` + scorer out of a struct of ``similarities``; null where it has none."""
    return {f"{prefix}{s}": F.when(~F.isnan(F.col(struct)[s]), F.col(struct)[s] * scale) for s in scorers}


# ---- arrays


def one_digit_typo(a: Column, b: Column) -> Column:
    """Some number of one side differs from some number of the other in exactly one digit (equal lengths)."""
    only_b = F.array_except(b, a)
    return F.exists(F.array_except(a, b), lambda x: F.exists(only_b, lambda y: (F.length(x) == F.length(y)) & (F.levenshtein(x, y) == 1)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Null where both sets are empty."""
    return F.try_divide(overlap(a, b).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def smaller_share(a: Column, b: Column) -> Column:
    """The smaller of two numbers divided by the greater one."""
    return F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double"))


def length_ratio(a: Column, b: Column) -> Column:
    return smaller_share(F.length(a), F.length(b))


def first_equal(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), (F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
