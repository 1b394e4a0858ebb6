"""The fuzzy scorers in SQL, for texts of at most 126 characters: a row of the subsequence table is one HUGEINT."""

from __future__ import annotations


def _hits(a: str, b: str) -> str:
    """The places of each character of ``b`` in ``a``, as bits."""
    return f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, CAST(i + 1 AS BIGINT), 1) = c THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END)))"


def _length(a: str, hits: str) -> str:
    full = f"((1::HUGEINT << length({a})) - 1)"
    return f"(length({a}) - bit_count(list_reduce({hits}, lambda r, h: ((r + (r & h)) | (r - (r & h))) & {full}, {full})))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0 * {_length(a, _hits(a, b))} / (length({a}) + length({b})) END::DOUBLE"


def _windows(short: str, long: str, hits: str) -> str:
    """Best ratio of ``short`` with the windows of ``long``, whose characters' places are ``hits``."""
    part = f"{hits}[greatest(0, s) + 1 : least(length({long}), s + length({short}))]"
    size = f"(least(length({long}), s + length({short})) - greatest(0, s))"
    return f"list_max(list_transform(generate_series(1 - length({short}), length({long}) - 1), lambda s: 200.0 * {_length(short, part)} / (length({short}) + {size})))::DOUBLE"


def tokens(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


def scores(name: str, pairs: str, scorers: str) -> str:
    """CTEs that end in ``name`` (a, b and a column for each scorer) over the distinct pairs (a, b) of a query; scores from 0 to 100."""
    wanted = scorers.split()
    out = [f"{name}_0 AS (SELECT DISTINCT a, b FROM ({pairs}))"]
    columns = ["a", "b"]
    extra = [
        f"array_to_string(list_sort({tokens('a')}), ' ') AS sa, array_to_string(list_sort({tokens('b')}), ' ') AS sb",
        f"list_sort(list_distinct(list_filter({tokens('a')}, lambda x: list_contains({tokens('b')}, x)))) AS common",
        f"list_sort(list_distinct(list_filter({tokens('a')}, lambda x: NOT list_contains({tokens('b')}, x)))) AS left_only",
        f"list_sort(list_distinct(list_filter({tokens('b')}, lambda x: NOT list_contains({tokens('a')}, x)))) AS right_only",
        "CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long",
        "list_distinct(string_split(a || b, '')) AS letters",
    ]
    out.append(f"{name}_1 AS (SELECT *, {', '.join(extra)} FROM {name}_0)")
    more = [
        "array_to_string(common, ' ') AS base, array_to_string(list_concat(common, left_only), ' ') AS ta, array_to_string(list_concat(common, right_only), ' ') AS tb",
        f"{_hits('short', 'long')} AS hits, {_hits('long', 'short')} AS back",
    ]
    coded = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr(CAST(32 + list_position(letters, c) AS INTEGER))), '')"
    out.append(f"{name}_2 AS (SELECT *, {', '.join(more)} FROM {name}_1)")
    known = {
        "ratio": ratio("a", "b"),
        "token_sort": ratio("sa", "sb"),
        "token_set": f"""CASE WHEN len(common) + len(left_only) = 0 OR len(common) + len(right_only) = 0 THEN 0.0 WHEN len(common) > 0 AND (len(left_only) = 0 OR len(right_only) = 0) THEN 100.0
            ELSE greatest({ratio('ta', 'tb')}, CASE WHEN base = '' THEN 0.0 ELSE 200.0 * length(base) / (length(base) + least(length(ta), length(tb))) END) END::DOUBLE""",
        "partial": f"CASE WHEN short = '' THEN CASE WHEN long = '' THEN 100.0 ELSE 0.0 END WHEN length(a) = length(b) THEN greatest({_windows('short', 'long', 'hits')}, {_windows('long', 'short', 'back')}) ELSE {_windows('short', 'long', 'hits')} END",
        # The library function compares bytes, so letters are numbered first.
        "jaro_winkler": f"100.0 * jaro_winkler_similarity({coded.format('a')}, {coded.format('b')})",
    }
    columns += [f"{known[s]} AS {s}" for s in wanted]
    out.append(f"{name} AS (SELECT {', '.join(columns)} FROM {name}_2)")
    return ",\n".join(out)
