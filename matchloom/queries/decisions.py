"""Queries over scored pairs: cuts, list context, policies, metrics, features and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import decisions as D
from ..operators import features as X
from ..operators import lists as L
from ..operators import models
from ..operators import sampling
from ..session import materialise
from ..sources.records import match_lists as build_lists
from .base import (
    NAME_TOKENS,
    PAIRS_SQL,
    R_SQL,
    SCORED_SQL,
    catalogue_pairs,
    catalogue_records,
    entities,
    filter_list,
    gold,
    linkage_records,
    lowered,
    query,
    scored_pairs,
    table,
)
from .fuzzy_sql import scores

F05_SQL = "CASE WHEN truth_len = 0 THEN CASE WHEN {k} = 0 THEN 1.0 ELSE 0.0 END WHEN {tp} > 0 THEN 1.25 * {tp} / ({k} + 0.25 * truth_len) ELSE 0.0 END"
_PRED = "pred AS (SELECT * FROM scored WHERE score >= 0.5)"
_ENT = """per AS (
  SELECT ent.s1_id, truth_len, CAST(count(pred.t_id) AS BIGINT) AS k, CAST(coalesce(sum(pred.label), 0) AS BIGINT) AS tp FROM ent LEFT JOIN pred USING (s1_id) GROUP BY ALL
), scored_ent AS (SELECT *, """ + F05_SQL.format(k="k", tp="tp") + """ AS f05 FROM per)"""


def _predicted(r):
    return scored_pairs(r).where("score >= 0.5")


@query("topk_cut", f"WITH {SCORED_SQL} SELECT s1_id, t_id, score, label FROM scored QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) <= 5")
def topk_cut(spark, sf_dir):
    return L.keep_top(scored_pairs(linkage_records(spark, sf_dir)), "score", 5)


@query(
    "cascade_cut",
    f"""WITH {SCORED_SQL}, x AS (SELECT least(filter_rank, 10) AS r, count(*) AS n FROM listed WHERE label = 1 GROUP BY 1), y AS (SELECT r, sum(n) OVER (ORDER BY r) / sum(n) OVER () AS kept FROM x)
    SELECT CAST(least(coalesce(min(CASE WHEN kept >= 0.998 AND r < 10 THEN r + 1 END), 10), 10) AS INTEGER) AS n_keep FROM y""",
)
def cascade_cut(spark, sf_dir):
    return L.choose_cut(scored_pairs(linkage_records(spark, sf_dir)), "score")


@query(
    "budgeted_k",
    f"""WITH {SCORED_SQL}, x AS (SELECT filter_rank AS r, sum(count(*)) OVER (ORDER BY filter_rank) AS total FROM listed GROUP BY 1) SELECT CAST(coalesce(max(CASE WHEN total <= 3000 THEN r + 1 END), 0) AS INTEGER) AS k FROM x""",
)
def budgeted_k(spark, sf_dir):
    return L.budgeted_k(scored_pairs(linkage_records(spark, sf_dir)), "score", 3000)


@query(
    "list_features",
    f"""WITH {SCORED_SQL} SELECT s1_id, t_id, filter_score, label, filter_rank, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY filter_score DESC, filter_rank, t_id) - 1 AS INTEGER) AS logit_rank,
    round(filter_score - max(filter_score) OVER (PARTITION BY s1_id), 6) AS logit_gap, CAST(sum(CASE WHEN filter_score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY s1_id) AS BIGINT) AS n_p05 FROM listed""",
)
def list_features(spark, sf_dir):
    return L.list_features(filter_list(linkage_records(spark, sf_dir)), "filter_score", "filter_score").withColumn("logit_gap", F.round("logit_gap", 6))


@query(
    "joined_score_features",
    f"""WITH {SCORED_SQL}, j AS (SELECT s1_id, t_id, CASE WHEN filter_rank < 3 THEN filter_score END AS other FROM listed)
    SELECT s1_id, t_id, other, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY other DESC NULLS LAST, t_id) - 1 AS INTEGER) AS other_rank, round(max(other) OVER (PARTITION BY s1_id) - other, 6) AS other_gap FROM j""",
)
def joined_score_features(spark, sf_dir):
    rows = filter_list(linkage_records(spark, sf_dir))
    scores = rows.select("s1_id", "t_id", F.col("filter_score").alias("other"), "filter_rank")
    joined = L.join_scores(rows.select("s1_id", "t_id"), scores, "other", below_rank=3)
    return L.joined_features(joined, "other", "other").withColumn("other_gap", F.round("other_gap", 6))


@query(
    "list_aggregates",
    f"""WITH {SCORED_SQL}, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER p AS n, sum(score) OVER p AS total, max(score) OVER p AS first,
      nth_value(score, 2) OVER (PARTITION BY s1_id ORDER BY score DESC, t_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
      sum((score >= 0.5)::INT) OVER p AS a, sum((score >= 0.9)::INT) OVER p AS b FROM scored WINDOW p AS (PARTITION BY s1_id), w AS (PARTITION BY s1_id ORDER BY score DESC, t_id))
    SELECT s1_id, t_id, score, CAST(rn - 1 AS INTEGER) AS q_rank, round(first - score, 6) AS q_gap, CASE WHEN rn = 1 THEN second ELSE first END AS best_other, round(total, 6) AS q_sum, CAST(a AS BIGINT) AS n_05, CAST(b AS BIGINT) AS n_09,
    round(CASE WHEN n > 1 THEN (total - score) / (n - 1) END, 6) AS mean_other FROM n""",
)
def list_aggregates(spark, sf_dir):
    rows = L.list_aggregates(scored_pairs(linkage_records(spark, sf_dir)).drop("label"), "score")
    return rows.withColumns({c: F.round(c, 6) for c in ("q_gap", "q_sum", "mean_other")})


@query(
    "listwise_features",
    f"""WITH {SCORED_SQL}, s AS (
      SELECT s1_id, count(*) AS cnt, min(score) AS s_min, max(score) AS s_max, avg(score) AS s_mean, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.75) AS q75, stddev_pop(score) AS s_std,
      list_reverse_sort(list(score)) AS every FROM scored GROUP BY s1_id),
    e AS (SELECT s.*, list_sum(list_transform(every, lambda v: exp(v - s_max))) AS z FROM s)
    SELECT s1_id, t_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) - 1 AS INTEGER) AS s_rank, cnt, s_min, s_max, round(s_mean, 6) AS s_mean, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, round(s_std, 4) AS s_std,
    round((score - median) / nullif(q75 - q25, 0), 4) AS robust_z, round(every[2] - score, 6) AS gap2, CAST(len(list_filter(every, lambda v: v >= s_max - 0.5)) AS INTEGER) AS within1, round(exp(score - s_max) / z, 6) AS softmax,
    round(-list_sum(list_transform(every, lambda v: exp(v - s_max) / z * (v - s_max - ln(z)))), 6) AS entropy FROM scored JOIN e USING (s1_id)""",
)
def listwise_features(spark, sf_dir):
    rows = L.listwise(scored_pairs(linkage_records(spark, sf_dir)), "score")
    rounded = {c: F.round(c, 6) for c in ("s_mean", "median", "q25", "q75", "gap2", "softmax", "entropy")} | {c: F.round(c, 4) for c in ("robust_z", "s_std")}
    return rows.withColumns(rounded).select("s1_id", "t_id", "s_rank", "cnt", "s_min", "s_max", "s_mean", "median", "q25", "q75", "s_std", "robust_z", "gap2", "within1", "softmax", "entropy")


@query(
    "rank_differences",
    f"""WITH {SCORED_SQL}, o AS (SELECT s1_id, t_id, filter_score AS a, CASE WHEN filter_rank % 2 = 0 THEN 1.0 - filter_score END AS b FROM listed),
    k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY a DESC, t_id) AS ra, row_number() OVER (PARTITION BY s1_id ORDER BY b DESC NULLS LAST, t_id) AS rb FROM o)
    SELECT s1_id, t_id, CASE WHEN b IS NOT NULL THEN CAST(abs(ra - rb) AS INTEGER) END AS rankdiff_a_b FROM k""",
)
def rank_differences(spark, sf_dir):
    rows = filter_list(linkage_records(spark, sf_dir))
    two = rows.select("s1_id", "t_id", F.col("filter_score").alias("a"), F.when(F.col("filter_rank") % 2 == 0, 1.0 - F.col("filter_score")).alias("b"))
    return L.rank_differences(two, ["a", "b"]).select("s1_id", "t_id", "rankdiff_a_b")


@query(
    "filter_context",
    f"""WITH {SCORED_SQL}, w AS (SELECT entity_id, list_distinct(list_filter(string_split(name, ' '), lambda x: length(x) >= 2)) AS t FROM r),
    x AS (SELECT l.*, count(*) OVER p AS n, max(filter_score) OVER p AS best, w.t, first_value(w.t) OVER (PARTITION BY l.s1_id ORDER BY filter_score DESC, l.t_id) AS top FROM listed l JOIN w ON w.entity_id = l.t_id WINDOW p AS (PARTITION BY l.s1_id))
    SELECT s1_id, t_id, round(filter_rank / n::DOUBLE, 6) AS filter_rank_frac, round(best - filter_score, 6) AS filter_gap_to_top, round(filter_score / nullif(best, 0), 6) AS filter_score_frac, n AS list_size,
    CAST(sum(CASE WHEN t_id LIKE 'S3-%' THEN 1 ELSE 0 END) OVER (PARTITION BY s1_id) AS BIGINT) AS list_n_s3, round(len(list_intersect(t, top))::DOUBLE / nullif(len(t), 0), 6) AS top1_name_overlap FROM x""",
)
def filter_context(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    tokens = r.select(F.col("entity_id").alias("t_id"), T.name_tokens(F.col("name")).alias("t_name_tokens"), T.record_digits(F.col("address")).alias("t_digits"))
    rows = L.filter_context(filter_list(r).join(tokens, "t_id"))
    rounded = {c: F.round(c, 6) for c in ("filter_rank_frac", "filter_gap_to_top", "filter_score_frac", "top1_name_overlap")}
    return rows.withColumns(rounded).select("s1_id", "t_id", "filter_rank_frac", "filter_gap_to_top", "filter_score_frac", "list_size", "list_n_s3", "top1_name_overlap")


@query(
    "number_patterns",
    f"""WITH {SCORED_SQL}, n AS (SELECT entity_id, list_distinct(regexp_extract_all(coalesce(text, ''), '\\p{{Nd}}+')) AS raw, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\p{{Nd}}+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)) AS c FROM r),
    p AS (SELECT s.s1_id, s.t_id, a.raw AS ra, b.raw AS rb, a.c AS ca, b.c AS cb, len(a.raw) + len(b.raw) > 0 AS has_any FROM scored s JOIN n a ON a.entity_id = s.s1_id JOIN n b ON b.entity_id = s.t_id),
    f AS (SELECT *, list_sort(ra) = list_sort(rb) AS raw_eq, list_sort(ca) = list_sort(cb) AS eq, len(cb) > 0 AND len(list_intersect(ca, cb)) = len(cb) AND len(ca) > len(cb) AS sub,
      len(list_filter(list_filter(ca, lambda x: NOT list_contains(cb, x)), lambda x: len(list_filter(list_filter(cb, lambda y: NOT list_contains(ca, y)), lambda y: levenshtein(x, y) = 1)) > 0)) > 0 AS edit FROM p)
    SELECT s1_id, t_id, has_any AND raw_eq AS digits_equal, has_any AND NOT raw_eq AND eq AS digits_equal_after_leading_zero_strip, sub AS digits_target_subset, edit AS digits_one_edit_typo, has_any AND NOT eq AND NOT sub AND NOT edit AS digits_other_mismatch FROM f""",
)
def number_patterns(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return X.number_patterns(scored_pairs(r).select("s1_id", "t_id"), X.number_store(r, "text"))


@query(
    "siblings",
    f"""WITH {SCORED_SQL}, x AS (SELECT s1_id, t_id, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) AS n FROM scored),
    o AS (SELECT a.s1_id, a.t_id, b.t_id AS o, row_number() OVER (PARTITION BY a.s1_id, a.t_id ORDER BY b.n) AS m FROM x a JOIN x b ON a.s1_id = b.s1_id AND a.t_id <> b.t_id)
    SELECT x.s1_id, x.t_id, coalesce((SELECT string_agg(o.o, ',' ORDER BY m) FROM o WHERE o.s1_id = x.s1_id AND o.t_id = x.t_id AND m <= 3), '') AS siblings FROM x""",
)
def siblings(spark, sf_dir):
    rows = L.siblings(scored_pairs(linkage_records(spark, sf_dir)), "score")
    return rows.withColumn("siblings", F.array_join("siblings", ","))


@query(
    "corpus_context",
    f"""WITH {SCORED_SQL}, p AS (SELECT s.s1_id, s.t_id, a.country AS c1, a.name AS n1, a.address AS a1, b.country AS c2, b.name AS n2, b.address AS a2 FROM scored s JOIN q a ON a.entity_id = s.s1_id JOIN g b ON b.entity_id = s.t_id),
    qn AS (SELECT country, name, count(*) AS n FROM q WHERE name <> '' GROUP BY ALL), qa AS (SELECT country, address, count(*) AS n FROM q WHERE address <> '' GROUP BY ALL),
    gn AS (SELECT country, name, count(*) AS n FROM g WHERE name <> '' GROUP BY ALL), ga AS (SELECT country, address, count(*) AS n FROM g WHERE address <> '' GROUP BY ALL)
    SELECT s1_id, t_id, coalesce(x1.n, 0) AS s1_same_name, coalesce(x2.n, 0) AS s1_same_addr, coalesce(x3.n, 0) AS tg_same_name, coalesce(x4.n, 0) AS tg_same_addr, coalesce(x5.n, 0) AS s1_same_tname,
    CAST(a2 = '' AS INTEGER) AS t_addr_empty, CAST(a1 = '' AS INTEGER) AS s1_addr_empty, CAST(c1 = c2 AND n1 <> '' AND n1 = n2 AS INTEGER) AS name_eq, CAST(c1 = c2 AND a1 <> '' AND a1 = a2 AS INTEGER) AS addr_eq,
    CASE WHEN n2 = '' THEN 0 ELSE count(*) OVER (PARTITION BY s1_id, c2, n2) END AS list_same_tname
    FROM p LEFT JOIN qn x1 ON x1.country = c1 AND x1.name = n1 LEFT JOIN qa x2 ON x2.country = c1 AND x2.address = a1 LEFT JOIN gn x3 ON x3.country = c2 AND x3.name = n2 LEFT JOIN ga x4 ON x4.country = c2 AND x4.address = a2
    LEFT JOIN qn x5 ON x5.country = c2 AND x5.name = n2""",
)
def corpus_context(spark, sf_dir):
    # Addresses and texts are only compared here: digests stand for them, written once instead of derived from the texts in every branch.
    r = linkage_records(spark, sf_dir)
    r = materialise(r.withColumns({c: F.when(F.col(c) == "", "").otherwise(F.md5(F.col(c).cast("binary"))) for c in ("address", "text")}), "records")
    return X.corpus_context(scored_pairs(r).select("s1_id", "t_id"), r.where("source = 1"), r.where("source > 1"))


def _first(tokens: str, n: int) -> str:
    """The first ``n`` distinct entries of a list expression, in order."""
    return f"list_filter({tokens}, lambda x, i: list_position({tokens}, x) = i)[1:{n}]"


_NUMBERS = r"list_transform(regexp_extract_all(address, '\p{Nd}+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)"
_ADDRESS_WORDS = r"list_filter(string_split(address, ' '), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '\p{Nd}+'))"
def _store(records: str) -> str:
    """CTEs of the token store: four numbers, eight name tokens, ten address tokens."""
    return f"""w0 AS (SELECT entity_id, source, name, address, {_NUMBERS} AS d0, {NAME_TOKENS} AS n0, {_ADDRESS_WORDS} AS a0 FROM {records}),
store AS (SELECT entity_id, source, name, address, {_first('d0', 4)} AS d, {_first('n0', 8)} AS n, {_first('a0', 10)} AS a, regexp_matches(name || address, '[^\\x00-\\x7F]') AS foreign_text FROM w0)"""


def _idf(column: str, name: str) -> str:
    """CTEs of the query side's idf shares of a token column of the store."""
    return f"""{name}_df AS (SELECT token, count(*) AS df FROM (SELECT unnest({column}) AS token FROM store WHERE source > 1) GROUP BY 1), {name}_c AS (SELECT count(*) AS n FROM store WHERE source > 1),
    {name}_w AS (SELECT entity_id, token, CASE WHEN df IS NULL THEN ln(c.n + 1) + 1 ELSE ln((c.n + 1.0) / (df + 1.0)) + 1 END AS idf FROM (SELECT entity_id, unnest({column}) AS token FROM store) LEFT JOIN {name}_df USING (token), {name}_c c),
    {name}_share AS (SELECT s.s1_id, s.t_id, sum(CASE WHEN list_contains(b.{column}, w.token) THEN idf ELSE 0 END) / sum(idf) AS share FROM scored s JOIN {name}_w w ON w.entity_id = s.s1_id JOIN store b ON b.entity_id = s.t_id GROUP BY ALL)"""


CHEAP_SQL = f"""{_store('r')}, {_idf('n', 'ni')}, {_idf('a', 'ai')},
cheap AS (
  SELECT s.s1_id, s.t_id, CAST(b.source = 3 AS INTEGER) AS is_s3, CAST(len(list_intersect(a.d, b.d)) AS INTEGER) AS digits_overlap, CAST(len(a.d) AS INTEGER) AS digits_s1_n, CAST(len(b.d) AS INTEGER) AS digits_tgt_n,
    round(len(list_intersect(a.d, b.d))::DOUBLE / nullif(len(a.d) + len(b.d) - len(list_intersect(a.d, b.d)), 0), 6) AS digits_jaccard,
    CAST(len(a.d) > 0 AND len(list_intersect(a.d, b.d)) = len(a.d) AS INTEGER) AS digits_all_s1_in_tgt, CAST(len(a.d) > 0 AND len(b.d) > 0 AND a.d[1] = b.d[1] AS INTEGER) AS house_match,
    CAST(len(list_intersect(a.n, b.n)) AS INTEGER) AS name_overlap, round(len(list_intersect(a.n, b.n))::DOUBLE / nullif(len(a.n), 0), 6) AS name_overlap_frac, round(x.share, 6) AS name_idf_frac,
    CAST(len(list_intersect(a.a, b.a)) AS INTEGER) AS addr_overlap, round(len(list_intersect(a.a, b.a))::DOUBLE / nullif(len(a.a), 0), 6) AS addr_overlap_frac, round(y.share, 6) AS addr_idf_frac,
    round(least(length(a.name), length(b.name))::DOUBLE / nullif(greatest(length(a.name), length(b.name)), 0), 6) AS name_len_ratio, round(least(length(a.address), length(b.address))::DOUBLE / nullif(greatest(length(a.address), length(b.address)), 0), 6) AS addr_len_ratio,
    CAST(b.address = '' AS INTEGER) AS tgt_addr_missing, CAST(b.name = '' AS INTEGER) AS tgt_name_missing, CAST(b.foreign_text AS INTEGER) AS tgt_non_ascii
  FROM scored s JOIN store a ON a.entity_id = s.s1_id JOIN store b ON b.entity_id = s.t_id LEFT JOIN ni_share x ON x.s1_id = s.s1_id AND x.t_id = s.t_id LEFT JOIN ai_share y ON y.s1_id = s.s1_id AND y.t_id = s.t_id
)"""


@query("token_overlap", f"WITH {SCORED_SQL}, {CHEAP_SQL} SELECT * FROM cheap")
def token_overlap(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    rows = X.cheap_features(scored_pairs(r).select("s1_id", "t_id"), X.token_store(r))
    return rows.withColumns({c: F.round(c, 6) for c in ("digits_jaccard", "name_overlap_frac", "name_idf_frac", "addr_overlap_frac", "addr_idf_frac", "name_len_ratio", "addr_len_ratio")})


@query(
    "idf_overlap",
    f"""WITH {SCORED_SQL}, n AS (SELECT entity_id, source, list_distinct(list_filter(string_split(name, ' '), lambda x: length(x) >= 2)) AS t FROM r),
    c AS (SELECT count(*) AS n FROM g), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(t) AS token FROM n WHERE source > 1) GROUP BY 1),
    w AS (SELECT entity_id, token, CASE WHEN df IS NULL THEN ln(c.n + 1) + 1 ELSE ln((c.n + 1.0) / (df + 1.0)) + 1 END AS idf FROM (SELECT entity_id, unnest(t) AS token FROM n) LEFT JOIN df USING (token), c)
    SELECT s.s1_id, s.t_id, round(sum(CASE WHEN list_contains(b.t, w.token) THEN idf ELSE 0 END) / sum(idf), 6) AS name_idf_frac FROM scored s JOIN w ON w.entity_id = s.s1_id JOIN n b ON b.entity_id = s.t_id GROUP BY ALL""",
)
def idf_overlap(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    rows = X.cheap_features(scored_pairs(r).select("s1_id", "t_id"), X.token_store(r))
    return rows.select("s1_id", "t_id", F.round("name_idf_frac", 6).alias("name_idf_frac"))


# crc32 of a digit run, bit by bit, for runs over twelve digits.
_CRC = (
    "xor(list_reduce(list_transform(string_split(x, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda u, c: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(u, c)), 4294967295::BIGINT), 4294967295::BIGINT)"
)


def _whole_text(r):
    """Records whose address is the whole text, where the numbers are."""
    return r.withColumn("address", F.coalesce("text", F.lit("")))


@query(
    "number_agreement",
    f"""WITH {SCORED_SQL}, d AS (SELECT entity_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\p{{Nd}}+'), lambda x: CASE WHEN length(x) <= 12 THEN CAST(x AS BIGINT) ELSE {_CRC} END) AS raw FROM r),
    o AS (SELECT entity_id, list_filter(raw, lambda x, i: list_position(raw, x) = i)[1:4] AS n FROM d)
    SELECT s.s1_id, s.t_id, CASE WHEN len(a.n) > 0 AND len(b.n) > 0 THEN CAST(a.n[1] = b.n[1] AS INTEGER) END AS num_first_eq, CASE WHEN len(a.n) > 0 AND len(b.n) > 0 THEN CAST(len(list_intersect(a.n, b.n)) AS INTEGER) END AS num_shared,
    round(len(list_intersect(a.n, b.n))::DOUBLE / nullif(len(a.n) + len(b.n) - len(list_intersect(a.n, b.n)), 0), 6) AS num_jaccard, CASE WHEN len(b.n) > 0 THEN CAST(len(b.n) - len(list_intersect(a.n, b.n)) AS INTEGER) END AS num_t_only
    FROM scored s JOIN o a ON a.entity_id = s.s1_id JOIN o b ON b.entity_id = s.t_id""",
)
def number_agreement(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    rows = X.number_features(scored_pairs(r).select("s1_id", "t_id"), _whole_text(r))
    return rows.select("s1_id", "t_id", "num_first_eq", "num_shared", F.round("num_jaccard", 6).alias("num_jaccard"), "num_t_only")


@query(
    "digit_typo",
    f"""WITH {SCORED_SQL}, o AS (SELECT entity_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\p{{Nd}}+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)) AS n FROM r)
    SELECT s.s1_id, s.t_id, len(list_filter(list_filter(a.n, lambda x: NOT list_contains(b.n, x)), lambda x: len(list_filter(list_filter(b.n, lambda y: NOT list_contains(a.n, y)), lambda y: length(x) = length(y) AND levenshtein(x, y) = 1)) > 0)) > 0 AS typo
    FROM scored s JOIN o a ON a.entity_id = s.s1_id JOIN o b ON b.entity_id = s.t_id""",
)
def digit_typo(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    store = r.select("entity_id", T.record_digits(F.col("text"), 1 << 30).alias("n"))
    return X.sides(scored_pairs(r).select("s1_id", "t_id"), store, ["n"]).select("s1_id", "t_id", S.one_digit_typo(F.col("s_n"), F.col("t_n")).alias("typo"))


@query(
    "colocated_context",
    f"""WITH {SCORED_SQL}, x AS (SELECT s.s1_id, s.t_id, s.score, split_part(g.name, ' ', 1) AS key FROM scored s JOIN g ON g.entity_id = s.t_id),
    y AS (SELECT *, count(*) OVER (PARTITION BY s1_id, key) - 1 AS same_key, row_number() OVER (PARTITION BY s1_id, key ORDER BY score DESC, t_id) AS rn,
      nth_value(score, 2) OVER (PARTITION BY s1_id, key ORDER BY score DESC, t_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, max(score) OVER (PARTITION BY s1_id, key) AS first FROM x)
    SELECT s1_id, t_id, score, CASE WHEN key <> '' THEN same_key END AS same_key, CASE WHEN key <> '' THEN CAST(rn - 1 AS INTEGER) END AS same_key_rank, CASE WHEN key <> '' THEN CASE WHEN rn = 1 THEN second ELSE first END END AS same_key_best_other FROM y""",
)
def colocated_context(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    keyed = scored_pairs(r).join(r.select(F.col("entity_id").alias("t_id"), F.nullif(F.split_part("name", F.lit(" "), F.lit(1)), F.lit("")).alias("key")), "t_id")
    rows = L.shared_space(keyed, "score", F.col("key"))
    return rows.select("s1_id", "t_id", "score", "same_key", "same_key_rank", "same_key_best_other")


_NAME_PAIRS = "SELECT a.name AS a, b.name AS b FROM scored s JOIN r a ON a.entity_id = s.s1_id JOIN r b ON b.entity_id = s.t_id"
_SIDES = "FROM scored s JOIN {0} a ON a.entity_id = s.s1_id JOIN {0} b ON b.entity_id = s.t_id"


def _shown(name: str, scorers: str, prefix: str, missing: str, scale: str = "") -> str:
    """Score columns of a CTE of ``fuzzy_sql.scores``, null where a side is missing."""
    return ", ".join(f"CASE WHEN {missing} THEN NULL ELSE round({name}.{s}{scale}, 6) END AS {prefix}{s}" for s in scorers.split())


_SCORERS = "ratio token_sort token_set partial jaro_winkler"


@query("jaro_winkler_pairs", f"WITH {SCORED_SQL}, {scores('f', _NAME_PAIRS, 'jaro_winkler')} SELECT s.s1_id, s.t_id, CASE WHEN a.name = '' OR b.name = '' THEN NULL ELSE round(f.jaro_winkler / 100, 6) END AS jw {_SIDES.format('r')} JOIN f ON f.a = a.name AND f.b = b.name")
def jaro_winkler_pairs(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    p = X.sides(scored_pairs(r).select("s1_id", "t_id"), r, ["name"])
    return p.select("s1_id", "t_id", F.round(S.similarity("jaro_winkler", F.col("s_name"), F.col("t_name")) / 100, 6).alias("jw"))


@query(
    "name_similarity_pairs",
    f"""WITH {SCORED_SQL}, {scores('f', _NAME_PAIRS, _SCORERS)} SELECT s.s1_id, s.t_id, {_shown('f', _SCORERS, '', "a.name = '' OR b.name = ''")} {_SIDES.format('r')} JOIN f ON f.a = a.name AND f.b = b.name""",
)
def name_similarity_pairs(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    p = X.sides(scored_pairs(r).select("s1_id", "t_id"), r, ["name"])
    p = p.withColumn("sim", S.similarities(list(S.SCORERS), F.col("s_name"), F.col("t_name")))
    return p.select("s1_id", "t_id", *[F.round(c, 6).alias(n) for n, c in S.scored("", "sim", list(S.SCORERS)).items()])


def _catalogue(spark, sf_dir, low=True):
    """Catalogue records (lower-cased words, or as written) and their candidate pairs."""
    raw = materialise(catalogue_records(spark, sf_dir), "catalogue")
    return (lowered(raw) if low else raw), catalogue_pairs(raw)


_PART_PAIRS = "SELECT a.{0} AS a, b.{0} AS b " + _SIDES.format("low")


@query(
    "edit_similarity_pairs",
    f"""WITH {PAIRS_SQL}, {scores('fn', _PART_PAIRS.format('name'), _SCORERS)}, {scores('fa', _PART_PAIRS.format('address'), _SCORERS)}
    SELECT s.s1_id, s.t_id, {_shown('fn', _SCORERS, 'name_', "a.name = '' OR b.name = ''", ' * 0.01')}, {_shown('fa', _SCORERS, 'address_', "a.address = '' OR b.address = ''", ' * 0.01')}
    {_SIDES.format('low')} JOIN fn ON fn.a = a.name AND fn.b = b.name JOIN fa ON fa.a = a.address AND fa.b = b.address""",
)
def edit_similarity_pairs(spark, sf_dir):
    r, pairs = _catalogue(spark, sf_dir)
    rows = X.fuzzy_features(pairs.select("s1_id", "t_id"), r)
    return rows.select("s1_id", "t_id", *[F.round(c, 6).alias(c) for c in rows.columns if c not in ("s1_id", "t_id")])


@query(
    "street_similarity",
    f"""WITH {PAIRS_SQL}, st AS (SELECT entity_id, trim(regexp_replace(regexp_replace(address, '\\p{{Nd}}+', ' ', 'g'), ' +', ' ', 'g')) AS street FROM low),
    {scores('f', 'SELECT a.street AS a, b.street AS b ' + _SIDES.format('st'), 'token_set token_sort partial')}
    SELECT s.s1_id, s.t_id, round(f.token_set, 6) AS addr_tset, round(f.token_sort, 6) AS addr_tsort, round(f.partial, 6) AS addr_partial {_SIDES.format('st')} LEFT JOIN f ON f.a = a.street AND f.b = b.street AND a.street <> '' AND b.street <> ''""",
)
def street_similarity(spark, sf_dir):
    r, pairs = _catalogue(spark, sf_dir, low=False)
    rows = X.address_features(pairs, r)
    return rows.select("s1_id", "t_id", *[F.round(c, 6).alias(c) for c in ("addr_tset", "addr_tsort", "addr_partial")])


_SIBLINGS = """place AS (SELECT s1_id, t_id, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) AS n FROM scored),
sib AS (SELECT * FROM (SELECT x.s1_id, x.t_id, y.t_id AS o, row_number() OVER (PARTITION BY x.s1_id, x.t_id ORDER BY y.n) AS m FROM place x JOIN place y ON x.s1_id = y.s1_id AND x.t_id <> y.t_id) WHERE m <= 3)"""


@query(
    "sibling_consensus",
    f"""WITH {SCORED_SQL}, {_SIBLINGS}, {scores('f', _NAME_PAIRS + ' UNION SELECT x.name, y.name FROM sib JOIN r x ON x.entity_id = sib.t_id JOIN r y ON y.entity_id = sib.o', 'token_set')},
    k AS (SELECT sib.s1_id, sib.t_id, max(f.token_set) AS most, avg(f.token_set) AS mean FROM sib JOIN r x ON x.entity_id = sib.t_id JOIN r y ON y.entity_id = sib.o JOIN f ON f.a = x.name AND f.b = y.name AND x.name <> '' AND y.name <> '' GROUP BY ALL)
    SELECT s.s1_id, s.t_id, round(f.token_set, 6) AS name_sim_s1, round(k.most, 6) AS sib_max_sim, round(k.mean, 6) AS sib_mean_sim {_SIDES.format('r')} LEFT JOIN f ON f.a = a.name AND f.b = b.name AND a.name <> '' AND b.name <> '' LEFT JOIN k ON k.s1_id = s.s1_id AND k.t_id = s.t_id""",
)
def sibling_consensus(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    rows = X.sibling_features(scored_pairs(r), r, "score")
    return rows.select("s1_id", "t_id", *[F.round(c, 6).alias(c) for c in ("name_sim_s1", "sib_max_sim", "sib_mean_sim")])


_ABBREVIATED = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ABBREVIATIONS.items()) + " ELSE w END"
_NOISE = ", ".join(f"'{w}'" for w in T.STREET_NOISE)


@query(
    "raw_quirks",
    f"""WITH {PAIRS_SQL}, {_SIBLINGS}, st AS (SELECT entity_id, name, address, CAST(coalesce(nullif(regexp_extract(address, '\\p{{Nd}}+'), ''), '-1') AS BIGINT) AS number,
      array_to_string(list_filter(list_transform(regexp_extract_all(lower(address), '\\p{{L}}+'), lambda w: {_ABBREVIATED}), lambda w: w NOT IN ({_NOISE})), ' ') AS street FROM r),
    {scores('fn', 'SELECT a.name AS a, b.name AS b ' + _SIDES.format('st') + ' UNION SELECT x.name, y.name FROM sib JOIN st x ON x.entity_id = sib.t_id JOIN st y ON y.entity_id = sib.o', 'ratio')},
    {scores('fa', 'SELECT a.address AS a, b.address AS b ' + _SIDES.format('st'), 'ratio')},
    {scores('fs', 'SELECT a.street AS a, b.street AS b ' + _SIDES.format('st') + ' UNION SELECT x.street, y.street FROM sib JOIN st x ON x.entity_id = sib.t_id JOIN st y ON y.entity_id = sib.o', 'token_sort token_set')},
    k AS (SELECT sib.s1_id, sib.t_id, max(fn.ratio) AS most, sum((x.name = y.name)::INT) AS eq, max(fs.token_set) AS street_max, avg(fs.token_set) AS street_mean, avg((x.number = y.number)::INT) FILTER (x.number >= 0 AND y.number >= 0) AS agree
      FROM sib JOIN st x ON x.entity_id = sib.t_id JOIN st y ON y.entity_id = sib.o JOIN fn ON fn.a = x.name AND fn.b = y.name LEFT JOIN fs ON fs.a = x.street AND fs.b = y.street AND x.address <> '' AND y.address <> '' GROUP BY ALL)
    SELECT s.s1_id, s.t_id, round(fn.ratio, 6) AS raw_name_ratio_s1, CAST(a.name = b.name AS INTEGER) AS raw_name_eq_s1, round(fa.ratio, 6) AS addr_raw_ratio_s1, round(fs.token_sort, 6) AS street_sim_s1_exp, round(k.most, 6) AS raw_name_ratio_sib_max,
      CAST(coalesce(k.eq, 0) AS BIGINT) AS raw_name_eq_sib, round(k.street_max, 6) AS street_sim_sib_max, round(k.street_mean, 6) AS street_sim_sib_mean, round(k.agree, 6) AS first_num_agree_sib
    {_SIDES.format('st')} JOIN fn ON fn.a = a.name AND fn.b = b.name LEFT JOIN fa ON fa.a = a.address AND fa.b = b.address AND a.address <> '' AND b.address <> ''
    LEFT JOIN fs ON fs.a = a.street AND fs.b = b.street AND a.address <> '' AND b.address <> '' LEFT JOIN k ON k.s1_id = s.s1_id AND k.t_id = s.t_id""",
)
def raw_quirks(spark, sf_dir):
    r, pairs = _catalogue(spark, sf_dir, low=False)
    rows = X.raw_features(pairs, r, "score")
    whole = ("s1_id", "t_id", "raw_name_eq_s1", "raw_name_eq_sib")
    return rows.select(*whole, *[F.round(c, 6).alias(c) for c in rows.columns if c not in whole])


_MAPPING = {"rd": "road", "economy": "cheap"}
_CANONICAL = "array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: CASE w WHEN 'rd' THEN 'road' WHEN 'economy' THEN 'cheap' ELSE w END), ' ')"
_OTHERS = "list_filter({0}, lambda x: NOT list_contains({1}, x))"
_TYPO = f"len(list_filter({_OTHERS.format('a.d', 'b.d')}, lambda x: len(list_filter({_OTHERS.format('b.d', 'a.d')}, lambda y: length(x) = length(y) AND levenshtein(x, y) = 1)) > 0)) > 0"


@query(
    "canonical_evidence",
    f"""WITH {PAIRS_SQL}, {_store('low')}, c AS (SELECT entity_id, d, {_CANONICAL.format('name')} AS name, {_CANONICAL.format('address')} AS address FROM store),
    {scores('fn', 'SELECT a.name AS a, b.name AS b ' + _SIDES.format('c'), 'token_set')}, {scores('fa', 'SELECT a.address AS a, b.address AS b ' + _SIDES.format('c'), 'token_set ratio')}
    SELECT s.s1_id, s.t_id, CAST({_TYPO} AS INTEGER) AS digit_typo, CASE WHEN len(b.d) > 0 THEN CAST(len({_OTHERS.format('b.d', 'a.d')}) = 0 AS INTEGER) END AS digits_tgt_in_s1,
      CASE WHEN a.name = '' OR b.name = '' THEN NULL ELSE round(fn.token_set * 0.01, 6) END AS canon_name_token_set, CASE WHEN a.address = '' OR b.address = '' THEN NULL ELSE round(fa.token_set * 0.01, 6) END AS canon_addr_token_set, CASE WHEN a.address = '' OR b.address = '' THEN NULL ELSE round(fa.ratio * 0.01, 6) END AS canon_addr_ratio,
      0 AS s_script, 0 AS t_script, 0 AS script_differs {_SIDES.format('c')} JOIN fn ON fn.a = a.name AND fn.b = b.name JOIN fa ON fa.a = a.address AND fa.b = b.address""",
)
def canonical_evidence(spark, sf_dir):
    r, pairs = _catalogue(spark, sf_dir)
    rows = X.canonical_features(pairs.select("s1_id", "t_id"), X.token_store(r), _MAPPING)
    return rows.withColumns({c: F.round(c, 6) for c in ("canon_name_token_set", "canon_addr_token_set", "canon_addr_ratio")})


@query(
    "digit_density",
    f"""WITH {R_SQL}, x AS (SELECT coalesce(text, '') AS address, source FROM r), y AS (SELECT {_NUMBERS} AS d0 FROM x WHERE source > 1), z AS (SELECT list_sort({_first('d0', 4)}) AS n FROM y)
    SELECT array_to_string(n, '|') AS digit_key, round(ln(1 + count(*)), 6) AS log_freq FROM z WHERE len(n) > 0 GROUP BY 1""",
)
def digit_density(spark, sf_dir):
    r = linkage_records(spark, sf_dir).withColumn("digits", T.record_digits(F.coalesce("text", F.lit(""))))
    return X.density(r).withColumn("log_freq", F.round("log_freq", 6))


@query(
    "match_rules",
    f"""WITH {PAIRS_SQL}, {scores('fn', _PART_PAIRS.format('name'), 'token_set')}, {scores('fa', _PART_PAIRS.format('address'), 'token_set')},
    x AS (SELECT s.s1_id, s.t_id, a.name <> '' AND a.name = b.name AS e, a.name <> '' AND regexp_replace(a.name, '(\\S)(?: (?:corp|corporation|pvt|private|ltd|limited)){{1,2}}$', '\\1') = regexp_replace(b.name, '(\\S)(?: (?:corp|corporation|pvt|private|ltd|limited)){{1,2}}$', '\\1') AS f,
      CASE WHEN a.name = '' OR b.name = '' THEN NULL ELSE round(fn.token_set * 0.01, 6) END AS n, CASE WHEN a.address = '' OR b.address = '' THEN NULL ELSE round(fa.token_set * 0.01, 6) END AS d
      {_SIDES.format('low')} JOIN fn ON fn.a = a.name AND fn.b = b.name JOIN fa ON fa.a = a.address AND fa.b = b.address)
    SELECT s1_id, t_id, e AS R1, e AND coalesce(d, 1) >= 0.8 AS R2, f AND coalesce(d, 1) >= 0.8 AS R3, coalesce(n, 0) >= 0.9 AND coalesce(d, 0) >= 0.85 AS R4, (e AND coalesce(d, 1) >= 0.8) OR (coalesce(n, 0) >= 0.9 AND coalesce(d, 0) >= 0.85) AS R5 FROM x""",
)
def match_rules(spark, sf_dir):
    r, pairs = _catalogue(spark, sf_dir)
    p = X.sides(pairs, r, ["name", "address"])
    given = F.col("s_name") != ""
    suffix = given & (T.strip_legal_suffix(F.col("s_name")) == T.strip_legal_suffix(F.col("t_name")))
    p = p.withColumns({c: F.round(S.similarity("token_set", F.col(f"s_{c}"), F.col(f"t_{c}")) / 100, 6) for c in ("name", "address")})
    rules = X.match_rules(given & (F.col("s_name") == F.col("t_name")), suffix, F.col("name"), F.col("address"))
    return p.select("s1_id", "t_id", *[c.alias(name) for name, c in rules.items()])


@query(
    "error_strata",
    f"""WITH {PAIRS_SQL}, {scores('fn', _PART_PAIRS.format('name'), 'token_set')}, {scores('fa', _PART_PAIRS.format('address'), 'token_set')},
    nums AS (SELECT entity_id, array_to_string(regexp_extract_all(address, '\\p{{Nd}}+'), ' ') AS d FROM low),
    x AS (SELECT s.s1_id, s.t_id, x1.d <> '' AND x2.d <> '' AND x1.d = x2.d AND round(fa.token_set * 0.01, 6) >= 0.9 AS same, round(fn.token_set * 0.01, 6) AS n {_SIDES.format('low')} JOIN fn ON fn.a = a.name AND fn.b = b.name JOIN fa ON fa.a = a.address AND fa.b = b.address JOIN nums x1 ON x1.entity_id = s.s1_id JOIN nums x2 ON x2.entity_id = s.t_id)
    SELECT s1_id, t_id, same AS same_address, n >= 0.9 AS strong_name, same AND n >= 0.9 AS same_address_and_strong_name, same AND n < 0.6 AS same_address_weak_name FROM x""",
)
def error_strata(spark, sf_dir):
    r, pairs = _catalogue(spark, sf_dir)
    p = X.pair_features(pairs.select("s1_id", "t_id"), X.token_store(r))
    return p.select("s1_id", "t_id", *[c.alias(n) for n, c in X.strata(F.col("digits_exact"), F.round("addr_token_set", 6), F.round("name_token_set", 6)).items()])


_PAIR_FEATURES = {"name": "ratio token_sort token_set partial jaro_winkler", "address": "ratio token_set partial", "nums": "token_set"}


@query(
    "pair_features",
    f"""WITH {PAIRS_SQL}, x AS (SELECT entity_id, name, address, array_to_string(regexp_extract_all(address, '\\p{{Nd}}+'), ' ') AS nums FROM low),
    pr AS MATERIALIZED (SELECT s.s1_id, s.t_id, a.name AS an, b.name AS bn, a.address AS aa, b.address AS ba, a.nums AS ad, b.nums AS bd {_SIDES.format('x')}),
    {scores('fn', 'SELECT an AS a, bn AS b FROM pr', _PAIR_FEATURES['name'])}, {scores('fa', 'SELECT aa AS a, ba AS b FROM pr', _PAIR_FEATURES['address'])}, {scores('fd', 'SELECT ad AS a, bd AS b FROM pr', _PAIR_FEATURES['nums'])}
    SELECT s1_id, t_id, CAST(an <> '' AND an = bn AS INTEGER) AS name_exact,
      CAST(an <> '' AND regexp_replace(an, '(\\S)(?: (?:corp|corporation|pvt|private|ltd|limited)){{1,2}}$', '\\1') = regexp_replace(bn, '(\\S)(?: (?:corp|corporation|pvt|private|ltd|limited)){{1,2}}$', '\\1') AS INTEGER) AS name_suffix_exact,
      {_shown('fn', _PAIR_FEATURES['name'], 'name_', "an = '' OR bn = ''", ' * 0.01')}, CASE WHEN an <> '' AND bn <> '' THEN round(least(length(an), length(bn))::DOUBLE / greatest(length(an), length(bn)), 6) END AS name_len_ratio,
      CASE WHEN aa <> '' AND ba <> '' THEN CAST(aa = ba AS INTEGER) END AS addr_exact, {_shown('fa', _PAIR_FEATURES['address'], 'addr_', "aa = '' OR ba = ''", ' * 0.01')},
      CASE WHEN ad <> '' AND bd <> '' THEN CAST(ad = bd AS INTEGER) END AS digits_exact, {_shown('fd', _PAIR_FEATURES['nums'], 'digits_', "ad = '' OR bd = ''", ' * 0.01')},
      CAST(ad <> '' AS INTEGER) AS s1_has_digits, CAST(bd <> '' AS INTEGER) AS tgt_has_digits, CAST(aa = '' AS INTEGER) AS s1_addr_missing, CAST(ba = '' AS INTEGER) AS tgt_addr_missing, CAST(bn = '' AS INTEGER) AS tgt_name_missing,
      CAST(regexp_matches(an || aa || bn || ba, '[^\\x00-\\x7F]') AS INTEGER) AS non_ascii_any
    FROM pr JOIN fn ON fn.a = an AND fn.b = bn JOIN fa ON fa.a = aa AND fa.b = ba JOIN fd ON fd.a = ad AND fd.b = bd""",
)
def pair_features(spark, sf_dir):
    r, pairs = _catalogue(spark, sf_dir)
    rows = X.pair_features(pairs.select("s1_id", "t_id"), X.token_store(r))
    kinds = dict(rows.dtypes)
    return rows.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in rows.columns])


@query(
    "hard_negative_sample",
    f"""WITH {SCORED_SQL}, a AS (SELECT *, label = 1 OR row_number() OVER (PARTITION BY s1_id, label ORDER BY filter_rank, t_id) <= 2 AS sure FROM listed),
    b AS (SELECT *, row_number() OVER (PARTITION BY s1_id, sure ORDER BY md5('0:' || s1_id || ':' || t_id), t_id) AS draw, count(*) OVER (PARTITION BY s1_id, sure) AS left_n FROM a)
    SELECT s1_id, t_id, label, filter_rank, CASE WHEN sure THEN 1.0 ELSE left_n::DOUBLE / least(left_n, 3) END AS weight FROM b WHERE sure OR draw <= 3""",
)
def hard_negative_sample(spark, sf_dir):
    rows = sampling.hard_negatives(filter_list(linkage_records(spark, sf_dir)), "filter_rank", 2, 3)
    return rows.select("s1_id", "t_id", "label", "filter_rank", "weight")


@query("entity_f05", f"WITH {SCORED_SQL}, {_PRED}, {_ENT} SELECT s1_id, truth_len, k, tp, round(f05, 6) AS f05 FROM scored_ent")
def entity_f05(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return D.entity_f05(entities(r), _predicted(r)).select("s1_id", "truth_len", "k", "tp", F.round("f05", 6).alias("f05"))


@query(
    "macro_report",
    f"""WITH {SCORED_SQL}, {_PRED}, {_ENT} SELECT country, count(*) AS s1, round(avg(f05), 6) AS macro_f05, round(avg(CASE WHEN k > 0 THEN tp::DOUBLE / k END), 6) AS mean_precision, round(avg(CASE WHEN truth_len > 0 THEN tp::DOUBLE / truth_len END), 6) AS mean_recall,
    round(avg(CASE WHEN truth_len = 0 THEN (k = 0)::INT END), 6) AS singleton_accuracy, round(avg((k > 0)::INT), 6) AS predicted_nonempty_rate, CAST(sum(k) AS BIGINT) AS predicted_pairs, CAST(sum(tp) AS BIGINT) AS true_positive_pairs
    FROM scored_ent JOIN q ON q.entity_id = s1_id GROUP BY country""",
)
def macro_report(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    per = D.entity_f05(entities(r), _predicted(r)).join(r.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return D.macro_report(per, "country")


@query(
    "oracle_ceiling",
    f"""WITH {SCORED_SQL}, pred AS (SELECT * FROM scored WHERE label = 1), {_ENT} SELECT round(avg(f05), 6) AS oracle_f05, count(*) AS s1 FROM scored_ent""",
)
def oracle_ceiling(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return D.oracle_f05(entities(r), scored_pairs(r)).agg(F.round(F.avg("f05"), 6).alias("oracle_f05"), F.count("*").alias("s1"))


_CURVE = (
    """thresholds AS (SELECT DISTINCT score AS threshold FROM scored UNION ALL SELECT 2.0),
hit AS (SELECT threshold, s1_id, count(*) AS k, sum(label) AS tp FROM thresholds JOIN scored ON score >= threshold GROUP BY ALL),
curve AS (SELECT threshold, round(avg("""
    + F05_SQL.format(k="coalesce(k, 0)", tp="coalesce(tp, 0)")
    + """), 6) AS macro_f05 FROM thresholds CROSS JOIN ent LEFT JOIN hit USING (threshold, s1_id) GROUP BY threshold)"""
)


@query("threshold_sweep", f"WITH {SCORED_SQL}, {_CURVE} SELECT threshold, macro_f05 FROM curve")
def threshold_sweep(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return D.sweep(entities(r), scored_pairs(r)).withColumn("macro_f05", F.round("macro_f05", 6))


@query("best_threshold", f"WITH {SCORED_SQL}, {_CURVE} SELECT threshold, macro_f05 FROM curve ORDER BY macro_f05 DESC, threshold DESC LIMIT 1")
def best_threshold(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return D.best_threshold(D.sweep(entities(r), scored_pairs(r)).withColumn("macro_f05", F.round("macro_f05", 6)))


_GRID = [(0.3, 0.3), (0.3, 0.6), (0.6, 0.6), (0.9, 0.9)]


@query(
    "grid_sweep",
    f"""WITH {SCORED_SQL}, grid AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _GRID)}) v(t, t_empty)), top AS (SELECT *, max(score) OVER (PARTITION BY s1_id) AS best FROM scored),
    hit AS (SELECT t, t_empty, s1_id, count(*) AS k, sum(label) AS tp FROM grid JOIN top ON score >= t AND best >= t_empty GROUP BY ALL)
    SELECT t, t_empty, round(avg({F05_SQL.format(k="coalesce(k, 0)", tp="coalesce(tp, 0)")}), 6) AS macro_f05 FROM grid CROSS JOIN ent LEFT JOIN hit USING (t, t_empty, s1_id) GROUP BY ALL""",
)
def grid_sweep(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return D.grid_sweep(entities(r), scored_pairs(r), _GRID).withColumn("macro_f05", F.round("macro_f05", 6))


@query("policy_empty_guard", f"WITH {SCORED_SQL} SELECT s1_id, t_id, score, label FROM scored WHERE score >= 0.3 QUALIFY max(score) OVER (PARTITION BY s1_id) >= 0.6")
def policy_empty_guard(spark, sf_dir):
    return D.apply_policy(scored_pairs(linkage_records(spark, sf_dir)), "empty_guard", 0.3, t_empty=0.6)


@query("policy_relative", f"WITH {SCORED_SQL}, m AS (SELECT *, max(score) OVER (PARTITION BY s1_id) AS best FROM scored) SELECT s1_id, t_id, score, label FROM m WHERE score >= 0.3 AND score >= 0.8 * best")
def policy_relative(spark, sf_dir):
    return D.apply_policy(scored_pairs(linkage_records(spark, sf_dir)), "relative", 0.3, r=0.8)


@query("one_owner", f"WITH {SCORED_SQL}, {_PRED} SELECT s1_id, t_id, score, label FROM pred QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY score DESC, s1_id) = 1")
def one_owner(spark, sf_dir):
    return D.one_owner(_predicted(linkage_records(spark, sf_dir)))


@query(
    "owner_stats",
    f"""WITH {SCORED_SQL}, {_PRED}, c AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, s1_id) > 1 AS lost FROM pred)
    SELECT count(*) AS claims, count(DISTINCT CASE WHEN lost THEN t_id END) AS targets_in_conflict, CAST(coalesce(sum(lost::INT), 0) AS BIGINT) AS claims_dropped, CAST(coalesce(sum((lost AND label = 1)::INT), 0) AS BIGINT) AS dropped_true, CAST(coalesce(sum((lost AND label = 0)::INT), 0) AS BIGINT) AS dropped_false FROM c""",
)
def owner_stats(spark, sf_dir):
    return D.owner_stats(_predicted(linkage_records(spark, sf_dir)))


@query(
    "country_rule",
    f"""WITH {SCORED_SQL}, acc AS (SELECT * FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY score DESC, s1_id) = 1),
    x AS (SELECT s.*, q.country, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) AS rn, s1_id IN (SELECT s1_id FROM acc) AS has FROM scored s JOIN q ON q.entity_id = s1_id)
    SELECT s1_id, t_id, score, label, country FROM x WHERE score >= CASE WHEN country = 'fr' THEN CASE WHEN rn = 1 AND NOT has THEN 0.4 ELSE 0.7 END ELSE 0.6 END""",
)
def country_rule(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    p = scored_pairs(r).join(r.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    accepted = D.one_owner(p.where("score >= 0.6"))
    return D.country_rule(p, accepted, "fr", 0.6, 0.7, 0.4).select("s1_id", "t_id", "score", "label", "country")


@query(
    "pair_auc",
    f"""WITH {SCORED_SQL}, s AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY score), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM w""",
)
def pair_auc(spark, sf_dir):
    return D.pair_auc(scored_pairs(linkage_records(spark, sf_dir))).withColumn("auc", F.round("auc", 6))


@query(
    "top1_hit",
    f"""WITH {SCORED_SQL}, f AS (SELECT s1_id, label FROM scored QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) = 1)
    SELECT count(*) AS with_truth, round(avg(coalesce(label, 0)), 6) AS top1_hit FROM ent LEFT JOIN f USING (s1_id) WHERE truth_len > 0""",
)
def top1_hit(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return D.top1_hit(entities(r), scored_pairs(r)).withColumn("top1_hit", F.round("top1_hit", 6))


def _gain(k: str, tp: str) -> str:
    return "round(avg(" + F05_SQL.format(k=f"({k})", tp=f"({tp})") + " - " + F05_SQL.format(k="k", tp="tp") + "), 6)"


def _budget(wrong: dict[str, str], missed: dict[str, str], table_name: str) -> str:
    """CTEs ``budget`` (error, n, gain) over a table (s1_id, predicted, label and the classes' columns) and ``lists`` (s1_id, truth_len, retrieved)."""
    flags = {f"wrong_{k}": f"predicted AND label = 0 AND coalesce({c}, false)" for k, c in wrong.items()}
    flags["wrong_other"] = "predicted AND label = 0" + "".join(f" AND NOT coalesce({c}, false)" for c in wrong.values())
    rest = "NOT predicted AND label = 1"
    for k, c in missed.items():
        flags[f"missed_{k}"] = f"{rest} AND coalesce({c}, false)"
        rest += f" AND NOT coalesce({c}, false)"
    flags["missed_other"] = rest
    counts = ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in flags.items())
    zero = ", ".join(f"coalesce({k}, 0) AS {k}" for k in ["k", "tp", "listed", "bad", *flags])
    rows = [f"SELECT '{k}' AS error, CAST(sum({k}) AS BIGINT) AS n, {_gain(f'k - {k}', 'tp') if k.startswith('wrong') else _gain(f'k + {k}', f'tp + {k}')} AS gain FROM b1" for k in flags]
    rows.append(f"SELECT 'wrong_singleton', CAST(count(*) FILTER (truth_len = 0 AND bad > 0) AS BIGINT), {_gain('k - CASE WHEN truth_len = 0 THEN bad ELSE 0 END', 'tp')} FROM b1")
    rows.append(f"SELECT 'dropped_by_filter', CAST(sum(retrieved - listed) AS BIGINT), {_gain('k + retrieved - listed', 'tp + retrieved - listed')} FROM b1")
    rows.append(f"SELECT 'never_retrieved', CAST(sum(truth_len - retrieved) AS BIGINT), {_gain('k + truth_len - retrieved', 'tp + truth_len - retrieved')} FROM b1")
    return f"""b0 AS (SELECT s1_id, count(*) FILTER (predicted) AS k, count(*) FILTER (predicted AND label = 1) AS tp, count(*) FILTER (label = 1) AS listed, count(*) FILTER (predicted AND label = 0) AS bad, {counts} FROM {table_name} GROUP BY 1),
    b1 AS (SELECT lists.*, {zero} FROM lists LEFT JOIN b0 USING (s1_id)), budget AS ({' UNION ALL '.join(rows)})"""


# A filter that keeps five rows a list, so that gold is lost both before it and by it.
_CUT = "lists AS (SELECT ent.s1_id, ent.truth_len, CAST(count(*) FILTER (label = 1) AS BIGINT) AS retrieved FROM ent LEFT JOIN listed USING (s1_id) GROUP BY ALL), cut_list AS (SELECT *, filter_score >= 0.5 AS predicted FROM listed WHERE filter_rank < 5)"


def _cut_lists(r):
    rows = filter_list(r)
    retrieved = rows.groupBy("s1_id").agg(F.sum(F.col("label").cast("long")).alias("retrieved_truth"))
    e = entities(r).join(retrieved, "s1_id", "left").fillna(0, ["retrieved_truth"])
    cut = rows.where("filter_rank < 5").withColumn("predicted", F.col("filter_score") >= 0.5)
    return e, cut


@query("error_budget", f"""WITH {SCORED_SQL}, {_CUT}, {_budget({"strong": "filter_score >= 0.8"}, {"weak": "filter_score < 0.3"}, "cut_list")} SELECT error, n, gain FROM budget""")
def error_budget(spark, sf_dir):
    e, p = _cut_lists(linkage_records(spark, sf_dir))
    return D.error_budget(e, p, {"strong": F.col("filter_score") >= 0.8}, {"weak": F.col("filter_score") < 0.3})


_SAME = "(digits_all_s1_in_tgt = 1 AND coalesce(addr_overlap_frac, 0) >= 0.8)"
_SCRIPT = "CASE WHEN regexp_extract({0}, '\\p{{L}}') = '' OR regexp_matches(regexp_extract({0}, '\\p{{L}}'), '\\p{{Latin}}') THEN 0 ELSE 11 END"


@query(
    "matcher_errors",
    f"""WITH {SCORED_SQL}, {_CUT}, {CHEAP_SQL}, owned AS (SELECT DISTINCT t_id FROM gold), evidence AS (
      SELECT s.s1_id, s.t_id, c.predicted, c.label, x.* EXCLUDE (s1_id, t_id), {_TYPO} AS digit_typo, len(b.d) > 0 AND len({_OTHERS.format('b.d', 'a.d')}) = 0 AS tgt_in_s1, {_SCRIPT.format('a.name')} <> {_SCRIPT.format('b.name')} AS script_differs, s.t_id IN (SELECT t_id FROM owned) AS owned
      FROM cut_list c JOIN scored s USING (s1_id, t_id) JOIN cheap x ON x.s1_id = s.s1_id AND x.t_id = s.t_id JOIN store a ON a.entity_id = s.s1_id JOIN store b ON b.entity_id = s.t_id),
    {_budget({"same_address_owned": f"{_SAME} AND owned", "same_address_unowned": f"{_SAME} AND NOT owned", "other_address_strong_name": f"NOT {_SAME} AND coalesce(name_idf_frac, 0) >= 0.8"},
             {"script": "script_differs", "address_missing": "tgt_addr_missing = 1", "digit_typo": "digit_typo", "digit_dropped": "tgt_in_s1 AND digits_all_s1_in_tgt = 0", "digit_other": "digits_s1_n > 0 AND digits_all_s1_in_tgt = 0", "weak_name": "coalesce(name_idf_frac, 0) < 0.3"}, "evidence")}
    SELECT error, n, gain FROM budget""",
)
def matcher_errors(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    e, p = _cut_lists(r)
    owners = gold(r).select(F.col("t_id").alias("owned_id")).distinct()
    p = p.join(owners, F.col("t_id") == F.col("owned_id"), "left").withColumn("owned", F.col("owned_id").isNotNull()).drop("owned_id")
    store = X.token_store(r)
    full = X.cheap_features(p, store).join(X.digit_evidence(p, store), ["s1_id", "t_id"])
    full = full.withColumns({c: F.round(c, 6) for c in ("addr_overlap_frac", "name_idf_frac")})
    return D.error_budget(e, full, *D.error_classes())


@query(
    "substitution_pairs",
    f"""WITH {SCORED_SQL}, w AS (SELECT entity_id, list_distinct(list_filter(string_split(name, ' '), lambda x: x <> '' AND NOT regexp_full_match(x, '\\p{{Nd}}+'))) AS w FROM r),
    d AS (SELECT list_filter(a.w, lambda x: NOT list_contains(b.w, x)) AS x, list_filter(b.w, lambda x: NOT list_contains(a.w, x)) AS y FROM scored s JOIN w a ON a.entity_id = s.s1_id JOIN w b ON b.entity_id = s.t_id),
    u AS (SELECT unnest(x) AS a, y FROM d WHERE len(x) BETWEEN 1 AND 2 AND len(y) BETWEEN 1 AND 2), v AS (SELECT a, unnest(y) AS b FROM u) SELECT a, b, count(*) AS n FROM v GROUP BY ALL""",
)
def substitution_pairs(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return X.token_substitutions(X.sides(scored_pairs(r), r, ["name"]), "s_name", "t_name")


_SUBSTITUTIONS = f"""w AS (SELECT entity_id, list_distinct(list_filter(string_split(name, ' '), lambda x: x <> '' AND NOT regexp_full_match(x, '\\p{{Nd}}+'))) AS w FROM r),
    d AS (SELECT list_filter(a.w, lambda x: NOT list_contains(b.w, x)) AS x, list_filter(b.w, lambda x: NOT list_contains(a.w, x)) AS y FROM scored s JOIN w a ON a.entity_id = s.s1_id JOIN w b ON b.entity_id = s.t_id),
    u AS (SELECT unnest(x) AS a, y FROM d WHERE len(x) BETWEEN 1 AND 2 AND len(y) BETWEEN 1 AND 2), v AS (SELECT a, unnest(y) AS b FROM u), subs AS (SELECT a, b, count(*) AS n FROM v GROUP BY ALL)"""


@query(
    "canonical_tokens",
    f"""WITH RECURSIVE {SCORED_SQL}, {_SUBSTITUTIONS}, best AS (SELECT *, sum(n) OVER (PARTITION BY a) AS total, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM subs),
    links AS (SELECT a, b FROM best WHERE place = 1 AND n >= 2 AND n >= 0.3::DOUBLE * total), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.y)
    SELECT x AS token, min(y) AS canonical FROM reach GROUP BY x HAVING min(y) <> x""",
)
def canonical_tokens(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return X.canonical_map(X.token_substitutions(X.sides(scored_pairs(r), r, ["name"]), "s_name", "t_name"), least=2, share=0.3)


@query(
    "expected_f_decision",
    f"""WITH {SCORED_SQL}, p AS (SELECT s1_id, list(score ORDER BY score DESC)[1:10] AS p FROM scored GROUP BY 1),
    m AS (SELECT s1_id, p, unnest(range(CAST(1 << len(p) AS BIGINT))) AS mask FROM p),
    w AS (SELECT s1_id, p, mask, list_product(list_transform(p, lambda x, i: CASE WHEN (mask >> CAST(i - 1 AS BIGINT)) & 1 = 1 THEN x ELSE 1 - x END)) AS chance, unnest(range(len(p) + 1)) AS k FROM m),
    f AS (SELECT s1_id, k, chance, bit_count(mask & ((1::BIGINT << CAST(k AS BIGINT)) - 1)) AS a, bit_count(mask >> CAST(k AS BIGINT)) AS b FROM w),
    e AS (SELECT s1_id, k, round(sum(chance * CASE WHEN k = 0 THEN CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END WHEN a > 0 THEN 1.25 * a / (1.25 * a + 0.25 * b + (k - a)) ELSE 0.0 END), 9) AS value FROM f GROUP BY ALL)
    SELECT s1_id, CAST(k AS INTEGER) AS k_star, round(value, 6) AS expected_f05 FROM e QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY value DESC, k) = 1""",
)
def expected_f_decision(spark, sf_dir):
    return D.expected_f_sizes(scored_pairs(linkage_records(spark, sf_dir))).withColumn("expected_f05", F.round("expected_f05", 6))


def _features(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    rows = L.list_aggregates(L.list_features(filter_list(r), "filter_score", "filter_score"), "filter_score")
    return r, materialise(rows, "features"), ["filter_score", "filter_rank", "logit_gap", "n_p05", "best_other", "mean_other"]


@query(
    "calibrated_scores",
    f"""WITH {SCORED_SQL}, x AS (SELECT score, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS hits FROM scored GROUP BY 1), y AS (SELECT *, sum(n) OVER w AS ns, sum(hits) OVER w AS hs FROM x WINDOW w AS (ORDER BY score)),
    v AS (SELECT a.score AS low, b.score AS high, (b.hs - a.hs + a.hits) / (b.ns - a.ns + a.n) AS mean FROM y a JOIN y b ON a.score <= b.score),
    z AS (SELECT y.score, v.low, min(v.mean) AS least FROM y JOIN v ON v.low <= y.score AND v.high >= y.score GROUP BY ALL), iso AS (SELECT score, max(least) AS p FROM z GROUP BY 1)
    SELECT s1_id, t_id, 10 * score - 5 AS logit, round(p, 6) AS p FROM scored JOIN iso USING (score)""",
)
def calibrated_scores(spark, sf_dir):
    rows = scored_pairs(linkage_records(spark, sf_dir)).withColumn("logit", 10 * F.col("score") - 5)
    return models.calibrate(rows, models.fit_calibrator(rows, "logit"), "logit").select("s1_id", "t_id", "logit", F.round("p", 6).alias("p"))


@query("filter_model")
def filter_model(spark, sf_dir):
    _, rows, names = _features(spark, sf_dir)
    model = models.fit_trees(rows, names, rounds=10)
    return models.predict(model, rows, names, "q").select("s1_id", "t_id", "label", "q")


@query("stacked_model")
def stacked_model(spark, sf_dir):
    _, rows, names = _features(spark, sf_dir)
    return models.out_of_fold(rows, names, folds=3).select("s1_id", "t_id", "label", "q")


def _f05_at(threshold: float, name: str) -> str:
    return f"""{name} AS (SELECT s1_id, {F05_SQL.format(k="k", tp="tp")} AS f FROM (SELECT ent.s1_id, truth_len, count(s.t_id) AS k, coalesce(sum(s.label), 0) AS tp FROM ent LEFT JOIN (SELECT * FROM scored WHERE score >= {threshold}) s USING (s1_id) GROUP BY ALL))"""


_POISSON = " + ".join(f"(u > {x!r})::INT" for x in models.POISSON)


@query(
    "paired_bootstrap",
    f"""WITH {SCORED_SQL}, {_f05_at(0.7, 'fa')}, {_f05_at(0.5, 'fb')}, diff AS (SELECT s1_id, fa.f - fb.f AS d FROM fa JOIN fb USING (s1_id)),
    drawn AS (SELECT draw, d, ('0x' || substr(md5(s1_id || ':' || draw || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM diff, (SELECT unnest(range(1, 201)) AS draw)),
    means AS (SELECT draw, sum(({_POISSON}) * d) / sum({_POISSON}) AS m FROM drawn GROUP BY 1)
    SELECT round((SELECT avg(d) FROM diff), 6) AS mean_diff, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means""",
)
def paired_bootstrap(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    e, p = entities(r), scored_pairs(r)
    rows = D.paired_bootstrap(D.entity_f05(e, p.where("score >= 0.7")), D.entity_f05(e, p.where("score >= 0.5")))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@query("vector_projection")
def vector_projection(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return models.project(vectors, "embedding", models.projection(vectors, "embedding", 4)).select("vec_id", "projected")


@query(
    "ensemble_scores",
    f"WITH {SCORED_SQL} SELECT s1_id, t_id, round(CASE WHEN filter_rank < 5 THEN (filter_score + 1.0 / (1 + filter_rank)) / 2 END, 6) AS score FROM listed",
)
def ensemble_scores(spark, sf_dir):
    rows = filter_list(linkage_records(spark, sf_dir))
    first = rows.select("s1_id", "t_id", F.col("filter_score").alias("score"))
    second = rows.where("filter_rank < 5").select("s1_id", "t_id", (1 / (1 + F.col("filter_rank"))).alias("score"))
    return L.ensemble([first, second]).withColumn("score", F.round("score", 6))


@query(
    "match_lists",
    f"""WITH {SCORED_SQL}, {_PRED}, o AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY score DESC, s1_id) = 1),
    k AS (SELECT s1_id, t_id, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) AS n FROM o)
    SELECT q.entity_id AS s1_id, coalesce(string_agg(k.t_id, ',' ORDER BY n), '') AS matched_entity_ids FROM q LEFT JOIN k ON k.s1_id = q.entity_id GROUP BY 1""",
)
def match_lists(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    owned = D.one_owner(_predicted(r))
    placed = owned.withColumn("n", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col("score").desc(), "t_id")))
    return build_lists(r.where("source = 1").select(F.col("entity_id").alias("s1_id")), placed, "n")
