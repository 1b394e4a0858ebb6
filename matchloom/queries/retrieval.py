"""Queries over records, candidate routes and fused lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..operators import lists as L
from ..operators import metrics as M
from ..operators import sampling
from ..session import materialise
from .base import (
    DENSE_SQL,
    GOLD_SQL,
    KEY_SQL,
    NAME_TOKENS,
    R_SQL,
    ROUTE_NAMES,
    ROUTES_SQL,
    SCORED_SQL,
    TEXT_DIGITS,
    WORD_GRAMS,
    dense_vectors,
    entities,
    filter_list,
    fused_query_routes,
    gold,
    grams_sql,
    linkage_records,
    query,
    query_routes,
    rare_sql,
    table,
    tfidf_sql,
)

_TOP = "SELECT s1_id, t_id, source, score, rank FROM {}"


@query(
    "record_profile",
    f"""WITH {R_SQL} SELECT source, count(*) AS n_rows, count(DISTINCT entity_id) AS ids, CAST(sum(CASE WHEN name = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_name,
    CAST(sum(CASE WHEN address = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_address,
    CAST(sum(CASE WHEN regexp_matches(name || address, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END) AS BIGINT) AS non_ascii,
    count(DISTINCT country) AS countries, CAST(max(length(name)) AS INTEGER) AS max_name, round(avg(length(name)), 6) AS mean_name FROM r GROUP BY source""",
)
def record_profile(spark, sf_dir):
    return M.record_profile(linkage_records(spark, sf_dir))


@query(
    "fold_summary",
    f"""WITH {R_SQL}, {GOLD_SQL} SELECT CAST(('0x' || substr(md5(ent.s1_id), 1, 8))::BIGINT % 5 AS INTEGER) AS fold,
    CASE WHEN truth_len >= 6 THEN '6+' ELSE CAST(truth_len AS VARCHAR) END AS bucket, q.country, count(*) AS n
    FROM ent JOIN q ON q.entity_id = ent.s1_id GROUP BY ALL""",
)
def fold_summary(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    links = gold(r).groupBy("s1_id").agg(F.collect_list("t_id").alias("matched"))
    q = r.where("source = 1").select(F.col("entity_id").alias("s1_id"), "country").join(links, "s1_id", "left")
    return sampling.fold_summary(q.withColumn("matched", F.coalesce("matched", F.array().cast("array<string>"))))


@query("exact_name_candidates", f"WITH {R_SQL}, {KEY_SQL} " + _TOP.format("exact_top"))
def exact_name_candidates(spark, sf_dir):
    return C.exact_name(linkage_records(spark, sf_dir))


@query("suffix_exact_candidates", f"WITH {R_SQL}, {KEY_SQL} " + _TOP.format("suffix_top"))
def suffix_exact_candidates(spark, sf_dir):
    return C.suffix_exact(linkage_records(spark, sf_dir))


@query("rare_token_candidates", f"WITH {R_SQL}, {rare_sql('rare', NAME_TOKENS)} " + _TOP.format("rare_top"))
def rare_token_candidates(spark, sf_dir):
    return C.rare_names(linkage_records(spark, sf_dir))


@query("digit_candidates", f"WITH {R_SQL}, {rare_sql('digit', TEXT_DIGITS)} " + _TOP.format("digit_top"))
def digit_candidates(spark, sf_dir):
    return C.rare_digits(linkage_records(spark, sf_dir), "text")


@query("char_tfidf_topk", f"WITH {R_SQL}, {tfidf_sql('char', grams_sql('name'), 0.01)} " + _TOP.format("char_top"))
def char_tfidf_topk(spark, sf_dir):
    return C.name_char_tfidf(materialise(linkage_records(spark, sf_dir).drop("text"), "records"))


@query("word_tfidf_topk", f"WITH {R_SQL}, {tfidf_sql('word', WORD_GRAMS, 0.1)} " + _TOP.format("word_top"))
def word_tfidf_topk(spark, sf_dir):
    return C.name_word_tfidf(materialise(linkage_records(spark, sf_dir).drop("text"), "records"))


@query("address_tfidf_topk", f"WITH {R_SQL}, {tfidf_sql('address', grams_sql('address'), None)} " + _TOP.format("address_top"))
def address_tfidf_topk(spark, sf_dir):
    return C.char_tfidf_whole(materialise(linkage_records(spark, sf_dir).drop("text"), "records"), "address")


@query("route_union_rrf", f"WITH {ROUTES_SQL} SELECT s1_id, t_id, route_bits, n_routes, rrf, rrf_rank FROM fused")
def route_union_rrf(spark, sf_dir):
    return fused_query_routes(linkage_records(spark, sf_dir, often=True))


_EVIDENCE = ", ".join(f"max(CASE WHEN route = '{r}' THEN score END) AS score_{r}, min(CASE WHEN route = '{r}' THEN rank END) AS rank_{r}" for r in ROUTE_NAMES)


@query(
    "route_evidence",
    f"WITH {ROUTES_SQL}, wide AS (SELECT s1_id, t_id, {_EVIDENCE} FROM routes GROUP BY ALL) SELECT fused.*, wide.* EXCLUDE (s1_id, t_id), count(*) OVER (PARTITION BY s1_id) AS cand_count FROM fused JOIN wide USING (s1_id, t_id)",
)
def route_evidence(spark, sf_dir):
    return fused_query_routes(linkage_records(spark, sf_dir, often=True), evidence=True)


@query(
    "route_subset_pareto",
    f"""WITH {ROUTES_SQL}, masks AS (SELECT range AS mask FROM range(128)),
    c AS (SELECT mask, CAST(count(fused.t_id) AS BIGINT) AS pairs, CAST(count(gold.t_id) AS BIGINT) AS hits FROM masks LEFT JOIN fused ON (mask & route_bits) <> 0 LEFT JOIN gold ON gold.s1_id = fused.s1_id AND gold.t_id = fused.t_id GROUP BY mask)
    SELECT mask, pairs, hits, round(hits::DOUBLE / nullif((SELECT count(*) FROM gold), 0), 6) AS recall, round(pairs::DOUBLE / nullif((SELECT count(*) FROM q), 0), 6) AS mean_candidates,
    NOT EXISTS (SELECT 1 FROM c o WHERE o.hits >= c.hits AND o.pairs <= c.pairs AND (o.hits > c.hits OR o.pairs < c.pairs)) AS pareto FROM c""",
)
def route_subset_pareto(spark, sf_dir):
    r = linkage_records(spark, sf_dir, often=True)
    return M.route_subsets(materialise(gold(r), "gold"), fused_query_routes(r), r.where("source = 1"), len(ROUTE_NAMES))


@query(
    "route_contributions",
    f"""WITH {ROUTES_SQL}, x AS (SELECT route, gold.t_id AS hit, count(*) OVER (PARTITION BY routes.s1_id, routes.t_id) AS n FROM routes LEFT JOIN gold ON gold.s1_id = routes.s1_id AND gold.t_id = routes.t_id)
    SELECT route, count(*) AS pairs, count(hit) AS hits, CAST(sum(CASE WHEN hit IS NOT NULL AND n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_hits FROM x GROUP BY route""",
)
def route_contributions(spark, sf_dir):
    r = linkage_records(spark, sf_dir, often=True)
    return M.route_contributions(gold(r), query_routes(r))


@query(
    "candidate_recall",
    f"""WITH {ROUTES_SQL}, k AS (SELECT unnest([1, 5, 10, 50]) AS k), l AS (SELECT gold.*, rrf_rank FROM gold LEFT JOIN fused USING (s1_id, t_id))
    SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN rrf_rank < k THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS links, round(sum(CASE WHEN rrf_rank < k THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS recall FROM l, k GROUP BY k""",
)
def candidate_recall(spark, sf_dir):
    r = linkage_records(spark, sf_dir, often=True)
    links = materialise(gold(r), "gold")
    # Only links can be hits, and they are few beside the candidates.
    return M.recall_at(links, fused_query_routes(r).join(links, ["s1_id", "t_id"], "left_semi"), [1, 5, 10, 50])


@query(
    "candidate_counts",
    f"""WITH {ROUTES_SQL}, n AS (SELECT count(fused.t_id) AS n FROM q LEFT JOIN fused ON fused.s1_id = q.entity_id GROUP BY q.entity_id)
    SELECT round(avg(n), 6) AS mean, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99,
    CAST(max(n) AS BIGINT) AS max, CAST(sum(n) AS BIGINT) AS total FROM n""",
)
def candidate_counts(spark, sf_dir):
    r = linkage_records(spark, sf_dir, often=True)
    return M.size_summary(fused_query_routes(r), r.where("source = 1").select(F.col("entity_id").alias("s1_id")))


@query(
    "candidate_quality",
    f"""WITH {ROUTES_SQL}, p AS (
      SELECT q.entity_id AS s1_id, q.country, (SELECT count(*) FROM gold WHERE gold.s1_id = q.entity_id) AS links,
             (SELECT count(*) FROM gold JOIN fused USING (s1_id, t_id) WHERE gold.s1_id = q.entity_id) AS hits, (SELECT count(*) FROM fused WHERE fused.s1_id = q.entity_id) AS n FROM q)
    SELECT country, count(*) AS queries, CAST(sum(links) AS BIGINT) AS links, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits)::DOUBLE / nullif(sum(links), 0), 6) AS link_recall,
    round(avg(CASE WHEN links > 0 THEN CASE WHEN hits = links THEN 1.0 ELSE 0.0 END END), 6) AS every_match, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_candidates FROM p GROUP BY country""",
)
def candidate_quality(spark, sf_dir):
    r = linkage_records(spark, sf_dir, often=True)
    links = materialise(gold(r), "gold")
    return M.quality(links, fused_query_routes(r), M.query_flags(r, links), "country")


@query("dense_knn", f"WITH {DENSE_SQL} SELECT * FROM dense")
def dense_knn(spark, sf_dir):
    q, t = dense_vectors(spark, sf_dir)
    return C.dense_neighbours(q, t).select("s1_id", "t_id", "dense_score", "dense_rank")


# The base list for the dense queries: the top 40 by the first quarter of the dimensions.
_BASE_SQL = """bs AS (SELECT a.vec_id AS s1_id, b.vec_id AS t_id, round(list_cosine_similarity(a.v[1:16], b.v[1:16]), 6) AS filter_score FROM dv a JOIN dv b USING (place)),
base AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY filter_score DESC, t_id) - 1 AS INTEGER) AS filter_rank FROM bs) WHERE filter_rank < 40)"""


def _dense_lists(spark, sf_dir):
    q, t = dense_vectors(spark, sf_dir)
    part = F.slice("vector", 1, 16)
    base = C.dense_neighbours(q.withColumn("vector", part), t.withColumn("vector", part), 40)
    return C.dense_neighbours(q, t), base.select("s1_id", "t_id", F.col("dense_score").alias("filter_score"), F.col("dense_rank").alias("filter_rank"))


@query("dense_new_pairs", f"WITH {DENSE_SQL}, {_BASE_SQL} SELECT s1_id, t_id, dense_score, dense_rank FROM dense ANTI JOIN base USING (s1_id, t_id) WHERE dense_rank < 20")
def dense_new_pairs(spark, sf_dir):
    dense, base = _dense_lists(spark, sf_dir)
    return C.new_dense_pairs(dense, base).select("s1_id", "t_id", "dense_score", "dense_rank")


@query(
    "augmented_list",
    f"""WITH {DENSE_SQL}, {_BASE_SQL}, fresh AS (SELECT * FROM dense ANTI JOIN base USING (s1_id, t_id) WHERE dense_rank < 20),
    both_lists AS (SELECT s1_id, t_id, filter_score, filter_rank FROM base UNION ALL SELECT s1_id, t_id, -20.0, 40 + dense_rank FROM fresh)
    SELECT s1_id, t_id, filter_score, filter_rank, dense_score, coalesce(dense_rank, 999)::DOUBLE AS dense_rank FROM both_lists LEFT JOIN dense USING (s1_id, t_id)""",
)
def augmented_list(spark, sf_dir):
    dense, base = _dense_lists(spark, sf_dir)
    return C.augment(base, C.new_dense_pairs(dense, base), dense)


@query(
    "dense_coverage",
    f"""WITH {DENSE_SQL}, {_BASE_SQL}, truth AS (SELECT s1_id, t_id FROM ds WHERE dense_score >= 0.2), k AS (SELECT unnest([1, 5, 10]) AS k),
    l AS (SELECT CAST(k AS INTEGER) AS k, coalesce(dense.dense_rank < k, false) AS a, base.t_id IS NOT NULL AS b FROM truth LEFT JOIN dense USING (s1_id, t_id) LEFT JOIN base USING (s1_id, t_id), k)
    SELECT k, count(*) AS links, CAST(sum(a::INT) AS BIGINT) AS dense, CAST(sum(b::INT) AS BIGINT) AS listed, CAST(sum((a OR b)::INT) AS BIGINT) AS union_found, CAST(sum((a AND NOT b)::INT) AS BIGINT) AS new FROM l GROUP BY k""",
)
def dense_coverage(spark, sf_dir):
    q, t = dense_vectors(spark, sf_dir)
    dense, base = _dense_lists(spark, sf_dir)
    every = C.dense_neighbours(q, t, 1 << 30)
    return M.dense_coverage(every.where("dense_score >= 0.2").select("s1_id", "t_id"), base, dense, [1, 5, 10])


@query(
    "reverse_competition",
    f"""WITH {DENSE_SQL}, o AS (
      SELECT a.s1_id, a.t_id, a.dense_score, a.dense_rank, max(b.dense_score) AS other, CAST(count(b.s1_id) AS BIGINT) AS n
      FROM dense a LEFT JOIN dense b ON a.t_id = b.t_id AND a.s1_id <> b.s1_id GROUP BY ALL)
    SELECT s1_id, t_id, other AS rev_best_other, round(dense_score - other, 6) AS rev_margin, n AS rev_count_other, CAST(other IS NULL OR dense_score >= other AS INTEGER) AS rev_is_top FROM o""",
)
def reverse_competition(spark, sf_dir):
    q, t = dense_vectors(spark, sf_dir)
    rows = L.reverse_competition(C.dense_neighbours(q, t))
    return rows.select("s1_id", "t_id", "rev_best_other", F.round("rev_margin", 6).alias("rev_margin"), "rev_count_other", "rev_is_top")


@query(
    "name_duplicates",
    "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1",
)
def name_duplicates(spark, sf_dir):
    return M.duplicates(table(spark, sf_dir, "part"), "p_name")


@query(
    "gold_agreement",
    f"""WITH {R_SQL}, {GOLD_SQL} SELECT count(*) AS links, round(avg((a.name = b.name)::INT), 6) AS same_name, round(avg((a.address = b.address)::INT), 6) AS same_address, round(avg((a.country = b.country)::INT), 6) AS same_country
    FROM gold JOIN r a ON a.entity_id = s1_id JOIN r b ON b.entity_id = t_id""",
)
def gold_agreement(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return M.agreement(r, gold(r))


@query(
    "record_tokens",
    f"""WITH {R_SQL} SELECT entity_id, array_to_string(list_filter(string_split(regexp_replace(name, '(\\S)(?: (?:corp|corporation|pvt|private|ltd|limited)){{1,2}}$', '\\1'), ' '), lambda x: x <> '')[1:6], ' ') AS stripped,
    regexp_extract(text, '\\p{{Nd}}+') AS first_run, regexp_matches(name || address, '[^\\x00-\\x7F]') AS non_ascii, CASE WHEN address = '' THEN name ELSE name || ' | ' || address END AS record_text FROM r""",
)
def record_tokens(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return r.select(
        "entity_id",
        T.strip_legal_suffix(F.col("name")).alias("stripped"),
        F.regexp_extract("text", r"\p{Nd}+", 0).alias("first_run"),
        T.has_non_ascii(F.concat("name", "address")).alias("non_ascii"),
        T.record_text(F.col("name"), F.col("address")).alias("record_text"),
    )


@query(
    "encoded_ids",
    f"""WITH {R_SQL} SELECT entity_id, CAST(CAST(substr(entity_id, 4) AS BIGINT) * 2 + CASE WHEN source = 3 THEN 1 ELSE 0 END AS BIGINT) AS code, entity_id AS decoded FROM g""",
)
def encoded_ids(spark, sf_dir):
    r = linkage_records(spark, sf_dir).where("source > 1")
    coded = r.select("entity_id", T.encode_id(F.col("entity_id")).alias("code"))
    return coded.withColumn("decoded", T.decode_id(F.col("code")))


@query(
    "filter_retention_curve",
    f"""WITH {SCORED_SQL}, k AS (SELECT unnest([1, 3, 10]) AS k),
    p AS (SELECT k, s1_id, sum(label) AS gold, count(*) AS n FROM listed, k WHERE filter_rank < k GROUP BY ALL),
    f AS (SELECT k, ent.s1_id, truth_len, coalesce(gold, 0) AS gold, coalesce(n, 0) AS n FROM ent CROSS JOIN k LEFT JOIN p USING (k, s1_id))
    SELECT CAST(k AS INTEGER) AS k, CAST(sum(gold) AS BIGINT) AS kept_gold, CAST(sum(n) AS BIGINT) AS kept_pairs, CAST((SELECT sum(label) FROM listed) AS BIGINT) AS listed_gold,
    round(sum(gold)::DOUBLE / (SELECT sum(label) FROM listed), 6) AS retention,
    round(avg(CASE WHEN truth_len = 0 THEN 1.0 WHEN gold > 0 THEN 1.25 * gold / (gold + 0.25 * truth_len) ELSE 0.0 END), 6) AS oracle_f05 FROM f GROUP BY k""",
)
def filter_retention_curve(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return M.retention_curve(filter_list(r), entities(r), "filter_rank", [1, 3, 10])


@query(
    "ownership_strata",
    f"""WITH {SCORED_SQL} SELECT CASE WHEN gold.t_id IS NULL THEN 'none' WHEN gold.s1_id = listed.s1_id THEN 'own' ELSE 'other' END AS kind, count(*) AS n FROM listed LEFT JOIN gold ON gold.t_id = listed.t_id GROUP BY 1""",
)
def ownership_strata(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return M.ownership(filter_list(r), gold(r))


@query(
    "scalar_functions",
    f"""WITH {R_SQL}, x AS (SELECT entity_id, name, coalesce(regexp_extract(text, '\\p{{Nd}}+'), '') AS run, regexp_extract(name, '\\p{{L}}') AS letter, length(name) AS n FROM r)
    SELECT entity_id, CASE WHEN run <> '' AND length(run) <= 12 THEN CAST(run AS BIGINT) ELSE -1 END AS first_number, CASE WHEN regexp_matches(letter, '\\p{{Latin}}') OR letter = '' THEN 0 ELSE 11 END AS script,
    CASE WHEN n >= 6 THEN '6+' ELSE CAST(n AS VARCHAR) END AS bucket, round(1 / (1 + exp(-greatest(least(n - 20.0, 40.0), -40.0))), 6) AS squashed, CAST(split_part(entity_id, '-', 2) AS BIGINT) AS number FROM x""",
)
def scalar_functions(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    number = F.coalesce(*[T.numeric_id(F.col("entity_id"), p) for p in ("S1", "S2", "S3")])
    return r.select(
        "entity_id",
        T.first_number(F.col("text")).alias("first_number"),
        T.script_code(F.col("name")).alias("script"),
        T.match_bucket(F.length("name")).alias("bucket"),
        F.round(T.sigmoid(F.length("name") - F.lit(20.0)), 6).alias("squashed"),
        number.alias("number"),
    )


@query("seeded_prefix", f"WITH {R_SQL} SELECT entity_id FROM r ORDER BY md5('7:' || entity_id), entity_id LIMIT 50")
def seeded_prefix(spark, sf_dir):
    return sampling.ordered_prefix(linkage_records(spark, sf_dir), "entity_id", 50, 7)


@query(
    "position_splits",
    f"""WITH {R_SQL}, p AS (SELECT entity_id, row_number() OVER (ORDER BY md5('7:' || entity_id), entity_id) - 1 AS position FROM r)
    SELECT entity_id, position, CASE WHEN position <= 599 THEN 'train' WHEN position BETWEEN 600 AND 799 THEN 'validation' END AS split FROM p""",
)
def position_splits(spark, sf_dir):
    return sampling.split_positions(linkage_records(spark, sf_dir), "entity_id", {"train": (0, 599), "validation": (600, 799)}, 7)


@query(
    "counting_subset",
    f"""WITH {R_SQL}, sure AS (SELECT entity_id FROM q), rest AS (SELECT entity_id FROM g ORDER BY md5('7:' || entity_id), entity_id LIMIT greatest(0, 500 - (SELECT count(*) FROM sure)))
    SELECT entity_id FROM sure UNION ALL SELECT entity_id FROM rest""",
)
def counting_subset(spark, sf_dir):
    r = linkage_records(spark, sf_dir)
    return sampling.counting_subset(r, "entity_id", r.where("source = 1"), 500, 7)
