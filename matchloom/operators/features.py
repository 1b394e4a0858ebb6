"""Pair features: token and number evidence, corpus context, siblings, street and raw-text similarity.

Record-side tokens are computed once per record and joined to the pairs by id; a pair's features are array expressions on
the two sides. "Not applicable" is null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from .lists import siblings


def token_store(records: DataFrame) -> DataFrame:
    """Per record: digits (4), name tokens (8), address tokens (10), lengths and flags."""
    return records.select(
        "entity_id", "source", "country", "name", "address", F.length("name").alias("name_len"), F.length("address").alias("addr_len"),
        T.record_digits(F.col("address")).alias("digits"),
        T.record_name_tokens(F.col("name")).alias("name_tokens"),
        T.record_address_tokens(F.col("address")).alias("addr_tokens"),
        T.has_non_ascii(F.concat("name", "address")).alias("non_ascii"),
    )


def sides(pairs: DataFrame, store: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the wanted columns of both records, as s_… and t_…."""
    s = store.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"s_{c}") for c in columns])
    t = store.select(F.col("entity_id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return pairs.join(s, "s1_id").join(t, "t_id")


def fit_idf(store: DataFrame, tokens: str) -> DataFrame:
    """(token, idf) over the targets: ln((n + 1) / (df + 1)) + 1."""
    t = store.where(F.col("source") > 1)
    n = t.agg(F.count("*").alias("n"))
    df = t.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def with_idf(store: DataFrame, tokens: str, idf: DataFrame, name: str) -> DataFrame:
    """Adds a map token → idf for each query record; tokens unseen in the targets weigh ln(n + 1) + 1."""
    n = store.where(F.col("source") > 1).agg((F.log(F.count("*") + 1.0) + 1).alias("unseen"))
    rows = store.select("entity_id", F.explode(tokens).alias("token")).join(idf, "token", "left").crossJoin(F.broadcast(n))
    maps = rows.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("idf", "unseen")))).alias(name))
    return store.join(maps, "entity_id", "left")


def idf_fraction(weights: Column, other: Column) -> Column:
    """Share of the left tokens' idf that the other side has; null without tokens."""
    entries = F.map_entries(weights)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["value"])
    shared = F.aggregate(F.filter(entries, lambda e: F.array_contains(other, e["key"])), F.lit(0.0), lambda s, e: s + e["value"])
    return F.try_divide(shared, total)


def cheap_features(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Near-free evidence of each pair; ``pairs`` may carry route evidence, which passes through."""
    # Pairs, and the records that are joined to them, carry the lengths of names and addresses, never the texts.
    store = store.drop("name", "address")
    prepared = with_idf(store, "name_tokens", fit_idf(store, "name_tokens"), "name_idf")
    prepared = with_idf(prepared, "addr_tokens", fit_idf(store, "addr_tokens"), "addr_idf")
    p = sides(pairs, prepared, ["source", "digits", "name_tokens", "addr_tokens", "name_idf", "addr_idf", "name_len", "addr_len", "non_ascii"])
    d = S.overlap(F.col("s_digits"), F.col("t_digits"))
    out = p.withColumns(
        {
            "is_s3": (F.col("t_source") == 3).cast("int"),
            "digits_overlap": d,
            "digits_s1_n": F.size("s_digits"),
            "digits_tgt_n": F.size("t_digits"),
            "digits_jaccard": S.jaccard(F.col("s_digits"), F.col("t_digits")),
            "digits_all_s1_in_tgt": ((d == F.size("s_digits")) & (F.size("s_digits") > 0)).cast("int"),
            "house_match": F.coalesce(S.first_equal(F.col("s_digits"), F.col("t_digits")), F.lit(0)),
            "name_overlap": S.overlap(F.col("s_name_tokens"), F.col("t_name_tokens")),
            "name_overlap_frac": F.try_divide(S.overlap(F.col("s_name_tokens"), F.col("t_name_tokens")).cast("double"), F.size("s_name_tokens").cast("double")),
            "name_idf_frac": idf_fraction(F.col("s_name_idf"), F.col("t_name_tokens")),
            "addr_overlap": S.overlap(F.col("s_addr_tokens"), F.col("t_addr_tokens")),
            "addr_overlap_frac": F.try_divide(S.overlap(F.col("s_addr_tokens"), F.col("t_addr_tokens")).cast("double"), F.size("s_addr_tokens").cast("double")),
            "addr_idf_frac": idf_fraction(F.col("s_addr_idf"), F.col("t_addr_tokens")),
            "name_len_ratio": S.smaller_share(F.col("s_name_len"), F.col("t_name_len")),
            "addr_len_ratio": S.smaller_share(F.col("s_addr_len"), F.col("t_addr_len")),
            "tgt_addr_missing": (F.col("t_addr_len") == 0).cast("int"),
            "tgt_name_missing": (F.col("t_name_len") == 0).cast("int"),
            "tgt_non_ascii": F.col("t_non_ascii").cast("int"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(("s_", "t_")) and c != "t_id"])


def fuzzy_features(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Name and address similarities by all scorers (0 to 1), null where a side is empty; one pass of Python a field."""
    p = sides(pairs, store, ["name", "address"])
    for field in ("name", "address"):
        p = p.withColumn("__sim", S.similarities(list(S.SCORERS), F.col(f"s_{field}"), F.col(f"t_{field}")))
        p = p.withColumns(S.scored(f"{field}_", "__sim", list(S.SCORERS), 0.01)).drop("__sim")
    return p.drop("s_name", "t_name", "s_address", "t_address")


def route_block(evidence: DataFrame, routes: list[str]) -> DataFrame:
    """The route part of a model's row, from ``lists.route_evidence``: route flags, fused score and rank, list size, exact hits.

    ``s1_exact_hits`` is the number of the query's exact-name targets; a route that lacks the pair leaves its score and rank null.
    """
    whole = Window.partitionBy("s1_id")
    flags = {f"route_{r}": (F.shiftright("route_bits", i).bitwiseAND(F.lit(1))).cast("int") for i, r in enumerate(routes)}
    out = evidence.withColumns(flags)
    return out.withColumns(
        {
            "rrf_score": F.col("rrf"),
            "rrf_rank_frac": F.col("rrf_rank") / F.greatest("cand_count", F.lit(1)),
            "log_cand_count": F.log1p("cand_count"),
            "s1_exact_hits": F.sum(F.col("route_exact_name").cast("long")).over(whole) if "exact_name" in routes else F.lit(0).cast("long"),
        }
    ).drop("rrf", "route_bits")


def digit_evidence(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Digit typo, target's digits all in the query's, scripts of both names."""
    p = sides(pairs.select("s1_id", "t_id"), store, ["name", "digits"])
    p = p.withColumns({f"{side}_script": T.script_code(F.col(f"{side}_name")) for side in "st"})
    return p.select(
        "s1_id", "t_id",
        S.one_digit_typo(F.col("s_digits"), F.col("t_digits")).cast("int").alias("digit_typo"),
        F.when(F.size("t_digits") > 0, (F.size(F.array_except("t_digits", "s_digits")) == 0).cast("int")).alias("digits_tgt_in_s1"),
        "s_script", "t_script",
        (F.col("s_script") != F.col("t_script")).cast("int").alias("script_differs"),
    )


def canonical_features(pairs: DataFrame, store: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``digit_evidence`` and the similarities of canonical names and addresses; canonical texts are made once a record."""
    table = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    texts = store.select("entity_id", T.canonical(F.col("name"), table).alias("cname"), T.canonical(F.col("address"), table).alias("caddr"))
    p = sides(digit_evidence(pairs, store), texts, ["cname", "caddr"])
    p = p.withColumn("__addr", S.similarities(["token_set", "ratio"], F.col("s_caddr"), F.col("t_caddr")))
    p = p.withColumns({"canon_name_token_set": S.similarity("token_set", F.col("s_cname"), F.col("t_cname")) / 100, **S.scored("canon_addr_", "__addr", ["token_set", "ratio"], 0.01)})
    return p.drop("__addr", "s_cname", "t_cname", "s_caddr", "t_caddr")


def number_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """First number equal, shared numbers, Jaccard, target-only numbers; token Jaccard and first token equal."""
    store = records.select("entity_id", T.number_codes(F.col("address")).alias("nums"), T.token_codes(F.col("name")).alias("toks"))
    p = sides(pairs, store, ["nums", "toks"])
    both = (F.size("s_nums") > 0) & (F.size("t_nums") > 0)
    shared = S.overlap(F.col("s_nums"), F.col("t_nums"))
    return p.select(
        "s1_id", "t_id",
        S.first_equal(F.col("t_nums"), F.col("s_nums")).alias("num_first_eq"),
        F.when(both, shared).alias("num_shared"),
        S.jaccard(F.col("t_nums"), F.col("s_nums")).alias("num_jaccard"),
        F.when(F.size("t_nums") > 0, F.size("t_nums") - shared).alias("num_t_only"),
        S.jaccard(F.col("t_toks"), F.col("s_toks")).alias("name_tok_jaccard"),
        S.first_equal(F.col("t_toks"), F.col("s_toks")).alias("name_first_eq"),
    )


def corpus_counts(records: DataFrame, value: str, name: str) -> DataFrame:
    """(country, value, count) of non-empty values."""
    return records.where(F.length(value) > 0).groupBy("country", value).agg(F.count("*").alias(name))


def corpus_context(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """How often the names and addresses of a pair occur in the corpus of their country; empty values count 0.

    Values are only compared, so digests stand for them and no text is moved, neither with the records nor with the pairs. Counts
    are joined to the records, before these meet the pairs.
    """
    digest = lambda c: F.when(F.col(c) == "", F.lit("").cast("binary")).otherwise(F.unhex(F.md5(F.col(c).cast("binary")))).alias(c)
    t_id = F.col("t_id") if "t_id" in targets.columns else F.col("entity_id").alias("t_id")
    queries = queries.select(F.col("entity_id").alias("s1_id"), "country", digest("name"), digest("address"))
    targets = targets.select(t_id, "country", digest("name"), digest("address"))

    def counted(rows: DataFrame, corpus: DataFrame, value: str, name: str) -> DataFrame:
        counts = corpus_counts(corpus, value, name).select(F.col("country").alias("__c"), F.col(value).alias("__v"), name)
        return rows.join(counts, (F.col("country") == F.col("__c")) & (F.col(value) == F.col("__v")), "left").drop("__c", "__v").withColumn(name, F.coalesce(name, F.lit(0)))

    s = counted(counted(queries, queries, "name", "s1_same_name"), queries, "address", "s1_same_addr")
    t = counted(counted(counted(targets, targets, "name", "tg_same_name"), targets, "address", "tg_same_addr"), queries, "name", "s1_same_tname")
    s = s.withColumnsRenamed({"country": "s_country", "name": "s_name", "address": "s_addr"})
    t = t.withColumnsRenamed({"country": "t_country", "name": "t_name", "address": "t_addr"})
    p = pairs.join(s, "s1_id").join(t, "t_id")
    same = F.col("s_country") == F.col("t_country")
    in_list = Window.partitionBy("s1_id", "t_country", "t_name")
    is_empty = lambda c: F.length(c) == 0
    return p.withColumns(
        {
            "t_addr_empty": is_empty("t_addr").cast("int"),
            "s1_addr_empty": is_empty("s_addr").cast("int"),
            "name_eq": (same & ~is_empty("s_name") & (F.col("s_name") == F.col("t_name"))).cast("int"),
            "addr_eq": (same & ~is_empty("s_addr") & (F.col("s_addr") == F.col("t_addr"))).cast("int"),
            "list_same_tname": F.when(is_empty("t_name"), 0).otherwise(F.count("*").over(in_list)).cast("long"),
        }
    ).drop("s_country", "s_name", "s_addr", "t_country", "t_name", "t_addr")


def density(store: DataFrame) -> DataFrame:
    """(digit_key, log_freq) over the targets."""
    keys = store.where(F.col("source") > 1).select(T.digit_key(F.col("digits")).alias("digit_key")).where(F.col("digit_key").isNotNull())
    return keys.groupBy("digit_key").agg(F.log1p(F.count("*")).alias("log_freq"))


def sibling_features(pairs: DataFrame, records: DataFrame, score: str, top: int = 3) -> DataFrame:
    """Similarity of a target's name to the list's best other targets, and to the query's name."""
    names = records.select("entity_id", "name")
    sib = siblings(pairs, score, top).select("s1_id", "t_id", F.explode("siblings").alias("sib_id"))
    named = sib.join(names.select(F.col("entity_id").alias("sib_id"), F.col("name").alias("sib_name")), "sib_id").join(names.select(F.col("entity_id").alias("t_id"), F.col("name").alias("t_name")), "t_id")
    sims = named.withColumn("sim", S.similarity("token_set", F.col("t_name"), F.col("sib_name"))).groupBy("s1_id", "t_id").agg(F.max("sim").alias("sib_max_sim"), F.avg("sim").alias("sib_mean_sim"))
    p = sides(pairs.select("s1_id", "t_id"), records, ["name"]).withColumn("name_sim_s1", S.similarity("token_set", F.col("s_name"), F.col("t_name"))).drop("s_name", "t_name")
    return p.join(sims, ["s1_id", "t_id"], "left")


def raw_features(pairs: DataFrame, records: DataFrame, score: str, top: int = 3) -> DataFrame:
    """Quirks of names and addresses as written, against the query's and the list's best other targets.

    Names are compared by ratio, empty ones too. Addresses count where both are given: by ratio as written, by token sort of
    the street text against the query's, by token set against the siblings'. Equal names of siblings are counted (0 without
    siblings); first numbers that agree are averaged over the siblings where both sides have one.
    """
    store = records.select("entity_id", F.coalesce("name", F.lit("")).alias("raw_name"), F.coalesce("address", F.lit("")).alias("raw_addr"), T.street_text(F.col("address")).alias("street"), T.first_number(F.col("address")).alias("number"))
    ratio = lambda scorer, a, b: S.similarity(scorer, F.col(a), F.col(b), empty_is_null=False)
    own = sides(pairs.select("s1_id", "t_id"), store, ["raw_name", "raw_addr", "street"])
    given = (F.col("s_raw_addr") != "") & (F.col("t_raw_addr") != "")
    own = own.withColumns(
        {
            "raw_name_ratio_s1": ratio("ratio", "s_raw_name", "t_raw_name"),
            "raw_name_eq_s1": (F.col("s_raw_name") == F.col("t_raw_name")).cast("int"),
            "addr_raw_ratio_s1": F.when(given, ratio("ratio", "s_raw_addr", "t_raw_addr")),
            "street_sim_s1_exp": F.when(given, ratio("token_sort", "s_street", "t_street")),
        }
    )
    columns = ["raw_name", "raw_addr", "street", "number"]
    side = lambda name, letter: store.select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{letter}_{c}") for c in columns])
    sib = siblings(pairs, score, top).select("s1_id", "t_id", F.explode("siblings").alias("sib_id"))
    sib = sib.join(side("sib_id", "b"), "sib_id").join(side("t_id", "a"), "t_id")
    both = (F.col("a_raw_addr") != "") & (F.col("b_raw_addr") != "")
    numbers = (F.col("a_number") >= 0) & (F.col("b_number") >= 0)
    sib = sib.withColumns({"n": ratio("ratio", "a_raw_name", "b_raw_name"), "st": F.when(both, ratio("token_set", "a_street", "b_street"))})
    sums = sib.groupBy("s1_id", "t_id").agg(
        F.max("n").alias("raw_name_ratio_sib_max"),
        F.sum((F.col("a_raw_name") == F.col("b_raw_name")).cast("long")).alias("raw_name_eq_sib"),
        F.max("st").alias("street_sim_sib_max"),
        F.avg("st").alias("street_sim_sib_mean"),
        F.avg(F.when(numbers, (F.col("a_number") == F.col("b_number")).cast("double"))).alias("first_num_agree_sib"),
    )
    keep = ["s1_id", "t_id", "raw_name_ratio_s1", "raw_name_eq_s1", "addr_raw_ratio_s1", "street_sim_s1_exp"]
    return own.select(*keep).join(sums, ["s1_id", "t_id"], "left").withColumn("raw_name_eq_sib", F.coalesce("raw_name_eq_sib", F.lit(0)))


def address_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Token-set, token-sort and partial similarity of the normalised addresses without numbers."""
    store = records.select("entity_id", T.street_without_numbers(T.normalize_text(F.col("address"))).alias("street"))
    p = sides(pairs.select("s1_id", "t_id"), store, ["street"])
    scorers = ["token_set", "token_sort", "partial"]
    p = p.withColumn("__sim", S.similarities(scorers, F.col("s_street"), F.col("t_street"))).withColumns(S.scored("__", "__sim", scorers))
    return p.select("s1_id", "t_id", F.col("__token_set").alias("addr_tset"), F.col("__token_sort").alias("addr_tsort"), F.col("__partial").alias("addr_partial"))


def match_rules(exact: Column, suffix: Column, name: Column, addr: Column) -> dict[str, Column]:
    """Rules R1 to R5 over exact and suffix flags and token-set scores of names and addresses (0 to 1, null: not comparable).

    A missing address agrees in R2 and R3 and disagrees in R4; a missing name is never strong.
    """
    agrees = F.coalesce(addr, F.lit(1.0)) >= 0.8
    r2 = exact & agrees
    r4 = (F.coalesce(name, F.lit(0.0)) >= 0.9) & (F.coalesce(addr, F.lit(0.0)) >= 0.85)
    return {"R1": exact, "R2": r2, "R3": suffix & agrees, "R4": r4, "R5": r2 | r4}


def strata(digits_exact: Column, addr_token_set: Column, name_token_set: Column) -> dict[str, Column]:
    """Error strata of a pair: same address, strong name, both, and same address with a weak name."""
    name = F.coalesce(name_token_set, F.lit(0.0))
    same = (F.coalesce(digits_exact, F.lit(0)) == 1) & (F.coalesce(addr_token_set, F.lit(0.0)) >= 0.9)
    return {"same_address": same, "strong_name": name >= 0.9, "same_address_and_strong_name": same & (name >= 0.9), "same_address_weak_name": same & (name < 0.6)}


def number_store(records: DataFrame, text: str = "address") -> DataFrame:
    """(entity_id, raw, nums): distinct digit runs of a text, as written and without leading zeros."""
    return records.select("entity_id", F.array_distinct(T.digit_runs(F.col(text))).alias("raw"), T.record_digits(F.col(text), 1 << 30).alias("nums"))


def number_patterns(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """How the numbers of two records relate: equal, equal but for leading zeros, target a proper subset, one edit, otherwise different."""
    p = sides(pairs, store, ["raw", "nums"])
    equal = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    some = (F.size("s_raw") > 0) | (F.size("t_raw") > 0)
    same_raw, same = equal("s_raw", "t_raw"), equal("s_nums", "t_nums")
    subset = (F.size("t_nums") > 0) & (F.size(F.array_except("t_nums", "s_nums")) == 0) & (F.size(F.array_except("s_nums", "t_nums")) > 0)
    only_t = F.array_except("t_nums", "s_nums")
    edit = F.exists(F.array_except("s_nums", "t_nums"), lambda x: F.exists(only_t, lambda y: F.levenshtein(x, y) == 1))
    return p.select(
        "s1_id", "t_id",
        (some & same_raw).alias("digits_equal"),
        (some & ~same_raw & same).alias("digits_equal_after_leading_zero_strip"),
        subset.alias("digits_target_subset"),
        edit.alias("digits_one_edit_typo"),
        (some & ~same & ~subset & ~edit).alias("digits_other_mismatch"),
    )


def pair_features(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Text evidence of the first matcher: exact and fuzzy names and addresses, digits as words, missing fields.

    ``pairs`` may carry ``route_block``, which passes through: together they are the model's whole row.
    """
    p = sides(pairs, store, ["name", "address", "non_ascii"])
    joined = lambda c: F.array_join(T.digit_runs(F.col(c)), " ")
    p = p.withColumns({"s_nums": joined("s_address"), "t_nums": joined("t_address")})
    wanted = {"name": list(S.SCORERS), "address": ["ratio", "token_set", "partial"], "nums": ["token_set"]}
    for c, scorers in wanted.items():
        p = p.withColumn("__sim", S.similarities(scorers, F.col(f"s_{c}"), F.col(f"t_{c}"))).withColumns(S.scored(f"__{c}_", "__sim", scorers, 0.01)).drop("__sim")
    fuzzy = lambda scorer, c: F.col(f"__{c}_{scorer}")
    both = lambda c: (F.col(f"s_{c}") != "") & (F.col(f"t_{c}") != "")
    equal = lambda c: (F.col(f"s_{c}") == F.col(f"t_{c}")).cast("int")
    suffix = T.strip_legal_suffix(F.col("s_name")) == T.strip_legal_suffix(F.col("t_name"))
    out = p.withColumns(
        {
            "name_exact": ((F.col("s_name") != "") & (F.col("s_name") == F.col("t_name"))).cast("int"),
            "name_suffix_exact": ((F.col("s_name") != "") & suffix).cast("int"),
            "name_ratio": fuzzy("ratio", "name"),
            "name_token_sort": fuzzy("token_sort", "name"),
            "name_token_set": fuzzy("token_set", "name"),
            "name_partial": fuzzy("partial", "name"),
            "name_jaro_winkler": fuzzy("jaro_winkler", "name"),
            "name_len_ratio": F.when(both("name"), S.length_ratio(F.col("s_name"), F.col("t_name"))),
            "addr_exact": F.when(both("address"), equal("address")),
            "addr_ratio": fuzzy("ratio", "address"),
            "addr_token_set": fuzzy("token_set", "address"),
            "addr_partial": fuzzy("partial", "address"),
            "digits_exact": F.when(both("nums"), equal("nums")),
            "digits_token_set": fuzzy("token_set", "nums"),
            "s1_has_digits": (F.col("s_nums") != "").cast("int"),
            "tgt_has_digits": (F.col("t_nums") != "").cast("int"),
            "s1_addr_missing": (F.col("s_address") == "").cast("int"),
            "tgt_addr_missing": (F.col("t_address") == "").cast("int"),
            "tgt_name_missing": (F.col("t_name") == "").cast("int"),
            "non_ascii_any": (F.col("s_non_ascii") | F.col("t_non_ascii")).cast("int"),
        }
    )
    return out.drop(*[f"{side}_{c}" for side in "st" for c in ("name", "address", "non_ascii", "nums")], *[f"__{c}_{x}" for c, scorers in wanted.items() for x in scorers])


def token_substitutions(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b, n): words on one side only against words on the other only, where both have one or two of them."""
    plain = lambda c: F.filter(F.array_distinct(T.words(F.col(c))), lambda w: ~w.rlike(r"^\p{Nd}+$"))
    diff = pairs.select(F.array_except(plain(left), plain(right)).alias("x"), F.array_except(plain(right), plain(left)).alias("y"))
    few = diff.where(F.size("x").between(1, 2) & F.size("y").between(1, 2))
    return few.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def canonical_map(substitutions: DataFrame, least: int = 30, share: float = 0.5) -> DataFrame:
    """(token, canonical) of the tokens that change: a token joins its most frequent partner if that is frequent and dominant.

    Joined groups take the name of their smallest member. The links are the few frequent and dominant substitutions of a
    language, so their groups are found on the driver, by passing the smallest name along until nothing changes.
    """
    by = Window.partitionBy("a").orderBy(F.col("n").desc(), "b")
    best = substitutions.withColumns({"total": F.sum("n").over(Window.partitionBy("a")), "r": F.row_number().over(by)}).where(F.col("r") == 1)
    links = [(r.a, r.b) for r in best.where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("a", "b").collect()]
    name = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for x, y in links:
            low = min(name[x], name[y])
            if name[x] != low or name[y] != low:
                name[x] = name[y] = low
                changed = True
    rows = sorted((token, low) for token, low in name.items() if token != low)
    return substitutions.sparkSession.createDataFrame(rows, "token string, canonical string")


def feature_ranges(features: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_rows, missing_rate, low, high) of each column over all rows; null and NaN are missing."""
    stats = []
    for c in columns:
        value = F.col(c).cast("double")
        good = value.isNotNull() & ~F.isnan(value)
        seen = F.when(good, value)
        stats.append(F.struct(F.lit(c).alias("feature"), F.count("*").alias("n_rows"), F.avg((~F.coalesce(good, F.lit(False))).cast("double")).alias("missing_rate"), F.min(seen).alias("low"), F.max(seen).alias("high")))
    return features.agg(F.array(*stats).alias("rows")).select(F.inline("rows"))


def split_totals(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Integrity of the pairs by split: one row per split.

    ``entities``: s1_id, split, truth_len; ``pairs``: s1_id, t_id, label. Queries, pairs, positives, gold links, retrieved gold, queries without gold,
    the recall that the lists allow at most, pairs per query, and repeated pairs (which must be 0).
    """
    per = pairs.groupBy("s1_id", "t_id").agg(F.count("*").alias("times"), F.max(F.col("label").cast("long")).alias("label"))
    per = per.groupBy("s1_id").agg(F.sum("times").alias("pairs"), F.sum("label").alias("positive"), F.sum((F.col("times") > 1).cast("long")).alias("repeated"))
    e = entities.join(per, "s1_id", "left").fillna(0, ["pairs", "positive", "repeated"])
    sums = e.groupBy("split").agg(
        F.count("*").alias("s1"),
        F.sum("pairs").cast("long").alias("pairs"),
        F.sum("positive").cast("long").alias("positive_pairs"),
        F.sum("truth_len").cast("long").alias("truth_links"),
        F.sum((F.col("truth_len") == 0).cast("long")).alias("singletons"),
        F.sum("repeated").cast("long").alias("repeated_pairs"),
    )
    return sums.withColumns({"recall_ceiling": F.round(F.try_divide("positive_pairs", "truth_links"), 6), "mean_candidates": F.round(F.try_divide("pairs", "s1"), 6)})
