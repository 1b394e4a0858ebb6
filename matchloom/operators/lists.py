"""Candidate lists: union and rank fusion, ranks and cuts, list context.

A list is a frame of pairs (s1_id, t_id, …); ranks count from 0 and order by descending score, missing scores last, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST = "s1_id"


def search(bounds: Column, value: Column, steps: int) -> Column:
    """How many of the ascending ``bounds`` (at most 2^steps of them) are at most ``value``: a binary search inside an expression."""
    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = (state["low"] < state["high"]) & (F.get(bounds, middle) <= value)
        return F.struct(F.when(below, middle + 1).otherwise(state["low"]).alias("low"), F.when(below | (state["low"] >= state["high"]), state["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, halve)["low"]


def running_totals(sums: DataFrame, key: str, values: dict[str, str], descending: bool = False, runs: int = 1024) -> DataFrame:
    """Adds for each ``name: column`` the sum of ``column`` over all rows up to and including the row's ``key`` (distinct, not null).

    The keys are cut into runs at approximate quantiles, each run is summed, the runs' totals (at most ``runs`` rows) are
    added up, and a window inside each run does the rest: no task holds all keys.
    """
    cuts = sums.agg(F.percentile_approx(key, F.array(*[F.lit(i / runs) for i in range(1, runs)]), F.lit(20_000)).alias("cuts"))
    cuts = cuts.select(F.coalesce(F.array_sort(F.array_distinct("cuts")), F.array().cast(f"array<{dict(sums.dtypes)[key]}>")).alias("__cuts"))
    placed = sums.crossJoin(F.broadcast(cuts)).withColumn("__run", search(F.col("__cuts"), F.col(key), runs.bit_length())).drop("__cuts")
    order = F.col("__run").desc() if descending else F.col("__run").asc()
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__run").agg(*[F.sum(c).alias(f"__{n}") for n, c in values.items()])
    starts = totals.select(F.col("__run").alias("__of"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in values])
    own = F.col(key).desc() if descending else F.col(key).asc()
    within = Window.partitionBy("__run").orderBy(own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(F.broadcast(starts), F.col("__run") == F.col("__of"))
    return joined.withColumns({n: F.col(f"__before_{n}") + F.sum(c).over(within) for n, c in values.items()}).drop("__run", "__of", *[f"__before_{n}" for n in values])


def best_first(score: str, *ties: str) -> Window:
    return Window.partitionBy(LIST).orderBy(F.col(score).desc_nulls_last(), *(ties or ("t_id",)))


def ranked(pairs: DataFrame, score: str, name: str = "rank", *ties: str) -> DataFrame:
    return pairs.withColumn(name, F.row_number().over(best_first(score, *ties)) - 1)


def keep_top(pairs: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The first ``k`` rows of each list; Spark limits the window groups on both sides of the exchange."""
    return ranked(pairs, score, "__rank", *ties).where(F.col("__rank") < k).drop("__rank")


def restrict(pairs: DataFrame, entities: DataFrame, score: str, k: int, *ties: str) -> tuple[DataFrame, DataFrame]:
    """The lists cut to their first ``k`` rows (unscored rows last), and the entities with n_cand and retrieved_truth counted anew.

    ``retrieved_truth`` is recounted where all rows kept are labelled (0 or 1), and left alone otherwise; truth_len never changes.
    """
    kept = keep_top(pairs, score, k, *ties)
    per = kept.groupBy(LIST).agg(F.count("*").alias("__n"), F.sum((F.col("label") == 1).cast("long")).alias("__hits"))
    labelled = kept.agg(F.coalesce(F.min((F.col("label") >= 0).cast("int")), F.lit(1)).alias("__labelled"))
    counted = entities.join(per, LIST, "left").crossJoin(F.broadcast(labelled))
    kind = dict(entities.dtypes)
    again = {"n_cand": F.coalesce("__n", F.lit(0)).cast(kind.get("n_cand", "long"))}
    if "retrieved_truth" in kind:
        again["retrieved_truth"] = F.when(F.col("__labelled") == 1, F.coalesce("__hits", F.lit(0))).otherwise(F.col("retrieved_truth")).cast(kind["retrieved_truth"])
    return kept, counted.withColumns(again).drop("__n", "__hits", "__labelled")


def route_positions(candidates: DataFrame) -> DataFrame:
    """Position from 1 of each candidate in the merged two-source order of its route, by (-score, id)."""
    by = Window.partitionBy(LIST, "route").orderBy(F.col("score").desc_nulls_last(), "t_id")
    return candidates.withColumn("position", F.row_number().over(by))


def fuse(candidates: DataFrame, constant: int = 60, *more: Column, deal: bool = True) -> DataFrame:
    """Reciprocal rank fusion: (s1_id, t_id, route_bits, n_routes, rrf, rrf_rank), and ``more`` aggregates over a pair's rows.

    Candidates are dealt by their list once; positions, sums and ranks all need no more than that. Without ``deal`` they are
    taken as they come: ``candidates.all_routes`` has dealt them.
    """
    fused = (
        route_positions(candidates.repartition(LIST) if deal else candidates)
        .groupBy(LIST, "t_id")
        .agg(
            F.bit_or("bit").alias("route_bits"),
            F.count_distinct("route").alias("n_routes"),
            F.round(F.sum(1.0 / (constant + F.col("position"))), 9).alias("rrf"),
            *more,
        )
    )
    return ranked(fused, "rrf", "rrf_rank")


def route_evidence(candidates: DataFrame, routes: list[str], deal: bool = True) -> DataFrame:
    """``fuse`` plus score and rank of each route (null where the route lacks the pair) and the list's size."""
    wide = [F.max(F.when(F.col("route") == r, F.col("score"))).alias(f"score_{r}") for r in routes]
    wide += [F.min(F.when(F.col("route") == r, F.col("rank"))).alias(f"rank_{r}") for r in routes]
    return fuse(candidates, 60, *wide, deal=deal).withColumn("cand_count", F.count("*").over(Window.partitionBy(LIST)))


def ensemble(scores: list[DataFrame], name: str = "score") -> DataFrame:
    """Mean of several score columns by pair; null if any is missing."""
    joined = scores[0].select(LIST, "t_id", F.col(name).alias("x0"))
    for i, other in enumerate(scores[1:], 1):
        joined = joined.join(other.select(LIST, "t_id", F.col(name).alias(f"x{i}")), [LIST, "t_id"], "left")
    total = F.col("x0")
    for i in range(1, len(scores)):
        total = total + F.col(f"x{i}")
    return joined.select(LIST, "t_id", (total / len(scores)).alias(name))


def join_scores(pairs: DataFrame, scores: DataFrame, score: str, below_rank: int | None = None) -> DataFrame:
    """Scores by pair; rows at or above a source rank count as unscored."""
    source = scores if below_rank is None else scores.where(F.col("filter_rank") < below_rank)
    return pairs.join(source.select(LIST, "t_id", score), [LIST, "t_id"], "left")


def list_features(pairs: DataFrame, logit: str, p: str) -> DataFrame:
    """Rank, distance to the best (never above 0) and the number of rows with p of a half or more."""
    whole = Window.partitionBy(LIST)
    return ranked(pairs, logit, "logit_rank", "filter_rank", "t_id").withColumns(
        {
            "logit_gap": F.col(logit) - F.max(logit).over(whole),
            "n_p05": F.sum((F.col(p) >= 0.5).cast("long")).over(whole),
        }
    )


def joined_features(pairs: DataFrame, score: str, name: str) -> DataFrame:
    """Of a second model's scores: rank (unscored last) and the best finite score minus the own one (never below 0)."""
    whole = Window.partitionBy(LIST)
    return ranked(pairs, score, f"{name}_rank").withColumn(f"{name}_gap", F.max(score).over(whole) - F.col(score))


def list_aggregates(pairs: DataFrame, q: str) -> DataFrame:
    """Context of a probability: rank, gap to the best, best other, sum, counts at 0.5 and 0.9, mean of the others."""
    whole = Window.partitionBy(LIST)
    ordered = best_first(q)
    first = F.max(q).over(whole)
    second = F.nth_value(q, 2).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = F.count("*").over(whole)
    total = F.sum(q).over(whole)
    return pairs.withColumns(
        {
            "q_rank": F.row_number().over(ordered) - 1,
            "q_gap": first - F.col(q),
            "best_other": F.when(F.row_number().over(ordered) == 1, second).otherwise(first),
            "q_sum": total,
            "n_05": F.sum((F.col(q) >= 0.5).cast("long")).over(whole),
            "n_09": F.sum((F.col(q) >= 0.9).cast("long")).over(whole),
            "mean_other": F.when(n > 1, (total - F.col(q)) / (n - 1)),
        }
    )


def listwise(pairs: DataFrame, score: str, deltas: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Eighteen list-relative features of one score, and its rank from 0 (null where unscored).

    The list's statistics come from one aggregation joined back; ``within`` counts the list's scores that close to its best.
    """
    stats = pairs.where(F.col(score).isNotNull()).groupBy(LIST).agg(
        F.count("*").alias("cnt"),
        F.min(score).alias("s_min"),
        F.max(score).alias("s_max"),
        F.avg(score).alias("s_mean"),
        F.percentile(score, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("qs"),
        F.stddev_pop(score).alias("s_std"),
        F.sort_array(F.collect_list(score), asc=False).alias("every"),
    )
    shifted = F.transform("every", lambda v: v - F.col("s_max"))
    stats = stats.withColumn("z_sum", F.aggregate(F.transform(shifted, F.exp), F.lit(0.0), lambda s, v: s + v))
    weighted = F.aggregate(F.transform(shifted, lambda v: F.exp(v) * v), F.lit(0.0), lambda s, v: s + v)

    def near(distance: float) -> Column:
        return F.size(F.filter("every", lambda v: v >= F.col("s_max") - distance))

    stats = stats.withColumns(
        {
            "entropy": F.log("z_sum") - weighted / F.col("z_sum"),
            "median": F.col("qs")[0],
            "q25": F.col("qs")[1],
            "q75": F.col("qs")[2],
            **{f"top{i}": F.get("every", F.lit(i - 1)) for i in (1, 2, 3)},
            **{f"within{i}": near(d) for i, d in enumerate(deltas, 1)},
        }
    ).drop("qs", "every")
    x = F.col(score)
    columns = {
        "z": F.try_divide(x - F.col("s_mean"), F.col("s_std")),
        "robust_z": F.try_divide(x - F.col("median"), F.col("q75") - F.col("q25")),
        **{f"gap{i}": F.col(f"top{i}") - x for i in (1, 2, 3)},
        "softmax": F.exp(x - F.col("s_max")) / F.col("z_sum"),
        "s_rank": F.when(x.isNotNull(), F.row_number().over(best_first(score)) - 1),
    }
    return pairs.join(stats, LIST, "left").withColumns(columns).drop("z_sum", "top1", "top2", "top3")


def rank_differences(pairs: DataFrame, scores: list[str]) -> DataFrame:
    """Absolute differences between the ranks of several scores, two by two; null where either is missing."""
    ranks = {s: F.when(F.col(s).isNotNull(), F.row_number().over(best_first(s)) - 1) for s in scores}
    rows = pairs.withColumns({f"__rank_{s}": r for s, r in ranks.items()})
    two = [(a, b) for i, a in enumerate(scores) for b in scores[i + 1 :]]
    return rows.withColumns({f"rankdiff_{a}_{b}": F.abs(F.col(f"__rank_{a}") - F.col(f"__rank_{b}")) for a, b in two}).drop(*[f"__rank_{s}" for s in scores])


def siblings(pairs: DataFrame, score: str, top: int = 3) -> DataFrame:
    """(s1_id, t_id, siblings): the list's best other targets, at most ``top``. Lists are cut to top + 1 before they are collected."""
    heads = keep_top(pairs, score, top + 1)
    lists = heads.groupBy(LIST).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce(F.col(score), F.lit(-1e300))).alias("s"), "t_id"))), lambda x: x["t_id"]).alias("heads"))
    return pairs.select(LIST, "t_id").join(lists, LIST).select(LIST, "t_id", F.slice(F.filter("heads", lambda x: x != F.col("t_id")), 1, top).alias("siblings"))


def reverse_competition(dense: DataFrame) -> DataFrame:
    """Per dense row: the best score any other query has with the target, the margin, how many others list it, and whether it is on top."""
    target = Window.partitionBy("t_id")
    by = target.orderBy(F.col("dense_score").desc(), "s1_id")
    frame = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first("dense_score").over(frame), F.nth_value("dense_score", 2).over(frame)
    other = F.when(F.first("s1_id").over(frame) == F.col("s1_id"), second).otherwise(best)
    return dense.withColumn("rev_best_other", other).withColumns(
        {
            "rev_margin": F.col("dense_score") - F.col("rev_best_other"),
            "rev_count_other": F.count("*").over(target) - 1,
            "rev_is_top": (F.col("rev_best_other").isNull() | (F.col("dense_score") >= F.col("rev_best_other"))).cast("int"),
        }
    )


def choose_cut(pairs: DataFrame, score: str, target: float = 0.998, most: int = 10) -> DataFrame:
    """One row: smallest cut that keeps at least ``target`` of the listed positives (``most`` if none does)."""
    counts = ranked(pairs, score, "r").where(F.col("label") == 1).groupBy(F.least("r", F.lit(most)).alias("r")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("r")
    share = counts.withColumn("kept", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy()))
    return share.agg(F.least(F.coalesce(F.min(F.when((F.col("kept") >= target) & (F.col("r") < most), F.col("r") + 1)), F.lit(most)), F.lit(most)).cast("int").alias("n_keep"))


def budgeted_k(pairs: DataFrame, score: str, budget: int) -> DataFrame:
    """One row: the largest K whose lists, cut at K, hold at most ``budget`` rows in all."""
    counts = ranked(pairs, score, "r").groupBy("r").agg(F.count("*").alias("n"))
    running = counts.withColumn("total", F.sum("n").over(Window.orderBy("r")))
    return running.agg(F.coalesce(F.max(F.when(F.col("total") <= budget, F.col("r") + 1)), F.lit(0)).cast("int").alias("k"))


def shared_space(pairs: DataFrame, score: str, key: Column) -> DataFrame:
    """Co-located candidates: within a list, those with the same non-null key: how many others, own rank, best other score."""
    keyed = pairs.withColumn("__key", key)
    block = Window.partitionBy(LIST, "__key")
    by = block.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), "t_id")
    frame = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.coalesce(F.col(score), F.lit(0.0))
    keyed = keyed.withColumns(
        {
            "same_key": F.count("*").over(block) - 1,
            "same_key_rank": F.row_number().over(by) - 1,
            "same_key_best_other": F.when(F.row_number().over(by) == 1, F.nth_value(value, 2).over(frame)).otherwise(F.first(value).over(frame)),
        }
    )
    known = F.col("__key").isNotNull()
    return keyed.withColumns({c: F.when(known, F.col(c)) for c in ("same_key", "same_key_rank", "same_key_best_other")}).drop("__key")


def filter_context(pairs: DataFrame, score: str = "filter_score", rank: str = "filter_rank", strong: float = 0.5) -> DataFrame:
    """A filter's list context: rank fraction, gap and ratio to the best, strong rows, list size and S3 rows.

    With the columns t_name_tokens and t_digits also the shares of them that the list's best target has.
    """
    whole = Window.partitionBy(LIST)
    n, best = F.count("*").over(whole), F.max(score).over(whole)
    out = pairs.withColumns(
        {
            "filter_rank_frac": F.col(rank) / n,
            "filter_gap_to_top": best - F.col(score),
            "filter_score_frac": F.try_divide(F.col(score), best),
            "list_n_strong": F.sum((F.col(score) >= strong).cast("long")).over(whole),
            "list_size": n,
            "list_n_s3": F.sum(F.col("t_id").startswith("S3-").cast("long")).over(whole),
        }
    )
    if "t_name_tokens" not in pairs.columns:
        return out
    frame = best_first(score).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def shared(column: str) -> Column:
        common = F.size(F.array_intersect(column, F.first(column).over(frame))).cast("double")
        return F.try_divide(common, F.size(column).cast("double"))

    return out.withColumns({"top1_name_overlap": shared("t_name_tokens"), "top1_digits_overlap": shared("t_digits")})
