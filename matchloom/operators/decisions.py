"""Decisions over scored pairs and their entity-level metrics.

Pairs: s1_id, t_id, score, label (0/1). Entities: s1_id, truth_len (gold matches, including those that no list holds). Metrics
always start from the entities, so queries without rows count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .lists import running_totals

# Fixed values of the decision rules: the threshold that predicts nothing, the ratios and guards that are tried, the one-owner window around a threshold.
NOTHING = 2.0
RATIOS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
GUARD_QUANTILES = 401
OWNER_STEPS = tuple(round(-0.2 + 0.01 * i, 2) for i in range(41))
LIST = "s1_id"


def f05(tp: Column, k: Column, truth: Column) -> Column:
    """F0.5 = 1.25 tp / (k + 0.25 truth); an entity without gold scores 1 exactly when nothing is predicted."""
    value = F.when(tp > 0, 1.25 * tp / (k + 0.25 * truth)).otherwise(0.0)
    return F.when(truth == 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(value).cast("double")


def fbeta(tp: Column, k: Column, truth: Column, beta: float) -> Column:
    b = beta * beta
    value = F.when(tp > 0, (1 + b) * tp / (k + b * truth)).otherwise(0.0)
    return F.when(truth == 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(value).cast("double")


def entity_f05(entities: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, truth_len, k, tp, f05) of every entity."""
    counts = predicted.groupBy(LIST).agg(F.count("*").alias("k"), F.sum(F.col("label").cast("long")).alias("tp"))
    joined = entities.join(counts, LIST, "left").withColumns({"k": F.coalesce("k", F.lit(0)), "tp": F.coalesce("tp", F.lit(0))})
    return joined.withColumn("f05", f05(F.col("tp"), F.col("k"), F.col("truth_len")))


def macro_report(per_entity: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, mean precision where something is predicted, mean recall where there is gold, singleton accuracy."""
    k, tp, truth = F.col("k"), F.col("tp"), F.col("truth_len")
    return per_entity.groupBy(*by).agg(
        F.count("*").alias("s1"),
        F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.round(F.avg(F.when(k > 0, tp / k)), 6).alias("mean_precision"),
        F.round(F.avg(F.when(truth > 0, tp / truth)), 6).alias("mean_recall"),
        F.round(F.avg(F.when(truth == 0, (k == 0).cast("double"))), 6).alias("singleton_accuracy"),
        F.round(F.avg((k > 0).cast("double")), 6).alias("predicted_nonempty_rate"),
        F.sum(k).cast("long").alias("predicted_pairs"),
        F.sum(tp).cast("long").alias("true_positive_pairs"),
    )


def oracle_f05(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ceiling: every listed gold pair predicted and nothing else."""
    return entity_f05(entities, pairs.where(F.col("label") == 1))


def _steps(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (s1_id, t_id, score, label, …) with ``delta``: how much the F0.5 of its query changes when the row joins, in descending score."""
    by = Window.partitionBy(LIST).orderBy(F.col("score").desc(), "t_id")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pairs.join(entities.select(LIST, "truth_len"), LIST).withColumns({"k": F.row_number().over(by), "tp": F.sum(F.col("label").cast("long")).over(upto)})
    rows = rows.withColumn("f", f05(F.col("tp"), F.col("k"), F.col("truth_len")))
    before = F.coalesce(F.lag("f").over(by), F.when(F.col("truth_len") == 0, 1.0).otherwise(0.0))
    return rows.withColumn("delta", F.col("f") - before).drop("truth_len", "k", "tp", "f")


def _base(entities: DataFrame) -> DataFrame:
    """One row: the sum of F0.5 where nothing is predicted, and the number of entities."""
    return entities.agg(F.sum((F.col("truth_len") == 0).cast("double")).alias("base"), F.count("*").alias("n"))


def sweep(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(threshold, macro_f05) at every distinct score: exact, by telescoping differences.

    Within an entity rows join in descending score; each row carries the change of its entity's F0.5. Summed over all
    rows in descending score, the differences telescope to the macro F0.5 of "predict score >= threshold". The sums per
    distinct score are added up run by run (``running_totals``), so no task holds them all.
    """
    steps = _steps(entities, pairs).groupBy("score").agg(F.sum("delta").alias("delta"))
    base = _base(entities)
    curve = running_totals(steps, "score", {"total": "delta"}, descending=True).crossJoin(F.broadcast(base))
    curve = curve.select(F.col("score").alias("threshold"), F.round((F.col("base") + F.col("total")) / F.col("n"), 9).alias("macro_f05"))
    return curve.unionByName(base.select(F.lit(NOTHING).alias("threshold"), F.round(F.col("base") / F.col("n"), 9).alias("macro_f05")))


def best_threshold(curve: DataFrame, cap: float | None = None) -> DataFrame:
    """The row with the highest macro F0.5; ties go to the higher threshold. ``cap`` limits thresholds (but "nothing")."""
    if cap is not None:
        curve = curve.where((F.col("threshold") <= cap) | (F.col("threshold") == NOTHING))
    best = F.max(F.struct("macro_f05", "threshold"))
    return curve.agg(best.alias("b")).select("b.threshold", "b.macro_f05")


def grid_sweep(entities: DataFrame, pairs: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """Macro F0.5 of each (t, t_empty): a row counts from t on, and only in lists whose best reaches t_empty."""
    spark = pairs.sparkSession
    settings = spark.createDataFrame([(float(a), float(b)) for a, b in grid], "t double, t_empty double")
    top = pairs.withColumn("top", F.max("score").over(Window.partitionBy(LIST)))
    chosen = top.join(F.broadcast(settings), (F.col("score") >= F.col("t")) & (F.col("top") >= F.col("t_empty")))
    counts = chosen.groupBy("t", "t_empty", LIST).agg(F.count("*").alias("k"), F.sum(F.col("label").cast("long")).alias("tp"))
    gain = counts.join(entities, LIST).withColumn("gain", f05(F.col("tp"), F.col("k"), F.col("truth_len")) - F.when(F.col("truth_len") == 0, 1.0).otherwise(0.0))
    sums = gain.groupBy("t", "t_empty").agg(F.sum("gain").alias("gain"))
    base = entities.agg(F.sum((F.col("truth_len") == 0).cast("double")).alias("base"), F.count("*").alias("n"))
    out = settings.join(sums, ["t", "t_empty"], "left").crossJoin(F.broadcast(base))
    return out.select("t", "t_empty", F.round((F.col("base") + F.coalesce("gain", F.lit(0.0))) / F.col("n"), 9).alias("macro_f05"))


def apply_policy(pairs: DataFrame, family: str, t: float, t_empty: float = 0.0, r: float = 0.0) -> DataFrame:
    """Predicted rows under a policy: threshold, empty_guard (list best >= t_empty) or relative (score >= r x list best)."""
    best = F.max("score").over(Window.partitionBy(LIST))
    rows = pairs.withColumn("__best", best).where(F.col("score") >= t)
    if family == "empty_guard":
        rows = rows.where(F.col("__best") >= t_empty)
    elif family == "relative":
        rows = rows.where(F.col("score") >= r * F.col("__best"))
    elif family != "threshold":
        raise ValueError(f"unknown policy family {family}")
    return rows.drop("__best")


def claims(pairs: DataFrame, *ties: Column) -> DataFrame:
    """Adds ``claim``: 1 for the best claim on each target (score, then the given ties, then s1_id)."""
    by = Window.partitionBy("t_id").orderBy(F.col("score").desc(), *ties, F.col(LIST))
    return pairs.withColumn("claim", F.row_number().over(by))


def one_owner(pairs: DataFrame, *ties: Column) -> DataFrame:
    """Each target keeps only its best claim."""
    return claims(pairs, *ties).where(F.col("claim") == 1).drop("claim")


def owner_stats(pairs: DataFrame, *ties: Column) -> DataFrame:
    """One row: claims, targets in conflict, dropped claims, and how many of those were right and wrong."""
    lost = F.col("claim") > 1
    return claims(pairs, *ties).agg(
        F.count("*").alias("claims"),
        F.count_distinct(F.when(lost, F.col("t_id"))).alias("targets_in_conflict"),
        F.coalesce(F.sum(lost.cast("long")), F.lit(0)).alias("claims_dropped"),
        F.coalesce(F.sum((lost & (F.col("label") == 1)).cast("long")), F.lit(0)).alias("dropped_true"),
        F.coalesce(F.sum((lost & (F.col("label") == 0)).cast("long")), F.lit(0)).alias("dropped_false"),
    )


def country_rule(pairs: DataFrame, accepted: DataFrame, country: str, t: float, t_country: float | None = None, t_empty: float | None = None) -> DataFrame:
    """Rows above their own threshold: ``t``, or ``t_country`` in one country.

    There the top row of a list without any accepted row (``accepted``: s1_id, t_id) may also come in at ``t_empty``.
    """
    by = Window.partitionBy(LIST).orderBy(F.col("score").desc(), "t_id")
    has = accepted.select(LIST).distinct().withColumn("__has", F.lit(True))
    inside = F.col("country") == country
    limit = F.when(inside, F.lit(t if t_country is None else t_country)).otherwise(F.lit(t))
    if t_empty is not None:
        limit = F.when(inside & (F.col("__r") == 1) & F.col("__has").isNull(), F.least(limit, F.lit(t_empty))).otherwise(limit)
    rows = pairs.withColumn("__r", F.row_number().over(by)).join(has, LIST, "left").withColumn("__limit", limit)
    return rows.where(F.col("score") >= F.col("__limit")).drop("__r", "__has", "__limit")


def pair_auc(pairs: DataFrame) -> DataFrame:
    """One row: ROC AUC by counts per distinct score (ties count a half)."""
    by_score = pairs.groupBy("score").agg(F.sum((F.col("label") == 1).cast("double")).alias("p"), F.sum((F.col("label") == 0).cast("double")).alias("n"))
    parts = running_totals(by_score, "score", {"upto": "n"}).withColumn("wins", F.col("p") * (F.col("upto") - F.col("n") / 2))
    return parts.agg(F.round(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n")), 9).alias("auc"))


@dataclass(frozen=True)
class Policy:
    """A decision rule: its family and parameters (t_empty and r count in their own family only), one owner or not, and how it did."""

    family: str
    t: float
    t_empty: float
    r: float
    one_owner: bool
    macro_f05: float

    @property
    def complexity(self) -> int:
        return int(self.family != "threshold") + int(self.one_owner)

    def apply(self, pairs: DataFrame, *ties: Column) -> DataFrame:
        rows = apply_policy(pairs, self.family, self.t, self.t_empty, self.r)
        return one_owner(rows, *ties) if self.one_owner else rows


def _best_setting(steps: DataFrame, base: DataFrame, of_row: Column, capped: bool) -> tuple[float, float, float]:
    """(setting, threshold, macro F0.5) of the best setting; ``of_row``: the ascending settings under which a row can be predicted.

    One running total per setting over its distinct scores. Ties go to the higher threshold, then to the lower setting; ``capped``: a
    threshold may not exceed its setting.
    """
    sums = steps.select(F.explode(of_row).alias("setting"), "score", "delta").groupBy("setting", "score").agg(F.sum("delta").alias("delta"))
    running = Window.partitionBy("setting").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = sums.withColumn("total", F.sum("delta").over(running))
    if capped:
        curve = curve.where(F.col("score") <= F.col("setting"))
    values = curve.crossJoin(F.broadcast(base)).withColumn("macro_f05", F.round((F.col("base") + F.col("total")) / F.col("n"), 9))
    per = values.groupBy("setting").agg(F.max(F.struct("macro_f05", "score")).alias("b"))
    best = per.agg(F.max(F.struct(F.col("b.macro_f05").alias("macro_f05"), (-F.col("setting")).alias("minus"), F.col("b.score").alias("score"))).alias("b")).first()["b"]
    nothing = base.select(F.round(F.col("base") / F.col("n"), 9)).first()[0]
    if best is None or best["macro_f05"] < nothing:
        return NOTHING, NOTHING, nothing
    return -best["minus"], best["score"], best["macro_f05"]


def tune_policies(entities: DataFrame, pairs: DataFrame, *ties: Column) -> list[Policy]:
    """The best policy of each family, and each of them again with one owner a target; exact sweeps throughout.

    A list's rows join in descending score, and under a guard (the list's best reaches ``t_empty``) or a ratio (a row reaches r
    times its list's best) a list keeps a prefix of them. So a row's change of F0.5 is the same under every setting, and all
    settings are tried by sums of the same changes: guards are 401 quantiles of the lists' best scores, ratios are ``RATIOS``.
    With one owner a target's best claim among the rows that the family lets through is its owner at every threshold, so
    the changes are taken over the owners' rows, and the thresholds around the family's own are compared.
    """
    base = materialise(_base(entities), "policy-base")
    best = F.max("score").over(Window.partitionBy(LIST))
    steps = materialise(_steps(entities, pairs).withColumn("best", best), "policy-steps")
    found = best_threshold(sweep(entities, pairs)).first()
    out = [Policy("threshold", found["threshold"], 0.0, 0.0, False, found["macro_f05"])]

    levels = F.array(*[F.lit(i / (GUARD_QUANTILES - 1)) for i in range(GUARD_QUANTILES)])
    guards = steps.groupBy(LIST).agg(F.max("score").alias("m")).agg(F.percentile("m", levels).alias("q")).first()["q"] or []
    guards = sorted({round(g, 9) for g in guards})
    lets = F.filter(F.array(*[F.lit(g) for g in guards]) if guards else F.array().cast("array<double>"), lambda g: F.col("best") >= g)
    setting, t, value = _best_setting(steps, base, lets, capped=True)
    out.append(Policy("empty_guard", t, setting, 0.0, False, value))

    lets = F.filter(F.array(*[F.lit(r) for r in RATIOS]), lambda r: F.col("score") >= r * F.col("best"))
    setting, t, value = _best_setting(steps, base, lets, capped=False)
    out.append(Policy("relative", t, 0.0, 0.0 if setting == NOTHING else setting, False, value))
    return out + [_tune_owner(entities, pairs, base, p, ties) for p in list(out)]


def _tune_owner(entities: DataFrame, pairs: DataFrame, base: DataFrame, policy: Policy, ties: tuple[Column, ...]) -> Policy:
    """The policy with one owner a target, at the best threshold near its own (ties go to the higher one)."""
    grid = sorted({policy.t, *(round(min(1.0, max(0.0, policy.t + d)), 9) for d in OWNER_STEPS)}, reverse=True)
    if policy.family == "empty_guard":
        grid = [t for t in grid if t <= policy.t_empty] or grid[-1:]
    eligible = apply_policy(pairs, policy.family, float("-inf"), policy.t_empty, policy.r)
    steps = _steps(entities, one_owner(eligible, *ties))
    sums = steps.agg(*[F.coalesce(F.sum(F.when(F.col("score") >= t, F.col("delta"))), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(grid)])
    row = sums.crossJoin(F.broadcast(base)).first()
    values = [round((row["base"] + row[f"t{i}"]) / row["n"], 9) for i in range(len(grid))]
    at = max(range(len(grid)), key=lambda i: (values[i], -i))
    return Policy(policy.family, grid[at], policy.t_empty, policy.r, True, values[at])


def choose_policy(policies: list[Policy], tolerance: float = 1e-5) -> Policy:
    """The simplest policy within ``tolerance`` of the best; among equally simple ones the better one."""
    best = max(p.macro_f05 for p in policies)
    return min((p for p in policies if p.macro_f05 >= best - tolerance), key=lambda p: (p.complexity, -p.macro_f05))


def top1_hit(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: share of entities with gold whose first row is right."""
    by = Window.partitionBy(LIST).orderBy(F.col("score").desc(), "t_id")
    first = pairs.withColumn("r", F.row_number().over(by)).where(F.col("r") == 1).select(LIST, "label")
    joined = entities.where(F.col("truth_len") > 0).join(first, LIST, "left")
    return joined.agg(F.count("*").alias("with_truth"), F.round(F.avg(F.coalesce(F.col("label"), F.lit(0)).cast("double")), 9).alias("top1_hit"))


def expected_f_sizes(pairs: DataFrame, width: int = 10, extra_missed: float = 0.0) -> DataFrame:
    """(s1_id, k_star): the prefix length of the list that maximises the expected F0.5 under independent probabilities.

    ``extra_missed``: expected gold links outside the list, which lower the recall of every non-empty prefix.

    The numbers of hits inside and outside the prefix are Poisson-binomial; their distributions are folded with
    ``aggregate``, one array per list, in JVM expressions only.
    """
    lists = pairs.groupBy(LIST).agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, width).alias("p"))

    def distribution(p: Column) -> Column:
        def more(d: Column, q: Column) -> Column:
            return F.zip_with(F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d), lambda stay, step: stay * (1 - q) + step * q)

        return F.aggregate(p, F.array(F.lit(1.0)), more)

    def expected(k: Column) -> Column:
        inside = distribution(F.slice("p", 1, k))
        outside = distribution(F.slice("p", k + 1, F.lit(width)))

        def value(a: Column, b: Column) -> Column:
            return F.when(k == 0, ((a == 0) & (b == 0)).cast("double")).when(a > 0, 1.25 * a / (1.25 * a + 0.25 * (b + extra_missed) + (k - a))).otherwise(F.lit(0.0))

        over_b = lambda a, pa: F.aggregate(F.transform(outside, lambda pb, b: pa * pb * value(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
        return F.aggregate(F.transform(inside, lambda pa, a: over_b(a, pa)), F.lit(0.0), lambda s, v: s + v)

    scored = F.transform(F.sequence(F.lit(0), F.size("p")), lambda k: F.struct(F.round(expected(k), 9).alias("e"), (-k).alias("minus")))
    best = F.array_max(scored)
    return lists.select(LIST, (-best["minus"]).cast("int").alias("k_star"), best["e"].alias("expected_f05"))


def decide_expected_f(pairs: DataFrame, width: int = 10, extra_missed: float = 0.0) -> DataFrame:
    by = Window.partitionBy(LIST).orderBy(F.col("score").desc(), "t_id")
    sizes = expected_f_sizes(pairs, width, extra_missed).select(LIST, "k_star")
    return pairs.withColumn("__r", F.row_number().over(by)).join(sizes, LIST).where(F.col("__r") <= F.col("k_star")).drop("__r", "k_star")


def paired_bootstrap(a: DataFrame, b: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """One row: mean difference of per-entity F0.5 and its 95 % interval.

    Poisson bootstrap: every entity enters draw d with a Poisson(1) weight from a seeded digest, so a draw is a weighted sum
    over the distributed rows; nothing but the draws' sums meets in one place.
    """
    diff = a.select(LIST, F.col("f05").alias("x")).join(b.select(LIST, F.col("f05").alias("y")), LIST).select(LIST, (F.col("x") - F.col("y")).alias("d"))
    limits = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(8)]  # beyond each, a Poisson(1) weight is one larger
    key = F.md5(F.concat_ws(":", F.col(LIST), F.col("draw"), F.lit(seed)).cast("binary"))
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / float(1 << 32)
    weight = sum((u > F.lit(x)).cast("int") for x in limits)
    drawn = diff.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    limits_row = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return diff.agg(F.avg("d").alias("mean_diff")).crossJoin(limits_row).select("mean_diff", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def error_budget(entities: DataFrame, pairs: DataFrame, wrong: dict[str, Column], missed: dict[str, Column]) -> DataFrame:
    """(error, n, gain): macro F0.5 gained if one class of errors were repaired.

    ``pairs``: s1_id, score, label, predicted and the columns that the classes use. ``wrong`` classes of wrong predictions may
    overlap, with the rest in wrong_other; ``missed`` classes of listed gold that was not predicted are tried in order,
    each row counts in the first, the rest in missed_other. wrong_singleton counts the entities without gold that have wrong rows;
    dropped_by_filter is gold that was retrieved but is in no list, where the entities tell (retrieved_truth), and never_retrieved the
    gold that was not retrieved. One pass: counts per entity and class, then one average per class.
    """
    bad = F.col("predicted") & (F.col("label") == 0)
    lost = ~F.col("predicted") & (F.col("label") == 1)
    flags = {f"wrong_{k}": bad & F.coalesce(c, F.lit(False)) for k, c in wrong.items()}
    none = F.lit(True)
    for c in flags.values():
        none = none & ~c
    flags["wrong_other"] = bad & none
    rest = lost
    for k, c in missed.items():
        hit = F.coalesce(c, F.lit(False))
        flags[f"missed_{k}"] = rest & hit
        rest = rest & ~hit
    flags["missed_other"] = rest
    per = pairs.groupBy(LIST).agg(
        F.sum(F.col("predicted").cast("long")).alias("k"),
        F.sum((F.col("predicted") & (F.col("label") == 1)).cast("long")).alias("tp"),
        F.sum((F.col("label") == 1).cast("long")).alias("listed"),
        F.sum(bad.cast("long")).alias("bad"),
        *[F.sum(c.cast("long")).alias(name) for name, c in flags.items()],
    )
    e = entities.join(per, LIST, "left").fillna(0)
    k, tp, truth = F.col("k"), F.col("tp"), F.col("truth_len")
    base = f05(tp, k, truth)
    classes = {name: (F.col(name), f05(tp, k - F.col(name), truth) if name.startswith("wrong") else f05(tp + F.col(name), k + F.col(name), truth)) for name in flags}
    single = F.when(truth == 0, F.col("bad")).otherwise(F.lit(0))
    retrieved = F.col("retrieved_truth") if "retrieved_truth" in entities.columns else F.col("listed")
    dropped, never = retrieved - F.col("listed"), truth - retrieved
    classes["wrong_singleton"] = ((single > 0).cast("long"), f05(tp, k - single, truth))
    classes["dropped_by_filter"] = (dropped, f05(tp + dropped, k + dropped, truth))
    classes["never_retrieved"] = (never, f05(tp + never, k + never, truth))
    rows = F.array(*[F.struct(F.lit(name).alias("error"), n.cast("long").alias("n"), (value - base).alias("gain")) for name, (n, value) in classes.items()])
    return e.select(F.inline(rows)).groupBy("error").agg(F.sum("n").alias("n"), F.round(F.avg("gain"), 6).alias("gain"))


def error_classes() -> tuple[dict[str, Column], dict[str, Column]]:
    """The matcher's classes, over the columns of ``features.cheap_features`` and ``canonical_features`` and the flag ``owned``."""
    same = (F.col("digits_all_s1_in_tgt") == 1) & (F.coalesce("addr_overlap_frac", F.lit(0.0)) >= 0.8)
    idf = F.coalesce("name_idf_frac", F.lit(0.0))
    wrong = {"same_address_owned": same & F.col("owned"), "same_address_unowned": same & ~F.col("owned"), "other_address_strong_name": ~same & (idf >= 0.8)}
    missed = {
        "script": F.col("script_differs") == 1,
        "address_missing": F.col("tgt_addr_missing") == 1,
        "digit_typo": F.col("digit_typo") == 1,
        "digit_dropped": (F.col("digits_tgt_in_s1") == 1) & (F.col("digits_all_s1_in_tgt") == 0),
        "digit_other": (F.col("digits_s1_n") > 0) & (F.col("digits_all_s1_in_tgt") == 0),
        "weak_name": idf < 0.3,
    }
    return wrong, missed


def adoption_gate(gain: float, low: float, slice_changes: dict[str, float], least_gain: float = 0.002, most_drop: float = 0.005) -> dict[str, bool]:
    """Whether a challenger may replace a champion: gain in macro F0.5, lower end of its interval, worst change of a slice."""
    checks = {"gain": gain >= least_gain, "interval_above_zero": low > 0, "no_slice_drops": min(slice_changes.values(), default=0.0) >= -most_drop}
    return {**checks, "passed": all(checks.values())}


def retrieval_gate(observed: dict, pilot: dict, limits: dict, slices: dict[str, tuple[float | None, float | None]] | None = None) -> dict[str, bool]:
    """Acceptance of a retrieval run against a pilot: link recall, queries with every match (per cent), 95th percentile of list sizes, slices.

    ``limits``: recall_drop and every_match_drop in percentage points, p95, slice_drop; a slice (observed, expected) that either lacks is passed over.
    """
    checks = {
        "link_recall": observed["link_recall"] >= pilot["link_recall"] - limits["recall_drop"] / 100,
        "every_match": observed["every_match_pct"] >= pilot["every_match_pct"] - limits["every_match_drop"],
        "p95": observed["p95"] <= limits["p95"],
    }
    known = [(a, b) for a, b in (slices or {}).values() if a is not None and b is not None]
    if slices:
        checks["no_slice_drops"] = all(100 * (a - b) >= -limits["slice_drop"] for a, b in known)
    return {**checks, "passed": all(checks.values())}


def platform_gate(observed: dict, expected: dict, limits: dict) -> dict[str, float | bool]:
    """How far a rerun on another machine is from the first run (near ties may swap targets at a cut), and whether that is within the limits."""
    out = {
        "links": abs(observed["links"] - expected["links"]),
        "every_match_pct": abs(observed["every_match_pct"] - expected["every_match_pct"]),
        "total": abs(observed["total"] - expected["total"]) / expected["total"],
        "equal_percentiles": all(observed[k] == expected[k] for k in ("median", "p95", "p99", "max")),
    }
    inside = all(out[k] <= limits[k] for k in ("links", "every_match_pct", "total"))
    return {**out, "within": inside and (out["equal_percentiles"] or not limits.get("equal_percentiles", True))}


def check_scores(scores: DataFrame, pairs: DataFrame, score: str) -> None:
    """Raise unless there is one finite score for every pair and none for anything else."""
    by = [LIST, "t_id"]
    bad = scores.where(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))
    if not bad.isEmpty():
        raise ValueError(f"{score}: scores that are not finite")
    if not scores.groupBy(*by).count().where("count > 1").isEmpty():
        raise ValueError(f"{score}: a pair has several scores")
    if not pairs.join(scores, by, "left_anti").isEmpty() or not scores.join(pairs, by, "left_anti").isEmpty():
        raise ValueError(f"{score}: scores and pairs differ")
