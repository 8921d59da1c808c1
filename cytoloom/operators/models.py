"""Statistical models: O144 to O162. Small dense problems, one a feature or context, in numpy inside applyInPandas; the rest are aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import PATIENTS, query
from ..sources.scratch import kept
from .aggregates import average_rank, ranks


def logit(x: np.ndarray, y: np.ndarray, l2: float = 0.0, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (intercept first), their covariance and the log likelihood, by Newton's method."""
    x = np.column_stack([np.ones(len(y)), x])
    w = np.ones(len(y)) if weight is None else weight
    b, ridge = np.zeros(x.shape[1]), l2 * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return b, np.linalg.inv(h), float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def cox(x: np.ndarray, time: np.ndarray, event: np.ndarray, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Proportional hazards with Efron ties: coefficients, covariance and partial log likelihood."""
    o = np.argsort(-time, kind="stable")
    x, time, event = x[o], time[o], event[o].astype(bool)
    d = np.flatnonzero(event)
    last = np.searchsorted(-time, -time[d], "right") - 1
    first = np.flatnonzero(np.concatenate([[True], time[d][1:] != time[d][:-1]])) if len(d) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(d)))
    tie = np.repeat(np.arange(len(first)), size)
    f = (np.arange(len(d)) - first[tie]) / size[tie]  # each death of a tie sees a smaller part of the others

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        r = np.exp(np.clip(x @ b, -30, 30))
        rx, rxx = r[:, None] * x, r[:, None, None] * x[:, :, None] * x[:, None, :]
        part = lambda v: np.cumsum(v, axis=0)[last] - f.reshape(-1, *[1] * (v.ndim - 1)) * np.add.reduceat(v[d], first, axis=0)[tie]
        z0, z1, z2 = part(r), part(rx), part(rxx)
        m = z1 / z0[:, None]
        ll = (x[d] @ b).sum() - np.log(z0).sum() - 0.5 * l2 * b @ b
        return float(ll), x[d].sum(axis=0) - m.sum(axis=0) - l2 * b, (z2 / z0[:, None, None] - m[:, :, None] * m[:, None, :]).sum(axis=0) + (l2 + 1e-9) * np.eye(len(b))

    b = np.zeros(x.shape[1])
    if not len(d):
        return b, np.full((len(b), len(b)), np.nan), 0.0
    for _ in range(40):
        _, g, h = at(b)
        step = np.linalg.solve(h, g)
        b = b + step
        if not len(b) or np.abs(step).max() < 1e-9:
            break
    ll, _, h = at(b)
    return b, np.linalg.inv(h), ll


def p_of_z(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def p_of_t(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return _beta_part(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared: the incomplete gamma function by series or continued fraction."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d, c = 1 / (k * d + b), b + k / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def signed_rank_p(d: np.ndarray) -> float:
    """Two-sided Wilcoxon signed-rank p; zeros are left out. Exact over all signs for up to 50 differences, ties included; the normal approximation beyond."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    r = ranks(np.abs(d))
    w = r[d > 0].sum()
    if n > 50:
        return p_of_z((w - r.sum() / 2) / math.sqrt((r**2).sum() / 4))
    steps = np.rint(2 * r).astype(int)  # half ranks become whole
    ways = np.zeros(steps.sum() + 1)
    ways[0] = 1
    for k in steps:
        ways[k:] += ways[:-k].copy()
    at = int(round(2 * w))
    return float(min(1.0, 2 * min(ways[: at + 1].sum(), ways[at:].sum()) / 2.0**n))


def roc_auc(score: np.ndarray, y: np.ndarray) -> float | None:
    n1 = int(y.sum())
    return float((ranks(score)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))) if 0 < n1 < len(y) else None


def average_precision(score: np.ndarray, y: np.ndarray) -> float | None:
    """Precision at each threshold, weighted by the recall it adds; equal scores are one threshold."""
    if not 0 < y.sum():
        return None
    o = np.argsort(-score, kind="stable")
    end = np.flatnonzero(np.append(score[o][1:] != score[o][:-1], True))
    tp = np.cumsum(y[o])[end]
    return float((np.diff(np.concatenate([[0], tp])) * tp / (end + 1)).sum() / y.sum())


def balanced_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The score from which on calls positive reach the best balanced accuracy; the largest of equals."""
    o = np.argsort(-score, kind="stable")
    end = np.flatnonzero(np.append(score[o][1:] != score[o][:-1], True))
    tp = np.cumsum(y[o])[end]
    ba = tp / max(y.sum(), 1) + 1 - (end + 1 - tp) / max((1 - y).sum(), 1)
    return float(score[o][end[int(np.argmax(ba))]])


def concordant(time: np.ndarray, event: np.ndarray, score: np.ndarray, block: int = 1024) -> tuple[float, int]:
    """Won and comparable pairs (the earlier time an event; the higher score wins, equal ones half): blocks of times against the sorted scores of all later ones."""
    o = np.argsort(-time, kind="stable")
    t, e, s = time[o], event[o].astype(bool), score[o]
    later, won, pairs, i = np.zeros(0), 0.0, 0, 0
    while i < len(t):
        j = int(np.searchsorted(-t, -t[min(i + block, len(t)) - 1], "right"))
        a = s[i:j][e[i:j]]
        lo, hi = np.searchsorted(later, a), np.searchsorted(later, a, "right")
        won, pairs = won + (lo + (hi - lo) / 2).sum(), pairs + len(a) * len(later)
        if t[i] != t[j - 1]:
            ok = (t[i:j, None] < t[None, i:j]) & e[i:j, None]
            won += (ok * ((s[i:j, None] > s[None, i:j]) + 0.5 * (s[i:j, None] == s[None, i:j]))).sum()
            pairs += int(ok.sum())
        later = np.sort(np.concatenate([later, s[i:j]]), kind="stable")
        i = j
    return float(won), int(pairs)


def _fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def _variants(covariates: list[str]) -> dict[str, list[str]]:
    return {"feature": ["value"]} | ({"clinical": covariates, "combined": ["value", *covariates]} if covariates else {})


_EFFECT = "variant string, n long, events long, coef double, se double, effect double, effect_low double, effect_high double, wald_p double, {} log_likelihood double, aic double, lrt_df long, lrt_p double"


def fit_models(df: DataFrame, keys: list[str], kind: str, covariates: list[str] | None = None) -> DataFrame:
    """O144, O145, O146: per group the effect of value on y (logistic) or on time and event (Cox), alone, of the clinical covariates, and of both.

    Predictors are scaled to unit variance. Of value: coefficient, standard error, odds or hazard ratio with 95 % bounds, Wald p. Of each model: AUC and average
    precision, or C-index, log likelihood, AIC, and the likelihood-ratio test against the nested model: none of its predictors, or the covariates alone
    for both together. Rows with a null are left out; groups or variants that can't be fitted give nulls.
    """
    covariates = covariates or []
    logistic = kind == "logistic"
    cols = ["value", *covariates, *(["y"] if logistic else ["time", "event"])]
    measures = ["auc", "average_precision"] if logistic else ["c_index"]
    names = [f.split()[0] for f in _EFFECT.replace("{}", "".join(f"{m} double, " for m in measures)).split(", ")]

    def model(p: pd.DataFrame, use: list[str]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        x = np.column_stack([p[c].to_numpy(float) for c in use]) if use else np.zeros((len(p), 0))
        sd = x.std(axis=0)
        if (sd == 0).any():
            raise ValueError("a constant predictor")
        x = (x - x.mean(axis=0)) / sd
        if logistic:
            b, v, ll = logit(x, p["y"].to_numpy(float))
            return b[1:], v[1:, 1:], ll, x @ b[1:]
        b, v, ll = cox(x, p["time"].to_numpy(float), p["event"].to_numpy(bool))
        return b, v, ll, x @ b

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(cols)
        y = p["y" if logistic else "event"].to_numpy(float)
        out = []
        for variant, use in _variants(covariates).items():
            row = dict.fromkeys(names) | {"variant": variant, "n": len(p), "events": int(y.sum())}
            try:
                if len(p) < 5 or not 0 < y.sum() or (logistic and y.sum() == len(y)):
                    raise ValueError("too few rows")
                b, v, ll, score = model(p, use)
                nested = covariates if variant == "combined" else []
                row |= {"log_likelihood": ll, "aic": 2 * (len(use) + logistic) - 2 * ll, "lrt_df": len(use) - len(nested), "lrt_p": chi2_tail(2 * (ll - model(p, nested)[2]), len(use) - len(nested))}
                if logistic:
                    row |= {"auc": roc_auc(score, y), "average_precision": average_precision(score, y)}
                else:
                    won, pairs = concordant(p["time"].to_numpy(float), y, score)
                    row["c_index"] = won / pairs if pairs else None
                if use[0] == "value":
                    se = math.sqrt(v[0, 0])
                    row |= {"coef": b[0], "se": se, "effect": math.exp(min(b[0], 700)), "effect_low": math.exp(min(b[0] - 1.959963984540054 * se, 700)), "effect_high": math.exp(min(b[0] + 1.959963984540054 * se, 700)), "wald_p": p_of_z(b[0] / se)}
            except (np.linalg.LinAlgError, ValueError):
                pass
            out.append([*key, *(row[c] for c in names)])
        return pd.DataFrame(out, columns=[*keys, *names])

    schema = _fields(df, keys) + _EFFECT.format("".join(f"{m} double, " for m in measures))
    return df.select(*keys, *cols).groupBy(*keys).applyInPandas(lambda key, p: run(key, p[cols]), schema)


def folds(df: DataFrame, keys: list[str], stratum: str, unit: str, k: int = 5, repeats: int = 5, seed: int = 1) -> DataFrame:
    """O147, O148: stratified folds of each repeat, dealt by a seeded hash of the unit."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    w = Window.partitionBy(*keys, "repeat", stratum).orderBy(F.xxhash64(F.lit(seed), "repeat", unit), unit)
    return d.withColumn("fold", (F.row_number().over(w) - 1) % k)


_SCORES = ["oof_auc", "oof_average_precision", "oof_balanced_accuracy", "oof_sensitivity", "oof_specificity"]


def cv_auc(df: DataFrame, keys: list[str], covariates: list[str] | None = None) -> DataFrame:
    """O147, O149: out-of-fold measures of class-balanced, L2-regularised logistic models of value, of the covariates and of both, over repeats of stratified folds: mean and sd over repeats.

    Predictors are scaled by the training folds, and calls are made at the training folds' threshold of best balanced accuracy. `delta_auc` is the mean gain in AUC over the clinical model.
    """
    covariates = covariates or []
    cols = ["value", *covariates, "y", "fold"]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(["fold", *cols[:-1]])
        y, f = p["y"].to_numpy(float), p["fold"].to_numpy()
        rows = []
        for variant, use in _variants(covariates).items():
            x = p[use].to_numpy(float)
            out, call = np.full(len(y), np.nan), np.zeros(len(y), bool)
            for k in np.unique(f):
                tr, te = f != k, f == k
                sd = x[tr].std(axis=0)
                if len(np.unique(y[tr])) < 2 or (sd == 0).any():
                    continue
                z = (x - x[tr].mean(axis=0)) / sd
                w = np.where(y[tr] == 1, 0.5 / y[tr].mean(), 0.5 / (1 - y[tr].mean()))
                b = logit(z[tr], y[tr], 1.0, w)[0]
                score = b[0] + z @ b[1:]
                out[te], call[te] = score[te], score[te] >= balanced_threshold(score[tr], y[tr])
            ok = np.isfinite(out)
            s, t, c = out[ok], y[ok], call[ok]
            row = [None] * 5
            if 0 < t.sum() < len(t):
                sens, spec = float(c[t == 1].mean()), float((~c[t == 0]).mean())
                row = [roc_auc(s, t), average_precision(s, t), (sens + spec) / 2, sens, spec]
            rows.append([*key, variant, *row])
        return pd.DataFrame(rows, columns=[*keys, "repeat", "variant", *_SCORES])

    d = folds(df, keys, "y", "patient_id").select(*keys, "repeat", *cols)
    r = d.groupBy(*keys, "repeat").applyInPandas(lambda key, p: run(key, p[cols]), _fields(df, keys) + "repeat int, variant string, " + ", ".join(f"{c} double" for c in _SCORES))
    return _over_repeats(r, keys, _SCORES, "oof_auc", "delta_auc")


def _over_repeats(r: DataFrame, keys: list[str], scores: list[str], score: str, delta: str) -> DataFrame:
    """O149: mean and sd of each measure over the repeats of a group and variant, and the mean gain over the clinical variant."""
    base = F.max(F.when(F.col("variant") == "clinical", F.col(score))).over(Window.partitionBy(*keys, "repeat"))
    r = r.withColumn(delta, F.col(score) - base)
    return r.groupBy(*keys, "variant").agg(*[F.avg(c).alias(c) for c in scores], *[F.stddev_samp(c).alias(f"{c}_repeat_sd") for c in scores], F.avg(delta).alias(delta), F.count(score).alias("n_repeats"))


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """O150: ROC AUC by average ranks, average precision by running sums, and accuracy measures at 0.5."""
    d = df.where(F.col(score).isNotNull()).withColumn("_r", average_rank(score, *keys))
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    d = d.withColumn("_tp", F.sum(F.col(positive).cast("int")).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    n1, n0 = F.count_if(positive), F.count_if(~F.col(positive))
    hit = F.col(score) >= 0.5
    sens, spec = F.try_divide(F.count_if(hit & F.col(positive)), n1), F.try_divide(F.count_if(~hit & ~F.col(positive)), n0)
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col(positive), F.col("_r"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"), F.try_divide(F.sum(F.when(F.col(positive), F.col("_tp") / F.col("_n"))), n1).alias("average_precision"), sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"))


#: Quantiles that cut times and scores into blocks.
BLOCKS = 64


def _block(x: str, bounds: str) -> Column:
    """The block of a value: odd ones hold one bound each, even ones what lies between two."""
    return 2 * F.size(F.filter(bounds, lambda b: b < F.col(x))) + F.array_contains(bounds, F.col(x)).cast("int")


def concordance(df: DataFrame, keys: list[str], score: str, blocks: int = BLOCKS) -> DataFrame:
    """O151: share of comparable pairs (the earlier time an event) whose higher score fails first; equal scores count half. Rows with a null are left out; cohorts without comparable pairs give no row.

    Times and scores are cut at their quantiles. Pairs in unlike blocks of both are counted from the numbers of rows in each pair of blocks; the
    others inside their block of times, or of scores, one block a task. A value that many rows share is a quantile and so a block of its own,
    which needs no rows: equal times aren't comparable, equal scores count half. So no cohort is gathered and no pair is a row.
    """
    x = df.select(*keys, F.col("time").cast("double").alias("time"), F.col("event").cast("boolean").alias("event"), F.col(score).cast("double").alias("score")).where("time IS NOT NULL AND event IS NOT NULL AND score IS NOT NULL AND NOT isnan(time) AND NOT isnan(score)")
    at = F.array(*(F.lit(i / blocks) for i in range(blocks + 1)))
    # written once: quantiles of another run may differ by the order in which parts come in, and all counts need the same blocks
    cut = kept(x.groupBy(*keys).agg(*(F.array_distinct(F.percentile_approx(c, at, F.lit(100 * blocks))).alias(f"{c}_at") for c in ("time", "score"))), "cuts")
    r = x.join(cut, keys).select(*keys, "time", "event", "score", _block("time", "time_at").alias("tb"), _block("score", "score_at").alias("sb"))
    fields, names = _fields(df, keys), [*keys, "won", "pairs"]
    table = r.groupBy(*keys, "tb", "sb").agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("e"))

    def across(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        n, e = (np.zeros((2 * blocks + 3, 2 * blocks + 3)) for _ in range(2))
        n[p["tb"], p["sb"]], e[p["tb"], p["sb"]] = p["n"], p["e"]
        later = n.sum(axis=0) - np.cumsum(n, axis=0)
        lower = np.cumsum(later, axis=1) - later
        won = (e * lower).sum() + (e * later)[:, 1::2].sum() / 2
        return pd.DataFrame([[*key, won, int((e.sum(axis=1) * later.sum(axis=1)).sum())]], columns=names)

    def inside(time: str):
        def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            won, pairs = concordant(p[time].to_numpy(float), p["event"].to_numpy(bool), p["score"].to_numpy(float))
            return pd.DataFrame([[*key[:-1], won, pairs if time == "time" else 0]], columns=names)

        return run

    schema = fields + "won double, pairs long"
    parts = table.groupBy(*keys).applyInPandas(across, schema)
    parts = parts.unionByName(r.where("sb % 2 = 0").groupBy(*keys, "sb").applyInPandas(inside("tb"), schema))
    parts = parts.unionByName(r.where("tb % 2 = 0").groupBy(*keys, "tb").applyInPandas(inside("time"), schema))
    out = parts.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pairs").alias("n_pairs")).where("n_pairs > 0")
    return out.select(*keys, (F.col("won") / F.col("n_pairs")).alias("c_index"), "n_pairs")


_SHIFT = ["n", "mean", "median", "sd", "dz", "fraction_up", "fraction_down", "t_p", "wilcoxon_p", "median_low", "median_high"]


def paired_shift(df: DataFrame, keys: list[str], delta: str, n_boot: int = 1000, seed: int = 1) -> DataFrame:
    """O159: mean, median and sd of paired differences, effect size, shares of rises and falls, p of Student's t and of the Wilcoxon signed-rank test, and the bootstrap interval of the median (95 %). Under three differences, or equal ones, give nulls from sd on."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        d = np.sort(p[delta].dropna().to_numpy(float))
        n = len(d)
        row = [n, *([float(d.mean()), float(np.median(d))] if n else [None, None]), *[None] * 8]
        if n >= 3 and d.std() > 0:
            sd = d.std(ddof=1)
            rng = np.random.default_rng(seed)
            boot = np.concatenate([np.median(rng.choice(d, (min(50, n_boot - i), n)), axis=1) for i in range(0, n_boot, 50)])
            row[3:] = [sd, d.mean() / sd, float((d > 0).mean()), float((d < 0).mean()), p_of_t(d.mean() / (sd / math.sqrt(n)), n - 1), signed_rank_p(d), float(np.quantile(boot, 0.025)), float(np.quantile(boot, 0.975))]
        return pd.DataFrame([[*key, *row]], columns=[*keys, *_SHIFT])

    return df.select(*keys, delta).groupBy(*keys).applyInPandas(run, _fields(df, keys) + "n long, " + ", ".join(f"{c} double" for c in _SHIFT[1:]))


def _brands(t) -> DataFrame:
    s = t("supplier").select(F.col("s_suppkey").alias("patient_id"), (F.col("s_acctbal") > 4500).cast("int").alias("y"), F.col("s_nationkey").cast("double").alias("nation"))
    return t.features().join(s, "patient_id")


def _cohorts(t) -> DataFrame:
    n = t("customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").cast("double").alias("nation"))
    return t.patients().withColumn("value", F.col("marker")).join(n, "patient_id")


@query("o144_logistic_models")
def _o144(t):
    return fit_models(_brands(t), ["feature"], "logistic", ["nation"])


@query("o145_cox_models")
def _o145(t):
    return fit_models(_cohorts(t), ["cohort"], "cox", ["nation"])


@query("o147_cross_validated_auc")
def _o147(t):
    return cv_auc(_brands(t), ["feature"], ["nation"])


@query("o150_auc_metrics", f"WITH {PATIENTS}, s AS (SELECT cohort, event, (marker + 1000) / 11000 AS s FROM patients), r AS (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY s) + (count(*) OVER (PARTITION BY cohort, s) - 1) / 2.0 AS r, sum(event::INT) OVER (PARTITION BY cohort ORDER BY s DESC) / count(*) OVER (PARTITION BY cohort ORDER BY s DESC)::DOUBLE AS prec FROM s), g AS (SELECT cohort, count(*) FILTER (WHERE event) AS n1, count(*) FILTER (WHERE NOT event) AS n0, sum(r) FILTER (WHERE event) AS rs, sum(prec) FILTER (WHERE event) AS ap, count(*) FILTER (WHERE event AND s >= 0.5) AS tp, count(*) FILTER (WHERE NOT event AND s < 0.5) AS tn FROM r GROUP BY 1) SELECT cohort, round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) AS auc, round(ap / n1, 9) AS average_precision, round(tp / n1::DOUBLE, 9) AS sensitivity, round(tn / n0::DOUBLE, 9) AS specificity FROM g")
def _o150(t):
    g = auc(t.patients().withColumn("s", (F.col("marker") + 1000) / 11000), ["cohort"], "s", "event")
    return g.select("cohort", *[F.round(c, 9).alias(c) for c in ("auc", "average_precision", "sensitivity", "specificity")])


@query("o151_concordance", f"WITH {PATIENTS} SELECT a.cohort, round(avg(CASE WHEN a.marker > b.marker THEN 1.0 WHEN a.marker = b.marker THEN 0.5 ELSE 0.0 END), 9) AS c_index, count(*) AS n_pairs FROM patients a JOIN patients b ON a.cohort = b.cohort AND a.event AND a.time < b.time GROUP BY 1")
def _o151(t):
    return concordance(t.patients(), ["cohort"], "marker").withColumn("c_index", F.round("c_index", 9))


@query("o153_context_quality", f"WITH {PATIENTS} SELECT cohort, count(*) AS n, count(*) FILTER (WHERE event) AS events, least(count(*) FILTER (WHERE event), count(*) FILTER (WHERE NOT event)) AS min_class, least(count(*) FILTER (WHERE event), count(*) FILTER (WHERE NOT event)) >= 5 AND count(*) >= 30 AS can_fit FROM patients GROUP BY 1")
def _o153(t):
    e, ne = F.count_if("event"), F.count_if(~F.col("event"))
    return t.patients().groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), e.alias("events"), F.least(e, ne).alias("min_class"), ((F.least(e, ne) >= 5) & (F.count(F.lit(1)) >= 30)).alias("can_fit"))


@query("o159_paired_shift")
def _o159(t):
    at = F.struct("o_orderdate", "o_orderkey")
    d = t("orders").groupBy("o_custkey").agg((F.max_by("o_totalprice", at) - F.min_by("o_totalprice", at)).alias("delta"))
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cohort"))
    return paired_shift(d.join(c, "o_custkey"), ["cohort"], "delta")


@query("o160_direction_consistency", "WITH f AS (SELECT user_id, value - 50 AS v FROM events), m AS (SELECT user_id, sign(avg(v)) AS s FROM f GROUP BY 1) SELECT user_id, round(avg((sign(v) = s)::INT), 9) AS consistency, any_value(-s)::DOUBLE AS favourable FROM f JOIN m USING (user_id) GROUP BY 1")
def _o160(t):
    f = t("events").select("user_id", (F.col("value") - 50).alias("v"))
    m = f.groupBy("user_id").agg(F.signum(F.avg("v")).alias("s"))
    return f.join(m, "user_id").groupBy("user_id").agg(F.round(F.avg((F.signum("v") == F.col("s")).cast("double")), 9).alias("consistency"), F.first(-F.col("s")).alias("favourable"))


@query("o146_nested_models")
def _o146(t):
    both = lambda df, keys, kind: fit_models(df, keys, kind, ["nation"]).where("variant = 'combined'").select(F.col(keys[0]).alias("context"), F.lit(kind).alias("kind"), "n", "lrt_df", "lrt_p")
    return both(_brands(t), ["feature"], "logistic").unionByName(both(_cohorts(t), ["cohort"], "cox"))
