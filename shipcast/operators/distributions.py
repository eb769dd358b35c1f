"""Distribution summaries: describe, box statistics, histograms, quantile-bin
odds, ECDF, 2-D bins, correlations.

Quantiles are exact and linear-interpolated.  Values are first counted per
distinct value (partial aggregation), the counts are dealt into value ranges,
and running counts across the ranges find the two ranks each quantile needs; no
group's values meet in one task.  ``exact=False`` switches to
``percentile_approx`` (a bounded sketch).  Multi-variable summaries run as one
job over a long (variable, value) form instead of one scan per variable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stored_table
from ..sources.tables import sized_broadcast

QUANTILE_ACCURACY = 100_000


def group_quantiles(df: DataFrame, by: list[str], value: str, ps: list[float], exact: bool = True,
                    weight: str | None = None) -> DataFrame:
    """(by..., n, q): number of values and the quantiles ``ps`` of each group, as an array.

    ``weight`` names a column that says how many rows a row stands for (exact only).

    Null values and rows with a null group column are left out.  Interpolation is
    that of ``percentile``: position p (n - 1) between its neighbouring ranks.
    """
    base = df.select(*by, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w") if weight else F.lit(1).alias("_w")).dropna()
    if not exact:
        return base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                     F.percentile_approx("_v", [float(p) for p in ps], QUANTILE_ACCURACY).alias("q"))
    counts = base.groupBy(*by, "_v").agg(F.sum("_w").cast("bigint").alias("_c"))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(counts.repartitionByRange(n_parts, *by, "_v").withColumn("_pid", F.spark_partition_id()))
    # one row per (range, group): ranges + groups rows
    totals = ranged.groupBy("_pid", *by).agg(F.sum("_c").alias("_t"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *by, "_t", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"),
                            F.sum("_t").over(group).alias("n"))
    places = F.array(*[F.lit(float(p)) for p in ps])
    positions = F.transform(places, lambda p: p * (F.col("n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(positions, lambda x: F.floor(x).cast("bigint")),
                                      F.transform(positions, lambda x: F.ceil(x).cast("bigint"))))
    # a range's rows carry only the ranks that lie in it, and ranges without any are not read
    offsets = offsets.select("_pid", *by, "_before", "n", F.filter(
        ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_t"))).alias("_ranks")).where(F.size("_ranks") > 0)
    upto = Window.partitionBy("_pid", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (ranged.withColumn("_upto", F.sum("_c").over(upto)).join(offsets, ["_pid", *by])
               .withColumn("_upto", F.col("_upto") + F.col("_before")))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))
    hits = running.select(*by, "n", "_v", F.explode(inside).alias("_rank"))  # two ranks per quantile at most
    at = F.map_from_entries(F.collect_list(F.struct("_rank", "_v")))
    found = hits.groupBy(*by, "n").agg(at.alias("_at"))

    def value_at(pos):
        lo, hi = F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint")
        low, high = F.element_at("_at", lo), F.element_at("_at", hi)
        # between equal values nothing is interpolated: rounding would leave the value by one digit
        return F.when(low == high, low).otherwise((hi - pos) * low + (pos - lo) * high)

    return found.select(*by, "n", F.transform(positions, value_at).alias("q"))


def long_values(df: DataFrame, cols: list[str], keep: list[str] = (), name: str = "variabl",
                value: str = "value") -> DataFrame:
    """Unpivot numeric ``cols`` to (keep..., variabl, value) with doubles; nulls dropped."""
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(keep), cols, name, value).where(F.col(value).isNotNull())


def describe_numeric(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """(variabl, n, mean, std, min, q25, median, q75, max) per column."""
    lv = long_values(df, cols)
    q = group_quantiles(lv, ["variabl"], "value", [0.25, 0.5, 0.75], exact)
    stats = lv.groupBy("variabl").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                      F.min("value").alias("min"), F.max("value").alias("max"))
    return (stats.join(q, "variabl")
            .select("variabl", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"),
                    F.col("q")[2].alias("q75"), "max"))


def box_stats(df: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """Boxplot data per group: quartiles, Tukey whiskers (furthest point within
    1.5 IQR of the box), outlier count.

    Quartiles per group are written to the shared folder; whiskers and outliers
    follow after joining each group's fences back, a broadcast or a shuffle join
    by the quartile table's known size.
    """
    v = F.col(value)
    base = df.where(v.isNotNull())
    q = stored_table(group_quantiles(base, by, value, [0.25, 0.5, 0.75], exact)
                     .select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                             F.col("q")[2].alias("q3")), "quartiles")
    fences = q.select(*by, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lo"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_hi"))
    joined = base.select(*by, v.alias("_v")).join(fences, by, "inner")
    w = joined.groupBy(*by).agg(
        F.min(F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= F.col("_hi"), F.col("_v"))).alias("whisker_hi"),
        F.count_if((F.col("_v") < F.col("_lo")) | (F.col("_v") > F.col("_hi"))).alias("n_outliers"))
    return q.join(w, by, "inner")


def histogram(df: DataFrame, col: str, bins: int = 10, right: bool = False,
              lo: float | None = None, width: float | None = None,
              by: list[str] = ()) -> DataFrame:
    """Fixed-width histogram of ``col``.

    Without ``lo``/``width``: ``bins`` equal bins between the column's min and
    max, computed in the same plan (one-row aggregate cross-joined, so nothing
    is collected).  ``right=False``: bins [a, b) with the last closed;
    ``right=True``: bins (a, b] with the first closed.  With ``lo``/``width``:
    explicit breaks lo, lo+width, ..., e.g. hourly bins of a duration in days;
    values below ``lo`` are counted in one underflow bin, -1, without a left edge.
    """
    x = F.col(col)
    base = df.where(x.isNotNull())
    if lo is None or width is None:
        rng_aggs = [F.min(x).cast("double").alias("_lo"),
                    ((F.max(x) - F.min(x)).cast("double") / bins).alias("_w")]
        if by:  # one range per group, as a histogram per group
            rng = base.groupBy(*by).agg(*rng_aggs)
            base = base.join(sized_broadcast(rng, 100_000), list(by))
        else:
            base = base.crossJoin(F.broadcast(base.agg(*rng_aggs)))  # exactly one row
        lo_c, w_c, nb = F.col("_lo"), F.col("_w"), F.lit(bins)
    else:
        lo_c, w_c, nb = F.lit(float(lo)), F.lit(float(width)), None
    pos = F.try_divide(x - lo_c, w_c)
    if right:
        idx = F.ceil(pos) - 1
        idx = F.greatest(idx, F.lit(0))
    else:
        idx = F.floor(pos)
    if nb is None:
        idx = F.when(x < lo_c, F.lit(-1)).otherwise(idx)
    else:
        idx = F.when(w_c == 0, F.lit(0)).otherwise(F.least(idx, nb - 1))
    binned = base.select(*by, idx.cast("bigint").alias("bin"), lo_c.alias("_lo"), w_c.alias("_w"))
    return (binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"),
                                           F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
            .select(*by, "bin", F.when(F.col("bin") >= 0, F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_left"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_right"), "n"))


def quantile_bin_odds(df: DataFrame, cols: list[str], flag: str = "late_delivery_flag", step: float = 0.02,
                      trims: dict[str, float] | None = None, exact: bool = True) -> DataFrame:
    """Late rate by quantile bin of each continuous variable.

    Edges: exact quantiles at 0, step, ..., 1, duplicates removed.  Bins are
    right-closed with the first bin holding the minimum: bin = number of
    edges strictly below x, at least 1.  ``trims``: per-variable lower bound
    (rows with x <= bound are excluded before the edges are computed).
    Output: (variabl, bin, bin_left, bin_right, bin_midpt, nbr, nbr_late, pct_late);
    empty bins are omitted.
    """
    n_steps = round(1 / step)
    ps = [i / n_steps for i in range(n_steps + 1)]
    lv = long_values(df, cols, keep=[flag])
    for var, bound in (trims or {}).items():
        lv = lv.where((F.col("variabl") != var) | (F.col("value") > bound))
    # the rows are read once: edges and bins come from the distinct values
    counts = stored_table(lv.groupBy("variabl", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(flag).cast("bigint").alias("late")),
                          "value-counts")
    edges = (group_quantiles(counts, ["variabl"], "value", ps, weight="n") if exact
             else group_quantiles(lv, ["variabl"], "value", ps, False)).select("variabl", F.array_distinct("q").alias("edges"))
    edges = F.broadcast(stored_table(edges, "edges"))  # one row per variable: len(cols) rows
    binned = counts.join(edges, "variabl").select(
        "variabl", "n", "late", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("value")))).alias("bin"))
    out = (binned.groupBy("variabl", "bin").agg(F.sum("n").alias("nbr"), F.sum("late").alias("nbr_late"))
           .join(edges.withColumnRenamed("edges", "_e"), "variabl"))
    left = F.element_at("_e", F.col("bin"))
    right_ = F.element_at("_e", F.col("bin") + 1)
    return out.select("variabl", "bin", left.alias("bin_left"), right_.alias("bin_right"),
                      ((left + right_) / 2).alias("bin_midpt"), "nbr", "nbr_late",
                      F.try_divide(F.col("nbr_late").cast("double"), F.col("nbr").cast("double")).alias("pct_late"))


def _co_moments(df: DataFrame, cols: list[str], listwise: bool = False) -> DataFrame:
    """(i, j, n, mx, my, sxx, syy, sxy) of every pair i < j of columns, over the rows
    where both are present (``listwise``: all columns are): counts, means and
    centred sums of products.

    A task holds one set of column-by-column matrices: each Arrow batch of rows
    adds its products (matrix multiplications), and a row per pair leaves the
    task at its end.  Rows are centred on the task's first batch, so sums keep
    their digits; the exact means are merged from the sums.
    """
    k = len(cols)
    above = np.triu_indices(k, 1)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.float64()), ("mx", pa.float64()),
                        ("my", pa.float64()), ("sxx", pa.float64()), ("syy", pa.float64()), ("sxy", pa.float64())])

    def run(batches):
        total = np.zeros((4, k, k))
        centre = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            here = ~np.isnan(x)
            if listwise:
                x = x[here.all(axis=1)]
                if not len(x):
                    continue
                here = ~np.isnan(x)
            if centre is None:
                centre = np.where(here, x, 0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
            x = np.where(here, x - centre, 0.0)
            seen = here.astype(np.float64)
            total += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
        if centre is None:
            return
        n, s, ss, p = (m[above] for m in total)
        other, squares = total[1].T[above], total[2].T[above]  # the sums of the second column of each pair
        n_safe = np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
            above[0].astype(np.int32), above[1].astype(np.int32), n, s / n_safe + centre[above[0]],
            other / n_safe + centre[above[1]], ss - s * s / n_safe, squares - other * other / n_safe,
            p - s * other / n_safe)], schema=schema)

    return df.select(*cols).mapInArrow(run, "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double")


def _pair_corr(base: DataFrame, cols: list[str], listwise: bool = False) -> DataFrame:
    """(i, j, corr) of all pairs of columns i < j, in one pass over the rows."""
    # stored: the means and the sums around them read it, and the rows are read once
    part = stored_table(_co_moments(base, cols, listwise), "co-moments").where("n > 0")  # a row per pair and task
    means = part.groupBy("i", "j").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("_mx"),
                                       (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("_my"))
    # between-task terms around the merged means
    both = part.join(means, ["i", "j"])
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    sums = both.groupBy("i", "j").agg(F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("xy"),
                                      F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("xx"),
                                      F.sum(F.col("syy") + F.col("n") * dy * dy).alias("yy"))
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select("i", "j", F.when(spread > 0, F.col("xy") / spread).otherwise(F.lit(float("nan"))).alias("corr"))


def corr_pairs(df: DataFrame, cols: list[str], listwise: bool = False) -> DataFrame:
    """Pearson correlation of every pair i < j in one job, long form
    (col_i, col_j, corr).  Pairwise deletion by default (each pair uses rows
    where both are present); ``listwise`` first drops rows with any missing."""
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    base = stored_table(_pair_corr(base, cols, listwise), "correlations")  # a row per pair
    names = F.array(*[F.lit(c) for c in cols])
    return base.select(F.element_at(names, F.col("i") + 1).alias("col_i"), F.element_at(names, F.col("j") + 1).alias("col_j"),
                       "corr")


def corr_with_target(df: DataFrame, target: str, cols: list[str], exclude: list[str] = (), listwise: bool = False) -> DataFrame:
    """(feature, corr, abs_corr) of each column with the target, strongest first."""
    feats = [c for c in cols if c != target and c not in set(exclude)]
    pairs = corr_pairs(df, [target, *dict.fromkeys(feats)], listwise).where(F.col("col_i") == target)
    return (pairs.select(F.col("col_j").alias("feature"), "corr", F.abs("corr").alias("abs_corr"))
            .orderBy(F.desc("abs_corr")))


def bins_2d(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Scatter data as 2-D bin counts: (x_bin, y_bin, n), bin = floor(v / width)."""
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("n")))
