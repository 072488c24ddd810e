"""Evaluation and reporting (E1-E8) as aggregations.

Label/prediction metrics reduce to a handful of conditional sums (one
map-side-combined aggregate). Timing statistics need exact order statistics
per group; ``order_statistics`` finds them by histogram narrowing, so a group
holding a third of all rows is never sorted or collected in one task.
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import join_null_safe
from ..functions.nn import sparse_cross_entropy_row
from ..schema import LINK_STATE_REPORT_NAMES


# ---------------------------------------------------------------- E1-E5
def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     n_classes: int = 3) -> DataFrame:
    """Rows = truth, columns ``pred_j`` = predicted counts (E1). Classes absent
    from the truth still get a row of zeros (3-row dimension table)."""
    classes = list(range(n_classes))
    m = (df.groupBy(F.col(label).cast("int").alias("label"))
         .pivot(pred, classes).agg(F.count(F.lit(1))))
    for j in classes:
        m = m.withColumnRenamed(str(j), f"pred_{j}")
    dim = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    out = dim.join(F.broadcast(m), "label", "left")  # both sides hold <= n_classes rows
    return out.select("label", *[F.coalesce(F.col(f"pred_{j}"), F.lit(0)).cast("bigint").alias(f"pred_{j}")
                                 for j in classes])


def _cell_sums(df: DataFrame, label: str, pred: str, n_classes: int) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in range(n_classes):
        aggs += [F.sum(((y == c) & (p == c)).cast("bigint")).alias(f"tp{c}"),
                 F.sum((y == c).cast("bigint")).alias(f"sup{c}"),
                 F.sum((p == c).cast("bigint")).alias(f"prd{c}")]
    return df.agg(*aggs)


def _ratio(a: Column, b: Column) -> Column:
    """0/0 -> 0, as the library default with a warning."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _rows_from(one_row: DataFrame, rows: list[dict]) -> DataFrame:
    """Several output rows from ONE aggregate row: explode an array of structs
    (one scan, one aggregation; no union of re-evaluated branches)."""
    names = list(rows[0])
    arr = F.array(*[F.struct(*[r[n].alias(n) for n in names]) for r in rows])
    return one_row.select(F.explode(arr).alias("_r")).select(*[F.col(f"_r.{n}").alias(n) for n in names])


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          names: Sequence[str] = LINK_STATE_REPORT_NAMES) -> DataFrame:
    """precision / recall / F1 / support per class, then accuracy, macro avg and
    weighted avg rows (E2). One aggregate over the data; the report rows are
    derived from its single result row."""
    k = len(names)
    s = _cell_sums(df, label, pred, k)
    pr = [_ratio(F.col(f"tp{c}"), F.col(f"prd{c}")) for c in range(k)]
    rc = [_ratio(F.col(f"tp{c}"), F.col(f"sup{c}")) for c in range(k)]
    f1 = [F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r)) for p, r in zip(pr, rc)]
    sup = [F.col(f"sup{c}").cast("bigint") for c in range(k)]
    total = sum(sup[1:], sup[0])
    none = F.lit(None).cast("double")

    def wavg(v):
        return F.when(total == 0, none).otherwise(sum((v[c] * sup[c] for c in range(1, k)), v[0] * sup[0]) / total)

    rows = [{"class": F.lit(nm), "precision": pr[c], "recall": rc[c], "f1_score": f1[c], "support": sup[c]}
            for c, nm in enumerate(names)]
    rows.append({"class": F.lit("accuracy"), "precision": none, "recall": none,
                 "f1_score": _ratio(sum((F.col(f"tp{c}") for c in range(k)), F.lit(0)), F.col("n")),
                 "support": F.col("n").cast("bigint")})
    rows.append({"class": F.lit("macro avg"), "precision": sum(pr[1:], pr[0]) / k, "recall": sum(rc[1:], rc[0]) / k,
                 "f1_score": sum(f1[1:], f1[0]) / k, "support": total})
    rows.append({"class": F.lit("weighted avg"), "precision": wavg(pr), "recall": wavg(rc), "f1_score": wavg(f1),
                 "support": total})
    return _rows_from(s, rows)


def per_class_accuracy(df: DataFrame, label: str = "label", pred: str = "prediction",
                       n_classes: int = 3) -> DataFrame:
    """Diagonal / row sum per true class; a class absent from the truth -> NULL."""
    s = _cell_sums(df, label, pred, n_classes)
    rows = [{"label": F.lit(c), "accuracy": F.when(F.col(f"sup{c}") > 0, F.col(f"tp{c}") / F.col(f"sup{c}"))}
            for c in range(n_classes)]
    return _rows_from(s, rows)


def overall_accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Share of rows with prediction == label."""
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def cross_entropy(df: DataFrame, probs: str = "probability", label: str = "label",
                  by: Sequence[str] = ()) -> DataFrame:
    """Mean sparse categorical cross-entropy (E5)."""
    ce = sparse_cross_entropy_row(F.col(probs), F.col(label))
    return df.groupBy(*by).agg(F.avg(ce).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- E7: order statistics
def order_statistics(df: DataFrame, group: Sequence[str], value: str, targets: Mapping[str, Column],
                     bins: int = 1024, max_candidates: int = 20000,
                     stats: DataFrame | None = None) -> DataFrame:
    """Exact ``k``-th smallest values per group.

    ``targets`` maps an output name to a 0-based rank expression over ``_n``
    (the group size). Each pass joins the values with the per-(group, target)
    value range still in play, histograms them into ``bins`` bins (partial
    aggregation, so a hot group costs no more than any other) and keeps the
    bin holding the rank, with its exact min/max as the new range. When at
    most ``max_candidates`` values remain, they are ranked by a window whose
    partitions are bounded by that number. Bins are monotone in the value, so
    the range ``[min, max]`` of a bin holds exactly that bin's values. Infinite
    values have bins of their own, the smallest and the largest value never share one, so every pass
    narrows. A NULL group is a group.
    ``stats`` (group, ``_n``, ``_lo``, ``_hi``) may be passed when the caller
    already aggregates the groups, saving a scan."""
    g = list(group)
    base = df.select(*g, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan(F.col("_v")))
    if stats is None:
        stats = base.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"),
                                     F.max("_v").alias("_hi"))
    tg = F.array(*[F.struct(F.lit(k).alias("t"), e.cast("bigint").alias("r")) for k, e in targets.items()])
    state = stats.select(*g, "_lo", "_hi", "_n", F.explode(tg).alias("_t")).select(
        *g, F.col("_t.t").alias("_target"), F.col("_t.r").alias("_r"), "_lo", "_hi",
        F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_cnt"))
    keys = g + ["_target"]
    top = 1.7e308
    def finite(c):
        return F.least(F.greatest(c, F.lit(-top)), F.lit(top)) / 2
    while True:
        open_ = F.col("_cnt") > max_candidates
        busy = state.where(open_ & (F.col("_lo") < F.col("_hi")))
        if busy.isEmpty():
            break
        from ..session import checkpoint_root
        checkpoint_root(df.sparkSession)
        j = join_null_safe(base, busy.select(*keys, "_lo", "_hi"), g).where(
            (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        v, lo, hi = finite(F.col("_v")), finite(F.col("_lo")), finite(F.col("_hi"))
        b = (F.when(F.col("_v") == F.col("_lo"), F.lit(-1)).when(F.col("_v") == F.col("_hi"), F.lit(bins))
             .when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * F.lit(float(bins))), F.lit(bins - 1))).otherwise(F.lit(0)))
        h = j.groupBy(*keys, b.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"),
                                                  F.max("_v").alias("_bmax"))
        w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        h = h.withColumn("_cum", F.sum("_c").over(w))    # <= bins rows per partition
        need = F.col("_r") - F.col("_below")
        pick = join_null_safe(h, busy.select(*keys, "_r", "_below"), keys).where(
            (F.col("_cum") - F.col("_c") <= need) & (need < F.col("_cum")))
        moved = pick.select(*keys, "_r", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                            (F.col("_below") + F.col("_cum") - F.col("_c")).alias("_below"),
                            F.col("_c").alias("_cnt"))
        kept = state.where(~(open_ & (F.col("_lo") < F.col("_hi"))))
        state = kept.unionByName(moved).checkpoint()     # cut lineage; tiny, on the shared dir
    const = state.where(F.col("_lo") == F.col("_hi")).select(*keys, F.col("_lo").alias("_val"))
    live = state.where(F.col("_lo") < F.col("_hi"))
    cand = join_null_safe(base, live.select(*keys, "_r", "_lo", "_hi", "_below"), g).where(
        (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    w = Window.partitionBy(*keys).orderBy("_v")          # <= max_candidates rows per partition
    sel = cand.withColumn("_rk", F.row_number().over(w) - 1 + F.col("_below")).where(
        F.col("_rk") == F.col("_r")).select(*keys, F.col("_v").alias("_val"))
    both = const.unionByName(sel)
    return both.groupBy(*g).pivot("_target", list(targets)).agg(F.first("_val"))


def timing_stats(df: DataFrame, group: Sequence[str], value: str, max_candidates: int = 20000) -> DataFrame:
    """count, mean, median, min, max, sample stddev (0 if n <= 1), total, p95,
    p99 per group (E7). p95/p99 take the sorted element at ``int(q*n)`` (0-based)
    when n >= 20 / 100, else the maximum (P20)."""
    g = list(group)
    n = F.col("_n")
    ranks = {
        "_med_lo": F.floor((n - 1) / 2),
        "_med_hi": F.floor(n / 2),
        "p95_ms": F.when(n >= 20, F.floor(F.lit(0.95) * n)).otherwise(n - 1),
        "p99_ms": F.when(n >= 100, F.floor(F.lit(0.99) * n)).otherwise(n - 1),
    }
    v = F.col(value).cast("double")
    agg = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*g).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev_ms"), F.sum(v).alias("total_ms"))
    agg = agg.withColumn("stddev_ms", F.when(F.col("count") > 1, F.col("stddev_ms")).otherwise(F.lit(0.0)))
    # the same aggregate seeds the order statistics (one scan fewer)
    stats = agg.select(*g, F.col("count").alias("_n"), F.col("min_ms").alias("_lo"), F.col("max_ms").alias("_hi"))
    os_ = order_statistics(df, g, value, ranks, max_candidates=max_candidates, stats=stats)
    out = join_null_safe(agg, os_, g)          # one row per group on both sides
    return out.select(*g, "count", "mean_ms", ((F.col("_med_lo") + F.col("_med_hi")) / 2).alias("median_ms"),
                      "min_ms", "max_ms", "stddev_ms", "total_ms", "p95_ms", "p99_ms")


def throughput(df: DataFrame, group: str, run: str, time_ms: str, rows: int | str = 1000) -> DataFrame:
    """rows/s and speed-up ``baseline / time`` per run, baseline = the group's
    first run; zero time -> 0, NULL time -> NULL (E8). The baseline is a per-group aggregate
    (partial aggregation, no window over a whole group)."""
    t = F.col(time_ms).cast("double")
    base = df.groupBy(group).agg(F.min_by(t, F.col(run)).alias("_base_ms"))
    r = F.lit(float(rows)) if not isinstance(rows, str) else F.col(rows).cast("double")
    out = join_null_safe(df, base, [group])      # AQE broadcasts the per-group side when it is small
    return out.select(
        group, run, t.alias("time_ms"),
        F.when(t > 0, r / (t / F.lit(1000.0))).when(t.isNotNull(), F.lit(0.0)).alias("rows_per_s"),
        F.when(t > 0, F.col("_base_ms") / t).when(t.isNotNull(), F.lit(0.0)).alias("speedup"))


def run_summary(df: DataFrame, group: str, time_ms: str) -> DataFrame:
    """avg / min / max time per group (E8, load-time report)."""
    t = F.col(time_ms).cast("double")
    return df.groupBy(group).agg(F.avg(t).alias("avg_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"),
                                 F.count(t).alias("runs"))


# ---------------------------------------------------------------- E6
def history_table(history: DataFrame) -> DataFrame:
    """Training history (one row, one array column per metric) -> one row per
    epoch, 1-based (E6)."""
    metrics = [c for c in history.columns]
    z = F.arrays_zip(*[F.col(c).alias(c) for c in metrics])
    e = history.select(F.posexplode(z).alias("_i", "_m"))
    return e.select((F.col("_i") + 1).alias("epoch"), *[F.col(f"_m.{c}").alias(c) for c in metrics])


def read_history(spark, path: str) -> DataFrame:
    """Per-epoch table from a saved model configuration whose ``history`` field
    maps metric names to arrays (one value per epoch) (E6)."""
    raw = spark.read.option("multiLine", True).json(path)
    return history_table(raw.select("history.*"))


def best_epoch(hist: DataFrame, metric: str = "val_accuracy", mode: str = "max") -> DataFrame:
    """The epoch with the best metric (first on ties): a top-1 report."""
    o = F.col(metric).desc() if mode == "max" else F.col(metric).asc()
    return hist.orderBy(o, F.col("epoch").asc()).limit(1)


# ---------------------------------------------------------------- E1, E2 over an open class set
def confusion_cells(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Occupied cells (label, prediction, n) of the confusion matrix for whatever classes the two columns hold; NULL is a class.
    One aggregate with partial results, so a cell with a third of all rows costs no more than others. Empty table: no rows."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def open_report(cells: DataFrame) -> DataFrame:
    """Per class that is a label or a prediction: ``tp``, ``support``, ``predicted``, precision, recall, F1 (0/0 -> 0). The supports sum to
    the rows. Needs a row a cell only, so the data isn't read once more for each class."""
    hit = F.col("label").eqNullSafe(F.col("prediction"))
    zero = F.lit(0).cast("bigint")
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")))))
    s = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    return s.select("class", "tp", "support", "predicted", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"),
                    _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"))
