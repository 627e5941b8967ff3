"""Order-dependent aggregates done without funnelling a whole column into one task.

Spark has no distributed unpartitioned window: ``Window.orderBy(x)`` without a
partition moves every row into a single task. Exact quantiles and first rows need
no order of all rows (see ``exact_quantile_rows`` and ``first_rows``). The operators that
do (ROC prefix sums, rank dictionaries) use ``running_totals``:

1. the caller compacts to one row per distinct order key (partial aggregation,
   so a hot value collapses map-side);
2. ``repartitionByRange`` spreads those keys over N balanced, ordered partitions;
3. per-(partition, group) totals; only groups that cross a partition boundary
   (at most N-1) need a non-zero offset, so the broadcast offsets table has at
   most 2(N-1) rows however many groups there are;
4. a window partitioned by partition id adds the local running sum.

The range-partitioned compact frame is checkpointed (reliable, shared folder)
so the partition ids seen by the offsets branch and the rows branch are the
same even if a task is re-run; it also cuts the lineage of the fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PID = "_pid"


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def running_totals(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str],
                   group_cols: Sequence[str] = (), descending: bool = False,
                   num_partitions: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_cols`` within ``group_cols``.

    Order keys must be unique within a group (compact first). One path at every size:
    the per-task share shrinks as partitions are added, and ``df`` is evaluated once
    (everything after the checkpoint reads the checkpoint).
    """
    n = _partitions(df, num_partitions)
    group_cols = list(group_cols)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    # Materialise the range partitioning in the shared checkpoint folder: the
    # partition ids below must be identical in both branches, and a re-run range
    # sample over shuffle output (whose row order varies) could move bounds.
    d = df.repartitionByRange(n, *[F.col(g) for g in group_cols], *order).checkpoint(eager=True)
    d = d.withColumn(PID, F.spark_partition_id())
    # per (partition, group) totals: G + N rows, aggregated distributed (never broadcast)
    part = d.groupBy(PID, *group_cols).agg(*[F.sum(c).alias(f"_pt_{c}") for c in sum_cols])
    if group_cols:
        # Rows are range-sorted by (group, order), so a group can continue from an earlier
        # partition only as a partition's first group, and only from the last group of the
        # nearest non-empty earlier partition. Those "split" groups -- at most N-1 -- are
        # the only ones with a non-zero offset; all others start at 0 in their partition.
        g = F.struct(*group_cols)
        ends = part.groupBy(PID).agg(F.min(g).alias("_first"), F.max(g).alias("_last"))   # N rows
        prev_last = F.lag("_last").over(Window.orderBy(PID))                             # N-row window
        split = ends.select(F.col("_first").alias("_g"), prev_last.alias("_p")) \
            .where(F.col("_g").eqNullSafe(F.col("_p"))).select("_g").distinct()
        part = part.join(F.broadcast(split), g.eqNullSafe(F.col("_g")), "left_semi")   # <= 2(N-1) rows
    w_off = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(
        F.col(PID).alias("_o_pid"), *[F.col(c).alias(f"_o_{c}") for c in group_cols],
        *[F.coalesce(F.sum(f"_pt_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
    )
    # offsets hold at most 2(N-1) rows (N without groups): bounded by the partition count
    on = F.col(PID) == F.col("_o_pid")
    for c in group_cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = d.join(F.broadcast(offsets), on, "left")
    w_run = (Window.partitionBy(PID, *group_cols).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.sum(c).over(w_run)).alias(f"{c}{suffix}")
          for c in sum_cols],
    )


#: relative error of the percentiles that bracket an exact quantile, and how far beyond it the bracket reaches
ACCURACY, MARGIN = 1000, 2
#: rows that are expected inside one bracket before its distinct values are gathered
INSIDE = 2_000_000


def _number(c: str) -> F.Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> tuple[dict, dict]:
    """(n per column, {(column, prob): (rank below, rank above, low value, high value)}).

    One scan gives counts and percentiles on both sides of every quantile. Where so many rows are left between
    them that one task should not sort them, further scans narrow the bracket by the same factor; ``below`` keeps
    how many values lie under it."""
    reach = MARGIN / ACCURACY
    sides = [x for p in probs for x in (max(0.0, p - reach), min(1.0, p + reach))]
    aggs = [a for c in cols for a in (F.count(_number(c)), F.percentile_approx(_number(c), sides, ACCURACY))]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    n = {c: row[2 * i] for i, c in enumerate(cols)}
    found = {}
    for i, c in enumerate(cols):
        for j, p in enumerate(probs):
            if n[c]:
                pos = p * (n[c] - 1)
                found[c, p] = [math.floor(pos), math.ceil(pos), *row[2 * i + 1][2 * j:2 * j + 2]]
    left = {k: n[k[0]] * 2 * reach for k in found}
    while wide := [k for k in found if left[k] > INSIDE and found[k][2] < found[k][3]]:
        inside = {k: F.when(_number(k[0]).between(*found[k][2:]), _number(k[0])) for k in wide}
        aggs = []
        for k in wide:  # where the quantile stands among the values of the bracket, if the bracket is centred
            aggs += [F.count_if(_number(k[0]) < found[k][2]), F.count(inside[k]), F.percentile_approx(inside[k], [i / 64 for i in range(65)], ACCURACY)]
        row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        for i, k in enumerate(wide):
            below, m, marks = row[3 * i:3 * i + 3]
            at = (found[k][0] - below) / max(m, 1) * 64
            low, high = marks[max(0, math.floor(at) - 1)], marks[min(64, math.ceil(at) + 2)]
            left[k] = m * 4 / 64 if (low, high) != tuple(found[k][2:]) else 0
            found[k][2:] = [low, high]
    return n, found


def _values_at(df: DataFrame, found: dict) -> dict:
    """{(column, prob): (value at the lower rank, value at the upper rank)}, None where the bracket misses it.

    One scan: rows are grouped by the values that lie inside a bracket (most rows have none and become one
    group per task), and each group counts what lies below each bracket. So only values inside leave the map side."""
    keys = list(found)
    inside = F.filter(F.array(*[
        F.when(_number(c).between(*found[c, p][2:]), F.struct(F.lit(i).alias("k"), _number(c).alias("v")))
        for i, (c, p) in enumerate(keys)]), lambda x: x.isNotNull())
    below = [F.count_if(_number(c) < found[c, p][2]).alias(f"b{i}") for i, (c, p) in enumerate(keys)]
    groups = df.groupBy(inside.alias("held")).agg(F.count(F.lit(1)).alias("n"), *below)
    rows = F.concat(F.transform("held", lambda x: F.struct(x.k.alias("k"), x.v.alias("v"), F.col("n").alias("n"))),
                    F.array(*[F.struct(F.lit(i).alias("k"), F.lit(None).cast("double").alias("v"), F.col(f"b{i}").alias("n"))
                              for i in range(len(keys))]))
    counts = groups.select(F.explode(rows).alias("r")).groupBy("r.k", "r.v").agg(F.sum("r.n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranks = F.array(*[F.struct(F.lit(found[k][0]).alias("lo"), F.lit(found[k][1]).alias("hi")) for k in keys])
    at = lambda r: F.max(F.when((F.col("upto") - F.col("n") <= r) & (r < F.col("upto")), F.col("v")))
    cum = counts.select("k", "v", "n", upto.alias("upto"), F.get(ranks, F.col("k")).alias("r"))
    got = cum.filter("v is not null").groupBy("k").agg(at(F.col("r.lo")).alias("lo"), at(F.col("r.hi")).alias("hi")).collect()
    out = dict.fromkeys(keys, (None, None))
    out.update({keys[r.k]: (r.lo, r.hi) for r in got})
    return out


def exact_quantile_rows(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[tuple]:
    """[(column, prob, quantile, n)]: exact linear-interpolated quantiles (pandas/NumPy ``linear``).

    Two scans of ``df``: approximate percentiles bracket every quantile, then the values inside the brackets
    are ranked exactly. What goes through one task is the percentiles' summary of each task, and per quantile the
    distinct values of its bracket (2 * MARGIN / ACCURACY of the rows, at most about INSIDE). A quantile that its
    bracket should miss is looked for again in the whole range of its column."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return []
    probs = [float(p) for p in probs]
    n, found = _brackets(df, cols, probs)
    got = _values_at(df, found) if found else {}
    missed = {k: [*found[k][:2], -math.inf, math.inf] for k, v in got.items() if None in v}
    if missed:
        got |= _values_at(df, missed)
    out = []
    for c in cols:
        for p in probs:
            if (c, p) in got:
                low, high = got[c, p]
                out.append((c, p, low if low == high else low + (high - low) * (p * (n[c] - 1) - found[c, p][0]), n[c]))
    return out


def exact_quantile_frame(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``exact_quantile_rows`` as a frame (column, prob, quantile, n)."""
    return df.sparkSession.createDataFrame(exact_quantile_rows(df, cols, probs), "column string, prob double, quantile double, n long")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.5,)) -> dict[str, dict[float, float]]:
    """Fitted quantiles as driver scalars: at most len(cols) * len(probs) numbers; NaN for a column without values."""
    out = {c: {float(p): math.nan for p in probs} for c in cols}
    for c, p, q, _ in exact_quantile_rows(df, cols, probs):
        out[c][p] = q
    return out


def first_rows(df: DataFrame, key: str, order_col: str, last: bool = False, tiebreak: str | None = None) -> DataFrame:
    """One row per key (NULL keys form one group): the one of the smallest (``last``: largest) ``order_col``.

    The extreme is a hash aggregate of one number per key, combined before the shuffle. A join on (key, order)
    finds its row, and spreads a hot key's rows over the tasks by their order values. Rows without an
    order come after all others. Of several rows at the extreme the one of the largest ``tiebreak`` stays (any one
    without it); only those rows are sorted. Orders that a hash aggregate cannot hold (strings, structs) go
    through ``min_by``."""
    if not isinstance(df.schema[order_col].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
        others = [c for c in df.columns if c != key]
        at = F.struct(F.col(order_col).isNotNull() if last else F.col(order_col).isNull(), F.col(order_col), *[F.col(t) for t in [tiebreak] if t])
        best = (F.max_by if last else F.min_by)(F.struct(*[F.col(c) for c in others]), at)
        return df.groupBy(key).agg(best.alias("_first")).select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])
    ends = df.groupBy(F.col(key).alias("_first_key")).agg((F.max if last else F.min)(order_col).alias("_first_at"))
    on = F.col(key).eqNullSafe(F.col("_first_key")) & F.col(order_col).eqNullSafe(F.col("_first_at"))
    rows = df.join(ends.hint("shuffle_hash"), on)
    among = F.row_number().over(Window.partitionBy("_first_key", "_first_at").orderBy(F.col(tiebreak).desc() if tiebreak else F.col(order_col)))
    return rows.withColumn("_first_of", among).filter("_first_of = 1").select(*df.columns)


def dense_codes(values: DataFrame, value_col: str, code_col: str = "code",
                num_partitions: int | None = None) -> DataFrame:
    """Sorted dictionary of distinct values -> 0-based code, ranked on the executors without a
    single-task window."""
    distinct = values.select(F.col(value_col)).where(F.col(value_col).isNotNull()).distinct()
    ranked = running_totals(distinct.withColumn("_one", F.lit(1)), [value_col], ["_one"], num_partitions=num_partitions)
    return ranked.select(value_col, (F.col("_one_cum") - 1).cast("int").alias(code_col))
