"""Order-dependent operators: clusters by gap, runs, folds, interpolation, numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, by: list[str], order: list[str], at: Column, gap) -> DataFrame:
    """Adds cluster, from 1 in each partition: a new one wherever the step from the row before exceeds gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    marked = df.withColumn("__new", new)
    return marked.withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def islands(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Adds island: equal for rows whose indexes follow each other by one."""
    return df.withColumn("island", F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index)))


def same_value_runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds run, from 1: a new one wherever value differs from the row before (nulls are equal)."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    new = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def latest(df: DataFrame, by: list[str], order: Column, *columns: str) -> DataFrame:
    """The columns of each partition's last row; aggregated before the shuffle."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("__last")).select(*by, "__last.*")


def earliest(df: DataFrame, by: list[str], order: Column, *columns: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(F.struct(*columns), order).alias("__first")).select(*by, "__first.*")


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(f"__n <= {n}").drop("__n")


def keep_best(df: DataFrame, by: list[str], best: list[Column]) -> DataFrame:
    """One row for each key: the first in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter("__n = 1").drop("__n")


def as_of(facts: DataFrame, states: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """facts with the columns of the last state strictly before them: one union, one window, no range join."""
    empty = [F.lit(None).cast(states.schema[c].dataType).alias(c) for c in columns]
    extra = [c for c in facts.columns if c not in (*by, at)]
    left = facts.select(*by, at, F.lit(0).alias("__side"), *extra, *empty)
    right = states.select(*by, at, F.lit(1).alias("__side"), *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in extra], *columns)
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, -1)
    seen = left.unionByName(right).withColumn("__state", F.last(F.when(F.col("__side") == 1, F.struct(*columns)), ignorenulls=True).over(w))
    return seen.filter("__side = 0").select(*by, at, *extra, *[F.col(f"__state.{c}").alias(c) for c in columns])


def fold_ema(df: DataFrame, by: list[str], order: list[str], value: str, keep: float) -> DataFrame:
    """by and ema: x <- keep * x + (1 - keep) * value in order, from the first value.

    Folded over each key's own ordered array; keys are sessions or profiles, whose history is bounded.
    """
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("__rows"))
    start = F.col("__rows")[0][value].cast("double")
    fold = F.aggregate(F.slice("__rows", 2, F.size("__rows")), start, lambda x, r: x * keep + r[value] * (1 - keep))
    return rows.select(*by, fold.alias("ema"))


def fill_short_gaps(df: DataFrame, by: list[str], index: str, value: str, longest: int) -> DataFrame:
    """Adds filled: null runs of at most longest rows interpolated linearly; a longer run, or a null at
    either end, makes the whole partition's values null."""
    w = Window.partitionBy(*by).orderBy(index)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    step = df.withColumns({"__l": F.last(known, True).over(before), "__r": F.first(known, True).over(after)})
    bad = F.col("__l").isNull() | F.col("__r").isNull() | (F.col("__r.i") - F.col("__l.i") - 1 > longest)
    whole = F.max(bad.cast("int")).over(Window.partitionBy(*by)) == 1
    share = (F.col(index) - F.col("__l.i")) / F.nullif(F.col("__r.i") - F.col("__l.i"), F.lit(0))
    value_at = F.coalesce(F.col("__l.v") + (F.col("__r.v") - F.col("__l.v")) * share, F.col("__l.v"))
    return step.withColumn("filled", F.when(whole, None).otherwise(value_at)).drop("__l", "__r")


def numbered(df: DataFrame, by: list[str], order: list, name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cumulative(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def stable_union(branches: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """All branches' rows, of equal keys the first: by branch, then by the order column. branch is added, from 0."""
    tagged = [b.withColumn("branch", F.lit(n)) for n, b in enumerate(branches)]
    whole = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in whole.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("branch", order)).alias("row")
    return whole.groupBy(*keys).agg(first).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])
