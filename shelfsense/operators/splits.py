"""Train / test splits. Every split adds a column instead of collecting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.operators import ordered
from shelfsense.operators.joins import with_scalar


def _check_share(share: float) -> None:
    if not 0 < share < 1:
        raise ValueError(f"test share must lie in (0, 1), got {share}")


def time_ordered(df: DataFrame, time: str, ids: list[str], test_share: float = 0.2, name: str = "is_test") -> DataFrame:
    """The first ``int(n * (1 - share))`` rows by (time, ids) train, the later ones test.

    Rows are counted per time value; only the time value that the cut falls into has its rows
    ordered by id.
    """
    _check_share(test_share)
    per_time = df.groupBy(time).agg(F.count("*").alias("n"))
    placed = ordered.positions(per_time, [], [F.col(time).asc_nulls_last()], sums={"n": "n"})
    cut = F.floor(F.col("n_total") * F.lit(1 - test_share))
    hit = (
        placed.withColumn("keep", cut - F.col("n_before"))
        .filter((F.col("keep") >= 0) & (F.col("keep") < F.col("n")))
        .select(time, "keep")
        .first()
    )
    if hit is None:  # empty input
        return df.withColumn(name, F.lit(True))
    at, keep = hit[time], hit["keep"]
    moment = F.col(time)
    if at is None:
        before, same = moment.isNotNull(), moment.isNull()
    else:
        # A row without a time sorts last, hence into the test side.
        before, same = F.coalesce(moment < F.lit(at), F.lit(False)), moment.eqNullSafe(F.lit(at))
    if keep == 0:
        return df.withColumn(name, ~before)
    border = ordered.row_number(df.filter(same).select(*ids), [], list(ids), "_nth")
    early = border.filter(F.col("_nth") <= keep).select(*ids).withColumn("_early", F.lit(True))
    marked = df.join(early, ids, "left")
    return marked.withColumn(name, ~(before | (same & F.coalesce("_early", F.lit(False))))).drop("_early")


def at_week(df: DataFrame, week: str, time: str = "week_start_date", name: str = "is_test") -> DataFrame:
    return df.withColumn(name, F.col(time) >= F.lit(week).cast("date"))


def week_share_cut(df: DataFrame, share: float = 0.8, time: str = "week_start_date") -> DataFrame:
    """One row ``cut_week``: the distinct week at position ``int(weeks * share)``."""
    weeks = df.select(time).distinct()
    # Distinct weeks: a few thousand at most.
    numbered = weeks.select(time, F.row_number().over(Window.orderBy(time)).alias("nth"))
    cut = with_scalar(numbered, weeks.agg(F.count("*").alias("weeks")), "weeks")
    return cut.filter(F.col("nth") == F.floor(F.col("weeks") * F.lit(share)) + 1).select(F.col(time).alias("cut_week"))


def by_week_share(df: DataFrame, share: float = 0.8, time: str = "week_start_date", name: str = "is_test") -> DataFrame:
    cut = week_share_cut(df, share, time)
    return with_scalar(df, cut, "cut_week").withColumn(name, F.col(time) >= F.col("cut_week")).drop("cut_week")


def stratified(df: DataFrame, label: str, ids: list[str], test_share: float = 0.2, name: str = "is_test") -> DataFrame:
    """The same share of every class goes to test, picked by the hash order of the ids."""
    _check_share(test_share)
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids]))
    placed = ordered.positions(df.withColumn("_hash", key), [label], ["_hash", *ids])
    return placed.withColumn(
        name, F.col("rows_before") < F.round(F.col("rows_total") * F.lit(test_share))
    ).drop("_hash", "rows_before", "rows_total")


def time_else_stratified(
    df: DataFrame, label: str, time: str, ids: list[str], test_share: float = 0.2, known: float = 0.8, name: str = "is_test"
) -> DataFrame:
    """By time where more than ``known`` of the rows have one and both sides then have two classes, else stratified.

    Rows without a time come last. ``split_strategy`` says which way was taken. ``df`` should be stored.
    """
    have = df.agg(F.count("*").alias("n"), F.count(time).alias("timed")).first()
    if have["timed"] > int(known * have["n"]):
        by_time = time_ordered(df, time, ids, test_share, name)
        classes = by_time.groupBy(name).agg(F.count_distinct(label).alias("classes")).collect()
        if len(classes) == 2 and all(r["classes"] == 2 for r in classes):
            return by_time.withColumn("split_strategy", F.lit("time_ordered"))
    return stratified(df, label, ids, test_share, name).withColumn("split_strategy", F.lit("stratified"))


def hash_folds(df: DataFrame, label: str, ids: list[str], folds: int = 5, name: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1 by the hash order of the ids inside each class."""
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids]))
    placed = ordered.positions(df.withColumn("_hash", key), [label], ["_hash", *ids], totals=False)
    return placed.withColumn(name, F.col("rows_before") % folds).drop("_hash", "rows_before")


def leave_last_out(df: DataFrame, user: str, order: list[str], name: str = "is_test") -> DataFrame:
    """The last row of each user tests; users with no other row are dropped.

    ``order`` must end in a column that is unique per user. The last row is found by an
    aggregate, so a heavy user is never sorted in one task.
    """
    last = df.groupBy(user).agg(F.max(F.struct(*order)).alias("_last"), F.count("*").alias("_n"))
    joined = df.join(last.filter("_n > 1"), user)
    # The last order column names the row; comparing it alone avoids equality of doubles.
    return joined.withColumn(name, F.col(order[-1]).eqNullSafe(F.col(f"_last.{order[-1]}"))).drop("_last", "_n")
