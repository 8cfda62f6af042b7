"""A join that is safe when one key of the left side holds a large share of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
#: Rows of a key that one task takes in any case.
LEAST_HOT_ROWS = 100_000
#: A hot key is cut so that a task's share of the rows holds so many parts of it.
PARTS_PER_TASK = 32


def fits_broadcast(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure ``df`` (one job over at most ``max_rows + 1`` rows) against both bounds."""
    fixed = 16 * len(df.columns)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    width = reduce(
        lambda total, c: total + F.coalesce(F.octet_length(F.col(c)), F.lit(0)), text, F.lit(fixed)
    )
    head = df.limit(max_rows + 1)
    rows, size = head.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def hot_key_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    how: str,
    spread_by: list[str],
    condition: Column | None = None,
    small: bool | None = None,
    sizes_from: DataFrame | None = None,
    least_hot: int = LEAST_HOT_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Join a large ``left`` to a dimension-like ``right`` on ``[(left column, right column)]``.

    A right side measured to be small is broadcast, so the left side is not shuffled and a hot key costs nothing.
    Otherwise the rows go three ways. Those whose key the right side does not have (if its keys alone are few
    enough to broadcast) go around the join. Of the others, the rows of hot keys are cut into as many parts as
    their measured number asks for, by a hash of ``spread_by`` (stable over task retries), and the right side's rows
    of these keys are repeated for each part; all other rows are joined as they are. Keys are counted in ``sizes_from``
    (by default ``left``), which needs the left key columns only. Both ways give the same rows. ``how`` is
    ``inner`` or ``left``. With ``partitions`` a join that shuffles has that many tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    names = [l for l, _ in on]
    keys = reduce(lambda a, b: a & b, [F.col(l) == F.col(r) for l, r in on])
    if condition is not None:
        keys = keys & condition
    if fits_broadcast(right) if small is None else small:
        return left.join(F.broadcast(right), keys, how)
    known = right.select(*[F.col(r).alias(l) for l, r in on]).distinct()
    around = None
    if fits_broadcast(known):
        if how == "left":
            others = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
            around = left.join(F.broadcast(known), names, "left_anti").select(*left.columns, *others)
        left = left.join(F.broadcast(known), names, "left_semi").select(*left.columns)
    hot = hot_keys(left if sizes_from is None else sizes_from, names, least_hot)
    through = left.join(F.broadcast(hot), names, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    last = F.coalesce("_parts", F.lit(1)) - 1
    copied = hot.withColumnsRenamed({l: f"_hot_{l}" for l in names})
    same = reduce(lambda a, b: a & b, [F.col(r) == F.col(f"_hot_{l}") for l, r in on])
    copied = right.join(F.broadcast(copied), same, "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), last.cast("int")))
    )
    through, copied = through.drop("_parts"), copied.select(*right.columns, "_copy")
    if partitions:
        # Spelled out, as adaptive execution would make fewer and larger tasks.
        through = through.repartition(partitions, *names, "_part")
        copied = copied.repartition(partitions, *[r for _, r in on], "_copy")
    joined = through.join(copied, keys & (F.col("_part") == F.col("_copy")), how)
    joined = joined.select(*left.columns, *right.columns)
    return joined if around is None else joined.union(around)


def hot_keys(df: DataFrame, names: list[str], least: int = LEAST_HOT_ROWS) -> DataFrame:
    """``names, _parts``: keys with more rows than a part of a task's share, and into how many parts to cut them.

    A key is counted before the shuffle; the hot ones, of which there are fewer than parts of all tasks, are
    held by the driver.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = df.select(*names).na.drop().groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    part = F.greatest(
        F.lit(1.0), counted.agg(F.sum("_n")).scalar() / F.lit(float(tasks * PARTS_PER_TASK))
    )
    parts = F.ceil(F.col("_n") / part).cast("int")
    hot = counted.where((F.col("_n") > least) & (F.col("_n") > 2 * part)).select(*names, parts.alias("_parts"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema.fields)
    return spark.createDataFrame(hot.collect(), kinds)
