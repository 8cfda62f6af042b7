"""The display form of a comparison and its column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.codes import TOTAL
from cohortlift.operators.compare import rank_order

BREAK = "..."


FIXED_COLUMNS = ("ccd", "name", "chisq", "odds_ratio", "dir")


def label_columns(reference_name: str, test_name: str) -> dict[str, str]:
    """Result columns named after the two sets: upper case, ``_`` for other characters.

    A number is added where a name would be that of another column, in whatever case.
    """
    taken = {c.upper() for c in FIXED_COLUMNS}
    found = {}
    for key, name in (("ref", reference_name), ("test", test_name)):
        plain = label = re.sub(r"\W+", "_", name.upper(), flags=re.ASCII)
        number = 1
        while {label, f"FRC_{label}"} & taken:
            number += 1
            label = f"{plain}_{number}"
        taken |= {label, f"FRC_{label}"}
        found[key], found[f"frc_{key}"] = label, f"FRC_{label}"
    return found


def report_table(
    result: DataFrame, reference_name: str, test_name: str, rank_by: str = "odds_ratio"
) -> DataFrame:
    """A comparison as text cells, in its order, with a ``...`` row before the first
    under-represented code. The ``TOTAL`` row shows its code and the two counts only."""
    names = label_columns(reference_name, test_name)
    is_total = F.col("ccd") == TOTAL

    def cell(shown: Column) -> Column:
        return F.when(is_total, F.lit("")).otherwise(F.coalesce(shown, F.lit("")))

    cells = {
        "ccd": F.col("ccd"),
        "name": cell(F.col("name")),
        names["ref"]: F.col("ref").cast("string"),
        names["frc_ref"]: cell(_fixed("frc_ref", 5)),
        names["test"]: F.col("test").cast("string"),
        names["frc_test"]: cell(_fixed("frc_test", 5)),
        "chisq": cell(_fixed("chisq", 2)),
        "odds_ratio": cell(F.col("odds_ratio").cast("string")),
        "dir": cell(F.col("dir").cast("string")),
    }
    # The sort keys are in one column, whose name is that of no cell.
    keys = "sort_keys"
    while keys.upper() in {name.upper() for name in cells}:
        keys += "_"

    def lines(of: DataFrame, shown: dict[str, Column], line: int) -> DataFrame:
        sorting = F.struct(is_total.alias("total"), "odds_ratio", "chisq", "dir", "ccd", F.lit(line).alias("line"))
        return of.select(*[c.alias(name) for name, c in shown.items()], sorting.alias(keys))

    first_under = (
        result.where(~is_total & (F.col("dir") == -1)).orderBy(*rank_order(rank_by)).limit(1)
    )
    marker = {name: F.lit(BREAK if name == "ccd" else "") for name in cells}
    by = {name: F.col(f"{keys}.{name}") for name in ("total", "odds_ratio", "chisq", "dir", "ccd", "line")}
    ranking = {"odds_ratio": by["odds_ratio"], "chisq": by["chisq"] * by["dir"]}[rank_by]
    return (
        lines(result, cells, 1)
        .unionByName(lines(first_under, marker, 0))
        .orderBy(by["total"].desc(), ranking.desc_nulls_first(), by["ccd"], by["line"])
        .drop(keys)
    )


def _fixed(column: str, digits: int) -> Column:
    shown = F.format_string(f"%.{digits}f", F.col(column))
    return F.when(F.col(column).isNotNull(), shown)

