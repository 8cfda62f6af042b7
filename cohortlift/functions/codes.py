"""Column expressions over concept codes, concept paths and LIKE patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# In-band conventions of the concept codes.
TOTAL = "TOTAL"
TOTAL_NAME = "All Patients in Population"
HIGH, LOW = "H", "L"
ABOVE_LABEL = "[ABOVE REFERENCE] "
BELOW_LABEL = "[BELOW REFERENCE] "
BASE_LAB_PREFIX = "LOINC:"
PIPE_SCHEME = "NAACCR"

_LIKE_ESCAPE = "~"


def like(column: Column, pattern: Column | str) -> Column:
    """``column LIKE pattern`` where only ``%`` and ``_`` are special.

    Backslashes are ordinary characters, as they separate the levels of concept paths.
    """
    if isinstance(pattern, str):
        pattern = F.lit(pattern)
    quoted = F.replace(pattern, F.lit(_LIKE_ESCAPE), F.lit(_LIKE_ESCAPE * 2))
    return F.like(column, quoted, F.lit(_LIKE_ESCAPE))


def is_flagged(ccd: Column) -> Column:
    return ccd.startswith(HIGH + "_") | ccd.startswith(LOW + "_")


def unflagged_code(ccd: Column) -> Column:
    """The code below one leading ``H_`` / ``L_`` flag; other codes stay as they are."""
    return F.regexp_replace(ccd, "^[HL]_", "")


def lookup_code(ccd: Column, strip: str = "leading") -> Column:
    """The code used to find a concept's name and domain.

    ``leading`` drops one leading flag, ``anywhere`` drops every ``H_`` and ``L_`` in the code.
    """
    if strip == "leading":
        return unflagged_code(ccd)
    if strip == "anywhere":
        for flag in (HIGH, LOW):
            ccd = F.replace(ccd, F.lit(flag + "_"), F.lit(""))
        return ccd
    raise ValueError(f"strip must be 'leading' or 'anywhere', not {strip!r}")


def scheme_prefix(ccd: Column, lookup: Column) -> Column:
    """The coding scheme: the text before the first colon, or the whole code without one."""
    return F.when(ccd.startswith(PIPE_SCHEME + "|"), F.lit(PIPE_SCHEME)).otherwise(
        F.nullif(F.substring_index(lookup, ":", 1), F.lit(""))
    )


def labelled_name(ccd: Column, name: Column) -> Column:
    """Concept name with its above/below label; a label without a name is kept alone."""
    return (
        F.when(ccd.startswith(HIGH + "_"), F.concat_ws("", F.lit(ABOVE_LABEL), name))
        .when(ccd.startswith(LOW + "_"), F.concat_ws("", F.lit(BELOW_LABEL), name))
        .otherwise(name)
    )


def ancestor_paths(path: Column, separator: str) -> Column:
    """Array of every prefix of ``path`` that ends in the separator."""
    parts = F.split(path, _regex_literal(separator))
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda _, i: F.concat(F.array_join(F.slice(parts, 1, i + 1), separator), F.lit(separator)),
    )


def literal_head(pattern: Column) -> Column:
    """The part of a LIKE pattern before its first wildcard."""
    return F.regexp_extract(pattern, "^[^%_]*", 0)


def cohort_id(master: Column, instance: Column, result: Column) -> Column:
    return F.format_string("M%d_I%d_R%d", master, instance, result)


def cohort_id_part(cohort: Column, part: str) -> Column:
    """``master``, ``instance`` or ``result`` number of a cohort id."""
    position = {"master": 1, "instance": 2, "result": 3}[part]
    return F.regexp_extract(cohort, r"^M(\d+)_I(\d+)_R(\d+)$", position).try_cast("bigint")


def _regex_literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)
