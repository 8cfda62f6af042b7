import pytest
from pyspark.sql import functions as F

from cohortlift.functions import codes


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_like_has_only_two_special_characters(spark):
    values = ["\\a\\B_1\\", "\\a\\Bx1\\", "~x", "a.c", "abc", None]
    v = F.col("v")
    found = column(
        spark,
        values,
        codes.like(v, "\\a\\B_1\\"),
        codes.like(v, "~%"),
        codes.like(v, "a.c"),
    )
    assert [f[0] for f in found] == [True, True, False, False, False, None]
    assert [f[1] for f in found] == [False, False, True, False, False, None]
    assert [f[2] for f in found] == [False, False, False, True, False, None]


def test_lookup_code_strips_one_flag_or_every_one(spark):
    values = ["LOINC:1-4", "H_LOINC:1-4", "L_LOINC:1-4", "ABCH_X:1", "H_L_X:1", "PLAIN"]
    v = F.col("v")
    found = column(spark, values, codes.lookup_code(v), codes.lookup_code(v, "anywhere"))
    assert [f[0] for f in found] == ["LOINC:1-4", "LOINC:1-4", "LOINC:1-4", "ABCH_X:1", "L_X:1", "PLAIN"]
    assert [f[1] for f in found] == ["LOINC:1-4", "LOINC:1-4", "LOINC:1-4", "ABCX:1", "X:1", "PLAIN"]
    with pytest.raises(ValueError):
        codes.lookup_code(v, "nowhere")


def test_scheme_prefix(spark):
    values = ["NAACCR|400", "NAACCR|400:2", "ICD9:250.1", "H_LOINC:1-4", "PLAIN", ":odd", "A:b:c"]
    v = F.col("v")
    found = column(spark, values, codes.scheme_prefix(v, codes.lookup_code(v)))
    assert [f[0] for f in found] == ["NAACCR", "NAACCR", "ICD9", "LOINC", "PLAIN", None, "A"]


def test_labels_survive_a_missing_name(spark):
    v = F.col("v")
    none = F.lit(None).cast("string")
    found = column(
        spark,
        ["H_X", "L_X", "X", "HX"],
        codes.labelled_name(v, F.lit("name")),
        codes.labelled_name(v, none),
    )
    assert found == [
        ("[ABOVE REFERENCE] name", "[ABOVE REFERENCE] "),
        ("[BELOW REFERENCE] name", "[BELOW REFERENCE] "),
        ("name", None),
        ("name", None),
    ]


@pytest.mark.parametrize("sep", ["/", "\\", "|", "."])
def test_ancestor_paths_are_the_prefixes_that_end_in_the_separator(spark, sep):
    values = ["/a/b/", "/a/b", "a/b/c/", "abc", "", "/", "//a/"]
    values = [x.replace("/", sep) for x in values]
    found = column(spark, values, codes.ancestor_paths(F.col("v"), sep))
    for value, (got,) in zip(values, found, strict=True):
        want = [value[: i + 1] for i in range(len(value)) if value[i] == sep]
        assert list(got) == want


def test_cohort_id_and_back(spark):
    df = spark.range(1).select(codes.cohort_id(F.lit(12), F.lit(3), F.lit(45)).alias("c"))
    c = F.col("c")
    row = df.select("c", *[codes.cohort_id_part(c, p) for p in ("master", "instance", "result")])
    assert tuple(row.first()) == ("M12_I3_R45", 12, 3, 45)
    odd = spark.range(1).select(codes.cohort_id_part(F.lit("else"), "master"))
    assert odd.first()[0] is None
