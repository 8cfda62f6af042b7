import json

import pytest

from cohortlift.operators import compare as cmp
from cohortlift.operators import report
from cohortlift.sources import sinks
from cohortlift.sources.star import SCHEMAS

NAMES = {"A:1": 'say "a", b', "A:2": None, "B:1": "b one", "B:2": "b two", "C:1": "c", "A_:1": "wild"}


@pytest.fixture(scope="module")
def tables(spark):
    totals = {"A:1": 50, "A:2": 20, "B:1": 40, "B:2": 100, "C:1": 30, "A_:1": 20, "TOTAL": 100}
    population = spark.createDataFrame(
        [(c.split(":")[0], c, NAMES.get(c), n, n / 100) for c, n in totals.items()],
        "prefix string, ccd string, name string, total bigint, frc_total double",
    )
    cohort = {"A:1": 8, "A:2": 2, "B:1": 1, "B:2": 10, "C:1": 10, "A_:1": 2, "TOTAL": 10}
    wider = {"A:1": 25, "A:2": 10, "B:1": 5, "B:2": 40, "C:1": 0, "A_:1": 4, "TOTAL": 40}

    def counts(table):
        n = table["TOTAL"]
        return spark.createDataFrame(
            [(c, k, k / n) for c, k in table.items()], "ccd string, cnt bigint, frc double"
        )

    schemes = spark.createDataFrame(
        [("A:", "A", "Alpha"), ("A_:", "A_", "Wild"), ("B:", "B", "Beta"), ("C", "C", "C"), ("TOTAL",) * 3],
        SCHEMAS["schemes"],
    )
    return population, counts(cohort), counts(wider), schemes


def codes_of(df):
    return [r.ccd for r in df.collect()]


# Odds: A:1 4.0, A:2 and A_:1 1 (equal), B:1 0.167, B:2 1 (equal at 1), C:1 0 (p = 1).
ORDER = ["TOTAL", "A:1", "A:2", "A_:1", "B:2", "B:1", "C:1"]


def test_whole_order_with_ties_by_code(spark, tables):
    population, test, _, schemes = tables
    scored = cmp.concept_scores(population, test)
    assert scored.columns == cmp.RESULT_COLUMNS
    assert codes_of(cmp.compare(scored, schemes)) == ORDER
    total = cmp.compare(scored, schemes).first()
    assert tuple(total)[3:] == (100, 1.0, 10, 1.0, 0.0, 1.0, 0)


def test_both_ends(spark, tables):
    population, test, _, schemes = tables
    scored = cmp.concept_scores(population, test, size=10)
    assert codes_of(cmp.compare(scored, schemes, limit=1)) == ["TOTAL", "A:1", "C:1"]
    assert codes_of(cmp.compare(scored, schemes, limit=2)) == ["TOTAL", "A:1", "A:2", "B:1", "C:1"]
    # Fewer codes than both ends ask for: none is doubled.
    assert codes_of(cmp.compare(scored, schemes, limit=4)) == ORDER
    assert codes_of(cmp.compare(scored, schemes, limit=100)) == ORDER
    assert codes_of(cmp.compare(scored, schemes, limit=0)) == ["TOTAL"]
    with pytest.raises(ValueError):
        cmp.compare(scored, schemes, limit=-1)


def test_domains(spark, tables):
    population, test, _, schemes = tables
    scored = cmp.concept_scores(population, test)

    def found(*patterns):
        return codes_of(cmp.compare(scored, schemes, None, list(patterns)))

    assert found() == ORDER
    assert found("ALL") == ORDER
    assert found("B:", "ALL") == ORDER
    assert found("B:") == ["TOTAL", "B:2", "B:1"]
    assert found("B:", "C", "B:") == ["TOTAL", "B:2", "B:1", "C:1"]
    assert found("A:") == ["TOTAL", "A:1", "A:2"]
    assert found("A_") == ["TOTAL", "A:1", "A:2", "A_:1"]  # _ is a wildcard
    assert found("none") == ["TOTAL"]
    assert codes_of(cmp.compare(scored, schemes, None, "C")) == ["TOTAL", "C:1"]


def test_cutoff_holds_for_the_total_row_too(spark, tables):
    population, test, _, schemes = tables
    at_30 = cmp.concept_scores(population, test, cutoff=30)
    assert codes_of(cmp.compare(at_30, schemes)) == ["TOTAL", "A:1", "B:2", "B:1", "C:1"]
    above = cmp.concept_scores(population, test, cutoff=101)
    assert codes_of(cmp.compare(above, schemes)) == []


def test_reference_cohort(spark, tables):
    population, test, wider, schemes = tables
    result = cmp.compare(cmp.concept_scores(population, test, wider), schemes)
    rows = {r.ccd: r for r in result.collect()}
    assert "C:1" not in rows  # absent from the reference
    assert (rows["TOTAL"].ref, rows["TOTAL"].test) == (40, 10)
    assert (rows["A:1"].ref, rows["A:1"].frc_ref) == (25, 0.625)
    assert rows["A:1"].odds_ratio == pytest.approx(0.375 * 0.8 / (0.2 * 0.625))


def test_population_against_itself_is_neutral(spark, tables):
    population, _, _, schemes = tables
    itself = population.selectExpr("ccd", "total cnt", "frc_total frc")
    rows = cmp.compare(cmp.concept_scores(population, itself), schemes).collect()
    assert {(r.chisq, r.odds_ratio, r.dir) for r in rows} == {(0.0, 1.0, 0)}


def test_rank_by_signed_chisq(spark, tables):
    population, test, _, schemes = tables
    scored = cmp.concept_scores(population, test)
    ranked = cmp.compare(scored, schemes, rank_by="chisq").collect()
    assert [r.ccd for r in ranked][:2] == ["TOTAL", "C:1"]  # a null score is first
    assert codes_of(cmp.compare(scored, schemes, limit=1, rank_by="chisq")) == ["TOTAL", "C:1", "B:1"]
    with pytest.raises(ValueError):
        cmp.compare(scored, schemes, rank_by="name")


def test_limited_plan_has_top_k_and_no_window(spark, tables):
    population, test, _, schemes = tables
    result = cmp.compare(cmp.concept_scores(population, test), schemes, 3, ["A:"])
    text = result._jdf.queryExecution().sparkPlan().toString()
    assert text.count("TakeOrderedAndProject") == 2  # one for each end; the total is one row
    assert "Window" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_limit_values():
    assert cmp.parse_limit("ALL") is None and cmp.parse_limit("all") is None
    assert cmp.parse_limit(None) is None
    assert cmp.parse_limit("20") == 20 and cmp.parse_limit(5) == 5
    for bad in ("ten", "-3", "1.5", ""):
        with pytest.raises(ValueError):
            cmp.parse_limit(bad)


def test_report(spark, tables):
    population, test, _, schemes = tables
    result = cmp.compare(cmp.concept_scores(population, test), schemes)
    table = report.report_table(result, "all patients", "Set-1 (new)")
    assert table.columns == [
        "ccd", "name", "ALL_PATIENTS", "FRC_ALL_PATIENTS", "SET_1_NEW_", "FRC_SET_1_NEW_",
        "chisq", "odds_ratio", "dir",
    ]
    lines = [tuple(r) for r in table.collect()]
    assert [x[0] for x in lines] == ["TOTAL", "A:1", "A:2", "A_:1", "B:2", "...", "B:1", "C:1"]
    assert lines[0] == ("TOTAL", "", "100", "", "10", "", "", "", "")
    assert lines[1][:6] == ("A:1", 'say "a", b', "50", "0.50000", "8", "0.80000")
    assert (lines[1][6], lines[1][8]) == ("21.60", "1")  # 3^2 * (1/5 + 1/1 + 1/5 + 1/1)
    assert float(lines[1][7]) == pytest.approx(4)
    assert lines[5] == ("...", "", "", "", "", "", "", "", "")
    assert lines[7][6] == ""  # no chi-square where the cohort has all
    twins = report.report_table(result, "Name", "name")
    assert twins.columns[2:6] == ["NAME_2", "FRC_NAME_2", "NAME_3", "FRC_NAME_3"]
    assert report.label_columns("a b", "A-B")["test"] == "A_B_2"
    assert report.label_columns("x", "FRC_x")["test"] == "FRC_X_2"
    assert twins.count() == len(lines)


@pytest.mark.parametrize(
    "label", [" total", "% chisq", "_odds", "dir", "ccd", "name", "odds ratio", "sort keys", "line", "", "é", "frc", "FRC ccd"]
)
def test_report_takes_any_label(spark, tables, label):
    """Labels like those of other columns and of sort keys; the rows stay the same, and the names unlike."""
    population, test, _, schemes = tables
    result = cmp.compare(cmp.concept_scores(population, test), schemes)
    want = [tuple(r) for r in report.report_table(result, "a", "b").collect()]
    for pair in ((label, "x"), ("x", label), (label, label), (label, f"{label} keys")):
        table = report.report_table(result, *pair)
        assert [tuple(r) for r in table.collect()] == want
        assert len({c.upper() for c in table.columns}) == 9


def test_report_without_an_under_represented_code(spark, tables):
    population, test, _, schemes = tables
    result = cmp.compare(cmp.concept_scores(population, test), schemes, None, ["A:"])
    assert "..." not in codes_of(report.report_table(result, "r", "t"))


def test_csv_and_json_round_trip(spark, tables, tmp_path):
    population, test, _, schemes = tables
    result = cmp.compare(cmp.concept_scores(population, test), schemes)
    schema = result.schema.simpleString()[7:-1].replace(":", " ")
    want = sorted(map(repr, result.collect()))
    sinks.write_csv(result, str(tmp_path / "csv"))
    assert sorted(map(repr, sinks.read_csv(spark, str(tmp_path / "csv"), schema).collect())) == want
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert text.startswith("prefix,ccd,name,") and '"say ""a"", b"' in text
    sinks.write_json(result, str(tmp_path / "json"))
    assert sorted(map(repr, spark.read.schema(schema).json(str(tmp_path / "json")).collect())) == want


def test_payload(spark, tables):
    population, test, _, schemes = tables
    result = cmp.compare(cmp.concept_scores(population, test), schemes, limit=1)
    got = json.loads(sinks.payload(result, "fine", 1))
    assert got["cols"][:3] == ["PREFIX", "CCD", "NAME"] and got["status"] == "fine"
    assert [r[1] for r in got["rows"]] == ["TOTAL", "A:1", "C:1"]
    assert json.loads(sinks.payload(None, "nothing", None)) == {"cols": [], "rows": [], "status": "nothing"}
    for limit in (None, 20_000):
        with pytest.raises(ValueError, match="write_payload"):
            sinks.payload(result, "fine", limit)
