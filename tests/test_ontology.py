import random

import pytest

from cohortlift.operators import ontology as on
from cohortlift.sources.star import SCHEMAS


def ontology(spark, rows):
    return spark.createDataFrame(rows, SCHEMAS["ontology"])


def node(code, dim, name="n", full=None, total=50, attributes="FA"):
    return (code, dim, name, full if full is not None else dim, total, attributes)


def test_branches_need_a_kind_and_the_global_rule(spark, rows):
    df = ontology(
        spark,
        [
            node("ICD9:250", "\\d\\250\\"),
            node("ICD9:250.1", "\\d\\250\\1\\"),
            node("ICD9:250.12", "\\d\\250\\12\\"),
            node("RX:1", "\\rx\\", name="[CV123] drugs"),
            node("P:1", "\\p\\", full="\\site\\Procedures\\PRC\\Meta1\\x\\A1234_678\\"),
            node("P:2", "\\p\\", full="\\site\\Procedures\\PRC\\Meta1\\x\\B12345678\\"),
            node("LOINC:123-4", "\\l\\1\\"),
            node("LOINC:12345-6", "\\l\\2\\"),
            node("LOINC:12-6", "\\l\\3\\"),
            node("ICD9:251", "\\d\\251\\", total=10),
            node("ICD9:252", "\\d\\252\\", attributes="LA"),
            node(None, "\\d\\253\\", name="[CV124] drugs"),
            node("", "\\d\\254\\", name="[CV125] drugs"),
        ],
    )
    patterns = [*on.BRANCH_PATTERNS, on.procedure_nodes("\\site\\Procedures\\PRC\\")]
    assert "P:1" not in [r.c_basecode for r in on.ontology_branches(df).collect()]
    assert rows(on.ontology_branches(df, patterns), "c_basecode", "is_vf") == [
        ("ICD9:250", False),
        ("ICD9:250.1", False),
        ("LOINC:123-4", True),
        ("LOINC:12345-6", True),
        ("P:1", False),
        ("RX:1", False),
    ]


def test_rules_may_be_columns_sql_or_switched_off(spark, rows):
    df = ontology(spark, [node("A:1", "/a/"), node("LOINC:123-4", "/l/"), node("B:1", "/b/", total=1)])
    only_a = on.ontology_branches(df, "c_basecode LIKE 'A:%'", False)
    assert rows(only_a, "c_basecode") == [("A:1",)]
    all_of_them = on.ontology_branches(df, True, False, "c_basecode IS NOT NULL")
    assert len(rows(all_of_them)) == 3
    small = on.ontology_branches(df, False, on.VALUE_FLAG_PATTERNS, on.populated_folders(49))
    assert rows(small, "c_basecode") == [("LOINC:123-4",)]


def brute_force(nodes, concepts, match):
    def hit(path, dim):
        if match == "prefix":
            return path.startswith(dim)
        import re

        pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in dim)
        return re.match(pattern, path, re.S) is not None

    found = {}
    for path, code, _ in concepts:
        for base, dim, is_vf in nodes:
            if dim and base and code and path and hit(path, dim):
                found[code, base] = found.get((code, base), False) or is_vf
    return sorted((c, b, v) for (c, b), v in found.items())


@pytest.mark.parametrize("match", ["prefix", "like"])
@pytest.mark.parametrize("small", [None, True, False])
def test_branch_map_equals_a_prefix_match_of_every_pair(spark, rows, match, small):
    rnd = random.Random(7)
    sep = "\\"

    def path(depth):
        return sep + "".join(rnd.choice(["a", "b", "A_", "ab", "c%d", "~"]) + sep for _ in range(depth))

    concepts = [(path(rnd.randint(0, 4)), f"C:{rnd.randint(0, 60)}", "x") for _ in range(200)]
    concepts += [("no separator", "C:1", "x"), ("", "C:2", "x"), (sep + "a", "C:3", "x"), (sep + "a", "", "x")]
    dims = [path(rnd.randint(0, 3)) for _ in range(40)]
    dims += [d[:-1] for d in dims[:20]] + [sep + "a" + sep + "a", "no", None, "", sep + "_" + sep, sep + "%b", "%~%"]
    nodes = [(f"B:{i % 30}", d, i % 3 == 0) for i, d in enumerate(dims)]
    branches = spark.createDataFrame(
        [(b, d, "n", d, 50, "FA", v) for b, d, v in nodes], SCHEMAS["ontology"] + ", is_vf boolean"
    )
    dimension = spark.createDataFrame(concepts, SCHEMAS["concepts"])
    got = rows(on.concept_branch_map(branches, dimension, sep, match, small=small))
    assert got == brute_force(nodes, concepts, match)
    assert got


def test_branch_map_plan_has_no_nested_loop(spark, plan):
    branches = ontology(spark, [node("LOINC:123-4", "/l/1/")])
    dimension = spark.createDataFrame([("/l/1/2/", "C:1", "x")], SCHEMAS["concepts"])
    for small in (True, False):
        text = plan(on.concept_branch_map(on.ontology_branches(branches), dimension, "/", small=small))
        assert "NestedLoop" not in text and "Cartesian" not in text
    with pytest.raises(ValueError):
        on.concept_branch_map(branches, dimension, "/", "regex")
