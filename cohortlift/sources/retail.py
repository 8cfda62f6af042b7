"""A clinical star made from order-history tables: customers stand in for patients.

Facts are order priorities and states, customer segments and line items (with a high/low flag from
the quantity). Parts are the concepts, with a two-level hierarchy of type and size. Patient sets
are customer segments, and the customers a supplier delivered to in one year.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.operators.ontology import BRANCH_PATTERNS, populated_folders, procedure_nodes
from cohortlift.plans.study import Rules
from cohortlift.sources.stage import StageTables
from cohortlift.sources.star import SCHEMAS, Star

# Patient sets 1 to 5.
BUILDING, BUILDING_NEAR, MACHINERY, ONE_CUSTOMER, NOBODY = 1, 2, 3, 4, 5

# Lineage of the five sets: (query master, query instance, patient set). Master 11 ran twice.
_RUNS = [(11, 101, 1), (11, 102, 2), (12, 103, 3), (13, 104, 4), (14, 105, 5)]

# Patient sets of suppliers have ids from here on: master 1000 + supplier, then year, then type.
_FIRST_SUPPLIER_SET = 100_000
_OTHER_RESULT = 50_000_000_000


def retail_rules() -> Rules:
    """Customers with a finished order are active; folders need three parts."""
    return Rules(
        active="concept_cd LIKE 'DISP:F%'",
        every_branch=populated_folders(2),
        separator="/",
    )


def retail_star(spark: SparkSession, sf_dir: str, stage: StageTables) -> Star:
    """The star over ``<sf_dir>/*.parquet``, written once as tables and then read."""

    def read(name: str, *columns: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)

    patient_sets = stage.table(
        "patient_sets", lambda: _patient_sets(read), range_by="result_instance_id"
    )
    return Star(
        facts=stage.table("facts", lambda: _facts(read)),
        concepts=stage.table("concepts", lambda: _concepts(read)),
        ontology=stage.table("ontology", lambda: _ontology(read)),
        schemes=_schemes(spark),
        patient_sets=patient_sets,
        **_lineage(stage.table("runs", lambda: _runs(spark, patient_sets))),
    )


def site_rules() -> Rules:
    """The retail rules with procedure categories among the branches."""
    return replace(retail_rules(), branch=[*BRANCH_PATTERNS, procedure_nodes("/proc/", "/")])


def site_star(spark: SparkSession, sf_dir: str, stage: StageTables) -> Star:
    """The retail star with the other kinds of codes that a clinical site has.

    Order dates are diagnoses below three-digit (year) and four-digit (quarter) ICD9 nodes, returns are procedures
    below categories, customers have tumor registry codes, and priorities are graded in codes that hold a flag's
    text inside.
    """

    def read(name: str, *columns: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)

    star = retail_star(spark, sf_dir, stage)
    return replace(
        star,
        facts=stage.table("site_facts", lambda: star.facts.unionByName(_site_facts(read))),
        concepts=stage.table("site_concepts", lambda: star.concepts.unionByName(_site_concepts(read))),
        ontology=stage.table("site_ontology", lambda: star.ontology.unionByName(_site_nodes(read))),
    )


def _dated() -> dict:
    year = F.lpad((F.year("o_orderdate") - 1700).cast("string"), 3, "0")
    return {"year": year, "quarter": F.quarter("o_orderdate").cast("string"), "grade": F.substring("o_orderpriority", 1, 1)}


def _diagnoses(read) -> DataFrame:
    orders = read("orders", "o_custkey", "o_orderdate", "o_orderpriority").where("o_orderdate is not null")
    code = F.concat_ws("|", F.lit("DX"), "year", "quarter", "grade")
    return orders.withColumns(_dated()).withColumn("code", code)


def _returns(read) -> DataFrame:
    return read("lineitem", "l_orderkey", "l_returnflag", "l_linestatus").withColumn(
        "code", F.concat_ws("|", F.lit("PROC"), "l_returnflag", "l_linestatus")
    )


def _site_facts(read) -> DataFrame:
    def facts(df: DataFrame, patient: str, *found) -> DataFrame:
        none = F.lit(None).cast("string").alias("valueflag_cd")
        return df.select(F.col(patient).alias("patient_num"), F.explode(F.array(*found)).alias("concept_cd"), none)

    orders = read("orders", "o_orderkey", "o_custkey")
    returns = _returns(read).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    customers = read("customer", "c_custkey", "c_nationkey", "c_mktsegment")
    registry = F.concat(F.lit("NAACCR|"), F.col("c_nationkey"), F.lit(":"), F.col("c_mktsegment"))
    graded = F.concat(F.lit("GRADE:H_"), "o_orderpriority")
    ranked = F.concat(F.lit("L_RANK:L_"), "o_orderpriority")
    return (
        facts(_diagnoses(read), "o_custkey", F.col("code"), graded, ranked)
        .unionByName(facts(returns, "o_custkey", F.col("code")))
        .unionByName(facts(customers, "c_custkey", registry))
    )


def _site_concepts(read) -> DataFrame:
    def concepts(df: DataFrame, path, code, name) -> DataFrame:
        found = df.select(path.alias("concept_path"), code.alias("concept_cd"), name.alias("name_char"))
        return found.distinct()

    diagnoses, returns = _diagnoses(read), _returns(read)
    path = F.concat(F.lit("/dx/"), F.concat_ws("/", "year", "quarter", "grade"), F.lit("/"))
    name = F.concat_ws(" ", F.lit("ordered"), "year", "quarter", "grade")
    category = F.concat(F.lit("/proc/Meta1/"), "l_returnflag", F.lit("0000000"), "l_linestatus", F.lit("/x/"))
    graded = F.concat(F.lit("GRADE:"), "o_orderpriority")
    ranked = F.concat(F.lit("RANK:"), "o_orderpriority")
    return (
        concepts(diagnoses, path, F.col("code"), name)
        .unionByName(concepts(returns, category, F.col("code"), F.lit("returned")))
        .unionByName(concepts(diagnoses, F.concat(F.lit("/grade/"), "grade", F.lit("/")), graded, F.lit("a grade")))
        .unionByName(concepts(diagnoses, F.concat(F.lit("/rank/"), "grade", F.lit("/")), ranked, F.lit("a rank")))
    )


def _site_nodes(read) -> DataFrame:
    """Years, quarters, grades (too deep for a branch) and categories of returns (branches if they start with A)."""

    def nodes(df: DataFrame, base, dim, name) -> DataFrame:
        return (
            df.groupBy(base.alias("c_basecode"), dim.alias("c_dimcode"), name.alias("c_name"))
            .agg(F.count("*").alias("c_totalnum"))
            .select(
                "c_basecode", "c_dimcode", "c_name", F.col("c_dimcode").alias("c_fullname"),
                "c_totalnum", F.lit("FA").alias("c_visualattributes"),
            )
        )

    diagnoses, returns = _diagnoses(read), _returns(read)
    year, quarter, grade = F.col("year"), F.col("quarter"), F.col("grade")
    category = F.concat("l_returnflag", F.lit("0000000"), "l_linestatus")
    return (
        nodes(diagnoses, F.concat(F.lit("ICD9:"), year), F.concat(F.lit("/dx/"), year, F.lit("/")), year)
        .unionByName(
            nodes(
                diagnoses,
                F.concat(F.lit("ICD9:"), year, F.lit("."), quarter),
                F.concat(F.lit("/dx/"), year, F.lit("/"), quarter, F.lit("/")),
                F.concat_ws(" ", year, quarter),
            )
        )
        .unionByName(
            nodes(
                diagnoses,
                F.concat(F.lit("ICD9:"), year, F.lit("."), quarter, grade),
                F.concat(F.lit("/dx/"), F.concat_ws("/", year, quarter, grade), F.lit("/")),
                F.concat_ws(" ", year, quarter, grade),
            )
        )
        .unionByName(
            nodes(
                returns,
                F.concat(F.lit("PRC:"), category),
                F.concat(F.lit("/proc/Meta1/"), category, F.lit("/")),
                F.concat(F.lit("returns "), category),
            )
        )
    )


def _facts(read) -> DataFrame:
    def unflagged(df: DataFrame, patient: str, *concepts) -> DataFrame:
        return df.select(
            F.col(patient).alias("patient_num"),
            F.explode(F.array(*concepts)).alias("concept_cd"),
            F.lit(None).cast("string").alias("valueflag_cd"),
        )

    orders = read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    quantity = F.col("l_quantity")
    labs = (
        read("lineitem", "l_orderkey", "l_partkey", "l_quantity")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("patient_num"),
            F.concat(F.lit("LAB|"), F.col("l_partkey")).alias("concept_cd"),
            F.when(quantity > 40, "H").when(quantity < 10, "L").otherwise("N").alias("valueflag_cd"),
        )
    )
    order_facts = unflagged(
        orders,
        "o_custkey",
        F.concat(F.lit("PRIO:"), F.col("o_orderpriority")),
        F.concat(F.lit("DISP:"), F.col("o_orderstatus")),
    )
    customers = read("customer", "c_custkey", "c_mktsegment")
    segments = unflagged(customers, "c_custkey", F.concat(F.lit("SEG:"), F.col("c_mktsegment")))
    return order_facts.unionByName(segments).unionByName(labs)


def _sized() -> tuple:
    size = F.lpad(F.col("p_size").cast("string"), 3, "0")
    folder = F.concat(F.lit("/lab/"), F.col("p_type"), F.lit("/"))
    return size, folder


def _concepts(read) -> DataFrame:
    size, folder = _sized()
    return read("part", "p_partkey", "p_name", "p_type", "p_size").select(
        F.concat(folder, size, F.lit("/"), F.col("p_partkey"), F.lit("/")).alias("concept_path"),
        F.concat(F.lit("LAB|"), F.col("p_partkey")).alias("concept_cd"),
        F.col("p_name").alias("name_char"),
    )


def _ontology(read) -> DataFrame:
    size, folder = _sized()
    parts = read("part", "p_type", "p_size")

    def nodes(keys: list[str], basecode, dimcode, name) -> DataFrame:
        return (
            parts.groupBy(*keys)
            .agg(F.count("*").alias("c_totalnum"))
            .select(
                basecode.alias("c_basecode"),
                dimcode.alias("c_dimcode"),
                name.alias("c_name"),
                dimcode.alias("c_fullname"),
                "c_totalnum",
                F.lit("FA").alias("c_visualattributes"),
            )
        )

    kind = F.col("p_type")
    sizes = nodes(
        ["p_type", "p_size"],
        F.concat(F.lit("LOINC:"), size, F.lit("-"), F.length("p_type")),
        F.concat(folder, size, F.lit("/")),
        F.concat(kind, F.lit(" size "), F.col("p_size")),
    )
    types = nodes(
        ["p_type"],
        F.concat(F.lit("KIND:"), kind),
        folder,
        F.concat(F.lit("[CLASS] "), kind),
    )
    return sizes.unionByName(types)


def _schemes(spark: SparkSession) -> DataFrame:
    rows = [
        ("PRIO:", "PRIO", "Order priority"),
        ("SEG:", "SEG", "Market segment"),
        ("LOINC:", "LOINC", "Part type and size"),
    ]
    return spark.createDataFrame(rows, SCHEMAS["schemes"])


def _patient_sets(read) -> DataFrame:
    customers = read("customer", "c_custkey", "c_mktsegment", "c_nationkey")
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    segment = F.col("c_mktsegment")
    sets = F.array(
        F.when(segment == "BUILDING", F.lit(BUILDING)),
        F.when((segment == "BUILDING") & (F.col("c_nationkey") < 5), F.lit(BUILDING_NEAR)),
        F.when(segment == "MACHINERY", F.lit(MACHINERY)),
    )
    by_segment = customers.select(
        F.explode(F.array_compact(sets).cast("array<bigint>")).alias("result_instance_id"),
        F.col("c_custkey").alias("patient_num"),
    )
    first_finished = F.min_by("o_custkey", "o_orderkey").alias("patient_num")
    one = (
        orders.where("o_orderstatus = 'F'")
        .agg(first_finished)
        .select(F.lit(ONE_CUSTOMER).cast("bigint").alias("result_instance_id"), "patient_num")
    )
    year = F.year("o_orderdate") % 100
    deliveries = (
        read("lineitem", "l_orderkey", "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (((1000 + F.col("l_suppkey")) * 100 + year) * 10 + 1).alias("result_instance_id"),
            F.col("o_custkey").alias("patient_num"),
        )
    )
    return by_segment.unionByName(one).unionByName(deliveries)


def _runs(spark: SparkSession, patient_sets: DataFrame) -> DataFrame:
    result = F.col("result_instance_id")
    derived = (
        patient_sets.where(result >= _FIRST_SUPPLIER_SET)
        .select("result_instance_id")
        .distinct()
        .select(
            F.expr("result_instance_id div 1000").alias("query_master_id"),
            F.expr("result_instance_id div 10").alias("query_instance_id"),
            "result_instance_id",
        )
    )
    named = spark.createDataFrame(
        _RUNS, "query_master_id bigint, query_instance_id bigint, result_instance_id bigint"
    )
    return named.unionByName(derived)


def _lineage(runs: DataFrame) -> dict[str, DataFrame]:
    """Each run has a patient set and, with a higher id, a result of another type."""
    result = F.col("result_instance_id")
    kinds = F.array(
        F.struct(result.alias("result_instance_id"), F.lit(1).alias("result_type_id")),
        F.struct((result + _OTHER_RESULT).alias("result_instance_id"), F.lit(2).alias("result_type_id")),
    )
    return {
        "query_masters": runs.select("query_master_id").distinct(),
        "query_instances": runs.select("query_instance_id", "query_master_id").distinct(),
        "query_results": runs.select(F.inline(kinds), "query_instance_id"),
    }
