"""The clinical star schema and its readers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "facts": "patient_num bigint, concept_cd string, valueflag_cd string",
    "concepts": "concept_path string, concept_cd string, name_char string",
    "ontology": "c_basecode string, c_dimcode string, c_name string, c_fullname string, "
    "c_totalnum bigint, c_visualattributes string",
    "schemes": "c_key string, c_name string, c_description string",
    "query_masters": "query_master_id bigint",
    "query_instances": "query_instance_id bigint, query_master_id bigint",
    "query_results": "result_instance_id bigint, query_instance_id bigint, result_type_id int",
    "patient_sets": "result_instance_id bigint, patient_num bigint",
}

# The names these tables have in a clinical data warehouse.
TABLE_NAMES = {
    "facts": "observation_fact",
    "concepts": "concept_dimension",
    "ontology": "ontology",
    "schemes": "schemes",
    "query_masters": "qt_query_master",
    "query_instances": "qt_query_instance",
    "query_results": "qt_query_result_instance",
    "patient_sets": "qt_patient_set_collection",
}


@dataclass(frozen=True)
class Star:
    """The input tables, each with (at least) the columns of :data:`SCHEMAS`.

    ``sources`` names the files or folders of tables that are read from files, ``versions`` a text for others that
    their owner changes with them; tables with neither are taken not to change. ``reread`` gives the star with its
    files listed anew, ``facts_from`` the facts of some of their files only.
    """

    facts: DataFrame
    concepts: DataFrame
    ontology: DataFrame
    schemes: DataFrame
    query_masters: DataFrame
    query_instances: DataFrame
    query_results: DataFrame
    patient_sets: DataFrame
    sources: Mapping[str, list[str]] = field(default_factory=dict)
    versions: Mapping[str, str] = field(default_factory=dict)
    reread: Callable[[], Star] | None = None
    facts_from: Callable[[list[str]], DataFrame] | None = None

    def __post_init__(self) -> None:
        for name in SCHEMAS:
            object.__setattr__(self, name, conform(getattr(self, name), name))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the table's columns with their types; Spark prunes the rest from the scan.

    A column that already has its type is left untouched, so filters on it still reach the files.
    """
    have = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    columns = []
    for name, kind in (c.strip().split(" ") for c in SCHEMAS[table].split(",")):
        if name not in have:
            raise ValueError(f"{table}: no column {name}")
        column = F.col(name)
        columns.append(column.alias(name) if have[name] == kind else column.cast(kind).alias(name))
    return df.select(*columns)


def read_star(
    spark: SparkSession, root: str, format: str = "parquet", names: dict[str, str] | None = None, **options
) -> Star:
    """Read the star from files: ``<root>/<table name>`` in any format Spark reads."""
    paths = {t: f"{root}/{name}" for t, name in {**TABLE_NAMES, **(names or {})}.items()}
    tables = {t: spark.read.format(format).options(**options).load(path) for t, path in paths.items()}
    return Star(
        **tables,
        sources={t: [path] for t, path in paths.items()},
        reread=lambda: read_star(spark, root, format, names, **options),
        facts_from=_some_files(tables["facts"], paths["facts"], format, options),
    )


def growing_facts(star: Star, spark: SparkSession, path: str, format: str = "parquet", **options) -> Star:
    """The star with facts read from the files under ``path``, which may be added to."""

    def read() -> Star:
        facts = spark.read.format(format).options(**options).load(path)
        return replace(
            star,
            facts=facts,
            sources={**star.sources, "facts": [path]},
            reread=read,
            facts_from=_some_files(facts, path, format, options),
        )

    return read()


def _some_files(table: DataFrame, root: str, format: str, options: dict) -> Callable[[list[str]], DataFrame]:
    """Reads some files of a table, with the columns that its folders name."""

    def read(files: list[str]) -> DataFrame:
        reader = table.sparkSession.read.schema(table.schema).format(format).options(**options)
        return reader.option("basePath", root).load(files)

    return read


def catalog_star(
    spark: SparkSession, schema: str, metaschema: str, names: dict[str, str] | None = None
) -> Star:
    """Read the star from catalog tables; ontology and schemes are in ``metaschema``."""
    names = {**TABLE_NAMES, **(names or {})}
    full = {t: f"{metaschema if t in ('ontology', 'schemes') else schema}.{name}" for t, name in names.items()}
    places = {t: _location(spark, name) for t, name in full.items()}
    return Star(
        **{t: spark.table(name) for t, name in full.items()},
        sources={t: [place] for t, place in places.items() if place},
        reread=lambda: _refreshed(spark, full, schema, metaschema, names),
    )


def _refreshed(spark: SparkSession, full: dict[str, str], schema: str, metaschema: str, names: dict) -> Star:
    for name in full.values():
        spark.catalog.refreshTable(name)
    return catalog_star(spark, schema, metaschema, names)


def _location(spark: SparkSession, table: str) -> str | None:
    """The folder of a table's files; None for a view and for tables of other systems."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def jdbc_star(
    spark: SparkSession,
    url: str,
    schema: str,
    metaschema: str,
    patient_bounds: tuple[int, int],
    partitions: int,
    names: dict[str, str] | None = None,
    versions: dict[str, str] | None = None,
    **options,
) -> Star:
    """Read the star from a database; facts and patient sets in parallel slices of patient ids.

    ``versions`` names the state of its tables, such as the number of the last load.
    """
    names = {**TABLE_NAMES, **(names or {})}
    tables = {}
    for t, name in names.items():
        home = metaschema if t in ("ontology", "schemes") else schema
        reader = spark.read.format("jdbc").options(url=url, dbtable=f"{home}.{name}", **options)
        if t in ("facts", "patient_sets"):
            reader = reader.options(
                partitionColumn="patient_num",
                lowerBound=patient_bounds[0],
                upperBound=patient_bounds[1],
                numPartitions=partitions,
            )
        tables[t] = _lower(reader.load())
    return Star(**tables, versions=versions or {})


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
