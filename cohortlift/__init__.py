"""Cohort over/under-representation analytics on Spark."""

from cohortlift.plans.study import Rules, Run, Study
from cohortlift.sources.stage import StageTables
from cohortlift.sources.star import Star, catalog_star, jdbc_star, read_star

__all__ = [
    "Rules", "Run", "StageTables", "Star", "Study", "catalog_star", "jdbc_star", "read_star",
]
