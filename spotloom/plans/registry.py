"""Name -> query and name -> DuckDB oracle, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spotloom.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The views and tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "boundaries":
            return fixtures.boundaries(self.spark, self.sf_dir)
        return fixtures.view(self.spark, self.sf_dir, name)


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Register a function of Views under its name, with the SQL that gives the same rows."""

    def put(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = fixtures.with_views(sql, *views)
        return f

    return put


from spotloom.plans import catalog, catalog_models, catalog_more, catalog_tables  # noqa: E402, F401
