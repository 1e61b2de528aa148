"""Where named queries are declared, one entry per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .session import ship_package
from .tables import CTES, Tables

_SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
_SQL_TYPES = {"l": "bigint", "d": "double", "s": "varchar", "b": "boolean"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    body: str | None
    uses: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        out = self.build(Tables(spark, sf_dir))
        return out.select(*[F.col(c).cast(_SPARK_TYPES[t]).alias(c) for c, t in self.columns])

    def sql(self) -> str | None:
        if self.body is None:
            return None
        ctes = ",\n".join(f"{name} as ({CTES[name]})" for name in self.uses)
        columns = ", ".join(f"cast({c} as {_SQL_TYPES[t]}) as {c}" for c, t in self.columns)
        head = f"with recursive {ctes}\n" if ctes else ""
        return f"{head}select {columns} from (\n{self.body.strip()}\n) q"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, uses: str = ""):
    """Declare a query: output columns as ``name:type``, and its SQL twin.

    ``uses`` lists the domain tables the SQL reads; they are put in front as
    common table expressions.
    """

    def wrap(build):
        spec = tuple(tuple(c.split(":")) for c in columns.split())
        if name in QUERIES:
            raise ValueError(f"query {name} is declared twice")
        QUERIES[name] = Query(name, spec, build, sql, tuple(uses.split()))
        return build

    return wrap


def load_all() -> dict[str, Query]:
    from .plans import catalogs, evaluation, grids, learned, samples, selection, stacks, storage, training  # noqa: F401

    return QUERIES
