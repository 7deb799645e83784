"""One catalog and the statements over it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quernel.catalog import Catalog, IndexEntry, Table
from quernel.errors import BindError
from quernel.plans.binder import Binder, Query
from quernel.plans.explain import outline
from quernel.plans.scratch import materialize
from quernel.sources.csv import load_csv, table_name
from quernel.sql import parse, parse_select
from quernel.sql.ast import CreateIndex, Select


class Engine:
    """``use_indexes`` False makes every access path a scan; results are the same. So they are with estimated statistics."""

    def __init__(self, spark: SparkSession, use_indexes: bool = True, exact_statistics: bool = True):
        self.spark = spark
        self.catalog = Catalog(spark, exact_statistics)
        self.use_indexes = use_indexes

    def load_csv(self, path: str, name: str | None = None) -> Table:
        """Parse the file once: queries read the typed copy that is written here. Malformed rows raise here."""
        typed = load_csv(self.spark, path)
        kept = materialize(typed.toDF(*[f"c{i}" for i in range(len(typed.columns))]), "csv").toDF(*typed.columns)
        return self.catalog.add_table(name or table_name(path), kept)

    def bind(self, sql: str) -> Query:
        return Binder(self.catalog, self.use_indexes).bind(parse_select(sql))

    def query(self, sql: str) -> DataFrame:
        """The DataFrame of a SELECT; nothing runs yet."""
        return self.bind(sql).frame

    def explain(self, sql: str) -> str:
        """The cost-annotated outline of a SELECT."""
        return outline(self.bind(sql)).render()

    def execute(self, text: str) -> DataFrame | IndexEntry | str:
        """SELECT gives a DataFrame, CREATE INDEX the index, EXPLAIN SELECT text."""
        explained = re.match(r"\s*EXPLAIN\s+", text, re.IGNORECASE)
        statement = parse(text[explained.end() :] if explained else text)
        if isinstance(statement, CreateIndex):
            if explained:
                raise BindError("only SELECT can be explained")
            return self.catalog.create_index(statement.table, statement.column, statement.kind)
        assert isinstance(statement, Select)
        bound = Binder(self.catalog, self.use_indexes).bind(statement)
        return outline(bound).render() if explained else bound.frame
