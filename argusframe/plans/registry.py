"""Query registry: Spark plan and, where one exists, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Result in engine-neutral types: zone-less times, doubles at six places, lists as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, rounds: str = "") -> Callable[[Plan], Plan]:
    """Register a plan; `rounds` names the SQL columns to round to six places."""

    def add(fn: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if rounds:
                repl = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in rounds.split())
                text = f"SELECT * REPLACE ({repl}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return fn

    return add
