"""Named queries over the given tables, each with equivalent SQL where SQL can say it."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.session import prepare

QUERIES = {}
ORACLES = {}


def present(df, digits=6):
    """Comparable output: rounded doubles, wide integers, zone-free times."""
    shown = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), digits)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def query(name, sql=None, digits=6):
    def register(run):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: present(run(prepare(spark), sf_dir), digits)
        if sql:
            ORACLES[name] = sql
        return run

    return register


def shown(sql, plain, doubles, digits=6):
    """The same rounding on the SQL side. Adding 0.0 turns -0.0 into 0.0."""
    columns = plain.split() + [f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(columns)} FROM ({sql}) AS shown_rows"
