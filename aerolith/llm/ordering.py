"""Positions of rows in an order, without a group in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.session import store


def positions(df, by, order, name="position"):
    """df with `name`: the gapless position of a row in its group, from 0.

    Rows are cut into ranges of (group, order), rows are numbered inside a range and the ranges'
    few counts give the offsets. Rows that tie in the whole order are told apart by a row
    number, so that ties of any size are cut too. df is read twice; give a stored table.
    """
    by, order = [F.col(b) for b in by], list(order)
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*by, *order, "__row").withColumn("__cell", F.spark_partition_id())
    celled = store(ranged.withColumn("__group", F.struct(F.lit(0), *by)), "ranges")
    counts = celled.groupBy("__group", "__cell").agg(F.count("*").alias("__count"))
    before = Window.partitionBy("__group").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__group", "__cell", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__group", "__cell").orderBy(*order, "__row")
    numbered = celled.withColumn("__r", F.row_number().over(inside)).join(
        offsets.withColumnsRenamed({"__group": "__g", "__cell": "__c"}),
        F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__cell") == F.col("__c")))
    return numbered.select(*df.columns, (F.col("__offset") + F.col("__r") - 1).cast("long").alias(name))
