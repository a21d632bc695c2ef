"""Exact duplicates by a tree merge of sorted digest runs.

Every partition of the input is a run: its digests, sorted. Runs meet in rounds: round r
joins FANOUT neighbouring groups of runs, sorts their entries together and keeps one entry
per digest with the smallest (or largest) identifier and the number of copies. The
answers then travel down the same tree, so that a digest that a third of all rows share
never meets more than FANOUT entries, on the way up or down. Digests of one round are
dealt by (group, digest): no task holds a whole run of a late round.

Entries merge only if three independent values agree: SHA-256, byte length, XXH64.

Defined cases: a null text counts as empty; rows that repeat an identifier are separate
rows of which one stays; a null identifier stays only if its group has no other; an empty
table gives an empty result; columns other than the two named ones are never read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from aerolith.session import store

FANOUT = 8

KEY = ["digest", "size", "check"]
#: An entry of a run. Whether a batch says its columns may be null differs between batches.
SHAPE = pa.schema([("grp", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("check", pa.int64()),
                   ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("copies", pa.int64())])


def _firsts(batches):
    """One entry per (grp, key) of a sorted stream: its first row, with the copies added up."""
    names = SHAPE.names
    held = None
    for batch in batches:
        table = pa.Table.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names], schema=SHAPE)
        if table.num_rows == 0:
            continue
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        starts = np.zeros(1, np.int64)
        if table.num_rows > 1:
            new = None
            for name in ["grp", *KEY]:
                column = table[name].combine_chunks()
                differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                new = differs if new is None else pc.or_(new, differs)
            starts = np.append(starts, pc.indices_nonzero(new).to_numpy().astype(np.int64) + 1)
        sums = np.add.reduceat(table["copies"].to_numpy(), starts)
        merged = table.take(pa.array(starts)).set_column(
            names.index("copies"), "copies", pa.array(sums, pa.int64()))
        held = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _merge(entries, keep):
    """Merge the sorted entries of each partition; equal keys of a group stand together."""
    best = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    return entries.sortWithinPartitions("grp", *KEY, best, "keep_row").mapInArrow(
        _firsts, "grp long, digest binary, size long, check long, keep_id long, keep_row long, copies long")


def groups(docs, id_col="doc_id", text_col="text", keep="smallest", normalise=None):
    """Stored rows (row, id, digest, size, keep_id, keep_row, copies), one per input row.

    keep is "smallest" or "largest"; normalise, if given, maps the text column before hashing.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if normalise is not None:
        text = normalise(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("run"), "id",
        F.unhex(F.sha2(F.col("t"), 256)).alias("digest"), F.octet_length("t").cast("long").alias("size"),
        F.xxhash64("t").alias("check"))
    rows = store(rows, "digest-rows")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = store(_merge(rows.select(
        F.col("run").alias("grp"), *KEY, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"),
        F.lit(1).cast("long").alias("copies")).repartition("grp", *KEY), keep), "digest-run")
    levels = [level]
    while runs > 1:
        runs = -(-runs // FANOUT)
        joined = level.withColumn("grp", F.floor(F.col("grp") / FANOUT)).repartition("grp", *KEY)
        level = store(_merge(joined, keep), "digest-round")
        levels.append(level)
    answer = levels.pop()
    won = ["keep_id", "keep_row", "copies"]
    while levels:
        below = levels.pop().select("grp", *KEY).withColumn("up", F.floor(F.col("grp") / FANOUT))
        answer = below.join(answer.withColumnRenamed("grp", "up"), ["up", *KEY]).select("grp", *KEY, *won)
    return rows.join(answer.withColumnRenamed("grp", "run"), ["run", *KEY]).select("row", "id", "digest", "size", *won)


def deduplicate(docs, id_col="doc_id", text_col="text", keep="smallest", normalise=None):
    """The rows of docs that stay, with all their columns.

    A row that stays is known by its identifier and digest. Only where rows repeat both does
    a last step drop the repeats, which costs another exchange of the texts.
    """
    found = groups(docs, id_col, text_col, keep, normalise)
    chosen = F.col("row") == F.col("keep_row")
    unrepeated = found.groupBy("id", "digest").count().where("count > 1").isEmpty()
    kept = found.where(chosen).select("id", F.lower(F.hex("digest")).alias("key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return keep_rows(docs, kept, id_col, F.sha2(text if normalise is None else normalise(text), 256), unrepeated)


def keep_rows(docs, kept, id_col, key, unrepeated):
    """The rows of docs whose identifier and text key are in kept (id, key), with docs' own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).cast("long").alias("own"), key.alias("own_key"))
    one = rows.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    return (one if unrepeated else one.dropDuplicates(["own", "own_key"])).select("whole.*")
