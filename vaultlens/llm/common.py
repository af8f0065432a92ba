"""What the operators share: the shared folder, stored intermediate tables, words and global ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, and what stands between words, as Java and RE2 write it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def held(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """df with one more column whose value is worked out once for each row.

    Spark writes a column's expression into the filters, lambdas and projections that use it, where it would run once for each use and
    element; it doesn't for the single element of an exploded array.
    """
    return df.select("*", F.explode(F.array(F.expr(value) if isinstance(value, str) else value)).alias(name))


#: Folders of the tables that stored has written.
_made: list[str] = []

#: A key that holds over 1/HOT of all rows is hot: there are fewer than HOT such keys, however many rows there are.
HOT = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session, where both are one machine, may go without."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not (found := context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vaultlens-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: lineage ends here and lost executors cost nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """stored(make()), and the tables that were stored on the way to it are deleted."""
    mark = len(_made)
    out = stored(make(), name)
    for path in _made[mark:-1]:
        remove(spark, path)
    del _made[mark:-1]
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def by_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner", hot: int = HOT) -> DataFrame:
    """rows joined (inner, left or left_semi) with table, whatever share of the rows one key holds.

    table has one row for each key, and n: the rows of that key (or more), of total in all. The fewer than
    ``hot`` keys that hold over 1/hot of total are broadcast and their rows stay where they are; no other key
    can fill a shuffle partition. how "left": the first key is a 64-bit hash.
    """
    often = F.col("n") * hot > total
    few, rest = F.broadcast(table.filter(often).drop("n")), table.filter(~often).drop("n")
    if how == "left":
        values = [c for c in table.columns if c not in (*keys, "n")]
        near = rows.join(few.withColumn("_near", F.lit(True)), keys, "left")
        # rows that have found theirs are dealt by their own hash and meet nothing
        near = near.withColumn("_away", F.when(F.col("_near"), F.xxhash64(*rows.columns)).otherwise(F.col(keys[0])))
        far = rest.withColumnsRenamed({keys[0]: "_away"} | {v: f"_{v}" for v in values})
        return near.join(far, ["_away", *keys[1:]], "left").select(*rows.columns, *[F.coalesce(v, f"_{v}").alias(v) for v in values])
    near = rows.join(few, keys, how)
    far = rows.join(F.broadcast(table.filter(often).select(*keys)), keys, "left_anti").join(rest, keys, how)
    return near.unionByName(far)


def salted(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column, total: int, how: str = "left", hot: int = HOT) -> DataFrame:
    """rows joined with table (one row for each key, and n as in by_key) whose rows are too wide to be broadcast.

    A key that holds over 1/hot of total is cut into so many parts that none does, by salt, a hash; fewer than ``hot`` keys and numbers are
    broadcast, and fewer than 2 * ``hot`` rows of table are added.
    """
    cut = table.withColumn("_parts", F.ceil(F.col("n") * hot / F.lit(max(total, 1))).cast("int")).drop("n")
    few = F.broadcast(cut.filter("_parts > 1").select(*keys, "_parts"))
    dealt = rows.join(few, keys, "left").withColumn("_part", F.pmod(salt, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    spread = cut.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")


def ranked(df: DataFrame, keys: list[str], name: str, index: str = "rank") -> DataFrame:
    """All rows with their 0-based place in the order of keys, as column index.

    Rows go to range partitions, so a hot key spreads over as many tasks as it
    needs; the place inside a partition comes from the sorted partition itself,
    and only the partitions' row counts (one row for each partition) meet in a
    window. The result is stored, as ranges are sampled and must not be drawn twice.
    """
    at = F.monotonically_increasing_id()
    cut = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at), name)
    chunk = F.shiftright("_at", 33)
    counts = cut.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("_n"))
    before = counts.selectExpr("_chunk", "coalesce(sum(_n) over (order by _chunk rows between unbounded preceding and 1 preceding), 0) as _before")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return cut.withColumn("_chunk", chunk).join(before, "_chunk").withColumn(index, place).drop("_chunk", "_before", "_at")
