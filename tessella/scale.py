"""Helpers that keep plans safe when one key holds a large share of all rows.

Everything here is exact: hot keys are split over several tasks, never dropped
or sampled.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# Rows of narrow columns that a broadcast side may hold (checked by counting).
BROADCAST_ROWS = 200_000
# Rows of two or three numbers that one task of a loop may take (checked by counting).
LOOP_ROWS = 500_000
# Rows of one key that a task of a join is meant to take at most.
ROWS_PER_TASK = 1_000_000


def session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine relies on; ``conf`` and what the cluster was
    started with win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        if not given.contains(key) and key not in conf:
            spark.conf.set(key, value)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder comes from ``spark.checkpoint.dir``. Only a session on one machine may go
    without: it gets a temporary folder. On a cluster a missing setting is an error, since
    executors do not share their disks.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tessella-ckpt-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for tables that a query writes, next to the checkpoints."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_files(spark: SparkSession) -> None:
    """Let Spark delete shuffle files, and checkpoints where it is set to, of finished tables.

    It does so once the driver's garbage is collected, which a loop over tables otherwise only
    sees when the driver's memory fills.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what its rows amount to, once some action has read all of them: counts come
    with the write instead of a second scan. ``Observation.get`` waits for that action."""
    watch = Observation()
    return df.observe(watch, *[m.alias(name) for name, m in metrics.items()]), watch


def spread(df: DataFrame, splits: int = 64) -> DataFrame:
    """Give a table of few splits to all cores.

    Small files come as one split. A table with ``splits`` splits or more is left as it
    is, however many cores there are, so at most so many splits are ever shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, splits) else df


def gathered(df: DataFrame, n: int, rows: int = LOOP_ROWS) -> DataFrame:
    """``df`` in one task if its at most ``n`` rows are no more than ``rows``, else as it is.

    For loops over small tables: rounds over one task's rows need no shuffle, where each step
    would else write a file for every task. A join forgets it, so its result is gathered again.
    """
    return df.coalesce(1) if n <= rows else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, bound: int | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it is proven small, else leave it be.

    ``bound`` is an upper limit of its rows that the caller knows (queries times
    k, say); without one the rows are counted. Without the mark Spark shuffles
    both sides and splits skewed partitions at run time.
    """
    small = is_small(df, rows) if bound is None else bound <= rows
    return F.broadcast(df) if small else df


def hot_keys(df: DataFrame, keys: list[str], target: int | None = None) -> DataFrame:
    """Key values with more than ``target`` rows, and in how many salts (``_salts``) their
    rows have to be split to keep to it. At most rows / target keys are hot."""
    target = ROWS_PER_TASK if target is None else target
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / F.lit(target)).cast("int").alias("_salts")
    return counts.where(F.col("_n") > target).select(*keys, salts)


def salted(many: DataFrame, keys: list[str], spread_by: list[str], hot: DataFrame) -> DataFrame:
    """``many`` with ``_salt``: rows of hot keys spread evenly, all others 0."""
    spread = F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
    return (
        many.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNotNull(), spread).otherwise(F.lit(0)))
        .drop("_salts")
    )


def skew_join(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    target: int | None = None,
) -> DataFrame:
    """Equi-join where keys of ``many`` may be hot and ``one`` is large.

    Rows of a hot key in ``many`` are spread over as many tasks as keep each near
    ``target`` rows, and only the matching rows of ``one`` are copied, so cold keys cost
    nothing extra. ``how`` may be ``inner``, ``left``, ``left_semi`` or ``left_anti`` seen
    from ``many``.
    """
    hot = F.broadcast(hot_keys(many, keys, target))
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = one.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted(many, keys, spread_by or many.columns, hot).join(copied, [*keys, "_salt"], how).drop("_salt")


def with_order_bucket(
    df: DataFrame, order: str, buckets: int | None = None, name: str = "_bucket"
) -> DataFrame:
    """Number rows 0..buckets by approximate quantiles of ``order``.

    Buckets follow the order of ``order`` and hold about equal row counts, so a
    (key, bucket) group stays small even for a key that holds every row. Only
    balance depends on the approximation.
    """
    if buckets is None:
        buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    shares = [i / buckets for i in range(1, buckets)]
    value = _as_number(df, order)
    cuts = df.agg(F.percentile_approx(value, shares, 10_000).alias("c")).first()["c"] or []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    position = F.size(F.filter(bounds, lambda c: c < value))
    return df.withColumn(name, position)


def _as_number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name)


def running_position(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    buckets: int | None = None,
) -> DataFrame:
    """1-based position of each row within its key, in ``order``.

    Same result as ``row_number() over (partition by keys order by order)``, but
    a hot key is numbered bucket by bucket: local positions inside (key, bucket)
    plus the row counts of the key's earlier buckets. ``order[0]`` must be
    numeric or a timestamp.
    """
    bucketed = with_order_bucket(df, order[0], buckets)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    numbered = bucketed.withColumn("_local", F.row_number().over(local))
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_bucket"]],
    )
    return (
        numbered.alias("n")
        .join(offsets.alias("o"), same)
        .select(
            *[F.col(f"n.{c}") for c in df.columns],
            (F.col("n._local") + F.col("o._offset")).cast("long").alias(name),
        )
    )


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly computed columns without computing them twice.

    Catalyst would copy the expressions into a filter below their projection; a
    row number that the condition reads keeps the filter above it.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.where(condition & (F.col("_row") >= 0)).drop("_row")


def exploded(df: DataFrame, items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array item.

    The outer form plus a NULL test gives the rows of a plain explode, but Spark
    derives no "array is not empty" filter that would build the array twice.
    Items must not be NULL.
    """
    if pos is None:
        out = df.select("*", F.explode_outer(items).alias(name))
    else:
        out = df.select("*", F.posexplode_outer(items).alias(pos, name))
    return out.where(F.col(name).isNotNull())


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. Spark trims each task to ``k`` rows before the
    shuffle (window group limit), so hot keys move little data."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
