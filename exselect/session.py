"""Session settings, size-checked broadcasts and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_CONF = "exselect.broadcastBytes"
BROADCAST_BYTES = 128 << 20


def local_session(cpus: int = 8, app: str = "exselect", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def broadcast_limit(spark: SparkSession) -> int:
    """Largest side, in bytes, that any operator may hand to every executor."""
    return int(spark.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when `rows` (an upper bound the caller can prove) fits the limit.

    Beyond the limit the frame comes back unhinted and the planner shuffles it.
    """
    return F.broadcast(df) if rows * row_bytes <= broadcast_limit(df.sparkSession) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the full number of shuffle partitions.

    Groups that are small in bytes but heavy in work must not be coalesced into a few tasks, which is
    what the adaptive planner does by size. Grouping by the same keys needs no further shuffle.
    """
    context = df.sparkSession.sparkContext
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if context.master.startswith("local"):  # a few tasks per core are enough on one machine
        tasks = min(tasks, 4 * context.defaultParallelism)
    return df.repartition(tasks, *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a scratch folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="exselect-checkpoint-"))
    return df.checkpoint(eager=True)


def is_cut(df: DataFrame) -> bool:
    """Whether the frame does no more than read columns of a checkpoint, row by row, so that another one would save nothing."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() == "Project":
        plan = plan.child()
    return plan.nodeName() in ("LogicalRDD", "Scan ExistingRDD") and plan.rdd().isCheckpointed()


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
