"""Session settings and reliable lineage cuts."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A private folder is used only for a local session that names none (tests).
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="cytolake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def apply_session_rules(spark: SparkSession, broadcast_limit: str = "10MB") -> None:
    """SQL settings the operators rely on, whoever built the session.

    Broadcast a join side only once its real size is known: the planner's estimate does not see how many
    rows an explode yields, so a pixel or run table can look tiny. With the static threshold off, a
    join starts as a shuffle join and AQE turns it into a broadcast join when the finished stage is
    below the limit.

    Unions must not claim the partitioning of their children: Spark 4.1 loses rows of a later join when one
    child is a checkpoint whose partitions were coalesced and the other is not.

    Batches that go to Python hold few rows, as a row can be a whole text.

    Folders are listed by a few tasks a core: Spark's 10,000 tasks take longer to start than thousands of folders to list.
    Opening a file counts as Spark has it; `stream_cells` alone lowers that.

    Joins deal by all their keys, so that a large slide is spread; only `stack_layers` and `class_at_centroid` turn that off.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", broadcast_limit)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "4MB")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(8 * spark.sparkContext.defaultParallelism))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later stages do not re-run its plan.

    Reliable checkpoints outlive lost executors; used where a plan is iterated
    or where two branches must see the very same rows.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        raise RuntimeError("call apply_session_rules(spark) first: a union of checkpoints can lose rows of a later join")
    shared_dir(spark)
    return df.checkpoint(eager=True)


def build_session(
    app: str, master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g"
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_session_rules(spark)
    return spark
