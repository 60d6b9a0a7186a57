"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, app: str = "riskloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "localhost")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    A machine-local folder stands in only where one machine is the cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def allow_checkpoints(spark: SparkSession) -> None:
    """Without a folder for them Spark's own boosting loops keep the lineage of all their rounds."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor costs no replay of the whole loop."""
    allow_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as files of their own in the shared folder, for frames that are read many times and do not fit into memory.

    Compressed columns take less disk than a persisted or checkpointed frame.  Shuffle files of the query that made them are
    removed with its end, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


def let_go(df: DataFrame) -> None:
    """Remove the files that `written` or `cut_lineage` made for this very frame; nothing may read it any more.

    Other frames, also those that are made from such a frame, have nothing of their own to remove.
    """
    plan, context = df._jdf.queryExecution().analyzed(), df.sparkSession.sparkContext
    kind = plan.getClass().getSimpleName()
    if kind == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        paths = [plan.rdd().getCheckpointFile().get()]
    elif kind == "LogicalRelation":
        found = plan.relation().location().rootPaths()
        paths = [found.apply(i).toString() for i in range(found.size())]
    else:
        return
    hadoop = context._jsc.hadoopConfiguration()
    whole = lambda name: context._jvm.org.apache.hadoop.fs.Path(name).getFileSystem(hadoop).makeQualified(context._jvm.org.apache.hadoop.fs.Path(name))
    folders = [whole(f).toString().rstrip("/") + "/" for f in (shared_folder(df.sparkSession), context.getCheckpointDir()) if f]
    for path in map(whole, paths):
        if path.toString().startswith(tuple(folders)):  # never an input
            path.getFileSystem(hadoop).delete(path, True)
