"""Session helpers: a tuned local session for tests/bench, and the shared
folder used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CKPT: dict[int, str] = {}
_STAGED: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "turnframe", extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster, pass ``master=None``: spark-submit decides, and the
    cluster's own ``spark.sql.shuffle.partitions`` stays unless one is given
    here (AQE coalesces small ones).  Local sessions get 8.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Python's json.loads keeps the last of duplicate keys.
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
        conf.setdefault("spark.driver.memory", "8g")
        # Small local inputs: let AQE keep enough partitions to use the
        # cores for regex-heavy stages (cluster sizes are far above this).
        conf.setdefault("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    Read from the session (``SparkContext.getCheckpointDir`` or the
    ``spark.checkpoint.dir`` conf).  Only a local-mode session without one
    gets a private temporary folder; on a cluster an unset directory is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return (sc.getCheckpointDir() or conf_dir).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running")
    key = id(sc)
    if key not in _LOCAL_CKPT:
        _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="turnframe-ckpt-")
        sc.setCheckpointDir(_LOCAL_CKPT[key])
    return (sc.getCheckpointDir() or _LOCAL_CKPT[key]).rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of
    recomputing a shuffle whose row order is not reproducible) and gives
    later stages column pruning and filter pushdown on the result.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _STAGED.append(path)
    return spark.read.parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete the folders ``materialize`` wrote in this process (call at the
    end of a run, once no DataFrame reading them is used any more).
    Returns how many were removed."""
    sc = spark.sparkContext
    removed = 0
    while _STAGED:
        path = _STAGED.pop()
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(jpath):
            fs.delete(jpath, True)
            removed += 1
    return removed


PARTITION_BYTES = 256 << 20


def partitions_for(df: DataFrame) -> int:
    """Number of range partitions for a frame: the session's setting, or
    more where the size of its inputs asks for it.

    The optimizer takes a join for as large as the product of its sides, so
    its estimate counts only up to what the plan's leaves hold together."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    held = sum(_leaf_bytes(leaves.apply(i)) for i in range(leaves.size()))
    wanted = -(-min(int(str(plan.stats().sizeInBytes())), held) // PARTITION_BYTES)
    return max(shuffle_partitions(df.sparkSession), min(wanted, 100_000))


def _leaf_bytes(leaf) -> int:
    """Size of a leaf of a plan; rows of an RDD have none, their partitions count."""
    if leaf.getClass().getSimpleName() == "LogicalRDD":
        return leaf.rdd().getNumPartitions() * PARTITION_BYTES
    return int(str(leaf.stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
