"""Session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method above 8,000 bytes of bytecode. A stage whose fused method grows
    # beyond that (the cleaning chain does) runs faster unfused, as small compiled methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    """A local session for tests and benches. On a cluster, build the session from the
    cluster's own configuration instead and keep its ``spark.checkpoint.dir``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return None


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (None when unset)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = _context(spark)
    return sc.getCheckpointDir() if sc is not None else None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint folder; only when the cluster names none (local tests) create one."""
    root = checkpoint_root(spark)
    sc = _context(spark)
    if root:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    master = sc.master if sc is not None else ""
    if fallback is None and not master.startswith("local[") and master != "local":
        raise RuntimeError(
            "spark.checkpoint.dir is not set: on a cluster intermediate tables need a folder that all executors share"
        )
    root = fallback or tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", root)
    if sc is not None:
        sc.setCheckpointDir(root)
    return root


def materialise(df, name: str):
    """Write ``df`` once as parquet to a fresh folder under the checkpoint root and return the
    stored copy: a single pass (compute and write together), and the lineage ends there, so a
    lost executor never recomputes what is stored. Used where one result feeds several
    branches of a plan."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


STAGING_DIR = "ledgerlens-staging"

#: Staging folders of this process that are not deleted yet.
_STAGED: dict[str, SparkSession] = {}


def release_staged(spark: SparkSession | None = None) -> int:
    """Delete the staged copies that this process has made and not yet dropped; returns their
    number. A returned query reads its staged inputs until its last action, so call this when
    its results are no longer read. Whatever is left goes when the process ends."""
    paths = [p for p, s in _STAGED.items() if spark is None or s is spark]
    for p in paths:
        try:
            drop_staged(_STAGED[p], p)
        except Exception:  # noqa: BLE001 - the session may be gone already; the next path may still go
            _STAGED.pop(p, None)
    return len(paths)


atexit.register(release_staged)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete one staging folder made by :func:`staging_path` once nothing reads it any more
    (only paths inside the staging area are ever deleted)."""
    if f"/{STAGING_DIR}/" not in path:
        raise ValueError(f"not a staging folder: {path}")
    _STAGED.pop(path, None)
    sc = _context(spark)
    if sc is None or sc._jsc is None:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint root for staged intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/{STAGING_DIR}/{name}-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    return path


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume (apply when building the
    session). Shuffle partitions start at about one per ``target_partition_bytes`` of input
    (never fewer than twice the cores) and AQE coalesces them to its advisory size, so each
    reduce task holds a few hundred MB and sorts or spills within executor memory; scan
    splits are capped at the same size. Skew splitting is on for the joins whose key can be
    hot (a merchant holding a third of all transactions)."""
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        **DEFAULT_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
