"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a private folder.  A cluster session
    without it is an error: a machine-local folder would not survive the loss of
    the executor that wrote it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder all executors share"
            )
        root = tempfile.mkdtemp(prefix="tensorspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_partitioned(df: DataFrame) -> DataFrame:
    """Like :func:`materialize`, and later plans know how the rows are partitioned.

    A checkpoint remembers the hash partitioning and ordering of the plan it was taken
    from, so joins and co-groups on the same key need no further shuffle of it.  Adaptive
    plans do not report theirs, hence the switch while this one job is planned.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return materialize(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def side_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session on the same context and catalog with the caller's settings but for these."""
    session = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def parallelism(spark: SparkSession) -> int:
    """Partition count for explicit repartitioning: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
