"""Session helpers: a local session for tests/bench and shared scratch paths.

On a cluster the session is supplied by the caller; scratch data and
checkpoints live under ``spark.checkpoint.dir`` (a shared folder).  Only when
that setting is absent *and* the master is local do we create one under the
system temp folder, as tests need.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "riskkit") -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("RISKKIT_DRIVER_MEM", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL_ROOT: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder from ``spark.checkpoint.dir``.

    The setting is read from the session, else the folder that the caller gave to
    ``SparkContext.setCheckpointDir``; a temp folder is used only when both are
    unset on a local master (tests).  The context's checkpoint dir is pointed at
    it so ``DataFrame.checkpoint()`` writes there.
    """
    global _LOCAL_ROOT
    sc = spark.sparkContext
    root = sc.getConf().get(_CKPT_KEY, None) or spark.conf.get(_CKPT_KEY, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"{_CKPT_KEY} must name a shared folder on a cluster")
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="riskkit-ckpt-")
        root = _LOCAL_ROOT
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written tables."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/riskkit-scratch/{uuid.uuid4().hex}/{name}"


#: Bytes of code from which on the JVM does not compile a method but interprets it.
_METHOD_BYTES = 8000


def compiled(spark: SparkSession) -> None:
    """Have plans whose generated method the JVM would interpret run operator by operator instead.

    A wide projection in one method is interpreted row by row (measured: 25 s in
    place of 3 s for the survey features of 9 million rows).
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > _METHOD_BYTES:
        spark.conf.set(key, str(_METHOD_BYTES))
