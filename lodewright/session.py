"""Session defaults and the one place that knows where shared working files go."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "lodewright", **conf: str) -> SparkSession:
    """A session with the settings every query here assumes: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, so that they need not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodewright-")) / "lodewright.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*")):
            if file.suffix in (".py", ".json"):
                out.write(file, Path(package.name) / file.relative_to(package))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) a session need not name one: a folder of this machine is made and
    set for the rest of the session. On a cluster that would lose data, so it is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder: later stages survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_micros(df: DataFrame) -> DataFrame:
    """df with its timestamps as microseconds since 1970-01-01 UTC, which every engine compares alike."""
    kinds = dict(df.dtypes)
    return df.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in df.columns])
