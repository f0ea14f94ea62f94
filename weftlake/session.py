"""Session helpers: table reading, durable checkpoints and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any kind, for use inside a Java character class.
WHITE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F"

#: The same characters in a string.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: A side is broadcast by hint only up to this many rows; beyond it the join is left to the optimizer.
BROADCAST_ROWS = 20_000


def local_session(cpus: int = 8, app: str = "weftlake") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, that the session names in `spark.checkpoint.dir`.

    On a cluster an unnamed folder is an error: other machines would not see one of this machine. Only a session on one
    machine, as in tests, gets a temporary one, which is removed when Python ends.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftlake-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation.

    The files go when the frame is no longer used, where `spark.cleaner.referenceTracking.cleanCheckpoints` is set, as
    `local_session` does.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (it is counted up to that bound), else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stripped(col):
    """A string column without white space of any kind around it."""
    return F.btrim(col, F.lit(WHITE_CHARS))


def is_blank(col):
    """True where a string is null, empty or white space of any kind only."""
    return F.coalesce(~col.rlike(rf"[^{WHITE}]"), F.lit(True))
