"""Session helpers: reading tables, cutting lineage and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured bytes stay below the bound.
BROADCAST_BYTES = 32 * 1024 * 1024


def session(app: str = "quillgraph", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine is tuned for."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session; they may not have it installed."""
    sc = spark.sparkContext
    if _LOCAL.get("shipped") == sc.applicationId:
        return
    _LOCAL["shipped"] = sc.applicationId
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(f"{folder}/{root.name}.zip")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (one machine, as in tests) an own one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return f"file://{_LOCAL['folder']}"


_LOCAL: dict[str, str] = {}


def delete_at_end(spark: SparkSession, path: str) -> None:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a compressed table into the shared folder and read it again.

    The table outlives executors and is deleted when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillgraph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """checkpoint(df), joined by merging wherever it stands.

    For tables that grow with the texts: Spark would broadcast them by the bytes
    of their compressed files, which are a small part of what the driver then holds.
    """
    return checkpoint(df).hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by the hash of its keys in as many partitions as the session sets.

    For steps in Python behind a small exchange: adaptive execution would merge it
    by its bytes into one task, whatever the step costs.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if its rows, measured, fit into limit bytes.

    A row counts with row_bytes at least, and with the bytes of its texts. df
    should be cheap to read (a checkpoint or a small table). Beyond the limit the
    plan stays a shuffled join.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    texts += [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    fixed = 16 + 8 * len(df.columns)
    size = F.greatest(F.lit(row_bytes), sum(texts, F.lit(fixed)))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df
