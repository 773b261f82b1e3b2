"""Session and shared-folder helpers."""
import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"
METHOD_LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"
#: Java never compiles a method with more bytes of code than this, but interprets it.
COMPILED_BYTES = 8000
_fallback_dir = None
_shipped = set()


def local_session(cores="*", shuffle_partitions=8, app="mooring"):
    """A single-machine session for tests and bench runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(METHOD_LIMIT_KEY, str(COMPILED_BYTES))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MOORING_DRIVER_MEMORY", "12g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def keep_compiled(df: DataFrame) -> DataFrame:
    """df; its session no longer generates single methods that Java would interpret.

    Spark's own limit lets a wide projection grow past what Java compiles, and each row then costs
    several times as much. A limit below that, set by the user, stays. Streams run their batches in
    sessions of their own, so this is called where wide columns are made, not once at the start.
    """
    conf = df.sparkSession.conf
    if int(conf.get(METHOD_LIMIT_KEY)) > COMPILED_BYTES:
        conf.set(METHOD_LIMIT_KEY, str(COMPILED_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    First the checkpoint folder of the context, then the setting. A temporary
    folder stands in on a local master only, where driver and executors are one.
    """
    global _fallback_dir
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get(SHARED_DIR_KEY, None)
    if configured:
        return configured
    if not context.master.split("[")[0] == "local":
        raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="mooring-")
        atexit.register(shutil.rmtree, _fallback_dir, ignore_errors=True)
    return _fallback_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored_rows(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what follows never redoes its work."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, where the context has none of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of df, so that a lost executor costs no replay."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may start anywhere; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="mooring-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "mooring_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
