"""Small helpers shared by the training-data operators."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.session import scratch_path, ship_package

#: Rows of whole texts that go to a Python worker at once.
TEXT_BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The characters that end a word: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read again: what follows never redoes its work."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(doc_id, modulus: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def fresh(columns, base: str) -> str:
    """A column name that df does not use yet."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def row_schema(inner: DataFrame, ddl: str) -> T.StructType:
    """The schema of a worker's output: the struct `row` of inner as it is, then columns as in ddl.

    Column names never pass through text, so that any name may stand in the row.
    """
    return T.StructType([inner.schema["row"], *T.StructType.fromDDL(ddl).fields])


def text_workers(spark: SparkSession) -> None:
    """Prepares the session for Python workers over whole texts: this package, and batches of few
    rows, as the default of 10,000 texts is tens of megabytes, held several times over."""
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= TEXT_BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(TEXT_BATCH_ROWS))
