import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: text, or (doc_id, text), or (doc_id, text, lang)."""
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            full.append((*row, "en", "src", 0)[:5] if len(row) == 2 else (*row, "src", 0))
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def table_dir(spark, tmp_path_factory):
    """Writes frames as the tables of a new folder, whose path it returns."""
    def write(**frames):
        path = tmp_path_factory.mktemp("tables")
        for name, frame in frames.items():
            frame.write.parquet(f"{path}/{name}.parquet")
        return str(path)
    return write


ODD_TEXTS = [None, "", " ", "\n\t\x0b", "a", "A b", "word " * 30_000, "z" * 50_000,
             "the same line\nthe same line\n\nthe same line", "é ß İ ẞ 中文 👩‍👧", "\x00\x1c\x85 x",
             "the same line\nthe same line\n\nthe same line"]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null, empty, blank, very long and repeated texts; a null id, repeated rows."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    return make_docs([*rows, (None, "a b c d"), (None, None), (3, ODD_TEXTS[3]), (8, ODD_TEXTS[8]),
                      (50, "some text", None)])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
