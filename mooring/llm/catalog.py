"""Registry of the training-data queries and the SQL they are compared with."""
import importlib.util

QUERIES = {}
ORACLE = {}

_MODULES = ("quality_rules", "sharding", "language", "simhash", "ngram_lm", "warc", "packing",
            "pii", "bpe", "embedding_dedup", "resampling", "quality_classifier", "search")


def register(name, sql=None):
    """Adds fn(spark, sf_dir) under name, with comparison SQL where SQL can say it."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


for _module in [m for m in _MODULES if importlib.util.find_spec(f"mooring.llm.{m}")]:
    importlib.import_module(f"mooring.llm.{_module}")
