"""Named queries and the SQL they are compared with."""
QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    """Adds fn(spark, sf_dir) under name, with comparison SQL where SQL can say it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add
