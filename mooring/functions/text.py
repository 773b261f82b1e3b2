"""Text, time, map and JSON expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_RESPONSE = T.StructType([
    T.StructField("score", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("source", T.StringType()),
])


def job_name(node_name: Column, prefix="saturate-") -> Column:
    """Other than lower-case letters, digits and dashes becomes a dash first."""
    return F.concat(F.lit(prefix), F.lower(F.regexp_replace(node_name, "[^a-z0-9-]", "-")))


def short_name(name: Column) -> Column:
    """The last two dash-separated parts."""
    parts = F.split(name, "-")
    return F.when(F.size(parts) <= 2, name).otherwise(F.concat_ws("-", F.slice(parts, -2, 2)))


def _tenths(x: Column) -> Column:
    """x of 1 or more in tenths, rounded by its exact binary value, larger on a true tie.

    x times a power of two that makes it whole is exact as a long, and twenty times that as a
    decimal.
    """
    out = None
    for below, bits in ((1 << 10, 52), (1 << 20, 42), (1 << 42, 20)):
        whole = (x * float(1 << bits)).cast("long").cast("decimal(20,0)")
        twentieths = whole * F.lit(20).cast("decimal(2,0)") + F.lit(1 << bits).cast("decimal(20,0)")
        unit = F.lit(1 << (bits + 1)).cast("decimal(20,0)")
        # A quotient of decimals is rounded; without the remainder it is whole.
        tenths = ((twentieths - twentieths % unit) / unit).cast("long")
        out = F.when(x < below, tenths) if out is None else out.when(x < below, tenths)
    return out.otherwise(F.rint(x * 10).cast("long"))


def compact_number(value: Column) -> Column:
    """1.2K or 3.4M with one decimal from a thousand on, else the plain number."""
    def short(unit, mark):
        tenths = _tenths(value.cast("double") / unit)
        return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."),
                        (tenths % 10).cast("string"), F.lit(mark))

    return (F.when(value >= 1_000_000, short(1e6, "M")).when(value >= 1_000, short(1e3, "K"))
            .otherwise(value.cast("string")))


def html_escape(text: Column) -> Column:
    for plain, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def duration_text(seconds: Column) -> Column:
    """59s, 3m07s or 2h05m."""
    minutes = F.floor(seconds / 60).cast("long")
    rest = F.floor(seconds - minutes * 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(seconds < 60, F.concat(F.rint(seconds).cast("long").cast("string"), F.lit("s")))
        .when(minutes < 60, F.format_string("%dm%02ds", minutes, rest))
        .otherwise(F.format_string("%dh%02dm", hours, minutes - hours * 60))
    )


def utc_stamp(moment: Column, zoned=False) -> Column:
    """UTC text of a moment: of a zoned timestamp in any session zone, else of UTC wall time."""
    wall = F.to_utc_timestamp(moment, F.current_timezone()) if zoned else moment
    return F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def label_lookup(labels: Column, key: Column):
    """(present, value) of a map entry."""
    return F.map_contains_key(labels, key), F.try_element_at(labels, key)


def condition_json(message: Column, moment: Column) -> Column:
    """Status patch marking a pod as unschedulable."""
    condition = F.struct(
        F.lit("PodScheduled").alias("type"),
        F.lit("False").alias("status"),
        F.lit("Unschedulable").alias("reason"),
        message.alias("message"),
        utc_stamp(moment).alias("lastTransitionTime"),
    )
    return F.to_json(F.struct(F.struct(F.array(condition).alias("conditions")).alias("status")))


def decode_response(body: Column) -> Column:
    """Score response struct; null where the text is no such object, score 0 where it has none."""
    schema = T.StructType([*SCORE_RESPONSE, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE",
                                        "columnNameOfCorruptRecord": "_broken"})
    return F.when(body.isNotNull() & parsed["_broken"].isNull(), F.struct(
        F.coalesce(parsed["score"], F.lit(0).cast("long")).alias("score"),
        parsed["reason"].alias("reason"), parsed["source"].alias("source")))
