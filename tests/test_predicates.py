"""Truth tables of tolerations, selectors and readiness."""
import pytest
from pyspark.sql import functions as F

from mooring.operators import predicates

TOLERATION = "struct<key:string,operator:string,value:string,effect:string>"
TAINT = "struct<key:string,value:string,effect:string>"
REQUIREMENT = "struct<key:string,operator:string,values:array<string>>"


@pytest.mark.parametrize("toleration, taint, expected", [
    (("", "Exists", "", ""), ("any", "x", "NoExecute"), True),
    (("k", "Exists", "", "NoSchedule"), ("k", "v", "NoSchedule"), True),
    (("k", "Exists", "", "NoExecute"), ("k", "v", "NoSchedule"), False),
    (("k", "Equal", "v", ""), ("k", "v", "NoSchedule"), True),
    (("k", "", "v", ""), ("k", "v", "NoSchedule"), True),
    (("k", "Equal", "w", ""), ("k", "v", "NoSchedule"), False),
    (("j", "Exists", "", ""), ("k", "v", "NoSchedule"), False),
    (("", "Equal", "v", ""), ("k", "v", "NoSchedule"), True),
    (("k", "Odd", "v", ""), ("k", "v", "NoSchedule"), False),
    (("k", "Exists", None, None), ("k", None, "NoSchedule"), True),
    ((None, "Exists", None, None), ("k", "v", "NoSchedule"), True),
    (("k", None, "v", None), ("k", "v", "NoSchedule"), True),
    (("k", None, None, None), ("k", None, "NoSchedule"), True),
    (("k", None, None, None), ("k", "v", "NoSchedule"), False),
])
def test_toleration(spark, toleration, taint, expected):
    df = spark.createDataFrame([(toleration, taint)], f"a {TOLERATION}, b {TAINT}")
    assert df.select(predicates.toleration_matches(F.col("a"), F.col("b"))).first()[0] is expected


@pytest.mark.parametrize("tolerations, taints, expected", [
    ([], [], True),
    ([], [("k", "v", "PreferNoSchedule")], True),
    ([], [("k", "v", "NoSchedule")], False),
    ([("k", "Exists", "", "")], [("k", "v", "NoSchedule"), ("m", "", "NoExecute")], False),
    ([("k", "Exists", "", ""), ("m", "Exists", "", "")],
     [("k", "v", "NoSchedule"), ("m", "", "NoExecute")], True),
    (None, None, True), ([], None, True), (None, [("k", "v", None)], False),
    (None, [("k", "v", "PreferNoSchedule")], True),
])
def test_all_taints(spark, tolerations, taints, expected):
    df = spark.createDataFrame([(tolerations, taints)], f"a array<{TOLERATION}>, b array<{TAINT}>")
    assert df.select(predicates.tolerates_taints(F.col("a"), F.col("b"))).first()[0] is expected


LABELS = {"zone": "z1", "gen": "4", "name": "x"}


@pytest.mark.parametrize("requirement, expected", [
    (("zone", "In", ["z0", "z1"]), True),
    (("zone", "In", ["z0"]), False),
    (("none", "In", ["z0"]), False),
    (("zone", "NotIn", ["z1"]), False),
    (("zone", "NotIn", ["z0"]), True),
    (("none", "NotIn", ["z0"]), True),
    (("zone", "Exists", []), True),
    (("none", "Exists", []), False),
    (("none", "DoesNotExist", []), True),
    (("zone", "DoesNotExist", []), False),
    (("gen", "Gt", ["3"]), True),
    (("gen", "Gt", ["4"]), False),
    (("gen", "Gt", []), False),
    (("gen", "Gt", ["x"]), False),
    (("gen", "Gt", [" 3 "]), False),
    (("gen", "Gt", ["+3"]), True),
    (("name", "Gt", ["3"]), False),
    (("none", "Gt", ["3"]), False),
    (("gen", "Lt", ["5"]), True),
    (("gen", "Lt", ["4"]), False),
    (("zone", "Like", ["z1"]), False),
])
def test_selector(spark, requirement, expected):
    df = spark.createDataFrame([(requirement, LABELS)], f"r {REQUIREMENT}, l map<string,string>")
    assert df.select(predicates.selector_matches(F.col("r"), F.col("l"))).first()[0] is expected


@pytest.mark.parametrize("terms, expected", [
    (None, True),
    ([], True),
    ([[]], True),
    ([[("zone", "In", ["z0"])], [("gen", "Gt", ["3"])]], True),
    ([[("zone", "In", ["z1"]), ("gen", "Gt", ["9"])]], False),
    ([[("hostname", "In", ["worker-1", "worker-2"])]], False),
])
def test_affinity(spark, terms, expected):
    df = spark.createDataFrame([(terms, LABELS)],
                               f"t array<array<{REQUIREMENT}>>, l map<string,string>")
    assert df.select(predicates.matches_affinity(F.col("t"), F.col("l"))).first()[0] is expected


@pytest.mark.parametrize("unschedulable, conditions, expected", [
    (False, [("Ready", "True")], True),
    (True, [("Ready", "True")], False),
    (False, [("Ready", "Unknown")], False),
    (False, [("DiskPressure", "True")], False),
    (False, [("Ready", "False"), ("Ready", "True")], False),
    (False, [], False),
])
def test_ready(spark, unschedulable, conditions, expected):
    df = spark.createDataFrame([(unschedulable, conditions)],
                               "u boolean, c array<struct<type:string,status:string>>")
    assert df.select(predicates.is_ready(F.col("u"), F.col("c"))).first()[0] is expected


def test_capacity_variants(spark):
    df = spark.createDataFrame(
        [(1000, 1000, 900, 0, 200, 10), (0, 1000, 0, 0, 1, 1), (1000, 1000, 0, 0, 1000, 1000),
         (1000, 1000, 900, 900, 200, 200), (1000, 1000, 0, 900, 200, 200)],
        "node_allocatable_cpu long, node_allocatable_memory long, current_cpu_usage long,"
        "current_memory_usage long, requested_cpu long, requested_memory long").withColumns({
            "total_requested_cpu": F.col("requested_cpu"),
            "total_requested_memory": F.col("requested_memory")})
    assert [r[0] for r in df.select(predicates.fits_total()).collect()] == [
        True, False, True, True, True]
    assert [r.reject_reason for r in df.withColumns(predicates.fits_free()).collect()] == [
        "cpu", "cpu", "", "both", "memory"]


def test_preferred_falls_back_to_all(spark):
    df = spark.createDataFrame([(1, 5), (1, 30), (2, 5), (2, 7)], "event_id long, score long")
    kept = {tuple(r) for r in predicates.preferred_only(df).collect()}
    assert kept == {(1, 30), (2, 5), (2, 7)}


def test_claims(spark):
    volume = "array<struct<name:string,claim:string>>"
    df = spark.createDataFrame([([("a", None), ("b", ""), ("c", "data")],), ([("a", None)],)],
                               f"v {volume}")
    rows = df.select(predicates.claim_names(F.col("v")), predicates.has_claims(F.col("v")))
    assert [tuple(r) for r in rows.collect()] == [("b, data", True), ("", False)]


@pytest.mark.parametrize("operator, expected", [
    ("DoesNotExist", True), ("NotIn", True), ("Exists", False), ("In", False), ("Gt", False)])
def test_absent_labels_are_no_labels(spark, operator, expected):
    df = spark.createDataFrame([(("zone", operator, ["1"]), None)],
                               f"r {REQUIREMENT}, l map<string,string>")
    assert df.select(predicates.selector_matches(F.col("r"), F.col("l"))).first()[0] is expected


def test_first_rejection_of_absent_fields(spark):
    """A node without taints and labels is turned down for what it lacks, not for a null."""
    df = spark.sql("""SELECT CAST(NULL AS array<struct<key:string,operator:string,value:string,
        effect:string>>) AS tolerations, CAST(NULL AS array<struct<key:string,value:string,
        effect:string>>) AS taints, CAST(NULL AS map<string,string>) AS labels,
        array(array(named_struct('key', 'ssd', 'operator', 'Exists', 'values', array('x'))))
        AS affinity_terms, 10L AS node_allocatable_cpu, 10L AS node_allocatable_memory,
        1L AS total_requested_cpu, 1L AS total_requested_memory""")
    assert df.select(predicates.first_rejection()).first()[0] == "affinity"
