"""Streamed validation: one pass over the labelled rows of a batch, nothing of them stored."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from mooring.operators.labelling import label_dataset
from mooring.streaming import jobs, validator
from builders import make_nodes, make_pods
from test_ranking import fleet as random_fleet


def test_labelled_rows_are_not_kept(spark, tmp_path, monkeypatch):
    node_rows, pod_rows = random_fleet(21)
    pods, nodes = make_pods(spark, pod_rows), make_nodes(spark, node_rows)
    rows = label_dataset(pods, nodes).toPandas()
    pods.repartition(3).write.parquet(str(tmp_path / "in"))

    def kept(*_):
        raise AssertionError("rows are kept")

    for name in ("persist", "cache"):
        monkeypatch.setattr(DataFrame, name, kept)
    found = validator.validate(jobs.folder_stream(spark, str(tmp_path / "in")), nodes, str(tmp_path / "v"))
    got = {(r.section, r.item): r.value for r in found.collect()}
    fit = rows[rows.feasible]
    assert got["overview", "total_rows"] == len(rows) and got["overview", "feasible_rows"] == len(fit)
    assert got["overview", "events"] == rows.event_id.nunique() == got["integrity", "selected_rows"]
    assert got["overview", "avg_cluster_size"] == pytest.approx(
        rows.groupby("event_id").cluster_size.min().mean())
    assert got["overview", "clusters"] == rows.cluster_id.nunique()
    assert got["score", "mean"] == pytest.approx(fit.teacher_score.mean())
    assert got["score", "std"] == pytest.approx(fit.teacher_score.std(ddof=0))
    assert got["cpu_penalty", "unique_values"] == fit.cpu_penalty.round(3).nunique()
    # A batch leaves figures, not rows: a bounded number of bytes below the output.
    assert spark.read.parquet(f"{tmp_path}/v/parts/batch=*").where("value IS NULL").count() < len(rows)


def test_figures_of_a_task_are_those_of_all_its_batches():
    rng = np.random.default_rng(4)
    values = rng.normal(1e6, 1, 1000)
    cells = [None if i % 7 == 0 else float(v) for i, v in enumerate(values)]
    column = pa.array(cells, pa.float64())
    table = pa.table({"m_a": column, "b_k": pa.array([i % 3 / 1.0 for i in range(1000)]),
                      "c_n": pa.array([i % 2 for i in range(1000)], pa.int64())})
    out = pa.Table.from_batches(list(validator._tally(["a", "none"], ["k"], ["n"])(
        table.append_column("m_none", pa.nulls(1000, pa.float64())).to_batches(37)))).to_pylist()
    held = np.array([c for c in cells if c is not None])
    by = {(r["kind"], r["value"]): r for r in out}
    assert set(by) == {("a", None), ("n", None), ("k", 0.0), ("k", 1.0), ("k", 2.0)}
    a = by["a", None]
    assert a["n"] == len(held) and a["mean"] == pytest.approx(held.mean(), rel=1e-14)
    assert a["squares"] == pytest.approx(held.var() * len(held), rel=1e-9)
    assert (a["lowest"], a["highest"]) == (held.min(), held.max())
    assert by["n", None]["n"] == 500 and by["k", 0.0]["n"] == 334
