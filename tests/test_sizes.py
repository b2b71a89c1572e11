"""How work is dealt out as tables grow: by rows, not by how small they are when they are shuffled."""

import pytest
from pyspark.sql import functions as F

from freshet import queries
from freshet.operators import metrics, online, windows
from freshet.schema import events_from_table
from freshet.sources import incremental

SF = "/root/testdata/sf0.001"


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def test_windows_of_few_panes_a_task(spark, monkeypatch):
    events = events_from_table(spark, SF)
    want = windows.sliding_all(events)
    monkeypatch.setattr(windows, "PANES_A_TASK", 50)
    got = windows.sliding_all(events)
    assert got.rdd.getNumPartitions() == -(-events.count() // 50) > want.rdd.getNumPartitions()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_events_are_summed_up_in_more_tasks_the_more_there_are(spark, monkeypatch):
    events = events_from_table(spark, SF)
    want = windows.sliding_all(events)
    monkeypatch.setattr(windows, "EVENTS_A_TASK", 50, raising=False)
    got = windows.sliding_all(events)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    got.collect()
    summed = [line for line in final_plan(got).splitlines() if "Exchange hashpartitioning(user_id" in line and "_product" in line]
    assert len(summed) == 1 and f", {-(-events.count() // 50)}), REPARTITION_BY_NUM" in summed[0]


def test_a_feature_reads_the_events_own_columns(spark):
    events = events_from_table(spark, SF).withColumns({"pane": F.lit(7), "product": F.lit(8)})
    more = [windows.Feature(c, lambda c=c: F.col(c), "max") for c in ("dearest", "least")]
    own = windows.sliding_all(events.withColumnsRenamed({"pane": "dearest", "product": "least"}), more)
    both = windows.sliding_all(events, [windows.Feature("dearest", lambda: F.col("pane"), "max"), windows.Feature("least", lambda: F.col("product"), "max")])
    assert own.exceptAll(both).count() == both.exceptAll(own).count() == 0


def test_the_online_vector_sorts_no_records(spark):
    features = windows.sliding_all(events_from_table(spark, SF))
    got = online.vector(features)
    assert "SortAggregate" not in final_plan(got)
    again = online.vector(features.withColumn("emission_seq", F.lit(0)))
    assert got.exceptAll(again).count() == again.exceptAll(got).count() == 0


def test_incremental_windows_sort_and_scatter_nothing(spark, tmp_path):
    table = incremental.FeatureTable(spark, str(tmp_path))
    table.fold(events_from_table(spark, SF).repartition(4), 0)
    assert "SortAggregate" not in final_plan(table.read())
    held = table.panes.read("panes")
    assert len(held.inputFiles()) == held.select("day").distinct().count()


def test_the_history_of_keys_is_dealt_out_by_rows(spark):
    plan = queries.emission_history(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(idempotency_key" in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines())


@pytest.mark.parametrize("held", [1_000_000, 50])
def test_percentiles_read_the_samples_once(spark, monkeypatch, held):
    monkeypatch.setattr(metrics, "HELD", held)
    read = spark.sparkContext.accumulator(0)

    def ms(n):
        read.add(1)
        return float(n % 300)

    once = F.udf(ms, "double").asNondeterministic()  # else it is called again for the filter
    got = metrics.percentiles(spark.range(0, 3000, 1, 4).select(once("id").alias("ms")), "ms", (0.5, 0.95))
    assert tuple(got.first()) == (149.5, 284.05) and read.value == 3000
