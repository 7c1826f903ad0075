import __spark_entry__ as entry


def test_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert "evaluate" in queries and set(oracles) <= set(queries)


def test_flagship(spark):
    rows = {r.metric: r.value for r in entry.entry(spark).collect()}
    assert set(rows) == {"mean_iou", "mean_iou_union", "pixel_accuracy", "fw_iou", "kappa"}
    assert 0 < rows["mean_iou"] < 100 and 0 < rows["kappa"] < 1
