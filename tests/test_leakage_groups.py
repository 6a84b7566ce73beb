"""Groups of records tied through incidents and texts, over chains of records."""

from apothecary.plans import modeling

POOL = "candidate_id string, split string, source string, incident_id string, reason_text_id string, annotation_origin string, event struct<primary_cause: string>, sample_weight double"


def test_quarantine_follows_chains(spark, tmp_path):
    ids = [("gold", "gold_evaluation", "i1", "t1"), ("direct", "train", "i2", "t1"), ("second", "train", "i2", "t2"), ("third", "test", "i3", "t2"), ("free", "train", "i4", "t4"), ("also", "train", "i4", "t5"), ("no-text", "train", "i5", None)]
    rows = [(c, s, "x", i, t, "o", ("c",), 1.0) for c, s, i, t in ids]
    spark.createDataFrame(rows, POOL).write.parquet(f"{tmp_path}/phase11_examples.parquet")
    got = {r[0] for r in modeling.quarantine_gold_connected(spark, str(tmp_path)).collect()}
    assert got == {"free", "also"}


def test_components_join_incidents_and_texts(spark, tmp_path):
    rows = [("a", "i1", "t1", "g1"), ("b", "i2", "t1", "g2"), ("c", "I 2", "t3", "g3"), ("d", "i4", "t4", "g4"), ("e", "i5", "t5", "g4"), ("f", None, "t4", None)]
    spark.createDataFrame(rows, "candidate_id string, incident_id string, reason_text_id string, split_group_id string").write.parquet(f"{tmp_path}/phase12_examples.parquet")
    got = {tuple(r) for r in modeling.leakage_components(spark, str(tmp_path)).select("candidate_id", "component").collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "d")}
