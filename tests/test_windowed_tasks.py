from sparkloom.operators import alignment
from sparkloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_windows_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(alignment, "TASK_ROWS", 100, raising=False)
    events = spark.read.parquet(f"{DATA}/events.parquet").count()
    found = catalog.QUERIES["w3_windowed_similarity_error"](spark, DATA)
    assert found.rdd.getNumPartitions() == -(-2 * events // 100)  # Spark merged them to as many as the small rows before wanted
    monkeypatch.undo()
    assert catalog.QUERIES["w3_windowed_similarity_error"](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
