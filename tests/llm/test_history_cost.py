"""What accepting batches costs must follow their rows, not the session's number of shuffle partitions."""

from ledgerloom.llm import incremental

SCHEMA = "id string, source string, source_record_id string, ingest_batch int, transaction_date string, merchant_raw string, amount double, direction string"


def test_few_tasks_for_small_batches(spark, tmp_path):
    """With 300 shuffle partitions every Python stage had 300 tasks and each of its tables up to 300 files."""
    rows = [(f"{i:04d}", "bank", None, 1 + i // 300, "2024-01-05", f"{'abcdefghij'[i % 10] * 3}ovegro bakery", float(i % 300), "expense") for i in range(600)]
    sc, partitions = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    sc.setJobGroup("history", "history")
    try:
        got = incremental.replay(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 1).repeats().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == 300 and len([p for p in (tmp_path / "chunks" / "n0").iterdir() if p.suffix == ".parquet"]) <= 8
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("history") for s in tracker.getJobInfo(job).stageIds}
    ran = [tracker.getStageInfo(s) for s in stages]
    tasks = sum(s.numCompletedTasks for s in ran if s)
    assert 0 < tasks < 1000, tasks
