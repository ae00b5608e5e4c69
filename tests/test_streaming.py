from acreframe.streaming import rounds


def test_labels_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,lat,lon,tile,label\nx,1,2,t,Agricultural\nx,1,2,t,Agricultural\ny,1,2,t,Non-Agricultural\n")
    q = rounds.label_counts(rounds.label_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.total, r.agri) for r in spark.sql("select * from counts").collect()] == [(2, 1)]


def test_scores_of_pixel_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    rounds.score_stream(stream, lambda d: d.selectExpr("id", "id / 10.0 as p"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_tasks_are_followed_over_restarts(spark, tmp_path):
    """Late and repeated events, a task that goes quiet, and a stream that is stopped between its batches."""
    import json

    from acreframe.streaming import exports

    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps({"task": t, "state": s, "ts": f"2024-01-01T{at}:00Z"}) + "\n" for t, s, at in rows))

    def told():
        events = spark.readStream.schema("task string, state string, ts timestamp").json(str(tmp_path / "in"))
        exports.run(exports.followed(events, "2 hours", 3 * 3_600_000), str(tmp_path / "out"), str(tmp_path / "marks"))
        return {r.task: (r.state, r.stalled) for r in exports.latest(spark, str(tmp_path / "out")).collect()}

    put("1.json", [("a", "READY", "01:00"), ("a", "RUNNING", "01:30"), ("a", "RUNNING", "01:30"), ("b", "READY", "01:00"), ("c", "COMPLETED", "01:10"), (None, "READY", "01:00")])
    assert told() == {"a": ("RUNNING", False), "b": ("READY", False), "c": ("COMPLETED", False)}
    put("2.json", [("a", "READY", "01:05"), ("b", "FAILED", "02:00"), ("b", "RUNNING", "01:50"), ("c", "COMPLETED", "01:10")])  # late and repeated
    assert told() == {"a": ("RUNNING", False), "b": ("FAILED", False), "c": ("COMPLETED", False)}
    put("3.json", [("d", "RUNNING", "09:00")])  # the watermark passes a's last event by more than three hours
    assert told() == {"a": ("RUNNING", True), "b": ("FAILED", False), "c": ("COMPLETED", False), "d": ("RUNNING", False)}
    put("4.json", [("a", "COMPLETED", "08:30"), ("d", "COMPLETED", "09:30")])
    assert told() == {"a": ("COMPLETED", False), "b": ("FAILED", False), "c": ("COMPLETED", False), "d": ("COMPLETED", False)}
