from tessera.streaming import markers

SCHEMA = "file_path string, text string"


def test_only_new_files_are_scanned(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: markers.append_markers(markers.arriving(spark, source, SCHEMA), target, checkpoint).awaitTermination()
    add([("a.py", "x\n  # TODO one\nHACK"), ("b.py", "nothing"), ("c.py", None)])
    run()
    add([("a.py", "FIXME later")])
    run()
    run()
    rows = sorted((r.file_path, r.line_number, r.text, r.tag) for r in spark.read.parquet(target).collect())
    assert rows == [("a.py", 1, "FIXME later", "FIXME"), ("a.py", 2, "# TODO one", "TODO"), ("a.py", 3, "HACK", "HACK")]
