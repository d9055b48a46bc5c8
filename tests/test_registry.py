"""Table functions whose rows have a status of their own."""

from noticeloom.plans import registry
from noticeloom.sources import files
from noticeloom.sources.segments import Segments
from noticeloom.sources.store import Snapshots
from noticeloom.streaming import claims


def test_a_bad_row_does_not_fail_its_batch(spark):
    def halves(state, n):
        assert state == "set up"
        if n is None:
            raise ValueError("no number")
        return [(n // 2, "half"), (n - n // 2, "rest")] if n else []

    registry.table_function(spark, "halves", halves, "n long, kind string", lambda: "set up")
    registry.table_function(spark, "narrow", lambda state, n: [(1, 2)], "n long")
    spark.createDataFrame([(1, 7), (2, None), (3, 0), (4, 2)], "k int, v long").createOrReplaceTempView("numbers")
    got = sorted(map(tuple, spark.sql("SELECT k, h.* FROM numbers, LATERAL halves(v) h").collect()), key=repr)
    assert got == [(1, 3, "half", "ok", None), (1, 4, "rest", "ok", None), (2, None, None, "failed", "ValueError: no number"), (4, 1, "half", "ok", None), (4, 1, "rest", "ok", None)]
    assert {r.status for r in spark.sql("SELECT h.* FROM numbers, LATERAL narrow(v) h").collect()} == {"failed"}


def test_only_bad_rows_become_dead_letters(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "doc_id string, value string").write.parquet(f"{tmp_path}/in")
    registry.table_function(spark, "number_of", lambda state, v: [(int(v),)], "n long")

    def work(df):
        df.createOrReplaceTempView("batch_rows")
        return df.sparkSession.sql("SELECT doc_id, n, status, error FROM batch_rows, LATERAL number_of(value)")

    sink, dead = Segments(spark, f"file://{tmp_path}/out", buckets=2), Snapshots(spark, f"file://{tmp_path}/dead")
    claims.processed(files.change_feed(spark, f"{tmp_path}/in", "doc_id string, value string"), work, sink, f"{tmp_path}/ck", dead=dead).awaitTermination(100)
    assert {(r.doc_id, r.n) for r in sink.read().collect()} == {("a", 1), ("c", 3)} and sink.read().columns == ["doc_id", "n", "rev"]
    assert [r.error.split(":")[0] for r in dead.read().collect()] == ["ValueError"] and '"doc_id":"b"' in dead.read().first().record
