"""Calls that are tried again by timers: counts outlive a restart, and no task waits."""

import time

from folioflow.streaming import retries


def test_waits_are_timers_and_counts_outlive_a_restart(spark, tmp_path):
    log, open_ = tmp_path / "calls", tmp_path / "open"
    log.write_text("")
    (tmp_path / "in").mkdir()

    def call(texts, log=str(log), gate=str(open_)):
        import os

        with open(log, "a") as f:
            f.write(f"{texts[0]}\n")
        if texts[0] == "odd":
            raise ValueError("too odd")
        if texts[0] == "lost" or (texts[0] == "late" and not os.path.exists(gate)):
            raise OSError("no server")
        return [f"said {texts[0]}"]

    calls = lambda text: log.read_text().split().count(text)

    def start(wait_s):
        feed = spark.readStream.schema("paper_id string, text string").json(f"{tmp_path}/in")
        out = retries.called(feed, call, attempts=3, wait_s=wait_s)
        return out.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()

    def until(query, what, seconds=120):
        end = time.time() + seconds
        while not what() and time.time() < end:
            assert query.exception() is None, query.exception()
            time.sleep(0.5)
        assert what()

    rows = [("a", "fine"), ("b", "odd"), ("c", "lost"), ("d", "late"), ("e", ""), (None, "nobody")]
    spark.createDataFrame(rows, "paper_id string, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    before = spark.conf.get(retries.PROVIDER)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    def told(*ids):
        if not (tmp_path / "out/_spark_metadata").exists():
            return False
        return {r.paper_id for r in spark.read.schema(retries.RESULT).json(f"{tmp_path}/out").collect()} >= set(ids)

    try:
        q = start(8.0)
        until(q, lambda: told("a", "b", "e") and (tmp_path / "cp/commits/0").exists())
        q.stop()
        assert calls("lost") < 3
        open_.write_text("")
        q = start(2.0)
        until(q, lambda: told("a", "b", "c", "d", "e"))
        q.stop()
    finally:
        spark.conf.set(retries.PROVIDER, before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    got = {r.paper_id: r for r in spark.read.schema(retries.RESULT).json(f"{tmp_path}/out").collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert (got["a"].ok, got["a"].value, got["a"].attempts) == (True, "said fine", 1) and got["e"].value == "said "
    assert (got["b"].error_type, got["b"].error, got["b"].attempts) == ("PermanentError", "too odd", 1)
    assert (got["c"].error_type, got["c"].attempts) == ("TransientError", 3) and calls("lost") in (3, 4)  # over both runs; the batch that was stopped may be done again
    assert got["d"].ok and 2 <= got["d"].attempts <= calls("late") <= 4
    assert sorted(r.paper_id for r in retries.dead_letters(spark.read.schema(retries.RESULT).json(f"{tmp_path}/out")).collect()) == ["b", "c"]
