import json
import time

import pytest
from pyspark.sql import functions as F

from veldspar.sources import readers, writers
from veldspar.streaming import events as S


def test_lists(spark):
    got = readers.texts(spark, ["a", "b"], [{"n": 1}, {}]).orderBy("document_id").collect()
    assert [(r.document_id, r.text, r.metadata) for r in got] == [("text-0", "a", {"n": "1"}), ("text-1", "b", {})]
    with pytest.raises(ValueError):
        readers.texts(spark, ["a"], [])


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.csv").write_text("id,text,extra\n1,hello,x\n2,,y\n")
    (tmp_path / "c.jsonl").write_text('{"text": "one", "k": 1}\n\n{"text": " "}\n')
    (tmp_path / "d.json").write_text(json.dumps({"meta": 1, "rows": [{"text": "r1", "id": 7}, {"text": "r2"}]}))
    (tmp_path / "e.weird").write_bytes(b"caf\xe9")
    read = lambda n, **k: readers.file(spark, str(tmp_path / n), **k).collect()
    assert [(r.document_id, r.text) for r in read("a.txt")] == [("a", "plain text")]
    assert [(r.document_id, r.text, r.metadata) for r in read("b.csv", id_field="id")] == [("1", "hello", {"extra": "x"})]
    assert [(r.text, r.metadata) for r in read("c.jsonl")] == [("one", {"k": "1"})]
    assert sorted((r.document_id, r.text) for r in read("d.json", id_field="id")) == [("7", "r1"), ("d-1", "r2")]
    assert [r.text for r in read("e.weird")] == ["café"]
    assert readers.whole_files(spark, str(tmp_path), "*.txt").count() == 1
    assert readers.folder(spark, str(tmp_path)).count() == 6


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("c1", "alpha beta", [0.1, 1e-300], [0.5, 0.25])], "chunk_id string, text string, mu array<double>, sigma_diag array<double>")
    writers.save_store(df, str(tmp_path / "store"))
    assert writers.load_store(spark, str(tmp_path / "store")).collect() == df.collect()
    writers.save_store(df, str(tmp_path / "store"))
    assert writers.load_index(spark, str(tmp_path / "store")).rows.count() == 2
    import shutil

    shutil.rmtree(tmp_path / "store/index")
    assert writers.load_index(spark, str(tmp_path / "store")).rows.count() == 2  # made anew from the chunks
    docs = spark.createDataFrame([(2, "B", "two"), (1, None, "one")], "n int, title string, text string")
    writers.to_markdown(docs, str(tmp_path / "md"), "n", "All")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "md"), wholetext=True).collect())
    assert text.index("# All") < text.index("## Untitled") < text.index("## B")
    writers.to_jsonl(docs, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2
    writers.to_text(docs, str(tmp_path / "tx"), "n")


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string")
    hit, miss = writers.cached(spark, path, texts, "1")
    assert hit.count() == 0 and miss.count() == 2
    writers.store_results(texts.where("k = 1").select("text", F.lit("done").alias("result")), path, "1")
    hit, miss = writers.cached(spark, path, texts, "1", 3600)
    assert [(r.k, r.result) for r in hit.collect()] == [(1, "done")] and [r.k for r in miss.collect()] == [2]
    assert writers.cached(spark, path, texts, "2")[0].count() == 0
    writers.store_results(texts.where("k = 2").select("text", F.lit("more").alias("result")), path, "1")
    assert tuple(writers.cache_stats(spark, path).first()) == (2, 8)
    writers.invalidate(spark, path, texts.where("k = 1"))
    assert [r.k for r in writers.cached(spark, path, texts, "1")[0].collect()] == [2]
    writers.evict(spark, path, 1)
    assert writers.cache_stats(spark, path).first().entries == 1
    writers.clear(spark, path)
    assert writers.cache_stats(spark, path).first().entries == 0
    writers.append_turns(texts, str(tmp_path / "chat"))
    writers.append_turns(texts, str(tmp_path / "chat"))
    assert spark.read.parquet(str(tmp_path / "chat")).where("ts is not null").count() == 4


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    df = spark.range(20).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    src = str(tmp_path / "src")
    for i in range(4):
        df.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(src)
    seen = []
    trigger = S.CountTrigger(8, lambda b, i: seen.append(b.count()), str(tmp_path / "gathered"))
    trigger.start(stream(spark, src, schema), str(tmp_path / "cp1")).awaitTermination(60)
    assert trigger.rows == 20 and seen == [10, 10] and trigger.pending(spark).count() == 0
    again = S.CountTrigger(8, lambda b, i: seen.append(b.count()), str(tmp_path / "gathered"))  # after a restart
    again(df.limit(5), 90)
    again(df.limit(5), 90)
    assert seen == [10, 10] and again.pending(spark).count() == 5
    again(df.limit(4), 91)
    assert seen == [10, 10, 9]
    S.append_log(stream(spark, src, schema), str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination(60)
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 20 and "recorded_at" in log.columns
    q = S.windowed(stream(spark, src, schema), "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.sql("select sum(n) from w").first()[0] == 20
    q = S.deduplicated(stream(spark, src, schema), "user_id", "1 hour").writeStream.format("memory").queryName("d").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.sql("select count(*) from d").first()[0] == 2
    assert S.trigger_points(df, 6).count() == 3


def test_state_with_time_to_live(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.range(10).select((F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value"))
    df.coalesce(1).write.parquet(src)
    q = S.latest_with_ttl(spark.readStream.schema(df.schema).parquet(src), "user_id", "value", 60_000).writeStream.format("memory").queryName("t").outputMode("update").start()
    end = time.time() + 40
    while time.time() < end and not spark.sql("select * from t").count():
        time.sleep(0.5)
    q.stop()
    got = {r.user_id: (r.value, r.n) for r in spark.sql("select * from t where not expired").collect()}
    assert got == {0: (8.0, 5), 1: (9.0, 5)}
