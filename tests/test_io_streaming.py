"""Sources, sinks and stateful flows."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import io
from millrace.sources.files import Files
from millrace.sources.generated import CountingProblems
from millrace.streaming import batches as S


def test_round_trips(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 4).alias("batch"))
    p = str(tmp_path / "b")
    io.write_batches(df, p)
    io.write_batches(df.where("batch = 1 and id < 6"), p)  # replaces batch 1 only
    back = io.read_parquet(spark, p)
    assert back.count() == 17 and io.without_done(df, back, "id").count() == 3
    with pytest.raises(ValueError):
        io.read_parquet(spark)
    assert io.difficulty_path("x", 6.5, 10) == "x/corpus_dgt6p5_n10.parquet" and io.difficulty_path("x", 6.0, 10, True) == "x/corpus_dge6_n10.parquet"
    (tmp_path / "c.jsonl").write_text('{"id": "1", "contents": "Title\\nBody\\nmore"}\n{"id": "2", "contents": "Only"}\n')
    got = {r["id"]: (r["title"], r["text"]) for r in io.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"1": ("Title", "Body\nmore"), "2": ("Only", "")}
    m = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "name string, value double")
    io.append_metrics(m, str(tmp_path / "m"), 1)
    io.append_metrics(m, str(tmp_path / "m"), 2)
    assert spark.read.json(str(tmp_path / "m")).where("value is not null").count() == 2
    nested = spark.createDataFrame([((1, (2,)), 3)], "a struct<x:int,b:struct<y:int>>, c int")
    assert nested.select(*io.flat_columns(nested)).columns == ["a/x", "a/b/y", "c"]
    io.dump_arrays(spark.createDataFrame([([1.0], 2)], "v array<double>, id int"), str(tmp_path / "d"), ["id", "v"])
    assert dict(spark.read.parquet(str(tmp_path / "d")).dtypes)["v"] == "array<float>"


def test_generated_source(spark):
    spark.dataSource.register(CountingProblems)
    df = spark.read.format("counting_problems").option("rows", "30").load()
    rows = df.collect()
    assert len(rows) == 30 and sum(r["split"] == "test" for r in rows) == 3
    for r in rows:
        letter, word = r["prompt"].split()[2], r["prompt"].rstrip("?").split()[-1]
        assert r["response"].endswith(f"\\boxed{{{word.count(letter)}}}")


def test_batches_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(5).write.parquet(src)
    for rows in (5, 8):
        stream = spark.readStream.schema("id long").parquet(src)
        S.run_batches(stream, lambda d: d.withColumn("y", F.col("id") * 2), out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == rows
        spark.range(100, 103).write.mode("append").parquet(src)


def test_recycling(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.createDataFrame([("p", False), ("q", True)], "prompt string, success boolean").coalesce(1).write.parquet(src)
    q = S.recycle_failures(spark.readStream.schema("prompt string, success boolean").parquet(src), 2).writeStream.format("memory").queryName("rec").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("rec").collect()} == {("p", 1, "retry"), ("q", 0, "solved")}


def test_failure_buffer(spark, tmp_path):
    buf = S.FailureBuffer(spark, str(tmp_path / "buf"), size=2, trigger=3, max_recycle=2)
    mk = lambda *xs: spark.createDataFrame([(x,) for x in xs], "prompt string")
    buf.add(mk("a", "b"), 1)
    assert buf.drain(1) is None
    buf.add(mk("c"), 2)
    got = buf.drain(2)
    assert [r["prompt"] for r in got.collect()] == ["a", "b"]
    buf.give_back(got, mk("a"), 2)
    assert {(r["prompt"], r["recycle_count"]) for r in buf.table().collect()} == {("c", 0), ("a", 1)}
    buf.give_back(buf.table(), mk("a", "c"), 3)
    assert {(r["prompt"], r["recycle_count"]) for r in buf.table().collect()} == {("c", 1)}


def test_failure_buffer_restarts(spark, tmp_path):
    mk = lambda *xs: spark.createDataFrame([(x,) for x in xs], "prompt string")
    new = lambda: S.FailureBuffer(spark, str(tmp_path / "buf"), size=2, trigger=2, rounds=2, cooldown=3)
    new().add(mk("b", "a"), 1)
    again = new()
    assert {r["prompt"] for r in again.table().collect()} == {"a", "b"}
    again.add(mk("z", "c", "d"), 2)
    third = new()
    got = third.drain(5)
    assert [(r["prompt"], r["chunk"]) for r in third.chunks(got).collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 1)], "first in, first out"
    fourth = new()
    assert fourth.last == 5 and fourth.drain(8) is None, "the cooldown outlives the process"
    fourth.give_back(got, mk("a"), 8)
    last = new()
    assert [r["prompt"] for r in last.drain(9).collect()] == ["z", "a"]
    (tmp_path / "buf" / "v=99").mkdir()  # a version that was cut short doesn't count
    assert new().table().count() == 2


def test_prompt_buffer(spark, tmp_path):
    new = lambda: S.PromptBuffer(spark, str(tmp_path / "p"))
    assert new().take(4, 2) is None
    new().add(spark.range(5), "id")
    b = new()
    b.add(spark.range(10, 15), "id")
    assert sorted(r["id"] for r in b.take(4, 2).collect()) == [0, 1, 2, 3]
    assert new().size() == 6 and sorted(r["id"] for r in new().take(100, 4).collect()) == [4, 10, 11, 12]
    assert new().size() == 2 and new().take(3, 3) is None


def test_accumulation_is_a_gate(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for i in range(6):  # a file, and so a batch, of two groups: one varies
        spark.createDataFrame([(f"a{i}", 0, 1.0), (f"a{i}", 1, 0.0), (f"b{i}", 0, 1.0), (f"b{i}", 1, 1.0)], "uid string, k int, score double").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("uid string, k int, score double").option("maxFilesPerTrigger", 1).parquet(src)
    groups = lambda: spark.read.parquet(out).select("uid").distinct().count()
    assert S.accumulate_groups(stream(), out, ck, 2, spark) and groups() == 2
    assert S.accumulate_groups(stream(), out, ck, 2, spark) and groups() == 2, "enough is enough"
    assert S.accumulate_groups(stream(), out, ck, 4, spark) and groups() == 4, "it goes on where it stopped"
    assert not S.accumulate_groups(stream(), out, ck, 9, spark) and groups() == 6


def test_files(spark, tmp_path):
    f = Files(spark)
    f.make_dirs(str(tmp_path / "a/b"))
    (tmp_path / "a/b/x.txt").write_text("one")
    f.copy(str(tmp_path / "a"), str(tmp_path / "c"))
    assert f.names(str(tmp_path / "c/b")) == ["x.txt"] and f.exists(str(tmp_path / "c/b/x.txt")) and not f.exists(str(tmp_path / "none")) and f.names(str(tmp_path / "none")) == []
    with pytest.raises(FileExistsError):
        f.copy(str(tmp_path / "a"), str(tmp_path / "c"), overwrite=False)
    where = f.local_copy(f"file://{tmp_path}/a/b/x.txt", str(tmp_path / "cache"))
    assert open(where).read() == "one" and where != str(tmp_path / "a/b/x.txt")
    (tmp_path / "a/b/x.txt").write_text("two")
    assert open(f.local_copy(f"file://{tmp_path}/a/b/x.txt", str(tmp_path / "cache"))).read() == "one"
    assert open(f.local_copy(f"file://{tmp_path}/a/b/x.txt", str(tmp_path / "cache"), always=True)).read() == "two"
    assert f.local_copy("/plain/path", "x") == "/plain/path"


def test_sampler(spark, tmp_path):
    s = S.ResumableSampler(spark.range(10), "id", str(tmp_path / "s"), span=4)
    first, second = ([r["id"] for r in s.batch(0, p, 5).collect()] for p in (0, 5))
    assert sorted(first + second) == list(range(10)) and [r["id"] for r in s.batch(0, 5, 5).collect()] == second
    assert [r["id"] for r in s.batch(1, 0, 10).collect()] != first + second


def test_sampler_makes_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S.ResumableSampler, "FOLDERS", 8)
    new = lambda: S.ResumableSampler(spark.range(100), "id", str(tmp_path / "s"), span=2)
    found = [r["id"] for p in (0, 40, 80) for r in new().batch(0, p, 40).collect()]
    assert sorted(found) == list(range(100))
    assert len(list((tmp_path / "s").glob("epoch=0/*/_span=*"))) == 8
