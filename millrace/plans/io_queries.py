"""Queries that write and read back: sources, sinks, resumable batches, buffers and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..sources.files import Files
from ..sources.generated import CountingProblems
from ..sources.tracking import Tracking, log_observed, observed, tracked_stream
from ..streaming import batches as S
from ..streaming.state import adaptive_coefficients, failure_queue, state_store
from .base import query, scratch, table

_CUSTOMER = "SELECT c_custkey, c_nationkey FROM customer"


def _customer(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey")


@query("scan_one_file", "SELECT n_nationkey, n_name FROM nation")
def scan_one_file(spark, d):
    return io.read_parquet(spark, f"{d}/nation.parquet", columns=["n_nationkey", "n_name"])


@query("scan_shards", _CUSTOMER)
def scan_shards(spark, d):
    path = scratch(spark, "shards")
    for k in range(3):
        io.write_parquet(_customer(spark, d).where(F.col("c_custkey") % 3 == k), f"{path}/train-{k}.parquet")
    return io.read_parquet(spark, *[f"{path}/train-{k}.parquet" for k in (2, 0, 1)])


@query("scan_folder", "SELECT 'customer' AS kind, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'supplier', count(*)::BIGINT FROM supplier")
def scan_folder(spark, d):
    tables = io.read_tables(spark, d, "customer", "supplier")
    return tables["customer"].select(F.lit("customer").alias("kind")).unionByName(tables["supplier"].select(F.lit("supplier").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("scan_json_corpus", "SELECT p_partkey::VARCHAR AS id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type || chr(10) || 'x' ELSE '' END AS text FROM part")
def scan_json_corpus(spark, d):
    path = scratch(spark, "corpus")
    contents = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n"), "p_type", F.lit("\nx"))).otherwise(F.lit("")))
    io.write_jsonl(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), contents.alias("contents")), path)
    return io.read_corpus(spark, path).select("id", "title", "text")


@query("generated_problems", "SELECT CASE WHEN i % 10 = 9 THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS n, count(*)::BIGINT AS n_right FROM (SELECT unnest(range(200)) AS i) GROUP BY 1")
def generated_problems(spark, d):
    """Each response's box against the letter counted in the question."""
    spark.dataSource.register(CountingProblems)
    rows = spark.read.format("counting_problems").option("rows", "200").load()
    letter, word = F.regexp_extract("prompt", "How many (.) are", 1), F.regexp_extract("prompt", "in ([a-z]+)", 1)
    right = F.regexp_extract("response", r"boxed\{(\d+)\}", 1).cast("int") == F.length(word) - F.length(F.replace(word, letter, F.lit("")))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))


@query("sink_overwrite", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 5")
def sink_overwrite(spark, d):
    path = scratch(spark, "overwrite")
    io.write_parquet(_customer(spark, d), path)
    io.write_parquet(_customer(spark, d).where("c_nationkey > 5"), path)
    return io.read_parquet(spark, path)


@query("sink_derived_name", "SELECT 'corpus_dgt6p5_n100.parquet' AS name, count(*)::BIGINT AS n FROM customer")
def sink_derived_name(spark, d):
    folder = scratch(spark, "derived")
    io.write_parquet(_customer(spark, d), io.difficulty_path(folder, 6.5, 100))
    name = Files(spark).names(folder)[0]
    return io.read_parquet(spark, f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))


@query("sink_batches", "SELECT c_custkey % 4 AS batch, CASE WHEN c_custkey % 4 = 1 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, c_custkey FROM customer")
def sink_batches(spark, d):
    path = scratch(spark, "batches")
    rows = _customer(spark, d).withColumn("batch", F.col("c_custkey") % 4)
    io.write_batches(rows, path)
    io.write_batches(rows.where("batch = 1").withColumn("c_nationkey", F.col("c_nationkey") + 100), path)  # a batch made again
    return io.read_parquet(spark, path).select(F.col("batch").cast("long").alias("batch"), "c_nationkey", "c_custkey")


@query("resume_batches", "SELECT c_custkey FROM customer WHERE c_custkey % 4 >= 2")
def resume_batches(spark, d):
    path = scratch(spark, "resume")
    rows = _customer(spark, d).withColumn("batch", F.col("c_custkey") % 4)
    io.write_batches(rows.where("batch < 2"), path)
    return io.without_done(rows, io.read_parquet(spark, path), "batch").select("c_custkey")


@query("sink_generations", "SELECT p_name AS input, p_type AS output, p_size::DOUBLE AS score, 7::BIGINT AS step, p_brand FROM part")
def sink_generations(spark, d):
    path = scratch(spark, "generations")
    io.dump_generations(table(spark, d, "part").select(F.col("p_name").alias("input"), F.col("p_type").alias("output"), F.col("p_size").cast("double").alias("score"), "p_brand"), path, 7)
    return spark.read.json(path).select("input", "output", "score", "step", "p_brand")


@query("sink_rows_json", "SELECT p_partkey, p_name FROM part")
def sink_rows_json(spark, d):
    path = scratch(spark, "rows")
    io.write_jsonl(table(spark, d, "part").select("p_partkey", "p_name"), path)
    return spark.read.json(path)


@query("sink_metrics", "SELECT s.step::BIGINT AS step, n.n_name AS name, CASE WHEN n.n_nationkey % 3 > 0 THEN n.n_nationkey::DOUBLE END AS value FROM nation n, (SELECT unnest([1, 2]) AS step) s")
def sink_metrics(spark, d):
    path = scratch(spark, "metrics")
    key = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(key % 3 > 0, key.cast("double")).otherwise(F.lit(float("nan"))).alias("value"))
    for step in (1, 2):
        io.append_metrics(rows, path, step)
    return spark.read.json(path).select("step", "name", F.col("value").cast("double").alias("value"))


@query("sink_arrays", "SELECT vec_id, round(list_sum(embedding::FLOAT[]::DOUBLE[]), 6) AS total FROM embeddings")
def sink_arrays(spark, d):
    path = scratch(spark, "arrays")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    io.dump_arrays(rows, path, ["vec_id", "embedding"])
    return io.read_parquet(spark, path).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("flat_columns", "SELECT p_partkey AS \"a/key\", p_brand AS \"a/b/brand\", p_size AS size FROM part")
def flat_columns(spark, d):
    rows = table(spark, d, "part").select(F.struct(F.col("p_partkey").alias("key"), F.struct(F.col("p_brand").alias("brand")).alias("b")).alias("a"), F.col("p_size").alias("size"))
    return rows.select(*io.flat_columns(rows))


@query("stream_batches", "SELECT c_custkey, c_nationkey * 2 AS twice FROM customer")
def stream_batches(spark, d):
    path = scratch(spark, "stream")
    _customer(spark, d).repartition(3).write.parquet(f"{path}/in")
    source = spark.readStream.schema("c_custkey long, c_nationkey int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    S.run_batches(source, lambda df: df.select("c_custkey", (F.col("c_nationkey") * 2).alias("twice")), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("c_custkey", "twice")


def _by_thirds(spark, path: str, rows, step: str, flow) -> None:
    """Runs a stateful flow over a table in three starts of one query: each reads the next third of the steps and goes
    on with the state that the last one left in the checkpoint."""
    low, high = rows.agg(F.min(step), F.max(step)).first()
    third = (high - low) // 3 + 1
    for k in range(3):
        rows.where((F.col(step) - low >= k * third) & (F.col(step) - low < (k + 1) * third)).write.mode("append").parquet(f"{path}/in")
        with state_store(spark):
            query_ = flow(spark.readStream.schema(rows.schema).parquet(f"{path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
            query_.trigger(availableNow=True).start(f"{path}/out").awaitTermination()


@query("failure_recycling", """WITH e AS (SELECT 'u' || user_id AS prompt, event_id AS seq, event_type = 'purchase' AS success, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY prompt, run, success ORDER BY seq) AS i FROM e), g AS (SELECT prompt, CASE WHEN success THEN 0 ELSE (i - 1) % 3 + 1 END AS recycle_count, CASE WHEN success THEN 'solved' WHEN i % 3 = 0 THEN 'dropped' ELSE 'retry' END AS event FROM f)
SELECT prompt, recycle_count::BIGINT AS recycle_count, event, count(*)::BIGINT AS n FROM g GROUP BY ALL""")
def failure_recycling(spark, d):
    """Users as prompts, their events as attempts: counters of failures in a row, dropped at the third; three starts."""
    path = scratch(spark, "recycling")
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("prompt"), (F.col("event_type") == "purchase").alias("success"), F.col("event_id").alias("at"))
    _by_thirds(spark, path, rows, "at", lambda source: S.recycle_failures(source, 3, order="at"))
    return spark.read.parquet(f"{path}/out").groupBy("prompt", "recycle_count", "event").agg(F.count("*").alias("n"))


_KL = "k AS (SELECT user_id % 10 AS run, event_id // 50 AS step, avg(value) / 50 AS kl, count(*) AS n FROM events GROUP BY ALL)"


@query("adaptive_kl", f"""WITH RECURSIVE {_KL}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM k), b AS (SELECT run, 0::BIGINT AS i, -1::BIGINT AS step, 0.2::DOUBLE AS beta FROM k GROUP BY run
UNION ALL SELECT o.run, o.i, o.step, b.beta * (1 + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, o.kl - 1)) * o.n / 2000.0::DOUBLE) FROM b JOIN o ON o.run = b.run AND o.i = b.i + 1)
SELECT run, step, round(beta, 9) AS beta FROM b WHERE i > 0""")
def adaptive_kl(spark, d):
    """A coefficient for each of ten runs, from the mean values of their events, step by step; three starts."""
    path = scratch(spark, "adaptive")
    steps = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("run"), F.floor(F.col("event_id") / 50).alias("step")).agg((F.avg("value") / 50).alias("kl"), F.count("*").alias("n"))
    _by_thirds(spark, path, steps, "step", lambda source: adaptive_coefficients(source, 0.2, 1.0, 2000.0))
    return spark.read.parquet(f"{path}/out").select("run", "step", F.round("beta", 9).alias("beta"))


@query("failure_queue", """WITH RECURSIVE f AS (SELECT user_id % 7 AS b, event_id // 20 AS step, coalesce(list(event_id ORDER BY event_id) FILTER (event_type <> 'purchase'), []) AS lost FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY step) AS i FROM f), q AS (SELECT b, 0::BIGINT AS i, -1::BIGINT AS step, []::BIGINT[] AS q, -100::BIGINT AS last, []::BIGINT[] AS going FROM f GROUP BY b
UNION ALL SELECT b, i, step, CASE WHEN fire THEN q[13:] ELSE q END, CASE WHEN fire THEN step ELSE last END, CASE WHEN fire THEN q[1:12] ELSE [] END
  FROM (SELECT o.b, o.i, o.step, q.q || o.lost AS q, q.last, len(q.q) + len(o.lost) >= 15 AND o.step - q.last > 2 AS fire FROM q JOIN o ON o.b = q.b AND o.i = q.i + 1))
SELECT b AS buffer, step, (place - 1) // 4 AS chunk, place - 1 AS place, 'e' || going[place] AS prompt, 1::BIGINT AS recycle_count FROM (SELECT *, unnest(range(1, len(going) + 1)) AS place FROM q)""")
def failure_queue_(spark, d):
    """Seven buffers of failed attempts: fifteen waiting, and three steps since the last time, let twelve go in chunks of four."""
    path = scratch(spark, "queue")
    e = table(spark, d, "events")
    rows = e.select((F.col("user_id") % 7).alias("buffer"), F.floor(F.col("event_id") / 20).alias("step"), F.col("event_id").alias("place"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("prompt"), (F.col("event_type") == "purchase").alias("success"), F.lit(0).alias("recycle_count"))
    _by_thirds(spark, path, rows, "step", lambda source: failure_queue(source, size=4, trigger=15, rounds=3, cooldown=2))
    return spark.read.parquet(f"{path}/out")


@query("failure_buffer", "SELECT 'c' || c_custkey AS prompt, 1::BIGINT AS recycle_count, 9::BIGINT AS arrived FROM (SELECT c_custkey FROM customer ORDER BY 'c' || c_custkey LIMIT 20) WHERE c_custkey % 2 = 0")
def failure_buffer(spark, d):
    """The first twenty waiting prompts are drained by a second instance; the even ones fail again and come back last."""
    path = scratch(spark, "buffer")
    new = lambda: S.FailureBuffer(spark, path, size=10, trigger=15, rounds=2, cooldown=2)
    new().add(table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("prompt")), 1)
    second = new()
    drained = second.drain(5)
    failed = drained.where(F.substring("prompt", 2, 20).cast("long") % 2 == 0)
    second.give_back(drained, failed, 9)
    return new().table().where("recycle_count = 1").select("prompt", "recycle_count", "arrived")


@query("prompt_buffer", "SELECT c_custkey FROM customer WHERE c_nationkey >= 0 ORDER BY c_custkey LIMIT 50 OFFSET 30")
def prompt_buffer(spark, d):
    path = scratch(spark, "prompts")
    S.PromptBuffer(spark, path).add(_customer(spark, d), "c_custkey")
    S.PromptBuffer(spark, path).take(30, 4)
    return S.PromptBuffer(spark, path).take(50, 4).select("c_custkey")


@query("sampler_batch", "SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':47:1'), c_custkey LIMIT 20 OFFSET 40)")
def sampler_batch(spark, d):
    return S.ResumableSampler(_customer(spark, d), "c_custkey", scratch(spark, "sampler"), span=25).batch(1, 40, 20).select("c_custkey")


@query("accumulated_groups", "SELECT true AS enough, count(*) >= 5 AS there FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type = 'purchase') = 2)")
def accumulated_groups(spark, d):
    path = scratch(spark, "accumulate")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("event_id").cast("int").alias("k"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("score"))
    rows.repartition(4, "uid").write.parquet(f"{path}/in")
    source = spark.readStream.schema("uid string, k int, score double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    enough = S.accumulate_groups(source, f"{path}/out", f"{path}/checkpoint", 5, spark)
    return spark.read.parquet(f"{path}/out").agg(F.lit(enough).alias("enough"), (F.count_distinct("uid") >= 5).alias("there"))


@query("copied_folder", _CUSTOMER)
def copied_folder(spark, d):
    path = scratch(spark, "copy")
    io.write_parquet(_customer(spark, d), f"{path}/a")
    Files(spark).copy(f"{path}/a", f"{path}/b")
    return io.read_parquet(spark, f"{path}/b")


@query("dataset_local_first", "SELECT n_nationkey, n_name FROM nation")
def dataset_local_first(spark, d):
    return io.read_dataset(spark, "nation", f"{d}/none", d).select("n_nationkey", "n_name")


@query("saved_batch", "SELECT c_custkey, c_nationkey, 'gen' AS stage, 7::BIGINT AS step FROM customer")
def saved_batch(spark, d):
    path = scratch(spark, "batch")
    io.save_batch(_customer(spark, d), path, {"stage": "gen", "step": 7})
    rows, meta = io.load_batch(spark, path)
    return rows.withColumns({"stage": F.lit(meta["stage"]), "step": F.lit(meta["step"]).cast("long")})


_OBSERVED = "count(*)::DOUBLE AS n, round(sum(l_quantity), 4) AS quantity, round(avg(l_discount), 9) AS discount"


@query("tracked_metrics", f"""WITH m AS (SELECT l_linenumber AS step, {_OBSERVED} FROM lineitem GROUP BY l_linenumber), u AS (UNPIVOT m ON n, quantity, discount INTO NAME name VALUE value)
SELECT b.backend, u.step::BIGINT AS step, u.name, u.value FROM u, (SELECT unnest(['json', 'parquet']) AS backend) b""")
def tracked_metrics(spark, d):
    """A write per line number; what is logged to two backends was observed while the rows were written."""
    path = scratch(spark, "tracking")
    run, rows = Tracking(spark, ["json", "parquet"], path), table(spark, d, "lineitem")
    for step in (r[0] for r in rows.select("l_linenumber").distinct().orderBy("l_linenumber").collect()):  # a few
        part, seen = observed(rows.where(F.col("l_linenumber") == step), f"step-{step}", n=F.count("*"), quantity=F.sum("l_quantity"), discount=F.avg("l_discount"), note=F.lit("text"))
        part.write.mode("append").parquet(f"{path}/rows")
        log_observed(run, seen, step)
    value = F.when(F.col("name") == "quantity", F.round("value", 4)).otherwise(F.round("value", 9))
    read = lambda name, df: df.select(F.lit(name).alias("backend"), F.col("step").cast("long").alias("step"), "name", F.col("value").cast("double").alias("value"))
    return read("json", spark.read.json(f"{path}/json")).unionByName(read("parquet", spark.read.parquet(f"{path}/parquet"))).withColumn("value", value)


@query("stream_metrics", "WITH m AS (SELECT count(*)::DOUBLE AS n, round(sum(value), 4) AS total, max(value)::DOUBLE AS most FROM events GROUP BY event_id % 4), u AS (UNPIVOT m ON n, total, most INTO NAME name VALUE value) SELECT name, value FROM u")
def stream_metrics(spark, d):
    """Four micro-batches of events: their metrics come from the query's progress."""
    path = scratch(spark, "stream-metrics")
    rows = table(spark, d, "events").select("event_id", "value")
    for k in range(4):
        rows.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    tracked_stream(source, Tracking(spark, ["parquet"], path), "events", {"n": F.count("*"), "total": F.sum("value"), "most": F.max("value")}, f"{path}/out", f"{path}/checkpoint")
    value = F.when(F.col("name") == "total", F.round("value", 4)).otherwise(F.col("value"))
    return spark.read.parquet(f"{path}/parquet").select("name", value.alias("value"))


@query("local_copies", "SELECT p_partkey, p_name FROM part")
def local_copies(spark, d):
    """A table by URL copied once to a cache, from where the rows come; the cache lies in the shared folder, so tasks see it."""
    path = scratch(spark, "cache")
    source = f"{d}/part.parquet" if "://" in d else f"file://{d}/part.parquet"
    copies = [Files(spark).local_copy(source, path.removeprefix("file://")) for _ in range(2)]  # the second call finds the copy
    return spark.read.parquet(*{f"file://{c}" for c in copies}).select("p_partkey", "p_name")
