"""Stream state, observed metrics, packed test cases, limits on scorers."""

import base64
import os
import pickle
import random
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import expressions as X
from millrace.functions import grading as G
from millrace.functions.guard import limited_map, limited_udf
from millrace.operators import adapters as D
from millrace.sources.tracking import Tracking, log_observed, observed, tracked_stream
from millrace.streaming import state as S


def run(spark, folder, frames, schema, flow):
    """Starts the flow once for each frame, on one checkpoint."""
    for rows in frames:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        with S.state_store(spark):
            q = flow(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start(f"{folder}/out")
            q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_coefficients_go_on_from_the_checkpoint(spark, tmp_path):
    rng = random.Random(1)
    rows = [(r, s, None if rng.random() < 0.1 else rng.expovariate(1), rng.randrange(1, 60)) for r in range(4) for s in range(30)]
    want = {}
    for r, s, kl, n in rows:
        beta = want.get((r, s - 1), 0.3)
        want[r, s] = beta if kl is None else beta * (1 + max(-0.2, min(0.2, kl / 0.7 - 1)) * n / 500)
    schema, flow = "run long, step long, kl double, n long", lambda df: S.adaptive_coefficients(df, 0.3, 0.7, 500.0)
    shuffled = rng.sample(rows, len(rows))
    thirds = [[x for x in shuffled if x[1] // 10 == k] for k in range(3)]
    for name, frames in (("whole", [shuffled]), ("thirds", thirds)):
        out = run(spark, tmp_path / name, frames, schema, flow)
        assert {(r["run"], r["step"]): r["beta"] for r in out.collect()} == pytest.approx(want)


def plain_queue(rows, size, trigger, rounds, cooldown, most):
    out, queue, last = [], [], None
    for step in sorted({r[1] for r in rows}):
        queue += [(r[3], r[5]) for r in sorted((r for r in rows if r[1] == step), key=lambda r: r[2]) if r[4] is not True and r[5] < most]
        if len(queue) >= trigger and (last is None or step - last > cooldown):
            out += [(step, i // size, i, p, c + 1) for i, (p, c) in enumerate(queue[: size * rounds])]
            queue, last = queue[size * rounds :], step
    return out


def test_failures_wait_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(b, s, i, f"p{b}-{s}-{i}", rng.choice([True, False, False, None]), rng.randrange(4)) for b in range(3) for s in range(24) for i in range(rng.randrange(0, 5))]
    schema = "buffer long, step long, place long, prompt string, success boolean, recycle_count int"
    shuffled = rng.sample(rows, len(rows))
    out = run(spark, tmp_path, [[x for x in shuffled if x[1] // 8 == k] for k in range(3)], schema, lambda df: S.failure_queue(df, size=2, trigger=5, rounds=2, cooldown=1, max_recycle=3))
    got = sorted((r["buffer"], r["step"], r["chunk"], r["place"], r["prompt"], r["recycle_count"]) for r in out.collect())
    assert got == sorted((b, *x) for b in range(3) for x in plain_queue([r for r in rows if r[0] == b], 2, 5, 2, 1, 3)) and got


def test_metrics_are_observed_without_another_pass(spark, tmp_path):
    track = Tracking(spark, ["parquet"], str(tmp_path / "m"))
    df, seen = observed(spark.range(100), "job", n=F.count("*"), total=F.sum("id"), note=F.lit("x"))
    df.write.parquet(str(tmp_path / "rows"))
    assert log_observed(track, seen, 3) == {"n": 100, "total": 4950, "note": "x"}
    spark.range(10, 30).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    args = (track, "s", {"n": F.count("*"), "most": F.max("id")}, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert tracked_stream(source(), *args) == 2
    assert tracked_stream(source(), *args) == 0  # nothing new
    got = sorted((r["name"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m/parquet")).collect())
    assert got == [("most", 4.0), ("most", 29.0), ("n", 5.0), ("n", 20.0), ("n", 100.0), ("total", 4950.0)]


class Evil:
    def __reduce__(self):
        return os.system, ("touch /tmp/never",)


def test_packed_cases(spark):
    pack = lambda raw: base64.b64encode(zlib.compress(raw)).decode()
    text = '[{"input":"1\\n","output":"é"}]'
    blobs = [pack(text.encode()), pack(pickle.dumps(text)), pack(pickle.dumps(text, protocol=2)), pack(b"x" * (1 << 22)), pack(pickle.dumps(Evil())), pack(pickle.dumps([text])), pack(text.encode())[:-9], "no blob!", "", pack(b"\xff\xfe"), None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b string")
    got = {r["i"]: r["t"] for r in df.select("i", D.unpacked_cases("b", 1 << 20).alias("t")).collect()}
    assert [got[i] for i in range(3)] == [text] * 3 and all(got[i] is None for i in range(3, len(blobs)))
    again = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", D.unpacked_cases(D.packed_cases("t")).alias("u"))
    assert all(r["t"] == r["u"] for r in again.collect())
    merged = spark.createDataFrame([(text, "broken", "f")], "a string, b string, n string").select(D.merge_test_cases("a", "b", "n").alias("m")).first()["m"]
    assert merged == '{"inputs":["1\\n"],"outputs":["é"],"fn_name":"f"}'


def sometimes(x, y):
    if x == 3:
        time.sleep(30)
    if x == 4:
        while True:
            pass
    if x == 5:
        os._exit(1)
    return float(x / y)


def test_late_rows_cost_only_themselves(spark):
    rows = [(x, 2) for x in range(8)] + [(1, 0), (None, 1)]
    want = [0.0, 0.5, 1.0, -1.0, -1.0, -1.0, 3.0, 3.5, -1.0, -1.0]
    began = time.perf_counter()
    assert limited_map(sometimes, rows, -1.0, 0.5) == want and limited_map(sometimes, [], -1.0, 0.5) == []
    other = []
    thread = threading.Thread(target=lambda: other.append(limited_map(sometimes, rows, -1.0, 0.5)))  # not the main thread
    thread.start()
    thread.join()
    assert other == [want] and time.perf_counter() - began < 10
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x int, y int").filter("x is not null").coalesce(1)
    got = df.select("i", limited_udf(sometimes, "double", -1.0, 0.5)("x", "y").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == want[:-1]


def test_answers_are_compared_by_what_they_are():
    assert not X.equal("abs(x)", "x") and not G.grade_symbolic("\\sqrt{x^2}", "x") and X.equal("(x+y)^2", "x^2+2*x*y+y^2")
    a = G.read_answer("Interval.Ropen(1, 2\\pi)")
    assert (a.kind, a.brackets, [i.kind for i in a.items]) == ("sequence", "[)", ["number", "number"])
    assert G.read_answer("\\begin{pmatrix}1&2\\\\3&x\\end{pmatrix}").kind == "matrix" and G.read_answer("(1+2)*(3+4)").kind == "expression"
    right = [("Matrix([[1, 2], [3, 4]])", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}"), ("(1, (2, 3))", "(1,(2,3))"), ("1, 2", "(1, 2)"), ("[5]", "5"), ("12.5\\%", "0.125"), ("1,000", "1000"), ("(0.5, x+1)", "(1/2, 1+x)"), ("X", "x")]
    wrong = [("(1, 2)", "[1, 2]"), ("(1, 2)", "(2, 1)"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"), ("(1, 2, 3)", "(1, 2)"), ("x", "5"), ("", "")]
    assert [p for p in right if not G.close_enough(*p)] == [] and [p for p in wrong if G.close_enough(*p)] == []
    deep = "(" * 300 + "1,2" + ")" * 300
    assert G.close_enough(deep, deep) and not G.close_enough(deep, "1")


def test_failure_queue_takes_many_small_steps():
    """200,000 attempts of one buffer in small steps: no table is made for each step, and rows go out in parts."""
    import time

    import pandas as pd

    class State:
        value = []

        def exists(self):
            return False

        def get(self):
            return iter(())

        def put(self, rows):
            self.value = rows

        def clear(self):
            self.value = []

        update = appendList = put

    n = 200_000
    frame = pd.DataFrame({"step": [i // 5 for i in range(n)], "place": range(n), "prompt": [f"p{i}" for i in range(n)], "success": [i % 4 == 0 for i in range(n)], "recycle_count": 0})
    queue = S.FailureQueue(4, 8, 3, 0, 3)
    queue.waiting, queue.drained = State(), State()
    shuffled = frame.sample(frac=1, random_state=1)
    began = time.process_time()
    found = list(queue.handleInputRows((0,), iter([shuffled[: n // 2], shuffled[n // 2 :]]), None))
    assert time.process_time() - began < 12 and max(map(len, found)) < 11_000
    went = pd.concat(found)["prompt"].tolist() + [p for p, _ in queue.waiting.value]
    assert went == [f"p{i}" for i in range(n) if i % 4]
