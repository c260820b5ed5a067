"""Queries over evaluation and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as R
from .base import ROLLOUTS, query, r6, rollouts, table


def _order_sql(n: int, best: bool) -> str:
    name, how = ("best", "") if best else ("worst", "DESC")
    return f"WITH {ROLLOUTS}, o AS (SELECT uid, value, row_number() OVER (PARTITION BY uid ORDER BY value {how})::DOUBLE AS i, count(*) OVER (PARTITION BY uid)::DOUBLE AS n FROM r) SELECT uid, round(sum((pow(i / n, {n}) - pow((i - 1) / n, {n})) * value), 6) AS {name}_at_{n} FROM o GROUP BY uid"


@query("best_at_n_exact", _order_sql(4, True))
def best_at_n_exact(spark, d):
    return E.order_statistic_mean(rollouts(spark, d), ["uid"], 4, "value").withColumn("best_at_4", r6("best_at_4"))


@query("worst_at_n_exact", _order_sql(4, False))
def worst_at_n_exact(spark, d):
    return E.order_statistic_mean(rollouts(spark, d), ["uid"], 4, "value", best=False).withColumn("worst_at_4", r6("worst_at_4"))


@query("majority_vote", f"WITH {ROLLOUTS}, v AS (SELECT uid, event_type, count(*) AS n, min(k) AS f FROM r GROUP BY uid, event_type), t AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) AS rn FROM v) SELECT t.uid, t.event_type AS majority, r.value FROM t JOIN r ON r.uid = t.uid AND r.k = t.f WHERE rn = 1")
def majority_vote(spark, d):
    return E.majority(rollouts(spark, d), ["uid"], "event_type", "value")


@query("validation_mean_std", "WITH p AS (SELECT event_type AS data_source, user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type, user_id) SELECT data_source, 'mean_at_2' AS metric, round(avg(m), 6) AS value FROM p GROUP BY data_source UNION ALL SELECT data_source, 'std_at_2', round(avg(s), 6) FROM p GROUP BY data_source")
def validation_mean_std(spark, d):
    out = E.validation_metrics(rollouts(spark, d).withColumnRenamed("event_type", "data_source"), 2, value="value")
    return out.where("metric in ('mean_at_2', 'std_at_2')").withColumn("value", r6("value"))


@query("metric_namespaces", "SELECT DISTINCT CASE WHEN event_type IN ('view', 'click') THEN 'val-core/' ELSE 'val-aux/' END || event_type || '/acc/mean_at_4' AS name FROM events WHERE event_type IN ('view', 'click') UNION SELECT DISTINCT 'val-aux/' || event_type || '/len/mean_at_4' FROM events WHERE event_type NOT IN ('view', 'click')")
def metric_namespaces(spark, d):
    e = F.col("event_type")
    rows = table(spark, d, "events").select(e.alias("data_source"), F.when(e.isin("view", "click"), "acc").otherwise("len").alias("variable"), F.lit("mean_at_4").alias("metric")).distinct()
    return E.namespaced(rows, "acc", 4).select("name")


@query("bootstrap_best_worst")
def bootstrap_best_worst(spark, d):
    return E.bootstrap_best_worst(rollouts(spark, d), ["uid"], 4, "value")


_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


@query("bm25_topk", f"""WITH qt AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark), w AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), ix AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
l AS (SELECT doc_id, sum(tf) AS dl FROM ix GROUP BY doc_id), t AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), f AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
s AS (SELECT qt.item_id, ix.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) AS score FROM qt JOIN ix USING (term) JOIN f USING (term) JOIN l ON l.doc_id = ix.doc_id, t GROUP BY qt.item_id, ix.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 3""")
def bm25_topk(spark, d):
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), 3).select("item_id", "doc_id", r6("score").alias("score"), "rank")


@query("dense_topk", """WITH p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 3""")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    return R.dense(e, e.where("vec_id % 50 = 0"), 3).select("query_id", "vec_id", r6("score").alias("score"), "rank")


_POOL = """WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, [value, value * (event_id % 3), 1.0 + event_id % 5] AS v, event_type <> 'view' AS m FROM events),
p AS (SELECT user_id, [sum(v[1]) FILTER (m) / count_if(m), sum(v[2]) FILTER (m) / count_if(m), sum(v[3]) FILTER (m) / count_if(m)] AS mean, any_value(v) FILTER (i = 1) AS cls FROM t GROUP BY user_id)"""


@query("pooled_embeddings", f"{_POOL} SELECT user_id, CASE WHEN mean[3] IS NOT NULL THEN list_transform([1, 2, 3], lambda i: round(mean[i] / sqrt(mean[1] ** 2 + mean[2] ** 2 + mean[3] ** 2), 6))::VARCHAR END AS mean, list_transform(cls, lambda x: round(x, 6))::VARCHAR AS cls FROM p")
def pooled_embeddings(spark, d):
    """A user's events as token vectors; views are masked out of the mean."""
    e = table(spark, d, "events")
    v = F.array(F.col("value"), F.col("value") * (F.col("event_id") % 3), F.lit(1.0) + F.col("event_id") % 5)
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", v.alias("v"), (F.col("event_type") != "view").cast("int").alias("m")))).alias("t"))
    rows = rows.select("user_id", F.transform("t", lambda t: t["v"]).alias("h"), F.transform("t", lambda t: t["m"]).alias("m"))
    text = lambda v: F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: (F.round(x, 6) + 0.0).cast("string")), ", "), F.lit("]")))
    return rows.select("user_id", text(R.pooled("h", "m")).alias("mean"), text(R.pooled("h", method="cls", normalise=False)).alias("cls"))


@query("title_and_text", """SELECT doc_id, trim(string_split(text, chr(10))[1], '"') AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents""")
def title_and_text(spark, d):
    parts = table(spark, d, "documents").select("doc_id", R.title_and_text("text").alias("p"))
    return parts.select("doc_id", "p.title", F.col("p.text").alias("body"))
