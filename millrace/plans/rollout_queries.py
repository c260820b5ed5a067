"""Queries over rollouts: group statistics, group filters, counters, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantages as A
from ..operators import curation as C
from ..operators import groups as G
from ..operators import stats as S
from .base import ROLLOUTS, query, r6, rollouts

_ADV = "SELECT uid, k, round(%s, 6) AS advantage FROM g"


def _out(df):
    return df.select("uid", "k", r6("advantage").alias("advantage"))


@query("hard_set_filter", "SELECT user_id AS uid, count(*)::BIGINT AS n_resp, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS mean_score, max(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0 END) AS max_score FROM events GROUP BY user_id HAVING avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) <= 0.2")
def hard_set_filter(spark, d):
    per = rollouts(spark, d).groupBy("uid").agg(F.count("*").alias("n_resp"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    return C.hard_set(per, 0.2, F.col("mean_score")).withColumn("mean_score", r6("mean_score"))


@query("hard_set_advantage", f"WITH {ROLLOUTS}, g AS (SELECT *, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) SELECT uid, k, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END, 6) AS advantage FROM g WHERE m <= 0.5")
def hard_set_advantage(spark, d):
    return _out(A.grpo(G.accuracy_band(rollouts(spark, d), 0.0, 0.5)))


@query("grpo_adv", f"WITH {ROLLOUTS}, g AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) " + _ADV % "CASE WHEN n = 1 THEN value / (1 + 1e-6) ELSE (value - m) / (s + 1e-6) END")
def grpo_adv(spark, d):
    return _out(A.grpo(rollouts(spark, d), "value"))


@query("grpo_adv_nostd", f"WITH {ROLLOUTS}, g AS (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) SELECT uid, k, round(CASE WHEN n = 1 THEN value ELSE value - m END, 10) AS advantage FROM g")
def grpo_adv_nostd(spark, d):
    return A.grpo(rollouts(spark, d), "value", scale=False).select("uid", "k", r6("advantage", 10).alias("advantage"))


@query("grpo_split", f"WITH {ROLLOUTS}, g AS (SELECT *, avg(value) FILTER (on_policy) OVER w AS m, stddev_samp(value) FILTER (on_policy) OVER w AS s, count(*) FILTER (on_policy) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) " + _ADV % "CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN value / (1 + 1e-6) ELSE (value - m) / (CASE WHEN s = 0 THEN 1 ELSE s END + 1e-6) END")
def grpo_split(spark, d):
    return _out(A.grpo_split(rollouts(spark, d), score="value"))


@query("grpo_passk", f"WITH {ROLLOUTS}, q AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY value DESC, k) AS rn, stddev_samp(value) OVER (PARTITION BY uid) AS s FROM q WHERE n > 1), g AS (SELECT *, max(CASE WHEN rn = 2 THEN value END) OVER (PARTITION BY uid) AS second FROM o) " + _ADV % "CASE WHEN rn = 1 THEN (value - second) / (s + 1e-6) ELSE 0.0 END")
def grpo_passk(spark, d):
    from pyspark.sql import Window

    several = rollouts(spark, d).withColumn("_n", F.count("*").over(Window.partitionBy("uid"))).where("_n > 1").drop("_n")
    return _out(A.grpo_passk(several, "value"))


@query("rloo_adv", f"WITH {ROLLOUTS}, g AS (SELECT *, sum(value) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) " + _ADV % "CASE WHEN n > 1 THEN value - (s - value) / (n - 1) ELSE value END")
def rloo_adv(spark, d):
    return _out(A.rloo(rollouts(spark, d), "value"))


@query("opo_adv", f"WITH {ROLLOUTS}, g AS (SELECT *, sum(length * value) OVER w / sum(length) OVER w AS b, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) " + _ADV % "value - CASE WHEN n > 1 THEN b ELSE 0 END")
def opo_adv(spark, d):
    return _out(A.opo(rollouts(spark, d), score="value"))


@query("rfpp_baseline", f"""WITH {ROLLOUTS}, g AS (SELECT *, value - CASE WHEN count(*) OVER w > 1 THEN avg(value) OVER w ELSE 0 END AS raw FROM r WINDOW w AS (PARTITION BY uid)),
m AS (SELECT sum(length)::DOUBLE AS n, sum(length * raw) / (sum(length) + 1e-8) AS mu FROM g), v AS (SELECT any_value(n) AS n, any_value(mu) AS mu, sum(length * (raw - mu) * (raw - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM g, m)
SELECT uid, k, round((raw - mu) / sqrt(var + 1e-8), 6) AS advantage FROM g, v""")
def rfpp_baseline(spark, d):
    return _out(A.rfpp_baseline(rollouts(spark, d), score="value"))


@query("sppo_softmean", f"WITH {ROLLOUTS}, b AS (SELECT max(value / 100) AS top FROM r), c AS (SELECT any_value(top) + ln(avg(exp(value / 100 - top))) AS base FROM r, b) SELECT uid, k, round(value / 100 - base, 6) AS advantage FROM r, c")
def sppo_softmean(spark, d):
    return _out(A.sppo(rollouts(spark, d).withColumn("value", F.col("value") / 100), 1.0, "value"))


@query("dpo_pref", f"WITH {ROLLOUTS} SELECT uid, k, row_number() OVER (PARTITION BY uid, k // 2 ORDER BY value DESC, k) = 1 AS chosen FROM r")
def dpo_pref(spark, d):
    r = rollouts(spark, d)
    pairs = r.withColumns({"user": F.col("uid"), "uid": F.struct("uid", F.floor(F.col("k") / 2))})  # adjacent responses are a pair
    return A.preference_pairs(pairs, "value").select(F.col("user").alias("uid"), "k", "chosen")


@query("pf_ppo_weights", f"WITH {ROLLOUTS}, e AS (SELECT max(score) AS hi, min(score) AS lo FROM r) SELECT uid, k, round(value * value + 1e-8, 6) AS w_pow, round(CASE WHEN score = hi OR score = lo THEN 1.0 ELSE 0.0 END + 1e-8, 9) AS w_ends, round(CASE WHEN score = hi THEN 0.4 ELSE 0.1 END + 1e-8, 9) AS w_random FROM r, e")
def pf_ppo_weights(spark, d):
    out = A.weights_pf_ppo(rollouts(spark, d), "pow", 2.0, "value").withColumn("w_pow", r6("weight"))
    for how, name in (("max_min", "w_ends"), ("max_random", "w_random")):
        out = A.weights_pf_ppo(out, how).withColumn(name, r6("weight", 9))
    return out.select("uid", "k", "w_pow", "w_ends", "w_random")


@query("dapo_filter", f"WITH {ROLLOUTS}, g AS (SELECT *, stddev_pop(score) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) SELECT uid, k, score FROM g WHERE s > 0 OR n = 1")
def dapo_filter(spark, d):
    return G.dynamic_sampling(rollouts(spark, d)).select("uid", "k", "score")


@query("dapo_take_groups", f"WITH {ROLLOUTS}, g AS (SELECT *, stddev_pop(score) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)), kept AS (SELECT * FROM g WHERE s > 0 OR n = 1), u AS (SELECT DISTINCT uid FROM kept ORDER BY uid LIMIT 20) SELECT uid, k FROM kept WHERE uid IN (SELECT uid FROM u)")
def dapo_take_groups(spark, d):
    return G.take_groups(G.dynamic_sampling(rollouts(spark, d)), 20).select("uid", "k")


@query("accuracy_band", f"WITH {ROLLOUTS}, g AS (SELECT *, avg(score) OVER (PARTITION BY uid) AS a FROM r) SELECT uid, k FROM g WHERE a BETWEEN 0.1 AND 0.25")
def accuracy_band(spark, d):
    return G.accuracy_band(rollouts(spark, d), 0.1, 0.25).select("uid", "k")


@query("accuracy_histogram", f"WITH {ROLLOUTS}, g AS (SELECT uid, avg(score) AS a FROM r GROUP BY uid) SELECT round(a, 6) AS accuracy, count(*)::BIGINT AS n_groups FROM g GROUP BY round(a, 6)")
def accuracy_histogram(spark, d):
    out = G.accuracy_histogram(rollouts(spark, d))
    return out.groupBy(r6("accuracy").alias("accuracy")).agg(F.sum("n_groups").alias("n_groups"))


@query("prime_downsample", f"WITH {ROLLOUTS}, g AS (SELECT uid, avg(score) AS a, max(length) AS l FROM r GROUP BY uid), f AS (SELECT uid FROM g ORDER BY (a BETWEEN 0.15 AND 0.5 AND l < 37 + 1 - 1) DESC, uid LIMIT 30) SELECT uid, k FROM r WHERE uid IN (SELECT uid FROM f)")
def prime_downsample(spark, d):
    return G.filter_and_downsample(rollouts(spark, d), 0.15, 0.5, 38, 30).select("uid", "k")


@query("failed_groups", f"WITH {ROLLOUTS} SELECT uid, bool_and(score = 0) AS all_failed, round(avg(score), 6) AS accuracy FROM r GROUP BY uid")
def failed_groups(spark, d):
    return G.failed_groups(rollouts(spark, d)).withColumn("accuracy", r6("accuracy"))


@query("valid_groups", f"WITH {ROLLOUTS}, g AS (SELECT *, bool_and(score = 0) OVER w AS f, bool_and(score = 1) OVER w AS s FROM r WINDOW w AS (PARTITION BY uid)) SELECT uid, k FROM g WHERE NOT f AND NOT s")
def valid_groups(spark, d):
    return G.valid_groups(rollouts(spark, d)).select("uid", "k")


@query("solve_counters", f"""WITH {ROLLOUTS}, g AS (SELECT uid, bool_and(score = 0) AS f, bool_and(score = 1) AS s, bool_and(score = -1) AS e, bool_or(score = 1) AS o FROM r GROUP BY uid)
SELECT count(*) FILTER (f)::BIGINT AS solve_none, count(*) FILTER (s)::BIGINT AS solve_all, count(*) FILTER (o)::BIGINT AS solve_one, count(*) FILTER (e)::BIGINT AS solve_none_format, count(*)::BIGINT AS n_groups FROM g""")
def solve_counters(spark, d):
    return G.solve_counters(rollouts(spark, d))


@query("replace_failed", f"""WITH {ROLLOUTS}, a AS (SELECT * FROM r WHERE on_policy), o AS (SELECT uid, event_id AS off_id, row_number() OVER (PARTITION BY uid ORDER BY k) AS n FROM r WHERE NOT on_policy),
g AS (SELECT *, avg(score) OVER w AS acc, max(CASE WHEN score <= 0 THEN k END) OVER w AS last FROM a WINDOW w AS (PARTITION BY uid)),
j AS (SELECT g.*, o.off_id, coalesce(acc <= 0.3 AND k = last AND off_id IS NOT NULL, false) AS replaced FROM g LEFT JOIN o ON o.uid = g.uid AND o.n = 1)
SELECT uid, k, CASE WHEN replaced THEN off_id ELSE event_id END AS response, CASE WHEN replaced THEN 0.5::DOUBLE ELSE score END AS score, replaced FROM j""")
def replace_failed(spark, d):
    r = rollouts(spark, d).withColumn("response", F.col("event_id"))
    on = r.where("on_policy").select("uid", "k", "score", "response")
    off = r.where("not on_policy").select("uid", "k", F.lit(0.5).alias("score"), "response")
    return G.replace_failed(on, off, 0.3).select("uid", "k", "response", "score", "replaced")


@query("merge_on_off", f"WITH {ROLLOUTS} SELECT uid, event_id, (row_number() OVER (PARTITION BY uid ORDER BY NOT on_policy, k) - 1)::INT AS slot, NOT on_policy AS off_policy FROM r")
def merge_on_off(spark, d):
    r = rollouts(spark, d)
    return G.merge_on_off(r.where("on_policy"), r.where("not on_policy")).select("uid", "event_id", "slot", "off_policy")


@query("pairwise_accuracy", f"""WITH {ROLLOUTS}, p AS (SELECT a.uid, ((a.value > b.value) = (a.score > b.score))::INT AS ok, abs(a.score - b.score) AS w FROM r a JOIN r b ON a.uid = b.uid AND a.k < b.k)
SELECT uid, count(*)::BIGINT AS n_pairs, round(CASE WHEN sum(w) = 0 THEN 0.5 ELSE sum(ok * w) / sum(w) END, 6) AS accuracy FROM p GROUP BY uid""")
def pairwise_accuracy(spark, d):
    return G.pairwise_accuracy(rollouts(spark, d), "score", "value").withColumn("accuracy", r6("accuracy"))


@query("replace_weak_off_policy", f"""WITH {ROLLOUTS}, s AS (SELECT uid, max(event_id) AS std FROM r WHERE on_policy GROUP BY uid), j AS (SELECT r.*, s.std, coalesce(NOT on_policy AND (score = 0 OR length < 10) AND std IS NOT NULL, false) AS replaced FROM r LEFT JOIN s USING (uid))
SELECT uid, k, replaced, CASE WHEN replaced THEN std ELSE event_id END AS response FROM j""")
def replace_weak_off_policy(spark, d):
    r = rollouts(spark, d).withColumn("response", F.col("event_id"))
    standard = r.where("on_policy").groupBy("uid").agg(F.max("response").alias("response"))
    return G.replace_weak_off_policy(r, standard, shortest=10).select("uid", "k", "replaced", "response")


_SEQUENCES = "q AS (SELECT user_id AS uid, event_id, value / 50 - 1 AS q, CASE WHEN event_type IN ('purchase', 'click') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc FROM events)"


def _sequences(spark, d):
    return rollouts(spark, d).select("uid", "event_id", (F.col("value") / 50 - 1).alias("q"), F.col("event_type").isin("purchase", "click").cast("double").alias("acc"))


def _detach_sql(body: str) -> str:
    return f"""WITH {_SEQUENCES}, g AS (SELECT *, count(*) OVER w AS n, coalesce(avg(q) FILTER (acc > 0) OVER w, 0) AS up, coalesce(avg(q) FILTER (acc <= 0) OVER w, 0) AS down, cume_dist() OVER (PARTITION BY uid ORDER BY acc) AS ca, cume_dist() OVER (PARTITION BY uid ORDER BY q) AS cq FROM q WINDOW w AS (PARTITION BY uid)),
l AS (SELECT *, ln(1 + exp(-((q - CASE WHEN acc > 0 THEN down ELSE up END) * 0.05 * CASE WHEN acc > 0 THEN 1 ELSE -1 END))) AS l FROM g) SELECT round({body}, 6) AS loss FROM l"""


@query("detach_dpo_loss", _detach_sql("avg(l)"))
def detach_dpo_loss(spark, d):
    from ..operators.losses import detach_dpo_loss as loss

    return loss(_sequences(spark, d)).select(r6("loss").alias("loss"))


@query("detach_dpo_bon_acc", _detach_sql("sum(l * n * pow(ca, n - 1))"))
def detach_dpo_bon_acc(spark, d):
    from ..operators.losses import detach_dpo_loss as loss

    return loss(_sequences(spark, d), mode="bon_acc").select(r6("loss").alias("loss"))


@query("detach_dpo_bon_rm", _detach_sql("sum(l * n * pow(cq, n - 1))"))
def detach_dpo_bon_rm(spark, d):
    from ..operators.losses import detach_dpo_loss as loss

    return loss(_sequences(spark, d), mode="bon_rm").select(r6("loss").alias("loss"))


@query("sign_accuracy", f"WITH {_SEQUENCES} SELECT round(avg((sign(q) = sign(acc * 2 - 1))::INT), 6) AS accuracy FROM q")
def sign_accuracy(spark, d):
    from ..operators.losses import sign_accuracy as accuracy

    return accuracy(_sequences(spark, d)).select(r6("accuracy").alias("accuracy"))


@query("preference_metrics", f"WITH {ROLLOUTS} SELECT round(avg(score), 6) AS score_mean, max(score) AS score_max, round(avg(value), 6) AS reward_mean, min(value) AS reward_min, round(avg(-value), 6) AS chosen_logp, round(avg((length = 37)::INT), 6) AS response_length_clip FROM r")
def preference_metrics(spark, d):
    r = rollouts(spark, d).select("score", F.col("value").alias("reward"), (-F.col("value")).alias("chosen_logp"), (-F.col("value")).alias("rejected_logp"), F.lit(0.0).alias("logit"), F.col("length").alias("response_length"), F.lit(5).alias("prompt_length"))
    out = S.preference_metrics(r, 37, 5)
    return out.select(r6("score_mean").alias("score_mean"), "score_max", r6("reward_mean").alias("reward_mean"), "reward_min", r6("chosen_logp").alias("chosen_logp"), r6("response_length_clip").alias("response_length_clip"))


@query("first_last_true", f"WITH {ROLLOUTS} SELECT uid, min(CASE WHEN score > 0 THEN k END)::INT AS first_true, max(CASE WHEN score > 0 THEN k END)::INT AS last_true FROM r GROUP BY uid")
def first_last_true(spark, d):
    hit = F.when(F.col("score") > 0, F.col("k"))
    return rollouts(spark, d).groupBy("uid").agg(F.min(hit).alias("first_true"), F.max(hit).alias("last_true"))


@query("top_two", f"WITH {ROLLOUTS}, g AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY value DESC, k) AS place FROM r) SELECT uid, k, place::INT AS place FROM g WHERE place <= 2")
def top_two(spark, d):
    from pyspark.sql import Window

    return rollouts(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("value"), "k"))).where("place <= 2").select("uid", "k", "place")


@query("tool_rewards", f"WITH {ROLLOUTS}, g AS (SELECT *, coalesce(max(value) OVER (PARTITION BY uid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b FROM r) SELECT uid, k, CASE WHEN value > b THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS tool_reward FROM g")
def tool_rewards(spark, d):
    return C.tool_rewards(rollouts(spark, d), score="value").select("uid", "k", "tool_reward")


@query("source_mean", "WITH p AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY event_type, user_id) SELECT event_type AS data_source, round(avg(m), 6) AS mean_score, count(*)::BIGINT AS n_prompts FROM p GROUP BY event_type")
def source_mean(spark, d):
    from ..operators.scoring import source_means

    return source_means(rollouts(spark, d), "event_type", "uid", "value").select(F.col("event_type").alias("data_source"), r6("mean_score").alias("mean_score"), "n_prompts")


@query("batch_means", "WITH p AS (SELECT user_id, avg(value) AS mean_score, max(value) AS max_score FROM events GROUP BY user_id), b AS (SELECT user_id // 16 AS batch, avg(mean_score) AS m, avg(max_score) AS x FROM p GROUP BY user_id // 16) SELECT round(avg(m), 6) AS mean_score, round(avg(x), 6) AS max_score, count(*)::BIGINT AS n_batches FROM b")
def batch_means(spark, d):
    from ..operators.scoring import batch_means as means

    per = rollouts(spark, d).groupBy("uid").agg(F.avg("value").alias("mean_score"), F.max("value").alias("max_score"))
    out = means(per.withColumn("batch", F.floor(F.col("uid") / 16)))
    return out.select(r6("mean_score").alias("mean_score"), r6("max_score").alias("max_score"), "n_batches")


@query("metric_reduce", "WITH m AS (SELECT CASE WHEN event_type = 'view' THEN 'len/max' WHEN event_type = 'click' THEN 'len/min' ELSE event_type END AS name, value FROM events) SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY name")
def metric_reduce(spark, d):
    e = F.col("event_type")
    m = rollouts(spark, d).select(F.when(e == "view", "len/max").when(e == "click", "len/min").otherwise(e).alias("name"), "value")
    return S.reduce_metrics(m).select("name", r6("value").alias("value"))


@query("data_metrics", f"WITH {ROLLOUTS} SELECT round(avg(score), 6) AS score_avg, max(score) AS score_max, min(score) AS score_min, round(avg(value), 6) AS value_avg, max(value) AS value_max, min(value) AS value_min, round(avg(length), 6) AS length_avg, max(length) AS length_max, min(length) AS length_min, round(avg((length = 37)::INT), 6) AS clip_ratio FROM r")
def data_metrics(spark, d):
    out = S.data_metrics(rollouts(spark, d), ["score", "value", "length"], 37)
    return out.select(*[r6(c).alias(c) if c.endswith("avg") or c == "clip_ratio" else F.col(c) for c in out.columns])


@query("explained_variance", f"WITH {ROLLOUTS} SELECT round(1 - var_samp(value - score) / (var_samp(value) + 1e-5), 6) AS explained_variance FROM r")
def explained_variance(spark, d):
    return S.explained_variance(rollouts(spark, d), "value", "score").select(r6("explained_variance").alias("explained_variance"))


@query("timing_per_token", "SELECT event_type AS stage, round(sum(value) * 1000 / CASE WHEN event_type = 'view' THEN count(*) ELSE count(*) + sum(event_id % 7) END, 6) AS ms_per_token FROM events GROUP BY event_type")
def timing_per_token(spark, d):
    e = rollouts(spark, d).groupBy("event_type").agg(F.sum("value").alias("seconds"), F.count("*").alias("response_tokens"), F.sum(F.col("event_id") % 7).alias("prompt_tokens"))
    stage = F.when(F.col("event_type") == "view", "gen").otherwise(F.col("event_type"))
    return S.timing_per_token(e.withColumn("stage", stage)).select(F.col("event_type").alias("stage"), r6("ms_per_token").alias("ms_per_token"))


@query("throughput", f"WITH {ROLLOUTS} SELECT round(sum(length) / (sum(value) * 4), 6) AS tokens_per_second FROM r")
def throughput(spark, d):
    one = rollouts(spark, d).agg(F.sum("length").alias("t"), F.sum("value").alias("s"))
    return one.select(r6(S.throughput("t", "s", 4)).alias("tokens_per_second"))


@query("on_off_metrics", f"WITH {ROLLOUTS} SELECT round(avg(value) FILTER (on_policy), 6) AS on_value, round(avg(value) FILTER (NOT on_policy), 6) AS off_value, round(avg(length) FILTER (on_policy), 6) AS on_length, round(avg(length) FILTER (NOT on_policy), 6) AS off_length, round(count(*) FILTER (NOT on_policy) / count(*) FILTER (on_policy), 6) AS off_on_ratio FROM r")
def on_off_metrics(spark, d):
    on, off = F.col("on_policy"), ~F.col("on_policy")
    mean = lambda c, side, name: r6(F.avg(F.when(side, F.col(c)))).alias(name)
    return rollouts(spark, d).agg(mean("value", on, "on_value"), mean("value", off, "off_value"), mean("length", on, "on_length"), mean("length", off, "off_length"), r6(F.try_divide(F.count_if(off), F.count_if(on))).alias("off_on_ratio"))


@query("solved_rates", f"WITH {ROLLOUTS} SELECT round(avg(score), 6) AS solved, round(avg((score = 0)::INT), 6) AS failed, round(avg(score) FILTER (on_policy), 6) AS on_solved, round(avg(score) FILTER (NOT on_policy), 6) AS off_solved FROM r")
def solved_rates(spark, d):
    s, on = F.col("score"), F.col("on_policy")
    return rollouts(spark, d).agg(r6(F.avg(s)).alias("solved"), r6(F.avg((s == 0).cast("int"))).alias("failed"), r6(F.avg(F.when(on, s))).alias("on_solved"), r6(F.avg(F.when(~on, s))).alias("off_solved"))
