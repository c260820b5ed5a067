"""Queries over token tables: masked statistics, scans, penalties, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as R
from ..operators import advantages as A
from ..operators import losses as L
from ..operators import stats as S
from .base import TOKENS, query, r6, tokens

_EPS = "1e-8::DOUBLE"


def _mm(x: str, m: str = "m") -> str:
    """SQL of a masked mean."""
    return f"sum(({x}) * {m}) / (sum({m}) + {_EPS})"


def _rounded(df, *keep):
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


@query("masked_sum_mean", f"WITH {TOKENS} SELECT uid, round(sum(reward * m), 6) AS total, round({_mm('reward')}, 6) AS mean FROM t GROUP BY uid")
def masked_sum_mean(spark, d):
    out = tokens(spark, d).groupBy("uid").agg(S.masked_sum("reward", "mask").alias("total"), S.masked_mean("reward", "mask").alias("mean"))
    return _rounded(out, "uid")


@query("masked_var", f"WITH {TOKENS}, a AS (SELECT sum(m) AS n, {_mm('adv')} AS mu FROM t) SELECT round(any_value(n), 6) AS n, round(any_value(mu), 6) AS mean, round(sum((adv - mu) * (adv - mu) * m) / (any_value(n) + {_EPS}) * any_value(n) / (any_value(n) - 1), 6) AS variance FROM t, a")
def masked_var(spark, d):
    return _rounded(S.moments(tokens(spark, d), "adv", "mask"))


@query("masked_whiten", f"WITH {TOKENS}, a AS (SELECT sum(m) AS n, {_mm('adv')} AS mu FROM t), v AS (SELECT any_value(mu) AS mu, sum((adv - mu) * (adv - mu) * m) / (any_value(n) + {_EPS}) * any_value(n) / (any_value(n) - 1) AS var FROM t, a) SELECT uid, pos, round((adv - mu) / sqrt(var + {_EPS}), 6) AS whitened FROM t, v")
def masked_whiten(spark, d):
    return _rounded(S.whiten(tokens(spark, d), "adv", "mask").select("uid", "pos", "whitened"), "uid", "pos")


@query("agg_loss_modes", f"""WITH {TOKENS}, s AS (SELECT uid, sum(adv * m) AS s, sum(m) AS n FROM t GROUP BY uid)
SELECT 'token-mean' AS mode, round({_mm('adv')}, 6) AS loss FROM t UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM s
UNION ALL SELECT 'seq-mean-token-mean', round(avg(CASE WHEN n > 0 THEN s / n END), 6) FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / 7.0, 6) FROM s""")
def agg_loss_modes(spark, d):
    t, out = tokens(spark, d), None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = S.agg_loss(t, "adv", "mask", mode, width=7, seq=("uid",)).select(F.lit(mode).alias("mode"), r6("loss").alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query("kl_penalties", f"WITH {TOKENS} SELECT uid, pos, round(logp - ref, 6) AS k1, round(abs(logp - ref), 6) AS k_abs, round(0.5 * (logp - ref) * (logp - ref), 6) AS k2, round(greatest(-10.0, least(10.0, exp(greatest(-20.0, least(20.0, ref - logp))) - greatest(-20.0, least(20.0, ref - logp)) - 1)), 6) AS k3 FROM t")
def kl_penalties(spark, d):
    return tokens(spark, d).select("uid", "pos", *[r6(S.kl_penalty("logp", "ref", kind)).alias(name) for kind, name in (("k1", "k1"), ("abs", "k_abs"), ("k2", "k2"), ("k3", "k3"))])


@query("kl_in_reward", f"WITH {TOKENS} SELECT uid, pos, round((logp - ref) * m, 6) + 0.0 AS kl, round(reward - 0.1 * (logp - ref) * m, 6) AS token_reward FROM t")
def kl_in_reward(spark, d):
    return _rounded(S.apply_kl(tokens(spark, d), 0.1).select("uid", "pos", "kl", "token_reward"), "uid", "pos")


@query("current_kl", f"WITH {TOKENS}, s AS (SELECT uid, {_mm('logp - ref')} AS x FROM t GROUP BY uid) SELECT round(avg(x), 6) AS current_kl FROM s")
def current_kl(spark, d):
    return _rounded(S.current_kl(tokens(spark, d), seq=("uid",)))


@query("ess_batch", f"WITH {TOKENS} SELECT round(sum(exp(logp - old) * m) * sum(exp(logp - old) * m) / (sum(exp(logp - old) * exp(logp - old) * m) + {_EPS}) / sum(m), 6) AS ess FROM t")
def ess_batch(spark, d):
    return _rounded(S.ess_batch(tokens(spark, d).withColumn("ratio", F.exp(F.col("logp") - F.col("old"))), "ratio", "mask"))


@query("ess_sequence", f"WITH {TOKENS}, q AS (SELECT *, least(exp(logp - old), 100.0) AS r FROM t) SELECT uid, round(CASE WHEN sum(m) > 0 THEN sum(r * m) * sum(r * m) / (sum(r * r * m) + {_EPS}) / sum(m) ELSE 1.0 END, 6) AS ess FROM q GROUP BY uid")
def ess_sequence(spark, d):
    return _rounded(S.ess_sequence(tokens(spark, d).withColumn("ratio", F.exp(F.col("logp") - F.col("old"))), "ratio", "mask", seq=("uid",)), "uid")


@query("ratio_histogram", f"WITH {TOKENS}, q AS (SELECT exp(logp - old) AS r FROM t WHERE m = 1) SELECT round(min(r), 6) AS ratio_min, round(max(r), 6) AS ratio_max, round(avg(r), 6) AS ratio_mean, count(*) FILTER (r < 0.5)::BIGINT AS bin_0, count(*) FILTER (r >= 0.5 AND r < 1.0)::BIGINT AS bin_1, count(*) FILTER (r >= 1.0 AND r < 1.5)::BIGINT AS bin_2, count(*) FILTER (r >= 1.5 AND r < 2.0)::BIGINT AS bin_3, count(*) FILTER (r >= 2.0)::BIGINT AS bin_4 FROM q")
def ratio_histogram(spark, d):
    out = S.ratio_histogram(tokens(spark, d).withColumn("ratio", F.exp(F.col("logp") - F.col("old"))), "ratio", "mask")
    return out.select(*[r6(c).alias(c) if c.startswith("ratio") else F.col(c) for c in out.columns])


@query("prob_gap", f"WITH {TOKENS} SELECT round(max(abs(exp(logp) - exp(old))), 6) AS gap_max, round(avg(abs(exp(logp) - exp(old))), 6) AS gap_mean, round(stddev_samp(abs(exp(logp) - exp(old))), 6) AS gap_std FROM t WHERE m = 1")
def prob_gap(spark, d):
    g = F.abs(F.exp("logp") - F.exp("old"))
    return tokens(spark, d).where("mask").agg(r6(F.max(g)).alias("gap_max"), r6(F.avg(g)).alias("gap_mean"), r6(F.stddev_samp(g)).alias("gap_std"))


@query("outlier_mean_exp", f"WITH {TOKENS} SELECT round(avg(exp(x)) FILTER (x > -20 AND x < 20), 6) AS mean_exp, count(*) FILTER (x > -20 AND x < 20)::BIGINT AS n_used FROM (SELECT logp * 60 AS x FROM t)")
def outlier_mean_exp(spark, d):
    from ..operators.curation import outlier_mean_exp as op

    return op(tokens(spark, d).withColumn("x", F.col("logp") * 60), "x").withColumn("mean_exp", r6("mean_exp"))


@query("position_ids", f"WITH {TOKENS} SELECT uid, pos, greatest(sum(m) OVER (PARTITION BY uid ORDER BY pos) - 1, 0)::BIGINT AS position_id FROM t")
def position_ids(spark, d):
    return S.positions(tokens(spark, d)).select("uid", "pos", "position_id")


@query("eos_mask", f"WITH {TOKENS} SELECT uid, pos, (coalesce(sum(se) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS response_mask FROM t")
def eos_mask(spark, d):
    return S.until_first(tokens(spark, d), F.col("se")).select("uid", "pos", "response_mask")


@query("reverse_cumsum", f"WITH {TOKENS} SELECT uid, pos, round(sum(reward) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS returns FROM t")
def reverse_cumsum(spark, d):
    return _rounded(S.reverse_cumsum(tokens(spark, d), "reward").select("uid", "pos", "returns"), "uid", "pos")


def _arrays(spark, d):
    return S.to_arrays(tokens(spark, d).select("uid", "pos", "reward", "value", F.col("mask").cast("int").alias("mask")), ["uid"], ["reward", "value", "mask"])


@query("rfpp_returns", f"WITH {TOKENS} SELECT a.uid, a.pos, round(sum(pow(0.9::DOUBLE, b.pos - a.pos) * b.reward), 10) AS returns FROM t a JOIN t b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos")
def rfpp_returns(spark, d):
    out = A.rfpp(_arrays(spark, d), "reward", 0.9)
    return out.select("uid", F.posexplode("returns").alias("pos", "returns")).withColumn("returns", r6("returns", 10))


@query("remax_returns", f"WITH {TOKENS} SELECT uid, pos, round(sum(reward) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.25, 6) + 0.0 AS advantage FROM t")
def remax_returns(spark, d):
    out = A.remax(_arrays(spark, d).withColumn("baseline", F.lit(0.25)), "reward")
    return out.select("uid", F.posexplode("advantage").alias("pos", "advantage")).withColumn("advantage", r6("advantage"))


@query("gae_adv", f"""WITH {TOKENS}, q AS (SELECT *, reward + 0.9123457::DOUBLE * coalesce(lead(value) OVER (PARTITION BY uid ORDER BY pos), 0) - value AS delta FROM t)
SELECT a.uid, a.pos, round(sum(pow(0.9123457::DOUBLE * 0.9337711::DOUBLE, b.pos - a.pos) * b.delta), 6) AS advantage, round(sum(pow(0.9123457::DOUBLE * 0.9337711::DOUBLE, b.pos - a.pos) * b.delta) + any_value(a.value), 6) AS returns
FROM q a JOIN q b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos""")
def gae_adv(spark, d):
    out = A.gae_estimator(_arrays(spark, d), "reward", "value", 0.9123457, 0.9337711)
    return out.select("uid", F.posexplode(F.arrays_zip("advantage", "returns")).alias("pos", "z")).select("uid", "pos", r6("z.advantage").alias("advantage"), r6("z.returns").alias("returns"))


@query("prime_rloo", f"""WITH {TOKENS}, s AS (SELECT uid, any_value(uid) % 50 AS g, sum(reward * m) / (sum(m) + {_EPS}) AS x FROM t GROUP BY uid), w AS (SELECT *, sum(x) OVER v AS s, count(*) OVER v AS n FROM s WINDOW v AS (PARTITION BY g))
SELECT uid AS seq, round(CASE WHEN n > 1 THEN x - (s - x) / (n - 1) ELSE x END, 6) AS advantage FROM w""")
def prime_rloo(spark, d):
    a = _arrays(spark, d).withColumn("seq", F.col("uid")).withColumn("uid", F.col("uid") % 50)
    return A.prime_rloo(a, "reward", "mask").select("seq", r6("advantage").alias("advantage"))


_CLIPPED = "greatest(-adv * r, -adv * greatest(0.8::DOUBLE, least(1.2::DOUBLE, r)))"
_RATIO = "q AS (SELECT *, exp(greatest(-20.0, least(20.0, logp - old))) AS r FROM t)"


@query("ppo_clip_loss", f"""WITH {TOKENS}, {_RATIO}, l AS (SELECT *, -adv * r AS l1, -adv * greatest(0.8::DOUBLE, least(1.2::DOUBLE, r)) AS l2, {_CLIPPED} AS w, -adv * 3.0::DOUBLE AS l3 FROM q),
f AS (SELECT *, CASE WHEN adv < 0 THEN least(l3, w) ELSE w END AS loss FROM l)
SELECT round({_mm('loss')}, 6) AS loss, round({_mm('(l2 > l1)::INT')}, 6) AS clipfrac, round({_mm('old - logp')}, 6) AS ppo_kl, round({_mm('(w > l3 AND adv < 0)::INT')}, 6) AS clipfrac_lower,
round(sum(CASE WHEN adv > 0 THEN loss * m END) / greatest(sum(m), 1), 6) AS pos_contrib, round(sum(CASE WHEN adv < 0 THEN loss * m END) / greatest(sum(m), 1), 6) AS neg_contrib FROM f""")
def ppo_clip_loss(spark, d):
    return _rounded(L.ppo_loss(tokens(spark, d), 0.2))


@query("value_loss", f"WITH {TOKENS}, q AS (SELECT *, value + reward AS nv, reward * 2 AS ret, greatest(value - 0.02, least(value + 0.02, value + reward)) AS cut FROM t) SELECT round({_mm('0.5 * greatest((nv - ret) * (nv - ret), (cut - ret) * (cut - ret))')}, 6) AS loss, round({_mm('((cut - ret) * (cut - ret) > (nv - ret) * (nv - ret))::INT')}, 6) AS clipfrac FROM q")
def value_loss(spark, d):
    t = tokens(spark, d).withColumns({"new_value": F.col("value") + F.col("reward"), "returns": F.col("reward") * 2})
    return _rounded(L.value_loss(t, 0.02))


@query("sft_loss", f"WITH {TOKENS} SELECT round({_mm('-logp')}, 6) AS loss FROM t")
def sft_loss(spark, d):
    return _rounded(L.sft_loss(tokens(spark, d)))


_ON = f"q2 AS (SELECT *, CASE WHEN adv < 0 THEN least(-adv * 3.0::DOUBLE, {_CLIPPED}) ELSE {_CLIPPED} END AS onl, exp(logp) AS pr, exp(old) AS po FROM q)"
_OFF_SQL = {
    ("no_reshape", "none"): ("pr", "-w * adv"), ("rlpluss", "none"): ("2 * pr / (po + 0.5 * (po + 1))", "-w * adv * sqrt(1 - pr)"),
    ("luffy", "p_div_p_0.1"): ("pr / (pr + 0.1)", "-w * greatest(adv, 0)"), ("luffy", "dft"): ("pr / (CASE WHEN po > 0.9 THEN 1.0 ELSE greatest(po, 0.1) END)", "-w"),
    ("luffy", "masked_sft"): ("logp * (pr > 0.1)::INT", "-w"), ("luffy", "sft"): ("logp", "-w"), ("se", "p_div_p_0.1"): ("r / (r + 0.1)", "-w * greatest(adv, 0)"),
    ("se", "rlpluss"): ("pr * sqrt(1 - pr)", "-w * greatest(adv, 0)"), ("se", "vanilla"): ("r", "-w * greatest(adv, 0)"), ("se", "filter"): ("r * rm", "-w * greatest(adv, 0)"),
    ("se", "cispo"): ("r * rm * logp", "-w * greatest(adv, 0)"), ("se", "luffy"): ("pr / (pr + 0.1)", "-w * greatest(adv, 0)"), ("se", "se_rlpluss"): ("r * sqrt(1 - pr)", "-w * greatest(adv, 0)"),
    ("se", "dynamic_clip"): ("least(r, greatest(1 / (pr + 1e-8), 1.2))", "-w * greatest(adv, 0)"), ("se", "dft"): ("pr * logp", "-w"),
}


def _mixed_sql(w: str, off: str) -> str:
    return f"""WITH {TOKENS}, {_RATIO}, {_ON}, q3 AS (SELECT *, ({w})::DOUBLE AS w FROM q2), q4 AS (SELECT *, ({off})::DOUBLE AS offl, p * m AS om, (1 - p) * m AS nm FROM q3)
SELECT round({_mm('offl * p * rm + onl * (1 - p) * rm')}, 6) AS loss, round({_mm('onl', 'nm')}, 6) AS on_loss, round({_mm('offl', 'om')}, 6) AS off_loss, round({_mm('w', 'om')}, 6) AS off_ratio, round({_mm('pr', 'om')}, 6) AS off_prob FROM q4"""


def _mixed(strategy: str, reshape: str):
    def run(spark, d):
        out = L.on_off_policy_loss(tokens(spark, d), strategy, reshape)
        return _rounded(out.select("loss", "on_loss", "off_loss", "off_ratio", "off_prob"))

    return run


for (_strategy, _reshape), (_w, _off) in _OFF_SQL.items():
    query(f"loss_{_strategy}_{_reshape}".replace(".", "").replace("_none", ""), _mixed_sql(_w, _off))(_mixed(_strategy, _reshape))


@query("loss_se_sequence", f"""WITH {TOKENS}, {_RATIO}, e AS (SELECT uid, CASE WHEN sum(p * m) > 0 THEN sum(least(r, 100.0) * p * m) * sum(least(r, 100.0) * p * m) / (sum(least(r, 100.0) * least(r, 100.0) * p * m) + {_EPS}) / sum(p * m) ELSE 1.0 END AS ess FROM q GROUP BY uid), {_ON.replace('FROM q)', 'FROM q JOIN e USING (uid))')},
q4 AS (SELECT *, -r * ess * greatest(adv, 0) AS offl, r * ess AS w, p * m AS om, (1 - p) * m AS nm FROM q2) SELECT round({_mm('offl * p * rm + onl * (1 - p) * rm')}, 6) AS loss, round({_mm('offl', 'om')}, 6) AS off_loss, round({_mm('w', 'om')}, 6) AS off_ratio FROM q4""")
def loss_se_sequence(spark, d):
    return _rounded(L.on_off_policy_loss(tokens(spark, d), "se", "sequence").select("loss", "off_loss", "off_ratio"))


_SFT_SQL = {
    "vanilla": ("-logp", "0"), "high_mask": ("-logp * (pr > 0.9)::INT", "0"), "low_mask": ("-logp * (pr < 0.1)::INT", "0"), "sft_clip_adv": ("-logp * greatest(adv, 0)", "0"), "weighted_sft": ("-least(pr / 0.5, 1.0) * logp", "0"),
    "low_sft_other_rl": ("-(1 / (1 + exp(-(0.2 - pr) / 0.01))) * greatest(adv, 0) * pr", "-(1 - 1 / (1 + exp(-(0.2 - pr) / 0.01))) * adv * pr"),
}


def _sft_sql(sft: str, rl: str) -> str:
    return f"""WITH {TOKENS}, {_RATIO}, {_ON}, q4 AS (SELECT *, ({sft})::DOUBLE * p * rm AS s, ({rl})::DOUBLE * p * rm AS g, onl * (1 - p) * rm AS o, p * m * rm AS om, (1 - p) * m * rm AS nm FROM q2),
z AS (SELECT {_mm('s + g', 'om')} AS off_loss, {_mm('o', 'nm')} AS on_loss FROM q4) SELECT round(off_loss, 6) AS off_loss, round(on_loss, 6) AS on_loss, round(0.4 * off_loss + 0.6 * on_loss, 6) AS loss FROM z"""


def _sft(reshape: str):
    return lambda spark, d: _rounded(L.on_off_sft_loss(tokens(spark, d), "rl-sft", reshape).select("off_loss", "on_loss", "loss"))


for _reshape, (_s, _g) in _SFT_SQL.items():
    query(f"loss_rl_sft_{_reshape}", _sft_sql(_s, _g))(_sft(_reshape))

_LUFFY_ON = {"no_reshape": "exp(d)", "logp": "d", "p_logp": "exp(d) + d", "square_root": "sqrt(exp(d))", "pow": "pow(exp(d), 0.5)", "p_div_p_0.1": "(pr / (pr + 0.1)) / (po / (po + 0.1))", "p_div_p_0.5": "(pr / (pr + 0.5)) / (po / (po + 0.5))"}
_LUFFY_OFF = {"no_reshape": "pr", "logp": "logp", "p_logp": "logp + pr", "square_root": "sqrt(pr)", "p_div_p_0.1": "pr / (pr + 0.1)", "p_div_p_0.3": "pr / (pr + 0.3)", "p_div_p_0.5": "pr / (pr + 0.5)", "pow": "pow(pr, 0.5)"}


@query("loss_luffy_on_reshapes", " UNION ALL ".join(f"""SELECT '{name}' AS reshape, round(x.loss, 6) AS loss, round(x.on_loss, 6) AS on_loss FROM (WITH {TOKENS}, q AS (SELECT *, logp - old AS d, exp(logp) AS pr, exp(old) AS po, p * m AS om, (1 - p) * m AS nm FROM t), z AS (SELECT *, {w} AS r FROM q), y AS (SELECT *, {_CLIPPED} AS onl, -adv * pr AS offl FROM z) SELECT {_mm('offl * p + onl * (1 - p)')} AS loss, {_mm('onl', 'nm')} AS on_loss FROM y) x""" for name, w in _LUFFY_ON.items()))
def loss_luffy_on_reshapes(spark, d):
    out = None
    for name in _LUFFY_ON:
        one = L.luffy_loss(tokens(spark, d), on_reshape=name).select(F.lit(name).alias("reshape"), r6("loss").alias("loss"), r6("on_loss").alias("on_loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query("loss_luffy_off_reshapes", " UNION ALL ".join(f"SELECT '{name}' AS reshape, round(x.off_loss, 6) AS off_loss, round(x.off_ratio, 6) AS off_ratio FROM (WITH {TOKENS}, q AS (SELECT *, exp(logp) AS pr, p * m AS om FROM t), z AS (SELECT *, {w} AS w FROM q) SELECT {_mm('-adv * w', 'om')} AS off_loss, {_mm('w', 'om')} AS off_ratio FROM z) x" for name, w in _LUFFY_OFF.items()))
def loss_luffy_off_reshapes(spark, d):
    out = None
    for name in _LUFFY_OFF:
        one = L.luffy_loss(tokens(spark, d), off_reshape=name).select(F.lit(name).alias("reshape"), r6("off_loss").alias("off_loss"), r6("off_ratio").alias("off_ratio"))
        out = one if out is None else out.unionByName(one)
    return out


@query("kl_cov_loss", f"""WITH {TOKENS}, a AS (SELECT avg(adv) AS ma, avg(logp) AS ml, greatest(1, floor(count(*) * 0.2))::BIGINT AS n FROM t WHERE m = 1), c AS (SELECT t.*, (adv - ma) * (logp - ml) AS cov, n FROM t, a WHERE m = 1),
o AS (SELECT *, row_number() OVER (ORDER BY cov DESC, uid, k, pos) AS rn FROM c) SELECT round(sum(-adv * exp(logp - old) + CASE WHEN rn <= n THEN abs(logp - old) ELSE 0 END) / (count(*) + {_EPS}), 6) AS loss, round(sum(abs(logp - old)) / (count(*) + {_EPS}), 6) AS mean_abs_kl FROM o""")
def kl_cov_loss(spark, d):
    return _rounded(L.kl_cov_loss(tokens(spark, d)))


@query("clip_cov_loss", f"""WITH {TOKENS}, a AS (SELECT avg(adv) AS ma, avg(logp) AS ml, greatest(1, floor(count(*) * 0.01))::BIGINT AS n FROM t WHERE m = 1),
c AS (SELECT t.*, (adv - ma) * (logp - ml) AS cov, n, -adv * exp(logp - old) AS plain, -adv * greatest(0.8::DOUBLE, least(1.2::DOUBLE, exp(logp - old))) AS cut FROM t, a WHERE m = 1),
f AS (SELECT *, cov > 0.01 AND cov < 5.0 AND NOT cut > plain AS free FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN free THEN 0 ELSE 1 END, md5('clip-cov:' || uid || ':' || k || ':' || pos), uid, k, pos) AS rn FROM f)
SELECT round(sum(CASE WHEN free AND rn <= n THEN 0 ELSE greatest(plain, cut) END) / (count(*) + {_EPS}), 6) AS loss FROM o""")
def clip_cov_loss(spark, d):
    return _rounded(L.clip_cov_loss(tokens(spark, d), share=0.01, lb=0.01, ub=5.0))


@query("dpo_losses", f"""WITH {TOKENS}, s AS (SELECT uid, sum((logp - old) * m) AS x FROM t GROUP BY uid)
SELECT uid, round(ln(1 + exp(-0.1 * x)) * 0.9 + ln(1 + exp(0.1 * x)) * 0.1, 6) AS sigmoid, round((x - 5.0) * (x - 5.0), 6) AS ipo, round((x - 0.2) * (x - 0.2), 6) AS sppo FROM s""")
def dpo_losses(spark, d):
    s = tokens(spark, d).groupBy("uid").agg(S.masked_sum(F.col("logp") - F.col("old"), "mask").alias("margin")).withColumns({"log_ratio": F.col("margin"), "reward": F.lit(0.2)})
    return s.select("uid", r6(L.dpo_loss("sigmoid", 0.1, 0.1)).alias("sigmoid"), r6(L.dpo_loss("ipo", 0.1)).alias("ipo"), r6(L.sppo_loss(1.0)).alias("sppo"))


@query("ce_dpo_loss", f"""WITH {TOKENS}, s AS (SELECT uid, sum((logp - old) * m) AS q, (uid % 2)::DOUBLE AS acc FROM t GROUP BY uid), p AS (SELECT acc, 1 / (1 + exp(-0.05 * q)) AS p FROM s)
SELECT round(avg(-(acc * ln(p) + (1 - acc) * ln(1 - p))), 6) AS loss FROM p""")
def ce_dpo_loss(spark, d):
    s = tokens(spark, d).groupBy("uid").agg(S.masked_sum(F.col("logp") - F.col("old"), "mask").alias("q")).withColumn("acc", (F.col("uid") % 2).cast("double"))
    return _rounded(L.ce_dpo_loss(s))


@query("softmax_entropy", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, embedding[3]::DOUBLE AS y FROM embeddings), z AS (SELECT vec_id, any_value(y) AS y, ln(sum(exp(x))) AS lse, sum(exp(x) * x) / sum(exp(x)) AS ex FROM e GROUP BY vec_id)
SELECT vec_id, round(lse - ex, 6) AS entropy, round(y - lse, 6) AS logprob FROM z""")
def softmax_entropy(spark, d):
    from .base import table

    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return e.select("vec_id", r6(L.entropy("x")).alias("entropy"), r6(L.logprob_at("x", F.lit(2))).alias("logprob"))


@query("l2_normalize", "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE * (1 + vec_id % 3) AS x FROM embeddings ), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id) SELECT vec_id, pos::INT AS pos, round(x / n, 6) AS x FROM e JOIN n USING (vec_id)")
def l2_normalize(spark, d):
    from .base import table

    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double") * (1 + F.col("vec_id") % 3)))
    return e.select("vec_id", F.posexplode(R.l2_normalize("x")).alias("pos", "x")).withColumn("x", r6("x"))


@query("sppo_batch_loss", f"""WITH {TOKENS}, s AS (SELECT uid, k, sum(logp * m) - sum(old * m) AS lr, max(m) AS a, (uid % 3) / 2.0 AS reward FROM t GROUP BY uid, k)
SELECT round(sum((lr - 2 * reward) * (lr - 2 * reward) * a) / (sum(a) + {_EPS}), 6) AS loss, round(avg(lr), 6) AS mean_log_ratio, round(avg(2 * reward), 6) AS mean_scaled_reward FROM s""")
def sppo_batch_loss(spark, d):
    t = tokens(spark, d)
    rewards = t.select("uid", "k", ((F.col("uid") % 3) / 2.0).alias("reward")).distinct()
    return _rounded(L.sppo_batch_loss(t, rewards, eta=2.0))


@query("sequence_logp", f"WITH {TOKENS} SELECT uid, round(coalesce(sum(logp) FILTER (se = 1), 0), 6) AS total, round(sum(logp) FILTER (se = 1) / nullif(count(*) FILTER (se = 1), 0), 6) AS mean FROM t GROUP BY uid")
def sequence_logp(spark, d):
    t = tokens(spark, d).select("uid", "pos", "logp", F.when(F.col("se"), 7).otherwise(-100).alias("label"))
    rows = S.to_arrays(t, ["uid"], ["logp", "label"])
    return rows.select("uid", r6(L.sequence_logp("logp", "label")).alias("total"), r6(L.sequence_logp("logp", "label", average=True)).alias("mean"))


@query("logprob_gather", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, embedding[(vec_id % 4 + 1)::INT]::DOUBLE AS y FROM embeddings) SELECT vec_id, round(any_value(y) - ln(sum(exp(x))), 6) AS logprob FROM e GROUP BY vec_id")
def logprob_gather(spark, d):
    from .base import table

    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return e.select("vec_id", r6(L.logprob_at("x", F.col("vec_id") % 4)).alias("logprob"))


@query("token_data_metrics", f"""WITH {TOKENS}, s AS (SELECT uid, sum(reward) AS score, sum(reward - 0.01) AS rew, count(*) AS len, uid % 9 AS plen, max(p) AS off FROM t GROUP BY uid),
a AS (SELECT avg(adv) AS am, max(adv) AS ax, min(adv) AS an, avg(adv + value) AS rm, max(adv + value) AS rx, min(adv + value) AS rn, avg(value) AS vm, max(value) AS vx, min(value) AS vn, 1 - var_samp(adv) / (var_samp(adv + value) + 1e-5) AS ev FROM t WHERE m = 1)
SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(avg(rew), 6) AS rewards_mean, round(max(rew), 6) AS rewards_max, round(min(rew), 6) AS rewards_min,
  round(any_value(am), 6) AS advantages_mean, any_value(round(ax, 6)) AS advantages_max, any_value(round(an, 6)) AS advantages_min, round(any_value(rm), 6) AS returns_mean, round(any_value(rx), 6) AS returns_max, round(any_value(rn), 6) AS returns_min,
  round(any_value(vm), 6) AS values_mean, round(any_value(vx), 6) AS values_max, round(any_value(vn), 6) AS values_min, round(any_value(ev), 5) AS vf_explained_var,
  round(avg(len), 6) AS response_length_mean, max(len) AS response_length_max, min(len) AS response_length_min, round(avg((len = 7)::INT), 6) AS response_length_clip_ratio,
  round(avg(plen), 6) AS prompt_length_mean, max(plen) AS prompt_length_max, min(plen) AS prompt_length_min, round(avg((plen = 8)::INT), 6) AS prompt_length_clip_ratio,
  round(avg(score) FILTER (off = 0), 6) AS score_on_mean, round(avg(score) FILTER (off = 1), 6) AS score_off_mean, round(avg(len) FILTER (off = 0), 6) AS response_length_on_mean, round(avg(len) FILTER (off = 1), 6) AS response_length_off_mean,
  round(count(*) FILTER (off = 1) / nullif(count(*) FILTER (off = 0), 0), 6) AS off_on_example_ratio FROM s, a""")
def token_data_metrics(spark, d):
    t = tokens(spark, d).withColumns({"score": F.col("reward"), "reward": F.col("reward") - 0.01, "returns": F.col("adv") + F.col("value"), "prompt_length": F.col("uid") % 9})
    out = S.token_data_metrics(t, 7, 8)
    return out.select(*[F.round(c, 5 if c == "vf_explained_var" else 6).alias(c) if t_ == "double" else F.col(c) for c, t_ in out.dtypes])


@query("off_policy_ratio_stats", f"""WITH {TOKENS}, o AS (SELECT *, uid % 4 AS batch, exp(greatest(-20.0::DOUBLE, least(10.0::DOUBLE, logp - old))) AS r, max(p) OVER (PARTITION BY uid) AS off FROM t), f AS (SELECT * FROM o WHERE off = 1),
g AS (SELECT batch, sum(r * m) / (sum(m) + {_EPS}) AS mean, sum(m) AS n, sum(r * m) AS s, sum(r * r * m) AS q FROM f GROUP BY batch), v AS (SELECT f.batch, sum((r - mean) * (r - mean) * m) / (any_value(n) + {_EPS}) AS v FROM f JOIN g USING (batch) GROUP BY f.batch)
SELECT batch, round(mean, 6) AS ratio_mean, round(v * n / (n - 1), 6) AS ratio_var, round(s * s / (q + 1e-8) / n, 6) AS ratio_ess FROM g JOIN v USING (batch)""")
def off_policy_ratio_stats(spark, d):
    out = S.off_policy_ratio_stats(tokens(spark, d).withColumn("batch", F.col("uid") % 4), "batch")
    return out.select("batch", *[r6(c).alias(c) for c in ("ratio_mean", "ratio_var", "ratio_ess")])


@query("loss_sft_all_max", f"""WITH {TOKENS}, c AS (SELECT *, exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, logp - old))) AS r, (exp(logp) <= 0.8)::INT AS keep FROM t),
l AS (SELECT *, -adv * r * (1 - p) * rm AS on_, -logp * p * rm AS off_ FROM c) SELECT round(0.4 * sum(off_ * p * m * rm) / (sum(p * m * rm) + {_EPS}) + 0.6 * sum(on_ * (1 - p) * m * rm) / (sum((1 - p) * m * rm) + {_EPS}), 6) AS loss,
  round(sum(on_ * keep) / greatest(sum(m * rm * keep), 1), 6) AS on_contrib, round(sum(off_ * keep) / greatest(sum(m * rm * keep), 1), 6) AS off_contrib FROM l""")
def loss_sft_all_max(spark, d):
    out = L.on_off_sft_loss(tokens(spark, d), "rl-sft", "vanilla", remove_clip=True, all_max=0.8)
    return out.select(*[r6(c).alias(c) for c in ("loss", "on_contrib", "off_contrib")])
