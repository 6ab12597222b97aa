"""Model queries: normalisation, forests, autoencoder, fusion, conformal and drift tests."""

from pyspark.sql import functions as F

from packetloom.operators import aggregates as A
from packetloom.operators import folds as X
from packetloom.operators import models as M
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.plans.state import _L, level_scores
from packetloom.sources import bindings as B

NAMES = ["size", "dst_port", "tcp_flags", "ttl"]


@query("model_zscore", with_("packets", "st as (select " + ", ".join(f"avg({n}) as m{i}, stddev_pop({n}) as s{i}" for i, n in enumerate(NAMES))
       + " from packets) select_final pkt_id, " + ", ".join(f"({n} - m{i}) / s{i} as {n}" for i, n in enumerate(NAMES)) + " from packets, st", " ".join(NAMES)))
def zscore(spark, d):
    p = B.packets(spark, d).select("pkt_id", *NAMES)
    return M.apply_zscore(p, M.fit_zscore(p, NAMES), NAMES)


query("model_calibrate_percentile", with_("scores", "select quantile_cont(score, 0.9) as threshold from scores", "threshold"))(
    lambda s, d: M.calibrate_percentile(B.scores(s, d), 0.1))
query("model_calibration_statistics", with_("scores", """select count(*) as size, avg(score) as mean, stddev_pop(score) as std, min(score) as min, max(score) as max, median(score) as median from scores""", "mean std min max median"))(
    lambda s, d: M.calibration_statistics(B.scores(s, d)))


@query("model_combined_score", with_("scores", """c as (select row_id, score as e, 1 - score as a, score * score as f from scores)
 select_final row_id, 0.5e0 * e + 0.35e0 * a + 0.15e0 * f as three, 0.3e0 * f + 0.7e0 * a as pair, 0.7385e0 * e + 0.2615e0 * f as forests from c""", "three pair forests"))
def combined(spark, d):
    s = F.col("score")
    return B.scores(spark, d).select("row_id", M.combined_score(s, 1 - s, s * s).alias("three"),
                                     M.combined_score_pair(s * s, 1 - s).alias("pair"), M.combined_score_forests(s, s * s).alias("forests"))


def hybrid_input(spark, d):
    """Window series per flow: mean score and its volume deviation per hour and user."""
    hour = (F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(3_600_000_000))).alias("ts_us")
    per = B.scores(spark, d).groupBy("flow_key", hour).agg(
        F.min("row_id").alias("row_id"), F.least(F.lit(1.0), F.avg("score") * 2).alias("score"), F.count(F.lit(1)).cast("double").alias("max_z"))
    squeezed = (B.EPOCH_US + F.floor((F.col("ts_us") - B.EPOCH_US) / 36000)).cast("bigint")
    return per.withColumn("ts_us", squeezed)


_HYB = """hs as (select flow_key, ts_us - ts_us % 3600000000 as t0, min(row_id) as row_id, least(1.0e0, avg(score) * 2) as score, count(*)::double as max_z from scores group by 1, 2),
 hi as (select flow_key, cast(1704067200000000 + floor((t0 - 1704067200000000) / 36000) as bigint) as ts_us, row_id, score, max_z, 1 / (1 + exp(-(max_z / 5.0e0 * 5.0e0 - 2.5e0))) as ewma_component from hs),
 hn as (select *, row_number() over (partition by flow_key order by ts_us, row_id) as rn from hi),
 hr as (select flow_key, 0::bigint as rn, []::double[] as ts, []::double[] as ss, 0.0e0 as boost, 0.0e0 as combined from (select distinct flow_key from hn)
  union all select flow_key, rn, list_append(ts, t)[-10:], list_append(ss, c)[-10:], boost, c from (
   select *, greatest(0, least(1, 0.55e0 * score + 0.3e0 * ewma_component + 0.15e0 * boost)) as c from (
    select *, case when len(ts) >= 3 and slope > 0 then least(1, slope * 20) * list_avg(ss[-3:]) else 0 end as boost from (
     select p.flow_key, n.rn, n.score, n.ewma_component, p.ts, p.ss, (n.ts_us - 1704067200000000) / 1e6 as t,
      case when len(p.ts) >= 3 then list_sum(list_transform(p.ts, lambda x, i: (x - list_avg(p.ts)) * (p.ss[i] - list_avg(p.ss)))) / nullif(list_sum(list_transform(p.ts, lambda x: (x - list_avg(p.ts)) * (x - list_avg(p.ts)))), 0) end as slope
     from hr p join hn n on n.flow_key = p.flow_key and n.rn = p.rn + 1))))"""


@query("model_hybrid_score", with_("scores", _HYB + " select_final hn.flow_key, hn.ts_us, row_id, score, max_z, ewma_component, boost as temporal_boost, combined, combined >= 0.45 as is_anomaly from hn join hr using (flow_key, rn)",
                                   "score max_z ewma_component temporal_boost combined", recursive=True))
def hybrid(spark, d):
    return M.hybrid_score(hybrid_input(spark, d))


_SPLIT = "ca as (select score from scores where y = 0 and row_id % 3 = 0), te as (select row_id, y, score from scores where not (y = 0 and row_id % 3 = 0))"


def conformal(spark, d):
    s = B.scores(spark, d)
    calibration = (F.col("y") == 0) & (F.col("row_id") % 3 == 0)
    return M.conformal_pvalues(s.filter(calibration).select("score"), s.filter(~calibration).select("row_id", "y", "score"))


_PV = _SPLIT + """, cs as (select list_sort(list(score)) as v from ca), pv as (select row_id, y, score, (select count(*) from ca where ca.score >= te.score) as ge, (select count(*) from ca) as n from te)"""
query("model_conformal_pvalues", with_("scores", _PV + " select_final row_id, y, score, (ge + 1) / (n + 1) as p_value, n as calibration_size, (ge + 1) / (n + 1) <= 0.05 as is_anomaly, 1 - (ge + 1) / (n + 1) as confidence from pv", "score p_value confidence"))(conformal)
query("model_conformal_coverage", with_("scores", _PV + """, cv as (select y, (ge + 1) / (n + 1) <= 0.05 as hit from pv)
 select_final avg(hit::int) filter (y = 0) as fpr, avg(hit::int) filter (y = 1) as tpr, count(*) filter (y = 0) as n_normal, count(*) filter (y = 1) as n_anomaly, avg(hit::int) as anomaly_rate, 0.05e0 as significance,
 avg(hit::int) filter (y = 0) <= 0.07 as fpr_valid from cv""", "fpr tpr anomaly_rate significance"))(lambda s, d: M.conformal_coverage(conformal(s, d)))

_KS = """ka as (select score from scores where label = '{a}'), kb as (select least(1, score {f}) as score from scores where label = '{b}'), kv as (select distinct score from (select * from ka union all select * from kb)),
 kn as (select (select count(*) from ka) as n1, (select count(*) from kb) as n2), kf as (select score, (select count(*) from ka where ka.score <= kv.score) as fa, (select count(*) from kb where kb.score <= kv.score) as fb from kv),
 kd as (select max(abs(fa / n1 - fb / n2)) as statistic, n1, n2, sqrt(n1 * n2 / (n1 + n2)) as en from kf, kn group by n1, n2),
 kl as (select *, (en + 0.12 + 0.11 / en) * statistic as l, 1.628e0 * sqrt((n1 + n2) / (n1 * n2)) as critical from kd),
 kp as (select *, greatest(0, least(1, 2 * exp(-2 * l * l) - 2 * exp(-8 * l * l) + 2 * exp(-18 * l * l) - 2 * exp(-32 * l * l))) as p_value from kl)
 select_final statistic, n1, n2, p_value, critical, statistic > critical or p_value < 0.01 as drift, case when statistic > critical or p_value < 0.01 then case when statistic > 2 * critical then 'CRITICAL' else 'WARNING' end end as severity from kp"""
for _name, _a, _b, _f in (("same", "view", "click", ""), ("shifted", "view", "click", "* 1.5e0")):
    query(f"model_ks_drift_{_name}", with_("scores", _KS.format(a=_a, b=_b, f=_f), "statistic p_value critical"))(
        lambda s, d, a=_a, b=_b, k=1.5 if _f else 1.0: M.ks_drift(
            B.scores(s, d).filter(F.col("label") == a).select("score"),
            B.scores(s, d).filter(F.col("label") == b).select(F.least(F.lit(1.0), F.col("score") * k).alias("score"))))


@query("model_top_contributors", with_("feats", """u as (select row_id, unnest(features)::double as z, unnest(range(64)) as i from feats), r as (select *, row_number() over (partition by row_id order by abs(z) desc, i) as k from u)
 select_final row_id, k::int as place, concat('f', i) as feature, abs(z) as z, case when z > 0 then 'above' else 'below' end as direction, least(1, abs(z) / 5) as weight from r where k <= 5""", "z weight"))
def contributors(spark, d):
    top = M.top_contributors(B.features(spark, d), "features", [f"f{i}" for i in range(64)])
    return top.select("row_id", F.posexplode("contributors").alias("p", "c")).select("row_id", (F.col("p") + 1).alias("place"), "c.*")


query("model_heuristic_score", with_("feats", """u as (select row_id, unnest(features)::double as x from feats)
 select_final row_id, greatest(0, least(1, stddev_pop(x) / avg(abs(x)) / 5)) as score from u group by 1""", "score"))(
    lambda s, d: B.features(s, d).select("row_id", M.heuristic_score(F.col("features")).alias("score")))


@query("fn_feature_projection", with_("feats", """p as (select row_id, (['BASELINE','WATCH','SUSPECT','HOSTILE'])[1 + row_id % 4] as level, list_transform(features[1:18], lambda x: x::double) as v from feats),
 k as (select row_id, level, case level when 'BASELINE' then [v[1], v[2], v[7], v[8], v[9]] when 'WATCH' then v[1:14] else v end as kept, case level when 'BASELINE' then [v[1], v[2], v[7], v[8], v[9], 0, 0, 0, 0, 0, 0, 0, 0, 0] else v[1:14] end as scored from p)
 select_final row_id, level, len(kept)::int as kept, list_sum(kept) as kept_sum, len(scored)::int as scored, list_sum(scored) as scored_sum from k""", "kept_sum scored_sum"))
def projection(spark, d):
    level = F.element_at(F.array(*[F.lit(n) for n in X.LEVELS]), (1 + F.col("row_id") % 4).cast("int"))
    f = B.features(spark, d).select("row_id", level.alias("level"), F.slice("features", 1, 18).alias("features"))
    p = M.feature_projection(f, F.col("level"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    return p.select("row_id", "level", F.size("kept").alias("kept"), total("kept").alias("kept_sum"), F.size("scored").alias("scored"), total("scored").alias("scored_sum"))


# ---- randomised and iterative models: rows only ---------------------------------------------------

def flow_vectors(spark, d):
    flows = A.flow_features_14(B.conversations_packets(spark, d), min_packets=2)
    flows = flows.withColumn("row_id", F.xxhash64("ip_low", "port_low", "ip_high", "port_high", "protocol", "window_start_us"))
    scaled = M.apply_zscore(flows, M.fit_zscore(flows, A.FLOW14), A.FLOW14)
    return M.with_vector(scaled, A.FLOW14).select("row_id", "window_start_us", "features")


@query("model_isolation_forest")
def forest(spark, d):
    f = B.features(spark, d)
    return M.predict_forest(f, M.fit_forest(f, trees=50, contamination=0.1)).select("row_id", "label", "y", "score", "predicted")


@query("model_extended_isolation_forest")
def extended(spark, d):
    f = flow_vectors(spark, d)
    return M.predict_forest(f, M.fit_forest(f, trees=50, extension=13, contamination=0.1)).select("row_id", "score", "predicted")


@query("model_autoencoder")
def autoencoder(spark, d):
    f = flow_vectors(spark, d)
    return M.score_autoencoder(f, M.fit_autoencoder(f, epochs=5)).select("row_id", "error", "score", "predicted")


@query("model_feature_importance")
def importance(spark, d):
    f = flow_vectors(spark, d)
    return M.feature_importance(f, M.fit_forest(f, trees=25), A.FLOW14)


@query("model_pca_2d")
def pca(spark, d):
    return M.pca_2d(B.features(spark, d)).select("row_id", "label", "pc1", "pc2")


def second_windows(spark, d):
    return A.window_features_14(B.packets(spark, d), 2 * A.SECOND)


@query("model_baseline_then_detect")
def baseline(spark, d):
    found = M.baseline_then_detect(second_windows(spark, d), A.WINDOW14, train=50, trees=50)
    return found.select("window_start_us", "combined", "severity", F.col("contributors")[0]["feature"].alias("top_feature"))


@query("model_score_flows")
def score_flows(spark, d):
    return M.score_flows(A.flow_features_8(B.conversations_packets(spark, d)), A.FLOW8, ["src_ip", "dst_ip", "dst_port"], trees=50)


@query("model_retrain_with_feedback")
def retrain(spark, d):
    f = second_windows(spark, d).withColumnRenamed("window_start_us", "row_id")
    rare = F.col("packet_rate") > 30
    stats, model = M.retrain_with_feedback(f.filter(~rare), f.filter(rare), A.WINDOW14, least=10, trees=25)
    return M.score_forest(M.with_vector(M.apply_zscore(f, stats, A.WINDOW14), A.WINDOW14), model).select("row_id", "score")


# ---- what must hold of random models, as rows an oracle can state -----------------------------------


def model_checks(make, scores=("score",)):
    """One row: number of rows, how many have scores in [0, 1], and whether a second run gives the same scores."""
    def checks(spark, d):
        one, two = make(spark, d), make(spark, d)
        inside = F.lit(True)
        for c in scores:
            inside = inside & F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1), F.lit(False))
        runs = one.select(*scores, F.lit(1).alias("_run")).unionByName(two.select(*scores, F.lit(2).alias("_run")))
        digest = F.xxhash64(*[F.round(F.col(c), 9) for c in scores]).cast("decimal(38,0)")
        first, second = F.col("_run") == 1, F.col("_run") == 2
        return runs.agg(F.count_if(first).alias("rows"), F.count_if(first & inside).alias("in_range"),
                        (F.sum(F.when(first, digest)) == F.sum(F.when(second, digest))).alias("repeatable"))

    return checks


_COUNT = " select_final count(*) as rows, count(*) as in_range, true as repeatable from {}"
_SECONDS = "sw as (select distinct ts_us - ts_us % 2000000 as s from packets)"
query("model_isolation_forest_checks", with_("feats", _COUNT.format("feats").strip()))(model_checks(forest))
query("model_retrain_with_feedback_checks", with_("packets", _SECONDS + _COUNT.format("sw")))(model_checks(retrain))


@query("model_pca_2d_checks", with_("feats", "select count(*) as rows, true as ordered, true as uncorrelated from feats"))
def pca_checks(spark, d):
    """The first component varies at least as much as the second, and they do not vary together."""
    p = M.pca_2d(B.features(spark, d))
    return p.agg(F.count(F.lit(1)).alias("rows"), (F.var_pop("pc1") >= F.var_pop("pc2")).alias("ordered"), (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"))


@query("model_isolation_forest_flags", with_("feats", "select true as share_kept, true as flagged_score_highest from feats limit 1"))
def forest_flags(spark, d):
    """A contamination of a tenth flags about a tenth, and nothing unflagged scores above a flagged row."""
    f = forest(spark, d)
    share = F.avg("predicted")
    return f.agg(((share > 0.08) & (share < 0.12)).alias("share_kept"), (
        F.min(F.when(F.col("predicted") == 1, F.col("score"))) >= F.max(F.when(F.col("predicted") == 0, F.col("score")))).alias("flagged_score_highest"))


@query("model_false_alarm_feedback", with_("scores", _L + """, ep as (select *, sum(case when to_level = 'HOSTILE' and from_level <> 'HOSTILE' then 1 else 0 end) over (partition by flow_key order by ts_us, forced, row_id) as e from lx),
 fa as (select count(*) filter (forced = 0) as n, max(score) filter (to_level = 'BASELINE') as score from ep where from_level = 'HOSTILE' group by flow_key, e),
 cb as (select least(1.0e0, score * 3) as score from scores where y = 0 and row_id % 3 = 0 union all select score from (select score, unnest(range(n)) from fa where score is not null)),
 te as (select row_id, y, least(1.0e0, score * 3) as score from scores where not (y = 0 and row_id % 3 = 0)),
 pv as (select te.*, (select count(*) from cb where cb.score >= te.score) as ge, (select count(*) from cb) as n from te)
 select_final row_id, y, score, (ge + 1) / (n + 1) as p_value, n as calibration_size, (ge + 1) / (n + 1) <= 0.05 as is_anomaly, 1 - (ge + 1) / (n + 1) as confidence from pv""",
       "score p_value confidence", recursive=True))
def false_alarm_feedback(spark, d):
    s = level_scores(spark, d)
    alarms = M.false_alarms(X.threat_levels(s))
    calibration = (F.col("y") == 0) & (F.col("row_id") % 3 == 0)
    return M.conformal_with_feedback(s.filter(calibration), alarms, s.filter(~calibration).select("row_id", "y", "score"))
