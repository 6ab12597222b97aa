"""Evaluation queries over labelled scores and alerts."""

from pyspark.sql import functions as F

from packetloom.operators import detectors as D
from packetloom.operators import evaluate as E
from packetloom.plans.detection import RULES, SQL
from packetloom.plans.oracle_base import with_
from packetloom.plans.registry import query
from packetloom.sources import bindings as B


def _cm(where, keys=""):
    return f"""select {keys} count(*) filter (y = 1 and {where}) as tp, count(*) filter (y = 0 and {where}) as fp, count(*) filter (y = 1 and not ({where})) as fn, count(*) filter (y = 0 and not ({where})) as tn"""


_RATES = """tp / nullif(tp + fp, 0) as p0, tp / nullif(tp + fn, 0) as r0, tn / nullif(tn + fp, 0) as s0"""
_METRICS = """coalesce(p0, 0) as precision, coalesce(r0, 0) as recall, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) as f1, (tp + tn) / (tp + fp + fn + tn) as accuracy,
 coalesce(fp / nullif(fp + tn, 0), 0) as fpr, coalesce(fn / nullif(fn + tp, 0), 0) as fnr, coalesce(s0, 0) as specificity, (coalesce(r0, 0) + coalesce(s0, 0)) / 2 as balanced_accuracy,
 (tp::double * tn - fp::double * fn) / sqrt(greatest((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn), 1)) as mcc"""
_MD = "precision recall f1 accuracy fpr fnr specificity balanced_accuracy mcc"


@query("eval_confusion_metrics", with_("scores", f"c as ({_cm('score >= 0.2')} from scores), r as (select *, {_RATES} from c) select_final tp, fp, fn, tn, {_METRICS} from r", _MD))
def confusion(spark, d):
    return E.confusion_metrics(B.scores(spark, d), F.col("score") >= 0.2)


def _grid(steps, lo=None, hi=None, margin=0.0):
    lo_ = f"min({lo}::double)" if lo is not None else f"min(score) - {margin}"
    hi_ = f"min({hi}::double)" if hi is not None else f"max(score) + {margin}"
    return f"""sp as (select lo, hi, (hi - lo) / {steps - 1} as step from (select {lo_} as lo, {hi_} as hi from scores)),
 th as (select i, case when i = {steps - 1} then hi else lo + i * step end as threshold from sp, range(0, {steps}) t(i)),
 g0 as (select i, threshold, count(*) filter (y = 1) as tp, count(*) filter (y = 0) as fp from th left join scores on score >= threshold group by 1, 2),
 g as (select i, threshold, tp, fp, np - tp as fn, nn - fp as tn, tp / greatest(np, 1) as tpr, fp / greatest(nn, 1) as fpr, tp / greatest(tp + fp, 1) as precision
  from g0, (select count(*) filter (y = 1) as np, count(*) filter (y = 0) as nn from scores))"""


query("join_threshold_grid", with_("scores", _grid(200) + " select_final i::int as i, threshold, tp, fp, fn, tn, tpr, fpr, precision from g", "threshold tpr fpr precision"))(
    lambda s, d: E.threshold_grid(B.scores(s, d), 200))
query("eval_roc_curve", with_("scores", _grid(200, 0, 1) + " select_final threshold, fpr, tpr from g", "threshold fpr tpr"))(lambda s, d: E.roc_curve(B.scores(s, d)))
query("eval_pr_curve", with_("scores", _grid(200, 0, 1) + " select_final threshold, precision, tpr as recall from g", "threshold precision recall"))(lambda s, d: E.pr_curve(B.scores(s, d)))
_AUC = """, z as (select (fpr - lag(fpr) over w) * (tpr + lag(tpr) over w) / 2 as a from g window w as (order by fpr, tpr)) select_final abs(coalesce(sum(a), 0)) as auc from z"""
for _name, _args in (("200", (200, 0, 1)), ("300", (300, 0, 1))):
    query(f"eval_roc_auc_{_name}", with_("scores", _grid(*_args) + _AUC, "auc"))(
        lambda s, d, a=_args: E.roc_auc(E.threshold_grid(B.scores(s, d), a[0], 0.0, 1.0)))
query("eval_roc_auc_span", with_("scores", _grid(500, margin=0.01) + _AUC, "auc"))(lambda s, d: E.roc_auc(E.threshold_grid(B.scores(s, d), 500, margin=0.01)))
for _name, _steps in (("500", 500), ("300", 300)):
    query(f"eval_youden_threshold_{_name}", with_("scores", _grid(_steps, margin=0.001) + """ select_final threshold, tpr - fpr as youden_j, tpr as recall, precision, fpr from g
 order by round(tpr - fpr, 6) desc, round(fpr, 9), i limit 1""", "threshold youden_j recall precision fpr"))(
        lambda s, d, n=_steps: E.youden_threshold(B.scores(s, d), n))
for _name, _w, _steps in (("200", 0.8, 200), ("300", 0.8, 300), ("500", 0.85, 500)):
    query(f"eval_recall_weighted_threshold_{_name}", with_("scores", _grid(_steps) + f""" select_final threshold, {_w} * tpr + (1 - {_w}) * precision as objective, tpr as recall, precision from g
 order by round({_w} * tpr + (1 - {_w}) * precision, 12) desc, i limit 1""", "threshold objective recall precision"))(
        lambda s, d, w=_w, n=_steps: E.recall_weighted_threshold(B.scores(s, d), w, n))
query("eval_contamination_threshold", with_("scores", "select quantile_cont(score, 0.8) as base, quantile_cont(score, 0.8) * (1 - (1 - 0.8) * 0.5) as threshold from scores", "base threshold"))(
    lambda s, d: E.contamination_threshold(B.scores(s, d)))
query("eval_per_attack_breakdown", with_("scores", """b as (select label, count(*) as total, count(*) filter (score >= 0.2) as det, avg(score) as mean_score from scores group by 1),
 c as (select *, case when upper(label) = 'VIEW' then total - det else det end as correct from b)
 select_final label, total, mean_score, correct, total - correct as missed, correct / total as rate from c""", "mean_score rate"))(
    lambda s, d: E.per_attack_breakdown(B.scores(s, d), F.col("score") >= 0.2, benign="view"))


@query("eval_model_comparison", with_("scores", f"""m as (select row_id, y, unnest(['raw', 'doubled', 'inverted']) as model, unnest([score, least(1, score * 2), 1 - score]) as score from scores),
 c as ({_cm('score >= 0.3', 'model,')} from m group by model), r as (select *, {_RATES} from c), k as (select model, tp, fp, fn, tn, {_METRICS} from r)
 select_final *, row_number() over (order by recall desc, f1 desc, model)::int as rank from k""", _MD))
def comparison(spark, d):
    s = F.col("score")
    models = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("score")) for n, c in
                       (("raw", s), ("doubled", F.least(F.lit(1.0), s * 2)), ("inverted", 1 - s))])
    rows = B.scores(spark, d).select("y", F.explode(models).alias("m")).select("y", "m.*")
    return E.model_comparison(E.confusion_metrics(rows, s >= 0.3, ["model"]))


def labelled(spark, d):
    """Packets with ground truth by plain flag and TTL conditions."""
    flags = F.col("tcp_flags")
    label = F.when((F.col("protocol") == "TCP") & (flags.bitwiseAND(3) == 3), "PROTO_ANOMALY").when(F.col("ttl") <= 3, "TTL_ANOMALY").otherwise("BENIGN")
    return B.packets(spark, d).select("pkt_id", label.alias("label"))


def flagged(spark, d):
    p = B.packets(spark, d)
    return D.ttl_anomaly(p, RULES).unionByName(D.proto_anomaly(p, RULES))


_FLAGGED = f"al as ({SQL['ttl_anomaly'][2]} union all {SQL['proto_anomaly'][2]})"
_TRUTH = """lb as (select pkt_id, case when protocol = 'TCP' and tcp_flags & 3 = 3 then 'PROTO_ANOMALY' when ttl <= 3 then 'TTL_ANOMALY' else 'BENIGN' end as label from packets)"""


@query("eval_rule_quality", with_("packets", f"""{_FLAGGED}, {_TRUTH}, jn as (select pkt_id, label, category from lb left join (select distinct seq, category from al) on pkt_id = seq),
 tp as (select label as category, count(*) filter (hit) as tp, count(*) filter (not hit) as fn, 0 as fp from (select pkt_id, label, max(coalesce(category = label, false)) as hit from jn where label <> 'BENIGN' group by 1, 2) group by 1),
 un as (select * from tp union all select category, 0, 0, count(*) from jn where category <> label group by 1),
 pc as (select category, sum(tp)::bigint as tp, sum(fn)::bigint as fn, sum(fp)::bigint as fp from un group by 1),
 ov as (select * from pc union all select 'OVERALL', sum(tp)::bigint, sum(fn)::bigint, sum(fp)::bigint from pc),
 rt as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall from ov)
 select_final *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from rt""", "precision recall f1"))
def rule_quality(spark, d):
    return E.rule_quality(labelled(spark, d), flagged(spark, d))


@query("eval_attack_accuracy", with_("packets", f"""{_FLAGGED}, {_TRUTH}, ac as (select label, count(*) as samples, count(*) filter (pkt_id in (select seq from al)) as detected from lb group by 1)
 select_final label, samples, detected, samples - detected as missed, detected / samples as rate from ac""", "rate"))
def accuracy(spark, d):
    return E.attack_accuracy(labelled(spark, d), flagged(spark, d))


@query("eval_traffic_report", with_("packets", f"""{_FLAGGED}, ta as (select category, source_ip, min((ts_us, seq)) as fa, arg_min(seq, (ts_us, seq)) as seq, min(ts_us) as ts_us from al group by 1, 2 order by ts_us, seq, category limit 5)
 select_final 'totals' as section, 'packets' as name, count(*)::double as value from packets union all select 'totals', 'failed', 0 union all select 'totals', 'alerts', count(*) from al
 union all select 'severity', (['INFO','LOW','MEDIUM','HIGH','CRITICAL'])[severity], count(*) from al group by 2 union all select 'category', category, count(*) from al group by 2
 union all select 'top_alert', concat(category, ' ', source_ip), seq from ta union all select 'protocol_pct', protocol, 100.0e0 * count(*) / (select count(*) from packets) from packets group by 2
 union all select 'sender_bytes', ip, b from (select src_ip as ip, sum(size)::double as b from packets group by 1 order by 2 desc, 1 limit 10)""", "value"))
def report(spark, d):
    return E.traffic_report(B.packets(spark, d), flagged(spark, d))


query("eval_top_alerts", with_("packets", f"""{_FLAGGED} select_final category, source_ip, min(ts_us) as ts_us, arg_min(seq, (ts_us, seq)) as seq from al group by 1, 2 order by 3, 4, 1 limit 5"""))(
    lambda s, d: E.top_alerts(flagged(s, d)).select("category", "source_ip", "ts_us", "seq"))
