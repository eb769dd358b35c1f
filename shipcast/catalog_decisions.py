"""Registered queries of the decision time: what is known by then, rates as of then,
and the event-time streams that score each order when it is due."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .catalog import r9, register
from .catalog_models import _GNB
from .operators import evaluate as E
from .operators import pointintime as P
from .plans import datasets as ds
from .plans import variables as V
from .session import cut_lineage, stored_table
from .streaming import decisions as D
from .streaming.scoring import fit_scoring_model

DELAY_DAYS = 2  # how far events may be out of order

_IN_TIME = f"coalesce({O.CARR} <= {O.SLF}, false)"
_AT = f"(CASE WHEN {_IN_TIME} THEN {O.CARR} ELSE {O.SLF} END)"
_MASKED = f"""
    CASE WHEN {_IN_TIME} THEN 0 ELSE 1 END AS shipping_limit_missed,
    CASE WHEN {_IN_TIME} THEN shipping_limit_miss_amt END AS shipping_limit_miss_amt,
    CASE WHEN {O.APPR} <= {_AT} THEN approval_time_days END AS approval_time_days,
    {O.days(_AT, O.EST)} AS days_remaining"""

_KNOWN = f"""
dk AS (SELECT * REPLACE ({_MASKED}), {_AT} AS decision_ts,
              CASE WHEN {O.DELIV} < {O.EST} + INTERVAL 1 DAY THEN {O.DELIV} ELSE {O.EST} + INTERVAL 1 DAY END AS known_ts
       FROM clf_cc)"""


def _rate_sql(name: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT d.Rww_ID, count(k.Rww_ID) AS n, CAST(coalesce(sum(k.late_delivery_flag), 0) AS BIGINT) AS late
  FROM dk d LEFT JOIN dk k ON k.{key} = d.{key} AND CAST(k.known_ts AS DATE) < CAST(d.decision_ts AS DATE)
  GROUP BY d.Rww_ID)"""


@register("known_at_decision", O.on_features(f"""
SELECT Rww_ID, decision_ts, shipping_limit_missed, round(shipping_limit_miss_amt, 9) AS shipping_limit_miss_amt,
       round(approval_time_days, 9) AS approval_time_days, round(days_remaining, 9) AS days_remaining,
       s.n AS seller_n, s.late AS seller_late, c.n AS state_n, c.late AS state_late
FROM dk JOIN ks s USING (Rww_ID) JOIN kc c USING (Rww_ID)""",
    _KNOWN, _rate_sql("ks", "seller_id"), _rate_sql("kc", "customer_state")))
def q_known_at_decision(spark, sf):
    """Predictors as known at the decision time, with the seller's and the state's
    late counts over outcomes of earlier days."""
    orders = P.known_at_decision(ds.clf_frame(spark, sf)).withColumn("known_ts", P.outcome_time())
    orders = stored_table(orders.select("Rww_ID", "decision_ts", "known_ts", "seller_id", "customer_state", V.CLF_TARGET,
                                        *V.KNOWN_MASKED), "known-at-decision")
    rated = P.asof_rates(orders, "seller_id", V.CLF_TARGET, "decision_ts", "known_ts", "seller")
    rated = P.asof_rates(rated, "customer_state", V.CLF_TARGET, "decision_ts", "known_ts", "state")
    return rated.select("Rww_ID", "decision_ts", "shipping_limit_missed", r9("shipping_limit_miss_amt"), r9("approval_time_days"),
                        r9("days_remaining"), "seller_n", "seller_late", "state_n", "state_late")


def _events(orders, *more):
    """(orders, hand_offs) as event tables, stored once."""
    table = stored_table(orders.select(
        F.col("Rww_ID").alias("key"), D.instant(O.PTS).alias("purchased_at"), D.instant(O.SLF).alias("ship_limit_at"),
        D.instant(O.APPR).alias("approved_at"), D.instant(O.EST).alias("estimated_at"), *more,
        D.instant(O.CARR).alias("handed_at")), "order-events")
    return table.drop("handed_at"), table.where("handed_at IS NOT NULL").select("key", "handed_at")


@register("decision_stream", O.on_features(f"""
SELECT Rww_ID, {_AT} AS decision_ts, CAST({_IN_TIME} AS INTEGER) AS handed_over, shipping_limit_missed,
       round(shipping_limit_miss_amt, 9) AS shipping_limit_miss_amt, round(approval_time_days, 9) AS approval_time_days,
       round(days_remaining, 9) AS days_remaining
FROM (SELECT * REPLACE ({_MASKED}) FROM feat)"""))
def q_decision_stream(spark, sf):
    """Every order decided once by two event-time streams, orders and hand-offs, that
    arrive out of order: at the hand-off if it comes by the ship limit, else at the limit."""
    orders, hand_offs = _events(ds.orders(spark, sf))
    decided = D.replay(orders, hand_offs, DELAY_DAYS)
    return decided.select(F.col("key").alias("Rww_ID"), D.wall_clock("decided_at").alias("decision_ts"),
                          F.col("handed_at").isNotNull().cast("int").alias("handed_over"), "shipping_limit_missed",
                          r9("shipping_limit_miss_amt"), r9("approval_time_days"), r9("days_remaining"))


_DECIDED_GNB = "".join(f",\ndec_{part} AS (SELECT * REPLACE ({_MASKED}) FROM clf_{part})" for part in ("train", "test")).lstrip(",") \
    + "," + _GNB.replace("clf_train", "dec_train").replace("clf_test", "dec_test")


@register("decision_scoring", O.on_features("""
SELECT actual_late_flag, predicted_late_flag, count(*) AS cnt FROM (
  SELECT t.Rww_ID, any_value(t.late_delivery_flag) AS actual_late_flag, arg_max(g.k, g.ll) AS predicted_late_flag
  FROM (SELECT tl.Rww_ID, g.k, any_value(g.log_prior) - 0.5 * sum(ln(2 * pi() * g.sigma))
               - 0.5 * sum(power(tl.x - g.theta, 2) / g.sigma) AS ll
        FROM (""" + "\n  UNION ALL ".join(
    f"SELECT Rww_ID, {j} AS j, {c} AS x FROM dec_test_s" for j, c in enumerate(V.CLF_BASIC)) + """) tl
        JOIN gnb g ON g.j = tl.j GROUP BY tl.Rww_ID, g.k) g
  JOIN dec_test_s t USING (Rww_ID) GROUP BY t.Rww_ID)
GROUP BY 1, 2""", _DECIDED_GNB))
def q_decision_scoring(spark, sf):
    """Test orders scored by the event-time streams at their decision time, with a
    naive-Bayes model fitted on the training orders as known at theirs; the
    confusion matrix of the scores."""
    train, test = ds.clf_split(spark, sf)
    model = fit_scoring_model(cut_lineage(P.known_at_decision(train).select("Rww_ID", V.CLF_TARGET, *V.CLF_BASIC)),
                              V.CLF_BASIC, V.CLF_NOT_SCALED, V.CLF_TARGET)
    given = [c for c in V.CLF_BASIC if c not in V.KNOWN_MASKED]
    orders, hand_offs = _events(test, V.CLF_TARGET, *given)
    scored = D.replay(orders, hand_offs, DELAY_DAYS, model=model)
    return E.confusion_matrix(scored, V.CLF_TARGET, "predicted_late_flag")
