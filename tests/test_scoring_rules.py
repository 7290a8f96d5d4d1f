"""Golden scoring (G1-G8), rule folding (G9-G16), rule versions (G38) and
the two-rule worker (G35)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import T0_MS, event_row, ts
from payguard import schemas
from payguard.config import DEFAULT_CONFIG as CFG
from payguard.operators import rules as R
from payguard.operators import scoring as S


def score(events_df, row, n=0, v=0, b=False, cfg=CFG, params=None):
    df = (events_df([row]).withColumn("merchant_users", F.lit(n).cast("long"))
          .withColumn("velocity_7d", F.lit(v).cast("long")).withColumn("blacklisted", F.lit(b)))
    p = params or R.static_params(cfg)
    r = S.evaluate(df, p, cfg).first()
    return r.decision, r.risk_score, list(r.reasons)


def test_g1_large_amount(events_df):
    assert score(events_df, event_row(amount=2_000_000), n=1) == ("BLOCK", 80, ["large_amount"])


def test_g2_burst(events_df):
    assert score(events_df, event_row(), n=10) == ("REVIEW", 70, ["merchant_multi_user_burst"])


def test_g3_withdrawal_and_burst(events_df):
    r = score(events_df, event_row(etype="WITHDRAWAL", device=None), n=10)
    assert r == ("BLOCK", 100, ["withdrawal_without_device", "merchant_multi_user_burst"])


def test_g4_nothing(events_df):
    assert score(events_df, event_row(etype="LOGIN", amount=0, merchant=None)) == ("ALLOW", 0, [])


def test_g5_custom_large_rule(events_df):
    cfg = CFG.with_(large_amount_cents=500_000, large_amount_score=90)
    assert score(events_df, event_row(amount=600_000), cfg=cfg) == ("BLOCK", 90, ["large_amount"])


def test_g6_burst_threshold(events_df):
    cfg = CFG.with_(burst_threshold=3)
    assert score(events_df, event_row(), n=5, cfg=cfg) == ("REVIEW", 70, ["merchant_multi_user_burst"])


def test_g7_blacklisted(events_df):
    assert score(events_df, event_row(), b=True) == ("BLOCK", 100, ["blacklisted_user"])


def test_g8_velocity(events_df):
    assert score(events_df, event_row(), v=100) == ("ALLOW", 40, ["high_velocity_7d"])


def test_blank_device_is_not_null_and_null_merchant_not_eligible(events_df):
    assert score(events_df, event_row(etype="WITHDRAWAL", device=" "), n=10)[2] == ["merchant_multi_user_burst"]
    assert score(events_df, event_row(merchant=None), n=50)[2] == []


def test_decision_uses_unclamped_score(events_df):
    cfg = CFG.with_(block_threshold=105)
    r = score(events_df, event_row(amount=2_000_000, etype="WITHDRAWAL", device=None), cfg=cfg)
    assert r == ("BLOCK", 100, ["large_amount", "withdrawal_without_device"])  # raw 110 >= 105


def test_thresholds_exact(events_df):
    cfg = CFG.with_(review_threshold=70)
    assert score(events_df, event_row(), n=10, cfg=cfg)[0] == "REVIEW"  # 70 >= 70


def rule_df(spark, rows):
    return spark.createDataFrame(
        [(r, t, e, p, dt.datetime(2026, 5, 20, 1, i, tzinfo=dt.timezone.utc), i) for i, (r, t, e, p) in enumerate(rows)],
        schemas.RULE_UPDATE)


def fold(spark, rows):
    return R.fold_rule_set(R.normalize_rule_updates(rule_df(spark, rows)), CFG).first().asDict()


def test_g9_defaults(spark):
    r = fold(spark, [])
    assert (r["large_amount_cents"], r["large_amount_score"], r["withdrawal_score"], r["burst_threshold"],
            r["burst_score"], r["velocity_threshold"], r["velocity_score"], r["review_threshold"],
            r["block_threshold"]) == (1_000_000, 80, 30, 10, 70, 100, 40, 60, 80)


def test_g10_g11_g12_large_amount(spark):
    assert fold(spark, [("r1", "large_amount", True, {"amount_cents": "500000", "score_delta": "85"})])[
        "large_amount_score"] == 85
    r = fold(spark, [("r1", "large_amount", True, {"amount_cents": "200000"})])
    assert (r["large_amount_cents"], r["large_amount_score"]) == (200_000, 80)
    assert fold(spark, [("r1", "large_amount", False, {"amount_cents": "1"})])["large_amount_cents"] == 1_000_000


def test_g13_g14_g15_g16(spark):
    r = fold(spark, [("g", "global", True, {"review_threshold": "50", "block_threshold": "75"})])
    assert (r["review_threshold"], r["block_threshold"]) == (50, 75)
    r = fold(spark, [("v", "high_velocity_7d", True, {"velocity_threshold": "250", "score_delta": "55"})])
    assert (r["velocity_threshold"], r["velocity_score"]) == (250, 55)
    r = fold(spark, [("a", "large_amount", True, {"amount_cents": "300000"}),
                     ("b", "merchant_multi_user_burst", True, {"burst_threshold": "5"}),
                     ("c", "global", True, {"block_threshold": "70"})])
    assert (r["large_amount_cents"], r["burst_threshold"], r["block_threshold"], r["review_threshold"]) == (
        300_000, 5, 70, 60)
    assert fold(spark, [("x", "unknown_type", True, {"score_delta": "1"})]) == fold(spark, [])


def test_several_rules_same_type_latest_wins(spark):
    r = fold(spark, [("a", "large_amount", True, {"score_delta": "11"}),
                     ("b", "large_amount", True, {"score_delta": "22"})])
    assert r["large_amount_score"] == 22


def test_bad_parameter_is_quarantined(spark):
    good, bad = R.split_valid_rules(rule_df(spark, [("a", "large_amount", True, {"amount_cents": "12x"})]))
    assert good.count() == 0 and bad.count() == 1


def test_g38_enable_then_disable(spark, events_df):
    t_on, t_off = T0_MS, T0_MS + 60_000
    updates = spark.createDataFrame([
        ("r-large", "LARGE_AMOUNT", True, {"amount_cents": "500000"}, ts(t_on), 1),
        ("r-large", "large_amount", False, {"amount_cents": "500000"}, ts(t_off), 2)], schemas.RULE_UPDATE)
    ev = events_df([event_row("e1", amount=600_000, ms=t_on + 1, seq=1),
                    event_row("e2", amount=600_000, ms=t_off + 1, seq=2)]).withColumns(
        {"merchant_users": F.lit(0).cast("long"), "velocity_7d": F.lit(0).cast("long"), "blacklisted": F.lit(False)})
    versions = R.rule_versions(updates, CFG)
    got = {r.event_id: (r.decision, r.risk_score, list(r.reasons))
           for r in S.evaluate(R.attach_rule_params(ev, versions, CFG, R.change_span(updates)), R.dynamic_params(), CFG).collect()}
    assert got == {"e1": ("BLOCK", 80, ["large_amount"]), "e2": ("ALLOW", 0, [])}


def test_g35_two_rule_worker_is_deterministic(events_df):
    df = events_df([event_row(amount=2_000_000)])
    a = S.two_rule_decisions(df, CFG).first()
    b = S.two_rule_decisions(df, CFG).first()
    assert a.decision_id == b.decision_id and (a.decision, a.risk_score, list(a.reasons)) == (
        "BLOCK", 80, ["large_amount"])
    none = S.two_rule_decisions(events_df([event_row(amount=1)]), CFG).first()
    assert list(none.reasons) == ["no_async_rule_hit"] and none.decision == "ALLOW"
