"""Frozen configuration of the risk pipeline.

Every tunable is a plain literal so a config can be captured in a closure,
shipped to executors and compared between runs.  Durations are milliseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

# Fixed values that must equal the reference's behaviour.
# Event types admitted by the gateway, in the reference's order.
ALLOWED_EVENT_TYPES = ("TRANSACTION", "LOGIN", "WITHDRAWAL", "TRANSFER", "BEHAVIOUR")
# Rule types accepted by the rule store.
ALLOWED_RULE_TYPES = (
    "large_amount",
    "withdrawal_without_device",
    "merchant_multi_user_burst",
    "high_velocity_7d",
    "global",
)
# Reason strings, in the order the rules are evaluated.
REASON_BLACKLISTED = "blacklisted_user"
REASON_VELOCITY = "high_velocity_7d"
REASON_LARGE_AMOUNT = "large_amount"
REASON_NO_DEVICE = "withdrawal_without_device"
REASON_BURST = "merchant_multi_user_burst"
REASON_NO_ASYNC_HIT = "no_async_rule_hit"
# Sources stamped on produced records.
SOURCE_ENGINE = "flink-risk-engine"
SOURCE_WORKER = "risk-worker"
SOURCE_GATEWAY = "api-gateway"
# Default severity -> channel routing of the alert service.
DEFAULT_ROUTING = (
    ("MEDIUM", ("email",)),
    ("HIGH", ("email", "sms")),
    ("CRITICAL", ("email", "sms", "push")),
)
# Documented ban ladder: severity -> ttl seconds (0 = permanent).
BAN_LADDER = ((1, 60), (2, 3_600), (3, 86_400), (4, 604_800), (5, 0))


@dataclass(frozen=True)
class RiskConfig:
    # scoring thresholds and deltas
    large_amount_cents: int = 1_000_000
    large_amount_score: int = 80
    withdrawal_score: int = 30
    burst_threshold: int = 10
    burst_score: int = 70
    velocity_threshold: int = 100
    velocity_score: int = 40
    blacklist_score: int = 100
    review_threshold: int = 60
    block_threshold: int = 80
    high_risk_threshold: int = 85
    alert_threshold: int = 90
    score_cap: int = 100
    # windows
    burst_window_ms: int = 300_000
    watermark_skew_ms: int = 5_000
    velocity_window_ms: int = 7 * DAY_MS
    rate_limit_window_ms: int = 60_000
    rate_limit: int = 5
    # two-rule worker
    worker_large_amount_cents: int = 1_000_000
    # bans
    ban_severity: int = 3
    ban_ttl_seconds: int = 86_400
    # alerts
    alert_cooldown_ms: int = 15 * 60_000
    alert_max_retries: int = 2
    routing: tuple = DEFAULT_ROUTING
    dlq_message_max_chars: int = 512
    # outbox / replay
    outbox_batch_size: int = 100
    replay_max_messages: int = 100
    # execution: time bucket used to split hot keys in window operators
    bucket_ms: int = HOUR_MS
    # largest key folded inside one array (longer keys: pointer doubling)
    fold_max_group_rows: int = 10_000

    def with_(self, **kw) -> "RiskConfig":
        return replace(self, **kw)

    @property
    def burst_lookback_ms(self) -> int:
        """Look-back of the running job: window + watermark skew + 1 ms."""
        return self.burst_window_ms + self.watermark_skew_ms + 1


DEFAULT_CONFIG = RiskConfig()

# Parameters scaled to the driver's test tables (the defaults never fire there).
TESTDATA_CONFIG = RiskConfig(
    rate_limit_window_ms=DAY_MS,
    rate_limit=4,
    velocity_threshold=20,
    large_amount_cents=15_000,
    burst_window_ms=12 * HOUR_MS,
    burst_threshold=10,
    alert_cooldown_ms=DAY_MS,
)
