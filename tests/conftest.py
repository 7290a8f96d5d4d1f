import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("payguard-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.streaming.noDataMicroBatches.enabled", "false")
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pg-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


T0 = dt.datetime(2026, 5, 10, 12, 0, 0, tzinfo=dt.timezone.utc)
T0_MS = int(T0.timestamp() * 1000)


def ts(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, tz=dt.timezone.utc)


def event_row(event_id="event-1", user="user-1", etype="TRANSACTION", ms=T0_MS, amount=10_000,
              device="dev-1", merchant="m-1", request="request-1", seq=1):
    return dict(event_id=event_id, request_id=request, user_id=user, event_type=etype, ts=ts(ms),
                amount_cents=amount, currency="USD", ip_address=None, device_fp=device, merchant_id=merchant,
                counterparty=None, source="api-gateway", seq=seq, ms=ms)


EVENT_DDL = ("event_id string, request_id string, user_id string, event_type string, ts timestamp, "
             "amount_cents long, currency string, ip_address string, device_fp string, merchant_id string, "
             "counterparty string, source string, seq long, ms long")


@pytest.fixture
def events_df(spark):
    def make(rows):
        cols = [c.split()[0] for c in EVENT_DDL.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], EVENT_DDL)
    return make
