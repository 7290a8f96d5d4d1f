import hashlib
import uuid

from pyspark.sql import functions as F

from payguard import functions as PF


def java_name_uuid(text: str) -> str:
    """Name-based UUID as Java's ``UUID.nameUUIDFromBytes`` builds it."""
    h = bytearray(hashlib.md5(text.encode("utf-8")).digest())
    h[6] = (h[6] & 0x0F) | 0x30
    h[8] = (h[8] & 0x3F) | 0x80
    return str(uuid.UUID(bytes=bytes(h)))


def test_f04_name_uuid_matches_java_rule(spark):
    seeds = [f"flink-risk-engine:evt-{i}" for i in range(300)] + ["risk-worker:event-1", "alert:x", "é ü 漢"]
    df = spark.createDataFrame([(s,) for s in seeds], "s string")
    got = {r.s: r.u for r in df.select("s", PF.name_uuid("s").alias("u")).collect()}
    assert all(got[s] == java_name_uuid(s) for s in seeds)


def test_f04_stable_id_prefix(spark):
    df = spark.createDataFrame([("event-1",)], "e string")
    assert df.select(PF.stable_id("risk-worker", "e")).first()[0] == java_name_uuid("risk-worker:event-1")


def test_f10_parse_int_or_zero(spark):
    vals = ["123", " 5 ", "abc", None, "+7", "-3", "", "99999999999"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(PF.parse_int_or_zero("v")).collect()]
    assert got == [123, 0, 0, 0, 7, -3, 0, 0]


def test_f12_ban_value_parse(spark):
    vals = ["FRAUD:4", "a:b:3", ":3", "x:", "plain"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [(r[0], r[1]) for r in df.select(PF.ban_value_reason("v"), PF.ban_value_severity("v")).collect()]
    assert got == [("FRAUD", 4), ("a:b", 3), (":3", 0), ("x:", 0), ("plain", 0)]


def test_f20_retry_count(spark):
    df = spark.createDataFrame([(bytes([0, 0, 0, 3]),), (bytes([0, 0, 3]),), (None,), (bytes([255, 255, 255, 255]),)],
                               "v binary")
    got = [r[0] for r in df.select(PF.retry_count_from_header("v", 2)).collect()]
    assert got == [3, 3, 3, -1]


def test_f02_blank_and_f24_severity(spark):
    df = spark.createDataFrame([(" \t",), ("",), ("a",), (None,), (" ",)], "v string")
    got = [(r[0], r[1]) for r in df.select(PF.is_blank("v"), PF.severity_or_unknown("v")).collect()]
    assert got[0] == (True, "unknown") and got[1] == (True, "unknown") and got[2] == (False, "a")
    assert got[3] == (None, "unknown")


def test_f18_truncate(spark):
    df = spark.createDataFrame([("x" * 600,), (None,)], "m string")
    got = [r[0] for r in df.select(PF.truncate_chars("m", 512)).collect()]
    assert len(got[0]) == 512 and got[1] == ""


def test_f06_f07_decision_and_severity(spark):
    df = spark.createDataFrame([(95,), (90,), (89,), (110,)], "s int")
    rows = df.select(PF.severity_for("s"), PF.decision_for("s", 60, 80), PF.decision_for("s", 100, 50)).collect()
    assert [r[0] for r in rows] == ["CRITICAL", "HIGH", "MEDIUM", "CRITICAL"]
    assert [r[1] for r in rows] == ["BLOCK", "BLOCK", "BLOCK", "BLOCK"]
    assert [r[2] for r in rows] == ["BLOCK", "BLOCK", "BLOCK", "BLOCK"]  # block test first


def test_f19_header_upsert_and_last(spark):
    h = [("a", b"1"), ("b", b"2"), ("a", b"3")]
    df = spark.createDataFrame([(h,)], "headers array<struct<key:string,value:binary>>")
    out = df.select(PF.header_value_str("headers", "a").alias("last"),
                    PF.header_upsert("headers", "a", F.lit("9")).alias("h")).first()
    assert out.last == "3"
    assert [(x.key, bytes(x.value)) for x in out.h] == [("b", b"2"), ("a", b"9")]


def test_f15_iso_roundtrip(spark):
    df = spark.createDataFrame([("2026-05-17T23:45:00Z",), ("2026-05-17T23:45:00.123Z",), ("garbage",)], "s string")
    rows = df.select(PF.iso_instant(PF.parse_instant("s")).alias("r")).collect()
    assert [r.r for r in rows] == ["2026-05-17T23:45:00Z", "2026-05-17T23:45:00.123Z", None]
