"""Edge cases of normalisation, on hand-made rows."""
import pytest
from pyspark.sql import functions as F

from logloom.functions import records as R
from logloom.functions import templates as T
from logloom.sources.journald import ingest_journald
from logloom.sources.syslog import parse_syslog
from logloom.sources.windows import parse_windows


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<int>' if isinstance(v, list) else 'long'}"
                       for k, v in values.items()) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def syslog(spark, *lines, **kw):
    df = spark.createDataFrame([(v, "/var/log/auth.log", i) for i, v in enumerate(lines)],
                               "value string, path string, seq long")
    return parse_syslog(df, 2024, **kw).orderBy("seq").collect()


def test_rfc3164(spark):
    r, = syslog(spark, "Jan 10 12:00:00 web sshd[1022]: Accepted key: from 10.0.0.5 port 41222")
    assert (r.timestamp, r.hostname, r.source, r.pid) == ("2024-01-10T12:00:00", "web", "sshd", 1022)
    assert r.message == "Accepted key: from 10.0.0.5 port 41222"
    assert (r.level, r.facility, r.os_source, r.os_type) == ("INFO", "auth", "auth", "Linux")
    assert r.text == ("[2024-01-10T12:00:00] [INFO] [Linux:auth] host=web source=sshd pid=1022 "
                      "facility=auth Accepted key: from 10.0.0.5 port 41222")


def test_impossible_dates_keep_their_text(spark):
    rows = syslog(spark, "Feb 30 01:02:03 h p: m", "Foo 1 01:02:03 h p: m", "Jan 5 25:02:03 h p: m",
                  "Jan 100 01:02:03 h p: m", "Jan 7 01:02:60 h p: m", "Jan 0 01:02:03 h p: m")
    assert [r.timestamp for r in rows] == [
        "2024 Feb 30 01:02:03", "2024 Foo 1 01:02:03", "2024 Jan 5 25:02:03",
        "2024 Jan 100 01:02:03", "2024 Jan 7 01:02:60", "2024 Jan 0 01:02:03"]
    assert all(r.ts_us is None and r.message == "m" for r in rows)


def test_month_case(spark):
    rows = syslog(spark, "JAN 05 01:02:03 h p: m", "feb  9 01:02:03 h p: m")
    assert [r.timestamp for r in rows] == ["2024-01-05T01:02:03", "2024-02-09T01:02:03"]


def test_iso_forms(spark):
    z, off, name = syslog(spark, "2024-01-10T12:00:00Z h p: m", "2024-01-10T12:00:00+02:00 h p[7]: m",
                          "2024-01-10T12:00:00.123456+00:00 h my proc: a: b")
    assert (z.level, z.source, z.timestamp, z.message) == ("UNKNOWN", "unknown", "", "2024-01-10T12:00:00Z h p: m")
    assert off.timestamp == "2024-01-10T12:00:00+02:00" and off.ts_us == 1704880800000000
    assert (name.source, name.pid, name.message) == ("my proc", None, "a: b")


def test_blank_lines_and_unmatched(spark):
    rows = syslog(spark, "", "   \t", "  hello world ", default_host="me")
    assert [(r.message, r.raw, r.hostname, r.facility) for r in rows] == [
        ("hello world", "hello world", "me", None)]


def test_empty_message_leaves_a_space(spark):
    r, = syslog(spark, "Jan 10 12:00:00 web app:")
    assert r.message == "" and r.text.endswith("facility=user ")


def test_parse_is_stable_and_ids_differ(spark):
    a, b = syslog(spark, "same line", "same line")
    assert a.id != b.id and a.id == syslog(spark, "same line")[0].id


@pytest.mark.parametrize("source, message, level", [
    ("x", "a FATAL thing", "ERROR"), ("x", "Failed password", "ERROR"), ("critd", "ok", "ERROR"),
    ("x", "some Warning", "WARNING"), ("x", "debugging", "DEBUG"), ("noticed", "ok", "NOTICE"),
    ("x", "ok", "INFO"), ("x", "warn then error", "ERROR")])
def test_infer_level(spark, source, message, level):
    assert one(spark, R.infer_level("s", "m"), s=source, m=message) == level


@pytest.mark.parametrize("source, facility", [
    ("Kernel", "kern"), ("kernel2", "user"), ("openssh", "auth"), ("su", "auth"), ("sum", "user"),
    ("anacron", "cron"), ("mailer", "mail"), ("init", "daemon"), ("systemd", "daemon"), ("systemd-x", "user")])
def test_infer_facility(spark, source, facility):
    assert one(spark, R.infer_facility("s"), s=source) == facility


@pytest.mark.parametrize("path, label", [
    ("/var/log/auth.log", "auth"), ("journald", "journald"), ("/a/b.log.log", "b"),
    ("/a/x.log.1", "x.1"), ("/a/.log", "/a/.log"), ("syslog", "syslog")])
def test_os_source_label(spark, path, label):
    assert one(spark, R.os_source_label("p"), p=path) == label


@pytest.mark.parametrize("text, us, compat_us", [
    ("2024-01-10T12:00:00", 1704888000000000, 1704888000000000),
    ("2024-01-10 12:00:00", 1704888000000000, 1704888000000000),
    ("2024-01-10T12:00:00.5", 1704888000500000, 1704888000500000),
    ("2024-01-10T12:00:00+00:00", 1704888000000000, None),
    ("2024-01-10T12:00:00.000001+02:00", 1704880800000001, 1704888000000001),
    ("2024-02-30T12:00:00", None, None), ("2024-01", None, None), ("", None, None), (None, None, None)])
def test_parse_event_time(spark, text, us, compat_us):
    assert one(spark, R.parse_event_time("t"), t=text) == us
    assert one(spark, R.parse_event_time("t", compat=True), t=text) == compat_us


@pytest.mark.parametrize("us, text", [(1704888000000000, "2024-01-10T12:00:00"),
                                      (1704888000000001, "2024-01-10T12:00:00.000001"),
                                      (0, "1970-01-01T00:00:00"), (9 * 10**18, "")])
def test_micros_to_iso(spark, us, text):
    assert one(spark, R.micros_to_iso("u"), u=us) == text


@pytest.mark.parametrize("values, text", [([72, 105], "Hi"), ([255, 65], "�A"), ([], ""),
                                          ([195, 169], "é"), ([300, 1], "[300, 1]")])
def test_decode_bytes(spark, values, text):
    assert one(spark, R.decode_byte_message("b"), b=values) == text


@pytest.mark.parametrize("number, name", [("0", "kern"), (" 16 ", "local0"), ("x", None), ("12", None), ("", None)])
def test_facility_name(spark, number, name):
    assert one(spark, R.facility_name("n"), n=number) == name


def test_falsy_parts_stay_out_of_text(spark):
    df = spark.createDataFrame([("t", None, "Linux", "auth", "", "src", 0, 0, "", "m")],
                               "timestamp string, level string, os_type string, os_source string, hostname string, "
                               "source string, pid long, event_id long, facility string, message string")
    assert df.select(R.build_text().alias("t")).first().t == "[t] [INFO] [Linux:auth] source=src m"


def journal(spark, *lines):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, seq long")
    return ingest_journald(df).orderBy("seq").collect()


def test_journald_forms(spark):
    rows = journal(
        spark,
        '{"__REALTIME_TIMESTAMP":"1704888000000000","PRIORITY":3,"MESSAGE":" [1] text ","_PID":"x","SYSLOG_PID":"5"}',
        '{"MESSAGE":null,"SYSLOG_IDENTIFIER":"","_COMM":"c","_PID":"12","SYSLOG_FACILITY":"4"}',
        '{"__REALTIME_TIMESTAMP":"soon","MESSAGE":[104,105]}', 'not json', '{"broken', '', '[1,2]', '17')
    assert len(rows) == 3
    a, b, c = rows
    assert (a.timestamp, a.level, a.message, a.pid, a.source) == ("2024-01-10T12:00:00", "ERROR", "[1] text", None, "unknown")
    assert (b.timestamp, b.level, b.message, b.pid, b.source, b.facility) == ("1970-01-01T00:00:00", "INFO", "", 12, "c", "auth")
    assert (c.timestamp, c.ts_us, c.message) == ("", None, "hi")


def test_windows_forms(spark):
    df = spark.createDataFrame(
        [("System", "2024-01-10 12:00:00.9", 16, 65536 * 3 + 41, "src", "pc", ["it's", "b"], None, 0),
         ("System", "2024-01-10 12:00:00", 3, 7, "src", "pc", None, " hi \r\n", 1),
         ("System", "2024-01-10 12:00:00", 1, 7, "src", "pc", ["a"], None, 2)],
        "channel string, t string, event_type int, event_id long, source_name string, computer_name string, "
        "string_inserts array<string>, message string, seq long").withColumn("time_generated", F.col("t").cast("timestamp_ntz"))
    a, b, c = parse_windows(df).orderBy("seq").collect()
    assert (a.level, a.event_id, a.message, a.timestamp) == ("AUDIT_FAILURE", 41, "it's | b", "2024-01-10T12:00:00")
    assert a.raw == 'EventID=41 Src=src Inserts=("it\'s", \'b\')'
    assert (b.level, b.message, b.raw) == ("UNKNOWN", "hi", "EventID=7 Src=src Inserts=None")
    assert c.raw == "EventID=7 Src=src Inserts=('a',)"


@pytest.mark.parametrize("message, template", [
    ("Failed for root from 10.0.0.9 port 22 ssh2", "Failed for root from <IP> port <N> ssh2"),
    ("from 10.0.0.9:443", "from <IP>"),
    ("[12345.678] Kill process 3001 (python3) score 900", "[<T>] Kill process <N> (python3) score <N>"),
    ("run [42] /usr/bin/apt-get   update", "run [<PID>] <PATH> update"),
    ("at 0xDEADbeef id 123e4567-e89b-12d3-a456-426614174000", "at <HEX> id <UUID>"),
    ("2024-01-02 03:04:05.25 x", "<TS> x"), ("", ""), (None, ""),
    ("größe 5 é7", "größe <N> é7")])
def test_mask_message(spark, message, template):
    assert one(spark, T.mask_message("m"), m=message) == template


def test_tokens(spark):
    assert one(spark, T.message_tokens("m"), m="[Error]: The (Quick) fox, ab x.y; ;;; Fox.") == ["quick", "fox", "x.y", "fox"]


def test_ngrams(spark):
    assert one(spark, T.ngram_terms("m"), m="A cat, a Dog ran") == ["cat", "dog", "ran", "cat dog", "dog ran"]
    assert one(spark, T.ngram_terms("m"), m="x") == []
    assert one(spark, T.ngram_terms("m"), m="one") == ["one"]
