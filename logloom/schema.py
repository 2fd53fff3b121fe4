"""Table schemas and the fixed vocabularies the operators share."""
from __future__ import annotations

from pyspark.sql import types as T

LOG_RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("os_type", T.StringType()),
    T.StructField("os_source", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("pid", T.LongType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("facility", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("text", T.StringType()),
    # kept by us: parsed time, arrival order, dataset name
    T.StructField("ts_us", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("dataset", T.StringType()),
])

EMBEDDING_FIELD = T.StructField("embedding", T.ArrayType(T.DoubleType()))
VECTORIZED = T.StructType(LOG_RECORD.fields + [EMBEDDING_FIELD])

ANNOTATIONS = [
    T.StructField("cluster_id", T.LongType()),
    T.StructField("pattern_label", T.StringType()),
    T.StructField("pattern_confidence", T.DoubleType()),
    T.StructField("is_burst", T.BooleanType()),
    T.StructField("is_escalation_source", T.BooleanType()),
    T.StructField("is_repeat_offender", T.BooleanType()),
]
PATTERN = T.StructType(VECTORIZED.fields + ANNOTATIONS)
SAMPLE = T.StructType(LOG_RECORD.fields + ANNOTATIONS)

PATTERN_SUMMARY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("description", T.StringType()),
])

VARIANTS = {"original": LOG_RECORD, "vectorized": VECTORIZED,
            "pattern": PATTERN, "sample": SAMPLE}
VARIANTS_WITH_EMBEDDING = ("vectorized", "pattern")

# --------------------------------------------------------------------------
# Level names, ranks, maps, word lists and patterns. Results
# depend on them letter by letter.
# --------------------------------------------------------------------------
WINDOWS_LEVELS = {1: "ERROR", 2: "WARNING", 4: "INFO",
                  8: "AUDIT_SUCCESS", 16: "AUDIT_FAILURE"}

JOURNALD_LEVELS = {"0": "EMERGENCY", "1": "ALERT", "2": "CRITICAL", "3": "ERROR",
                   "4": "WARNING", "5": "NOTICE", "6": "INFO", "7": "DEBUG"}

FACILITY_NAMES = {0: "kern", 1: "user", 2: "mail", 3: "daemon", 4: "auth",
                  5: "syslog", 6: "lpr", 7: "news", 8: "uucp", 9: "cron",
                  10: "authpriv", 16: "local0", 17: "local1", 18: "local2",
                  19: "local3", 20: "local4", 21: "local5", 22: "local6",
                  23: "local7"}

CRITICAL_LEVELS = ["ERROR", "CRITICAL", "EMERGENCY", "ALERT", "AUDIT_FAILURE"]
OFFENDER_COUNT_LEVELS = ["ERROR", "CRITICAL", "AUDIT_FAILURE"]
SPLIT_LEVELS = ["ERROR", "CRITICAL", "EMERGENCY", "ALERT", "WARNING", "NOTICE",
                "INFO", "AUDIT_SUCCESS", "AUDIT_FAILURE", "DEBUG"]

SEVERITY_RANK = {"DEBUG": 0, "INFO": 1, "NOTICE": 2, "WARNING": 3, "ERROR": 4,
                 "CRITICAL": 5, "EMERGENCY": 6}
UNRANKED = -1

LEVEL_BADGES = {"ERROR": "[!!]", "CRITICAL": "[!!]", "EMERGENCY": "[!!]",
                "ALERT": "[!!]", "AUDIT_FAILURE": "[!F]", "WARNING": "[W ]",
                "NOTICE": "[N ]", "INFO": "[  ]", "AUDIT_SUCCESS": "[OK]",
                "DEBUG": "[D ]", "UNKNOWN": "[? ]"}
DEFAULT_BADGE = "[  ]"

STOPWORDS = [
    "the", "a", "an", "is", "it", "to", "of", "in", "for", "on", "at",
    "by", "or", "and", "not", "no", "has", "was", "are", "be", "been",
    "with", "from", "that", "this", "have", "had", "as", "but", "its",
    "log", "source", "host", "pid", "event", "id", "facility", "info",
    "error", "warning", "debug", "notice", "unknown",
]
TOKEN_EDGE_CHARS = "[]():,;."

MASK_RULES = [
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?", "<IP>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
     "<UUID>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?", "<TS>"),
    (r"\[\s*\d+\.\d+\]", "[<T>]"),
    (r"\bport \d+", "port <N>"),
    (r"\[\d+\]", "[<PID>]"),
    (r"(?:/[\w.\-]+){2,}", "<PATH>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b\d+\b", "<N>"),
]

DEFAULT_SYSLOG_FILES = ["/var/log/syslog", "/var/log/messages", "/var/log/auth.log",
                        "/var/log/kern.log", "/var/log/daemon.log"]

# Words that give a message without a level its level, the first kind found.
LEVEL_WORDS = {"ERROR": ["error", "fail", "fatal", "crit", "panic"], "WARNING": ["warn"],
               "DEBUG": ["debug"], "NOTICE": ["notice"]}
LEVEL_WITHOUT_WORD = "INFO"

# Operating defaults: schedule of the live mode.
BURST_WINDOW_SECS = 60
BURST_THRESHOLD = 3
OFFENDER_THRESHOLD = 3
ESCALATION_STEP = 2
SAMPLES_PER_CLUSTER = 2
REBUILD_ROWS = 100
REBUILD_SECS = 300
REVIEW_SECS = 1800
HASH_DIMS = 128
SVD_DIMS = 64
TFIDF_FEATURES = 5000
# --------------------------------------------------------------------------
