"""Log-shaped inputs derived from the given tables, in Spark and in SQL.

Each function reads a whole table; the SQL next to it states the same columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import WHITESPACE, compute_once, lookup
from ..functions.records import build_text
from ..session import scratch_path, spread
from ..streaming.run import read_stream

LEVEL_OF = {"error": "ERROR", "signup": "WARNING", "purchase": "NOTICE", "click": "INFO",
            "view": "DEBUG"}
LEVELS_SQL = ("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVEL_OF.items())
              + " END")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream; the pattern names the one file."""
    return read_stream(spark, f"{sf_dir}/events.parque[t]", events(spark, sf_dir).schema)


# --- canonical records -----------------------------------------------------

def _message():
    return F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string"),
                    F.lit(" props "), "props")


def _iso(c="ts"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _micros(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def log_columns(ev: DataFrame) -> DataFrame:
    third = F.col("event_id") % 3
    windows = F.col("user_id") % 3 == 1
    linux = F.when(~windows, F.lit(True))
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        _iso().alias("timestamp"),
        F.when(windows, "Windows").otherwise("Linux").alias("os_type"),
        F.when(windows, lookup(third, {0: "System", 1: "Application"}, "Security"))
         .otherwise(lookup(third, {0: "auth", 1: "kern"}, "journald")).alias("os_source"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@"),
                 F.date_format("ts", "MMdd")).alias("source"),
        lookup(F.col("event_type"), LEVEL_OF).alias("level"),
        F.when(windows, F.col("event_id")).alias("event_id"),
        F.when(linux, F.col("user_id")).alias("pid"),
        F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string")).alias("hostname"),
        F.when(linux, "user").alias("facility"),
        _message().alias("message"),
        F.concat(_iso(), F.lit(" "), _message()).alias("raw"),
        _micros().alias("ts_us"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("dataset"))


def t_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(log_columns(events(spark, sf_dir)))


def t_log_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows over all cores, for work that is heavy per row."""
    return with_text(log_columns(spread(events(spark, sf_dir))))


def t_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(log_columns(events_stream(spark, sf_dir)))


def with_text(df: DataFrame) -> DataFrame:
    at = df.columns.index("raw") + 1
    return df.withColumn("text", build_text()).select(*df.columns[:at], "text", *df.columns[at:])


_TEXT_SQL = """concat('[', timestamp, '] [', level, '] [', os_type, ':', os_source, ']',
 ' host=', hostname, ' source=', source,
 CASE WHEN pid <> 0 THEN concat(' pid=', pid) ELSE '' END,
 CASE WHEN event_id <> 0 THEN concat(' event_id=', event_id) ELSE '' END,
 CASE WHEN facility IS NOT NULL THEN concat(' facility=', facility) ELSE '' END,
 ' ', message)"""

T_LOG_SQL = f"""SELECT *, {_TEXT_SQL} AS text FROM (SELECT
 CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
 CASE WHEN user_id % 3 = 1 THEN 'Windows' ELSE 'Linux' END AS os_type,
 CASE WHEN user_id % 3 = 1
  THEN CASE event_id % 3 WHEN 0 THEN 'System' WHEN 1 THEN 'Application' ELSE 'Security' END
  ELSE CASE event_id % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'kern' ELSE 'journald' END END AS os_source,
 concat('u', user_id, '@', strftime(ts, '%m%d')) AS source,
 {LEVELS_SQL} AS level,
 CASE WHEN user_id % 3 = 1 THEN event_id END AS event_id,
 CASE WHEN user_id % 3 <> 1 THEN user_id END AS pid,
 concat('host', user_id % 7) AS hostname,
 CASE WHEN user_id % 3 <> 1 THEN 'user' END AS facility,
 concat(event_type, ' by user ', user_id, ' props ', props) AS message,
 concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), ' ', event_type, ' by user ', user_id, ' props ', props) AS raw,
 epoch_us(ts) AS ts_us, event_id AS seq, concat('d', user_id % 2) AS dataset
 FROM events) base"""

LOG = {"t_log": T_LOG_SQL}

# --- syslog lines ----------------------------------------------------------
PROCS = {0: "sshd", 1: "kernel", 2: "CRON", 3: "postfix-mail", 4: "systemd", 5: "app"}
FILES = {0: "/var/log/auth.log", 1: "/var/log/syslog", 2: "/var/log/messages"}
SEVERITY_WORD = {"error": "error", "signup": "warning", "purchase": "notice", "click": "info",
                 "view": "debug"}
PARSE_YEAR = 2024


def t_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``, ``path``, ``seq``: one line per event, three kinds in turn."""
    number = F.floor(F.col("event_id") / 3) % 6
    said = F.concat(lookup(F.col("event_type"), SEVERITY_WORD), F.lit(": "), _message())
    pid = F.when(F.col("user_id") % 2 == 0,
                 F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]"))).otherwise("")
    tail = F.concat(F.lit(" host"), (F.col("user_id") % 7).cast("string"), F.lit(" "),
                    lookup(number, PROCS), pid, F.lit(": "), said)
    line = (F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "MMM d HH:mm:ss"), tail))
             .when(F.col("event_id") % 3 == 1, F.concat(_iso(), F.lit("+00:00"), tail))
             .otherwise(F.concat(F.col("event_id").cast("string"), F.lit(" "), said)))
    lines = compute_once(spread(events(spark, sf_dir)), "line", line)
    return lines.select(F.col("line").alias("value"), lookup(F.col("user_id") % 3, FILES).alias("path"),
                        F.col("event_id").alias("seq"))


_WORD_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY_WORD.items()) + " END"
_PROC_SQL = "CASE (event_id // 3) % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PROCS.items()) + " END"
_PATH_SQL = "CASE user_id % 3 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FILES.items()) + " END"

# the expected records, computed from the columns and not from the lines
RAW = {"t_said": f"""SELECT *, event_id % 3 AS kind, {_PROC_SQL} AS proc, {_PATH_SQL} AS path,
 concat({_WORD_SQL}, ': ', event_type, ' by user ', user_id, ' props ', props) AS said FROM events""",
       "t_raw": """SELECT event_id AS seq, path, kind,
 CASE kind WHEN 0 THEN concat(strftime(ts, '%b '), day(ts), strftime(ts, ' %H:%M:%S'))
           WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS head,
 concat(' host', user_id % 7, ' ', proc,
        CASE WHEN user_id % 2 = 0 THEN concat('[', user_id, ']') ELSE '' END, ': ', said) AS tail,
 CASE WHEN kind = 2 THEN concat(event_id, ' ', said) ELSE concat(head, tail) END AS raw,
 CASE kind WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN head ELSE '' END AS timestamp,
 CASE kind WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(ts) END AS ts_us,
 CASE WHEN kind = 2 THEN 'unknown' ELSE proc END AS source,
 CASE WHEN kind = 2 THEN 'UNKNOWN' WHEN event_type = 'error' THEN 'ERROR'
      WHEN event_type = 'signup' THEN 'WARNING' WHEN event_type = 'purchase' THEN 'NOTICE'
      WHEN event_type = 'click' THEN 'INFO' ELSE 'DEBUG' END AS level,
 CASE WHEN kind <> 2 AND user_id % 2 = 0 THEN user_id END AS pid,
 CASE WHEN kind = 2 THEN 'localhost' ELSE concat('host', user_id % 7) END AS hostname,
 CASE WHEN kind = 2 THEN NULL WHEN proc = 'kernel' THEN 'kern' WHEN proc = 'sshd' THEN 'auth'
      WHEN proc = 'CRON' THEN 'cron' WHEN proc = 'postfix-mail' THEN 'mail'
      WHEN proc = 'systemd' THEN 'daemon' ELSE 'user' END AS facility,
 CASE WHEN kind = 2 THEN raw ELSE said END AS message,
 CASE user_id % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'syslog' ELSE 'messages' END AS os_source
 FROM t_said"""}

# --- journald lines --------------------------------------------------------
PRIORITIES = {"error": 3, "signup": 4, "purchase": 5, "click": 6, "view": 7}


def t_jrn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``, ``seq``: JSON lines with every field form; 1 in 50 is broken."""
    n = F.col("event_id")

    def text(c):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))

    priority = F.when(n % 11 == 0, "").otherwise(F.concat(
        F.lit(',"PRIORITY":"'), lookup(F.col("event_type"), PRIORITIES).cast("string"), F.lit('"')))
    byte_list = F.concat(F.lit("["), F.array_join(F.transform(
        F.split(_message(), ""), lambda c: F.ascii(c).cast("string")), ","), F.lit("]"))
    said = F.when(n % 97 == 0, "null").when(n % 10 == 0, byte_list).otherwise(text(_message()))
    name = F.when(n % 2 == 1, "_COMM").otherwise("SYSLOG_IDENTIFIER")
    user = F.col("user_id").cast("string")
    line = F.concat(
        F.lit('{"__REALTIME_TIMESTAMP":"'), _micros().cast("string"), F.lit('"'), priority,
        F.lit(',"MESSAGE":'), said, F.lit(',"'), name, F.lit('":"svc'),
        (F.col("user_id") % 5).cast("string"), F.lit('","_HOSTNAME":"host'),
        (F.col("user_id") % 7).cast("string"), F.lit('",'),
        F.when(n % 4 == 0, '"SYSLOG_PID":"').otherwise('"_PID":"'), user,
        F.lit('","SYSLOG_FACILITY":'), (n % 25).cast("string"),
        F.lit(',"_SYSTEMD_UNIT":"unit'), (n % 4).cast("string"), F.lit('.service"'),
        F.when(n % 50 == 49, "").otherwise("}"))
    return compute_once(spread(events(spark, sf_dir)), "line", line).select(
        F.col("line").alias("value"), n.alias("seq"))


JRN = {"t_jrn": """SELECT event_id AS seq, event_id % 4 AS unit_no,
 concat(event_type, ' by user ', user_id, ' props ', props) AS said,
 concat('{"__REALTIME_TIMESTAMP":"', epoch_us(ts), '"',
  CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(',"PRIORITY":"',
   CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 WHEN 'click' THEN 6 ELSE 7 END, '"') END,
  ',"MESSAGE":', CASE WHEN event_id % 97 = 0 THEN 'null'
   WHEN event_id % 10 = 0 THEN concat('[', array_to_string(list_transform(string_split(said, ''), lambda c: ascii(c)), ','), ']')
   ELSE concat('"', replace(said, '"', '\\"'), '"') END,
  ',"', CASE WHEN event_id % 2 = 1 THEN '_COMM' ELSE 'SYSLOG_IDENTIFIER' END, '":"svc', user_id % 5,
  '","_HOSTNAME":"host', user_id % 7, '",', CASE WHEN event_id % 4 = 0 THEN '"SYSLOG_PID":"' ELSE '"_PID":"' END, user_id,
  '","SYSLOG_FACILITY":', event_id % 25, ',"_SYSTEMD_UNIT":"unit', event_id % 4, '.service"}') AS raw,
 CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
 epoch_us(ts) AS ts_us,
 concat('svc', user_id % 5) AS source, user_id AS pid, concat('host', user_id % 7) AS hostname,
 CASE WHEN event_id % 11 = 0 THEN 'INFO' ELSE CASE event_type WHEN 'error' THEN 'ERROR'
  WHEN 'signup' THEN 'WARNING' WHEN 'purchase' THEN 'NOTICE' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END END AS level,
 CASE event_id % 25 WHEN 0 THEN 'kern' WHEN 1 THEN 'user' WHEN 2 THEN 'mail' WHEN 3 THEN 'daemon'
  WHEN 4 THEN 'auth' WHEN 5 THEN 'syslog' WHEN 6 THEN 'lpr' WHEN 7 THEN 'news' WHEN 8 THEN 'uucp'
  WHEN 9 THEN 'cron' WHEN 10 THEN 'authpriv' WHEN 16 THEN 'local0' WHEN 17 THEN 'local1'
  WHEN 18 THEN 'local2' WHEN 19 THEN 'local3' WHEN 20 THEN 'local4' WHEN 21 THEN 'local5'
  WHEN 22 THEN 'local6' WHEN 23 THEN 'local7' END AS facility,
 CASE WHEN event_id % 97 = 0 THEN '' ELSE said END AS message
 FROM events WHERE event_id % 50 <> 49"""}

# --- Windows rows ----------------------------------------------------------
EVENT_TYPES = {"error": 1, "signup": 2, "purchase": 4, "click": 8, "view": 16}
CHANNELS = {0: "System", 1: "Application", 2: "Security"}


def windows_columns(ev: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return ev.select(
        lookup(n % 3, CHANNELS).alias("channel"), F.col("ts").alias("time_generated"),
        F.when(n % 13 == 0, 0).otherwise(lookup(F.col("event_type"), EVENT_TYPES)).alias("event_type"),
        (n + 65536 * (n % 4)).alias("event_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source_name"),
        F.concat(F.lit("pc"), (F.col("user_id") % 7).cast("string")).alias("computer_name"),
        F.array(F.col("event_type"), F.col("props")).alias("string_inserts"),
        F.when(n % 5 != 0, F.concat(F.lit("  "), _message(), F.lit("\r\n"))).alias("message"),
        n.alias("seq"))


def t_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_columns(events(spark, sf_dir))


def t_win_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_columns(events_stream(spark, sf_dir))


WIN = {"t_win": """SELECT event_id AS seq, ts,
 CASE event_id % 3 WHEN 0 THEN 'System' WHEN 1 THEN 'Application' ELSE 'Security' END AS os_source,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, epoch_us(date_trunc('second', ts)) AS ts_us,
 concat('src', user_id % 5) AS source,
 CASE WHEN event_id % 13 = 0 THEN 'UNKNOWN' ELSE CASE event_type WHEN 'error' THEN 'ERROR'
  WHEN 'signup' THEN 'WARNING' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'AUDIT_SUCCESS'
  ELSE 'AUDIT_FAILURE' END END AS level,
 event_id % 65536 AS event_id, concat('pc', user_id % 7) AS hostname,
 CASE WHEN event_id % 5 = 0 THEN concat(event_type, ' | ', props)
      ELSE concat(event_type, ' by user ', user_id, ' props ', props) END AS message,
 concat('EventID=', event_id % 65536, ' Src=src', user_id % 5, ' Inserts=(''', event_type, ''', ''', props, ''')') AS raw
 FROM events"""}

# --- messages from documents -----------------------------------------------


def t_msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    lines = docs.select("doc_id", "lang", F.col("source"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "message"))
    return lines.select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("seq"), "doc_id", "source",
        lookup(F.col("lang"), {"en": "ERROR", "de": "WARNING", "fr": "INFO"}, "DEBUG").alias("level"),
        F.col("lang").alias("os_source"), "message",
        F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string")).alias("dataset"))


MSG = {"t_msg": """SELECT doc_id * 100000 + pos - 1 AS seq, doc_id, source,
 CASE lang WHEN 'en' THEN 'ERROR' WHEN 'de' THEN 'WARNING' WHEN 'fr' THEN 'INFO' ELSE 'DEBUG' END AS level,
 lang AS os_source, message, concat('d', doc_id % 2) AS dataset
 FROM (SELECT doc_id, lang, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
              unnest(string_split(text, chr(10))) AS message FROM documents)"""}

# Character classes of the expected texts, spelled out: those the SQL engine names are ASCII only.
WORD_SQL = "\\p{L}\\p{M}\\p{Nd}\\p{Pc}"
SPACE_SQL = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"


def with_variable_tail(msg: DataFrame) -> DataFrame:
    """Append the parts that the masking rules look for."""
    d = F.col("doc_id")

    def s(c):
        return c.cast("string")

    h = F.md5(s(d))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return msg.withColumn("message", F.concat(
        "message", F.lit("  from 10.0."), s(d % 256), F.lit("."), s(d % 250), F.lit(":"), s(d % 60000),
        F.lit(" port "), s(d), F.lit(" proc["), s(d), F.lit("] at /var/log/app"), s(d % 7),
        F.lit(".log reg 0x"), F.lower(F.hex(d)), F.lit(" key "), uuid, F.lit(" on 2024-01-02T03:04:05."),
        s(d), F.lit(" up [ "), s(d), F.lit(".5]   n "), s(d), F.lit(" ")))


TAILED_SQL = """SELECT * REPLACE (concat(message, '  from 10.0.', doc_id % 256, '.', doc_id % 250, ':', doc_id % 60000,
 ' port ', doc_id, ' proc[', doc_id, '] at /var/log/app', doc_id % 7, '.log reg 0x', lower(hex(doc_id)), ' key ',
 substr(md5(CAST(doc_id AS VARCHAR)), 1, 8), '-', substr(md5(CAST(doc_id AS VARCHAR)), 9, 4), '-',
 substr(md5(CAST(doc_id AS VARCHAR)), 13, 4), '-', substr(md5(CAST(doc_id AS VARCHAR)), 17, 4), '-',
 substr(md5(CAST(doc_id AS VARCHAR)), 21, 12), ' on 2024-01-02T03:04:05.', doc_id, ' up [ ', doc_id,
 '.5]   n ', doc_id, ' ') AS message) FROM t_msg"""


def mask_sql(column: str) -> str:
    from .. import schema as S
    out = column
    for pattern, mark in S.MASK_RULES:
        times = 1
        spelled = pattern.replace("\\w", WORD_SQL).replace("\\d", "\\p{Nd}").replace("\\s", SPACE_SQL)
        if pattern.startswith("\\b"):
            spelled, mark = f"(^|[^{WORD_SQL}])" + spelled[2:], "\\1" + mark
        if pattern.endswith("\\b"):
            # neighbouring matches share the character between them: the second pass finds the others
            spelled, mark, times = spelled[:-2] + f"($|[^{WORD_SQL}])", mark + "\\2", 2
        for _ in range(times):
            out = f"regexp_replace({out}, '{spelled}', '{mark}', 'g')"
    return f"trim(regexp_replace({out}, '{SPACE_SQL}+', ' ', 'g'))"


TAILED = {**MSG, "t_tail": TAILED_SQL}

# --- vectors ----------------------------------------------------------------


def t_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("seq"), F.col("vec_id").cast("string").alias("id"),
        F.col("label").cast("long").alias("cluster_id"),
        F.col("embedding").cast("array<double>").alias("embedding"))


EMB = {"t_emb": """SELECT vec_id AS seq, CAST(vec_id AS VARCHAR) AS id, CAST(label AS BIGINT) AS cluster_id,
 CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
       "t_dim": """SELECT seq, cluster_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM t_emb""",
       "t_cen": "SELECT cluster_id, dim, avg(x) AS c FROM t_dim GROUP BY cluster_id, dim",
       "t_cos": """SELECT seq, cluster_id, sum(x * c) AS xc, sqrt(sum(x * x)) AS nx, sqrt(sum(c * c)) AS nc
 FROM t_dim JOIN t_cen USING (cluster_id, dim) GROUP BY seq, cluster_id"""}


def text_folder(df: DataFrame, name: str) -> str:
    """Write a ``value`` column as text files in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.select("value").write.text(path)
    return path


def text_files(lines: DataFrame, names: list[str]) -> list[str]:
    """One text file per path of ``lines``, whose last part starts the name, in order of ``seq``."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = scratch_path(spark, "files")
    out = []
    for name in names:
        stem = name.rsplit(".", 1)[0]
        part = f"{folder}/parts-{stem}"
        own = lines.where(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1) == stem)
        own.repartition(1).sortWithinPartitions("seq").select("value").write.text(part)
        root = jvm.org.apache.hadoop.fs.Path(part)
        fs = root.getFileSystem(conf)
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-")]
        fs.rename(found[0], jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
        out.append(f"{folder}/{name}")
    return out
