"""Log views of the sample ``events`` table: every event becomes one log line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import GEO_PROFILES
from .text import use_all_cores

START_EPOCH = 1779321600  # 2026-05-21 00:00:00 UTC

URLS = [
    "/start.html", "/team.html", "/write-us.html", "/shop/parts", "/assets/app.js",
    "/assets/site.css", "/assets/mark.png", "/icon.ico", "/api/v1/health", "/news/archive",
    "/api/items?sku=7%20UNION%20SELECT%2520colour", "/login?name=lee%27%20OR%201=1--",
    "/docs/../../etc/passwd", "/get?doc=..%2f..%2fwin.ini",
    "/api/trace?to=1;cat%20/x", "/api/trace?to=10.1.1.1;%20whoami",
    "/find?t=%3Cscript%3Eprompt(2)%3C/script%3E", "/wp-login.php", "/.env", "/admin",
    "/secret/keys", "/api/v1/auth/login", "/api/v1/auth/login", "/gone/away",
]

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


TIME = f"""timestamp_seconds({START_EPOCH} + (event_id div 1000) * 3600
    + if((event_id div 1000) % 3 = 0, (event_id % 1000) div 20, (event_id % 1000) * 3)) AS time"""
ADDRESS_NUMBER = "if(user_id % 10 < 3, user_id % 3, 3 + user_id % 21) AS ipx"
URL_NUMBER = "(event_id * 7 + user_id) % 24 AS u"

REQUEST = [
    f"if(ipx < 12, get({_array([p[0] for p in GEO_PROFILES])}, int(ipx)),"
    " concat('45.33.', ipx, '.7')) AS ip",
    f"get({_array(URLS)}, int(u)) AS url",
    """CASE WHEN u IN (21, 22) THEN 401 WHEN u IN (17, 18, 23) THEN 404 WHEN u IN (12, 13) THEN 400
       WHEN u IN (10, 14, 15) OR (u < 10 AND event_type = 'error') THEN 500 ELSE 200 END AS status""",
    "if(u IN (11, 21, 22), 'POST', 'GET') AS method",
    "if(event_id % 50 = 0, '-', string(floor(value * 100))) AS size",
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level",
]

LINES = {
    "apache": """if(event_id % 97 = 0, concat('malformed entry ', event_id),
        concat(ip, ' - - [', date_format(time, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "', method, ' ',
               url, ' HTTP/1.1" ', status, ' ', size, ' "-" "-"'))""",
    "hdfs": """concat(date_format(time, 'yyyy-MM-dd HH:mm:ss'), ' ', ip, ' ',
        if(event_id % 2 = 1, 'audit ', ''), level, ' dfs.FSNamesystem: ',
        if(event_type = 'error', 'Unauthorized read denied on', 'Allowed read of'),
        ' /warehouse/shard/', user_id)""",
    "kubernetes": """concat(date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' ', level, ' pod-',
        user_id % 6, ' ', ip, ' ',
        CASE event_type WHEN 'error' THEN 'Container tried an exploit: quota overflow'
             WHEN 'signup' THEN concat('User u', user_id, ' failed login')
             ELSE 'Probe answered in time' END)""",
    "cloudtrail": """concat(date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' ', ip, ' ',
        CASE event_type WHEN 'click' THEN 'DescribeInstances' WHEN 'view' THEN 'GetObject'
             WHEN 'signup' THEN 'CreateUser' WHEN 'purchase' THEN 'AssumeRole'
             ELSE 'DescribeDBInstances' END, ' ',
        CASE WHEN event_type = 'error' THEN 'AccessDenied'
             WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'UnauthorizedOperation'
             ELSE 'Success' END,
        if(event_id % 97 = 0, '', concat(' ',
           CASE event_type WHEN 'click' THEN 'ec2' WHEN 'view' THEN 's3' WHEN 'signup' THEN 'iam'
                WHEN 'purchase' THEN 'sts' ELSE 'rds' END, '.amazonaws.com')))""",
    "android": """concat(date_format(time, 'MM-dd HH:mm:ss'), '.', lpad(event_id % 1000, 3, '0'), ' ',
        CASE event_type WHEN 'error' THEN 'F' WHEN 'signup' THEN 'E' WHEN 'view' THEN 'W'
             WHEN 'click' THEN 'I' ELSE 'D' END,
        ' Tag', user_id % 7, '( ', 1000 + event_id % 9000, ') IP ', ip, ' ',
        if(event_type = 'error', 'Exploit blocked', 'Channel ready'))""",
}

LOG_TYPES = list(LINES)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the address, time, url and status their log line will carry."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS)
    return _as_requests(use_all_cores(events))


def _as_requests(events: DataFrame) -> DataFrame:
    return events.selectExpr("*", TIME, ADDRESS_NUMBER, URL_NUMBER).selectExpr("*", *REQUEST)


def _as_lines(requests: DataFrame, log_type: str) -> DataFrame:
    return requests.selectExpr("event_id AS line_no", f"{LINES[log_type]} AS value")


def log_lines(spark: SparkSession, sf_dir: str, log_type: str = "apache") -> DataFrame:
    """``line_no, value``: one line per event in the given format."""
    return _as_lines(requests(spark, sf_dir), log_type)


def stream_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, value`` of the web log as a stream over the files of ``events``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, since the table may be one file as well as a folder of files.
    files = f"{sf_dir}/events.{{parquet}}"
    events = spark.readStream.schema(schema).parquet(files).select(*EVENT_COLUMNS)
    return _as_lines(_as_requests(events), "apache")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, log_type, value``: every event once in each format."""
    views = [
        log_lines(spark, sf_dir, name).select(
            (F.col("line_no") * len(LOG_TYPES) + i).alias("line_no"),
            F.lit(name).alias("log_type"),
            "value",
        )
        for i, name in enumerate(LOG_TYPES)
    ]
    return reduce(DataFrame.unionByName, views)
