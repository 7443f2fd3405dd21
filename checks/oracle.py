"""The same results as DuckDB SQL on the sample tables."""

from __future__ import annotations

from logwarden.functions import fixed_values as V
from logwarden.sources import samples as S


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _value(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return _text(value)
    return f"{value}::DOUBLE" if isinstance(value, float) else str(value)


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in rows)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


REQUESTS = f"""
base AS (
  SELECT *, event_id // 1000 AS blk, event_id % 1000 AS pos, (event_id * 7 + user_id) % 24 AS u,
    CASE WHEN user_id % 10 < 3 THEN user_id % 3 ELSE 3 + user_id % 21 END AS ipx
  FROM events),
timed AS (
  SELECT *, TIMESTAMP '2026-05-21 00:00:00'
      + to_seconds(blk * 3600 + CASE WHEN blk % 3 = 0 THEN pos // 20 ELSE pos * 3 END) AS t,
    CASE WHEN ipx < 12 THEN {_list([p[0] for p in V.GEO_PROFILES])}[ipx + 1]
         ELSE '45.33.' || ipx || '.7' END AS rip,
    {_list(S.URLS)}[u + 1] AS rurl,
    CASE WHEN u IN (21, 22) THEN 401 WHEN u IN (17, 18, 23) THEN 404 WHEN u IN (12, 13) THEN 400
         WHEN u IN (10, 14, 15) OR (u < 10 AND event_type = 'error') THEN 500 ELSE 200 END AS rstatus,
    CASE WHEN u IN (11, 21, 22) THEN 'POST' ELSE 'GET' END AS rmethod,
    CASE WHEN event_id % 50 = 0 THEN '-' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END
      AS rsize,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS lvl
  FROM base)"""

APACHE_LINES = (
    REQUESTS
    + """,
lines AS (
  SELECT event_id AS line_no,
    CASE WHEN event_id % 97 = 0 THEN 'malformed entry ' || event_id
         ELSE rip || ' - - [' || strftime(t, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || rmethod || ' '
           || rurl || ' HTTP/1.1" ' || rstatus || ' ' || rsize || ' "-" "-"' END AS value
  FROM timed)"""
)

_LINE_SQL = {
    "apache": "SELECT line_no, value FROM lines",
    "hdfs": """SELECT event_id AS line_no, strftime(t, '%Y-%m-%d %H:%M:%S') || ' ' || rip || ' '
      || CASE WHEN event_id % 2 = 1 THEN 'audit ' ELSE '' END || lvl || ' dfs.FSNamesystem: '
      || CASE WHEN lvl = 'ERROR' THEN 'Unauthorized read denied on' ELSE 'Allowed read of' END
      || ' /warehouse/shard/' || user_id AS value FROM timed""",
    "kubernetes": """SELECT event_id AS line_no, strftime(t, '%Y-%m-%dT%H:%M:%SZ') || ' ' || lvl
      || ' pod-' || (user_id % 6) || ' ' || rip || ' '
      || CASE lvl WHEN 'ERROR' THEN 'Container tried an exploit: quota overflow'
                  WHEN 'WARN' THEN 'User u' || user_id || ' failed login'
                  ELSE 'Probe answered in time' END AS value FROM timed""",
    "cloudtrail": """SELECT event_id AS line_no, strftime(t, '%Y-%m-%dT%H:%M:%SZ') || ' ' || rip || ' '
      || CASE event_type WHEN 'click' THEN 'DescribeInstances' WHEN 'view' THEN 'GetObject'
           WHEN 'signup' THEN 'CreateUser' WHEN 'purchase' THEN 'AssumeRole'
           ELSE 'DescribeDBInstances' END || ' '
      || CASE WHEN event_type = 'error' THEN 'AccessDenied'
              WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'UnauthorizedOperation'
              ELSE 'Success' END
      || CASE WHEN event_id % 97 = 0 THEN '' ELSE ' ' ||
           CASE event_type WHEN 'click' THEN 'ec2' WHEN 'view' THEN 's3' WHEN 'signup' THEN 'iam'
             WHEN 'purchase' THEN 'sts' ELSE 'rds' END || '.amazonaws.com' END AS value FROM timed""",
    "android": """SELECT event_id AS line_no, strftime(t, '%m-%d %H:%M:%S') || '.'
      || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' '
      || CASE event_type WHEN 'error' THEN 'F' WHEN 'signup' THEN 'E' WHEN 'view' THEN 'W'
           WHEN 'click' THEN 'I' ELSE 'D' END
      || ' Tag' || (user_id % 7) || '( ' || (1000 + event_id % 9000) || ') IP ' || rip || ' '
      || CASE WHEN event_type = 'error' THEN 'Exploit blocked' ELSE 'Channel ready' END
      AS value FROM timed""",
}

MIXED = (
    APACHE_LINES
    + ",\nmixed AS ("
    + " UNION ALL ".join(
        f"SELECT line_no * 5 + {i} AS line_no, '{name}' AS log_type, value FROM ({_LINE_SQL[name]})"
        for i, name in enumerate(S.LOG_TYPES)
    )
    + ")"
)


def _groups(pattern: str, n: int) -> str:
    names = "[" + ", ".join(f"'g{i + 1}'" for i in range(n)) + "]"
    return (
        f"regexp_extract(value, {_text(pattern)}, {names}) AS g, "
        f"regexp_matches(value, {_text(pattern)}) AS ok"
    )


def _epoch(expression: str) -> str:
    return f"CAST(epoch({expression}) AS BIGINT)"


APACHE_EPOCH = _epoch("strptime(timestamp, '%d/%b/%Y:%H:%M:%S %z')")

PARSED = (
    APACHE_LINES
    + f""",
matched AS (SELECT line_no, value, {_groups(V.APACHE_STRICT, 7)} FROM lines),
fields AS (
  SELECT line_no, 'Apache' AS log_type, g.g1 AS ip, g.g2 AS timestamp, g.g3 AS method, g.g4 AS url,
    g.g5 AS protocol, CAST(g.g6 AS INTEGER) AS status,
    CASE WHEN g.g7 = '-' THEN 0 ELSE TRY_CAST(g.g7 AS BIGINT) END AS size
  FROM matched WHERE ok),
parsed AS (
  SELECT *, {APACHE_EPOCH} AS second, url_decode(url_decode(url)) AS decoded_url FROM fields)"""
)

COUNTED = (
    PARSED
    + """,
logins AS (
  SELECT *, CASE WHEN (contains(lower(decoded_url), 'login') OR contains(lower(decoded_url), 'auth'))
      AND status IN (401, 403) THEN 1 ELSE 0 END AS failed FROM parsed),
counted AS (
  SELECT *,
    CAST(count(*) OVER (PARTITION BY ip ORDER BY second RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY ip, second ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND
          UNBOUNDED FOLLOWING) AS BIGINT) AS requests_10s,
    CAST(sum(failed) OVER (PARTITION BY ip ORDER BY second RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)
      - coalesce(sum(failed) OVER (PARTITION BY ip, second ORDER BY line_no ROWS BETWEEN 1 FOLLOWING
          AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS failed_logins_60s
  FROM logins)"""
)

_SIGNATURE = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(decoded_url, {_text(p)}, 'i') THEN {_text(n)}"
        for n, p in V.ATTACK_SIGNATURES
    )
    + " END"
)
_SENSITIVE = f"regexp_matches(decoded_url, {_text('|'.join(V.SENSITIVE_PATHS))}, 'i')"
_PRIVILEGED = (
    "((" + " OR ".join(f"contains(decoded_url, {_text(p)})" for p in V.PRIVILEGED_PARTS)
    + ") AND status = 200)"
)

RULED = (
    COUNTED
    + f""",
tested AS (
  SELECT *, {_SIGNATURE} AS signature, {_SENSITIVE} AS sensitive, {_PRIVILEGED} AS privileged
  FROM counted),
numbered AS (
  SELECT *, CASE WHEN requests_10s > 30 THEN 1 WHEN failed_logins_60s >= 5 THEN 2
      WHEN signature IS NOT NULL THEN 3 WHEN sensitive THEN 4 WHEN privileged THEN 5
      WHEN status = 404 THEN 6 WHEN status = 500 THEN 7 ELSE 8 END AS rule_no FROM tested),
ruled AS (
  SELECT *, rule_no NOT IN (6, 8) AS is_threat,
    CASE rule_no WHEN 1 THEN 'DDoS Attempt / Flooding' WHEN 2 THEN 'Brute Force Attack'
      WHEN 3 THEN signature WHEN 4 THEN 'Web Scanner / Reconnaissance'
      WHEN 5 THEN 'Unauthorized Privilege Access' WHEN 6 THEN 'Normal (404 Not Found)'
      WHEN 7 THEN 'Server Application Error' ELSE 'Normal' END AS rule_type,
    CASE WHEN rule_no IN (2, 3) THEN 'Critical' WHEN rule_no IN (1, 5) THEN 'High'
      WHEN rule_no = 4 THEN CASE WHEN status = 200 THEN 'High' ELSE 'Medium' END
      WHEN rule_no = 7 THEN 'Medium' ELSE 'Low' END AS rule_severity,
    CAST(CASE rule_no WHEN 1 THEN 0.85 WHEN 2 THEN 0.95 WHEN 3 THEN 0.98
      WHEN 4 THEN CASE WHEN status = 200 THEN 0.75 ELSE 0.5 END WHEN 5 THEN 0.8 WHEN 6 THEN 0.15
      WHEN 7 THEN 0.4 ELSE 0.02 END AS DOUBLE) AS rule_score,
    CASE rule_no WHEN 1 THEN 'IP requested ' || requests_10s || ' resources in 10 seconds.'
      WHEN 2 THEN 'Detected ' || failed_logins_60s || ' failed login attempts in under 60 seconds.'
      WHEN 3 THEN 'Exploit pattern detected in request query path: ' || decoded_url
      WHEN 4 THEN 'Scanned restricted or sensitive endpoint ''' || decoded_url
        || ''' resulting in HTTP ' || status || '.'
      WHEN 5 THEN 'Successful access to sensitive, restricted admin directory.'
      WHEN 6 THEN 'Requested resources not found: ' || decoded_url
      WHEN 7 THEN 'Server responded with HTTP 500. Could indicate SQL syntax crashes or system failure.'
      ELSE 'Normal HTTP request flow.' END AS details
  FROM numbered)"""
)

GEO = f""",
profiles AS (SELECT * FROM (VALUES {_rows(V.GEO_PROFILES)})
  AS t(p_ip, p_country, p_city, p_lat, p_lon, p_bad)),
pool AS (SELECT * FROM (VALUES {_rows([(i, *r) for i, r in enumerate(V.GEO_POOL)])})
  AS t(g_idx, g_country, g_city, g_lat, g_lon, g_isp))"""

_HASH = " + ".join(
    f"CAST('0x' || substr(md5(ip), {8 * i + 1}, 8) AS UHUGEINT) * {2 ** (96 - 32 * i)}::UHUGEINT"
    for i in range(4)
)


def placed(source: str, name: str) -> str:
    """CTEs that add place columns to ``source``."""
    return (
        GEO
        + f""",
hashes AS (SELECT ip, {_HASH} AS h FROM (SELECT DISTINCT ip FROM {source})),
places AS (
  SELECT ip, coalesce(p_country, g_country) AS country, coalesce(p_city, g_city) AS city,
    coalesce(p_lat, round(g_lat + (CAST(h % 200 AS INTEGER) - 100) * 0.005::DOUBLE, 4)) AS latitude,
    coalesce(p_lon, round(g_lon + (CAST((h // 16) % 200 AS INTEGER) - 100) * 0.005::DOUBLE, 4))
      AS longitude,
    CASE WHEN p_ip IS NULL THEN g_isp WHEN p_bad THEN {_text(V.ISP_MALICIOUS)}
         ELSE {_text(V.ISP_OTHER)} END AS isp
  FROM hashes LEFT JOIN profiles ON ip = p_ip JOIN pool ON g_idx = CAST(h % 13 AS INTEGER)),
{name} AS (SELECT s.*, country, city, latitude, longitude, isp FROM {source} s JOIN places USING (ip))"""
    )


_DISPLAY = "CASE {0} WHEN 'Medium' THEN 'Suspicious' WHEN 'High' THEN 'High Threat' WHEN 'Critical' THEN 'Critical' ELSE 'Normal' END"

STORE = (
    RULED
    + f""",
judged AS (
  SELECT line_no, line_no AS ingest_seq, log_type, timestamp, second, ip, method, url, protocol,
    status, size, details, rule_score AS anomaly_score, 'RDD-01' AS batch_id,
    CASE WHEN is_threat THEN 'Anomaly' ELSE 'Normal' END AS prediction,
    CASE WHEN is_threat THEN rule_severity ELSE 'Low' END AS severity,
    CASE WHEN is_threat THEN rule_type ELSE 'Normal' END AS threat_type,
    {_DISPLAY.format("(CASE WHEN is_threat THEN rule_severity ELSE 'Low' END)")} AS display_severity
  FROM ruled)"""
    + placed("judged", "store")
)

SEVERITY_COUNTS = """count(*) FILTER (display_severity = 'Normal') AS normal,
  count(*) FILTER (display_severity = 'Suspicious') AS suspicious,
  count(*) FILTER (display_severity = 'High Threat') AS high_threat,
  count(*) FILTER (display_severity = 'Critical') AS critical"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _store(select: str) -> str:
    return _with(STORE, select)


def _format(name: str, ctes: str, fields: str, epoch: str) -> str:
    """A format's parsed columns, from its lines."""
    lines = f"{APACHE_LINES}, raw AS ({_LINE_SQL[name]}), matched AS ({ctes})"
    return _with(
        lines + f", fields AS (SELECT line_no, {fields} FROM matched WHERE ok)",
        f"SELECT *, {epoch} AS second FROM fields",
    )


def _percent(part: str, whole: str, digits: int) -> str:
    return f"CASE WHEN {whole} > 0 THEN round({part} / {whole} * 100, {digits}) ELSE 0.0 END"


RECORD_COLUMNS = "log_type, timestamp, ip, method, url, status"

_FORMAT_FIELDS = {
    "hdfs": (
        f"SELECT line_no, {_groups(V.HDFS_LINE, 5)} FROM raw",
        """'HDFS' AS log_type, g.g1 AS timestamp, g.g2 AS ip, 'HDFS_OP' AS method,
        CASE WHEN contains(g.g5, '/') THEN list_last(string_split(g.g5, ' ')) ELSE '/hdfs/root' END AS url,
        CASE WHEN g.g3 = 'ERROR' THEN 500 WHEN contains(lower(g.g5), 'unauthorized')
          OR contains(lower(g.g5), 'denied') THEN 403 ELSE 200 END AS status""",
        _epoch("CAST(timestamp AS TIMESTAMP)"),
    ),
    "kubernetes": (
        f"SELECT line_no, {_groups(V.KUBERNETES_LINE, 5)} FROM raw",
        """'Kubernetes' AS log_type, g.g1 AS timestamp, g.g4 AS ip, 'K8S_REQ' AS method,
        '/pods/' || g.g3 AS url,
        CASE WHEN regexp_matches(lower(g.g5), 'fail|exploit|unauthorized') THEN 401
          WHEN g.g2 = 'INFO' THEN 200 ELSE 400 END AS status""",
        _epoch("strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')"),
    ),
    "cloudtrail": (
        "SELECT line_no, string_split(value, ' ') AS g, len(string_split(value, ' ')) >= 5 AS ok FROM raw",
        """'CloudTrail' AS log_type, g[1] AS timestamp, g[2] AS ip, g[3] AS method, g[5] AS url,
        CASE WHEN contains(g[4], 'Denied') OR contains(g[4], 'Unauthorized') THEN 403 ELSE 200 END
          AS status""",
        _epoch("strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')"),
    ),
    "android": (
        f"SELECT line_no, {_groups(V.ANDROID_LINE, 6)} FROM raw",
        """'Android' AS log_type, '2026-' || g.g1 AS timestamp, g.g5 AS ip, 'ANDROID_' || g.g2 AS method,
        '/app/' || g.g3 AS url, CASE WHEN g.g2 IN ('E', 'F') THEN 500 ELSE 200 END AS status""",
        "CAST(floor(epoch(CAST(timestamp AS TIMESTAMP))) AS BIGINT)",
    ),
}

_NATIVE = {
    "apache": "FALSE AS flag, '' AS lvl, 'Normal' AS name, 0.05 AS score",
    "hdfs": f"""regexp_matches(lower(g.g5), 'unauthorized|denied') AS flag, g.g3 AS lvl,
      'Unauthorized Access' AS name, 0.85 AS score""",
    "kubernetes": """regexp_matches(lower(g.g5), 'fail|exploit|unauthorized') AS flag, g.g2 AS lvl,
      'Pod Bruteforce' AS name, 0.92 AS score""",
    "cloudtrail": """contains(g[4], 'Denied') OR contains(g[4], 'Unauthorized') AS flag, '' AS lvl,
      'IAM Privilege Escalation' AS name, 0.95 AS score""",
    "android": """g.g2 IN ('E', 'F') OR regexp_matches(lower(g.g6), 'exploit|malware') AS flag,
      g.g2 AS lvl, 'Logcat Malware Warning' AS name, 0.88 AS score""",
}
_MATCHED = {
    "apache": f"SELECT line_no, {_groups(V.APACHE_STRICT, 7)} FROM raw",
    **{name: parts[0] for name, parts in _FORMAT_FIELDS.items()},
}
_SHOWN = {
    "apache": "Apache", "hdfs": "HDFS", "kubernetes": "Kubernetes", "cloudtrail": "CloudTrail",
    "android": "Android",
}


def _native_threats() -> str:
    parts = []
    for i, name in enumerate(S.LOG_TYPES):
        matched = _MATCHED[name].replace("FROM raw", f"FROM ({_LINE_SQL[name]})")
        parts.append(
            f"SELECT line_no * 5 + {i} AS line_no, '{_SHOWN[name]}' AS log_type, {_NATIVE[name]} "
            f"FROM ({matched}) WHERE ok"
        )
    return _with(
        APACHE_LINES + ", flags AS (" + " UNION ALL ".join(parts) + ")",
        """SELECT line_no, log_type, CASE WHEN flag THEN name ELSE 'Normal' END AS threat_type,
          CASE WHEN flag AND (log_type = 'CloudTrail' OR (log_type = 'Kubernetes' AND lvl = 'ERROR'))
                 THEN 'Critical'
               WHEN flag THEN 'High Threat'
               WHEN log_type = 'HDFS' AND lvl = 'WARN' THEN 'Suspicious' ELSE 'Normal' END AS severity,
          CASE WHEN flag THEN 'Anomaly' ELSE 'Normal' END AS prediction,
          CAST(score AS DOUBLE) AS score FROM flags""",
    )


def _parsed_all() -> str:
    """CTE ``records``: every format's parsed rows."""
    parts = [
        f"SELECT line_no * 5 AS line_no, {RECORD_COLUMNS}, size FROM parsed"
    ]
    for i, name in enumerate(S.LOG_TYPES):
        if name == "apache":
            continue
        matched, fields, _ = _FORMAT_FIELDS[name]
        matched = matched.replace("FROM raw", f"FROM ({_LINE_SQL[name]})")
        parts.append(
            f"SELECT line_no * 5 + {i} AS line_no, {RECORD_COLUMNS}, CAST(NULL AS BIGINT) AS size "
            f"FROM (SELECT line_no, {fields} FROM ({matched}) WHERE ok)"
        )
    return ", records AS (" + " UNION ALL ".join(parts) + ")"


LENIENT = f"""WITH {APACHE_LINES.strip()}, matched AS (
  SELECT line_no, {_groups(V.APACHE_LENIENT, 7)} FROM lines),
fields AS (
  SELECT line_no, g.g1 AS ip, g.g2 AS timestamp, g.g3 AS method,
    CASE WHEN g.g4 = '' THEN '/' ELSE g.g4 END AS url,
    CASE WHEN g.g5 = '' THEN 'HTTP/1.1' ELSE g.g5 END AS protocol, CAST(g.g6 AS INTEGER) AS status,
    CASE WHEN g.g7 = '-' THEN 0 ELSE TRY_CAST(g.g7 AS BIGINT) END AS size FROM matched WHERE ok)
SELECT *, {APACHE_EPOCH} AS second FROM fields"""

TERMS = (
    APACHE_LINES
    + r""",
words AS (SELECT line_no, regexp_extract_all(lower(value), '\w+') AS w FROM lines),
terms AS (
  SELECT line_no, unnest(w) AS term FROM words
  UNION ALL
  SELECT line_no, w[i] || ' ' || w[i + 1] AS term
  FROM (SELECT line_no, w, unnest(range(1, len(w))) AS i FROM words))"""
)

LOG_ROW = """ingest_seq, timestamp, ip, method, url, status, size, severity, prediction,
  anomaly_score, country, city, latitude, longitude"""
GEO_ROW = """ingest_seq, timestamp, ip, country, city, isp, latitude, longitude, display_severity,
  threat_type, method, url, status, size, prediction, anomaly_score"""

KPI = f"""SELECT count(*) AS total_logs, count(*) FILTER (prediction = 'Anomaly') AS total_anomalies,
  count(*) FILTER (status >= 400) AS failed_requests,
  count(*) FILTER (severity IN ('High', 'Critical')) AS high_severity_alerts"""

CLUSTERS = f"""clusters AS (
  SELECT ip, count(*) AS count, {SEVERITY_COUNTS},
    max_by({{'s': display_severity, 't': threat_type, 'ts': timestamp, 'm': method, 'u': url,
      'st': status, 'a': anomaly_score}},
      (CASE display_severity WHEN 'Normal' THEN 0 WHEN 'Suspicious' THEN 1 WHEN 'High Threat' THEN 2
       ELSE 3 END) * 1000000000000 + ingest_seq) AS w,
    max_by({{'c': country, 'ci': city, 'i': isp, 'la': latitude, 'lo': longitude, 's': size,
      'p': prediction}}, ingest_seq) AS l
  FROM store GROUP BY ip),
flat_clusters AS (
  SELECT ip, count, normal, suspicious, high_threat, critical, w.s AS display_severity,
    w.t AS threat_type, w.ts AS timestamp, w.m AS method, w.u AS url, w.st AS status,
    w.a AS anomaly_score, l.c AS country, l.ci AS city, l.i AS isp, l.la AS latitude,
    l.lo AS longitude, l.s AS size, l.p AS prediction FROM clusters)"""

LATEST_100 = "latest AS (SELECT * FROM store WHERE prediction = 'Anomaly' ORDER BY ingest_seq DESC LIMIT 100)"

RULE_ROW = """line_no, is_threat, rule_type AS threat_type, rule_severity AS severity,
  rule_score AS score, details"""

# The model verdict the fusion check uses: flagged when the size is a multiple of 7.
MODEL_FLAG = "(size % 7 = 0)"
MODEL_SCORE = "((size % 10007) / 10007.0::DOUBLE)"

ORACLE: dict[str, str] = {
    # --- parsing
    "parse_apache_strict": _with(
        PARSED,
        "SELECT line_no, ip, timestamp, method, url, protocol, status, size, second FROM parsed",
    ),
    "parse_apache_lenient": LENIENT,
    **{f"parse_{name}": _format(name, *parts) for name, parts in _FORMAT_FIELDS.items()},
    "parse_fallback": _with(
        PARSED
        + _parsed_all()
        + MIXED[len(APACHE_LINES) :]
        + """, failed AS (SELECT m.* FROM mixed m ANTI JOIN records r ON m.line_no = r.line_no)""",
        f"""SELECT line_no, log_type, ip, method, url, status, coalesce(size, -1) AS size,
          FALSE AS is_fallback FROM records
        UNION ALL
        SELECT line_no, upper(substr(log_type, 1, 1)) || substr(log_type, 2),
          CASE WHEN contains(value, '82.102') THEN '82.102.23.45' ELSE '127.0.0.1' END, 'GET',
          CASE WHEN contains(value, '/') THEN '/api/system' ELSE '/index.html' END, 200,
          length(value), TRUE FROM failed""",
    ),
    "native_threats": _native_threats(),
    "rebuild_line": _with(
        PARSED + _parsed_all(),
        """SELECT line_no, CASE log_type
          WHEN 'Apache' THEN ip || ' - - [' || timestamp || '] "' || method || ' ' || url
            || ' HTTP/1.1" ' || status || ' ' || size || ' "-" "-"'
          WHEN 'HDFS' THEN timestamp || ' ' || ip || ' INFO dfs.FSNamesystem: Access ' || url
          WHEN 'Kubernetes' THEN timestamp || ' INFO pod ' || ip || ' ' || url || ' success'
          WHEN 'CloudTrail' THEN timestamp || ' ' || ip || ' ' || method || ' Success ' || url
          ELSE timestamp || ' I ActivityManager IP ' || ip || ' Requesting ' || url END AS line
        FROM records""",
    ),
    "url_decode_twice": _with(
        PARSED + ", urls AS (SELECT line_no AS id, 'log' AS kind, url FROM parsed UNION ALL "
        "SELECT page_id, 'page', url FROM pages)",
        "SELECT id, kind, url, url_decode(url_decode(url)) AS decoded_url FROM urls",
    ),
    "parse_event_time": _with(
        REQUESTS,
        """SELECT event_id AS line_no, 'apache' AS form, epoch_ms(t) AS millis FROM timed
        UNION ALL SELECT event_id, 'blank', epoch_ms(t) FROM timed
        UNION ALL SELECT event_id, 'iso', epoch_ms(t) FROM timed
        UNION ALL SELECT event_id, 'fraction', epoch_ms(t) + event_id % 1000 FROM timed
        UNION ALL SELECT event_id, 'junk', -1 FROM timed""",
    ),
    "display_labels": _store(
        """SELECT line_no, CASE WHEN contains(url, 'UNION') THEN 'SQLi' WHEN contains(url, 'passwd')
          THEN 'LFI' WHEN contains(url, 'login') THEN 'BruteForce' ELSE 'Scanner' END AS label,
          CASE WHEN length(url) > 25 THEN substr(url, 1, 25) || '...' ELSE url END AS short_url,
          'HTTP ' || status AS code, status >= 400 AS is_error,
          round(anomaly_score * 100, 1) AS confidence,
          strftime(make_timestamp(second * 1000000), '%H:%M:%S') AS clock FROM store"""
    ),
    # --- rules
    "flood_trailing": _with(COUNTED, "SELECT line_no, ip, requests_10s FROM counted"),
    "brute_force_trailing": _with(COUNTED, "SELECT line_no, ip, failed_logins_60s FROM counted"),
    "signature_match": _with(
        PARSED
        + ", texts AS (SELECT line_no AS id, 'log' AS kind, decoded_url FROM parsed UNION ALL "
        "SELECT doc_id, 'document', text FROM documents)",
        f"SELECT id, kind, {_SIGNATURE} AS signature FROM texts",
    ),
    "sensitive_path": _with(PARSED, f"SELECT line_no, url, {_SENSITIVE} AS sensitive FROM parsed"),
    "rule_verdicts": _with(RULED, f"SELECT {RULE_ROW} FROM ruled"),
    "rule_verdicts_in_two_jobs": _with(RULED, f"SELECT {RULE_ROW} FROM ruled"),
    "rates_over_limit": _with(
        COUNTED,
        """SELECT line_no, requests_10s, failed_logins_60s FROM counted
        WHERE requests_10s > 30 OR failed_logins_60s >= 5""",
    ),
    "rule_summary": _with(
        RULED,
        """SELECT rule_type AS threat_type, rule_severity AS severity, count(*) AS count
        FROM ruled GROUP BY ALL""",
    ),
    "weak_labels": _with(
        RULED,
        """SELECT l.line_no, CAST(CASE WHEN r.is_threat THEN 1 ELSE 0 END AS DOUBLE) AS label
        FROM lines l LEFT JOIN ruled r USING (line_no)""",
    ),
    # --- places
    "geo_profile_join": _with(
        PARSED + GEO,
        """SELECT line_no, ip, coalesce(p_country, 'Unknown') AS country,
          coalesce(p_city, 'Unknown') AS city, coalesce(p_lat, 0.0) AS latitude,
          coalesce(p_lon, 0.0) AS longitude FROM parsed LEFT JOIN profiles ON ip = p_ip""",
    ),
    "geo_hash_fallback": _with(
        "hosts AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '.' || CAST(event_id % 251 AS VARCHAR)"
        " || '.' || event_type AS ip FROM events)" + placed("hosts", "found"),
        "SELECT ip, country, city, latitude, longitude, isp FROM found",
    ),
    "geo_threats": _store(
        f"""SELECT {GEO_ROW} FROM store WHERE contains(lower(url), 'api')
          AND lower(display_severity) = 'critical'
          AND (SELECT max(second) FROM store) - second <= 86400"""
    ),
    "top_countries": _store(
        f"""SELECT country, count(*) AS count, {SEVERITY_COUNTS},
          round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage
        FROM store WHERE prediction = 'Anomaly' GROUP BY country ORDER BY count DESC, country LIMIT 10"""
    ),
    "ip_investigation": _store(
        """SELECT ip, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
          max_by(display_severity, ingest_seq) AS display_severity, any_value(country) AS country,
          count(*) AS count, max_by(timestamp, ingest_seq) AS timestamp
        FROM store WHERE ip = '185.220.101.5' GROUP BY ip"""
    ),
    "attack_vectors": _with(
        STORE + ", " + CLUSTERS,
        """SELECT ip, latitude AS source_lat, longitude AS source_lon, 13.0827::DOUBLE AS target_lat,
          80.2707::DOUBLE AS target_lon, display_severity,
          CASE display_severity WHEN 'Critical' THEN 45 WHEN 'High Threat' THEN 30 ELSE 15 END AS range
        FROM flat_clusters WHERE display_severity <> 'Normal'""",
    ),
    "ip_clusters": _with(STORE + ", " + CLUSTERS, "SELECT * FROM flat_clusters"),
    # --- fusion
    "fuse_rules": _store(
        """SELECT line_no, prediction, severity, display_severity, threat_type, details, anomaly_score
        FROM store"""
    ),
    "fuse_verdicts": _with(
        RULED
        + f""", flagged AS (SELECT *, {MODEL_FLAG} AS flag, {MODEL_SCORE} AS points FROM ruled),
        merged AS (SELECT *, CASE WHEN NOT (flag OR is_threat) THEN 'Low' WHEN rule_severity <> 'Low'
          THEN rule_severity WHEN points >= 0.7 THEN 'High' ELSE 'Medium' END AS severity FROM flagged)""",
        f"""SELECT line_no, CASE WHEN flag OR is_threat THEN 'Anomaly' ELSE 'Normal' END AS prediction,
          severity, {_DISPLAY.format('severity')} AS display_severity,
          CASE WHEN is_threat THEN rule_type WHEN flag THEN 'ML Anomaly' ELSE 'Normal' END
            AS threat_type, details, round(points, 4) AS anomaly_score FROM merged""",
    ),
    # --- aggregates
    "verdict_counts": _store(
        """SELECT count(*) FILTER (prediction = 'Normal') AS normal,
          count(*) FILTER (prediction = 'Anomaly') AS anomaly FROM store"""
    ),
    "verdict_split": _store(
        """SELECT 'Normal Traffic' AS name, count(*) FILTER (prediction <> 'Anomaly') AS value FROM store
        UNION ALL SELECT 'Anomalies', count(*) FILTER (prediction = 'Anomaly') FROM store"""
    ),
    "severity_distribution": _store(f"SELECT {SEVERITY_COUNTS} FROM store"),
    "severity_counts": _store(
        "SELECT display_severity AS name, count(*) AS value FROM store GROUP BY 1"
    ),
    "top_attackers": _store(
        """SELECT ip, count(*) AS count FROM store WHERE prediction = 'Anomaly' GROUP BY ip
        ORDER BY count DESC, ip LIMIT 5"""
    ),
    "status_breakdown": _store("SELECT status, count(*) AS count FROM store GROUP BY status"),
    "status_labels": _store("SELECT 'HTTP ' || status AS code, count(*) AS count FROM store GROUP BY 1"),
    "top_endpoints": _store(
        "SELECT url AS endpoint, count(*) AS count FROM store GROUP BY url ORDER BY count DESC, url LIMIT 5"
    ),
    "top_ips": _with(
        PARSED, "SELECT ip, count(*) AS count FROM parsed GROUP BY ip ORDER BY count DESC, ip LIMIT 10"
    ),
    "request_trend": _store(
        """SELECT strftime(make_timestamp(second // 3600 * 3600 * 1000000), '%Y-%m-%d %H:%M') AS time,
          count(*) AS count FROM store GROUP BY 1 ORDER BY time DESC LIMIT 10"""
    ),
    "request_trend_text": _store(
        """SELECT split_part(split_part(timestamp, ' ', 1), ':', 1) AS time, count(*) AS count
        FROM store GROUP BY 1 ORDER BY time DESC LIMIT 10"""
    ),
    "line_count": _with(PARSED, "SELECT count(*) AS total_logs FROM parsed"),
    "batch_metadata": _store(
        """SELECT count(*) AS records_processed, count(*) FILTER (status = 404) AS records_filtered,
          'RDD-01' AS batch_id FROM store"""
    ),
    "dashboard_kpis": _store(
        f"""SELECT *, {_percent("total_anomalies", "total_logs", 2)} AS detection_rate,
          CASE WHEN high_severity_alerts > 20 THEN 'CRITICAL' WHEN high_severity_alerts > 5
            THEN 'WARNING' ELSE 'SECURE' END AS system_status
        FROM ({KPI},
          count(DISTINCT country) FILTER (prediction = 'Anomaly' AND country NOT IN
            ('Unknown', 'Local', 'Internal')) AS threat_countries,
          count(DISTINCT ip) FILTER (prediction = 'Anomaly') AS suspicious_ips FROM store)"""
    ),
    "anomaly_summary": _store(
        f"""SELECT *, {_percent("total_anomalies", "total_logs", 2)} AS anomaly_rate FROM (
        SELECT count(*) AS total_logs, count(*) FILTER (prediction = 'Anomaly') AS total_anomalies,
          count(*) FILTER (prediction = 'Anomaly' AND severity = 'High') AS high_severity_alerts,
          count(*) FILTER (prediction = 'Anomaly' AND severity = 'Critical') AS critical_severity_alerts
        FROM store)"""
    ),
    "anomaly_rate": _store(
        """SELECT round(count(*) FILTER (prediction = 'Anomaly') / count(*) * 100, 2) AS anomaly_rate
        FROM store"""
    ),
    "threat_map_kpis": _store(
        f"""SELECT *, {_percent("high_or_critical", "total_attacks", 1)} AS critical_ratio,
          CASE WHEN high_or_critical > 15 THEN 'CRITICAL LIMIT' WHEN high_or_critical > 5
            THEN 'WARNING ESCALATION' ELSE 'SECURE' END AS posture
        FROM (SELECT count(*) AS total_attacks,
          count(*) FILTER (display_severity IN ('High Threat', 'Critical')) AS high_or_critical,
          count(DISTINCT country) FILTER (country <> 'Unknown') AS unique_countries,
          count(DISTINCT ip) AS unique_ips FROM store)"""
    ),
    "audit_report": _store(
        """SELECT *, critical + high AS high_risk FROM (SELECT count(*) AS total,
          count(*) FILTER (prediction = 'Anomaly') AS anomalies,
          count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
          count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low,
          count(*) FILTER (threat_type = 'Web Scanner / Reconnaissance') AS scanners,
          count(*) FILTER (threat_type = 'SQL Injection') AS sqli,
          count(*) FILTER (threat_type = 'Directory Traversal / LFI') AS traversals,
          count(*) FILTER (threat_type = 'Brute Force Attack') AS brute_force
        FROM (SELECT * FROM store ORDER BY ingest_seq DESC LIMIT 500))"""
    ),
    "audit_report_all": _store(
        """SELECT *, critical + high AS high_risk FROM (SELECT count(*) AS total,
          count(*) FILTER (prediction = 'Anomaly') AS anomalies,
          count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
          count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low,
          count(*) FILTER (threat_type = 'Web Scanner / Reconnaissance') AS scanners,
          count(*) FILTER (threat_type = 'SQL Injection') AS sqli,
          count(*) FILTER (threat_type = 'Directory Traversal / LFI') AS traversals,
          count(*) FILTER (threat_type = 'Brute Force Attack') AS brute_force FROM store)"""
    ),
    "attack_label_counts": _store(
        """SELECT CASE WHEN contains(url, 'UNION') THEN 'SQLi' WHEN contains(url, 'passwd') THEN 'LFI'
          WHEN contains(url, 'login') THEN 'BruteForce' ELSE 'Scanner' END AS name, count(*) AS value
        FROM store WHERE prediction = 'Anomaly' GROUP BY 1"""
    ),
    "threat_timeline": _store(
        """SELECT split_part(timestamp, ':', 2) || ':00' AS time, count(*) AS count FROM store
        GROUP BY 1 ORDER BY time DESC LIMIT 12"""
    ),
    "top_threat_countries": _store(
        """SELECT country AS name, count(*) AS attacks FROM store WHERE country NOT IN ('', 'Unknown')
        GROUP BY 1 ORDER BY attacks DESC, name LIMIT 5"""
    ),
    "actor_profiles": _with(
        STORE + ", " + LATEST_100,
        """SELECT ip, count(*) AS count, max_by(country, ingest_seq) AS country,
          max_by(severity, ingest_seq) AS severity, max_by(details, ingest_seq) AS details
        FROM latest GROUP BY ip ORDER BY count DESC, ip LIMIT 10""",
    ),
    "latest_threat_countries": _with(
        STORE + ", " + LATEST_100,
        "SELECT country, count(*) AS count FROM latest GROUP BY country",
    ),
    "country_list": _store(
        "SELECT DISTINCT country FROM store WHERE country NOT IN ('', 'Unknown')"
    ),
    "ip_suggest": _store(
        """SELECT ip FROM store WHERE contains(lower(ip), '45.') GROUP BY ip
        ORDER BY max(ingest_seq) DESC LIMIT 5"""
    ),
    # --- filters, pages, exports
    "log_search": _store(
        f"""SELECT {LOG_ROW} FROM store WHERE (contains(lower(ip), 'login') OR contains(lower(url), 'login')
          OR contains(lower(threat_type), 'login')) AND lower(prediction) = 'anomaly'"""
    ),
    "batch_filter": _store(
        f"""SELECT {LOG_ROW} FROM store WHERE contains(lower(ip), '45.33') AND contains(lower(url), 'api')
          AND status = 500 AND contains(lower(threat_type), 'injection')"""
    ),
    "time_range_filter": _store(
        f"SELECT {LOG_ROW} FROM store WHERE (SELECT max(second) FROM store) - second <= 21600"
    ),
    "log_page": _store(f"SELECT {LOG_ROW} FROM store ORDER BY ingest_seq DESC LIMIT 50 OFFSET 100"),
    "log_page_before": _store(
        f"""SELECT {LOG_ROW} FROM store WHERE ingest_seq < 500 ORDER BY ingest_seq DESC LIMIT 50"""
    ),
    "page_counts": _store(
        """SELECT *, greatest(1, CAST(ceil(filtered_count / 25) AS BIGINT)) AS pages FROM (
        SELECT count(*) AS total, count(*) FILTER (status = 404) AS filtered_count FROM store)"""
    ),
    "latest_threats": _store(
        f"SELECT {LOG_ROW} FROM store WHERE prediction = 'Anomaly' ORDER BY ingest_seq DESC LIMIT 100"
    ),
    "keep_latest": _store(f"SELECT {LOG_ROW} FROM store ORDER BY ingest_seq DESC LIMIT 10000"),
    "last_n_series": _store(
        """SELECT ingest_seq, timestamp, CASE WHEN prediction = 'Anomaly' THEN 1 ELSE 0 END AS threats,
          1 AS count FROM store ORDER BY ingest_seq DESC LIMIT 15"""
    ),
    "export_rows": _store(
        """SELECT ip, timestamp, method, url, status, size, log_type,
          display_severity AS threat_severity, prediction, anomaly_score, country, city, batch_id
        FROM store"""
    ),
    "export_page": _store(
        """SELECT timestamp AS "Timestamp", ip AS "IP Address", method AS "Method", url AS "URL",
          status AS "Status Code", severity AS "Severity", prediction AS "Verdict",
          anomaly_score AS "Probability Score", country AS "Country" FROM store"""
    ),
    "export_map": _store(
        """SELECT timestamp AS "Timestamp", ip AS "IP Address", country AS "Country", city AS "City",
          isp AS "ISP", latitude AS "Latitude", longitude AS "Longitude",
          display_severity AS "Severity", threat_type AS "Attack Type", method AS "Method",
          url AS "URL", status AS "Status Code", anomaly_score AS "Anomaly Score" FROM store"""
    ),
    "add_missing_ip": _store(
        """, hot AS (SELECT ip, count(*) AS count FROM store
            WHERE threat_type = 'DDoS Attempt / Flooding' GROUP BY ip)
        SELECT ip, count FROM hot
        UNION ALL
        SELECT ip, count(*) AS count FROM store WHERE ip NOT IN (SELECT ip FROM hot) GROUP BY ip"""
    ),
    "merge_new_old": _with(
        PARSED + _parsed_all(),
        f"""SELECT line_no, {RECORD_COLUMNS} FROM records WHERE log_type IN ('Apache', 'Kubernetes')""",
    ),
    # --- text features
    "tfidf_terms": _with(
        TERMS,
        """SELECT term, count(*) AS term_count, count(DISTINCT line_no) AS line_count FROM terms
        GROUP BY term ORDER BY term_count DESC, term LIMIT 1000""",
    ),
    # --- streams
    "stream_ingest": _store(f"SELECT {GEO_ROW.replace('ingest_seq, ', '')} FROM store"),
    "stream_kpis": _store(
        f"""SELECT *, {_percent("total_anomalies", "total_logs", 2)} AS detection_rate FROM (
        SELECT count(*) AS total_logs, count(*) FILTER (prediction = 'Anomaly') AS total_anomalies,
          count(*) FILTER (status >= 400) AS failed_requests,
          count(*) FILTER (prediction = 'Anomaly' AND severity IN ('High', 'Critical'))
            AS high_severity_alerts FROM store)"""
    ),
    "stream_counts": _store(
        """SELECT prediction, display_severity, CASE WHEN prediction <> 'Anomaly' THEN ''
          WHEN contains(url, 'UNION') THEN 'SQLi' WHEN contains(url, 'passwd') THEN 'LFI'
          WHEN contains(url, 'login') THEN 'BruteForce' ELSE 'Scanner' END AS label, count(*) AS count
        FROM store GROUP BY ALL"""
    ),
    "stream_flood": _with(
        COUNTED, "SELECT line_no, ip, requests_10s, failed_logins_60s FROM counted"
    ),
    "stream_windows": _with(
        COUNTED,
        """SELECT 'flood' AS alert, ip, second - o AS window_start, count(*) AS count
        FROM logins, range(0, 10) AS r(o) GROUP BY ALL HAVING count(*) > 30
        UNION ALL
        SELECT 'failed logins', ip, second - o, count(*) FROM logins, range(0, 60) AS r(o)
        WHERE failed = 1 GROUP BY ALL HAVING count(*) >= 5""",
    ),
}

NUMBERED = """,
numbered AS (SELECT line_no AS id, row_number() OVER (ORDER BY line_no) - 1 AS place FROM lines)"""

_FIGURES = """
SELECT 'top_attackers' AS figure, * FROM (SELECT ip AS key, count(*) AS count FROM store
  WHERE prediction = 'Anomaly' GROUP BY ip ORDER BY count DESC, key LIMIT 5)
UNION ALL SELECT 'status_counts', CAST(status AS VARCHAR), count(*) FROM store GROUP BY status
UNION ALL SELECT 'request_trends', * FROM (SELECT strftime(to_timestamp(second - second % 3600), '%Y-%m-%d %H:%M') AS key,
  count(*) FROM store GROUP BY 1 ORDER BY key DESC LIMIT 10)
UNION ALL SELECT 'anomaly_counts', lower(v), count(*) FILTER (prediction = v) FROM store, (VALUES ('Normal'), ('Anomaly')) AS t(v) GROUP BY v
UNION ALL SELECT 'endpoint_analytics', * FROM (SELECT url AS key, count(*) AS count FROM store GROUP BY url ORDER BY count DESC, key LIMIT 5)
UNION ALL SELECT 'severity_distribution', lower(replace(v, ' ', '_')), count(*) FILTER (display_severity = v)
  FROM store, (VALUES ('Normal'), ('Suspicious'), ('High Threat'), ('Critical')) AS t(v) GROUP BY v"""

ORACLE |= {
    "scan_text_files": _with(
        APACHE_LINES + NUMBERED, "SELECT place AS line_no, value FROM lines JOIN numbered ON id = line_no"
    ),
    "latest_rows_files": _with(
        PARSED + NUMBERED,
        """SELECT place AS line_no, ip, timestamp, url, status FROM parsed JOIN numbered ON id = line_no
        ORDER BY place DESC LIMIT 100""",
    ),
    "analyze_records": _store(f"SELECT {GEO_ROW} FROM store WHERE contains(lower(url), 'api')"),
    "analyze_figures": _store(_FIGURES),
    "analyze_metadata": _store(
        """SELECT count(*) AS records_processed, count(*) FILTER (status = 404) AS records_filtered,
        'RDD-01' AS batch_id FROM store"""
    ),
    **{
        name: _store(
            """SELECT timestamp, ip, method, url, status, size, prediction, severity, threat_type,
            anomaly_score FROM store"""
        )
        for name in ("ingest_store", "rebuild_store")
    },
    "export_csv_back": ORACLE["export_rows"],
    "export_json_back": ORACLE["export_rows"],
    "append_raw_back": _with(APACHE_LINES, "SELECT value, count(*) AS count FROM lines GROUP BY value"),
    "parse_statistics": _with(
        PARSED,
        """SELECT 'total' AS figure, '' AS key, count(*) AS count FROM parsed
        UNION ALL SELECT 'status_distribution', CAST(status AS VARCHAR), count(*) FROM parsed GROUP BY status
        UNION ALL SELECT 'top_ips', * FROM (SELECT ip, count(*) AS n FROM parsed GROUP BY ip ORDER BY n DESC, ip LIMIT 10)""",
    ),
    "stream_kpis_text": ORACLE["stream_kpis"],
    "stream_counts_text": ORACLE["stream_counts"],
    "stream_flood_text": _with(
        COUNTED,
        "SELECT ip, timestamp, requests_10s, failed_logins_60s, count(*) AS count FROM counted GROUP BY ALL",
    ),
    "stream_windows_text": _with(
        COUNTED,
        """SELECT * FROM (
        SELECT 'flood' AS alert, ip, second - o AS window_start, count(*) AS count
        FROM logins, range(0, 10) AS r(o) GROUP BY ALL HAVING count(*) > 30)
        WHERE window_start + 10 <= (SELECT max(second) FROM logins) - 120
        UNION ALL SELECT * FROM (
        SELECT 'failed logins', ip, second - o AS window_start, count(*) FROM logins, range(0, 60) AS r(o)
        WHERE failed = 1 GROUP BY ALL HAVING count(*) >= 5)
        WHERE window_start + 60 <= (SELECT max(second) FROM logins WHERE failed = 1) - 120""",
    ),
}

#: What deals the lines of a log over files: the same bounds as ``registry.log_files`` for its least number of files.
_FILES = """, sizes AS (SELECT count(*) AS n, max(line_no) + 1 AS top FROM lines),
file_of AS (
  SELECT line_no AS id, (SELECT max(k) FROM range(0, 1000) AS r(k), sizes
    WHERE k < greatest(4, (n + 199999) // 200000)
      AND round_even(top * power(k / greatest(4, (n + 199999) // 200000), 1.5), 0) <= line_no) AS file
  FROM lines)"""

ORACLE |= {
    "flood_trailing_spread": _with(
        COUNTED.replace("lines AS (\n  SELECT event_id AS line_no", "lines AS (\n  SELECT event_id * 1000003 % 1073741827 AS line_no"),
        "SELECT line_no, ip, requests_10s, failed_logins_60s FROM counted",
    ),
    "log_page_view": _store(
        f"""SELECT {LOG_ROW} FROM store WHERE contains(lower(url), 'api') OR contains(lower(ip), 'api')
        OR contains(lower(threat_type), 'api') ORDER BY ingest_seq DESC LIMIT 7 OFFSET 140"""
    ),
    "stream_metadata": _with(
        PARSED + _FILES,
        """SELECT 'RDD-0' || file AS batch_id, count(*) AS records_processed, TRUE AS measured
        FROM parsed JOIN file_of ON id = line_no GROUP BY file""",
    ),
}
