"""Fixed values that results depend on: formats, patterns, lookup rows and constants."""

# --- line formats: Python-style regular expressions, anchored at the line start ---------------
APACHE_STRICT = r'^(\S+) \S+ \S+ \[([\w:/]+\s[+\-]\d{4})\] "(\S+)\s+(\S+)\s+(\S+)" (\d{3}) (\d+|-)'
APACHE_LENIENT = r'^(\S+) \S+ \S+ \[(.*?)\] "(\S+)\s?(\S+)?\s?(\S+)?" (\d{3}) (\S+)'
# The token between the address and the level is optional.
HDFS_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\S+) (?:\S+ )?(INFO|WARN|ERROR) ([\w\.]+): (.*)"
KUBERNETES_LINE = r"^(\S+) (INFO|WARN|ERROR) (\S+) (\S+) (.*)"
ANDROID_LINE = r"^(\S+ \S+) ([VDIWEF]) (\S+)\(\s*(\d+)\) IP (\S+) (.*)"
CLOUDTRAIL_MIN_PARTS = 5

APACHE_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"
ANDROID_DEFAULT_YEAR = 2026

DEFAULT_URL = "/"
DEFAULT_PROTOCOL = "HTTP/1.1"
HDFS_ROOT_URL = "/hdfs/root"

FALLBACK_MARKER = "82.102"
FALLBACK_MARKER_IP = "82.102.23.45"
FALLBACK_IP = "127.0.0.1"
FALLBACK_PATH_URL = "/api/system"
FALLBACK_PLAIN_URL = "/index.html"

# --- rule thresholds ---------------------------------------------------------------------------
FLOOD_SECONDS = 10
FLOOD_MORE_THAN = 30
FAILED_LOGIN_SECONDS = 60
FAILED_LOGIN_AT_LEAST = 5
REFUSED_STATUS = [401, 403]

# --- attack signatures, tested in this order against the decoded url, ignoring case ------------
ATTACK_SIGNATURES = [
    (
        "SQL Injection",
        r"(UNION\s+SELECT|SELECT\s+.*\s+FROM|UNION\s+ALL\s+SELECT|INSERT\s+INTO|OR\s+1\s*=\s*1"
        r"|[\'\"]\s*OR\s*[\'\"]1[\'\"]\s*=\s*[\'\"]1)",
    ),
    ("Directory Traversal / LFI", r"(\.\./|\.\.\\|\%2e\%2e\%2f|\%252e\%252e\%252f)"),
    (
        "Cross-Site Scripting (XSS)",
        r"(<script.*?>|javascript:|onload=|<img\s+src\s*=\s*[\'\"]?javascript:)",
    ),
    (
        "Command Injection",
        r"(;|&&|\|\|)\s*(cat|ls|pwd|whoami|id|wget|curl|netcat|nc|sh|bash|powershell|cmd)\s",
    ),
]

# --- sensitive paths, found anywhere in the decoded url, ignoring case -------------------------
SENSITIVE_PATHS = [
    r"/admin", r"/wp-admin", r"/wp-login\.php", r"/\.env", r"/config",
    r"/etc/passwd", r"/boot\.ini", r"/phpinfo\.php", r"/shell", r"/cmd\.exe",
    r"/\.git", r"/backup", r"/db_backup", r"/composer\.lock", r"/package-lock\.json",
    r"/jenkins", r"/phpmyadmin",
]

PRIVILEGED_PARTS = ["/root", "/admin/secure", "/secret"]

# --- rules in the order they are tested: name, is_threat, threat type (None: the signature's name),
# severity, score, details before and after the subject, subject of the details --------------------
RULES = [
    ("flood", True, "DDoS Attempt / Flooding", "High", 0.85,
     "IP requested ", " resources in 10 seconds.", "requests"),
    ("brute force", True, "Brute Force Attack", "Critical", 0.95,
     "Detected ", " failed login attempts in under 60 seconds.", "failures"),
    ("signature", True, None, "Critical", 0.98,
     "Exploit pattern detected in request query path: ", "", "url"),
    ("open path", True, "Web Scanner / Reconnaissance", "High", 0.75,
     "Scanned restricted or sensitive endpoint '", ".", "scan"),
    ("closed path", True, "Web Scanner / Reconnaissance", "Medium", 0.50,
     "Scanned restricted or sensitive endpoint '", ".", "scan"),
    ("privilege", True, "Unauthorized Privilege Access", "High", 0.80,
     "Successful access to sensitive, restricted admin directory.", "", ""),
    ("not found", False, "Normal (404 Not Found)", "Low", 0.15,
     "Requested resources not found: ", "", "url"),
    ("server error", True, "Server Application Error", "Medium", 0.40,
     "Server responded with HTTP 500. Could indicate SQL syntax crashes or system failure.", "", ""),
    ("normal", False, "Normal", "Low", 0.02, "Normal HTTP request flow.", "", ""),
]

# --- severity vocabularies: store name -> display name -----------------------------------------
SEVERITY_NAMES = [
    ("Low", "Normal"),
    ("Medium", "Suspicious"),
    ("High", "High Threat"),
    ("Critical", "Critical"),
]

# --- address profiles: ip, country, city, latitude, longitude, is_malicious --------------------
GEO_PROFILES = [
    ("185.220.101.5", "United States", "Washington", 47.75, -120.74, True),
    ("82.102.23.45", "Russia", "Moscow", 55.75, 37.61, True),
    ("103.22.200.41", "North Korea", "Pyongyang", 39.03, 125.76, True),
    ("198.51.100.12", "China", "Beijing", 39.90, 116.40, True),
    ("91.220.43.12", "Ukraine", "Kyiv", 50.45, 30.52, True),
    ("190.12.87.54", "Brazil", "Sao Paulo", -23.55, -46.63, True),
    ("89.248.167.15", "Netherlands", "Amsterdam", 52.36, 4.90, True),
    ("122.164.48.9", "India", "Chennai", 13.08, 80.27, False),
    ("203.0.113.88", "Australia", "Sydney", -33.86, 151.20, False),
    ("81.108.20.11", "United Kingdom", "London", 51.50, -0.12, False),
    ("192.168.1.15", "Local", "Localhost", 37.77, -122.41, False),
    ("10.0.0.4", "Internal", "Intranet", 37.77, -122.41, False),
]
ISP_MALICIOUS = "CyberSafe Autonomous System"
ISP_OTHER = "Local Loop ISP"

# --- fallback places, picked by md5(ip) mod 13: country, city, latitude, longitude, isp --------
GEO_POOL = [
    ("United States", "San Francisco", 37.7749, -122.4194, "Cloudflare Hub"),
    ("Germany", "Frankfurt", 50.1109, 8.6821, "Deutsche Telekom AG"),
    ("Japan", "Tokyo", 35.6762, 139.6503, "NTT Global Network"),
    ("Canada", "Toronto", 43.6532, -79.3832, "Rogers Cable Network"),
    ("France", "Paris", 48.8566, 2.3522, "Orange S.A. Transit"),
    ("Singapore", "Singapore", 1.3521, 103.8198, "Singtel Infrastructure"),
    ("South Africa", "Cape Town", -33.9249, 18.4241, "Telkom SA Core"),
    ("Netherlands", "Rotterdam", 51.9244, 4.4777, "KPN Telecom"),
    ("China", "Beijing", 39.9042, 116.4074, "China Telecom"),
    ("India", "Mumbai", 19.0760, 72.8777, "Reliance Jio Backbone"),
    ("Brazil", "Sao Paulo", -23.5505, -46.6333, "Claro Transit Gateway"),
    ("Russia", "Saint Petersburg", 59.9343, 30.3351, "Rostelecom Core"),
    ("Australia", "Sydney", -33.8688, 151.2093, "Telstra Communications"),
]
JITTER_STEPS = 200
JITTER_SIZE = 0.005
COORDINATE_DIGITS = 4

ATTACK_TARGET = (13.0827, 80.2707)
NOT_A_THREAT_COUNTRY = ["Unknown", "Local", "Internal"]

# --- seconds per named time range --------------------------------------------------------------
BATCH_TIME_RANGES = {"1h": 3600, "6h": 21600, "24h": 86400}
MAP_TIME_RANGES = {"1h": 3600, "24h": 86400, "7d": 604800}
MAP_TIME_RANGE_OTHER = 365 * 86400

# --- lines that seed a first set of models -----------------------------------------------------
BOOTSTRAP_LINES = [
    '127.0.0.1 - - [21/May/2026:10:00:01 +0000] "GET /index.html HTTP/1.1" 200 1024',
    '127.0.0.1 - - [21/May/2026:10:00:02 +0000] "GET /style.css HTTP/1.1" 200 4096',
    '127.0.0.1 - - [21/May/2026:10:00:03 +0000] "GET /js/app.js HTTP/1.1" 200 8192',
    '192.168.1.10 - - [21/May/2026:10:01:05 +0000] "POST /login HTTP/1.1" 200 512',
    '192.168.1.10 - - [21/May/2026:10:02:10 +0000] "POST /login HTTP/1.1" 401 256',
    '192.168.1.10 - - [21/May/2026:10:02:12 +0000] "POST /login HTTP/1.1" 401 256',
    '185.220.101.5 - - [21/May/2026:10:03:00 +0000] "GET /admin HTTP/1.1" 404 128',
    '185.220.101.5 - - [21/May/2026:10:03:15 +0000] "GET /wp-login.php HTTP/1.1" 404 128',
    '185.220.101.5 - - [21/May/2026:10:04:00 +0000] "GET /etc/passwd HTTP/1.1" 400 512',
    '185.220.101.5 - - [21/May/2026:10:04:30 +0000] "GET /index.php?id=1%27%20UNION%20SELECT%20NULL,username,password%20FROM%20users-- HTTP/1.1" 500 2048',
]

# Characters Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
