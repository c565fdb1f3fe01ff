"""Identifiers, texts, patterns and constants that results must carry exactly."""

# --- Cleaning and admission limits (fixed values) ---------------------------------------
MAX_LINE_CHARS = 16384
RATE_LIMIT_ROWS = 500
RATE_LIMIT_SECONDS = 5
ANSI_COLOUR = r"\x1b\[[0-9;]*m"
# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# --- Line formats (fixed values) --------------------------------------------------------
AUTH_LINE = r"(\w{3})\s+(\d+)\s+([\d:]+).*(sshd|sudo|su)\[?(\d*)\]?:\s+(.+)"
WEB_LINE = r'^([\d.]+) - .* \[([^\]]+)\] "(\w+) (\S+)[^"]*" (\d{3})( \d+)?'
KERNEL_LINE = r"^\[[\d. ]+\]\s+(.+)"
PRIORITY_LINE = r"^<(\d+)>(.+)"
IPV4_TOKEN = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
TLS_JA3 = r"ja3=([a-f0-9]{32})"
TLS_SNI = r"sni=(\S+)"
TLS_VERSION = r"tls_version=(\S+)"
PRIVATE_IP = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.)"

# --- Severities (fixed values) ----------------------------------------------------------
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_COLOURS = {"CRITICAL": 0xFF0000, "HIGH": 0xFF6600, "MEDIUM": 0xFFAA00, "LOW": 0x00AA00}
SEVERITY_MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
OTHER_COLOUR = 0x888888
OTHER_MARK = "⚪"
MESSAGE_TITLE = " SIEM Alert — "

# --- Detection rules (fixed values): id, name, description, severity, category, mitre ---
RULES = [
    ("AUTH-001", "SSH Brute Force",
     "More than 5 failed SSH login attempts from the same IP in 60 seconds.",
     "HIGH", "auth", "T1110"),
    ("AUTH-002", "Root Login Attempt",
     "Someone tried to log in as root via SSH.",
     "HIGH", "auth", "T1110"),
    ("AUTH-003", "Successful Root Login",
     "Root successfully authenticated.",
     "CRITICAL", "auth", "T1078.003"),
    ("AUTH-004", "Sudo Privilege Escalation",
     "A user ran a command with sudo.",
     "MEDIUM", "auth", "T1548.003"),
    ("AUTH-005", "SSH Brute Force — High Volume",
     "More than 10 failed SSH login attempts from the same IP in 60 seconds. Likely automated attack.",
     "CRITICAL", "auth", "T1110"),
    ("AUTH-006", "Successful Login After Failures",
     "Successful authentication after repeated failures — possible credential compromise.",
     "CRITICAL", "auth", "T1110"),
    ("WEB-001", "HTTP Scanner / Directory Traversal",
     "Request path contains traversal patterns.",
     "MEDIUM", "web", "T1083"),
    ("WEB-002", "Web Brute Force (4xx Flood)",
     "More than 20 HTTP 4xx responses from the same IP in 60 seconds.",
     "MEDIUM", "web", "T1110"),
    ("WEB-003", "SQL Injection Attempt",
     "SQL injection patterns detected in path/query/full URI (handles URL-encoded payloads).",
     "HIGH", "web", "T1190"),
    ("WEB-004", "Web Brute Force — High Volume",
     "More than 50 HTTP 4xx responses from the same IP in 60 seconds. CRITICAL threshold.",
     "CRITICAL", "web", "T1110"),
    ("SYS-001", "OOM Killer Activated",
     "The Linux kernel killed a process due to out-of-memory.",
     "MEDIUM", "kernel", None),
    ("SYS-002", "Segmentation Fault",
     "A process crashed with a segfault.",
     "LOW", "kernel", None),
    ("NET-001", "Deprecated TLS Version Detected",
     "A TLS session was negotiated using TLS 1.0 (0x0301) or TLS 1.1 (0x0302). "
     "These versions have known cryptographic weaknesses (BEAST, POODLE) "
     "and their presence is a compliance finding under NIST SP 800-52r2 and PCI DSS.",
     "MEDIUM", "network", "T1573"),
    ("NET-002", "High-Entropy SNI — Potential DGA Domain",
     "The SNI field contains a high-entropy hostname characteristic of "
     "Domain Generation Algorithm (DGA) malware used to randomise C2 domains "
     "and evade static blocklists.",
     "HIGH", "network", "T1071.001"),
    ("NET-003", "Known Malicious JA3 Fingerprint",
     "The TLS Client Hello matches a JA3 fingerprint associated with "
     "known malware families (Dridex, Trickbot, Cobalt Strike, Metasploit). "
     "JA3 hashes the TLS handshake parameters to fingerprint the client implementation.",
     "HIGH", "network", "T1071"),
]

# --- Rule patterns and thresholds (fixed values) ----------------------------------------
ROOT_ATTEMPT = r"(invalid user root|failed.*root|root.*failed)"
ROOT_ACCEPTED = r"accepted.*root"
LOGIN_ACCEPTED = r"accepted password|accepted publickey"
TRAVERSAL = r"\.\./|%2e%2e|etc/passwd|/proc/self"
SQL_INJECTION = (
    r"(union|select|insert|drop|delete|update|or 1=|and 1=|benchmark|sleep|waitfor|pg_sleep"
    r"|dbms_pipe|extractvalue|order by|--|/\*\*|; --|exec|xp_cmdshell|cast|chr|1' OR '1'='1"
    r"|UNION SELECT| SLEEP| DROP TABLE)"
)
TLS_MARKER = "TLS_EVENT"
DEPRECATED_TLS_HEX = ["0x0301", "0x0302"]
DEPRECATED_TLS_TEXT = r"^TLSv1($|\.1)"
SNI_ENTROPY_LIMIT = 3.8
BAD_JA3 = [
    ("e7d705a3286e19ea42f587b6e7359082", "Dridex"),
    ("6734f37431670b3ab4292b8f60f29984", "Trickbot"),
    ("1aa7bf845b0e18f9b627b5b36a48a553", "Cobalt Strike"),
    ("72a589da586844d7f0818ce684948eea", "Metasploit"),
    ("a0e9f5d64349fb13191bc781f81f42e1", "Generic RAT"),
]
WINDOW_SECONDS = 60
FOLLOWUP_SECONDS = 300
SSH_FAILURES = 5
LOGIN_FAILURES = 10
FOLLOWUP_FAILURES = 3
WEB_4XX = 20
WEB_4XX_HIGH = 50
UNKNOWN_KEY = "unknown"

# --- Private-network location (fixed values) --------------------------------------------
INTERNAL_COUNTRY = "Internal"
INTERNAL_CITY = "Private Network"
INTERNAL_ISP = "N/A"

# --- Network signatures (fixed values):
#     sid, message, protocol, port, field, pattern, ignore case, negated, class ----------
SIGNATURES = [
    (1001, "SQLi - UNION SELECT", "http", 5000, "http_uri", "union", True, False, "attempted-admin"),
    (1002, "SQLi - OR 1=1", "http", 5000, "http_uri", "or 1=1", True, False, "attempted-admin"),
    (1003, "SQLi - UNION ALL SELECT", "http", 5000, "http_uri", "union all", True, False, "attempted-admin"),
    (1004, "SQLi - DROP TABLE", "http", 5000, "http_uri", "drop table", True, False, "attempted-admin"),
    (1005, "SQLi - Benchmark Sleep", "http", 5000, "http_uri", "benchmark", True, False, "attempted-admin"),
    (1006, "SQLi - WAITFOR DELAY", "http", 5000, "http_uri", "waitfor delay", True, False, "attempted-admin"),
    (1007, "SQLi - Comment Injection", "http", 5000, "http_uri", "--", False, False, "attempted-admin"),
    (2001, "Dir Traversal - ../", "http", 5000, "http_uri", "../", True, False, "attempted-admin"),
    (2002, "Dir Traversal - encoded ../", "http", 5000, "http_uri", "%2e%2e%2f", True, False, "attempted-admin"),
    (2003, "Dir Traversal - etc/passwd", "http", 5000, "http_uri", "/etc/passwd", True, False, "attempted-admin"),
    (2004, "Dir Traversal - proc/self", "http", 5000, "http_uri", "/proc/self", True, False, "attempted-admin"),
    (3001, "Cmd Injection - Pipe", "http", 5000, "http_uri", "|", False, False, "attempted-admin"),
    (3002, "Cmd Injection - Backtick", "http", 5000, "http_uri", "`", False, False, "attempted-admin"),
    (3003, "Cmd Injection - Dollar Paren", "http", 5000, "http_uri", "$(", False, False, "attempted-admin"),
    (3004, "Cmd Injection - Semicolon", "http", 5000, "http_uri", ";", False, False, "attempted-admin"),
    (4001, "Nikto Scanner", "http", None, "user_agent", "Nikto", True, False, "attempted-recon"),
    (4002, "sqlmap Scanner", "http", None, "user_agent", "sqlmap", True, False, "attempted-recon"),
    (4003, "Nessus Scanner", "http", None, "user_agent", "Nessus", True, False, "attempted-recon"),
    (5001, "Nmap in User-Agent", "http", None, "user_agent", "Nmap", True, False, "attempted-recon"),
    (5002, "ICMP Echo Request - Possible Ping Scan", "icmp", None, "icmp_type", "8", False, False, "attempted-recon"),
    (5003, "TCP SYN Scan - SYN Flag", "tcp", None, "tcp_flags", "S", False, False, "attempted-recon"),
    (5005, "TCP FIN Scan - FIN Flag Set", "tcp", None, "tcp_flags", "F,12", False, False, "attempted-recon"),
    (5006, "TCP XMAS Scan - FPU Flags", "tcp", None, "tcp_flags", "FPU", False, False, "attempted-recon"),
    (6001, "Unusual HTTP User-Agent", "http", None, "user_agent", "Mozilla", False, True, "attempted-recon"),
    (6002, "SSH Version Detection", "tcp", None, "payload", "SSH-", False, False, "attempted-recon"),
]
TCP_FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}
TCP_RESERVED_BITS = {"1": 128, "2": 64}

# --- Assessment scenarios (fixed values): scenario, technique ---------------------------
SCENARIOS = [
    ("Network Scanning", "T1046"),
    ("SSH Brute Force", "T1110"),
    ("SQL Injection", "T1190"),
    ("Path Traversal", "T1083"),
]

# --- Report sizes (fixed values) --------------------------------------------------------
RECENT_EVENTS = 200
RECENT_ALERTS = 100
PAGE_ROWS = 500
OVERVIEW_ALERTS = 8
TOP_ADDRESSES = 10
TOP_RULES = 20
SNAPSHOT_KEEP_DAYS = 14

# --- Watched logs (fixed values): path, source name -------------------------------------
WATCHED_LOGS = [
    ("/var/log/auth.log", "auth"),
    ("/var/log/syslog", "syslog"),
    ("/var/log/apache2/access.log", "apache"),
    ("/var/log/nginx/access.log", "nginx"),
    ("logs/flask_access.log", "flask"),
    ("suricata-logs/eve.json", "suricata"),
]
