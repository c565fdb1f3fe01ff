"""Values that the checked code must hold too, written out on their own: a wrong one there shows as a difference."""

# --- Fixed values: line formats, as the lines of the watched logs are read ----------------
AUTH_LINE = r"(\w{3})\s+(\d+)\s+([\d:]+).*(sshd|sudo|su)\[?(\d*)\]?:\s+(.+)"
WEB_LINE = r'^([\d.]+) - .* \[([^\]]+)\] "(\w+) (\S+)[^"]*" (\d{3})( \d+)?'
KERNEL_LINE = r"^\[[\d. ]+\]\s+(.+)"
PRIORITY_LINE = r"^<(\d+)>(.+)"
TLS_JA3 = r"ja3=([a-f0-9]{32})"
TLS_SNI = r"sni=(\S+)"
TLS_VERSION = r"tls_version=(\S+)"

# --- Fixed values: what rules look for ----------------------------------------------------
ROOT_ATTEMPT = r"(invalid user root|failed.*root|root.*failed)"
ROOT_ACCEPTED = r"accepted.*root"
LOGIN_ACCEPTED = r"accepted password|accepted publickey"
TRAVERSAL = r"\.\./|%2e%2e|etc/passwd|/proc/self"
SQL_INJECTION = (
    r"(union|select|insert|drop|delete|update|or 1=|and 1=|benchmark|sleep|waitfor|pg_sleep"
    r"|dbms_pipe|extractvalue|order by|--|/\*\*|; --|exec|xp_cmdshell|cast|chr|1' OR '1'='1"
    r"|UNION SELECT| SLEEP| DROP TABLE)"
)
BAD_JA3 = [
    ("e7d705a3286e19ea42f587b6e7359082", "Dridex"),
    ("6734f37431670b3ab4292b8f60f29984", "Trickbot"),
    ("1aa7bf845b0e18f9b627b5b36a48a553", "Cobalt Strike"),
    ("72a589da586844d7f0818ce684948eea", "Metasploit"),
    ("a0e9f5d64349fb13191bc781f81f42e1", "Generic RAT"),
]
SEVERITY_MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
SEVERITY_COLOURS = {"CRITICAL": 16711680, "HIGH": 16737792, "MEDIUM": 16755200, "LOW": 43520}
SCENARIOS = [("Network Scanning", "T1046"), ("SSH Brute Force", "T1110"), ("SQL Injection", "T1190"), ("Path Traversal", "T1083")]
# rule -> severity, category, technique, in the order of evaluation
RULE_KINDS = {
    "AUTH-001": ("HIGH", "auth", "T1110"), "AUTH-002": ("HIGH", "auth", "T1110"), "AUTH-003": ("CRITICAL", "auth", "T1078.003"),
    "AUTH-004": ("MEDIUM", "auth", "T1548.003"), "AUTH-005": ("CRITICAL", "auth", "T1110"), "AUTH-006": ("CRITICAL", "auth", "T1110"),
    "WEB-001": ("MEDIUM", "web", "T1083"), "WEB-002": ("MEDIUM", "web", "T1110"), "WEB-003": ("HIGH", "web", "T1190"),
    "WEB-004": ("CRITICAL", "web", "T1110"), "SYS-001": ("MEDIUM", "kernel", None), "SYS-002": ("LOW", "kernel", None),
    "NET-001": ("MEDIUM", "network", "T1573"), "NET-002": ("HIGH", "network", "T1071.001"), "NET-003": ("HIGH", "network", "T1071"),
}
