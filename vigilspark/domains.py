"""Value domains of labelled security telemetry. Results depend on them exactly."""

SOURCES = ["auth_log", "syslog", "web_access", "web_error", "journal", "ebpf_process", "ebpf_network", "ebpf_file"]
CHANNEL_OF_SOURCE = {
    "auth_log": "auth_log", "syslog": "syslog", "web_access": "web_log", "web_error": "web_log", "journal": "syslog",
    "ebpf_process": "process_events", "ebpf_network": "network_events", "ebpf_file": "file_events",
}
KERNEL_COLUMNS = {"process_events": 8, "network_events": 7, "file_events": 6}
RISK_OF_STAGE = {"recon": 3.0, "initial_access": 5.0, "execution": 8.0, "persistence": 9.0, "exfiltration": 10.0}
PASS, ALERT, THROTTLE, BLOCK, UNBLOCK, ISOLATE = range(6)
REWARD_ON_ATTACK = {PASS: -0.5, ALERT: 0.5, THROTTLE: 0.75, BLOCK: 1.0, UNBLOCK: -0.5, ISOLATE: 0.25}
REWARD_ON_BENIGN = {PASS: 0.0, ALERT: -0.3, THROTTLE: -0.5, BLOCK: -1.0, UNBLOCK: 0.0, ISOLATE: -2.0}
ACTED = (ALERT, THROTTLE, BLOCK, ISOLATE)
ISOLATED_SOURCES = ["ebpf_network", "web_access", "web_error", "auth_log"]
SYSCALLS = ["execve", "exit", "fork", "connect", "accept", "bind", "close", "open", "write", "unlink"]  # numbered from 1
SOURCE_OF_SYSCALL = {
    "execve": "ebpf_process", "exit": "ebpf_process", "fork": "ebpf_process", "connect": "ebpf_network", "accept": "ebpf_network",
    "bind": "ebpf_network", "close": "ebpf_network", "open": "ebpf_file", "write": "ebpf_file", "unlink": "ebpf_file",
}
FLAG_BITS = {"O_RDONLY": 0, "O_WRONLY": 1, "O_RDWR": 2, "O_CREAT": 64, "O_EXCL": 128, "O_TRUNC": 512, "O_APPEND": 1024, "O_NONBLOCK": 2048}
ATTACK_TYPES = ["brute_force", "credential_stuffing", "web_exploit", "execution", "persistence", "privilege_escalation", "discovery", "exfiltration"]
ATTACK_STAGES = ["recon", "initial_access", "execution", "persistence", "exfiltration"]
MAX_SEVERITY = 3
VECTOR_SOURCES = ["auth_log", "syslog", "web_access", "web_error", "journal"]
VECTOR_EVENTS = ["auth_success", "auth_failure", "auth_invalid_user", "session_open", "session_close", "connection", "http_request", "http_error", "service_start", "service_stop", "cron", "kernel", "other"]
#: Fixed values. (pattern, event type), the first that matches counts; groups: user, ip, port (0: none).
AUTH_PATTERNS = [
    ("auth_publickey", r"^Accepted publickey for (\S+) from ([\d.]+) port (\d+)", "auth_success", (1, 2, 3)),
    ("auth_password", r"^Accepted password for (\S+) from ([\d.]+) port (\d+)", "auth_success", (1, 2, 3)),
    ("auth_failed_password", r"^Failed password for (?:invalid user )?(\S+) from ([\d.]+) port (\d+)", "auth_failure", (1, 2, 3)),
    ("invalid_user", r"^Invalid user (\S+) from ([\d.]+)(?: port (\d+))?", "auth_invalid_user", (1, 2, 3)),
    ("connection_closed_preauth", r"^Connection closed by (?:authenticating user \S+ )?([\d.]+) port (\d+) \[preauth\]", "session_close", (0, 1, 2)),
    ("disconnected", r"^Disconnected from (?:authenticating user \S+ )?([\d.]+) port (\d+)", "session_close", (0, 1, 2)),
    ("session_open", r"^pam_unix\(sshd:session\): session opened for user (\S+)", "session_open", (1, 0, 0)),
    ("session_close", r"^pam_unix\(sshd:session\): session closed for user (\S+)", "session_close", (1, 0, 0)),
    ("connection", r"^Connection from ([\d.]+) port (\d+)", "connection", (0, 1, 2)),
    ("max_auth_attempts", r"^error: maximum authentication attempts exceeded for (?:invalid user )?(\S+) from ([\d.]+)", "auth_failure", (1, 2, 0)),
]
#: Line patterns.
SYSLOG_BSD = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w-]+)(?:\[(\d+)\])?\s*:\s*(.*)$"
SYSLOG_RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z))\s+(\S+)\s+([\w-]+)(?:\[(\d+)\])?\s*:\s*(.*)$"
WEB_ACCESS = r'^([\d.]+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s*([^"]*)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
WEB_ERROR = r"^\[(\w{3})\s+(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?\s+(\d{4})\]\s+\[(?:([^:]+):)?(\w+)\]\s+\[pid\s+(\d+)\]\s*(?:\[client\s+([\d.]+):(\d+)\]\s*)?(.*)"
EBPF_LINE = r"^(\d{4}-\d{2}-\d{2}T[\d:.]+Z)\s+(\w+)\s+(.+)$"
#: Rule -> words, the first rule that matches counts.
WEB_FILTERS = {
    "path_traversal": ["../", "..%2f", "..%252f"],
    "sqli": ["union select", "union+select", "' or", "1=1", "' and", "or+1=1"],
    "xss": ["<script", "javascript:", "%3cscript"],
    "jndi": ["${jndi:", "${lower:", "%24%7bjndi"],
    "shell_access": ["/etc/passwd", "/bin/sh", "cmd.exe", "powershell"],
    "rfi": ["auto_prepend_file", "auto_append_file", "allow_url_include"],
    "exploit_paths": ["/wp-login", "/.env", "/.git/", "/phpmyadmin", "/actuator", "/xmlrpc.php", "/cgi-bin/", "/wp-admin/", "/wp-content/", "/wp-includes/"],
    "scanner_ua": ["nikto", "sqlmap", "nmap", "masscan", "zmeu", "dirbuster", "nuclei", "hydra", "gobuster"],
    "suspicious_method": ["connect ", "trace ", "propfind "],
}
AUTH_FILTERS = {
    "failed_password": ["failed password"],
    "invalid_user": ["invalid user"],
    "auth_failure": ["authentication failure"],
    "preauth_close": ["[preauth]"],
    "max_auth": ["maximum authentication attempts"],
    "input_userauth_invalid": ["input_userauth_request: invalid user"],
}
#: Fixed values. channel -> (pattern, weight); all that match add up.
KEYWORD_RULES = {
    "auth_log": [("Failed password for", 2), ("Invalid user", 2), (r"Connection closed by.*\[preauth\]", 1), ("authentication failure", 2), ("maximum authentication attempts exceeded", 3), ("Bad protocol version", 1)],
    "web_log": [(r"(?i)\$\{jndi:", 5), (r"(?i)UNION\s+SELECT", 4), (r"\.\./\.\./", 3), ("(?i)(?:nmap|nikto|sqlmap|masscan)", 3), (r'"\s*(?:4\d{2})\s', 1), ("(?:etc/passwd|etc/shadow|proc/self)", 4)],
    "process_events": [("execve.*parent_comm=(?:redis-server|nginx|apache2|java)", 5), ("execve.*parent_comm=sshd.*comm=(?:bash|sh|dash|wget|curl|python)", 3), ("execve.*comm=(?:nmap|masscan|nikto|sqlmap|hydra|john)", 4), ("execve.*comm=(?:wget|curl).*parent_comm=(?:redis-server|nginx|java)", 5), ("exit.*code=255", 1)],
    "network_events": [(r"connect.*uid=(?!0\b)\d+.*comm=(?!(?:apt|curl|wget)\b)", 1)],
    "file_events": [("open.*comm=(?:redis-server|nginx|java).*path=/etc/(?:passwd|shadow)", 4), (r"open.*comm=(?:redis-server|nginx|java).*path=/proc/\d+/cmdline", 3), ("unlink", 1)],
}
#: Fixed values. (pattern, group of the address), the first that matches counts.
FAILURE_PATTERNS = [(r"Failed password for (?:invalid user )?(\S+) from (\S+)", 2), (r"Invalid user (\S+) from (\S+)", 2), (r"authentication failure.*rhost=(\S+)", 1), (r"Connection closed by (\S+).*\[preauth\]", 1)]
