"""The parsers as functions of SQL: a struct of typed fields, null where the line isn't the parser's.

    select id, a.* from (select id, parse_auth(line, timestamp_ntz'2026-01-01 00:00:00') as a from lines) where a is not null

They are SQL functions of one expression, so Catalyst puts their bodies into the query: no Python worker, no join, no shuffle.
They are temporary: a session registers them once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vigilspark import domains as D


def _text(pattern: str) -> str:
    """A pattern as a raw literal of SQL."""
    if "'" in pattern:
        raise ValueError(f"a quote in {pattern}")
    return f"r'{pattern}'"


def _group(column: str, pattern: str, k: int, empty: bool = False) -> str:
    found = f"regexp_extract({column}, {_text(pattern)}, {k})"
    return found if empty else f"nullif({found}, '')"


def _utc(time: str) -> str:
    return f"convert_timezone(current_timezone(), 'UTC', cast({time} as timestamp_ntz))"


def _pairs(column: str, pattern: str) -> str:
    """Map of key=value pairs, of repeated keys the last."""
    return (
        f"map_from_entries(filter(transform(regexp_extract_all({column}, {_text(pattern)}, 0), p -> struct(substring_index(p, '=', 1) as k, substr(p, locate('=', p) + 1) as v)), "
        f"(x, i) -> not exists(slice(transform(regexp_extract_all({column}, {_text(pattern)}, 0), p -> substring_index(p, '=', 1)), i + 2, size(regexp_extract_all({column}, {_text(pattern)}, 0))), k -> k = x.k)))"
    )


def _case(column: str, values: dict[str, str], default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + f" else '{default}' end"


def _let(names: dict[str, str], body: str) -> str:
    """body, in which v.name is a value computed once however often it is used."""
    fields = ", ".join(f"'{n}', {value}" for n, value in names.items())
    return f"get(transform(array(named_struct({fields})), v -> {body}), 0)"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {value}" for n, value in fields.items()) + ")"


def _syslog_header() -> str:
    bsd, rfc = D.SYSLOG_BSD, D.SYSLOG_RFC3339
    pick = lambda b, r: f"case when v.bsd then {_group('line', bsd, b)} else {_group('line', rfc, r)} end"
    day = ", ".join(["cast(year(reference_time) as string)", *(_group("line", bsd, k, True) for k in (1, 2, 3))])
    known = {
        "bsd": f"line rlike {_text(bsd)}",
        "day": f"cast(try_to_timestamp(concat_ws(' ', {day}), 'yyyy MMM d HH:mm:ss') as timestamp_ntz)",
        "exact": _utc(f"try_cast({_group('line', rfc, 1)} as timestamp)"),
    }
    time = "case when not v.bsd then v.exact when v.day > reference_time then v.day - interval 1 year else v.day end"
    header = {"ts": time, "hostname": pick(4, 2), "service": pick(5, 3), "pid": f"try_cast({pick(6, 4)} as int)", "message": f"coalesce({pick(7, 5)}, '')"}
    return f"case when line rlike {_text(bsd)} or line rlike {_text(rfc)} then {_let(known, _struct(header))} end"


def _auth() -> str:
    """The first pattern that fits is the message's; its number picks the groups."""
    number = "case " + " ".join(f"when v.h.message rlike {_text(p[1])} then {k}" for k, p in enumerate(D.AUTH_PATTERNS)) + " else -1 end"
    each = lambda value: "case w.n " + " ".join(f"when {k} then {value(*p)}" for k, p in enumerate(D.AUTH_PATTERNS))
    group = lambda j: each(lambda name, pattern, kind, groups: _group("v.h.message", pattern, groups[j]) if groups[j] else "cast(null as string)") + " end"
    method = each(lambda name, *_: "'publickey'" if "publickey" in name else "'password'" if "password" in name else "cast(null as string)") + " end"
    is_ = lambda wanted: each(lambda name, *_: str(name == wanted).lower()) + " else false end"
    fields = {
        "ts": "v.h.ts", "hostname": "v.h.hostname", "pid": "v.h.pid",
        "pattern": each(lambda name, *_: f"'{name}'") + " end",
        "event_type": each(lambda name, pattern, kind, groups: f"'{kind}'") + " else 'other' end",
        "username": group(0), "src_ip": group(1), "port": group(2), "session_id": f"{group(1)} || ':' || {group(2)}",
        "auth_method": method, "preauth": is_("connection_closed_preauth"), "max_attempts_exceeded": is_("max_auth_attempts"),
    }
    found = f"get(transform(array(named_struct('n', {number})), w -> {_struct(fields)}), 0)"
    return _let({"h": "parse_syslog_header(line, reference_time)"}, f"case when startswith(v.h.service, 'sshd') then {found} end")


def _service_kind(cron: str, kernel: str, unit: str, message: str) -> str:
    said = lambda a, b: f"{unit} and (contains({message}, '{a}') or contains({message}, '{b}'))"
    return f"case when {cron} then 'cron' when {kernel} then 'kernel' when {said('Started', 'Starting')} then 'service_start' when {said('Stopped', 'Stopping')} then 'service_stop' else 'other' end"


def _syslog() -> str:
    kind = _service_kind("lower(v.h.service) in ('cron', 'crond')", "lower(v.h.service) = 'kernel'", "lower(v.h.service) = 'systemd'", "v.h.message")
    fields = {n: f"v.h.{n}" for n in ("ts", "hostname", "service", "pid", "message")} | {"event_type": kind}
    return _let({"h": "parse_syslog_header(line, reference_time)"}, f"case when not startswith(v.h.service, 'sshd') then {_struct(fields)} end")


def _web_access() -> str:
    g = lambda k: _group("line", D.WEB_ACCESS, k, True)
    fields = {
        "ts": _utc(f"try_to_timestamp({g(4)}, 'dd/MMM/yyyy:HH:mm:ss Z')"),
        "src_ip": g(1), "username": f"nullif({g(3)}, '-')", "method": g(5), "path": g(6), "protocol": f"trim({g(7)})",
        "status": f"try_cast({g(8)} as int)", "size": f"coalesce(try_cast({g(9)} as int), 0)", "referer": g(10), "user_agent": g(11), "session_id": g(1),
        "event_type": f"case when try_cast({g(8)} as int) >= 400 then 'http_error' else 'http_request' end",
    }
    return f"case when line rlike {_text(D.WEB_ACCESS)} then {_struct(fields)} end"


def _web_error() -> str:
    g = lambda k: _group("line", D.WEB_ERROR, k)
    fields = {
        "ts": f"cast(try_to_timestamp(concat_ws(' ', {g(6)}, {g(2)}, {g(3)}, {g(4)}), 'yyyy MMM d HH:mm:ss') as timestamp_ntz)",
        "module": g(7), "level": g(8), "pid": f"try_cast({g(9)} as int)", "src_ip": g(10), "client_port": f"try_cast({g(11)} as int)",
        "message": f"trim({_group('line', D.WEB_ERROR, 12, True)})", "session_id": g(10), "event_type": "'http_error'",
    }
    return f"case when line rlike {_text(D.WEB_ERROR)} then {_struct(fields)} end"


def _journal() -> str:
    j = lambda k: f"get_json_object(line, '$.{k}')"
    known = {"who": f"lower(coalesce({j('SYSLOG_IDENTIFIER')}, ''))", "unit": f"lower(coalesce({j('_SYSTEMD_UNIT')}, ''))", "message": f"coalesce({j('MESSAGE')}, '')"}
    kind = _service_kind("(contains(v.who, 'cron') or contains(v.unit, 'cron'))", "v.who = 'kernel'", "(contains(v.who, 'systemd') or endswith(v.unit, '.service'))", "v.message")
    time = f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(try_cast({j('__REALTIME_TIMESTAMP')} as bigint) / 1000000 as decimal(18, 6)))"
    fields = {"ts": time, "event_type": kind, "message": "v.message", "priority": f"try_cast({j('PRIORITY')} as int)", "pid": f"try_cast({j('_PID')} as int)"}
    sound = f"is_valid_utf8(line) and try_parse_json(line) is not null and line rlike {_text(JSON_OBJECT)} and coalesce({j('SYSLOG_IDENTIFIER')}, '') <> 'sshd'"
    return f"case when {sound} then {_let(known, _struct(fields))} end"


def _ebpf() -> str:
    g = lambda k: _group("line", D.EBPF_LINE, k, True)
    peer = "coalesce(v.fields['src'], v.fields['dst'])"
    fields = {
        "ts": f"try_cast(trim(trailing 'Z' from {g(1)}) as timestamp_ntz)", "event_type": g(2), "source": _case(g(2), D.SOURCE_OF_SYSCALL, "ebpf_process"), "fields": "v.fields",
        "src_ip": f"case when contains({peer}, ':') then {_group(peer, ADDRESS, 1, True)} else {peer} end",
    }
    return f"case when line rlike {_text(D.EBPF_LINE)} then {_let({'fields': _pairs(g(3), KERNEL_PAIR)}, _struct(fields))} end"


def _audit() -> str:
    time = f"cast(try_to_timestamp({_group('line', AUDIT_TIME, 1, True)}, 'MM/dd/yyyy HH:mm:ss') as timestamp_ntz)"
    known = {"fields": f"transform_values({_pairs('line', AUDIT_PAIR)}, (k, x) -> replace(x, '\"', ''))"}
    return _let(known, _struct({"type": "v.fields['type']", "ts": time, "fields": "v.fields"}))


#: key=value pairs of kernel and audit lines, times of audit records, what is before a port, JSON objects.
KERNEL_PAIR = r"\w+=\S*"
AUDIT_PAIR = r'\w+=(?:"[^"]*"|\S+)'
AUDIT_TIME = r"msg=audit\((\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})"
ADDRESS = r"^(.*):([^:]*)$"
JSON_OBJECT = r"^\s*\{"

_LINE, _DATED = "line string", "line string, reference_time timestamp_ntz"
_SYSLOG = "ts: timestamp_ntz, hostname: string, service: string, pid: int, message: string"
#: name -> (parameters, fields, body); those that others call come first.
FUNCTIONS = {
    "parse_syslog_header": (_DATED, _SYSLOG, _syslog_header),
    "parse_auth": (_DATED, "ts: timestamp_ntz, hostname: string, pid: int, pattern: string, event_type: string, username: string, src_ip: string, port: string, session_id: string, auth_method: string, preauth: boolean, max_attempts_exceeded: boolean", _auth),
    "parse_syslog": (_DATED, f"{_SYSLOG}, event_type: string", _syslog),
    "parse_web_access": (_LINE, "ts: timestamp_ntz, src_ip: string, username: string, method: string, path: string, protocol: string, status: int, size: int, referer: string, user_agent: string, session_id: string, event_type: string", _web_access),
    "parse_web_error": (_LINE, "ts: timestamp_ntz, module: string, level: string, pid: int, src_ip: string, client_port: int, message: string, session_id: string, event_type: string", _web_error),
    "parse_journal": (_LINE, "ts: timestamp_ntz, event_type: string, message: string, priority: int, pid: int", _journal),
    "parse_ebpf": (_LINE, "ts: timestamp_ntz, event_type: string, source: string, fields: map<string, string>, src_ip: string", _ebpf),
    "parse_audit": (_LINE, "type: string, ts: timestamp_ntz, fields: map<string, string>", _audit),
}


def register_parsers(spark: SparkSession) -> list[str]:
    """Make the parsers known to the session's SQL; returns their names."""
    for name, (parameters, fields, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns struct<{fields}> return {body()}")
    return list(FUNCTIONS)
