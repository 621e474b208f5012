"""Parsers: a text line to a struct of typed fields, null where the line isn't the parser's. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark import domains as D
from vigilspark.functions.encode import address, mapped, syscall_source


def _group(line: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))


def _ntz(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(text: Column, pattern: str) -> Column:
    """Map of a text's key=value pairs, of repeated keys the last."""
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.locate("=", p) + 1).alias("v"))
    later = lambda e, x, i: F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"])
    return _with(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), entry), lambda e: F.map_from_entries(F.filter(e, lambda x, i: ~later(e, x, i))))


def syslog_header(line: Column, reference_time: str) -> Column:
    """ts, hostname, service, pid, message. A BSD date takes reference_time's year, the year before if that is later."""
    bsd, rfc = line.rlike(D.SYSLOG_BSD), line.rlike(D.SYSLOG_RFC3339)
    ref = F.lit(reference_time).cast("timestamp_ntz")
    day = F.concat_ws(" ", F.year(ref).cast("string"), F.regexp_extract(line, D.SYSLOG_BSD, 1), F.regexp_extract(line, D.SYSLOG_BSD, 2), F.regexp_extract(line, D.SYSLOG_BSD, 3))
    local = _ntz(day, "yyyy MMM d HH:mm:ss")
    local = F.when(local > ref, local - F.expr("interval 1 year")).otherwise(local)
    text = _group(line, D.SYSLOG_RFC3339, 1)
    exact = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    pick = lambda b, r: F.when(bsd, _group(line, D.SYSLOG_BSD, b)).otherwise(_group(line, D.SYSLOG_RFC3339, r))
    message = F.when(bsd, F.regexp_extract(line, D.SYSLOG_BSD, 7)).otherwise(F.regexp_extract(line, D.SYSLOG_RFC3339, 5))
    header = F.struct(F.when(bsd, local).otherwise(exact).alias("ts"), pick(4, 2).alias("hostname"), pick(5, 3).alias("service"), pick(6, 4).try_cast("int").alias("pid"), message.alias("message"))
    return F.when(bsd | rfc, header)


def auth_log(header: Column) -> Column:
    """pattern, event_type, username, src_ip, port, session_id (address and port), auth_method, preauth,
    max_attempts_exceeded of an sshd message."""
    message, out, none = header["message"], F.lit(None), F.lit(None).cast("string")

    def struct(pattern: Column, kind: Column, user: Column, ip: Column, port: Column, method: Column, preauth: bool, exceeded: bool) -> Column:
        names = {"pattern": pattern, "event_type": kind, "username": user, "src_ip": ip, "port": port, "session_id": F.concat(ip, F.lit(":"), port), "auth_method": method, "preauth": F.lit(preauth), "max_attempts_exceeded": F.lit(exceeded)}
        return F.struct(*[c.alias(n) for n, c in names.items()])

    for name, pattern, kind, groups in reversed(D.AUTH_PATTERNS):
        user, ip, port = (_group(message, pattern, g) if g else F.lit(None).cast("string") for g in groups)
        method = F.lit("publickey" if "publickey" in name else "password") if "publickey" in name or "password" in name else none
        found = struct(F.lit(name), F.lit(kind), user, ip, port, method, name == "connection_closed_preauth", name == "max_auth_attempts")
        out = F.when(message.rlike(pattern), found).otherwise(out)
    return F.when(header["service"].startswith("sshd"), F.coalesce(out, struct(none, F.lit("other"), none, none, none, none, False, False)))


def syslog_event(header: Column) -> Column:
    service, message = F.lower(header["service"]), header["message"]
    start, stop = message.contains("Started") | message.contains("Starting"), message.contains("Stopped") | message.contains("Stopping")
    kind = F.when(service.isin("cron", "crond"), "cron").when(service == "kernel", "kernel").when((service == "systemd") & start, "service_start").when((service == "systemd") & stop, "service_stop").otherwise("other")
    return F.when(~header["service"].startswith("sshd"), kind)


def sudo(header: Column) -> Column:
    """sudo (whether the service is sudo), sudo_user (who called it) of a syslog line."""
    is_sudo = F.lower(header["service"]) == "sudo"
    return F.struct(F.coalesce(is_sudo, F.lit(False)).alias("sudo"), F.when(is_sudo, _group(header["message"], r"^(\S+)\s*:", 1)).alias("sudo_user"))


def web_access(line: Column) -> Column:
    """ts (UTC), src_ip, username, method, path, protocol, status, size, referer, user_agent, session_id, event_type."""
    g = lambda k: F.regexp_extract(line, D.WEB_ACCESS, k)
    ts = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(g(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).cast("timestamp_ntz"))
    status = g(8).try_cast("int")
    return F.when(
        line.rlike(D.WEB_ACCESS),
        F.struct(ts.alias("ts"), g(1).alias("src_ip"), F.nullif(g(3), F.lit("-")).alias("username"), g(5).alias("method"), g(6).alias("path"), F.trim(g(7)).alias("protocol"), status.alias("status"), F.coalesce(g(9).try_cast("int"), F.lit(0)).alias("size"), g(10).alias("referer"), g(11).alias("user_agent"), g(1).alias("session_id"), F.when(status >= 400, "http_error").otherwise("http_request").alias("event_type")),
    )


def web_error(line: Column) -> Column:
    g = lambda k: _group(line, D.WEB_ERROR, k)
    ts = _ntz(F.concat_ws(" ", g(6), g(2), g(3), g(4)), "yyyy MMM d HH:mm:ss")
    return F.when(
        line.rlike(D.WEB_ERROR),
        F.struct(ts.alias("ts"), g(7).alias("module"), g(8).alias("level"), g(9).try_cast("int").alias("pid"), g(10).alias("src_ip"), g(11).try_cast("int").alias("client_port"), F.trim(F.regexp_extract(line, D.WEB_ERROR, 12)).alias("message"), g(10).alias("session_id"), F.lit("http_error").alias("event_type")),
    )


def ebpf(line: Column) -> Column:
    """ts, event_type, source, fields (of repeated keys the last), src_ip (of src, else dst, without its port)."""
    kind = F.regexp_extract(line, D.EBPF_LINE, 2)
    ts = F.rtrim(F.regexp_extract(line, D.EBPF_LINE, 1), F.lit("Z")).try_cast("timestamp_ntz")

    def event(fields: Column) -> Column:
        ip = _with(F.coalesce(fields["src"], fields["dst"]), address)
        return F.struct(ts.alias("ts"), kind.alias("event_type"), syscall_source(kind).alias("source"), fields.alias("fields"), ip.alias("src_ip"))

    return F.when(line.rlike(D.EBPF_LINE), _with(_pairs(F.regexp_extract(line, D.EBPF_LINE, 3), r"\w+=\S*"), event))


def integers(fields: Column) -> Column:
    """The whole numbers among a record's fields, as numbers."""
    return F.map_filter(F.transform_values(fields, lambda _, v: F.when(v.rlike(r"^-?\d+$"), v.try_cast("bigint"))), lambda _, v: v.isNotNull())


def categorised(kernel: DataFrame) -> dict[str, DataFrame]:
    """Kernel rows by their source; the three kernel sources are always there."""
    return {name: kernel.filter(F.col("source") == name) for name in ("ebpf_process", "ebpf_network", "ebpf_file")}


def journal(line: Column) -> Column:
    j = lambda k: F.get_json_object(line, f"$.{k}")
    who, unit, message = F.lower(F.coalesce(j("SYSLOG_IDENTIFIER"), F.lit(""))), F.lower(F.coalesce(j("_SYSTEMD_UNIT"), F.lit(""))), F.coalesce(j("MESSAGE"), F.lit(""))
    unitish = who.contains("systemd") | unit.endswith(".service")
    start, stop = message.contains("Started") | message.contains("Starting"), message.contains("Stopped") | message.contains("Stopping")
    kind = F.when(who.contains("cron") | unit.contains("cron"), "cron").when(who == "kernel", "kernel").when(unitish & start, "service_start").when(unitish & stop, "service_stop").otherwise("other")
    us = j("__REALTIME_TIMESTAMP").try_cast("bigint")
    ts = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / 1000000).cast("decimal(18,6)"))
    ok = F.is_valid_utf8(line) & F.try_parse_json(line).isNotNull() & line.rlike(r"^\s*\{") & (F.coalesce(j("SYSLOG_IDENTIFIER"), F.lit("")) != "sshd")
    return F.when(ok, F.struct(ts.alias("ts"), kind.alias("event_type"), message.alias("message"), j("PRIORITY").try_cast("int").alias("priority"), j("_PID").try_cast("int").alias("pid")))


def audit_record(record: Column) -> Column:
    """type, ts (seconds), fields of one ausearch record; of repeated keys the last."""
    fields = F.transform_values(_pairs(record, r'\w+=(?:"[^"]*"|\S+)'), lambda _, v: F.replace(v, F.lit('"'), F.lit("")))
    ts = _ntz(F.regexp_extract(record, r"msg=audit\((\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})", 1), "MM/dd/yyyy HH:mm:ss")
    return _with(fields, lambda f: F.struct(f["type"].alias("type"), ts.alias("ts"), f.alias("fields")))


def audit_records(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n----\n|\n\s*\n"), lambda r: F.trim(r)), lambda r: r != "")


def with_audit_key(records: DataFrame, column: str, key: str = "research_exploit") -> DataFrame:
    """The rows whose parsed audit record carries the key."""
    return records.filter(F.col(f"{column}.fields")["key"] == key)


def enrich_by_pid(events: DataFrame, file: str = "path", order: str = "line_no") -> DataFrame:
    """Rows without address take the latest address and session that their pid had before in the same file."""
    w = Window.partitionBy(file, "pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("src_ip").isNotNull(), F.struct("src_ip", "session_id")), ignorenulls=True).over(w)
    take = F.col("src_ip").isNull() & F.col("pid").isNotNull()
    return events.withColumn("_seen", seen).withColumn("session_id", F.when(take, F.coalesce("session_id", "_seen.session_id")).otherwise(F.col("session_id"))).withColumn("src_ip", F.when(take, F.col("_seen.src_ip")).otherwise(F.col("src_ip"))).drop("_seen")


PARSERS: dict[str, Callable[..., Column]] = {"auth_log": auth_log, "ebpf": ebpf, "journal": journal, "syslog": syslog_event, "web_access": web_access, "web_error": web_error}


def register(name: str, parser: Callable[..., Column]) -> None:
    PARSERS[name] = parser


def get(name: str) -> Callable[..., Column]:
    if name not in PARSERS:
        raise KeyError(f"no parser {name!r}; there are {available()}")
    return PARSERS[name]


def available() -> list[str]:
    return sorted(PARSERS)
