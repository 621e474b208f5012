"""Registered queries of the analytics engine, each with the same result in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark import domains as D
from vigilspark.adapter import CAMPAIGN_SQL, campaigns, event_sql, event_view
from vigilspark.functions import encode as E
from vigilspark.functions.sql_parsers import register_parsers
from vigilspark.operators import parse as P
from vigilspark.operators import prepare as R
from vigilspark.operators import validate as V
from vigilspark.operators import windows as W
from vigilspark.plans import compose as C
from vigilspark.plans.campaign import PROFILES, timing_segment
from vigilspark.scratch import scratch_path
from vigilspark.sources import files, ingest, store
from vigilspark.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
START = "2026-01-01 00:00:00"


def register(sql: str | None = None, campaigns_too: bool = False) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    """Register a function of the adapter view, and its SQL over `ev`."""

    def add(f: Callable[[DataFrame], DataFrame]) -> None:
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(event_view(spark, sf_dir))
        if sql:
            head = f"with {'recursive ' if sql.lstrip().startswith('with recursive') else ''}{event_sql()}{', ' + CAMPAIGN_SQL if campaigns_too else ''}"
            body = sql.lstrip()
            _SQL[name] = f"{head}, {body.removeprefix('with').lstrip().removeprefix('recursive ')}" if body.startswith("with") else f"{head} {body}"

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def case_sql(key: str, values: dict, default: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"case {key} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in values.items()) + f" else {default} end"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"




def us(c: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {c})")


CHANNEL = case_sql("source", D.CHANNEL_OF_SOURCE, "'syslog'")


# Scans and aggregates.
@register(f"select source, {CHANNEL} as channel, count(*) as n, count(*) filter (is_malicious = 1) as malicious, count(*) filter (is_malicious = 0) as benign, count(*) filter (is_malicious is null) as unlabelled, min(ts_us) as first_us, max(ts_us) as last_us from ev group by source")
def source_label_counts(ev):
    return ev.groupBy("source", E.channel(F.col("source")).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_malicious") == 1).alias("malicious"), F.count_if(F.col("is_malicious") == 0).alias("benign"), F.count_if(F.col("is_malicious").isNull()).alias("unlabelled"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@register("select id, source, raw_line from ev where id > 500 and source in ('auth_log', 'web_access') order by id limit 100")
def cursor_page(ev):
    return store.page(ev, 500, 100, ["auth_log", "web_access"]).select("id", "source", "raw_line")


@register("select count(*) as n from ev where id > 700")
def remaining_rows(ev):
    return store.remaining(ev, 700)


@register("select min(ts_us) as first_us, max(ts_us) as last_us from ev")
def time_range(ev):
    return store.time_range(ev).select(us("first").alias("first_us"), us("last").alias("last_us"))


@register("select distinct source from ev")
def distinct_sources(ev):
    return store.distinct_sources(ev)


@register("select coalesce(nullif(attack_type, ''), 'unknown') as pool, id, row_number() over (partition by coalesce(nullif(attack_type, ''), 'unknown') order by timestamp, id) - 1 as pos from ev where is_malicious = 1")
def attack_pools(ev):
    return store.attack_pools(ev).select("pool", "id", "pos")


@register("select id, case when parsed is null then '{\"event_type\": \"' || event_type || '\"}' else regexp_replace(parsed, '\\s*\\}\\s*$', '') || ', \"event_type\": \"' || event_type || '\"}' end as parsed from ev")
def event_type_injection(ev):
    return ev.select("id", store.with_event_type(F.col("parsed"), F.col("event_type")).alias("parsed"))


@register("select attack_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from ev where is_malicious = 1 group by attack_type")
def attack_shares(ev):
    from pyspark.sql import Window

    return ev.filter("is_malicious = 1").groupBy("attack_type").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


# Encoders.
@register(f"select id, {CHANNEL} as channel, case when is_malicious = 1 then {case_sql('attack_stage', D.RISK_OF_STAGE, '0.0')} else 0.0 end::double as true_risk from ev")
def truth(ev):
    return ev.select("id", E.channel(F.col("source")).alias("channel"), E.true_risk(F.col("is_malicious"), F.col("attack_stage")).alias("true_risk"))


FLAGS = "case id % 5 when 0 then 'O_WRONLY|O_CREAT' when 1 then 'O_RDWR | O_APPEND' when 2 then 'O_WHAT' when 3 then null else 'O_RDONLY|O_EXCL|O_TRUNC|O_NONBLOCK' end"


@register("select id, case id % 5 when 0 then 65 when 1 then 1026 when 4 then 2688 else 0 end as bits, case id % 4 when 0 then 'O_RDONLY' when 1 then 'O_WRONLY|O_CREAT' when 2 then 'O_RDWR|O_APPEND' else 'O_WRONLY|O_EXCL|O_TRUNC' end as names from ev")
def flag_bitmask(ev):
    return ev.select("id", E.flag_bits(F.expr(FLAGS)).alias("bits"), E.flag_names(F.expr("case id % 4 when 0 then 0 when 1 then 65 when 2 then 1026 else 641 end")).alias("names"))


ADDRESSES = "case id % 4 when 0 then src_ip || ':' || cast(id as string) when 1 then src_ip when 2 then '::1:22' else src_ip || ':x' end"


@register(f"with a as (select id, {ADDRESSES} as a from ev) select id, case when contains(a, ':') then regexp_extract(a, '^(.*):([^:]*)$', 1) else a end as host, case when contains(a, ':') then coalesce(try_cast(nullif(regexp_extract(a, ':(\\d+)$', 1), '') as int), 0) else 0 end as port from a")
def ip_port_split(ev):
    return ev.withColumn("a", F.expr(ADDRESSES)).select("id", E.address(F.col("a")).alias("host"), E.port(F.col("a")).alias("port"))


@register(f"with k as (select id, split_part(raw_line, ' ', 2) as k from ev where source like 'ebpf%') select id, {case_sql('k', {n: i + 1 for i, n in enumerate(D.SYSCALLS)}, '0')} as syscall, {case_sql('k', D.SOURCE_OF_SYSCALL, quoted('ebpf_process'))} as source from k")
def syscall_enum(ev):
    k = F.element_at(F.split("raw_line", " "), 2)
    return ev.filter(F.col("source").startswith("ebpf")).select("id", E.syscall_number(k).alias("syscall"), E.syscall_source(k).alias("source"))


def _index_sql(key: str, names: list[str]) -> str:
    return f"case {key} " + " ".join(f"when '{n}' then {k}::double / {len(names) - 1}" for k, n in enumerate(names)) + " end"


@register(f"select id, coalesce(is_malicious::double, -1) as h0, round(coalesce({_index_sql('attack_type', D.ATTACK_TYPES)}, -1), 5) as h1, round(coalesce({_index_sql('attack_stage', D.ATTACK_STAGES)}, -1), 5) as h2, round(coalesce(severity::double / 3, -1), 5) as h3, round(coalesce(floor(value) / 100, -1), 2) as h4 from ev")
def targets5(ev):
    t = ev.select("id", E.targets(F.col("is_malicious"), F.col("attack_type"), F.col("attack_stage"), F.col("severity"), F.floor("value")).alias("t"))
    head = lambda k, n: F.round(F.nanvl(F.col("t")[k].cast("double"), F.lit(-1.0)), n)
    return t.select("id", head(0, 5).alias("h0"), head(1, 5).alias("h1"), head(2, 5).alias("h2"), head(3, 5).alias("h3"), head(4, 2).alias("h4"))


HOUR, DOW = "(hour(timestamp) + minute(timestamp) / 60.0)", "(isodow(timestamp) - 1)"
_HOTS = " || ".join([f"case when source = '{s}' then '1' else '0' end" for s in D.VECTOR_SOURCES] + [f"case when {'event_type' if e != 'other' else 'case when event_type in (' + ', '.join(map(quoted, D.VECTOR_EVENTS)) + ') then event_type else ' + quoted('other') + ' end'} = '{e}' then '1' else '0' end" for e in D.VECTOR_EVENTS])


@register(f"select id, {_HOTS} || case when src_ip is null then '0' else '1' end || case when username is null then '0' else '1' end as hots, round(sin(2*pi()*{HOUR}/24), 4) + 0.0 as hs, round(cos(2*pi()*{HOUR}/24), 4) + 0.0 as hc, round(sin(2*pi()*{DOW}/7), 4) + 0.0 as ds, round(cos(2*pi()*{DOW}/7), 4) + 0.0 as dc from ev")
def event_vec24(ev):
    v = ev.select("id", E.event_vector(F.col("source"), F.col("event_type"), F.col("timestamp"), F.col("src_ip"), F.col("username")).alias("v"))
    bits = F.array_join(F.transform(F.concat(F.slice("v", 1, 18), F.slice("v", 23, 2)), lambda x: x.cast("int").cast("string")), "")
    return v.select("id", bits.alias("hots"), *[(F.round(F.col("v")[18 + k].cast("double"), 4) + 0.0).alias(n) for k, n in enumerate(("hs", "hc", "ds", "dc"))])


@register("select id, case id % 4 when 0 then (id % 90) * 86400.0 when 1 then (id % 90) * 3600.0 when 2 then (id % 90 + 0.5) * 60.0 else null end::double as seconds from ev")
def duration_literal(ev):
    return ev.select("id", E.duration_seconds(F.expr("case id % 4 when 0 then cast(id % 90 as string) || 'd' when 1 then cast(id % 90 as string) || ' h' when 2 then cast(id % 90 as string) || '.5m' else 'x' end")).alias("seconds"))


@register("select id, (case when id % 2 = 0 then -1 else 1 end) * ((id % 13) * 3600 + (id % 4) * 900) as seconds from ev")
def utc_offset(ev):
    return ev.select("id", E.utc_offset_seconds(F.expr("case when id % 2 = 0 then '-' else '+' end || lpad(cast(id % 13 as string), 2, '0') || lpad(cast((id % 4) * 15 as string), 2, '0')")).cast("long").alias("seconds"))


@register(r"""select id, len(t) as n, md5(array_to_string(t, ' ')) as digest from (select id, list_filter(regexp_split_to_array(raw_line, '[\s\[\]():=,"''{}]+'), lambda x: x <> '') as t from ev)""")
def tokenise(ev):
    t = ev.select("id", E.tokens(F.col("raw_line")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


# Parsers.
@register(r"""with l as (select id, regexp_extract(raw_line, '\]: (.*)$', 1) as m, cast(regexp_extract(raw_line, 'sshd\[(\d+)\]', 1) as int) as pid, raw_line, ts_us from ev where source = 'auth_log')
select id, pid, ts_us // 1000000 as ts_s, regexp_extract(raw_line, ' (host\d) ', 1) as hostname,
 case when m like 'Accepted%' then 'auth_success' when m like 'Failed%' then 'auth_failure' when m like 'Invalid%' then 'auth_invalid_user' when m like 'Connection closed%' then 'session_close' else 'session_open' end as event_type,
 nullif(regexp_extract(m, '(user\d+)', 1), '') as username, nullif(regexp_extract(m, '(?:from|by) ([\d.]+)', 1), '') as src_ip, nullif(regexp_extract(m, 'port (\d+)', 1), '') as port from l""")
def parse_auth(ev):
    d = ev.filter("source = 'auth_log'").withColumn("h", P.syslog_header(F.col("raw_line"), "2024-06-01 00:00:00"))
    d = d.withColumn("a", P.auth_log(F.col("h")))
    return d.select("id", "h.pid", F.floor(us("h.ts") / 1000000).alias("ts_s"), "h.hostname", "a.event_type", "a.username", "a.src_ip", "a.port")


#: Lines of every sshd form (id % 13), with ISO or BSD headers, and three that no parser takes.
_FORMS = """case id % 13 when 0 then 'Accepted publickey for u1 from 10.0.0.1 port 22 ssh2: RSA' when 1 then 'Accepted password for u2 from 10.0.0.2 port 23 ssh2'
 when 2 then 'Failed password for u3 from 10.0.0.3 port 24 ssh2' when 3 then 'Invalid user u4 from 10.0.0.4' when 4 then 'Connection closed by authenticating user u5 10.0.0.5 port 25 [preauth]'
 when 5 then 'Disconnected from authenticating user u6 10.0.0.6 port 26' when 6 then 'pam_unix(sshd:session): session opened for user u7 by (uid=0)' when 7 then 'pam_unix(sshd:session): session closed for user u8'
 when 8 then 'Connection from 10.0.0.9 port 27 on 10.0.0.10 port 22' when 9 then 'error: maximum authentication attempts exceeded for invalid user u9 from 10.0.0.11 port 28 ssh2' when 10 then 'Server listening on 0.0.0.0' else 'x' end"""
_FORM_LINE = f"case id % 13 when 11 then 'no header at all' when 12 then '' else case when id % 2 = 0 then 'Mar  3 04:05:06 h' else '2024-03-03T04:05:06+02:00 h' end || ' sshd' || case id % 3 when 0 then '[99999999999]' when 1 then '[77]' else '' end || ': ' || {_FORMS} end"


@register("""select id, case when id % 13 < 11 then case when id % 2 = 0 then timestamp '2024-03-03 04:05:06' else timestamp '2024-03-03 02:05:06' end end as ts, case when id % 13 < 11 and id % 3 = 1 then 77 end as pid,
 case id % 13 when 0 then 'auth_publickey' when 1 then 'auth_password' when 2 then 'auth_failed_password' when 3 then 'invalid_user' when 4 then 'connection_closed_preauth' when 5 then 'disconnected' when 6 then 'session_open' when 7 then 'session_close' when 8 then 'connection' when 9 then 'max_auth_attempts' end as pattern,
 case id % 13 when 0 then 'auth_success' when 1 then 'auth_success' when 2 then 'auth_failure' when 3 then 'auth_invalid_user' when 4 then 'session_close' when 5 then 'session_close' when 6 then 'session_open' when 7 then 'session_close' when 8 then 'connection' when 9 then 'auth_failure' when 10 then 'other' end as event_type,
 case id % 13 when 0 then 'u1' when 1 then 'u2' when 2 then 'u3' when 3 then 'u4' when 6 then 'u7' when 7 then 'u8' when 9 then 'u9' end as username,
 case id % 13 when 0 then '10.0.0.1:22' when 1 then '10.0.0.2:23' when 2 then '10.0.0.3:24' when 4 then '10.0.0.5:25' when 5 then '10.0.0.6:26' when 8 then '10.0.0.9:27' end as session_id,
 case id % 13 when 0 then 'publickey' when 1 then 'password' when 2 then 'password' end as auth_method, coalesce(id % 13 = 4, false) as preauth, coalesce(id % 13 = 9, false) as max_attempts_exceeded from ev""")
def parse_auth_forms(ev):
    d = ev.select("id", F.expr(_FORM_LINE).alias("line")).withColumn("h", P.syslog_header(F.col("line"), "2024-06-01 00:00:00")).withColumn("a", P.auth_log(F.col("h")))
    no = lambda c: F.coalesce(c, F.lit(False))
    return d.select("id", "h.ts", "h.pid", "a.pattern", "a.event_type", "a.username", "a.session_id", "a.auth_method", no(F.col("a.preauth")).alias("preauth"), no(F.col("a.max_attempts_exceeded")).alias("max_attempts_exceeded"))


@register("select id, user_id % 3 = 0 as sudo, case when user_id % 3 = 0 then 'user' || user_id end as sudo_user from ev")
def parse_sudo(ev):
    line = F.expr("'2024-03-03T04:05:06Z h ' || case when user_id % 3 = 0 then 'sudo' else 'su' end || ': user' || cast(user_id as string) || ' : TTY=pts/0'")
    d = ev.select("id", line.alias("line")).withColumn("u", P.sudo(P.syslog_header(F.col("line"), "2024-06-01 00:00:00")))
    return d.select("id", "u.sudo", "u.sudo_user")


@register("select id, 'key' || (id % 3) as key from ev where id % 3 = 1")
def audit_key_filter(ev):
    record = F.concat(F.lit('type=SYSCALL msg=audit(01/02/2024 03:04:05.1:7): pid=1 key="key'), (F.col("id") % 3).cast("string"), F.lit('"'))
    d = ev.select("id", P.audit_record(record).alias("a"))
    return P.with_audit_key(d, "a", "key1").select("id", F.col("a.fields")["key"].alias("key"))


@register("select id, case id % 4 when 0 then 'cron' when 1 then 'kernel' when 2 then 'service_start' else 'other' end as event_type, ts_us // 1000000 as ts_s from ev where source = 'syslog'")
def parse_syslog(ev):
    h = P.syslog_header(F.col("raw_line"), "2024-06-01 00:00:00")
    return ev.filter("source = 'syslog'").withColumn("h", h).select("id", P.syslog_event(F.col("h")).alias("event_type"), F.floor(us("h.ts") / 1000000).alias("ts_s"))


_WEB_ACCESS_SQL = r"""select id, ts_us // 1000000 as ts_s, case when id % 4 = 0 then 'user' || user_id end as username, regexp_extract(raw_line, 'GET (\S+)', 1) as path, cast(regexp_extract(raw_line, '" (\d{3}) ', 1) as int) as status, cast(id % 5000 as int) as size, regexp_extract(raw_line, '"([^"]*)"$', 1) as user_agent, case when regexp_extract(raw_line, '" (\d{3}) ', 1) >= '400' then 'http_error' else 'http_request' end as event_type from ev where source = 'web_access'"""


@register(_WEB_ACCESS_SQL)
def parse_web_access(ev):
    d = ev.filter("source = 'web_access'").withColumn("w", P.web_access(F.col("raw_line")))
    return d.select("id", F.floor(us("w.ts") / 1000000).alias("ts_s"), "w.username", "w.path", "w.status", "w.size", "w.user_agent", "w.event_type")


@register(_WEB_ACCESS_SQL)
def sql_parse_web_access(ev):
    register_parsers(ev.sparkSession)
    lines = "select id, parse_web_access(raw_line) as w from {ev} where source = 'web_access'"
    return ev.sparkSession.sql(f"select id, floor(timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', w.ts) / 1000000) as ts_s, w.username, w.path, w.status, w.size, w.user_agent, w.event_type from ({lines}) where w is not null", ev=ev)


@register(r"""select id, ts_us // 1000000 as ts_s, 'core' as module, 'error' as level, cast(user_id % 900 + 100 as int) as pid, nullif(regexp_extract(raw_line, 'client ([\d.]+):', 1), '') as src_ip, regexp_extract(raw_line, '(File does.*)$', 1) as message from ev where source = 'web_error'""")
def parse_web_error(ev):
    d = ev.filter("source = 'web_error'").withColumn("w", P.web_error(F.col("raw_line")))
    return d.select("id", F.floor(us("w.ts") / 1000000).alias("ts_s"), "w.module", "w.level", "w.pid", "w.src_ip", "w.message")


@register(r"""select id, split_part(raw_line, ' ', 2) as event_type, source, (ts_us // 1000000) * 1000000 + 500000 as t_us, regexp_extract(raw_line, ' pid=(\d+)', 1) as pid, nullif(regexp_extract(raw_line, ' comm=(\S+)', 1), '') as comm, nullif(regexp_extract(raw_line, ' src=([\d.]+):', 1), '') as src_ip from ev where source like 'ebpf%'""")
def parse_ebpf_kv(ev):
    d = ev.filter(F.col("source").startswith("ebpf")).withColumn("p", P.ebpf(F.col("raw_line")))
    return d.select("id", "p.event_type", "p.source", us("p.ts").alias("t_us"), F.col("p.fields")["pid"].alias("pid"), F.col("p.fields")["comm"].alias("comm"), "p.src_ip")


@register("select id, ts_us as t_us, case id % 3 when 0 then 'service_start' else 'cron' end as event_type, cast(id % 8 as int) as priority from ev where source = 'journal' and id % 3 <> 1")
def parse_journal(ev):
    d = ev.filter("source = 'journal'").withColumn("j", P.journal(F.col("raw_line"))).filter("j is not null")
    return d.select("id", us("j.ts").alias("t_us"), "j.event_type", "j.priority")


@register("""with a as (select id, user_id % 50 as pid, stream_id, case when id % 5 = 0 then null else src_ip end as ip, case when id % 5 = 0 then null else session_id end as ses from ev where source = 'auth_log'),
b as (select *, max(case when ip is not null then id end) over (partition by stream_id, pid order by id) as j from a)
select b.id, coalesce(b.ip, a.ip) as src_ip, case when b.ip is null then coalesce(b.ses, a.ses) else b.ses end as session_id from b left join a on b.j = a.id""")
def pid_enrich(ev):
    d = ev.filter("source = 'auth_log'").selectExpr("id", "user_id % 50 as pid", "stream_id", "case when id % 5 = 0 then null else src_ip end as src_ip", "case when id % 5 = 0 then null else session_id end as session_id")
    return P.enrich_by_pid(d, "stream_id", "id").select("id", "src_ip", "session_id")


@register("select id, 'SYSCALL' as type, 'key' || (id % 3) as key, (ts_us // 1000000) as ts_s from ev")
def parse_audit(ev):
    record = F.concat(F.lit("type=X type=SYSCALL msg=audit("), F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss"), F.lit('.123:77): pid=1 key="key'), (F.col("id") % 3).cast("string"), F.lit('"')).alias("r")
    d = ev.select("id", F.explode(P.audit_records(F.concat(record, F.lit("\n----\n")))).alias("r")).withColumn("a", P.audit_record(F.col("r")))
    return d.select("id", "a.type", F.col("a.fields")["key"].alias("key"), F.floor(us("a.ts") / 1000000).alias("ts_s"))


PATHS = "case id % 7 when 0 then '/var/log/auth.log.1' when 1 then 'x/syslog.2.gz' when 2 then 'apache2/site_access.log.3' when 3 then 'log/journal/a/system' when 4 then 'log/wtmp' when 5 then 'nginx/access.log' else 'apache2/other_error.log' end"


@register("select id, case id % 7 when 0 then 'auth_log' when 1 then 'syslog' when 2 then 'web_access' when 5 then 'web_access' when 6 then 'web_error' end as parser from ev")
def file_route(ev):
    return ev.select("id", files.route(F.expr(PATHS)).alias("parser"))


# Preparation.
def _rules_sql(rules: dict[str, list[str]]) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower(raw_line), {quoted(w)})" for w in words) + f" then '{n}'" for n, words in rules.items()) + " end"


RULE = f"case when source in ('web_access', 'web_error') then {_rules_sql(D.WEB_FILTERS)} when source = 'auth_log' then {_rules_sql(D.AUTH_FILTERS)} end"


@register(f"select source, rule, count(*) as n from (select source, {RULE} as rule from ev) where rule is not null group by 1, 2")
def malicious_filter_hits(ev):
    return ev.withColumn("rule", R.filter_rule(F.col("source"), F.col("raw_line"))).filter("rule is not null").groupBy("source", "rule").agg(F.count(F.lit(1)).alias("n"))


#: A thousand words in ten rules; 'user1' is a part of 'user13', so that the order of the rules decides.
_MANY = {f"r{j}": [f"user{k}" for k in range(1000) if k % 10 == j] for j in range(10)}


@register("select id, 'r' || min(k % 10) as rule from ev, (select unnest(range(1000)) as k) w where contains(lower(raw_line), 'user' || k) group by id")
def many_words(ev):
    return ev.select("id", R.first_rule(F.lower("raw_line"), _MANY).alias("rule")).filter("rule is not null")


@register(f"select distinct src_ip from ev where {RULE} is not null and src_ip is not null")
def malicious_ips(ev):
    return R.malicious_addresses(ev)


@register(f"select id, source from ev where source like 'ebpf%' and (source <> 'ebpf_network' or src_ip is null or src_ip not in (select src_ip from ev where {RULE} is not null and src_ip is not null and user_id % 3 = 0))")
def carryover_antijoin(ev):
    return R.without_addresses(ev, R.malicious_addresses(ev.filter("user_id % 3 = 0"))).select("id", "source")


SCRUB = R.ScrubConfig([("HOST1", "web-a"), ("user13", "someone"), ("10.0.0.12", "192.0.2.1")], [(r"\bhost(\d)\b", "node-$1", "hostname")], ["host2"])
_SCRUBBED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_line, '(?i)HOST1', 'web-a', 'g'), '(?i)user13', 'someone', 'g'), '(?i)10\.0\.0\.12', '192.0.2.1', 'g'), '\bhost(\d)\b', 'node-\1', 'g')"


@register(f"select id, md5({_SCRUBBED}) as digest from ev")
def pii_scrub(ev):
    return ev.select("id", F.md5(R.scrubbed(F.col("raw_line"), SCRUB)).alias("digest"))


@register(r"""with a as (select raw_line as l0 from ev), b as (select l0, regexp_replace(l0, '(?i)HOST1', 'web-a', 'g') as l1 from a), c as (select *, regexp_replace(l1, '(?i)user13', 'someone', 'g') as l2 from b), d as (select *, regexp_replace(l2, '(?i)10\.0\.0\.12', '192.0.2.1', 'g') as l3 from c)
select 'HOST1' as rule, count(*) filter (regexp_matches(l0, '(?i)HOST1')) as n from d union all select 'user13', count(*) filter (regexp_matches(l1, '(?i)user13')) from d union all select '10.0.0.12', count(*) filter (regexp_matches(l2, '10\.0\.0\.12')) from d union all select 'hostname', count(*) filter (regexp_matches(l3, '\bhost(\d)\b')) from d""")
def scrub_counts(ev):
    return R.scrub_counts(ev, SCRUB)


@register("select id, md5(replace(replace(raw_line, 'sshd', 'daemon'), 'host', 'h')) as digest from ev")
def literal_scrub(ev):
    return ev.select("id", F.md5(R.replaced(F.col("raw_line"), [("sshd", "daemon"), ("host", "h")])).alias("digest"))


def _phases(spark: SparkSession) -> DataFrame:
    rows = [(0, "2024-01-03 00:00:00", "2024-01-05 12:00:00", [], "brute_force", "initial_access", 2), (1, "2024-01-05 00:00:00", "2024-01-09 00:00:00", [], "web_exploit", "execution", 1)]
    return spark.createDataFrame(rows, "idx int, s string, e string, source_ips array<string>, attack_type string, attack_stage string, severity int").selectExpr("idx", "cast(s as timestamp_ntz) as start_time", "cast(e as timestamp_ntz) as end_time", "source_ips", "attack_type", "attack_stage", "severity")


_PHASE = """case when timestamp between '2024-01-03' and '2024-01-05 12:00:00' and (src_ip is null or user_id % 2 = 0) then 0 when timestamp between '2024-01-05' and '2024-01-09' and (src_ip is null or user_id % 3 = 0) then 1 end"""


@register(f"with p as (select id, {_PHASE} as p from ev) select id, case when p is null then 0 else 1 end as is_malicious, case p when 0 then 'brute_force' when 1 then 'web_exploit' end as attack_type, case p when 0 then 'initial_access' when 1 then 'execution' end as attack_stage, case p when 0 then 2 when 1 then 1 else 0 end as severity from p")
def label_interval_join(ev):
    """Phases of every second and every third user's address, however many users the table has."""
    users = ev.filter("src_ip is not null").select("user_id", "src_ip").distinct()
    addresses = users.filter("user_id % 2 = 0").select(F.lit(0).alias("idx"), "src_ip").unionByName(users.filter("user_id % 3 = 0").select(F.lit(1).alias("idx"), "src_ip"))
    return R.label_by_windows(ev, _phases(ev.sparkSession), addresses).select("id", "is_malicious", "attack_type", "attack_stage", "severity")


@register("select e.id, case when a.timestamp is not null and e.is_malicious = 1 then greatest(e.severity, 3) else e.severity end as severity from ev e left join (select distinct timestamp from ev where user_id % 4 = 0) a using (timestamp)")
def audit_escalation(ev):
    return R.escalate_by_audit(ev, ev.filter("user_id % 4 = 0").select(F.col("timestamp").alias("ts"))).select("id", "severity")


_DOMINANT = "dom as (select attack_type, campaign_id, src_ip, n from (select attack_type, campaign_id, src_ip, count(*) as n, row_number() over (partition by attack_type, campaign_id order by count(*) desc, min(id)) as k from ev where is_malicious = 1 and not starts_with(source, 'ebpf_') and src_ip is not null and src_ip not in ('', '0.0.0.0') group by 1, 2, 3) where k = 1)"


@register(f"with {_DOMINANT} select * from dom")
def dominant_ip(ev):
    return R.dominant_address(ev).select("attack_type", "campaign_id", "src_ip", "n")


@register(f"with {_DOMINANT} select e.id, case when x then d.src_ip else e.src_ip end as src_ip, case when x then d.src_ip || ':ebpf_' || right(e.campaign_id, 8) else e.session_id end as session_id from (select *, coalesce(starts_with(source, 'ebpf_') and is_malicious = 1 and coalesce(src_ip, '') in ('', '0.0.0.0'), false) as lacks from ev) e left join dom d on e.attack_type = d.attack_type and e.campaign_id = d.campaign_id, lateral (select e.lacks and d.src_ip is not null as x)")
def ebpf_enrich(ev):
    return R.enrich_kernel(ev).select("id", "src_ip", "session_id")


@register(r"""with r as (select id, source, case when id % 3 = 0 then null else src_ip end as src_ip, case when id % 3 = 0 then null else session_id end as session_id, case when source = 'auth_log' then nullif(regexp_extract(raw_line, 'sshd\[(\d+)\]', 1), '') end as pid from ev),
l as (select pid, max_by(src_ip, id) as ip, max_by(coalesce(session_id, '~'), id) as ses from r where pid is not null and src_ip is not null group by pid)
select r.id, case when r.src_ip is null and r.session_id is null then l.ip else r.src_ip end as src_ip, case when r.src_ip is null and r.session_id is null then nullif(l.ses, '~') else r.session_id end as session_id from r left join l using (pid)""")
def backfill_sessions(ev):
    d = ev.withColumn("src_ip", F.expr("case when id % 3 = 0 then null else src_ip end")).withColumn("session_id", F.expr("case when id % 3 = 0 then null else session_id end"))
    return R.backfill(d).select("id", "src_ip", "session_id")


_SHA_MOD = "list_reduce([0::bigint] || list_transform(range(8), lambda k: ('0x' || substring(sha256(timestamp_text || '|' || source || '|' || raw_line), 8 * k + 1, 8))::bigint), lambda a, w: (a * 296 + w) % 1000)"


@register(f"with t as (select *, strftime(timestamp, '%Y-%m-%d %H:%M:%S') as timestamp_text from ev) select id from t where not starts_with(source, 'ebpf_') or {_SHA_MOD} < 242")
def ebpf_sample(ev):
    return R.sampled(ev.withColumn("timestamp_text", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), 0.242).select("id")


@register("select id, ts_us - case when source in ('auth_log', 'syslog') then 3600000000 else 0 end as t_us from ev where timestamp - case when source in ('auth_log', 'syslog') then interval 1 hour else interval 0 hour end between timestamp '2024-01-04 23:58:00' and timestamp '2024-01-06 00:02:00'")
def collection_window(ev):
    return R.in_window(ev, "2024-01-05 00:00:00", "2024-01-06 00:00:00", 120, 3600).select("id", us("timestamp").alias("t_us"))


_PERTURBED = "(case when id % 10 = 0 then id + 3 else id end)"


@register(f"select id, row_number() over (order by timestamp, id) as new_id from (select {_PERTURBED} * 2 + id % 2 as id, timestamp from ev)")
def resequence(ev):
    return R.resequenced(ev.select(F.expr(f"{_PERTURBED} * 2 + id % 2").alias("id"), "timestamp")).select("id", "new_id")


# Validation.
def _check_sql(name: str, bad: str, failed: str = "FAIL") -> str:
    return f"select '{name}' as name, case when n_bad > 0 then '{failed}' else 'PASS' end as status, n_bad from ({bad})"


@register(_check_sql("label_consistency", "select count(*) filter ((is_malicious = 1 and (attack_type is null or attack_stage is null or severity is null)) or (is_malicious = 0 and (attack_type is not null or attack_stage is not null))) as n_bad from ev"))
def check_label_consistency(ev):
    return V.label_consistency(ev)


@register("select 'campaign_boundaries' as name, case when n_bad > 0 then 'FAIL' else 'PASS' end as status, n_bad from (select count(*) as n_bad from ev join camp c on ev.campaign_id = c.id where timestamp < start_time or (end_time is not null and timestamp > end_time))", campaigns_too=True)
def check_boundaries(ev):
    return V.campaign_boundaries(ev, _campaigns(ev))


def _campaigns(ev: DataFrame) -> DataFrame:
    days = ev.filter("campaign_id is not null and dayofmonth(timestamp) <> 29").groupBy(F.col("campaign_id").alias("id")).agg(F.expr("cast(date_trunc('day', min(timestamp)) as timestamp_ntz)").alias("start_time"), F.min(F.dayofmonth("timestamp")).alias("d"))
    return days.selectExpr("id", "start_time", "case when d % 5 = 0 then null when d % 3 = 0 then start_time + interval 12 hours else start_time + interval 24 hours end as end_time", "case when d % 4 = 0 then 'web_exploit, execution' else 'brute_force, web_exploit,execution' end as attack_type")


@register(_check_sql("campaign_types", "select count(*) filter (c.id is null or not coalesce(list_contains(list_transform(string_split(c.attack_type, ','), lambda x: trim(x)), ev.attack_type), false)) as n_bad from ev left join camp c on ev.campaign_id = c.id where ev.is_malicious = 1 and ev.campaign_id is not null"), campaigns_too=True)
def check_type_crossval(ev):
    return V.campaign_types(ev, _campaigns(ev))


@register(f"with t as (select *, case when is_malicious = 1 then {case_sql('attack_stage', D.RISK_OF_STAGE, '0.0')} else 0.0 end as risk from ev order by id limit 10000) " + _check_sql("target_consistency", "select count(*) filter ((is_malicious = 1 and (attack_type is null or attack_stage is null)) or (coalesce(is_malicious, 0) = 0 and (attack_type is not null or attack_stage is not null)) or risk not between 0 and 10) as n_bad from t"))
def check_target_consistency(ev):
    return V.target_consistency(ev.withColumn("true_risk", E.true_risk(F.col("is_malicious"), F.col("attack_stage"))))


@register("""with w(attack_type, want) as (values ('brute_force', 0.1), ('web_exploit', 0.3), ('execution', 0.2), ('exfiltration', 0.4)), c as (select attack_type, count(*) as n, count(*) / sum(count(*)) over () as share from ev where is_malicious = 1 group by 1)
select w.attack_type, coalesce(n, 0) as n, round(share, 6) as share, case when n is null then 'FAIL' when share < want / 2 or share > least(1.0, want * 2) then 'WARN' else 'PASS' end as status from w left join c using (attack_type)""")
def check_distribution(ev):
    return V.attack_distribution(ev, {"brute_force": 1, "web_exploit": 3, "execution": 2, "exfiltration": 4})


@register(_check_sql("temporal_order", f"select count(*) filter (timestamp < before) as n_bad from (select timestamp, lag(timestamp) over (order by id) as before from (select {_PERTURBED} * 2 + id % 2 as id, timestamp from ev))"))
def check_temporal_order(ev):
    return V.temporal_order(ev.select(F.expr(f"{_PERTURBED} * 2 + id % 2").alias("id"), "timestamp"), width=1000)


@register(_check_sql("build_order", f"select count(*) filter (timestamp > after) as n_bad from (select timestamp, lead(timestamp) over (order by id) as after from (select {_PERTURBED} * 2 + id % 2 as id, timestamp from ev))", "WARN"))
def check_build_order(ev):
    return V.temporal_order(ev.select(F.expr(f"{_PERTURBED} * 2 + id % 2").alias("id"), "timestamp"), "build_order", "WARN", width=777)


@register(_check_sql("no_unlabelled", "select count(*) filter (is_malicious is null) as n_bad from ev"))
def check_unlabelled(ev):
    return V.no_unlabelled(ev)


@register(_check_sql("session_coherence", "select count(*) as n_bad from (select session_id from ev where session_id is not null group by 1 having count(distinct is_malicious) > 1)"))
def check_session_coherence(ev):
    return V.session_coherence(ev)


@register("select session_id, count(*) filter (is_malicious = 1) as malicious, count(*) filter (is_malicious = 0) as benign from ev where session_id is not null group by 1 having count(distinct is_malicious) > 1")
def mixed_sessions(ev):
    return V.mixed_sessions(ev)


@register("""with s as (select *, row_number() over (partition by attack_type order by sha256(id || ':42')) as k from ev where is_malicious = 1 and attack_type in ('brute_force', 'credential_stuffing', 'web_exploit', 'discovery', 'execution')),
t as (select attack_type, count(*) as n, count(*) filter (case attack_type
 when 'brute_force' then regexp_matches(raw_line, '(?i)Failed password|Invalid user|res=failed|authentication failure|Connection closed.*preauth|Disconnected from')
 when 'web_exploit' then contains(raw_line, '${jndi:') or regexp_matches(raw_line, '(?i)jndi:ldap://|python-requests|/\\?x=')
 when 'execution' then regexp_matches(raw_line, '(?i)Accepted password|session opened|Started User|pam_unix|New session|_AUDIT_TYPE|_CMDLINE|EXECVE|session_finalize|User Runtime Directory|user-\\d+\\.slice|research_exploit|"MESSAGE"|session-\\d+\\.scope')
 else false end) as hits from s where k <= 50 group by 1), u as (select min(hits / n) as worst, sum(n - hits) as bad from t)
select 'spot_check' as name, case when worst is null then 'SKIP' when worst < 0.6 then 'FAIL' when worst < 0.8 then 'WARN' else 'PASS' end as status, coalesce(bad, 0)::bigint as n_bad from u""")
def check_spot(ev):
    return V.spot_check(ev)


_ABSENT = " or ".join(f"contains(lower(coalesce({c}, '')), lower('{p}'))" for p in ("Failed password", "Invalid user", "${jndi:", "UNION+SELECT", "../../../", "wp-login.php") for c in ("raw_line",))


@register(_check_sql("no_attack_content", f"select count(*) filter ({_ABSENT}) as n_bad from ev"))
def check_attack_content(ev):
    return V.strings_absent(ev, V.ATTACK_STRINGS, "no_attack_content", columns=("raw_line",))


@register(_check_sql("pii_absent", "select count(*) filter (contains(lower(raw_line), 'host2')) as n_bad from ev"))
def check_pii(ev):
    return V.strings_absent(ev, SCRUB.verify_patterns, "pii_absent")


@register(_check_sql("all_benign", "select count(*) filter (is_malicious <> 0) as n_bad from ev"))
def check_all_benign(ev):
    return V.all_benign(ev)


# Ordered analytics.
@register("select id, round(coalesce(date_diff('microsecond', lag(timestamp) over (partition by stream_id order by id), timestamp) / 1e6, 0), 6) as dt from ev")
def dt_visible(ev):
    return W.with_gap(ev, "stream_id").select("id", F.round("dt_seconds", 6).alias("dt"))


@register(f"select id, channel, round(coalesce(date_diff('microsecond', lag(timestamp) over (partition by stream_id, channel order by id), timestamp) / 1e6, 0), 6) as dt, round(ln(1 + coalesce(date_diff('microsecond', lag(timestamp) over (partition by stream_id, channel order by id), timestamp) / 1e6, 0)), 6) as log_dt from (select *, {CHANNEL} as channel from ev where source like 'ebpf%')")
def channel_dt(ev):
    d = ev.filter(F.col("source").startswith("ebpf")).withColumn("channel", E.channel(F.col("source")))
    return W.with_gap(d, "stream_id", "channel").select("id", "channel", F.round("dt_seconds", 6).alias("dt"), F.round(E.log_delta(F.col("dt_seconds")), 6).alias("log_dt"))


@register("with f as (select id, count(*) over (partition by src_ip order by ts_us range between 86400000000 preceding and current row) as failures from ev where is_malicious = 1) select id, failures, case when failures >= 5 then 3 when failures >= 2 then 1 else 0 end as action from f")
def failures_window(ev):
    return W.failures_within(ev.filter("is_malicious = 1"), 86400, 5).select("id", "failures", "action")


_FEATURES = ", ".join(f"count(*) filter (event_type = '{k}') over w::double as f{j + 1:02d}" for j, k in enumerate(W.EVENT_COUNTERS))
_KEY = "case when coalesce(session_id, '') <> '' and id % 2 = 0 then session_id when coalesce(src_ip, '') <> '' then src_ip else 'unknown' end"


@register(f"""with k as (select *, {_KEY} as key, case when src_ip is not null then regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) end as net from ev),
c as (select *, count(*) over (partition by key, net order by id) as c, row_number() over (partition by key, username order by id) = 1 and username is not null as u1, row_number() over (partition by key, src_ip order by id) = 1 and src_ip is not null as i1 from k),
d as (select *, case when net is null then 0 else c * log2(c) - case when c > 1 then (c - 1) * log2(c - 1) else 0 end end as inc from c)
select id, key, count(*) over w::double as f00, {_FEATURES}, count(*) filter (event_type not in ({', '.join(map(quoted, W.EVENT_COUNTERS))})) over w::double as f09, count(*) filter (u1) over w::double as f10, count(*) filter (i1) over w::double as f11,
round(case when count(net) over w > 0 then greatest(0, log2(count(net) over w) - sum(inc) over w / count(net) over w) else 0 end, 5) as f12, round(f02 / greatest(f01 + f02, 1), 6) as f13, round(date_diff('microsecond', first(timestamp) over w, timestamp) / 1e6, 6) as f14, floor(case when f00 > 1 then date_diff('microsecond', first(timestamp) over w, timestamp) / 1e6 / (f00 - 1) else 0 end * 1000) / 1000 as f15,
round(sin(2*pi()*{HOUR}/24), 4) + 0.0 as f16, round(cos(2*pi()*{HOUR}/24), 4) + 0.0 as f17, round(sin(2*pi()*{DOW}/7), 4) + 0.0 as f18, round(cos(2*pi()*{DOW}/7), 4) + 0.0 as f19 from d window w as (partition by key order by id rows unbounded preceding)""")
def session_features20(ev):
    d = W.session_features(ev.withColumn("session_id", F.expr("case when id % 2 = 0 then session_id end")))
    digits = {10: 0, 11: 0, 12: 5, 13: 6, 14: 6, 16: 4, 17: 4, 18: 4, 19: 4}
    return d.select("id", "key", *[(F.floor(F.col("f15") * 1000) / 1000 if k == 15 else F.round(f"f{k:02d}", digits[k]) + 0.0 if k > 11 else F.col(f"f{k:02d}")).alias(f"f{k:02d}") for k in range(20)])


_READ = ["id", "stream_id", "source", "raw_line"]  # what tails are made of


@register(f"select id, length(tail) as n, md5(tail) as digest from (select id, right(array_to_string(list(raw_line) over (partition by stream_id, channel order by id rows 499 preceding), chr(10)), 50000) as tail from (select *, {CHANNEL} as channel from ev))")
def text_tail(ev):
    return W.text_tail(ev.select(*_READ), count="n").select("id", F.col("n").cast("long").alias("n"), F.md5("tail").alias("digest"))


_CHANNELS = sorted(set(D.CHANNEL_OF_SOURCE.values()))
_CARRIED = ", ".join(f"coalesce(last_value(case when channel = '{c}' then tail end ignore nulls) over w, '')" for c in _CHANNELS)


@register(f"select id, md5(concat_ws('|', {_CARRIED})) as digest from (select id, stream_id, channel, right(array_to_string(list(raw_line) over (partition by stream_id, channel order by id rows 499 preceding), chr(10)), 50000) as tail from (select *, {CHANNEL} as channel from ev)) window w as (partition by stream_id order by id rows unbounded preceding)")
def observation_tails(ev):
    return W.observations(ev.select(*_READ)).select("id", F.md5(F.concat_ws("|", *[f"tail_{c}" for c in _CHANNELS])).alias("digest"))


@register("select id, array_to_string(list_concat(w, list_resize([]::bigint[], 50 - len(w), 0)), ',') as ring from (select id, list(id % 100) over (partition by stream_id order by id rows 49 preceding) as w from ev)")
def struct_ring(ev):
    d = W.ring(ev.withColumn("row", F.array((F.col("id") % 100).cast("float"))), "row", 1, 50, "stream_id")
    return d.select("id", F.array_join(F.transform("ring", lambda r: r[0].cast("int").cast("string")), ",").alias("ring"))


@register("select id, array_to_string(list_concat(list_resize([]::bigint[], 50 - len(w), 0), w), ',') as stack from (select id, list(id % 100) over (partition by stream_id order by id rows 49 preceding) as w from ev)")
def window_stack(ev):
    d = W.window_stack(ev.withColumn("row", F.array((F.col("id") % 100).cast("double"))), "row", 1, 50, "stream_id")
    return d.select("id", F.array_join(F.transform("stack", lambda x: x.cast("int").cast("string")), ",").alias("stack"))


@register("""with g as (select *, (ts_us - min(ts_us) over (partition by stream_id)) / 1e9 as t from ev)
select id, round(sum(value * power(0.95, -t)) over (partition by stream_id order by id) * power(0.95, t), 4) as trace from g""")
def decay_trace(ev):
    d = W.with_gap(ev, "stream_id").withColumn("dt_seconds", F.col("dt_seconds") / 1e3).withColumn("row", F.array("value"))
    return W.decaying_trace(d.select("id", "stream_id", "row", "dt_seconds"), "row").select("id", F.round(F.col("trace")[0], 4).alias("trace"))


# Composition.
DURATION = 40 * 86400.0
_SPANS = "sp as (select source, min(timestamp) as t0, case when date_diff('microsecond', min(timestamp), max(timestamp)) <= 0 then 1.0 else date_diff('microsecond', min(timestamp), max(timestamp)) / 1e6 end::double as span, min(id) as gen from ev where is_malicious = 0 group by source)"
_CYCLED = "cy as (select e.id, e.source, e.raw_line, sp.gen, k.k as cycle, k.k * (span + 1) + date_diff('microsecond', t0, timestamp) / 1e6 as elapsed from ev e join sp using (source), lateral (select unnest(range(0, 10)) as k) k where is_malicious = 0 and k.k * (span + 1) + date_diff('microsecond', t0, timestamp) / 1e6 <= 3456000.0)"


def _benign(ev: DataFrame) -> DataFrame:
    return ev.filter("is_malicious = 0")


@register(f"with {_SPANS}, {_CYCLED} select source, count(*) as n from cy group by source")
def cycle_counts(ev):
    return C.cycle_counts(_benign(ev), DURATION)


@register(f"with {_SPANS}, {_CYCLED} select id, source, cast(cycle as int) as cycle, round(elapsed, 6) as elapsed from cy")
def cycle_rows(ev):
    return C.cycled(_benign(ev), DURATION).select("id", "source", "cycle", F.round("elapsed", 6).alias("elapsed"))


_PLAN = [(0, "brute_force", 1000.0, 0, 5), (1, "execution", 50000.0, 3, 9), (2, "web_exploit", 90000.0, 2, 4), (3, "brute_force", 200000.0, 4, 6)]


def _planned(ev: DataFrame) -> DataFrame:
    plan = ev.sparkSession.createDataFrame(_PLAN, "campaign long, attack_type string, offset_s double, start long, size long")
    return C.transplanted(store.attack_pools(ev), plan)


_POOL = "po as (select *, row_number() over (partition by attack_type order by timestamp, id) - 1 as pos from ev where is_malicious = 1)"
_TRANS = f"pl(campaign, pool, offset_s, start, size) as (values {', '.join(map(repr, _PLAN))}), tr as (select po.id, po.source, po.raw_line, campaign, pos, offset_s + date_diff('microsecond', min(timestamp) over (partition by campaign), timestamp) / 1e6 as elapsed from po join pl on po.attack_type = pl.pool and pos >= start and pos < start + size)"


@register(f"with {_POOL}, {_TRANS} select campaign::bigint as campaign, id, round(elapsed::double, 6) as elapsed from tr")
def transplant(ev):
    return _planned(ev).select("campaign", "id", F.round("elapsed", 6).alias("elapsed"))


@register(f"with {_SPANS}, {_CYCLED}, {_POOL}, {_TRANS}, m as (select id, source, elapsed, gen, cycle as a, id as b, 0 as bad from cy union all select id, source, elapsed::double, 4611686018427387904, campaign, pos, 1 from tr) select source, bad::int as is_malicious, count(*) as n, round(min(elapsed), 6) as first_s, round(max(elapsed), 6) as last_s from m group by 1, 2")
def compose_merge(ev):
    m = C.merged(C.cycled(_benign(ev), DURATION), _planned(ev), START)
    return m.groupBy("source", "is_malicious").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("elapsed"), 6).alias("first_s"), F.round(F.max("elapsed"), 6).alias("last_s"))


_POOLED = f"pe as (select po.* replace (case when x then d.src_ip else po.src_ip end as src_ip, case when x then d.src_ip || ':ebpf_' || right(po.campaign_id, 8) else po.session_id end as session_id) from po left join dom d on po.attack_type = d.attack_type and po.campaign_id = d.campaign_id, lateral (select starts_with(po.source, 'ebpf_') and coalesce(po.src_ip, '') in ('', '0.0.0.0') and d.src_ip is not null as x))"
_PLACED = f"pl(campaign, pool, offset_s, start, size) as (values {', '.join(map(repr, _PLAN))}), ta as (select pe.*, 4611686018427387904 as gen, campaign as a, pos as b, offset_s + date_diff('microsecond', min(timestamp) over (partition by campaign), timestamp) / 1e6 as elapsed from pe join pl on pe.attack_type = pl.pool and pos >= start and pos < start + size)"
_ROUNDS = "ca as (select e.*, sp.gen, k.k as a, e.id as b, k.k * (span + 1) + date_diff('microsecond', t0, timestamp) / 1e6 as elapsed from ev e join sp using (source), lateral (select unnest(range(0, 10)) as k) k where is_malicious = 0 and k.k * (span + 1) + date_diff('microsecond', t0, timestamp) / 1e6 <= 3456000.0)"


@register(f"""with {_SPANS}, {_ROUNDS}, {_POOL}, {_DOMINANT}, {_POOLED}, {_PLACED},
m as (select * from ca union all by name select * from ta), u as (select *, epoch_us(timestamp '{START}') + round(elapsed * 1000000)::bigint as us from m)
select row_number() over (order by us, gen, a, b) as id, us as ts_us, source, is_malicious, src_ip, session_id, md5(concat_ws('|', raw_line, parsed, campaign_id, attack_type, attack_stage, severity::varchar, username, service)) as digest from u""")
def compose_store(ev):
    """A composed store, written and opened again: ids, ties and all columns of every row."""
    spark = ev.sparkSession
    made = store.EventStore(spark, scratch_path(spark, "composed"), "w")
    pools = R.enrich_kernel(store.attack_pools(ev))
    plan = spark.createDataFrame(_PLAN, "campaign long, attack_type string, offset_s double, start long, size long")
    made.append(C.store_rows(C.sequenced(C.merged(C.cycled(_benign(ev), DURATION), C.transplanted(pools, plan), START))))
    rest = F.concat_ws("|", "raw_line", "parsed", "campaign_id", "attack_type", "attack_stage", F.col("severity").cast("string"), "username", "service")
    return made.events().select("id", us("timestamp").alias("ts_us"), "source", "is_malicious", "src_ip", "session_id", F.md5(rest).alias("digest"))


@register("select id, source, raw_line from ev where id > 4000 and source in ('auth_log', 'web_access') order by id limit 1000")
def store_page(ev):
    """A page after a cursor from the files of a store that can hold it."""
    made = store.EventStore(ev.sparkSession, scratch_path(ev.sparkSession, "paged"), "w")
    made.append(C.store_rows(ev.repartitionByRange("id")))
    made.write_index()
    return made.read_page(4000, 1000, ["auth_log", "web_access"]).select("id", "source", "raw_line")


# Replay.
def _score_sql() -> str:
    out = "case " + CHANNEL
    for name, rules in D.KEYWORD_RULES.items():
        if name != "network_events":  # its look-ahead has no RE2 form; the adapter's network lines have uid=0
            out += f" when '{name}' then " + " + ".join(f"case when regexp_matches(raw_line, {quoted(p)}) then {w} else 0 end" for p, w in rules)
    return out + " else 0 end"


@register(f"select id, {_score_sql()} as score from ev")
def keyword_score(ev):
    return ev.select("id", E.keyword_score(F.col("source"), F.col("raw_line")).alias("score"))


_ACTION = f"case when {_score_sql()} >= 5 and src_ip is not null then 3 when {_score_sql()} >= 2 then 1 else 0 end"


def _acting(ev: DataFrame) -> DataFrame:
    score = E.keyword_score(F.col("source"), F.col("raw_line"))
    return ev.withColumn("score", score).withColumn("action", E.keyword_action(F.col("score"), F.col("src_ip")))


@register(f"""with a as (select {_ACTION} as action, coalesce(is_malicious, 0) = 1 as bad from ev), c as (select count(*) filter (action in (1, 2, 3, 5) and bad) as tp, count(*) filter (action in (1, 2, 3, 5) and not bad) as fp, count(*) filter (action not in (1, 2, 3, 5) and bad) as fn, count(*) filter (action not in (1, 2, 3, 5) and not bad) as tn from a), d as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double as recall from c)
select tp, fp, fn, tn, round(precision, 9) as precision, round(recall, 9) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) as f1 from d""")
def confusion_matrix(ev):
    c = replay.confusion(_acting(ev))
    return c.select("tp", "fp", "fn", "tn", *[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")])


@register("with a as (select id, stream_id, id % 2 as action, coalesce(lead(is_malicious, 1, 0) over (partition by stream_id order by id), 0) as nxt from ev) select id, action::int as action, case when nxt = 1 then case action when 1 then 0.5 else -0.5 end else case action when 1 then -0.3 else 0.0 end end::double as reward from a")
def replay_open_loop_reward(ev):
    return replay.open_loop(ev.withColumn("action", (F.col("id") % 2).cast("int"))).select("id", "action", "reward")


@register(r"""select id, nullif(coalesce(nullif(regexp_extract(raw_line, 'Failed password for (?:invalid user )?(\S+) from (\S+)', 2), ''), nullif(regexp_extract(raw_line, 'Invalid user (\S+) from (\S+)', 2), ''), nullif(regexp_extract(raw_line, 'authentication failure.*rhost=(\S+)', 1), ''), nullif(regexp_extract(raw_line, 'Connection closed by (\S+).*\[preauth\]', 1), '')), '') as failed_ip from ev where source = 'auth_log'""")
def failure_extraction(ev):
    return ev.filter("source = 'auth_log'").select("id", E.failure_address(F.col("raw_line")).alias("failed_ip"))


@register(r"""with f as (select id, ts_us, nullif(coalesce(nullif(regexp_extract(raw_line, 'Failed password for (?:invalid user )?(\S+) from (\S+)', 2), ''), nullif(regexp_extract(raw_line, 'Invalid user (\S+) from (\S+)', 2), ''), nullif(regexp_extract(raw_line, 'authentication failure.*rhost=(\S+)', 1), ''), nullif(regexp_extract(raw_line, 'Connection closed by (\S+).*\[preauth\]', 1), '')), '') as failed_ip from ev where source = 'auth_log'),
n as (select id, failed_ip, count(*) over (partition by failed_ip order by ts_us range between 86400000000 preceding and current row) as failures from f where failed_ip is not null)
select id, failed_ip, failures, case when failures >= 5 then 3 when failures >= 2 then 1 else 0 end as action from n""")
def failed_logins_window(ev):
    """Failed logins of each address within a day, as its policy counts them."""
    return W.failed_logins_within(ev, 86400, 5).select("id", "failed_ip", "failures", "action")


@register()
def replay_closed_loop(ev):
    """The policy's action is a column, as its line alone decides it: lines stay out of the loop's shuffle."""
    line = F.col("raw_line")
    action = F.when(line.contains("Failed password") | line.contains("jndi"), D.BLOCK).when(line.contains("UNION"), D.THROTTLE).otherwise(D.PASS)

    def policy(row: dict) -> tuple[int, float]:
        return row["action"], 5.0 if row["action"] == D.BLOCK else 0.0

    return replay.closed_loop(ev.withColumn("action", action), policy, reset_row=True, reads=["action"], seed=42, ttl_s=86400.0, deny_log=True)


@register()
def replay_totals(ev):
    """Reward totals and confusion figures of the random policy."""
    return replay.totals(replay.closed_loop(ev, replay.random_policy(), lists=False, reads=[], seed=42))


@register("""with recursive p as (select id, user_id % 4 as stream_id, cast(regexp_extract(raw_line, ' pid=(\\d+)', 1) as int) as pid, cast(regexp_extract(raw_line, ' ppid=(\\d+)', 1) as int) as ppid from ev where source = 'ebpf_process'),
l as (select a.id, a.ppid, max(b.id) as parent from p a left join p b on a.stream_id = b.stream_id and b.pid = a.ppid and b.id < a.id group by 1, 2),
r as (select id, case when ppid = 0 then 0 else 1 end as depth from l where parent is null or ppid = 0 union all select l.id, r.depth + 1 from l join r on l.parent = r.id where l.ppid <> 0)
select id, cast(depth as int) as depth from r""")
def proc_depth(ev):
    d = ev.filter("source = 'ebpf_process'").withColumn("p", P.ebpf(F.col("raw_line")))
    d = d.select("id", (F.col("user_id") % 4).alias("stream_id"), F.col("p.fields")["pid"].cast("int").alias("pid"), F.col("p.fields")["ppid"].cast("int").alias("ppid"))
    return W.process_depth(d).select("id", "depth")


@register()
def kernel_rows(ev):
    """Numeric rows of kernel events (8, 7 or 6 columns), with hashed names."""
    d = W.with_gap(ev.filter(F.col("source").startswith("ebpf")), "stream_id", "source").withColumn("p", P.ebpf(F.col("raw_line"))).withColumn("f", F.col("p.fields"))
    n = lambda k: F.coalesce(F.col("f")[k].try_cast("double"), F.lit(0.0))
    h = lambda c, seed: F.coalesce(E.murmur3(c, seed).cast("double"), F.lit(0.0))
    d = d.withColumns({"comm": h(F.col("f")["comm"], E.COMM), "parent": h(F.col("f")["parent_comm"], E.COMM), "dst": h(E.address(F.col("f")["dst"]), E.ADDRESS), "path": h(F.col("f")["path"], E.PATH)})
    call, gap = E.syscall_number(F.col("p.event_type")).cast("double"), E.log_delta(F.col("dt_seconds"))
    row = F.when(F.col("source") == "ebpf_process", F.array(gap, n("pid"), n("ppid"), n("uid"), call, F.col("comm"), F.col("parent"), F.lit(0.0))).when(F.col("source") == "ebpf_network", F.array(gap, n("pid"), n("uid"), call, F.col("dst"), E.port(F.col("f")["dst"]).cast("double"), F.col("comm"))).otherwise(F.array(gap, n("pid"), n("uid"), call, E.flag_bits(F.col("f")["flags"]).cast("double"), F.col("path")))
    return d.select("id", "source", row.cast("array<float>").alias("row"))


@register()
def feature_hash(ev):
    return ev.select("id", E.feature_hash(F.col("raw_line"), 256).alias("v"))


@register("select id, regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) as net, 'DENIED ' || raw_line as denied from ev where src_ip is not null")
def deny_lines(ev):
    return ev.filter("src_ip is not null").select("id", F.substring_index("src_ip", ".", 3).alias("net"), F.concat(F.lit("DENIED "), "raw_line").alias("denied"))


@register("select campaign_id, min(ts_us) as first_us, max(ts_us) as last_us, string_agg(distinct attack_type, ',' order by attack_type) as attack_types, count(*) as n from ev where campaign_id is not null group by 1")
def campaign_summary(ev):
    return ev.filter("campaign_id is not null").groupBy("campaign_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.nullif(F.array_join(F.array_sort(F.collect_set("attack_type")), ","), F.lit("")).alias("attack_types"), F.count(F.lit(1)).alias("n"))


@register("select count(*) as total, count(*) filter (is_malicious = 1) as malicious, count(*) filter (is_malicious = 0) as benign, count(*) filter (is_malicious = 1 and severity >= 3) as audit_confirmed from ev")
def label_stats(ev):
    return R.label_stats(ev)


@register("""select id, case when id % 4 = 0 then '{"a": 1, "event_type": "x"}' when id % 4 = 1 and source = 'auth_log' then '{"pattern": "disconnected", "event_type": "session_close"}' when id % 4 = 1 then case source when 'web_access' then '{"pattern": "disconnected", "event_type": "http_request"}' when 'web_error' then '{"pattern": "disconnected", "event_type": "http_error"}' else '{"pattern": "disconnected"}' end
 when id % 4 = 2 then case source when 'web_access' then '{"event_type": "http_request"}' when 'web_error' then '{"event_type": "http_error"}' else '{}' end end as parsed from ev""")
def backfill_event_types(ev):
    made = F.expr("""case id % 4 when 0 then '{"a": 1, "event_type": "x"}' when 1 then '{"pattern": "disconnected"}' when 2 then '{}' end""")
    return R.with_event_types(ev.withColumn("parsed", made)).select("id", "parsed")


# Building and batches.
_INGEST = f"(select 'h' || cast(user_id % 5 as string) as source_host, {PATHS} as path, case when id % 29 <> 0 then source end as source, raw_line from ev)"


@register(f"select source_host, count(distinct path) as files, count(source) as parsed, count(source) filter ({RULE} is not null) as filtered, count(source) filter ({RULE} is null) as kept, count(*) - count(source) as errors from {_INGEST} group by 1")
def ingest_stats(ev):
    lines = ev.select(F.expr("'h' || cast(user_id % 5 as string)").alias("source_host"), F.expr(PATHS).alias("path"), F.expr("case when id % 29 <> 0 then source end").alias("source"), "raw_line")
    return ingest.ingest_stats(lines)


@register("select id, source, 0 as is_malicious, 0 as severity, cast(null as varchar) as attack_type from ev where source like 'ebpf%'")
def carry_over_labels(ev):
    return ingest.as_benign(ev.filter(F.col("source").startswith("ebpf"))).select("id", "source", "is_malicious", "severity", "attack_type")


@register("select source as scope, count(*) as n, count(*) filter (is_malicious = 1) as malicious, min(ts_us) as first_us, max(ts_us) as last_us from ev group by 1 union all select 'all', count(*), count(*) filter (is_malicious = 1), min(ts_us), max(ts_us) from ev")
def build_report(ev):
    return ingest.build_report(ev).select("scope", "n", "malicious", us("first").alias("first_us"), us("last").alias("last_us"))


@register("select batch, count(*) as n, min(id) as low, max(id) as high from (select id, (row_number() over (order by timestamp, id) - 1) // 300 as batch from ev) group by 1")
def batch_bounds(ev):
    return ingest.with_batch(ev, 300).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@register("select attack_type, id from (select attack_type, id, row_number() over (partition by attack_type order by sha256(cast(id as varchar) || ':42')) as k from ev where is_malicious = 1) where k <= 20")
def type_sample(ev):
    return V.seeded_sample(ev, 20).select("attack_type", "id")


@register("select t as attack_type from (values ('brute_force'), ('credential_stuffing'), ('web_exploit'), ('log4shell')) r(t) where t not in (select attack_type from ev where is_malicious = 1 and attack_type is not null)")
def missing_types(ev):
    asked = ev.sparkSession.createDataFrame([("brute_force",), ("credential_stuffing",), ("web_exploit",), ("log4shell",)], "attack_type string")
    return asked.join(ev.filter("is_malicious = 1").select("attack_type").distinct(), "attack_type", "left_anti")


_FLAG_PARTS = ", ".join(f"case when id % 4096 & {b} <> 0 then '{n}' end" for n, b in D.FLAG_BITS.items() if b > 2)


@register(f"select id, concat_ws('|', case (id % 4096) & 3 when 1 then 'O_WRONLY' when 2 then 'O_RDWR' else 'O_RDONLY' end, {_FLAG_PARTS.replace('id % 4096 &', '(id % 4096) &')}) as flags from ev")
def open_flag_names(ev):
    return ev.select("id", E.flag_names((F.col("id") % 4096).cast("int")).alias("flags"))


@register("select id, case when p <= 0.3 then 'slow' when p <= 0.7 then 'medium' else 'fast' end as segment from (select id, cast(least(1, greatest(0, value / 400 - 0.1)) as double) as p from ev)")
def timing_segments(ev):
    return ev.select("id", timing_segment(F.col("value") / 400 - 0.1, PROFILES["accelerating"]).alias("segment"))


@register("select source, event_type, count(*) as n from ev where source like 'ebpf%' group by 1, 2")
def kernel_categories(ev):
    return ev.filter(F.col("source").startswith("ebpf")).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("select 'source_distribution' as name, 'PASS' as status, string_agg(distinct source, ', ' order by source) as detail from ev")
def check_source_distribution(ev):
    return V.source_distribution(ev)


@register("select 'event_count' as name, 'PASS' as status, cast(count(*) as varchar) as detail from ev")
def check_event_count(ev):
    return V.event_count(ev)


@register("select p as pattern, case when n > 0 then 'WARN' else 'PASS' end as status, n as n_bad from (select p, count(*) filter (contains(lower(raw_line), p) or coalesce(contains(lower(parsed), p), false)) as n from ev, (values ('host2'), ('user14'), ('nowhere')) x(p) group by p)")
def check_scrub_left(ev):
    return V.strings_left(ev, ["host2", "user14", "nowhere"])
