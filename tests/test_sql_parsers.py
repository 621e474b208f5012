"""Parsers called from SQL against the Column parsers, over well-formed, broken, empty and null lines."""

import pytest
from pyspark.sql import functions as F

from vigilspark.functions.sql_parsers import FUNCTIONS, register_parsers
from vigilspark.operators import parse as P

REFERENCE = "2026-03-01 00:00:00"
MESSAGES = [
    "Accepted publickey for root from 10.0.0.1 port 22 ssh2",
    "Accepted password for bob from 10.0.0.1 port 2201 ssh2",
    "Failed password for invalid user admin from 10.9.8.7 port 4000 ssh2",
    "Invalid user test from 1.2.3.4 port 55",
    "Connection closed by authenticating user root 1.2.3.4 port 55 [preauth]",
    "maximum authentication attempts exceeded for root from 1.2.3.4 port 55 ssh2 [preauth]",
    "Started session",
    "Stopping unit",
    "",
]
SERVICES = ["sshd[12]", "sshd", "CRON[9]", "systemd[1]", "kernel", "sudo"]
LINES = [
    *(f"{head} host {s}: {m}" for head in ("Jan  5 01:02:03", "Dec 31 23:59:59", "Xyz 40 99:00:00", "2026-01-05T01:02:03.123456+02:00") for s in SERVICES for m in MESSAGES),
    '1.2.3.4 - bob [05/Jan/2026:01:02:03 +0200] "GET /a?b=c HTTP/1.1" 404 12 "-" "agent/1.0"',
    '1.2.3.4 - - [05/Jan/2026:01:02:03 +0000] "GET /" 200 -',
    '1.2.3.4 - - [nonsense] "GET / HTTP/1.0" 200 99999999999',
    "[Mon Jan 05 01:02:03.123 2026] [core:error] [pid 77] [client 1.2.3.4:5000] File does not exist: /x",
    "[Mon Jan 05 01:02:03 2026] [notice] [pid 77] resuming",
    '{"SYSLOG_IDENTIFIER": "CRON", "MESSAGE": "x", "__REALTIME_TIMESTAMP": "1767571200123456", "PRIORITY": "6", "_PID": "9"}',
    '{"SYSLOG_IDENTIFIER": "systemd", "MESSAGE": "Started a", "PRIORITY": "x"}',
    '{"_SYSTEMD_UNIT": "a.service", "MESSAGE": "Stopped a"}',
    '{"SYSLOG_IDENTIFIER": "sshd", "MESSAGE": "x"}',
    '{"broken": ',
    "[1]",
    "2026-01-05T01:02:03.5Z connect pid=1 dst=1.2.3.4:80 dst=5.6.7.8:443 comm=",
    "2026-01-05T01:02:03Z execve pid=1 src=fe80::1:22 uid=0",
    "2026-99-05T01:02:03Z openat nothing",
    'type=SYSCALL msg=audit(01/05/2026 01:02:03.123:77) : pid=1 key="research exploit" pid=2 type=X',
    "no pairs",
    "",
    None,
]


@pytest.fixture(scope="module")
def lines(spark):
    register_parsers(spark)
    d = spark.createDataFrame([(k, line) for k, line in enumerate(LINES)], "id int, line string")
    d.createOrReplaceTempView("parser_lines")
    return d


def column_parser(name):
    header = P.syslog_header(F.col("line"), REFERENCE)
    return {
        "parse_syslog_header": lambda d: d.withColumn("r", header),
        "parse_auth": lambda d: d.withColumn("h", header).withColumn("a", P.auth_log(F.col("h"))).withColumn("r", F.when(F.col("a").isNotNull(), F.struct("h.ts", "h.hostname", "h.pid", "a.*"))),
        "parse_syslog": lambda d: d.withColumn("h", header).withColumn("k", P.syslog_event(F.col("h"))).withColumn("r", F.when(F.col("k").isNotNull(), F.struct("h.*", F.col("k").alias("event_type")))),
        "parse_web_access": lambda d: d.withColumn("r", P.web_access(F.col("line"))),
        "parse_web_error": lambda d: d.withColumn("r", P.web_error(F.col("line"))),
        "parse_journal": lambda d: d.withColumn("r", P.journal(F.col("line"))),
        "parse_ebpf": lambda d: d.withColumn("r", P.ebpf(F.col("line"))),
        "parse_audit": lambda d: d.withColumn("r", P.audit_record(F.col("line"))),
    }[name]


@pytest.mark.parametrize("name", FUNCTIONS)
def test_sql_parsers_equal_the_column_parsers(spark, lines, name):
    reference = f", timestamp_ntz'{REFERENCE}'" if "reference_time" in FUNCTIONS[name][0] else ""
    got = spark.sql(f"select id, p.* from (select id, {name}(line{reference}) as p from parser_lines) where p is not null")
    want = column_parser(name)(lines).filter("r is not null").select("id", "r.*")
    assert sorted(f.name for f in got.schema) == sorted(f.name for f in want.schema)
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
    columns = sorted(got.columns)
    key = lambda d: sorted((tuple(r) for r in d.select("id", *(c for c in columns if c != "id")).collect()), key=lambda r: r[0])
    assert key(got) == key(want) and got.count() > 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("EvalPython", "Exchange", "Join", "Subquery"))


def test_one_line_can_go_through_several_parsers(spark, lines):
    got = spark.sql(f"select id, coalesce(parse_web_access(line).ts, parse_web_error(line).ts, parse_syslog_header(line, timestamp_ntz'{REFERENCE}').ts) as ts from parser_lines")
    assert got.count() == len(LINES) and got.filter("ts is not null").count() > 150
