"""Databases, archives and audit files through the Python Data Source API."""

import gzip
import io
import sqlite3
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from vigilspark.operators.parse import audit_record, audit_records
from vigilspark.sources import datasources as S


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    S.register(spark)


def database(path, ids):
    db = sqlite3.connect(path)
    db.execute("create table if not exists events (id integer primary key, timestamp text, source text, raw_line text, severity)")
    db.executemany("insert into events values (?, '2026-01-01T00:00:00', ?, 'é', ?)", [(i, "syslog" if i % 3 else "auth_log", i if i % 5 else "bad") for i in ids])
    db.commit()
    db.close()


def test_rows_by_ranges_and_pushed_filters(spark, tmp_path):
    database(tmp_path / "a.db", [1, 2, *range(1000, 3000)])
    rows = spark.read.format("vigil_sqlite").option("rows", 500).load(str(tmp_path / "a.db"))
    assert rows.rdd.getNumPartitions() == 6 and rows.count() == 2002 and rows.columns[:3] == ["id", "timestamp", "source"]
    got = rows.filter("source = 'auth_log' and id > 2000 and id in (2001, 2004, 2005) and username is null").collect()
    assert [r["id"] for r in got] == [2001, 2004] and got[0]["severity"] == 2001 and rows.filter("id = 1000").first()["severity"] is None
    made = S.SqliteReader(rows.schema, {"path": str(tmp_path / "a.db")})
    made.pushFilters([S.S.EqualTo(("source",), "auth_log"), S.S.In(("id",), (3, 6)), S.S.IsNotNull(("id",)), S.S.StringContains(("source",), "x"), S.S.IsNull(("severity",))])
    assert [(w[0], w[2]) for w in made.where] == [("source", ["auth_log"]), ("id", [3, 6]), ("id", [])]
    assert {r[0] for r in made.read(S.Rows(str(tmp_path / "a.db"), 0, 5000))} == set()  # 3 and 6 are not there
    assert rows.filter("severity is null and id < 1100").count() == 20 and rows.filter("severity >= 2990").count() == 8
    with pytest.raises(Exception, match="no table"):
        spark.read.format("vigil_sqlite").option("table", "none").schema("id long").load(str(tmp_path / "a.db")).count()


def test_packed_databases_are_unpacked_in_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    database(tmp_path / "a.db", range(5, 100))
    (folder / "a.db.zst").write_bytes(zstandard.compress((tmp_path / "a.db").read_bytes()))
    database(folder / "b.db", range(200, 210))
    folder.chmod(0o555)
    for parts in (1, 3):
        rows = spark.read.format("vigil_sqlite").option("parts", parts).load(str(folder))
        assert sorted(r["id"] for r in rows.select("id").collect()) == [*range(5, 100), *range(200, 210)]
    assert sorted(p.name for p in folder.iterdir()) == ["a.db.zst", "b.db"]
    folder.chmod(0o755)


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    path, out = tmp_path / "a.db", str(tmp_path / "out")

    def run():
        q = spark.readStream.format("vigil_sqlite").option("rows", 7).option("after", 3).load(str(path)).select("id", "source").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    database(path, range(1, 21))
    assert run() == list(range(4, 21)) and run() == list(range(4, 21))
    database(path, [25, 30])
    assert run() == [*range(4, 21), 25, 30]


def archive(path, mode, members):
    with tarfile.open(path, mode) as tar:
        for name, raw in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))


MEMBERS = {"var/log/auth.log": b"one\r\ntwo\n\nlast", "var/log/empty": b"", "var/log/old.log.gz": gzip.compress(b"x\ny\n"), "var/log/big": b"".join(b"%d \xff\n" % k for k in range(50_000))}
LINES = {"var/log/auth.log": ["one", "two", "", "last"], "var/log/old.log.gz": ["x", "y"], "var/log/big": [f"{k} �" for k in range(50_000)]}


def by_member(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["path"], r["line_no"])):
        out.setdefault(r["path"], []).append(r["line"])
    return out


@pytest.mark.parametrize(("mode", "tasks"), [("w", 4), ("w:gz", 1), ("w:xz", 1)])
def test_lines_of_archives(spark, tmp_path, mode, tasks):
    archive(tmp_path / "a.tar", mode, MEMBERS)
    rows = spark.read.format("vigil_tar").load(str(tmp_path / "a.tar"))
    assert rows.rdd.getNumPartitions() == tasks and by_member(rows) == LINES


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_truncated_archives_keep_what_stands_before_the_break(spark, tmp_path, mode):
    archive(tmp_path / "a.tar", mode, MEMBERS)
    raw = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "a.tar").write_bytes(raw[: len(raw) // 2])
    got = by_member(spark.read.format("vigil_tar").load(str(tmp_path / "a.tar")))
    assert got["var/log/auth.log"] == LINES["var/log/auth.log"]
    big = got["var/log/big"]
    assert 1000 < len(big) < 50_000 and big[:-1] == LINES["var/log/big"][: len(big) - 1]
    (tmp_path / "none.tar").write_bytes(b"not an archive")
    assert spark.read.format("vigil_tar").load(str(tmp_path / "none.tar")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50, 64, 1000, 1 << 20])
def test_audit_records_by_byte_ranges(spark, tmp_path, size):
    records = [f"type=SYSCALL msg=audit(01/02/2024 03:04:05.{k}:7): pid={k}\ntype=CWD cwd=/é{'x' * (k % 90)}" for k in range(12)]
    text = "----\n" + "\n----\n".join(records[:6]) + "\n\n \n" + "\n\n".join(records[6:]) + "\n----\n"
    (tmp_path / "a.txt").write_text(text)
    rows = S.AusearchReader({"path": str(tmp_path / "a.txt"), "bytes": size})
    got = [r for p in rows.partitions() for r in rows.read(p)]
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == records
    if size == 64:
        df = spark.read.format("vigil_ausearch").option("bytes", size).load(str(tmp_path / "a.txt"))
        assert df.rdd.getNumPartitions() > 4 and sorted(r["pid"] for r in df.select(audit_record(F.col("record"))["fields"]["pid"].alias("pid")).collect()) == sorted(map(str, range(12)))
        assert df.count() == spark.createDataFrame([(text[5:-6],)], "t string").select(F.explode(audit_records(F.col("t")))).count()
