"""Sources that Spark plans through its Python Data Source API: spark.read.format(...) after register(spark).

vigil_sqlite    rows of a table of SQLite event databases (also .zst), by ranges of row numbers; also as a stream from an id cursor
vigil_tar       lines of the members of tar archives (also compressed), a task for each member of a plain one
vigil_ausearch  records of ausearch text files, by byte ranges

path is a file, a folder or a glob on a folder that driver and executors both mount. The driver reads headers and row
numbers only; nothing is unpacked on it."""

from __future__ import annotations

import glob
import gzip
import os
import sqlite3
import tarfile
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.types import StructType

ROWS = 10_000


def paths_of(options: dict) -> list[str]:
    path = options.get("path", "").removeprefix("file://").removeprefix("file:")
    if not path:
        raise ValueError("no path given")
    if os.path.isdir(path):
        return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names)
    if not (found := sorted(glob.glob(path))):
        raise FileNotFoundError(path)
    return found


# SQLite.
@dataclass
class Rows(S.InputPartition):
    """Rows low <= rowid < high of a database; part k of n of a packed one, whose row numbers are known only once unpacked."""

    path: str
    low: int = 0
    high: int = 0
    k: int = 0
    n: int = 0


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


def bounds(path: str, table: str) -> tuple[int, int]:
    """Least row number and one more than the greatest; (0, 0) without rows."""
    db = opened(path)
    try:
        low, high = db.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
    except sqlite3.OperationalError as e:
        raise ValueError(f"no table {table!r} in {path}") from e
    finally:
        db.close()
    return (0, 0) if low is None else (low, high + 1)


def condition(f: S.Filter, kinds: dict[str, str]) -> tuple[str, str, list] | None:
    """(column, SQL, parameters) of a pushed filter on one column with plain values; None if it can't be pushed. Columns
    hold values of any type: those of another type than the schema's pass, for Spark to look at."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in kinds:
        return None
    name = '"' + column.replace('"', '""') + '"'
    types = "('text')" if kinds[column] == "string" else "('integer', 'real')"
    or_other = f"or typeof({name}) not in {types}"
    plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
    signs = {S.EqualTo: "=", S.GreaterThan: ">", S.GreaterThanOrEqual: ">=", S.LessThan: "<", S.LessThanOrEqual: "<="}
    if type(f) in signs and plain(f.value):
        return column, f"({name} {signs[type(f)]} ? {or_other})", [f.value]
    if isinstance(f, S.In) and f.value and all(map(plain, f.value)) and len(f.value) <= 500:
        return column, f"({name} in ({', '.join('?' * len(f.value))}) {or_other})", list(f.value)
    if isinstance(f, S.IsNotNull):
        return column, f"{name} is not null", []
    return None


class _Table:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.fields, self.options = [(f.name, f.dataType.typeName()) for f in schema.fields], options
        self.table, self.range = options.get("table", "events"), int(options.get("rows", 200_000))
        self.where: list[tuple[str, str, list]] = []

    def ranges(self, path: str, low: int, high: int) -> list[Rows]:
        return [Rows(path, k, min(k + self.range, high)) for k in range(low, high, self.range)]

    def read(self, p: Rows) -> Iterator[tuple]:
        if not p.n:
            yield from self.rows(p.path, p.low, p.high)
            return
        import zstandard

        with tempfile.TemporaryDirectory() as folder:  # the executor's own; gone when the task ends
            plain = os.path.join(folder, "plain.db")
            with open(p.path, "rb") as packed, open(plain, "wb") as out:
                zstandard.ZstdDecompressor().copy_stream(packed, out)
            low, high = bounds(plain, self.table)
            size = -(-(high - low) // p.n)
            yield from self.rows(plain, low + p.k * size, min(low + (p.k + 1) * size, high))

    def rows(self, path: str, low: int, high: int) -> Iterator[tuple]:
        db = opened(path)
        held = {r[1] for r in db.execute(f'pragma table_info("{self.table}")')}
        wanted = ", ".join(f'"{n}"' if n in held else "null" for n, _ in self.fields)
        asked = [w for w in self.where if w[0] in held]
        more = "".join(f" and {c}" for _, c, _ in asked)
        values = [v for _, _, vs in asked for v in vs]
        kinds = [k for _, k in self.fields]
        found = db.execute(f'select {wanted} from "{self.table}" where rowid >= ? and rowid < ?{more}', (low, high, *values))
        while got := found.fetchmany(ROWS):
            for row in got:
                yield tuple(_as(v, k) for v, k in zip(row, kinds, strict=True))
        db.close()


def _as(value: object, kind: str) -> object:
    """SQLite columns hold values of any type: what doesn't fit the schema is null."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    try:
        return int(value) if kind in ("integer", "long") else float(value) if kind == "double" else value
    except (TypeError, ValueError):
        return None


class SqliteReader(_Table, S.DataSourceReader):
    def pushFilters(self, filters: list[S.Filter]) -> Iterable[S.Filter]:  # noqa: N802
        """Filters go to the databases where they can; Spark applies all of them again to the rows that come."""
        kinds = {n: k for n, k in self.fields if k in ("string", "integer", "long", "double")}
        self.where += [made for f in filters if (made := condition(f, kinds)) is not None]
        return filters

    def partitions(self) -> list[Rows]:
        out: list[Rows] = []
        parts = int(self.options.get("parts", 1))
        for path in paths_of(self.options):
            out += [Rows(path, k=k, n=parts) for k in range(parts)] if path.endswith(".zst") else self.ranges(path, *bounds(path, self.table))
        return out or [Rows("", 0, 0)]

    def read(self, p: Rows) -> Iterator[tuple]:
        return _Table.read(self, p) if p.path else iter(())


class SqliteStream(_Table, S.DataSourceStreamReader):
    """Rows appended to one database, by row number; offsets are {"after": row number}."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": int(self.options.get("after", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        (path,) = paths_of(self.options)
        return {"after": max(bounds(path, self.table)[1] - 1, self.initialOffset()["after"])}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        (path,) = paths_of(self.options)
        return self.ranges(path, start["after"] + 1, end["after"] + 1)

    def read(self, p: Rows) -> Iterator[tuple]:
        return _Table.read(self, p)

    def commit(self, end: dict) -> None:
        """Nothing to do: the database keeps its rows, the query's checkpoint is the cursor."""


class SqliteSource(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vigil_sqlite"

    def schema(self) -> str:
        from vigilspark.sources.store import CAMPAIGN_SCHEMA, EVENT_SCHEMA

        table = self.options.get("table", "events")
        if table not in ("events", "campaigns"):
            raise ValueError("give a schema for tables other than events and campaigns")
        return (EVENT_SCHEMA if table == "events" else CAMPAIGN_SCHEMA).replace("timestamp_ntz", "string")

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> SqliteStream:  # noqa: N802
        return SqliteStream(schema, dict(self.options))


# Archives.
@dataclass
class Member(S.InputPartition):
    """A member's bytes in a plain archive; a compressed archive whole where name is None."""

    archive: str
    name: str | None = None
    offset: int = 0
    size: int = 0


def lines_of(archive: str, name: str, f: object) -> Iterator[tuple]:
    """Lines of a file object, up to where it breaks off; members that are gzip files themselves are decompressed."""
    source = gzip.GzipFile(fileobj=f) if name.endswith(".gz") else f
    try:
        for k, raw in enumerate(source):
            yield archive, name, k, raw.rstrip(b"\r\n").decode("utf-8", "replace")
    except (tarfile.ReadError, EOFError, OSError):
        return


class _Part:
    """A file object's next size bytes, by lines."""

    def __init__(self, f: object, size: int) -> None:
        self.f, self.left = f, size

    def read(self, n: int = -1) -> bytes:
        got = self.f.read(self.left if n is None or n < 0 else min(n, self.left))
        self.left -= len(got)
        return got

    def __iter__(self) -> Iterator[bytes]:
        while self.left and (line := self.f.readline(self.left)):
            self.left -= len(line)
            yield line


class TarReader(S.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Member]:
        out: list[Member] = []
        for path in paths_of(self.options):
            try:
                with tarfile.open(path, "r:") as tar:  # reads headers and skips what is between
                    try:
                        out += [Member(path, m.name, m.offset_data, m.size) for m in tar if m.isreg()]
                    except (tarfile.ReadError, EOFError):  # truncated: the members before the break
                        out += [Member(path, m.name, m.offset_data, m.size) for m in tar.members if m.isreg()]
            except tarfile.ReadError:
                out.append(Member(path))
        return out or [Member("")]

    def read(self, p: Member) -> Iterator[tuple]:
        if p.name is not None:
            with open(p.archive, "rb") as f:
                f.seek(p.offset)
                yield from lines_of(p.archive, p.name, _Part(f, p.size))
        elif p.archive:
            try:
                with tarfile.open(p.archive, "r|*") as tar:  # one pass, a member at a time
                    for m in tar:
                        if m.isreg():
                            yield from lines_of(p.archive, m.name, tar.extractfile(m))
            except (tarfile.ReadError, EOFError, OSError):
                return


class TarSource(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vigil_tar"

    def schema(self) -> str:
        return "archive string, path string, line_no long, line string"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(dict(self.options))


# Audit records.
@dataclass
class Bytes(S.InputPartition):
    path: str
    start: int
    end: int


class AusearchReader(S.DataSourceReader):
    """Records are what lines of four dashes and blank lines part; a record is its range's in which it starts."""

    def __init__(self, options: dict) -> None:
        self.options, self.size = options, int(options.get("bytes", 32 << 20))

    def partitions(self) -> list[Bytes]:
        return [Bytes(p, k, k + self.size) for p in paths_of(self.options) for k in range(0, max(os.path.getsize(p), 1), self.size)]

    def read(self, p: Bytes) -> Iterator[tuple]:
        with open(p.path, "rb") as f:
            held: list[bytes] = []
            at, open_record = p.start, False
            if p.start:
                # A line that the range before began is that one's; so is a record that it began.
                f.seek(p.start - 1)
                at += len(f.readline()) - 1
                open_record = not self.parted(p.path, at)
            first = at
            for line in f:
                if line.strip() in (b"----", b""):
                    if held:
                        yield self.record(p.path, first, held)
                        held = []
                    open_record = False
                    if at + len(line) >= p.end:
                        return
                elif not open_record:
                    if not held:
                        if at >= p.end:
                            return
                        first = at
                    held.append(line)
                at += len(line)
            if held:
                yield self.record(p.path, first, held)

    @staticmethod
    def parted(path: str, at: int) -> bool:
        """Whether the line that ends before the place parts records."""
        with open(path, "rb") as f:
            low = max(0, at - 64)
            f.seek(low)
            before = f.read(at - low).split(b"\n")
        return len(before) >= 2 and before[-2].strip() in (b"----", b"")

    @staticmethod
    def record(path: str, first: int, held: list[bytes]) -> tuple:
        return path, first, b"".join(held).decode("utf-8", "replace").strip()


class AusearchSource(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vigil_ausearch"

    def schema(self) -> str:
        return "path string, offset long, record string"

    def reader(self, schema: StructType) -> AusearchReader:
        return AusearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (SqliteSource, TarSource, AusearchSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
