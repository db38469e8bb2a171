"""Mapped CSV files and tar.gz archives of them as flows, with what was rejected and what the files cover.

A row of the wrong shape fails the scan, or is counted if the mapping says so. A row with bad content is rejected with a
reason. Both kinds of file, headers or declared field names, go through the same expressions.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import unquote
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import flow_columns as C
from netloom.operators import statistics as S
from netloom.sources.flows import CONTRACT

TIMES = ("time_received", "time_end", "time_start")
BIG = (1 << 63) - 1
#: Bounds of the numeric fields and what a blank stands for.
NUMBERS = {
    "packets": (0, BIG, 0), "bytes": (0, BIG, 0), "src_tos": (0, 255, 0), "dst_tos": (0, 255, 0), "src_port": (0, 65_535, None),
    "dst_port": (0, 65_535, None), "min_ttl": (0, 255, None), "max_ttl": (0, 255, None), "flow_count": (1, BIG, 1),
}
#: What a strptime directive is in a datetime pattern (fixed values).
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "j": "DDD", "z": "XXX"}
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: What a run of pattern letters takes, as strptime does: numbers without leading zeros, one to six digits of a fraction.
ACCEPTED = {
    "yyyy": r"\d{4}", "yy": r"\d\d", "M": "1[0-2]|0[1-9]|[1-9]", "d": r"3[01]|[12]\d|0[1-9]|[1-9]| [1-9]", "H": r"2[0-3]|[01]\d|\d", "h": "1[0-2]|0[1-9]|[1-9]",
    "m": r"[0-5]\d|\d", "s": r"[0-5]\d|\d", "S": r"\d{1,6}", "a": "am|pm", "D": r"36[0-6]|3[0-5]\d|[12]\d\d|0[1-9]\d|00[1-9]|[1-9]\d|0[1-9]|[1-9]",
    "X": r"z|[+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?", "MMMM": "|".join(MONTH_NAMES), "MMM": "|".join(m[:3] for m in MONTH_NAMES),
}


def datetime_pattern(text: str) -> str:
    """A strptime format as a datetime pattern; a text without % is taken as it is."""
    if "%" not in text:
        return text
    out, i = "", 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            if text[i + 1] not in DIRECTIVES:
                raise ValueError(f"unknown directive %{text[i + 1]}")
            out += DIRECTIVES[text[i + 1]]
            i += 2
        else:
            out += f"'{text[i]}'" if text[i].isalpha() else text[i]
            i += 1
    return out


@dataclass
class CsvMapping:
    """How a CSV's columns map to the contract. columns: contract name to file column; fieldnames: for files without header."""

    columns: dict[str, str]
    source_id: str | None = None  # else the column that columns["source_id"] names
    fieldnames: list[str] | None = None
    delimiter: str = ","
    timestamp_format: str = "unix"  # unix, unix_ms or a datetime pattern
    timezone: str = "UTC"
    protocol_map: dict[str, int] = field(default_factory=dict)  # names of protocols, laid over the fixed ones
    skip_bad_column_count: bool = False
    member_contains: str = ""
    input_order: str = "timestamp_ascending"
    lag_buckets: int = 12
    include_contains: tuple[str, ...] = ("csv",)
    include_suffixes: tuple[str, ...] = (".tar.gz", ".tgz")
    exclude_suffixes: tuple[str, ...] = (".aria2", ".txt")
    quoted_breaks: bool = True  # quoted fields may have line breaks; False saves the look for files with such fields

    def __post_init__(self):
        if not any(t in self.columns for t in TIMES):
            raise ValueError(f"the mapping needs one of {', '.join(TIMES)}")
        if missing := [c for c in ("src_ip", "dst_ip") if c not in self.columns]:
            raise ValueError(f"the mapping lacks {missing}")
        if not self.source_id and "source_id" not in self.columns:
            raise ValueError("the mapping needs a source, as a value or a column")
        if len(self.delimiter) != 1:
            raise ValueError("the delimiter must be one character")
        if self.input_order not in ("timestamp_ascending", "unsorted"):
            raise ValueError("input_order must be timestamp_ascending or unsorted")
        if isinstance(self.lag_buckets, bool) or not isinstance(self.lag_buckets, int) or self.lag_buckets < 0:
            raise ValueError("the lag must be a whole number of buckets")
        if bad := [n for n, v in self.protocol_map.items() if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= 255]:
            raise ValueError(f"protocol numbers are 0 to 255: {bad}")
        ZoneInfo(self.timezone)
        if self.fieldnames and (missing := sorted({c for c in self.columns.values()} - set(self.fieldnames))):
            raise ValueError(f"the field names lack the mapped columns {missing}")

    @classmethod
    def from_payload(cls, payload: Mapping) -> CsvMapping:
        """The mapping of a JSON object, checked."""
        if not isinstance(payload, Mapping) or not isinstance(payload.get("columns"), Mapping):
            raise ValueError("the configuration must be an object with columns")
        columns = {k: v for k, v in payload["columns"].items() if v not in (None, "")}
        if not all(isinstance(x, str) for kv in columns.items() for x in kv):
            raise ValueError("columns map texts to texts")
        source = payload.get("source_id") or {}
        if source.get("column"):
            columns["source_id"] = source["column"]
        header, names = payload.get("has_header", True), payload.get("fieldnames")
        for key in ("has_header", "skip_bad_column_count", "quoted_breaks"):
            if not isinstance(payload.get(key, False), bool):
                raise ValueError(f"{key} must be true or false")
        if not header and not names:
            raise ValueError("fieldnames are required without a header")
        form = payload.get("timestamp_format", "unix")
        if form not in ("unix", "unix_ms", "datetime"):
            raise ValueError("timestamp_format must be unix, unix_ms or datetime")
        found = payload.get("discovery") or {}
        more = {k: tuple(found[k]) for k in ("include_contains", "include_suffixes", "exclude_suffixes") if found.get(k) is not None}
        return cls(
            columns, source.get("value") or None, None if header else list(names), payload.get("delimiter", ","),
            datetime_pattern(payload.get("datetime_format", "%Y-%m-%d %H:%M:%S")) if form == "datetime" else form, payload.get("timestamp_timezone", "UTC"),
            payload.get("protocol_map") or {}, payload.get("skip_bad_column_count", False), (payload.get("archive") or {}).get("member_contains") or "",
            payload.get("input_order", "timestamp_ascending"), payload.get("out_of_order_lag_buckets", 12), quoted_breaks=payload.get("quoted_breaks", True), **more,
        )


def milliseconds(text: Column, mapping: CsvMapping) -> Column:
    """Exact milliseconds since the epoch, null for what isn't a time or is finer."""
    if mapping.timestamp_format in ("unix", "unix_ms"):
        value = text.try_cast("decimal(38,9)") * (1000 if mapping.timestamp_format == "unix" else 1)
        return F.when(value == F.floor(value), value.try_cast("long"))
    wall, micros = _wall_clock(text, mapping.timestamp_format)
    seconds = C.epoch_of(F.convert_timezone(F.lit(mapping.timezone), F.lit("UTC"), wall))
    return F.when(F.pmod(micros, F.lit(1000)) == 0, seconds * 1000 + F.floor(micros / 1000)).cast("long")


def _wall_clock(text: Column, pattern: str) -> tuple[Column, Column]:
    """The local time that text has by a datetime pattern, null where it has none, and its microseconds. An offset is read and, as
    the mapping has a time zone, has no effect."""
    regex, fields = "", []
    for quoted, letters, space, other in _runs(pattern):
        if letters:
            key = letters if letters in ACCEPTED else letters[0]
            if key not in ACCEPTED:
                raise ValueError(f"unknown letters {letters} in the pattern {pattern}")
            regex += f"({ACCEPTED[key]})"
            fields.append(key)
        else:
            regex += r"\s+" if space else re.escape(quoted or other)
    lowered = F.lower(text)
    of = lambda key: F.regexp_extract(lowered, f"(?i)^{regex}$", fields.index(key) + 1) if key in fields else None
    number = lambda key, default: F.trim(of(key)).try_cast("int") if key in fields else F.lit(default)
    year = number("yyyy", 1900)
    if "yy" in fields:
        year = number("yy", 0) + F.when(number("yy", 0) < 69, 2000).otherwise(1900)
    month = number("M", 1)
    for key, width in (("MMMM", 12), ("MMM", 3)):
        if key in fields:
            month = F.array_position(F.array(*[F.lit(m[:width]) for m in MONTH_NAMES]), of(key)).cast("int")
    hour = number("H", 0)
    if "h" in fields:
        hour = number("h", 12) % 12 + F.when(of("a") == "pm", 12).otherwise(0) if "a" in fields else number("h", 0)
    wall = F.try_make_timestamp_ntz(year, month, number("d", 1), hour, number("m", 0), number("s", 0).cast("decimal(16,6)"))
    if "D" in fields and "M" not in fields:
        wall = F.try_add(wall, F.make_dt_interval(days=number("D", 1) - 1))
    micros = F.rpad(of("S"), 6, "0").try_cast("int") if "S" in fields else F.lit(0)
    return F.when(text.rlike(f"(?i)^{regex}$"), wall), micros


def _runs(pattern: str) -> list[tuple[str, str, str, str]]:
    """(quoted text, run of a letter, white space, other character): one of them in each place."""
    return [(q, run, space, other) for q, run, _, space, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|(\s+)|(.)", pattern)]


def _named(raw: DataFrame, names: list[str], mapping: CsvMapping, where: str) -> DataFrame:
    if missing := sorted({c for c in mapping.columns.values()} - set(names)):
        raise ValueError(f"{where} lacks the mapped columns {missing}")
    place = {n: k for k, n in enumerate(names)}
    return raw.select("locator", "block", "row_no", "bad", "blank", *[F.col(f"c{place[c]}").alias(n) for n, c in mapping.columns.items()])


def _options(mapping: CsvMapping, corrupt: str) -> dict:
    return {"sep": mapping.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "columnPruning": "false"}


def _shaped(raw: DataFrame, fields: list[Column], corrupt: Column, locator: Column) -> DataFrame:
    """(locator, block, row_no, bad, blank, c0, c1, ...): a row with other than the wanted number of fields is bad, one without
    content blank. Block and row number give the place in the file."""
    content = F.concat_ws("", *[F.trim(c) for c in fields], F.regexp_replace(F.coalesce(corrupt, F.lit("")), r"[\s,;|\t\"]", ""))
    return raw.select(locator.alias("locator"), "block", "row_no", corrupt.isNotNull().alias("bad"), (content == "").alias("blank"), *[c.alias(f"c{k}") for k, c in enumerate(fields)])


def file_rows(spark: SparkSession, paths: str | list[str], mapping: CsvMapping) -> DataFrame:
    """The mapped texts of plain files' rows; files with another header than the first fail."""
    if mapping.fieldnames:
        names = mapping.fieldnames
    else:
        names = spark.read.options(header=True, inferSchema=False, sep=mapping.delimiter, quote='"', escape='"').csv(paths).columns
    corrupt = "_corrupt"
    while corrupt in names:
        corrupt += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, corrupt]])
    reader = spark.read.options(**_options(mapping, corrupt)).schema(schema)
    if not mapping.fieldnames:
        reader = reader.options(header=True, enforceSchema=False)
    placed = lambda df: df.select("*", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    broken, whole = _with_breaks(spark, paths) if mapping.quoted_breaks else ([], [])
    if not broken:
        raw = placed(reader.csv(paths))
    else:  # by one task for each such file, as a line isn't a record there; the others are split
        raw = placed(reader.option("multiLine", True).csv(broken))
        if whole:
            raw = placed(reader.option("multiLine", False).csv(whole)).union(raw)
    raw = raw.toDF(*[f"f{k}" for k in range(len(names))], "corrupt", "file", "block", "row_no")
    return _named(_shaped(raw, [F.col(f"f{k}") for k in range(len(names))], F.col("corrupt"), F.col("file")), names, mapping, "the file")


def _with_breaks(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """Names of the files with a line that leaves a quote open, and of the others if there are any such."""
    file = F.col("_metadata.file_path").alias("file")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    broken = {r.file for r in spark.read.text(paths).where(quotes % 2 == 1).select(file).distinct().collect()}
    if not broken:
        return [], []
    all_files = [r.file for r in spark.read.format("binaryFile").load(paths).select(file).collect()]
    return sorted(map(unquote, broken)), [unquote(f) for f in all_files if f not in broken]


class _Forward(io.RawIOBase):
    """A member of an archive that is read as a stream, for readers that ask whether they may go back."""

    def __init__(self, member):
        self.member = member

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.member.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def archive_lines(spark: SparkSession, paths: list[str], member: str = "", at_once: int = 4096) -> DataFrame:
    """(locator, line_no, line) of the tar.gz archives' files whose name holds `member`. An archive is a stream that one task
    reads, some lines at a time; bytes that aren't UTF-8 are replaced."""
    schema = T.StructType([T.StructField("locator", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])

    def made(locator, first, lines):
        columns = [pa.array([locator] * len(lines), pa.string()), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["locator", "line_no", "line"])

    def run(it):
        from pyarrow import fs

        for b in it:
            for path in b.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with system.open_input_stream(inner, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile() and member in m.name:
                            held, first = [], 1
                            text = io.TextIOWrapper(io.BufferedReader(_Forward(tar.extractfile(m))), encoding="utf-8", errors="replace")
                            for n, line in enumerate(text, 1):
                                held.append(line.rstrip("\r\n"))
                                if len(held) == at_once:
                                    yield made(f"{path}:{m.name}", first, held)
                                    held, first = [], n + 1
                            yield made(f"{path}:{m.name}", first, held)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1)).mapInArrow(run, schema)


def archive_rows(lines: DataFrame, mapping: CsvMapping) -> DataFrame:
    """The mapped texts of archive lines (locator, line_no, line), which should be a stored table."""
    if mapping.fieldnames:
        return _parsed(lines, mapping.fieldnames, mapping)
    headers = [r.line for r in lines.where("line_no = 1").select("line").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError("the archive's files have different headers")
    names = [n.strip('"') for n in (headers[0] if headers else "").split(mapping.delimiter)]
    return _parsed(lines.where("line_no > 1"), names, mapping)


def _parsed(lines: DataFrame, names: list[str], mapping: CsvMapping) -> DataFrame:
    schema = ", ".join([f"f{k} string" for k in range(len(names))] + ["corrupt string"])
    block = F.floor(F.col("line_no") / (1 << 20)).alias("block")
    raw = lines.select("locator", block, F.col("line_no").alias("row_no"), F.from_csv("line", schema, _options(mapping, "corrupt")).alias("r"))
    return _named(_shaped(raw, [F.col(f"r.f{k}") for k in range(len(names))], F.col("r.corrupt"), F.col("locator")), names, mapping, "the archive")


class Scan:
    """The rows of a scan, each accepted, rejected for its content, or of the wrong shape. What is asked of a scan reads its files
    again, what is asked of a stored one doesn't."""

    def __init__(self, rows: DataFrame, mapping: CsvMapping, observed: Observation | None = None):
        self.rows, self.mapping, self._observed = rows, mapping, observed

    def stored(self, path: str) -> Scan:
        """The scan with its typed rows as a table at path, where none may be. The files are read once, for the table and the metrics."""
        observed = Observation()
        on = lambda c: F.count_if(F.coalesce(F.expr(c), F.lit(False)))
        seen = self.rows.observe(
            observed, F.count(F.lit(1)).alias("rows"), on("reason is null").alias("accepted_rows"), on("reason <> 'shape'").alias("rejected_rows"),
            on("reason = 'shape'").alias("skipped_bad_column_count"), F.min("covers").alias("first"), F.max("covers").alias("last"),
        )
        seen.write.parquet(path)
        return Scan(self.rows.sparkSession.read.schema(self.rows.schema).parquet(path), self.mapping, observed)

    @property
    def metrics(self) -> dict:
        """Of a stored scan, from the pass that stored it: rows, accepted_rows, rejected_rows, skipped_bad_column_count, and the first and
        last 5 minutes that rows cover (None without any)."""
        if self._observed is None:
            raise ValueError("the scan isn't stored")
        return self._observed.get

    def flows(self) -> DataFrame:
        """The accepted rows, by the contract."""
        return self.rows.where("reason is null").select(*CONTRACT)

    def rejected(self) -> DataFrame:
        return self.rows.where("reason <> 'shape'")

    def observed_bounds(self) -> DataFrame:
        """(source_id, first, last) over all rows whose source and time can be read, rejected ones too."""
        return self.rows.where("covers is not null").groupBy("source_id").agg(F.min("covers").alias("first"), F.max("covers").alias("last"))

    def report(self) -> DataFrame:
        """(locator, rows, rejected_rows, skipped_bad_column_count): one row for each file that has rows."""
        on = lambda c: F.count_if(F.expr(c))
        return self.rows.groupBy("locator").agg(F.count("*").alias("rows"), on("reason <> 'shape'").alias("rejected_rows"), on("reason = 'shape'").alias("skipped_bad_column_count"))

    def late_rows(self) -> DataFrame:
        """(locator, source_id, row_no, bucket_start) of rows that come after their bucket was emitted, file by file; none for
        a mapping that says that rows are not in order."""
        if self.mapping.input_order == "unsorted":
            return self.rows.select("locator", "source_id", "row_no", F.col("covers").alias("bucket_start")).limit(0)
        file_and_source = F.struct("locator", "source_id").alias("source_id")
        read = self.rows.where("covers is not null").select(file_and_source, "block", "row_no", F.col("covers").alias("bucket_start"))
        return S.late_rows(read, self.mapping.lag_buckets).select("source_id.*", "row_no", "bucket_start")

    def check_order(self) -> None:
        """Fail if a row comes after its bucket was emitted."""
        if late := self.late_rows().first():
            raise ValueError(f"{late.locator} is not in order: a row of {late.source_id} for {late.bucket_start} comes after its bucket was emitted")


def scan(rows: DataFrame, mapping: CsvMapping) -> Scan:
    """Normalise mapped texts (locator, block, row_no, bad, blank and a column for each mapped name)."""
    text = lambda n: F.nullif(F.trim(F.col(n)), F.lit("")) if n in mapping.columns else F.lit(None).cast("string")
    times = {t: milliseconds(text(t), mapping) for t in TIMES}
    chosen = F.coalesce(*[F.when(text(t).isNotNull(), F.struct(times[t].alias("ms"))) for t in TIMES]).getField("ms")  # the first that isn't blank
    end, start = times["time_end"], times["time_start"]
    source = F.lit(mapping.source_id) if mapping.source_id else text("source_id")
    src_ip, dst_ip = text("src_ip"), text("dst_ip")
    version = C.ip_version(src_ip)
    protocol = C.protocol_number(text("protocol"), mapping.protocol_map)
    values = {n: F.when(text(n).isNull(), F.lit(blank).cast("long")).otherwise(text(n).try_cast("long")) for n, (_, _, blank) in NUMBERS.items()}
    explicit = text("duration").try_cast("decimal(38,6)") * 1000
    reason = F.when(F.col("bad"), "shape" if mapping.skip_bad_column_count else F.raise_error(F.concat(F.lit("a row of the wrong number of fields in "), "locator")).cast("string"))
    reason = reason.when(source.isNull(), "source_id").when(chosen.isNull(), "timestamp")
    for t in TIMES:
        reason = reason.when(text(t).isNotNull() & times[t].isNull(), "timestamp")
    reason = reason.when(version.isNull() | C.ip_version(dst_ip).isNull() | (version != C.ip_version(dst_ip)), "address")
    reason = reason.when(protocol.isNull() | ~protocol.between(0, 255), "protocol")
    for n, (low, high, _) in NUMBERS.items():
        reason = reason.when(text(n).isNotNull() & (values[n].isNull() | ~values[n].between(low, high)), n)
    reason = reason.when(end < start, "duration").when(text("duration").isNotNull() & (explicit.isNull() | (explicit < 0) | (explicit != F.floor(explicit))), "duration")
    reason = reason.when(values["min_ttl"] > values["max_ttl"], "ttl")
    shaped = rows.where("not blank").select("*", reason.alias("reason"))
    return Scan(
        shaped.select(
            "locator", "block", "row_no", "reason", source.alias("source_id"), version.alias("ip_version"), src_ip.alias("src_ip"), dst_ip.alias("dst_ip"),
            C.ipv4_number(src_ip).alias("src_u32"), C.ipv4_number(dst_ip).alias("dst_u32"), protocol.alias("protocol"), *[values[n].alias(n) for n in NUMBERS if n != "dst_tos"],
            F.coalesce(explicit.try_cast("long"), end - start).alias("duration_ms"), F.floor(chosen / 1000).cast("long").alias("end_s"),
            F.when((F.col("reason").isNull() | (F.col("reason") != "shape")) & source.isNotNull(), C.floor_to(F.floor(chosen / 1000).cast("long"), C.FIVE_MINUTES)).alias("covers"),
        ),
        mapping,
    )


def scan_csv(spark: SparkSession, paths: str | list[str], mapping: CsvMapping) -> Scan:
    """Scan plain files."""
    return scan(file_rows(spark, paths, mapping), mapping)


def scan_archives(spark: SparkSession, paths: list[str], mapping: CsvMapping, lines_path: str) -> Scan:
    """Scan tar.gz archives: their lines become a table at lines_path, an ordinary scan reads it."""
    archive_lines(spark, paths, mapping.member_contains).write.mode("overwrite").parquet(lines_path)
    return scan(archive_rows(spark.read.parquet(lines_path), mapping), mapping)
