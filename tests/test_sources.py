import io
import ipaddress
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.operators import statistics as S
from netloom.sources import captures, csv_files, discovery
from netloom.sources.selection import Selection

F1 = ["te", "src", "dst", "proto", "packets", "bytes", "stos"]
MAP1 = dict(time_end="te", src_ip="src", dst_ip="dst", protocol="proto", packets="packets", bytes="bytes", src_tos="stos")


def csv(tmp_path, lines, name="a.csv"):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def mapping(**more):
    return csv_files.CsvMapping(MAP1, source_id="r1", fieldnames=F1, timestamp_format="yyyy-MM-dd HH:mm:ss", **more)


TWO = ["2016-07-27 13:43:30,192.0.2.1,198.51.100.1,6,3,300,3", "2016-07-27 13:44:00,192.0.2.2,198.51.100.2,UDP,2,200,0"]


def test_scopes_of_two_rows(spark, tmp_path):
    scan = csv_files.scan_csv(spark, csv(tmp_path, TWO), mapping())
    assert scan.rejected().count() == 0
    dense = S.dense(S.traffic(scan.flows()), scan.observed_bounds(), "5m").where("ip_version = 4")
    rows = {(r.src_visibility, r.dst_visibility): (r.flows, r.packets, r.bytes) for r in dense.collect()}
    a, n = "anonymized", "literal"
    assert rows == {("all", "all"): (2, 5, 500), (a, a): (1, 3, 300), (a, n): (0, 0, 0), (n, a): (0, 0, 0), (n, n): (1, 2, 200)}
    assert {r.avg_duration for r in dense.collect()} == {None}


def test_bad_rows_are_rejected_with_a_reason(spark, tmp_path):
    bad = ["2016-07-27 13:50:00,192.0.2.300,198.51.100.1,6,1,1,0", "x,192.0.2.1,198.51.100.1,6,1,1,0", "2016-07-27 13:50:00,192.0.2.1,2001:db8::1,6,1,1,0", "2016-07-27 13:50:00,192.0.2.1,192.0.2.2,NOPE,1,1,0", "2016-07-27 13:50:00,192.0.2.1,192.0.2.2,6,-1,1,0", "2016-07-27 13:50:00,192.0.2.1,192.0.2.2,6,1,1,256"]
    scan = csv_files.scan_csv(spark, csv(tmp_path, TWO + bad), mapping())
    assert scan.flows().count() == 2
    assert sorted(r.reason for r in scan.rejected().collect()) == ["address", "address", "packets", "protocol", "src_tos", "timestamp"]
    assert scan.report().first()[1:] == (8, 6, 0)
    for lines, m in ((["a,b", "1,2"], dict(fieldnames=None)), (["x"], dict(fieldnames=["te", "src"]))):
        with pytest.raises(ValueError, match="lack"):
            csv_files.scan_csv(spark, csv(tmp_path, lines, "h.csv"), csv_files.CsvMapping(MAP1, "r1", **m))


def test_rich_columns(spark, tmp_path):
    names = "tr,te,src,dst,sp,dp,proto,packets,bytes,stos,duration,lo,hi"
    line = "1469627010,1469627009,192.0.2.1,192.0.2.9,0,443,TCP,10,2048,2,1.234,31,64"
    blank = "1469627010,,192.0.2.1,192.0.2.9,,,1,,,,,,"
    dotted = "1469627010,,192.0.2.1,192.0.2.9,3.1,,1,,,,,,"
    m = csv_files.CsvMapping(dict(time_received="tr", time_end="te", src_ip="src", dst_ip="dst", src_port="sp", dst_port="dp", protocol="proto", packets="packets", bytes="bytes", src_tos="stos", duration="duration", min_ttl="lo", max_ttl="hi"), source_id="r1")
    scan = csv_files.scan_csv(spark, csv(tmp_path, [names, line, blank, dotted]), m)
    a, b = scan.flows().orderBy("packets", ascending=False).collect()
    assert (a.end_s, a.src_port, a.dst_port, a.duration_ms, a.min_ttl, a.max_ttl, a.flow_count) == (1469627010, 0, 443, 1234, 31, 64, 1)
    assert (b.src_port, b.dst_port, b.packets, b.duration_ms, b.min_ttl) == (None, None, 0, None, None)
    assert [r.reason for r in scan.rejected().collect()] == ["src_port"]  # dotted pseudo-ports are for captures


def test_captures_take_bucket_from_the_file_name(spark, tmp_path):
    d = tmp_path / "r7/2025/11/02"
    d.mkdir(parents=True)
    (d / "nfcapd.202511020115").write_text(",".join(captures.CAPTURE_FIELDS) + "\n1744733279.999,1744733000.001,1744732700.500,192.0.2.1,192.0.2.2,3.1,0,1,5,500,3,0,3,0,64\n")
    r = captures.read_captures(spark, str(d / "nfcapd.202511020115")).first()
    assert (r.source_id, r.end_s, r.duration_ms, r.flow_count, r.min_ttl, r.max_ttl, r.src_port) == ("r7", 1762071300, 299501, 3, None, 64, 0)


def test_protocol_names_of_the_reference_and_own_ones(spark, tmp_path):
    names = {"ICMPV6": 58, "ipip": 94, "Egp": 8, "RSVP": 46, "EIGRP": 88, "OSPFIGP": 89, "PIM": 103, "VRRP": 112, "IPv6-Frag": 44, "RSPF": 73, "mine": 200, "17": 17, "TCP": 66}
    lines = [f"2016-07-27 13:43:30,192.0.2.1,198.51.100.1,{n},{k},300,3" for k, n in enumerate(names)]
    scan = csv_files.scan_csv(spark, csv(tmp_path, lines), mapping(protocol_map={"Mine": 200, "tcp": 66}))
    assert [r.protocol for r in scan.flows().orderBy("packets").collect()] == list(names.values()) and scan.rejected().count() == 0
    d = tmp_path / "r7/2025/11/02"
    d.mkdir(parents=True)
    (d / "nfcapd.202511020115").write_text(",".join(captures.CAPTURE_FIELDS) + "\n1744733279.999,1744733000.001,1744732700.500,2001:db8::1,2001:db8::2,0,0,ICMPV6,5,500,3,0,3,0,64\n")
    assert captures.read_captures(spark, str(d / "nfcapd.202511020115")).first().protocol == 58


def test_rows_of_the_wrong_shape_fail_or_are_counted(spark, tmp_path):
    short, long = TWO[0].rsplit(",", 1)[0], TWO[0] + ",9"
    for bad in (short, long):
        with pytest.raises(Exception, match="wrong number of fields"):
            csv_files.scan_csv(spark, csv(tmp_path, [*TWO, bad]), mapping()).flows().collect()
    scan = csv_files.scan_csv(spark, csv(tmp_path, [*TWO, short, "", ",,,,,,", "  ", long]), mapping(skip_bad_column_count=True))
    assert scan.flows().count() == 2 and scan.rejected().count() == 0 and scan.report().first()[1:] == (4, 0, 2)
    header = ["te,src,dst,proto,packets,bytes,stos", *TWO, short]
    m = csv_files.CsvMapping(MAP1, "r1", timestamp_format="yyyy-MM-dd HH:mm:ss", skip_bad_column_count=True)
    assert csv_files.scan_csv(spark, csv(tmp_path, header), m).report().first()[1:] == (3, 0, 1)
    (tmp_path / "two").mkdir()
    csv(tmp_path / "two", header[:2], "a.csv")
    csv(tmp_path / "two", ["te,dst,src,proto,packets,bytes,stos", TWO[1]], "b.csv")
    with pytest.raises(Exception, match="header"):
        csv_files.scan_csv(spark, str(tmp_path / "two"), m).flows().collect()


def test_order_is_checked_file_by_file(spark, tmp_path):
    at = lambda minute: f"2016-07-27 {13 + minute // 60}:{minute % 60:02}:00,192.0.2.1,198.51.100.1,6,1,1,0"
    path = csv(tmp_path, [at(0), at(5), at(100), at(3), at(200), at(130)])
    scan = csv_files.scan_csv(spark, path, mapping())
    assert [r.bucket_start for r in scan.late_rows().orderBy("row_no").collect()] == [1469624400, 1469624400 + 130 * 60]
    with pytest.raises(ValueError, match="not in order"):
        scan.check_order()
    csv_files.scan_csv(spark, path, mapping(lag_buckets=24)).check_order()
    csv_files.scan_csv(spark, path, mapping(input_order="unsorted")).check_order()
    (tmp_path / "f").mkdir()
    csv(tmp_path / "f", [at(300)], "a.csv")
    csv(tmp_path / "f", [at(0)], "b.csv")  # files of a scan don't wait for each other
    csv_files.scan_csv(spark, str(tmp_path / "f"), mapping()).check_order()


def test_rejected_and_selected_out_rows_are_covered(spark, tmp_path):
    """The bucket of a rejected row is zero, not absent; so is that of a row that the selection leaves out."""
    lines = ["2016-07-27 13:40:00,192.0.2.1,198.51.100.1,6,3,300,1", "2016-07-27 13:50:00,192.0.2.300,198.51.100.1,6,1,1,0", "never,192.0.2.1,198.51.100.1,6,1,1,0"]
    scan = csv_files.scan_csv(spark, csv(tmp_path, lines), mapping())
    assert [tuple(r) for r in scan.observed_bounds().collect()] == [("r1", 1469626800, 1469627400)]
    dense = S.dense(S.traffic(scan.flows()), scan.observed_bounds(), "5m").where("ip_version = 4 and src_visibility = 'all'")
    assert [(r.bucket_start, r.flows) for r in dense.orderBy("bucket_start").collect()] == [(1469626800, 1), (1469627100, 0), (1469627400, 0)]
    chosen = Selection("192.0.2.99/24", "literal", "anonymized").select(scan.flows())
    assert chosen.count() == 1 and Selection("198.51.100.0/24", "anonymized").select(scan.flows()).count() == 0


def test_times_are_exact_milliseconds(spark):
    def ms(texts, **m):
        kind = csv_files.CsvMapping(MAP1, "r1", F1, **m)
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(csv_files.milliseconds(F.col("t"), kind)).collect()]

    assert ms(["1.234", "1.2340", "1.2345", "x", "-0.001", "1e3"]) == [1234, 1234, None, None, -1, 1000000]
    assert ms(["1234", "1.5"], timestamp_format="unix_ms") == [1234, None]
    zone = dict(timezone="America/Los_Angeles")
    form = csv_files.datetime_pattern("%Y-%m-%d %H:%M:%S")
    for session in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", session)
        assert ms(["2025-11-02 01:15:00", "2025-11-02 02:15:00", "2025-13-02 02:15:00"], timestamp_format=form, **zone) == [1762071300000, 1762078500000, None]  # the first fold
        assert ms(["2025-11-02T01:15:00.250000", "2025-11-02T01:15:00.250100"], timestamp_format=csv_files.datetime_pattern("%Y-%m-%dT%H:%M:%S.%f")) == [1762046100250, None]
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mapping_payloads_are_checked():
    good = {"columns": {"time_end": "te", "src_ip": "a", "dst_ip": "b"}, "source_id": {"value": "r1"}}
    m = csv_files.CsvMapping.from_payload(good | {"timestamp_format": "datetime", "has_header": False, "fieldnames": ["te", "a", "b"], "discovery": {"include_contains": []}})
    assert (m.timestamp_format, m.fieldnames, m.include_contains, m.include_suffixes) == ("yyyy-MM-dd HH:mm:ss", ["te", "a", "b"], (), (".tar.gz", ".tgz"))
    assert csv_files.CsvMapping.from_payload({**good, "source_id": {"column": "s"}}).columns["source_id"] == "s"
    for bad in (
        {"columns": {"src_ip": "a", "dst_ip": "b"}}, {"columns": {"time_end": "t", "src_ip": "a"}}, {"source_id": {}}, {"delimiter": ";;"}, {"has_header": False}, {"has_header": "no"},
        {"timestamp_format": "when"}, {"timestamp_timezone": "Mars/Base"}, {"input_order": "random"}, {"out_of_order_lag_buckets": -1}, {"out_of_order_lag_buckets": True}, {"protocol_map": {"x": 256}}, {"columns": None},
    ):
        with pytest.raises((ValueError, KeyError)):
            csv_files.CsvMapping.from_payload(good | bad)


CAPTURE = ["1744733279.999", "1744733000.001", "1744732700.500", "192.0.2.1", "192.0.2.2", "3.1", "0", "1", "5", "500", "3", "0", "3", "0", "64"]


@pytest.mark.parametrize(
    "change",
    [(5, "99999999999"), (5, "70000"), (5, "3.256"), (5, "3.1.1"), (6, ""), (7, "6"), (7, "300"), (7, ""), (10, "300"), (11, "256"), (8, "-5"), (8, "1.5"), (12, "0"), (1, "1744732700.499"), (13, "65"), (14, "256"), (0, "soon"), (0, "1.2345"), (3, "2:1"), (3, "192.0.02.1"), (4, "2001:db8::1"), (3, None)],
)
def test_a_malformed_capture_row_fails(spark, change):
    row = list(CAPTURE)
    schema = "locator string, corrupt string, " + ", ".join(f"{c} string" for c in captures.CAPTURE_FIELDS)
    of = lambda r: captures.capture_flows(spark.createDataFrame([("/c/r7/2025/11/02/nfcapd.202511020115", None, *r)], schema))
    assert of(row).first().end_s == 1762071300
    row[change[0]] = change[1]
    with pytest.raises(Exception, match="malformed"):
        of(row).collect()


def test_capture_files_fail_as_a_whole(spark, tmp_path):
    d = tmp_path / "r7/2025/11/02"
    d.mkdir(parents=True)
    names, path = list(captures.CAPTURE_FIELDS), d / "nfcapd.202511020115"

    def read(lines, p=path):
        p.write_text("\n".join(lines) + "\n")
        return captures.read_captures(spark, str(p)).collect()

    header, row = ",".join(names), ",".join(CAPTURE)
    assert len(read([header, row])) == 1 and read([header, captures.NO_FLOWS]) == []
    names[5], names[6] = names[6], names[5]
    for lines in ([",".join(names), row], [header, row + ",1"], [header, row.rsplit(",", 1)[0]]):
        with pytest.raises(Exception):  # noqa: B017
            read(lines)
    with pytest.raises(Exception, match="file name"):
        read([header, row], d / "nfcapd.202513020115")


def test_archives_are_scans(spark, tmp_path):
    header = "te,src,dst,proto,packets,bytes,stos"
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, content in (("a.csv", f"{header}\n{TWO[0]}\n{TWO[0]},x\n".encode()), ("b.csv", f"{header}\r\n{TWO[1]}\r\n\xff,,,,,,\r\n".encode("latin-1")), ("c.txt", b"no\n")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    m = csv_files.CsvMapping(MAP1, "r1", timestamp_format="yyyy-MM-dd HH:mm:ss", skip_bad_column_count=True, member_contains=".csv")
    scan = csv_files.scan_archives(spark, [str(tmp_path / "x.tar.gz")], m, f"file://{tmp_path}/lines")
    assert sorted(r.packets for r in scan.flows().collect()) == [2, 3]
    assert {(r.locator.rsplit(":", 1)[1], r.rejected_rows, r.skipped_bad_column_count) for r in scan.report().collect()} == {("a.csv", 0, 1), ("b.csv", 1, 0)}
    small = csv_files.archive_lines(spark, [str(tmp_path / "x.tar.gz")], ".csv", at_once=1)
    assert [tuple(r)[1:] for r in small.where("locator like '%a.csv'").orderBy("line_no").collect()] == [(1, header), (2, TWO[0]), (3, TWO[0] + ",x")]


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(1)
    cases = ["::", "2:1", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "01.2.3.4", "256.1.1.1", "2001:db8::8:800:200c:417a", "::1.2.3.4.5", ":1::2", "1::2:"]
    cases += ["".join(rng.choice([":", "::", "1", "ab", "0", "1.2.3.4", "ffff"]) for _ in range(rng.randint(1, 13))) for _ in range(2000)]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", C.ip_version(F.col("t"), strict=True).alias("v"), C.ip_digits(F.col("t")).alias("d")).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.t)
            assert (r.v, r.d) == (a.version, f"{int(a):0{8 if a.version == 4 else 32}x}")
        except ValueError:
            assert r.v is None


def test_selections(spark):
    rows = [(4, "10.0.0.1", "192.168.1.9", 167772161, 3232235785, 0), (6, "2001:db8::1", "2001:db8:1::1", None, None, 2), (6, "::1", "2001:db8::ffff:0:1", None, None, 3)]
    flows = spark.createDataFrame(rows, "ip_version int, src_ip string, dst_ip string, src_u32 long, dst_u32 long, src_tos long")
    n = lambda *a: Selection(*a).select(flows).count()
    assert (n("192.168.0.77/16"), n("11.0.0.0/8"), n("0.0.0.0/0"), n("2001:db8::/32"), n("2001:db8:1::/48"), n("::/0"), n("2001:db8::/32", "anonymized", "anonymized"), n(None, "literal")) == (1, 0, 1, 2, 1, 2, 1, 1)
    assert Selection.from_payload(None).payload() == {"version": 1, "kind": "all"} and Selection.from_payload({"ip_prefix": ""}).unrestricted
    assert Selection.from_payload({"ip_prefix": "192.0.2.99/24", "src_visibility": "literal"}).payload() == {"version": 1, "kind": "flows", "ip_prefix": "192.0.2.0/24", "src_visibility": "literal", "dst_visibility": None}
    for bad in ({"x": 1}, {"version": 2}, {"kind": "some"}, {"kind": "all", "ip_prefix": "10.0.0.0/8"}, {"ip_prefix": "10.0.0.0/40"}, {"src_visibility": "all"}, []):
        with pytest.raises(ValueError):
            Selection.from_payload(bad)


def test_discovery(spark, tmp_path):
    for name in ("b_march.week2.csv.gz", "a_march_week1.csv", "z-january-week3.csv", "other.csv", "notes.csv.txt", "x.tar.gz", "late_week1.csv", "late_week1.csv.aria2", "plain.json"):
        (tmp_path / name).write_text("x")
    files = discovery.files_below(spark, f"file://{tmp_path}").select("path")
    found = discovery.csv_files(files, csv_files.CsvMapping(MAP1, "r1"))
    assert [r.name for r in found.collect()] == ["z-january-week3.csv", "a_march_week1.csv", "b_march.week2.csv.gz", "other.csv", "x.tar.gz"]
    paths = ["/d/m1/2025/11/02/nfcapd.202511020115", "/d/m1/2025/11/02/nfcapd.202511020125", "/d/m1/2025/11/02/nfcapd.current", "/d/m1/x/nfcapd.202511020115"]
    caps = discovery.captures(spark.createDataFrame([(p,) for p in paths], "path string"))
    bounds = discovery.extended(discovery.source_bounds(caps), spark.createDataFrame([("m1",), ("m2",)], "source_id string"), 1762071600, 1762071900)
    gaps = discovery.with_gaps(caps, bounds)
    want = {("m1", 1762071300, paths[0], False), ("m1", 1762071600, "gap://nfcapd/m1/202511020120", True), ("m1", 1762071900, paths[1], False), ("m2", 1762071600, "gap://nfcapd/m2/202511020120", True), ("m2", 1762071900, "gap://nfcapd/m2/202511020125", True)}
    assert {tuple(r) for r in gaps.collect()} == want
    members = spark.createDataFrame([("both", "m1"), ("both", "m2"), ("m2", "m2")], "source_id string, member_id string")
    assert {tuple(r) for r in discovery.logical_inputs(gaps, members).collect()} == {("both", 1762071300, 1, 0), ("both", 1762071600, 0, 2), ("both", 1762071900, 1, 1), ("m2", 1762071600, 0, 1), ("m2", 1762071900, 0, 1)}


def test_datetimes_are_as_lax_as_strptime(spark):
    import datetime as dt
    import random
    from zoneinfo import ZoneInfo

    r = random.Random(4)
    texts = ["2024-1-5 0:00:01", "2024-01-05 00:00:60", "2024-02-30 1:1:1", "2024-2-29  7:08:09", "24-01-05 00:00:01", " 2024-01-05 00:00:01", "2024-01-05 00:00:1x", "2024-1-5 24:00:00", ""]
    forms = {
        "%Y-%m-%d %H:%M:%S": texts, "%d/%b/%y %I:%M %p": ["5/jan/24 12:30 AM", "05/DEC/69 1:05 pm", "5/january/24 1:00 am", "31/Feb/24 1:00 am", "5/May/68 12:00 PM"],
        "%Y%m%d%H%M%S": ["20240105000001", "202415000001"], "%Y-%m-%dT%H:%M:%S.%f%z": ["2024-01-05T00:00:01.5+02:00", "2024-01-05T00:00:01.25Z", "2024-01-05T00:00:01.000001-0730", "2024-01-05T00:00:01.123000+1"],
        "%j %Y": ["60 2024", "366 2024", "0 2024"], "%B %d %Y": ["January 5 2024", "MAY 05 2024"],
    }
    forms["%Y-%m-%d %H:%M:%S"] += [f"{r.randrange(1970, 2040)}-{r.randrange(1, 14)}-{r.randrange(1, 32):02d} {r.randrange(25)}:{r.randrange(60)}:{r.randrange(61):02d}" for _ in range(200)]
    for form, values in forms.items():
        want = []
        for t in values:
            try:
                at = dt.datetime.strptime(t.strip(), form)
                ms = at.replace(tzinfo=ZoneInfo("America/Los_Angeles")) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
                want.append(None if at.microsecond % 1000 else ms // dt.timedelta(milliseconds=1))
            except ValueError:
                want.append(None)
        m = csv_files.CsvMapping(MAP1, "r1", F1, timestamp_format=csv_files.datetime_pattern(form), timezone="America/Los_Angeles")
        got = [x.ms for x in spark.createDataFrame(list(enumerate(values)), "n int, t string").select("n", csv_files.milliseconds(F.trim("t"), m).alias("ms")).orderBy("n").collect()]
        assert list(zip(values, got, strict=True)) == list(zip(values, want, strict=True))


def test_quoted_fields_may_have_line_breaks(spark, tmp_path):
    head = "te,src,dst,proto,packets,bytes,stos,note"
    a, b = (x + ',"one\ntwo ""2"", 3"' for x in TWO)
    (tmp_path / "in").mkdir()
    csv(tmp_path / "in", [head, a, b], "broken a.csv")
    csv(tmp_path / "in", [head, TWO[0] + ",plain"], "plain.csv")
    m = csv_files.CsvMapping(MAP1, "r1", timestamp_format="yyyy-MM-dd HH:mm:ss")
    assert csv_files.scan_csv(spark, f"file://{tmp_path}/in", m).flows().count() == 3
    with pytest.raises(Exception, match="wrong number of fields"):
        csv_files.scan_csv(spark, f"file://{tmp_path}/in", csv_files.CsvMapping(MAP1, "r1", timestamp_format="yyyy-MM-dd HH:mm:ss", quoted_breaks=False)).flows().collect()
    (tmp_path / "open").mkdir()
    csv(tmp_path / "open", [head, TWO[0] + ',"never closed', TWO[1] + ",x"], "a.csv")  # as Python's reader has it, the field goes on to the end
    assert csv_files.scan_csv(spark, f"file://{tmp_path}/open", m).report().first().rows == 1


def test_a_stored_scan_reads_its_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, rows in (("a", ["1,192.0.2.1,192.0.2.2", "x,192.0.2.1,192.0.2.2", "1"]), ("b", ["700,192.0.2.1,192.0.2.2"])):
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(["when,src,dst", *rows]) + "\n")
    m = csv_files.CsvMapping({"time_end": "when", "src_ip": "src", "dst_ip": "dst"}, "r1", skip_bad_column_count=True)
    scan = csv_files.scan_csv(spark, f"file://{tmp_path}/in", m)
    with pytest.raises(ValueError, match="isn't stored"):
        scan.metrics
    stored = scan.stored(f"file://{tmp_path}/rows")
    assert stored.metrics == {"rows": 4, "accepted_rows": 2, "rejected_rows": 1, "skipped_bad_column_count": 1, "first": 0, "last": 600}
    same = lambda f: sorted(map(tuple, f(scan).collect())) == sorted(map(tuple, f(stored).collect()))
    assert same(lambda s: s.flows()) and same(lambda s: s.report()) and same(lambda s: s.observed_bounds()) and same(lambda s: s.rejected())
    for f in tmp_path.glob("in/*.csv"):
        f.unlink()  # nothing reads the files again
    stored.check_order()
    assert stored.flows().count() == 2 and stored.report().count() == 2
    none = csv_files.scan(csv_files._parsed(spark.createDataFrame([], "locator string, line_no long, line string"), ["when", "src", "dst"], m), m)
    assert none.stored(f"file://{tmp_path}/none").metrics == {"rows": 0, "accepted_rows": 0, "rejected_rows": 0, "skipped_bad_column_count": 0, "first": None, "last": None}
