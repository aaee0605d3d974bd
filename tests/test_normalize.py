"""Normalization from XML and message text, with reject reasons."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.functions import scalars as S
from huntframe.functions import timestamps as TS
from huntframe.operators import normalize as N

HEAD = (
    '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Sensor"/>'
    '<EventID>{code}</EventID><TimeCreated SystemTime="2026-05-01T10:00:00.1234567Z"/><Channel>Op</Channel>'
    "<Computer> HOST </Computer></System>"
)


def xml(code, **data):
    fields = "".join(f'<Data Name="{k}">{v}</Data>' for k, v in data.items())
    return HEAD.format(code=code) + f"<EventData>{fields}</EventData></Event>"


PROCESS = dict(
    UtcTime="2026-05-01 10:00:00.123456", ProcessGuid="{g}", ProcessId="10", Image=r"C:\Tools\a.exe",
    CommandLine='a.exe "b c" d', User=r"CORP\ann\x", Hashes="SHA256=AA, MD5 = bb,junk", ParentProcessId="4",
    ParentImage="C:/Windows/explorer.exe",
)


def normalize(spark, *docs):
    return N.normalize_xml(spark.createDataFrame([(d,) for d in docs], "xml string")).collect()


def test_process_event(spark):
    (r,) = normalize(spark, xml(1, **PROCESS))
    assert r.error_reason is None and r["@timestamp"].endswith("1234567Z") and r.host.name == "HOST"
    assert (r.event.code, r.event.category, r.event.created) == (1, ["process"], "2026-05-01T10:00:00.123Z")
    assert (r.process.pid, r.process.name, r.process.args) == (10, "a.exe", ["a.exe", '"b c"', "d"])
    assert r.process.hash == {"sha256": "AA", "md5": "bb"} and r.process.parent.name == "explorer.exe"
    assert (r.user.domain, r.user.name) == ("CORP", r"ann\x")
    assert r.file is None and r.registry is None and r.tags == ["ecs_normalized", "sysmon_event_1"]


def test_other_events(spark):
    net, fil, reg = normalize(
        spark,
        xml(3, ProcessId="1", Image="x.exe", Protocol="TCP", Initiated=" True ", SourcePort="1", DestinationPort="2", DestinationIp="1.1.1.1"),
        xml(11, ProcessId="1", TargetFilename=r"C:\d\f.tar.gz"),
        xml(13, ProcessId="1", TargetObject=r"HKCU\Run\v", Details="x"),
    )
    assert (net.network.transport, net.network.direction, net.destination.port) == ("tcp", "outbound", 2)
    assert (fil.file.name, fil.file.extension) == ("f.tar.gz", "gz")
    assert (reg.registry.value, reg.registry.data.strings) == ("v", ["x"])
    assert net.data_stream.namespace == "phase12" and net.event.created is None


@pytest.mark.parametrize(
    "doc,reason",
    [
        (xml(1, **PROCESS)[:120], "malformed_xml"),
        (xml(7, ProcessId="1"), "unsupported_event_id"),
        (xml(1, **{**PROCESS, "ProcessId": "x"}), "bad_integer:ProcessId"),
        (xml(1, **{**PROCESS, "UtcTime": "yesterday"}), "bad_utc_time"),
        (xml(3, ProcessId="1", SourcePort="1"), "bad_integer:DestinationPort"),
        (HEAD.format(code=11) + "</Event>", "missing_element:EventData"),
        ("<Event><EventData/></Event>", "missing_element:System"),
    ],
)
def test_reject_reasons(spark, doc, reason):
    (r,) = normalize(spark, doc)
    assert r.error_reason == reason


def test_repeated_names_keep_the_last_and_empty_text_stays(spark):
    doc = xml(11, ProcessId="1", TargetFilename="a").replace(
        "</EventData>", '<Data Name="TargetFilename">b</Data><Data Name="E"></Data><Data>x</Data></EventData>'
    )
    (r,) = normalize(spark, doc)
    assert r.file.path == "b" and r.sysmon.event_data["E"] == "" and len(r.sysmon.event_data) == 3


MESSAGE = "Process Create:\r\nUtcTime: 2026-05-01 10:00:00.5\nProcessId: 4\nImage: C:\\a\\b.exe\nCommandLine: b.exe x\n  y z\nComputer: H"


def records(spark, *rows):
    return N.normalize_records(spark.createDataFrame(rows, schemas.LOG_RECORD)).collect()


def test_message_text(spark):
    (r,) = records(spark, (9, 1, "", "", MESSAGE, ""))
    assert r["@timestamp"] == "2026-05-01T10:00:00.500Z" and r.event.id == "9" and r.host.name == "H"
    assert r.process.command_line == "b.exe x\ny z" and r.process.parent is None and r.user is None
    assert "realtime_message_fallback" in r.tags and r.sysmon.message_fields["ProcessId"] == "4"


def test_xml_first_then_message_then_reject(spark):
    good = xml(11, ProcessId="1", TargetFilename="f")
    a, b, c, d = sorted(
        records(
            spark,
            (1, 11, "2026-05-01 09:00:00", "p", MESSAGE, good),
            (2, 1, "2026-05-01T09:00:00Z", "p", MESSAGE, good[:90]),
            (3, 1, "", "p", "", good[:90]),
            (4, 99, "2026-05-01 09:00:00.25", "", "Note:\nplain: value", ""),
        ),
        key=lambda r: r.winlog.record_id,
    )
    assert a.file.path == "f" and a.raw.message == MESSAGE and a.event.created == a["@timestamp"]
    assert b.process.name == "b.exe" and b["@timestamp"] == "2026-05-01T09:00:00.000Z" and b.error_reason is None
    assert c.error_reason == "malformed_xml"
    assert d.event.category == ["event"] and d.event.action == "Sysmon Event 99"


def test_split_and_fail_fast(spark):
    df = N.normalize_xml(spark.createDataFrame([(xml(11, ProcessId="1"),), ("<x",)], "xml string"))
    good, rejects = N.split_rejects(df)
    assert good.count() == 1 and rejects.first().original == "<x"
    with pytest.raises(Exception, match="invalid telemetry row"):
        N.fail_on_rejects(df).collect()


def test_metadata_raw_form_and_exclusion(spark):
    df = N.normalize_xml(spark.createDataFrame([(xml(1, **PROCESS),)], "xml string"))
    tagged = N.with_test_metadata(df.drop("error_reason"), {"technique_id": "T1"}, ("ecs_normalized", "new"))
    r = tagged.first()
    assert r.art == {"technique_id": "T1"} and r.tags == ["ecs_normalized", "sysmon_event_1", "new"]
    again = N.with_test_metadata(tagged, {"technique_id": "T2", "b": "c"}).first()
    assert again.art == {"technique_id": "T2", "b": "c"}
    raw = N.with_ingest_fields(N.raw_projection(tagged)).first()
    assert raw.event.dataset == "edr.raw" and raw.ingest_source == "logstash-http"
    assert N.drop_sensor_noise(df, (r"C:\Tools\a.exe",)).count() == 0 and N.drop_sensor_noise(df).count() == 1


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("", []),
        ("  ", []),
        ('a "b c" d', ["a", '"b c"', "d"]),
        ('a x"b c" d', ["a", 'x"b', 'c"', "d"]),
        ('a "unclosed b', ['a "unclosed b']),
        ("'q r' \"s\"t", ["'q r'", '"s"', "t"]),
    ],
)
def test_command_line_tokens(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(S.split_command_line(F.col("c")).alias("t")).first().t == tokens


@pytest.mark.parametrize(
    "text,normalized,hour",
    [
        ("2026-05-01 10:00:00.5", "2026-05-01T10:00:00.500Z", 10),
        ("2026-05-01 10:00:00", "2026-05-01T10:00:00.000Z", 10),
        ("2026-05-01T23:30:00.1234567Z", "2026-05-01T23:30:00.123Z", 23),
        ("2026-05-01T01:00:00+02:00", "2026-04-30T23:00:00.000Z", 1),
        ("nonsense", "nonsense", None),
        ("2026", "2026", None),
    ],
)
def test_timestamps(spark, text, normalized, hour):
    df = spark.createDataFrame([(text,)], "c string")
    r = df.select(TS.normalize_timestamp(F.col("c")).alias("n"), TS.own_hour(F.col("c")).alias("h")).first()
    assert (r.n, r.h) == (normalized, hour)


def test_small_scalars(spark):
    df = spark.createDataFrame([("1/3, 11/unknown/None/1",)], "c string")
    r = df.select(
        S.split_event_codes(F.col("c")).alias("codes"),
        S.ordered_event_ids(S.str_array(["11", "x", "3"])).alias("ids"),
        S.ordered_by(S.str_array(["b", "a", "z"]), ("z", "y")).alias("pref"),
        S.join_human(S.str_array(["a", "b", "c"])).alias("human"),
        S.parse_long(F.lit("1.5")).alias("bad"),
        S.parse_long(F.lit(" +7 ")).alias("good"),
        TS.index_name("p", F.lit("2026-05-01")).alias("index_name"),
        TS.index_name("p", F.lit("May")).alias("no_index"),
    ).first()
    assert r.codes == ["1", "3", "11"] and r.ids == ["3", "11", "x"] and r.pref == ["z", "a", "b"]
    assert (r.human, r.bad, r.good, r.index_name, r.no_index) == ("a, b, and c", None, 7, "p-2026.05.01", None)


def test_only_one_whole_document_counts(spark):
    good = (
        "<Event><System><Provider Name='p'/><EventID>1</EventID><TimeCreated SystemTime='t'/><Channel>c</Channel>"
        "<Computer>h</Computer></System><EventData><Data Name='UtcTime'>2026-05-01 10:00:00.000</Data>"
        "<Data Name='ProcessId'>1</Data><Data Name='ParentProcessId'>1</Data></EventData></Event>"
    )
    texts = {
        good: None, good + "\n<!-- end -->": None, good + good: "malformed_xml", good + " tail": "malformed_xml",
        good[:-20]: "malformed_xml", good.replace(">c<", ">a & b<"): "malformed_xml",
        good.replace("<EventID>1<", "<EventID>99999999999<"): "unsupported_event_id",
    }
    from huntframe.operators.normalize import normalize_xml

    df = spark.createDataFrame([(t,) for t in texts], "xml string")
    got = {r.original: r.error_reason for r in normalize_xml(df).selectExpr("event.original", "error_reason").collect()}
    assert got == texts


@pytest.mark.parametrize(
    "text,whole",
    [
        ("<a><b/></a>", True), ("  <a/>\n", True), ("<?xml version='1.0'?><!-- x --><a>t</a><!-- </a> -->", True), ("<a><a>x</a></a>", True),
        ("<a><![CDATA[</a><b>]]></a>", True), ("<a x='>'/>", True), ('<a x="</a>">t</a>', True), ("<a></a ><?end?>", True),
        ("<a/><b/>", False), ("<a></a><b/>", False), ("<a></a><a></a>", False), ("<a></a>junk/>", False), ("<a></a>t", False), ("t<a></a>", False),
        ("<a><b></a>", True), ("<a>", False), ("", False), ("plain", False), ("<a/>t", False),
    ],
)
def test_one_document(spark, text, whole):
    # what is inside the root is the parser's to judge
    assert spark.createDataFrame([(text,)], "x string").select(N.is_one_document(F.col("x")).alias("w")).first().w is whole
