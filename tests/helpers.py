"""Hand-written events in the normalized schema."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from huntframe import catalog, schemas

CATEGORY = {1: ["process"], 3: ["network"], 11: ["file"], 13: ["registry"]}


def event(seq, code=1, ts="2026-05-01T10:00:00Z", host="H1", name="", entity="", parent="", pid=None, cmd=None, **sections):
    """One event as a JSON-like dict; ``sections`` are file, registry, destination, data and others."""
    process = {"name": name, "entity_id": entity, "executable": f"C:\\Windows\\System32\\{name}" if name else ""}
    if pid is not None:
        process["pid"] = pid
    if cmd is not None:
        process["command_line"] = cmd
        process["args"] = cmd.split()
    if parent or sections.get("parent_name"):
        process["parent"] = {"entity_id": parent, "name": sections.pop("parent_name", "")}
    doc = {
        "@timestamp": ts,
        "event": {"kind": "event", "category": CATEGORY.get(code, ["event"]), "code": code, "dataset": catalog.DATASET},
        "host": {"name": host},
        "process": process,
        "sysmon": {"event_data": sections.pop("data", {})},
        "winlog": {"record_id": seq},
    }
    doc.update(sections)
    return doc


def events_df(spark, docs, extra=""):
    """Events as a DataFrame with ``seq`` from the record id; ``extra`` are DDL columns taken from each dict."""
    schema = "seq bigint, doc string" + (f", {extra}" if extra else "")
    names = [part.strip().split(" ")[0] for part in extra.split(",")] if extra else []
    rows = [(d["winlog"]["record_id"], json.dumps({k: v for k, v in d.items() if k not in names}), *[d[n] for n in names]) for d in docs]
    df = spark.createDataFrame(rows, schema)
    parsed = df.withColumn("_e", F.from_json("doc", schemas.EVENT))
    return parsed.select("seq", *names, *[F.col(f"_e.`{c}`").alias(c) for c in schemas.EVENT_COLUMNS])


def download_process(seq, **kw):
    kw = {"name": "certutil.exe", "cmd": "certutil.exe -urlcache -f http://127.0.0.1/a EDR_DEMO_T1105", **kw}
    return event(seq, 1, **kw)


def download_network(seq, **kw):
    kw = {"name": "certutil.exe", "destination": {"ip": "127.0.0.1", "port": 80, "domain": ""}, **kw}
    return event(seq, 3, **kw)


def download_file(seq, **kw):
    kw = {
        "name": "certutil.exe",
        "file": {"path": "C:\\Users\\demo\\Downloads\\edr_demo.txt", "name": "edr_demo.txt", "extension": "txt"},
        **kw,
    }
    return event(seq, 11, **kw)


def run_key_process(seq, **kw):
    return event(seq, 1, **{"name": "reg.exe", "cmd": "reg.exe add HKCU\\...\\Run /v EDRDemo", **kw})


def run_key_write(seq, **kw):
    path = "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\EDRDemo"
    kw = {
        "name": "reg.exe",
        "registry": {"path": path, "value": "EDRDemo", "data": {"strings": ["powershell.exe -File x"]}},
        "data": {"Details": "powershell.exe -File x"},
        **kw,
    }
    return event(seq, 13, **kw)


def proxy_process(seq, **kw):
    return event(seq, 1, **{"name": "rundll32.exe", "cmd": "rundll32.exe url.dll,FileProtocolHandler EDR_DEMO_T1218", **kw})
