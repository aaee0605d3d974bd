"""Multi-step behavioural sequences: the first following event per step, in process context.

All definitions are matched together. Events that fit no step of any definition are dropped
first; what remains is materialised once and then read as anchors and as candidates. Step *n* of
every definition is found in one as-of lookup (``following``), so a definition costs no
plan of its own. Lookups carry ids and times only; the documents of matched events are fetched once at the end.

Context is always tested against the anchor. Its four alternatives (parent link, same entity,
same pid and name, shared marker) become equality keys:

* ``E``: entity id; candidates also list their parent's entity id;
* ``P``: pid and lower-cased name;
* ``N``/``W``: marker with name, or marker alone for anchors without a name.

The ``P``, ``N`` and ``W`` keys exist twice: over all candidates (``A``), read by anchors without
an entity id, and over candidates without one (``M``), read by anchors that have one. Two known but
different entity ids thus never meet outside the parent link.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import SequenceDefinition
from ..functions import ids
from ..functions import scalars as S
from ..functions import timestamps as TS
from ..session import cut_lineage
from . import alerts as A
from . import following
from . import rules as R

_MICROS = 1_000_000
UNKNOWN_HOST = "unknown-host"


def _code(n: int) -> Column:
    return F.coalesce(F.col("event.code") == n, F.lit(False))


def _command_and_data() -> Column:
    return F.concat_ws(" ", R.lowered("process.command_line"), R.lowered("sysmon.event_data"))


def _process_step(names: Sequence[str] | None, markers: Sequence[str]) -> Callable[[], Column]:
    def build() -> Column:
        hit = R.has_category("process") & S.lower_contains_any(_command_and_data(), markers)
        return hit if names is None else hit & R.lowered("process.name").isin(*names)

    return build


def _to_demo_destination() -> Column:
    return _code(3) & (
        (R.lowered("destination.ip") == catalog.DEMO_DESTINATION_IP)
        | (R.lowered("destination.domain") == catalog.DEMO_DESTINATION_DOMAIN)
    )


def _download_file() -> Column:
    path, name = R.lowered("file.path"), R.lowered("file.name")
    named = F.concat_ws(" ", name, path)
    return (
        _code(11)
        & S.lower_contains_any(path, ("Downloads",))
        & S.lower_contains_any(named, ("edr_demo",))
    )


def _run_key_write() -> Column:
    evidence = F.concat_ws(
        " ", R.lowered("registry.data.strings"), R.lowered("sysmon.event_data.Details"), R.lowered("sysmon.event_data")
    )
    return (
        _code(13)
        & R.has_category("registry")
        & S.lower_contains_any(R.lowered("registry.path"), catalog.RUN_KEY_PATHS)
        & S.lower_contains_any(evidence, catalog.RUN_KEY_DETAILS)
    )


def _child_or_file() -> Column:
    kind = R.has_category("process") | R.has_category("file") | _code(11)
    return kind & S.lower_contains_any(F.col("_text"), catalog.PROXY_MARKERS)


# The sequence definitions; each step name maps to its predicate.
SEQUENCES: tuple[SequenceDefinition, ...] = (
    SequenceDefinition(
        rule_id="det.behavioral.t1105_download_sequence",
        sequence_name="t1105_download_sequence",
        technique_id="T1105",
        technique_name="Ingress Tool Transfer",
        tactic=("Command and Control",),
        severity="high",
        confidence="high",
        required_steps=("process", "network", "file"),
        window_seconds=300,
        event_codes="1/3/11",
        steps={
            "process": _process_step(catalog.DOWNLOAD_PROCESSES, catalog.DOWNLOAD_MARKERS),
            "network": _to_demo_destination,
            "file": _download_file,
        },
    ),
    SequenceDefinition(
        rule_id="det.behavioral.t1547_001_registry_persistence_sequence",
        sequence_name="t1547_001_registry_persistence_sequence",
        technique_id="T1547.001",
        technique_name="Registry Run Keys / Startup Folder",
        tactic=("Persistence",),
        severity="high",
        confidence="high",
        required_steps=("process", "registry"),
        optional_steps=("follow_up_process",),
        window_seconds=600,
        event_codes="1/13",
        steps={
            "process": _process_step(catalog.PERSISTENCE_PROCESSES, catalog.PERSISTENCE_PROCESS_MARKERS),
            "registry": _run_key_write,
            "follow_up_process": _process_step(None, catalog.PERSISTENCE_PAYLOAD_MARKERS),
        },
    ),
    SequenceDefinition(
        rule_id="det.behavioral.t1218_lolbin_sequence",
        sequence_name="t1218_lolbin_sequence",
        technique_id="T1218",
        technique_name="System Binary Proxy Execution",
        tactic=("Defense Evasion",),
        severity="medium",
        confidence="medium",
        required_steps=("process",),
        optional_steps=("network", "child_or_file"),
        window_seconds=300,
        event_codes="1/3/11",
        steps={
            "process": _process_step(catalog.PROXY_PROCESSES, catalog.PROXY_MARKERS),
            "network": _to_demo_destination,
            "child_or_file": _child_or_file,
        },
    ),
)


def step_hits(events: DataFrame, definitions: Sequence[SequenceDefinition] = SEQUENCES) -> DataFrame:
    """One row per event and definition it fits, with ``def`` and the fitting ``steps`` in order."""
    prepared = R.prepare(events).withColumn("_text", R.batch_event_text())
    hits = []
    for n, d in enumerate(definitions):
        names = (*d.required_steps, *d.optional_steps)
        steps = F.array_compact(F.array(*[F.when(d.steps[name](), F.lit(name)) for name in names]))
        hits.append(F.struct(F.lit(n).alias("def"), steps.alias("steps")))
    hits = F.filter(F.array(*hits), lambda h: F.size(h["steps"]) > 0)
    return prepared.withColumn("_hit", F.explode(hits))


def _slim(
    events: DataFrame, definitions: Sequence[SequenceDefinition], key: str, order: str, scope: str | None
) -> DataFrame:
    """Per definition its step-matching events with only what matching and the alert need."""
    ts = TS.event_time(F.col("`@timestamp`"), F.col("event.created"))
    flagged = step_hits(events, definitions)
    host = F.coalesce(S.non_empty(F.col("host.name")), F.lit(UNKNOWN_HOST))
    scope_text = F.lit("") if scope is None else S.text(F.col(scope))
    doc = F.col("src_doc.document_id") if "src_doc" in events.columns else F.lit(None).cast("string")
    stamp = F.coalesce(S.non_empty(F.col("`@timestamp`")), S.non_empty(F.col("event.created")), F.lit(""))
    process = A.selected_process()
    return flagged.select(
        F.col("_hit.def").alias("def"),
        F.col("_hit.steps").alias("steps"),
        F.col(key).cast("string").alias("eid"),
        F.col(order).cast("bigint").alias("o"),
        F.coalesce(F.unix_micros(ts), F.lit(0)).alias("t"),
        ts.isNotNull().alias("timed"),
        F.concat(scope_text, F.lit("|"), host).alias("host"),
        S.text(F.col("process.entity_id")).alias("entity"),
        S.text(F.col("process.parent.entity_id")).alias("parent"),
        S.text(F.col("process.pid")).alias("pid"),
        R.lowered("process.name").alias("name"),
        S.present_markers(F.col("_text"), catalog.SEQUENCE_CONTEXT_MARKERS).alias("markers"),
        F.struct(
            F.coalesce(S.non_empty(F.col("event.id")), S.non_empty(doc)).alias("document_id"),
            stamp.alias("stamp"),
            F.col("event.code").alias("code"),
            F.col("host").alias("host"),
            process.alias("process"),
            scope_text.alias("scope"),
        ).alias("doc"),
    )


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _anchor_keys() -> Column:
    known, named = F.col("entity") != "", F.col("name") != ""
    scope = F.when(known, F.lit("M")).otherwise(F.lit("A"))
    base = F.array(
        F.when(known, _cat("E|", F.col("entity"))),
        F.when((F.col("pid") != "") & named, _cat("P", scope, "|", F.col("pid"), "|", F.col("name"))),
    )
    with_name = F.flatten(
        F.transform(
            "markers",
            lambda m: F.array(_cat("N", scope, "|", m, "|", F.col("name")), _cat("N", scope, "|", m, "|")),
        )
    )
    alone = F.transform("markers", lambda m: _cat("W", scope, "|", m))
    return F.array_compact(F.concat(base, F.when(named, with_name).otherwise(alone)))


def _candidate_keys() -> Column:
    unknown = F.col("entity") == ""
    own = F.array(
        F.when(~unknown, _cat("E|", F.col("entity"))),
        F.when((F.col("parent") != "") & (F.col("parent") != F.col("entity")), _cat("E|", F.col("parent"))),
    )

    def scoped(scope: str) -> Column:
        pid = F.array(
            F.when(
                (F.col("pid") != "") & (F.col("name") != ""), _cat(f"P{scope}|", F.col("pid"), "|", F.col("name"))
            )
        )
        marked = F.flatten(
            F.transform(
                "markers", lambda m: F.array(_cat(f"N{scope}|", m, "|", F.col("name")), _cat(f"W{scope}|", m))
            )
        )
        return F.concat(pid, marked)

    none = F.array().cast("array<string>")
    return F.array_compact(F.concat(own, scoped("A"), F.when(unknown, scoped("M")).otherwise(none)))


def _per_definition(column: str, values: Sequence, cast: str) -> Column:
    expr = F.lit(None).cast(cast)
    for n, v in reversed(list(enumerate(values))):
        expr = F.when(F.col(column) == n, F.lit(v).cast(cast)).otherwise(expr)
    return expr


def match_sequences(
    events: DataFrame,
    definitions: Sequence[SequenceDefinition] = SEQUENCES,
    window_seconds: int | None = None,
    key: str = "seq",
    order: str = "seq",
    scope: str | None = None,
) -> DataFrame:
    """Matched sequences: ``def``, ``host``, ``anchor`` and ``matched`` (array of step, eid, doc).

    ``key`` names a column with a unique event id and ``order`` one with the arrival number that
    breaks ties between equal times. With ``scope``, events only match inside the same value of that column. Every anchor yields its own match. Events without a readable time
    sort first and pass every window test.
    """
    definitions = [d.with_window(window_seconds) for d in definitions]
    base = cut_lineage(_slim(events, definitions, key, order, scope))
    width = _per_definition("def", [d.window_seconds * _MICROS for d in definitions], "bigint")

    event = F.struct("t", "o", "eid")
    first = _per_definition("def", [d.required_steps[0] for d in definitions], "string")
    chains = base.where(F.array_contains("steps", first)).select(
        "def",
        "host",
        F.col("eid").alias("anchor"),
        F.col("t").alias("a_t"),
        F.col("o").alias("a_o"),
        "timed",
        _anchor_keys().alias("keys"),
        F.array(F.struct(first.alias("step"), "eid", "t", "o")).alias("matched"),
    )

    total_steps = max(len(d.required_steps) + len(d.optional_steps) for d in definitions)
    for position in range(1, total_steps):
        # Read several times by the next step, and small: one row per anchor that is left, without documents.
        chains = cut_lineage(_advance(chains, base, definitions, position, width, event))
    return _with_documents(chains, base, total_steps)


def _with_documents(chains: DataFrame, base: DataFrame, total_steps: int) -> DataFrame:
    """Adds the document of each matched event, read from the step events; only those that may be matched are shuffled."""
    keys = ["def", "host", "eid", "t", "o"]
    numbered = chains.select("def", "host", "anchor", F.monotonically_increasing_id().alias("_chain"), "matched")
    wanted = numbered.select("def", "host", "anchor", "_chain", F.posexplode("matched").alias("_at", "m")).select(
        "def", "host", "anchor", "_chain", "_at", "m.step", "m.eid", "m.t", "m.o"
    )
    docs = following.maybe_among(base, wanted, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "steps", "doc")
    same = F.array_contains("steps", F.col("step"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    # Rows that repeat an id have one document each; the least stands for them.
    at = lambda n: F.min(F.when(F.col("_at") == n, F.struct("step", "eid", "t", "o", "doc")))
    return (
        wanted.join(docs, same)
        .groupBy("def", "host", "anchor", "_chain")
        .agg(F.array_compact(F.array(*[at(n) for n in range(total_steps)])).alias("matched"))
        .drop("_chain")
    )


def _advance(
    chains: DataFrame,
    base: DataFrame,
    definitions: Sequence[SequenceDefinition],
    position: int,
    width: Column,
    event: Column,
) -> DataFrame:
    """Adds the step at ``position`` of every definition that has one; the others pass through."""
    names, required, depth = [], [], 1
    for d in definitions:
        steps = (*d.required_steps, *d.optional_steps)
        names.append(steps[position] if position < len(steps) else None)
        required.append(position < len(d.required_steps))
        if names[-1] and not required[-1]:
            # Events used since the anchor may hide that many nearer candidates.
            depth = max(depth, position)
    is_required = _per_definition("def", required, "boolean")
    start = F.when(is_required, F.element_at("matched", -1)["t"]).otherwise(F.col("a_t"))
    start_o = F.when(is_required, F.element_at("matched", -1)["o"]).otherwise(F.col("a_o"))
    by = ["def", "host", "key"]
    # A chain without any key still gets one probe, so that optional steps can miss. Its first probe carries the chain, the others what
    # they are compared with.
    chain = F.struct("a_t", "a_o", "timed", "keys", "matched")
    probes = chains.select(
        "*", start.alias("t"), start_o.alias("o"),
        F.posexplode(F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(F.lit("-")))).alias("_at", "key"),
    ).select(
        "def", "host", "t", "o", "key",
        F.struct(
            "anchor", "a_t", "timed", F.transform("matched", lambda m: m["eid"]).alias("used"), F.when(F.col("_at") == 0, chain).alias("chain")
        ).alias("probe"),
    )
    step_name = _per_definition("def", names, "string")
    candidates = base.where(F.array_contains("steps", step_name)).select(
        "def", "host", "t", "o", F.explode(_candidate_keys()).alias("key"), event.alias("cand"), F.col("timed").alias("cand_timed")
    )

    # Anchors without a readable time accept any later event: a lookup without a time limit. Timed ones never take
    # an event without a time, since that sorts before them.
    found = following.nearest_within(
        probes.where("probe.timed"), candidates.where("cand_timed").drop("cand_timed"), by, F.col("probe.a_t"), width, depth
    ).unionByName(
        following.nearest_anywhere(probes.where("NOT probe.timed"), candidates.drop("cand_timed"), by, width, depth)
    )

    in_window = lambda c: ~F.col("probe.timed") | (c["t"] - F.col("probe.a_t") <= width)
    usable = F.filter("found", lambda c: in_window(c) & ~F.array_contains(F.col("probe.used"), c["eid"]))
    best = (
        found.withColumn("_pick", F.get(usable, F.lit(0)))
        .where(F.col("probe.chain").isNotNull() | F.col("_pick").isNotNull())
        .groupBy("def", "host", F.col("probe.anchor").alias("anchor"))
        .agg(F.min("_pick").alias("pick"), F.any_value("probe.chain", True).alias("chain"))
        .where(~is_required | F.col("pick").isNotNull())
    )
    added = F.struct(step_name.alias("step"), F.col("pick.eid").alias("eid"), F.col("pick.t").alias("t"), F.col("pick.o").alias("o"))
    return best.select(
        "def", "host", "anchor", "chain.a_t", "chain.a_o", "chain.timed", "chain.keys",
        F.when(F.col("pick").isNull(), F.col("chain.matched"))
        .otherwise(F.concat("chain.matched", F.array(added)))
        .alias("matched"),
    )


def sequence_rules_df(spark: SparkSession, definitions: Sequence[SequenceDefinition] = SEQUENCES) -> DataFrame:
    rows = [
        (n, d.rule_id, d.name, d.description, d.severity, d.confidence, d.technique_id, d.technique_name,
         list(d.tactic), d.sequence_name, d.window_seconds)
        for n, d in enumerate(definitions)
    ]
    return spark.createDataFrame(
        rows,
        "def int, rule_id string, rule_name string, rule_description string, severity string, "
        "confidence string, technique_id string, technique_name string, tactic array<string>, "
        "sequence_name string, window_seconds int",
    )


def behavioral_alerts(
    events: DataFrame,
    definitions: Sequence[SequenceDefinition] = SEQUENCES,
    window_seconds: int | None = None,
    key: str = "seq",
    order: str = "seq",
    scope: str | None = None,
) -> DataFrame:
    """Alert documents for the matched sequences of the given definitions.

    With ``scope`` the alerts carry that column too.
    """
    found = match_sequences(events, definitions, window_seconds, key, order, scope)
    df = found.join(F.broadcast(sequence_rules_df(events.sparkSession, definitions)), "def")
    # Documents without an id of their own get one from definition, anchor and position.
    document_ids = F.transform(
        F.col("matched"),
        lambda m, i: F.coalesce(
            m["doc"]["document_id"],
            ids.prefixed(
                "local",
                [m["doc"]["stamp"], m["doc"]["code"], m["doc"]["host"]["name"], F.col("rule_id"), F.col("anchor"), i],
            ),
        ),
    )
    stamps = F.filter(F.transform("matched", lambda m: m["doc"]["stamp"]), lambda s: s != "")
    df = df.select(
        "*",
        document_ids.alias("_docs"),
        F.transform("matched", lambda m: m["step"]).alias("_steps"),
        F.coalesce(F.array_max(stamps), F.lit("1970-01-01T00:00:00Z")).alias("_created"),
        F.get(F.filter(F.transform("matched", lambda m: m["doc"]["host"]), lambda h: h.isNotNull()), F.lit(0)).alias("_host"),
        F.get(F.filter(F.transform("matched", lambda m: m["doc"]["process"]), lambda p: p.isNotNull()), F.lit(0)).alias("_process"),
    )
    material = [
        F.col("rule_id"), F.col("sequence_name"), F.array_join("_docs", "|"), F.col("_host.name"),
        F.col("_process.pid"), F.col("_process.entity_id"), F.col("_process.name"), F.array_join("_steps", "|"),
        F.col("_created"),
    ]
    sample = A.detect(events.limit(0), R.NATIVE_RULES[:1])
    none = lambda n: F.lit(None).cast(sample.schema[n].dataType).alias(n)
    return df.select(
        F.struct(
            ids.prefixed(ids.slug(F.col("rule_id")), material).alias("id"),
            F.lit("signal").alias("kind"), F.lit("open").alias("status"), F.col("_created").alias("created"),
            F.col("severity"), F.col("confidence"),
        ).alias("alert"),
        F.struct(
            F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), F.lit(1).alias("version"),
            F.col("rule_description").alias("description"),
        ).alias("rule"),
        F.struct(
            F.struct(F.col("technique_id").alias("id"), F.col("technique_name").alias("name")).alias("technique"),
            F.col("tactic"),
        ).alias("attack"),
        none("event"),
        F.col("_host").cast(sample.schema["host"].dataType).alias("host"),
        none("user"),
        F.col("_process").cast(sample.schema["process"].dataType).alias("process"),
        none("file"), none("registry"), none("destination"), none("network"),
        F.struct(
            F.lit("behavioral").alias("engine"), F.lit(None).cast("array<string>").alias("matched_fields"),
            F.col("sequence_name"), F.col("_steps").alias("sequence_steps"),
            F.size("matched").alias("correlated_event_count"), F.lit(None).cast("string").alias("reason"),
        ).alias("detection"),
        none("ml"),
        F.struct(
            F.lit(None).cast("string").alias("index"), F.lit(None).cast("string").alias("document_id"),
            F.col("_docs").alias("document_ids"),
        ).alias("src_doc"),
        none("art"),
        *([] if scope is None else [F.col("matched")[0]["doc"]["scope"].alias(scope)]),
    )


def host_ordinals(events: DataFrame, order: str = "seq", slice_seconds: int = 3600) -> DataFrame:
    """Dense per-host ordinal by time then arrival, numbered from 1; unreadable times come first.

    A host is numbered slice by slice: rows inside a time slice on their own, slices by the
    running sum of the slice sizes before them. No host is ever sorted in one task.
    """
    ts = TS.event_time(F.col("`@timestamp`"), F.col("event.created"))
    host = F.coalesce(S.non_empty(F.col("host.name")), F.lit(UNKNOWN_HOST))
    t = F.coalesce(F.unix_micros(ts), F.lit(0))
    rows = events.withColumns({"_host": host, "_t": t}).withColumns(
        {
            "_slice": F.floor(F.col("_t") / (slice_seconds * _MICROS)),
            "_sub": F.when(F.col("_t") == 0, F.floor(F.col(order) / (1 << 20))).otherwise(F.lit(0)),
        }
    )
    cut = ["_host", "_slice", "_sub"]
    before = Window.partitionBy("_host").orderBy("_slice", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*cut)
        .count()
        .select(*cut, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*cut).orderBy("_t", order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, cut)
        .withColumn("host_ord", F.col("_offset") + F.col("_rank"))
        .drop(*cut, "_t", "_offset", "_rank")
    )


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """Alerts of several engines as one table."""
    return reduce(lambda a, b: a.unionByName(b), alerts)


def running_numbers(rows: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Dense numbers from 1 over all rows in the order of some columns, which together are unique.

    Rows are dealt by ranges and sorted there; a row's number is its place plus the sizes of the ranges before. The sizes are one row per range, so
    no task sees the whole table. The dealt rows are written first, which fixes the ranges.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_place": place}), "numbered"
    )
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _before bigint")
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")
