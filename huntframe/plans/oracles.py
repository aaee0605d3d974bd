"""Check SQL: each registered query again as plain SQL over the given tables.

Joins here are written for clarity, not speed: they restate the semantics independently of the plans.
"""

from __future__ import annotations

from .. import catalog
from ..operators.realtime import REALTIME_RULES
from ..operators.rules import NATIVE_RULES, SIGMA_LIKE_RULES
from ..operators.sequences import SEQUENCES
from ..sources.telemetry_view import FLAT_SQL
from .queries import CORRELATION_WINDOW, ENGINE_CASES, PLAYBOOKS, SEQUENCE_WINDOW, WIDE_CASES

SUPPORTED = "event_code IN (1, 3, 11, 13)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(expr: str, markers) -> str:
    """Case-insensitive substring test; ``expr`` must be lower-cased already."""
    return "(" + " OR ".join(f"contains({expr}, {q(m.lower())})" for m in dict.fromkeys(markers)) + ")"


def within(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(q(v) for v in values)})"


def tele(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"{FLAT_SQL.strip()}{extra}\n{body}"


def digest(prefix: str, parts: list[str], length: int = 16) -> str:
    joined = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '<null>')" for p in parts)
    return f"{prefix} || '-' || substr(sha256(concat_ws(chr(31), {joined})), 1, {length})"


LOWS = """
low AS (
  SELECT *, lower(process_name) AS name, coalesce(lower(command_line), '') AS cmd, lower(event_data) AS edata,
    coalesce(lower(file_path), '') AS fpath, coalesce(lower(file_name), '') AS fname,
    coalesce(lower(registry_path), '') AS rpath, coalesce(lower(registry_value), '') AS rvalue,
    coalesce(lower(registry_data), '') AS rdata, coalesce(lower(details), '') AS det,
    coalesce(lower(dest_ip), '') AS dip, coalesce(lower(dest_domain), '') AS ddom,
    lower(executable) AS exe
  FROM tele WHERE event_code IN (1, 3, 11, 13)
)"""

_TOOL = within("name", catalog.DOWNLOAD_PROCESSES)
_DEMO = "contains(cmd, 'edr_demo_t1105')", "contains(edata, 'edr_demo_t1105')"
_SHELL_FIELDS = """concat_ws(',',
    CASE WHEN name = 'powershell.exe' THEN 'process.name' END,
    CASE WHEN ends_with(exe, '\\powershell.exe') THEN 'process.executable' END,
    CASE WHEN contains(cmd, 'powershell.exe') THEN 'process.command_line' END)"""
_DOWNLOAD_FIELDS = f"""CASE
    WHEN category = 'process' AND {_TOOL} AND {has('cmd', catalog.DOWNLOAD_MARKERS)} THEN 'process.command_line'
    WHEN event_code = 3 AND {_TOOL} AND (dip = '127.0.0.1' OR ddom = 'example.test')
      AND ((cmd = '' AND edata = '') OR {_DEMO[0]} OR {_DEMO[1]})
      THEN concat_ws(',', CASE WHEN dip = '127.0.0.1' THEN 'destination.ip' ELSE 'destination.domain' END,
        CASE WHEN {_DEMO[0]} THEN 'process.command_line' END, CASE WHEN {_DEMO[1]} THEN 'sysmon.event_data' END)
    WHEN event_code = 11 AND contains(fpath, 'downloads') AND contains(fname, 'edr_demo')
      AND {has("(fpath || ' ' || edata)", ('EDR_DEMO_T1105', 'edr_demo'))} THEN 'file.path,file.name'
    ELSE '' END"""
_RUN_KEY_FIELDS = f"""CASE WHEN event_code = 13 AND category = 'registry' AND rvalue <> ''
    AND {has('rpath', catalog.RUN_KEY_PATHS)} AND {has("(rdata || ' ' || det)", catalog.RUN_KEY_DETAILS)}
    THEN 'registry.path,registry.value,registry.data.strings' ELSE '' END"""
_PROXY_FIELDS = f"""CASE WHEN category = 'process' AND {within('name', catalog.PROXY_PROCESSES)}
    AND {has('cmd', catalog.PROXY_MARKERS)} THEN 'process.name,process.command_line' ELSE '' END"""
_FIELDS = (f"CASE WHEN event_code = 1 THEN {_SHELL_FIELDS} ELSE '' END", _DOWNLOAD_FIELDS, _RUN_KEY_FIELDS, _PROXY_FIELDS)


def hits(name: str, rules, first: int = 0) -> str:
    """CTE of rule hits: the event's columns with rule position, id, engine and matched fields."""
    parts = [
        f"SELECT *, {n + first} AS rule_ord, {q(r.rule_id)} AS rule_id, {q(r.engine)} AS engine, {q(r.severity)} AS severity, "
        f"{q(r.confidence)} AS confidence, {q(r.technique_id)} AS technique_id, {q(r.name)} AS rule_name, "
        f"{q(','.join(r.tactic))} AS tactic, {_FIELDS[n]} AS matched_fields FROM low"
        for n, r in enumerate(rules)
    ]
    return f"{name} AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE matched_fields <> '')"


NATIVE, SIGMA = hits("native", NATIVE_RULES), hits("sigma", SIGMA_LIKE_RULES, len(NATIVE_RULES))
ALL = "allhits AS (SELECT * FROM native UNION ALL SELECT * FROM sigma)"
ENGINES = (LOWS, NATIVE, SIGMA, ALL)
ALERT_ID = digest(
    "replace(replace(rule_id, '.', '-'), '_', '-')",
    ["engine", "rule_id", "'windows.sysmon_operational'", "event_code", "stamp", "host_name", "entity_id", "pid", "executable", "command_line", "seq"],
)
ALERTS = f"alerts AS (SELECT *, {ALERT_ID} AS alert_id FROM allhits)"
MS_STAMP = "CASE WHEN stamp = 'not-a-time' THEN stamp ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END"
_TOKENS = """regexp_extract_all(command_line, '"[^"]*"|[^ "][^ ]*')"""
_SHA = "coalesce('AB' || CAST(k AS VARCHAR), '')"

# --- realtime rules -----------------------------------------------------------------------------


def _rt_fields() -> list[str]:
    label = [f"CASE WHEN {has('cmd', markers)} THEN 'process.command_line' ELSE '' END" for _, markers in catalog.LABEL_MARKER_RULES]
    shell = f"""CASE WHEN event_code = 1 AND {within('name', catalog.REALTIME_SHELLS)} AND (contains(cmd, 'edr_demo_t1059_001')
      OR contains(cmd, '-noprofile') OR contains(cmd, ' -nop') OR (contains(cmd, '-executionpolicy') AND contains(cmd, 'bypass')))
      THEN 'process.name' || CASE WHEN cmd <> '' THEN ',process.command_line' ELSE '' END ELSE '' END"""
    column = {
        "process.command_line": "cmd", "file.path": "fpath", "file.name": "fname", "destination.ip": "dip",
        "destination.domain": "ddom", "raw.message": "''", "sysmon.event_data": "edata",
    }
    checks = ", ".join(f"CASE WHEN {has(column[p], m)} THEN {q(p)} END" for p, m in catalog.REALTIME_DOWNLOAD_CHECKS)
    download = f"CASE WHEN {within('name', catalog.REALTIME_DOWNLOAD_TOOLS)} THEN concat_ws(',', {checks}) ELSE '' END"
    below = " OR ".join(
        f"contains(rpath, 'currentversion\\{k}\\') OR ends_with(rpath, 'currentversion\\{k}')" for k in ("run", "runonce")
    )
    run_key = f"CASE WHEN event_code = 13 AND ({below}) THEN 'registry.path,registry.value' ELSE '' END"
    url = f"""CASE WHEN event_code = 1 AND name = 'rundll32.exe' AND {has('cmd', ('edr_demo_t1218', 'url.dll,fileprotocolhandler'))}
      THEN 'process.name,process.command_line' ELSE '' END"""
    return [*label, shell, download, run_key, url]


RT_HITS = "rt AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT *, {n} AS rule_ord, {q(r.rule_id)} AS rule_id, {q(r.reason)} AS reason, {q(r.severity)} AS severity, "
    f"{q(r.technique_id)} AS technique_id, {fields} AS matched_fields FROM low"
    for n, (r, fields) in enumerate(zip(REALTIME_RULES, _rt_fields()))
) + ") WHERE matched_fields <> '')"
_NET = "CASE WHEN event_code = 3 THEN nullif(dest_ip || CASE WHEN dest_port IS NULL THEN '' ELSE ':' || CAST(dest_port AS VARCHAR) END, '') END"
_SUMMARY = f"coalesce(command_line, file_path, registry_path, {_NET}, '-')"

# --- sequences ----------------------------------------------------------------------------------

_CMD_DATA = "(cmd || ' ' || edata)"
_TEXT = "concat_ws(' ', lower(stamp), '', CAST(event_code AS VARCHAR), name, cmd, fpath, fname, rpath, rvalue, rdata, dip, ddom, edata)"
_NETWORK_STEP = "(event_code = 3 AND (dip = '127.0.0.1' OR ddom = 'example.test'))"
_FLAGS = {
    "t1105_process": f"category = 'process' AND {_TOOL} AND {has(_CMD_DATA, catalog.DOWNLOAD_MARKERS)}",
    "network": _NETWORK_STEP,
    "t1105_file": f"event_code = 11 AND contains(fpath, 'downloads') AND contains(fname || ' ' || fpath, 'edr_demo')",
    "t1547_process": f"category = 'process' AND {within('name', catalog.PERSISTENCE_PROCESSES)} AND {has(_CMD_DATA, catalog.PERSISTENCE_PROCESS_MARKERS)}",
    "registry": f"event_code = 13 AND {has('rpath', catalog.RUN_KEY_PATHS)} AND {has('''(rdata || ' ' || det || ' ' || edata)''', catalog.RUN_KEY_DETAILS)}",
    "follow_up": f"category = 'process' AND {has(_CMD_DATA, catalog.PERSISTENCE_PAYLOAD_MARKERS)}",
    "t1218_process": f"category = 'process' AND {within('name', catalog.PROXY_PROCESSES)} AND {has(_CMD_DATA, catalog.PROXY_MARKERS)}",
    "child": f"category IN ('process', 'file') AND {has('etext', catalog.PROXY_MARKERS)}",
}
_MARKERS = ", ".join(
    f"CASE WHEN contains(etext, {q(m)}) THEN {q(m)} END" for m in dict.fromkeys(x.lower() for x in catalog.SEQUENCE_CONTEXT_MARKERS)
)
def seq_events(same: str = "true") -> tuple[str, ...]:
    """CTEs of the step events and the pairs of an anchor and a later event that may belong to it, and for which ``same`` holds."""
    return (
    f"texts AS (SELECT *, {_TEXT} AS etext FROM low)",
    f"ev AS (SELECT *, coalesce(epoch_us(ts), 0) AS t, coalesce(CAST(pid AS VARCHAR), '') AS pidt, "
    f"list_filter([{_MARKERS}], lambda x: x IS NOT NULL) AS markers, "
    + ", ".join(f"({expr}) AS is_{n}" for n, expr in _FLAGS.items())
    + " FROM texts)",
    f"""pairs AS (
  SELECT a.seq AS a, c.seq AS c, a.t AS at, c.t AS ct, a.host_name AS host_name,
    a.is_t1105_process AS p1105, a.is_t1547_process AS p1547, a.is_t1218_process AS p1218,
    c.is_network AS network, c.is_t1105_file AS file, c.is_registry AS registry, c.is_follow_up AS follow_up, c.is_child AS child
  FROM ev a JOIN ev c ON a.host_name = c.host_name AND (c.t > a.t OR (c.t = a.t AND c.seq > a.seq))
    AND (a.ts IS NULL OR c.ts IS NULL OR c.t - a.t <= {SEQUENCE_WINDOW * 1_000_000})
  WHERE (a.is_t1105_process OR a.is_t1547_process OR a.is_t1218_process)
    AND CASE WHEN a.entity_id <> '' AND c.parent_entity_id = a.entity_id THEN true
      WHEN a.entity_id <> '' AND c.entity_id <> '' THEN a.entity_id = c.entity_id
      WHEN a.pidt <> '' AND a.pidt = c.pidt AND a.name <> '' AND a.name = c.name THEN true
      WHEN a.name <> '' AND c.name <> '' AND a.name <> c.name THEN false
      ELSE list_has_any(a.markers, c.markers) END AND ({same}))""",
    )


SEQ_EVENTS = (LOWS, *seq_events())


def _first(name: str, source: str, where: str) -> str:
    """The earliest pair per anchor that satisfies ``where``."""
    return (
        f"{name} AS (SELECT a, c, ct FROM (SELECT p.*, row_number() OVER (PARTITION BY p.a ORDER BY p.ct, p.c) AS rn "
        f"FROM {source} WHERE {where}) WHERE rn = 1)"
    )


def _sequence_select(name: str, source: str, steps: list[tuple[str, str]]) -> str:
    """Rows in the alert form; ``steps`` are (step name, event id expression), null ids are left out."""
    label = ", ".join(f"CASE WHEN {e} IS NOT NULL THEN {q(s)} END" for s, e in steps)
    docs = ", ".join(f"CAST({e} AS VARCHAR)" for _, e in steps)
    ids = ", ".join(e for _, e in steps)
    return (
        f"SELECT {q(name)} AS sequence_name, x.host_name, concat_ws(',', {label}) AS steps, concat_ws(',', {docs}) AS documents, "
        f"(SELECT max(e.stamp) FROM ev e WHERE e.seq IN ({ids})) AS created, x.process_name, "
        f"CAST(len(list_filter([{ids}], lambda z: z IS NOT NULL)) AS BIGINT) AS n FROM {source}"
    )


def sequence_hits(same: str = "true") -> tuple[str, ...]:
    """CTE ``seqs``: each matched sequence with its anchor, without its documents."""
    s1, s2, s3 = SEQUENCES
    row = lambda d: f"x.seq, x.user_no, x.host_name, {q(d.sequence_name)} AS sequence_name, {q(d.rule_id)} AS rule_id, {q(d.technique_id)} AS technique_id"
    return (
        *seq_events(same),
        _first("net1", "pairs p", "p.p1105 AND p.network"),
        _first("fil1", "pairs p JOIN net1 n ON n.a = p.a", "p.p1105 AND p.file AND (p.ct > n.ct OR (p.ct = n.ct AND p.c > n.c))"),
        _first("reg1", "pairs p", "p.p1547 AND p.registry"),
        f"""seqs AS (SELECT {row(s1)} FROM ev x JOIN net1 ON net1.a = x.seq JOIN fil1 ON fil1.a = x.seq
  UNION ALL SELECT {row(s2)} FROM ev x JOIN reg1 ON reg1.a = x.seq UNION ALL SELECT {row(s3)} FROM ev x WHERE is_t1218_process)""",
    )


SEQUENCE_HITS = sequence_hits()
T1105_SQL = tele(
    _sequence_select(
        SEQUENCES[0].sequence_name, "ev x JOIN net ON net.a = x.seq JOIN fil ON fil.a = x.seq",
        [("process", "x.seq"), ("network", "net.c"), ("file", "fil.c")],
    ),
    *SEQ_EVENTS,
    _first("net", "pairs p", "p.p1105 AND p.network"),
    _first("fil", "pairs p JOIN net n ON n.a = p.a", "p.p1105 AND p.file AND (p.ct > n.ct OR (p.ct = n.ct AND p.c > n.c))"),
)
OPTIONAL_SQL = tele(
    _sequence_select(
        SEQUENCES[1].sequence_name, "ev x JOIN reg ON reg.a = x.seq LEFT JOIN fup ON fup.a = x.seq",
        [("process", "x.seq"), ("registry", "reg.c"), ("follow_up_process", "fup.c")],
    )
    + " UNION ALL "
    + _sequence_select(
        SEQUENCES[2].sequence_name, "(SELECT * FROM ev WHERE is_t1218_process) x LEFT JOIN net ON net.a = x.seq LEFT JOIN kid ON kid.a = x.seq",
        [("process", "x.seq"), ("network", "net.c"), ("child_or_file", "kid.c")],
    ),
    *SEQ_EVENTS,
    _first("reg", "pairs p", "p.p1547 AND p.registry"),
    _first("fup", "pairs p JOIN reg r ON r.a = p.a", "p.p1547 AND p.follow_up AND p.c <> r.c"),
    _first("net", "pairs p", "p.p1218 AND p.network"),
    _first("kid", "pairs p LEFT JOIN net n ON n.a = p.a", "p.p1218 AND p.child AND (n.c IS NULL OR p.c <> n.c)"),
)

# --- correlation --------------------------------------------------------------------------------

_RT_TEXT = "concat_ws(' ', lower(stamp), CAST(event_code AS VARCHAR), name, exe, cmd, fpath, fname, rpath, rvalue, rdata, dip, ddom, '', edata)"
_RT_TOOL = within("name", catalog.REALTIME_DOWNLOAD_TOOLS)


def correlation(window: int, select: str, host_scoped: bool = False, within_: str = "@", more: tuple[str, ...] = ()) -> str:
    """The correlator's triples; ``within_`` is a query with ``@`` in their place."""
    markers = ", ".join(
        f"CASE WHEN contains(etext, {q(m)}) THEN {q('marker:' + m)} END"
        for m in dict.fromkeys(x.lower() for x in catalog.REALTIME_CONTEXT_MARKERS)
    )
    scope = "host_name || '|' || " if host_scoped else ""
    earliest = lambda s: f"arg_min(j.seq, (j.t, j.seq)) FILTER (WHERE j.step = {q(s)})"
    found = (
        f"SELECT DISTINCT {select} FROM triples JOIN ev f ON f.seq = file_no "
        "WHERE process_no IS NOT NULL AND network_no IS NOT NULL AND file_no IS NOT NULL"
    )
    return tele(
        within_.replace("@", found),
        LOWS,
        *more,
        f"texts AS (SELECT *, {_RT_TEXT} AS etext FROM low WHERE ts IS NOT NULL)",
        f"""ev AS (SELECT *, epoch_us(ts) AS t, CASE
      WHEN event_code = 1 AND {_RT_TOOL} AND {has('etext', catalog.REALTIME_PROCESS_STEP_MARKERS)} THEN 'process'
      WHEN event_code = 3 AND {_RT_TOOL} THEN 'network'
      WHEN event_code = 11 AND {has('etext', catalog.REALTIME_FILE_STEP_MARKERS)} THEN 'file' END AS step,
      list_filter([CASE WHEN entity_id <> '' THEN 'entity:' || lower(entity_id) END, 'image:' || exe, {markers}], lambda x: x IS NOT NULL) AS keys
      FROM texts)""",
        f"keyed AS (SELECT seq, t, step, {scope}key AS key FROM (SELECT seq, t, step, host_name, unnest(keys) AS key FROM ev))",
        f"""triples AS (SELECT {earliest('process')} AS process_no, {earliest('network')} AS network_no, {earliest('file')} AS file_no
      FROM keyed k JOIN (SELECT * FROM keyed WHERE step IS NOT NULL) j ON j.key = k.key AND j.t >= k.t - {window * 1_000_000}
        AND (j.t < k.t OR (j.t = k.t AND j.seq <= k.seq))
      GROUP BY k.key, k.seq)""",
    )


_FILE_STAMP = "strftime(f.ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_TRIPLE = "CAST(process_no AS VARCHAR) AS process_id, CAST(network_no AS VARCHAR) AS network_id, CAST(file_no AS VARCHAR) AS file_id, strftime(f.ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp"
_TRIPLE_RULE = _TRIPLE + ", 'behavioral.realtime.t1105.process_network_file' AS rule_id"

# --- anomaly ------------------------------------------------------------------------------------


def _keyword(expr: str, k: str) -> str:
    if k in catalog.WHOLE_WORD_KEYWORDS:
        return f"regexp_matches({expr}, '(^|[^a-z0-9_-]){k}($|[^a-z0-9_-])')"
    return f"contains({expr}, {q(k)})"


_FEATURES = f"""feat AS (SELECT *, length(command_line) AS n_chars, len({_TOKENS}) AS n_args,
  len(list_filter(string_split_regex(lower(command_line), '\\s+'), lambda x: {within('x', catalog.ENCODED_FLAGS)})) > 0 AS encoded,
  concat_ws(',', {', '.join(f"CASE WHEN {_keyword('cmd', k)} THEN {q(k)} END" for k in catalog.NETWORK_KEYWORDS)}) AS keywords,
  len(list_filter(string_split(executable, '\\'), lambda x: x <> '' AND NOT ends_with(x, ':'))) - 1 AS depth,
  CAST(extract(hour FROM ts) AS BIGINT) AS hour
  FROM low WHERE event_code = 1)"""


def _score(hours) -> str:
    w, b = catalog.ANOMALY_WEIGHTS, catalog.DEFAULT_BASELINE
    pairs = ", ".join(q(f"{p}>{c}") for p, c in b.allowed_parent_child_pairs)
    keyword = "CASE " + " ".join(f"WHEN {_keyword('cmd', k)} THEN {q(k)}" for k in b.suspicious_keywords) + " END"
    parent = "lower(parent_name)"
    checks = (
        ("uncommon_process", f"name NOT IN ({', '.join(q(n) for n in b.common_process_names)})", "'process name is not common: ' || name"),
        ("unusual_parent_child", f"{parent} || '>' || name NOT IN ({pairs})", f"'parent-child pair is unusual: ' || {parent} || ' -> ' || name"),
        ("long_command_line", f"n_chars > {b.max_command_line_length}", f"'command line length ' || CAST(n_chars AS VARCHAR) || ' exceeds baseline {b.max_command_line_length}'"),
        ("too_many_args", f"n_args > {b.max_args_count}", f"'args count ' || CAST(n_args AS VARCHAR) || ' exceeds baseline {b.max_args_count}'"),
        ("encoded_command", "encoded", "'encoded command flag present'"),
        ("suspicious_keyword", f"({keyword}) IS NOT NULL", f"'suspicious keyword matched: ' || ({keyword})"),
        ("unusual_executable_path", "NOT (" + " OR ".join(f"starts_with(exe, {q(r)})" for r in catalog.NORMAL_ROOTS) + ")", "'executable path is unusual: ' || executable"),
        ("outside_normal_hours", f"hour NOT IN ({', '.join(str(h) for h in hours)})", "'hour ' || CAST(hour AS VARCHAR) || ' is outside baseline normal hours'"),
    )
    total = " + ".join(f"CASE WHEN {c} THEN CAST({w[n]} AS DOUBLE) ELSE 0 END" for n, c, _ in checks)
    reasons = ", ".join(f"CASE WHEN {c} THEN {r} END" for _, c, r in checks)
    count = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c, _ in checks)
    return f"scored AS (SELECT *, least(1.0, round({total}, 4)) AS score, concat_ws('; ', {reasons}) AS reasons, {count} AS n_reasons FROM feat)"


# --- cases --------------------------------------------------------------------------------------

_PB_ORD = "least(" + ", ".join(
    "CASE " + " ".join(
        f"WHEN {col} IN ({', '.join(q(v) for v in getattr(p, attr))}) THEN {n}" for n, p in enumerate(PLAYBOOKS) if getattr(p, attr)
    ) + " END"
    for col, attr in (("rule_id", "rule_ids"), ("technique_id", "technique_ids"))
) + ")"
_PB = "pb AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {q(p.id)}, {q(','.join(a.id for a in p.actions))}, {q('|'.join(a.id for a in p.actions))})" for n, p in enumerate(PLAYBOOKS)
) + ") v(ord, playbook_id, actions, action_ids))"

CASES = (
    *ENGINES,
    """cases AS (SELECT 'case_' || CAST(no AS VARCHAR) AS case_id, no,
    (['T1059.001','T1105','T1547.001','T1218','T9999'])[no % 5 + 1] AS technique_id, no % 3 <> 0 AS expected_alert,
    CASE WHEN no % 4 = 0 THEN 'dry-run' WHEN no % 4 = 1 THEN 'none' ELSE '' END AS expected_protection, no % 8 = 0 AS expected_response
    FROM (SELECT DISTINCT user_no * 7 + seq % 7 AS no FROM low))""",
    """ca AS (SELECT 'case_' || CAST(user_no * 7 + seq % 7 AS VARCHAR) AS case_id, seq * 10 + rule_ord AS ord, rule_id, engine, technique_id FROM allhits)""",
    f"resp AS (SELECT case_id, count(*) AS responses FROM ca WHERE {_PB_ORD} IS NOT NULL GROUP BY 1)",
    """firsts AS (SELECT case_id, rule_id, engine, min(ord) AS ord FROM ca GROUP BY ALL)""",
    """engs AS (SELECT case_id, string_agg(engine, ',' ORDER BY ord) AS engines FROM (SELECT case_id, engine, min(ord) AS ord FROM ca GROUP BY ALL) GROUP BY 1)""",
    """act AS (SELECT case_id, string_agg(rule_id, ',' ORDER BY ord) AS rules FROM firsts GROUP BY 1)""",
    """nums AS (SELECT case_id, count(*) AS n FROM ca GROUP BY 1)""",
    """codes AS (SELECT case_id, string_agg(CAST(event_code AS VARCHAR), '/' ORDER BY seq) AS event_code, sum(c) AS events FROM (
    SELECT 'case_' || CAST(user_no * 7 + seq % 7 AS VARCHAR) AS case_id, event_code, min(seq) AS seq, count(*) AS c FROM low GROUP BY 1, 2) GROUP BY 1)""",
    """rows_ AS (SELECT c.*, coalesce(p.responses, 0) AS response_count, coalesce(n.n, 0) AS alert_count, coalesce(n.n, 0) > 0 AS actual_alert, coalesce(a.rules, '') AS rules,
    coalesce(e.engines, '') AS engines, k.event_code, CAST(k.events AS BIGINT) AS events,
    CASE WHEN expected_alert AND coalesce(n.n, 0) > 0 THEN 'true_positive' WHEN NOT expected_alert AND coalesce(n.n, 0) = 0 THEN 'true_negative'
      WHEN NOT expected_alert THEN 'false_positive' ELSE 'false_negative' END AS classification
    FROM cases c LEFT JOIN nums n USING (case_id) LEFT JOIN act a USING (case_id) LEFT JOIN engs e USING (case_id) LEFT JOIN codes k USING (case_id) LEFT JOIN resp p USING (case_id))""",
)
DASHBOARD = """
SELECT 'protection_count' AS metric, CASE WHEN expected_protection = '' THEN 'none' ELSE expected_protection END AS key, CAST(count(*) AS BIGINT) AS n FROM rows_ GROUP BY 1, 2
UNION ALL SELECT 'alert_count_by_technique', technique_id, CAST(sum(alert_count) AS BIGINT) FROM rows_ WHERE actual_alert GROUP BY 1, 2
UNION ALL SELECT 'event_count_by_code', event_code, count(*) FROM rows_ GROUP BY 1, 2
UNION ALL SELECT 'classification', classification, count(*) FROM rows_ GROUP BY 1, 2
UNION ALL SELECT 'total', 'response_count', CAST(sum(response_count) AS BIGINT) FROM rows_
UNION ALL SELECT 'total', 'correlated_sequence_count', 0
UNION ALL SELECT 'alert_count_by_rule', rule_id, count(*) FROM firsts GROUP BY 1, 2
UNION ALL SELECT 'alert_count_by_engine', engine, count(*) FROM (SELECT DISTINCT case_id, engine FROM ca) GROUP BY 1, 2
"""
INVENTORY = "inv AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(r.rule_id)}, {q(r.engine)}, {q(r.technique_id)}, {q(r.severity)}, {q('/'.join(map(str, r.event_codes)))})"
    for r in (*NATIVE_RULES, *SIGMA_LIKE_RULES)
) + ", " + ", ".join(
    f"({q(d.rule_id)}, 'behavioral', {q(d.technique_id)}, {q(d.severity)}, {q(d.event_codes)})" for d in SEQUENCES
) + ") v(rule_id, engine, technique_id, severity, event_code))"
COVERED = "cov AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(t)}, {q(catalog.TECHNIQUE_NAMES[t])}, {q(tactic)}, {q(codes)}, {q(','.join(engines))}, {n})"
    for n, (t, tactic, codes, engines) in enumerate(catalog.COVERED_TECHNIQUES, 1)
) + ") v(technique_id, technique_name, tactic, event_code, engines, rank))"
_RANKS = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {n}" for s, n in catalog.SEVERITY_RANK.items()) + " END"
_SEV = f"""sev AS (SELECT case_id, arg_max(severity, {_RANKS}) AS severity FROM firsts JOIN inv USING (rule_id) GROUP BY 1)"""


def _zero(metric: str, keys, source: str) -> str:
    wanted = ", ".join(f"({q(k)})" for k in keys)
    return (
        f"SELECT {q(metric)} AS metric, coalesce(w.key, s.key) AS key, CAST(coalesce(s.n, 0) AS BIGINT) AS n "
        f"FROM (VALUES {wanted}) w(key) FULL JOIN ({source}) s ON w.key = s.key"
    )


COVERAGE_SQL = tele(
    f"""SELECT technique_id, technique_name, tactic, engines, rule_ids, event_ids, demo_case_count, true_positive_count, false_positive_count,
  false_negative_count, sequence_count, has_response_or_protection, CAST(score AS BIGINT) AS score,
  CASE score {' '.join(f"WHEN {s} THEN {q(c)}" for s, c in catalog.SCORE_COLORS.items())} END AS color,
  lower(replace(tactic, ' ', '-')) AS slug,
  CASE WHEN technique_id = 'T1218' THEN 'T1218 is constrained T1218-lite demo coverage for deterministic LOLBin execution and behavioral sequence evidence.'
    ELSE technique_id || ' covered by ' || CASE engines WHEN 'native,sigma-like' THEN 'native and Sigma-like' ELSE 'native, Sigma-like, and behavioral' END
      || ' detections using Sysmon Event ID ' || event_ids || ' evidence.' END AS comment,
  CAST(rank AS BIGINT) AS rank, CAST(7 + CASE WHEN contains(engines, 'behavioral') OR demo_case_count > 0 OR has_response_or_protection THEN 1 ELSE 0 END AS BIGINT) AS n_metadata
FROM (SELECT *, CASE WHEN n_engines <= 1 THEN 1 WHEN engines = 'native,sigma-like' THEN 2 WHEN demo_case_count <= 0 THEN 3
    WHEN has_response_or_protection AND contains(engines, 'behavioral') THEN 5 ELSE 4 END AS score FROM agg)""",
    *CASES, INVENTORY, COVERED, *SEQUENCE_HITS,
    """facts AS (
  SELECT technique_id, 'engine' AS kind, unnest(string_split(engines, ',')) AS v FROM cov
  UNION ALL SELECT technique_id, 'code', unnest(string_split(event_code, '/')) FROM cov
  UNION ALL SELECT technique_id, 'engine', engine FROM inv UNION ALL SELECT technique_id, 'rule', rule_id FROM inv
  UNION ALL SELECT technique_id, 'code', unnest(string_split(event_code, '/')) FROM inv
  UNION ALL SELECT technique_id, 'engine', unnest(string_split(engines, ',')) FROM rows_
  UNION ALL SELECT technique_id, 'rule', unnest(string_split(rules, ',')) FROM rows_
  UNION ALL SELECT technique_id, 'code', unnest(string_split(event_code, '/')) FROM rows_)""",
    """d AS (SELECT DISTINCT technique_id, kind, v FROM facts WHERE v <> '')""",
    """sets AS (SELECT technique_id,
    string_agg(v, ',' ORDER BY CASE v WHEN 'native' THEN 1 WHEN 'sigma-like' THEN 2 WHEN 'behavioral' THEN 3 ELSE 4 END) FILTER (WHERE kind = 'engine') AS engines,
    count(*) FILTER (WHERE kind = 'engine') AS n_engines,
    string_agg(v, ',' ORDER BY v) FILTER (WHERE kind = 'rule') AS rule_ids,
    string_agg(v, '/' ORDER BY CAST(CASE WHEN kind = 'code' THEN v END AS INTEGER)) FILTER (WHERE kind = 'code') AS event_ids
    FROM d GROUP BY 1)""",
    """agg AS (SELECT c.technique_id, c.technique_name, c.tactic, c.rank, s.engines, s.n_engines, s.rule_ids, s.event_ids,
    count(r.case_id) AS demo_case_count, count(*) FILTER (WHERE r.classification = 'true_positive') AS true_positive_count,
    count(*) FILTER (WHERE r.classification = 'false_positive') AS false_positive_count,
    count(*) FILTER (WHERE r.classification = 'false_negative') AS false_negative_count,
    (SELECT count(*) FROM seqs q WHERE q.technique_id = c.technique_id) AS sequence_count,
    coalesce(bool_or(r.expected_response OR r.expected_protection = 'dry-run' OR r.response_count > 0), false) AS has_response_or_protection
    FROM cov c JOIN sets s USING (technique_id) LEFT JOIN rows_ r USING (technique_id) GROUP BY ALL)""",
)

# --- realtime evaluation ------------------------------------------------------------------------

_CASE_ROWS = "wide AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(c.case_id)}, {q(c.marker.lower())}, {q(c.technique_id)}, {str(c.expected_alert).lower()}, {c.window_seconds}, {n})"
    for n, c in enumerate(WIDE_CASES)
) + ") v(case_id, marker, technique_id, expected_alert, window_seconds, case_ord))"
_EVENT_TEXT = "concat_ws(' ', lower(l.stamp), l.name, l.exe, l.cmd, l.fpath, l.rpath, l.rdata, l.dip, l.edata)"
_ALERT_TEXT = "concat_ws(' ', lower(r.stamp), r.rule_id, r.name, r.exe, r.cmd, r.fpath, r.rpath, r.rdata, r.dip, lower(r.parent_name), r.rvalue)"
EPISODES = (
    LOWS, RT_HITS, _CASE_ROWS,
    f"sight AS (SELECT w.case_id, w.window_seconds, l.ts, l.seq FROM low l JOIN wide w ON contains({_EVENT_TEXT}, w.marker) WHERE l.ts IS NOT NULL)",
    "gaps AS (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER o) > CAST(window_seconds AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS is_new FROM sight WINDOW o AS (PARTITION BY case_id ORDER BY ts, seq))",
    "numbered AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY case_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM gaps)",
    # An alert is searched by its own document, which has no raw event data.
    f"linked AS (SELECT n.case_id, n.episode, n.seq, r.rule_id FROM numbered n JOIN rt r ON r.seq = n.seq JOIN wide w USING (case_id) WHERE contains({_ALERT_TEXT}, w.marker))",
    "fired AS (SELECT case_id, episode, count(*) AS alert_count, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM linked GROUP BY 1, 2)",
    """eps AS (SELECT n.case_id, n.episode, min(n.ts) AS first_seen, max(n.ts) AS last_seen, count(*) AS event_count,
    coalesce(any_value(f.alert_count), 0) AS alert_count, coalesce(any_value(f.rules), '') AS rules FROM numbered n LEFT JOIN fired f USING (case_id, episode) GROUP BY 1, 2)""",
    """done AS (SELECT e.*, w.technique_id, w.expected_alert, w.case_ord, CASE WHEN w.expected_alert AND alert_count > 0 THEN 'true_positive'
    WHEN NOT w.expected_alert AND alert_count > 0 THEN 'false_positive'
    WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(first_seen) < CAST(w.window_seconds AS BIGINT) * 1000000 THEN ''
    WHEN w.expected_alert THEN 'false_negative' ELSE 'true_negative' END AS classification FROM eps e JOIN wide w USING (case_id))""",
    """latest AS (SELECT w.case_id, w.technique_id, w.expected_alert, w.case_ord, CASE WHEN d.case_id IS NULL THEN 'not_seen' WHEN d.classification = '' THEN 'pending' ELSE 'complete' END AS status,
    coalesce(d.classification, '') AS classification, coalesce(d.event_count, 0) AS event_count, coalesce(d.alert_count, 0) AS alert_count, coalesce(d.rules, '') AS actual_rule_ids
    FROM wide w LEFT JOIN (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY episode DESC) = 1) d USING (case_id))""",
)
LINKS_SQL = tele(
    """SELECT case_id, episode, 'event' AS kind, count(DISTINCT seq) AS n FROM numbered GROUP BY 1, 2
UNION ALL SELECT case_id, episode, 'alert', count(*) FROM (SELECT DISTINCT case_id, episode, seq, rule_id FROM linked) GROUP BY 1, 2
UNION ALL SELECT case_id, episode, 'rule', count(DISTINCT rule_id) FROM linked GROUP BY 1, 2""",
    *EPISODES,
)
_TEXT_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_CLS = ("true_positive", "true_negative", "false_positive", "false_negative")

_POLICY_MARK = has("cmd", catalog.POLICY_MARKERS)
_APPROVED = within("rule_id", catalog.APPROVED_RULE_IDS)


def _policy(mode: str) -> str:
    run = mode == "execute"
    prefix = "" if run else "dry_run_default,"
    suffix = ",execute_requested,lab_allow_execute" if run else ""
    ok = f"({_APPROVED} OR {_POLICY_MARK})"
    good = "'execute allowed for approved lab protection action'" if run else "'dry-run planned for approved detection alert'"
    bare = "'execute blocked because PID is missing'" if run else "'dry-run planned for approved detection alert; PID missing so execution would be blocked'"
    blocked = f"(NOT {ok}" + (" OR pid IS NULL)" if run else ")")
    return f"""SELECT {q(mode)} AS mode, CASE WHEN {blocked} THEN 'blocked' ELSE 'planned' END AS status,
    CASE WHEN NOT {ok} THEN 'rule id is not approved and no safe demo marker is present' WHEN pid IS NULL THEN {bare} ELSE {good} END AS reason,
    '{prefix}' || CASE WHEN pid IS NULL THEN 'pid_missing' ELSE 'pid_present' END || ',process_not_protected,' ||
      CASE WHEN {_APPROVED} THEN 'approved_rule_id{suffix}' WHEN {_POLICY_MARK} THEN 'safe_demo_marker{suffix}' ELSE 'unsupported_rule_blocked' END AS checks, pid
    FROM native"""


SUMMARY_SQL = tele(
        """SELECT 'event_count_by_code' AS metric, CAST(event_code AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS value FROM e GROUP BY 1, 2
UNION ALL SELECT 'event_count', '', CAST(count(*) AS VARCHAR) FROM e UNION ALL SELECT 'latest_event_at', '', max(st) FROM e
UNION ALL SELECT 'alert_count_by_technique', technique_id, CAST(count(*) AS VARCHAR) FROM r GROUP BY 1, 2
UNION ALL SELECT 'alert_count_by_engine', 'realtime-native', CAST(count(*) AS VARCHAR) FROM r
UNION ALL SELECT 'severity_counts', severity, CAST(count(*) AS VARCHAR) FROM r GROUP BY 1, 2
UNION ALL SELECT 'alert_count', '', CAST(count(*) AS VARCHAR) FROM r UNION ALL SELECT 'latest_alert_at', '', max(st) FROM r""",
        LOWS, RT_HITS, f"e AS (SELECT *, {MS_STAMP} AS st FROM low)", f"r AS (SELECT *, {MS_STAMP} AS st FROM rt)",
    )


ORACLES: dict[str, str] = {
    "normalize_route": tele(
        """SELECT seq, category, type, action,
  CASE WHEN event_code = 7 THEN 'unsupported_event_id' WHEN pid IS NULL THEN 'bad_integer:ProcessId' ELSE '' END AS error_reason FROM tele"""
    ),
    "xml_events": tele(
        f"""SELECT seq, CAST(event_code AS BIGINT) AS event_code, stamp AS timestamp, host_name, user_domain, user_name, pid, entity_id, process_name, executable,
  coalesce(command_line, '') AS command_line, coalesce(array_to_string({_TOKENS}, '|'), '') AS args,
  CASE WHEN event_code = 1 THEN {_SHA} ELSE '' END AS sha256, CASE WHEN event_code = 1 THEN 'CD' || CAST(seq AS VARCHAR) ELSE '' END AS md5,
  coalesce(parent_name, '') AS parent_name, CASE WHEN event_code = 1 THEN strftime(raw_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' ELSE '' END AS created,
  coalesce(file_path, '') AS file_path, coalesce(file_name, '') AS file_name,
  CASE WHEN contains(file_name, '.') THEN list_extract(string_split(file_name, '.'), -1) ELSE '' END AS file_extension,
  coalesce(registry_path, '') AS registry_path, coalesce(registry_value, '') AS registry_value, coalesce(details, '') AS registry_data,
  coalesce(dest_ip, '') AS dest_ip, dest_port, coalesce(dest_domain, '') AS dest_domain, coalesce(lower(protocol), '') AS transport,
  CASE lower(initiated) WHEN 'true' THEN 'outbound' WHEN 'false' THEN 'inbound' ELSE '' END AS direction,
  'ecs_normalized,sysmon_event_' || CAST(event_code AS VARCHAR) AS tags
FROM tele WHERE {SUPPORTED} AND pid IS NOT NULL"""
    ),
    "message_fields": tele(
        f"""SELECT seq, CAST(event_code AS BIGINT) AS event_code, strftime(raw_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, pid, process_name,
  CASE WHEN command_line IS NULL THEN '' ELSE trim(command_line) || chr(10) || 'continued text' END AS command_line, entity_id,
  CASE WHEN file_path IS NULL THEN '' ELSE file_path || chr(10) || 'continued text' END AS file_path, coalesce(registry_path, '') AS registry_path,
  CASE WHEN details IS NULL THEN '' ELSE details || chr(10) || 'continued text' END AS registry_data, coalesce(dest_ip, '') AS dest_ip, dest_port,
  coalesce(lower(protocol), '') AS transport, CASE lower(initiated) WHEN 'true' THEN 'outbound' WHEN 'false' THEN 'inbound' ELSE '' END AS direction, host_name,
  CAST(2 + CASE WHEN pid IS NULL THEN 0 ELSE 1 END + CASE WHEN entity_id = '' THEN 0 ELSE 1 END + CASE event_code WHEN 1 THEN 1 WHEN 11 THEN 1 WHEN 13 THEN 2
    ELSE 2 + CASE WHEN initiated = '' THEN 0 ELSE 1 END + CASE WHEN dest_ip = '' THEN 0 ELSE 1 END + 1 END AS BIGINT) AS n_fields
FROM tele WHERE {SUPPORTED}"""
    ),
    "path_scalars": tele(
        """SELECT seq, process_name AS base, user_domain AS domain, user_name AS name, coalesce(file_name, '') AS file_base,
  CASE WHEN contains(file_name, '.') THEN list_extract(string_split(file_name, '.'), -1) ELSE '' END AS extension, coalesce(registry_value, '') AS registry_value FROM tele"""
    ),
    "text_scalars": tele(
        f"""SELECT seq, CAST(coalesce(len({_TOKENS}), 0) AS BIGINT) AS n_args, coalesce(array_to_string({_TOKENS}, '|'), '') AS args,
  CASE WHEN event_code = 1 THEN {_SHA} ELSE '' END AS sha256, CASE WHEN event_code = 1 THEN 'CD' || CAST(seq AS VARCHAR) ELSE '' END AS md5,
  CASE lower(initiated) WHEN 'true' THEN 'outbound' WHEN 'false' THEN 'inbound' ELSE '' END AS direction, coalesce(lower(protocol), '') AS transport,
  CASE WHEN seq % 3 = 1 THEN NULL ELSE k END AS number, CAST(2 AS BIGINT) AS depth, coalesce(k % 10 = 1 AND event_code = 1, false) AS encoded FROM tele"""
    ),
    "timestamp_scalars": tele(
        """SELECT seq, CASE seq % 4 WHEN 0 THEN strftime(raw_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' ELSE '' END AS utc_iso,
  CASE WHEN seq % 4 = 3 THEN 'n/a' WHEN seq % 4 = 1 AND stamp = 'not-a-time' THEN stamp WHEN seq % 4 = 2 THEN strftime(date_trunc('second', raw_ts) - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.000Z'
    ELSE strftime(raw_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS normalized,
  CASE WHEN seq % 4 = 3 OR (seq % 4 = 1 AND stamp = 'not-a-time') OR seq % 4 = 0 THEN CASE WHEN seq % 4 = 0 THEN CAST(extract(hour FROM raw_ts) AS BIGINT) END ELSE CAST(extract(hour FROM raw_ts) AS BIGINT) END AS hour,
  CASE WHEN seq % 4 = 3 OR (seq % 4 = 1 AND stamp = 'not-a-time') THEN NULL WHEN seq % 4 = 2 THEN epoch_us(date_trunc('second', raw_ts) - INTERVAL 330 MINUTE)
    WHEN seq % 4 = 0 THEN epoch_us(date_trunc('millisecond', raw_ts)) ELSE epoch_us(raw_ts) END AS micros,
  strftime(raw_ts, '%Y-%m-%dT%H:%M:%SZ') AS created,
  CASE WHEN seq % 4 = 3 THEN 'n/a' WHEN seq % 4 = 1 AND stamp = 'not-a-time' THEN stamp WHEN seq % 4 = 2 THEN strftime(date_trunc('second', raw_ts) - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.000Z'
    ELSE strftime(raw_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS event_timestamp FROM tele"""
    ),
    "document_ids": tele(
        f"""SELECT seq, CASE WHEN seq % 3 = 0 THEN CAST(seq AS VARCHAR) WHEN seq % 3 = 1 THEN '{{' || entity_id || '}}' ELSE
  {digest("'event'", ["'windows.sysmon_operational'", "event_code", "stamp", "host_name", "entity_id", "pid", "executable", "command_line"], 32)} END AS document_id,
  CASE WHEN seq % 3 = 0 THEN CAST(seq AS VARCHAR) WHEN seq % 3 = 1 THEN '{{' || entity_id || '}}' ELSE entity_id END AS envelope_id,
  CASE WHEN stamp <> 'not-a-time' THEN 'edr-normalized-events-' || strftime(ts, '%Y.%m.%d') END AS index_name FROM tele WHERE {SUPPORTED}"""
    ),
    "raw_projection": tele(
        f"""SELECT host_name, 'edr.raw' AS dataset, 'logstash-http' AS ingest_source, 'sysmon_event_' || CAST(event_code AS VARCHAR) || '_raw' AS tag,
  'T1059.001' AS technique_id, count(*) AS n FROM tele WHERE {SUPPORTED} GROUP BY ALL"""
    ),
    "log_row_decode": tele(
        f"""SELECT seq, CAST(event_code AS BIGINT) AS event_code, strftime(raw_ts, '%Y-%m-%d %H:%M:%S.%g') AS time_created, executable AS message, '' AS provider_name, '' AS xml
FROM tele WHERE {SUPPORTED} AND raw_ts >= TIMESTAMP '2024-01-11 00:00:00'"""
    ),
    "sensor_exclusion": tele(f"SELECT executable, count(*) AS n FROM tele WHERE {SUPPORTED} AND executable <> 'C:\\Windows\\System32\\notepad.exe' GROUP BY 1"),
    "envelope_validation": tele(
        """SELECT CASE WHEN seq % 12 = 10 THEN 'not_json' WHEN seq % 12 = 0 THEN 'schema_version' WHEN seq % 12 = 1 THEN 'event_id' WHEN seq % 12 = 2 THEN 'event'
    WHEN seq % 12 = 3 THEN 'metadata' WHEN seq % 12 = 4 THEN 'event.event' WHEN seq % 12 = 5 THEN 'event.dataset' WHEN event_code <> 1 THEN 'event.code'
    WHEN seq % 12 = 6 THEN 'metadata.producer' WHEN seq % 12 = 7 THEN 'metadata.source' WHEN seq % 12 = 8 THEN 'metadata.pipeline_phase'
    WHEN seq % 12 = 9 THEN 'metadata.created_at' ELSE '' END AS error_reason, count(*) AS n,
    count(DISTINCT CASE WHEN seq % 12 IN (1, 10) THEN '' ELSE CAST(seq AS VARCHAR) END) AS ids FROM tele GROUP BY 1"""
    ),
    "native_rule_matches": tele("SELECT seq, rule_id, matched_fields FROM native", LOWS, NATIVE),
    "sigma_like_matches": tele("SELECT seq, rule_id, matched_fields FROM sigma", LOWS, SIGMA),
    "multi_branch_rules": tele(
        "SELECT rule_id, CAST(event_code AS BIGINT) AS event_code, matched_fields, count(*) AS n FROM native WHERE rule_ord > 0 GROUP BY ALL", LOWS, NATIVE
    ),
    "alert_documents": tele(
        "SELECT alert_id, severity, rule_id, rule_name, technique_id, tactic, engine, matched_fields, host_name, process_name, CAST(seq AS VARCHAR) AS document_id FROM alerts",
        *ENGINES, ALERTS,
    ),
    "realtime_rules": tele(
        f"SELECT seq, CAST(rule_ord AS BIGINT) AS rule_ord, rule_id, matched_fields, reason, severity, {MS_STAMP} AS timestamp, {_SUMMARY} AS evidence FROM rt", LOWS, RT_HITS
    ),
    "candidate_topk": tele(
        """SELECT seq, stamp AS timestamp, process_name FROM low WHERE event_code = 1 AND (process_name = 'powershell.exe' OR ends_with(exe, '\\powershell.exe') OR contains(cmd, 'powershell.exe'))
ORDER BY stamp DESC, seq LIMIT 100""",
        LOWS,
    ),
    "evidence_projection": tele(
        f"""SELECT seq, etext AS event_text, concat_ws(',', {_MARKERS}) AS markers, concat_ws(',',
    CASE WHEN dest_ip <> '' THEN 'destination.ip' END, CASE WHEN dest_port IS NOT NULL THEN 'destination.port' END,
    CASE WHEN file_path IS NOT NULL THEN 'file.path' END, CASE WHEN parent_name IS NOT NULL THEN 'parent.process.name' END,
    CASE WHEN command_line IS NOT NULL THEN 'process.command_line' END, 'process.executable', 'process.name',
    CASE WHEN details IS NOT NULL THEN 'registry.data' END, CASE WHEN registry_path IS NOT NULL THEN 'registry.path' END, CASE WHEN registry_value IS NOT NULL THEN 'registry.value' END) AS evidence_keys,
  {_SUMMARY} AS summary FROM texts""",
        LOWS, f"texts AS (SELECT *, {_TEXT} AS etext FROM low)",
    ),
    "sequence_process_network_file": T1105_SQL,
    "sequence_with_optional": OPTIONAL_SQL,
    "host_ordinals": tele(
        f"SELECT seq, host_name, row_number() OVER (PARTITION BY host_name ORDER BY coalesce(ts, TIMESTAMP '1970-01-01'), seq) AS host_ord FROM tele WHERE {SUPPORTED}"
    ),
    "sequence_numbers": tele(
        "SELECT host_name, sequence_name, seq AS anchor, row_number() OVER (ORDER BY host_name, sequence_name, seq) AS number FROM seqs", LOWS, *SEQUENCE_HITS
    ),
    "correlate_batch": correlation(CORRELATION_WINDOW, _TRIPLE_RULE),
    "correlated_alert_documents": correlation(
        CORRELATION_WINDOW,
        f"""{digest("'behavioral-realtime-t1105-process-network-file'", ["'behavioral.realtime.t1105.process_network_file'", "process_no", "network_no", "file_no", _FILE_STAMP])} AS alert_id, {_FILE_STAMP} AS timestamp,
  'high' AS severity, 'behavioral.realtime.t1105.process_network_file' AS rule_id, 'T1105' AS technique_id, 'sequence.process,sequence.network,sequence.file' AS matched_fields, CAST(3 AS BIGINT) AS n,
  concat_ws(',', process_no, network_no, file_no) AS source_event_ids, '1,3,11' AS codes, CAST(file_no AS VARCHAR) AS source_event, f.host_name, f.process_name, f.file_path,
  'file.path,process.executable,process.name' AS evidence_keys, (SELECT e.command_line FROM ev e WHERE e.seq = process_no) AS first_command_line""",
    ),
    "correlate_host_scoped": correlation(SEQUENCE_WINDOW, _TRIPLE, True),
    "stream_correlation": correlation(CORRELATION_WINDOW, _TRIPLE_RULE),
    "anomaly_features": tele(
        """SELECT seq, process_name, parent_name AS parent_process_name, CAST(n_chars AS BIGINT) AS command_line_length, CAST(n_args AS BIGINT) AS args_count,
  CAST(depth AS BIGINT) AS executable_directory_depth, encoded AS has_encoded_command, keywords <> '' AS has_network_tool_flag, keywords AS matched_network_keywords, hour AS hour_of_day FROM feat""",
        LOWS, _FEATURES,
    ),
    "anomaly_scores": tele("SELECT seq, score, score >= 0.7 AS is_anomaly, reasons FROM scored", LOWS, _FEATURES, _score(range(6, 20))),
    "anomaly_rejects": tele(
        f"SELECT CASE WHEN event_code = 1 THEN '' ELSE 'wrong_event_code' END AS reason, count(*) AS n FROM tele WHERE {SUPPORTED} GROUP BY 1"
    ),
    "response_rejects": tele(
        "SELECT CASE seq % 4 WHEN 1 THEN 'missing_alert_id' WHEN 3 THEN 'missing_rule_or_technique' ELSE '' END AS reason, count(*) AS n FROM allhits GROUP BY 1", *ENGINES
    ),
    "written_protection": tele("SELECT mode, status, count(*) AS n FROM (" + _policy("dry-run") + ") GROUP BY ALL", LOWS, NATIVE),
    "case_totals": tele(
        "SELECT CAST(7 AS BIGINT) AS total_cases, " + ", ".join(f"count(*) FILTER (WHERE classification = {q(c)}) AS {c}_count" for c in _CLS) + " FROM rows_", *CASES
    ),
    "capability_report": tele(
        """SELECT capability, CASE WHEN capability IN ('unknown') OR (capability IN ('anomaly', 'everything') AND bad > 0) THEN 'failed' ELSE 'passed' END AS status
FROM (VALUES ('rules'), ('sequences'), ('anomaly'), ('everything'), ('unknown'), ('plain')) v(capability),
  (SELECT count(*) AS bad FROM low WHERE (user_no % 60) % 5 = 3 AND (user_no % 60) % 3 = 0 AND event_code <> 1)""",
        LOWS,
    ),
    "anomaly_alerts": tele(
        "SELECT CAST(seq AS VARCHAR) AS document_id, 'ml.process_anomaly' AS rule_id, 'ml-anomaly' AS engine, score, CAST(n_reasons AS BIGINT) AS n_reasons FROM scored WHERE score >= 0.7",
        LOWS, _FEATURES, _score(range(24)),
    ),
    "response_plan": tele(
        f"""SELECT {digest("'soar-response'", ["playbook_id", "alert_id", "action_ids"])} AS response_id, severity, 'planned' AS status, alert_id, rule_id, technique_id, playbook_id, actions
FROM (SELECT *, {_PB_ORD} AS ord FROM alerts) JOIN pb USING (ord)""",
        *ENGINES, ALERTS, _PB,
    ),
    "policy_decisions": tele(
        "SELECT mode, status, reason, checks, count(*) AS n, count(DISTINCT pid) AS pids FROM (" + _policy("dry-run") + " UNION ALL " + _policy("execute") + ") GROUP BY ALL",
        LOWS, NATIVE,
    ),
    "case_matrix": tele(
        """SELECT case_id, technique_id, expected_alert, actual_alert, classification, alert_count, events AS normalized_event_count, response_count, rules AS actual_rule_ids,
  engines AS actual_engines, event_code FROM rows_""",
        *CASES,
    ),
    "case_matrix_engines": tele(
        """SELECT 'engine_case_' || CAST(c.no AS VARCHAR) AS case_id, c.engine, CASE WHEN c.bad THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN c.bad THEN 'wrong_event_code' ELSE '' END AS error, c.no % 3 <> 0 AS expected_alert,
  CASE WHEN c.no % 3 <> 0 AND NOT c.bad AND a.n > 0 THEN 'true_positive' WHEN c.no % 3 <> 0 THEN 'false_negative' WHEN NOT c.bad AND a.n > 0 THEN 'false_positive' ELSE 'true_negative' END AS classification,
  CASE WHEN c.bad THEN 0 ELSE coalesce(a.n, 0) END AS alert_count, CASE WHEN c.bad THEN 0 ELSE coalesce(a.planned, 0) END AS response_count,
  CASE WHEN c.bad THEN 0 ELSE coalesce(a.correlated, 0) END AS correlated_sequence_count, CASE WHEN c.bad THEN 0 ELSE c.n END AS normalized_event_count,
  CASE WHEN c.bad THEN '' ELSE coalesce(a.rules, '') END AS actual_rule_ids, CASE WHEN c.bad THEN '' ELSE coalesce(a.engines, '') END AS actual_engines,
  CASE WHEN c.bad THEN '' ELSE coalesce(a.sequences, '') END AS actual_sequence_names, CASE WHEN c.bad THEN '' ELSE c.codes END AS event_code
FROM ecases c LEFT JOIN eacts a USING (no)""",
        *ENGINES, _FEATURES, _score(range(24)), *sequence_hits(f"a.user_no % {ENGINE_CASES} = c.user_no % {ENGINE_CASES}"),
        f"kept AS (SELECT user_no % {ENGINE_CASES} AS no, seq, event_code FROM low WHERE (user_no % {ENGINE_CASES}) % 5 <> 3 OR (user_no % {ENGINE_CASES}) % 3 = 0 OR event_code = 1)",
        """ecases AS (SELECT no, (['native', 'sigma-like', 'all', 'ml-anomaly', 'behavioral'])[no % 5 + 1] AS engine, CAST(sum(n) AS BIGINT) AS n,
    no % 5 = 3 AND bool_or(event_code <> 1) AS bad, string_agg(CAST(event_code AS VARCHAR), '/' ORDER BY first) AS codes
    FROM (SELECT no, event_code, count(*) AS n, min(seq) AS first FROM kept GROUP BY 1, 2) GROUP BY 1)""",
        f"""efacts AS (
    SELECT user_no % {ENGINE_CASES} AS no, rule_id, technique_id, engine, CAST(NULL AS VARCHAR) AS sequence_name FROM allhits WHERE (user_no % {ENGINE_CASES}) % 5 = 2 OR (engine = 'native' AND (user_no % {ENGINE_CASES}) % 5 = 0) OR (engine = 'sigma-like' AND (user_no % {ENGINE_CASES}) % 5 = 1)
    UNION ALL SELECT user_no % {ENGINE_CASES}, 'ml.process_anomaly', NULL, 'ml-anomaly', NULL FROM scored WHERE score >= 0.7 AND (user_no % {ENGINE_CASES}) % 5 = 3
    UNION ALL SELECT user_no % {ENGINE_CASES}, rule_id, technique_id, 'behavioral', sequence_name FROM seqs WHERE (user_no % {ENGINE_CASES}) % 5 = 4)""",
        f"""eacts AS (SELECT no, count(*) AS n, count(*) FILTER (WHERE {_PB_ORD} IS NOT NULL) AS planned, count(*) FILTER (WHERE engine = 'behavioral') AS correlated,
    string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines,
    string_agg(DISTINCT sequence_name, ',' ORDER BY sequence_name) AS sequences FROM efacts GROUP BY 1)""",
    ),
    "case_dashboard": tele(DASHBOARD, *CASES),
    "count_maps": tele(
        f"SELECT metric, string_agg(key || '=' || CAST(n AS VARCHAR), ',' ORDER BY key) AS counts FROM ({DASHBOARD}) WHERE metric NOT IN ('total', 'classification') GROUP BY 1", *CASES
    ),
    "technique_coverage": COVERAGE_SQL,
    "coverage_report": tele(
        """SELECT '2026-01-01T00:00:00Z' AS generated_at, CAST(4 AS BIGINT) AS n_techniques, (SELECT string_agg(rule_id, ';' ORDER BY rule_id) FROM inv) AS rules,
  (SELECT count(*) FROM inv) AS total_rule_count, string_agg(concat_ws(':', engine, needed, missing, alerts, missing = 0), ';' ORDER BY engine) AS validations, bool_and(missing = 0) AS all_passed
FROM (SELECT engine, count(*) AS needed, count(*) FILTER (WHERE n IS NULL) AS missing, CAST(coalesce(sum(n), 0) AS BIGINT) AS alerts
  FROM inv LEFT JOIN (SELECT rule_id, count(*) AS n FROM (SELECT rule_id FROM allhits UNION ALL SELECT rule_id FROM seqs) GROUP BY 1) USING (rule_id) GROUP BY 1)""",
        *ENGINES, INVENTORY, *SEQUENCE_HITS,
    ),
    "engine_summary": tele(
        """SELECT engine, count(*) AS rule_count, count(n) AS fired_rule_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS alert_count, count(DISTINCT technique_id) AS technique_count
FROM inv LEFT JOIN (SELECT rule_id, count(*) AS n FROM allhits GROUP BY 1) USING (rule_id) GROUP BY 1""",
        *ENGINES, INVENTORY,
    ),
    "filtered_alert_counts": tele(
        """SELECT 't1059' AS kind, 'total' AS key, count(*) AS n FROM allhits WHERE technique_id = 'T1059.001'
UNION ALL SELECT 't1059', 'native', count(*) FROM native WHERE technique_id = 'T1059.001' UNION ALL SELECT 't1059', 'sigma_like', count(*) FROM sigma WHERE technique_id = 'T1059.001'
UNION ALL SELECT 'rule', rule_id, count(*) FROM allhits GROUP BY 1, 2 UNION ALL SELECT 'engine', engine, count(*) FROM allhits GROUP BY 1, 2""",
        *ENGINES,
    ),
    "collection_counts": tele(
        """SELECT 'edr-normalized-events' AS collection, count(*) AS n FROM low UNION ALL SELECT 'edr-raw-events', count(*) FROM tele
UNION ALL SELECT 'edr-alerts-native', count(*) FROM native""",
        LOWS, NATIVE,
    ),
    "zero_filled_counts": tele(
        " UNION ALL ".join(
            (
                _zero("severity", catalog.SEVERITIES, "SELECT severity AS key, count(*) AS n FROM sev GROUP BY 1"),
                _zero(
                    "engine", catalog.DASHBOARD_ENGINES,
                    "SELECT key, sum(w) AS n FROM (SELECT unnest(string_split(CASE WHEN engines = '' THEN 'unknown' ELSE engines END, ',')) AS key, CASE WHEN alert_count = 0 THEN 1 ELSE alert_count END AS w FROM rows_) GROUP BY 1",
                ),
                _zero("event_code", ("1", "3", "11", "13"), "SELECT key, count(*) AS n FROM (SELECT unnest(string_split(event_code, '/')) AS key FROM rows_) GROUP BY 1"),
                _zero("technique", catalog.TECHNIQUE_ORDER, "SELECT technique_id AS key, count(*) AS n FROM rows_ GROUP BY 1"),
            )
        ),
        *CASES, INVENTORY, _SEV,
    ),
    "dashboard_totals": tele(
        """SELECT count(*) AS total_cases, CAST(sum(alert_count) AS BIGINT) AS total_alerts, CAST(0 AS BIGINT) AS correlated_sequences, CAST(11 AS BIGINT) AS rule_count, CAST(4 AS BIGINT) AS technique_count,
  (SELECT count(DISTINCT rule_id) FROM named) AS fired_rules, (SELECT count(DISTINCT technique_id) FROM named) AS fired_techniques, (SELECT count(*) FROM seqs) AS sequence_alerts FROM rows_""",
        *CASES, *SEQUENCE_HITS, "named AS (SELECT rule_id, technique_id FROM allhits UNION ALL SELECT rule_id, technique_id FROM seqs)",
    ),
    "dashboard_rows": tele(
        """SELECT case_id, technique_id, classification, alert_count, event_code, coalesce(severity, 'unknown') AS severity, '-' AS process, expected_alert AS expected_malicious, expected_protection
FROM rows_ LEFT JOIN sev USING (case_id)""",
        *CASES, INVENTORY, _SEV,
    ),
    "expected_rule_checks": tele(
        """SELECT case_id, CAST(2 AS BIGINT) AS expected_alert_count, alert_count AS actual_alert_count, CASE WHEN contains(rules, 'det.t1105.lolbin_download') THEN 0 ELSE 1 END::BIGINT AS missing_rule_count,
  contains(rules, 'det.t1105.lolbin_download') AND alert_count = 2 AS passed FROM rows_ WHERE expected_alert""",
        *CASES,
    ),
    "unknown_cases": """SELECT DISTINCT 'case_' || CAST(user_id * 7 + event_id % 7 AS VARCHAR) AS case_id FROM events
  WHERE user_id * 7 + event_id % 7 NOT IN (SELECT user_id * 7 + event_id % 7 FROM events WHERE event_type = 'view')""",
    "episode_sessions": tele(
        f"""SELECT case_id, episode, CASE WHEN classification = '' THEN 'pending' ELSE 'complete' END AS status, classification, {_TEXT_TS.format('first_seen')} AS first_seen,
  {_TEXT_TS.format('last_seen')} AS last_seen, event_count, alert_count, rules AS actual_rule_ids FROM done""",
        *EPISODES,
    ),
    "case_classification": tele("SELECT case_id, technique_id, expected_alert, status, classification, event_count, alert_count, actual_rule_ids FROM latest", *EPISODES),
    "evaluation_counts": tele(
        "SELECT count(*) AS case_count, count(*) FILTER (WHERE status <> 'not_seen') AS observed_case_count, "
        + ", ".join(f"count(*) FILTER (WHERE classification = {q(c)}) AS {c}" for c in _CLS)
        + ", count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'not_seen') AS not_seen FROM latest",
        *EPISODES,
    ),
    "realtime_summary": SUMMARY_SQL,
    "stream_summary": SUMMARY_SQL,
    "latest_events": tele(
        f"SELECT seq, stamp AS timestamp, CAST(event_code AS BIGINT) AS event_code FROM tele WHERE {SUPPORTED} ORDER BY ts DESC NULLS LAST, seq DESC LIMIT 500"
    ),
    "alert_case_lookup": tele(
        """SELECT CAST(r.seq AS VARCHAR) || '-' || CAST(r.rule_ord AS VARCHAR) AS alert_id, coalesce(nullif(l.classification, ''), l.status, 'pending') AS classification, r.rule_id, r.severity,
  r.process_name AS process, CAST(r.event_code AS VARCHAR) AS event_code, coalesce(l.expected_alert, true) AS expected_alert, coalesce(l.case_id, '') AS case_id
FROM rt r LEFT JOIN (SELECT rule_id, min(case_ord) AS rule_ord_ FROM final GROUP BY 1) m USING (rule_id)
LEFT JOIN (SELECT seq, rule_id, min(case_ord) AS own_ord FROM final GROUP BY 1, 2) o ON o.seq = r.seq AND o.rule_id = r.rule_id
LEFT JOIN latest l ON l.case_ord = least(m.rule_ord_, o.own_ord)""",
        *EPISODES,
        "final AS (SELECT k.*, w.case_ord FROM linked k JOIN wide w USING (case_id) JOIN (SELECT case_id, max(episode) AS episode FROM numbered GROUP BY 1) x USING (case_id, episode))",
    ),
    "episode_links": LINKS_SQL,
    "stream_episode_links": LINKS_SQL,
    "untimed_activity": tele(
        """SELECT 'evaluation_event' AS consumer, 'missing_time' AS reason, case_id AS of, count(*) AS n FROM lost GROUP BY 3
UNION ALL SELECT 'evaluation_alert', 'missing_time', w.case_id, count(*) FROM wide w, rt r WHERE r.ts IS NULL AND contains("""
        + _ALERT_TEXT + """, w.marker) GROUP BY 3
UNION ALL SELECT 'correlation', 'missing_time', step, count(*) FROM late GROUP BY 3""",
        LOWS, RT_HITS, _CASE_ROWS,
        f"lost AS (SELECT w.case_id FROM low l JOIN wide w ON contains({_EVENT_TEXT}, w.marker) WHERE l.ts IS NULL)",
        f"""late AS (SELECT CASE WHEN event_code = 1 AND {_RT_TOOL} AND {has('etext', catalog.REALTIME_PROCESS_STEP_MARKERS)} THEN 'process'
      WHEN event_code = 3 AND {_RT_TOOL} THEN 'network' WHEN event_code = 11 AND {has('etext', catalog.REALTIME_FILE_STEP_MARKERS)} THEN 'file' ELSE 'none' END AS step
      FROM (SELECT *, {_RT_TEXT} AS etext FROM low WHERE ts IS NULL))""",
    ),
    "dedupe_records": "SELECT event_id // 2 AS record_id, event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_id) = 1",
    "distinct_realtime_alerts": tele(
        "SELECT seq, rule_id, reason FROM rt QUALIFY row_number() OVER (PARTITION BY seq, rule_id ORDER BY rule_ord) = 1", LOWS, RT_HITS
    ),
    "daily_upsert": tele(
        f"""SELECT strftime(ts, '%Y.%m.%d') AS day, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM tele WHERE {SUPPORTED} GROUP BY 1
UNION ALL SELECT '2001.01.01', count(*), CAST(sum(seq) AS BIGINT) FROM tele WHERE {SUPPORTED} AND seq % 500 = 0 HAVING count(*) > 0"""
    ),
    "written_alerts": tele("SELECT rule_id, severity, count(DISTINCT alert_id) AS n FROM alerts GROUP BY 1, 2", *ENGINES, ALERTS),
    "written_responses": tele(
        f"""SELECT playbook_id, rule_id, count(DISTINCT {digest("'soar-response'", ["playbook_id", "alert_id", "action_ids"])}) AS n
FROM (SELECT *, {_PB_ORD} AS ord FROM alerts) JOIN pb USING (ord) GROUP BY 1, 2""",
        *ENGINES, ALERTS, _PB,
    ),
    "xml_rejects": tele(
        f"""SELECT seq, CASE seq % 8 WHEN 1 THEN 'malformed_xml' WHEN 2 THEN 'malformed_xml' WHEN 3 THEN 'malformed_xml' WHEN 4 THEN 'unsupported_event_id'
  WHEN 5 THEN 'missing_element:Computer' WHEN 6 THEN 'bad_integer:ProcessId' WHEN 7 THEN 'missing_xml' WHEN 0 THEN CASE WHEN pid IS NULL THEN 'bad_integer:ProcessId' END END AS error_reason
FROM tele WHERE {SUPPORTED}"""
    ),
    "stream_alerts": correlation(
        CORRELATION_WINDOW, _TRIPLE_RULE,
        within_="SELECT rule_id, 'behavioral' AS engine, 'high' AS severity, timestamp, concat_ws(',', process_id, network_id, file_id) AS source_event_ids FROM (@) "
        f"UNION ALL SELECT rule_id, 'realtime-native', severity, {MS_STAMP}, CAST(seq AS VARCHAR) FROM (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY seq, rule_id ORDER BY rule_ord) = 1)",
        more=(RT_HITS,),
    ),
    "stream_latest": tele(
        f"""SELECT 'kept_event' AS kind, seq, stamp AS timestamp, '' AS rule_id FROM (SELECT * FROM low ORDER BY ts DESC NULLS LAST, seq DESC LIMIT 500)
UNION ALL SELECT 'shown_event', seq, stamp, '' FROM (SELECT * FROM low ORDER BY ts DESC NULLS LAST, seq DESC LIMIT 80)
UNION ALL SELECT 'alert', seq, {MS_STAMP}, rule_id FROM (SELECT * FROM (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY seq, rule_id ORDER BY rule_ord) = 1) ORDER BY ts DESC NULLS LAST, seq DESC, rule_id LIMIT 200)""",
        LOWS, RT_HITS,
    ),
    "stream_record_order": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM events",
    "stream_rules_summary": tele("SELECT rule_id, severity, count(*) AS n FROM rt GROUP BY ALL", LOWS, RT_HITS),
    "stream_evaluation": tele(
        f"""SELECT case_id, episode, classification, {_TEXT_TS.format('first_seen')} AS first_seen, {_TEXT_TS.format('last_seen')} AS last_seen, event_count, alert_count, rules AS actual_rule_ids FROM stream""",
        *EPISODES,
        # The stream's own clock decides: windows still open at the last event stay pending.
        """stream AS (SELECT d.* REPLACE (CASE WHEN d.alert_count = 0 AND epoch_us(m.newest) - epoch_us(d.first_seen) < CAST(w.window_seconds AS BIGINT) * 1000000 THEN '' ELSE d.classification END AS classification)
    FROM done d JOIN wide w USING (case_id), (SELECT max(ts) AS newest FROM sight) m)""",
    ),
    "stream_dedupe": tele(f"SELECT DISTINCT seq // 2 AS record_id FROM tele WHERE {SUPPORTED}"),
    "stream_series": tele(f"SELECT strftime(raw_ts, '%Y-%m-%d') AS day, CAST(event_code AS BIGINT) AS event_code, count(*) AS n FROM tele WHERE {SUPPORTED} GROUP BY ALL"),
    "stream_consume": tele("SELECT rule_id, host_name, count(*) AS n FROM allhits WHERE event_code = 1 GROUP BY ALL", *ENGINES),
}
