"""Detection content: fixed values and the driver-side definitions built from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values: telemetry constants -------------------------------------------------------
DATASET = "windows.sysmon_operational"
RAW_DATASET = "edr.raw"
MODULE = "sysmon"
PROVIDER = "Microsoft-Windows-Sysmon"
LOG_NAME = "Microsoft-Windows-Sysmon/Operational"
SUPPORTED_CODES = (1, 3, 11, 13)
INGEST_SOURCE = "logstash-http"
SENSOR_IMAGES = (
    "C:\\Windows\\System32\\Sysmon.exe",
    "C:\\Windows\\Sysmon.exe",
    "C:\\Windows\\System32\\Sysmon64.exe",
    "C:\\Windows\\Sysmon64.exe",
)

# --- Fixed values: transport envelope --------------------------------------------------------
SCHEMA_VERSION = "1.0"
ENVELOPE_PRODUCER = "edr-live-telemetry-pipeline"
PIPELINE_PHASE = "phase-4-kafka-mvp"
ENVELOPE_SOURCES = ("fixture", "xml")
EVENTS_TOPIC = "normalized-events"

# --- Fixed values: daily collections ---------------------------------------------------------
EVENT_INDEX = "edr-normalized-events"
RAW_INDEX = "edr-raw-events"
ALERT_INDEX = "edr-alerts-native"
RESPONSE_INDEX = "edr-soar-responses"
PROTECTION_INDEX = "edr-protection-actions"

# --- Fixed values: marker and process lists --------------------------------------------------
DOWNLOAD_PROCESSES = ("certutil.exe", "bitsadmin.exe", "curl.exe", "powershell.exe")
DOWNLOAD_MARKERS = (
    "urlcache",
    "bitsadmin",
    "Invoke-WebRequest",
    "iwr",
    "curl",
    "http://127.0.0.1",
    "example.test",
    "EDR_DEMO_T1105",
)
DEMO_DESTINATION_IP = "127.0.0.1"
DEMO_DESTINATION_DOMAIN = "example.test"
RUN_KEY_PATHS = (
    "\\Software\\Microsoft\\Windows\\CurrentVersion\\Run",
    "\\Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce",
)
RUN_KEY_DETAILS = ("powershell.exe", "cmd.exe", "rundll32.exe", "EDRDemo", "EDR_DEMO_T1547")
PROXY_PROCESSES = ("rundll32.exe", "regsvr32.exe", "mshta.exe")
PROXY_MARKERS = (
    "EDR_DEMO_T1218",
    "javascript:",
    "scrobj.dll",
    "url.dll,FileProtocolHandler",
    "suspicious.dll",
    "example.test",
)
PERSISTENCE_PROCESSES = ("reg.exe", "powershell.exe")
PERSISTENCE_PROCESS_MARKERS = ("EDR_DEMO_T1547", "Run", "RunOnce", "registry persistence", "EDRDemo")
PERSISTENCE_PAYLOAD_MARKERS = ("EDR_DEMO_T1547", "EDRDemo")
SEQUENCE_CONTEXT_MARKERS = (
    "EDR_DEMO_T1105",
    "EDR_DEMO_T1547",
    "EDR_DEMO_T1218",
    "EDRDemo",
    "example.test",
    "edr_demo",
    "suspicious.dll",
    "scrobj.dll",
    "url.dll,FileProtocolHandler",
)
REALTIME_DOWNLOAD_TOOLS = ("curl.exe", "powershell.exe", "pwsh.exe", "certutil.exe", "bitsadmin.exe")
REALTIME_SHELLS = ("powershell.exe", "pwsh.exe")
REALTIME_DOWNLOAD_CHECKS = (
    ("process.command_line", ("EDR_DEMO_T1105", "http://127.0.0.1", "localhost")),
    ("file.path", ("EDR_DEMO_T1105", "edr_demo_t1105", "edr_demo")),
    ("file.name", ("EDR_DEMO_T1105", "edr_demo_t1105", "edr_demo")),
    ("destination.ip", ("127.0.0.1",)),
    ("destination.domain", ("localhost", "example.test")),
    ("raw.message", ("EDR_DEMO_T1105",)),
    ("sysmon.event_data", ("EDR_DEMO_T1105", "http://127.0.0.1")),
)
REALTIME_PROCESS_STEP_MARKERS = (
    "EDR_DEMO_T1105", "http://127.0.0.1", "localhost", "curl", "Invoke-WebRequest", "iwr",
)
REALTIME_FILE_STEP_MARKERS = ("EDR_DEMO_T1105", "edr_demo_t1105", "edr_demo")
REALTIME_CONTEXT_MARKERS = ("EDR_DEMO_T1105", "edr_demo_t1105", "edr_demo")
REALTIME_WINDOW_SECONDS = 300
REALTIME_EVENT_LIMIT = 500
REALTIME_ALERT_LIMIT = 200
SHOWN_EVENT_LIMIT = 80
# Label markers that fire a rule directly: (rule key, markers).
LABEL_MARKER_RULES = (
    ("t1059", ("edr_demo_tp_1", "edr_demo_tp_5", "edr_demo_fp_1", "edr_demo_fp_5")),
    ("t1105", ("edr_demo_tp_2", "edr_demo_tp_6", "edr_demo_fp_2", "edr_demo_fp_6")),
    ("t1547", ("edr_demo_tp_3", "edr_demo_tp_7", "edr_demo_fp_3")),
    ("t1218", ("edr_demo_tp_4", "edr_demo_tp_8", "edr_demo_fp_4")),
)
LABEL_MARKER_REASON = "Demo target rule triggered by marker."

# --- Fixed values: anomaly scoring -----------------------------------------------------------
ENCODED_FLAGS = ("-enc", "-encodedcommand", "/enc", "/encodedcommand")
NETWORK_KEYWORDS = (
    "curl", "wget", "nc", "netcat", "invoke-webrequest", "iwr", "invoke-restmethod", "irm",
    "downloadstring", "webclient",
)
WHOLE_WORD_KEYWORDS = ("nc", "iwr", "irm")
ANOMALY_WEIGHTS = {
    "uncommon_process": 0.18,
    "unusual_parent_child": 0.20,
    "long_command_line": 0.12,
    "too_many_args": 0.10,
    "encoded_command": 0.25,
    "suspicious_keyword": 0.20,
    "unusual_executable_path": 0.12,
    "outside_normal_hours": 0.08,
}
ANOMALY_THRESHOLD = 0.7
NORMAL_ROOTS = ("c:\\windows\\", "c:\\program files\\", "c:\\program files (x86)\\")
ANOMALY_RULE = {
    "id": "ml.process_anomaly",
    "name": "ML-style Process Anomaly",
    "version": 1,
    "description": "Deterministic heuristic anomaly detection for process creation events.",
    "severity": "medium",
    "confidence": "medium",
}

# --- Fixed values: policy --------------------------------------------------------------------
APPROVED_RULE_IDS = (
    "det.t1059_001.powershell_process_start",
    "sigma_like.t1059_001.powershell_process_start",
    "ml.process_anomaly",
)
POLICY_MARKERS = ("EDR_DEMO_T1059_001", "EDR_SAFE_MANUAL_T1059_001", "phase_8_demo", "phase_9_demo")
PROTECTED_PROCESSES = (
    "system", "registry", "smss.exe", "csrss.exe", "wininit.exe", "services.exe", "lsass.exe",
    "svchost.exe", "winlogon.exe", "explorer.exe",
)

# --- Fixed values: reporting -----------------------------------------------------------------
SEVERITIES = ("low", "medium", "high", "critical", "unknown")
SEVERITY_RANK = {"unknown": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCES = ("low", "medium", "high")
RULE_SEVERITIES = ("low", "medium", "high", "critical")
TECHNIQUE_ORDER = ("T1059.001", "T1105", "T1547.001", "T1218")
ENGINE_ORDER = ("native", "sigma-like", "behavioral", "ml-anomaly")
DASHBOARD_ENGINES = ("native", "sigma-like", "ml-anomaly", "behavioral", "realtime-native")
TACTIC_ORDER = ("Execution", "Command and Control", "Persistence", "Defense Evasion")
TACTIC_SLUGS = {
    "Command and Control": "command-and-control",
    "Defense Evasion": "defense-evasion",
    "Execution": "execution",
    "Persistence": "persistence",
}
ENGINE_LABELS = {
    "native": "native",
    "sigma-like": "Sigma-like",
    "behavioral": "behavioral",
    "ml-anomaly": "ML anomaly",
}
SCORE_COLORS = {1: "#d8e2ef", 2: "#9ecae1", 3: "#6baed6", 4: "#3182bd", 5: "#08519c"}
SEQUENCE_TECHNIQUES = {
    "t1105_download_sequence": "T1105",
    "t1547_001_registry_persistence_sequence": "T1547.001",
    "t1218_lolbin_sequence": "T1218",
}
TECHNIQUE_NAMES = {
    "T1059.001": "PowerShell",
    "T1105": "Ingress Tool Transfer",
    "T1547.001": "Registry Run Keys / Startup Folder",
    "T1218": "System Binary Proxy Execution",
}
CASE_CATEGORIES = ("attack", "benign", "limitation")
CASE_INPUT_TYPES = ("fixture", "xml", "json")
CASE_ENGINES = ("native", "sigma-like", "all", "ml-anomaly", "behavioral")
CASE_PROTECTIONS = ("none", "dry-run", "execute-lab-only")
CASE_RUNNER_MODES = ("phase8", "live", "ml", "behavioral")


@dataclass(frozen=True)
class Condition:
    """One field test of a declarative rule: operator ``equals``, ``endswith`` or ``contains``."""

    field: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """A single-event rule.

    Declarative rules carry a gate (dataset and codes) and conditions; programmatic ones carry
    ``matcher``, a function from the prepared event columns to an array of matched field names.
    """

    rule_id: str
    engine: str
    name: str
    version: int
    description: str
    severity: str
    confidence: str
    technique_id: str
    technique_name: str
    tactic: tuple[str, ...]
    dataset: str | None = DATASET
    event_codes: tuple[int, ...] = ()
    conditions: tuple[Condition, ...] = ()
    matcher: Callable[..., Column] | None = None
    reason: str = ""


@dataclass(frozen=True)
class SequenceDefinition:
    rule_id: str
    sequence_name: str
    technique_id: str
    technique_name: str
    tactic: tuple[str, ...]
    severity: str
    confidence: str
    required_steps: tuple[str, ...]
    optional_steps: tuple[str, ...] = ()
    window_seconds: int = 300
    steps: dict[str, Callable[..., Column]] = field(default_factory=dict, hash=False, compare=False)
    event_codes: str = ""

    @property
    def name(self) -> str:
        return f"{self.technique_id} behavioral {self.sequence_name.replace('_', ' ')}"

    @property
    def description(self) -> str:
        return (
            f"Correlates {', '.join(self.required_steps)} evidence for a deterministic "
            f"{self.technique_id} demo sequence."
        )

    def with_window(self, seconds: int | None) -> "SequenceDefinition":
        return self if seconds is None else replace(self, window_seconds=seconds)


@dataclass(frozen=True)
class Baseline:
    """Process baseline profile; names, pairs and keywords are lower-cased on construction."""

    common_process_names: tuple[str, ...]
    allowed_parent_child_pairs: tuple[tuple[str, str], ...]
    max_command_line_length: float
    max_args_count: float
    suspicious_keywords: tuple[str, ...]
    normal_hours: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        lower = lambda values: tuple(v.lower() for v in values)
        object.__setattr__(self, "common_process_names", lower(self.common_process_names))
        object.__setattr__(self, "suspicious_keywords", lower(self.suspicious_keywords))
        object.__setattr__(
            self, "allowed_parent_child_pairs", tuple(lower(p) for p in self.allowed_parent_child_pairs)
        )


# The default profile.
DEFAULT_BASELINE = Baseline(
    common_process_names=("cmd.exe", "powershell.exe", "explorer.exe", "conhost.exe", "svchost.exe"),
    allowed_parent_child_pairs=(
        ("powershell.exe", "cmd.exe"),
        ("explorer.exe", "cmd.exe"),
        ("explorer.exe", "powershell.exe"),
        ("cmd.exe", "conhost.exe"),
    ),
    max_command_line_length=120,
    max_args_count=8,
    suspicious_keywords=(
        "encodedcommand", "invoke-webrequest", "downloadstring", "webclient", "netcat", "nc", "wget", "curl",
    ),
    normal_hours=tuple(range(24)),
)


@dataclass(frozen=True)
class Action:
    id: str
    type: str
    description: str
    status: str = "planned"


@dataclass(frozen=True)
class Playbook:
    id: str
    name: str
    description: str
    rule_ids: tuple[str, ...]
    technique_ids: tuple[str, ...]
    actions: tuple[Action, ...]
    status: str = "dry-run"


# The default playbooks.
DEFAULT_PLAYBOOKS = (
    Playbook(
        id="soar.playbook.powershell_execution",
        name="PowerShell Execution Response",
        description="Plan safe dry-run response actions for PowerShell execution alerts.",
        rule_ids=("det.t1059_001.powershell_process_start", "sigma_like.t1059_001.powershell_process_start"),
        technique_ids=("T1059.001",),
        actions=(
            Action("notify_analyst", "notification", "Notify analyst about PowerShell execution alert."),
            Action(
                "collect_process_context",
                "collection",
                "Collect process, parent process, host, and user context from alert document.",
            ),
            Action(
                "recommend_host_review",
                "recommendation",
                "Recommend host review; no containment action is executed.",
            ),
        ),
    ),
)


@dataclass(frozen=True)
class EvaluationCase:
    """A labelled realtime marker and the outcome expected of it."""

    case_id: str
    marker: str
    technique_id: str
    expected_alert: bool
    window_seconds: int
    expected_rule_ids: tuple[str, ...] = ()


# The labelled realtime cases.
EVALUATION_CASES = (
    EvaluationCase("rt_tp_1", "EDR_DEMO_TP_1", "T1059.001", True, 8),
    EvaluationCase("rt_tp_2", "EDR_DEMO_TP_2", "T1105", True, 8),
    EvaluationCase("rt_tp_3", "EDR_DEMO_TP_3", "T1547.001", True, 8),
    EvaluationCase("rt_tp_4", "EDR_DEMO_TP_4", "T1218", True, 8),
    EvaluationCase("rt_tp_5", "EDR_DEMO_TP_5", "T1059.001", True, 8),
    EvaluationCase("rt_tp_6", "EDR_DEMO_TP_6", "T1105", True, 8),
    EvaluationCase("rt_tp_7", "EDR_DEMO_TP_7", "T1547.001", True, 8),
    EvaluationCase("rt_tp_8", "EDR_DEMO_TP_8", "T1218", True, 8),
    EvaluationCase("rt_tn_1", "EDR_DEMO_TN_1", "benign", False, 6),
    EvaluationCase("rt_tn_2", "EDR_DEMO_TN_2", "benign", False, 6),
    EvaluationCase("rt_tn_3", "EDR_DEMO_TN_3", "benign", False, 6),
    EvaluationCase("rt_tn_4", "EDR_DEMO_TN_4", "benign", False, 6),
    EvaluationCase("rt_tn_5", "EDR_DEMO_TN_5", "benign", False, 6),
    EvaluationCase("rt_tn_6", "EDR_DEMO_TN_6", "benign", False, 6),
    EvaluationCase("rt_tn_7", "EDR_DEMO_TN_7", "benign", False, 6),
    EvaluationCase("rt_tn_8", "EDR_DEMO_TN_8", "benign", False, 6),
    EvaluationCase("rt_fp_1", "EDR_DEMO_FP_1", "T1059.001", False, 6),
    EvaluationCase("rt_fp_2", "EDR_DEMO_FP_2", "T1105", False, 6),
    EvaluationCase("rt_fp_3", "EDR_DEMO_FP_3", "T1547.001", False, 6),
    EvaluationCase("rt_fp_4", "EDR_DEMO_FP_4", "T1218", False, 6),
    EvaluationCase("rt_fp_5", "EDR_DEMO_FP_5", "T1059.001", False, 6),
    EvaluationCase("rt_fp_6", "EDR_DEMO_FP_6", "T1105", False, 6),
    EvaluationCase("rt_fn_1", "EDR_DEMO_FN_1", "T1059", True, 6),
    EvaluationCase("rt_fn_2", "EDR_DEMO_FN_2", "T1105", True, 6),
    EvaluationCase("rt_fn_3", "EDR_DEMO_FN_3", "T1547.001", True, 6),
    EvaluationCase("rt_fn_4", "EDR_DEMO_FN_4", "T1218", True, 6),
    EvaluationCase("rt_fn_5", "EDR_DEMO_FN_5", "T1059", True, 6),
    EvaluationCase("rt_fn_6", "EDR_DEMO_FN_6", "T1105", True, 6),
)

CASE_SCHEMA = T.StructType(
    [
        T.StructField("case_ord", T.IntegerType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("marker", T.StringType()),
        T.StructField("technique_id", T.StringType()),
        T.StructField("expected_alert", T.BooleanType()),
        T.StructField("window_seconds", T.IntegerType()),
        T.StructField("expected_rule_ids", T.ArrayType(T.StringType())),
    ]
)


def evaluation_cases_df(spark: SparkSession, cases: Sequence[EvaluationCase] = EVALUATION_CASES) -> DataFrame:
    rows = [
        (n, c.case_id, c.marker, c.technique_id, c.expected_alert, c.window_seconds, list(c.expected_rule_ids))
        for n, c in enumerate(cases)
    ]
    return spark.createDataFrame(rows, CASE_SCHEMA)


# Covered techniques (technique, tactic, event codes, engines).
COVERED_TECHNIQUES = (
    ("T1059.001", "Execution", "1", ("native", "sigma-like")),
    ("T1105", "Command and Control", "1/3/11", ("native", "sigma-like", "behavioral")),
    ("T1547.001", "Persistence", "1/13", ("native", "sigma-like", "behavioral")),
    ("T1218", "Defense Evasion", "1", ("native", "sigma-like", "behavioral")),
)
