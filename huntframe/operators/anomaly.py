"""Heuristic process-anomaly features and scores as one projection per event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..catalog import ANOMALY_THRESHOLD, DEFAULT_BASELINE, Baseline
from ..functions import scalars as S
from ..functions import timestamps as TS

BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("common_process_names", T.ArrayType(T.StringType())),
        T.StructField(
            "allowed_parent_child_pairs",
            T.ArrayType(
                T.StructType([T.StructField("parent", T.StringType()), T.StructField("child", T.StringType())])
            ),
        ),
        T.StructField("max_command_line_length", T.DoubleType()),
        T.StructField("max_args_count", T.DoubleType()),
        T.StructField("suspicious_keywords", T.ArrayType(T.StringType())),
        T.StructField("normal_hours", T.ArrayType(T.IntegerType())),
    ]
)


def input_error() -> Column:
    """Why an event cannot be scored; null if it can. Codes ``1`` and ``"1"`` both pass."""
    stamp = F.coalesce(S.non_empty(F.col("event.created")), S.non_empty(F.col("`@timestamp`")))
    return F.coalesce(
        F.when(F.col("event").isNull(), F.lit("missing_event")),
        F.when(~S.text(F.col("event.dataset")).eqNullSafe(catalog.DATASET), F.lit("wrong_dataset")),
        F.when(~F.coalesce(F.col("event.code") == 1, F.lit(False)), F.lit("wrong_event_code")),
        F.when(F.col("process").isNull(), F.lit("missing_process")),
        F.when(stamp.isNotNull() & TS.own_hour(stamp).isNull(), F.lit("bad_timestamp")),
    )


def with_features(events: DataFrame, on_reject: str = "drop") -> DataFrame:
    """Adds the ``features`` struct; rows that cannot be scored are dropped, or kept with a reason."""
    command = S.text(F.col("process.command_line"))
    low = F.lower(command)
    keywords = F.array_compact(
        F.array(
            *[
                F.when(S.contains_keyword(low, k, catalog.WHOLE_WORD_KEYWORDS), F.lit(k))
                for k in catalog.NETWORK_KEYWORDS
            ]
        )
    )
    stamp = F.coalesce(S.non_empty(F.col("event.created")), S.non_empty(F.col("`@timestamp`")))
    df = events.withColumn("feature_error", input_error())
    if on_reject == "drop":
        df = df.where(F.col("feature_error").isNull()).drop("feature_error")
    df = df.withColumn("_keywords", keywords)
    features = F.struct(
        S.text(F.col("process.name")).alias("process_name"),
        S.text(F.col("process.executable")).alias("process_executable"),
        S.text(F.col("process.parent.name")).alias("parent_process_name"),
        command.alias("process_command_line"),
        F.length(command).alias("command_line_length"),
        F.greatest(F.coalesce(F.size("process.args"), F.lit(0)), F.lit(0)).alias("args_count"),
        S.directory_depth(F.col("process.executable")).alias("executable_directory_depth"),
        S.has_flag(command, catalog.ENCODED_FLAGS).alias("has_encoded_command"),
        (F.size("_keywords") > 0).alias("has_network_tool_flag"),
        F.col("_keywords").alias("matched_network_keywords"),
        TS.own_hour(stamp).alias("hour_of_day"),
    )
    return df.withColumn("features", features).drop("_keywords")


def with_scores(
    featured: DataFrame, baseline: Baseline = DEFAULT_BASELINE, threshold: float = ANOMALY_THRESHOLD
) -> DataFrame:
    """Adds ``score``, ``threshold``, ``is_anomaly`` and ordered ``reasons``.

    The baseline is a driver-side profile, so its lists enter the plan as literals.
    """
    f = lambda name: F.col(f"features.{name}")
    w = catalog.ANOMALY_WEIGHTS
    name, parent = F.lower(f("process_name")), F.lower(f("parent_process_name"))
    command, executable = F.lower(f("process_command_line")), F.lower(f("process_executable"))
    pair = F.concat(parent, F.lit("\x1f"), name)
    allowed = [f"{p}\x1f{c}" for p, c in baseline.allowed_parent_child_pairs]
    keyword = F.coalesce(
        *[
            F.when(S.contains_keyword(command, k, catalog.WHOLE_WORD_KEYWORDS), F.lit(k))
            for k in baseline.suspicious_keywords
        ]
    )
    hours = baseline.normal_hours
    off_hours = (
        F.lit(False)
        if hours is None
        else F.coalesce(~f("hour_of_day").isin(*hours) if hours else f("hour_of_day").isNotNull(), F.lit(False))
    )
    checks: Sequence[tuple[str, Column, Column]] = (
        (
            "uncommon_process",
            (name != "") & ~name.isin(*baseline.common_process_names),
            F.concat(F.lit("process name is not common: "), name),
        ),
        (
            "unusual_parent_child",
            (name != "") & (parent != "") & ~pair.isin(*allowed),
            F.concat(F.lit("parent-child pair is unusual: "), parent, F.lit(" -> "), name),
        ),
        (
            "long_command_line",
            f("command_line_length") > F.lit(baseline.max_command_line_length),
            F.concat(
                F.lit("command line length "),
                f("command_line_length").cast("string"),
                F.lit(f" exceeds baseline {int(baseline.max_command_line_length)}"),
            ),
        ),
        (
            "too_many_args",
            f("args_count") > F.lit(baseline.max_args_count),
            F.concat(
                F.lit("args count "),
                f("args_count").cast("string"),
                F.lit(f" exceeds baseline {int(baseline.max_args_count)}"),
            ),
        ),
        ("encoded_command", f("has_encoded_command"), F.lit("encoded command flag present")),
        (
            "suspicious_keyword",
            F.col("_keyword").isNotNull(),
            F.concat(F.lit("suspicious keyword matched: "), F.col("_keyword")),
        ),
        (
            "unusual_executable_path",
            (executable != "") & ~S.any_of(F.startswith(executable, F.lit(r)) for r in catalog.NORMAL_ROOTS),
            F.concat(F.lit("executable path is unusual: "), f("process_executable")),
        ),
        (
            "outside_normal_hours",
            off_hours,
            F.concat(F.lit("hour "), f("hour_of_day").cast("string"), F.lit(" is outside baseline normal hours")),
        ),
    )
    total = sum((F.when(hit, F.lit(w[key])).otherwise(F.lit(0.0)) for key, hit, _ in checks), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(hit, reason) for _, hit, reason in checks]))
    return (
        featured.withColumn("_keyword", keyword)
        .withColumns(
            {
                "score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(total, 4))),
                "threshold": F.lit(float(threshold)),
                "reasons": reasons,
            }
        )
        .withColumn("is_anomaly", F.col("score") >= F.col("threshold"))
        .drop("_keyword")
    )


def score_events(
    events: DataFrame, baseline: Baseline = DEFAULT_BASELINE, threshold: float = ANOMALY_THRESHOLD
) -> DataFrame:
    return with_scores(with_features(events), baseline, threshold)


def baseline_violations(profile: DataFrame) -> DataFrame:
    """Quality checks over a profile table (``BASELINE_SCHEMA``): one row per violated check."""
    bad_strings = lambda n: (F.coalesce(F.size(n), F.lit(0)) <= 0) | F.exists(n, lambda x: S.text(x) == "")
    not_positive = lambda n: ~F.coalesce(F.col(n) > 0, F.lit(False))
    checks = F.array(
        F.when(bad_strings("common_process_names"), F.lit("common_process_names")),
        F.when(
            (F.coalesce(F.size("allowed_parent_child_pairs"), F.lit(0)) <= 0)
            | F.exists(
                "allowed_parent_child_pairs", lambda p: (S.text(p["parent"]) == "") | (S.text(p["child"]) == "")
            ),
            F.lit("allowed_parent_child_pairs"),
        ),
        F.when(not_positive("max_command_line_length"), F.lit("max_command_line_length")),
        F.when(not_positive("max_args_count"), F.lit("max_args_count")),
        F.when(bad_strings("suspicious_keywords"), F.lit("suspicious_keywords")),
        F.when(
            F.coalesce(
                F.exists("normal_hours", lambda h: h.isNull() | (h < 0) | (h > 23)), F.lit(False)
            ),
            F.lit("normal_hours"),
        ),
    )
    return profile.select(F.explode(F.array_compact(checks)).alias("violation"))


def load_baseline(spark: SparkSession, path: str) -> Baseline:
    """The one profile object of a JSON file, checked; raises ``ValueError`` with the bad fields."""
    profile = spark.read.schema(BASELINE_SCHEMA).json(path, multiLine=True)
    if len(profile.take(2)) > 1:
        raise ValueError(f"more than one baseline profile in {path}")
    bad = [r.violation for r in baseline_violations(profile).collect()]
    if bad:
        raise ValueError(f"bad baseline fields: {', '.join(bad)}")
    row = profile.first()
    if row is None:
        raise ValueError(f"no baseline profile in {path}")
    return Baseline(
        common_process_names=tuple(row.common_process_names),
        allowed_parent_child_pairs=tuple((p.parent, p.child) for p in row.allowed_parent_child_pairs),
        max_command_line_length=row.max_command_line_length,
        max_args_count=row.max_args_count,
        suspicious_keywords=tuple(row.suspicious_keywords),
        normal_hours=None if row.normal_hours is None else tuple(row.normal_hours),
    )
