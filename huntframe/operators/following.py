"""As-of lookup of the next candidates after a position, without forming pairs.

Probes and candidates of one key are laid out in one sorted run, and a running window carries
the nearest candidate to each probe. The cost is one sort of both sides, however many
probes and candidates share a key: a hot key never yields pairs. Keys are further cut by time,
so a key that holds much of the data still spreads over many tasks.

Row layout of both inputs: the ``by`` columns, ``t`` (microseconds), ``o`` (unique tie-breaker),
and either ``probe`` or ``cand`` as one struct column. "Following" is strict in ``(t, o)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A window is cut into so many slices when one key may hold most of its rows.
SLICES = 256
#: Bits of the map that says which groups are probed: 4 MB, whatever the size of the input.
PROBED_BITS = 1 << 25

# Rows without a time share t = 0; their runs are cut by the tie-breaker instead.
_UNTIMED_RUN = 1 << 20


def maybe_among(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int = PROBED_BITS) -> DataFrame:
    """The rows whose ``keys`` are among those of ``wanted``, and a few others, before anything is shuffled.

    A bitmap of fixed size over the hashes of the wanted keys goes to all tasks. Nulls equal nulls. No wanted row is lost: equal keys
    have equal hashes, so the map only decides how many others stay.
    """
    # One type on both sides, as equal numbers of two types have two hashes.
    place = F.pmod(F.xxhash64(*[F.col(k).cast(wanted.schema[k].dataType) for k in keys]), F.lit(bits))
    part, at = F.bitmap_bucket_number("_place"), F.bitmap_bit_position("_place")
    maps = wanted.select(place.alias("_place")).groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    marked = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    placed = rows.withColumn("_place", place).withColumn("_part", part)
    return placed.join(F.broadcast(maps), "_part").where(marked).drop("_part", "_place", "_map")


def nearest(probes: DataFrame, candidates: DataFrame, by: Sequence[str], depth: int = 1) -> DataFrame:
    """Each probe with ``found``: up to ``depth`` next candidates of its group, nearest first."""
    probe_type = probes.schema["probe"].dataType
    cand_type = candidates.schema["cand"].dataType
    keep = [*by, "t", "o"]
    rows = probes.select(
        *keep, F.lit(0).alias("is_cand"), "probe", F.lit(None).cast(cand_type).alias("cand")
    ).unionByName(
        candidates.select(*keep, F.lit(1).alias("is_cand"), F.lit(None).cast(probe_type).alias("probe"), "cand")
    )
    # Walked from the latest row backwards; at one position probes come first and so do not
    # see a candidate that is the same event.
    before = (
        Window.partitionBy(*by)
        .orderBy(F.col("t").desc(), F.col("o").desc(), F.col("is_cand"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_n1", F.last("cand", ignorenulls=True).over(before))
    for k in range(2, depth + 1):
        # A candidate's own (k-1)-th successor is its reader's k-th.
        own = F.when(F.col("is_cand") == 1, F.col(f"_n{k - 1}"))
        rows = rows.withColumn(f"_n{k}", F.last(own, ignorenulls=True).over(before))
    found = F.array_compact(F.array(*[F.col(f"_n{k}") for k in range(1, depth + 1)]))
    return rows.where("is_cand = 0").select(*keep, "probe", found.alias("found"))


def nearest_within(
    probes: DataFrame,
    candidates: DataFrame,
    by: Sequence[str],
    start: Column,
    width: Column,
    depth: int = 1,
) -> DataFrame:
    """``nearest`` for probes that only accept candidates in ``[start, start + width]``.

    Groups are cut into time buckets of the window's width. A window reaches at most into the
    next bucket, so each candidate is laid into its own and the bucket before it, and only where there may be a probe.
    ``start`` is evaluated on probes, ``width`` (microseconds, a function of ``by``) on both.
    The caller still checks the window itself on what was found.
    """
    p = probes.withColumn("_bucket", F.floor(start / width))
    own = F.floor(F.col("t") / width)
    c = candidates.withColumn("_bucket", F.explode(F.array(own, own - 1)))
    cut = [*by, "_bucket"]
    return nearest(p, maybe_among(c, p, cut), cut, depth).drop("_bucket")


def nearest_anywhere(
    probes: DataFrame, candidates: DataFrame, by: Sequence[str], width: Column, depth: int = 1
) -> DataFrame:
    """``nearest`` without a time limit, for groups of any size.

    Two levels: runs of bounded time inside a group are searched on their own, then each run
    looks ahead over the first ``depth`` candidates of every later run. The second level holds
    at most ``depth`` rows per run, not the group's rows.
    """
    run = lambda df: df.withColumns(
        {
            "_run": F.floor(F.col("t") / width),
            "_sub": F.when(F.col("t") == 0, F.floor(F.col("o") / _UNTIMED_RUN)).otherwise(F.lit(0)),
        }
    )
    # Only groups that are probed at all matter; usually few or none.
    p, c = run(probes), run(maybe_among(candidates, probes, by))
    cut = [*by, "_run", "_sub"]
    inside = nearest(p, c, cut, depth)

    in_run = Window.partitionBy(*cut).orderBy("t", "o")
    heads = (
        c.withColumn("_rank", F.row_number().over(in_run)).where(F.col("_rank") <= depth).drop("_rank")
    )
    # A run is a position after all of its own rows: its key as (t, o), compared as runs.
    as_rows = lambda df: df.withColumns({"t": F.col("_run"), "o": F.col("_sub")})
    run_probes = as_rows(p.select(*cut).distinct().withColumn("probe", F.struct("_run", "_sub")))
    ordered_heads = as_rows(heads.withColumn("cand", F.struct(F.col("t"), F.col("o"), F.col("cand"))))
    ahead = _nearest_runs(run_probes, ordered_heads, by, depth)
    joined = inside.join(ahead, cut, "left")
    both = F.concat("found", F.coalesce(F.col("ahead"), F.array().cast(inside.schema["found"].dataType)))
    return joined.select(*by, "t", "o", "probe", F.slice(both, 1, depth).alias("found"))


def _nearest_runs(run_probes: DataFrame, heads: DataFrame, by: Sequence[str], depth: int) -> DataFrame:
    """Per run the first ``depth`` candidates of the later runs of its group."""
    cand_type = heads.schema["cand"].dataType
    rows = run_probes.select(
        *by, "t", "o", F.lit(0).alias("is_cand"), "probe", F.lit(None).cast(cand_type).alias("cand")
    ).unionByName(
        heads.select(
            *by, "t", "o", F.lit(1).alias("is_cand"),
            F.lit(None).cast(run_probes.schema["probe"].dataType).alias("probe"), "cand",
        )
    )
    before = (
        Window.partitionBy(*by)
        .orderBy(
            F.col("t").desc(), F.col("o").desc(), F.col("is_cand"), F.col("cand.t").desc(), F.col("cand.o").desc()
        )
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_n1", F.last("cand.cand", ignorenulls=True).over(before))
    for k in range(2, depth + 1):
        own = F.when(F.col("is_cand") == 1, F.col(f"_n{k - 1}"))
        rows = rows.withColumn(f"_n{k}", F.last(own, ignorenulls=True).over(before))
    found = F.array_compact(F.array(*[F.col(f"_n{k}") for k in range(1, depth + 1)]))
    return rows.where("is_cand = 0").select(
        *by, F.col("probe._run").alias("_run"), F.col("probe._sub").alias("_sub"), found.alias("ahead")
    )


def nearest_by_label(
    probes: DataFrame, candidates: DataFrame, by: Sequence[str], labels: Sequence[str]
) -> DataFrame:
    """Each probe with the next candidate of every label, one struct column per label.

    Candidates carry ``label``. One sort serves all labels.
    """
    cand_type = candidates.schema["cand"].dataType
    probe_type = probes.schema["probe"].dataType
    keep = [*by, "t", "o"]
    rows = probes.select(
        *keep, F.lit(0).alias("is_cand"), "probe", F.lit(None).cast("string").alias("label"),
        F.lit(None).cast(cand_type).alias("cand"),
    ).unionByName(
        candidates.select(
            *keep, F.lit(1).alias("is_cand"), F.lit(None).cast(probe_type).alias("probe"), "label", "cand"
        )
    )
    before = (
        Window.partitionBy(*by)
        .orderBy(F.col("t").desc(), F.col("o").desc(), F.col("is_cand"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    next_of = {
        label: F.last(F.when(F.col("label") == label, F.col("cand")), ignorenulls=True).over(before)
        for label in labels
    }
    found = rows.select(*keep, "is_cand", "probe", *[c.alias(label) for label, c in next_of.items()])
    return found.where("is_cand = 0").drop("is_cand")


def next_by_label(
    probes: DataFrame, candidates: DataFrame, by: Sequence[str], labels: Sequence[str], width: int, slices: int = SLICES
) -> DataFrame:
    """``nearest_by_label`` for groups of any size, at least as far as ``width`` microseconds after each probe.

    Two levels: a short time slice of a group is searched on its own, and the first candidate of each label and slice (combined
    before the shuffle) stands for it in a lookup among slices. A task sorts the rows of a slice, or the heads of two windows, but never a group.
    The caller checks the window itself on what was found.
    """
    fine = max(width // slices, 1)
    reach = -(-width // fine) + 1
    cut = lambda df: df.withColumn("_slice", F.floor(F.col("t") / fine))
    keys = [*by, "_slice"]
    p, c = cut(probes), cut(candidates)
    inside = nearest_by_label(p, c, keys, labels)
    heads = c.groupBy(*keys, "label").agg(F.min(F.struct("t", "o", "cand")).alias("h")).select(*keys, "label", F.col("h.cand").alias("cand"))
    block = F.floor(F.col("_slice") / reach)
    places = p.select(*keys).distinct().select(
        *by, block.alias("_block"), F.col("_slice").alias("t"), F.lit(0).alias("o"), F.struct("_slice").alias("probe")
    )
    ahead_rows = heads.select(
        *by, F.explode(F.array(block, block - 1)).alias("_block"), F.col("_slice").alias("t"), F.lit(-1).alias("o"), "label", "cand"
    )
    ahead = nearest_by_label(places, ahead_rows, [*by, "_block"], labels).select(
        *by, F.col("probe._slice").alias("_slice"), *[F.col(x).alias(f"_ahead_{x}") for x in labels]
    )
    joined = inside.join(ahead, keys, "left")
    return joined.select(*by, "t", "o", "probe", *[F.coalesce(F.col(x), F.col(f"_ahead_{x}")).alias(x) for x in labels])
