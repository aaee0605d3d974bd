"""Quality rules by distribution divergence, in DataFrame functions only.

Per document: counts for the base rule, a histogram of character classes, and a histogram of common words. Each language's
reference is the sum of the histograms of its documents that pass the base rule and are long enough; languages outside ``LANGUAGES`` (null
too) share the reference of all. A document is rejected if the base rule fails it, or if the Jensen-Shannon distance
(base 2, 0 to 1) between its histogram and the reference exceeds a threshold. A histogram of fewer than ``MIN_CHARS`` characters
or ``MIN_WORDS`` words is too thin to judge and never rejects, nor does a missing reference.

Null texts count as empty: no words, so the base rule fails them. Repeated rows get repeated verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.scalars import where_computed
from huntframe.llm.storage import written

LANGUAGES = ("en", "fr", "de", "es")
# Frequent short function words of the four languages, one list for all.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "was", "that", "with", "at", "for", "are", "is", "on", "by", "as", "de", "la", "le", "et", "les",
    "des", "en", "un", "une", "du", "que", "qui", "pour", "dans", "der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "ist",
    "el", "los", "las", "del", "por", "con", "para", "se", "no",
)
MIN_CHARS = 400
MIN_WORDS = 120
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.28
MIN_BASE_WORDS = 50

SPACE = r"[\x20\x09-\x0D]+"
#: Character classes in the order in which they are counted; what is left is ASCII punctuation of other kinds and controls.
CLASSES = (
    ("lower", "[a-z]+"), ("space", SPACE), ("upper", "[A-Z]+"), ("other_script", r"[^\x00-\x7F]+"), ("digit", "[0-9]+"),
    ("punctuation", r"""[.,;:!?'"()-]+"""),
)
_CODES = "".join(chr(ord("A") + i) for i in range(len(COMMON_WORDS)))
_LONGEST = max(map(len, COMMON_WORDS))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def with_metrics(df: DataFrame, text: str = "text", lang: str = "lang", prefix: str = "") -> DataFrame:
    """Adds the counts, ``base_failed``, the histograms ``chars`` and ``common`` and the reference's ``key``, each name with the prefix."""
    p = prefix
    c = lambda name: F.col(f"`{p}{name}`")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.select("*", whole.alias(f"{p}text0"))
    for i, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"{p}text{i + 1}", _removed(c(f"text{i}"), pattern))
    lines = F.filter(F.split(c("text0"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(c("text0"), SPACE), "")
    tokens = F.split(F.lower(c("text0")), r"[\x00-\x60\x7B-\x7F]+")
    listed = F.lit(",".join(COMMON_WORDS))
    code = lambda w: F.when(
        F.length(w) <= _LONGEST, F.substring(F.lit("." + _CODES), F.find_in_set(w, listed) + 1, F.lit(1))
    ).otherwise(".")
    df = df.select(
        *[k for k in df.columns if k not in {f"{p}text{i}" for i in range(len(CLASSES) + 1)}],
        words.alias(f"{p}words"),
        lines.alias(f"{p}lines"),
        F.array(
            *[(F.length(c(f"text{i}")) - F.length(c(f"text{i + 1}"))).cast("long") for i in range(len(CLASSES))],
            F.length(c(f"text{len(CLASSES)}")).cast("long"),
        ).alias(f"{p}chars"),
        (F.length(c("text0")) - F.length(_removed(c("text0"), r"[#*$%&|<>]+"))).cast("long").alias(f"{p}n_symbols"),
        F.replace(F.array_join(F.transform(tokens, code), ""), F.lit("."), F.lit("")).alias(f"{p}hits"),
    )
    # equal windows have equal hashes, so only texts with an equal pair of hashes need the windows themselves
    after = lambda i: (F.get(c("words"), i + 1), F.get(c("words"), i + 2))
    df = df.withColumn(f"{p}hashes", F.sort_array(F.transform(c("words"), lambda w, i: F.xxhash64(w, *after(i)))))
    df = df.withColumn(f"{p}again", F.exists(F.transform(c("hashes"), lambda h, k: h == F.get(c("hashes"), k - 1)), lambda e: e))
    # windows sorted by content: one that equals a neighbour is found twice or more; the last two are short and equal none
    windows = F.sort_array(
        F.transform(c("words"), lambda w, i: F.struct(F.concat_ws(" ", w, *after(i)).alias("w"), i.alias("i")))
    )
    df = df.withColumn(f"{p}windows", F.when(c("again"), windows).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    twice = F.transform(
        F.filter(c("windows"), lambda x, k: (x.w == F.get(c("windows"), k - 1).w) | (x.w == F.get(c("windows"), k + 1).w)), lambda x: x.i
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2))))
    hits = c("hits")
    counted = [(F.length(hits) - F.length(F.replace(hits, F.lit(code), F.lit("")))).cast("long") for code in _CODES]
    df = df.select(
        *[k for k in df.columns if k not in {f"{p}{k}" for k in ("windows", "hits", "lines", "words", "hashes", "again")}],
        _size(c("words")).alias(f"{p}n_words"),
        (F.aggregate(c("chars"), F.lit(0).cast("long"), lambda a, x: a + x) - c("chars")[1]).alias(f"{p}word_chars"),
        (_size(c("lines")) - _size(F.array_distinct(c("lines")))).alias(f"{p}n_dup_lines"),
        _size(covered).alias(f"{p}n_repeat_words"),
        F.array(*counted).alias(f"{p}known"),
    )
    known = F.aggregate(c("known"), F.lit(0).cast("long"), lambda a, x: a + x)
    language = F.col(f"`{lang}`") if lang in df.columns else F.lit(None).cast("string")
    return df.select(
        *[k for k in df.columns if k != f"{p}known"],
        F.concat(c("known"), F.array(F.greatest(c("n_words") - known, F.lit(0).cast("long")))).alias(f"{p}common"),
        ((c("n_words") < MIN_BASE_WORDS) | (100 * c("n_repeat_words") > 50 * c("n_words"))).alias(f"{p}base_failed"),
        F.when(language.isin(*LANGUAGES), language).otherwise("*").alias(f"{p}key"),
    )


def references(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """``ref_key, ref_chars, ref_common``: one row per language and one, ``*``, of all; at most one more than ``LANGUAGES``.

    Sums are combined in each task first, so that a few rows per task are shuffled. The condition stands inside the sums, as
    a filter would be pushed below the metrics with all their expressions copied.
    """
    p = prefix
    long_enough = ~F.col(f"`{p}base_failed`") & (F.col(f"`{p}n_words`") >= MIN_WORDS)
    sums = lambda name, n: F.array(*[F.sum(F.when(long_enough, F.col(f"`{p}{name}`")[i])) for i in range(n)]).alias(f"ref_{name}")
    totals = (
        metrics.rollup(F.col(f"`{p}key`").alias("ref_key"))
        .agg(sums("chars", len(CLASSES) + 1), sums("common", len(COMMON_WORDS) + 1))
    )
    own = F.col("ref_key").isNull() | F.col("ref_key").isin(*LANGUAGES)
    return totals.filter(own).withColumn("ref_key", F.coalesce("ref_key", F.lit("*")))


def distance(mine: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms, null if one of them is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    pairs = F.zip_with(mine, reference, lambda x, y: F.struct((x / total(mine)).alias("x"), (y / total(reference)).alias("y")))
    divergence = F.aggregate(
        pairs, F.lit(0.0), lambda a, v: a + (part(v.x, (v.x + v.y) / 2) + part(v.y, (v.x + v.y) / 2)) / 2
    )
    return F.when((total(mine) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def with_verdict(metrics: DataFrame, refs: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ``kept`` and ``reason``. The references are broadcast: five rows at most."""
    p = prefix
    c = lambda name: F.col(f"`{p}{name}`")
    n_chars = F.aggregate(c("chars"), F.lit(0).cast("long"), lambda a, x: a + x)
    renamed = refs.select(*[F.col(k).alias(f"{p}{k}") for k in refs.columns])
    joined = metrics.join(F.broadcast(renamed), c("key") == c("ref_key"), "left")
    joined = joined.select(
        *[k for k in joined.columns if k not in renamed.columns],
        F.when(n_chars >= MIN_CHARS, distance(c("chars"), c("ref_chars"))).alias(f"{p}char_distance"),
        F.when(c("n_words") >= MIN_WORDS, distance(c("common"), c("ref_common"))).alias(f"{p}word_distance"),
    )
    reason = (
        F.when(c("base_failed"), "base")
        .when(c("char_distance") > MAX_CHAR_DISTANCE, "characters")
        .when(c("word_distance") > MAX_WORD_DISTANCE, "words")
    )
    return joined.withColumn(f"{p}reason", reason).withColumn(f"{p}kept", c("reason").isNull())


def good_documents(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows the rules keep, with their own columns. Texts are read twice: for the references, then for the verdicts."""
    p = "_q_"
    while any(k.lower().startswith(p) for k in df.columns):
        p += "_"
    metrics = with_metrics(df, text, lang, p)
    judged = with_verdict(metrics, written(references(metrics, p), "references"), p)
    return where_computed(judged, F.col(f"`{p}kept`")).select(*df.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    metrics = written(with_metrics(docs).drop("text"), "quality")  # counts and two short histograms a row
    return with_verdict(metrics, references(metrics)).select("doc_id", *COUNTS, "base_failed", "kept", "reason")


def _sql() -> str:
    classes = "".join(f", length(regexp_replace(text, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')) AS k{i}" for i, (_, pattern) in enumerate(
        [("", ("(" + "|".join(q for _, q in CLASSES[: n + 1]) + ")")) for n in range(len(CLASSES))]))
    chars = "[" + ", ".join(f"{'length(text)' if i == 0 else f'k{i - 1}'} - k{i}" for i in range(len(CLASSES))) + f", k{len(CLASSES) - 1}]"
    common = "[" + ", ".join(f"len(list_filter(tokens, lambda w: w = '{w}'))" for w in COMMON_WORDS) + "]"
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"
    jsd = lambda x, y: (
        f"sqrt(greatest(list_sum(list_transform(list_zip({x}, {y}), lambda v: (CASE WHEN v[1] > 0 THEN v[1] / list_sum({x}) * log2(v[1] / list_sum({x}) / "
        f"((v[1] / list_sum({x}) + v[2] / list_sum({y})) / 2)) ELSE 0 END + CASE WHEN v[2] > 0 THEN v[2] / list_sum({y}) * log2(v[2] / list_sum({y}) / "
        f"((v[1] / list_sum({x}) + v[2] / list_sum({y})) / 2)) ELSE 0 END) / 2)), 0))"
    )
    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN lang IN {LANGUAGES} THEN lang ELSE '*' END AS key, coalesce(text, '') AS text, row_number() OVER () AS r
  FROM documents
), a AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    string_split_regex(lower(text), '[\x00-\x60\x7B-\x7F]+') AS tokens{classes}
  FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM a)
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) t(o) WHERE n > 1 GROUP BY r
), m AS (
  SELECT a.r, doc_id, key, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, {chars} AS chars, {common} AS known, length(text) AS n_chars
  FROM a LEFT JOIN rep USING (r)
), v AS (
  SELECT *, list_append(known, greatest(n_words - list_sum(known), 0)) AS common,
    n_words < {MIN_BASE_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
), refs AS (
  SELECT coalesce(key, '*') AS key, chars, common FROM (
    SELECT key, {sums("chars", len(CLASSES) + 1)} AS chars, {sums("common", len(COMMON_WORDS) + 1)} AS common
    FROM v WHERE NOT base_failed AND n_words >= {MIN_WORDS} GROUP BY ROLLUP (key)
  ) WHERE key IS NULL OR key <> '*'
), s AS (
  SELECT v.*, CASE WHEN n_chars >= {MIN_CHARS} THEN {jsd("v.chars", "refs.chars")} END AS dc,
    CASE WHEN n_words >= {MIN_WORDS} THEN {jsd("v.common", "refs.common")} END AS dw
  FROM v LEFT JOIN refs ON v.key = refs.key
), f AS (
  SELECT *, CASE WHEN base_failed THEN 'base' WHEN dc > {MAX_CHAR_DISTANCE} THEN 'characters' WHEN dw > {MAX_WORD_DISTANCE} THEN 'words' END AS reason
  FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM f
"""


SQL = _sql()
