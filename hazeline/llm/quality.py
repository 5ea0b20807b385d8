"""Quality rules: a table of thresholds compiled into one projection of text statistics.

The statistics and the verdict are built-in Spark functions alone; nothing is shuffled, so the work is
one scan whatever the sizes of sources, texts or groups of copies.

Defined cases: null text has no word (all counts 0, base_failed); empty text and text of separators
alone likewise; a word is a run of characters other than space and \\t \\n \\v \\f \\r. Every input row
gives one output row, repeated rows included; an empty table gives none. Other columns stay as they are, but
for those named like a result, which the result replaces; the pipeline stage returns all of them unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import SPACE, table, words

#: Frequent short words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a", "an", "and", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "of", "on", "or",
    "that", "the", "to", "was", "with",
    "au", "aux", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour",
    "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "und",
    "von", "zu",
    "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "una", "y",
)

#: A whole word without a letter.
NO_LETTER = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """least <= metric <= most; a missing bound is open."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Bounds as published for large web corpora; ratios are a word or a line.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("letters", "letter_word_ratio", 0.7, None),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.3),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row: as a variable it can't be copied into the lambdas of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words that lie in a window of 8 words found twice or more in _words.

    Windows are compared by 64-bit hash. Only rows that hold a repeated hash sort their windows; the
    words covered are then the sum of the distances between starts, 8 at most each.
    """
    n = F.size("_words")
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    coded = F.transform("_words", lambda w: F.xxhash64(w))
    windows = _let(coded, lambda c: F.transform(starts, lambda i: F.xxhash64(F.slice(c, i, WINDOW))))
    df = df.withColumn("_hashes", F.when(n >= WINDOW, windows))
    pairs = F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    df = df.withColumn(
        "_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(pairs))
    ).drop("_hashes")

    def start(x: Column, i: Column) -> Column:
        after, before = F.get("_sorted", i + 1)["h"], F.get("_sorted", i - 1)["h"]
        return F.when(x["h"].eqNullSafe(after) | x["h"].eqNullSafe(before), x["p"])

    df = df.withColumn("_starts", F.sort_array(F.filter(F.transform("_sorted", start), lambda p: p.isNotNull()))).drop("_sorted")
    later = F.slice("_starts", 2, F.size("_starts"))
    steps = F.zip_with("_starts", later, lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_starts") > 0, covered), F.lit(0)).cast("long")).drop("_starts")


#: What text_statistics adds.
STATISTICS = (
    "n_repeat_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_letter_words", "n_stop_words",
    "mean_word_chars", "symbol_ratio", "letter_word_ratio", "stop_word_ratio", "dup_line_ratio",
)


def _numbered(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df with its columns numbered, so that no name clashes with another, and their way back to their names."""
    plain = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)])
    return plain, [F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)]


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts and ratios that rules may name."""
    plain, back = _numbered(df)
    out = _statistics(plain, f"_c{df.columns.index(text)}")
    return out.select(*[c for c, name in zip(back, df.columns, strict=True) if name not in STATISTICS], *STATISTICS)


def _statistics(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = "#*$%&|<>"
    df = df.withColumn("_words", words(F.col(text)))
    df = _repeat_words(df)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = df.withColumn("_lines", lines)
    among = F.lit(f" {' '.join(STOP_WORDS)} ")
    bare = lambda w: F.lower(F.trim(w, F.lit(".,;:!?")))
    stop = lambda w: among.contains(F.concat(F.lit(" "), bare(w), F.lit(" ")))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, symbols, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_letter_words": (F.size("_words") - F.regexp_count(t, F.lit(NO_LETTER))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", stop)).cast("long"),
        }
    ).drop("_words", "_lines")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return df.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "letter_word_ratio": ratio("n_letter_words", "n_words"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        }
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """A boolean column for each rule, true where it holds."""
    out = {}
    for r in rules:
        tests = [F.col(r.metric) >= r.least] if r.least is not None else []
        tests += [F.col(r.metric) <= r.most] if r.most is not None else []
        passed = F.lit(True)
        for x in tests:
            passed = passed & x
        out[r.name] = passed
    return out


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the statistics, base_failed, failed_rules (names in the table's order) and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of 8.
    """
    plain, back = _numbered(df)
    kept = [c for c, name in zip(back, df.columns, strict=True) if name not in (*STATISTICS, *VERDICT)]
    return _ruled(plain, f"_c{df.columns.index(text)}", rules).select(*kept, *STATISTICS, *VERDICT)


VERDICT = ("base_failed", "failed_rules", "kept")


def _ruled(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    df = _statistics(df, text)
    tests = compiled(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests.items()]), lambda x: x.isNotNull())
    return df.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *COLUMNS)


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass.

    A filter on kept alone would be pushed below the projections, where it would hold a copy of every
    statistic for each of its uses; it isn't pushed below a column that isn't deterministic.
    """
    plain, back = _numbered(docs)
    ruled = _ruled(plain, f"_c{docs.columns.index('text')}", RULES).withColumn("_row", F.monotonically_increasing_id())
    return ruled.filter(F.col("kept") & (F.col("_row") >= 0)).select(*back)


_W = "[^\\x20\\x09-\\x0D]+"
SQL = {
    "op3_quality_rules": rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), w as (
  select rid, doc_id, t, regexp_extract_all(t, '{_W}') as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) as ls
  from d
), g as (
  select rid, i as p, list_slice(ws, i, i + 7) as k
  from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)
), r as (
  select rid, p from (select rid, p, count(*) over (partition by rid, k) as c from g) where c > 1
), c as (
  select rid, sum(least(8, coalesce(nxt - p, 8))) as n_repeat_words
  from (select rid, p, lead(p) over (partition by rid order by p) as nxt from r) group by rid
), s as (
  select w.doc_id, cast(len(ws) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(len(ls) as double) as n_lines,
    cast(coalesce(c.n_repeat_words, 0) as bigint) as n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as n_letter_words,
    len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(trim(x, '.,;:!?'))))) as n_stop_words
  from w left join c using (rid)
), b as (
  select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
    case when n_words = 0 then 0 else cast(n_words as double) end as nw from s
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and word_chars / nw between 2.0 and 12.0 and n_symbols / nw <= 0.1
   and n_letter_words / nw >= 0.7 and n_stop_words / nw >= 0.01
   and n_dup_lines / n_lines <= 0.3) as kept
from b
"""
}
