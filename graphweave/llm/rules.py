"""Quality rules as a bitmask ledger, in Spark expressions only.

Every rule is evaluated once per document; its outcome is one bit of `failed_bits`, its inputs are
kept as measurements. A policy is a named, versioned mask over those bits, so that judging again
under another policy, or asking what a rule removes by itself, needs no text.

Defined results: a null or empty text has no words and measures zero everywhere, and fails
`few_words`; texts of any length are measured whole; repeated rows are judged each by itself; an
empty table gives an empty ledger; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import SPACE, fenced, table, texts

#: Rules in bit order: name, and the condition over the measurements under which a document fails.
#: Ratios are compared in whole numbers. New rules go to the end, so that stored bits keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("capitals", "100 * n_capitals > 30 * word_chars"),
    ("exclamations", "100 * n_exclamations > 20 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("stutter", "100 * n_stutters > 20 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("digits", "100 * n_digits > 50 * word_chars"),
)
BASE = ("few_words", "repeated_windows")
#: Policy versions: the rules under which a document is rejected.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": tuple(name for name, _ in RULES),
}
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations", "n_stutters", "n_digits")


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Hash of each 5-word window of the array `words`.
_WINDOWS = "CASE WHEN size(words) < 5 THEN array() ELSE transform(sequence(1, size(words) - 4), i -> xxhash64(slice(words, i, 5))) END"
#: Sorted starts of the windows whose hash another window has, from the array `windows`: sorting by hash brings equal ones together.
_REPEATED = _let(
    "sort_array(transform(windows, (h, i) -> struct(h, i)))",
    "s",
    "sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].h = x.h) OR (i < size(s) - 1 AND s[i + 1].h = x.h)), x -> x.i))",
)
#: Words in those windows: each start adds what the next does not cover again.
_COVERED = _let(_REPEATED, "p", "aggregate(p, 0L, (sum, x) -> sum + 0L) + aggregate(transform(p, (x, i) -> CASE WHEN i < size(p) - 1 THEN least(5, p[i + 1] - x) ELSE 5 END), 0L, (sum, x) -> sum + x)")


def _left(pattern: str) -> Column:
    """Number of characters of the text outside the pattern's runs."""
    return F.length(F.regexp_replace("text", pattern, "")).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def measured(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, the measurements and the columns to carry of each document."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = texts(docs, carry)
    d = fenced(d, *d.columns, _words(F.col("text")).alias("words"), _words(F.lower("text")).alias("lowered"), lines.alias("lines"))
    d = fenced(d, *d.columns, F.expr(_WINDOWS).alias("windows"))
    repeat = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(F.expr(_COVERED))
    stutters = F.expr("size(filter(lowered, (w, i) -> i > 0 AND lowered[i - 1] = w))")
    return fenced(
        d,
        "doc_id",
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _left("[^A-Z]+").alias("n_capitals"),
        _left("[^!]+").alias("n_exclamations"),
        stutters.cast("long").alias("n_stutters"),
        _left("[^0-9]+").alias("n_digits"),
    )


def ledger(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, the measurements and `failed_bits`, bit i set if rule i fails; and the columns to carry."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, carry).select("doc_id", *carry, *MEASUREMENTS, total.alias("failed_bits"))


def judged(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with `base_failed` and the policy's verdict `kept`."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0))


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents it fails, documents that only it fails, and documents kept without it.

    One aggregation over the stored bits; rule and policy are literals, so nothing is exploded.
    """
    names = [name for name, _ in RULES]
    bits, every = F.col("failed_bits"), mask(policy)
    sums = []
    for name in POLICIES[policy]:
        bit = 1 << names.index(name)
        sums += [
            F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_fails"),
            F.count_if(bits.bitwiseAND(F.lit(every)) == bit).alias(f"{name}_alone"),
            F.count_if(bits.bitwiseAND(F.lit(every & ~bit)) == 0).alias(f"{name}_without"),
        ]
    wide = book.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_or("failed_bits"), F.lit(0)).alias("any_bits"), *sums)
    rows = [F.struct(F.lit(x).alias("rule"), *(F.col(f"{x}_{k}").alias(k) for k in ("fails", "alone", "without"))) for x in POLICIES[policy]]
    return wide.select("n", "any_bits", F.explode(F.array(*rows)).alias("r")).select("r.*", "n", "any_bits")


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with all their columns as they were.

    The row travels through the ledger as one struct, so that no join is needed and clashing names cannot meet.
    """
    book = ledger(docs.select("doc_id", "text", F.struct("*").alias("_row")), ["_row"])
    return judged(book, policy).filter("kept").select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1."""
    return judged(ledger(table(spark, sf_dir, "documents")))


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines
  FROM documents),
t AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
o AS (
  SELECT doc_id, i, w, lag(w) OVER p AS before,
         w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS win
  FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM o WHERE win IS NOT NULL) WHERE c > 1),
covered AS (
  SELECT doc_id, sum(CASE WHEN nxt IS NULL THEN 5 ELSE least(5, nxt - i) END)::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
stutter AS (SELECT doc_id, count(*) AS n FROM o WHERE lower(before) = lower(w) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
         length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
         coalesce(stutter.n, 0)::BIGINT AS n_stutters,
         length(regexp_replace(text, '[^0-9]+', '', 'g'))::BIGINT AS n_digits
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN stutter USING (doc_id)),
b AS (SELECT *, ({' + '.join(f'CASE WHEN {c} THEN {1 << i} ELSE 0 END' for i, (_, c) in enumerate(RULES))})::BIGINT AS failed_bits FROM m)
SELECT *, (failed_bits & {mask('base')}) <> 0 AS base_failed, (failed_bits & {mask('base') | mask('v1')}) = 0 AS kept FROM b
"""
