"""Quality rules as a bitmask ledger, with Spark expressions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. A policy is a
named, versioned set of rules, applied to the stored bits, so that changing a policy never reads the texts again.
Ablations (what each rule rejects alone) are one aggregation over the bits.

Nulls: a null text counts as empty (no words, no lines). A null doc_id is kept as it is. Repeated rows are judged each on
its own. An empty table gives an empty ledger and ablation counts of zero. Other columns of the input are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
ASCII_SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over the measurements, under which a document fails."""

    name: str
    fails: str


#: The order gives the bit, so rules are only ever appended.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", "n_lines > 3 AND 10 * n_dup_lines > 4 * n_lines"),
    Rule("few_letter_words", "100 * n_letter_words < 60 * n_words"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_trigrams"),
    "v1": ("too_few_words", "repeated_trigrams", "short_words", "long_words", "symbol_heavy", "repeated_lines", "few_letter_words"),
}


def repeated_words(w: Column) -> Column:
    """Words of array w that lie in a three-word window found twice or more in it.

    Windows are compared by 64-bit hashes. Most documents repeat none, which a hash set shows. Otherwise the hashes, with
    the position in place of their low bits, are sorted; neighbours that agree are looked at again with whole hashes.
    """
    n = F.size(w)

    def covered(positions: Column) -> Column:
        gaps = F.zip_with(positions, F.slice(positions, 2, F.size(positions)), lambda a, b: F.least(F.lit(3), F.nvl(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def in_pairs(found: Column) -> Column:
        """Positions of the (hash, position) structs, sorted, that have a neighbour with the same hash."""
        last = F.size(found) - 1
        same = F.filter(
            found,
            lambda x, k: ((k > 0) & (F.get(found, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(found, k + 1)["h"] == x["h"])),
        )
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def search(hashes: Column) -> Column:
        def masked(bits: Column) -> Column:
            keep, low = bits["keep"], bits["low"]

            def neighbours(ordered: Column) -> Column:
                pairs = F.zip_with(
                    ordered,
                    F.slice(ordered, 2, F.size(ordered)),
                    lambda a, b: F.when(F.nvl(a.bitwiseXOR(b), F.lit(-1).cast("long")).bitwiseAND(keep) == 0, F.array(a, b)),
                )
                places = F.transform(F.array_distinct(F.flatten(F.array_compact(pairs))), lambda x: x.bitwiseAND(low).cast("int"))
                return let(F.array_sort(F.transform(places, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i")))), in_pairs)

            return let(F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(keep).bitwiseOR(i.cast("long")))), neighbours)

        low = F.pow(F.lit(2.0), F.length(F.bin(n))).cast("long") - 1
        return let(low, lambda m: let(F.struct(F.bitwise_not(m).alias("keep"), m.alias("low")), masked))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(search(h)))
    return F.when(n < 4, 0).otherwise(some).cast("long")


def measure(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """One column of the input and the measurements that rules are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, ASCII_SPACES, "")) > 0)
    by_words = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        keep,
        by_words.alias("by_words"),
        by_lines.alias("by_lines"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}")).cast("long").alias("n_letter_words"),
    ).select(keep, "by_words.*", "by_lines.*", "n_symbols", "n_letter_words")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: str = "doc_id") -> DataFrame:
    """The kept column, the measurements and fail_bits: bit k is set if rules[k] fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, keep).withColumn("fail_bits", bits)


def policy_mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy]
    return sum(1 << k for k, rule in enumerate(rules) if rule.name in names)


def kept(policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the policy keeps a row of the ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects. One pass, two numbers a rule."""
    mask = policy_mask(policy, rules)
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    used = [(k, r) for k, r in enumerate(rules) if mask >> k & 1]
    sums = rows.agg(
        *(F.count_if(bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias(f"f{k}") for k, _ in used),
        *(F.count_if(bits == (1 << k)).alias(f"o{k}") for k, _ in used),
    )
    entries = [F.struct(F.lit(r.name).alias("rule"), F.col(f"f{k}").alias("n_failed"), F.col(f"o{k}").alias("n_only")) for k, r in used]
    return sums.select(F.inline(F.array(*entries)))


def reject(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with all their columns; repeated rows and null ids are judged row by row."""
    rows = ledger(docs.select(F.struct(*docs.columns).alias("row"), "text"), keep="row")
    return rows.where(kept(policy)).select("row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read

    rows = ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), kept("v1").alias("kept"), "fail_bits",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT rid, doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_letter_words FROM d),
tri AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines, n_letter_words
  FROM m LEFT JOIN cov USING (rid)),
g AS (
  SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 14 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 4 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_letter_words < 60 * n_words THEN 64 ELSE 0 END))::BIGINT AS fail_bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM g
"""


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """For each rule of policy v1 the documents that fail it, and those that no other rule rejects."""
    from .common import read

    return ablations(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))


ABLATIONS_SQL = "WITH ledger AS (" + ORACLE_SQL + "), rules(rule, bit) AS (VALUES " + ", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(RULES)) + """)
SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (fail_bits = bit)::BIGINT AS n_only FROM ledger, rules GROUP BY rule"""
