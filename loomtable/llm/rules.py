"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for every document; the ledger keeps its measurements and one bit for
each rule that fails. A policy is a named, versioned mask of rules; applying it is a bitwise AND, and
an ablation (what if one rule were dropped, or stood alone?) is a count over the few distinct masks.

A null text has no words and no lines. Empty and null texts fail the length rule; a very long text is
handled in its own row (no rows are exploded, nothing is shuffled); repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space that parts words, and the symbols that are counted.
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` holds; expressions are SQL over the measurements."""

    bit: int
    name: str
    fails: str


#: The bit of a rule never changes its meaning; new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words * 4"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
    Rule(6, "few_words_strict", "n_words < 100"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_trigrams"))
DEFAULT = Policy("default", 1, ("few_words", "repeated_trigrams", "symbols", "duplicate_lines", "short_words", "long_words"))
STRICT = Policy("strict", 1, (*DEFAULT.rules, "few_words_strict"))


def words_of(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    spaced = F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def repeated_words(words: str) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Where all windows' hashes differ there are none. Else windows are sorted by hash, then by text, with their places;
    equal neighbours are repeats, and texts are compared only where hashes meet. Places of repeats, sorted, cover three
    words each, less what the next one covers too.
    """
    return F.expr(
        f"""
        CASE WHEN size({words}) < 4 THEN 0L ELSE
          transform(
            array(transform(slice({words}, 1, size({words}) - 2), (w, i) -> xxhash64(w, {words}[i + 1], {words}[i + 2]))),
            hashes -> CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE
              aggregate(
                sort_array(
                  flatten(
                    transform(
                      array(sort_array(transform(
                        hashes,
                        (h, i) -> struct(h AS h, concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]) AS t, i AS i)))),
                      s -> transform(
                        filter(
                          transform(s, (x, j) -> struct(x.i AS i, (j > 0 AND s[j - 1].h = x.h AND s[j - 1].t = x.t) OR (j + 1 < size(s) AND s[j + 1].h = x.h AND s[j + 1].t = x.t) AS r)),
                          y -> y.r),
                        y -> y.i)))),
                struct(-3 AS last, 0L AS n),
                (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n),
                a -> a.n)
            END)[0]
        END"""
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, the measurements, fail_bits) of every document; further columns of docs are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("_text"), words_of(text).alias("_words"), F.filter(F.split(text, "\n"), lambda line: F.trim(F.translate(line, WHITE_SPACE, " " * 6)) != "").alias("_lines"))
    # Measurements come out of a generator of one row: filters on them stay above it, where Spark would
    # otherwise write the splitting of the text into every use of its words.
    measures = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", WHITE_SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_words").alias("n_repeat_words"),
    )
    measured = rows.select("doc_id", F.inline(F.array(measures)))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.withColumn("fail_bits", mask.cast("long"))


def fails(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(book: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Adds base_failed, kept and the policy's name and version; what the base rules reject, every policy rejects."""
    return book.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE) & ~fails(policy)).withColumn("policy", F.lit(f"{policy.name}/{policy.version}"))


def ablations(book: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(rule, failed, failed_alone, kept_without): by rule of a policy, from one count of distinct masks.

    failed_alone: documents that this rule alone rejects; kept_without: documents kept if it is dropped.
    """
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    names = [(r.name, 1 << r.bit) for r in RULES if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in names]))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return masks.select("m", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(total(hit).alias("failed"), total(hit & rest).alias("failed_alone"), total(rest).alias("kept_without"))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")

#: DuckDB: the measurements of `documents`, and the bits of the rules that fail.
_MEASURED = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS rid
  FROM documents),
t AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM t QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS d(k) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 10 * n_symbols > 4 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END)
         + (CASE WHEN n_words < 100 THEN 64 ELSE 0 END) AS bits
  FROM m)
"""

#: DuckDB: the same rows as the query over `documents`.
ORACLE = (
    _MEASURED
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed,
       bits & 63 = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits, 'default/1' AS policy
FROM b
"""
)

#: DuckDB: the ablations of the default policy over `documents`.
ABLATIONS_ORACLE = (
    _MEASURED
    + """
SELECT r.rule AS rule, CAST(count(*) FILTER (bits & r.bit <> 0) AS BIGINT) AS failed,
       CAST(count(*) FILTER (bits & 63 = r.bit) AS BIGINT) AS failed_alone,
       CAST(count(*) FILTER (bits & (63 - r.bit) = 0) AS BIGINT) AS kept_without
FROM b, (VALUES ('few_words', 1), ('repeated_trigrams', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32)) AS r(rule, bit)
GROUP BY r.rule
"""
)


def keep_passing(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of docs, all columns, that a policy keeps; measured in their own rows, without a join."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), "text")
    return apply_policy(ledger(packed), policy).filter("kept").select("doc_id.*")
