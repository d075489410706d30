"""Rule ledger: every quality rule is evaluated once, policies and ablations work on its bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of

@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition on the measurements is true; the bit is its place for good."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: ledgers written with older rules keep their meaning.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "shouting", "2 * n_upper > word_chars"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(7, "no_letters", "NOT has_letters"),
)

#: What a version of the policy rejects, by rule names.  Versions are only ever added.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting"),
    "v2": tuple(rule.name for rule in RULES),
}


def mask_of(policy: str) -> int:
    """Bits of the rules of a policy."""
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _only(text: Column, kept: str) -> Column:
    """How many characters of a text are in a class of characters, given as its complement."""
    return F.length(F.regexp_replace(text, kept, "")).cast("long")


#: Bits of a window's sort key that hold its position; the others hold its hash.
PLACE = 22
_AT = (1 << PLACE) - 1


def _covered(positions: Column) -> Column:
    """Number of words in 3-word windows at the given positions, which are sorted and distinct."""
    return F.aggregate(
        F.zip_with(
            positions,
            F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1))),
            lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("long"),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )


def _windows_as_text(words: Column) -> Column:
    """Positions of windows with an equal one, by sorting the windows themselves."""
    placed = F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
        )
    )
    pairs = F.zip_with(
        placed,
        F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))


def repeated_words(docs: DataFrame, words: str, name: str) -> DataFrame:
    """Number of words in 3-word windows that a text holds twice or more, as column ``name``.

    One sort per text: keys are a hash of the window in the high bits and its position in the low
    ones, so equal windows are neighbours.  Neighbours with one hash are compared word by word; a
    text where such a pair differs, or with more words than the low bits can count, is done again
    with the windows themselves as keys.
    """
    w = F.col(words)
    keyed = docs.withColumn(
        "__keys",
        F.array_sort(
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
                .bitwiseAND(F.lit(~_AT))
                .bitwiseOR(i.cast("long").bitwiseAND(F.lit(_AT))),
            )
        ),
    )
    at = lambda i: F.get("__keys", i).bitwiseAND(F.lit(_AT)).cast("int")
    same = keyed.withColumn(
        "__same",
        F.filter(
            F.transform(
                "__keys",
                lambda x, i: F.when(F.shiftright(x.bitwiseXOR(F.get("__keys", i + 1)), PLACE) == 0, i),
            ),
            lambda i: i.isNotNull(),
        ),
    )
    differs = F.exists(
        "__same",
        lambda i: (F.get(w, at(i)) != F.get(w, at(i + 1)))
        | (F.get(w, at(i) + 1) != F.get(w, at(i + 1) + 1))
        | (F.get(w, at(i) + 2) != F.get(w, at(i + 1) + 2)),
    )
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform("__same", lambda i: F.array(at(i), at(i + 1))))))
    return (
        same.withColumn("__at", F.when((F.size(w) > _AT) | differs, _windows_as_text(w)).otherwise(positions))
        .withColumn(name, _covered(F.col("__at")))
        .drop("__keys", "__same", "__at")
    )


def ledger(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, the measurements, and ``fail_bits``.

    Measurements (long): n_words, word_chars, n_symbols, n_upper, n_lines (lines with a word),
    n_dup_lines (of these, equal to an earlier line) and n_repeat_words (words in 3-word windows
    found twice or more); has_letters (boolean).  Words stand between blanks.  NULL text measures
    as empty text: every count is 0 and few_words fails.  Rows are independent, so repeated rows
    get equal ledgers, and tables without rows give none.  Columns of ``docs`` with the name of a
    measurement are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumn("__words", words_of(F.col("text"))).withColumn(
        "__lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    measured = (
        repeated_words(split, "__words", "n_repeat_words")
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": _only(text, r"[^#*$%&|<>]+"),
                "n_upper": _only(text, r"[^\p{Lu}]+"),
                "has_letters": text.rlike(r"\p{L}"),
                "n_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            }
        )
        .drop("__words", "__lines")
    )
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long") for rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    # A condition on a column of rows that were numbered is not pushed below the numbering, so a
    # filter on the bits does not measure a text again for each place where the bits mention it.
    return measured.withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, total))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """Whether a document with these bits is kept under a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone (kept without it), and all.

    Documents are first counted by their bits, of which there are at most 2 to the number of rules;
    texts are not looked at again.  A ledger without rows gives zeros.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)))
    counts = ledger_rows.groupBy(masked.alias("bits")).count()
    rules = [rule for rule in RULES if rule.name in POLICIES[policy]]
    hits = lambda rule: F.col("bits").bitwiseAND(F.lit(1 << rule.bit)) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0))
    columns = [
        F.struct(
            F.lit(policy).alias("policy"),
            F.lit(rule.name).alias("rule"),
            total(hits(rule)).alias("n_failed"),
            total(F.col("bits") == (1 << rule.bit)).alias("n_failed_alone"),
            F.coalesce(F.sum("count"), F.lit(0)).alias("n_documents"),
        )
        for rule in rules
    ]
    return counts.agg(F.array(*columns).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def keep_passing(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of ``docs``, with their own columns alone, that a policy keeps."""
    inner = docs.select(F.struct("*").alias("__row"), "text")
    return ledger(inner).filter(passes(policy)).select("__row.*")
