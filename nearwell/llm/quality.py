"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies are masks over those bits, so a new policy version or an ablation never reads a text
again. Everything is column expressions: one scan, no shuffle, except for the ablation counts, which
aggregate by distinct bitmask (at most two to the number of rules groups) before anything moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwell.llm.columns import SPACES, bind, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; ``bit`` never changes once published."""

    name: str
    bit: int
    fails: Callable[[dict[str, Column]], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document stays unless it fails one of these rules."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        by_name = {r.name: r.mask for r in rules}
        return sum(by_name[n] for n in set(self.rules))


RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 50),
    Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    # one symbol to two words: markup or separators, not prose
    Rule("symbols", 2, lambda m: 2 * m["n_symbols"] > m["n_words"]),
    Rule("short_words", 3, lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", 4, lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("repeated_lines", 5, lambda m: F.lit(20) * m["n_dup_lines"] > m["n_words"]),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", tuple(r.name for r in RULES)))


def _repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more, each word once.

    The repeated hashes are found among the sorted ones; windows that have one of them cover three
    words each, less what the window before already covers.
    """
    def covered(order: Column) -> Column:
        near = F.filter(order, lambda x, j: (F.get(order, j + 1)["h"] == x["h"]).eqNullSafe(True)
                        | ((j > 0) & (F.get(order, j - 1)["h"] == x["h"])))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(F.transform(near, lambda x: x["i"])), start,
                           lambda a, p: F.struct((p + 3).alias("end"), (
                               a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n")),
                           lambda a: a["n"])

    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, bind(order, covered)).otherwise(F.lit(0))


def measures_of(text: Column) -> Column:
    """The measurements of one whole text as a struct of longs; null counts as empty.

    Windows are compared by a 64-bit hash (a document of a million words has a chance of about one
    in 10^7 of one accidental match).
    """
    def all_of(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        return bind(words_of(text), lambda words: F.struct(*(v.cast("long").alias(k) for k, v in {
            "n_words": F.size(words),
            "word_chars": F.length(F.translate(text, SPACES, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": bind(window_hashes(words, 3), _repeat_words)}.items())))

    return bind(F.coalesce(text, F.lit("")), all_of)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text, as longs.

    A null or blank text measures 0 everywhere. Repeated rows are measured each; other columns are
    ignored.
    """
    # a generator keeps later filters from being pushed below the measuring, and so from repeating it
    return docs.select("doc_id", F.inline(F.array(measures_of(F.col("text")))))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: bit b is set if the rule of bit b fails."""
    measures = {m: F.col(m) for m in MEASURES}
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(measures), F.lit(rule.mask)).otherwise(F.lit(0))
                              .cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES,
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with one boolean column ``kept_<version>`` per policy."""
    return book.withColumns({f"kept_{p.version}": passes(p, rules) for p in policies})


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES,
              rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents failing the rule, failing it alone, and kept without it.

    An empty ledger gives rows of zeros. Documents are counted by bitmask first.
    """
    spark = book.sparkSession
    grid = spark.createDataFrame(
        [(p.version, r.name, p.mask(rules), r.mask) for p in policies for r in rules
         if r.name in p.rules], "version string, rule string, policy_mask long, rule_mask long")
    groups = book.groupBy("fail_bits").count()
    failed = F.col("fail_bits").bitwiseAND(F.col("policy_mask"))
    hit = failed.bitwiseAND(F.col("rule_mask")) != 0
    without = F.col("fail_bits").bitwiseAND(
        F.col("policy_mask").bitwiseXOR(F.col("rule_mask"))) == 0

    def total(when: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0)).alias(name)

    # grid has one row per policy and rule, a fixed list of the code
    joined = groups.join(F.broadcast(grid), F.lit(True), "right")
    return joined.groupBy("version", "rule").agg(
        total(hit, "failing"), total(failed == F.col("rule_mask"), "failing_alone"),
        total(without, "kept_without"))


def keep(docs: DataFrame, policy: Policy = POLICIES[-1],
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, with all their columns, that pass the policy; the ledger is not kept.

    One projection over the documents: no join brings text and verdict together. Columns of the
    documents that are named like a measurement stay as they are.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id")
    return ledger(docs.select(row, "text"), rules).where(passes(policy, rules)).select("doc_id.*")
