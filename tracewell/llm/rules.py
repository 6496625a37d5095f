"""Quality rules as a bitmask ledger: every rule is evaluated once per document, policies are applied to the stored bits.

The ledger keeps one integer of failure bits and all measurements per document. A policy is a named, versioned set of
rules; applying one is a bitwise AND, and an ablation (what a policy would keep without one of its rules) is one
aggregation over the stored bits. No text is read again for either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, resident, text_slices, unused

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rule name -> predicate over the measurements that is true where a document FAILS; the position is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
}
BASE = ("few_words", "repeated_windows")
#: Versioned policies. Never change one; add a version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "strict-1": tuple(RULES),
    # no upper bound on length: many_words stays a measurement of the ledger
    "strict-2": tuple(r for r in RULES if r != "many_words"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def count_repeats(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of so many words which occurs twice or more in the list, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    for w in words:
        numbers.setdefault(w, len(numbers))
    h = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=n)
    # a window is numbered by the number of its first words and that of its next word: equal numbers are equal windows
    grams = h
    for k in range(1, window):
        grams = np.unique(grams[:-1] * len(numbers) + h[k:], return_inverse=True)[1] if k < window - 1 else grams[:-1] * len(numbers) + h[k:]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; a null text measures as an empty one."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), count_repeats(words), len(lines)


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs without the text column (unless keep_text), plus measurements and failure bits (`rule_bits`).

    Defined results: a null or empty text has zero for all measures and fails `few_words`; a null id is carried on;
    repeated rows get a row each; other columns are carried on unless they bear a name that the ledger itself
    defines, in which case the ledger's value stands.
    """
    carried = [c for c in docs.columns if c != text and c not in MEASURES and c != "rule_bits"]
    held = unused([*carried, *MEASURES], "__text")
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(__name__)
        for batch in text_slices(batches, held):
            rows = np.array([measure(x) for x in batch.column(held).to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
            columns = [batch.column(c) for c in passed] + [pa.array(rows[:, k]) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, *MEASURES])

    passed = [*carried, held] if keep_text else carried
    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in source.schema if c.name in passed), *(f"{m} long" for m in MEASURES)])
    measured = map_batches(source, run, schema)
    if keep_text:
        measured = measured.withColumnRenamed(held, text)
    bits = sum((F.when(F.expr(p), bit(r)).otherwise(0) for r, p in RULES.items()), F.lit(0))
    return measured.withColumn("rule_bits", bits.cast("long"))


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """Add `kept`: no rule of the policy failed."""
    return book.withColumn("kept", F.col("rule_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail it alone, and what the policy keeps without it."""
    bits = F.col("rule_bits").bitwiseAND(F.lit(mask(policy)))
    rules = POLICIES[policy]
    sums = [F.count(F.lit(1)).alias("n")]
    for r in rules:
        sums += [F.count_if(bits.bitwiseAND(F.lit(bit(r))) != 0).alias(f"fail_{r}"), F.count_if(bits == bit(r)).alias(f"only_{r}"), F.count_if(bits.bitwiseAND(F.lit(mask(policy) & ~bit(r))) == 0).alias(f"kept_{r}")]
    wide = book.agg(*sums)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit"), F.col(f"fail_{r}").alias("failed"), F.col(f"only_{r}").alias("failed_alone"), F.col(f"kept_{r}").alias("kept_without")) for r in rules])))


def quality_rules(docs: DataFrame, policy: str = "strict-2", keep_text: bool = False) -> DataFrame:
    """The ledger of docs with base_failed and the policy's verdict."""
    book = apply_policy(ledger(docs, keep_text=keep_text), policy)
    base = F.col("rule_bits").bitwiseAND(F.lit(mask("base-1"))) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("kept"))
