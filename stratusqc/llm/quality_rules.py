"""Quality rules as a short-circuit cascade, in built-in functions only.

The measures that are reported are taken of every text. The verdict runs further rules one after the other and
stops at the first that rejects. Their order follows from a sample: each rule is timed and its rejections are
counted on it, and the rule with most rejections per second comes first. The order decides how much is
computed, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import SPACE, text_or_empty
from stratusqc.session import write_and_reread

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: About so many rows are sampled to order the rules.
SAMPLE_ROWS = 2_000


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text and the measures of each text, in steps: what several measures need is computed once.

    Repeats are looked for among hashes of windows; only texts that have some are taken further.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bare = F.col("text")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    rows = rows.select(
        "doc_id", "text", _words(F.col("text")).alias("words"), _lines(F.col("text")).alias("lines"), (F.length("text") - F.length(bare)).alias("n_symbols")
    )
    rows = rows.select(
        "doc_id",
        "text",
        "n_symbols",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    kept = ["doc_id", "text", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    rows = rows.select(*kept, F.when(F.size("hashes") >= WINDOW, windows).alias("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*kept, F.when(F.size("windows") > F.size(F.array_distinct("windows")), placed).alias("placed"))
    here = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("placed", lambda x, k: here(x, k - 1) | here(x, k + 1))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    # Words covered by the windows: each adds what reaches beyond the one before.
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    rows = rows.select(*kept, F.when(F.col("placed").isNotNull(), covered).otherwise(0).alias("n_repeat_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return rows.select("doc_id", "text", *[F.col(c).cast("long").alias(c) for c in counts])


#: Further rules; each rejects a text.
RULES: dict[str, Column | str] = {
    "symbols": "10 * n_symbols > n_words",
    "repeated lines": "2 * n_dup_lines > n_lines",
    "odd words": "word_chars > 20 * n_words or word_chars < 2 * n_words",
    "capitals": "2 * regexp_count(text, '[A-ZÀ-ÖØ-Þ]') > word_chars",
    "urls": "3 * regexp_count(text, 'https?://') > n_words",
}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(docs: DataFrame, rules: dict[str, str] | None = None) -> list[str]:
    """Names of the rules by rejections per second on a sample, most first."""
    rules = RULES if rules is None else rules
    total = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    # The same rows however they are dealt.
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = write_and_reread(measured(docs.filter(chosen)), "sample")

    def timed(rule: Column) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = sample.agg(F.sum(rule.cast("int")), F.count("text")).first()[0] or 0
        return time.perf_counter() - start, rejected

    timed(F.lit(True))
    idle, _ = timed(F.lit(True))
    found = {name: timed(F.expr(rule)) for name, rule in rules.items()}
    return sorted(rules, key=lambda name: -found[name][1] / max(found[name][0] - idle, 1e-3))


def judge(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row.

    Null and empty texts have no words and fail the base rule. Null or repeated doc_ids are passed on; other columns
    are not looked at; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    rows = measured(docs).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), False)
    for name in order_rules(docs, rules):
        verdict = verdict.when(F.expr(rules[name]), False)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(True).alias("kept")
    )
