"""The queries of this package; one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratusqc.llm import (
    bpe,
    exact_dedup,
    fill_middle,
    licenses,
    ngram_join,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    runs,
    secrets,
    token_files,
    toxicity,
)
from stratusqc.llm.common import table, text_or_empty
from stratusqc.session import scratch_dir

LOWER_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: For these queries only; a deployment brings its own secret.
PII_KEY = b"key of the published examples"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = ("email", "phone", "card", "ip", "ssn", "iban", "date")
    counts = [_count("pii_spans", kind).alias(f"n_{kind}") for kind in kinds]
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", *counts, _listed(F.col("pii_spans")).alias("spans"))


def op2_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), LOWER_TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    machine = toxicity.fit(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), scratch_dir(spark, "ledger"))
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id",
        *[_count("found", kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def op6_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_TOKENIZER)
    read = token_files.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.find_copies(docs, exact_dedup.halves(docs))


OP7_SQL = r"""
WITH digests AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM digests GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM digests JOIN groups USING (text_sha256)
"""


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH texts AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
    SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM texts
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM texts, unnest(range(1, len(w) - 6)) AS u(i)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS s(k) GROUP BY doc_id
), measures AS (
    SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
    FROM lines LEFT JOIN covered USING (doc_id)
), base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words
        OR 2 * length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) > word_chars
        OR 3 * len(regexp_extract_all(t, 'https?://')) > n_words) AS kept
FROM base
"""


def op9_jaccard_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


OP9_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least_id AS component_id
FROM sets JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = quality_classifier.select(docs, table(spark, sf_dir, "labels"))
    return chosen.scored(docs.select("doc_id", "text")).select(
        "doc_id", "importance", F.col("key").alias("sample_key"), (F.col("key") >= chosen.threshold).alias("kept")
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; by the checksum of its id one text in ten gets a tail that repeats, the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    split = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"), g.alias("g"), F.lit(r"([^\x20\x09-\x0D]+)").alias("word"))
    split = split.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.col("word"), F.lit(1))))
    split = split.withColumn("a", (F.col("g") % n).cast("int"))
    split = split.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    tailed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return split.select("doc_id", F.when(n > 0, tailed).otherwise(F.col("text")).alias("text"))


def op11_run_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    # The greatest length first, then the smallest start and period.
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    longest = F.when(F.size("runs") > 0, F.array_min(ranked))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.length")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH RECURSIVE summed AS MATERIALIZED (
    -- The checksum, bit by bit: a number from 0 on is a byte to take in, -1 a shift.
    SELECT doc_id, coalesce(text, '') AS t, xor(4294967295, list_reduce(
        flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END, 4294967295)) AS h
    FROM documents
), numbers AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS v, h, h // 10 AS g FROM summed
), tails AS (
    SELECT doc_id, v, h % 10 = 0 AND len(v) > 0 AS tailed, g % greatest(len(v), 1) AS a, g FROM numbers
), texts AS MATERIALIZED (
    SELECT doc_id, CASE WHEN tailed THEN list_transform(range(len(v)),
        lambda i: CASE WHEN i < a THEN v[i + 1] ELSE v[a + (i - a) % (1 + (len(v) - a) // (3 + g % 8)) + 1] END) ELSE v END AS w
    FROM tails
), strides AS (
    -- A run of four periods has four neighbouring multiples of its period in it.
    SELECT doc_id, w, unnest(range(1, len(w) // 4 + 1)) AS d FROM texts
), proposed AS MATERIALIZED (
    SELECT doc_id, w, d FROM strides WHERE len(list_filter(range(0, len(w) // d - 2),
        lambda m: w[m * d + 1] = w[m * d + d + 1] AND w[m * d + 1] = w[m * d + 2 * d + 1])) > 0
), equal AS (
    SELECT doc_id, d, unnest(list_filter(range(1, len(w) - d + 1), lambda i: w[i] = w[i + d])) AS i FROM proposed
), stretches AS (
    SELECT doc_id, d, min(i) - 1 AS s, count(*) + d AS n
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS part FROM equal)
    GROUP BY doc_id, d, part HAVING count(*) + d >= greatest(6, 4 * d)
), runs AS MATERIALIZED (SELECT doc_id, s, n, min(d) AS q FROM stretches GROUP BY doc_id, s, n
), summary AS (
    SELECT doc_id, count(*) AS n_runs, min({'length': -n, 'start': s, 'period': q}) AS best,
        string_agg(concat(s, ',', n, ',', q, chr(10)), '' ORDER BY s, q) AS listed
    FROM runs GROUP BY doc_id
), dropped AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + n)) AS i FROM runs) GROUP BY doc_id
), collapsed AS (
    SELECT texts.doc_id, array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(
        list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i - 1) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END, ' ') AS c
    FROM texts LEFT JOIN dropped USING (doc_id)
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(-best.length AS BIGINT) AS length,
    CAST(best.period AS BIGINT) AS period, CAST(-1000 * best.length // best.period AS BIGINT) AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM collapsed LEFT JOIN summary USING (doc_id)
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
    FROM documents
), numbers AS (
    SELECT doc_id, t, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
        CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
    FROM drawn
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT doc_id, n, form, t, coalesce(array_to_string(u[1:a], ''), '') AS prefix,
        coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix
    FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


def op13_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["base"])
    places = F.transform(base, lambda f: f["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda f: f["label"]))), ",")
    return found.select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_pack_sum_of_squares": op2_pack_sum_of_squares,
    "op3_distinct_word_bpe": op3_distinct_word_bpe,
    "op4_subsequence_svm": op4_subsequence_svm,
    "op5_blob_ledger": op5_blob_ledger,
    "op6_patched_frames": op6_patched_frames,
    "op7_exact_copies": op7_exact_copies,
    "op8_rule_cascade": op8_rule_cascade,
    "op9_jaccard_prefix_tree": op9_jaccard_prefix_tree,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_run_factors": op11_run_factors,
    "op12_fill_middle": op12_fill_middle,
    "op13_license_index": op13_license_index,
}

ORACLES: dict[str, str] = {
    "op7_exact_copies": OP7_SQL,
    "op8_rule_cascade": OP8_SQL,
    "op9_jaccard_prefix_tree": OP9_SQL,
    "op11_run_factors": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
}
