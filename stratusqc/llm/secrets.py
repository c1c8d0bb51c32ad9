"""Secret scans of every version of every text through a ledger of contents.

Each version is addressed by the SHA-256 of its text. The ledger holds, per content, the rules (with their versions)
that have been run over it and what they found. A scan looks up which pairs of content and rule version are new,
reads one version of each such content, runs just those rules, appends to the ledger, and joins the findings back
to all versions that have the content. Raising a rule's version runs that rule alone over all contents again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stratusqc.llm.common import byte_slices, text_bytes, text_or_empty
from stratusqc.session import write_and_reread

#: Kinds in the order in which spans with one start are listed, each with the version of its rule.
RULES = {"assign": 1, "access": 1, "hex": 1, "pem": 1, "github": 1, "slack": 1, "jwt": 1}
BASE = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
PATTERNS = {
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    "github": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
#: What a text must contain for a rule to match at all.
NEEDS = {"access": "AKIA", "pem": "-----BEGIN ", "github": "gh", "slack": "xox", "jwt": "eyJ"}
SHORTEST_HEX = 24

LEDGER = "blob string, rules array<string>, found array<struct<start:long,rank:int,end:long,kind:string>>"
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def spans(kind: str, text: str) -> list[tuple[int, int]]:
    """Start and end of all matches of one rule, in code points."""
    if kind == "assign":
        return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if kind in NEEDS and NEEDS[kind] not in text:
        return []
    return [m.span() for m in PATTERNS[kind].finditer(text)]


def _hopeful(texts: pa.Array) -> dict[str, np.ndarray]:
    """For the rules without a fixed word: which texts have the signs they need."""
    raw, starts = text_bytes(texts)
    signs = np.concatenate([[0], np.cumsum((raw == 58) | (raw == 61))])
    runs = np.concatenate([[0], np.cumsum(_HEX[raw])])
    # A run crosses from one text into the next at worst; that text is then looked at for nothing.
    full = np.zeros(len(raw) + 1, np.int64)
    if len(raw) >= SHORTEST_HEX:
        full[1 : len(raw) - SHORTEST_HEX + 2] = runs[SHORTEST_HEX:] - runs[:-SHORTEST_HEX] == SHORTEST_HEX
    full = np.cumsum(full)
    return {"assign": signs[starts[1:]] > signs[starts[:-1]], "hex": full[starts[1:]] > full[starts[:-1]]}


def _scan(batches: Iterable[pa.RecordBatch], ranks: dict[str, int]) -> Iterator[pa.RecordBatch]:
    found_kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))
    for rows in byte_slices(batches):
        hopeful, found = _hopeful(rows.column("text")), []
        for k, (text, rules) in enumerate(zip(rows.column("text").to_pylist(), rows.column("rules").to_pylist())):
            own = []
            for rule in rules:
                kind = rule.split("@")[0]
                if kind not in hopeful or hopeful[kind][k]:
                    own += [{"start": s, "rank": ranks[kind], "end": e, "kind": kind} for s, e in spans(kind, text)]
            found.append(own)
        yield pa.RecordBatch.from_arrays([rows.column("blob"), rows.column("rules"), pa.array(found, found_kind)], names=["blob", "rules", "found"])


def _ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger_path: str, rules: dict[str, int] | None = None) -> DataFrame:
    """doc_id, blob (hex SHA-256 of the text) and found (start, rank, end, kind in order) of every row of ``docs``.

    Rows are versions: a doc_id may occur any number of times and may be null. A null text counts as empty. An
    empty table gives no rows and leaves the ledger as it is. Columns besides doc_id and text are not looked at.
    Findings of older versions of a rule stay in the ledger but are not returned.
    """
    spark = docs.sparkSession
    rules = RULES if rules is None else rules
    named = [f"{kind}@{version}" for kind, version in rules.items()]
    wanted = F.array(*[F.lit(n) for n in named])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    versions = write_and_reread(texts.select("doc_id", F.sha2("text", 256).alias("blob")), "versions")

    # One row per content; copies are summed up before the shuffle.
    blobs = versions.groupBy("blob").agg(F.min("doc_id").alias("at"))
    seen = _ledger(spark, ledger_path).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    unseen = blobs.join(seen, "blob", "left").select("blob", "at", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
    unseen = write_and_reread(unseen.filter(F.size("rules") > 0), "unseen")
    read = texts.join(unseen, F.col("doc_id").eqNullSafe(F.col("at"))).filter(F.sha2("text", 256) == F.col("blob"))
    ranks = {kind: k for k, kind in enumerate(rules)}
    scanned = read.select("blob", "text", "rules").mapInArrow(partial(_scan, ranks=ranks), LEDGER)
    scanned.write.mode("append").parquet(ledger_path)

    # Of an entry only what was found by a rule version that is wanted now; ranks are those of the wanted rules.
    entries = _ledger(spark, ledger_path).withColumn("rules", F.array_intersect("rules", wanted)).filter(F.size("rules") > 0)
    current = F.filter("found", lambda s: F.exists("rules", lambda r: F.substring_index(r, "@", 1) == s["kind"]))
    order = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    ranked = F.transform(current, lambda s: s.withField("rank", order[s["kind"]]))
    entries = entries.withColumn("found", ranked)
    # A content that was read twice, because a row is repeated, has its findings twice.
    findings = entries.filter(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return versions.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("found", empty).alias("found"))
