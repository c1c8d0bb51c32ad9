"""Exact duplicates between an immutable snapshot and a batch of new documents.

1. Every row gets the digest of its normalised text (runs of white space become one blank).
2. Snapshot and new batch are grouped by digest apart, both with partial sums before the shuffle, so that a group
   of any size arrives as a few rows.
3. The snapshot's digests go into static binary fuse filters, one per shard of the digest space; the number of
   shards follows the number of digests, so that a filter stays below about 200 kB.
4. The batch's digests are screened by them. Most new texts end here: they are in no bucket of the snapshot.
5. Those that pass join the snapshot's exact buckets by digest.
6. Byte check: the texts of all rows in groups of two or more are compared as texts, not as digests. Only these
   rows are normalised again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.llm import fuse_filter
from stratusqc.llm.common import text_or_empty
from stratusqc.session import write_and_reread

SHARD_KEYS = 1 << 17


def normalised(text: Column) -> Column:
    """Every run of white space as one blank; plain replacements first, the pattern only where runs are left."""
    for code in (9, 10, 11, 12, 13):
        text = F.replace(text, F.lit(chr(code)), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    whole = digests.combine_chunks() if isinstance(digests, pa.ChunkedArray) else digests
    return np.frombuffer(b"".join(d[:8] for d in whole.to_pylist()), np.uint64)


def _build(group: pa.Table) -> pa.Table:
    seed, segment, segments, raw = fuse_filter.build(_keys(group.column("digest")))
    return pa.table(
        {
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int64()),
            "seed": pa.array([seed], pa.int64()),
            "segment": pa.array([segment], pa.int64()),
            "segments": pa.array([segments], pa.int64()),
            "fingerprints": pa.array([raw], pa.binary()),
        }
    )


def _screen(batch: pa.Table, filters: pa.Table) -> pa.Table:
    if filters.num_rows and batch.num_rows:
        f = filters.to_pylist()[0]
        found = fuse_filter.contains((f["seed"], f["segment"], f["segments"], f["fingerprints"]), _keys(batch.column("digest")))
    else:
        found = np.zeros(batch.num_rows, bool)
    return batch.select(["digest", "keep", "n"]).append_column("maybe", pa.array(found))


def _grouped(rows: DataFrame) -> DataFrame:
    """Digest, first row and number of rows of each group."""
    return rows.groupBy("digest").agg(F.min("place").alias("keep"), F.count(F.lit(1)).alias("n"))


def find_copies(docs: DataFrame, is_new: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``is_new`` tells the new batch from the snapshot (null counts as new). A null text counts as empty. The row
    with the smallest doc_id of a group stays; null ids come after all others, and of rows with the same id one
    stays. An empty table gives no rows; columns besides doc_id and text are not looked at.
    Raises if two different texts have one digest.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(text_or_empty()), 256)).alias("digest"),
        F.coalesce(is_new, F.lit(True)).alias("is_new"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = write_and_reread(rows, "digests").withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    old = write_and_reread(_grouped(rows.filter("not is_new")), "buckets")
    new = write_and_reread(_grouped(rows.filter("is_new")), "batch")
    shards = max(1, -(-max(old.count(), new.count()) // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    filters = write_and_reread(
        old.select("digest", shard)
        .groupBy("shard")
        .applyInArrow(_build, "shard long, seed long, segment long, segments long, fingerprints binary"),
        "filters",
    )
    place = old.schema["keep"].dataType.simpleString()
    screened = write_and_reread(
        new.select("*", shard)
        .groupBy("shard")
        .cogroup(filters.groupBy("shard"))
        .applyInArrow(_screen, f"digest binary, keep {place}, n long, maybe boolean"),
        "screened",
    )
    known = screened.filter("maybe").select("digest", F.col("keep").alias("new_keep"), F.col("n").alias("new_n"))
    met = old.join(known, "digest", "full_outer").select(
        "digest",
        F.least("keep", "new_keep").alias("keep"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"),
    )
    groups = write_and_reread(met.unionByName(screened.filter("not maybe").select("digest", "keep", "n")), "groups")
    out = rows.join(groups, "digest").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    out = write_and_reread(out, "copies")
    _check_bytes(docs, out)
    return out


def _check_bytes(docs: DataFrame, copies: DataFrame) -> None:
    """Raises if a group holds two texts. Copies are counted before the shuffle, so a large group arrives as few rows."""
    members = copies.filter("group_size > 1").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.join(members, texts.doc_id.eqNullSafe(members.doc_id), "left_semi").select(normalised(F.col("text")).alias("text"))
    each = texts.groupBy("text").count().select(F.sha2("text", 256).alias("digest"))
    twice = each.groupBy("digest").count().filter("count > 1").limit(1).collect()
    if twice:
        raise RuntimeError(f"two texts have the digest {twice[0]['digest']}")


def halves(docs: DataFrame) -> Column:
    """Documents in order of their ids: the first half as the snapshot, the rest as the new batch."""
    middle = docs.select(F.percentile_approx("doc_id", 0.5)).first()[0]
    return F.lit(True) if middle is None else F.col("doc_id") > middle


def drop_copies(docs: DataFrame, is_new: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of equal rows one stays."""
    copies = find_copies(docs, is_new)
    kept = copies.filter("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    if not copies.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).collect():
        return docs.join(kept.select(F.col("doc_id").alias("kept_id")), docs["doc_id"] == F.col("kept_id"), "left_semi")
    # Ids don't tell rows apart: go by id and text, and take one of rows that agree in both.
    digest = F.sha2(normalised(text_or_empty()), 256)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id").cast("long").alias("id"), digest.alias("digest"))
    same = marked["id"].eqNullSafe(kept["doc_id"]) & (marked["digest"] == kept["digest"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("all.*")
