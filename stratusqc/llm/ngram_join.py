"""Documents linked by the Jaccard similarity of their word n-grams, exactly.

1. One pass hashes every document's n-grams into a set and names the set by its digest. Documents with one set
   are one node from here on.
2. A document that is similar to another shares at least the same part of its own n-grams with it. So each task
   sends the distinct n-grams of its documents to buckets, as packed arrays, and gets back which of them occur
   elsewhere too. Nearly all documents end here. An n-gram that is everywhere is sent once per task.
3. The remaining sets are ordered by one global order, frequent n-grams first; n-grams of one node are only
   counted. Two sets can only be similar if they share one of their rarest n-grams (a suffix of the order whose
   length follows from the bound), which splits the nodes into candidate groups.
4. The sets of a group go into a prefix tree. A set traverses it once: overlaps of shared prefixes are counted
   once for all sets below, and a subtree is left out when the lengths below it, or what remains of both sets,
   can't reach the bound, or when everything below is in the component already. Groups of more than ``BLOCK``
   nodes are split into blocks, and each pair of blocks gets a tree of its own.
5. The links found join the nodes into components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, mix64, partitions_for, text_or_empty
from stratusqc.llm.components import connected
from stratusqc.llm.shingles import shingle_sets
from stratusqc.session import write_and_reread

BLOCK = 4096
#: N-grams held by a task before they are sent.
MOST_HELD = 6_000_000
NOBODY = 0xFFFFFFFF


def _digests(shingles: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set; none for empty sets."""
    ends = np.cumsum(counts)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(shingles ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    halves = [mix64(s[ends] - s[ends - counts] + counts.astype(np.uint64)) for s in sums]
    raw = np.stack(halves, axis=1).astype("<u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if c else None for i, c in enumerate(counts.tolist())]


class _Held:
    """N-grams of the documents read so far."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids: list = []
        self.size = 0

    def sent(self, part: int, buckets: int) -> pa.RecordBatch:
        counts = np.concatenate(self.counts)
        grams = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        nodes = _digests(grams, counts)
        order = np.argsort(grams)
        grams, owner = grams[order], owner[order]
        first = np.ones(len(grams), bool)
        first[1:] = grams[1:] != grams[:-1]
        at = np.flatnonzero(first)
        many = np.diff(np.append(at, len(grams))) > 1
        shared_here = np.bincount(owner[np.repeat(many, np.diff(np.append(at, len(grams))))], minlength=len(counts))
        grams, owner = grams[at], owner[at].copy()
        owner[many] = NOBODY
        bucket = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        low = (grams & np.uint64(0xFFFFFFFF)).astype("<u4")
        if len(counts) < 0xFFFF:
            owner = owner.astype("<u2")
        rows = [(b, low[s:e].tobytes(), owner[s:e].tobytes()) for b, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if e > s]
        columns = {
            "bucket": pa.array([part % buckets] + [r[0] for r in rows], pa.int64()),
            "part": pa.array([part] * (len(rows) + 1), pa.int64()),
            "grams": pa.array([None] + [r[1] for r in rows], pa.binary()),
            "owners": pa.array([None] + [r[2] for r in rows], pa.binary()),
            "ids": pa.array([self.ids] + [None] * len(rows), pa.list_(pa.int64())),
            "nodes": pa.array([nodes] + [None] * len(rows), pa.list_(pa.binary())),
            "sizes": pa.array([counts.tolist()] + [None] * len(rows), pa.list_(pa.int64())),
            "shared": pa.array([shared_here.tolist()] + [None] * len(rows), pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


SENT = "bucket long, part long, grams binary, owners binary, ids array<long>, nodes array<binary>, sizes array<long>, shared array<long>"
ANSWER = "part long, ids array<long>, nodes array<binary>, sizes array<long>, shared array<long>, owners array<long>, found array<long>"


def _send(batches: Iterable[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    held, part = _Held(), TaskContext.get().partitionId() << 24
    for rows in byte_slices(batches):
        grams, counts = shingle_sets(rows.column("text"), size)
        held.sets.append(grams)
        held.counts.append(counts)
        held.ids += rows.column("doc_id").to_pylist()
        held.size += len(grams)
        if held.size >= MOST_HELD:
            yield held.sent(part, buckets)
            held, part = _Held(), part + 1
    if held.ids:
        yield held.sent(part, buckets)


def _answer(table: pa.Table) -> pa.Table:
    """Which n-grams of a bucket came from more than one part, counted per owner; rows of a part go on as they are."""
    rows, out = table.to_pylist(), []
    grams = [np.frombuffer(r["grams"], "<u4") for r in rows if r["grams"] is not None]
    owners = [np.frombuffer(r["owners"], "<u2" if 2 * len(g) == len(r["owners"]) else "<u4") for r, g in zip([r for r in rows if r["grams"] is not None], grams)]
    parts = [r["part"] for r in rows if r["grams"] is not None]
    if grams:
        whole = np.concatenate(grams)
        order = np.argsort(whole)
        same = whole[order][1:] == whole[order][:-1]
        often = np.zeros(len(whole), bool)
        often[order[1:]] |= same
        often[order[:-1]] |= same
        begin = 0
        for part, g, o in zip(parts, grams, owners):
            mine = o[often[begin : begin + len(g)]]
            begin += len(g)
            who, n = np.unique(mine[mine != (0xFFFF if o.dtype == np.dtype("<u2") else NOBODY)], return_counts=True)
            if len(who):
                out.append({"part": part, "owners": who.tolist(), "found": n.tolist()})
    for r in rows:
        if r["ids"] is not None:
            out.append({"part": r["part"], "ids": r["ids"], "nodes": r["nodes"], "sizes": r["sizes"], "shared": r["shared"]})
    return pa.Table.from_pylist(out, schema=_ANSWER)


_LONGS = pa.list_(pa.int64())
_ANSWER = pa.schema(
    [("part", pa.int64()), ("ids", _LONGS), ("nodes", pa.list_(pa.binary())), ("sizes", _LONGS), ("shared", _LONGS), ("owners", _LONGS), ("found", _LONGS)]
)


def _judge(table: pa.Table, num: int, den: int) -> pa.Table:
    """Rows of one part; a candidate shares enough of its n-grams with others."""
    rows = table.to_pylist()
    (own,) = (r for r in rows if r["ids"] is not None)
    shared = np.array(own["shared"], np.int64)
    for r in rows:
        if r["owners"] is not None:
            shared[r["owners"]] += r["found"]
    sizes = np.array(own["sizes"], np.int64)
    return pa.table(
        {
            "doc_id": pa.array(own["ids"], pa.int64()),
            "node": pa.array(own["nodes"], pa.binary()),
            "n_shingles": pa.array(sizes),
            "candidate": pa.array((sizes > 0) & (den * shared >= num * sizes)),
        }
    )


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for rows in byte_slices(batches):
        grams, counts = shingle_sets(rows.column("text"), size)
        nodes = _digests(grams, counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(grams.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), rows.column("node"), lists], names=["node", "wanted", "grams"])


class _Branch:
    """Sets with a common prefix."""

    __slots__ = ("grams", "below", "ends", "least", "most", "deepest", "member", "uniform")

    def __init__(self, grams: list, size: int, depth: int, member: int):
        self.grams, self.below, self.ends = grams, {}, []
        self.least = self.most = size
        self.deepest, self.member, self.uniform = depth, member, True


class PrefixTree:
    """Sets in one global order; finds links and keeps the components of its members."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.root = _Branch([], 0, 0, 0)
        self.sizes: list[int] = []
        self.parent: list[int] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, grams: list, size: int) -> list[int]:
        """Puts a set of ``size`` n-grams in, of which ``grams`` can occur elsewhere; members of other components it joined."""
        me = len(self.sizes)
        self.sizes.append(size)
        self.parent.append(me)
        linked = self._probe(set(grams), size, me) if me else []
        self._insert(grams, size, me)
        return linked

    def _probe(self, grams: set, size: int, me: int) -> list[int]:
        num, den, total, held = self.num, self.den, self.num + self.den, grams.__contains__
        linked, waiting = [], [(self.root, 0, 0)]
        while waiting:
            branch, depth, overlap = waiting.pop()
            if branch.uniform and self.find(branch.member) == self.find(me):
                continue
            if den * branch.most < num * size or num * branch.least > den * size:
                continue
            needed = -(-num * (size + max(branch.least, -(-num * size // den))) // total)
            if overlap + min(branch.deepest - depth, len(grams) - overlap) < needed:
                continue
            depth += len(branch.grams)
            overlap += sum(map(held, branch.grams))
            for other in branch.ends:
                if den * overlap >= num * (size + self.sizes[other] - overlap):
                    a, b = self.find(other), self.find(me)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        linked.append(other)
            if overlap + min(branch.deepest - depth, len(grams) - overlap) >= needed:
                waiting += [(b, depth, overlap) for b in branch.below.values()]
        return linked

    def _insert(self, grams: list, size: int, me: int) -> None:
        if not me:
            self.root.least = self.root.most = size
        branch, at = self.root, 0
        while True:
            branch.uniform = branch.uniform and self.find(branch.member) == self.find(me)
            branch.least, branch.most = min(branch.least, size), max(branch.most, size)
            branch.deepest = max(branch.deepest, len(grams))
            if at == len(grams):
                branch.ends.append(me)
                return
            following = branch.below.get(grams[at])
            if following is None:
                leaf = _Branch(grams[at:], size, len(grams), me)
                leaf.ends.append(me)
                branch.below[grams[at]] = leaf
                return
            common, most = 0, min(len(following.grams), len(grams) - at)
            while common < most and following.grams[common] == grams[at + common]:
                common += 1
            if common < len(following.grams):
                upper = _Branch(following.grams[:common], following.least, following.deepest, following.member)
                upper.most, upper.uniform = following.most, following.uniform
                following.grams = following.grams[common:]
                upper.below[following.grams[0]] = following
                branch.below[grams[at]] = upper
                following = upper
            branch, at = following, at + common


def _link(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one key."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "i", "j", "node", "n", "grams")]
            for group, i, j, *rest in zip(*columns):
                yield (group, i, j), rest

    pairs: list[tuple] = []
    for _, run in groupby(rows(), key=lambda r: r[0]):
        tree, nodes = PrefixTree(num, den), []
        for _, (node, n, grams) in run:
            nodes.append(node)
            pairs += [(nodes[other], node) for other in tree.add(grams, n)]
        if len(pairs) >= 10_000:
            yield _pairs(pairs)
            pairs = []
    yield _pairs(pairs)


def _pairs(pairs: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _ordered(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Node, size n, its n-grams that other nodes have too in global order, and the rarest ones of which a partner has one."""
    each = sets.select("node", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = each.join(often, "gram").groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("rarity"), "gram"))).alias("ordered"))
    out = sets.select("node", F.size("grams").cast("long").alias("n")).join(shared, "node")
    grams = F.col("ordered.gram")
    # All n-grams of this node alone come before the shared ones among the rarest.
    alone = F.col("n") - F.size("ordered")
    rarest = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - alone
    return out.select("node", "n", grams.alias("grams"), F.when(rarest > 0, F.slice(F.reverse(grams), 1, F.least(rarest, F.size("ordered")).cast("int"))).alias("rarest"))


def components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (size of its set), component_id.

    Documents link when den * intersection >= num * union of their sets of ``size``-word shingles, letters A-Z
    taken as a-z. component_id is the smallest doc_id that links reach. A text with fewer words is one shingle.
    A null or empty text, or one without words, has an empty set, links to nothing and has its own id as component.
    Rows with a null doc_id take part; only a component of nothing but such rows has a null component_id.
    Repeated rows are rows of one component. Other columns are not looked at; an empty table gives no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    buckets = 4 * partitions_for(docs)
    sent = given.mapInArrow(partial(_send, size=size, buckets=buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answer, ANSWER)

    def judge(part: pa.Table) -> pa.Table:
        return _judge(part, num, den)

    judged = answers.groupBy("part").applyInArrow(judge, "doc_id long, node binary, n_shingles long, candidate boolean")
    judged = write_and_reread(judged, "nodes")

    # Names of sets stand for documents from here on; of each, one document is read again.
    chosen = judged.filter("candidate").groupBy("node").agg(F.min("doc_id").alias("chosen_id"))
    again = given.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id"))).select("text", "node")
    sets = again.mapInArrow(partial(_sets, size=size), "node binary, wanted binary, grams array<long>")
    sets = write_and_reread(sets.filter("node = wanted").drop("wanted").dropDuplicates(["node"]), "sets")
    ordered = write_and_reread(_ordered(sets, num, den), "ordered")

    stars = ordered.select("node", F.explode("rarest").alias("gram"))
    hubs = stars.groupBy("gram").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = connected(stars.join(hubs, "gram").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())

    blocks = groups.groupBy(F.col("label").alias("group")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    spread = groups.withColumnRenamed("label", "group").join(blocks, "group").withColumn("own", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.filter("blocks = 1 or own != other")
    spread = spread.select("node", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    trees = spread.join(ordered.select("node", "n", "grams"), "node")
    trees = trees.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "n", "node")
    links = write_and_reread(trees.mapInArrow(partial(_link, num=num, den=den), "a binary, b binary"), "links")

    reached = connected(links).select("node", F.col("label").alias("reached"))
    placed = judged.join(reached, "node", "left").select("doc_id", "n_shingles", F.coalesce("reached", "node").alias("component"))
    placed = write_and_reread(placed, "placed")
    # Written, so that the join below may split a component that holds a large share of all rows.
    smallest = write_and_reread(placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    linked = placed.filter("component is not null").join(smallest, "component").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(placed.filter("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with all their columns.

    Rows without an id stay only if their component has no id at all.
    """
    found = components(docs, size, num, den).filter("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
