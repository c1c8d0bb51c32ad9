"""JSON files that are one large array, read by many tasks.

Spark's text source cuts a file into splits at any separator. Here that is the closing brace, the only place where an
object can end, so a split never begins within a key, an escape or a number; it may begin within a text or a nested
object. What a split finds at its start follows from all splits before it, in two passes:

1. each split is summed up for both cases, begun outside or inside a text: how far it changes the depth, how deep it
   falls, what it opened last at each depth. These sums, one small row a split, are put together file by file;
2. the lines of a split go to one task with the state at its start and are cut into objects. An object that crosses
   splits comes out in parts, which are joined by the split it began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratusqc.session import write_and_reread

ROWS_KEY = "readings"
ESCAPE = re.compile(r"\\.", re.DOTALL)
OPENS_ARRAY = re.compile(r"\s*:\s*\[")
BRACKET = re.compile(r"[\[\]{}]")
BYTE_ORDER_MARK = 3

SUMMARY = (
    "file string, split long, size long, n_bytes long, first string, inside boolean, exit_inside boolean, "
    "change int, lowest int, opened map<int,string>"
)
STATE = "file string, split long, inside boolean, depth int, within boolean, level int, started long, open_end boolean"
PARTS = "file string, started long, split long, text string"
SUMMARY_TYPES = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("n_bytes", pa.int64()), ("first", pa.string()),
    ("inside", pa.bool_()), ("exit_inside", pa.bool_()), ("change", pa.int32()), ("lowest", pa.int32()),
    ("opened", pa.map_(pa.int32(), pa.string())),
])
PART_TYPES = pa.schema([("file", pa.string()), ("started", pa.int64()), ("split", pa.int64()), ("text", pa.string())])


def _quoted(line: str) -> list[str]:
    """The line cut at its quotes, escapes blanked: every second part is text."""
    return (ESCAPE.sub("__", line) if "\\" in line else line).split('"')


def _brackets(parts: list[str], inside: bool) -> list[tuple[int, str, bool]]:
    """Brackets outside texts as (position, sign, opens the array of rows)."""
    found, at = [], 0
    for i, part in enumerate(parts):
        if i % 2 == inside:
            named = i >= 2 and parts[i - 1] == ROWS_KEY and OPENS_ARRAY.match(part) is not None
            for m in BRACKET.finditer(part):
                found.append((at + m.start(), m[0], named))
                named = False
        at += len(part) + 1
    return found


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).cast("long").alias("n_bytes"),
        F.make_valid_utf8("value").alias("value"),
    )


class _Sum:
    """A split as seen from its start, for one of the two cases."""

    def __init__(self, inside: bool):
        self.entry = self.inside = inside
        self.depth = self.lowest = 0
        self.opened: dict[int, str] = {}

    def add(self, parts: list[str]) -> None:
        plain = "".join(parts[self.inside :: 2])
        if "[" in plain or "]" in plain:
            signs = [(sign, named) for _, sign, named in _brackets(parts, self.inside)]
        else:
            # A line has one closing brace, its last sign, which may be text.
            signs = [("{", False)] * plain.count("{") + [("}", False)] * plain.count("}")
        for sign, named in signs:
            if sign in "[{":
                self.opened[self.depth] = ROWS_KEY if named else sign
                self.depth += 1
            else:
                self.depth -= 1
                self.lowest = min(self.lowest, self.depth)
        self.inside ^= len(parts) % 2 == 0


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all splits of a task, whose lines follow one another."""
    sums: dict[tuple, list] = {}
    for batch in batches:
        for file, split, size, n_bytes, line in zip(*(c.to_pylist() for c in batch.columns)):
            held = sums.setdefault((file, split, size), [0, "", _Sum(False), _Sum(True)])
            held[0] += n_bytes
            held[1] = held[1] or line.lstrip("\ufeff \t\r\n")[:1]
            parts = _quoted(line + "}")
            held[2].add(parts)
            held[3].add(parts)
    rows = [
        (*key, n, first, s.entry, s.inside, s.depth, s.lowest, list(s.opened.items()))
        for key, (n, first, *both) in sums.items()
        for s in both
    ]
    yield _batch(rows, SUMMARY_TYPES)


def _states(sums: pd.DataFrame) -> pd.DataFrame:
    """State at the start of every split of one file; a file that isn't whole is an error."""
    file, size = sums["file"].iloc[0], sums["size"].iloc[0]
    ordered = sums.sort_values(["split", "inside"])
    cases = {(r.split, r.inside): r for r in ordered.itertuples(index=False)}
    splits = ordered["split"].unique().tolist()
    first = next((cases[s, False].first for s in splits if cases[s, False].first), "")
    rows: list[tuple] = []
    if not first:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])
    if first not in "[{":
        raise ValueError(f"{file} is neither an array nor an object")
    level = 1 if first == "[" else 2
    inside, depth, within, started, element = False, 0, level == 1, -1, ""
    # The source drops separators, and a byte order mark; the last line had a separator only if the file ends with it.
    open_end = sum(cases[s, False].n_bytes for s in splits) - size in (1, 1 - BYTE_ORDER_MARK)
    for split in splits:
        rows.append((file, split, inside, depth, within, level, started, open_end and split == splits[-1]))
        r = cases[split, inside]
        opened = dict(r.opened)
        if depth + r.lowest <= level:
            started = -1
        if level == 2 and 1 - depth in opened:
            within = opened[1 - depth] == ROWS_KEY
        element = opened.get(level - depth, element)
        inside, depth = r.exit_inside, depth + r.change
        if started < 0 and depth > level and within and element == "{":
            started = split
    if inside or depth + open_end != 0:
        raise ValueError(f"{file} is not whole JSON")
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])


class _Cutter:
    """Cuts the lines of one split into objects."""

    def __init__(self, file, split, inside, depth, within, level, started, open_end):
        self.file, self.split, self.inside, self.depth, self.within, self.level = file, split, inside, depth, within, level
        self.started = started if started >= 0 else None
        self.open_end = open_end
        self.held: list[str] = []

    def add(self, line: str, last: bool) -> tuple | None:
        text = line if last and self.open_end else line + "}"
        parts = _quoted(text)
        recording, begin = self.started is not None or bool(self.held), 0
        if not recording and not self.inside and self.within and self.depth == self.level and len(parts) % 2:
            plain = "".join(parts[::2])
            # An object without objects and arrays in it, the usual case: the depth stays.
            if plain.count("{") == 1 == plain.count("}") and "{" in parts[0] and "[" not in plain and "]" not in plain:
                return (self.file, None, self.split, text[text.index("{") :])
        for at, sign, named in _brackets(parts, self.inside):
            if sign in "[{":
                if self.depth == 1 and self.level == 2:
                    self.within = named
                if sign == "{" and self.depth == self.level and self.within and not recording:
                    recording, begin = True, at
                self.depth += 1
            else:
                self.depth -= 1
        self.inside ^= len(parts) % 2 == 0
        if recording:
            self.held.append(text[begin:])
            if self.depth <= self.level:
                return self.take()
        return None

    def take(self, unfinished: bool = False) -> tuple:
        started = self.started if self.started is not None or not unfinished else self.split
        row = (self.file, started, self.split, "".join(self.held))
        self.held, self.started = [], None
        return row


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of whole splits; each split's state comes first, then its lines in order."""
    cutter: _Cutter | None = None
    waiting: str | None = None

    def step(out: list, last: bool) -> None:
        if cutter is not None and waiting is not None:
            row = cutter.add(waiting, last)
            out.extend([row] if row else [])
        if last and cutter is not None and cutter.held:
            out.append(cutter.take(unfinished=True))

    for batch in batches:
        out: list[tuple] = []
        for state, line in zip(batch.column("state").to_pylist(), batch.column("value").to_pylist()):
            step(out, last=state is not None)
            cutter, waiting = (cutter, line) if state is None else (_Cutter(**state), None)
        yield _batch(out, PART_TYPES)
    out = []
    step(out, last=True)
    yield _batch(out, PART_TYPES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def split_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per split with what is open at its start."""
    sums = _lines(spark, path).drop("at").mapInArrow(_sum_up, SUMMARY)
    return sums.groupBy("file").applyInPandas(_states, STATE)


def read_json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The objects of files that are an array, or an object with an array ``readings``, as ``file`` and ``text``.

    Elements that aren't objects are left out, and so are other keys beside ``readings``; were that key to come twice,
    both arrays count. An empty file has no rows. A file that begins with anything else, or ends within a text or an
    object, is an error that names it. Signs that are not UTF-8 become replacement signs. Results are written once.
    """
    lines = _lines(spark, path)
    states = split_states(spark, path)
    whole = F.struct(*[c.split()[0] for c in STATE.split(", ")])
    rows = lines.select("file", "split", "at", "value", F.lit(None).cast(f"struct<{_typed(STATE)}>").alias("state")).unionByName(
        states.select("file", "split", F.lit(-1).cast("long").alias("at"), F.lit("").alias("value"), whole.alias("state"))
    )
    gathered = rows.repartition("file", "split").sortWithinPartitions("file", "split", "at")
    parts = write_and_reread(gathered.mapInArrow(_cut, PARTS), "json-objects")
    order = F.array_sort(F.collect_list(F.struct("split", "text")))
    crossing = (
        parts.filter("started is not null").groupBy("file", "started").agg(F.concat_ws("", order["text"]).alias("text"))
    )
    return parts.filter("started is null").select("file", "text").unionByName(crossing.select("file", "text"))


def _typed(ddl: str) -> str:
    return ", ".join(":".join(c.split()) for c in ddl.split(", "))
