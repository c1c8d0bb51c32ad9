"""Alerts from verdicts: severity, wording, folding of repeats, status and feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.functions.alerts import alert_message, severity
from stratusqc.session import write_and_reread

KEY = ["station_id", "variable"]
SPAN_SECONDS = 86400


def add_severity(qc: DataFrame) -> DataFrame:
    return qc.withColumn("severity", severity(F.col("verdict"), F.col("confidence"), F.col("reason_code")))


def add_message(qc: DataFrame, stations: DataFrame) -> DataFrame:
    """Readable text for rows with ``severity``; needs the explanation columns of merged verdicts."""
    names = stations.select("station_id", "station_code", F.col("name").alias("station_name"))
    text = alert_message(
        *[
            F.col(c)
            for c in (
                "severity", "station_name", "station_code", "variable", "reason_code", "confidence", "value",
                "persistence_max", "flat_value", "delta", "spatial_delta", "z_score", "ml_score",
            )
        ]
    )
    return qc.join(names, "station_id").withColumn("message", text)


def _sorted_groups(
    frames: Iterator[pd.DataFrame], keys: Sequence[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """Hand key-sorted batches to ``fn`` with the positions where groups start.

    Only whole groups are handed on: the last one of a batch waits for the next batch.
    """
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        if held:
            frame = pd.concat([*held, frame], ignore_index=True)
        starts = _group_starts(frame, keys)
        held = [frame.iloc[starts[-1] :]]
        if len(starts) > 1:
            yield fn(frame.iloc[: starts[-1]], starts[:-1])
    if held:
        yield fn(held[0], np.array([0]))


def _group_starts(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    changed = np.zeros(len(frame), dtype=bool)
    for k in keys:
        values = frame[k].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(changed)])


def _by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn, schema: str) -> DataFrame:
    keys = list(keys)
    return (
        df.repartition(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(lambda frames: _sorted_groups(frames, keys, fn), schema)
    )


def _links(frame: pd.DataFrame, starts: np.ndarray, span_micros: int, cooldown: int) -> np.ndarray:
    """Per row the position of the first later row that an alert raised here would not fold in.

    All groups at once: times are taken from the start of their span, and every group is moved
    so far along the axis that no cooldown reaches from one into the next.
    """
    group = np.zeros(len(frame), dtype=np.int64)
    group[starts[1:]] = 1
    offset = frame["at"].to_numpy() - frame["span"].to_numpy() * span_micros
    axis = offset + np.cumsum(group) * (span_micros + 2 * cooldown + 1)
    return np.searchsorted(axis, axis + cooldown, side="right")


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


#: What a stretch of time does to the chain of alerts: if the standing alert blocks until x, the alert that stands
#: at its end is the one at the first start_at above x; if there is none, the standing alert stays.
EFFECT = "start_at array<bigint>, last_at array<bigint>, last_id array<bigint>"
#: Stretches of one level that make one of the next.
FAN = 8


def _shortened(start: np.ndarray, at: np.ndarray, ids: np.ndarray, edge: int) -> tuple:
    """The effect without steps that cannot be told apart: beyond ``edge`` nothing blocks, and chains that met are one."""
    n = min(len(start), int(np.searchsorted(start, edge, side="right")) + 1)
    start, at, ids = start[:n], at[:n], ids[:n]
    ends = np.append((at[1:] != at[:-1]) | (ids[1:] != ids[:-1]), True)
    return start[ends], at[ends], ids[ends]


def _effects(frame: pd.DataFrame, starts: np.ndarray, level: str, effects: list[tuple]) -> pd.DataFrame:
    out = frame.iloc[starts][[*KEY, level]].reset_index(drop=True)
    for name, values in zip(("start_at", "last_at", "last_id"), zip(*effects)):
        out[name] = list(values)
    return out


def _span_effect(cooldown: int, span_micros: int):
    """The effect of a span, from its candidates."""

    def summarize(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n, sizes = len(frame), _sizes(starts, len(frame))
        ends = np.repeat(starts + sizes, sizes)
        links = _links(frame, starts, span_micros, cooldown)
        # Links are followed to the last alert of the span, twice as far in every round.
        last = np.where(links < ends, links, np.arange(n))
        while not np.array_equal(further := last[last], last):
            last = further
        at, ids = frame["at"].to_numpy(), frame["qc_id"].to_numpy()
        edges = frame["span"].to_numpy()[starts] * span_micros + cooldown
        effects = [
            _shortened(at[a : a + k], at[last[a : a + k]], ids[last[a : a + k]], edge)
            for a, k, edge in zip(starts.tolist(), sizes.tolist(), edges.tolist())
        ]
        return _effects(frame, starts, "span", effects)

    return summarize


def _joint_effect(cooldown: int, micros: int):
    """The effect of neighbouring stretches, one after the other; ``micros``: length of the joint stretch."""

    def compose(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        columns = [frame[c].tolist() for c in ("start_at", "last_at", "last_id")]
        effects = []
        for a, k in zip(starts.tolist(), _sizes(starts, len(frame)).tolist()):
            edge = int(frame["stretch"].iloc[a]) * micros + cooldown
            start, at, ids = (np.asarray(c[a]) for c in columns)
            for i in range(a + 1, a + k):
                then, then_at, then_id = (np.asarray(c[i]) for c in columns)
                entry = np.searchsorted(then, at + cooldown, side="right")
                met = entry < len(then)
                step = np.minimum(entry, len(then) - 1)
                at, ids = np.where(met, then_at[step], at), np.where(met, then_id[step], ids)
                start, at, ids = _shortened(
                    np.concatenate([start, then]), np.concatenate([at, then_at]), np.concatenate([ids, then_id]), edge
                )
            effects.append((start, at, ids))
        return _effects(frame, starts, "stretch", effects)

    return compose


def _standing_at_start(cooldown: int):
    """The alert that stands when each stretch begins; the one at the start of the group comes as its first row."""

    def walk(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        rows, first = [], set(starts.tolist())
        for i, r in enumerate(frame.itertuples(index=False)):
            if i in first:
                standing = None
            if r.start_at is None:
                standing = (int(r.at), int(r.qc_id))
                continue
            if standing is not None:
                rows.append((r.station_id, r.variable, r.part, *standing))
            entry = 0 if standing is None else int(np.searchsorted(r.start_at, standing[0] + cooldown, side="right"))
            if entry < len(r.start_at):
                standing = (int(r.last_at[entry]), int(r.last_id[entry]))
        return pd.DataFrame(rows, columns=[*KEY, "part", "at", "qc_id"])

    return walk


def _assign_alerts(cooldown: int, span_micros: int):
    """Give every candidate of a span the alert it raises or folds into."""

    def assign(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n, sizes = len(frame), _sizes(starts, len(frame))
        links = _links(frame, starts, span_micros, cooldown)
        # The first row of a span is an alert, and so is what the links from an alert lead to.
        jump = np.append(np.where(links < np.repeat(starts + sizes, sizes), links, n), n)
        raised = np.zeros(n + 1, dtype=bool)
        raised[starts] = True
        while (jump[:n] < n).any():
            raised[jump[raised]] = True
            jump = jump[jump]
        owner = np.maximum.accumulate(np.where(raised[:n], np.arange(n), 0))
        out = frame[[*KEY, "span", "at", "qc_id", "severity"]].copy()
        out["alert_id"], out["alert_at"] = frame["qc_id"].to_numpy()[owner], frame["at"].to_numpy()[owner]
        return out[~frame["entering"].to_numpy(dtype=bool)]

    return assign


def span_effects(candidates: DataFrame, cooldown_minutes: int = 60, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """What each span of a key does to the chain of alerts; as many steps as chains that have not met by its end."""
    micros = span_seconds * 1_000_000
    rows = _in_spans(candidates, span_seconds).drop("severity")
    return _by_group(
        rows, [*KEY, "span"], ["at", "qc_id"], _span_effect(cooldown_minutes * 60_000_000, micros), f"{_key(candidates)}, span bigint, {EFFECT}"
    )


def joint_effects(effects: DataFrame, cooldown_minutes: int, micros: int) -> DataFrame:
    """Effects of ``FAN`` stretches in a row as one, numbered by ``stretch``; ``micros``: length of the joint one."""
    grouped = effects.withColumnRenamed("stretch", "part").withColumn("stretch", F.floor(F.col("part") / FAN))
    return _by_group(
        grouped, [*KEY, "stretch"], ["part"], _joint_effect(cooldown_minutes * 60_000_000, micros), f"{_key(effects)}, stretch bigint, {EFFECT}"
    )


def _in_spans(candidates: DataFrame, span_seconds: int) -> DataFrame:
    at, length = F.unix_micros("created_at"), F.lit(span_seconds * 1_000_000)
    span = ((at - F.pmod(at, length)) / length).cast("bigint").alias("span")
    return candidates.select(*KEY, span, at.alias("at"), "qc_id", "severity")


def _key(df: DataFrame) -> str:
    return f"station_id {df.schema['station_id'].dataType.simpleString()}, variable string"


def _entering(levels: list[DataFrame], cooldown: int, key: str) -> DataFrame:
    """The alert that stands when a span begins, from the longest stretches down to the spans."""
    standing = None
    for effects in reversed(levels):
        named = effects.withColumnRenamed("stretch", "part")
        rows = named.withColumns(
            {
                "stretch": F.lit(0).cast("bigint") if standing is None else F.floor(F.col("part") / FAN),
                "turn": F.lit(1),
                "at": F.lit(None).cast("bigint"),
                "qc_id": F.lit(None).cast("bigint"),
            }
        )
        if standing is not None:
            first = standing.withColumnRenamed("part", "stretch").withColumns({"part": F.lit(0).cast("bigint"), "turn": F.lit(0)})
            rows = rows.unionByName(first, allowMissingColumns=True)
        standing = _by_group(
            rows, [*KEY, "stretch"], ["turn", "part"], _standing_at_start(cooldown), f"{key}, part bigint, at bigint, qc_id bigint"
        )
    return standing


def debounce_alerts(
    candidates: DataFrame, cooldown_minutes: int = 60, span_seconds: int = SPAN_SECONDS
) -> DataFrame:
    """Fold candidates into the alert raised at most ``cooldown_minutes`` earlier.

    Per (station, variable): a candidate later than that raises a new alert. An alert takes the
    newest folded verdict and, if it was lower, the first high or critical severity among them.

    The chain is anchored at each alert's own creation, so it is sequential. It is cut into spans of
    time, and what a span does to the chain is a function of the alert that stands when it begins.
    These functions are put together ``FAN`` at a time, level by level, until a key has few left; then the
    standing alert is handed down again. Functions are short where chains have met, which they do within
    a few cooldowns unless candidates come at exact intervals. A task holds the candidates of one span,
    or the functions of ``FAN`` stretches of one key.

    ``candidates``: qc_id, station_id, variable, severity, created_at. The functions are written out.
    """
    cooldown, span_micros, key = cooldown_minutes * 60_000_000, span_seconds * 1_000_000, _key(candidates)
    rows = _in_spans(candidates, span_seconds)
    effects = span_effects(candidates, cooldown_minutes, span_seconds).withColumnRenamed("span", "stretch")
    levels = [write_and_reread(effects, "span-effects")]
    low, high = levels[0].agg(F.min("stretch"), F.max("stretch")).first()
    micros = span_micros
    while low is not None and high - low > FAN:
        low, high, micros = low // FAN, high // FAN, micros * FAN
        levels.append(write_and_reread(joint_effects(levels[-1], cooldown_minutes, micros), "joint-effects"))
    standing = _entering(levels, cooldown, key).withColumnRenamed("part", "span")
    reaching = standing.filter(F.col("at") + cooldown >= F.col("span") * span_micros)
    entering = reaching.withColumn("severity", F.lit(None).cast("string")).withColumn("entering", F.lit(True))
    assigned = _by_group(
        rows.withColumn("entering", F.lit(False)).unionByName(entering), [*KEY, "span"], ["at", "qc_id"],
        _assign_alerts(cooldown, span_micros),
        f"{key}, span bigint, at bigint, qc_id bigint, severity string, alert_id bigint, alert_at bigint",
    )
    when, grave = F.struct("at", "qc_id"), F.col("severity").isin("high", "critical")
    first_grave = F.min_by(F.when(grave, F.col("severity")), F.when(grave, when))
    return (
        assigned.groupBy(*KEY, "alert_id", "alert_at")
        .agg(
            F.max_by("qc_id", when).alias("last_qc_id"),
            F.min_by("severity", when).alias("_first"),
            first_grave.alias("_grave"),
            F.count(F.lit(1)).alias("n_folded"),
        )
        .select(
            "alert_id",
            *KEY,
            F.timestamp_micros("alert_at").alias("first_ts"),
            "last_qc_id",
            F.coalesce("_grave", "_first").alias("severity"),
            "n_folded",
        )
    )


def alert_table(qc: DataFrame, stations: DataFrame, cooldown_minutes: int = 60) -> DataFrame:
    """Alerts with the wording of the verdict that raised them; all start open.

    The flagged verdicts are written out first: the fold reads them more than once.
    """
    flagged = write_and_reread(add_severity(qc).filter(F.col("severity").isNotNull()), "flagged")
    alerts = debounce_alerts(flagged, cooldown_minutes)
    wording = add_message(flagged, stations).select(F.col("qc_id").alias("alert_id"), "message")
    return alerts.join(wording, "alert_id").select(
        "alert_id",
        "station_id",
        "variable",
        F.col("last_qc_id").alias("qc_result_id"),
        "severity",
        F.lit("open").alias("status"),
        "message",
        F.col("first_ts").alias("created_at"),
        "n_folded",
    )


def apply_status(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Newest status change wins; ``events``: alert_id, new_status, event_ts. Resolving stamps resolved_at."""
    newest = events.groupBy("alert_id").agg(
        F.max_by("new_status", "event_ts").alias("_status"),
        F.max(F.when(F.col("new_status") == "resolved", F.col("event_ts"))).alias("_resolved"),
    )
    return (
        alerts.join(newest, "alert_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("resolved_at", F.coalesce("_resolved", "resolved_at"))
        .drop("_status", "_resolved")
    )


def apply_feedback(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Confirmed faults acknowledge open alerts, false alarms resolve any alert.

    All entries count, in order: a false alarm anywhere leaves the alert resolved, since a later
    confirmation only touches open alerts.
    """
    per_alert = feedback.groupBy("qc_result_id").agg(
        F.max(F.when(F.col("label") == "false_alarm", F.col("created_at"))).alias("_cleared"),
        F.count_if(F.col("label") == "confirmed_fault").alias("_confirmed"),
    )
    cleared = F.col("_cleared").isNotNull()
    return (
        alerts.join(per_alert, "qc_result_id", "left")
        .withColumn(
            "status",
            F.when(cleared, "resolved")
            .when((F.col("status") == "open") & (F.col("_confirmed") > 0), "acknowledged")
            .otherwise(F.col("status")),
        )
        .withColumn("resolved_at", F.coalesce("_cleared", "resolved_at"))
        .drop("_cleared", "_confirmed")
    )


def open_alert_within_cooldown(candidates: DataFrame, alerts: DataFrame, cooldown_minutes: int = 60) -> DataFrame:
    """Candidates with the earliest open alert of their station and variable raised within the cooldown before.

    No candidate is paired with all alerts near it. Both are laid on one time axis, candidates a
    cooldown earlier than they happened, and the alert wanted is simply the next one on the axis.
    The axis is cut into slices of one cooldown; alerts also appear in the slice before their own,
    since a candidate's alert lies at most one slice ahead.
    """
    cooldown = cooldown_minutes * 60_000_000
    slice_of = lambda at: F.floor(at / F.lit(cooldown)).cast("bigint")
    opened = F.unix_micros("created_at")
    raised = (
        alerts.filter(F.col("status") == "open")
        .select(*KEY, opened.alias("at"), "alert_id", F.lit(None).cast("bigint").alias("qc_id"))
        .withColumn("slice", F.explode(F.array(slice_of(F.col("at")), slice_of(F.col("at")) - 1)))
    )
    asking = candidates.select(
        *KEY, (opened - cooldown).alias("at"), F.lit(None).cast("bigint").alias("alert_id"), "qc_id"
    ).withColumn("slice", slice_of(F.col("at")))
    # Walking backwards in time, alerts before candidates at the same instant, low ids last.
    backwards = Window.partitionBy(*KEY, "slice").orderBy(
        F.col("at").desc(), F.col("alert_id").desc_nulls_last(), "qc_id"
    ).rowsBetween(Window.unboundedPreceding, 0)
    alert = F.when(F.col("alert_id").isNotNull(), F.struct("at", "alert_id"))
    return (
        raised.unionByName(asking)
        .withColumn("_next", F.last(alert, ignorenulls=True).over(backwards))
        .filter(F.col("qc_id").isNotNull() & (F.col("_next.at") <= F.col("at") + cooldown))
        .select("qc_id", F.col("_next.alert_id").alias("alert_id"))
    )
