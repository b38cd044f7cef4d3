"""Labels of annotation sessions whose actions arrive in any order.

State is kept per session, as the mode (which class a click gives) is the session's. Actions are held by number until the session
has got ``lateness`` numbers further; then they are settled into labels and undo histories and forgotten. With every batch
the held actions are replayed on top of what is settled, and the labels that differ from those shown before are emitted.
So within ``lateness`` any order of arrival shows in the end what a replay in order gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CHANGES = "session_id long, image_id int, region_id int, cls int, version long, late boolean"
STATE = "mode int, settled long, newest long, version long, labels array<long>, undo array<long>, held array<long>, shown array<long>"
ACTIONS = ("mode0", "mode1", "click", "undo", "clear")
#: How many numbers an action may be overtaken by.
LATENESS = 1_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Session:
    """Mode, labels ``{(image, region): class}`` and undo histories ``{image: [(region, class before or -1)]}`` of one session."""

    def __init__(self, mode: int, labels: list[int], undo: list[int]):
        self.mode = mode
        self.labels = {(i, r): c for i, r, c in zip(labels[::3], labels[1::3], labels[2::3], strict=True)}
        self.undo: dict[int, list[tuple[int, int]]] = {}
        for i, r, c in zip(undo[::3], undo[1::3], undo[2::3], strict=True):
            self.undo.setdefault(i, []).append((r, c))

    def flat(self) -> tuple[int, list[int], list[int]]:
        return self.mode, [x for (i, r), c in self.labels.items() for x in (i, r, c)], [x for i, s in self.undo.items() for r, c in s for x in (i, r, c)]

    def act(self, image: int, action: str, region: int) -> None:
        if action in ("mode0", "mode1"):
            self.mode = int(action[-1])
        elif action == "click" and region > 0:
            self.undo.setdefault(image, []).append((region, self.labels.get((image, region), -1)))
            self.labels[image, region] = self.mode
        elif action == "undo" and self.undo.get(image):
            region, before = self.undo[image].pop()
            if before < 0:
                self.labels.pop((image, region), None)
            else:
                self.labels[image, region] = before
        elif action == "clear":
            self.undo.pop(image, None)
            self.labels = {k: c for k, c in self.labels.items() if k[0] != image}


class Annotations(StatefulProcessor):
    """Ordered replay of each session; ``ttl_ms``: state of a session that has been still for so long is dropped."""

    def __init__(self, lateness: int, ttl_ms: int | None):
        self.lateness, self.ttl_ms = lateness, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE, ttlDurationMs=self.ttl_ms) if self.ttl_ms else handle.getValueState("session", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.state.get() if self.state.exists() else None
        mode, settled, newest, version, labels, undo, held, shown = tuple(found) if found else (1, -(1 << 62), -(1 << 62), 0, [], [], [], [])
        waiting = {s: (i, a, r) for s, i, a, r in zip(held[::4], held[1::4], held[2::4], held[3::4], strict=True)}
        out = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.seq <= settled:
                    out.append((key[0], r.image_id, r.region_id, -1, version, True))
                elif r.seq not in waiting:
                    waiting[int(r.seq)] = (int(r.image_id), ACTIONS.index(r.action), int(r.region_id))
                    newest = max(newest, int(r.seq))
        base, order = Session(mode, list(labels), list(undo)), sorted(waiting)
        ripe = [s for s in order if s <= newest - self.lateness]
        for s in ripe:
            i, a, region = waiting.pop(s)
            base.act(i, ACTIONS[a], region)
            settled = s
        keep = base.flat()
        now = Session(*keep)
        for s in order[len(ripe) :]:
            i, a, region = waiting[s]
            now.act(i, ACTIONS[a], region)
        before = {(i, r): c for i, r, c in zip(shown[::3], shown[1::3], shown[2::3], strict=True)}
        changed = {k: now.labels.get(k, -1) for k in before.keys() | now.labels.keys() if before.get(k, -1) != now.labels.get(k, -1)}
        version += 1
        out += [(key[0], *k, c, version, False) for k, c in sorted(changed.items())]
        self.state.update((keep[0], settled, newest, version, keep[1], keep[2], [x for s, v in waiting.items() for x in (s, *v)], [x for k, c in now.labels.items() for x in (*k, c)]))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "image_id", "region_id", "cls", "version", "late"]).astype({"version": "int64", "late": bool})

    def close(self) -> None:
        pass


def label_changes(actions: DataFrame, lateness: int = LATENESS, ttl_ms: int | None = None) -> DataFrame:
    """Stream of CHANGES from the stream ``actions(session_id, seq, image_id, action, region_id)``; -1 for a label taken back.

    Actions as in ``annotation_replay``; others are left out, and so are rows with a null session, number or action; a null image or region is 0. A number that comes
    again is ignored while it is held. An action that comes after its number was settled changes nothing and is reported as ``late``. State is ``lateness`` actions, and the session's labels and undo history.
    """
    rows = actions.where(F.col("action").isin(*ACTIONS) & F.col("session_id").isNotNull() & F.col("seq").isNotNull())
    rows = rows.select("session_id", "seq", F.coalesce(F.col("image_id").cast("int"), F.lit(0)).alias("image_id"), "action", F.coalesce(F.col("region_id").cast("int"), F.lit(0)).alias("region_id"))
    return rows.groupBy("session_id").transformWithStateInPandas(Annotations(lateness, ttl_ms), CHANGES, "Append", "ProcessingTime" if ttl_ms else "None")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The state store that holds state on disk and in the checkpoint, for queries that start inside; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_annotations(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, lateness: int = LATENESS, ttl_ms: int | None = None, files_per_batch: int = 1_000) -> StreamingQuery:
    """``label_changes`` of actions that arrive as Parquet files, appended as Parquet; runs until all are done."""
    actions = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    with state_on_disk(spark):
        return label_changes(actions, lateness, ttl_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_labels(changes: DataFrame) -> DataFrame:
    """The labels that stand after all changes."""
    last = changes.where("NOT late").groupBy("session_id", "image_id", "region_id").agg(F.max_by("cls", "version").alias("cls"))
    return last.where("cls >= 0")
