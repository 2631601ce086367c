"""Edits over a table that is never changed: a log on the driver, resolved as small tables joined by broadcast."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import functions as F

from .ordering import ID_BYTES, ID_COLUMN
from .table import ORDER, TextTable

NORMAL, ADDED, DELETED, DUPLICATED, EDITED = "Normal", "Added", "Deleted", "Duplicated", "Edited"
#: Rows of a log up to which its tables are broadcast.
BROADCAST_EDITS = 100_000
SUFFIX = ".recovery.json"


@dataclass
class Overlay:
    """Cell edits by row, row states, templates of added rows (negative numbers), and what can be undone."""

    edits: dict[int, list[tuple[int, str]]] = field(default_factory=dict)
    states: dict[int, str] = field(default_factory=dict)
    added: dict[int, list[str]] = field(default_factory=dict)
    ops: list[tuple[str, int, str]] = field(default_factory=list)  # row operations: kind, row, the state before
    next_row: int = -1
    undo_log: list[tuple[str, int]] = field(default_factory=list)  # "cell" or "row", and the row

    @property
    def is_empty(self) -> bool:
        return not (self.edits or self.states or self.added or self.ops)

    def edit(self, row: int, column: int, value: str) -> None:
        self.edits.setdefault(row, []).append((column, value))
        self.undo_log.append(("cell", row))

    def _new(self, kind: str, values: list[str]) -> int:
        row, self.next_row = self.next_row, self.next_row - 1
        self.added[row], self.states[row] = list(values), kind
        self.ops.append((kind, row, NORMAL))
        self.undo_log.append(("row", row))
        return row

    def add(self, columns: int) -> int:
        return self._new(ADDED, [""] * columns)

    def duplicate(self, resolved: list[str]) -> int:
        return self._new(DUPLICATED, resolved)

    def delete(self, *rows: int) -> None:
        """Each row's deletion can be undone by itself; a deleted row's edits stay, without effect."""
        for row in rows:
            self.ops.append((DELETED, row, self.states.get(row, NORMAL)))
            self.states[row] = DELETED
            self.undo_log.append(("row", row))

    def restore(self, row: int) -> bool:
        """Takes back the last operation on one row; False if it has none."""
        at = next((i for i in range(len(self.ops) - 1, -1, -1) if self.ops[i][1] == row), None)
        if at is None:
            return False
        last = next((i for i in range(len(self.undo_log) - 1, -1, -1) if self.undo_log[i] == ("row", row)), None)
        if last is not None:
            del self.undo_log[last]
        self._reverse(self.ops.pop(at))
        return True

    def _reverse(self, op: tuple[str, int, str]) -> None:
        kind, row, before = op
        if kind != DELETED:  # an added row goes with its edits and what could be undone of them
            self.added.pop(row, None)
            self.edits.pop(row, None)
            self.states.pop(row, None)
            self.undo_log = [x for x in self.undo_log if x[1] != row]
            self.ops = [x for x in self.ops if x[1] != row]
        elif before == NORMAL:
            self.states.pop(row, None)
        else:
            self.states[row] = before

    def undo(self) -> bool:
        """Takes back the latest edit or row operation."""
        if not self.undo_log:
            return False
        kind, row = self.undo_log.pop()
        if kind == "row":
            if self.ops:
                self._reverse(self.ops.pop())
        elif self.edits.get(row):
            self.edits[row].pop()
            if not self.edits[row]:
                del self.edits[row]
        return True

    def change(self, row: int, before: list[str], after: list[str]) -> None:
        """Edits of the fields that differ."""
        for i, (a, b) in enumerate(zip(before, after)):
            if a != b:
                self.edit(row, i, b)

    def live_added(self) -> list[int]:
        """Added rows that aren't deleted, in the order of their making."""
        return [r for r in sorted(self.added, reverse=True) if self.states.get(r) != DELETED]

    def state(self) -> dict:
        """All that can be seen; not what can be undone."""
        return {"edits": {str(k): v for k, v in self.edits.items()}, "states": {str(k): v for k, v in self.states.items()}, "added": {str(k): v for k, v in self.added.items()}, "ops": self.ops, "next_row": self.next_row}

    @classmethod
    def of(cls, state: dict) -> Overlay:
        numbered = lambda name: {int(k): v for k, v in state[name].items()}
        return cls({k: [(int(i), v) for i, v in x] for k, x in numbered("edits").items()}, numbered("states"), numbered("added"), [tuple(x) for x in state["ops"]], state["next_row"])

    def resolve(self, table: TextTable) -> TextTable:
        """Rows as they are seen: row_idx, fields, render_state, id_bytes (of the id in the file). Deleted rows are gone.

        An edit beyond a row's own length has no effect; the last of a cell holds."""
        base = table.ragged()
        spark = base.df.sparkSession
        original = table.value(ID_COLUMN)
        key = F.lit(b"") if original is None else F.substring(F.encode(base.value(ID_COLUMN), "UTF-8"), 1, ID_BYTES)
        rows = base.df.select(ORDER, "fields", F.lit(NORMAL).alias("render_state"), key.alias("id_bytes"))
        if new := [(r, self.added[r], self.states.get(r, ADDED)) for r in self.live_added()]:
            made = spark.createDataFrame(new, f"{ORDER} long, fields array<string>, render_state string")
            rows = rows.unionByName(made.withColumn("id_bytes", F.lit(b"")))
        small = F.broadcast if len(self.states) + len(self.edits) <= BROADCAST_EDITS else (lambda d: d)
        if gone := [(r,) for r, s in self.states.items() if s == DELETED]:
            rows = rows.join(small(spark.createDataFrame(gone, f"{ORDER} long")), ORDER, "left_anti")
        if self.edits:
            latest = [(r, dict(x)) for r, x in self.edits.items()]
            rows = rows.join(small(spark.createDataFrame(latest, f"{ORDER} long, edits map<int,string>")), ORDER, "left")
            done = F.transform("fields", lambda x, i: F.coalesce(F.col("edits")[i], x))
            state = F.when(F.col("edits").isNotNull() & (F.col("render_state") == NORMAL), EDITED).otherwise(F.col("render_state"))
            rows = rows.select(ORDER, F.when(F.col("edits").isNull(), F.col("fields")).otherwise(done).alias("fields"), state.alias("render_state"), "id_bytes")
        return TextTable(rows, base.names, False, table.layout, table.section)


@dataclass
class Recovery:
    """One document's edits on disk."""

    path: str
    section: int
    saved: str
    overlay: dict


def recovery_name(path: str, section: int) -> str:
    return hashlib.sha256(f"{path.upper()}\0{section}".encode()).hexdigest()[:24] + SUFFIX


def save_recovery(folder: str, path: str, section: int, overlay: Overlay) -> None:
    os.makedirs(folder, exist_ok=True)
    record = Recovery(path, section, datetime.now(UTC).isoformat(), overlay.state())
    with open(os.path.join(folder, recovery_name(path, section)), "w", encoding="utf-8") as f:
        json.dump(asdict(record), f)


def drop_recovery(folder: str, path: str, section: int) -> None:
    at = os.path.join(folder, recovery_name(path, section))
    if os.path.exists(at):
        os.remove(at)


def load_recoveries(folder: str) -> list[Recovery]:
    """All that can be read; others are passed over."""
    out = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.endswith(SUFFIX):
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    record = Recovery(**json.load(f))
                Overlay.of(record.overlay)
            except (ValueError, TypeError, KeyError, AttributeError):
                continue
            out.append(record)
    return out
