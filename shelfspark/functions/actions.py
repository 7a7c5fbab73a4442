"""User actions over a selection: callables from a frame to proposed changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources.versions import Versions

MAX_SELECTION = 500
CHANGES = ["id", "field", "before", "after"]

_actions: dict[str, tuple[Callable[[DataFrame], DataFrame], frozenset[str]]] = {}


def register(name: str, permissions: set[str] | None = None):
    """Name an action; permissions: the fields that it may change (rating, tags, name)."""

    def keep(f: Callable[[DataFrame], DataFrame]):
        _actions[name] = (f, frozenset(permissions or ()))
        return f

    return keep


def preview(name: str, assets: DataFrame, ids: list[str]) -> DataFrame:
    """The proposed changes (id, field, before, after); nothing is applied."""
    if len(set(ids)) > MAX_SELECTION:
        raise ValueError(f"at most {MAX_SELECTION} assets")
    f, allowed = _actions[name]
    out = f(assets.where(F.col("id").isin(ids))).select(*CHANGES)
    return out.where(F.col("field").isin(sorted(allowed)))


def apply(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """assets with the proposed ratings; names change the last part of the path."""
    new = changes.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.col("after"))).alias(f"_{f}") for f in ("rating", "name")])
    rows = assets.join(new, "id", "left")
    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = rows.withColumns({"rating": F.coalesce(F.expr("try_cast(_rating as bigint)"), "rating"), "path": F.when(F.col("_name").isNotNull(), F.concat(folder, "_name")).otherwise(F.col("path"))})
    return rows.select(*assets.columns)


class Journal:
    """Undo and redo of changes(id, before, after) to a column, kept in a folder.

    An entry's changes are written once; what was done, undone and redone is an
    append-only log in the notes of each version, from which the two stacks are
    replayed.  A new entry clears what was undone; the folders of entries that
    no stack holds any more are dropped with it.
    """

    SCHEMA = "id string, before string, after string"

    def __init__(self, spark: SparkSession, folder: str):
        self.versions = Versions(spark, folder)

    def stacks(self) -> tuple[list[int], list[int]]:
        """Entries that can be undone and redone, the next one last."""
        return self._replayed(self.versions.current()[2].get("log", []))

    @staticmethod
    def _replayed(log: list) -> tuple[list[int], list[int]]:
        done: list[int] = []
        undone: list[int] = []
        for what, n in log:
            if what == "do":
                done.append(n)
                undone.clear()
            elif what == "undo":
                done.remove(n)
                undone.append(n)
            elif what == "redo":
                undone.remove(n)
                done.append(n)
            else:  # stale
                for stack in (done, undone):
                    if n in stack:
                        stack.remove(n)
        return done, undone

    def record(self, column: str, changes: DataFrame, needs: str = "there") -> int:
        """Note a change that has been applied; needs: live, trashed or there, what its assets must be to undo or redo it."""
        change = self.versions.begin()
        log = change.notes.setdefault("log", [])
        n = max((x for _, x in log), default=0) + 1
        change.notes["log"] = log = [*log, ["do", n]]
        change.notes.setdefault("columns", {})[str(n)] = [column, needs]
        change.put(f"entry={n}", changes.select("id", F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after")))
        self._forget(change)
        change.commit()
        return n

    def _forget(self, change) -> None:
        """Drop the data of entries that are in neither stack, and what the log says of them."""
        held = {x for stack in self._replayed(change.notes["log"]) for x in stack}
        for part in [p for p in change.parts if int(p.removeprefix("entry=")) not in held]:
            change.drop(part)
        last = max(x for _, x in change.notes["log"])
        change.notes["log"] = [e for e in change.notes["log"] if e[1] in held or e[1] == last]
        change.notes["columns"] = {k: v for k, v in change.notes["columns"].items() if int(k) in held}

    def _changes(self, n: int) -> DataFrame:
        return self.versions.read(self.SCHEMA, [f"entry={n}"])

    def applicable(self, n: int, assets: DataFrame) -> bool:
        """Whether all assets of an entry are what it needs; an entry without assets is not."""
        needs = self.versions.current()[2]["columns"][str(n)][1]
        fits = {"there": F.lit(True), "live": F.col("deleted_at").isNull(), "trashed": F.col("deleted_at").isNotNull()}[needs]
        ids = self._changes(n).select("id")
        return bool(ids.take(1)) and not ids.join(assets.where(fits).select("id"), "id", "left_anti").take(1)

    def _step(self, assets: DataFrame, what: str) -> DataFrame:
        from shelfspark.operators.ingest import apply_values

        change = self.versions.begin()
        log, side = list(change.notes.get("log", [])), 0 if what == "undo" else 1
        out = assets
        while stack := self._replayed(log)[side]:
            n = stack[-1]
            if self.applicable(n, assets):
                column = change.notes["columns"][str(n)][0]
                kind = assets.schema[column].dataType
                values = self._changes(n).select("id", F.col("before").cast(kind).alias("before"), F.col("after").cast(kind).alias("after"))
                out = apply_values(assets, values, column, "before" if what == "undo" else "after")
                log.append([what, n])
                break
            log.append(["stale", n])
        if log != change.notes.get("log", []):
            change.notes["log"] = log
            self._forget(change)
            change.commit()
        return out

    def undo(self, assets: DataFrame) -> DataFrame:
        """assets with the last change undone that still can be; those that can't are dropped on the way."""
        return self._step(assets, "undo")

    def redo(self, assets: DataFrame) -> DataFrame:
        return self._step(assets, "redo")

    def prune(self, assets: DataFrame) -> int:
        """Drop all entries that can't be applied; how many."""
        change = self.versions.begin()
        stale = [n for stack in self.stacks() for n in stack if not self.applicable(n, assets)]
        if stale:
            change.notes["log"] = [*change.notes["log"], *[["stale", n] for n in stale]]
            self._forget(change)
            change.commit()
        return len(stale)
