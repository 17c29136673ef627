"""What a user's model said, kept, so that it is asked once.

Models cost money and may answer differently the second time. An answer is
kept under the hash of the hook, its version and the whole input. Questions are
asked in groups, and each group's answers are written to the store before any is
used: a run that dies loses the group at hand, and the next run asks only what
is not there. Without a store the answers of one run are written to the shared
folder, which is enough for every use within the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.operators.state import Snapshots
from tessera.plans.shared import materialize

SCHEMA = "key string, answer string, error string"
#: Answers of a group at least; a run has at most ``GROUPS`` groups.
GROUP, GROUPS = 500, 50


class Answers:
    """``ask`` adds (key, answer, error) to rows; an input that stands in several rows is asked about once."""

    def __init__(self, hook: str, version: str = "1", store: Snapshots | None = None, group: int = GROUP) -> None:
        self.hook, self.version, self.store, self.group = hook, version, store, group

    @property
    def table(self) -> str:
        return f"answers_{self.hook}"

    def _known(self, like: DataFrame) -> DataFrame:
        had = self.store.read(self.table) if self.store is not None else None
        return like.sparkSession.createDataFrame([], SCHEMA) if had is None else had

    def ask(self, rows: DataFrame, inputs: list[str], hook: Callable[[dict], str], distinct: bool = False) -> DataFrame:
        """``hook`` gets a dict of the ``inputs`` columns and returns a text. Where it
        raises, ``error`` says what and ``answer`` is null; that is not kept, so a later run asks again.

        ``distinct`` says that no input stands in two rows; without a store the
        rows then go by the hook as they come, inputs are not written, and come
        back without those that are arrays (``key`` is null)."""
        if distinct and self.store is None:
            return self._once(rows, inputs, hook)
        cells = F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})
        keyed = materialize(rows.withColumn("key", F.sha2(F.concat_ws("|", F.lit(self.hook), F.lit(self.version), cells), 256)), "asked")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                said = _said(b, inputs, hook)
                yield pd.DataFrame({"key": b["key"], "answer": [a for a, _ in said], "error": [e for _, e in said]})

        known = self._known(rows)
        new = materialize(keyed.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", *inputs), "questions")
        n = new.count()
        groups = min(GROUPS, -(-n // self.group)) if self.store is not None else min(n, 1)
        failed = []
        for i in range(groups):
            part = new.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == i)
            said = materialize(part.mapInPandas(run, SCHEMA), "answers")
            if self.store is None:
                known = known.unionByName(said)
                continue
            self.store.upsert(self.table, said.where("error is null"), "key")
            failed.append(said.where("error is not null"))
        if self.store is not None and groups:
            known = self._known(rows)
            for f in failed:
                known = known.unionByName(f)
        return keyed.join(known, "key")

    def _once(self, rows: DataFrame, inputs: list[str], hook: Callable[[dict], str]) -> DataFrame:
        keep = [f for f in rows.schema.fields if not isinstance(f.dataType, ArrayType)]
        schema = StructType([*keep, *StructType.fromDDL(SCHEMA).fields])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                said = _said(b, inputs, hook)
                yield b[[f.name for f in keep]].assign(key=None, answer=[a for a, _ in said], error=[e for _, e in said])

        return materialize(rows.mapInPandas(run, schema), "answers")


def _said(rows: pd.DataFrame, inputs: list[str], hook: Callable[[dict], str]) -> list[tuple[str | None, str | None]]:
    out = []
    for row in rows[inputs].to_dict("records"):
        try:
            out.append((hook({k: list(v) if hasattr(v, "tolist") else v for k, v in row.items()}), None))
        except Exception as e:
            out.append((None, f"{type(e).__name__}: {e}"))
    return out
