"""Stages that resume: a manifest of finished stages under the hash of a plan; what is there is read, another plan's is refused."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.sources.sinks import digest
from scholia.sources.versions import Store


class OtherPlan(RuntimeError):
    """The folder holds the stages of another plan."""


class Broken(RuntimeError):
    """A stage's table is not what its manifest says."""


Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def content(rows: DataFrame) -> str:
    """One digest of all rows and their types, whatever their order."""
    found = digest(rows.withColumn("_all", F.lit(0)), "_all").first()
    return hashlib.sha256(f"{rows.schema.simpleString()}:{found['rows'] if found else 0}:{found['digest'] if found else ''}".encode()).hexdigest()


def plan_hash(inputs: dict[str, DataFrame], stages: list[str], parameters: dict) -> str:
    """What a run depends on: contents of its inputs, its stages in order, its parameters."""
    plan = {"inputs": {n: content(d) for n, d in sorted(inputs.items())}, "stages": stages, "parameters": parameters}
    return hashlib.sha256(json.dumps(plan, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Resumable:
    spark: SparkSession
    folder: str

    def run(self, source: DataFrame, stages: list[Stage], parameters: dict, inputs: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
        """The last stage's rows, and the names of the stages that this run had to do.

        A stage gets the rows of the one before, reread from its table. Its table and its line of the manifest become visible by one
        commit, so a run broken at any point leaves whole stages only. A finished stage whose table lacks rows is refused.
        """
        plan = plan_hash({"source": source, **(inputs or {})}, [n for n, _ in stages], parameters)
        store = Store(self.spark, self.folder)
        done: dict[str, tuple[str, int]] = {}
        if store.version():
            lines = store.read("manifest").collect()  # a line a stage
            if any(r["plan"] != plan for r in lines):
                raise OtherPlan(f"the stages in {self.folder} belong to plan {lines[0]['plan']}, not {plan}")
            done = {r["stage"]: (r["digest"], r["place"]) for r in lines}
        rows, did = source, []
        for place, (name, stage) in enumerate(stages):
            if name in done:
                rows = store.read(f"stage_{place}")
                if content(rows) != done[name][0]:
                    raise Broken(f"stage {name} is not as it was finished")
                continue
            made = stage(rows)
            parent = store.version()
            known = [(plan, n, p, d) for n, (d, p) in done.items()]
            table = f"{self.folder}/stages/{uuid.uuid4().hex}"
            made.write.parquet(table)
            done[name] = (content(self.spark.read.parquet(table)), place)
            lines = self.spark.createDataFrame([*known, (plan, name, place, done[name][0])], "plan string, stage string, place int, digest string")
            store.commit({"manifest": lines}, parent, adopt={f"stage_{place}": table})
            rows = store.read(f"stage_{place}")
            did.append(name)
        return rows, did
