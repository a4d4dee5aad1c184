"""Running a pipeline in stages that are kept, resumed and timed."""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from kindred.sources.files import dump_json


def stage_key(name: str, *depends) -> str:
    """Of a stage's name, what it reads, its settings and its code."""
    def plain(x):
        return inspect.getsource(x) if callable(x) or inspect.ismodule(x) else x

    return f"{name}-{hashlib.sha1(json.dumps([plain(x) for x in depends], sort_keys=True, default=str).encode()).hexdigest()[:16]}"


class Stages:
    """Stages written to ``root`` as Parquet; a stage of the same key is read, not computed. ``look_in`` are roots that are only read."""

    def __init__(self, spark: SparkSession, root: str, report: str | None = None, look_in: tuple[str, ...] = ()):
        self.spark, self.root, self.report, self.look_in = spark, root, report, look_in
        self.log: dict[str, dict] = {}

    def load(self, key: str) -> DataFrame | None:
        for r in (self.root, *self.look_in):
            try:
                return self.spark.read.parquet(f"{r}/{key}")
            except Exception:  # noqa: BLE001, S112  missing or unreadable: compute it
                continue
        return None

    @contextmanager
    def track(self, name: str):
        began = time.time()
        if os.environ.get("FAIL_AFTER") and os.environ["FAIL_AFTER"] in self.log:
            raise RuntimeError(f"asked to fail after {os.environ['FAIL_AFTER']}")
        try:
            yield
            self.log[name] = {"seconds": round(time.time() - began, 3), "ok": True}
        except BaseException as e:
            self.log[name] = {"seconds": round(time.time() - began, 3), "ok": False, "error": repr(e)[:500]}
            raise
        finally:
            if self.report:
                dump_json(self.log, self.report)

    def run(self, name: str, make: Callable[[], DataFrame], *depends, tries: int = 3) -> DataFrame:
        key = stage_key(name, *depends)
        found = self.load(key)
        if found is not None:
            self.log[name] = {"ok": True, "reused": True}
            return found
        with self.track(name):
            for n in range(tries):
                try:
                    make().write.mode("overwrite").parquet(f"{self.root}/{key}")
                    break
                except Exception:
                    if n + 1 == tries:
                        raise
        return self.spark.read.parquet(f"{self.root}/{key}")
