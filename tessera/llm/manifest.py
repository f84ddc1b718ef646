"""Numbered manifests of a persisted structure: what is live is named by the one with the largest number.

A new state is written beside the old one and becomes live with one rename to a name that was free before. Nothing live is
deleted or replaced on the way, so that a job lost at any point leaves the state before or the state after, never neither.
Two writers cannot both commit the same number: the later one's rename fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/manifest"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._hadoop.Path(self.path)
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]  # two at most, as older ones are deleted
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self) -> tuple[int, dict | None]:
        """The number and content of the live manifest; (0, None) before the first."""
        numbers = self._numbers()
        if not numbers:
            return 0, None
        source = self._fs.open(self._hadoop.Path(f"{self.path}/{numbers[-1]:09d}.json"))
        try:
            data = bytes(source.readAllBytes())
        finally:
            source.close()
        return numbers[-1], json.loads(data)

    def commit(self, number: int, content: dict) -> int:
        """Make `content` live as the state after `number`, the one that it was derived from; gives its own number."""
        new = self._hadoop.Path(f"{self.path}/.new-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        target = self._hadoop.Path(f"{self.path}/{number + 1:09d}.json")
        if self._fs.exists(target) or not self._fs.rename(new, target):
            self._fs.delete(new, False)
            raise RuntimeError(f"{self.path} was changed by another writer after number {number}")
        for old in self._numbers():
            if old < number:  # the last but one stays for those that read it now
                self._fs.delete(self._hadoop.Path(f"{self.path}/{old:09d}.json"), False)
        return number + 1
