"""Tables below a folder that are replaced as a whole: every save is a new version, the newest complete one is read.

A version is complete when the last of its parts has Spark's success file, so a save that was broken off is never read, and the next
save writes over it. Two savers of the same version meet as an error of the second, not as a mix. Older versions go, but for
the one before, which a running reader may still need.

Of a part that only grows a save writes the new rows. Such a part is the rows of its last whole copy and of all versions since; a whole copy
is made again when these are many.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEPT = 2
#: Versions after which a part that only grows is written whole again.
PIECES = 64


class Versions:
    """Versions of a table, or of several tables that change together, ``parts`` being their (name, schema); those in ``grows`` only get new rows."""

    def __init__(self, spark: SparkSession, folder: str, parts: dict[str, str], grows: tuple[str, ...] = ()):
        self.spark, self.folder, self.parts, self.grows = spark, folder.rstrip("/"), parts, grows
        if list(parts)[-1] in grows:
            raise ValueError("the last part says that a version is complete; it is written whole")

    def _fs(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n))

    def found(self) -> list[tuple[int, bool]]:
        """(number, whether it is complete) of the versions in the folder that are not cleared up, ascending."""
        fs, path = self._fs()
        last = list(self.parts)[-1]
        numbers = self._numbers()
        whole = {n for n in numbers if fs.exists(path(f"{self.folder}/v={n}/{last}/_SUCCESS"))}
        return [(n, n in whole) for n in numbers if n in whole or not whole or n > min(whole)]

    def newest(self) -> int:
        """0 if there is none."""
        return max((n for n, whole in self.found() if whole), default=0)

    def _pieces(self, part: str, at: int) -> tuple[int, list[str]]:
        """(number of the last whole copy up to ``at``, or 0; the folders of a part that grows)."""
        fs, path = self._fs()
        numbers = [n for n in self._numbers() if n <= at]
        base = max((n for n in numbers if fs.exists(path(f"{self.folder}/v={n}/{part}/_SUCCESS"))), default=0)
        return base, [f"{self.folder}/v={base}/{part}"] * (base > 0) + [f"{self.folder}/v={n}/{part}+" for n in numbers if n > base]

    def load(self, part: str | None = None) -> DataFrame:
        part = part or next(iter(self.parts))
        at = self.newest()
        if not at:
            return self.spark.createDataFrame([], self.parts[part])
        paths = self._pieces(part, at)[1] if part in self.grows else [f"{self.folder}/v={at}/{part}"]
        return self.spark.read.schema(self.parts[part]).parquet(*paths)

    def save(self, **frames: DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]) -> int:
        """Write all parts as the next version; they may be made from the version before.

        A frame may be a function of what this save has written of the parts before it: called with a part's name, that returns its frame.
        """
        at = self.newest() + 1
        fs, path = self._fs()
        if at in self._numbers():
            fs.delete(path(f"{self.folder}/v={at}"), True)  # one that was broken off
        name_of = lambda p: f"{self.folder}/v={at}/{p}{'+' * (p in self.grows)}"
        written = lambda p: self.spark.read.schema(self.parts[p]).parquet(name_of(p))
        for name in self.parts:
            frame = frames[name](written) if callable(frames[name]) else frames[name]
            if name in self.grows and len(self._pieces(name, at)[1]) >= PIECES:
                old = self.load(name)
                frame.write.option("compression", "zstd").parquet(name_of(name))
                old.unionByName(written(name)).write.option("compression", "zstd").parquet(f"{self.folder}/v={at}/{name}")
            else:
                frame.write.option("compression", "zstd").parquet(name_of(name))
        oldest = at - KEPT + 1  # that is kept
        bases = {p: self._pieces(p, oldest)[0] for p in self.grows}
        for n in self._numbers():
            if n >= oldest:
                continue
            held = [p for p in self.grows if n >= bases[p]]
            if not held:
                fs.delete(path(f"{self.folder}/v={n}"), True)
                continue
            for p in self.parts:
                if p not in held:
                    for x in (p, f"{p}+"):
                        fs.delete(path(f"{self.folder}/v={n}/{x}"), True)
        return at
