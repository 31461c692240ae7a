"""Several season tables that change together.

Each update writes the seasons it touches into new folders ``{table}/version=N/season=S`` and then publishes one small
manifest, which says for each table and season the version to read. Publishing is the creation of a file that must not exist:
readers see all tables of one version or of the one before, a failure before it leaves the old version in place (with
folders that nothing names), and of two writers that started from the same version one gets an error. Rows of untouched
seasons are neither read nor written.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from priorwise.sources.tables import _exists


class VersionConflict(RuntimeError):
    """Another writer published the version first."""


class SeasonTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, rising."""
        path, fs = self._path(f"{self.root}/manifests")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, dict[str, int]]:
        """Table -> season -> version of its rows; empty before the first version. ``version``: an earlier one."""
        known = self.versions()
        if version is None and not known:
            return {}
        if version is not None and version not in known:
            raise ValueError(f"no version {version} under {self.root}")
        version = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:08d}.json", wholetext=True).first()["value"])

    def publish(self, version: int, manifest: Mapping[str, Mapping[str, int]]) -> None:
        path, fs = self._path(f"{self.root}/manifests/{version:08d}.json")
        text = json.dumps(manifest, sort_keys=True).encode()
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise VersionConflict(f"version {version} of {self.root} exists already") from e
            raise
        try:
            out.write(text, 0, len(text))
        finally:
            out.close()

    def commit(self, changes: Mapping[str, DataFrame], season_col: str = "season") -> int:
        """Replace the seasons that each frame holds, in all tables at once; the version published.

        A season that a frame has no rows of keeps its version. Nothing changes unless all frames could be written.
        """
        version = max(self.versions(), default=0) + 1
        manifest = self.manifest()
        for name, df in changes.items():
            folder = f"{self.root}/{name}/version={version}"
            # a commit that failed may have left rows here: each attempt starts anew
            df.hint("rebalance", season_col).write.mode("overwrite").option("partitionOverwriteMode", "static") \
                .partitionBy(season_col).parquet(folder)
            path, fs = self._path(folder)
            seasons = [f.getPath().getName().partition("=")[2] for f in fs.listStatus(path) if f.isDirectory() and "=" in f.getPath().getName()]
            manifest[name] = {**manifest.get(name, {}), **{s: version for s in seasons}}
        self.publish(version, manifest)
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """Rows of a table as of a version (the last one by default); None if it has no seasons. Filters on the season prune folders."""
        seasons = self.manifest(version).get(name)
        if not seasons:
            return None
        paths = [f"{self.root}/{name}/version={v}/season={s}" for s, v in sorted(seasons.items())]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths).drop("version")

    def drop_unnamed(self, keep: int = 2) -> list[str]:
        """Delete version folders that none of the last ``keep`` manifests names, and the manifests before those; the folders' paths.

        Only for a time without writers: a commit under way has folders that no manifest names yet.
        """
        known = self.versions()
        named = {(t, v) for version in known[-keep:] for t, seasons in self.manifest(version).items() for v in seasons.values()}
        gone = []
        for table in {t for version in known for t in self.manifest(version)}:
            path, fs = self._path(f"{self.root}/{table}")
            for f in fs.listStatus(path) if _exists(self.spark, f"{self.root}/{table}") else []:
                if (table, int(f.getPath().getName().partition("=")[2])) not in named:
                    fs.delete(f.getPath(), True)
                    gone.append(f.getPath().toString())
        for version in known[:-keep]:
            path, fs = self._path(f"{self.root}/manifests/{version:08d}.json")
            fs.delete(path, False)
        return sorted(gone)
