"""Tables of Parquet segments with a manifest for each version: changes cost what they touch, readers see one version whole.

A change is a new segment (rows put, ids deleted, or signed counts), sorted by key and written with bloom filters, then a manifest that names all
segments. The manifest gets its final name by a rename that fails where the name exists, so of two writers one starts
again, and a write that dies before it leaves a folder that no version names (``vacuum`` removes it). Reads merge: the last
change of a key wins, or counts add up and zeros go. Searches by key leave out segments whose key range lies elsewhere and let Parquet's
statistics and bloom filters skip the rest. ``compact`` folds segments into one; old versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class VersionedTable:
    """kind "latest": the last put or delete of a key holds. kind "sum": the columns outside the key are signed counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], kind: str = "latest"):
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind
        self.schema = StructType.fromDDL(schema)
        self.values = [f.name for f in self.schema if f.name not in key]
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    # -- versions ---------------------------------------------------------------------------------------------------

    def _at(self, name: str):
        return self._fs.makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "segments", "marks"} of a version, by default the last one; an unwritten table is version 0."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version == 0:
            return {"version": 0, "segments": [], "marks": {}}
        text = self.spark.read.text(str(self._at(f"manifests/{version:012d}.json").toString()), wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, base: dict, segments: list[dict], marks: dict) -> int:
        version = base["version"] + 1
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"manifests/{version:012d}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        out.write(json.dumps({"version": version, "segments": segments, "marks": marks}).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(draft, final, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    # -- changes ----------------------------------------------------------------------------------------------------

    def _segment(self, rows: DataFrame, deleted: bool) -> dict | None:
        """Writes rows as a segment; None if there are none."""
        name = f"segments/{uuid.uuid4().hex}"
        target = str(self._at(name).toString())
        out = rows.repartitionByRange(*self.key).sortWithinPartitions(*self.key).write
        for k in self.key:
            out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
        out.parquet(target)
        first = self.key[0]
        n, least, most = self.spark.read.schema(rows.schema).parquet(target).agg(F.count(F.lit(1)), F.min(first), F.max(first)).first()
        return {"name": name, "rows": n, "least": least, "most": most, "deleted": deleted} if n else None

    def append(self, rows: DataFrame, deleted: bool = False, mark: tuple[str, int] | None = None, tries: int = 5) -> int:
        """A version with rows put (or their keys deleted); returns its number.

        mark (name, number): a change whose number is not above the last one of that name has been made before and is left out, so a
        batch that runs again after a restart changes nothing. Nothing to change makes no version.
        """
        base = self.manifest()
        if mark and base["marks"].get(mark[0], -1) >= mark[1]:
            return base["version"]
        kept = rows.select(*self.key) if deleted else rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        if self.kind == "sum":
            kept = kept.groupBy(*self.key).agg(*[F.sum(v).alias(v) for v in self.values])
            kept = kept.filter(reduce(lambda a, b: a | b, [F.col(v) != 0 for v in self.values]))
        else:
            kept = kept.dropDuplicates(self.key)
        made = self._segment(kept, deleted)
        for _ in range(tries):
            marks = base["marks"] | ({mark[0]: mark[1]} if mark else {})
            if made is None and marks == base["marks"]:
                return base["version"]
            try:
                return self._commit(base, base["segments"] + ([made] if made else []), marks)
            except Conflict:
                base = self.manifest()
        raise Conflict("other writers were always first")

    def delete(self, keys: DataFrame, mark: tuple[str, int] | None = None) -> int:
        if self.kind == "sum":
            raise ValueError("counts are taken back by negative counts")
        return self.append(keys, True, mark)

    # -- reads ------------------------------------------------------------------------------------------------------

    def _rows(self, segments: list[dict], only=None) -> DataFrame:
        parts = []
        for seq, s in enumerate(segments):
            schema = StructType([f for f in self.schema if f.name in self.key]) if s["deleted"] else self.schema
            part = self.spark.read.schema(schema).parquet(str(self._at(s["name"]).toString()))
            part = part if only is None else only(part)
            parts.append(part.withColumns({"_seq": F.lit(seq), "_gone": F.lit(s["deleted"])}))
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumns({"_seq": F.lit(0), "_gone": F.lit(False)})
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _merged(self, rows: DataFrame, keep_gone: bool = False) -> DataFrame:
        if self.kind == "sum":
            total = rows.groupBy(*self.key).agg(*[F.sum(v).alias(v) for v in self.values])
            return total.filter(reduce(lambda a, b: a | b, [F.col(v) != 0 for v in self.values])).select(*self.schema.names)
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct("_gone", *self.values), "_seq").alias("r"))
        last = last.select(*self.key, "r.*")
        return last if keep_gone else last.filter(~F.col("_gone")).select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        segments = self.manifest(version)["segments"]
        if len(segments) == 1 and not segments[0]["deleted"]:
            return self._rows(segments).select(*self.schema.names)  # nothing to merge
        return self._merged(self._rows(segments))

    def touching(self, values: list, version: int | None = None) -> list[dict]:
        """The segments whose range of the first key column may hold one of values."""
        some = [v for v in values if v is not None]
        return [s for s in self.manifest(version)["segments"] if s["least"] is None or any(s["least"] <= v <= s["most"] for v in some)]

    def look_up(self, values: list, version: int | None = None) -> DataFrame:
        """Rows whose first key column is one of a few values; other segments, row groups and pages are not read."""
        return self._merged(self._rows(self.touching(values, version), lambda part: part.filter(F.col(self.key[0]).isin(values))))

    def of_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the keys in a table of any size: only they are merged."""
        asked = keys.select(self.key[0]).distinct()
        return self._merged(self._rows(self.manifest(version)["segments"], lambda part: part.join(asked, self.key[0], "left_semi")))

    # -- upkeep -----------------------------------------------------------------------------------------------------

    def compact(self, most: int = 1) -> int:
        """Folds segments into one when there are more than most. The first may be left as it is: if the later ones hold less than half of its
        rows, only they are folded, and what they delete stays noted."""
        base = self.manifest()
        segments = base["segments"]
        if len(segments) <= most:
            return base["version"]
        later = sum(s["rows"] for s in segments[1:])
        if self.kind == "latest" and len(segments) > 2 and 2 * later < segments[0]["rows"]:
            rows = self._merged(self._rows(segments[1:]), keep_gone=True)
            made = [self._segment(rows.filter(~F.col("_gone")).select(*self.schema.names), False), self._segment(rows.filter("_gone").select(*self.key), True)]
            new = [segments[0], *[m for m in made if m]]
            if len(new) >= len(segments):
                return base["version"]
        else:
            made = self._segment(self._merged(self._rows(segments)), False)
            new = [made] if made else []
        return self._commit(base, new, base["marks"])  # a writer that came first wins; fold again later

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last keep versions and the folders that none of those names; returns how many folders went.

        Not to be run beside a writer, whose segment no version names yet.
        """
        kept = self.versions()[-keep:]
        live = {s["name"].split("/")[1] for v in kept for s in self.manifest(v)["segments"]}
        for v in self.versions()[:-keep]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        gone = [n for n in self._names("segments") if n not in live]
        for n in gone:
            self._fs.delete(self._at(f"segments/{n}"), True)
        for n in self._names("drafts"):
            self._fs.delete(self._at(f"drafts/{n}"), False)
        return len(gone)


class VectorStore:
    """Texts and their embeddings by content hash: what is known is not embedded again, ids can be deleted and come back."""

    SCHEMA = "hash_id string, content string, embedding array<double>"

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, self.SCHEMA, ["hash_id"])

    def insert(self, texts: DataFrame, embed, mark: tuple[str, int] | None = None) -> int:
        """Adds texts (hash_id, content) that the store lacks; embed: (hash_id, content) -> (hash_id, content, embedding)."""
        new = texts.select("hash_id", "content").dropDuplicates(["hash_id"])
        known = self.table.of_keys(new).select("hash_id")
        return self.table.append(embed(new.join(known, "hash_id", "left_anti")), mark=mark)

    def replace(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Puts rows (hash_id, content, embedding) whether or not the store has them."""
        return self.table.append(rows, mark=mark)

    def delete(self, ids: DataFrame, mark: tuple[str, int] | None = None) -> int:
        return self.table.delete(ids, mark)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def rows(self, ids: list[str]) -> DataFrame:
        return self.table.look_up(ids)
