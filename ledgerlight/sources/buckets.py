"""Tables in hash buckets of their key, of which a batch rewrites only those that it touches.

A table is a folder:

    data/<version>-<writer>/_bucket=<b>/*.parquet     rows of one bucket, as of the version that wrote them
    edits/<version>-<writer>/*.parquet                what an upsert changed, field by field
    versions/<version>.json                           which folder holds each bucket, and what made the version

Readers take the newest version; a folder is never written to twice. A writer writes new folders for the buckets that it
touches, then publishes a version by creating its file, which fails where that version is there already: of two writers one
wins and the other has changed nothing that anyone reads. A writer that is lost before it publishes leaves folders that no version
names, which ``vacuum`` deletes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.sources import sinks

BUCKET = "_bucket"


@dataclass
class Version:
    number: int
    key: str
    buckets: int
    schema: str
    #: Folder of each bucket that has rows, by number.
    folders: dict[str, str] = field(default_factory=dict)
    #: Buckets that this version wrote.
    wrote: list[int] = field(default_factory=list)
    #: The folder of its edits.
    logged: str | None = None
    #: The newest epoch of each stream that wrote into the table.
    epochs: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has published the version that this one would have made."""


class BucketTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ versions
    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        top = self._path("versions")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or one of a number; an error where there is none."""
        found = self.versions()
        if not found or (number is not None and number not in found):
            raise FileNotFoundError(f"{self.root} has no version {'at all' if number is None else number}")
        stream = self._fs.open(self._path("versions", f"{found[-1] if number is None else number:010}.json"))
        try:
            return Version(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _publish(self, v: Version) -> None:
        """Creates the file of a version, or fails where it is there."""
        at, part = self._path("versions", f"{v.number:010}.json"), self._path("versions", f".{v.number:010}.{self.spark.sparkContext.applicationId}")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps(asdict(v)).encode()))
        finally:
            stream.close()
        # a rename onto a file that is there fails, so a version is whole or not there
        if self._fs.exists(at) or not self._fs.rename(part, at):
            self._fs.delete(part, False)
            raise Conflict(f"{self.root} has a version {v.number} of another writer")

    # ------------------------------------------------------------ rows
    def _rows(self, v: Version, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        return self._rows(v, list(v.folders.values()))

    def read_keys(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """Rows of the given keys (a frame with the key column); only their buckets are read."""
        v = self.version(number)
        return self._rows(v, [v.folders[str(b)] for b in self.touched(keys, v) if str(b) in v.folders]).join(keys.select(v.key).distinct(), v.key, "left_semi")

    def _names(self, *parts: str) -> list[str]:
        top = self._path(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(top) if s.isDirectory()] if self._fs.exists(top) else []

    def _logged(self) -> list[str]:
        """Folders of edits of published versions; of those that were vacuumed, others than the published ones are gone."""
        found = self.versions()
        named = {n: self.version(n).logged for n in found}
        folders = [(int(x.partition("-")[0]), f"edits/{x}") for x in self._names("edits")]
        return [f for n, f in folders if n <= max(found) and named.get(n, f) == f]

    def edits(self) -> DataFrame | None:
        """All edits that upserts have logged, (key, field, old_value, new_value, observed_at)."""
        folders = self._logged()
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def bucket(self, v: Version) -> Column:
        kind = next(f for f in T.StructType.fromJson(json.loads(v.schema)) if f.name == v.key).dataType
        return F.pmod(F.xxhash64(F.col(v.key).cast(kind)), F.lit(v.buckets)).cast("int")

    def touched(self, rows: DataFrame, v: Version) -> list[int]:
        """Buckets of some rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(v)).distinct().collect())

    def _write(self, rows: DataFrame, v: Version, n: int) -> dict[str, str]:
        """Writes rows by bucket, one file for each, and gives the folders of those that have any."""
        folder = f"data/{v.number:010}-{uuid.uuid4().hex[:12]}"
        rows.withColumn(BUCKET, self.bucket(v)).repartition(max(1, n), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        return {x.partition("=")[2]: f"{folder}/{x}" for x in self._names(*folder.split("/")) if x.startswith(f"{BUCKET}=")}

    # ------------------------------------------------------------ writers
    def create(self, rows: DataFrame, key: str, buckets: int = 64, epochs: dict[str, int] | None = None) -> Version:
        """The first version. Rows without a key can't be found again and are refused."""
        if self.exists():
            raise Conflict(f"{self.root} is a table already")
        v = Version(0, key, buckets, rows.schema.json(), epochs=epochs or {})
        self._refuse_keyless(rows, key)
        v.folders = self._write(rows, v, buckets)
        v.wrote = sorted(map(int, v.folders))
        self._publish(v)
        return v

    def upsert(self, batch: DataFrame, observed_at: str, *, tracked=sinks.TRACKED, epoch: tuple[str, int] | None = None) -> Version:
        """Rows of the batch replace those of their keys; edits are logged beside. Buckets without a row of the batch are neither read nor
        written. epoch: (stream, number); an epoch that the table has seen changes nothing."""
        now = self.version()
        if epoch and now.epochs.get(epoch[0], -1) >= epoch[1]:
            return now
        self._refuse_keyless(batch, now.key)
        hit = self.touched(batch, now)
        old = self._rows(now, [now.folders[str(b)] for b in hit if str(b) in now.folders])
        merged, edits = sinks.upserted(old, batch.withColumn(now.key, F.col(now.key).cast(old.schema[now.key].dataType)), now.key, observed_at, tracked)
        v = Version(now.number + 1, now.key, now.buckets, merged.schema.json(), dict(now.folders), hit, f"edits/{now.number + 1:010}-{uuid.uuid4().hex[:12]}", now.epochs | ({epoch[0]: epoch[1]} if epoch else {}))
        edits.write.parquet(f"{self.root}/{v.logged}")
        if hit:
            v.folders |= self._write(merged, v, len(hit))
        self._publish(v)
        return v

    def remove(self, keys: DataFrame) -> Version:
        """A version without the rows of some keys."""
        now = self.version()
        hit = [b for b in self.touched(keys, now) if str(b) in now.folders]
        left = self._rows(now, [now.folders[str(b)] for b in hit]).join(keys.select(F.col(now.key)).distinct(), now.key, "left_anti")
        v = Version(now.number + 1, now.key, now.buckets, now.schema, {b: f for b, f in now.folders.items() if int(b) not in hit}, hit, None, now.epochs)
        if hit:
            v.folders |= self._write(left, v, len(hit))
        self._publish(v)
        return v

    def _refuse_keyless(self, rows: DataFrame, key: str) -> None:
        if not rows.where(F.col(key).isNull()).isEmpty():
            raise ValueError(f"rows without {key} can't be kept in {self.root}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forgets all but the newest versions and deletes the folders that nothing names any more; readers of older versions must be done. Edits stay."""
        found = self.versions()
        named = {f for n in found[-keep:] for f in self.version(n).folders.values()} | set(self._logged())
        gone = []
        for top in ("data", "edits"):
            for x in self._names(top):
                # folders of a version that is still to be published stay
                if int(x.partition("-")[0]) > found[-1]:
                    continue
                inner = [f"{top}/{x}/{b}" for b in self._names(top, x)]
                gone += [f"{top}/{x}"] if not named & {f"{top}/{x}", *inner} else [f for f in inner if f not in named]
        for f in gone:
            self._fs.delete(self._path(*f.split("/")), True)
        for n in found[:-keep]:
            self._fs.delete(self._path("versions", f"{n:010}.json"), False)
        return gone
