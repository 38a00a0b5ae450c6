"""Tables of one row a key that are added to and merged into without being read as a whole.

Rows are dealt into buckets by the first bits of their key's hash, and sorted by it, so that each file
holds a short stretch of hashes. A manifest lists the files with their least and largest hash; beside it,
for each file, a blocked Bloom filter is kept as rows: each key sets a bit in each of the eight words of
one block. So which files may hold a key is found by two joins with tables of a few bytes a key, and only
those files are opened. Files are never changed. A new version of the manifest, one file, makes what a run
has written visible; until it is there, readers see the version before, whatever has failed.

One writer at a time. Nothing deletes what no version lists any more.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.sources.scratch import written

#: Keys for each block of 256 bits; about one key in 300 that isn't there is taken for one that may be.
BLOCK_KEYS = 16
FILE_ROWS = 1_000_000
_HASH, _BUCKET = "__hash", "__bucket"
_WORDS = [f"w{i}" for i in range(8)]
_MANIFEST = "version long, file string, run string, bucket long, rows long, low long, high long, blocks long, bits int"


def key_hash(key: Column) -> Column:
    """A 64-bit hash; null is a key of its own."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), key.isNull())


def _masks(hashed: str) -> list[Column]:
    """The bit that a key sets in each word of its block: five bits of a second hash say which."""
    return [F.expr(f"shiftleft(1, cast(shiftright(xxhash64({hashed}), {5 * i}) & 31 as int))").alias(w) for i, w in enumerate(_WORDS)]


def _block(hashed: str, blocks: str) -> Column:
    return F.expr(f"pmod(shiftrightunsigned(xxhash64({hashed}), 40), {blocks})")


class KeyedStore:
    """A table at `path`, of rows of `schema`, one for each value of the column `key`.

    `bits`: as many bits of the hash name a bucket; it is fixed by the first run. A store without any run is
    an empty table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, bits: int = 6, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.schema, self.key, self.file_rows = spark, path.rstrip("/"), schema, key, file_rows
        first = self.manifest().select("bits").first()
        self.bits = first["bits"] if first else bits

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # no run has ended yet
            return self.spark.createDataFrame([], _MANIFEST)

    def version(self) -> int:
        """The newest version; 0 before the first run."""
        return self._versions().agg(F.max("version").alias("v")).first()["v"] or 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """Rows (version, file, run, bucket, rows, low, high, blocks, bits): the files of a version."""
        return self._versions().where(F.col("version") == (self.version() if version is None else version))

    def _read(self, files: DataFrame, schema: T.StructType) -> DataFrame:
        """The rows of these files; a reader's driver lists the files it reads in any case."""
        names = [f"{self.path}/{r['file']}" for r in files.select("file").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version), self.schema)

    def _hashed(self, df: DataFrame) -> DataFrame:
        h = key_hash(F.col(self.key))
        return df.withColumns({_HASH: h, _BUCKET: F.shiftrightunsigned(h, 64 - self.bits)})

    def may_hold(self, keys: DataFrame) -> DataFrame:
        """Rows of the manifest: the files that may hold one of these keys; all that do are among them."""
        live = written(self.manifest(), "manifest")
        asked = self._hashed(keys.select(self.key)).select(_HASH, _BUCKET).distinct()
        near = asked.join(live, (F.col(_BUCKET) == F.col("bucket")) & F.col(_HASH).between(F.col("low"), F.col("high"))).select(_HASH, "file", "run", "blocks")
        runs = [r["run"] for r in live.select("run").distinct().toLocalIterator()]  # at most one for each run so far
        if not runs:
            return live
        index = self.spark.read.schema(f"file string, block long, {', '.join(f'{w} int' for w in _WORDS)}").parquet(*(f"{self.path}/index/{r}" for r in runs))
        tested = near.select("file", _block(_HASH, "blocks").alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks(_HASH)))).join(index, ["file", "block"])
        there = F.lit(True)
        for i, w in enumerate(_WORDS):
            there = there & (F.col(w).bitwiseAND(F.col(f"m{i}")) != 0)
        return live.join(tested.where(there).select("file").distinct(), "file", "left_semi")

    def missing(self, df: DataFrame) -> DataFrame:
        """Rows of df whose key isn't stored. df is read twice."""
        stored = self._read(self.may_hold(df), T.StructType([self.schema[self.key]]))
        known = stored.select(F.col(self.key).alias("__stored"))
        return df.join(known, F.col(self.key).eqNullSafe(F.col("__stored")), "left_anti")

    def _stage(self, df: DataFrame) -> DataFrame:
        """Writes rows and their filters; returns what the manifest says of them, but adds it to none."""
        run = uuid.uuid4().hex
        hashed = self._hashed(df.select(*self.schema.names))
        dealt = hashed.repartition(_BUCKET).sortWithinPartitions(_BUCKET, _HASH)
        dealt.write.partitionBy(_BUCKET).option("maxRecordsPerFile", self.file_rows).parquet(f"{self.path}/data/{run}")
        try:
            back = self.spark.read.schema(f"{_HASH} long, {_BUCKET} long").parquet(f"{self.path}/data/{run}")
        except AnalysisException:  # no row, no file
            return self.spark.createDataFrame([], _MANIFEST)
        back = back.select(F.regexp_extract("_metadata.file_path", r"(data/[0-9a-f]{32}/[^/]+/[^/]+)$", 1).alias("file"), _HASH, F.col(_BUCKET).alias("bucket"))
        counted = back.groupBy("file", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.min(_HASH).alias("low"), F.max(_HASH).alias("high"))
        listed = written(counted.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_KEYS)), "staged")
        placed = back.join(listed.select("file", "blocks"), "file").select("file", _block(_HASH, "blocks").alias("block"), *_masks(_HASH))
        placed.groupBy("file", "block").agg(*(F.bit_or(w).alias(w) for w in _WORDS)).sortWithinPartitions("file", "block").write.parquet(f"{self.path}/index/{run}")
        return listed.withColumns({"run": F.lit(run), "bits": F.lit(self.bits)})

    def _commit(self, files: DataFrame) -> int:
        """Makes these the files of the next version. One task writes them to one file, which appears at once or not at all."""
        following = self.version() + 1
        rows = files.withColumn("version", F.lit(following)).select(*(c.split()[0] for c in _MANIFEST.split(", ")))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return following

    def append(self, df: DataFrame) -> int:
        """Adds rows whose keys aren't stored, as `missing` gives them, each once; returns the new version."""
        staged = self._stage(df)
        return self._commit(self.manifest().drop("version").unionByName(staged.drop("version"), allowMissingColumns=True))

    def merge(self, df: DataFrame, order: str) -> DataFrame:
        """Adds the first row by `order` of each key that isn't stored; returns the rows that were added.

        What is stored wins. Only the buckets that get rows are read, and written anew; all other files stay as
        they are. Of equal places the smallest row is first; null is a key of its own.
        """
        every = F.struct(order, F.struct(*(F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind)))
        known = self.missing(df).select(*self.schema.names)
        first = known.groupBy(F.coalesce(F.col(self.key).cast("string"), F.lit("")).alias("__k"), F.col(self.key).isNull().alias("__none")).agg(F.min_by(F.struct(*self.schema.names), every).alias("row"))
        fresh = written(first.select("row.*"), "fresh")
        if fresh.isEmpty():
            return fresh
        live = written(self.manifest().drop("version"), "manifest")
        touched = self._hashed(fresh.select(self.key)).select(F.col(_BUCKET).alias("bucket")).distinct()  # as many as there are buckets, at most
        old = live.join(touched, "bucket", "left_semi")
        staged = self._stage(self._read(old, self.schema).unionByName(fresh))
        self._commit(live.join(touched, "bucket", "left_anti").unionByName(staged.drop("version"), allowMissingColumns=True))
        return fresh
