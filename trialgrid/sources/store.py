"""A table of current rows by key (S8): bucketed upserts, published one manifest at a time.

Rows lie in `n_buckets` buckets by the hash of their key. A commit rewrites
the buckets that its rows fall into, in a folder of its own, and then
publishes a manifest that names, for every bucket, the folder it lies in now.
The manifest is written aside and moved into place in one step that fails when
the version is taken, so readers see the state before a commit or after it,
a commit that dies leaves the state as it was, and of two writers that start
from the same version one has to try again.

The number of buckets follows the rows: a commit that would leave more than
BUCKET_ROWS rows to a bucket on average writes all rows into more of them. So
a bucket's size is bounded, what a commit reads and writes depends on its own
rows, and the growing costs a constant factor over all commits.

A bucket is told by the hash that Spark deals rows by. Grown stores have a
multiple of the session's shuffle partitions: what `merge` has dealt by the key
lies in whole buckets then, and is written without being dealt again.

A commit of many rows works through its buckets in up to `SLICES` lots, one
after the other, if its rows say which slice they belong to (see `sliced`): what
is shuffled and sorted at a time, and lies on the executors' disks, is one lot.

A manifest may carry a writer's token (stream and epoch): a commit that is
repeated with a token that is already there changes nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialgrid.session import tidied_shuffles

BUCKET = "_bucket"
SLICE = "_slice"
SLICES = 16
#: Rows of a lot, at least.
LOT_ROWS = 1 << 22
DEFAULT_BUCKETS = 16
BUCKET_ROWS = 1 << 16
KEPT_VERSIONS = 2
HASH = "murmur3"
OLD_HASH = "xxhash64"


class CommitConflict(RuntimeError):
    """Another commit published this version first."""


def _files(spark: SparkSession, path: str):
    """(file context, file system, Path class) of `path`'s own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf), fs, jvm.org.apache.hadoop.fs.Path


def _manifest_dir(path: str) -> str:
    return f"{path.rstrip('/')}/manifests"


def _versions(spark: SparkSession, path: str) -> list[int]:
    _, fs, Path = _files(spark, path)
    found = fs.globStatus(Path(_manifest_dir(path), "*.json")) or []
    return sorted(int(s.getPath().getName()[:-len(".json")]) for s in found)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The last published manifest under `path`; None while there is none."""
    versions = _versions(spark, path)
    return _read_manifest(spark, path, versions[-1]) if versions else None


def _read_manifest(spark: SparkSession, path: str, version: int) -> dict:
    _, fs, Path = _files(spark, path)
    stream = fs.open(Path(_manifest_dir(path), f"{version:012d}.json"))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Put `manifest` in place as its version, or raise `CommitConflict`."""
    context, fs, Path = _files(spark, path)
    aside = Path(_manifest_dir(path), f".{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    no_options = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(aside, Path(_manifest_dir(path), f"{manifest['version']:012d}.json"), no_options)
    except Exception as taken:
        fs.delete(aside, False)
        raise CommitConflict(f"version {manifest['version']} of {path} was published by another commit") from taken


def _bucket_of(key: list[str], n_buckets: int, hashed: str = HASH):
    """`hashed` is "xxhash64" for the buckets of a manifest that doesn't name its hash."""
    return F.pmod((F.hash if hashed == HASH else F.xxhash64)(*key), F.lit(n_buckets)).cast("int")


def _dealt(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _slice_of(spark: SparkSession, key: list[str]):
    """The same for all rows of a bucket, if there are `SLICES` times as many buckets as shuffle partitions, or a multiple."""
    return F.pmod(F.floor(F.hash(*key) / F.lit(_dealt(spark))), F.lit(SLICES)).cast("int")


def sliced(rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows` with the slice of a commit that each belongs to, as the last column: write them by it."""
    return rows.withColumn(SLICE, _slice_of(rows.sparkSession, key))


def _folder(path: str, folder: str, bucket: int) -> str:
    return f"{path.rstrip('/')}/data/{folder}/{BUCKET}={bucket}"


def read_current(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None,
                 manifest: dict | None = None) -> DataFrame:
    """The current rows (of all buckets, or of the named ones); empty while nothing is committed."""
    manifest = manifest or read_manifest(spark, path)
    places = (manifest or {}).get("buckets", {})
    paths = [_folder(path, folder, int(b)) for b, folder in places.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched_buckets(rows: DataFrame, key: list[str], n_buckets: int, hashed: str = HASH) -> list[int]:
    """The buckets that `rows` fall into (`n_buckets` numbers at most)."""
    return sorted(r[0] for r in rows.select(_bucket_of(key, n_buckets, hashed).alias(BUCKET)).distinct().collect())


def read_touched(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """The current rows of the buckets that `rows` fall into."""
    manifest = read_manifest(rows.sparkSession, path)
    buckets = touched_buckets(rows, key, manifest["n_buckets"], manifest.get("hash", OLD_HASH)) if manifest else []
    return read_current(rows.sparkSession, path, rows.schema, buckets, manifest)


def upsert(rows: DataFrame, path: str, key: list[str], merge: Callable[[DataFrame], DataFrame],
           n_buckets: int = DEFAULT_BUCKETS, token: dict | None = None, fresh: bool = False) -> bool:
    """Commit `rows`: `merge` gets the rows of the touched buckets, old and new
    together, and returns what they shall hold. `rows` is read twice, so give a
    written or cheap table; with the column of `sliced` a large commit is done in
    lots. `n_buckets` counts when the table is new. With
    `fresh` the state before it is dropped in the same step. False if `token`
    is already there (then nothing is done)."""
    spark = rows.sparkSession
    before = read_manifest(spark, path)
    if token is not None and before is not None and before.get("token") == token:
        return False
    old = {"buckets": {}, "sizes": {}, "n_buckets": n_buckets, "version": 0}
    if before is not None:
        old = {**before, "buckets": {}, "sizes": {}} if fresh else before
    n_buckets, kept, sizes, dealt = old["n_buckets"], dict(old["buckets"]), dict(old["sizes"]), _dealt(spark)
    hashed = old.get("hash", OLD_HASH) if kept else HASH
    schema = rows.drop(SLICE).schema
    held = sum(sizes.values()) if kept else rows.count()
    grown = held > n_buckets * BUCKET_ROWS
    if grown:  # more buckets, and all rows into them
        n_buckets = max(n_buckets, dealt) // dealt * dealt
        while held > n_buckets * BUCKET_ROWS // 2:
            n_buckets *= 2
        given, kept, sizes, touched, hashed = {"buckets": kept}, {}, {}, list(range(n_buckets)), HASH
    else:
        touched = touched_buckets(rows, key, n_buckets, hashed)
        held = sum(sizes.get(str(b), 0) for b in touched) if kept else held
        given = {"buckets": {b: kept[b] for b in map(str, touched) if b in kept}}
    whole = hashed == HASH and n_buckets % dealt == 0  # what is dealt by the key lies in whole buckets
    n_lots = math.gcd(n_buckets // dealt, SLICES) if whole and SLICE in rows.columns else 1
    while n_lots > 1 and held < n_lots * LOT_ROWS:
        n_lots //= 2
    for b in map(str, touched):
        kept.pop(b, None)
        sizes.pop(b, None)
    for lot in range(n_lots if touched else 0):
        own, theirs = rows.drop(SLICE), given
        if n_lots > 1:
            own = rows.where(F.col(SLICE) % n_lots == lot).drop(SLICE)
            theirs = given if grown else {"buckets": {b: f for b, f in given["buckets"].items() if int(b) // dealt % n_lots == lot}}
        was = read_current(spark, path, schema, None, theirs)
        if n_lots > 1 and grown:
            was = was.where(_slice_of(spark, key) % n_lots == lot)
        where = f"{path.rstrip('/')}/data/{(folder := uuid.uuid4().hex)}"
        merged = merge(was.unionByName(own)).select(*own.columns).withColumn(BUCKET, _bucket_of(key, n_buckets, hashed))
        if not whole:
            merged = merged.repartition(BUCKET)
        with tidied_shuffles(spark):
            merged.write.mode("errorifexists").option("compression", "zstd").partitionBy(BUCKET).parquet(where)
        _, fs, Path = _files(spark, path)
        if fs.globStatus(Path(where, f"{BUCKET}=*")):  # a bucket that `merge` emptied has no folder
            for b, n in spark.read.parquet(where).groupBy(BUCKET).count().collect():
                kept[str(b)], sizes[str(b)] = folder, n
    publish(spark, path, {"version": old["version"] + 1, "n_buckets": n_buckets, "hash": hashed, "token": token, "buckets": kept, "sizes": sizes,
                          "rewritten": touched})
    return True


def vacuum(spark: SparkSession, path: str, keep: int = KEPT_VERSIONS) -> int:
    """Remove all but the last `keep` manifests, and the data folders that no
    kept one names (rests of commits that died among them). Not while another
    commit runs. Returns how many folders went."""
    _, fs, Path = _files(spark, path)
    versions = _versions(spark, path)
    named = {f for v in versions[-keep:] for f in _read_manifest(spark, path, v)["buckets"].values()}
    for v in versions[:-keep]:
        fs.delete(Path(_manifest_dir(path), f"{v:012d}.json"), False)
    gone = [s.getPath() for s in fs.globStatus(Path(f"{path.rstrip('/')}/data", "*")) or [] if s.getPath().getName() not in named]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
