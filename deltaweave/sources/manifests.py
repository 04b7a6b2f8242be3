"""File sources and manifests.

A manifest text has a version line, the checksum type, the number of paths and
one line a path: ``Path:<hex digest, nibbles swapped>:<relative path>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import digest
from ..operators.files import ignored, numbered

VERSION = "Manifest:1.0"


def _hollow(spark: SparkSession, root: str) -> list[str]:
    """The relative paths of empty files, and with a final slash of empty
    directories, which the file reader leaves out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [(path, "")]
    while todo:
        folder, prefix = todo.pop()
        entries = list(store.listStatus(folder))
        if not entries and prefix:
            out.append(prefix)
        for entry in entries:
            name = prefix + entry.getPath().getName()
            if entry.isDirectory():
                todo.append((entry.getPath(), name + "/"))
            elif not entry.getLen():
                out.append(name)
    return sorted(out)


def scan_directory(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """(path, is_dir, size, content) of the files below ``root``, sorted by path.

    Paths are relative with slashes.  Files that an ignore rule matches are left
    out.  Empty directories are listed too, with a final slash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:(?://)?", "")
    relative = F.expr(f"substring(p, locate('{base}', p) + {len(base)})")
    table = files.where("length > 0").withColumn("p", path).select(relative.alias("path"), F.lit(False).alias("is_dir"), F.col("length").alias("size"), "content")
    hollow = [(p, p.endswith("/"), 0, None if p.endswith("/") else b"") for p in _hollow(spark, root)]
    if hollow:
        table = table.unionByName(spark.createDataFrame(hollow, table.schema))
    if ignore:
        table = table.where(~ignored(F.col("path"), ignore))
    return table.orderBy("path")


def swapped(hex_digest: F.Column) -> F.Column:
    """Hex digits with the two of each byte exchanged."""
    return F.regexp_replace(hex_digest, "(.)(.)", "$2$1")


def manifest_lines(files: DataFrame, checksum: str = "sha256") -> DataFrame:
    """(line_no, value) of the manifest text of files (path, content)."""
    body = files.select("path", F.concat(F.lit("Path:"), swapped(F.coalesce(digest(checksum, F.col("content")), F.lit(""))), F.lit(":"), F.col("path")).alias("value"))
    lines = numbered(body, "path").select((F.col("index") + 3).alias("line_no"), "value")
    spark = files.sparkSession
    count = body.agg(F.format_string("Count:%d", F.count(F.lit(1))).alias("value")).select(F.lit(2).cast("long").alias("line_no"), "value")
    head = spark.createDataFrame([(0, VERSION), (1, f"ChecksumType:{checksum}")], "line_no long, value string")
    return head.unionByName(count).unionByName(lines)


def save_manifest(files: DataFrame, path: str, checksum: str = "sha256") -> None:
    """Write the manifest text as one sorted text file below ``path``."""
    manifest_lines(files, checksum).orderBy("line_no").coalesce(1).select("value").write.mode("overwrite").text(path)


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(path, checksum_type, digest) of manifest text lines; the count must match."""
    heads = {r["value"].split(":", 1)[0]: r["value"].split(":", 1)[1] for r in lines.where("value RLIKE '^(ChecksumType|Count|Manifest):'").limit(4).collect()}
    if f"Manifest:{heads.get('Manifest')}" != VERSION or "Count" not in heads:
        raise ValueError("not a manifest")
    body = lines.where("value LIKE 'Path:%'")
    found = body.select(
        F.regexp_extract("value", r"^Path:[0-9a-f]*:(.*)$", 1).alias("path"),
        F.lit(heads["ChecksumType"]).alias("checksum_type"),
        swapped(F.regexp_extract("value", r"^Path:([0-9a-f]*):", 1)).alias("digest"),
    )
    if found.count() != int(heads["Count"]):
        raise ValueError("the manifest has another number of paths")
    return found


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, checksum_type, digest) of a saved manifest; its count must match."""
    return parse_manifest(spark.read.text(path))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of every path: ok, changed, missing or extra."""
    kind = manifest.select("checksum_type").first()
    now = files.where("NOT is_dir").select("path", digest(kind[0] if kind else "sha256", F.col("content")).alias("now"))
    joined = now.join(manifest.select("path", "digest").where("path NOT LIKE '%/'"), "path", "full_outer")
    state = F.when(F.col("digest").isNull(), "extra").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("digest"), "ok").otherwise("changed")
    return joined.select("path", state.alias("state"))
