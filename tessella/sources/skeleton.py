"""Indexes without text: export, guarded import, download."""

from __future__ import annotations

import gzip
import os
import tarfile
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, FingerprintMismatch
from ..functions import fingerprint
from ..operators import index
from ..schema import ISSUES, TABLES
from .embedder import opener
from .store import IndexStore

#: What leaves the index, and the manifest's keys that do.
COLUMNS = ("id", "repo", "kind", "number", "state", "updated_at", "embedded_hash")
MANIFEST_KEYS = ("embedding_fp", "schema_version")


def issues_without_text(issues: DataFrame) -> DataFrame:
    """Only the listed columns; the others are empty."""
    blank = {"title": F.lit(""), "body": F.lit(""), "labels": F.lit(None).cast("array<string>"), "author": F.lit(""), "comments_count": F.lit(0).cast("long"), "created_at": F.lit("")}
    names = [part.split()[0] for part in ISSUES.split(", ")]
    return issues.select(*[F.col(n) if n in COLUMNS else blank[n].alias(n) for n in names])


def export(store: IndexStore, path: str) -> None:
    """Issues without text, vectors, and the listed manifest keys, as Parquet folders under ``path``."""
    issues_without_text(store.table("issues")).write.parquet(f"{path}/issues")
    store.table("issues_vec").write.parquet(f"{path}/issues_vec")
    store.table("manifest").where(F.col("key").isin(*MANIFEST_KEYS)).write.parquet(f"{path}/manifest")


def load(store: IndexStore, path: str, expected: str) -> dict:
    """Take a skeleton into the index: shape check, fingerprint check, and the listed columns alone.

    Returns the numbers of issues and vectors, and the fingerprint stored.
    """
    spark = store.spark
    got = {}
    for name in ("issues", "issues_vec", "manifest"):
        df = spark.read.parquet(f"{path}/{name}")
        lacking = {part.split()[0] for part in TABLES[name].split(", ")} - set(df.columns)
        if lacking - ({"title", "body", "labels", "author", "comments_count", "created_at"} if name == "issues" else set()):
            raise ConfigError(f"{path}/{name} is no skeleton: it lacks {sorted(lacking)}")
        got[name] = df
    row = got["manifest"].where("key = 'embedding_fp'").first()
    if row is None:
        raise FingerprintMismatch("the skeleton has no fingerprint")
    stored = fingerprint.ensure(row.value, expected)
    store.create()
    rows = got["issues"].select(*COLUMNS)
    old = store.table("issues")
    merged = index.upsert(old, rows.drop("id"))
    ids = rows.select(F.col("id").alias("_from"), "repo", "number").join(merged.select("id", "repo", "number"), ["repo", "number"])
    vecs = got["issues_vec"].join(ids, F.col("issue_id") == F.col("_from")).select(F.col("id").alias("issue_id"), "embedding")
    store.publish({"issues": merged, "issues_vec": index.replace_rows(store.table("issues_vec"), vecs, ["issue_id"]), "manifest": store.with_manifest("embedding_fp", stored)})
    return {"issues": rows.count(), "vectors": vecs.count(), "fingerprint": stored}


def proxy_of(environment: dict[str, str], configured: str | None = None) -> str | None:
    """HTTPS_PROXY, then ALL_PROXY, then the settings'."""
    for value in (environment.get("HTTPS_PROXY"), environment.get("ALL_PROXY"), configured):
        if value and value.strip():
            return value.strip()
    return None


def gunzip_if_needed(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def download(address: str, path: str, proxy: str | None = None) -> bytes:
    """A local file's or an address' bytes, unpacked if they are compressed, also written to ``path``."""
    if address.startswith(("http://", "https://")):
        with opener(proxy).open(address, timeout=120) as r:
            raw = r.read()
    else:
        with open(address, "rb") as f:
            raw = f.read()
    made = gunzip_if_needed(raw)
    with open(f"{path}.part", "wb") as f:
        f.write(made)
    os.replace(f"{path}.part", path)
    return made


def is_archive(source: str) -> bool:
    """Whether a skeleton comes as an archive, from an address or a file, rather than as a folder."""
    return source.startswith(("http://", "https://")) or source.endswith((".tar", ".tar.gz", ".tgz"))


def unpacked(store: IndexStore, source: str, proxy: str | None = None) -> str:
    """The folder of an archived skeleton, put beside the index, where all executors can read it."""
    target = f"{store.home}/fetched-{uuid.uuid4().hex}"
    with tempfile.TemporaryDirectory() as own:  # the driver's; executors read the copy
        download(source, f"{own}/skeleton.tar", proxy)
        with tarfile.open(f"{own}/skeleton.tar") as tar:
            tar.extractall(f"{own}/out", filter="data")
        found = [d for d, names, _ in os.walk(f"{own}/out") if {"issues", "issues_vec", "manifest"} <= set(names)]
        if not found:
            raise ConfigError(f"{source} holds no skeleton")
        jvm = store.spark.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path(target)
        to.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{found[0]}"), to)
    return target
