"""Releases: directories of Parquet tables, registered as views while they are connected."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliref.schemas import QC, RAW
from ampliref.session import children, is_file, path_exists
from ampliref.sources import install
from ampliref.sources.sqlite import import_sqlite

FINAL_TABLE, RAW_TABLE, QC_TABLE = "final", "raw", "qc_reference_p2"


@dataclass(frozen=True)
class Manifest:
    """What a published release is: its identifiers, where it lies, and how to know it."""

    doi: str = ""
    record: str = ""
    filename: str = "reference.db"
    url: str = ""
    size_bytes: int = 0
    md5: str = ""

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], "doi string, record string, filename string, url string, size_bytes long, md5 string")


def read_manifest(path: str) -> Manifest:
    """A manifest from a JSON file; its url, size_bytes and md5 are what install() enforces."""
    with open(path, encoding="utf-8") as f:
        return Manifest(**json.load(f))


def install_release(manifest: Manifest, dest: str | None = None, **options) -> str:
    """install() of what a manifest says, refused unless size and checksum are those it names."""
    return install.install(manifest.url, dest, manifest=manifest, **options)


def demo_subset(final: DataFrame, n: int = 200, order: list[str] | None = None) -> DataFrame:
    """The first n rows in order, as a demo release holds them: a top-k, which Spark takes from each task's first n."""
    return final.orderBy(*(order or ["unique_code"])).limit(n)


def write_release(out_dir: str, tables: dict[str, DataFrame], partition_final: bool = True) -> str:
    """Tables as Parquet; the final one in a folder per marker, which queries for a marker then read alone."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_final and name == FINAL_TABLE and "seq_type" in df.columns:
            df.repartition("seq_type").write.mode("overwrite").partitionBy("seq_type").parquet(f"{out_dir}/{name}.parquet")
        else:
            writer.parquet(f"{out_dir}/{name}.parquet")
    return out_dir


def release_tables(final: DataFrame) -> dict[str, DataFrame]:
    """The final table with the raw and quality tables that are projections of it."""
    return {
        FINAL_TABLE: final,
        RAW_TABLE: final.select(*RAW.fieldNames()),
        QC_TABLE: final.withColumnRenamed("seq_type", "gene").select(*QC.fieldNames()),
    }


def demo_release(spark: SparkSession, csv_path: str, out_dir: str) -> str:
    """A release from one CSV file of the final table; empty strings are missing values."""
    final = spark.read.csv(csv_path, header=True, inferSchema=True, encoding="UTF-8")
    return write_release(out_dir, release_tables(final), partition_final=False)


class Release:
    """Tables of a release. Each becomes a temporary view, prefixed so that several releases can be open."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = ""):
        if not path_exists(spark, path):
            raise FileNotFoundError("Database file does not exist: " + path)
        self.spark, self.path, self.prefix = spark, path, prefix
        self.frames = {n.removesuffix(".parquet"): spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in children(spark, path) if n.endswith(".parquet")}
        for name, df in self.frames.items():
            df.createOrReplaceTempView(prefix + name)

    def tables(self) -> DataFrame:
        """(table, n_rows); counts come from the files' footers."""
        parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in self.frames.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read_table(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise ValueError("Table not found: " + name)
        return self.frames[name]

    def table_or_empty(self, name: str, schema: str) -> DataFrame:
        return self.frames.get(name, self.spark.createDataFrame([], schema))

    @property
    def final(self) -> DataFrame:
        return self.read_table(FINAL_TABLE)

    def qc_table(self) -> DataFrame:
        return self.frames.get(QC_TABLE, self.frames.get(FINAL_TABLE))

    def disconnect(self) -> None:
        """Drops the views; a second time does nothing."""
        for name in self.frames:
            self.spark.catalog.dropTempView(self.prefix + name)
        self.frames = {}


def available_datasets(spark: SparkSession, bundled: str | None = None, demo: str | None = None) -> DataFrame:
    """(name, version, path) of the release that connect() takes by default: a bundled one, a cached one, or the demo."""
    path = next((p for p in (bundled, install.find_full(), demo) if p and path_exists(spark, str(p))), "")
    version = "demo" if path == (demo or "") else "full-local"
    return spark.createDataFrame([("reference", version, path)], "name string, version string, path string")


def connect(spark: SparkSession, path: str | None = None, download: bool = False, url: str | None = None, demo: str | None = None, downloader=install.download_file) -> Release:
    """Opens a release directory; a SQLite file is imported beside itself once. Without a path the default release, installed first if asked to."""
    if path is None:
        if download and not install.available():
            install.install(url if url is not None else install.db_url(), downloader=downloader)
        path = available_datasets(spark, demo=demo).first()["path"]
    if not path or not path_exists(spark, str(path)):
        raise FileNotFoundError("Database file does not exist: " + str(path))
    if is_file(spark, str(path)):
        out = path + ".parquet.d"
        if not os.path.isdir(out) or os.path.getmtime(out) < os.path.getmtime(path):
            import_sqlite(spark, path, out)
        path = out
    return Release(spark, path)
