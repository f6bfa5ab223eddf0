"""Contaminant reference sets from a list of accessions and queries."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ampliref.operators.align import kmer_index
from ampliref.schemas import require_columns
from ampliref.session import path_exists
from ampliref.sources.fasta import read_fasta

Fetcher = Callable[[list[str]], str]
Searcher = Callable[[str, int], list[str]]


def build_contaminant_set(organisms: DataFrame, out_dir: str, fetcher: Fetcher, searcher: Searcher, retmax: int = 200) -> dict[str, str]:
    """Category -> FASTA file. organisms: (type, category, value), type accession or query.

    fetcher: accessions to FASTA text; searcher: a query and how many results to accessions. What fails is warned of and
    left out; an unknown type is an error. The list is a hand-made one, so the driver goes through it.
    """
    require_columns(organisms, ["type", "category", "value"])
    rows = organisms.collect()
    unknown = sorted({str(r["type"]) for r in rows if r["type"] not in ("accession", "query")})
    if unknown:
        raise ValueError("Unknown organism type: " + ", ".join(unknown))
    texts: dict[str, list[str]] = {}
    for r in rows:
        try:
            ids = [r["value"]] if r["type"] == "accession" else searcher(r["value"], retmax)
            text = fetcher(ids) if ids else ""
        except Exception as e:  # whatever a fetcher raises
            warnings.warn(f"Failed to fetch {r['value']}: {e}", stacklevel=2)
            continue
        if text.strip():
            texts.setdefault(r["category"], []).append(text.strip() + "\n")
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    out = {}
    for category, parts in texts.items():
        path = Path(out_dir) / f"{category}.fasta"
        path.write_text("".join(parts), encoding="utf-8")
        out[category] = str(path)
    return out


def build_index(spark: SparkSession, fasta_paths: list[str], out_path: str) -> DataFrame:
    """Writes the k-mer index of FASTA files as Parquet, and returns it: (id, kmer, pos), for the index of search() and contaminated()."""
    missing = [p for p in fasta_paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError("FASTA file not found: " + ", ".join(missing))
    frames = [read_fasta(spark, p).selectExpr("asv_id as id", "sequence") for p in fasta_paths]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    kmer_index(rows).repartitionByRange("kmer").write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)
