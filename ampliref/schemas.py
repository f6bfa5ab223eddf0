"""Schemas of the tables of a release, and checks of columns and arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]
PREFIXES = ["k", "p", "c", "o", "f", "g", "s"]


def _schema(strings: str = "", doubles: str = "", ints: str = "") -> StructType:
    return StructType([StructField(n, t()) for names, t in ((strings, StringType), (doubles, DoubleType), (ints, IntegerType)) for n in names.split()])


FINAL = _schema("source sequence_id species unique_code seq_type sequence qc_flag cn_name genus family order class phylum kingdom occurrence habitat")
RAW = _schema("source species seq_type sequence_id unique_code sequence")
QC = _schema("source sequence_id unique_code species gene sequence qc_flag")
BLAST = StructType(
    [StructField(n, StringType()) for n in ("asv_id", "subject_id")]
    + [StructField(n, DoubleType()) for n in ("pident", "length", "qlen", "slen", "evalue", "bitscore", "mismatch", "gapopen", "qstart", "qend", "sstart", "send")]
)
ASV = StructType([StructField("asv_id", StringType()), StructField("sequence", StringType()), StructField("ord", LongType())])
METRICS = ["pident", "qcov", "scovs", "ccovs", "evalue", "bitscore", "bitscore_pb"]
HITS = _schema("asv_id species genus family", " ".join(METRICS))
ASSIGNMENT = ["asv_id", "species", "genus", "family", *METRICS, "n_best_species", "assignment_status", "confidence", "tie_taxa"]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))


def match_arg(value: str | Sequence[str], choices: Sequence[str]) -> str:
    """One choice, by exact or unambiguous partial match, ignoring case."""
    if not isinstance(value, str):
        raise ValueError("argument must be a single string")
    low = value.lower()
    if low in choices:
        return low
    found = [c for c in choices if c.startswith(low)]
    if len(found) != 1:
        raise ValueError("argument must be one of: " + ", ".join(choices))
    return found[0]
