"""Row digests and order-free content digests (A30, core of E1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folding import clean_ws
from .times import canonical_decimal

# Columns of the content digest under their export names, in key order.
HASHED = {
    "Année universitaire": "academic_year",
    "Durée": "duree",
    "Filière": "filiere",
    "Groupe": "groupe",
    "Horaire": "horaire",
    "Jour": "jour",
    "Matière": "matiere",
    "Niveau": "niveau",
    "Nom et prénom": "enseignant",
    "Salle": "salle",
    "Type": "type_seance",
}


def sha256_record(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def canonical_row() -> Column:
    """Key-sorted JSON of one session; provenance columns are left out."""
    value = lambda c: canonical_decimal(c) if c == "duree" else clean_ws(c)
    return F.to_json(F.struct(*[value(c).alias(label) for label, c in HASHED.items()]))


def row_digest() -> Column:
    return F.sha2(canonical_row(), 256)


def content_fingerprint(
    sessions: DataFrame, by: Sequence[str], name: str = "source_hash"
) -> DataFrame:
    """One digest per group from the multiset of its row digests.

    Sums of the digest's quarters do not depend on row order and combine on the map
    side, so a version of any size is never gathered in one task. Equal content always
    gives an equal digest; each quarter adds 60 bits of the row's SHA-256.
    """
    quarter = lambda i: F.conv(F.substring("_d", 16 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(quarter(i)).alias(f"_q{i}") for i in range(4)]
    grouped = (
        sessions.withColumn("_d", row_digest())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("sessions_count"), *sums)
    )
    parts = [F.col("sessions_count").cast("string")] + [
        F.col(f"_q{i}").cast("string") for i in range(4)
    ]
    return grouped.select(*by, "sessions_count", F.sha2(F.concat_ws(":", *parts), 256).alias(name))


def file_fingerprints(files: DataFrame) -> DataFrame:
    """Digest of each file of a ``binaryFile`` scan."""
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))
