"""Operator 9: secrets, with a ledger of scanned contents.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a Parquet
table of (blob, rules, findings), a row for each pair of content and rule version scanned so
far, findings or none. A run scans only contents whose pair is not in the ledger, once each
however many paths hold them, appends their rows, and joins the findings back to all versions.
A run that is lost before its append is committed leaves the ledger as it was; a pair that several
runs committed counts once.

Rules find kind, start and end (code points, end exclusive). The base kinds are assign, access
and hex; a further kind, key_block (PEM private keys), adds spans. Within a kind, matches are
leftmost and do not overlap; a match that fails its length test is dropped after it has taken
its text.

Nulls: a null text is the empty text. Repeated versions are repeated rows of the result. A null
path or version is kept as it is. A column that bears the name of a result's column is replaced
by that. An empty table gives an empty result. Long texts are scanned
whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm._shared import Scratch, freed, ship, table

#: Changes whenever a rule does: contents are then scanned anew.
RULES = "2024-1"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key_block")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run that is too short holds no longer one, so the shortest length may stand in the pattern.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[^-]*-----END (?:[A-Z]+ )?PRIVATE KEY-----")


def spans(text: str) -> list[tuple[int, int, str]]:
    """All findings of a text as (start, kind's number, kind, end), in order."""
    found = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(m.start(), 3, "key_block", m.end()) for m in _KEY_BLOCK.finditer(text)]
    found.sort()
    return found


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            found = spans(text.as_py() or "")
            base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found if kind in BASE)
            rows.append(
                (
                    *(sum(kind == k for _, _, kind, _ in found) for k in BASE),
                    hashlib.sha256(base.encode()).hexdigest(),
                    ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found),
                )
            )
        columns = dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        yield pa.RecordBatch.from_pydict(
            {"blob": batch.column("blob")}
            | {n: pa.array(list(v), pa.int64() if n.startswith("n_") else pa.string()) for n, v in columns.items()}
        )


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path, or None where none was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(f"blob binary, rules string, {_FOUND}").parquet(path)


def scan_versions(versions: DataFrame, ledger_path: str, rules: str = RULES) -> DataFrame:
    """versions (text, other columns) -> the other columns and the findings of each version.

    Scans what the ledger has not seen under these rules, and adds it there.
    """
    spark = versions.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    blobs = versions.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")).distinct()
    seen = ledger(spark, ledger_path)
    if seen is not None:
        blobs = blobs.join(seen.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    new = blobs.mapInArrow(freed(_scan), f"blob binary, {_FOUND}").withColumn("rules", F.lit(rules))
    new.select("blob", "rules", *[f.split()[0] for f in _FOUND.split(", ")]).write.mode("append").parquet(ledger_path)
    # Runs at the same time may both have committed a pair; a pair counts once.
    known = ledger(spark, ledger_path).where(F.col("rules") == rules).drop("rules").dropDuplicates(["blob"])
    known = known.withColumnsRenamed({c: f"_{c}" for c in known.columns})
    taken = {"text", *known.columns, *(c[1:] for c in known.columns)}
    rest = [c for c in versions.columns if c not in taken]
    paths = versions.select(*rest, F.unhex(F.sha2(text, 256)).alias("_blob"))
    found = paths.join(known, "_blob")
    return found.select(*rest, *[F.col(c).alias(c[1:]) for c in known.columns])


def op9_secrets(spark: SparkSession, sf_dir: str, ledger_path: str | None = None, rules: str = RULES) -> DataFrame:
    """Secrets of all documents, each document a path with one version.

    Only what the ledger at ledger_path has not seen is scanned; without a path the ledger is new.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_versions(docs, ledger_path or f"{Scratch(spark, 'op9').root}/ledger", rules).drop("blob")
