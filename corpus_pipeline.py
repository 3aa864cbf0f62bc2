"""Five stages over the documents table; each works on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents (and any others that came). Which rows go:

- language: documents whose text is too far from every language, or has no letter;
- near_duplicates: all but one document of each group of near copies (5-word shingles, similarity
  0.8); a null doc_id is kept;
- secrets: documents with a finding;
- mix: documents that the target weights leave out; others are repeated as often as they say;
- sentence_pieces: none; returns ids, their number and score, the N best segmentations, and the text
  decoded from the ids.

Rows with nulls in any column pass as the operators say (a null text has no letter and goes first).
Repeated rows: copies of a text with different ids are near copies; of rows with one doc_id the least
one stays (columns that have no order, such as maps, don't count for that); the mix may repeat a row.
Ties are settled by doc_id or content, never by the order of arrival. Texts of any length pass whole,
an empty table gives an empty result, and further columns, whatever their names, come along to the
last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import language, mixing, near_dedup, secrets, sentence_pieces
from tidelane.llm._shared import Scratch, shared_folder


def _aside(docs: DataFrame, made: list[str]) -> tuple[DataFrame, list[Column]]:
    """docs with other names for columns that an operator makes; and how to select all under their own."""
    names = {c: f"own {i}" if c in made or "." in c else c for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no language claims; the model is learned from the rows that carry a language."""
    named, own = _aside(docs, ["lang_pred", "score", "rejected"])
    return language.predicted(named, language.fit(docs)).where(~F.col("rejected")).select(*own)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the least doc_id of each group, and all but one row of a repeated doc_id."""
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct().hint("merge")
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    # Repeated ids are few: only they are looked at again, the least row of each stays.
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is not null and n > 1")
    twice = Scratch(spark, "repeated").keep(twice.select(F.col("doc_id").alias("twice")), "ids")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, kept["doc_id"] == twice["twice"], "left_anti")
    repeated = kept.join(twice, kept["doc_id"] == twice["twice"], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ordered = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = repeated.select(F.col("doc_id").alias("id"), F.struct(*columns).alias("row"), F.struct(*ordered).alias("order"))
    least = rows.groupBy("id").agg(F.min_by("row", "order").alias("row"))
    return single.unionByName(least.select("row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Drops documents with a finding; the findings come from a ledger of their contents, a new one if none is named."""
    ledger = ledger or f"{shared_folder(spark)}/tidelane/ledger-{uuid.uuid4().hex}"
    secrets.scan_versions(docs.select("text"), ledger)
    bad = secrets.ledger(spark, ledger).where((F.col("spans") != "") & (F.col("rules") == secrets.RULES))
    bad = bad.select("blob")
    blob = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    return docs.join(bad, blob == bad["blob"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight gives."""
    named, own = _aside(docs, ["size", "source_size", "target", "copies"])
    return mixing.emitted(mixing.mix(named)).select(*own)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, its N best segmentations, and the text decoded from the ids."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "lang", "source", "text")
    return sentence_pieces.encoded(rows, model, sentence_pieces.N_BEST, decode=True)


STAGES = [
    ("language", by_language),
    ("near_duplicates", one_of_near_copies),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("sentence_pieces", pieces),
]

#: SQL can express neither the nearest centroids nor the groups of near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
