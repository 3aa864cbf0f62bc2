"""Operator 5: quality by weak supervision.

The rules of _rules() read a document's measures and vote good (1), bad (-1) or abstain (0).
Expectation maximisation takes the true quality as hidden: a document is good, or fails in one of
as many ways as there are rules (junk of one kind passes the rules made for other kinds). It gives
the share of each, and each rule's accuracy in each: how often it calls good documents good, and
documents of each failure bad. Votes count as independent given the quality. Rules state how often they
may call a good document bad; that guess weighs as ALARM_PRIOR documents, which larger tables outweigh.
The input is the number of
documents of each combination of votes (at most 3 to the number of rules, however many
documents), so all documents shape the estimates and the driver holds only that table. A document
is kept if its posterior probability of being good is at least KEEP and it does not fail the base
rule (fewer than 50 words, or over half of the words in repeated 3-word windows).

Nulls: a null text has no words and fails the base rule; a null doc_id is kept as it is. Repeated
rows count as often as they stand; an empty table gives an empty result. Texts are read whole, and no
rule depends on their length. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm._shared import Scratch, ship, slices, table, word_codes

#: First guesses: the share of good documents; how often a rule calls bad its own failure, and others.
START = (0.9, 0.9, 0.15)
#: How many documents the guesses weigh: a rule's false alarms, and the others.
ALARM_PRIOR, PRIOR = 1000.0, 2.0
KEEP, ROUNDS = 0.5, 200
SYMBOLS = b"#*$%&|<>"
MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_distinct",
    "n_lines",
    "n_ends",
    "n_upper",
    "n_digits",
    "n_letters",
]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over each text's bytes."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(codes: np.ndarray, counts: np.ndarray, size: int = 3) -> np.ndarray:
    """For each text, its words within windows of size words that stand in it twice or more."""
    n = len(codes)
    if n < size:
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[: n - size + 1] == doc[size - 1 :]
    # Pairs get numbers of their own, so that every code is exact in 64 bits.
    key = codes.astype(np.int64)
    for k in range(1, size):
        pair = key[: n - k] * (int(codes.max()) + 1) + codes[k:]
        key = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    starts = np.flatnonzero(inside)
    key = key[starts] * len(counts) + doc[starts]
    _, place, often = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(n, bool)
    for s in range(size):
        covered[starts[often[place] > 1] + s] = True
    return np.bincount(doc[covered], minlength=len(counts))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of an Arrow array of texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    docs = len(texts)
    codes, words, counts = word_codes(texts)
    doc = np.repeat(np.arange(docs), counts)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + docs + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if docs else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if docs else np.zeros(1, np.int64)

    def count(chars: bytes) -> np.ndarray:
        flag = np.zeros(256, np.uint8)
        flag[list(chars)] = 1
        return _per_text(flag[raw], offsets)

    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(docs), np.diff(lines.offsets.to_numpy()))
    coded = lines.flatten().dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(coded.dictionary, r"[.!?\"'][\x20\x09-\x0D]*\z").to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy(zero_copy_only=False)
    full = worded[line] if len(line) else np.zeros(0, bool)
    line_doc, line = line_doc[full], line[full]
    n_lines = np.bincount(line_doc, minlength=docs)
    first = np.unique(line_doc * (len(worded) + 1) + line)
    pairs = np.unique(doc * (len(words) + 1) + codes)
    return {
        "n_words": counts,
        "word_chars": np.bincount(doc, length[codes], docs).astype(np.int64),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": n_lines - np.bincount(first // (len(worded) + 1), minlength=docs),
        "n_repeat_words": _repeats(codes, counts),
        "n_distinct": np.bincount(pairs // (len(words) + 1), minlength=docs),
        "n_lines": n_lines,
        "n_ends": np.bincount(line_doc[ended[line]], minlength=docs),
        "n_upper": count(bytes(range(65, 91))),
        "n_digits": count(bytes(range(48, 58))),
        # A byte that starts a character beyond ASCII counts as a letter.
        "n_letters": count(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)])),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            found = measures(batch.column("text").slice(a, b - a))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").slice(a, b - a)}
                | {n: pa.array(found[n].astype(np.int64)) for n in MEASURES}
            )


def _share(part: str, whole: str) -> Column:
    """part / whole; null where whole is 0, so that rules abstain."""
    return F.try_divide(F.col(part).cast("double"), F.col(whole))


def _rules() -> list[tuple[str, Column, Column, float]]:
    """Each rule: name, where it votes bad, where it votes good, how often it may call a good document
    bad. Elsewhere it abstains."""
    word = _share("word_chars", "n_words")
    symbols = _share("n_symbols", "n_words")
    dup, ends = _share("n_dup_lines", "n_lines"), _share("n_ends", "n_lines")
    repeat = _share("n_repeat_words", "n_words")
    # Distinct words grow as a power of the words: the power hardly depends on the length.
    variety = F.try_divide(F.ln(F.col("n_distinct")), F.ln(F.col("n_words")))
    upper, digits = _share("n_upper", "n_letters"), _share("n_digits", "word_chars")
    letters = _share("n_letters", "word_chars")
    return [
        ("word_length", (word < 2.5) | (word > 12), (word >= 3.5) & (word <= 9), 0.02),
        ("symbols", symbols > 0.1, symbols <= 0.02, 0.01),
        ("repeated_lines", dup > 0.3, dup <= 0.05, 0.05),
        ("repeated_windows", repeat > 0.3, repeat <= 0.1, 0.03),
        ("upper", upper > 0.3, upper <= 0.15, 0.02),
        ("digits", digits > 0.2, digits <= 0.03, 0.02),
        ("letters", letters < 0.7, letters >= 0.9, 0.02),
        ("line_ends", ends < 0.1, ends >= 0.5, 0.05),
        ("variety", variety < 0.7, variety >= 0.85, 0.05),
    ]


def estimate(votes: np.ndarray, n: np.ndarray, alarm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From combinations of votes, their numbers and the rules' expected false alarms: the shares of
    good documents and of each failure, and each rule's rate of bad votes in each (row 0: good)."""
    rules = votes.shape[1]
    shares = np.array([START[0], *[(1 - START[0]) / rules] * rules])
    rates = np.vstack([alarm, np.full((rules, rules), START[2]) + np.eye(rules) * (START[1] - START[2])])
    start, total = rates.copy(), n.sum()
    weight = np.array([ALARM_PRIOR, *[PRIOR] * rules])[:, None]
    for _ in range(ROUNDS):
        who = n[:, None] * posterior(votes, shares, rates)
        new_shares = np.maximum(who.sum(0) / total, 1e-9)
        new_rates = (who.T @ (votes < 0) + weight * start) / (who.T @ (votes != 0) + weight)
        new_rates = np.clip(new_rates, 1e-4, 0.999)
        moved = np.abs(new_shares - shares).max() + np.abs(new_rates - rates).max()
        shares, rates = new_shares / new_shares.sum(), new_rates
        if moved < 1e-9:
            break
    return shares, rates


def posterior(votes: np.ndarray, shares: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The probabilities of being good and of each failure, for each row of votes."""
    like = np.log(shares) + (votes < 0) @ np.log(rates).T + (votes > 0) @ np.log(1 - rates).T
    like = np.exp(like - like.max(1, keepdims=True))
    return like / like.sum(1, keepdims=True)


def scored(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the measures, base_failed, votes (by rule), posterior, kept."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "quality")
    kind = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = scratch.keep(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measured, kind), "measures"
    )
    rules = _rules()
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    voted = rows.withColumn("votes", F.array(*[vote(bad, good) for _, bad, good, _ in rules]))
    found = sorted((tuple(r.votes), r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect())
    votes, n = np.array([v for v, _ in found]).reshape(-1, len(rules)), np.array([c for _, c in found], float)
    shares, rates = estimate(votes, n, np.array([a for *_, a in rules])) if found else (None, None)
    good = posterior(votes, shares, rates)[:, 0].tolist() if found else []
    # A row for each combination of votes: at most 3 to the number of rules.
    verdicts = spark.createDataFrame([(list(v), g) for (v, _), g in zip(found, good)], "votes array<int>, posterior double")
    voted = voted.join(F.broadcast(verdicts), "votes")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "doc_id",
        *MEASURES,
        base_failed.alias("base_failed"),
        "votes",
        "posterior",
        (~base_failed & (F.col("posterior") >= KEEP)).alias("kept"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rule and verdict for all documents."""
    out = scored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *MEASURES[:5], "base_failed", "kept", "posterior")
