"""Operator 13: fill-in-the-middle transformation by a parallel automaton scan.

A text is a row of units: runs of A-Z and a-z, and single other code points. Where its two cuts fall
depends on the number of its units, so a text is scanned before it is cut. The scan is an automaton
of four states over UTF-8 bytes: outside a run, inside one, after `<`, after `<` and a letter of a
mark. What a stretch of text does to it is a function from the state before to the state after, with
the units begun and whether a mark (`<P>`, `<S>`, `<M>`) was completed, for each state before. Such
functions compose, and composition is associative: the stretches of one text are scanned in any
order, in any task, and a scan over their functions gives the state and the units before each one.
The stretch that holds a cut follows from those, and that one alone is walked for the place.

A text of up to `giant` bytes is one stretch, scanned where it is read, together with all others of its
batch. The stretches of a longer one (of `stretch` bytes) are dealt out over all tasks; the functions
come back by the text's SHA-256, so that a text is scanned once however many rows hold it.

Cuts and form follow from four numbers h1 to h4, the first 8-digit groups of the hexadecimal SHA-256
of `seed:doc_id`: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle
after the larger. A text that is empty or holds a mark stays plain, and so do those with h3 % 100 not
below `percent`; of the others h4 % 100 below `spm_percent` gives suffix-prefix-middle, else
prefix-suffix-middle.

Nulls: a null text is the empty text; a null doc_id is the empty word in the hash. Repeated rows are
repeated in the result (a row's result depends on its doc_id and text alone). An empty table gives an
empty result; other columns are kept, but those named like a result column are replaced. Texts of
any length are scanned and cut whole. There are no ties: both cuts may be the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelane.llm._shared import ship, slices, table

MARKS = ("P", "S", "M")
#: Bytes of a stretch of a long text, and the bytes from which a text is long.
STRETCH, GIANT = 1 << 15, 1 << 16
OUTSIDE, INSIDE, OPENED, NAMED = range(4)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_NAME = np.zeros(256, bool)
_NAME[[ord(c) for c in MARKS]] = True
#: The state after a byte, by the state before and the byte.
STEP = np.zeros((4, 256), np.int8)
STEP[:, _LETTER] = INSIDE
STEP[OPENED, _NAME] = NAMED
STEP[:, ord("<")] = OPENED
#: Whether a letter in that state goes on with a run.
_RUNNING = np.array([False, True, False, True])


def begins(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte, for stretches of data between edges that are entered outside a run."""
    letter = _LETTER[data]
    out = (data & 0xC0) != 0x80
    out[1:] &= ~(letter[1:] & letter[:-1])
    first = edges[:-1][np.diff(edges) > 0]
    out[first] = (data[first] & 0xC0) != 0x80
    return out


def functions(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stretches of data do, by (stretch, state before): the state after, units begun, whether a mark was completed.

    edges: where each stretch begins, and the end of the last.
    """
    size, k = np.diff(edges), len(edges) - 1
    upto = np.concatenate([[0], np.cumsum(begins(data, edges))])
    units = np.repeat((upto[edges[1:]] - upto[edges[:-1]])[:, None], 4, 1)
    after = np.tile(np.arange(4, dtype=np.int8), (k, 1))
    marked = np.zeros((k, 4), bool)
    # Two bytes settle the state, whatever it was before them.
    for back in (2, 1):
        own = np.flatnonzero(size >= back)
        after[own] = STEP[after[own], data[edges[1:][own] - back][:, None]]
    own = np.flatnonzero(size)
    first = data[edges[:-1][own]]
    units[np.ix_(own, _RUNNING)] -= _LETTER[first][:, None]
    # Marks that lie within a stretch, and those whose first part came before it.
    hits = np.flatnonzero((data[:-2] == ord("<")) & _NAME[data[1:-1]] & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    at = np.searchsorted(edges, hits, "right") - 1
    marked[at[hits + 3 <= edges[at + 1]]] = True
    marked[own, NAMED] |= first == ord(">")
    two = np.flatnonzero(size > 1)
    begin = edges[:-1][two]
    marked[two, OPENED] |= _NAME[data[begin]] & (data[begin + 1] == ord(">"))
    return after, units, marked


def compose(f: tuple, g: tuple) -> tuple:
    """First f, then g, for arrays of functions: (stretch, state before) each."""
    through = f[0].astype(np.int64)
    return (
        np.take_along_axis(g[0], through, 1),
        f[1] + np.take_along_axis(g[1], through, 1),
        f[2] | np.take_along_axis(g[2], through, 1),
    )


def entries(after: np.ndarray, units: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Of the stretches of one text: the state and the units before each, all units, whether there is a mark.

    A scan by doubling: after round i each place holds the composition of 2**i functions.
    """
    scan = (after, units, marked)
    step = 1
    while step < len(after):
        joined = compose(tuple(a[:-step] for a in scan), tuple(a[step:] for a in scan))
        scan = tuple(np.concatenate([a[:step], j]) for a, j in zip(scan, joined))
        step *= 2
    state = np.concatenate([[OUTSIDE], scan[0][:-1, OUTSIDE]])
    before = np.concatenate([[0], scan[1][:-1, OUTSIDE]])
    return state, before, int(scan[1][-1, OUTSIDE]), bool(scan[2][-1, OUTSIDE])


def stretches(text: bytes, size: int) -> list[int]:
    """Where the stretches of a text begin, and its end; none begins within a code point."""
    edges = [0]
    while edges[-1] < len(text):
        at = min(edges[-1] + size, len(text))
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        edges.append(at)
    return edges


def place(text: bytes, edges: list[int], state: np.ndarray, before: np.ndarray, k: int) -> int:
    """The byte at which unit k (from 0) begins: only the stretch that holds it is walked."""
    s = int(np.searchsorted(before, k, "right")) - 1
    data = np.frombuffer(text, np.uint8)[edges[s] : edges[s + 1]]
    at = begins(data, np.array([0, len(data)]))
    if _RUNNING[state[s]] and _LETTER[data[0]]:
        at[0] = False
    return edges[s] + int(np.flatnonzero(at)[k - before[s]])


def draws(doc_id: Column, seed: int) -> Column:
    """The four numbers of a document."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


_NEW = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
_DIRECTORY = "array<struct<no:long,bytes:long,after:binary,units:binary,marked:binary>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Functions of stretches (digest, no, text)."""
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column("text")]
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        after, units, marked = functions(np.frombuffer(b"".join(texts), np.uint8), edges)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("digest"),
                batch.column("no"),
                pa.array(np.diff(edges)),
                pa.array([a.tobytes() for a in after.astype(np.int8)], pa.binary()),
                pa.array([u.tobytes() for u in units.astype("<i8")], pa.binary()),
                pa.array([m.tobytes() for m in marked], pa.binary()),
            ],
            names=["digest", "no", "bytes", "after", "units", "marked"],
        )


def directories(texts: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """digest, text -> digest and the functions of the text's stretches in order, scanned by all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column("digest"), batch.column("text")):
                raw = text.as_py().encode()
                edges = stretches(raw, stretch)
                numbered = list(enumerate(zip(edges, edges[1:])))
                for first in range(0, len(numbered), 64):
                    some = numbered[first : first + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "digest": pa.array([digest.as_py()] * len(some), pa.string()),
                            "no": pa.array([no for no, _ in some], pa.int64()),
                            "text": pa.array([raw[a:b].decode() for _, (a, b) in some], pa.string()),
                        }
                    )

    parts = texts.mapInArrow(cut, "digest string, no long, text string").repartition("digest", "no")
    done = parts.mapInArrow(_scan, "digest string, no long, bytes long, after binary, units binary, marked binary")
    # A text of several rows has the same functions in each.
    once = done.dropDuplicates(["digest", "no"]).select("digest", F.struct("no", "bytes", "after", "units", "marked").alias("part"))
    return once.groupBy("digest").agg(F.sort_array(F.collect_list("part")).alias("parts"))


def transformed(
    docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1, stretch: int = STRETCH, giant: int = GIANT
) -> DataFrame:
    """docs (doc_id, text, other columns) with n, form, prefix_chars, middle_chars and output, without text."""
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in _NEW]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    named = {c: f"own {i}" for i, c in enumerate(own)}
    rest = [named[c] for c in own if c != "text"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items() if c != "text"], text.alias("text"), draws(F.col("doc_id"), seed).alias("draw"))
    long = F.octet_length("text") > giant
    few = rows.where(~long).withColumn("parts", F.lit(None).cast(_DIRECTORY))
    many = rows.where(long).withColumn("digest", F.sha2("text", 256))
    many = many.join(directories(many.select("digest", "text"), stretch), "digest").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 24):
                part = batch.slice(a, b - a)
                texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
                found = _cut(texts, part.column("draw").to_pylist(), part.column("parts").to_pylist(), percent, spm_percent)
                columns = [pa.array(v, pa.string() if t == "string" else pa.int64()) for v, t in zip(found, _NEW.values())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *columns], names=[*rest, *_NEW])

    kind = StructType([f for f in few.schema if f.name in rest])
    for name, t in _NEW.items():
        kind.add(name, t)
    out = few.unionByName(many).mapInArrow(run, kind)
    return out.select(*[F.col(named[c]).alias(c) for c in own if c != "text"], *_NEW)


def _cut(texts: list[bytes], draw: list, parts: list, percent: int, spm_percent: int) -> tuple[list, ...]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    # All texts without a directory are stretches of one scan.
    edges = np.concatenate([[0], np.cumsum([len(t) if p is None else 0 for t, p in zip(texts, parts)])]).astype(np.int64)
    data = np.frombuffer(b"".join(t for t, p in zip(texts, parts) if p is None), np.uint8)
    _, units, marked = functions(data, edges)
    spots = np.flatnonzero(begins(data, edges))
    first = np.searchsorted(spots, edges[:-1])
    out = []
    for i, (text, h, directory) in enumerate(zip(texts, draw, parts)):
        if directory is None:
            n, mark = int(units[i, OUTSIDE]), bool(marked[i, OUTSIDE])
        else:
            shape = (len(directory), 4)
            state, before, n, mark = entries(
                np.frombuffer(b"".join(p["after"] for p in directory), np.int8).reshape(shape),
                np.frombuffer(b"".join(p["units"] for p in directory), "<i8").reshape(shape),
                np.frombuffer(b"".join(p["marked"] for p in directory), bool).reshape(shape),
            )
            begin = np.concatenate([[0], np.cumsum([p["bytes"] for p in directory])]).tolist()
        if not text or mark or h[2] % 100 >= percent:
            out.append((n, "plain", None, None, text.decode()))
            continue
        cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if directory is None:
            a, b = (int(spots[first[i] + k] - edges[i]) if k < n else len(text) for k in cuts)
        else:
            a, b = (place(text, begin, state, before, k) if k < n else len(text) for k in cuts)
        prefix, middle, suffix = text[:a].decode(), text[a:b].decode(), text[b:].decode()
        if h[3] % 100 < spm_percent:
            out.append((n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"))
        else:
            out.append((n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"))
    return tuple(zip(*out)) if out else ((),) * len(_NEW)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and digests of the outputs of all documents."""
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM documents
), units AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || digits[1:8])::BIGINT AS h1, ('0x' || digits[9:16])::BIGINT AS h2,
    ('0x' || digits[17:24])::BIGINT AS h3, ('0x' || digits[25:32])::BIGINT AS h4
  FROM hashed
), formed AS (
  SELECT *, len(u) AS n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM formed
), made AS (
  SELECT doc_id, n, form, text,
    array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(coalesce(prefix, '')) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(coalesce(middle, '')) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || coalesce(prefix, '') || '<S>' || coalesce(suffix, '') || '<M>' || coalesce(middle, '')
    WHEN 'spm' THEN '<S>' || coalesce(suffix, '') || '<P>' || coalesce(prefix, '') || '<M>' || coalesce(middle, '') ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM made
"""
