"""What several operators of this subpackage share: scratch tables, word caches, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words: a space and the characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session, where all of Spark runs in one process, may do without the setting.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidelane-")
        sc.setCheckpointDir(folder)
    return folder


class Scratch:
    """Written tables in the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tidelane/{operator}-{uuid.uuid4().hex}"
        self._count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back."""
        self._count += 1
        path = f"{self.root}/{self._count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.tidelane_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that keep() returned and that no later plan reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.tidelane_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that tasks can import it."""
    if getattr(spark.sparkContext, "_tidelane_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tidelane-code-")
    target = os.path.join(folder, "tidelane.zip")
    with zipfile.ZipFile(target, "w") as z:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.join("tidelane", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._tidelane_shipped = True


class Memo(dict):
    """make(key) by key, for the keys used lately: at most twice limit of them are held."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def many(self, keys: list, make_all) -> list:
        """The values of distinct keys; make_all(missing keys) gives those of missing ones at once."""
        values = list(map(self.get, keys))
        absent = [i for i, v in enumerate(values) if v is None]
        for i, v in zip(absent, list(map(self.older.get, [keys[i] for i in absent]))):
            values[i] = v
        missing = [i for i in absent if values[i] is None]
        for i, v in zip(missing, make_all([keys[i] for i in missing]) if missing else ()):
            values[i] = v
        if len(self) + len(absent) >= self.limit:
            self.older = dict(self)
            self.clear()
        self.update((keys[i], values[i]) for i in absent)
        return values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u32(column) -> F.Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes (null: of no bytes)."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


def slices(texts, most: int = 1 << 22):
    """(first, after) of runs of an Arrow string array of about most bytes each; a longer text is alone.

    Then gives the memory of freed buffers back to the system: several such processes share a machine.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = total = 0
    for i, s in enumerate(size.tolist()):
        if total and total + s > most:
            yield first, i
            first, total = i, 0
        total += s
    if first < len(size):
        yield first, len(size)
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return what this process has freed to the system, at the end of a task that held much."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # a C library without it


def freed(run):
    """run, a function over a task's batches; what it has freed goes back to the system when the task ends.

    The workers of an executor stay, idle or not, and share its memory with tasks that have none of their own.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def word_codes(texts):
    """Words of an Arrow string array (null: none): codes, the distinct words, words per text.

    Words are runs of characters other than a space and those from tab to carriage return.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    edges = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    if len(blank := np.flatnonzero(pc.equal(words, pa.scalar("", words.type)).to_numpy(zero_copy_only=False))):
        kept = codes != blank[0]
        edges = np.concatenate([[0], np.cumsum(kept)])[edges - edges[0]]
        codes = codes[kept]
    return codes, words, np.diff(edges)


def spread(lengths, codes):
    """For runs of a table, laid end to end with these lengths: the table's places in order of codes."""
    import numpy as np

    starts = np.cumsum(lengths) - lengths
    out = lengths[codes]
    ends = np.cumsum(out)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(np.sum(lengths))) < 1 << 31 else np.int64
    places = np.repeat((starts[codes] - ends + out).astype(kind), out)
    places += np.arange(total, dtype=kind)
    return places
