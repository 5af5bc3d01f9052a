"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SCRATCH = "/tmp/checkpoints/ebbline"
BATCH_ROWS = 1_000
#: Ids of up to so many rows are broadcast (8 bytes each, counted first).
BROADCAST_IDS = 1_000_000
#: Beyond, as bitmaps of so many ids each, while all bitmaps together are under so many bytes.
BITMAP_IDS, BITMAP_BYTES = 1 << 15, 1 << 25
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return LOCAL_SCRATCH


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, freezes non-deterministic numbering, survives the loss of
    executors and gives the optimizer the table's real size, so that it broadcasts a
    side only when that side is under the session's threshold.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, tag))


def store(df: DataFrame, tag: str) -> str:
    """Write ``df`` as Parquet in the shared folder, for tasks to read with ``stored``.

    Its shuffle files go once it is written; else they stay until the driver happens to
    collect its garbage, which a long job on much data may never need to.
    """
    path = f"{shared_dir(df.sparkSession)}/ebbline-{tag}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    own = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if own is None else conf.set(_CLEANUP, own)
    made(path)
    return path


def made(path: str) -> None:
    """Tells ``recorded`` of a table or folder."""
    if (found := _MADE.get()) is not None:
        found.append(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are stored in this block; a block around it gets them too."""
    found: list[str] = []
    token = _MADE.set(found)
    try:
        yield found
    finally:
        _MADE.reset(token)
        for path in found:
            made(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes stored tables that nothing will read again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def by_ids(docs: DataFrame, column: str, ids: DataFrame, listed: bool) -> DataFrame:
    """Rows of ``docs`` whose ``column`` is (``listed``) or isn't among the first column of ``ids``.

    ``ids`` is a stored table. Rows of ``docs``, which hold texts, don't move: few ids are
    broadcast as they are, many as bitmaps of their ranges. Only many ids that are strewn
    so widely that bitmaps don't pay, or that aren't integers, are joined by a shuffle.
    """
    how, x = "left_semi" if listed else "left_anti", fresh(docs)
    ids = ids.select(F.col(ids.columns[0]).alias(f"{x}id"))
    n = ids.count()
    on = F.col(f"`{column}`") == F.col(f"{x}id")
    if n <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), on, how)
    if not {ids.dtypes[0][1], docs.select(f"`{column}`").dtypes[0][1]} <= {"tinyint", "smallint", "int", "bigint"}:
        return docs.join(ids, on, how)
    part = lambda c: F.shiftright(c.cast("long"), BITMAP_IDS.bit_length() - 1)
    place = lambda c: c.cast("long").bitwiseAND(BITMAP_IDS - 1)
    one = F.col(f"{x}id")
    if ids.select(part(one).alias("p")).distinct().count() * BITMAP_IDS // 8 > BITMAP_BYTES:
        return docs.join(ids, on, how)
    maps = ids.where(one.isNotNull()).groupBy(part(one).alias(f"{x}p")).agg(F.bitmap_construct_agg(place(one)).alias(f"{x}m"))
    maps = F.broadcast(materialize(maps, "ids"))
    own = F.col(f"`{column}`")
    byte = F.conv(F.hex(F.substring(F.col(f"{x}m"), (F.shiftright(place(own), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftright({x}b, cast({x}k as int)) & 1 = 1")
    out = docs.join(maps, part(own) == F.col(f"{x}p"), "left").withColumn(f"{x}b", byte).withColumn(f"{x}k", place(own).bitwiseAND(7))
    held = F.coalesce(bit, F.lit(False))
    return out.where(held if listed else ~held).select(*[F.col(f"`{c}`") for c in docs.columns])


def stored(folder: str, rows: int):
    """The rows of a stored table in record batches of at most ``rows``, in one order for all tasks."""
    system, path = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder.removeprefix("file:"))
    names = sorted(i.path for i in system.get_file_info(pa.fs.FileSelector(path)) if i.base_name.startswith("part-") and i.base_name.endswith(".parquet"))
    for name in names:
        with system.open_input_file(name) as f:
            yield from (b for b in pa.parquet.ParquetFile(f).iter_batches(rows) if b.num_rows)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows.

    Spark's own default of 10,000 rows piles up long texts in an executor's memory beside
    its heap. A session that asks for fewer rows keeps its setting.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(bounded, schema)


def _give_back() -> None:
    """Freed memory goes from a worker, which waits for its next task, to the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: list = [None, None]


def worker_keeps(key, make):
    """What an operator keeps between the tasks of one Python worker, made once.

    A worker serves one operator after another; what the one before has kept goes first, so
    a worker holds one operator's caches at a time.
    """
    if _KEPT[0] != key:
        _KEPT[:] = [None, None]
        _KEPT[:] = [key, make()]
    return _KEPT[1]


def fresh(*frames: DataFrame, stem: str = "ebb") -> str:
    """A column-name prefix that no column of ``frames`` starts with."""
    used = [c.lower() for f in frames for c in f.columns]
    n = 0
    while any(c.startswith(f"__{stem}{n}_") for c in used):
        n += 1
    return f"__{stem}{n}_"


_BREAK = re.compile(r"\s")


def word_blocks(texts, max_chars: int = 1 << 19):
    """Whole texts as blocks of white-space chunks of bounded size.

    Yields ``(owner, length, words)``: ``words`` is flat, ``owner[i]`` the position of
    the text that the next ``length[i]`` words belong to. A text over ``max_chars`` comes
    in several pieces, cut at white space only (a longer unbroken run stays whole). Texts
    that are None or blank have no entry.
    """
    owner: list[int] = []
    length: list[int] = []
    words: list[str] = []
    size = 0

    def out():
        return np.array(owner, np.int64), np.array(length, np.int64), words

    for i, text in enumerate(texts):
        if not text:
            continue
        for piece in _pieces(text, max_chars):
            found = piece.split()
            if not found:
                continue
            owner.append(i)
            length.append(len(found))
            words.extend(found)
            size += len(piece)
            if size >= max_chars:
                yield out()
                owner, length, words, size = [], [], [], 0
    if owner:
        yield out()


def _pieces(text: str, max_chars: int):
    if len(text) <= max_chars:
        yield text
        return
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, min(at + max_chars, len(text)))
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def joined_batches(batches, rows: int = 1_000, size: int = 1 << 22):
    """Arrow batches of about ``rows`` rows or ``size`` bytes, made of a task's smaller ones."""
    held, n, most = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        most += b.nbytes
        if n >= rows or most >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, most = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class ChunkTable(dict):
    """Chunk -> row number, with one feature row per chunk, computed once per worker.

    ``features(chunks) -> (len(chunks), width)`` array. The table is emptied when it has
    more than ``limit`` chunks or has met one over ``longest`` characters, so its memory is
    bounded whatever the corpus holds.
    """

    longest = 256

    def __init__(self, features, width: int, limit: int = 150_000, dtype=np.float32):
        super().__init__()
        self.features, self.width, self.limit, self.dtype = features, width, limit, dtype
        self.pending: list[str] = []
        self.full = False
        self.rows = np.zeros((1 << 12, width), dtype)

    def __missing__(self, chunk: str) -> int:
        at = len(self)
        self[chunk] = at
        self.pending.append(chunk)
        return at

    def at(self, words: list[str]) -> np.ndarray:
        if self.full:
            self.clear()
            self.full = False
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            start = len(self) - len(self.pending)
            if len(self) > len(self.rows):
                more = np.zeros((max(len(self), 2 * len(self.rows)), self.width), self.dtype)
                more[:start] = self.rows[:start]
                self.rows = more
            self.rows[start : len(self)] = self.features(self.pending)
            self.full = len(self) > self.limit or max(map(len, self.pending)) > self.longest
            self.pending = []
        return found

    def sums(self, texts) -> np.ndarray:
        """The sum of the chunks' feature rows for every text, as float64."""
        out = np.zeros((len(texts), self.width), np.float64)
        for owner, length, words in word_blocks(texts):
            at = self.at(words)
            starts = np.concatenate(([0], np.cumsum(length)[:-1]))
            np.add.at(out, owner, np.add.reduceat(self.rows[at].astype(np.float64), starts, axis=0))
        return out


def slices(batch, max_rows: int = 2000):
    """Smaller slices of an Arrow batch."""
    for at in range(0, batch.num_rows, max_rows):
        yield batch.slice(at, max_rows)
