"""Packing with mixture control: deficit round-robin over source queues.

Each source's documents form a queue. In every round a queue's deficit grows by its quantum,
its target share of one window, and it sends documents while its deficit covers them; what is
left of the deficit goes on to the next round. The documents sent one after another are the
stream that fills the windows of ``length`` tokens; a document is cut where a window ends.
A document over ``most`` tokens is sent in runs of that size, so that a window never falls
far from its target for the sake of one long document.

As queues always hold their documents in advance, the round of a run has a closed form: it is
the first one in which all quanta so far, with the queue's credit, cover the queue up to the
run's end. So deficits pass over windows and partitions by arithmetic: rounds are dealt in
blocks, each task orders its own blocks, and running sums of the blocks' tokens say where each
block begins in the stream.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.llm.common import joined_batches, map_arrow, materialize, worker_keeps
from ebbline.llm.words import cut_words, text_blocks

LENGTH = 2048
END_ID = 1
#: Rounds that one task orders at a time: about half a million tokens.
ROUNDS_A_BLOCK = 256
#: Blocks whose running sums are made together.
BLOCKS_A_GROUP = 4096
#: Tokens that one task sorts at a time, about; beyond so many tasks they sort more, and spill.
TOKENS_A_TASK = 1 << 22
MOST_TASKS = 50_000


# -- tokens ---------------------------------------------------------------------
class _Encoder:
    """Packed ids of words and texts by the tokenizers library.

    New words go to the library all at once; they are kept in two generations of bounded
    size, long ones not at all.
    """

    def __init__(self, path: str, limit: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.whole = path, None
        # for words that are normalised and cut already
        self.words_tok = Tokenizer.from_file(path)
        self.words_tok.no_truncation()
        self.words_tok.no_padding()
        self.words_tok.normalizer = normalizers.Sequence([])
        self.words_tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab, last = self.words_tok.get_vocab(), self.words_tok.model.end_of_word_suffix
        size = 1 + max(vocab.values())
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(last)]] = True
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def text(self, text: str) -> np.ndarray:
        if self.whole is None:  # few corpora need it
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.no_truncation()
            self.whole.no_padding()
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of distinct normalised words, in ``self.kind``."""
        if len(self.words) > self.limit:
            self.old, self.words = self.words, {}
        known, old, width = self.words, self.old, self.kind.itemsize
        out = list(map(known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            found = old.get(words[i])
            if found is None:
                new.append(i)
            else:
                out[i] = known[words[i]] = found
        for lo in range(0, len(new), 20_000):
            part = [words[i] for i in new[lo : lo + 20_000]]
            ids = np.array(self.words_tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise RuntimeError("the tokenizer's words aren't those cut here")
            raw, at = ids.tobytes(), 0
            for i, w, stop in zip(new[lo : lo + 20_000], part, (width * stops).tolist(), strict=True):
                out[i] = raw[at:stop]
                if len(w) <= 32:
                    known[w] = out[i]
                at = stop
        return out


def _encoder(path: str) -> _Encoder:
    return worker_keeps(("packing", path), lambda: _Encoder(path))


def token_ids(texts: pa.Array, path: str, end: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of all whole texts in a row, each with ``end`` behind it, and where each text's begin.

    Texts are cut into words and every distinct word of a block is encoded once; texts that
    can't be cut with certainty are encoded by the library as a whole.
    """
    encoder = _encoder(path)
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for lo, hi in text_blocks(texts):
        words, n_words, unsure = cut_words(texts[lo:hi])
        coded = words.dictionary_encode()
        raw = encoder.encode(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // encoder.kind.itemsize
        pool = np.frombuffer(b"".join(raw), encoder.kind)
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        stop = np.concatenate(([0], np.cumsum(n)))
        # token i of the block is pool[where its word's ids begin + i - where the word begins in the block]
        flat = pool[np.repeat((np.cumsum(size) - size)[at] - stop[:-1], n) + np.arange(stop[-1])]
        own = np.diff(stop[np.concatenate(([0], np.cumsum(n_words)))])
        if unsure.any():
            odd = [encoder.text(texts[lo + i].as_py()) for i in np.flatnonzero(unsure).tolist()]
            own[unsure] = [len(x) for x in odd]
            whole = np.empty(own.sum(), encoder.kind)
            there = np.repeat(unsure, own)
            whole[there], whole[~there] = np.concatenate(odd), flat
            flat = whole
        parts.append(flat)
        counts[lo:hi] = own
    flat = np.concatenate(parts) if parts else np.zeros(0, encoder.kind)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if end:
        if max(end) > np.iinfo(encoder.kind).max:
            flat = flat.astype("<u4")
        flat = np.insert(flat, np.repeat(offsets[1:], len(end)), np.tile(np.array(end, flat.dtype), len(texts)))
        offsets = offsets + len(end) * np.arange(len(offsets))
    return flat, offsets


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each whole text as little-endian unsigned 32-bit integers."""
    flat, offsets = token_ids(pa.array(texts, pa.string()), path)
    raw = flat.astype("<u4").tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


TOKEN_SCHEMA = "doc_id long, queue string, part int, start long, n long, ids binary"


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = END_ID) -> DataFrame:
    """Documents as packed ids (two or four bytes each) with the end id, and their place in their queue within the task."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        filled: dict[str | None, int] = {}
        for b in joined_batches(batches):
            flat, offsets = token_ids(b.column(1), path, [end_id])
            n, starts = np.diff(offsets), []
            for q, k in zip(b.column(2).to_pylist(), n.tolist(), strict=True):
                at = filled.get(q, 0)
                starts.append(at)
                filled[q] = at + k
            for lo, hi in _slices(offsets * flat.itemsize):
                own = offsets[lo : hi + 1]
                raw = pa.py_buffer(flat[own[0] : own[-1]].tobytes())
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(((own - own[0]) * flat.itemsize).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(np.full(hi - lo, part, np.int32)), pa.array(starts[lo:hi], pa.int64()), pa.array(n[lo:hi]), ids],
                    names=["doc_id", "queue", "part", "start", "n", "ids"],
                )

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string"))
    return map_arrow(slim, run, TOKEN_SCHEMA)


def _slices(ends: np.ndarray, most: int = 1 << 22):
    """Runs (lo, hi) of rows of about ``most`` bytes at most, one row at least."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# -- rounds -----------------------------------------------------------------------
def credit(queue: Column, held: Column, most: int) -> Column:
    """What a queue has before its first round: by its hash, less than a run and than all it holds.

    Without it, sources of one document or two would all come due in the last round.
    """
    return F.pmod(F.xxhash64(F.coalesce(F.concat(F.lit("="), queue), F.lit("-"))), F.least(held, F.lit(most).cast("long")))


def queue_table(parts: DataFrame, weights: dict[str, int] | None, most: int) -> DataFrame:
    """(queue, held, tier, weight, credit): sources with a given weight first, the others by what they hold."""
    queues = parts.groupBy("queue").agg(F.sum("held").alias("held"))
    given = parts.sparkSession.createDataFrame([(k, int(v)) for k, v in (weights or {}).items() if v > 0], "name string, given long")
    queues = queues.join(F.broadcast(given), F.col("queue") == F.col("name"), "left")  # as large as the caller's own argument
    return queues.select("queue", "held", F.when(F.col("given").isNull(), 1).otherwise(0).cast("long").alias("tier"), F.coalesce("given", "held").alias("weight"), credit(F.col("queue"), F.col("held"), most).alias("credit"))


def schedule(tokens: DataFrame, weights: dict[str, int] | None, length: int, most: int) -> tuple[DataFrame | None, int]:
    """The runs of all documents: (doc_id, queue, n, ids, at, size, stop, due, slot), None without rows, and how many tokens there are.

    ``stop`` is the run's end in its queue and ``due`` its round, exact in decimals of 38
    digits; ``slot`` is its block of rounds, those of weighted sources first.
    """
    parts = materialize(tokens.groupBy("queue", "part").agg(F.sum("n").alias("held")), "pack-parts")
    queues = materialize(queue_table(parts, weights, most), "pack-queues")
    tiers = queues.groupBy("tier").agg(F.sum("weight").alias("w"), F.sum("held").alias("held")).collect()  # two rows at most
    sums = {r["tier"]: r["w"] for r in tiers}
    if not sums:
        return None, 0
    w = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("queue").alias("bq"), F.col("part").alias("bp"), F.coalesce(F.sum("held").over(w), F.lit(0)).alias("before"))
    places = before.join(queues.withColumnRenamed("queue", "qq"), F.col("bq").eqNullSafe(F.col("qq"))).drop("qq", "held")
    places = materialize(places, "pack-places")
    runs = tokens.join(places, F.col("queue").eqNullSafe(F.col("bq")) & (F.col("part") == F.col("bp")))
    runs = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("at"))
    runs = runs.withColumn("size", F.least(F.lit(most).cast("long"), F.col("n") - F.col("at")))
    runs = runs.withColumns({"stop": F.expr("before + start + at + size"), "whole": F.when(F.col("tier") == 0, F.lit(sums.get(0, 0))).otherwise(F.lit(sums.get(1, 0)))})
    # the first round whose quanta, length * weight / whole each, cover the queue up to the run's end
    quantum = f"(cast({length} as decimal(10,0)) * cast(weight as decimal(19,0)))"
    need = "(cast(stop - credit as decimal(19,0)) * cast(whole as decimal(19,0)))"
    runs = runs.withColumn("due", F.expr(f"greatest(1L, ({need} + {quantum} - 1) div {quantum})"))
    return runs.withColumn("slot", F.expr(f"tier * {1 << 61} + due div {ROUNDS_A_BLOCK}")), sum(r["held"] for r in tiers)


def slot_starts(runs: DataFrame) -> DataFrame:
    """(s, begin): where each block of rounds begins in the stream."""
    blocks = materialize(runs.groupBy("slot").agg(F.sum("size").alias("b")).withColumn("g", F.expr(f"slot div {BLOCKS_A_GROUP}")), "pack-blocks")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row for thousands of blocks, each of about half a million tokens
    groups = blocks.groupBy("g").agg(F.sum("b").alias("b")).select(F.col("g").alias("gg"), F.coalesce(F.sum("b").over(before.orderBy("g")), F.lit(0)).alias("base"))
    inner = blocks.select("slot", "g", F.coalesce(F.sum("b").over(before.partitionBy("g").orderBy("slot")), F.lit(0)).alias("own"))
    return materialize(inner.join(groups, F.col("g") == F.col("gg")).select(F.col("slot").alias("s"), (F.col("base") + F.col("own")).alias("begin")), "pack-starts")


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(length: int, with_ids: bool):
    """Runs in the order of the stream to pieces; holds one batch and where the stream stands."""

    def run(batches):
        stands, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            at, size, slot, begin = (b.column(i).to_numpy() for i in (2, 3, 4, 5))
            new = np.concatenate(([slot[0] != last], slot[1:] != slot[:-1]))
            before = np.cumsum(size) - size
            firsts = np.flatnonzero(new)
            place = before + np.concatenate(([stands], begin[firsts] - before[firsts]))[np.cumsum(new)]
            stands, last = int(place[-1] + size[-1]), slot[-1]
            cuts = (place + size - 1) // length - place // length + 1
            row = np.repeat(np.arange(len(size)), cuts)
            window = place[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            lo, hi = np.maximum(place[row], window * length), np.minimum(place[row] + size[row], (window + 1) * length)
            raw = b"".join(b.column(6).to_pylist())
            flat = np.frombuffer(raw, "<u2" if len(raw) == 2 * size.sum() else "<u4").astype("<u4")
            where = before[row] + lo - place[row]
            view = memoryview(flat.tobytes())
            sums = [zlib.crc32(view[a:z]) for a, z in zip((4 * where).tolist(), (4 * (where + hi - lo)).tolist(), strict=True)]
            pick = pa.array(row)
            cols = [b.column(0).take(pick), pa.array(at[row] + lo - place[row]), pa.array(hi - lo), pa.array(sums, pa.int64()), b.column(1).take(pick), pa.array(window), pa.array(lo - window * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:  # the pieces lie in the batch as they do in the runs
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(where, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, weights: dict[str, int] | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = True, end_id: int = END_ID, most: int | None = None) -> DataFrame:
    """One row per piece: its document, its place there, its sequence and its offset.

    ``weights`` are the sources' target proportions (integers); a source without one comes
    when only such are left, by what it holds. Without weights each window has the corpus's
    own proportions, the only target that holds to the last window if every token is to be
    packed. A queue that runs out is skipped, and the others share its room. ``most`` (a
    quarter of ``length`` by default) bounds what a queue sends at once: documents up to it
    are cut by a window's end alone, and no source is further than about ``most`` tokens
    from its target after any number of windows.

    Null text: the end id alone. Null sources form a queue of their own, null ids stay null,
    repeated rows are documents of their own, other columns aren't read, an empty table
    gives no rows. Only the last sequence can be short. Documents are tokenized once, in a
    narrow pass into the shared folder; only their ids are shuffled, once, by blocks of
    rounds, which hold about equal numbers of tokens whatever the sources' sizes and number.
    No table of sources goes to the driver or has to fit a task.
    """
    spark = docs.sparkSession
    if length < 1 or (most is not None and most < 1):
        raise ValueError("a window and a run need a token at least")
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    tokens = materialize(tokenize(docs, tokenizer_path, id_col, text_col, source_col, end_id), "pack-tokens")
    runs, held = schedule(tokens, weights, length, most or max(1, length // 4))
    if runs is None:
        return spark.createDataFrame([], schema)
    starts = slot_starts(runs)
    width = F.expr("cast(length(ids) div n as int)")
    ids = F.substr("ids", F.col("at").cast("int") * width + 1, F.col("size").cast("int") * width)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-held // TOKENS_A_TASK)))
    placed = runs.select("doc_id", "n", "at", "size", "slot", "due", "queue", "stop", ids.alias("ids")).repartition(tasks, "slot")
    placed = placed.join(starts, F.col("slot") == F.col("s")).sortWithinPartitions("slot", "due", "queue", "stop")
    return map_arrow(placed.select("doc_id", "n", "at", "size", "slot", "begin", "ids"), _place(length, with_ids), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
