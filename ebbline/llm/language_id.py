"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of words (lower case, letters only, with word
ends). All languages share one sorted array of n-gram hashes per order, whose rows hold
the interpolated log-probabilities of every language; what an order doesn't hold backs
off through a second sorted array of context weights. Both grow with the data: tasks
write them to the shared folder, and workers map them. The language with the lowest
cross-entropy per character wins; thresholds calibrated on learned documents reject.
"""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import ChunkTable, fresh, made, map_arrow, materialize, shared_dir, slices, word_blocks, worker_keeps

ORDER = 5
#: About the rows that one task sorts, and the values that it interpolates at once.
ROWS_A_TASK, VALUES_A_TASK = 200_000, 4_000_000
MAX_LANGUAGES = 512
#: Cross-entropies are ranked in steps of 2 ** -32, read in digits of RADIX bits.
ENTROPY_SCALE, ENTROPY_BITS, RADIX = float(1 << 32), 40, 8
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0)
UND = "und"
#: Words: runs of letters with their marks.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_step(h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (symbol.astype(np.uint64) + np.uint64(1))) * _MIX
        return x ^ (x >> np.uint64(29))


def _suffix_hashes(codes: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place."""
    h = np.full(len(place), n, np.uint64)
    for k in range(n - 1, -1, -1):
        h = hash_step(h, codes[place - k])
    return h


def _layout(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of ``^word$`` in a row, and for each predicted one its place, depth and word."""
    text = "".join([f"^{w}$" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.flatnonzero(depth > 0)
    return codes, place, depth[place], word[place]


def letters_of(chunk: str) -> list[str]:
    return _LETTERS.findall(chunk.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTERS.search(text) is not None


# -- counting -----------------------------------------------------------------------
def _gram_counts(words: dict[str, int], order: int) -> tuple[list[str], np.ndarray]:
    """The longest n-gram (up to ``order``) that ends at each symbol, with counts."""
    grams: list[str] = []
    counts: list[np.ndarray] = []
    keys = list(words)
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        codes, place, depth, word = _layout(part)
        weight = np.array([words[w] for w in part], np.int64)[word]
        text = "".join([f"^{w}$" for w in part])
        for n in range(2, order + 1):
            here = place[(depth + 1 == n) if n < order else (depth + 1 >= order)]
            if not len(here):
                continue
            own = weight[(depth + 1 == n) if n < order else (depth + 1 >= order)]
            h = _suffix_hashes(codes, here, n)
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            grams += [text[p - n + 1 : p + 1] for p in here[first].tolist()]
            counts.append(np.bincount(inverse, weights=own).astype(np.int64))
    return grams, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def count_grams(docs: DataFrame, text_col: str, lang_col: str, order: int = ORDER, limit: int = 150_000) -> DataFrame:
    """(lang, gram, n) summed over whole texts of all rows; pre-aggregated in each task."""

    def run(batches):
        words: dict[str, Counter] = {}
        long = False

        def flush():
            for lang, chunks in words.items():
                pure: Counter = Counter()
                for chunk, n in chunks.items():
                    for w in letters_of(chunk):
                        pure[w] += n
                grams, n = _gram_counts(pure, order)
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            words.clear()

        for batch in batches:
            for b in slices(batch):
                texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
                for owner, length, flat in word_blocks(texts):
                    at = 0
                    for i, n in zip(owner.tolist(), length.tolist(), strict=True):
                        words.setdefault(langs[i], Counter()).update(flat[at : at + n])
                        at += n
                    long |= max(map(len, flat)) > ChunkTable.longest
                if long or sum(map(len, words.values())) > limit:
                    long = False
                    yield from flush()
        yield from flush()

    parts = map_arrow(docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")), run, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# -- the model ------------------------------------------------------------------------
class KneserNey:
    """Interpolated Kneser-Ney models of several languages in shared sorted hash arrays."""

    def __init__(self, langs: list[str], grams: dict[int, tuple], contexts: dict[int, tuple], floor: np.ndarray, thresholds: dict | None = None):
        self.langs, self.grams, self.contexts, self.floor = langs, grams, contexts, floor
        self.thresholds = thresholds or {}
        self.order = max(grams) if grams else 0
        self.folder: str | None = None

    @classmethod
    def fit(cls, counts: pd.DataFrame, order: int = ORDER) -> KneserNey:
        """``counts``: lang, gram, n with the longest n-grams, as ``count_grams`` gives them."""
        langs = sorted(counts["lang"].unique())
        per = []
        for lang in langs:
            rows = counts[counts["lang"] == lang]
            tables: dict[int, dict[str, int]] = {n: {} for n in range(1, order + 1)}
            for g, n in zip(rows["gram"], rows["n"], strict=True):
                tables[len(g)][g] = int(n)
            for n in range(order, 1, -1):  # continuation counts: distinct symbols to the left
                for g in tables[n]:
                    s = g[1:]
                    tables[n - 1][s] = tables[n - 1].get(s, 0) + 1
            per.append(tables)
        size = len({g for t in per for g in t[1]}) + 1
        L = len(langs)
        grams: dict[int, tuple] = {}
        contexts: dict[int, tuple] = {}
        floor = np.full(L, 1.0 / size)
        lower: dict[str, np.ndarray] = {}
        for n in range(1, order + 1):
            union = sorted({g for t in per for g in t[n]})
            heads = sorted({g[:-1] for g in union})
            head_at = {h: i for i, h in enumerate(heads)}
            at = np.array([head_at[g[:-1]] for g in union], np.int64)
            p = np.zeros((len(union), L))
            weight = np.ones((len(heads), L))
            for j, tables in enumerate(per):
                c = np.array([tables[n].get(g, 0) for g in union], float)
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(at, weights=c, minlength=len(heads))
                types = np.bincount(at, weights=c > 0, minlength=len(heads))
                seen = total > 0
                weight[seen, j] = d * types[seen] / total[seen]
                p[:, j] = np.where(seen[at], np.maximum(c - d, 0) / np.where(seen[at], total[at], 1), 0)
            below = np.array([lower[g[1:]] for g in union]) if n > 1 and union else np.broadcast_to(floor, (len(union), L))
            p += weight[at] * below if len(union) else 0
            lower = dict(zip(union, p, strict=True))
            grams[n] = cls._sorted(union, np.log(p))
            contexts[n - 1] = cls._sorted(heads, np.log(weight))
        return cls(langs, grams, contexts, np.log(floor))

    @staticmethod
    def _sorted(names: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.empty(len(names), np.uint64)
        by: dict[int, list[int]] = {}
        for i, g in enumerate(names):
            by.setdefault(len(g), []).append(i)
        for n, at in by.items():
            if n == 0:
                h[at] = 0
                continue
            codes = np.frombuffer("".join([names[i] for i in at]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            h[at] = _suffix_hashes(codes, np.arange(n - 1, n * len(at), n), n)
        order = np.argsort(h, kind="stable")
        return h[order], rows[order].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = table[0]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages + 1): log-probabilities summed, and the number of symbols."""
        out = np.zeros((len(words), len(self.langs) + 1))
        if not words:
            return out
        codes, place, depth, word = _layout(words)
        # equal longest n-grams have equal scores: look up each once
        top = np.minimum(depth + 1, self.order)
        whole = np.empty(len(place), np.uint64)
        for n in np.unique(top).tolist():
            here = top == n
            whole[here] = _suffix_hashes(codes, place[here], n)
        _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
        p, t = place[first], top[first]
        score = np.tile(self.floor.astype(np.float64), (len(p), 1))
        owed = np.zeros_like(score)
        open_ = np.ones(len(p), bool)
        for n in range(self.order, 0, -1):
            here = np.flatnonzero(open_ & (t >= n))
            if not len(here):
                continue
            at, hit = self._find(self.grams[n], _suffix_hashes(codes, p[here], n))
            score[here[hit]] = self.grams[n][1][at[hit]]
            open_[here[hit]] = False
            miss = here[~hit]
            if len(miss):  # the context's share for what it hasn't seen
                h = _suffix_hashes(codes, p[miss] - 1, n - 1) if n > 1 else np.zeros(len(miss), np.uint64)
                at, hit = self._find(self.contexts[n - 1], h)
                owed[miss[hit]] += self.contexts[n - 1][1][at[hit]]
        each = (score + owed)[inverse]
        np.add.at(out[:, :-1], word, each)
        out[:, -1] = np.bincount(word, minlength=len(words))
        return out

    def chunk_scores(self, chunks: list[str]) -> np.ndarray:
        found = [letters_of(c) for c in chunks]
        flat = [w for f in found for w in f]
        per_word = self.word_scores(flat)
        out = np.zeros((len(chunks), len(self.langs) + 1))
        np.add.at(out, np.repeat(np.arange(len(chunks)), [len(f) for f in found]), per_word)
        return out

    def table(self) -> ChunkTable:
        return ChunkTable(self.chunk_scores, len(self.langs) + 1)

    def judge(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Winner (-1: no letter), calibrated score, cross-entropy and rejection per row."""
        n = sums[:, -1]
        entropy = np.where(n[:, None] > 0, -sums[:, :-1] / np.maximum(n, 1)[:, None], 0.0)
        best = entropy.argmin(axis=1)
        sharp = self.thresholds.get("sharpness", 8.0)
        low = entropy.min(axis=1)
        odds = np.exp(-sharp * (entropy - low[:, None]))
        score = np.where(n > 0, 1.0 / odds.sum(axis=1), 0.0)
        most = np.array([self.thresholds.get("entropy", {}).get(x, np.inf) for x in self.langs])
        rejected = (n == 0) | (low > most[best]) | (score < self.thresholds.get("score", 0.0))
        return np.where(n > 0, best, -1), score, low, rejected

    def numbers(self, sums: np.ndarray, own: list[str | None]) -> np.ndarray:
        """A row of ``NUMBERS`` per row of ``sums``; the first ones are NaN without a learned language or letters.

        They are all that thresholds and verdicts need, whatever the number of languages.
        """
        n = sums[:, -1]
        entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        rows, number = np.arange(len(n)), {x: j for j, x in enumerate(self.langs)}
        at = np.array([number.get(x, -1) for x in own], np.int64)
        learned = (at >= 0) & (n > 0)
        low = entropy.min(axis=1)
        losses, scores = [], []
        for sharp in SHARPNESS:
            z = -sharp * (entropy - low[:, None])
            total = np.exp(z).sum(axis=1)
            losses.append(np.where(learned, np.log(total) - z[rows, at], np.nan))
            scores.append(np.where(n > 0, 1.0 / total, 0.0))
        best = np.where(n > 0, entropy.argmin(axis=1), -1)
        return np.stack([np.where(learned, entropy[rows, at], np.nan), *losses, best, np.where(n > 0, low, 0.0), *scores], axis=1)

    def decide(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``judge``, of rows of ``NUMBERS``."""
        k = len(SHARPNESS)
        best, low = numbers[:, 1 + k].astype(np.int64), numbers[:, 2 + k]
        score = numbers[:, 3 + k + SHARPNESS.index(self.thresholds.get("sharpness", 8.0))]
        most = np.array([self.thresholds.get("entropy", {}).get(x, np.inf) for x in self.langs])
        return best, score, low, (best < 0) | (low > most[best]) | (score < self.thresholds.get("score", 0.0))

    def calibrate(self, trials: DataFrame) -> None:
        """Thresholds from all learned documents: a wide margin over what a language's own ones need.

        ``trials``: l, x (the first of ``NUMBERS``), a stored table with a row for each.
        """
        k = [F.col("x")[i] for i in range(1 + len(SHARPNESS))]
        fine = trials.where(~F.isnan(k[0]))
        by = {r["l"]: r for r in fine.groupBy("l").agg(F.count("*").alias("n"), F.stddev_pop(k[0]).alias("sd"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(k)]).collect()}
        total = sum(r["n"] for r in by.values())
        enough = {x: r["n"] for x, r in by.items() if r["n"] >= 10}
        wanted = {x: {int(q * (n - 1)) + up for q in (0.5, 0.99) for up in (0, 1) if int(q * (n - 1)) + up < n} for x, n in enough.items()}
        found = at_ranks(fine.select("l", F.rint(F.least(F.greatest(k[0], F.lit(0.0)) * ENTROPY_SCALE, F.lit(2.0**ENTROPY_BITS - 1))).cast("long").alias("k")), wanted)

        def quantile(lang: str, q: float) -> float:
            at, n = q * (enough[lang] - 1), enough[lang]
            low, high = found[lang, int(at)], found[lang, min(int(at) + 1, n - 1)]
            return (low + (high - low) * (at - int(at))) / ENTROPY_SCALE

        limit = {x: max(quantile(x, 0.99) + 3 * by[x]["sd"], 1.5 * quantile(x, 0.5)) for x in sorted(enough)}
        losses = np.array([sum(r[f"s{i}"] for r in by.values()) / total for i in range(1, 1 + len(SHARPNESS))]) if total else None
        sharp = SHARPNESS[int(np.round(losses, 9).argmin())] if total else 8.0
        self.thresholds = {"sharpness": sharp, "entropy": limit, "score": 0.5 if len(self.langs) > 1 else 0.0}

    def dump(self) -> bytes:
        """All of an own model; of one in the shared folder, where its arrays are."""
        if self.folder:
            return json.dumps({"folder": self.folder, "langs": self.langs, "order": self.order, "floor": self.floor.tolist(), "thresholds": self.thresholds}).encode()
        out = io.BytesIO()
        arrays = {f"g{n}{k}": a for n, t in self.grams.items() for k, a in enumerate(t)} | {f"c{n}{k}": a for n, t in self.contexts.items() for k, a in enumerate(t)}
        np.savez(out, floor=self.floor, meta=np.array(json.dumps({"langs": self.langs, "thresholds": self.thresholds})), **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> KneserNey:
        if data[:1] == b"{":  # a mapped one
            spec = json.loads(data)
            return mapped(spec["folder"], spec["langs"], spec["order"], np.array(spec["floor"]), spec["thresholds"])
        z = np.load(io.BytesIO(data))
        meta = json.loads(str(z["meta"]))
        numbers = lambda c: sorted({int(k[1:-1]) for k in z.files if re.fullmatch(rf"{c}\d+", k)})
        return cls(meta["langs"], {n: (z[f"g{n}0"], z[f"g{n}1"]) for n in numbers("g")}, {n: (z[f"c{n}0"], z[f"c{n}1"]) for n in numbers("c")}, z["floor"], meta["thresholds"])


# -- fitting over all n-grams -----------------------------------------------------------
def mapped(folder: str, langs: list[str], order: int, floor: np.ndarray, thresholds: dict | None = None) -> KneserNey:
    """The model whose arrays tasks have written to ``folder``."""

    grams = {n: (_map(folder, f"g{n}.h"), _map(folder, f"g{n}.p", len(langs))) for n in range(1, order + 1)}
    contexts = {n: (_map(folder, f"c{n}.h"), _map(folder, f"c{n}.w", len(langs))) for n in range(order)}
    out = KneserNey(langs, grams, contexts, floor, thresholds)
    out.folder = folder
    return out


_KINDS = {"h": np.uint64, "a": np.float64, "t": np.float64, "w": np.float32, "p": np.float32, "s": np.uint32}


def _map(folder: str, name: str, width: int = 0) -> np.ndarray:
    path, kind = f"{folder}/{name}", _KINDS[name[-1]]
    size = os.path.getsize(path) if os.path.exists(path) else 0
    found = np.asarray(np.memmap(path, kind, "r")) if size else np.zeros(0, kind)
    return found.reshape(-1, width) if width else found


def _write(path: str, parts: list[np.ndarray]) -> None:
    """One file, as a whole or not at all, so that an attempt can be repeated."""
    own = f"{path}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for x in parts:
            f.write(np.ascontiguousarray(x).tobytes())
    os.replace(own, path)


def _join(folder: str, names: list[str], into: str) -> None:
    with open(f"{folder}/{into}", "wb") as out:
        for name in names:
            with open(f"{folder}/{name}", "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
            os.remove(f"{folder}/{name}")


def _rows_a_task(n_langs: int) -> int:
    return max(1, min(ROWS_A_TASK, VALUES_A_TASK // n_langs))


def _flat(names: list[str]) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le", "replace"), np.uint32)


def _store(rows: DataFrame, n_rows: int, folder: str, kind: str, n_langs: int, columns) -> None:
    """Sorted arrays of ``rows`` (s, v: array of j, a, b) per length of s, written by the tasks.

    ``columns(a, b, length)`` gives the files' contents by their extension, from dense
    arrays of a row's values for each language.
    """
    bits = (n_rows // _rows_a_task(n_langs)).bit_length()

    def keyed(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            size = np.fromiter(map(len, names), np.int64, len(names))
            h = np.zeros(len(names), np.uint64)
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                h[at] = _suffix_hashes(_flat([names[i] for i in at.tolist()]).astype(np.uint64), np.arange(n - 1, n * len(at), n), n)
            top = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((h ^ np.uint64(1 << 63)).view(np.int64)), pa.array((size << bits) + top)], names=["s", "v", "key", "bucket"])

    def write(batches):
        bucket, held = None, {}

        def end():
            if bucket is not None:
                for ext, parts in held.items():
                    _write(f"{folder}/{kind}-{bucket}.{ext}", parts)
                return [bucket]
            return []

        done = []
        for b in batches:
            buckets = b.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if buckets[lo] != bucket:
                    done += end()
                    bucket, held = int(buckets[lo]), {}
                part = b.slice(lo, hi - lo)
                j, x, y = (c.to_numpy(zero_copy_only=False) for c in part.column(1).flatten().flatten())
                owner = np.repeat(np.arange(hi - lo), part.column(1).value_lengths().to_numpy())
                first, second = np.zeros((hi - lo, n_langs)), np.zeros((hi - lo, n_langs))
                first[owner, j], second[owner, j] = x, y
                got = columns(first, second, bucket >> bits)
                got["h"] = part.column(2).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
                if kind == "g":
                    got["s"] = _flat(part.column(0).to_pylist())
                for ext, value in got.items():
                    held.setdefault(ext, []).append(value.astype(_KINDS[ext]))
        done += end()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["bucket"])

    schema = "s string, v array<struct<j:int,a:double,b:double>>, key long, bucket long"
    sorted_rows = map_arrow(rows, keyed, schema).repartition(max(8, 1 << bits), "bucket").sortWithinPartitions("bucket", "key")
    found = sorted(r["bucket"] for r in sorted_rows.mapInArrow(write, "bucket long").collect())
    for n in sorted({x >> bits for x in found}):
        for ext in ("h", "a", "s") if kind == "g" else ("h", "t", "w"):
            _join(folder, [f"{kind}-{x}.{ext}" for x in found if x >> bits == n], f"{kind}{n}.{ext}")


def fit_stored(grams: DataFrame, langs: list[str], order: int = ORDER) -> KneserNey:
    """``KneserNey.fit`` over (lang, gram, n) of any size.

    Continuation counts, context totals and types and discounts are aggregates over all
    n-grams. The arrays are sorted, interpolated and written by tasks; the driver only
    joins files and holds a few numbers a language and order.
    """
    spark, many = grams.sparkSession, len(langs)
    root = re.sub("^file:(//)?", "", shared_dir(spark))
    if "://" in root:
        raise ValueError("the model's arrays are mapped, so the shared folder must be one of the file system")
    folder = f"{root}/ebbline-lid-model-{uuid.uuid4().hex}"
    os.makedirs(folder)
    made(folder)
    number = F.create_map(*[F.lit(x) for j, lang in enumerate(langs) for x in (lang, j)])
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda i: F.struct(F.substr("gram", i).alias("s"), F.when(i == 1, F.col("n")).otherwise(0).alias("c")))
    keys = grams.select(number[F.col("lang")].alias("j"), F.explode(ends).alias("e")).groupBy("j", "e.s").agg(F.sum("e.c").alias("c"))
    keys = materialize(keys, "lid-keys")
    more = keys.where(F.length("s") > 1).select("j", F.substr("s", F.lit(2)).alias("s"), F.lit(1).cast("long").alias("c"))
    counts = materialize(keys.unionByName(more).groupBy("j", "s").agg(F.sum("c").alias("c")), "lid-counts")
    discount = {n: np.full(many, 0.5) for n in range(1, order + 1)}
    for r in counts.groupBy("j", F.length("s").alias("m")).agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")).collect():
        if r["ones"] and r["twos"]:
            discount[r["m"]][r["j"]] = r["ones"] / (r["ones"] + 2 * r["twos"])
    start = 1.0 / (counts.where(F.length("s") == 1).select("s").distinct().count() + 1)
    n_rows = counts.count()

    def whole(frame, a, b):
        return frame.groupBy("s").agg(F.collect_list(F.struct(F.col("j"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))).alias("v"))

    def context(total, types, n):
        seen = total > 0
        return {"t": total, "w": np.log(np.where(seen, discount[n + 1] * types / np.where(seen, total, 1), 1.0))}

    heads = counts.groupBy("j", F.substr("s", F.lit(1), F.length("s") - 1).alias("s")).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
    _store(whole(counts, "c", "c"), n_rows, folder, "g", many, lambda c, _, n: {"a": c})
    _store(whole(heads, "total", "types"), n_rows, folder, "c", many, context)

    step = _rows_a_task(many)
    sizes = {n: len(_map(folder, f"g{n}.h")) for n in range(1, order + 1)}
    ranges = [(n, lo, min(lo + step, size)) for n, size in sizes.items() for lo in range(0, size, step)]

    def interpolate(batches):
        find = KneserNey._find
        for b in batches:
            for i in b.column(0).to_pylist():
                n, lo, hi = ranges[i]
                flat = _map(folder, f"g{n}.s", n)[lo:hi].ravel().astype(np.uint64)
                last = np.arange(n - 1, n * (hi - lo), n)
                p = np.full((hi - lo, many), start)
                for k in range(1, n + 1):  # from the last symbol alone to the whole n-gram
                    at, _ = find((_map(folder, f"g{k}.h"), None), _suffix_hashes(flat, last, k))
                    c = _map(folder, f"g{k}.a", many)[at]
                    h = _suffix_hashes(flat, last - 1, k - 1) if k > 1 else np.zeros(hi - lo, np.uint64)
                    at, _ = find((_map(folder, f"c{k - 1}.h"), None), h)
                    total, weight = _map(folder, f"c{k - 1}.t", many)[at], _map(folder, f"c{k - 1}.w", many)[at]
                    p = np.maximum(c - discount[k], 0) / np.where(total > 0, total, 1) + np.exp(weight.astype(float)) * p
                _write(f"{folder}/p-{i}.p", [np.log(p).astype(np.float32)])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64())], names=["i"])

    spark.range(0, len(ranges), 1, max(1, len(ranges))).mapInArrow(interpolate, "i long").collect()
    for n in sizes:
        _join(folder, [f"p-{i}.p" for i, r in enumerate(ranges) if r[0] == n], f"g{n}.p")
        for name in (f"g{n}.a", f"g{n}.s", f"c{n - 1}.t"):  # only the fit needs them
            if os.path.exists(f"{folder}/{name}"):
                os.remove(f"{folder}/{name}")
    return mapped(folder, langs, order, np.full(many, np.log(start)))


def at_ranks(rows: DataFrame, wanted: dict[str, set[int]]) -> dict[tuple[str, int], int]:
    """Of each language's sorted k those at the wanted ranks (from 0), exactly.

    ``rows``: l, k from 0 below 2 ** ``ENTROPY_BITS``. k is found digit by digit, from counts
    of every row; a round brings the driver at most 2 ** ``RADIX`` counts for each rank.
    """
    found = {(lang, rank): (0, rank) for lang, ranks in wanted.items() for rank in ranks}  # the digits so far, the rank among those with them
    if not found:
        return {}
    for shift in range(ENTROPY_BITS - RADIX, -1, -RADIX):
        heads = rows.sparkSession.createDataFrame(sorted({(lang, head) for (lang, _), (head, _) in found.items()}), "l string, head long")
        own = rows.withColumn("head", F.shiftright("k", shift + RADIX)).join(F.broadcast(heads), ["l", "head"])
        counts: dict[tuple, list] = {}
        for r in own.groupBy("l", "head", F.shiftright("k", shift).alias("d")).agg(F.count("*").alias("n")).collect():
            counts.setdefault((r["l"], r["head"]), []).append((r["d"], r["n"]))
        for (lang, rank), (head, left) in found.items():
            for d, n in sorted(counts[lang, head]):
                if left < n:
                    found[lang, rank] = (d, left)
                    break
                left -= n
    return {key: k for key, (k, _) in found.items()}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> KneserNey | None:
    """Models of all languages in ``docs``, without thresholds; None if there is nothing to learn from.

    Counts and model cover every n-gram of every row, of ``MAX_LANGUAGES`` languages at
    most; the model's arrays stay in the shared folder.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    grams = materialize(count_grams(known, text_col, lang_col, order), "lid-grams")
    langs = [r["lang"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()]
    if not langs:
        return None
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    return fit_stored(grams, sorted(langs), order)


#: What ``KneserNey.numbers`` gives: cross-entropy in the own language, the loss for each of
#: ``SHARPNESS``, winner (-1: no letter), lowest cross-entropy, the score for each of ``SHARPNESS``.
NUMBERS = 3 + 2 * len(SHARPNESS)


def measured(docs: DataFrame, model: KneserNey, text_col: str, lang: Column, keep: dict[str, Column], calibrating: bool = False) -> DataFrame:
    """Columns ``keep``, l (``lang``), h (a hash of the text) and x (its ``NUMBERS``; the first ones if only ``calibrating``)."""
    data = spark_of(docs).broadcast(model.dump())
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*[c.alias(name) for name, c in keep.items()], lang.cast("string").alias("l"), F.xxhash64(text).alias("h"), text.alias("t"))
    width = 1 + len(SHARPNESS) if calibrating else NUMBERS

    def run(batches):
        m, table = _loaded(data.value)
        for batch in batches:
            for b in slices(batch, 500):
                got = m.numbers(table.sums(b.column(b.num_columns - 1).to_pylist()), b.column(b.num_columns - 3).to_pylist())
                x = pa.ListArray.from_arrays(np.arange(0, width * b.num_rows + 1, width, dtype=np.int32), pa.array(np.ascontiguousarray(got[:, :width]).ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], x.cast(pa.list_(pa.float64()))], names=[*rows_names, "x"])

    rows_names = rows.columns[:-1]
    return map_arrow(rows, run, rows.drop("t").schema.add("x", T.ArrayType(T.DoubleType())))


def trials(rows: DataFrame) -> DataFrame:
    """A stored row (l, x) for each different learned document among ``measured`` ones."""
    some = rows.where("l is not null").select("l", "h", F.slice("x", 1, 1 + len(SHARPNESS)).alias("x"))
    return materialize(some.groupBy("l", "h").agg(F.first("x").alias("x")).select("l", "x"), "lid-trials")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> KneserNey | None:
    """``fit`` with thresholds from the whole texts of all its different documents; the tasks score them."""
    model = fit(docs, text_col, lang_col, order)
    if model:
        known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        model.calibrate(trials(measured(known, model, text_col, F.col(f"`{lang_col}`"), {}, calibrating=True)))
    return model


def spark_of(docs: DataFrame):
    return docs.sparkSession.sparkContext


def _loaded(data: bytes) -> tuple[KneserNey, ChunkTable]:
    """The model and its chunk scores, once per Python worker."""

    def make():
        model = KneserNey.load(data)
        return model, model.table()

    return worker_keeps(("language", data), make)


def _judged(docs: DataFrame, model: KneserNey | None, text_col: str, keep: list[str], names: list[str]) -> DataFrame:
    """Columns ``keep`` and winner, score, cross-entropy and rejection under ``names``."""
    data = spark_of(docs).broadcast(model.dump() if model else b"")
    t = fresh(docs, stem="text")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(t))

    def run(batches):
        m, table = _loaded(data.value) if data.value else (None, None)
        for batch in batches:
            for b in slices(batch, 500):
                texts = b.column(b.num_columns - 1).to_pylist()
                if m:
                    best, score, low, rejected = m.judge(table.sums(texts))
                    # a letter alone decides; lower() can't make or lose one here
                    pred = [m.langs[j] if j >= 0 else UND for j in best.tolist()]
                else:
                    pred, score, low, rejected = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, *names])

    schema = kept.drop(t).schema
    for name, kind in zip(names, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return map_arrow(kept, run, schema)


def identify(docs: DataFrame, model: KneserNey | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and lang_pred, score, cross_entropy, rejected.

    ``und`` for texts that are null or without a letter, or without a model. One narrow
    pass over whole texts; repeated rows repeat; input columns of these names give way.
    """
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    return _judged(docs, model, text_col, [c for c in (keep or docs.columns) if c.lower() not in new], new)


def accepted(docs: DataFrame, model: KneserNey | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns as they are."""
    p = fresh(docs)
    names = [f"{p}{x}" for x in ("pred", "score", "entropy", "rejected")]
    out = _judged(docs, model, text_col, docs.columns, names)
    return out.where(~F.col(names[3])).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_and_identify(docs: DataFrame, learned: Column, keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` of all rows by ``train`` on the ``learned`` ones, with one scoring of each text."""
    model = fit(docs.where(learned), text_col, lang_col)
    if not model:
        return identify(docs, None, text_col, keep)
    lang = F.when(learned & F.col(f"`{text_col}`").isNotNull(), F.col(f"`{lang_col}`"))
    rows = materialize(measured(docs, model, text_col, lang, {c: F.col(f"`{c}`") for c in keep}), "lid-measured")
    model.calibrate(trials(rows))
    langs, thresholds = model.langs, model.thresholds

    def run(batches):
        m = KneserNey(langs, {}, {}, np.zeros(0), thresholds)
        for b in batches:
            best, score, low, rejected = m.decide(b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, NUMBERS))
            pred = [langs[j] if j >= 0 else UND for j in best.tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=[*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    rows = rows.select(*keep, "x")
    schema = rows.drop("x").schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")
    return map_arrow(rows, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = learn_and_identify(docs, ~held_out(), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
