"""N-gram Jaccard self-join, size-aware: heavy and light sets.

Documents are sets of word shingles. Equal sets are one class. For the rest:

* Light (small) sets enumerate fixed-size subsets: a pair of sizes (a, b) that reaches the
  threshold shares c = ceil(t (a + b) / (1 + t)) elements, so each set lists its c-subsets
  under the key (a, b, subset), and linked sets meet under an equal key.
* Heavy (large) sets are found by scanning inverted lists. The lists' terms are runs of the
  hash space: a linked pair differs in at most k elements, so of k + 1 runs one holds the
  same elements on both sides. (Some runs more make sure that one of them isn't empty;
  empty runs would be one list for all sets.) Such a term is about 1 / (1 - t) shingles together, so a
  passage that many documents share makes no long list, as its single shingles would.

The boundary between the two is the size where the estimated cost (subsets against terms
with their verification) over the size histogram is least. Lists are read as sorted runs.
Each member is checked against its list's first member, then members of different
components against the components' representatives, and at last what is left pair by
pair, so that a group of near copies costs its members and not its pairs. A parity bitmap
bounds the difference of two sets from below and spares most checks; the checks are exact
on 64-bit shingle hashes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.common import BROADCAST_IDS, by_ids, drop, map_arrow, materialize, recorded, slices, worker_keeps
from ebbline.llm.components import connected_components

BITMAP_WORDS = 8
#: Rounds against representatives before what is left is compared pair by pair.
REPRESENTATIVE_ROUNDS = 4
#: Largest size for which subsets are considered.
LIGHT_MOST = 40
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


class _Words(dict):
    """word -> 64-bit hash; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = found
        return found


def _words() -> _Words:
    return worker_keeps("shingles", _Words)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles.

    A-Z are lower-cased and words are runs of ``[^\\x20\\x09-\\x0D]``. With fewer words than
    a shingle has, the whole sequence is one; without words the set is empty.
    """
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = mix(_rotate(out, 23) + h[k : len(h) - size + 1 + k] * _C3)
    return np.unique(out)


class SizePlan:
    """Sizes, overlaps and terms for one threshold, in integers (t = num / den)."""

    def __init__(self, num: int = 90, den: int = 100, light: int = 0):
        self.num, self.den, self.light = num, den, light
        self._classes: list[tuple[int, int]] = [(1, max(1, den // num))]
        self._cuts: dict[int, np.ndarray] = {}

    def overlap(self, a: int, b: int) -> int:
        """Least common elements of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def most_size(self, a: int) -> int:
        return a * self.den // self.num

    def class_of(self, n: int) -> int:
        while self._classes[-1][1] < n:
            low = self._classes[-1][1] + 1
            self._classes.append((low, max(low, self.most_size(low))))
        lo, hi = 0, len(self._classes) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self._classes[mid][1] < n else (lo, mid)
        return lo

    def differing(self, i: int) -> int:
        """k: the most elements that differ in a linked pair whose smaller set is of class i."""
        a = self._classes[i][1]
        return (self.den - self.num) * (a + self.most_size(a)) // (self.den + self.num)

    def spare(self, i: int) -> int:
        """Runs beyond k + 1: a set with no more empty runs than that needn't list them."""
        least = self.differing(i) + 1
        empty = least * exp(-self._classes[i][0] / least)
        return ceil(2 * empty + 3 * sqrt(empty)) if empty >= 0.02 else 0

    def runs(self, i: int) -> int:
        return self.differing(i) + 1 + self.spare(i)

    def partners(self, n: int) -> list[int]:
        """Sizes of light sets that a set of n can be linked with (equal sets apart)."""
        low = -(-self.num * n // self.den)
        return [b for b in range(low, min(self.most_size(n), self.light) + 1) if b and self.overlap(n, b) <= min(n, b) and not (n == b == self.overlap(n, b))]

    def subset_cost(self, n: int) -> int:
        return sum(comb(n, n - self.overlap(n, b)) for b in self.partners(n))

    def term_cost(self, n: int) -> int:
        i = self.class_of(n)
        return self.runs(i) + (self.runs(i - 1) if i else 0)

    def choose(self, histogram: dict[int, int], check: float = 3.0) -> None:
        """Sets ``light`` to the boundary of least cost; a term costs ``check`` subsets, as it needs verification."""
        best = None
        for x in range(0, LIGHT_MOST + 1):
            self.light = x
            cost = sum(m * ((self.subset_cost(n) if n <= x else 0) + (check * self.term_cost(n) if n > x or self.bridges(n) else 0)) for n, m in histogram.items() if n <= LIGHT_MOST + 5)
            if best is None or cost < best[0]:
                best = (cost, x)
        self.light = best[1]

    def bridges(self, n: int) -> bool:
        """Whether a light set may be linked with a heavy one."""
        return n <= self.light and self.most_size(n) > self.light

    def cuts(self, runs: int) -> np.ndarray:
        if runs not in self._cuts:
            self._cuts[runs] = np.array([(j << 64) // runs for j in range(1, runs)], np.uint64)
        return self._cuts[runs]

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Signed 64-bit keys under which linked sets meet."""
        n = len(h)
        if not n:
            return np.zeros(0, np.int64)
        m = mix(h ^ _C3)
        out: list[np.ndarray] = []
        with np.errstate(over="ignore"):
            if n <= self.light:
                total = m.sum(dtype=np.uint64)
                for b in self.partners(n):
                    gone = n - self.overlap(n, b)
                    if gone == 0:
                        left = np.array([total], np.uint64)
                    elif gone == 1:
                        left = total - m
                    else:
                        pick = np.array(list(combinations(range(n), gone)), np.int64)
                        left = total - m[pick].sum(axis=1, dtype=np.uint64)
                    out.append(mix(left + np.uint64((min(n, b) << 32 | max(n, b)) + (1 << 62))))
            if n > self.light or self.bridges(n):
                i = self.class_of(n)
                run = np.concatenate(([np.uint64(0)], np.cumsum(m, dtype=np.uint64)))
                for j in (i, i - 1):
                    if j < 0:
                        continue
                    runs = self.runs(j)
                    ends = np.concatenate(([0], np.searchsorted(h, self.cuts(runs)), [n]))
                    sums = run[ends[1:]] - run[ends[:-1]]
                    keys = mix(mix(sums + np.uint64(j + 1) * _C3) + np.arange(runs, dtype=np.uint64))
                    # of spare + 1 equal runs one isn't empty, unless both sets have more empty ones
                    filled = ends[1:] > ends[:-1]
                    out.append(keys[filled] if runs - int(filled.sum()) <= self.spare(j) else keys)
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of the elements per bit: differing bits never outnumber differing elements."""
    bits = np.bincount((h >> np.uint64(7)).astype(np.int64) & (64 * BITMAP_WORDS - 1), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_META = "doc_id long, n int, k1 long, k2 long, " + ", ".join(f"m{i} long" for i in range(BITMAP_WORDS))


def _meta(words: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch, 1000):
                rows = np.zeros((b.num_rows, 3 + BITMAP_WORDS), np.int64)
                for i, text in enumerate(b.column(1).to_pylist()):
                    h = shingle_set(text, words)
                    if len(h):
                        with np.errstate(over="ignore"):
                            rows[i, 0] = len(h)
                            rows[i, 1:3] = np.array([mix(h + _C1).sum(dtype=np.uint64), mix(h + _C2).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                        rows[i, 3:] = bitmap(h)
                cols = [b.column(0), pa.array(rows[:, 0].astype(np.int32))] + [pa.array(np.ascontiguousarray(rows[:, j])) for j in range(1, rows.shape[1])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "k1", "k2", *[f"m{j}" for j in range(BITMAP_WORDS)]])

    return run


def _terms(words: int, num: int, den: int, light: int):
    def run(batches):
        plan = _plan(num, den, light)
        for batch in batches:
            for b in slices(batch, 500):
                ids = b.column(0).to_numpy(zero_copy_only=False)
                found = [plan.terms(shingle_set(t, words)) for t in b.column(1).to_pylist()]
                sizes = [len(x) for x in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(ids, sizes).astype(np.int64))], names=["term", "doc"])

    return run


@lru_cache(8)
def _plan(num: int, den: int, light: int) -> SizePlan:
    return SizePlan(num, den, light)


def _scan(batches):
    """Sorted (term, doc) rows to (term, first member, other member); holds one row only."""
    term, first = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        t, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        starts = np.empty(len(t), bool)
        starts[0] = t[0] != term if term is not None else True
        starts[1:] = t[1:] != t[:-1]
        at = np.maximum.accumulate(np.where(starts, np.arange(len(t)), -1))
        lead = np.where(at >= 0, d[np.maximum(at, 0)], first)
        keep = ~starts & (lead != d)
        term, first = t[-1], lead[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(lead[keep]), pa.array(d[keep])], names=["term", "lead", "doc"])


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch, 500):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "s"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        plan = SizePlan(num, den)
        for batch in batches:
            for b in slices(batch, 500):
                ok = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(x) > len(y):
                        x, y = y, x
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                    ok.append(plan.linked(common, len(x), len(y)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class JaccardJoin:
    """The steps of the join over one table; ``classes`` and ``links`` are stored tables."""

    def __init__(self, docs: DataFrame, words: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.words, (self.num, self.den) = docs.sparkSession, words, threshold
        if not 2 * self.num >= self.den or not self.num <= self.den:
            raise ValueError("the threshold must be from 0.5 to 1")
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.meta = materialize(map_arrow(self.docs, _meta(words), _META), "join-meta")
        some = self.meta.where("n > 0 and doc_id is not null")
        marks = [F.first(f"m{i}").alias(f"m{i}") for i in range(BITMAP_WORDS)]  # equal within a class
        self.classes = materialize(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), *marks), "join-classes")
        self.links = None

    def _some_docs(self, ids: DataFrame, listed: bool) -> DataFrame:
        """Documents whose id is (not) in ``ids`` (column id), without moving the texts."""
        return by_ids(self.docs, "doc_id", materialize(ids, "join-ids"), listed)

    def lists(self) -> DataFrame:
        """(term, lead, doc): the members of lists of two and more, next to the first one."""
        sizes = {r["s"]: r["c"] for r in self.classes.groupBy(F.least(F.col("n"), F.lit(LIGHT_MOST + 6)).alias("s")).agg(F.count("*").alias("c")).collect()}
        plan = SizePlan(self.num, self.den)
        plan.choose(sizes)
        rep = self.meta.where("n > 0").join(self.classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"])
        copies = rep.where("doc_id <> rep").select(F.col("doc_id").alias("id")).distinct()
        alone = self._some_docs(copies, False).where("doc_id is not null")
        terms = map_arrow(alone, _terms(self.words, self.num, self.den, plan.light), "term long, doc long")
        ranged = terms.repartition("term").sortWithinPartitions("term", "doc")
        return materialize(map_arrow(ranged, _scan, "term long, lead long, doc long"), "join-lists")

    def _different(self, lists: DataFrame) -> DataFrame:
        """One of the lists of equal members, known by two hash sums and their number.

        Two sets that share many elements share many terms, whose lists say the same.
        """
        doc = F.col("doc")
        signs = lists.groupBy("term").agg(F.min("lead").alias("lead"), F.bit_xor(F.xxhash64(doc)).alias("x"), F.sum(F.shiftright(F.xxhash64(doc, F.lit(7)), 24)).alias("y"), F.count("*").alias("c"))
        kept = signs.groupBy("lead", "x", "y", "c").agg(F.min("term").alias("term"))
        return materialize(lists.join(kept.select("term"), "term", "left_semi"), "join-lists")

    def _known(self, name: str) -> DataFrame:
        return self.classes.select(F.col("rep").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(f"m{i}").alias(f"{name}_m{i}") for i in range(BITMAP_WORDS)])

    def _near(self, a: str = "a", b: str = "b"):
        """Whether sizes and bitmaps leave room for a link."""
        low, high = F.least(f"{a}_n", f"{b}_n").cast("long"), F.greatest(f"{a}_n", f"{b}_n").cast("long")
        differ = sum((F.bit_count(F.col(f"{a}_m{i}").bitwiseXOR(F.col(f"{b}_m{i}"))) for i in range(1, BITMAP_WORDS)), F.bit_count(F.col(f"{a}_m0").bitwiseXOR(F.col(f"{b}_m0"))))
        return (high * self.num <= low * self.den) & (differ * (self.den + self.num) <= (low + high) * (self.den - self.num))

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), once each, that pass the filter."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        return pairs.join(self._known("a"), "a").join(self._known("b"), "b").where(self._near()).select("a", "b")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are linked."""
        both = pairs
        for side, name in (("a", "x"), ("b", "y")):  # only the sets asked for are moved
            ids = materialize(pairs.select(F.col(side).alias("wanted")).distinct(), "join-wanted")
            ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
            some = sets.join(ids, sets["id"] == ids["wanted"], "left_semi")
            both = both.join(some.select(F.col("id").alias(side), F.col("s").alias(name)), side)
        return materialize(map_arrow(both.select("a", "b", "x", "y"), _verify(self.num, self.den), "a long, b long").distinct(), "join-links")

    def _mixed(self, members: DataFrame, edges: DataFrame) -> DataFrame:
        """Members (term, doc, part) of lists that still hold several components."""
        parts = connected_components(edges, native=False).withColumnRenamed("node", "doc")
        out = members.join(parts, "doc", "left").select("term", "doc", F.coalesce("component", "doc").alias("part"))
        # a list of any length is one row a task here, and may be split in the join
        some = out.groupBy("term").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
        return materialize(out.join(some.select("term"), "term", "left_semi"), "join-mixed")

    def solve(self) -> DataFrame:
        """Edges between classes that hold their links together: (a, b)."""
        with recorded() as passing:
            edges = self._edges()
        self.links = materialize(edges, "join-edges")
        drop(self.spark, passing)
        return self.links

    def _edges(self) -> DataFrame:
        with recorded() as whole:
            found = self.lists()
        lists = self._different(found)
        drop(self.spark, whole)
        leads = lists.select("term", F.col("lead").alias("doc")).distinct()
        members = lists.select("term", "doc").union(leads)
        ids = lists.select(F.col("doc").alias("id")).union(lists.select("lead")).distinct()
        sets = materialize(map_arrow(self._some_docs(ids, True), _sets(self.words), "id long, s binary"), "join-sets")
        # 1: each member against the least first member that may be linked with it
        first = self._filtered(lists.select(F.col("lead").alias("a"), F.col("doc").alias("b"))).groupBy("b").agg(F.min("a").alias("a"))
        seen = materialize(first.select("a", "b"), "join-pairs")
        edges = self.verified(seen, sets)
        # 2: members against the representatives of the other components in their lists, while that
        # links any; 3: all that is left between different components
        mixed, rounds, last = None, 0, False
        while True:
            mixed = self._mixed(members, edges) if mixed is None else mixed
            if mixed.isEmpty():
                break
            a = mixed.select("term", F.col("doc").alias("a"), F.col("part").alias("pa"))
            if last:
                b = mixed.select(F.col("term").alias("tb"), F.col("doc").alias("b"), F.col("part").alias("pb"))
            else:
                b = mixed.groupBy(F.col("term").alias("tb"), F.col("part").alias("pb")).agg(F.min("doc").alias("b"))
            a, b = a.join(self._known("a"), "a"), b.join(self._known("b"), "b")
            on = (F.col("term") == F.col("tb")) & ((F.col("pa") < F.col("pb")) if last else (F.col("pa") != F.col("pb"))) & self._near()
            pairs = a.join(b, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = materialize(pairs.join(seen, ["a", "b"], "left_anti"), "join-pairs")
            new = None
            if not pairs.isEmpty():
                new = self.verified(pairs, sets)
                edges, seen = edges.union(new), seen.union(pairs)
            if last:
                break
            rounds += 1
            linked = new is not None and not new.isEmpty()
            mixed = None if linked else mixed
            last = not linked or rounds >= REPRESENTATIVE_ROUNDS
        return edges

    def result(self) -> DataFrame:
        edges = self.solve()
        parts = connected_components(edges, native=False)
        rep = self.classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("c"))
        rep = materialize(rep, "join-result")  # its size decides how it is joined
        out = self.meta.select("doc_id", "n", "k1", "k2").join(rep, ["k1", "k2", "n"], "left")
        return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull() | F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("c")).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null, empty and wordless texts have size 0 and their own id as component. Null ids link
    nothing and have a null component. Repeated rows come out repeatedly; equal texts are
    one class whose least id stands for it; ids should name one text each (rows of one id
    with different texts count as that id's texts in checks). Other columns aren't read.
    An empty table gives no rows. Equal sets are collapsed before any list is made, all
    lists are complete, and no partner or candidate is capped.
    """
    return JaccardJoin(docs, words, threshold, id_col, text_col).result()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
