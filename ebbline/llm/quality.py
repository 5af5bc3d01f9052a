"""Quality classifier with hierarchical empirical Bayes.

A logistic model turns each document's own evidence into a probability of being good.
Hosts (here: sources) and the paths below them get Beta posteriors by grouped
aggregation: a path shrinks toward its host and a host toward the global prior, the more
the fewer documents it has, with strengths estimated from the spread between groups. A
document's log-odds are its own plus what its path's posterior says beyond the prior.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import ChunkTable, by_ids, fresh, map_arrow, materialize, slices, word_blocks, worker_keeps

_CHUNK = ("chars", "letters", "upper", "digits", "symbols", "shouted", "noisy_end", "single_symbol", "short", "long", "chunks")
FEATURES = ("upper_share", "digit_share", "symbol_share", "shouted_share", "noisy_share", "lone_symbol_share", "short_share", "long_share", "mean_length", "log_chunks", "distinct_share", "top_share", "line_repeats", "bare_line_ends")
_NOISY = re.compile(r"([^\w\s])\1+$|[^\w\s]{3,}$")


def _chunk_features(chunks: list[str]) -> np.ndarray:
    out = np.zeros((len(chunks), len(_CHUNK)), np.float32)
    for i, c in enumerate(chunks):
        n = len(c)
        letters = sum(map(str.isalpha, c))
        digits = sum(map(str.isdigit, c))
        upper = sum(map(str.isupper, c))
        out[i] = (n, letters, upper, digits, n - letters - digits, letters > 1 and upper == letters, _NOISY.search(c) is not None, n <= 2 and letters == 0, letters <= 2, letters > 20, 1)
    return out


def document_features(texts, table: ChunkTable) -> np.ndarray:
    """One row of ``FEATURES`` per whole text; zeros for null and blank texts."""
    sums = np.zeros((len(texts), len(_CHUNK)))
    distinct, top, entries = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for owner, length, words in word_blocks(texts):
        at = table.at(words)
        starts = np.concatenate(([0], np.cumsum(length)[:-1]))
        np.add.at(sums, owner, np.add.reduceat(table.rows[at].astype(np.float64), starts, axis=0))
        # repeats inside a text; of a text in several blocks, they are counted below
        which = np.repeat(np.arange(len(owner)), length)
        pair, n = np.unique(which * (1 << 32) + at, return_counts=True)
        which = pair >> 32
        np.add.at(distinct, owner, np.bincount(which, minlength=len(owner)))
        most = np.zeros(len(owner))
        np.maximum.at(most, which, n)
        np.add.at(top, owner, most)
        entries += np.bincount(owner, minlength=len(texts))
    for i in np.flatnonzero(entries > 1).tolist():
        found = Counter(texts[i].split())
        distinct[i], top[i] = len(found), max(found.values())
    lines, bare = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if text and "\n" in text:
            own = [x for x in text.split("\n") if x.strip()]
            if own:
                lines[i] = 1 - len(set(own)) / len(own)
                bare[i] = sum(x.rstrip()[-1].isalnum() for x in own) / len(own)
    s = dict(zip(_CHUNK, sums.T, strict=True))
    chars, chunks, letters = np.maximum(s["chars"], 1), np.maximum(s["chunks"], 1), np.maximum(s["letters"], 1)
    cols = (s["upper"] / letters, s["digits"] / chars, s["symbols"] / chars, s["shouted"] / chunks, s["noisy_end"] / chunks, s["single_symbol"] / chunks, s["short"] / chunks, s["long"] / chunks, s["chars"] / chunks / 10, np.log1p(s["chunks"]) / 10, distinct / chunks, top / chunks, lines, bare)
    return np.stack(cols, axis=1) * (s["chunks"] > 0)[:, None]


def feature_table() -> ChunkTable:
    return worker_keeps("quality", lambda: ChunkTable(_chunk_features, len(_CHUNK)))


class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.centre, self.scale, self.weights = centre, scale, weights

    @staticmethod
    def _spread(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, x**2], axis=1)

    @classmethod
    def fit(cls, rows: DataFrame, ridge: float = 1.0) -> Logistic | None:
        """From all ``rows`` (y, x: ``FEATURES``), a stored table; None without both kinds of y.

        Tasks sum over their rows; a pass brings the driver one row of sums a task.
        """
        k = 2 * len(FEATURES)

        def summed(of, width: int) -> np.ndarray:
            def run(batches):
                total = np.zeros(width)
                for b in batches:
                    if b.num_rows:
                        total += of(b.column(0).to_numpy(zero_copy_only=False).astype(float), cls._spread(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)))
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

            return sum((np.array(r["s"]) for r in map_arrow(rows.select("y", "x"), run, "s array<double>").collect()), np.zeros(width))

        first = summed(lambda y, x: np.concatenate(([len(y), y.sum()], x.sum(axis=0))), 2 + k)
        if not 0 < first[1] < first[0]:
            return None
        centre = first[2:] / first[0]
        scale = np.sqrt(summed(lambda y, x: ((x - centre) ** 2).sum(axis=0), k) / first[0])
        scale = np.where(scale > 1e-9, scale, 1.0)
        w = np.zeros(1 + k)
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6

        def curved(y, x):
            z = np.hstack([np.ones((len(x), 1)), np.clip((x - centre) / scale, -8, 8)])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate((((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (y - p)))

        for _ in range(50):
            s = summed(curved, len(w) ** 2 + len(w))
            step = np.linalg.solve(s[: -len(w)].reshape(len(w), -1) + np.diag(penalty) + 1e-9 * np.eye(len(w)), s[-len(w) :] - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(centre, scale, w)

    def proba(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self._spread(x) - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -12, 12)))

    def dump(self) -> str:
        return json.dumps([self.centre.tolist(), self.scale.tolist(), self.weights.tolist()])

    @classmethod
    def load(cls, text: str) -> Logistic:
        return cls(*(np.array(x) for x in json.loads(text)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Logistic | None:
    """A classifier from all labelled rows; None without both kinds of label.

    A document with several labels counts with its worst. Texts don't move: those of
    labelled ids are found in place, and their features are joined with the labels.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = materialize(known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("y")), "quality-labels")
    some = by_ids(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("t")), "__id", known, True)

    def run(batches):
        table = feature_table()
        for batch in batches:
            for b in slices(batch, 500):
                x = document_features(b.column(1).to_pylist(), table)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["__id", "x"])

    found = map_arrow(some, run, some.drop("t").schema.add("x", T.ArrayType(T.DoubleType())))
    return Logistic.fit(materialize(found.join(known, "__id").select("y", "x"), "quality-labelled"))


def with_evidence(docs: DataFrame, model: Logistic | None, text_col: str = "text", keep: list[str] | None = None, name: str = "evidence") -> DataFrame:
    """Columns ``keep`` (all by default) and the document's own probability; 0.5 without a model."""
    keep = [c for c in (keep or docs.columns) if c.lower() != name.lower()]
    data = docs.sparkSession.sparkContext.broadcast(model.dump() if model else "")
    t = fresh(docs, stem="text")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(t))

    def run(batches):
        m = Logistic.load(data.value) if data.value else None
        table = feature_table()
        for batch in batches:
            for b in slices(batch, 500):
                texts = b.column(b.num_columns - 1).to_pylist()
                p = m.proba(document_features(texts, table)) if m else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names=[*keep, name])

    return map_arrow(kept, run, kept.drop(t).schema.add(name, "double"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column, n: str = "n", mean: str = "m") -> float:
    """Prior strength by moments: spread of the groups' means beyond their sampling error."""
    r = groups.agg(
        F.sum(F.col(n)).alias("n"),
        F.sum(F.col(n) * (F.col(mean) - prior) ** 2).alias("between"),
        F.sum(F.col("v")).alias("within"),
        F.avg(prior * (1 - prior)).alias("pq"),
    ).first()
    if not r["n"]:
        return 1.0
    spread = (r["between"] - r["within"]) / r["n"]
    pq = max(r["pq"] or 0.0, 1e-6)
    return float(min(max(pq / spread - 1, 1.0), 1e4)) if spread > 1e-9 else 1e4


def group_sums(evidence: DataFrame, host: list[Column], path: list[Column], p: str = "evidence") -> tuple[DataFrame, dict[str, float]]:
    """(h, p, n, s, hn, hs) per path, with its host's sums, and the estimates prior, k_host and k_path.

    Every row counts. Groups are sums, partially aggregated, so a group of any size costs
    one row per task.
    """
    rows = evidence.select(F.struct(*host).alias("h"), F.struct(*path).alias("p"), F.col(p).alias("e"))
    # var_pop / n is the sampling error of a mean; n times that is var_pop
    paths = rows.groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
    paths = materialize(paths, "quality-paths")
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    prior = float(total[1] / total[0]) if total[0] else 0.5
    mean, var = F.col("s") / F.col("n"), F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2)
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    k_host = _strength(hosts.withColumns({"m": mean, "v": var}), F.lit(prior))
    paths = materialize(paths.join(hosts.select("h", F.col("n").alias("hn"), F.col("s").alias("hs")), "h"), "quality-hosts")
    k_path = _strength(paths.withColumns({"m": mean, "v": var}), (F.col("hs") + k_host * prior) / (F.col("hn") + k_host))
    return paths.drop("q"), {"prior": prior, "k_host": k_host, "k_path": k_path}


def _scored(docs: DataFrame, model: Logistic | None, host_cols: tuple[str, ...], path_cols: tuple[str, ...], text_col: str, keep: list[str], names: list[str]) -> DataFrame:
    """Columns ``keep`` and evidence, host and path posterior and score under ``names``.

    A document's own evidence is left out of its groups' posteriors, or sparse groups would
    count it twice. Texts are read once; what is kept is stored with the evidence.
    """
    x = fresh(docs)
    groups = {f"{x}h{i}": F.col(f"`{c}`") for i, c in enumerate(host_cols)} | {f"{x}p{i}": F.col(f"`{c}`") for i, c in enumerate(path_cols)}
    host = [F.col(f"{x}h{i}").alias(f"c{i}") for i in range(len(host_cols))]
    path = [F.col(f"{x}p{i}").alias(f"c{i}") for i in range(len(path_cols))]
    wide = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])], *[c.alias(k) for k, c in groups.items()])
    first = materialize(with_evidence(wide, model, text_col, [*keep, *groups], f"{x}e"), "quality-evidence")
    sums, est = group_sums(first, host, path, f"{x}e")
    side = sums.select(*[F.col(f"h.c{i}").alias(f"{x}gh{i}") for i in range(len(host))], *[F.col(f"p.c{i}").alias(f"{x}gp{i}") for i in range(len(path))], F.struct("n", "s", "hn", "hs").alias(f"{x}g"))
    on = [F.col(f"{x}h{i}").eqNullSafe(F.col(f"{x}gh{i}")) for i in range(len(host))] + [F.col(f"{x}p{i}").eqNullSafe(F.col(f"{x}gp{i}")) for i in range(len(path))]
    joined = first.join(side, on, "left")
    # one struct, so that no column of the input can clash with a sum's name
    own = F.struct(F.col(f"{x}e").alias("e"), *[F.col(f"{x}g.{c}").alias(c) for c in ("n", "s", "hn", "hs")])
    host_post = (own["hs"] - own["e"] + est["k_host"] * est["prior"]) / (own["hn"] - 1 + est["k_host"])
    path_post = (own["s"] - own["e"] + est["k_path"] * host_post) / (own["n"] - 1 + est["k_path"])
    shift = _logit(path_post) - F.lit(float(np.log(max(est["prior"], 1e-6) / max(1 - est["prior"], 1e-6))))
    score = 1 / (1 + F.exp(-(_logit(F.col(f"{x}e")) + shift)))
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.col(f"{x}e").alias(names[0]), host_post.alias(names[1]), path_post.alias(names[2]), score.alias(names[3]))


def classify(docs: DataFrame, model: Logistic | None, host_cols: tuple[str, ...] = ("source",), path_cols: tuple[str, ...] = ("lang",), text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` (all by default) and evidence, host_posterior, path_posterior, quality_score, accepted.

    Null hosts and paths are groups of their own. Null and blank texts carry nothing and
    are rejected. Repeated rows count and come out repeatedly; input columns of the new
    names give way; an empty table gives no rows. Texts are read once in a narrow pass and
    never shuffled; only one row per path is, and the optimizer broadcasts those rows while
    they are under its threshold and otherwise splits hot hosts.
    """
    new = ["evidence", "host_posterior", "path_posterior", "quality_score"]
    keep = [c for c in (keep or docs.columns) if c.lower() not in [*new, "accepted"]]
    out = _scored(docs, model, host_cols, path_cols, text_col, keep, new)
    return out.withColumn("accepted", F.col("quality_score") >= threshold)


def accepted(docs: DataFrame, model: Logistic | None, host_cols: tuple[str, ...] = ("source",), path_cols: tuple[str, ...] = ("lang",), text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The accepted rows of ``docs`` with all their columns as they are."""
    p = fresh(docs, stem="q")
    out = _scored(docs, model, host_cols, path_cols, text_col, docs.columns, [f"{p}{x}" for x in "ehps"])
    return out.where(F.col(f"{p}s") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model, keep=["doc_id"])
