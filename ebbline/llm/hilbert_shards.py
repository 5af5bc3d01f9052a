"""Sharding by Hilbert-curve order (native).

Several metadata dimensions are quantised, the row's index on a Hilbert curve through
their grid is its sort key, and the sorted rows are cut into runs: each shard covers a
compact box in all dimensions at once, so that readers prune files by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import fresh, materialize


def hilbert_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, cell bits), built from the rule below.

    A state is an entry corner and a main direction; a cell's digit is the Gray-code rank
    of its bits after reflection and rotation, and the child's state follows from the
    curve's entry and direction in that cell.
    """
    n, cells = dims, 1 << dims
    turn = lambda x, k: ((x >> (k % n)) | (x << (n - k % n))) & (cells - 1)

    def rank(gray: int) -> int:
        out = 0
        while gray:
            out ^= gray
            gray >>= 1
        return out

    def entry(w: int) -> int:
        return 0 if w == 0 else (lambda x: x ^ (x >> 1))(2 * ((w - 1) // 2))

    def ones(w: int) -> int:
        return ((w + 1) & ~w).bit_length() - 1

    def direction(w: int) -> int:
        return 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n

    states = {(0, 0): 0}
    order, digits, following = [(0, 0)], [], []
    for e, d in order:
        for bits in range(cells):
            w = rank(turn(bits ^ e, d + 1))
            child = (e ^ turn(entry(w), n - (d + 1) % n), (d + direction(w) + 1) % n)
            if child not in states:
                states[child] = len(order)
                order.append(child)
            digits.append(w)
            following.append(states[child])
    return digits, following


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index on the curve of a cell of ``len(cells)`` coordinates below ``2**bits``."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the curve's index must fit a long")
    digits, following = hilbert_tables(n)
    table = lambda v: F.array(*[F.lit(x) for x in v])

    def bit_group(level: Column) -> Column:
        out = F.lit(0)
        for k, c in enumerate(cells):
            out = out.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", c, level).bitwiseAND(1), F.lit(k)))
        return out

    groups = F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), bit_group)
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))

    def step(acc: Column, g: Column) -> Column:
        at = acc["s"] * (1 << n) + g
        return F.struct(F.get(table(following), at).alias("s"), (acc["h"] * (1 << n) + F.get(table(digits), at)).alias("h"))

    return F.aggregate(groups, start, step, lambda acc: acc["h"])


def quantile_cells(df: DataFrame, column: Column, bits: int) -> Column:
    """A cell number by approximate quantiles of a numeric column (one partial aggregate); null: 0."""
    cuts = df.select(F.percentile_approx(column, F.lit([i / (1 << bits) for i in range(1, 1 << bits)]), F.lit(10_000)).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    # width of a cut list is fixed by bits, not by the data
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= column)), F.lit(0))


def ranked(df: DataFrame, keys: list[str], tag: str, weight: str | None = None) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions, with ``row`` (from 0) and, of ``weight``, ``before``: the sum over earlier rows.

    Sorting is a range exchange, and a row's number is its partition's start and its seat
    there; only a weight needs a window in each partition. Starts are one row per partition.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the id holds the partition above bit 33 and the position in it below
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), f"{tag}-sorted")
    ranged = ranged.withColumn("__part", F.call_function("shiftright", F.col("__at"), F.lit(33)))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col(weight) if weight else F.lit(0).cast("long")
    totals = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.sum(own).alias("b"))
    starts = totals.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in ("n", "b")])
    starts = materialize(starts, f"{tag}-starts")
    placed = ranged.join(F.broadcast(starts) if parts <= 100_000 else starts, "__part")
    placed = placed.withColumn("row", F.col("__n") + F.col("__at").bitwiseAND((1 << 33) - 1))
    if weight:
        inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("before", F.col("__b") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return placed.drop("__part", "__at", "__n", "__b")


def label_cells(df: DataFrame, labels: list[str], bits: int, rows: int) -> DataFrame:
    """(dim, label, cell) of all ``labels``: cells ascend with the label and hold near equal numbers of rows; null comes first.

    One row per distinct label; labels are counted before they are sorted, and no label
    list comes to the driver.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("label")) for i, c in enumerate(labels)]))
    counts = df.select(each.alias("x")).groupBy("x.dim", "x.label").agg(F.count("*").alias("c"))
    placed = ranked(counts, ["dim", "label"], "shards-labels", "c")
    cell = F.floor((F.col("before") - F.col("dim") * F.lit(rows)).cast("double") * (1 << bits) / max(rows, 1))
    return materialize(placed.select("dim", "label", F.least(cell, F.lit((1 << bits) - 1)).cast("int").alias("cell")), "shards-cells")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 24, law: str = "rows", bits: int = 6, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] = ("source", "lang"), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, ``curve`` and ``carry``.

    Dimensions: quantiles of the size, and the labels' ranks in value order, so that a
    shard covers a range of sizes and of labels. All copies of a text take the least index
    on the curve among them and sit side by side; a group is cut only where a shard ends
    inside it. Rows are sorted by (curve index, text, id). law ``rows`` cuts runs of counts
    at most one apart; law ``bytes`` cuts where the running size passes a multiple of
    total / shards. ``grown_shard`` is null: both laws move rows when the shard count
    changes. Null texts have size 8 and the checksum of the empty string; null ids and
    labels sort first; repeated rows take slots of their own; an empty table gives no
    rows. Sorting is a range exchange on a nearly unique key, so no label, text or size
    can fill one task; only the slim columns are shuffled, and the tables of labels and
    of copies have one row a key. ``carry`` names input columns to take along, which must
    not be called like the result's. ``write_shards`` attaches the texts.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        text_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        *[F.col(c).cast("string").alias(f"label{i}") for i, c in enumerate(label_cols)],
        *carry,
    )
    slim = materialize(slim, "shards-slim")
    rows, size = slim.agg(F.count("*"), F.sum("size")).first()
    cells, celled = [quantile_cells(slim, F.col("size"), bits).cast("int")], slim
    names = [f"label{i}" for i in range(len(label_cols))]
    ranks = label_cells(slim, names, bits, rows) if names else None
    for i, name in enumerate(names):
        own = ranks.where(F.col("dim") == i).select(F.col("label").alias("__label"), F.col("cell").alias(f"cell{i}"))
        celled = celled.join(own, F.col(name).eqNullSafe(F.col("__label"))).drop("__label", name)
        cells.append(F.col(f"cell{i}"))
    same = ["text_crc32", "text_hash", "size"]
    keyed = materialize(celled.select("doc_id", *same, *carry, hilbert_index(cells, bits).alias("own")), "shards-keyed")
    spread = keyed.groupBy(*same).agg(F.min("own").alias("least"), F.max("own").alias("most"))
    spread = materialize(spread.where("least < most").drop("most"), "shards-copies")
    keyed = keyed.join(spread, same, "left").select("doc_id", *same, *carry, F.coalesce("least", "own").alias("curve"))
    placed = ranked(keyed, ["curve", *same, "doc_id", *carry], "shards", "size" if law == "bytes" else None)
    if law == "rows":
        base, extra = divmod(rows, shards)
        head = (base + 1) * extra  # the first `extra` shards hold one more
        r = F.col("row")
        low = F.expr(f"row div {base + 1}")
        shard = F.when(r < head, low).otherwise(extra + F.expr(f"(row - {head}) div {max(base, 1)}"))
        slot = F.when(r < head, r - low * (base + 1)).otherwise((r - head) % max(base, 1))
        out = placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})
    else:
        middle = F.col("before") + F.expr("size div 2")
        shard = F.least(F.lit(shards - 1), F.floor(middle.cast("double") * shards / max(int(size or 0), 1)))
        out = materialize(placed.withColumn("shard", shard.cast("int")), "shards-bytes")
        first = out.groupBy("shard").agg(F.min("row").alias("row0"))
        out = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("row") - F.col("row0"))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *carry)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The documents as Parquet, one folder per shard, each sorted by slot.

    Rows are numbered in a stored copy first and meet their place by that number, so
    repeated and null ids are written as often as they come. The columns ``shard`` and
    ``slot`` are the place; input columns of those names give way.
    """
    row = fresh(docs) + "row"
    numbered = materialize(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()), "shards-rows")
    place = hilbert_shards(numbered, carry=(row,), **options).select(row, "shard", "slot")
    whole = numbered.join(place, row).drop(row)
    whole.repartitionByRange(options.get("shards", 24), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("curve")
