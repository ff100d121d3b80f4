"""Documents linked by the Jaccard similarity of their word shingles, in components.

1. Every text becomes its set of hashed shingles. Documents of equal sets form a class; its
   smallest id stands for it.
2. Two sets of similarity num/den differ in few members: at most D of them. A set's
   members are dealt by hash into more than D cells, so two linked sets agree in
   whole cells. Sets that share a cell (its members summed to one hash) are connected, and
   what is connected is one candidate family. Members that very many documents have (a
   shared passage) are left out of the cells: what differs is not more without them, so
   no link is lost. A set that has too few other members takes part with all of them too.
   More cells are filled than members can differ, so linked sets agree in at least the surplus: a set
   that shares fewer cells with others has no link, and of the cells that it shares the most common, one less than
   the surplus, need not be looked at. Unrelated texts that share a sentence do not become one family.
3. Inside a family signature trees find the links (``signature_tree``). A family of
   many members is cut into blocks by size and hash; the trees of blocks of near
   sizes are traversed in pairs, one bounded pair a task.
4. The links found, a spanning forest, are joined into components. Where the number of links
   is asked for, the trees find all links and each task adds up its own.

Cells are made for bands of set sizes, so that both sets of a link use the same number of
cells; a set near the lower edge of its band also uses the band below. A set whose members
leave too few cells filled also takes part with its empty cells.

Defined cases: null or empty text and text without words have no shingles and link
with nothing; fewer words than the width make one shingle of the whole sequence. Repeated rows
are in one class. Rows that share an id are one document to the links. A row with a null id joins the
component of an equal set, else none (null). The number of links counts the other rows with an id; a row with
a null id has one if an equal set has an id, else none (null). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.llm import arrow_text, shingles, signature_tree
from halyard.llm.components import components
from halyard.sources.scratch import drop_written, written

SLICE_BYTES = 1 << 18
FAMILY_MEMBERS = 2 << 20  # shingles in one block
SEEN = 1 << 20  # sets that a task remembers
FREQUENT_ROWS = 50  # rows that share a shingle before it counts as frequent
MOST_FREQUENT = 1 << 18  # of them are broadcast, two MB
CELLS = 1.5  # cells of a band for each member in which its largest sets can differ
CELL_PASSES = 4  # the cells are shuffled a share at a time
TEXT_PASS = 1 << 24  # shingles whose texts are shuffled to their pairs of blocks at once, or half of all where that is more
SHARED_IN_TASK = 3
COUNTED = 1 << 20  # shingles held before a task adds them up
U = np.uint64
SALTS = [U(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1)]
EMPTY_CELL = U(0x6A09E667F3BCC908)


class Bands:
    """Bands of set sizes and the number of cells in each, for similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, -(-self.edges[-1] * 3 // 2)))

    def differ(self, size: int) -> int:
        """Most members in which a set of this size can differ from one that it links with."""
        return (size + size * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, cells) that a set takes part in."""
        band = int(np.searchsorted(self.edges, size, "right")) - 1
        bands = [band]
        if band and -(-size * self.num // self.den) < self.edges[band]:
            bands.append(band - 1)
        return [(b, math.ceil(CELLS * self.differ(self.edges[b + 1] - 1)) + 2) for b in bands]


@cache
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def _filled(members: np.ndarray, count: int, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and hashes of the cells that the members fill."""
    cell = ((shingles.mix(members ^ SALTS[0]) >> U(32)) * U(count)) >> U(32)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    if not len(starts):
        return cell, cell
    sums = np.add.reduceat(shingles.mix(members[order] + SALTS[1]), starts)
    return cell[starts], shingles.mix(sums + cell[starts] * shingles.BASE + name)


def cell_parts(members: np.ndarray, plan: Bands, frequent: np.ndarray | None = None) -> list[tuple[np.ndarray, int, int]]:
    """(hashes of cells, band, least) of one set; ``frequent`` holds the members to leave out, sorted.

    Two linked sets share at least ``least`` of the cells of either: if it has more filled cells than members can differ, the
    surplus of them is untouched. A set with fewer (least 1) also gives the cells of all members, and, where
    those are too few as well, the names of its empty cells.
    """
    size = len(members)
    differ = plan.differ(size)
    if not differ:
        return []
    rare = members
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        rare = members[frequent[at] != members]
    out = []
    for band, count in plan.of(size):
        name = shingles.mix(np.array([band], U) + SALTS[2])
        filled, hashes = _filled(rare, count, name)
        out.append((hashes, band, max(len(filled) - differ, 1)))
        if len(filled) > differ:
            continue
        name = shingles.mix(name)
        filled, hashes = _filled(members, count, name)
        out.append((hashes, band, 1))
        if len(filled) <= differ:
            empty = np.setdiff1d(np.arange(count, dtype=U), filled)
            out.append((shingles.mix(EMPTY_CELL + empty * shingles.BASE + name), band, 1))
    return out


def cells(members: np.ndarray, plan: Bands, frequent: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all cells of one set; two linked sets share one."""
    return np.concatenate([np.zeros(0, U), *[hashes for hashes, _, _ in cell_parts(members, plan, frequent)]])


def _slices(batches: Iterator[pa.RecordBatch], width: int):
    """(batch, rows, sets) in bounded slices of batches whose last column is the text."""
    for batch in batches:
        data, offsets = arrow_text.texts(batch.column(batch.num_columns - 1))
        for start, stop in arrow_text.ranges(offsets, SLICE_BYTES):
            yield batch.slice(start, stop - start), shingles.sets(data, offsets[start : stop + 1], width)
    arrow_text.give_back()


def frequent_shingles(docs: DataFrame, text: str, width: int, least: int = FREQUENT_ROWS, most: int = MOST_FREQUENT) -> np.ndarray:
    """The shingles that most rows have, sorted: at most ``most``, in at least ``least`` rows.

    Each task counts its rows and hands on what several of them share, so counts are lower
    bounds. They only choose what is left out of the cells; any choice keeps all links.
    """

    def count(batches):
        held, n = np.zeros(0, U), np.zeros(0, np.int64)
        waiting, size = [], 0

        def settle():
            nonlocal held, n, waiting, size
            values, at = np.unique(np.concatenate([held, *waiting]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([n, np.ones(size, np.int64)]), len(values)).astype(np.int64)
            held, n, waiting, size = values[sums > 1], sums[sums > 1], [], 0

        for _, found in _slices(batches, width):
            waiting += found
            size += sum(map(len, found))
            if size > COUNTED:
                settle()
        settle()
        enough = n >= SHARED_IN_TASK
        yield pa.RecordBatch.from_arrays([pa.array(held[enough].view(np.int64)), pa.array(n[enough])], ["shingle", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "shingle long, n long")
    summed = counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = summed.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(U))


def _keys(found: list[np.ndarray]) -> list[np.ndarray]:
    """Two hashes of each set."""
    return [np.array([shingles.mix(s ^ salt).sum(dtype=U) for s in found], U).view(np.int64) for salt in SALTS[2:]]


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, key1, key2) of every row: set size and hashes of the set."""

    def run(batches):
        for part, found in _slices(batches, width):
            n = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, *map(pa.array, _keys(found))], ["id", "n", "key1", "key2"])

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "id long, n long, key1 long, key2 long")


def families(docs: DataFrame, text: str, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(node, component): first keys of sets connected by shared cells; sets that share too few are left out.

    A task gives the cells of a set once, so a text with very many copies has a row a cell and task. The cells
    are written, and shuffled in ``CELL_PASSES`` shares. With its cells ordered by rows, fewest first, the first cell that
    a set has in common with one that it links with has at least the others in common after it: ``least`` - 1 of the
    set's shared cells. So these last ones are left out, and with them every set that shares fewer than ``least``.
    """
    left_out = docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_FREQUENT numbers at most

    def run(batches):
        plan, here, seen = bands(num, den), left_out.value, set()
        for _, found in _slices(batches, width):
            if len(seen) > SEEN:
                seen.clear()
            hashes, nodes, parts = [np.zeros(0, U)], [], []
            for members, node in zip(found, _keys(found)[0].tolist()):
                if len(members) and node not in seen:
                    seen.add(node)
                    for some, band, least in cell_parts(members, plan, here):
                        hashes.append(some)
                        nodes.append(node)
                        parts.append(2 * least + band % 2)  # a set is in neighbouring bands
            lengths = [len(h) for h in hashes[1:]]
            columns = [np.concatenate(hashes).view(np.int64), np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(parts, np.int64), lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "node", "part"])

    filled = written(docs.select(F.col(text).alias("text")).mapInArrow(run, "cell long, node long, part long"), "shingle-cells")
    shares = []
    for share in range(CELL_PASSES):
        mine = filled.where(F.pmod("cell", F.lit(CELL_PASSES)) == share)
        # most cells have one set: they end here, and a cell of any number of sets is one row
        counted = mine.groupBy("cell").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"))
        shared = written(counted.where("first <> last").select("cell", "n"), "shingle-shared")
        met = mine.join(shared.hint("shuffle_hash"), "cell").groupBy("cell", "node", "part").agg(F.first("n").alias("n"))
        shares.append(written(met, "shingle-met"))
        drop_written(shared)
    drop_written(filled)
    own = W.partitionBy("node", "part")  # cells of one text
    ranked = reduce(DataFrame.union, shares).select(
        "cell", "node", "part", F.row_number().over(own.orderBy("n", "cell")).alias("place"), F.count("*").over(own).alias("shared")
    )
    kept = written(ranked.where("place <= shared - part div 2 + 1").select("cell", "node"), "shingle-kept")
    for table in shares:
        drop_written(table)
    first = kept.groupBy("cell").agg(F.min("node").alias("u"))
    met = kept.join(first.hint("shuffle_hash"), "cell").where("u <> node")
    edges = written(met.groupBy("u", F.col("node").alias("v")).agg(F.lit(1).alias("once")).select("u", "v"), "shingle-edges")
    drop_written(kept)
    return components(edges, consume=[edges])


def blocks(members: DataFrame, num: int, den: int, block_members: int = FAMILY_MEMBERS) -> DataFrame:
    """(node, family, own, others, cut) for rows (node, family, n): the blocks a set is compared with; further columns stay.

    A family of at most ``block_members`` shingles is one block. A larger one is cut by set
    size, and a size with too many by the hash of the node; only blocks of near sizes meet.
    """
    step = math.log(den / num) * (1 + 1e-9)  # sizes of linked sets are at most one bucket apart
    sized = members.withColumn("bucket", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)))
    buckets = sized.groupBy("family", "bucket").agg(F.sum("n").alias("total"))
    buckets = buckets.withColumn("parts", F.ceil(F.col("total") / F.lit(block_members)))
    whole = buckets.groupBy("family").agg(
        F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "parts"))).alias("buckets")
    )
    near = F.filter("buckets", lambda b: F.abs(b["bucket"] - F.col("bucket")) <= 1)
    numbers = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["parts"] - 1), lambda s: F.shiftleft(b["bucket"], 32) + s)
    parts = F.get(F.filter("buckets", lambda b: b["bucket"] == F.col("bucket")), F.lit(0))["parts"]
    own = F.shiftleft("bucket", 32) + F.pmod(F.xxhash64("node"), parts)
    cut = F.col("total") > block_members
    zero = F.lit(0).cast("long")
    return sized.join(whole, "family").select(
        "node",
        "family",
        F.when(cut, own).otherwise(zero).alias("own"),
        F.when(cut, F.flatten(F.transform(near, numbers))).otherwise(F.array(zero)).alias("others"),
        cut.alias("cut"),
        *[c for c in members.columns if c not in ("node", "family", "n")],
    )


def _forest(group: pd.DataFrame, found: list[np.ndarray], side: np.ndarray, num: int, den: int) -> pd.DataFrame:
    nodes = group["node"].to_numpy()
    pairs = signature_tree.forest(found, side, num, den)
    return pd.DataFrame([(nodes[x], nodes[y]) for x, y in pairs], columns=["u", "v"])


def _pairs(group: pd.DataFrame, found: list[np.ndarray], side: np.ndarray, num: int, den: int) -> pd.DataFrame:
    nodes = group["node"].to_numpy()
    runs = [pd.DataFrame({"u": nodes[x], "v": nodes[y]}) for x, y in signature_tree.pairs(found, side, num, den)]
    return pd.concat([pd.DataFrame({"u": nodes[:0], "v": nodes[:0]}), *runs])


def _counts(group: pd.DataFrame, found: list[np.ndarray], side: np.ndarray, num: int, den: int) -> pd.DataFrame:
    """A spanning forest, and a row for each set with the rows that it links with: linear however many pairs link."""
    nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    label, n, forest = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), []
    for x, y in signature_tree.pairs(found, side, num, den):
        np.add.at(n, x, copies[y])
        np.add.at(n, y, copies[x])
        apart = label[x] != label[y]
        for a, b in zip(x[apart].tolist(), y[apart].tolist()):
            if label[a] != label[b]:
                forest.append((a, b))
                label[label == label[b]] = label[a]
    # Int64 before the concat: missing values must not make floats of the keys
    sums = group.loc[n > 0, ["key1", "key2"]].assign(n=n[n > 0]).astype("Int64")
    edges = pd.DataFrame([(nodes[a], nodes[b]) for a, b in forest], columns=["u", "v"]).astype("Int64")
    return pd.concat([edges, sums])[["u", "v", "key1", "key2", "n"]]


#: What is wanted of the links, its columns, and the function for two blocks.
WANTED = {
    "forest": ("u long, v long", _forest),
    "pairs": ("u long, v long", _pairs),
    "counts": ("u long, v long, key1 long, key2 long, n long", _counts),
}


def links(
    docs: DataFrame, key: str, text: str, width: int, num: int, den: int, members: DataFrame, want: str = "forest", block_members: int = FAMILY_MEMBERS,
    pass_members: int = TEXT_PASS,
) -> DataFrame:
    """The links inside each family of (node, family, n, key1, key2); nodes are ids of documents.

    (u, v): a spanning forest, or with ``pairs`` all links of different sets, each once. With ``counts``, where members
    have their ``copies``, (u, v, key1, key2, n): a spanning forest and, u and v null, summands of the copies that a set links with.

    A text goes to every pair of blocks that its own is in, so more text is shuffled than there is, and the more the larger a family is.
    Beyond ``pass_members`` shingles the texts are written once beside their blocks, and shuffled a share of the pairs at a time.
    """
    total = members.agg(F.sum("n")).first()[0] or 0
    groups = max(1, math.ceil(total / block_members))
    schema, link = WANTED[want]
    extra = [c for c in ("key1", "key2", "copies") if c in members.columns]

    def own_sets(batches):
        """Of rows that share an id only those of the set that the id stands for."""
        for part, found in _slices(batches, width):
            one, two = _keys(found)
            yield part.filter(pa.array((one == part.column("key1").to_numpy()) & (two == part.column("key2").to_numpy())))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: pd.Series(dtype="Int64") for c in schema.split(", ")})]
        for (_, a, z), group in frame.groupby(["family", "a", "z"], sort=False):
            group = group.drop_duplicates(["key1", "key2"])  # repeated rows
            if len(group) < 2 or (a != z and group["own"].nunique() < 2):
                continue
            data, offsets = arrow_text.texts(pa.array(group["text"], pa.large_string()))
            found = [s for x, y in arrow_text.ranges(offsets, SLICE_BYTES) for s in shingles.sets(data, offsets[x : y + 1], width)]
            out.append(link(group, found, (group["own"].to_numpy() != a).astype(int), num, den))
            del data, found
        arrow_text.give_back()
        return pd.concat(out)

    slim = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
    # texts are shuffled whatever the number of members: the plan is the same at every size
    placed_in = blocks(members, num, den, block_members)
    placed = slim.join(placed_in.hint("merge"), "node").select("node", "family", "own", "others", "cut", *extra, "text")
    more = ", ".join(f"{c} long" for c in extra)
    sized = placed.mapInArrow(own_sets, f"node long, family long, own long, others array<long>, cut boolean, {more}, text string")

    def paired(texts: DataFrame) -> DataFrame:
        # texts travel, not sets: hashes are longer than words and cannot be compressed
        return (
            texts.withColumn("other", F.explode("others"))
            .select("node", "family", *extra, "text", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("z"), "cut")
            .withColumn("group", F.when(F.col("cut"), F.xxhash64("family", "a", "z")).otherwise(F.pmod(F.xxhash64("family"), F.lit(groups))))
            .drop("cut")
        )

    moved = members.select("node", "family", "n") if total > pass_members else None
    if moved is not None:
        moved = blocks(moved.withColumn("size", F.col("n")), num, den, block_members).agg(F.sum(F.col("size") * F.size("others"))).first()[0] or 0
    passes = math.ceil(moved / max(pass_members, total // 2)) if moved else 1
    if passes == 1:
        return paired(sized).groupBy("group").applyInPandas(join, schema)
    texts = written(sized, "shingle-texts")
    parts = []
    for part in range(passes):
        mine = paired(texts).where(F.pmod(F.xxhash64("group"), F.lit(passes)) == part)
        parts.append(written(mine.groupBy("group").applyInPandas(join, schema), "shingle-found"))
    drop_written(texts)
    return reduce(DataFrame.union, parts)


def linked(docs: DataFrame, key: str, text: str, width: int, num: int, den: int, count: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row; linked are sets of similarity num / den or more.

    With ``count`` also n_links: how many other rows it is linked with, equal sets included.
    """
    sketched = written(sketches(docs, key, text, width), "shingle-sketches")
    family = families(docs, text, width, num, den, frequent_shingles(docs, text, width))
    classes = (
        sketched.where((F.col("n") > 0) & F.col("id").isNotNull())
        .groupBy("key1", "key2")
        .agg(F.min("id").alias("node"), F.first("n").alias("n"), F.count("*").alias("copies"))
    )
    placed = classes.join(family.select(F.col("node").alias("key1"), F.col("component").alias("family")), "key1")
    members = written(placed.select("node", "family", "n", "key1", "key2", *["copies"] * count), "shingle-families")
    found = links(docs, key, text, width, num, den, members, "counts" if count else "forest")
    if count:
        found = written(found, "shingle-links")
    component = components(found.select("u", "v"))
    named = classes.join(component, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    columns = ["id", F.col("n").alias("n_shingles"), "component_id"]
    if count:
        sums = found.where(F.col("u").isNull()).groupBy("key1", "key2").agg(F.sum("n").alias("others"))
        named = named.join(sums, ["key1", "key2"], "left").withColumn("around", F.col("copies") + F.coalesce("others", F.lit(0)))
        columns.append((F.col("around") - F.when(F.col("id").isNull(), 0).otherwise(1)).alias("n_links"))
    some = sketched.where(F.col("n") > 0).join(named.select("key1", "key2", "component_id", *["around"] * count), ["key1", "key2"], "left")
    none = sketched.where(F.col("n") == 0).withColumns({"component_id": F.col("id"), **({"around": F.when(F.col("id").isNull(), 0).otherwise(1)} if count else {})})
    return some.select(*columns).unionByName(none.select(*columns))
