"""Reply trees to conversations: paths by iterative self-joins, ranked, formatted reversibly.

``paths`` enumerates root-to-leaf paths. Every message points at its parent;
joining the table of pointers with itself doubles the distance they span, so a
path of n messages takes about log2(n) joins, and the sums of scores along the
way come with it. Leaves are ranked by the score of their path (ties: smaller
leaf), the best ``branches`` of each tree stay, and the same pointers lead from a
chosen leaf back to its root, the set of rows doubling at each join.

``formatted`` writes a path as one text. Turns are marked by control strings;
inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so a
text cannot open or close a turn, and ``turns`` reads back what was written.

Defined cases: null role or text is empty; a parent that is null or not in the
tree makes a root; messages of a cycle lie on no path and are left out; trees with
a null id form one tree. Rows that share tree and node id are one message (the
first by role and text). An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.sources.scratch import written

# The control strings of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(c: Column, role: bool = False) -> Column:
    """Between doubled backslashes every backslash that is left belongs to an escape."""

    def part(p: Column) -> Column:
        out = F.replace(p, F.lit("<\\|"), F.lit("<|"))
        return F.replace(out, F.lit("\\n"), F.lit("\n")) if role else out

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def linear(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Messages of plain conversations: each replies to the one before it, all score alike.

    Rows are numbered by the order column, ties by role and text.
    """
    slim = rows.select(
        F.col(tree).alias("tree"),
        F.col(order).alias("order"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy("order", "role", "text")).cast("long")
    return slim.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, position, node, path_score) of the chosen root-to-leaf paths."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))  # noqa: E731  a null tree id is a tree too
    base = messages.groupBy("tree", "node").agg(F.min_by(F.struct("parent", "score"), F.struct("role", "text")).alias("m"))
    base = base.select("tree", "node", "m.parent", F.coalesce("m.score", F.lit(0.0)).alias("score"))
    known = base.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    pointers = written(
        base.join(known, same("tree", "t") & F.col("parent").eqNullSafe(F.col("up")), "left").select(
            "tree", "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("hops"), "score"
        ),
        "chat-pointers",
    )
    live, done = pointers.where(F.col("up").isNotNull()), pointers.where(F.col("up").isNull())
    # jumps[r]: messages with an ancestor 2**r steps up, and what lies below it; done: all that leads up to the root
    jumps, left = [], live.count()
    while left:
        jumps.append(live)
        above = live.union(done).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("hops").alias("h2"), F.col("score").alias("s2")
        )
        doubled = written(
            live.join(above, same("tree", "t") & (F.col("up") == F.col("n"))).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("score") + F.col("s2")).alias("score")
            ),
            "chat-pointers",
        )
        live, done = doubled.where(F.col("up").isNotNull()), done.union(doubled.where(F.col("up").isNull()))
        before, left = left, live.count()
        if left == before:  # only cycles are left: without one each round ends some
            break
    parents = pointers.where(F.col("up").isNotNull()).select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    ends = done.join(parents, same("tree", "t") & (F.col("node") == F.col("p")), "left_anti")
    ends = ends.select("tree", F.col("node").alias("leaf"), F.col("score").alias("path_score"), F.col("hops").alias("length"))
    if branches is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
        ends = ends.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches).drop("place")
    walk = ends.withColumn("node", F.col("leaf")).withColumn("down", F.lit(0).cast("long"))
    for r, jump in enumerate(jumps):
        up = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        step = walk.join(up, same("tree", "t") & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", "path_score", "length", F.col("up").alias("node"), (F.col("down") + F.lit(1 << r)).cast("long").alias("down")
        )
        walk = written(walk.unionByName(step), "chat-walk")
    return walk.select("tree", "leaf", (F.col("length") - F.col("down")).alias("position"), "node", "path_score")


def formatted(messages: DataFrame, chosen: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, path_score, output, mask): one text a path, and the spans that count for the loss.

    A span covers the text of one turn of ``loss_role``, in code points of the output.
    """
    bodies = messages.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("m"))
    bodies = bodies.select(F.col("tree").alias("t"), F.col("node").alias("n"), "m.role", "m.text")
    turns = chosen.join(bodies, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit("")), role=True), F.lit("\n"))
    turns = turns.select(
        "tree", "leaf", "position", "path_score", (F.col("role") == loss_role).alias("loss"), head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body")
    ).withColumn("segment", F.concat("head", "body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy("position")
    at = F.sum(F.char_length("segment").cast("long")).over(before) - F.char_length("segment") + F.char_length("head")
    span = F.when(F.col("loss"), F.struct(at.cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    turns = turns.select("tree", "leaf", "position", "path_score", "segment", span.alias("span"))
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct("position", "segment", "span"))).alias("turns")
    )
    return whole.select(
        "tree",
        "leaf",
        "path_score",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("output"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("mask"),
    )


def turns(output: Column) -> Column:
    """The (role, text) pairs read back from a formatted text."""
    parts = F.slice(F.split(output, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(output, r"<\|im_start\|>", -1)) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        skip = F.char_length(role) + 1
        body = F.substring(p, skip + 1, F.char_length(p) - skip - len(CLOSE) - 1)
        return F.struct(unescape(role, role=True).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def under_mask(output: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, span after span."""
    cut = lambda s: unescape(F.substring(output, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(mask, cut), "")
