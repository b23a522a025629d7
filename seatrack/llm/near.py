"""Classes of similar texts from MinHash signatures: candidates by shared prefixes, exact verification, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import jaccard, mixed, saved, shingles, word_hashes

#: Rows of a run that meet in one task, on either side.
BLOCK = 512
#: Runs of at most SMALL rows are not cut into blocks, and many of them share a task.
SMALL = 16
#: A pair at the threshold meets a pivot's run with at least this probability, however few such links the data show.
LEAST_RECALL = 0.95


def meeting(similarity: float, trees: int, depth: int) -> float:
    """Probability that a pair shares a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, shortened from the full depth, at which a pair at the threshold meets with the recall."""
    while depth > 1 and meeting(threshold, trees, depth) < recall:
        depth -= 1
    return depth


def _runs(depth: int, at: int) -> int:
    """Pieces of `at` values that each tree's values hold, the first being the prefix."""
    return depth // at


def _run(trees: int, depth: int, at: int, runs: int = 1) -> Column:
    """Exploded (tree, run): a hash of each of the `runs` first pieces, of `at` values, of the `depth` values that the signature has for each tree."""
    first = lambda t: F.floor(t / runs).cast("int") * (depth * 4) + F.pmod(t, F.lit(runs)) * (at * 4) + 1
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees * runs - 1)), lambda t: F.struct(
        t.alias("tree"), F.xxhash64(t, F.substring(F.col("signature"), first(t), F.lit(at * 4))).alias("run")
    )))


def in_company(nodes: DataFrame, trees: int, depth: int, at: int) -> DataFrame:
    """Nodes that share a piece of `at` values with another one in some tree."""
    legs = nodes.select("node", _run(trees, depth, at, _runs(depth, at)).alias("leg")).select("node", "leg.run")
    several = legs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("run")
    return legs.join(several, "run").select("node").distinct()


def pivot_pairs(classes: DataFrame, trees: int, depth: int, at: int) -> DataFrame:
    """Distinct pairs (a, b) of the rows of each run with the run's pivot, where their classes differ.

    classes: (node, cls, signature). The pivot is the least node of the least
    class, so that the runs of one group mostly agree on it and pairs grow with
    the rows, not with their square.
    """
    legs = classes.select("node", "cls", _run(trees, depth, at).alias("leg")).select("node", "cls", "leg.run")
    pivots = (
        legs.groupBy("run").agg(F.min(F.struct("cls", "node")).alias("pivot"), F.max("cls").alias("last")).where("pivot.cls <> last")
        .select("run", F.col("pivot.cls").alias("pivot_cls"), F.col("pivot.node").alias("pivot"))
    )
    met = legs.join(pivots, "run").where("cls <> pivot_cls")
    return met.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()


def verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with similarity: the exact Jaccard of the five-word shingle sets, `threshold` or more.

    held: (node, text), a row for each node that pairs name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict = {}
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.a, batch.b, batch.text_a, batch.text_b, strict=True):
                if len(sets) >= 256:
                    sets.clear()
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        sets[node] = shingles(word_hashes(text))
                if (found := jaccard(sets[a], sets[b])) >= threshold:
                    out.append((a, b, found))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    kind = held.schema["node"].dataType.simpleString()
    left = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, f"a {kind}, b {kind}, similarity double")


def estimated_recall(links: DataFrame, trees: int, depths: list[int], threshold: float) -> dict[int, float]:
    """Share of the links that prefixes of each depth find, told from links(similarity, at) found at depth `at`.

    Each found link stands for the inverse of its chance to be found. One link
    at the threshold is added, so that few or no links claim nothing.
    """
    chance = lambda k: F.lit(1.0) - F.pow(F.lit(1.0) - F.pow(F.col("similarity"), k), F.lit(float(trees)))
    found = links.agg(F.sum(1 / chance(F.col("at"))).alias("all"), *[F.sum(chance(F.lit(k)) / chance(F.col("at"))).alias(f"k{k}") for k in depths]).first()
    return {k: ((found[f"k{k}"] or 0) + meeting(threshold, trees, k)) / ((found["all"] or 0) + 1) for k in depths}


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of shingles that each row of x shares with each row of y."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1]))[: len(values)]
    held = np.diff(np.append(np.flatnonzero(fresh), len(values)))
    many = np.repeat(held > 1, held)
    rows, column = rows[many], np.cumsum(fresh[many]) - 1
    out = np.zeros((len(x), len(y)), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        low, high = np.searchsorted(column, (at, at + 2048))
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[rows[low:high], column[low:high] - at] = 1
        out += part[x] @ part[y].T
    return out


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    unseen = linked.any(axis=1)
    tops, ends = [], []
    for seed in np.flatnonzero(unseen).tolist():
        if not unseen[seed]:
            continue
        unseen[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(linked[at] & unseen)
            unseen[found] = False
            queue += found.tolist()
            tops += [at] * len(found)
            ends += found.tolist()
    return tops, ends


def _cell_links(cell: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x and y of a cell, and which of x has an exact Jaccard of `threshold` or more to which other row of y."""
    side = cell.side.to_numpy()
    within = cell.kind.iloc[0] != "main" and cell.i.iloc[0] == cell.j.iloc[0]
    x = np.arange(len(cell)) if within else np.flatnonzero(side == 0)
    y = x if within else np.flatnonzero(side == 1)
    if not len(x) or not len(y):
        return x, y, np.zeros((len(x), len(y)), dtype=bool)
    sets = [shingles(word_hashes(t)) for t in cell.text]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = _shared(sets, x, y)
    return x, y, (both / (size[x][:, None] + size[y][None, :] - both) >= threshold) & (x[:, None] != y[None, :])


def _edges_of(threshold: float, kind: str) -> Callable:
    """Edges (a, b) that join the rows of each cell that are linked across classes: a spanning forest of them."""
    dtype = "int64" if kind == "bigint" else object

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, cell in group.groupby(["run", "kind", "i", "j"], sort=False):
            nodes, (classes, _) = cell.node.to_numpy(dtype=object), pd.factorize(cell.cls)
            x, y, asked = _cell_links(cell, threshold)
            linked = np.zeros((len(cell), len(cell)), dtype=bool)
            i, j = np.nonzero(asked & (classes[x][:, None] != classes[y][None, :]))
            linked[x[i], y[j]] = linked[y[j], x[i]] = True
            tops, ends = _forest(linked)
            a += nodes[tops].tolist()
            b += nodes[ends].tolist()
        return pd.DataFrame({"a": pd.Series(a, dtype=dtype), "b": pd.Series(b, dtype=dtype)})

    return run


def _counts_of(threshold: float, kind: str) -> Callable:
    """(node, n): the links of each row that its cells show."""
    dtype = "int64" if kind == "bigint" else object

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found, n = [], []
        for _, cell in group.groupby(["run", "kind", "i", "j"], sort=False):
            x, y, linked = _cell_links(cell, threshold)
            count = np.bincount(x, weights=linked.sum(axis=1), minlength=len(cell))
            if cell.i.iloc[0] != cell.j.iloc[0]:
                count += np.bincount(y, weights=linked.sum(axis=0), minlength=len(cell))
            found += cell.node.to_numpy(dtype=object).tolist()
            n += count.astype(np.int64).tolist()
        return pd.DataFrame({"node": pd.Series(found, dtype=dtype), "n": pd.Series(n, dtype="int64")})

    return run


def _cell(kind: str, i: Column, j: Column, side: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _met_in_cells(dealt: DataFrame, cells: Column, held: DataFrame) -> DataFrame:
    """Rows of dealt(node, cls, run, n, ...) in each of their cells, with text and `cell_group`: a cell, or many of runs of at most SMALL rows."""
    packs = dealt.where(F.col("n") <= SMALL).count() // 256 + 1
    group = F.when(F.col("n") <= SMALL, F.concat(F.lit("s"), F.pmod(F.xxhash64("run"), F.lit(packs)))).otherwise(F.concat_ws(":", F.hex("run"), "c.kind", "c.i", "c.j"))
    met = dealt.select("node", "cls", "run", "n", F.explode(cells).alias("c")).select("node", "cls", "run", group.alias("cell_group"), "c.*")
    return met.join(held.select("node", "text"), "node")


def links_across_classes(classes: DataFrame, held: DataFrame, trees: int, depth: int, at: int, threshold: float, met_in_twos: bool) -> DataFrame:
    """Edges (a, b) that join rows linked across classes.

    classes: (node, cls, signature); held: (node, text). All pairs of a run,
    of all pieces of any tree, whose classes differ are compared, whatever their
    number; runs of two are left out if the pivot has met the other one
    (met_in_twos). Runs of several trees that hold the same rows are taken once.
    The rows of a run's largest class never meet each other, so a dense run
    costs its strays times its rows. Runs of more than SMALL rows meet in cells
    of two blocks, smaller ones are packed; no task holds more than about two
    blocks, and no pair is written that is not of a cell's spanning forest.
    """
    legs = classes.select("node", "cls", _run(trees, depth, at, _runs(depth, at)).alias("leg")).select("node", "cls", "leg.tree", "leg.run")
    name = F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40)).cast("decimal(38,0)"))
    runs = (
        legs.groupBy("run", "tree", "cls").agg(F.count(F.lit(1)).alias("n"), name.alias("name")).groupBy("run", "tree")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_classes"), F.max(F.struct("n", "cls")).alias("main"), F.sum("name").cast("string").alias("name"), F.sum(F.xxhash64("cls", "n", "name").cast("decimal(38,0)")).cast("string").alias("more"))
        .where(f"n_classes > 1 and n > {2 if met_in_twos else 1}")
    )
    # equal rows have equal names
    runs = runs.groupBy("n", "name", "more").agg(F.min(F.struct("tree", "run", "main")).alias("r")).select("n", "r.*")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    dealt = saved(
        legs.join(runs, ["run", "tree"])
        .select("node", "cls", "run", "n", (F.col("cls") == F.col("main.cls")).alias("is_main"), _blocks(F.col("main.n")).alias("mains"), _blocks(F.col("n") - F.col("main.n")).alias("others"))
        .withColumn("block", mine)
    )
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own, nil = F.col("block"), F.lit(0)
    cells = F.when(F.col("n") <= SMALL, F.array(_cell("all", nil, nil, nil))).when(F.col("is_main"), F.transform(steps("others"), lambda k: _cell("main", k, own, F.lit(1)))).otherwise(F.concat(
        F.transform(steps("others"), lambda k: _cell("other", F.least(own, k), F.greatest(own, k), own > k)),
        F.transform(steps("mains"), lambda k: _cell("main", own, k, F.lit(0))),
    ))
    node = held.schema["node"].dataType.simpleString()
    return _met_in_cells(dealt, cells, held).groupBy("cell_group").applyInPandas(_edges_of(threshold, node), f"a {node}, b {node}")


def links_within_classes(roots: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(node, n): the number of rows of its class that each row of roots(node, root) is linked to, for classes of several rows.

    held: (node, text). All pairs of a class are compared by their exact
    Jaccard, so no link inside one is left out, however the class was joined.
    Classes of more than SMALL rows meet in cells of two blocks, smaller ones
    are packed; the two rows of a class are linked. No pair is written.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = saved(
        roots.join(sizes, "root").select("node", F.col("root").alias("cls"), F.col("root").alias("run"), "n", _blocks(F.col("n")).alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    own, nil = F.col("block"), F.lit(0)
    cells = F.when(F.col("n") <= SMALL, F.array(_cell("all", nil, nil, nil))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: _cell("other", F.least(own, k), F.greatest(own, k), own > k))
    )
    node = held.schema["node"].dataType.simpleString()
    counts = _met_in_cells(dealt.where("n > 2"), cells, held).groupBy("cell_group").applyInPandas(_counts_of(threshold, node), f"node {node}, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n")).unionByName(dealt.where("n = 2").select("node", F.lit(1).cast("long").alias("n")))


def similar_classes(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], trees: int, depth: int, recall: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the nodes that meet another one, and (node, text) of them.

    nodes: (node, signature) with `depth` values for each of `trees` trees;
    texts_of(named) gives (node, text) of the nodes it names. In each tree rows
    are first met by their full prefix. Each row meets its run's pivot; verified
    links join classes, which later runs know. The prefix is then shortened to
    the longest one whose recall, told from the links found so far, reaches the
    target, until none is wanted that is shorter. Then all pairs whose classes
    still differ are compared, block by block, in the runs of the shortest
    prefix, at which a pair at the threshold meets with the recall, and of as
    many further pieces of that length as each tree's values hold.
    """
    least, most = matched_depth(threshold, trees, depth, recall), matched_depth(threshold, trees, depth, LEAST_RECALL)
    signed = nodes.select("node", "signature")
    company = saved(in_company(signed, trees, depth, least))
    held = saved(texts_of(company).join(signed, "node"))
    labels = held.select("node", F.col("node").alias("cls"))
    links = tried = None
    at = depth
    while True:
        asked = pivot_pairs(held.select("node", "signature").join(labels, "node"), trees, depth, at)
        asked = saved(asked if tried is None else asked.join(tried, ["a", "b"], "left_anti"))
        found = saved(verified(asked, held, threshold).withColumn("at", F.lit(float(at))))
        tried, links = (asked, found) if tried is None else (tried.unionByName(asked), links.unionByName(found))
        roots = components(links.select("a", "b"))
        labels = saved(held.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("cls")))
        share = estimated_recall(links, trees, list(range(least, depth + 1)), threshold)
        wanted = max([k for k in range(least, min(at, most) + 1) if share[k] >= recall], default=least)
        if wanted >= at:
            break
        at = wanted
    met_in_twos = at == least and _runs(depth, least) == 1
    bridges = saved(links_across_classes(held.select("node", "signature").join(labels, "node"), held, trees, depth, least, threshold, met_in_twos))
    bridges = bridges.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(bridges).toDF("old", "new")
    roots = labels.join(merged, F.col("cls") == F.col("old"), "left").select("node", F.coalesce("new", "cls").alias("root"))
    return saved(roots), held


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node of its component.

    Edges from a node to itself are left out; an empty table gives none.
    Alternating large-star and small-star steps. Each step is a grouped
    minimum, combined before its shuffle, and a join; the driver sees two
    numbers a round.
    """
    current = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        current = saved(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = mark(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
