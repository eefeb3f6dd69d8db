"""Set operators on molecule graphs: atoms (keys, atom_idx, ...) and bonds (keys, bond_idx, a, b, type, ...).

`keys` names the columns that tell one graph from another. All of it is grouping and joining by keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .labels import ELEMENTS

#: Graphs of up to so many edges are searched for components as they are, about so many edges at a time; larger ones by rounds.
SMALL_EDGES = 1 << 16
#: Edges of larger graphs that a task holds at once as it leaves out those which connect nothing new.
HELD_EDGES = 1 << 20
#: Rows of a task that makes them distinct, about.
DEALT_ROWS = 1 << 19


def distinct_rows(rows: DataFrame, dealt: int = DEALT_ROWS) -> DataFrame:
    """distinct() for rows few of which are equal: counted, and dealt to tasks of about `dealt` rows.

    A table of them before the shuffle saves nothing there, and it and what is joined to a partition after it hold as much as a split or a coalesced partition has.
    """
    return rows.repartition(rows.count() // dealt + 1, *rows.columns).distinct()


def ends(bonds: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """A row for each end of each bond."""
    return bonds.select(*keys, F.explode(F.array("a", "b")).alias("atom_idx"), *more)


def connected_atoms(atoms: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    """Atoms that a bond touches."""
    return atoms.join(ends(bonds, keys), [*keys, "atom_idx"], "left_semi")


def disconnected_atoms(atoms: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    return atoms.join(ends(bonds, keys), [*keys, "atom_idx"], "left_anti")


def distinct_bonds(bonds: DataFrame, keys: list[str], atoms: DataFrame | None = None) -> DataFrame:
    """Bonds without self-loops and, of those with the same ends, the first only; with atoms, both ends must be there."""
    if atoms is not None:
        ids = atoms.select(*keys, "atom_idx")
        bonds = bonds.join(ids.withColumnRenamed("atom_idx", "a"), [*keys, "a"], "left_semi").join(ids.withColumnRenamed("atom_idx", "b"), [*keys, "b"], "left_semi")
    rest = [c for c in bonds.columns if c not in keys and c != "bond_idx"]
    pair = [F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high")]
    first = F.min(F.struct("bond_idx", *rest)).alias("first")
    kept = bonds.where("a <> b").groupBy(*keys, *pair).agg(first)
    return kept.select(*keys, "first.bond_idx", *[f"first.{c}" for c in rest])


def merged_bonds(bonds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bond_idx, a, b, type: parallel bonds as one, its type the first one's plus one for each other."""
    first = F.min(F.struct("bond_idx", "type")).alias("first")
    one = bonds.where("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(first, F.count("*").alias("n"))
    return one.select(*keys, "first.bond_idx", "a", "b", (F.col("first.type") + F.col("n") - 1).alias("type"))


def degrees(bonds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, atom_idx, degree, bond_sum."""
    return ends(bonds, keys, "type").groupBy(*keys, "atom_idx").agg(F.count("*").alias("degree"), F.sum("type").alias("bond_sum"))


def terminal_atoms(bonds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, atom_idx of atoms on one bond only, which is single and not aromatic."""
    e = ends(bonds, keys, "type", "arom").groupBy(*keys, "atom_idx").agg(F.count("*").alias("n"), F.max("type").alias("type"), F.bool_or("arom").alias("arom"))
    return e.where("n = 1 and type = 1 and not arom").select(*keys, "atom_idx")


def without_curves(rows: DataFrame, curves: DataFrame, keys: list[str], children: bool = False) -> DataFrame:
    """rows (keys, curve_id) that do not belong to one of the curves (keys, curve_id, parent_id), nor to its direct children if asked.

    curves has all curves and a flag `drop`.
    """
    gone = curves.where("drop").select(*keys, "curve_id")
    if children:
        parent = gone.withColumnRenamed("curve_id", "parent_id")
        gone = gone.unionByName(curves.join(parent, [*keys, "parent_id"], "left_semi").select(*keys, "curve_id"))
    return rows.join(gone, [*keys, "curve_id"], "left_anti")


def plain_curves(bonds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, curve_id of curves with a plain single bond."""
    return bonds.where("type = 1 and not wedge and not hash").select(*keys, "curve_id").distinct()


def counts(atoms: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_atoms, n_bonds, max_type."""
    a = atoms.groupBy(*keys).agg(F.count("*").alias("n_atoms"))
    b = bonds.groupBy(*keys).agg(F.count("*").alias("n_bonds"), F.max("type").alias("max_type"))
    out = a.join(b, keys, "full") if keys else a.crossJoin(b)  # without keys both have one row
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_atoms", "n_bonds", "max_type")])


def bond_lengths(atoms: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    """bonds with x1, y1, x2, y2 and length."""
    from ..functions.geometry import distance

    at = lambda end, x, y: atoms.select(*keys, F.col("atom_idx").alias(end), F.col("x").alias(x), F.col("y").alias(y))
    both = bonds.join(at("a", "x1", "y1"), [*keys, "a"]).join(at("b", "x2", "y2"), [*keys, "b"])
    return both.withColumn("length", distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def frequent(rows: DataFrame, by: list[str], least: int) -> DataFrame | None:
    """Values of `by` on over a thousandth of all rows and over `least`, so fewer than a thousand; None if there are none, or no more rows than `least`."""
    n = rows.count()
    if n <= least:
        return None
    few = rows.groupBy(*by).count().where(F.col("count") > max(n // 1000, least)).select(*by)
    return few if few.head(1) else None


def looked_up(rows: DataFrame, table: DataFrame, by: list[str], few: DataFrame | None, how: str) -> DataFrame:
    """rows joined with `table`, which has a row at most for a value of `by`; the rows of frequent values stay where they are, and their part of the table is broadcast."""
    if few is None:
        return rows.join(table, by, how)
    few = F.broadcast(few)
    hot = rows.join(few, by, "left_semi").join(F.broadcast(table.join(few, by, "left_semi")), by, how)
    return hot.unionByName(rows.join(few, by, "left_anti").join(table, by, how))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that each is connected with over edges a[i]-b[i]."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _small_components(keys: list[str], kinds: StructType):
    names = kinds.names

    def run(table: pa.Table) -> pa.Table:
        n, graph = table.num_rows, np.zeros(table.num_rows, np.int64)
        for k in keys:
            code = table.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
            graph = np.unique(graph * n + code, return_inverse=True)[1]
        ends = pa.concat_arrays([table.column(k).combine_chunks() for k in "ab"])
        values, order = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
        # numbers of nodes: by graph, then by value, so the smallest number is the smallest node
        _, first, node = np.unique(np.tile(graph, 2) * len(values) + order, return_index=True, return_inverse=True)
        root = _roots(node[:n], node[n:], len(first))
        own = table.select(keys).take(pa.array(first % n))
        return pa.table([*own.columns, ends.take(pa.array(first)), ends.take(pa.array(first[root]))], names=names)

    return run


def _forests(pairs: DataFrame, keys: list[str], kinds: StructType, held: int) -> DataFrame:
    """keys, a, b: edges that connect the same nodes as pairs do, without a shuffle; a task keeps one for each node it meets, while those are up to held / 2."""
    search = _small_components(keys, kinds)

    def run(batches):
        tables, n = [], 0
        for batch in batches:
            tables.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= held:
                found = search(pa.concat_tables(tables, promote_options="default")).rename_columns([*keys, "a", "b"])
                if found.num_rows > held // 2:
                    yield from found.to_batches()
                    tables, n = [], 0
                else:
                    tables, n = [found], found.num_rows
        if n:
            yield from search(pa.concat_tables(tables, promote_options="default")).rename_columns([*keys, "a", "b"]).to_batches()

    return pairs.select(*keys, "a", "b").mapInArrow(run, StructType([StructField(name, k.dataType) for name, k in zip([*keys, "a", "b"], kinds)]))


def components(edges: DataFrame, keys: list[str] = (), cut=None, hot_rows: int = 1_000_000, small: int = SMALL_EDGES, held: int = HELD_EDGES) -> DataFrame:
    """keys, node, component: the smallest node reachable over edges (keys, a, b).

    Graphs (by keys) of up to `small` edges are shuffled once, dealt to buckets of about half as many edges, and searched there. Larger ones, and one without keys, lose
    edges that connect nothing new, `held` at a time, as they are read and again in the order of their components so far. What is left takes
    rounds of neighbour minimum and label jump, whose number grows with the logarithm of a chain's length. `cut` writes edges, results and each round's labels to
    reliable storage; by default that is storage.cut. A node with over `hot_rows` edges, or a label that over so many nodes carry, does not go through one task.
    """
    if cut is None:
        from ..sources.storage import cut
    keys, small = list(keys), min(small, hot_rows)
    c = F.col
    kind = edges.select("a").union(edges.select("b")).schema["a"].dataType
    # null is no graph and no node; a node whose other end is null stands by itself
    pairs = edges.select(*keys, F.coalesce("a", "b").cast(kind).alias("a"), F.coalesce("b", "a").cast(kind).alias("b")).dropna(subset=[*keys, "a"])
    kinds = StructType([*(pairs.schema[k] for k in keys), StructField("node", kind), StructField("component", kind)])
    if not keys:
        return _by_rounds(pairs, keys, kinds, cut, hot_rows, held)
    pairs = cut(pairs)  # counted and read twice
    n = pairs.count()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(2 * n // max(small, 1) + 1)).alias("_bucket")
    has_large = False
    if n > small:  # a graph above the bound fills a bucket beyond it, half full else: few graphs are counted, and fewer than n / small found
        full = cut(pairs.groupBy(bucket).count().where(c("count") > small).select("_bucket"))
        if full.head(1):
            large = pairs.select("*", bucket).join(F.broadcast(full), "_bucket", "left_semi").groupBy(*keys).count()
            large = cut(large.where(c("count") > small).select(*keys))
            has_large = bool(large.head(1))
    few = pairs.join(F.broadcast(large), keys, "left_anti") if has_large else pairs
    out = cut(few.select(*keys, "a", "b", bucket).groupBy("_bucket").applyInArrow(_small_components(keys, kinds), kinds))
    if has_large:
        out = out.unionByName(_by_rounds(pairs.join(F.broadcast(large), keys, "left_semi"), keys, kinds, cut, hot_rows, held))
    return out


def _by_rounds(pairs: DataFrame, keys: list[str], kinds: StructType, cut, hot_rows: int, held: int) -> DataFrame:
    edges = cut(_forests(pairs, keys, kinds, held))
    if (n := edges.count()) > held:  # b is the smallest node so far; up to its order, edges of one component may be anywhere
        edges = cut(_forests(edges.repartitionByRange(n // (2 * held) + 1, *keys, "b", "a"), keys, kinds, held))
    links = cut(distinct_rows(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))))
    hubs = frequent(links, [*keys, "b"], hot_rows)
    hubs = None if hubs is None else cut(hubs)
    labels = cut(links.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("m")).select(*keys, "node", F.least("node", "m").alias("component")))
    many = labels.count() > hot_rows
    while True:
        near = looked_up(links, labels.withColumnRenamed("node", "b"), [*keys, "b"], hubs, "inner").select(*keys, F.col("a").alias("node"), "component")
        low = labels.unionByName(near).groupBy(*keys, "node").agg(F.min("component").alias("low"))
        low = cut(low) if many else low  # counted and read twice
        hot = frequent(low, [*keys, "low"], hot_rows) if many else None
        jump = labels.select(*keys, F.col("node").alias("low"), F.col("component").alias("far"))
        old = labels.withColumnRenamed("component", "old")
        moved = looked_up(low, jump, [*keys, "low"], hot, "left").join(old, [*keys, "node"])
        new = cut(moved.select(*keys, "node", F.least("low", F.coalesce("far", "low")).alias("component"), "old"))
        labels = new.drop("old")
        if not new.where("component <> old").head(1):
            return labels


def component_boxes(nodes: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, component, x1, y1, x2, y2, n of nodes (keys, component, x, y)."""
    return nodes.groupBy(*keys, "component").agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"), F.count("*").alias("n"))


def collapsed(points: DataFrame, reach: float, keys: list[str] = ()) -> DataFrame:
    """keys, id, x, y, n: points (keys, id, x, y) joined by steps shorter than `reach` as one, the smallest id at the mean of all.

    Neighbours are found by grid cell; a point without any stays as it is.
    """
    from ..functions.geometry import distance
    from .spatial import near_pairs

    keys = list(keys)
    pairs = near_pairs(points, points, reach, distance, keys, ordered=True)
    groups = components(pairs.select(*keys, F.col("id1").alias("a"), F.col("id2").alias("b")), keys).withColumnRenamed("node", "id")
    whole = points.join(groups, [*keys, "id"], "left").withColumn("id", F.coalesce("component", "id"))
    return whole.groupBy(*keys, "id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def rejoin_pairs(atoms: DataFrame, fragments: DataFrame, keys: list[str], average: float | str) -> DataFrame:
    """keys, a, b, gap, coincide: for each two fragments of a graph of at most three the closest pair of atoms near enough to join.

    atoms: keys, atom_idx, x, y, label; fragments: keys, atom_idx, component. Fragments have over two atoms. A gap over a third and
    under 1.1 of the average bond (a number, or a column of atoms) is a new bond if no label is longer than one character; a smaller one makes the atoms
    coincide. Atoms meet by cells of 1.1 average bonds; a is the atom of the fragment with the smaller name.
    """
    from ..functions.geometry import distance
    from .spatial import near_pairs

    c, own = F.col, list(keys)
    unit = c(average) if isinstance(average, str) else F.lit(float(average))
    keys = [*own, "_graph"]  # a graph without keys is one too
    fragments = fragments.withColumn("_graph", F.lit(0))
    sizes = fragments.groupBy(*keys, "component").count()
    few = sizes.groupBy(*keys).agg(F.count("*").alias("n")).where("n between 2 and 3").drop("n")
    f = atoms.withColumn("_unit", unit).withColumn("_graph", F.lit(0)).join(fragments, [*keys, "atom_idx"]).join(few, keys, "left_semi")
    f = f.join(sizes.where("count > 2").drop("count"), [*keys, "component"], "left_semi").select(*keys, "component", "atom_idx", "x", "y", "label", "_unit")
    points = f.select(*keys, c("atom_idx").alias("id"), (c("x") / c("_unit")).alias("x"), (c("y") / c("_unit")).alias("y"))
    side = lambda k: f.select(*keys, c("atom_idx").alias(f"id{k}"), c("component").alias(f"c{k}"), c("x").alias(f"x{k}"), c("y").alias(f"y{k}"), c("label").alias(f"l{k}"), *([c("_unit")] if k == 1 else []))
    met = near_pairs(points, points, 1.1, distance, keys).select(*keys, "id1", "id2").join(side(1), [*keys, "id1"]).join(side(2), [*keys, "id2"]).where("c1 < c2")
    gap = distance(c("x1"), c("y1"), c("x2"), c("y2"))
    best = met.groupBy(*keys, "c1", "c2", "_unit").agg(F.min(F.struct(gap.alias("gap"), c("id1").alias("a"), c("id2").alias("b"), "l1", "l2")).alias("p")).select(*keys, "_unit", "p.*")
    short = (F.length(F.trim("l1")) < 2) & (F.length(F.trim("l2")) < 2)
    near = c("gap") <= c("_unit") / 3
    return best.where(near | ((c("gap") < 1.1 * c("_unit")) & short)).select(*own, "a", "b", "gap", near.alias("coincide"))


FEATURES = (
    "C N O F S Cl Br Si U Me Li R Xx rings aromatic_rings fragments rings5 rings6 hashes wedges double_o positive letters atoms heavy bonds"
).split()


def features(atoms: DataFrame, bonds: DataFrame, keys: list[str], rings: DataFrame) -> DataFrame:
    """keys and features, 26 counts: ten elements and Me, R, Xx, rings, aromatic rings, fragments, 5- and 6-rings, hash, wedge and C=O
    bonds, positive charges, recognised letters, atoms, heavy atoms, bonds.

    atoms: atom_idx, symbol, label, charge; bonds: a, b, type, hash, wedge; rings: keys, rings, aromatic_rings, fragments, rings5, rings6.
    A carbon with a label of its own counts as Me and not as C.
    """
    from ..functions.text import readable_count

    symbol, own = F.col("symbol"), F.length(F.trim(F.coalesce("label", F.lit("")))) > 0
    me = (symbol == "C") & own
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("int")
    a = atoms.groupBy(*keys).agg(
        count((symbol == "C") & ~me).alias("C"), *[count(symbol == e).alias(e) for e in FEATURES[1:9]], count(me).alias("Me"), count(symbol == "Li").alias("Li"),
        count(symbol == "R").alias("R"), count(~symbol.isin(*ELEMENTS, "R")).alias("Xx"), count(F.col("charge") > 0).alias("positive"),
        F.sum(readable_count(F.coalesce("label", F.lit("")))).cast("int").alias("letters"), F.count("*").cast("int").alias("atoms"), count(symbol != "H").alias("heavy"),
    )
    named = lambda end: atoms.select(*keys, F.col("atom_idx").alias(end), F.col("symbol").alias(f"{end}_symbol"))
    both = bonds.join(named("a"), [*keys, "a"]).join(named("b"), [*keys, "b"])
    b = both.groupBy(*keys).agg(count(F.col("hash")).alias("hashes"), count(F.col("wedge")).alias("wedges"), count((F.col("type") == 2) & ((F.col("a_symbol") == "O") | (F.col("b_symbol") == "O"))).alias("double_o"), F.count("*").cast("int").alias("bonds"))
    all_ = a.join(b, keys, "left").join(rings, keys, "left")
    return all_.select(*keys, F.array(*[F.coalesce(F.col(n), F.lit(0)).cast("int") for n in FEATURES]).alias("features"))


def linear_score(values, weights: list[float]):
    """Dot product of an array column with fixed weights."""
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
