"""From pages to structure records: one plan, options as a dataclass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import agents, chem, cleanup, glyphs, graph, labels, molecule, raster, reaction, segment, select, tidy

RECORDS = "doc_id long, page_no int, box_id int, res_iter int, dpi int, frag_id int, structure string, mol string, identity_key string, confidence double, avg_bond double, x1 int, y1 int, x2 int, y2 int, error string"
FORMATS = ("smi", "can", "sdf", "mol", "rsmi", "rxn", "cmlr")
#: Ours, not trained: weights of graph.FEATURES, 0 for those that are not named.
WEIGHTS = {"atoms": 0.02, "rings6": 0.3, "rings5": 0.2, "Xx": -0.5, "fragments": -0.1}
BOX = ["doc_id", "page_no", "box_id", "res_iter"]
KEY = ["drawing"]
GRAPHS = (
    "doc_id long, page_no int, box_id int, res_iter int, dpi int, left int, top int, scale double, average double, "
    "atoms array<struct<atom_idx:int,x:double,y:double,label:string>>, bonds array<struct<bond_idx:int,a:int,b:int,type:int,hash:boolean,wedge:boolean,arom:boolean>>"
)
#: What is read off the pixels of a box: its lines, with their widths at places along them, its letters, and circles.
TRACES = (
    GRAPHS + ", letters array<struct<letter_idx:int,a:string,x:double,y:double,r:double>>, circles array<struct<x:double,y:double,diameter:double>>, samples array<struct<id:int,x:double,y:double,w:double>>"
)


@dataclass(frozen=True)
class Options:
    """format: of structures. resolution: 0 tries all. threshold: 0 goes by resolution. unpaper: rounds of clean-up."""

    format: str = "can"
    resolution: int = 0
    threshold: float = 0.0
    invert: bool = False
    adaptive: bool = False
    unpaper: int = 0
    jaggy: bool = False
    rotate: float = 0.0
    embedded: str = ""
    learning: bool = False
    confidence: bool = False
    bond_length: bool = False
    shown_resolution: bool = False
    page: bool = False
    coordinates: bool = False

    def checked(self) -> Options:
        """With the format in lower case; ValueError for what does not go together."""
        o = Options(**{**self.__dict__, "format": self.format.lower(), "embedded": self.embedded.lower()})
        if o.format not in FORMATS:
            raise ValueError(f"format {o.format}")
        if o.embedded and (o.format != "sdf" or o.embedded not in ("inchi", "smi", "can")):
            raise ValueError("an embedded format goes with sdf only")
        if o.rotate and o.coordinates:
            raise ValueError("coordinates are lost by rotation")
        return o

    @property
    def reactions(self) -> bool:
        return self.format in ("rsmi", "rxn", "cmlr")


def clean_pages(pages: DataFrame, options: Options) -> DataFrame:
    """pages rotated and cleaned as the options say."""
    if not options.unpaper and not options.rotate:
        return pages

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf.itertuples():
                gray = np.frombuffer(p.gray, np.uint8).reshape(p.height, p.width)
                if options.rotate:
                    gray = cleanup.rotate(gray, np.radians(options.rotate))
                for _ in range(options.unpaper):
                    gray = cleanup.unpaper(gray)[0]
                out.append(gray.tobytes())
            yield pdf.assign(gray=out)

    return pages.mapInPandas(run, pages.schema)


def trace_box(gray: np.ndarray, dpi: int, thin: bool, options: Options, reader=None) -> dict:
    """What the pixels of a box hold: letters, as `reader` reads them, lines between them as atoms and bonds, rows of dashes as hash bonds, circles, the widths of
    lines at ten places of each, the average bond and the scale of all coordinates.
    """
    threshold = options.threshold or (0.4 if dpi >= 150 else 0.2)
    mask, scale, thinned = raster.prepare_box(gray, dpi, dpi, threshold, thin, options.jaggy)
    ink = raster.ink(gray, threshold)  # not thinned, at its own scale
    letters = []
    if reader is not None:
        lab = raster.components(mask if not thinned else ink)
        for k in range(1, lab.max() + 1):
            ys, xs = np.nonzero(lab == k)
            h, w = int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1
            if not 5 <= h <= select.FONT_HEIGHT or not 1 <= w <= 3 * select.FONT_WIDTH:
                continue
            glyph = lab[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] == k
            c = reader(glyph) if w <= select.FONT_WIDTH else glyphs.UNKNOWN
            found = [(c, 0, w)] if c != glyphs.UNKNOWN else glyphs.split_fused(glyph, reader, h // 3, select.FONT_WIDTH) if w > h else []
            for c, first, end in found:
                letters.append({"letter_idx": len(letters), "a": c, "x": float(xs.min() + (first + end - 1) / 2), "y": float(ys.min() + ys.max()) / 2, "r": max(h, end - first) / 2})
            if found:
                mask[ys[(ys < mask.shape[0])], xs[(ys < mask.shape[0])]] = False
    mask, dots, circles = small_parts(mask)
    g = molecule.Graph(*raster.trace(raster.thin(mask)))
    sizes = sorted(g.length(b) for b in g.bonds if g.length(b) > SHORT) or [10.0]
    average = sizes[3 * (len(sizes) - 1) // 4]
    wide = lambda x, y: scale * min(raster.run_through(ink, round(x / scale), round(y / scale), across) for across in (True, False))
    samples = []
    for b in g.live():
        (x1, y1), (x2, y2) = g.at(b["a"]), g.at(b["b"])
        for t in SAMPLES:
            x, y = x1 + (x2 - x1) * t, y1 + (y2 - y1) * t
            samples.append({"id": len(samples), "x": x, "y": y, "w": float(wide(x, y))})
    molecule.dashes_to_bonds(g, dots, average / 2)
    atoms = [{"atom_idx": i, "x": float(a["x"]), "y": float(a["y"]), "label": a["label"]} for i, a in enumerate(g.atoms)]
    bonds = [{"bond_idx": i, **{k: b[k] for k in ("a", "b", "type", "hash", "wedge", "arom")}} for i, b in enumerate(g.live())]
    return {"scale": float(scale), "average": float(average), "atoms": atoms, "bonds": bonds, "letters": letters, "circles": circles, "samples": samples}


#: Where along a line its width is measured.
SAMPLES = tuple((k + 0.5) / 10 for k in range(10))
#: Traced lines of up to so many pixels are no bonds by which others are judged.
SHORT = 6.0


def small_parts(mask: np.ndarray, side: int = select.FONT_HEIGHT) -> tuple[np.ndarray, list[dict], list[dict]]:
    """(mask without them, dots, circles): parts of up to `side` pixels beside larger ones are dots, as x, y and area; round rings inside the box of a larger part
    are circles, as x, y and diameter.
    """
    lab = raster.components(mask)
    parts = []
    for k in range(1, int(lab.max()) + 1):
        ys, xs = np.nonzero(lab == k)
        parts.append((k, xs, ys, int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())))
    large = [p for p in parts if max(p[5] - p[3], p[6] - p[4]) >= side]
    dots, circles, gone = [], [], []
    for k, xs, ys, x1, y1, x2, y2 in parts if large else []:
        w, h = x2 - x1 + 1, y2 - y1 + 1
        if max(w, h) <= side:
            dots.append({"x": float(xs.mean()), "y": float(ys.mean()), "area": len(xs)})
            gone.append(k)
            continue
        r = np.hypot(xs - (x1 + x2) / 2, ys - (y1 + y2) / 2)
        inside = any(p[3] < x1 and p[4] < y1 and x2 < p[5] and y2 < p[6] for p in large)
        if inside and 0.85 < w / h < 1.18 and r.min() > 0.7 * r.max():
            circles.append({"x": (x1 + x2) / 2, "y": (y1 + y2) / 2, "diameter": float(w + h) / 2})
            gone.append(k)
    return mask & ~np.isin(lab, gone), dots, circles


def tidied(traces: DataFrame) -> DataFrame:
    """GRAPHS of TRACES, cut from their lineage: atoms united, kinks taken out, parallel lines made bonds of higher order, lines parted where others end, free ends joined, labels
    attached, wedges and aromatic rings marked. All drawings go through a step at once; only kinks, waves and bridges are walked drawing by drawing.
    """
    from ..sources.storage import cut

    # one number a drawing joins faster, and plans faster, than four columns
    traces = cut(traces.withColumn("drawing", F.monotonically_increasing_id()))
    c, near = F.col, 3.0
    rows = lambda name: traces.select(*KEY, F.explode(name).alias("v")).select(*KEY, "v.*")
    drawings = traces.select(*KEY, "average")
    atoms, bonds = tidy.near_united(rows("atoms"), graph.distinct_bonds(rows("bonds"), KEY), near, KEY)

    def walked(atoms: DataFrame, bonds: DataFrame, passes) -> tuple[DataFrame, DataFrame]:
        both = cut(molecule.clean_graphs(atoms.withColumn("charge", F.lit(0)), bonds, KEY, passes=passes))
        return (
            both.where("kind = 'a'").select(*KEY, c("idx").alias("atom_idx"), "x", "y", "label"),
            both.where("kind = 'b'").select(*KEY, c("idx").alias("bond_idx"), "a", "b", "type", "hash", "wedge", "arom"),
        )

    atoms, bonds = walked(atoms, bonds, molecule.straightened)
    bonds = tidy.parallel_merged(atoms, bonds, drawings, KEY)
    atoms = cut(graph.connected_atoms(atoms, bonds, KEY))
    bonds = tidy.split_at_joints(atoms, bonds, near, KEY)
    atoms, bonds = tidy.ends_joined(atoms, bonds, drawings, 0.25, 0.45, KEY)
    atoms, bonds = tidy.near_united(atoms, bonds, near, KEY)
    atoms, bonds = walked(atoms, bonds, molecule.uncrossed)
    more = graph.merged_bonds(bonds, KEY).select(*KEY, "bond_idx", c("type").cast("int").alias("type"))
    bonds = graph.distinct_bonds(bonds, KEY).drop("type").join(more, [*KEY, "bond_idx"]).select(*bonds.columns)
    bonds = tidy.wedges(atoms, bonds, drawings, rows("samples"), KEY)
    bonds = cut(tidy.round_rings(atoms, tidy.forks_trimmed(atoms, bonds, drawings, 0.25, KEY), drawings, rows("circles"), KEY))
    atoms = cut(graph.connected_atoms(atoms, bonds, KEY))
    labelled = glyphs.assemble_labels(rows("letters"), KEY)
    atoms = tidy.labels_attached(atoms, bonds, drawings, labelled, 0.8, KEY)
    # a drawing's graph, of up to some hundred atoms, is one row again
    listed = lambda df, name, *n: df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*n))).alias(name))
    kinds = {"atom_idx": "int", "bond_idx": "int", "a": "int", "b": "int", "type": "int"}
    typed = lambda df: df.select(*[c(n).cast(kinds[n]).alias(n) if n in kinds else c(n) for n in df.columns])
    whole = traces.select(*KEY, *BOX, "dpi", "left", "top", "scale", "average").join(listed(typed(atoms), "atoms", "atom_idx", "x", "y", "label"), KEY).join(listed(typed(bonds), "bonds", "bond_idx", "a", "b", "type", "hash", "wedge", "arom"), KEY)
    return cut(whole.select(*BOX, "dpi", "left", "top", "scale", "average", "atoms", "bonds"))


def structures(graphs: DataFrame, spelling: DataFrame | None = None, superatoms: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """RECORDS of GRAPHS, one for each fragment worth keeping: labels corrected by `spelling` (key, value), charges taken from them,
    groups resolved by `superatoms` (key, SMILES as value), then the structure's text, 26 features and their weighted sum.

    Fragments of a graph of two or three that come near each other are joined (see graph.rejoin_pairs). A fragment is named by its smallest atom. One with 5 atoms or fewer, or 250 or more, is left out. An atom that a superatom
    replaces counts as a labelled carbon among the features. graphs is read several times: cut its lineage before.
    """
    from ..sources.storage import cut

    spark, part, c = graphs.sparkSession, [*BOX, "frag_id"], F.col
    empty = spark.createDataFrame([], "key string, value string")
    raw = graphs.select(*BOX, F.explode("atoms").alias("v")).select(*BOX, "v.*")
    links = graph.distinct_bonds(graphs.select(*BOX, F.explode("bonds").alias("v")).select(*BOX, "v.*"), BOX)
    own = graph.components(links, BOX).select(*BOX, c("node").alias("atom_idx"), "component")
    # parts of one drawing that the tracing left apart
    gaps = cut(graph.rejoin_pairs(raw.join(graphs.select(*BOX, "average"), BOX), own, BOX, "average"))
    if gaps.head(1):
        made = gaps.where("not coincide").select(*BOX, (c("a") * 1000 + c("b") + 1_000_000).cast("int").alias("bond_idx"), "a", "b", F.lit(1).alias("type"), *[F.lit(False).alias(n) for n in ("hash", "wedge", "arom")])
        raw, links = tidy.united(raw, links.unionByName(made), gaps.where("coincide").select(*BOX, "a", "b"), BOX)
        own = graph.components(links, BOX).select(*BOX, c("node").alias("atom_idx"), "component")
    own = own.withColumnRenamed("component", "frag_id")
    sizes = own.groupBy(*part).count().where((c("count") > select.MIN_ATOMS) & (c("count") < select.MAX_ATOMS)).drop("count")
    own = own.join(sizes, part, "left_semi")
    bonds = links.join(own.withColumnRenamed("atom_idx", "a"), [*BOX, "a"])
    read = raw.join(own, [*BOX, "atom_idx"])
    named = labels.resolve_labels(labels.assign_charges(read, bonds, spelling or empty, part), superatoms or empty, "label")
    element = F.get(F.array(*[F.lit(e) for e in labels.ELEMENTS]), c("anum") - 1)
    symbol = F.when(c("smiles").isNotNull(), "C").when(c("anum") > 0, element).otherwise("*")  # as chem.parse_smiles has it
    scales = graphs.select(*BOX, "dpi", "left", "top", "scale", "average")
    atoms = named.withColumn("symbol", symbol).withColumnRenamed("smiles", "group").join(scales.select(*BOX, "average"), BOX)
    written = chem.write_structures(atoms, bonds, part)
    counted = graph.features(atoms, bonds, part, written.select(*part, "rings", "aromatic_rings", "fragments", "rings5", "rings6"))
    score = counted.select(*part, graph.linear_score(c("features"), [weights.get(n, 0.0) for n in graph.FEATURES]).alias("confidence"))
    boxes = graph.component_boxes(atoms.withColumnRenamed("frag_id", "component"), BOX).withColumnRenamed("component", "frag_id")
    whole = written.join(score, part).join(boxes, part).join(scales, BOX)
    place = [(c(n) / c("scale") + c(corner)).cast("int").alias(n) for n, corner in (("x1", "left"), ("y1", "top"), ("x2", "left"), ("y2", "top"))]
    shown = [c("smiles").alias("structure"), "mol", "identity_key", "confidence", (c("average") / c("scale")).alias("avg_bond")]
    return whole.select(*BOX, "dpi", "frag_id", *shown, *place, F.lit(None).cast("string").alias("error"))


def recognise(pages: DataFrame, options: Options = Options(), reader=None, spelling: DataFrame | None = None, superatoms: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """RECORDS of pages: segmented into boxes, each box at each resolution, then each document's best resolution. A page of which there is
    nothing, as it was not decoded or has too many segments, is a row with the reason as its error.

    A box at a resolution is one row of work, dealt out by all its keys, so a page with many boxes is spread. What is done with
    the graphs of boxes is set work: see `structures` for the dictionaries and weights.
    """
    from ..sources.storage import cut

    options = options.checked()
    good = clean_pages(pages.where("error IS NULL"), options)
    segments = cut(segment.find_segments(good))
    records = records_of(good, segment.boxes_of_segments(segments), options, reader, spelling, superatoms, weights)
    return records.unionByName(unread_of(pages, segments), allowMissingColumns=True)


def reactions_of(pages: DataFrame, options: Options = Options(format="rsmi"), reader=None, spelling: DataFrame | None = None, superatoms: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """doc_id, page_no, arrow_id, reactants, products, agent, reversible, linebreak, x1 .. y2, mols: the reactions of pages, an arrow each, and the connection
    tables of both sides as struct (reactants, products).

    Arrows, plus signs and the characters written around arrows belong to no drawing. What `reader` reads of these characters is the agent, with the drawings that
    lie over the arrow. The fragments of a box are one structure.
    """
    from ..sources.storage import cut

    options, keys, c = options.checked(), ["doc_id", "page_no"], F.col
    good = clean_pages(pages.where("error IS NULL"), options)
    segments = cut(segment.find_segments(good))
    symbols = cut(segment.find_symbols(segments))
    arrows = symbols.where("kind = 'arrow'").select(*keys, c("segment_id").alias("arrow_id"), "tail_x", "tail_y", "head_x", "head_y")
    pluses = symbols.where("kind = 'plus'").select(*keys, c("head_x").alias("x"), c("head_y").alias("y"))
    height, width = c("y2") - c("y1"), c("x2") - c("x1")
    small = segment.measured(segments).where((height <= 2 * select.FONT_HEIGHT) & (width <= 2 * select.FONT_WIDTH) & (height > 5)).join(symbols.select(*keys, "segment_id"), [*keys, "segment_id"], "left_anti")
    characters = small.select(*keys, c("segment_id").alias("glyph_id"), "x1", "y1", "x2", "y2", "points")
    mine = cut(agents.claimed(characters.drop("points"), arrows, keys))
    around = mine.select(*keys, c("glyph_id").alias("segment_id"))
    texts = agents.agent_strings(read_segments(characters.join(mine.select(*keys, "glyph_id"), [*keys, "glyph_id"], "left_semi"), reader), arrows, keys)
    ordered = F.array_sort(F.collect_list(F.struct("line", "agent")))
    texts = texts.groupBy(*keys, "arrow_id").agg(F.array_join(F.transform(ordered, lambda x: x["agent"]), " ").alias("agent"))
    arrows = arrows.join(texts, [*keys, "arrow_id"], "left").withColumn("agent", F.coalesce("agent", F.lit("")))

    boxes = segment.boxes_of_segments(segments, symbols.select(*keys, "segment_id").unionByName(around))
    records = cut(records_of(good, boxes, options, reader, spelling, superatoms, weights))
    box = records.groupBy(*keys, "box_id").agg(F.array_join(F.array_sort(F.collect_list("structure")), ".").alias("structure"), F.max_by("mol", F.struct(F.length("mol"), -c("frag_id"))).alias("mol"), *[f(n).alias(n) for f, n in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    found = cut(reaction.reactions(arrows, pluses, box))
    tables = reaction.reactions(arrows, pluses, box.withColumn("agent_structure", c("structure")).withColumn("structure", c("mol")))
    tables = tables.select(*keys, "arrow_id", F.struct("reactants", "products").alias("mols"))
    return found.join(tables, [*keys, "arrow_id"])


def read_segments(characters: DataFrame, reader) -> DataFrame:
    """characters (points, ...) with `a`, what the reader says of their ink, without those it does not know; without a reader none."""
    if reader is None:
        return characters.withColumn("a", F.lit("")).where("false").drop("points")

    def run(batches):
        for pdf in batches:
            read = []
            for points in pdf["points"]:
                xs, ys = np.array([p["x"] for p in points]), np.array([p["y"] for p in points])
                ink = np.zeros((np.ptp(ys) + 1, np.ptp(xs) + 1), bool)
                ink[ys - ys.min(), xs - xs.min()] = True
                read.append(reader(ink))
            yield pdf.drop(columns="points").assign(a=read)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in characters.schema if f.name != "points"]
    return characters.mapInPandas(run, ", ".join([*fields, "a string"])).where(F.col("a") != glyphs.UNKNOWN)


def records_of(good: DataFrame, boxes: DataFrame, options: Options, reader=None, spelling: DataFrame | None = None, superatoms: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """RECORDS of the boxes of decoded pages; at all resolutions where the options say learning, else at each document's best."""
    from ..sources.storage import cut

    spark = good.sparkSession
    keys = ["doc_id", "page_no"]
    boxes = select.large_boxes(boxes, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).select(*keys, "box_id", *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    page = good.select(*keys, "width", "height", "gray")

    def crop(batches):
        for pdf in batches:
            rows = []
            for p in pdf.itertuples():
                gray = np.frombuffer(p.gray, np.uint8).reshape(p.height, p.width)
                x1, y1, x2, y2 = max(p.bx1 - 5, 0), max(p.by1 - 5, 0), min(p.bx2 + 6, p.width), min(p.by2 + 6, p.height)
                rows.append((p.doc_id, p.page_no, p.box_id, x1, y1, x2 - x1, y2 - y1, gray[y1:y2, x1:x2].tobytes()))
            yield pd.DataFrame(rows, columns=[*keys, "box_id", "left", "top", "width", "height", "gray"])

    cropped = page.join(boxes, keys).mapInPandas(crop, "doc_id long, page_no int, box_id int, left int, top int, width int, height int, gray binary")
    work = cropped.crossJoin(F.broadcast(select.resolutions(spark, options.resolution))).repartition(*keys, "box_id", "res_iter")

    def run(batches):
        names = [x.split()[0] for x in TRACES.split(", ")]
        for pdf in batches:
            rows = []
            for p in pdf.itertuples():
                found = trace_box(np.frombuffer(p.gray, np.uint8).reshape(p.height, p.width), p.dpi, p.thin, options, reader)
                rows.append((p.doc_id, p.page_no, p.box_id, p.res_iter, p.dpi, p.left, p.top, *[found[n] for n in ("scale", "average", "atoms", "bonds", "letters", "circles", "samples")]))
            yield pd.DataFrame(rows, columns=names)

    records = structures(tidied(work.mapInPandas(run, TRACES)), spelling, superatoms, weights)
    if options.learning:
        return records
    return select.select_resolution(cut(records))  # the records feed both the choice and the result


def unread_of(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, page_no, error: the pages that were not decoded, and those of which find_segments gave up."""
    crowded = segments.where("skipped").select("doc_id", "page_no", F.lit(f"over {segment.MOST_SEGMENTS} segments").alias("error"))
    return pages.where("error IS NOT NULL").select("doc_id", "page_no", "error").unionByName(crowded)


def unread(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, page_no, reason: the pages of which `recognise` has nothing but the reason."""
    good = clean_pages(pages.where("error IS NULL"), options)
    return unread_of(pages, segment.find_segments(good)).withColumnRenamed("error", "reason")


def reaction_lines(found: DataFrame, options: Options = Options(format="rsmi")) -> DataFrame:
    """doc_id, ord, line: reactions of `reactions_of` as reaction SMILES, RXN files or CML, in order of page and arrow."""
    o, c = options.checked(), F.col
    if not o.reactions:
        raise ValueError(f"{o.format} is no format of reactions")
    order = Window.partitionBy("doc_id").orderBy("page_no", "y1", "x1", "arrow_id")
    mols = (c("mols.reactants"), c("mols.products"))
    if o.format == "rsmi":
        line = reaction.reaction_smiles(c("reactants"), c("agent"), c("products"))
    else:
        line = reaction.reaction_rxn(*mols) if o.format == "rxn" else reaction.reaction_cml(mols[0], c("agent"), mols[1], c("reversible"))
    return found.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), line.alias("line"))


def lines(records: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, ord, line: the output of records in the options' format, in order of page, box and fragment; pages without any have no line.

    An embedded SMILES is a property of SDF records. Reactions have `reaction_lines`.
    """
    from ..functions import text as X

    order = Window.partitionBy("doc_id").orderBy("page_no", "box_id", "frag_id")
    o, c = options.checked(), F.col
    if o.reactions or o.embedded == "inchi":
        raise ValueError(f"{o.embedded or o.format} is not written from records")
    records = records.where("error IS NULL")
    shown = [(o.bond_length, F.round("avg_bond", 4)), (o.shown_resolution, c("dpi")), (o.confidence, F.round("confidence", 4)), (o.page, c("page_no") + 1), (o.coordinates, X.box_text(c("x1"), c("y1"), c("x2"), c("y2")))]
    if o.format in ("sdf", "mol"):
        props = [("SMILES", bool(o.embedded), c("structure")), ("Confidence_estimate", o.confidence, F.round("confidence", 4)), ("Average_bond_length", o.bond_length, F.round("avg_bond", 4)), ("Resolution", o.shown_resolution, c("dpi")), ("Page", o.page, c("page_no") + 1), ("Surrounding_box", o.coordinates, X.box_text(c("x1"), c("y1"), c("x2"), c("y2")))]
        line = F.concat(c("mol"), *[F.concat(F.lit(f"> <{n}>\n"), v.cast("string"), F.lit("\n\n")) for n, on, v in props if on], F.lit("$$$$"))
    else:
        line = X.output_line(c("structure"), *[v.cast("string") for on, v in shown if on])
    return records.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), line.alias("line"))
