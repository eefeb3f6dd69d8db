"""Correction and resolution of atom labels by dictionaries.

A dictionary is a small table by nature, but its size is not taken on trust: Spark broadcasts it if it is under the session's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of the elements, by atomic number from 1.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd "
    "In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu"
).split()


def plain_label(label: Column, bonds: Column) -> Column:
    """A label before the dictionary: one character is upper-cased, and H with more than one bond is N."""
    return F.when((label == "H") & (bonds > 1), "N").when(F.length(label) == 1, F.upper(label)).otherwise(label)


def correct_labels(atoms: DataFrame, spelling: DataFrame, label: str, bonds: Column, out: str = "corrected") -> DataFrame:
    """atoms with `out`: the dictionary's value for the label as it was read, else plain_label."""
    pairs = spelling.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    joined = atoms.join(pairs, F.col(label) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce("_value", plain_label(F.col(label), bonds))).drop("_key", "_value")


def atomic_number(symbol: Column) -> Column:
    """From 1; null for anything else."""
    at = F.array_position(F.array(*[F.lit(e) for e in ELEMENTS]), symbol)
    return F.when(at > 0, at).cast("int")


def resolve_labels(atoms: DataFrame, superatoms: DataFrame, label: str) -> DataFrame:
    """atoms with `smiles` and `anum`: blank is carbon, then the superatom's fragment, then the element; anum 0 is unknown."""
    pairs = superatoms.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    joined = atoms.join(pairs, F.col(label) == F.col("_key"), "left")
    blank = F.coalesce(F.trim(label), F.lit("")) == ""
    number = F.when(blank, 6).when(F.col("_value").isNotNull(), F.lit(None)).otherwise(F.coalesce(atomic_number(F.col(label)), F.lit(0)))
    return joined.withColumn("smiles", F.when(~blank, F.col("_value"))).withColumn("anum", number).drop("_key", "_value")


def unresolved(atoms: DataFrame, superatoms: DataFrame, label: str) -> DataFrame:
    """The rows whose label is in neither the dictionary nor the element table."""
    known = superatoms.select(F.col("key").alias("_key"))
    return atoms.where(atomic_number(F.col(label)).isNull()).join(known, F.col(label) == F.col("_key"), "left_anti")


def signed_charge(label: Column) -> tuple[Column, Column]:
    """(label without signs, charge): each minus, then each plus is struck out and counts if what is left then starts with a letter."""
    signs = lambda s: F.length(F.regexp_replace(label, f"[^{s}]", ""))
    bare = F.regexp_replace(label, "[-+]", "")
    # while minus signs go, a leading plus still stands in front, and a second leading minus in front of the rest
    lead = F.length(F.regexp_extract(label, "^([-]*)", 1))
    starts = F.rlike(bare, F.lit("^[A-Za-z]"))
    plus_first = F.rlike(F.regexp_replace(label, "-", ""), F.lit(r"^\+"))
    minus = F.when(plus_first | ~starts, 0).otherwise(signs("-") - F.greatest(lead - 1, F.lit(0)))
    lead_plus = F.length(F.regexp_extract(F.regexp_replace(label, "-", ""), r"^(\+*)", 1))
    plus = F.when(~starts, 0).otherwise(signs("+") - F.greatest(lead_plus - 1, F.lit(0)))
    return bare, (plus - minus).cast("int")


def assign_charges(atoms: DataFrame, bonds: DataFrame, spelling: DataFrame, keys: list[str]) -> DataFrame:
    """atoms (keys, atom_idx, label) with charge and corrected label, from bonds (keys, a, b, type, hash).

    An atom on a hash bond has no charge. Bonds to atoms that are not there do not count.
    """
    ids = atoms.select(*keys, "atom_idx")
    live = bonds.join(ids.withColumnRenamed("atom_idx", "a"), [*keys, "a"], "left_semi").join(ids.withColumnRenamed("atom_idx", "b"), [*keys, "b"], "left_semi")
    ends = live.select(*keys, F.explode(F.array("a", "b")).alias("atom_idx"), "type", "hash")
    sums = ends.groupBy(*keys, "atom_idx").agg(F.sum("type").alias("_n"), F.bool_or("hash").alias("_hash"))
    joined = atoms.join(sums, [*keys, "atom_idx"], "left")
    bare, charge = signed_charge(F.col("label"))
    marked = joined.withColumn("charge", F.when(F.coalesce("_hash", F.lit(False)), 0).otherwise(charge)).withColumn("label", bare)
    fixed = correct_labels(marked, spelling, "label", F.coalesce("_n", F.lit(0)), "_label")
    return fixed.withColumn("label", F.col("_label")).drop("_label", "_n", "_hash")
