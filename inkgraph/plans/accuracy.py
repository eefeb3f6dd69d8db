"""From pages and their true structures to the share that was recognised."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chem, evaluate
from .recognise import WEIGHTS, Options, recognise


def stem(path: Column) -> Column:
    """A file's name without folders and without what follows its last dot."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


@F.pandas_udf("string")
def mol_identity(mol: pd.Series) -> pd.Series:
    """The identity key of connection tables; null where a table cannot be read."""

    def one(text):
        try:
            return chem.identity(*chem.parse_molfile(text))
        except (ValueError, IndexError, KeyError):
            return None

    return mol.map(one, na_action="ignore")


def truth_of(sd: DataFrame) -> DataFrame:
    """file, identity_key of the records of `chem.read_sd`, a row each."""
    return sd.select(stem(F.col("path")).alias("file"), mol_identity("mol").alias("identity_key"))


def accuracy(pages: DataFrame, sd: DataFrame, options: Options = Options(), reader=None, spelling: DataFrame | None = None, superatoms: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """identical, total, recall: recognised structures that are true ones of the file of the same name, the true ones, and the share of distinct true ones that
    were recognised. pages as of `read_pages`, sd as of `read_sd`; files without a page count in full, null keys match nothing.
    """
    from ..sources.storage import cut

    names = pages.select("doc_id", stem(F.col("path")).alias("file")).distinct()
    found = recognise(pages, options, reader, spelling, superatoms, weights).where("error IS NULL").join(names, "doc_id").select("file", "identity_key")
    found, truth = cut(found), cut(truth_of(sd))
    return evaluate.matched(found, truth, ["file"]).crossJoin(evaluate.ideal_recall(found, truth, ["file"]))  # one row each
