"""Residue order, sequences, regions and exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descra.functions import chemistry as ch

KEY = ["structure_id", "chain", "resnum", "icode", "resname"]


def order(resnum: Column, icode: Column) -> list[Column]:
    """Sort columns: by number, then code; at 112 codes run backwards and none comes last."""
    letter = F.upper(icode)
    back = F.when(icode == "", F.lit("~")).otherwise(F.char(F.lit(155) - F.ascii(letter)))
    return [resnum, F.when(resnum == 112, back).otherwise(letter)]


def residues(atoms: DataFrame) -> DataFrame:
    """One row a residue with its first serial place and its place in the chain (seq_idx from 0)."""
    own = atoms.groupBy(*KEY).agg(F.min("atom_ord").alias("first_atom"))
    chain = Window.partitionBy("structure_id", "chain").orderBy(*order(F.col("resnum"), F.col("icode")), "resname")  # a chain is short
    return own.withColumn("seq_idx", F.row_number().over(chain) - 1)


def termini(res: DataFrame) -> DataFrame:
    return res.groupBy("structure_id", "chain").agg(F.min_by(F.struct(*KEY[2:]), "seq_idx").alias("n_term"), F.max_by(F.struct(*KEY[2:]), "seq_idx").alias("c_term"))


def sequences(res: DataFrame) -> DataFrame:
    """structure_id, chain, sequence in one-letter code (X for others)."""
    letter = ch.table(ch.ONE_LETTER, F.col("resname"), "X")
    return res.groupBy("structure_id", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_idx", letter.alias("a")))), lambda x: x["a"]), "").alias("sequence"))


def islands(df: DataFrame, keys: list[str], index: str, name: str = "island") -> DataFrame:
    """df with a number for each run of successive index values within the keys (repeated values share it)."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(index))
    return df.withColumn(name, F.col(index) - place)


def fragments(res: DataFrame, chosen: Column) -> DataFrame:
    """Sequences of the runs of chosen residues."""
    runs = islands(res.where(chosen), ["structure_id", "chain"], "seq_idx")
    letter = ch.table(ch.ONE_LETTER, F.col("resname"), "X")
    return runs.groupBy("structure_id", "chain", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_idx", letter.alias("a")))), lambda x: x["a"]), "").alias("fragment"))


def exposed(sasa: DataFrame, threshold: float = ch.EXPOSED) -> DataFrame:
    return sasa.where(F.col("side_rel") > threshold)


def within(rows: DataFrame, res: DataFrame) -> DataFrame:
    """Rows of residues that the structure has."""
    return rows.join(res.select(*KEY), KEY, "left_semi")


def missing_coverage(rows: DataFrame, res: DataFrame) -> DataFrame:
    """structure_id, chain, residues, missing (of the structure, that rows lack) of each chain that lacks any, and whether no chain of the structure is in rows."""
    there = rows.select(*KEY, F.lit(1).alias("_there")).distinct()
    by_chain = res.select(*KEY).distinct().join(there, KEY, "left").groupBy("structure_id", "chain").agg(F.count("*").alias("residues"), F.count_if(F.col("_there").isNull()).alias("missing"))
    known = rows.select("structure_id", "chain").distinct().withColumn("_known", F.lit(True))
    found = by_chain.join(known, ["structure_id", "chain"], "left")
    apart = found.groupBy("structure_id").agg((F.count("_known") == 0).alias("disjoint"))
    return found.where("missing > 0").join(apart, "structure_id").select("structure_id", "chain", "residues", "missing", "disjoint")


def collisions(res: DataFrame) -> DataFrame:
    """(structure_id, chain, resnum) that more than one residue has."""
    return res.groupBy("structure_id", "chain", "resnum").agg(F.count("*").alias("n")).where("n > 1")


def spare_numbers(res: DataFrame) -> DataFrame:
    """old_* and new_* keys that give residues with an insertion code in a collision a number of the chain's spare pool.

    A chain with more of them than the 99 numbers of its pool is an error.
    """
    pool = F.when(F.col("chain") == "H", 901).when(F.col("chain") == "L", 801).otherwise(701)
    hit = res.where("icode <> ''").join(collisions(res).select("structure_id", "chain", "resnum"), ["structure_id", "chain", "resnum"], "left_semi")
    place = F.row_number().over(Window.partitionBy("structure_id", "chain").orderBy("seq_idx")) - 1
    number = F.when(F.col("_i") < 99, F.col("_i")).otherwise(F.raise_error(F.format_string("%s %s: more than 99 insertion codes in collisions", "structure_id", "chain")).cast("int"))
    return hit.withColumn("_i", place).withColumn("_i", number).select(*[F.col(k).alias(f"old_{k}") for k in KEY], "structure_id", "chain", (pool + F.col("_i")).alias("new_resnum"), F.lit("").alias("new_icode"), F.col("resname").alias("new_resname"))


def peptide_bonds(atoms: DataFrame, res: DataFrame, low: float = 1.0, high: float = 2.0) -> DataFrame:
    """C-N distance from each residue to the next in its chain, and whether it lies in [low, high]."""
    at = lambda n: F.max(F.when(F.col("name") == n, F.struct("x", "y", "z"))).alias(n)
    parts = atoms.groupBy(*KEY).agg(at("C"), at("N")).join(res.select(*KEY, "seq_idx"), KEY)
    chain = Window.partitionBy("structure_id", "chain").orderBy("seq_idx")
    d = F.sqrt(sum((F.col(f"C.{c}") - F.col(f"next.{c}")) ** 2 for c in "xyz"))
    return parts.withColumn("next", F.lead("N").over(chain)).where("C is not null and next is not null").withColumn("length", d).withColumn("ok", F.col("length").between(low, high)).select(*KEY, "length", "ok")


def unrefined(atoms: DataFrame) -> DataFrame:
    """structure_id, all_zero: every B factor is 0, so the structure was not refined."""
    return atoms.groupBy("structure_id").agg(F.bool_and(F.abs("bfactor") < 1e-6).alias("all_zero"))
