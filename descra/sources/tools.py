"""Per-residue tables from the text outputs of surface, pKa and secondary-structure tools, and the charge library."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.functions import scalars as sc
from descra.sources.results import stem

KEY = ["structure_id", "chain", "resnum", "icode", "resname"]
AREAS = ("all_abs", "all_rel", "side_abs", "side_rel", "main_abs", "main_rel", "nonpolar_abs", "nonpolar_rel", "polar_abs", "polar_rel")


def lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """structure_id, n (line number), line."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("structure_id"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def read_sasa(spark: SparkSession, path: str, glob: str = "*.{sasa,rsa}") -> tuple[DataFrame, DataFrame]:
    """Residue areas (relative ones as fractions; N/A is 0) and structure_id, total of files that have a TOTAL line."""
    rows = lines(spark, path, glob).withColumn("f", F.split(F.trim("line"), r"\s+"))
    total = rows.where(F.col("f")[0] == "TOTAL").groupBy("structure_id").agg(F.min_by(F.col("f")[1].try_cast("double"), "n").alias("total"))
    # A four-digit number may touch the chain.
    own = rows.where(F.col("f")[0] == "RES").withColumn("f", F.split(F.trim(F.regexp_replace("line", r"^(RES\s+\S+\s+[A-Za-z])(-?\d)", "$1 $2")), r"\s+"))
    number, code = sc.residue_number(F.col("f")[3])
    value = lambda i, c: F.coalesce(F.get("f", F.lit(4 + i)).try_cast("double"), F.lit(0.0)) / (100.0 if c.endswith("rel") else 1.0)
    res = own.select("structure_id", F.col("f")[2].alias("chain"), number.alias("resnum"), code.alias("icode"), F.upper(F.col("f")[1]).alias("resname"), *[value(i, c).alias(c) for i, c in enumerate(AREAS)])
    return res.where("resnum is not null").join(total.where("total is not null").select("structure_id"), "structure_id", "left_semi"), total


def missing_totals(spark: SparkSession, path: str, glob: str = "*.{sasa,rsa}") -> DataFrame:
    """Violations: files without a TOTAL line."""
    all_ = lines(spark, path, glob).groupBy("structure_id").agg(F.bool_or(F.col("line").startswith("TOTAL")).alias("ok")).where("not ok")
    return all_.select(F.lit("no TOTAL line").alias("rule"), F.col("structure_id").alias("key"), F.lit("").alias("detail"))


PKA_ROWS = ("ASP", "GLU", "HIS", "CYS", "TYR", "LYS", "ARG", "N+", "C-")


def read_pka(spark: SparkSession, path: str, glob: str = "*.pka") -> DataFrame:
    """KEY and pka from the rows after the header with RESIDUE and pKa; a mark after the value is dropped, the first value of a residue stays."""
    rows = lines(spark, path, glob)
    head = rows.where(F.col("line").contains("RESIDUE") & F.col("line").contains("pKa")).groupBy("structure_id").agg(F.min("n").alias("head"))
    own = rows.join(head, "structure_id").where(F.col("n") > F.col("head") + 1).withColumn("f", F.split(F.trim("line"), r"\s+"))
    own = own.where(F.col("f")[0].isin(*PKA_ROWS) & (F.size("f") >= 4))
    number, code = sc.residue_number(F.col("f")[1])
    value = F.regexp_replace(F.col("f")[3], r"\*+$", "").try_cast("double")
    out = own.select("structure_id", F.col("f")[2].alias("chain"), number.alias("resnum"), code.alias("icode"), F.col("f")[0].alias("resname"), value.alias("pka"), "n").where("pka is not null and resnum is not null")
    return out.groupBy(*KEY).agg(F.min_by("pka", "n").alias("pka"))


def read_dssp(spark: SparkSession, path: str, glob: str = "*.dssp") -> DataFrame:
    """KEY (resname as one letter), dssp_seq, ss and hbonds (offset, energy) from fixed columns; empty bonds are dropped."""
    rows = lines(spark, path, glob)
    head = rows.where(F.col("line").rlike(r"^\s*#\s+RESIDUE\s+AA\s+STRUCTURE")).groupBy("structure_id").agg(F.min("n").alias("head"))
    own = rows.join(head, "structure_id").where("n > head and length(line) >= 14")
    code = F.trim(F.substring("line", 11, 1))
    field = F.trim(F.substring("line", 6, 5))
    number, own_code = sc.residue_number(field)
    pairs = F.regexp_extract_all(F.substring("line", 40, 10_000), F.lit(r"(-?\d+\s*,\s*-?\d+(?:\.\d+)?)"), 1)
    bonds = F.filter(F.transform(pairs, lambda p: F.struct(F.trim(F.split(p, ",")[0]).cast("int").alias("offset"), F.trim(F.split(p, ",")[1]).cast("double").alias("energy"))), lambda b: (b["offset"] != 0) | (b["energy"] != 0))
    return own.select("structure_id", F.trim(F.substring("line", 12, 1)).alias("chain"), number.alias("resnum"), F.when(own_code != "", own_code).otherwise(F.when(code.rlike("^[A-Za-z]$"), code).otherwise("")).alias("icode"), F.substring("line", 14, 1).alias("aa"), F.trim(F.substring("line", 1, 5)).try_cast("int").alias("dssp_seq"), F.trim(F.substring("line", 17, 1)).alias("ss"), bonds.alias("hbonds")).where("resnum is not null and aa <> '!'")


_ATOMS = re.compile(r"^!entry\.(\S+)\.unit\.atoms table")
_ATOM = re.compile(r'^\s*"([^"]+)"\s+"[^"]*"(?:\s+-?\d+){5}\s+(-?[0-9.eE+-]+)\s*$')


def charge_library(text: str) -> dict[tuple[str, str], float]:
    """(residue, atom) to charge from an OFF library; HIS is read as HIE."""
    out, residue = {}, None
    for line in text.splitlines():
        if m := _ATOMS.match(line):
            residue = m[1].upper()
        elif line.startswith("!") and not line.startswith("!!"):
            residue = None
        elif residue and (m := _ATOM.match(line)):
            out[residue, m[1].strip().upper()] = float(m[2])
    return out | {("HIS", a): q for (r, a), q in out.items() if r == "HIE"}


def charge_table(spark: SparkSession, library: dict[tuple[str, str], float]) -> DataFrame:
    return spark.createDataFrame([(r, a, q) for (r, a), q in sorted(library.items())], "lookup string, name string, charge double")


def with_charges(atoms: DataFrame, library: DataFrame, by_protons: bool = True) -> DataFrame:
    """atoms with ``charge``: by name, a terminal oxygen as O, terminal hydrogens as H, else 0.

    With by_protons a histidine is taken by the hydrogens it shows (both: HIP, HD1 only: HID, else HIE).
    The library has a few hundred rows, so it is broadcast.
    """
    if by_protons:
        seen = atoms.where(F.col("resname") == "HIS").groupBy(*KEY).agg(F.bool_or(F.col("name") == "HD1").alias("_hd"), F.bool_or(F.col("name") == "HE2").alias("_he"))
        atoms = atoms.join(seen, KEY, "left")
        state = F.when(F.col("_hd") & F.col("_he"), "HIP").when(F.col("_hd"), "HID").otherwise("HIE")
    else:
        state = F.lit("HIE")
    out = atoms.withColumn("lookup", F.when(F.col("resname") == "HIS", state).otherwise(F.col("resname"))).drop("_hd", "_he")
    out = out.withColumn("_other", F.when(F.col("name") == "OXT", "O").when(F.col("name").isin("H1", "H2", "H3"), "H"))
    first = F.broadcast(library)
    second = F.broadcast(library.select("lookup", F.col("name").alias("_other"), F.col("charge").alias("_charge")))
    return out.join(first, ["lookup", "name"], "left").join(second, ["lookup", "_other"], "left").withColumn("charge", F.coalesce("charge", "_charge", F.lit(0.0))).drop("lookup", "_other", "_charge")
