"""Lookup tables and predicates of residues and atoms, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them as they are.
STANDARD_PKA = {"ARG": 12.48, "ASP": 3.90, "GLU": 4.07, "HIS": 6.04, "LYS": 10.54, "TYR": 10.46, "CYS": 8.37}
N_TERMINUS_PKA = 8.0
WIMLEY_WHITE = {
    "ALA": -0.20, "ARG": -0.41, "ASN": -0.51, "ASP": -1.53, "CYS": 0.31, "GLN": -0.71, "GLU": -2.51, "GLY": 0.00, "HIS": -0.20, "ILE": 0.35,
    "LEU": 0.71, "LYS": -0.59, "MET": 0.30, "PHE": 1.43, "PRO": -0.55, "SER": -0.15, "THR": -0.16, "TRP": 2.33, "TYR": 1.19, "VAL": -0.08,
}
KYTE_DOOLITTLE = {
    "ILE": 4.5, "VAL": 4.2, "LEU": 3.8, "PHE": 2.8, "CYS": 2.5, "MET": 1.9, "ALA": 1.8, "GLY": -0.4, "THR": -0.7, "SER": -0.8,
    "TRP": -0.9, "TYR": -1.3, "PRO": -1.6, "HIS": -3.2, "GLU": -3.5, "GLN": -3.5, "ASP": -3.5, "ASN": -3.5, "LYS": -3.9, "ARG": -4.5,
}
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
ACIDS, BASES = ("ASP", "GLU", "CYS", "TYR", "C-"), ("ARG", "LYS", "HIS", "N+")
AROMATIC, NONPOLAR = ("PHE", "TYR", "TRP", "HIS"), ("VAL", "LEU", "ILE", "MET", "PHE", "TRP", "TYR", "CYS")
CDR_RANGES = ((27, 38), (56, 65), (105, 117))
EXPOSED, CHARGED, VICINITY, SALT_BRIDGE, HBOND, HBOND_COSINE, BACKBONE_APART = 0.20, 0.05, 5.0, 4.0, 3.2, 0.5, 3
CLUSTERING = {"neg": (10.0, 2), "pos": (10.0, 2), "hyd": (5.0, 3)}
SHELLS, NULL_DRAWS = ((4.0, 3.0), (7.0, 3.0)), 3000
#: Fixed values, (atom, residue) as below: charged ends of side chains that make salt bridges.
POSITIVE_ATOMS = (("NH1", "ARG"), ("NH2", "ARG"), ("NZ", "LYS"), ("ND1", "HIS"), ("NE2", "HIS"))
NEGATIVE_ATOMS = (("OD1", "ASP"), ("OD2", "ASP"), ("OE1", "GLU"), ("OE2", "GLU"))
#: Fixed values, (atom, residue): base atom and hydrogen bonds it can give; (atom, residue): bonds it can take.
DONORS = {
    ("NE2", "GLN"): ("CD", 2), ("ND2", "ASN"): ("CG", 2), ("NE", "ARG"): ("CZ", 1), ("NH1", "ARG"): ("CZ", 2), ("NH2", "ARG"): ("CZ", 2), ("NZ", "LYS"): ("CE", 3),
    ("ND1", "HIS"): ("CG", 1), ("NE2", "HIS"): ("CD2", 1), ("OG", "SER"): ("CB", 1), ("OG1", "THR"): ("CB", 1), ("OH", "TYR"): ("CZ", 1), ("NE1", "TRP"): ("CD1", 1),
}
ACCEPTORS = {
    ("OE1", "GLN"): 1, ("OE1", "GLU"): 2, ("OE2", "GLU"): 2, ("OD1", "ASN"): 1, ("OD1", "ASP"): 2, ("OD2", "ASP"): 2,
    ("ND1", "HIS"): 1, ("NE2", "HIS"): 1, ("OG", "SER"): 1, ("OG1", "THR"): 1, ("OH", "TYR"): 1,
}


def table(values: dict, key: Column, default=None) -> Column:
    """A literal map looked up without an error for unknown keys."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.upper(F.trim(key)))
    return found if default is None else F.coalesce(found, F.lit(default))


def hydrophobicity(residue: Column, scale: dict = WIMLEY_WHITE) -> Column:
    return table(scale, residue, 0.0)


def standard_pka(residue: Column) -> Column:
    return table(STANDARD_PKA, residue)


def fractional_charge(residue: Column, pka: Column, ph: float | Column) -> Column:
    """Henderson and Hasselbalch: acids lose, bases gain; 0 without a pKa or for any other residue."""
    ph = F.lit(ph) if isinstance(ph, (int, float)) else ph
    acid = -1.0 / (1.0 + F.pow(F.lit(10.0), pka - ph))
    base = 1.0 / (1.0 + F.pow(F.lit(10.0), ph - pka))
    return F.when(pka.isNull(), 0.0).when(residue.isin(*ACIDS), acid).when(residue.isin(*BASES), base).otherwise(0.0)


def charge_class(charge: Column, residue: Column) -> Column:
    """neg or pos beyond the threshold, else hyd for nonpolar residues, else null."""
    return F.when(charge < -CHARGED, "neg").when(charge > CHARGED, "pos").when(residue.isin(*NONPOLAR), "hyd")


def in_cdr(resnum: Column) -> Column:
    out = F.lit(False)
    for low, high in CDR_RANGES:
        out = out | resnum.between(low, high)
    return out


def is_hydrogen(name: Column, element: Column) -> Column:
    return F.coalesce(F.upper(F.trim(element)).isin("H", "D"), F.lit(False)) | F.upper(F.trim(name)).rlike("^[0-9]?H")


def donor_bonds(name: Column, residue: Column) -> Column:
    """Hydrogen bonds an atom can give; null for no donor (the backbone N of proline is none)."""
    out = F.when((name == "N") & (residue != "PRO"), 1)
    for (atom, res), (_, n) in DONORS.items():
        out = out.when((name == atom) & (residue == res), n)
    return out


def acceptor_bonds(name: Column, residue: Column) -> Column:
    out = F.when(name == "O", 2)
    for (atom, res), n in ACCEPTORS.items():
        out = out.when((name == atom) & (residue == res), n)
    return out
