"""Atoms from PDB and mmCIF files: one row an atom, keyed by structure_id (the file's stem)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from descra.functions.chemistry import ONE_LETTER
from descra.sources.results import stem

CHAINS = ("H", "L")
ATOMS = "structure_id string, atom_ord long, serial int, name string, resname string, chain string, resnum int, icode string, x double, y double, z double, bfactor double, element string"


def read_pdb(spark: SparkSession, path: str, chains: tuple[str, ...] | None = CHAINS) -> DataFrame:
    """ATOM lines of the 20 residues by fixed columns; other places than blank and A, and bad numbers, are left out."""
    lines = spark.read.option("pathGlobFilter", "*.{pdb,ent}").text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("structure_id"), F.posexplode(F.split("value", "\r?\n")).alias("atom_ord", "line"))
    field = lambda a, n: F.trim(F.substring("line", a, n))
    atoms = lines.where(F.col("line").startswith("ATOM") & (F.length("line") >= 54) & F.substring("line", 17, 1).isin(" ", "A"))
    out = atoms.select(
        "structure_id",
        F.col("atom_ord").cast("long").alias("atom_ord"),
        field(7, 5).try_cast("int").alias("serial"),
        field(13, 4).alias("name"),
        F.upper(field(18, 3)).alias("resname"),
        field(22, 1).alias("chain"),
        field(23, 4).try_cast("int").alias("resnum"),
        field(27, 1).alias("icode"),
        *[field(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))],
        F.coalesce(field(61, 6).try_cast("double"), F.lit(0.0)).alias("bfactor"),
        F.when(field(77, 2) != "", field(77, 2)).otherwise(F.substring(F.regexp_replace(field(13, 4), "^[0-9]+", ""), 1, 1)).alias("element"),
    )
    return _kept(out, chains)


def _kept(atoms: DataFrame, chains: tuple[str, ...] | None) -> DataFrame:
    good = atoms.where(F.col("resname").isin(*ONE_LETTER) & F.col("resnum").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return good.where(F.col("chain").isin(*chains)) if chains else good


_TOKEN = re.compile(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(\S+)")


def cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """Tokens of an mmCIF text and whether they were quoted; lines between semicolons are one token."""
    held = None
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if held is not None:
            if line.startswith(";"):
                yield "\n".join(held), True
                held = None
            else:
                held.append(line)
            continue
        if line.startswith(";"):
            held = [line[1:]]
            continue
        for m in _TOKEN.finditer(line):
            if m[3] is None:
                yield m[1] if m[1] is not None else m[2], True
            elif m[3].startswith("#"):
                break
            else:
                yield m[3], False


def cif_atoms(text: str) -> list[dict]:
    """Rows of the first loop over _atom_site: names without that prefix, values as text ('' for . and ?)."""
    names, rows, row, state = [], [], [], ""
    for token, quoted in cif_tokens(text):
        if not quoted and token == "loop_":
            if rows:
                break
            names, row, state = [], [], "names"
        elif not quoted and token.startswith("_"):
            if state == "names":
                names.append(token)
            elif rows:
                break
            else:
                state = ""
        elif state in ("names", "rows") and names and all(n.startswith("_atom_site.") for n in names):
            state = "rows"
            row.append("" if not quoted and token in (".", "?") else token)
            if len(row) == len(names):
                rows.append(dict(zip((n.removeprefix("_atom_site.") for n in names), row)))
                row = []
        else:
            state = "other" if state != "" else ""
    return rows


def read_cif(spark: SparkSession, path: str, chains: tuple[str, ...] | None = CHAINS) -> DataFrame:
    """As read_pdb, from mmCIF: the author's names are preferred and the first model only is read."""
    import pandas as pd

    files = spark.read.option("pathGlobFilter", "*.{cif,mmcif}").text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("structure_id"), "value")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame.structure_id, frame.value):
                out, model = [], None
                for i, a in enumerate(cif_atoms(text)):
                    own = lambda k, a=a: a.get(f"auth_{k}") or a.get(f"label_{k}") or ""
                    here = a.get("pdbx_PDB_model_num", "")
                    model = model or here
                    if a.get("group_PDB") != "ATOM" or here != model or a.get("label_alt_id", "") not in ("", "A"):
                        continue
                    number = re.fullmatch(r"(-?\d+)([A-Za-z]?)", own("seq_id"))
                    try:
                        xyz = [float(a[f"Cartn_{c}"]) for c in "xyz"]
                        b, serial = float(a.get("B_iso_or_equiv") or 0), int(a.get("id") or 0)
                    except (KeyError, ValueError):
                        continue
                    if number:
                        atom = own("atom_id")
                        out.append((name, i, serial, atom, own("comp_id").upper(), own("asym_id"), int(number[1]), a.get("pdbx_PDB_ins_code") or number[2], *xyz, b, a.get("type_symbol") or atom[:1]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ATOMS.split(", ")])

    return _kept(files.mapInPandas(parse, ATOMS), chains)


def read_structures(spark: SparkSession, path: str, chains: tuple[str, ...] | None = CHAINS) -> DataFrame:
    """Both kinds, told apart by their extension."""
    return read_pdb(spark, path, chains).unionByName(read_cif(spark, path, chains))


def is_structure_stem(name):
    """False for the parts and by-products that tools leave beside a structure."""
    return ~name.rlike(r"(_H|_L|_H_chain|_L_chain|_full_atom_sasa)$")


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """structure_id, text: the atoms as 80-column lines with TER after each chain, occupancy 1.00 and B 0.00."""
    name = F.when((F.length("name") < 4) & (F.length("element") < 2), F.concat(F.lit(" "), F.rpad("name", 3, " "))).otherwise(F.rpad("name", 4, " "))
    line = F.format_string("ATOM  %5d %s %3s %1s%4d%1s   %8.3f%8.3f%8.3f  1.00  0.00          %2s  ", F.col("serial"), name, F.col("resname"), F.col("chain"), F.col("resnum"), F.when(F.col("icode") == "", " ").otherwise(F.col("icode")), "x", "y", "z", F.col("element"))
    chain = atoms.select("structure_id", "chain", "atom_ord", line.alias("line")).groupBy("structure_id", "chain").agg(F.min("atom_ord").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atom_ord", "line"))), lambda a: a["line"]), "\n").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda c: F.concat(c["text"], F.lit("\n"), F.rpad(F.lit("TER"), 80, " "))), "\n")
    return chain.groupBy("structure_id").agg(F.concat(whole, F.lit("\n"), F.rpad(F.lit("END"), 80, " "), F.lit("\n")).alias("text"))


def ca(atoms: DataFrame) -> DataFrame:
    """The first CA of each residue."""
    keys = ["structure_id", "chain", "resnum", "icode", "resname"]
    return atoms.where(F.col("name") == "CA").groupBy(*keys).agg(F.min_by(F.struct("x", "y", "z"), "atom_ord").alias("_")).select(*keys, "_.*")



