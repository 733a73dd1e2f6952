"""The wide row of descriptors of each structure, from atoms and per-residue tables.

Sums over residues and atoms are joins and groupings; only clustering, hydrogen
bonds, random surfaces and the isoelectric point run as kernels, grouped by
structure_id, a group being one molecule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descra.functions import chemistry as ch
from descra.functions.scalars import motif_count, shell_name
from descra.operators import clusters, joins, residues, spatial
from descra.operators.residues import KEY
from descra.sources.structures import ca

ID = "structure_id"
CLASSES = ("aro", "neg", "pos", "hyd")


def heavy(atoms: DataFrame) -> DataFrame:
    return atoms.where(~ch.is_hydrogen(F.col("name"), F.col("element")))


def disulfides(atoms: DataFrame, most: float = 2.5) -> DataFrame:
    """Cysteines whose sulfur has another within reach."""
    s = atoms.where("resname = 'CYS' and name = 'SG'").select(*KEY, "x", "y", "z")
    return spatial.radius_join(s, s, [ID], most).where("chain <> to_chain or resnum <> to_resnum or icode <> to_icode").select(*KEY).distinct()


def complete_pka(atoms: DataFrame, res: DataFrame, pka: DataFrame) -> DataFrame:
    """pka with the standard value for the side chain of a terminal residue whose chain has the terminus but not the side chain."""
    ends = residues.termini(res)
    wanted = None
    for end, mark in (("n_term", "N+"), ("c_term", "C-")):
        has = pka.where(F.col("resname") == mark).select(ID, "chain").distinct()
        part = ends.select(ID, "chain", f"{end}.*").join(has, [ID, "chain"], "left_semi")
        wanted = part if wanted is None else wanted.unionByName(part)
    free = wanted.where(F.col("resname").isin(*ch.STANDARD_PKA)).distinct().join(disulfides(atoms), KEY, "left_anti").join(pka.select(*KEY), KEY, "left_anti")
    return pka.select(*KEY, "pka").unionByName(free.select(*KEY, ch.standard_pka(F.col("resname")).alias("pka")))


def net_charges(pka: DataFrame, phs: dict[str, float]) -> DataFrame:
    charge = lambda ph, on=F.lit(True): F.sum(F.when(on, ch.fractional_charge(F.col("resname"), F.col("pka"), ph)).otherwise(0.0))
    sides = {c: charge(7.5, F.col("chain") == c) for c in ("H", "L")}
    return pka.groupBy(ID).agg(*[charge(v).alias(n) for n, v in phs.items()], (sides["H"] * sides["L"]).alias("charge_symmetry"))


def isoelectric(pka: DataFrame) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame.resname.isin(ch.ACIDS + ch.BASES)]
        pi = clusters.isoelectric_point(own.pka.to_numpy(float), own.resname.isin(ch.ACIDS).to_numpy())
        return pd.DataFrame({ID: [frame[ID].iloc[0]], "protein_pi": [np.nan if pi is None else pi]})

    return pka.groupBy(ID).applyInPandas(run, f"{ID} string, protein_pi double").withColumn("protein_pi", F.nanvl("protein_pi", F.lit(None).cast("double")))


def missing_termini(res: DataFrame, pka: DataFrame) -> DataFrame:
    """Violations: chains without a terminal pKa."""
    chains = res.select(ID, "chain").distinct()
    out = None
    for mark in ("N+", "C-"):
        gone = chains.join(pka.where(F.col("resname") == mark).select(ID, "chain"), [ID, "chain"], "left_anti")
        part = gone.select(F.lit(f"no {mark}").alias("rule"), F.col(ID).alias("key"), F.col("chain").alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def dipole(charged: DataFrame) -> DataFrame:
    """Length of the dipole moment about the unweighted centre."""
    centre = charged.groupBy(ID).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"], *[F.sum(F.col("charge") * F.col(c)).alias(f"q{c}") for c in "xyz"], F.sum("charge").alias("q"))
    return centre.select(ID, F.sqrt(sum((F.col(f"q{c}") - F.col("q") * F.col(f"c{c}")) ** 2 for c in "xyz")).alias("dipole_moment_ff19sb"))


def charge_map(charged: DataFrame, radius: float = 10.0) -> DataFrame:
    total = spatial.neighbour_sums(charged.select(ID, "atom_ord", "x", "y", "z", "charge"), [ID], "atom_ord", radius, "charge")
    return total.groupBy(ID).agg(F.sum(F.least(F.col("total"), F.lit(0.0))).alias("scm_neg_ff19sb"), F.sum(F.greatest(F.col("total"), F.lit(0.0))).alias("scm_pos_ff19sb"))


def contacts(atoms: DataFrame, radius: float) -> DataFrame:
    """Distinct pairs of residues with heavy atoms within the radius, both ways, self left out."""
    p = heavy(atoms).select(*KEY, "x", "y", "z")
    pairs = spatial.radius_join(p, p, [ID], radius).select(*KEY, *[f"to_{k}" for k in KEY[1:]]).distinct()
    return pairs.where(" or ".join(f"{k} <> to_{k}" for k in KEY[1:]))


def aggregation_shell(atoms: DataFrame, res: DataFrame, radius: float = 10.0) -> DataFrame:
    """Sums of relative side area of aromatic residues, alone and weighted by what surrounds a residue."""
    weight = res.select(*KEY, F.coalesce("side_rel", F.lit(0.0)).alias("w"), "is_aro", "is_pos", "is_neg")
    to = weight.select(ID, *[F.col(c).alias(f"to_{c}") for c in weight.columns if c != ID])
    near = contacts(atoms, radius).join(to, [ID, *[f"to_{k}" for k in KEY[1:]]])
    env = near.groupBy(*KEY).agg(*[F.sum(F.when(F.col(f"to_is_{c}"), F.col("to_w") * 100).otherwise(0.0)).alias(c) for c in ("aro", "pos", "neg")])
    own = weight.join(env, KEY, "left").na.fill(0.0, ["aro", "pos", "neg"])
    w = F.col("w") * 100
    return own.groupBy(ID).agg(F.sum(w * F.col("aro")).alias("sap_aro_score"), F.sum(w * F.col("pos") * F.col("aro")).alias("sap_pos_aro_synergy"), F.sum(w * F.col("aro") * F.col("neg")).alias("sap_aro_neg_synergy"))


def neighbour_score(
    atoms: DataFrame, res: DataFrame, radius: float, source: str = "charge", *, weighted: bool = True, exposed: float = ch.EXPOSED, ionizable: bool = False, centre: str = "area", centre_by_area: bool = False, reduce: str = "neg_abs"
) -> DataFrame:
    """structure_id, score: what the residues within reach of each residue bring, times what the residue is.

    source: charge, positive, negative, hydrophobicity or one; ``weighted`` by relative side area, else of exposed
    residues only.  centre: area, charge, positive, negative, hydrophobicity or one, ``centre_by_area`` times the area.
    ``ionizable``: only residues that have a charged end.  reduce: neg_abs (size of the sum of negative products),
    pos_abs (sum of positive ones) or sum.  A structure without any such residue has no row.
    """
    kinds = {"charge": F.col("charge"), "positive": F.greatest("charge", F.lit(0.0)), "negative": F.least("charge", F.lit(0.0)), "hydrophobicity": ch.hydrophobicity(F.col("resname")), "one": F.lit(1.0), "area": F.col("area")}
    reducers = {"neg_abs": F.abs(F.sum(F.least("p", F.lit(0.0)))), "pos_abs": F.sum(F.greatest("p", F.lit(0.0))), "sum": F.sum("p")}
    if source not in kinds or source == "area" or centre not in kinds or reduce not in reducers:
        raise ValueError(f"unknown source, centre or reduce: {source}, {centre}, {reduce}")
    own = res.select(*KEY, "charge", F.coalesce("side_rel", F.lit(0.0)).alias("area"))
    if ionizable:
        ends = F.concat_ws(" ", "name", "resname").isin(*[" ".join(x) for x in ch.POSITIVE_ATOMS + ch.NEGATIVE_ATOMS])
        own = own.join(atoms.where(ends).select(*KEY).distinct(), KEY, "left_semi")
    brings = kinds[source] * F.col("area") if weighted else F.when(F.col("area") > exposed, kinds[source])
    is_ = kinds[centre] * (F.col("area") if centre_by_area else F.lit(1.0))
    own = own.select(*KEY, brings.alias("brings"), is_.alias("is"))
    to = own.select(ID, *[F.col(k).alias(f"to_{k}") for k in KEY[1:]], "brings")
    around = contacts(atoms, radius).join(to, [ID, *[f"to_{k}" for k in KEY[1:]]]).groupBy(*KEY).agg(F.sum("brings").alias("around"))
    return own.join(around, KEY, "left").withColumn("p", F.coalesce("around", F.lit(0.0)) * F.col("is")).groupBy(ID).agg(reducers[reduce].alias("score"))


def residue_charge_map(atoms: DataFrame, res: DataFrame, radius: float = 10.0, reduce: str = "neg_abs") -> DataFrame:
    """structure_id, score: the spatial charge map over residues with a charged end, charges from pKa values."""
    return neighbour_score(atoms, res, radius, "charge", ionizable=True, centre="area", reduce=reduce)


def salt_bridges(atoms: DataFrame, res: DataFrame) -> DataFrame:
    """Pairs (positive, negative residue) with charged atoms in reach."""
    own = atoms.join(res.select(*KEY, "is_pos", "is_neg"), KEY)
    side = lambda some: F.concat_ws(" ", "name", "resname").isin(*[" ".join(x) for x in some])
    pos, neg = own.where(F.col("is_pos") & side(ch.POSITIVE_ATOMS)), own.where(F.col("is_neg") & side(ch.NEGATIVE_ATOMS))
    pairs = spatial.radius_join(pos.select(*KEY, "x", "y", "z"), neg.select(*KEY, "x", "y", "z"), [ID], ch.SALT_BRIDGE)
    return pairs.select(*KEY, *[f"to_{k}" for k in KEY[1:]]).distinct()


def planarity(atoms: DataFrame, radius: float = 8.0) -> DataFrame:
    """Mean flatness of the heavy atoms around a residue's heavy atoms."""
    p = heavy(atoms).select(ID, "atom_ord", "x", "y", "z")
    flat = spatial.smallest_eigenvalue_share(spatial.planarity_moments(p, [ID], "atom_ord", radius)).select(ID, "atom_ord", "planarity")
    return heavy(atoms).join(flat, [ID, "atom_ord"]).groupBy(*KEY).agg(F.avg("planarity").alias("planarity"))


def hydrogen_bond_weights(atoms: DataFrame, res: DataFrame) -> DataFrame:
    """Each residue's summed area weights of its hydrogen bonds (side or main chain area by the atom)."""
    own = heavy(atoms).join(res.select(*KEY, "seq_idx", "side_rel", "main_rel"), KEY).withColumns({"gives": ch.donor_bonds(F.col("name"), F.col("resname")), "takes": ch.acceptor_bonds(F.col("name"), F.col("resname"))})
    base = {f"{a}|{r}": b for (a, r), (b, _) in ch.DONORS.items()}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("atom_ord", kind="stable")
        place = {(c, n, i, r, a): (x, y, z) for c, n, i, r, a, x, y, z in zip(frame.chain, frame.resnum, frame.icode, frame.resname, frame.name, frame.x, frame.y, frame.z)}
        carbon = {(c, s): place.get((c, n, i, r, "C")) for c, s, n, i, r in zip(frame.chain, frame.seq_idx, frame.resnum, frame.icode, frame.resname)}
        items = []
        for r in frame.itertuples(index=False):
            key = (r.chain, r.resnum, r.icode, r.resname)
            above = carbon.get((r.chain, r.seq_idx - 1)) if r.name == "N" else place.get((*key, base.get(f"{r.name}|{r.resname}", "")))
            back = r.name in ("N", "O", "C", "CA", "OXT")
            rel = r.main_rel if back else r.side_rel
            items.append({"xyz": (r.x, r.y, r.z), "base": above, "residue": key, "chain": r.chain, "seq_idx": r.seq_idx, "backbone": back, "weight": 0.0 if pd.isna(rel) else 100 * rel, "gives": r.gives, "takes": r.takes})
        donors = [x | {"capacity": int(x["gives"])} for x in items if not pd.isna(x["gives"])]
        acceptors = [x | {"capacity": int(x["takes"])} for x in items if not pd.isna(x["takes"])]
        total: dict[tuple, float] = {}
        for i, j in clusters.hydrogen_bonds(donors, acceptors):
            for end in (donors[i], acceptors[j]):
                total[end["residue"]] = total.get(end["residue"], 0.0) + end["weight"]
        return pd.DataFrame([(frame[ID].iloc[0], *k, v) for k, v in total.items()], columns=[*KEY, "hbond"])

    polar = own.where("gives is not null or takes is not null or name in ('C', 'CD', 'CG', 'CZ', 'CE', 'CD2', 'CB', 'CD1')")
    return polar.select(*KEY, "atom_ord", "name", "x", "y", "z", "seq_idx", "side_rel", "main_rel", "gives", "takes").groupBy(ID).applyInPandas(run, f"{ID} string, chain string, resnum int, icode string, resname string, hbond double")


def backbone_energy(dssp: DataFrame, res: DataFrame) -> DataFrame:
    """Mean over aligned residues of main chain area times absolute bond energy, both ends counted."""
    rows = dssp.join(res.select(*KEY, F.coalesce("main_rel", F.lit(0.0)).alias("w")), [ID, "chain", "resnum", "icode"]).select(ID, "chain", "resnum", "icode", "dssp_seq", "w", "hbonds")
    each = rows.withColumn("b", F.explode("hbonds")).select(ID, "dssp_seq", (F.col("dssp_seq") + F.col("b.offset")).alias("to"), F.abs("b.energy").alias("e"))
    ends = each.select(ID, "dssp_seq", "e").unionByName(each.select(ID, F.col("to").alias("dssp_seq"), "e"))
    total = ends.groupBy(ID, "dssp_seq").agg(F.sum("e").alias("e"))
    return rows.select(ID, "dssp_seq", "w").join(total, [ID, "dssp_seq"], "left").groupBy(ID).agg(F.avg(F.col("w") * 100 * F.coalesce("e", F.lit(0.0))).alias("hbond_energy_density"))


def surface_correlation(points: DataFrame, draws: int = ch.NULL_DRAWS) -> DataFrame:
    """Enrichment of pairs of each class at each shell among exposed CA atoms; points has x, y, z, class and seq order."""
    names = [f"pcf_{c}_{shell_name(*s)}" for c in ("neg", "pos", "hyd") for s in ch.SHELLS]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["chain", "seq_idx"], kind="stable")
        xyz = frame[["x", "y", "z"]].to_numpy(float)
        score = clusters.surface_enrichment(xyz, {c: np.flatnonzero((frame["class"] == c).to_numpy()) for c in ("neg", "pos", "hyd")}, draws=draws)
        return pd.DataFrame([[frame[ID].iloc[0], *[score[c, k] for c in ("neg", "pos", "hyd") for k in range(len(ch.SHELLS))]]], columns=[ID, *names])

    return points.groupBy(ID).applyInPandas(run, f"{ID} string, " + ", ".join(f"{n} double" for n in names))


def residue_table(atoms: DataFrame, sasa: DataFrame, pka: DataFrame, ph: float = 7.5) -> DataFrame:
    """A row a residue with areas, charge, class flags, region, vicinity of the binding loops, exposure."""
    res = residues.residues(atoms)
    near = spatial.vicinity(heavy(atoms).select(*KEY, "x", "y", "z"), [ID], KEY[1:], ch.in_cdr(F.col("resnum")), ch.VICINITY).withColumn("_near", F.lit(True))
    areas = [c for c in sasa.columns if c not in KEY]
    # Tools may leave an insertion code out: its residue then has the values of the plain number.
    area = joins.or_without_code(res, sasa.select(*KEY, *areas, F.lit(True).alias("has_sasa")), KEY, "icode")
    out = joins.or_without_code(area, complete_pka(atoms, res, pka).where(~F.col("resname").isin("N+", "C-")), KEY, "icode").join(near, KEY, "left")
    charge = ch.fractional_charge(F.col("resname"), F.col("pka"), ph)
    return out.withColumns({"charge": charge, "cdr": ch.in_cdr(F.col("resnum")), "vic": F.coalesce("_near", F.lit(False)), "exposed": F.coalesce(F.col("side_rel") > ch.EXPOSED, F.lit(False)), "has_sasa": F.coalesce("has_sasa", F.lit(False))}).withColumns(
        {"is_aro": F.col("resname").isin(*ch.AROMATIC), "is_neg": F.col("charge") < -ch.CHARGED, "is_pos": F.col("charge") > ch.CHARGED, "is_hyd": F.col("resname").isin(*ch.NONPOLAR), "class": ch.charge_class(F.col("charge"), F.col("resname"))}
    ).drop("_near")


def residue_sums(res: DataFrame) -> DataFrame:
    """Every descriptor that is one sum, count or mean over the residue table, in one grouping."""
    area, rel = F.coalesce("side_abs", F.lit(0.0)), F.coalesce("side_rel", F.lit(0.0)) * 100
    total = lambda value, *on: F.coalesce(F.sum(F.when(_all(on), value)), F.lit(0.0))
    # A structure without residues in the binding loops has fractions and a mean of 0.
    share = lambda *on: F.coalesce(F.try_divide(F.count_if(_all((F.col("cdr"), *on))), F.count_if(F.col("cdr"))), F.lit(0.0))
    is_ = lambda c: F.col(f"is_{c}")
    out = [total(area, is_(c), F.col("exposed")).alias(f"{c}_exposed_sasa") for c in CLASSES] + [total(area, is_(c)).alias(f"{c}_all_sasa") for c in CLASSES]
    out += [total(area, is_(c), F.col("exposed"), F.col("vic")).alias(f"{c}_sasa_cdr") for c in ("aro", "neg", "pos")]
    out += [total(rel, is_(c), F.col("exposed"), F.col("vic")).alias(f"{c}_exposure_cdr") for c in CLASSES]
    out += [
        F.coalesce(F.avg(F.when(F.col("vic") & F.col("has_sasa"), ch.hydrophobicity(F.col("resname")) * F.coalesce("side_rel", F.lit(0.0)))), F.lit(0.0)).alias("exposure_weighted_hyd_score_cdr"),
        total(ch.hydrophobicity(F.col("resname")), F.col("has_sasa")).alias("hyd_score"),
        F.count_if(F.col("resnum").between(*ch.CDR_RANGES[2])).alias("cdr3_length"),
        share(F.col("resname") == "GLY").alias("fraction_gly_in_cdr"),
        share(F.col("resname") == "PRO").alias("fraction_pro_in_cdr"),
        *[share(is_(c)).alias(f"fraction_{c}_in_cdr") for c in ("aro", "pos", "neg")],
        share(F.col("resname").isin("GLN", "ASN")).alias("fraction_gln_asn_in_cdr"),
    ]
    return res.groupBy(ID).agg(*out)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def patch_sums(res: DataFrame, points: DataFrame) -> DataFrame:
    """Area and entropy of clusters of each class, over all CA atoms and over those near the binding loops."""
    own = points.join(res.select(*KEY, "seq_idx", "is_neg", "is_pos", "is_hyd", "vic", F.coalesce("side_abs", F.lit(0.0)).alias("area")), KEY).withColumn("place", F.concat_ws(":", "chain", F.lpad(F.col("seq_idx").cast("string"), 8, "0")))
    out = None
    for c, (radius, least) in ch.CLUSTERING.items():
        for suffix, on in (("", F.lit(True)), ("_cdr", F.col("vic"))):
            some = own.where(F.col(f"is_{c}") & on).select(ID, "place", "x", "y", "z", "area")
            found = clusters.patches(clusters.cluster(some, [ID], radius, least, "place"), [ID], "area").select(ID, F.col("total").alias(f"{c}_patch{suffix}"), *([F.col("entropy").alias(f"{c}_cluster_entropy")] if not suffix and c != "hyd" else []))
            out = found if out is None else out.join(found, ID, "full")
    return out


def motifs(res: DataFrame) -> DataFrame:
    pieces = residues.fragments(res, F.col("vic"))
    return pieces.groupBy(ID).agg(*[F.sum(motif_count(F.col("fragment"), m)).cast("long").alias(f"count_{n}_cdr") for m, n in (("DD", "AspAsp"), ("DE", "AspGlu"), ("YY", "TyrTyr"))])


def buried_area(totals: DataFrame) -> DataFrame:
    """Area that the two chains lose together; totals has structure_id, part (full, H, L), total."""
    part = lambda p: F.sum(F.when(F.col("part") == p, F.col("total")))
    return totals.groupBy(ID).agg((part("H") + part("L") - part("full")).alias("inter_chain_buried_sasa"))


def describe(atoms: DataFrame, sasa: DataFrame, pka: DataFrame, dssp: DataFrame, totals: DataFrame, library: DataFrame, draws: int = ch.NULL_DRAWS) -> DataFrame:
    """structure_id and the 59 descriptors."""
    from descra.sources.tools import with_charges

    res = residue_table(atoms, sasa, pka).persist()
    carbons = ca(atoms)
    flat = planarity(atoms).join(res, KEY).where("exposed and vic")
    mean = F.avg("planarity")
    planar = flat.groupBy(ID).agg(*[F.when(mean > 1e-18, F.coalesce(F.sum(F.when(F.col(f"is_{c}"), F.col("planarity"))), F.lit(0.0)) / mean).otherwise(0.0).alias(f"{c}_planarity_cdr") for c in CLASSES])
    bonds = res.where("vic").select(*KEY).join(hydrogen_bond_weights(atoms, res), KEY, "left").groupBy(ID).agg((F.sum(F.coalesce("hbond", F.lit(0.0))) / F.count("*")).alias("hbond_density_cdr"))
    surface = surface_correlation(carbons.join(res.where("exposed").select(*KEY, "seq_idx", "class"), KEY), draws)
    bridges = salt_bridges(atoms, res).groupBy(ID).agg(F.count("*").alias("number_of_salt_bridges"))
    full_pka = complete_pka(atoms, residues.residues(atoms), pka)
    parts = [
        residue_sums(res),
        patch_sums(res, carbons),
        planar,
        bonds,
        charge_map(with_charges(atoms, library, by_protons=False)),
        dipole(with_charges(atoms, library)),
        aggregation_shell(atoms, res),
        backbone_energy(dssp, res),
        buried_area(totals),
        net_charges(full_pka, {"net_charge_by_pH_3": 3.0, "net_charge_by_pH_7.5": 7.5}),
        isoelectric(full_pka),
        bridges,
        motifs(res),
        surface,
    ]
    out = atoms.select(ID).distinct()
    for p in parts:
        out = out.join(p, ID, "left")
    zero = [c for c in out.columns if c.startswith(("pcf_", "count_", "number_of")) or "patch" in c or "entropy" in c or "planarity" in c]
    return out.na.fill(0, zero)
