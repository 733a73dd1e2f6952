"""Parsers and descriptors on structures made here, against direct computations."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from descra.functions import chemistry as ch
from descra.functions import scalars as sc
from descra.operators import descriptors as de
from descra.operators import residues, spatial
from descra.sources import results, sinks, structures, tables, tools
from descra.sources.structures import ATOMS
from descra.streaming import results as stream

NAMES = ["structure_id", "atom_ord", "serial", "name", "resname", "chain", "resnum", "icode", "x", "y", "z", "bfactor", "element"]


def molecule(seed=0, n=60, name="s1"):
    """Two chains of residues on a random walk, each with backbone, CB and a tip."""
    r, rows = np.random.default_rng(seed), []
    tips = {"LYS": "NZ", "ARG": "NH1", "ASP": "OD1", "GLU": "OE1", "SER": "OG", "CYS": "SG", "HIS": "ND1"}
    for chain in "HL":
        at = r.normal(size=3) * 4
        for k in range(n):
            res = sorted(ch.ONE_LETTER)[r.integers(20)]
            at = at + r.normal(size=3) * 2.2
            for a in ["N", "CA", "C", "O", "CB", *([tips[res]] if res in tips else [])]:
                x = at + r.normal(size=3) * 1.2
                rows.append((name, len(rows), len(rows) + 1, a, res, chain, 20 + k * 2, "", *[round(float(v), 3) for v in x], 0.0, a[0]))
    return rows


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame(molecule() + molecule(1, 40, "s2"), ATOMS).persist()


def surface(rows):
    """Residue areas that follow from the key."""
    out, seen = [], set()
    for s, _, _, _, res, c, n, i, *_ in rows:
        if (s, c, n) not in seen:
            seen.add((s, c, n))
            rel = (n * 7 % 100) / 100
            out.append((s, c, n, i, res, 10.0 * rel + n, rel, 5.0, 0.3))
    return out


SASA = "structure_id string, chain string, resnum int, icode string, resname string, side_abs double, side_rel double, main_abs double, main_rel double"


def pka(rows):
    keys = sorted({(r[0], r[5], r[6], r[7], r[4]) for r in rows})
    out = [(*k, ch.STANDARD_PKA[k[4]]) for k in keys if k[4] in ch.STANDARD_PKA]
    for s in {k[0] for k in keys}:
        for c in "HL":
            out += [(s, c, 20, "", "N+", 8.0), (s, c, 99, "", "C-", 3.2)]
    return out


PKA = "structure_id string, chain string, resnum int, icode string, resname string, pka double"


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))


def test_radius_join_is_brute_force(atoms):
    rows = pd.DataFrame(molecule(), columns=NAMES)
    xyz = rows[["x", "y", "z"]].to_numpy()
    d = distances(xyz, xyz)
    p = atoms.where("structure_id = 's1'").select("structure_id", "atom_ord", "x", "y", "z")
    for r in (2.0, 5.0):
        got = {(a.atom_ord, a.to_atom_ord) for a in spatial.radius_join(p, p, ["structure_id"], r).collect()}
        assert got == set(zip(*(k.tolist() for k in np.nonzero(((xyz[:, None] - xyz[None]) ** 2).sum(2) <= r * r))))
    shells = {s.shell: s.pairs for s in spatial.shell_pairs(p, ["structure_id"], "atom_ord", [(4.0, 3.0), (7.0, 3.0)]).collect()}
    upper = d[np.triu_indices(len(d), 1)]
    assert shells == {a: int(((upper >= a) & (upper < a + 3)).sum()) for a in (4.0, 7.0)}


def test_planarity_by_eigenvalues(atoms):
    p = atoms.where("structure_id = 's1'").select("structure_id", "atom_ord", "x", "y", "z")
    rows = pd.DataFrame(molecule(), columns=NAMES)
    xyz = rows[["x", "y", "z"]].to_numpy()
    near = distances(xyz, xyz) <= 6
    for r in spatial.smallest_eigenvalue_share(spatial.planarity_moments(p, ["structure_id"], "atom_ord", 6.0)).collect():
        e = np.linalg.eigvalsh(np.cov(xyz[near[r.atom_ord]].T, bias=True))
        assert r.planarity == pytest.approx(max(e[0], 0) / e.sum(), abs=1e-9)


def test_charge_map_dipole_and_sums(spark, atoms):
    library = {(r, a): q for r in [*ch.ONE_LETTER, "HIE"] for a, q in (("N", -0.4), ("C", 0.5), ("O", -0.6), ("CA", 0.1))}
    charged = tools.with_charges(atoms, tools.charge_table(spark, library))
    rows = pd.DataFrame(molecule(), columns=NAMES)
    q = np.array([library.get((r, a), 0.0) for r, a in zip(rows.resname, rows.name)])
    xyz = rows[["x", "y", "z"]].to_numpy()
    total = (distances(xyz, xyz) <= 10) @ q - q
    got = de.charge_map(charged).where("structure_id = 's1'").first()
    assert got.scm_neg_ff19sb == pytest.approx(total[total < 0].sum()) and got.scm_pos_ff19sb == pytest.approx(total[total > 0].sum())
    assert de.dipole(charged).where("structure_id = 's1'").first().dipole_moment_ff19sb == pytest.approx(np.linalg.norm((q[:, None] * (xyz - xyz.mean(0))).sum(0)))


def test_all_descriptors(spark, atoms):
    rows = molecule() + molecule(1, 40, "s2")
    sasa = spark.createDataFrame(surface(rows), SASA)
    values = spark.createDataFrame(pka(rows), PKA)
    dssp = spark.createDataFrame([("s1", "H", 20 + 2 * k, "", "A", k + 1, "H", [(2, -1.5), (-1, -0.5)] if k % 3 == 0 else []) for k in range(60)], "structure_id string, chain string, resnum int, icode string, aa string, dssp_seq int, ss string, hbonds array<struct<offset: int, energy: double>>")
    totals = spark.createDataFrame([("s1", "full", 100.0), ("s1", "H", 70.0), ("s1", "L", 60.0)], "structure_id string, part string, total double")
    library = tools.charge_table(spark, {("ALA", "N"): -0.4})
    wide = de.describe(atoms, sasa, values, dssp, totals, library, draws=20)
    assert len(wide.columns) == 60
    got = {r.structure_id: r for r in wide.collect()}
    assert set(got) == {"s1", "s2"} and got["s1"].inter_chain_buried_sasa == 30.0 and got["s2"].inter_chain_buried_sasa is None
    # The sums, directly.
    res = pd.DataFrame(surface(molecule()), columns=[c.split()[0] for c in SASA.split(", ")])
    acid, base = {"ASP", "GLU", "CYS", "TYR"}, {"ARG", "LYS", "HIS"}
    charge = lambda r, ph: 0.0 if r not in ch.STANDARD_PKA else -1 / (1 + 10 ** (ch.STANDARD_PKA[r] - ph)) if r in acid else 1 / (1 + 10 ** (ph - ch.STANDARD_PKA[r]))
    res["q"] = [charge(r, 7.5) for r in res.resname]
    flags = {"aro": res.resname.isin(ch.AROMATIC), "hyd": res.resname.isin(ch.NONPOLAR), "neg": res.q < -0.05, "pos": res.q > 0.05}
    one = got["s1"]
    for c, on in flags.items():
        assert one[f"{c}_all_sasa"] == pytest.approx(res.side_abs[on].sum())
        assert one[f"{c}_exposed_sasa"] == pytest.approx(res.side_abs[on & (res.side_rel > 0.2)].sum())
    net = lambda ph: res.resname.map(lambda r: charge(r, ph)).sum() + 2 / (1 + 10 ** (ph - 8.0)) - 2 / (1 + 10 ** (3.2 - ph))
    assert one["net_charge_by_pH_3"] == pytest.approx(net(3)) and one["net_charge_by_pH_7.5"] == pytest.approx(net(7.5)) and abs(net(one.protein_pi)) < 1e-6
    assert one.hyd_score == pytest.approx(res.resname.map(ch.WIMLEY_WHITE).sum())
    cdr = res[(res.resnum.between(27, 38)) | res.resnum.between(56, 65) | res.resnum.between(105, 117)]
    assert one.cdr3_length == int(res.resnum.between(105, 117).sum()) and one.fraction_gly_in_cdr == pytest.approx((cdr.resname == "GLY").mean())
    # Vicinity and what is summed over it.
    a = pd.DataFrame(molecule(), columns=NAMES)
    xyz, centre = a[["x", "y", "z"]].to_numpy(), (a.resnum.between(27, 38) | a.resnum.between(56, 65) | a.resnum.between(105, 117)).to_numpy()
    near = (distances(xyz, xyz[centre]) <= 5).any(1)
    vic = {(c, n) for c, n, on in zip(a.chain, a.resnum, near) if on}
    inside = pd.Series([(c, n) in vic for c, n in zip(res.chain, res.resnum)])
    assert one.aro_sasa_cdr == pytest.approx(res.side_abs[flags["aro"] & inside & (res.side_rel > 0.2)].sum())
    assert one.pos_exposure_cdr == pytest.approx(100 * res.side_rel[flags["pos"] & inside & (res.side_rel > 0.2)].sum())
    # Bond energies: both ends get the energy, weighted by main chain area in percent.
    energy = np.zeros(200)
    for k in range(0, 60, 3):
        for o, e in ((2, 1.5), (-1, 0.5)):
            energy[k + 1] += e
            energy[k + 1 + o] += e
    assert one.hbond_energy_density == pytest.approx(np.mean([30 * energy[k + 1] for k in range(60)]))
    # Contacts of the aggregation shell.
    key = list(zip(a.chain, a.resnum))
    place = {k: i for i, k in enumerate(zip(res.chain, res.resnum))}
    touch = np.zeros((len(res), len(res)), bool)
    i, j = np.nonzero(distances(xyz, xyz) <= 10)
    touch[[place[key[k]] for k in i], [place[key[k]] for k in j]] = True
    np.fill_diagonal(touch, False)
    w = res.side_rel.to_numpy() * 100
    env = {c: touch @ (w * flags[c].to_numpy()) for c in ("aro", "pos", "neg")}
    assert one.sap_aro_score == pytest.approx((w * env["aro"]).sum()) and one.sap_pos_aro_synergy == pytest.approx((w * env["pos"] * env["aro"]).sum())


def test_pdb_round_trip(spark, tmp_path):
    rows = molecule(2, 6)
    text = structures.pdb_lines(spark.createDataFrame(rows, ATOMS)).first().text
    assert all(len(line) == 80 for line in text.splitlines()) and text.count("TER") == 2
    bad = text.replace("ATOM      3", "HETATM    3").splitlines()
    bad.insert(2, bad[0][:30] + "   wrong" + bad[0][38:])
    bad.insert(3, bad[0][:16] + "B" + bad[0][17:])
    (tmp_path / "s1.pdb").write_text("\n".join(bad))
    (tmp_path / "empty.pdb").write_text("")
    got = structures.read_pdb(spark, f"file://{tmp_path}").orderBy("serial").collect()
    assert [(r.serial, r.name, r.resname, r.chain, r.resnum, r.x, r.y, r.z) for r in got] == [(r[2], r[3], r[4], r[5], r[6], *r[8:11]) for r in rows if r[2] != 3]
    assert residues.unrefined(structures.read_pdb(spark, f"file://{tmp_path}")).first().all_zero


CIF = """data_x
loop_
_other.a
_other.b
1 'x y'
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM 1 C "CA" . ALA A 1 H 112 B 1.0 2.0 3.0 1
ATOM 2 O 'O5'' . ALA A 1 H 112 ? 1.5
2.5 3.5 1
HETATM 3 C C1 . LIG A 1 H 9 ? 0 0 0 1
ATOM 4 C CA . ALA A 1 H 112 ? 9.0 9.0 9.0 2
ATOM 5 C CA B ALA A 1 H 113 ? 9.0 9.0 9.0 1
ATOM 6 C CA . ALA A 1 X 113 ? 9.0 9.0 9.0 1
#
loop_
_tail.a
1
"""


def test_cif(spark, tmp_path):
    (tmp_path / "m.cif").write_text(CIF)
    got = structures.read_structures(spark, f"file://{tmp_path}").collect()
    assert [(r.structure_id, r.serial, r.name, r.resnum, r.icode, r.x) for r in got] == [("m", 1, "CA", 112, "B", 1.0), ("m", 2, "O5'", 112, "", 1.5)]


def test_tool_outputs(spark, tmp_path):
    (tmp_path / "a.sasa").write_text("REM x\nRES ALA H  27   50.0  40.0  30.0  25.0  20.0 N/A 1 2 3 4\nRES GLY H1001   5.0  4.0  3.0  2.0  1.0 0 1 2 3 4\nRES TYR L  30A  1 2 3 4 5 6 7 8 9 10\nTOTAL 123.5 1 2\n")
    (tmp_path / "b.sasa").write_text("RES ALA H 1 1 1 1 1 1 1 1 1 1 1\n")
    res, total = tools.read_sasa(spark, f"file://{tmp_path}")
    got = {(r.structure_id, r.chain, r.resnum, r.icode): r for r in res.collect()}
    assert set(got) == {("a", "H", 27, ""), ("a", "H", 1001, ""), ("a", "L", 30, "A")} and got["a", "H", 27, ""].side_rel == 0.25 and got["a", "H", 27, ""].main_rel == 0
    assert [tuple(r) for r in total.collect()] == [("a", 123.5)] and tools.missing_totals(spark, f"file://{tmp_path}").first().key == "b"
    (tmp_path / "a.pka").write_text("junk\n RESIDUE    pKa\n ---------\nASP  27 H   3.50*  100 %\nASP  27 H   9.99\nN+   1 H  8.00\nLIG  1 H 4.0\n")
    assert {(r.resname, r.resnum, r.pka) for r in tools.read_pka(spark, f"file://{tmp_path}").collect()} == {("ASP", 27, 3.5), ("N+", 1, 8.0)}
    line = lambda seq, num, code, chain, aa, bonds: f"{seq:5d}{num:>5}{code:1}{chain:1} {aa:1}  H{'':22}{bonds}"
    (tmp_path / "a.dssp").write_text("head\n  #  RESIDUE AA STRUCTURE\n" + line(1, "27", "", "H", "A", "  0, 0.0   2,-1.5  -1,-0.5   0, 0.0") + "\n" + line(2, "27", "A", "H", "G", "  0, 0.0") + "\n" + line(3, "", "", "", "!", "") + "\n")
    got = sorted(tools.read_dssp(spark, f"file://{tmp_path}").collect(), key=lambda r: r.dssp_seq)
    assert [(r.resnum, r.icode, r.chain, r.aa, [tuple(b) for b in r.hbonds]) for r in got] == [(27, "", "H", "A", [(2, -1.5), (-1, -0.5)]), (27, "A", "H", "G", [])]
    library = tools.charge_library('!!index\n "HIE"\n!entry.HIE.unit.atoms table  str name  str type\n "N" "N" 0 1 131072 1 7 -0.4157\n "HE2" "H" 0 1 131072 2 1 0.3339\n!entry.HIE.unit.box array\n "X" "X" 0 1 1 1 1 9.0\n')
    assert library == {("HIE", "N"): -0.4157, ("HIE", "HE2"): 0.3339, ("HIS", "N"): -0.4157, ("HIS", "HE2"): 0.3339}


def test_charges_fall_back(spark):
    library = tools.charge_table(spark, {("HIP", "N"): 1.0, ("HID", "N"): 2.0, ("HIE", "N"): 3.0, ("ALA", "O"): 4.0, ("ALA", "H"): 5.0})
    his = lambda n, names: [("s", k, 1, a, "HIS", "H", n, "", 0.0, 0.0, 0.0, 0.0, "N") for k, a in enumerate(names)]
    rows = his(1, ["N", "HD1", "HE2"]) + his(2, ["N", "HD1"]) + his(3, ["N"]) + [("s", 9, 1, a, "ALA", "H", 4, "", 0.0, 0.0, 0.0, 0.0, "O") for a in ("OXT", "H2", "CB")]
    df = spark.createDataFrame(rows, ATOMS)
    got = {(r.resnum, r.name): r.charge for r in tools.with_charges(df, library).collect()}
    assert (got[1, "N"], got[2, "N"], got[3, "N"], got[4, "OXT"], got[4, "H2"], got[4, "CB"]) == (1, 2, 3, 4, 5, 0)
    assert {r.charge for r in tools.with_charges(df, library, by_protons=False).where("name = 'N'").collect()} == {3.0}


def test_residue_order_and_fragments(spark):
    keys = [(111, ""), (111, "A"), (112, "C"), (112, "B"), (112, "A"), (112, ""), (113, "")]
    rows = [("s", k, k, "CA", "ASP" if k != 3 else "GLU", "H", n, i, 0.0, 0.0, 0.0, 0.0, "C") for k, (n, i) in enumerate(reversed(keys))]
    res = residues.residues(spark.createDataFrame(rows, ATOMS)).orderBy("seq_idx")
    assert [(r.resnum, r.icode) for r in res.collect()] == keys
    assert residues.sequences(res).first().sequence == "DDDEDDD"
    assert sorted(r.fragment for r in residues.fragments(res, F.col("seq_idx") != 2).collect()) == ["DD", "EDDD"]
    assert residues.termini(res).first().n_term.resnum == 111 and residues.collisions(res).count() == 2
    assert sorted(r.new_resnum for r in residues.spare_numbers(res).collect()) == [901, 902, 903, 904]
    assert spark.createDataFrame([("DDDDE",), ("",), (None,)], "s string").select(sc.motif_count(F.col("s"), "DD")).collect()[0][0] == 3


def test_scalars(spark):
    row = spark.range(1).select(*[x.alias(n) for n, x in (("a", sc.residue_number(F.lit("-3B"))[0]), ("b", sc.residue_number(F.lit("x"))[0]), ("c", sc.insertion_code(F.lit("?"))), ("d", sc.slug(F.lit(" a b/ü "))), ("e", sc.feature_budget(F.lit(40))), ("f", sc.subsample_count(F.lit(1000))), ("g", sc.shell_volume(1.0, 1.0)), ("h", sc.finite(F.lit(float("inf")))))]).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.h) == (-3, None, "", "a_b", 6, 167, None) and row.g == pytest.approx(4 / 3 * math.pi * 7)
    assert sc.shell_name(4, 3) == "4w3A" and sc.shell_name(4.5, 1) == "4p5w1A" and len(sc.path_token("x" * 200)) == 96
    assert sc.as_bool("Yes") and sc.as_int("4") == 4 and sc.as_list("a, b,") == ["a", "b"]
    for f, bad in ((sc.as_bool, "maybe"), (sc.as_int, 1.5), (sc.as_list, 3)):
        with pytest.raises(ValueError):
            f(bad)


def test_results_and_sinks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for n in ("a", "b"):
        (tmp_path / "r" / f"{n}.json").write_text('{"name": "z", "surface": {"nonpolar_sasa": NaN, "q": 1.23456, "bins": [1]}, "general": {"by_pH": {"7.5": 2}}}')
    (tmp_path / "r" / "broken.json").write_text("{")
    wide = results.read_json(spark, f"file://{tmp_path}/r")
    assert set(wide.columns) == {"name", "surface_hyd_sasa", "surface_q", "general_by_pH_7.5"} and sorted(r.name for r in wide.collect()) == ["a", "b"]
    sinks.write_descriptors(wide, f"file://{tmp_path}/out")
    again = spark.read.json(f"file://{tmp_path}/out").orderBy("name").first()
    assert again.surface_q == 1.235 and again.surface_hyd_sasa is None
    (tmp_path / "features.csv").write_text("pdb_file,error,f\n/x/a.min.pdb,,1\n")
    assert results.read_features(spark, f"file://{tmp_path}/features.csv").first().asDict() == {"f": 1, "name": "a"}
    assert tables.source_kind(["x/features.csv"]) == "csv" and tables.source_kind(["a.json", "b.txt"]) == "json"
    with pytest.raises(ValueError):
        tables.source_kind(["a.txt"])
    before = sinks.digests(spark, f"file://{tmp_path}/r").collect()
    (tmp_path / "r" / "a.json").write_text("{}")
    assert [r.path.rsplit("/", 1)[1] for r in sinks.changed(spark.createDataFrame(before), sinks.digests(spark, f"file://{tmp_path}/r")).collect()] == ["a.json"]
    (tmp_path / "fail.tsv").write_text("dataset\tstructure\treason\nd\ts1\tx\nd\ts2\ty\n")
    assert tables.failures_by_dataset(tables.failures(spark, f"file://{tmp_path}/fail.tsv")).first().structures == ["s1", "s2"]
    log = spark.createDataFrame([(0, "START"), (1, "old"), (2, "START again"), (3, "new")], "n int, line string")
    assert [r.line for r in tables.last_session(log).collect()] == ["new"]
    digest = sinks.put_json(spark, f"file://{tmp_path}/m/x.json", {"a": 1})
    assert len(digest) == 64 and json.loads(sinks.get_text(spark, f"file://{tmp_path}/m/x.json")) == {"a": 1}


def test_stream_of_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"surface": {"q": 1.0}}')
    schema = spark.createDataFrame([], "name string, surface struct<q: double>").schema
    for n in (1, 2):
        stream.append(stream.read(spark, f"file://{tmp_path}/in", schema), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == n
        (tmp_path / "in" / "b.json").write_text('{"surface": {"q": 2.0}}')


def test_geometry_checks(spark):
    rows = [("s", k, k, a, "ALA", "H", n, "", x, 0.0, 0.0, 0.0, a[0]) for k, (a, n, x) in enumerate([("N", 1, 0.0), ("C", 1, 1.0), ("N", 2, 2.3), ("C", 2, 3.0), ("N", 3, 9.0)])]
    df = spark.createDataFrame(rows, ATOMS)
    got = {r.resnum: (round(r.length, 3), r.ok) for r in residues.peptide_bonds(df, residues.residues(df)).collect()}
    assert got == {1: (1.3, True), 2: (6.0, False)}


def test_a_structure_without_binding_loops_has_fractions_of_zero(spark):
    rows = [("s", "H", n, "", "GLY", n, 1.0, 0.5, True, False, False, False, False, False, True) for n in (1, 2, 3)]
    res = spark.createDataFrame(rows, "structure_id string, chain string, resnum int, icode string, resname string, seq_idx int, side_abs double, side_rel double, has_sasa boolean, is_aro boolean, is_neg boolean, is_pos boolean, is_hyd boolean, vic boolean, exposed boolean")
    one = de.residue_sums(res.withColumn("cdr", ch.in_cdr(F.col("resnum")))).first()
    assert one.fraction_gly_in_cdr == 0.0 and one.exposure_weighted_hyd_score_cdr == 0.0 and one.cdr3_length == 0


def test_salt_bridges_by_hand(spark):
    # A lysine's NZ and an arginine's NH1 near one aspartate; the arginine's NE, nearer to a glutamate, is no charged end.
    at = lambda i, name, resname, resnum, x: ("s", 1, i, name, resname, "H", resnum, "", float(x), 0.0, 0.0)
    atoms = spark.createDataFrame([at(1, "NZ", "LYS", 1, 0), at(2, "OD1", "ASP", 2, 3), at(3, "NH1", "ARG", 3, 6.5), at(4, "NE", "ARG", 3, 20), at(5, "OE1", "GLU", 4, 22)], "structure_id string, model int, serial int, name string, resname string, chain string, resnum int, icode string, x double, y double, z double")
    res = atoms.select("structure_id", "chain", "resnum", "icode", "resname", F.col("resname").isin("LYS", "ARG").alias("is_pos"), F.col("resname").isin("ASP", "GLU").alias("is_neg")).distinct()
    assert {(r.resnum, r.to_resnum) for r in de.salt_bridges(atoms, res).collect()} == {(1, 2), (3, 2)}


def test_more_collisions_than_spare_numbers_are_an_error(spark):
    rows = [("s", "H", 5, "" if k == 0 else f"{k}", "GLY", k) for k in range(101)]
    res = spark.createDataFrame(rows, "structure_id string, chain string, resnum int, icode string, resname string, seq_idx int")
    assert residues.spare_numbers(res.where("seq_idx < 100")).count() == 99
    with pytest.raises(Exception, match="more than 99"):
        residues.spare_numbers(res).collect()


def test_a_chain_without_a_terminal_value_is_told(spark, atoms):
    values = spark.createDataFrame(pka(molecule()), PKA).where("not (chain = 'H' and resname = 'N+')")
    got = de.missing_termini(residues.residues(atoms.where("structure_id = 's1'")), values).collect()
    assert [(r.key, r.detail, r.rule) for r in got] == [("s1", "H", "no N+")]


def test_neighbour_scores_by_brute_force(spark, atoms):
    rows = molecule()
    a = pd.DataFrame(rows, columns=NAMES)
    sasa = spark.createDataFrame(surface(rows), SASA).where("structure_id = 's1'")
    one = atoms.where("structure_id = 's1'")
    res = de.residue_table(one, sasa, spark.createDataFrame(pka(rows), PKA)).persist()
    table = res.toPandas()
    xyz, place = a[["x", "y", "z"]].to_numpy(), {k: i for i, k in enumerate(zip(table.chain, table.resnum))}
    touch = np.zeros((len(table), len(table)), bool)
    i, j = np.nonzero(distances(xyz, xyz) <= 6)
    key = list(zip(a.chain, a.resnum))
    touch[[place[key[k]] for k in i], [place[key[k]] for k in j]] = True
    np.fill_diagonal(touch, False)
    area, charge = table.side_rel.fillna(0).to_numpy(), table.charge.to_numpy()
    hyd = table.resname.map(ch.WIMLEY_WHITE).to_numpy()
    p = (touch @ (charge * area)) * area
    score = lambda *x, **k: de.neighbour_score(one, res, 6.0, *x, **k).first().score
    assert score() == pytest.approx(-p[p < 0].sum()) and score(reduce="pos_abs") == pytest.approx(p[p > 0].sum()) and score(reduce="sum") == pytest.approx(p.sum())
    p = (touch @ np.where(area > 0.2, hyd, 0)) * np.maximum(charge, 0) * area
    assert score("hydrophobicity", weighted=False, centre="positive", centre_by_area=True, reduce="sum") == pytest.approx(p.sum())
    some = np.array([any((n, r) in ch.POSITIVE_ATOMS + ch.NEGATIVE_ATOMS for n in a.name[(a.chain == c) & (a.resnum == m)]) for c, m, r in zip(table.chain, table.resnum, table.resname)])
    got = de.residue_charge_map(one, res, 6.0).first()
    p = ((touch[:, some] @ (charge * area)[some]) * area)[some]
    assert (got is None and not some.any()) or got.score == pytest.approx(-p[p < 0].sum())
    with pytest.raises(ValueError):
        score("mass")
    # Residues that a tool lacks, by chain.
    lacks = residues.missing_coverage(sasa.where("not (chain = 'H' and resnum < 30)"), res).collect()
    assert [(r.chain, r.missing, r.disjoint) for r in lacks] == [("H", int(((table.chain == "H") & (table.resnum < 30)).sum()), False)]
