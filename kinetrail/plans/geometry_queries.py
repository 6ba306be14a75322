"""Registered queries of the featurizers, and the SQL that says the same.

The first 63 numbers of an embedding are read as 21 atoms: five residues of N, CA, C
and CB, and a ligand of one atom. Columns are ``f0``, ``f1`` and so on, rounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinetrail.functions import geometry
from kinetrail.operators import featurizers as fz
from kinetrail.plans import views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

RESIDUES = 5
TOP = fz.Topology(
    tuple(fz.Atom(a, a[0], r) for r in range(RESIDUES) for a in ("N", "CA", "C", "CB")) + (fz.Atom("C1", "C", RESIDUES, "LIG", 1),),
    tuple((4 * r + i, 4 * r + j) for r in range(RESIDUES) for i, j in ((0, 1), (1, 2), (1, 3))) + tuple((4 * r + 2, 4 * r + 4) for r in range(RESIDUES - 1)),
)
#: A frame to superpose on, from a rule.
REFERENCE = np.array([[((i * 37 + j * 17) % 23 - 11) / 40.0 for j in range(3)] for i in range(21)])

# --- SQL expressions over ``x``, the list of numbers ---


def _at(atom: int) -> list[str]:
    return [f"x[{3 * atom + c + 1}]" for c in range(3)]


def _minus(a: int, b: int) -> list[str]:
    return [f"({p} - {q})" for p, q in zip(_at(a), _at(b))]


def _dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(u, v)) + ")"


def _cross(u: list[str], v: list[str]) -> list[str]:
    return [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _dist(a: int, b: int) -> str:
    d = _minus(a, b)
    return f"sqrt({_dot(d, d)})"


def _torsion(a: int, b: int, c: int, d: int) -> str:
    u, v, w = _minus(b, a), _minus(c, b), _minus(d, c)
    return f"atan2(sqrt({_dot(v, v)}) * {_dot(u, _cross(v, w))}, {_dot(_cross(u, v), _cross(v, w))})"


def _cosine(a: int, b: int, c: int) -> str:
    u, v = _minus(a, b), _minus(c, b)
    return f"({_dot(u, v)} / sqrt({_dot(u, u)} * {_dot(v, v)}))"


def _closest(a: int, b: int) -> str:
    return "least(" + ", ".join(_dist(i, j) for i in TOP.of_residue(a) for j in TOP.of_residue(b)) + ")"


def _reciprocal(atom: int) -> list[str]:
    bonded = {j for b in TOP.bonds if atom in b for j in b}
    r = [f"1 / {_dist(atom, j)}" for j in range(21) if j != atom and j not in bonded]
    numbers = "[" + ", ".join(r) + "]"
    m = f"list_avg({numbers})"
    moment = lambda k: f"list_avg(list_transform({numbers}, lambda r: pow(r - {m}, {k})))"
    return [m, f"sqrt({moment(2)})", f"sign({moment(3)}) * pow(abs({moment(3)}), 1.0 / 3)"]


def _add(name: str, featurizer: fz.Featurizer, columns: list[str], digits: int = 6) -> None:
    sql = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS f{i}" for i, c in enumerate(columns))
    ORACLE[name] = f"WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, {sql} FROM a"

    def run(s, d):
        atoms = F.array(*(F.slice("features", 3 * i + 1, 3) for i in range(21)))
        out = featurizer.transform(views.vectors(s, d).withColumn("xyz", atoms), "made")
        return out.select("vec_id", "made").select("vec_id", *(F.round(F.col("made")[i], digits).alias(f"f{i}") for i in range(len(columns))))

    QUERIES[name] = run


def _contacts() -> list[tuple[int, int]]:
    return [(a, b) for a in range(RESIDUES) for b in range(a + 3, RESIDUES)]


_phi, _psi = TOP.torsions("phi").tolist(), TOP.torsions("psi").tolist()
_alphas = TOP.backbone([("CA", -1), ("CA", 0), ("CA", 1), ("CA", 2)]).tolist()
_pairs = [(0, 20), (3, 17), (8, 9)]
_ligand = [(r, RESIDUES) for r in range(RESIDUES)]

_add("feat_dihedral", fz.DihedralFeaturizer(TOP), [f"{t}({_torsion(*q)})" for k in (_phi, _psi) for t in ("sin", "cos") for q in k])
_add("feat_von_mises", fz.VonMisesFeaturizer(TOP, ["phi"], 4, 2.0), [f"exp(2.0 * cos({_torsion(*q)} - {c!r})) / {2 * np.pi * float(np.i0(2.0))!r}" for c in np.linspace(0, 2 * np.pi, 4).tolist() for q in _phi])
_add("feat_alpha_angle", fz.AlphaAngleFeaturizer(TOP), [f"{t}({_torsion(*q)})" for t in ("cos", "sin") for q in _alphas])
_add("feat_kappa_angle", fz.KappaAngleFeaturizer(TOP), [_cosine(*q) for q in TOP.backbone([("CA", -2), ("CA", 0), ("CA", 2)]).tolist()])
_add("feat_angle", fz.AngleFeaturizer([(0, 1, 2), (5, 9, 20)], False), [f"acos({_cosine(*q)})" for q in ((0, 1, 2), (5, 9, 20))])
_add("feat_contact", fz.ContactFeaturizer(TOP), [_closest(*c) for c in _contacts()])
_add("feat_contact_ca", fz.ContactFeaturizer(TOP, scheme="ca"), [_dist(4 * a + 1, 4 * b + 1) for a, b in _contacts()])
_add("feat_contact_soft", fz.ContactFeaturizer(TOP, [(0, 4)], soft_min=True, soft_min_beta=0.5), ["0.5 / ln(" + " + ".join(f"exp(0.5 / {_dist(i, j)})" for i in range(4) for j in range(16, 20)) + ")"])
_add("feat_binary_contact", fz.BinaryContactFeaturizer(TOP, cutoff=0.3), [f"CASE WHEN {_closest(*c)} < 0.3 THEN 1 ELSE 0 END" for c in _contacts()])
_add("feat_logistic_contact", fz.LogisticContactFeaturizer(TOP, center=0.3, steepness=5.0), [f"1 / (1 + exp(5.0 * ({_closest(*c)} - 0.3)))" for c in _contacts()])
_add("feat_ligand_contact", fz.LigandContactFeaturizer(TOP), [_closest(*c) for c in _ligand])
_add("feat_binary_ligand_contact", fz.BinaryLigandContactFeaturizer(TOP, cutoff=0.3), [f"CASE WHEN {_closest(*c)} < 0.3 THEN 1 ELSE 0 END" for c in _ligand])
_add("feat_common_contact", fz.CommonContactFeaturizer({"a": "AAAAA", "b": "AAA-A"}, "a", TOP), [_closest(0, 4), _closest(1, 4)])
_add("feat_gaussian_solvent", fz.GaussianSolventFeaturizer([0, 5], [16, 18, 20], 0.4), [" + ".join(f"exp(-pow({_dist(a, b)}, 2) / 0.32)" for b in (16, 18, 20)) for a in (0, 5)])
_add("feat_raw_positions", fz.RawPositionsFeaturizer([2, 20]), _at(2) + _at(20))
_add("feat_drid", fz.DRIDFeaturizer(TOP, [1, 20]), _reciprocal(1) + _reciprocal(20), 5)
_add("feat_function", fz.FunctionFeaturizer(lambda x, k: x[:, :, 0].sum(1) * k, {"k": 2.0}), ["2 * (" + " + ".join(_at(i)[0] for i in range(21)) + ")"])
_add("feat_selector", fz.FeatureSelector([("pairs", fz.AtomPairsFeaturizer(_pairs, exponent=2)), ("all", fz.RawPositionsFeaturizer()), ("cos", fz.subset_cos_phi(TOP))], ["pairs", "cos"]), [f"pow({_dist(*p)}, 2)" for p in _pairs] + [f"cos({_torsion(*q)})" for q in _phi])
_add("feat_slicer", fz.FeatureSlicer(fz.DihedralFeaturizer(TOP, "psi", False), [2, 0]), [_torsion(*_psi[2]), _torsion(*_psi[0])])
_add("feat_subset_atom_pairs", fz.subset_atom_pairs(_pairs, [2, 0]), [_dist(*_pairs[2]), _dist(*_pairs[0])])
for _kind, _quads in (("phi", _phi), ("psi", _psi)):
    for _form in ("sin", "cos"):
        _add(f"feat_subset_{_form}_{_kind}", fz.SubsetTrigFeaturizer(TOP, _kind, _form, [1, 3]), [f"{_form}({_torsion(*_quads[i])})" for i in (1, 3)])

# two points superposed lie half the difference of their distances off, each
_two = [f"abs({_dist(0, 20)} - {float(np.linalg.norm(REFERENCE[0] - REFERENCE[20]))!r}) / 2"]
_add("feat_rmsd", fz.RMSDFeaturizer(REFERENCE[None], [0, 20]), _two)
_add("feat_landmark_rmsd", fz.LandMarkRMSDFeaturizer(REFERENCE[None], [0, 20], 0.5), [f"exp(-pow({_two[0]}, 2) / 0.5)"])


class _AfterSuperposing(fz.Featurizer):
    """What superposing leaves as it is, distances, and what it sets, the mean place."""

    def compute(self, x):
        y = fz.RawPositionsFeaturizer(reference=REFERENCE).compute(x).reshape(x.shape)
        return np.concatenate([geometry.distances(y, np.array(_pairs)), y.mean(1)], 1)


_add("feat_superposed", _AfterSuperposing(), [_dist(*p) for p in _pairs] + [repr(float(v)) for v in REFERENCE.mean(0)])
