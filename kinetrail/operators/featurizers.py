"""Featurizers: coordinates of a frame to a vector, frame by frame.

A frame's coordinates are an array of atoms of three numbers. Featurizers are
stateless after construction; reference structures and topologies are small and
travel with the function. ``transform`` needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.functions import geometry
from kinetrail.functions.distances import kabsch_rmsd, superpose

#: Radii in nanometres for surface areas, by element.
RADII = {"H": 0.12, "C": 0.17, "N": 0.155, "O": 0.152, "S": 0.18, "P": 0.18, "F": 0.147, "CL": 0.175}

#: Atoms of side-chain torsions.
CHI = {
    "chi1": [("N", "CA", "CB", g) for g in ("CG", "CG1", "OG", "OG1", "SG")],
    "chi2": [("CA", "CB", "CG", d) for d in ("CD", "CD1", "OD1", "ND1", "SD")] + [("CA", "CB", "CG1", "CD1")],
    "chi3": [("CB", "CG", "CD", e) for e in ("NE", "OE1", "CE")] + [("CB", "CG", "SD", "CE")],
    "chi4": [("CG", "CD", "NE", "CZ"), ("CG", "CD", "CE", "NZ")],
    "chi5": [("CD", "NE", "CZ", "NH1")],
}
#: Residues of proteins.
PROTEIN = set("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL HID HIE HIP CYX ACE NME".split())
WATER = {"HOH", "WAT", "SOL", "TIP3"}


@dataclass(frozen=True)
class Atom:
    name: str
    element: str
    residue: int
    resname: str = "ALA"
    chain: int = 0


@dataclass(frozen=True)
class Topology:
    """Atoms in order, and bonds as pairs of their indices."""

    atoms: tuple[Atom, ...]
    bonds: tuple[tuple[int, int], ...] = field(default=())

    def residues(self) -> list[int]:
        return sorted({a.residue for a in self.atoms})

    def index(self, residue: int, name: str) -> int | None:
        return next((i for i, a in enumerate(self.atoms) if a.residue == residue and a.name == name), None)

    def of_residue(self, residue: int, heavy: bool = False) -> list[int]:
        return [i for i, a in enumerate(self.atoms) if a.residue == residue and not (heavy and a.element == "H")]

    def chain_of(self, residue: int) -> int:
        return next(a.chain for a in self.atoms if a.residue == residue)

    def resname(self, residue: int) -> str:
        return next(a.resname for a in self.atoms if a.residue == residue)

    def backbone(self, parts: list[tuple[str, int]]) -> np.ndarray:
        """Indices of atoms given by name and offset of the residue, for each residue that has all in its chain."""
        out, all_ = [], self.residues()
        for k, r in enumerate(all_):
            ids = []
            for name, offset in parts:
                j = k + offset
                if not 0 <= j < len(all_) or self.chain_of(all_[j]) != self.chain_of(r):
                    break
                i = self.index(all_[j], name)
                if i is None:
                    break
                ids.append(i)
            if len(ids) == len(parts):
                out.append(ids)
        return np.array(out, int).reshape(-1, len(parts))

    def torsions(self, kind: str) -> np.ndarray:
        if kind == "phi":
            return self.backbone([("C", -1), ("N", 0), ("CA", 0), ("C", 0)])
        if kind == "psi":
            return self.backbone([("N", 0), ("CA", 0), ("C", 0), ("N", 1)])
        if kind == "omega":
            return self.backbone([("CA", 0), ("C", 0), ("N", 1), ("CA", 1)])
        if kind in CHI:
            out = []
            for r in self.residues():
                for names in CHI[kind]:
                    ids = [self.index(r, n) for n in names]
                    if None not in ids:
                        out.append(ids)
                        break
            return np.array(out, int).reshape(-1, 4)
        raise ValueError(f"unknown torsion {kind!r}")


def atompair_indices(top: Topology, keep: set[str] | None = None, exclude: set[str] | None = None, drop_bonded: bool = True) -> np.ndarray:
    """Pairs of atoms by name, without bonded ones."""
    chosen = [i for i, a in enumerate(top.atoms) if (keep is None or a.name in keep) and (not exclude or a.name not in exclude)]
    bonded = {frozenset(b) for b in top.bonds} if drop_bonded else set()
    return np.array([p for p in combinations(chosen, 2) if frozenset(p) not in bonded], int).reshape(-1, 2)


def atompair_table(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """The same on tables: ``i``, ``j`` of a small topology's atoms (``idx``) that no bond joins."""
    a, b = atoms.select(F.col("idx").alias("i")), atoms.select(F.col("idx").alias("j"))
    pairs = a.join(F.broadcast(b), F.col("i") < F.col("j"))
    bonded = bonds.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return pairs.join(bonded, ["i", "j"], "left_anti")


class Featurizer:
    """``compute`` maps (frames, atoms, 3) to (frames, features)."""

    xyz = "xyz"

    def compute(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def describe(self) -> list[dict]:
        """A dictionary for each feature."""
        return []

    def fit(self, df: DataFrame) -> Featurizer:
        return self

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        compute = self.compute

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def features(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.array([np.stack([np.asarray(a, float) for a in r]) for r in rows])
            return pd.Series(list(np.asarray(compute(x), float).reshape(len(x), -1)))

        return df.withColumn(out, features(self.xyz))

    fit_transform = transform


class SuperposeFeaturizer(Featurizer):
    """Displacement of each atom from a reference after superposition."""

    def __init__(self, atom_indices, reference: np.ndarray, superpose_atom_indices=None):
        self.atoms, self.reference = np.asarray(atom_indices, int), np.asarray(reference, float)
        self.by = self.atoms if superpose_atom_indices is None else np.asarray(superpose_atom_indices, int)

    def compute(self, x):
        y = superpose(x, self.reference, self.by)
        return np.linalg.norm(y[:, self.atoms] - self.reference[self.atoms], axis=2)

    def describe(self):
        return [{"featurizer": "superpose", "atoms": [int(a)]} for a in self.atoms]


class RMSDFeaturizer(Featurizer):
    """Deviation from each of some reference frames."""

    def __init__(self, references: np.ndarray, atom_indices=None):
        self.references = np.asarray(references, float)
        self.atoms = np.arange(self.references.shape[1]) if atom_indices is None else np.asarray(atom_indices, int)

    def compute(self, x):
        return np.stack([kabsch_rmsd(x[:, self.atoms], r[self.atoms]) for r in self.references], 1)


class LandMarkRMSDFeaturizer(RMSDFeaturizer):
    """The same through a Gaussian of width ``sigma``."""

    def __init__(self, references, atom_indices=None, sigma: float = 0.3):
        super().__init__(references, atom_indices)
        self.sigma = sigma

    def compute(self, x):
        return np.exp(-(super().compute(x) ** 2) / (2 * self.sigma**2))


class AtomPairsFeaturizer(Featurizer):
    def __init__(self, pair_indices, box=None, exponent: float = 1.0):
        self.pairs, self.box, self.exponent = np.asarray(pair_indices, int).reshape(-1, 2), box, exponent

    def compute(self, x):
        return geometry.distances(x, self.pairs, self.box) ** self.exponent

    def expression(self, xyz: str = "xyz"):
        """The same in the JVM, without a box."""
        def one(i, j):
            d = F.zip_with(F.get(xyz, F.lit(int(j))), F.get(xyz, F.lit(int(i))), lambda a, b: (a - b).cast("double") * (a - b))
            return F.pow(F.aggregate(d, F.lit(0.0), lambda a, b: a + b), F.lit(self.exponent / 2))

        return F.array(*(one(i, j) for i, j in self.pairs))

    def describe(self):
        return [{"featurizer": "atom pair", "atoms": [int(i), int(j)], "exponent": self.exponent} for i, j in self.pairs]


class FunctionFeaturizer(Featurizer):
    """A user's function of the coordinates, with fixed further arguments."""

    def __init__(self, function: Callable, func_args: dict | None = None):
        self.function, self.func_args = function, func_args or {}

    def compute(self, x):
        return np.asarray(self.function(x, **self.func_args), float).reshape(len(x), -1)


class DihedralFeaturizer(Featurizer):
    """Torsions; with ``sincos`` the sines and then the cosines of each type."""

    def __init__(self, top: Topology, types=("phi", "psi"), sincos: bool = True):
        self.types = [types] if isinstance(types, str) else list(types)
        self.sincos = sincos
        self.quads = {k: top.torsions(k) for k in self.types}

    def compute(self, x):
        parts = []
        for k in self.types:
            a = geometry.dihedrals(x, self.quads[k])
            parts += [np.sin(a), np.cos(a)] if self.sincos else [a]
        return np.concatenate(parts, 1)

    def describe(self):
        forms = ("sin", "cos") if self.sincos else ("angle",)
        return [{"featurizer": "dihedral", "type": k, "form": f, "atoms": q.tolist()} for k in self.types for f in forms for q in self.quads[k]]


class VonMisesFeaturizer(DihedralFeaturizer):
    """Soft bins of torsions: the von Mises density of ``kappa`` at ``n_bins`` centres from 0 to 2 pi, both ends included."""

    def __init__(self, top: Topology, types=("phi", "psi"), n_bins: int = 18, kappa: float = 20.0):
        super().__init__(top, types, False)
        self.centers, self.kappa = np.linspace(0, 2 * np.pi, n_bins), kappa

    def compute(self, x):
        parts = []
        for k in self.types:
            a = geometry.dihedrals(x, self.quads[k])
            p = np.exp(self.kappa * np.cos(a[:, :, None] - self.centers)) / (2 * np.pi * np.i0(self.kappa))
            parts.append(p.transpose(0, 2, 1).reshape(len(x), -1))  # bins of all torsions, bin by bin
        return np.concatenate(parts, 1)

    def describe(self):
        return [{"featurizer": "von mises", "type": k, "bin": b, "atoms": q.tolist()} for k in self.types for b in range(len(self.centers)) for q in self.quads[k]]


class AlphaAngleFeaturizer(Featurizer):
    """Torsions of four successive alpha carbons: cosines, then sines. Fewer than four give no columns."""

    def __init__(self, top: Topology, sincos: bool = True):
        self.quads, self.sincos = top.backbone([("CA", -1), ("CA", 0), ("CA", 1), ("CA", 2)]), sincos

    def compute(self, x):
        a = geometry.dihedrals(x, self.quads)
        return np.concatenate([np.cos(a), np.sin(a)], 1) if self.sincos else a


class KappaAngleFeaturizer(Featurizer):
    """Angle of the alpha carbons ``offset`` before, at and ``offset`` after a residue."""

    def __init__(self, top: Topology, cos: bool = True, offset: int = 2):
        self.triples, self.cos = top.backbone([("CA", -offset), ("CA", 0), ("CA", offset)]), cos

    def compute(self, x):
        a = geometry.angles(x, self.triples)
        return np.cos(a) if self.cos else a


class AngleFeaturizer(Featurizer):
    def __init__(self, angle_indices, cos: bool = True):
        self.triples, self.cos = np.asarray(angle_indices, int).reshape(-1, 3), cos

    def compute(self, x):
        a = geometry.angles(x, self.triples)
        return np.cos(a) if self.cos else a


class SASAFeaturizer(Featurizer):
    """Accessible surface of each atom, or summed by residue."""

    def __init__(self, top: Topology, mode: str = "residue", probe: float = 0.14, points: int = 960):
        if mode not in ("residue", "atom"):
            raise ValueError("mode is 'residue' or 'atom'")
        self.mode, self.probe, self.points = mode, probe, points
        self.radii = np.array([RADII.get(a.element.upper(), 0.17) for a in top.atoms])
        at = {r: k for k, r in enumerate(top.residues())}
        self.owner = np.array([at[a.residue] for a in top.atoms])

    def compute(self, x):
        areas = geometry.surface_areas(x, self.radii, self.probe, self.points)
        if self.mode == "atom":
            return areas
        return np.stack([areas[:, self.owner == r].sum(1) for r in range(self.owner.max() + 1)], 1)


class ContactFeaturizer(Featurizer):
    """Distances of residues: of alpha carbons, of the closest atoms or the closest heavy atoms; a soft minimum if wanted."""

    def __init__(self, top: Topology, contacts="all", scheme: str = "closest-heavy", ignore_nonprotein: bool = True, soft_min: bool = False, soft_min_beta: float = 20.0, box=None):
        if scheme not in ("ca", "closest", "closest-heavy"):
            raise ValueError(f"unknown scheme {scheme!r}")
        self.scheme, self.soft_min, self.soft_min_beta, self.box = scheme, soft_min, soft_min_beta, box
        if isinstance(contacts, str):
            all_ = [r for r in top.residues() if not ignore_nonprotein or top.resname(r) in PROTEIN]
            contacts = [(a, b) for a, b in combinations(all_, 2) if b - a >= 3]
        self.contacts = [tuple(c) for c in contacts]
        self.pairs: list[np.ndarray] = []
        for a, b in self.contacts:
            if scheme == "ca":
                i, j = [top.index(a, "CA")], [top.index(b, "CA")]
                if None in i + j:
                    raise ValueError("a residue has no alpha carbon")
            else:
                i, j = (top.of_residue(r, scheme == "closest-heavy") for r in (a, b))
            self.pairs.append(np.array([(p, q) for p in i for q in j], int))

    def residue_distances(self, x):
        out = []
        for p in self.pairs:
            d = geometry.distances(x, p, self.box)
            if self.soft_min:
                b = self.soft_min_beta
                top = (b / d).max(1, keepdims=True)
                out.append(b / (np.log(np.exp(b / d - top).sum(1)) + top[:, 0]))
            else:
                out.append(d.min(1))
        return np.stack(out, 1) if out else np.zeros((len(x), 0))

    def compute(self, x):
        return self.residue_distances(x)

    def describe(self):
        return [{"featurizer": "contact", "scheme": self.scheme, "residues": list(c)} for c in self.contacts]


class BinaryContactFeaturizer(ContactFeaturizer):
    """1 where residues are nearer than ``cutoff``."""

    def __init__(self, top: Topology, contacts="all", cutoff: float = 0.8, **kw):
        super().__init__(top, contacts, **kw)
        self.cutoff = cutoff

    def compute(self, x):
        return (self.residue_distances(x) < self.cutoff).astype(float)


class LogisticContactFeaturizer(ContactFeaturizer):
    """A smooth step from 1 to 0 at ``center``."""

    def __init__(self, top: Topology, contacts="all", center: float = 0.8, steepness: float = 20.0, **kw):
        super().__init__(top, contacts, **kw)
        self.center, self.steepness = center, steepness

    def compute(self, x):
        return 1 / (1 + np.exp(self.steepness * (self.residue_distances(x) - self.center)))


class GaussianSolventFeaturizer(Featurizer):
    """For each solute atom the sum over solvent atoms of exp(-d^2 / 2 sigma^2); without ``squared`` d is not squared."""

    def __init__(self, solute_indices, solvent_indices, sigma: float, box=None, squared: bool = True):
        self.solute, self.solvent = np.asarray(solute_indices, int), np.asarray(solvent_indices, int)
        self.sigma, self.box, self.squared = sigma, box, squared

    def compute(self, x):
        out = []
        for a in self.solute:
            d = geometry.distances(x, np.stack([np.full(len(self.solvent), a), self.solvent], 1), self.box)
            out.append(np.exp(-(d**2 if self.squared else d) / (2 * self.sigma**2)).sum(1))
        return np.stack(out, 1)


class RawPositionsFeaturizer(Featurizer):
    """Flat coordinates, superposed on a reference if one is given."""

    def __init__(self, atom_indices=None, reference=None):
        self.atoms = None if atom_indices is None else np.asarray(atom_indices, int)
        self.reference = None if reference is None else np.asarray(reference, float)

    def compute(self, x):
        if self.reference is not None:
            x = superpose(x, self.reference, self.atoms)
        return (x if self.atoms is None else x[:, self.atoms]).reshape(len(x), -1)


class DRIDFeaturizer(Featurizer):
    """Moments of the reciprocal distances of each atom to all that it is not bonded to."""

    def __init__(self, top: Topology, atom_indices=None):
        self.atoms = np.arange(len(top.atoms)) if atom_indices is None else np.asarray(atom_indices, int)
        near: dict[int, set[int]] = {}
        for i, j in top.bonds:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
        self.excluded = [near.get(int(a), set()) for a in self.atoms]

    def compute(self, x):
        return geometry.reciprocal_moments(x, self.atoms, self.excluded)


class Slicer(Featurizer):
    """Some columns of a feature array: by ``index``, or the ``first`` so many."""

    def __init__(self, index=None, first: int | None = None, features: str = "features"):
        if (index is None) == (first is None):
            raise ValueError("exactly one of index and first is needed")
        self.index, self.first, self.features = index, first, features

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        x = F.col(self.features)
        return df.withColumn(out or self.features, F.slice(x, 1, self.first) if self.index is None else F.array(*(x[int(i)] for i in self.index)))


class CommonContactFeaturizer(Featurizer):
    """Contacts given in the columns of a sequence alignment, for one of the aligned proteins.

    ``alignment`` has a string for each protein, with ``-`` for gaps; contacts in
    which the protein has a gap raise, unless ``contacts`` is ``all``: then those present in
    all proteins are used.
    """

    def __init__(self, alignment: dict[str, str], name: str, top: Topology, contacts="all", same_residue: bool = True, kind: type[ContactFeaturizer] = ContactFeaturizer, **kw):
        place = {p: self._places(s) for p, s in alignment.items()}
        shared = [c for c in range(len(next(iter(alignment.values())))) if all(c in m for m in place.values())]
        if same_residue:
            shared = [c for c in shared if len({s[c] for s in alignment.values()}) == 1]
        if isinstance(contacts, str):
            contacts = [(a, b) for a, b in combinations(shared, 2) if b - a >= 3]
        residues, mine = top.residues(), place[name]
        self.inner = kind(top, [(residues[mine[a]], residues[mine[b]]) for a, b in contacts], **kw)

    @staticmethod
    def _places(sequence: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for column, letter in enumerate(sequence):
            if letter != "-":
                out[column] = len(out)
        return out

    def compute(self, x):
        return self.inner.compute(x)


def ligand_chains(top: Topology) -> tuple[int, int]:
    """The chain of the protein, the longest, and that of the ligand, the shortest that is no water."""
    size: dict[int, int] = {}
    for a in top.atoms:
        if a.resname not in WATER:
            size[a.chain] = size.get(a.chain, 0) + 1
    if len(size) < 2:
        raise ValueError("a protein and a ligand need two chains")
    order = sorted(size, key=lambda c: (size[c], -c))
    return order[-1], order[0]


class LigandContactFeaturizer(ContactFeaturizer):
    """Contacts between residues of a protein and a ligand; a pocket keeps those near in a reference frame."""

    def __init__(self, top: Topology, protein_chain: int | None = None, ligand_chain: int | None = None, reference=None, binding_pocket: float | None = None, scheme: str = "closest-heavy", **kw):
        protein, ligand = ligand_chains(top) if protein_chain is None or ligand_chain is None else (protein_chain, ligand_chain)
        pairs = [(a, b) for a in top.residues() if top.chain_of(a) == protein for b in top.residues() if top.chain_of(b) == ligand]
        super().__init__(top, pairs, scheme, ignore_nonprotein=False, **kw)
        if binding_pocket is not None:
            near = self.residue_distances(np.asarray(reference, float)[None])[0] < binding_pocket
            self.contacts = [c for c, n in zip(self.contacts, near) if n]
            self.pairs = [p for p, n in zip(self.pairs, near) if n]


class BinaryLigandContactFeaturizer(LigandContactFeaturizer):
    def __init__(self, top: Topology, cutoff: float = 0.8, **kw):
        super().__init__(top, **kw)
        self.cutoff = cutoff

    def compute(self, x):
        return (self.residue_distances(x) < self.cutoff).astype(float)


class LigandRMSDFeaturizer(Featurizer):
    """Superposed by one part, the plain deviation of another: by default protein and ligand."""

    def __init__(self, top: Topology, reference, align_by: str = "protein", calculate_for: str = "ligand"):
        protein, ligand = ligand_chains(top)
        at = {"protein": np.array([i for i, a in enumerate(top.atoms) if a.chain == protein]), "ligand": np.array([i for i, a in enumerate(top.atoms) if a.chain == ligand])}
        self.by, self.of, self.reference = at[align_by], at[calculate_for], np.asarray(reference, float)

    def compute(self, x):
        y = superpose(x, self.reference, self.by)
        return np.sqrt(((y[:, self.of] - self.reference[self.of]) ** 2).sum(2).mean(1))[:, None]


class SubsetFeaturizer(Featurizer):
    """Some columns of another featurizer, changeable between fits."""

    def __init__(self, inner: Featurizer, subset=None):
        self.inner, self.subset = inner, subset

    def compute(self, x):
        out = self.inner.compute(x)
        return out if self.subset is None else out[:, np.asarray(self.subset, int)]


def subset_atom_pairs(pairs, subset=None, exponent: float = 1.0) -> SubsetFeaturizer:
    return SubsetFeaturizer(AtomPairsFeaturizer(pairs, exponent=exponent), subset)


class SubsetTrigFeaturizer(SubsetFeaturizer):
    """Sine or cosine of one type of torsion, each by its name: the psi ones use psi."""

    def __init__(self, top: Topology, kind: str, form: str, subset=None):
        trig, quads = {"sin": np.sin, "cos": np.cos}[form], top.torsions(kind)
        super().__init__(FunctionFeaturizer(lambda x: trig(geometry.dihedrals(x, quads))), subset)


def subset_cos_phi(top, subset=None):
    return SubsetTrigFeaturizer(top, "phi", "cos", subset)


def subset_cos_psi(top, subset=None):
    return SubsetTrigFeaturizer(top, "psi", "cos", subset)


def subset_sin_phi(top, subset=None):
    return SubsetTrigFeaturizer(top, "phi", "sin", subset)


def subset_sin_psi(top, subset=None):
    return SubsetTrigFeaturizer(top, "psi", "sin", subset)


class FeatureSelector(Featurizer):
    """Named featurizers side by side, all or those in ``which``."""

    def __init__(self, features: list[tuple[str, Featurizer]], which=None):
        if isinstance(features, dict):
            raise TypeError("features are (name, featurizer) pairs in order")
        self.all = dict(features)
        chosen = list(self.all) if which is None else [which] if isinstance(which, str) else list(which)
        unknown = [n for n in chosen if n not in self.all]
        if unknown:
            raise ValueError(f"unknown features {unknown}")
        self.which = chosen

    def compute(self, x):
        return np.concatenate([self.all[n].compute(x) for n in self.which], 1)

    def describe(self):
        return [{"name": n} | d for n in self.which for d in self.all[n].describe()]


class FeatureSlicer(SubsetFeaturizer):
    """Columns of a featurizer by index."""


def feature_union(parts: list[DataFrame], keys: tuple[str, str] = ("traj_id", "frame"), normalize: bool = True) -> DataFrame:
    """Parallel feature sets joined by frame, each divided by the standard deviation of all its numbers. A frame that one lacks fails."""
    out = None
    for k, df in enumerate(parts):
        x = df.select(*keys, F.col("features").alias(f"__f{k}"))
        if normalize:
            flat = x.select(F.explode(f"__f{k}").alias("v")).agg(F.stddev_pop("v")).first()[0]
            x = x.withColumn(f"__f{k}", F.transform(f"__f{k}", lambda v: v / F.lit(float(flat or 1.0))))
        out = x if out is None else out.join(x, list(keys), "full")
    whole = F.concat(*(F.coalesce(F.col(f"__f{k}"), F.raise_error(F.lit("feature sets differ in their frames")).cast("array<double>")) for k in range(len(parts))))
    return out.select(*keys, whole.alias("features"))
