"""Coordinates from text files of molecular frames: PDB and XYZ, many files at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.operators.featurizers import PROTEIN, Atom, Featurizer, Topology

FRAMES = "path string, frame bigint, xyz array<array<double>>"


def pdb_frames(text: str) -> Iterator[np.ndarray]:
    """Coordinates of each model in nanometres."""
    atoms: list[list[float]] = []
    for line in text.splitlines():
        if line.startswith(("ATOM", "HETATM")):
            atoms.append([float(line[30:38]) / 10, float(line[38:46]) / 10, float(line[46:54]) / 10])
        elif line.startswith("ENDMDL") and atoms:
            yield np.array(atoms)
            atoms = []
    if atoms:
        yield np.array(atoms)


def xyz_frames(text: str) -> Iterator[np.ndarray]:
    """Frames of an XYZ file: a number, a comment, and a line an atom in tenths of nanometres."""
    lines = text.splitlines()
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        n = int(lines[at])
        yield np.array([[float(v) / 10 for v in row.split()[1:4]] for row in lines[at + 2 : at + 2 + n]]).reshape(n, 3)
        at += 2 + n


READERS = {"pdb": pdb_frames, "xyz": xyz_frames}


def read_coordinates(spark: SparkSession, path: str, fmt: str, stride: int = 1, atom_indices=None) -> DataFrame:
    """``path``, ``frame`` and ``xyz`` of every ``stride``-th frame, with all or some atoms.

    Both choices are made in the reader, so what is left out never leaves the task.
    """
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}")
    frames, atoms = READERS[fmt], None if atom_indices is None else np.asarray(atom_indices, int)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", "true").load(path)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"]):
                rows = []
                for i, x in enumerate(frames(content.decode())):
                    if i % stride == 0:
                        rows.append((p, i, (x if atoms is None else x[atoms]).tolist()))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=["path", "frame", "xyz"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "frame", "xyz"])

    return files.select("path", "content").mapInPandas(read, FRAMES)


def pdb_topology(text: str) -> Topology:
    """Atoms of the first model, and the bonds of its CONECT records."""
    atoms, serial, bonds, chains = [], {}, set(), {}
    done = False
    for line in text.splitlines():
        if line.startswith(("ATOM", "HETATM")) and not done:
            name, resname, chain = line[12:16].strip(), line[17:20].strip(), line[21:22]
            element = line[76:78].strip() or name.lstrip("0123456789")[:1]
            key = (chain, line[22:27])
            residue = chains.setdefault(key, len(chains))
            serial[int(line[6:11])] = len(atoms)
            atoms.append((name, element, residue, resname, chain))
        elif line.startswith("ENDMDL"):
            done = True
        elif line.startswith("CONECT"):
            ids = [int(line[i : i + 5]) for i in range(6, len(line.rstrip()), 5) if line[i : i + 5].strip()]
            bonds |= {tuple(sorted((serial[ids[0]], serial[j]))) for j in ids[1:] if ids[0] in serial and j in serial}
    order = {c: i for i, c in enumerate(dict.fromkeys(a[4] for a in atoms))}
    return Topology(tuple(Atom(n, e, r, s, order[c]) for n, e, r, s, c in atoms), tuple(sorted(bonds)))


def atom_indices(top: Topology, kind: str) -> np.ndarray:
    """Atoms of a kind: ``all``, ``alpha`` carbons, ``heavy`` atoms, or the ``minimal`` set of the backbone and the first side-chain carbon."""
    minimal = {"CA", "CB", "C", "N", "O"}
    rules = {
        "all": lambda a: True,
        "alpha": lambda a: a.name == "CA",
        "heavy": lambda a: a.element.upper() != "H" and a.resname in PROTEIN,
        "minimal": lambda a: a.name in minimal and a.resname in PROTEIN,
    }
    if kind not in rules:
        raise ValueError(f"unknown kind of atoms {kind!r}")
    return np.array([i for i, a in enumerate(top.atoms) if rules[kind](a)], int)


def featurize_all(frames: DataFrame, featurizer: Featurizer, stride: int = 1) -> DataFrame:
    """``fns``, ``indices`` and ``data``: each frame's file, its number and its features."""
    rows = frames if stride == 1 else frames.where(F.col("frame") % stride == 0)
    return featurizer.transform(rows, "data").select(F.col("path").alias("fns"), F.col("frame").alias("indices"), "data")
