"""Small invented structures and tables."""

import numpy as np

HEAD = """data_TEST
# a comment
_struct.title 'A chain''s "title"'
_pdbx_database_status.recvd_initial_deposition_date 1999-03-04
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.pdbx_PDB_model_num
"""
SCHEME = """#
loop_
_pdbx_poly_seq_scheme.asym_id
_pdbx_poly_seq_scheme.seq_id
_pdbx_poly_seq_scheme.mon_id
_pdbx_poly_seq_scheme.pdb_seq_num
"""


def cif(chains=("A", "B"), models=3, residues=6, occupancy=None, hetero_only=False, scheme_chains=None):
    lines, n = [HEAD], 0
    for m in range(1, models + 1):
        for c in chains:
            for r in range(1, residues + 1):
                for atom in ("N", "CA"):
                    n += 1
                    kind = "HETATM" if hetero_only else "ATOM"
                    occ = (occupancy or {}).get(r, "1.00")
                    lines.append(f"{kind} {n} {atom} ALA {c} {r} {r * 3.8 + m * 0.1:.3f} {ord(c) % 7}.5 {m * 0.2:.3f} {occ} {m}\n")
            n += 1
            lines.append(f"HETATM {n} CA CA {c} . 9.0 9.0 9.0 1.00 {m}\n")
    lines.append(SCHEME)
    for c in scheme_chains or chains:
        for r in range(1, residues + 2):
            lines.append(f"{c} {r} ALA {r}\n")
    lines.append("_other.text\n;first line\nsecond; line\n;\n_other.quoted 'it''s'\n")
    return "".join(lines)


def helix(n):
    t = np.arange(n)
    return np.stack([2.3 * np.cos(np.radians(100) * t), 2.3 * np.sin(np.radians(100) * t), 1.5 * t], axis=1)


def strand(n):
    t = np.arange(n)
    return np.stack([3.3 * t, 0.9 * (-1.0) ** t, np.zeros(n)], axis=1)


def rotation(seed):
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q * np.array([1, 1, -1])


def wander(n, seed=0):
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(n, 3)) + np.array([0.6, 0.3, 0.1])
    return np.cumsum(3.8 * d / np.linalg.norm(d, axis=1, keepdims=True), axis=0)


def hinged(models=6, half=15):
    base, out = wander(2 * half, 3), []
    for m in range(models):
        a = np.radians(12 * m)
        r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        x = base.copy()
        x[half:] = (x[half:] - base[half]) @ r.T + base[half]
        out.append(x)
    return np.array(out)


def points_rows(models, chain="A"):
    return [(chain, m, s + 1, *map(float, p)) for m, x in enumerate(models, 1) for s, p in enumerate(x)]


POINTS = "chain string, model long, seq long, x double, y double, z double"
