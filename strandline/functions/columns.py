"""Column functions. Everything here stays in whole-stage code generation or is a built-in expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The twenty standard residues, in one-letter and three-letter form.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
#: The twenty standard residues.
STANDARD = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
#: Secondary-structure letters and their number in eight states, and in three (helix, strand, coil).
DSSP8 = {"H": 0, "B": 1, "E": 2, "G": 3, "I": 4, "T": 5, "S": 6, " ": 7}
DSSP3 = {"H": 0, "G": 0, "I": 0, "E": 1, "B": 1, "T": 2, "S": 2, " ": 2}


def lookup(values: dict, key: Column, default=None) -> Column:
    """A map literal applied to `key`; unknown keys give `default`, null keys null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.when(key.isNotNull(), F.coalesce(found, F.lit(default)) if default is not None else found)


def aa3_to_1(residue: Column, strict: bool = True) -> Column:
    """One letter for a three-letter residue. Unknown residues raise, or are X if not strict."""
    letter = lookup(ONE_LETTER, F.upper(residue))
    unknown = F.raise_error(F.concat(F.lit("unknown residue "), residue)) if strict else F.lit("X")
    return F.when(residue.isNull(), None).when(letter.isNull(), unknown).otherwise(letter)


def fasta_wrap(sequence: Column, width: int = 80, legacy: bool = False) -> Column:
    """Line breaks after each `width` letters; legacy: the first line has one letter more."""
    body = lambda s: F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", "")
    if not legacy:
        return body(sequence)
    head, rest = F.substring(sequence, 1, width + 1), sequence.substr(F.lit(width + 2), F.length(sequence))
    return F.when(F.length(sequence) <= width + 1, sequence).otherwise(F.concat(head, F.lit("\n"), body(rest)))


def normal_id(entry: Column) -> Column:
    """Upper case, without a structure file's suffix."""
    return F.upper(F.regexp_replace(F.trim(entry), r"(?i)\.(cif|pdb|ent)(\.gz)?$", ""))


def chain_key(pid: Column, chain: Column) -> Column:
    return F.concat_ws("_", pid, chain)


def key_entry(pidc: Column) -> Column:
    return F.split_part(pidc, F.lit("_"), F.lit(1))


def key_chain(pidc: Column) -> Column:
    return F.split_part(pidc, F.lit("_"), F.lit(2))


def model_label(pidc: Column, model: Column) -> Column:
    """Key and model number, two digits at least."""
    return F.concat(pidc, F.lit("_"), F.when(model < 10, F.concat(F.lit("0"), model.cast("string"))).otherwise(model.cast("string")))


def deposition_year(date: Column) -> Column:
    return date.cast("string").substr(1, 4).try_cast("int")


def mask_low_occupancy(value: Column, occupancy: Column, threshold: float = 0.5) -> Column:
    """Null where the occupancy is at or below the threshold; an unknown occupancy keeps the value."""
    return F.when(occupancy <= threshold, None).otherwise(value)


def unlike(column: Column, value) -> Column:
    """column <> value, true for null: a null is no match, so it is not dropped."""
    return column.isNull() | (column != value)


def unless(condition: Column) -> Column:
    """The complement of a filter: true where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def similarity_to_distance(s: Column) -> Column:
    return F.lit(1.0) - s


def rmsd_band(rmsd: Column, scale: float = 1.0) -> Column:
    """How alike two structures of this RMSD are."""
    return F.when(rmsd.isNull(), None).when(rmsd < 1 * scale, "near identical").when(rmsd < 2 * scale, "very similar").when(rmsd < 4 * scale, "similar").when(rmsd <= 6 * scale, "related").when(rmsd <= 10 * scale, "different").otherwise("unrelated")


def tm_band(tm: Column) -> Column:
    return F.when(tm.isNull(), None).when(tm >= 1.0, "identical").when(tm > 0.8, "near identical").when(tm > 0.5, "same fold").when(tm >= 0.2, "uncertain").otherwise("random")


def tm_d0(length: Column) -> Column:
    """The distance scale of the final score for a chain of this length: 0.5 up to 21 residues and never less."""
    return F.when(length <= 21, F.lit(0.5)).otherwise(F.greatest(F.lit(0.5), F.lit(1.24) * F.pow(length - 15.0, F.lit(1 / 3)) - 1.8))


def tm_d0_search(length: Column) -> Column:
    """The distance scale of the search, and its clipped form for choosing pairs."""
    d0 = F.when(length <= 19, F.lit(0.168)).otherwise(F.lit(1.24) * F.pow(length - 15.0, F.lit(1 / 3)) - 1.8) + 0.8
    return F.struct(d0.alias("d0"), F.least(F.lit(8.0), F.greatest(F.lit(4.5), d0)).alias("d0_search"), (F.lit(1.5) * F.pow(length.cast("double"), F.lit(0.3)) + 3.5).alias("d8"))


def tm_term(distance: Column, d0: Column) -> Column:
    return F.lit(1.0) / (1.0 + (distance / d0) * (distance / d0))


def contact_msf_to_b(msf: Column) -> Column:
    """Crystallographic B-factor of a mean square fluctuation."""
    return F.lit(8 * math.pi**2 / 3) * msf


def superposed_rmsd(sums: DataFrame) -> DataFrame:
    """RMSD after the best proper rotation, in closed form, of rows (keys.., n, e, c00 .. c22) -> (keys.., rmsd).

    n: points; e: sum of squares of both centred sets; c: the 3x3 sums of
    products of centred coordinates. With singular values s1 >= s2 >= s3 of c,
    rmsd^2 = (e - 2 (s1 + s2 + sign(det c) s3)) / n; their squares are the
    eigenvalues of the symmetric matrix c'c, from the trigonometric cubic.
    Each step is a projection of its own, so no term is computed twice.
    """
    used = {"n", "e", *(f"c{i}{j}" for i in range(3) for j in range(3))}
    keys = [c for c in sums.columns if c not in used]
    c = [[F.col(f"c{i}{j}") for j in range(3)] for i in range(3)]
    g = {(i, j): c[0][i] * c[0][j] + c[1][i] * c[1][j] + c[2][i] * c[2][j] for i in range(3) for j in range(i, 3)}
    df = sums.select(*keys, "n", "e", _det(c).alias("det"), *[v.alias(f"g{i}{j}") for (i, j), v in g.items()])
    df = df.withColumn("mean", (F.col("g00") + F.col("g11") + F.col("g22")) / 3.0)
    b = [[F.col(f"g{min(i, j)}{max(i, j)}") - F.col("mean") if i == j else F.col(f"g{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    p2 = (b[0][0] * b[0][0] + b[1][1] * b[1][1] + b[2][2] * b[2][2] + 2.0 * (b[0][1] * b[0][1] + b[0][2] * b[0][2] + b[1][2] * b[1][2])) / 6.0
    df = df.select(*keys, "n", "e", "det", "mean", F.sqrt(F.greatest(p2, F.lit(0.0))).alias("p"), _det(b).alias("detb"))
    p = F.col("p")
    half = F.col("detb") / 2.0 / F.when(p > 0, p * p * p)
    df = df.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(half, F.lit(1.0))))) / 3.0)
    root = lambda k: F.sqrt(F.greatest(F.col("mean") + 2.0 * p * F.cos(F.col("phi") + k * 2.0 * math.pi / 3.0), F.lit(0.0)))
    total = root(0) + root(2) + F.signum("det") * root(1)
    return df.select(*keys, F.sqrt(F.greatest((F.col("e") - 2.0 * total) / F.col("n"), F.lit(0.0))).alias("rmsd"))


def _det(m) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def distance(ax, ay, az, bx, by, bz) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def secondary_structure(x: Column, y: Column, z: Column, keys: list[str], order: str, scale: float = 1.0) -> Column:
    """H, E, T or C from the six distances within five residues; the two at either end are C.

    Fixed values: the distances of an ideal helix and strand, and their tolerances.
    """
    w = W.partitionBy(*keys).orderBy(order)
    at = lambda k: [F.lag(c, -k).over(w) if k else c for c in (x, y, z)]
    p = {k: at(k) for k in range(-2, 3)}
    d = {(a, b): distance(*p[a], *p[b]) for a, b in ((-2, 0), (-2, 1), (-2, 2), (-1, 1), (-1, 2), (0, 2))}

    def near(values, tolerance):
        out = F.lit(True)
        for pair, v in values.items():
            out = out & (F.abs(d[pair] - v * scale) < tolerance * scale)
        return out

    helix = near({(-2, 2): 6.37, (-2, 1): 5.18, (-1, 2): 5.18, (-2, 0): 5.45, (-1, 1): 5.45, (0, 2): 5.45}, 2.1)
    strand = near({(-2, 2): 13.0, (-2, 1): 10.4, (-1, 2): 10.4, (-2, 0): 6.1, (-1, 1): 6.1, (0, 2): 6.1}, 1.42)
    return F.when(d[(-2, 2)].isNull(), "C").when(helix, "H").when(strand, "E").when(d[(-2, 2)] < 8.0 * scale, "T").otherwise("C")


def boundary(label: Column, keys: list[str], order: str) -> Column:
    """Half a point for each neighbour with another label; a missing neighbour is none."""
    w = W.partitionBy(*keys).orderBy(order)
    side = lambda n: F.when(n.isNotNull() & (n != label), 0.5).otherwise(0.0)
    return side(F.lag(label).over(w)) + side(F.lead(label).over(w))


def smooth3(value: Column, keys: list[str], order: str) -> Column:
    """Weights a quarter, a half, a quarter; zero beyond the ends."""
    w = W.partitionBy(*keys).orderBy(order)
    return F.lit(0.25) * F.coalesce(F.lag(value).over(w), F.lit(0.0)) + F.lit(0.5) * value + F.lit(0.25) * F.coalesce(F.lead(value).over(w), F.lit(0.0))


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    return (value - median) / (F.lit(1.4826) * (mad + 1e-12))
