"""Structure files: mmCIF and PDB text to typed rows, as table functions over whole files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.columns import normal_id
from strandline.schemas import ATOM_SITE, POLY_SEQ
from strandline.sources.scratch import computed_once

#: The file's fields that feed the two tables.
ATOM_FIELDS = dict(zip(ATOM_SITE.names, ("group_PDB", "id", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "pdbx_PDB_model_num"), strict=True))
SCHEME_FIELDS = dict(zip(POLY_SEQ.names, ("seq_id", "mon_id", "pdb_seq_num", "asym_id"), strict=True))

_WORD = re.compile(r"""#[^\n]*|'(?:[^'\n]|'(?=\S))*'|"(?:[^"\n]|"(?=\S))*"|\S+""")


#: Bytes of a text that are taken apart at once, and rows of a loop that leave a task together.
SLICE, ROWS = 1 << 20, 1 << 13


def _lines(text) -> Iterator[str]:
    """The lines of a text, a string or the bytes of one; of bytes only a slice is decoded at a time."""
    if isinstance(text, str):
        yield from text.splitlines()
        return
    at, size = 0, len(text)
    while at < size:
        end, step = size, SLICE
        while at + step < size:
            cut = bytes(text[at : at + step]).rfind(b"\n")
            if cut >= 0:
                end = at + cut + 1
                break
            step *= 2
        yield from bytes(text[at:end]).decode().splitlines()
        at = end


def cif_words(text):
    """(value, quoted) of an mmCIF file; comments are dropped, text fields between line-initial semicolons are one value."""
    lines = _lines(text)
    for line in lines:
        if line.startswith(";"):
            parts, rest = [line[1:]], ""
            for more in lines:
                if more.startswith(";"):
                    rest = more[1:]
                    break
                parts.append(more)
            yield "\n".join(parts), True
            line = rest
        for m in _WORD.finditer(line):
            w = m[0]
            if w[0] == "#":
                break
            quoted = len(w) > 1 and w[0] in "'\"" and w[-1] == w[0]
            yield (w[1:-1] if quoted else w), quoted


def cif_pieces(text) -> Iterator[tuple[list[str], list[str], bool]]:
    """(names, values, first) of the first data block: a name with its value, or a loop's names with the values of some of its rows, one after another. first: whether the loop begins here."""
    names: list[str] | None = None
    values: list[str] = []
    key, blocks, first, step = None, 0, True, 0
    for w, quoted in cif_words(text):
        low = w.lower()
        if not quoted and (low.startswith("data_") or low == "loop_" or w.startswith("_")):
            if w.startswith("_") and names is not None and not step:
                names.append(w)
                continue
            if names:
                yield names, values, first
            names, values, first, step = None, [], True, 0
            if low.startswith("data_"):
                blocks += 1
                if blocks > 1:
                    return
            elif low == "loop_":
                names = []
            else:
                key = w
        elif names is not None:
            step = step or max(1, ROWS * len(names))
            values.append(w)
            if len(values) == step:
                if names:
                    yield names, values, first
                values, first = [], False
        elif key:
            yield [key], [w], True
            key = None
    if names:
        yield names, values, first


def parse_cif(text: str) -> dict[str, list[str]]:
    """Field name -> values of the first data block."""
    out: dict[str, list[str]] = {}
    for names, values, first in cif_pieces(text):
        _gather(out, names, values, first)
    return out


def _gather(out: dict[str, list[str]], names: list[str], values: list[str], first: bool) -> None:
    for n, k in {n: k for k, n in enumerate(names)}.items():
        if first:
            out[n] = []
        out[n] += values[k :: len(names)]


def _in_one_loop(text, category: str) -> bool:
    """Whether a category's names stand one after another behind one loop_, and nowhere else. Then its rows are final as they come; else a later value may replace an earlier one."""
    end = None
    for m in re.finditer(category.encode() + rb"\.\S*\s*", text):
        if m.start() != end and (end is not None or not re.search(rb"(?i)\bloop_\s+\Z", bytes(text[max(0, m.start() - 64) : m.start()]))):
            return False
        end = m.end()
    return True


def _rows(names: list[str], values: list[str], category: str, wanted: dict[str, str]) -> list[list[str]]:
    """`_columns` of a piece of a loop."""
    fields: dict[str, list[str]] = {}
    _gather(fields, names, values, True)
    return _columns(fields, category, wanted)


def _columns(fields: dict[str, list[str]], category: str, wanted: dict[str, str]) -> list[list[str]]:
    columns = [fields.get(f"{category}.{f}") for f in wanted.values()]
    if not any(columns):
        return [[] for _ in wanted]
    missing = [f for f, c in zip(wanted.values(), columns, strict=True) if c is None]
    if missing:
        raise KeyError(f"{category} lacks {', '.join(missing)}")
    if len({len(c) for c in columns}) > 1:
        raise ValueError(f"{category} has columns of different length")
    return columns


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(pid, path, text) of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(normal_id(name).alias("pid"), "path", F.decode("content", "UTF-8").alias("text"))


#: The two tables: category and fields.
_TABLES = (("_atom_site", ATOM_FIELDS), ("_pdbx_poly_seq_scheme", SCHEME_FIELDS))


def file_rows(text) -> Iterator[tuple[list, list, dict | None]]:
    """(columns of atoms, columns of the scheme, header) of the bytes of an mmCIF file, some rows at a time; the header comes last, alone.

    Only a piece of a loop is held. A category that is not in one loop is
    gathered first, as its later values replace the earlier ones.
    """
    streamed = [_in_one_loop(text, c) for c, _ in _TABLES]
    held: dict[str, list[str]] = {}
    one = dict.fromkeys(("_struct.title", "_pdbx_database_status.recvd_initial_deposition_date"))
    some: dict[str, dict] = {n: {} for n in ("_atom_site.label_asym_id", "_struct_asym.id", "_atom_site.pdbx_PDB_model_num")}
    nothing: list[list] = [[[] for _ in wanted] for _, wanted in _TABLES]
    for names, values, first in cif_pieces(text):
        place = {n: k for k, n in enumerate(names)}
        for n in one.keys() & place.keys() if first else ():
            one[n] = values[place[n]] if place[n] < len(values) else None
        for n in some.keys() & place.keys():
            some[n] = ({} if first else some[n]) | dict.fromkeys(values[place[n] :: len(names)])
        for t, (category, wanted) in enumerate(_TABLES):
            if not any(f"{category}.{f}" in place for f in wanted.values()):
                continue
            if streamed[t]:
                columns = list(nothing)
                columns[t] = _rows(names, values, category, wanted)
                yield *columns, None
            else:
                _gather(held, names, values, first)
    for t, (category, wanted) in enumerate(_TABLES):
        if not streamed[t]:
            columns = _columns(held, category, wanted)
            for k in range(0, len(columns[0]), ROWS):
                part = list(nothing)
                part[t] = [c[k : k + ROWS] for c in columns]
                yield *part, None
    title, deposition = one.values()
    chains = some["_atom_site.label_asym_id"] or some["_struct_asym.id"]
    yield *nothing, {"head": title, "deposition": deposition, "chains": list(chains), "model_count": len(some["_atom_site.pdbx_PDB_model_num"])}


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of a table (pid, text): pid, atoms, scheme (arrays of some rows of a file), and one a file with head, deposition, all_chains, model_count, where `last` is true. One pass, no shuffle; what a task holds is a file's text, not its values."""
    import pyarrow as pa

    def rows(columns, wanted):
        cells = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=list(wanted))
        return pa.ListArray.from_arrays(pa.array([0, len(columns[0])], pa.int32()), cells)

    def run(batches):
        for b in batches:
            for pid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for atoms, scheme, h in file_rows(memoryview(text.as_buffer() or b"")):
                    own = h or dict.fromkeys(("head", "deposition", "chains", "model_count"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pid], pa.string()), rows(atoms, ATOM_FIELDS), rows(scheme, SCHEME_FIELDS), pa.array([own["head"]], pa.string()), pa.array([own["deposition"]], pa.string()), pa.array([own["chains"]], pa.list_(pa.string())), pa.array([own["model_count"]], pa.int32()), pa.array([h is not None])],
                        names=["pid", "atoms", "scheme", "head", "deposition", "all_chains", "model_count", "last"],
                    )

    row = lambda names: "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>"
    return files.select("pid", "text").mapInArrow(run, f"pid string, atoms {row(ATOM_FIELDS)}, scheme {row(SCHEME_FIELDS)}, head string, deposition string, all_chains array<string>, model_count int, last boolean")


def parse_mmcif(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atom_site, poly_seq, headers), each keyed by pid, of a table (pid, text). Files are parsed once, now; the three tables read what that left in the shared folder."""
    parsed = computed_once(parse_files(files))
    return parsed.select("pid", F.inline("atoms")), parsed.select("pid", F.inline("scheme")), parsed.filter("last").select("pid", "head", "deposition", "all_chains", "model_count")


def parse_pdb(files: DataFrame, atom: str = "CA", hetero: bool = False, split_models: bool = True, until_ter: bool = False) -> DataFrame:
    """Fixed-width PDB coordinates of a table (pid, text): (pid, model, chain, seq_id, mon_id, atom_id, x, y, z), one row a matching atom.

    hetero: also HETATM rows; split_models: number models (else all are 1);
    until_ter: only up to the first TER of a model. A file is cut into its
    models before its lines become rows, so nothing is shuffled.
    """
    parts = F.split("text", r"(?m)^(?=MODEL(?: |\r?$))") if split_models else F.array("text")
    models = files.select("pid", F.explode(parts).alias("part"))
    number = F.regexp_extract("part", r"\AMODEL\s+(\d+)", 1).try_cast("bigint") if split_models else F.lit(None).cast("bigint")
    body = F.element_at(F.split("part", r"(?m)^TER(?: {3}| {0,2}\r?$)", 2), 1) if until_ter else F.col("part")
    lines = models.select("pid", F.coalesce(number, F.lit(1).cast("bigint")).alias("model"), F.explode(F.split(body, "\r?\n")).alias("line"))
    kinds = ["ATOM", "HETATM"] if hetero else ["ATOM"]
    field = lambda a, n: F.trim(F.substring("line", a, n))
    rows = lines.filter(F.rtrim(F.substring("line", 1, 6)).isin(*kinds) & (field(13, 4) == atom) & field(17, 1).isin("", "A"))
    numbers = [field(31 + 8 * k, 8).try_cast("double").alias(c) for k, c in enumerate("xyz")]
    return rows.select("pid", "model", field(22, 1).alias("chain"), field(23, 4).try_cast("bigint").alias("seq_id"), field(18, 3).alias("mon_id"), field(7, 5).try_cast("bigint").alias("atom_id"), *numbers)


def read_pdb(spark: SparkSession, path: str, pattern: str = "*.pdb", **options) -> DataFrame:
    """`parse_pdb` of files."""
    return parse_pdb(read_files(spark, path, pattern), **options)


def parse_xyz(files: DataFrame, atom: str | None = None) -> DataFrame:
    """Plain coordinate files (a count, a comment, then name x y z; several frames one after another), in the columns of `parse_pdb`."""
    # A frame begins where a line is nothing but a count; its comment is the line after it.
    parts = files.select("pid", F.posexplode(F.filter(F.split("text", r"(?m)^(?=[ \t]*\d+[ \t]*\r?$)"), lambda p: F.trim(p) != "")).alias("frame", "part"))
    lines = parts.select("pid", (F.col("frame") + 1).cast("long").alias("model"), F.posexplode(F.slice(F.split("part", "\r?\n"), 3, 1 << 30)).alias("no", "line"))
    cells = F.split(F.trim("line"), r"\s+")
    rows = lines.select("pid", "model", "no", cells.alias("c")).filter(F.size("c") >= 4)
    if atom is not None:
        rows = rows.filter(F.get("c", F.lit(0)) == atom)
    numbers = [F.get("c", F.lit(k + 1)).try_cast("double").alias(x) for k, x in enumerate("xyz")]
    n = (F.col("no") + 1).cast("long")
    return rows.select("pid", "model", F.lit("A").alias("chain"), n.alias("seq_id"), F.lit("UNK").alias("mon_id"), n.alias("atom_id"), *numbers)


def parse_traces(files: DataFrame, atom: str = "CA", hetero: bool = False) -> DataFrame:
    """Coordinates of files of any of the three formats, told by their text: mmCIF has loop_, plain ones begin with a count."""
    kind = F.when(F.col("text").rlike(r"(?m)^\s*loop_"), "cif").when(F.col("text").rlike(r"\A\s*\d+[ \t]*\r?\n"), "xyz").otherwise("pdb")
    told = files.select("pid", "text", kind.alias("kind"))
    rows = parse_files(told.filter("kind = 'cif'")).select("pid", F.inline("atoms"))
    kinds = ["ATOM", "HETATM"] if hetero else ["ATOM"]
    rows = rows.filter(F.col("A_group_PDB").isin(*kinds) & (F.col("A_label_atom_id") == atom))
    number = lambda c, t, to: F.col(c).try_cast(t).alias(to)
    cif = rows.select("pid", number("A_pdbx_PDB_model_num", "bigint", "model"), F.col("A_label_asym_id").alias("chain"), number("A_label_seq_id", "bigint", "seq_id"), F.col("A_label_comp_id").alias("mon_id"), number("A_id", "bigint", "atom_id"), *[number(f"A_Cartn_{c}", "double", c) for c in "xyz"])
    return cif.unionByName(parse_pdb(told.filter("kind = 'pdb'"), atom, hetero)).unionByName(parse_xyz(told.filter("kind = 'xyz'"), atom))
