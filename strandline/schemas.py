"""Explicit schemas of every table the engine reads or writes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_S, _L, _I, _D = StringType(), LongType(), IntegerType(), DoubleType()


def _of(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


#: Raw atom records as the text has them.
ATOM_SITE = _of(A_group_PDB=_S, A_id=_S, A_label_atom_id=_S, A_label_comp_id=_S, A_label_asym_id=_S, A_label_seq_id=_S, A_Cartn_x=_S, A_Cartn_y=_S, A_Cartn_z=_S, A_occupancy=_S, A_pdbx_PDB_model_num=_S)
#: The residue numbering scheme of the polymers.
POLY_SEQ = _of(S_seq_id=_S, S_mon_id=_S, S_pdb_seq_num=_S, S_asym_id=_S)
#: One row for each chain, model and residue.
CA_ATOMS = _of(pid=_S, chain=_S, pidc=_S, A_pdbx_PDB_model_num=_L, S_seq_id=_L, S_mon_id=_S, A_label_atom_id=_S, A_id=_L, A_Cartn_x=_D, A_Cartn_y=_D, A_Cartn_z=_D)
SSV = _of(A_pdbx_PDB_model_num=_L, S_seq_id=_L, S_mon_id=_S, A_id=_L, A_Cartn_x=_D, A_Cartn_y=_D, A_Cartn_z=_D)
MEAN_COORDS = _of(pidc=_S, S_mon_id=_S, S_seq_id=_L, A_id=_L, mean_x=_D, std_x=_D, mean_y=_D, std_y=_D, mean_z=_D, std_z=_D)
HITS = _of(query=_S, target=_S, evalue=_D, pident=_D, alnlen=_I, qcov=_D, tcov=_D)
CHAIN_STATS = _of(Pidc=_S, CA_count=_I, model_count=_I, minRMSD=_D, maxRMSD=_D, meanRMSD=_D, stdevRMSD=_D, minTMS=_D, maxTMS=_D, meanTMS=_D, stdevTMS=_D, homologues=ArrayType(_S))
ENTRY_STATS = _of(Pid=_S, head=_S, all_chains=ArrayType(_S), hethom=_S, year=_I, all_prot_only_chains=ArrayType(_S))
MATRIX = _of(pidc=_S, i=_I, j=_I, value=_D)
CLUSTERS = _of(pidc=_S, clusters=MapType(_I, ArrayType(_I)))
CONFORMERS = StructType([StructField("Protein name", _S), StructField("Conformers", ArrayType(_S)), StructField("Family", _S)])
FRAMES = _of(domain=_S, temperature=_I, replica=_I, frame=_I, rmsd=_D, gyration_radius=_D)
RESIDUES = _of(domain=_S, temperature=_I, replica=_I, residue=_I, rmsf=_D)
DSSP = _of(domain=_S, temperature=_I, replica=_I, frame=_I, residue=_I, code=_S)
ENTRY_META = _of(pid=_S, method=_S, protein_entities=_I, protein_instances=_I, score=_D, deposition=DateType(), title=_S)
