"""Reference dimensions. All values in this file are fixed values of the file formats and of published radii."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "HSD": "H", "HSP": "H", "HSE": "H",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
NUCLEIC = {"DA": "a", "DC": "c", "DT": "t", "DG": "g", "A": "a", "C": "c", "T": "t", "G": "g", "U": "u"}
IONS = ["MG", "ZN", "FE", "NA", "CL", "K", "CA", "MN", "AL", "AU", "AG", "CU"]
OTHER = ["SO4", "PO4", "ATP", "ADP", "NAD"]
WATER = ["HOH", "HHO", "OHH", "SOL"]
RADII = {
    "H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "NA": 2.27, "MG": 1.73, "SI": 2.10, "P": 1.80, "S": 1.80, "CL": 1.75, "K": 2.75,
    "CU": 1.40, "ZN": 1.39, "SE": 1.90, "BR": 1.85, "I": 1.98, "MN": 2.05, "AL": 1.84, "AU": 1.66, "FE": 1.94, "CA": 2.31, "AG": 2.03,
}
PHOSPHO = {"PTR": "TYR", "NEP": "HIS", "HIP": "HIS", "SEP": "SER", "TPO": "THR", "PHD": "ASP", "PTM": "TYR", "FTY": "TYR", "SBG": "SER", "SEN": "SER", "SGB": "SER", "SGX": "SER", "SGR": "SER", "4TP": "THR", "28X": "THR"}
ACETYL = {"AYA": "ALA", "TH5": "THR", "ALY": "LYS", "SAC": "SER", "OAS": "SER", "SCY": "CYS"}
METHYL = {"MLZ": "LYS", "MVA": "VAL", "MLE": "LEU", "MAA": "ALA", "MEA": "PHE", "0A9": "PHE", "MME": "MET", "4PH": "PHE", "SMC": "CYS", "CMT": "CYS", "HIC": "HIS", "AGM": "ARG", "IML": "ILE", "MLL": "LEU", "VME": "VAL", "MEN": "ASN", "OLT": "THR"}
MODIFICATIONS = {"Phosphorylation": PHOSPHO, "Acetylation": ACETYL, "Methylation": METHYL, "Selenomethionine": {"MSE": "MET"}}
PARENT = {name: parent for group in MODIFICATIONS.values() for name, parent in group.items()}
BACKBONE = ["N", "CA", "C", "O"]
SIDECHAIN = {
    "ALA": ["CB"],
    "ARG": ["CB", "CG", "CD", "NE", "CZ", "NH1", "NH2"],
    "ASN": ["CB", "CG", "OD1", "ND2"],
    "ASP": ["CB", "CG", "OD1", "OD2"],
    "ASX": ["CB", "CG", "XD1", "XD2"],
    "CYS": ["CB", "SG"],
    "GLN": ["CB", "CG", "CD", "OE1", "NE2"],
    "GLU": ["CB", "CG", "CD", "OE1", "OE2"],
    "GLX": ["CB", "CG", "CD", "XE1", "XE2"],
    "GLY": [],
    "HIS": ["CB", "CG", "ND1", "CD2", "CE1", "NE2"],
    "HSD": ["CB", "CG", "ND1", "CD2", "CE1", "NE2"],
    "HSP": ["CB", "CG", "ND1", "CD2", "CE1", "NE2"],
    "HSE": ["CB", "CG", "ND1", "CD2", "CE1", "NE2"],
    "ILE": ["CB", "CG1", "CG2", "CD1"],
    "LEU": ["CB", "CG", "CD1", "CD2"],
    "LYS": ["CB", "CG", "CD", "CE", "NZ"],
    "MET": ["CB", "CG", "SD", "CE"],
    "PHE": ["CB", "CG", "CD1", "CD2", "CE1", "CE2", "CZ"],
    "PRO": ["CB", "CG", "CD"],
    "SER": ["CB", "OG"],
    "THR": ["CB", "OG1", "CG2"],
    "TRP": ["CB", "CG", "CD1", "CD2", "NE1", "CE2", "CE3", "CZ2", "CZ3", "CH2"],
    "TYR": ["CB", "CG", "CD1", "CD2", "CE1", "CE2", "CZ", "OH"],
    "VAL": ["CB", "CG1", "CG2"],
}
EXPECTED_ATOMS = {name: BACKBONE + side for name, side in SIDECHAIN.items()}
#: The alphabet of marked sequences (with selenocysteine and unknown), and the counted alphabet of alignments.
LETTERS = "ACDEFGHIKLMNPQRSTVWYUX"
COUNTED = "ACDEFGHIKLMNPQRSTVWY"


def literal_map(table: dict) -> Column:
    """A small fixed table as a map literal."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(table: dict, key: Column) -> Column:
    """The value of a key in a small fixed table, or null."""
    return F.try_element_at(literal_map(table), key)
