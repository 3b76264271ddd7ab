"""Rule tables. They must be these for compatible results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Motif id -> rank, category, colour.
RANK = {1: 4, 2: 11, 3: 9, 4: 6, 5: 7, 6: 5, 7: 13, 8: 12, 9: 14, 10: 8, 11: 14, 12: 10, 13: 3, 14: 3, 15: 2, 16: 2, 17: 1, 18: 1, 19: 14, 20: 15}
CATEGORY = {1: "NBARC", 2: "NBARC", 3: "NBARC", 4: "NBARC", 5: "NBARC", 6: "NBARC", 7: "LINKER", 8: "LINKER", 9: "LRR", 10: "NBARC", 11: "LRR", 12: "NBARC", 13: "TIR", 14: "NA", 15: "TIR", 16: "CC", 17: "CC", 18: "TIR", 19: "LRR", 20: "NA"}
COLOUR = {
    1: "0,255,255", 2: "0,0,255", 3: "255,0,0", 4: "255,0,255", 5: "255,255,0", 6: "0,255,0", 7: "0,128,128", 8: "68,68,68", 9: "0,128,0", 10: "192,192,192",
    11: "128,0,128", 12: "128,128,0", 13: "0,0,128", 14: "128,0,0", 15: "255,255,255", 16: "0,255,255", 17: "0,0,255", 18: "255,0,0", 19: "255,0,255", 20: "255,255,0",
}
# Consensus sequences of the NB-ARC motifs.
CONSENSUS = {
    1: "PIWGMGGVGKTTLARAVYNDP", 2: "LKPCFLYCAIFPEDYMIDKNKLIWLWMAE", 3: "CGGLPLAIKVWGGMLAGKQKT", 4: "YLVVLDDVWDTDQWD", 5: "NGSRIIITTRNKHVANYMCT", 6: "HFDCRAWVCVSQQYDMKKVLRDIIQQVGG",
    10: "LSHEESWQLFHQHAF", 12: "IMPVLRLSYHHLPYH",
}
# Seed combinations and signatures.
SEEDS = ((1, 6, 4), (6, 4, 5), (4, 5, 10), (5, 10, 3), (10, 3, 12), (3, 12, 2), (1, 4, 5), (12, 2, 8), (2, 8, 7), (18, 15, 13), (1, 6))
SIGNATURES = ((17, 16), (1, 6), (1, 6, 4), (6, 4, 5), (4, 5, 10), (5, 10, 3), (10, 3, 12), (3, 12, 2), (12, 2, 8), (2, 8, 7), (8, 7, 9), (7, 9, 11), (9, 11), (11, 9), (18, 15), (15, 13), (13, 1), (1, 4, 5))
# Amino acids of the 64 codons in the order of the bases A, C, G, T; thresholds on p-values.
CODONS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
CANDIDATE_P, ACCEPT_P = 1e-4, 1e-5

P_LOOP = 1
LRR = tuple(i for i, c in CATEGORY.items() if c == "LRR")
NBARC_ORDER = tuple(sorted((i for i, c in CATEGORY.items() if c == "NBARC"), key=RANK.get))


def lookup(values: dict, motif_id: Column) -> Column:
    """The rule of a motif as a column; null for an id without one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), motif_id)


def codon_table() -> dict[str, str]:
    return {a + b + c: CODONS[16 * i + 4 * j + k] for i, a in enumerate("ACGT") for j, b in enumerate("ACGT") for k, c in enumerate("ACGT")}


def motif_rules(spark: SparkSession) -> DataFrame:
    """The dimension table (motif_id, rank, category, rgb, consensus)."""
    rows = [(i, RANK[i], CATEGORY[i], COLOUR[i], CONSENSUS.get(i)) for i in RANK]
    return spark.createDataFrame(rows, "motif_id int, rank int, category string, rgb string, consensus string")
