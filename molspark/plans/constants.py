"""Fixed values of the assay that the registered queries use."""

ANCHOR = "GGCACACTGTCCT"
START, END = "GAGACTGCATGG", "TTTAGTGAGGGT"
METAS = {"META01": "AGAAGCCGTGTGCCGGTCTA", "META02": "ATCGTGCGGACGAGACAGCA", "META03": "AATCCTAGCACCGGTTCGCC"}
#: target -> (left flank, right flank)
EDITED = {"RNF2": ("CATCTTAGTCATTAC", "GACAGGTGTTCGTTG"), "HEK3": ("CAGACTGAGCACG", "ACTTGGCAGAGGAAAGGAAGCCCTGCTTCCTCCAGA")}
INT_ANCHOR1, INT_ANCHOR2 = "GAGACTGCATGG", "AGAAGCCGTG"
SCAFFOLD = "GTTTAAGAGC"
