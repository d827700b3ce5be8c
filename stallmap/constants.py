"""Fixed values of the method. They must stay as they are for results to be right."""

#: First-stage alphas, loose to strict, and the two-sided normal quantile of each.
ALPHAS = (0.2, 0.15874, 0.12599, 0.1, 0.07937, 0.062996, 0.05)
Z_VALUES = (1.2815515655446008, 1.4093219202393654, 1.5301079934299415, 1.6448536269514715, 1.7543532304276743, 1.8592197251274092, 1.9599639845400536)

MIN_COVERAGE = 6
MIN_STOP_FRACTION = 0.05
RESCUE_DIFFERENCE = 0.1
BACKGROUND_STOP = 0.025
BISECT_TOLERANCE = 0.001
BISECT_STEPS = 17
THREE_PRIME_ZONE = 3
WINDOW = 10
FLANK = 50
SHOWN_FLANK = 10
UPSTREAM = 60
MOTIF_MIN = 11
TARGET_FDR = 0.015
COVERAGE_CHANGE = 0.1

#: A motif is four G tracts with three loops between them, and ends at the 3' end looked at. For each kind
#: its class (1 is best), its tracts 5' to 3', and the least and greatest length of its loops. A tract is (length, bulge):
#: so many Gs, split after the first or before the last by 1 to `bulge` bases other than G unless bulge is 0.
_PLAIN, _SHORT, _SMALL, _LARGE = (3, 0), (2, 0), (3, 1), (3, 7)
MOTIF_KINDS = (
    (1, (_PLAIN, _PLAIN, _PLAIN, _PLAIN), ((1, 7), (1, 7), (1, 7))),
    (2, (_PLAIN, _PLAIN, _PLAIN, _PLAIN), ((8, 12), (1, 7), (1, 7))),
    (2, (_PLAIN, _PLAIN, _PLAIN, _PLAIN), ((1, 7), (1, 7), (8, 12))),
    (2, (_PLAIN, _PLAIN, _PLAIN, _PLAIN), ((1, 7), (8, 21), (1, 7))),
    (3, (_SMALL, _SMALL, _SMALL, _SMALL), ((1, 9), (1, 9), (1, 9))),
    (3, (_LARGE, _PLAIN, _PLAIN, _PLAIN), ((1, 9), (1, 9), (1, 9))),
    (3, (_PLAIN, _LARGE, _PLAIN, _PLAIN), ((1, 9), (1, 9), (1, 9))),
    (3, (_PLAIN, _PLAIN, _LARGE, _PLAIN), ((1, 9), (1, 9), (1, 9))),
    (3, (_PLAIN, _PLAIN, _PLAIN, _LARGE), ((1, 9), (1, 9), (1, 9))),
    (4, (_SHORT, _SHORT, _SHORT, _SHORT), ((1, 9), (1, 9), (1, 9))),
)
MOTIF_CLASSES = {1: "canonical/G3L1-7", 2: "longloop", 3: "bulges", 4: "two-quartet"}

#: Names of the report's columns; three follow for each annotation.
REPORT_COLUMNS = ("chromosome", "start", "end", "rG4_structural_class", "avg_sequencing_coverage", "strand", "rG4_intervals", "splicing", "sequence_diagram")
ANNOTATION_COLUMNS = ("gene_names", "transcript_ids", "coding_regions")
PICTURE_LABEL = "rG4seq-"

K_REPLICATES, KPDS_REPLICATES = (1, 2, 3, 4), (10, 20, 30, 40)


def motif_pattern(tracts: tuple, loops: tuple) -> str:
    """A motif kind as a regular expression over a window that ends at the 3' end."""

    def tract(n: int, bulge: int) -> str:
        if not bulge:
            return "G" * n
        return f"(?:G[ATCN]{{1,{bulge}}}{'G' * (n - 1)}|{'G' * (n - 1)}[ATCN]{{1,{bulge}}}G)"

    parts = [tract(*tracts[0])]
    for (low, high), following in zip(loops, tracts[1:]):
        parts.append(f"[ATCGN]{{{low},{high}}}{tract(*following)}")
    return "".join(parts) + "$"
