"""Settings of a search."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SearchOptions:
    """Defaults of a search. The statistics do not follow the matrix or the gap costs; set them together."""

    matrix: str = "BLOSUM62"
    matrix_dir: str | None = None
    gap_open: int = 11
    gap_extend: int = 1
    lambda_: float = 0.267
    kappa: float = 0.041
    entropy: float = 0.140
    min_length: int = 5
    min_score: int = 1
    seeds: int = 300_000
    alignments: int = 5_000
    hits: int = 100
    evalue: float = 1e-3
    mask: bool = True
    #: Drop alignments whose score does not fit into 16 bits, as a search with short counters does.
    saturation: bool = False

    def __post_init__(self) -> None:
        if self.min_length < 3:
            raise ValueError("min_length must be at least 3")
        if self.alignments < 0 or self.seeds < 0 or self.hits < 0:
            raise ValueError("alignments, seeds and hits must not be negative")
        if self.gap_open < self.gap_extend or self.gap_extend < 0:
            raise ValueError("gap_open must not be below gap_extend")

    def fast(self) -> SearchOptions:
        """Fewer seeds and alignments, slightly less sensitive."""
        return replace(self, seeds=100_000, alignments=1_500)


#: HSPs below this score are not aligned.
MIN_HSP_TO_ALIGN = 40
#: The largest score that fits into 16 bits.
SATURATED = 32_767
#: Residues an HSP is extended to either side.
EXTENSION = 128
#: Queries longer than this keep 1.5 x hits proteins only.
LONG_QUERY = 3_000
