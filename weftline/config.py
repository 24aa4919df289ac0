"""Parameters of an assembly run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AssemblyConfig:
    """Defaults follow the published command line; see README for the two modes."""

    mode: str = "intended"  # "intended" or "compat"
    delimiter: str = "_"
    hanging_out: int = 80
    filter_chimeras: bool = False
    chimera_slack: int = 300
    rounds: int = 3
    split_sd: int = 1000
    back_window: int = 4
    end_window: int = 15
    min_links: int = 3
    link_strength: int = 10
    read_thresholds: tuple[float, float, int] = (200.0, 800.0, 50)
    contig_thresholds: tuple[float, float, int] = (500.0, 2000.0, 100)
    min_layout_reads: int = 3
    block_width: int = 12000
    block_overlap: int = 600
    join_min_score: int = 40
    divided_share: float | None = None  # of a read's link weight against its direction that sets it aside, such as 0.25; None keeps all
    edge_use: str | None = None  # "both" or "visit_order"; None picks by mode
    scale: "ScaleBounds" = field(default_factory=lambda: ScaleBounds())

    def __post_init__(self):
        if self.mode not in ("intended", "compat"):
            raise ValueError(f"unknown mode {self.mode!r}")

    @property
    def compat(self) -> bool:
        return self.mode == "compat"

    @property
    def equations_from(self) -> str:
        return self.edge_use or ("visit_order" if self.compat else "both")


@dataclass(frozen=True)
class ScaleBounds:
    """Largest piece of work one Python task may receive.

    Whatever exceeds a bound takes the distributed route; nothing is dropped.
    """

    finish_edges: int = 50_000     # contracted edges one task may finish
    vote_edges: int = 200_000      # summed links one task may merge
    slice_nodes: int = 1024        # unknowns eliminated by one task
    finish_rows: int = 200_000     # rows of a reduced system one task may finish
    chain_reads: int = 512         # reads split by one task
    poa_depth: int = 64            # slices aligned in one consensus task
