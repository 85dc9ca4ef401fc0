"""Point-in-time panels and ranking audits as Spark DataFrame programs."""

from tidemark.config import PanelSpec, SplitSpec

__all__ = ["PanelSpec", "SplitSpec"]
