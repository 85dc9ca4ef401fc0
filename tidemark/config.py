"""Settings shared by every operator: what the entity, the period and the label are called."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from tidemark.functions.periods import parse_quarter


@dataclass(frozen=True)
class SplitSpec:
    """Last period of each split. ``purge`` drops that many periods from the end of
    train and validation so that no label there reaches into the next split."""

    train_end: int
    validation_end: int
    test_end: int
    purge: int = 0

    @classmethod
    def quarters(cls, train: str, validation: str, test: str, purge: int = 0) -> SplitSpec:
        return cls(parse_quarter(train), parse_quarter(validation), parse_quarter(test), purge)


@dataclass(frozen=True)
class PanelSpec:
    window_start: int
    splits: SplitSpec
    entity: str = "company_uuid"
    period: str = "quarter_idx"
    unit: str = "quarter"
    lag: int = 1
    horizon: int = 8
    label: str = "realized_hard_timely_liquidity_by_horizon"
    asof_mode: str = "full_history"
    match_missing_country: bool = False
    carry: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def published(cls, **overrides) -> PanelSpec:
        """The window and split ends of the published benchmark."""
        return cls(
            window_start=parse_quarter("2010Q1"),
            splits=SplitSpec.quarters("2018Q4", "2021Q4", "2023Q4"),
            **overrides,
        )

    def fingerprint(self) -> str:
        """Names a stage table, so that changed settings never read an old one."""
        text = json.dumps(asdict(self), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]
