"""Parameters of a linkage run."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass


@dataclass(frozen=True)
class LinkConfig:
    # Defaults of the linkage semantics.
    top_k: int = 15
    cap_fraction: float = 0.0002
    cap_floor: int = 20
    pool: int = 600
    address_k: int = 5
    address_k_crowded: int = 15
    crowded: int = 10
    reverse_k: int = 3
    name_share: float = 0.05
    address_share: float = 0.03
    name_core: int = 6
    address_core: int = 8
    floor: float = 0.05
    threshold: float = 0.5
    low: float = 0.005
    high: float = 0.995
    hold: float = 0.15
    hold_from: float = 0.7
    train_to: float = 0.45
    alias_count: int = 50
    alias_precision: float = 0.5
    alias_typo: float = 0.75
    alias_synonym: float = 0.7
    alias_rarity: float = 0.05
    keep_easy: int = 1_500_000
    learn_pairs: int = 600_000
    # Parameters of reports and samples.
    sample: int = 50
    batch: int = 256
    report: int = 20
    countries: tuple[str, ...] = ("de", "fr")


_now: ContextVar[LinkConfig] = ContextVar("linkloom_config", default=LinkConfig())


class Current:
    """The configuration under which a plan is rendered."""

    def __getattr__(self, name: str):
        return getattr(_now.get(), name)


DEFAULT = Current()


@contextmanager
def using(config: LinkConfig):
    token = _now.set(config)
    try:
        yield config
    finally:
        _now.reset(token)
