"""Constants that are semantics, in one frozen object that every stage takes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Experiment:
    """An image window and a forecast horizon, in rows."""

    name: str
    window: int
    horizon: int


EXPERIMENTS = (Experiment("I5R5", 5, 5), Experiment("I20R5", 20, 5), Experiment("I60R5", 60, 5), Experiment("I20R20", 20, 20), Experiment("I60R20", 60, 20))


@dataclass(frozen=True)
class EngineConfig:
    start: dt.date = dt.date(2009, 1, 1)
    end: dt.date = dt.date(2024, 12, 31)
    train_end: dt.date = dt.date(2019, 12, 31)
    valid_start: dt.date = dt.date(2020, 1, 1)
    valid_end: dt.date = dt.date(2020, 12, 31)
    test_start: dt.date = dt.date(2021, 1, 1)
    experiments: tuple[Experiment, ...] = EXPERIMENTS
    embargo: dict[int, int] = field(default_factory=lambda: {5: 5, 20: 20})
    min_list_days: int = 120
    min_amount: float = 20_000_000.0
    low_volume_ratio: float = 0.10
    limit_default: float = 9.8
    limit_wide: float = 19.8
    limit_st: float = 4.8
    wide_always: tuple[str, ...] = ("688",)
    wide_since: tuple[str, ...] = ("300", "301")
    wide_date: dt.date = dt.date(2020, 8, 24)
    return_windows: tuple[int, ...] = (1, 3, 5, 10, 20, 25, 60)
    ma_windows: tuple[int, ...] = (5, 10, 20, 30, 60, 120, 250)
    position_windows: tuple[int, ...] = (5, 20, 60)
    vol_windows: tuple[int, ...] = (20, 60)
    deciles: int = 10
    costs_bps: tuple[float, ...] = (0.0, 10.0, 25.0, 50.0, 100.0)
    days_per_year: int = 252
    low_coverage: float = 0.95
    check_tolerance: float = 1e-6
    folds: int = 5
    purge_days: int = 20
    pad_missing_returns: bool = True
    day_width: int = 3
    white: int = 255

    @property
    def horizons(self) -> tuple[int, ...]:
        return tuple(sorted({e.horizon for e in self.experiments}))

    @property
    def windows(self) -> tuple[int, ...]:
        return tuple(sorted({e.window for e in self.experiments}))

    def horizons_of_window(self, window: int) -> tuple[int, ...]:
        """One image serves all horizons of its window."""
        return tuple(sorted({e.horizon for e in self.experiments if e.window == window}))

    def select(self, names: str | None) -> tuple[Experiment, ...]:
        """Experiments by a comma-separated list (all if empty); an unknown name is an error."""
        if not names:
            return self.experiments
        known = {e.name: e for e in self.experiments}
        wanted = [n.strip() for n in names.split(",") if n.strip()]
        if missing := [n for n in wanted if n not in known]:
            raise ValueError(f"unknown experiments: {missing}; known: {sorted(known)}")
        return tuple(known[n] for n in wanted)


#: Image heights of the windows; other windows take the last.
HEIGHTS = {5: 32, 20: 64, 60: 96}


def image_shape(window: int, day_width: int = 3) -> tuple[int, int, int, int]:
    """(height, width, price rows, volume rows) of a window's image: four fifths for prices, one row between."""
    height = HEIGHTS.get(window, 96)
    price = round(height * 4 / 5)
    return height, window * day_width, price, height - price
