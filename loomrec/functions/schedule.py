"""Learning-rate schedule and batch sizes."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """Linear warm-up, then a half cosine; kind "cosine" has no warm-up."""

    total: int
    warmup: int = 200
    start: float = 1e-8
    peak: float = 3e-4
    least: float = 1e-6
    kind: str = "cosine_with_warmup"

    def __post_init__(self) -> None:
        if self.kind not in ("cosine_with_warmup", "cosine"):
            raise ValueError(f"unknown schedule {self.kind}")

    @property
    def rise(self) -> int:
        return 0 if self.kind == "cosine" else self.warmup

    def rate(self, step: Column) -> Column:
        progress = F.least((step - self.rise) / F.lit(float(max(1, self.total - self.rise))), F.lit(1.0))
        falling = self.least + (self.peak - self.least) * 0.5 * (1 + F.cos(math.pi * progress))
        rising = self.start + (self.peak - self.start) * step / F.lit(float(max(1, self.rise)))
        return F.when(step < self.rise, rising).otherwise(falling)


class Position:
    """A place in a schedule, which moves a step at a time and can be saved and restored."""

    def __init__(self, schedule: Schedule, step: int = 0) -> None:
        self.schedule = schedule
        self.step = step
        #: The rate that is in force: the first one before any step, then that of the last call of advance.
        self.last = self.rate

    @property
    def rate(self) -> float:
        s = self.schedule
        if self.step < s.rise:
            return s.start + (s.peak - s.start) * self.step / max(1, s.rise)
        progress = min(1.0, (self.step - s.rise) / max(1, s.total - s.rise))
        return s.least + (s.peak - s.least) * 0.5 * (1 + math.cos(math.pi * progress))

    def advance(self) -> float:
        """The rate of this step, which comes into force; the place moves on behind it."""
        self.last = self.rate
        self.step += 1
        return self.last

    def state(self) -> dict[str, object]:
        return {"step": self.step, **asdict(self.schedule)}

    @classmethod
    def restored(cls, state: dict[str, object]) -> Position:
        rest = dict(state)
        return cls(step=int(rest.pop("step")), schedule=Schedule(**rest))


@dataclass(frozen=True)
class CodebookConfig:
    """What a quantizer's training takes; values that can't work are errors. The defaults are fixed values of a standard run."""

    levels: int = 3
    size: int = 256
    width: int = 32
    hidden: tuple[int, ...] = (512, 256, 128)
    normalize: bool = False
    beta: float = 0.1
    batch: int = 32_768
    epochs: int = 20_000
    schedule: str = "cosine_with_warmup"
    start: float = 1e-8
    warmup: int = 200
    peak: float = 3e-4
    least: float = 1e-6
    clip: float | None = 1.0
    kmeans: bool = True
    starts: int = 10
    reset_every: int = 2
    least_usage: float = 1.0
    dominance: float = 0.5
    val_share: float = 0.05
    val_every: int = 1
    save_every: int = 500
    seed: int = 0

    def __post_init__(self) -> None:
        positive = (self.levels, self.size, self.width, self.starts, self.batch, self.epochs, self.val_every, self.save_every, *self.hidden)
        if min(positive) < 1 or self.beta < 0 or not 0 < self.dominance <= 1 or not 0 < self.val_share < 1 or self.reset_every < 0 or (self.clip is not None and self.clip <= 0):
            raise ValueError(f"impossible settings: {self}")
        Schedule(1, kind=self.schedule)

    def state(self) -> dict[str, object]:
        return asdict(self) | {"hidden": list(self.hidden)}

    @classmethod
    def restored(cls, state: dict[str, object]) -> CodebookConfig:
        return cls(**(state | {"hidden": tuple(state["hidden"])}))


@dataclass(frozen=True)
class WarmupConfig:
    """The first stage's sample; weights of four bits can't be merged at the end, so they must be saved on the way."""

    rows: int = 20_000
    seed: int = 0
    grounding_only: bool = False
    four_bit: bool = False
    save_steps: int | None = None

    def __post_init__(self) -> None:
        if self.four_bit and not self.save_steps:
            raise ValueError("four_bit needs save_steps")


def adaptive_batch_size(length: Column, base: int = 64, reference: int = 512) -> Column:
    """base up to the reference length, then fewer by the square of the ratio, one at least."""
    ratio = F.lit(float(reference)) / length
    return F.when(length <= reference, F.lit(base)).otherwise(F.greatest(F.lit(1), F.floor(base * ratio * ratio))).cast("int")
