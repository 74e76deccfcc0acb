"""Learning-rate schedules and other small formulas, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_decay(epoch: Column, start: float, factor: float, every: int) -> Column:
    """F17."""
    return F.lit(start) * F.pow(F.lit(factor), F.floor((epoch + 1) / every))


def polynomial_decay(epoch: Column, start: float, epochs: int, power: float = 1.0) -> Column:
    """F18."""
    return F.lit(start) * F.pow(1 - epoch / epochs, F.lit(power))


def cosine_restarts(epoch: Column, start: float, epochs: int, cycles: int) -> Column:
    """the epochs in cycles of epochs // cycles, each from the start rate down towards 0."""
    length = epochs // cycles
    return F.lit(start / 2) * (F.cos(F.pmod(epoch, F.lit(length)) * (math.pi / length)) + 1)


def snapshot_after(epoch: Column, epochs: int, cycles: int) -> Column:
    """The number of the snapshot taken after an epoch, else null."""
    length = epochs // cycles
    return F.when((epoch != 0) & ((epoch + 1) % length == 0), F.floor((epoch + 1) / length))


def scaled_dropout(rate: Column, factor: Column) -> Column:
    """F21."""
    return F.when(factor > 1, 1 - (1 - rate) / factor).otherwise(rate * factor)
