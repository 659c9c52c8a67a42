"""Schedules, buckets, losses and flow arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


#: The range of sigmas and the number of training timesteps.
LOW_SIGMA, HIGH_SIGMA, TIMESTEPS = 0.003 / 1.002, 1.0, 1000


def even_sigma(i: Column, steps: Column, high: float = HIGH_SIGMA, low: float = LOW_SIGMA, open_end: bool = False, rising: bool = False) -> Column:
    """The i-th of `steps` sigmas from high to low, or to just above low; rising: in the order from low to high."""
    at = steps - 1 - i if rising else i
    return high - at * ((high - low) / F.greatest(steps if open_end else steps - 1, F.lit(1)))


def shifted(sigma: Column, shift: float) -> Column:
    return shift * sigma / (1 + (shift - 1) * sigma)


def exponentially_shifted(sigma: Column, mu: Column) -> Column:
    return F.exp(mu) / (F.exp(mu) + (1 / sigma - 1))


def ending_at(sigma: Column, last: Column, terminal: float) -> Column:
    """Sigmas stretched so that the last of them becomes `terminal`; last: the last one's value."""
    return 1 - (1 - sigma) / ((1 - last) / (1 - terminal))


def interpolated_shift(length: Column, base_length: int = 256, most_length: int = 8192, base: float = 0.5, most: float = 0.9) -> Column:
    slope = (most - base) / (most_length - base_length)
    return length * slope + (base - slope * base_length)


def bell(timestep: Column, steps: Column) -> Column:
    """A Gaussian bell over timesteps, before its least is taken off and the rest scaled."""
    return F.exp(-2 * F.pow((timestep - steps / 2) / steps, 2))


def bell_weights(bells: Column, steps: Column, schedule: WindowSpec) -> Column:
    """The bells of a schedule less the least of them, adding up to the number of steps; null if all are equal."""
    above = bells - F.min(bells).over(schedule)
    return F.try_divide(above * steps, F.sum(bells).over(schedule) - steps * F.min(bells).over(schedule))


def relative_bucket(distance: Column, buckets: int = 32, most: int = 128) -> Column:
    """Of a signed distance: half the buckets for each sign; half of these exact, the others logarithmic up to `most`."""
    half = buckets // 2
    exact = half // 2
    far = F.least(F.lit(half - 1), exact + F.floor(F.round(F.log(F.abs(distance) / exact) / math.log(most / exact) * (half - exact), 9)))
    return (F.when(distance > 0, half).otherwise(0) + F.when(F.abs(distance) < exact, F.abs(distance)).otherwise(far)).cast("long")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit_loss(z: Column, y: Column) -> Column:
    """Binary cross entropy of a logit, stable for large ones."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def euler_step(x: Column, velocity: Column, now: Column, then: Column) -> Column:
    return x + velocity * (then - now)


def stepped_by(x: Column, sigmas: list[float], velocity: Callable[[Column, Column], Column], step: Callable[[Column, Column, Column, Column], Column] = euler_step) -> Column:
    """A value led through a schedule by hooks: velocity(x, now) at each time, and step(x, velocity, now, then) to the next."""
    for now, then in zip(sigmas, sigmas[1:]):
        x = step(x, velocity(x, F.lit(float(now))), F.lit(float(now)), F.lit(float(then)))
    return x


def add_noise(x: Column, noise: Column, sigma: Column) -> Column:
    return (1 - sigma) * x + sigma * noise


def guided(free: Column, conditioned: Column, scale: float) -> Column:
    return free + scale * (conditioned - free)


def to_byte(x: Column, scale: bool = True, truncate: bool = False) -> Column:
    """A value of [0, 1] as 0 to 255, rounded half to even or cut off."""
    return (F.floor if truncate else F.rint)(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * (255 if scale else 1)).cast("long")


def to_byte_by_range(x: Column, greatest: Column) -> Column:
    """Values of an image whose greatest is 1 or less are scaled; all are clipped to bytes."""
    return F.floor(F.least(F.greatest(F.when(greatest <= 1, x * 255).otherwise(x), F.lit(0.0)), F.lit(255.0))).cast("long")


def sinusoid(position: Column, size: int) -> Column:
    """Cosines of the position at size / 2 frequencies, then the sines."""
    half = size // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: position * F.pow(F.lit(10000.0), -i / half))
    return F.concat(F.transform(angles, F.cos), F.transform(angles, F.sin))
