"""Sizes of images and windows, all in exact arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_multiple(x: Column, factor: int, how: str = "round") -> Column:
    """The nearest multiple (half to even), or the next below or above."""
    q = x / factor
    return ({"round": F.rint, "floor": F.floor, "ceil": F.ceil}[how](q) * factor).cast("long")


def budget_size(h: Column, w: Column, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> tuple[Column, Column]:
    """(height, width) in multiples of the factor, with the number of pixels within the budget and the ratio about kept.  Fails on sizes
    more than 200 times as long as wide, or the reverse."""
    sound = F.greatest(h, w) / F.least(h, w) <= 200
    h = F.when(sound, h).otherwise(F.raise_error(F.concat(F.lit("ratio above 200: "), h.cast("string"), F.lit(" x "), w.cast("string"))).cast("long"))
    rh, rw = F.greatest(F.lit(factor), to_multiple(h, factor)), F.greatest(F.lit(factor), to_multiple(w, factor))
    shrink, grow = F.sqrt(h * w / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (h * w))
    small = [to_multiple(x / shrink, factor, "floor") for x in (h, w)]
    large = [to_multiple(x * grow, factor, "ceil") for x in (h, w)]
    return tuple(F.when(rh * rw > most, s).when(rh * rw < least, g).otherwise(r) for s, g, r in zip(small, large, (rh, rw)))


def letterbox(h: Column, w: Column, to_h: int, to_w: int) -> dict[str, Column]:
    """Size and offsets of an image fitted into a frame, centred."""
    scale = F.least(F.lit(float(to_h)) / h, F.lit(float(to_w)) / w)
    new_h, new_w = F.floor(h * scale).cast("long"), F.floor(w * scale).cast("long")
    return {"new_h": new_h, "new_w": new_w, "top": F.floor((F.lit(to_h) - new_h) / 2).cast("long"), "left": F.floor((F.lit(to_w) - new_w) / 2).cast("long")}


def best_size(h: Column, w: Column, dh: int, dw: int, area: int) -> tuple[Column, Column]:
    """Of two sizes in steps (dh, dw) within the area, one rounded by width first and one by height first, that whose ratio is nearer."""
    ratio = w / h
    ow, oh = F.sqrt(area * ratio), F.lit(float(area)) / F.sqrt(area * ratio)
    w1 = F.floor(ow / dw) * dw
    h1 = F.floor(area / w1 / dh) * dh
    h2 = F.floor(oh / dh) * dh
    w2 = F.floor(area / h2 / dw) * dw
    off = [F.greatest(ratio / (a / b), (a / b) / ratio) for a, b in ((w1, h1), (w2, h2))]
    first = off[0] < off[1]
    return F.when(first, h1).otherwise(h2).cast("long"), F.when(first, w1).otherwise(w2).cast("long")


def sequence_length(frames: Column, h: Column, w: Column, patch: tuple[int, int], parts: int) -> Column:
    """Tokens of a latent video, filled up to a multiple of the parts."""
    return (F.ceil(F.ceil(h * w / (patch[0] * patch[1]) * frames) / parts) * parts).cast("long")


def frame_time(i: Column, fps: Column) -> Column:
    return i / fps


def stitched_size(head_h: Column, head_w: Column, wrists: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """Of one view above two views side by side: these are half the first one's height, or as high as the higher of `wrists`."""
    below = F.floor(head_h / 2) if wrists is None else F.greatest(*wrists)
    return (head_h + below).cast("long"), head_w


def stitched_parts(head_h: Column, head_w: Column) -> dict[str, Column]:
    """Where the parts of a stitched frame lie: the row of the lower two, and the column of the right one with its width."""
    split = F.floor(head_w / 2).cast("long")
    return {"row": head_h, "split": split, "right_w": head_w - split}


def announced_size(h: Column, w: Column) -> tuple[Column, Column]:
    """The size a converter announces for a stitched frame, one and a half times as wide, though the frame is that much higher."""
    return h, F.floor(w * 1.5).cast("long")