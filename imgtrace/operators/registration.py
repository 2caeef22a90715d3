"""Registration of movies: whole-frame offsets smoothed over frames, then offsets of blocks, and the same moves for a second channel.

Correlation surfaces are smoothed over neighbouring frames, so a plane's frames are dealt into ranges, and each range gets
the frames of a halo on both sides too: one exchange of frames, a little more than their own size. A range then goes
through all steps by itself, and the result does not hang on how long ranges are. A plane's reference image travels with
the first frame of each range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.operators.alignment import BlockTemplate, Grid, peaks, surface, template_spectrum
from imgtrace.operators.frames import lists, odd_rows_shifted, stacked, taper_mask, tapered, translated, warped

#: Frames that go through the Fourier transforms at a time.
AT_ONCE = 32


@dataclass(frozen=True)
class Steps:
    """What is done to frames: sizes, the rigid step, smoothing over frames, and blocks (without a grid: none)."""

    height: int
    width: int
    reach: int
    sigma: float = 1.15
    slope: float = 3.45
    in_time: float = 0.0
    clip: tuple[float, float] | None = (1.0, 99.0)
    odd_lines: int = 0
    grid: Grid | None = None
    most: float = 5.0
    least_clear: float = 1.2
    around: int = 3
    #: What correlations see instead of the frames (a high-pass, say); the frames that come out are moved, not filtered.
    prepare: Callable[[np.ndarray], np.ndarray] | None = None

    @property
    def halo(self) -> int:
        return int(4 * self.in_time + 0.5)

    def weights(self) -> np.ndarray:
        bell = np.exp(-0.5 * (np.arange(-self.halo, self.halo + 1) / (self.in_time or 1)) ** 2)
        return bell / bell.sum()


class Template:
    """A reference image as frames are held against it: clipped between two percentiles, as a spectrum, and its blocks."""

    def __init__(self, image: np.ndarray, steps: Steps):
        self.steps = steps
        self.low, self.high = np.percentile(image, steps.clip) if steps.clip else (-np.inf, np.inf)
        image = np.clip(image, self.low, self.high)
        self.mask, self.mean = taper_mask(*image.shape, steps.slope), image.mean()
        self.spectrum = template_spectrum(image, steps.sigma)
        self.blocks = BlockTemplate.of(image, steps.grid, steps.sigma, steps.slope) if steps.grid else None

    def surfaces(self, seen: np.ndarray) -> np.ndarray:
        clipped = np.clip(seen, self.low, self.high)
        return surface(tapered(clipped, self.mask, np.full(len(seen), self.mean)), self.spectrum, self.steps.reach)

    def block_offsets(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.blocks.offsets(np.clip(seen, self.low, self.high), self.steps.most, self.steps.least_clear, self.steps.around)


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places beyond 0 to n - 1 turned back at the ends, which are taken twice."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def smoothed_over_frames(surfaces: np.ndarray, first: int, wanted: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Weighted sums around the wanted frames of n; surfaces[0] is that of frame `first`."""
    half = len(weights) // 2
    out = np.zeros((len(wanted), *surfaces.shape[1:]))
    for k, w in zip(range(-half, half + 1), weights, strict=True):
        out += w * surfaces[mirrored(wanted + k, n) - first]
    return out


def _in_parts(f: Callable[..., np.ndarray | tuple], *stacks: np.ndarray) -> list:
    return [f(*(s[i : i + AT_ONCE] for s in stacks)) for i in range(0, len(stacks[0]), AT_ONCE)]


def register(frames: DataFrame, references: DataFrame, plane: str, frame: str, values: str, steps: Steps, second: str | None = None, span: int = 64) -> DataFrame:
    """plane, frame, dy, dx, correlation, block_dy, block_dx, block_peaks (empty without blocks), pixels, and second_pixels if wanted.

    Frames must be 0, 1, 2, ... in a plane. An offset says how far content has moved; frames are moved back, round the
    edges by whole pixels, then along the field between the blocks' offsets. Beyond a plane's ends the surfaces repeat as
    in a mirror. Planes without a reference give no rows.
    """
    h, w, halo = steps.height, steps.width, steps.halo
    channels = ["pixels", *(["second_pixels"] if second else [])]
    at = F.col(frame).cast("long")
    ranges = F.sequence(F.greatest(F.floor((at - halo) / span), F.lit(0)).cast("long"), F.floor((at + halo) / span).cast("long"))
    picked = frames.select(F.col(plane).cast("long").alias("plane"), at.alias("frame"), F.explode(ranges).alias("range"), *(F.col(c).cast("array<double>").alias(n) for c, n in zip([values, second], channels)))
    known = references.select(F.col(plane).cast("long").alias("plane"), F.col("reference").cast("array<double>").alias("reference"))
    lead = F.when(F.col("frame") == F.col("range") * span, F.col("reference"))  # once a range
    sent = picked.join(known, "plane").withColumn("reference", lead)
    blocks = ("block_dy", "block_dx", "block_peaks")
    schema = "plane long, frame long, dy long, dx long, correlation double, " + ", ".join(f"{c} array<double>" for c in (*blocks, *channels))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame").combine_chunks()
        numbers, begin = rows["frame"].to_numpy(), rows["range"][0].as_py() * span
        own = (numbers >= begin) & (numbers < begin + span)
        if not own.any():  # the halo of a plane's last frames reaches here, no frame lies here
            return pa.schema([pa.field(f.name, f.type) for f in empty]).empty_table()
        if (np.diff(numbers) != 1).any():
            raise ValueError("frames of a plane must be numbered 0, 1, 2, ... once each")
        column = lambda c: rows[c].combine_chunks()
        template = Template(stacked(column("reference").drop_null(), h, w)[0], steps)
        straight = lambda x: odd_rows_shifted(x, steps.odd_lines) if steps.odd_lines else x
        stack = straight(stacked(column("pixels"), h, w))
        seen = np.concatenate(_in_parts(steps.prepare, stack)) if steps.prepare else stack
        surfaces = np.concatenate(_in_parts(template.surfaces, seen))
        if halo:
            surfaces = smoothed_over_frames(surfaces, int(numbers[0]), numbers[own], int(numbers[-1]) + 1, steps.weights())
        else:
            surfaces = surfaces[own]
        dy, dx, fit = peaks(surfaces)
        dy, dx = dy - steps.reach, dx - steps.reach
        moved = [translated(stack[own], dy, dx)]
        if second:
            moved.append(translated(straight(stacked(column("second_pixels"), h, w)[own]), dy, dx))
        found = [np.zeros((len(dy), 0))] * 3
        if steps.grid:
            found = [np.concatenate(x) for x in zip(*_in_parts(template.block_offsets, translated(seen[own], dy, dx) if steps.prepare else moved[0]), strict=True)]
            spread = lambda x, by, bx: warped(x, steps.grid.spread(by, h, w), steps.grid.spread(bx, h, w))
            moved = [np.concatenate(_in_parts(spread, m, *found[:2])) for m in moved]
        columns = [rows["plane"].filter(pa.array(own)), pa.array(numbers[own]), pa.array(dy), pa.array(dx), pa.array(fit), *map(lists, found), *map(lists, moved)]
        return pa.table(columns, names=["plane", "frame", "dy", "dx", "correlation", *blocks, *channels])

    array = pa.list_(pa.float64())
    empty = [pa.field(c, pa.int64()) for c in ("plane", "frame", "dy", "dx")] + [pa.field("correlation", pa.float64())] + [pa.field(c, array) for c in (*blocks, *channels)]
    return sent.groupBy("plane", "range").applyInArrow(run, schema)


def rigid_offsets(frames: DataFrame, references: DataFrame, plane: str, frame: str, values: str, steps: Steps, span: int = 64) -> DataFrame:
    """plane, frame, dy, dx and correlation of the first step alone."""
    return register(frames, references, plane, frame, values, steps, span=span).select("plane", "frame", "dy", "dx", "correlation")
