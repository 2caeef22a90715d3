"""Alignment of frames: reference images by rounds, phases of scanned lines, offsets of blocks and the fields between them.

Frames are arrays, a row each, and a plane's reference image is joined to its frames, so offsets need no shuffle of
frames when the references are small enough for Spark to broadcast. An offset says how far content has moved: a frame is
corrected by sampling at each pixel plus its offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.operators.frames import lists, stacked, taper_mask, tapered, translated, warped

EPSILON = 1e-5
#: Steps of a pixel in fine offsets, and the width of the Gaussians between correlation values.
FINE, SPREAD = 10, 0.85


# ---- phase correlation


def whitened(spectrum: np.ndarray) -> np.ndarray:
    return spectrum / (np.abs(spectrum) + EPSILON)


def gaussian_response(sigma: float, height: int, width: int) -> np.ndarray:
    """A Gaussian around pixel (0, 0), wrapped at the edges and of sum 1, as a spectrum."""
    bell = lambda n: np.exp(-0.5 * ((np.arange(n) - n // 2) / sigma) ** 2)
    kernel = np.outer(bell(height), bell(width))
    return np.fft.fft2(np.fft.ifftshift(kernel / kernel.sum()))


def template_spectrum(image: np.ndarray, sigma: float) -> np.ndarray:
    """What a frame's white spectrum is multiplied with: the image's own, turned round, smoothed if sigma is above 0."""
    spectrum = whitened(np.conj(np.fft.fft2(image)))
    return spectrum * gaussian_response(sigma, *image.shape) if sigma > 0 else spectrum


def surface(frames: np.ndarray, template: np.ndarray, reach: int) -> np.ndarray:
    """Correlation for shifts of -reach to reach each way, of the last two axes."""
    whole = np.fft.ifft2(whitened(np.fft.fft2(frames)) * template).real
    shifts = np.arange(-reach, reach + 1)
    return whole[..., (shifts % whole.shape[-2])[:, None], shifts % whole.shape[-1]]


def peaks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the first maximum over the last two axes."""
    flat = values.reshape(*values.shape[:-2], -1)
    at = flat.argmax(-1)
    return at // values.shape[-1], at % values.shape[-1], np.take_along_axis(flat, at[..., None], -1)[..., 0]


# ---- reference images


def picked(frames: DataFrame, plane: str, frame: str, most: int) -> DataFrame:
    """At most `most` frames of each plane, evenly spaced; frames must be 0, 1, 2, ... in a plane."""
    sizes = frames.groupBy(plane).agg(F.count("*").alias("_n"))
    place = lambda f: F.floor(f * most / F.col("_n"))
    joined = frames.join(F.broadcast(sizes), plane)
    return joined.where((F.col("_n") <= most) | (place(F.col(frame) + 1) > place(F.col(frame)))).drop("_n")


def first_reference(frames: np.ndarray, partners: int) -> np.ndarray:
    """Mean of the frames most like the one that has the most alike partners, their own means taken off."""
    flat = frames.reshape(len(frames), -1)
    flat = flat - flat.mean(1, keepdims=True)
    unit = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    count = min(partners, len(frames))
    own_last = np.sort(alike, axis=1)[:, -count:]
    seed = int(own_last[:, : max(1, count - 1)].mean(1).argmax())
    return flat[np.argsort(-alike[seed], kind="stable")[:count]].mean(0).reshape(frames.shape[1:])


def refined(frames: np.ndarray, sigma: float, slope: float, reach: int, partners: int, rounds: int) -> np.ndarray:
    """A reference from frames (n, h, w): align all to it, take the mean of those that fit best, and again with more of them.

    The best of all is left out, so that a reference does not feed on itself; offsets' mean is taken back.
    """
    if len(frames) < 2:
        return frames[0]
    image, mask = first_reference(frames, partners), taper_mask(*frames.shape[1:], slope)
    for turn in range(rounds):
        faded = tapered(frames, mask, np.full(len(frames), image.mean()))
        dy, dx, fit = peaks(surface(faded, template_spectrum(image, sigma), reach))
        dy, dx = dy - reach, dx - reach
        frames = translated(frames, dy, dx)
        best = np.argsort(-fit, kind="stable")[1 : max(2, len(frames) * (1 + turn) // (2 * rounds))]
        back = np.round(-np.array([dy[best].mean(), dx[best].mean()])).astype(int)
        image = translated(frames[best].mean(0)[None], back[:1], back[1:])[0]
    return image


def reference_images(
    frames: DataFrame, plane: str, frame: str, values: str, height: int, width: int, reach: int, sigma: float, slope: float, most: int = 300, partners: int = 20, rounds: int = 8
) -> DataFrame:
    """plane and reference, from at most `most` frames of each plane (a documented sample, which bounds a task's memory)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack(rows.sort_values(frame)[values].to_list()).reshape(-1, height, width).astype(float)
        return pd.DataFrame({plane: rows[plane].iloc[:1].to_numpy(), "reference": [refined(stack, sigma, slope, reach, partners, rounds).ravel()]})

    chosen = picked(frames.select(plane, frame, values), plane, frame, most)
    return chosen.groupBy(plane).applyInPandas(run, f"{plane} {frames.schema[plane].dataType.simpleString()}, reference array<double>")


# ---- phase of scanned lines


def line_phases(frames: DataFrame, plane: str, values: str, height: int, width: int, reach: int = 10) -> DataFrame:
    """plane and offset: how many pixels odd lines must move right to lie under the even ones before them.

    Each batch adds up the correlations of its line pairs, so that a plane's frames never meet in one task.
    """
    lags = np.arange(-min(reach, (width - 1) // 2), min(reach, (width - 1) // 2) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stack, planes = stacked(batch.column(values), height, width), batch.column(plane).to_numpy(zero_copy_only=False)
                odd = whitened(np.fft.rfft(stack[:, 1::2], axis=2))
                even = whitened(np.fft.rfft(stack[:, ::2], axis=2))[:, : odd.shape[1]]
                fit = np.fft.irfft(odd * np.conj(even), n=width, axis=2).sum(1)[:, lags % width]
                names, place = np.unique(planes, return_inverse=True)
                total = np.zeros((len(names), len(lags)))
                np.add.at(total, place, fit)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, len(lags)), pa.int64()), pa.array(np.tile(lags, len(names)), pa.int64()), pa.array(total.ravel())], ["plane", "lag", "fit"])

    source = frames.select(F.col(plane).cast("long").alias(plane), F.col(values).cast("array<double>").alias(values))
    sums = source.mapInArrow(run, "plane long, lag long, fit double").groupBy("plane", "lag").agg(F.sum("fit").alias("fit"))
    return sums.groupBy("plane").agg(F.max_by(-F.col("lag"), F.struct("fit", -F.col("lag"))).alias("offset"))


# ---- blocks


@dataclass(frozen=True)
class Grid:
    """Blocks of one size over an image, overlapping by about half, numbered row by row."""

    tops: np.ndarray
    lefts: np.ndarray
    height: int
    width: int

    @staticmethod
    def over(height: int, width: int, block_height: int, block_width: int) -> Grid:
        def places(length: int, size: int) -> np.ndarray:
            return np.zeros(1, int) if size >= length else np.linspace(0, length - size, int(np.ceil(1.5 * length / size))).astype(int)

        return Grid(places(height, block_height), places(width, block_width), min(height, block_height), min(width, block_width))

    def cut(self, images: np.ndarray) -> np.ndarray:
        """(..., h, w) to (..., blocks, block height, block width)."""
        every = np.lib.stride_tricks.sliding_window_view(images, (self.height, self.width), axis=(-2, -1))
        chosen = every[..., self.tops[:, None], self.lefts, :, :]
        return chosen.reshape(*chosen.shape[:-4], -1, self.height, self.width)

    def neighbours(self) -> np.ndarray:
        """Weights (blocks, blocks) that smooth over blocks, by squared distance in the grid; each row's sum is 1."""
        y, x = (a.ravel() for a in np.indices((len(self.tops), len(self.lefts))))
        weights = np.exp(-((y[:, None] - y) ** 2) - (x[:, None] - x) ** 2.0)
        return weights / weights.sum(1, keepdims=True)

    def spread(self, offsets: np.ndarray, height: int, width: int) -> np.ndarray:
        """Offsets (n, blocks) as fields (n, h, w): linear between the blocks' middles, constant beyond the outer ones."""

        def weights(length: int, starts: np.ndarray, size: int) -> np.ndarray:
            place = np.interp(np.arange(length), starts + size / 2, np.arange(len(starts)))
            return np.maximum(0, 1 - np.abs(place[:, None] - np.arange(len(starts))))

        rows, columns = weights(height, self.tops, self.height), weights(width, self.lefts, self.width)
        return rows @ offsets.reshape(-1, len(self.tops), len(self.lefts)) @ columns.T


def clearness(window: np.ndarray, around: int) -> np.ndarray:
    """The peak inside a margin of `around`, over the greatest value outside the square of 2 around that begins `around` before it."""
    y, x, top = peaks(window[..., around:-around, around:-around])
    at = np.arange(window.shape[-1])
    near = lambda p: (at >= p[..., None]) & (at < p[..., None] + 2 * around)
    rest = np.where(near(y)[..., :, None] & near(x)[..., None, :], -np.inf, window).max((-2, -1))
    return top / np.maximum(rest, 1e-10)


def finer(around: int) -> np.ndarray:
    """Weights (2 around + 1, 2 around FINE + 1) from values at whole pixels to values between them, through Gaussians.

    A Gaussian of two coordinates is a product, so the same weights serve both axes.
    """
    coarse, fine = np.arange(-around, around + 1), np.arange(-around * FINE, around * FINE + 1) / FINE
    bell = lambda a, b: np.exp(-((a[:, None] - b) ** 2) / (2 * SPREAD**2))
    return np.linalg.solve(bell(coarse, coarse), bell(coarse, fine))


@dataclass(frozen=True)
class BlockTemplate:
    """What frames are held against: a reference image's blocks as spectra, with tapers and the means that fill them."""

    grid: Grid
    mask: np.ndarray
    fill: np.ndarray
    spectra: np.ndarray

    @staticmethod
    def of(image: np.ndarray, grid: Grid, sigma: float, slope: float) -> BlockTemplate:
        blocks = grid.cut(image)
        mask = grid.cut(taper_mask(*image.shape, slope)) * taper_mask(grid.height, grid.width, 2 * sigma)
        return BlockTemplate(grid, mask, blocks.mean((1, 2), keepdims=True) * (1 - mask), np.stack([template_spectrum(b, sigma) for b in blocks]))

    def offsets(self, frames: np.ndarray, most: float, least_clear: float, around: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """dy, dx and peak, each (n, blocks), to a tenth of a pixel. Unclear blocks are smoothed with their neighbours, up to twice."""
        reach = int(min(round(most), min(self.grid.height, self.grid.width) // 2 - around))
        if reach < 1:
            raise ValueError("blocks are too small for offsets of a pixel")
        window = surface(self.grid.cut(frames) * self.mask + self.fill, self.spectra, reach + around)
        if least_clear > 1:
            smoother, level, clear = self.grid.neighbours(), window, clearness(window, around)
            for _ in range(2):
                level = np.einsum("ab,nbyx->nayx", smoother, level)
                unclear = clear < least_clear
                window = np.where(unclear[..., None, None], level, window)
                clear = np.where(unclear, clearness(level, around), clear)
        y, x, _ = peaks(window[..., around:-around, around:-around])
        side = np.arange(2 * around + 1)
        n, b = np.indices(y.shape)
        region = window[n[..., None, None], b[..., None, None], (y[..., None] + side)[..., :, None], (x[..., None] + side)[..., None, :]]
        weights = finer(around)
        fy, fx, top = peaks(weights.T @ region @ weights)
        return y - reach + fy / FINE - around, x - reach + fx / FINE - around, top


def _by_plane(frames: DataFrame, references: DataFrame, plane: str, frame: str, values: str) -> DataFrame:
    numbers = frames.select(F.col(plane).cast("long").alias("plane"), F.col(frame).cast("long").alias("frame"), F.col(values).cast("array<double>").alias("pixels"))
    return numbers.join(references.select(F.col(plane).cast("long").alias("plane"), "reference"), "plane")


def _slices(batches: Iterator[pa.RecordBatch], height: int, width: int, grid: Grid, sigma: float, slope: float) -> Iterator[tuple]:
    """Runs of a plane's rows of at most 64 frames, as (rows, frames, template); one template is kept."""
    held, template = None, None
    for batch in batches:
        planes = batch.column("plane").to_numpy()
        ends = np.flatnonzero(np.diff(planes)) + 1
        for start, end in zip([0, *ends], [*ends, len(planes)], strict=True):
            if start < end and planes[start] != held:
                held, template = planes[start], BlockTemplate.of(stacked(batch.column("reference")[start : start + 1], height, width)[0], grid, sigma, slope)
            for at in range(start, end, 64):
                rows = batch.slice(at, min(64, end - at))
                yield rows, stacked(rows.column("pixels"), height, width), template


def block_offsets(
    frames: DataFrame, references: DataFrame, plane: str, frame: str, values: str, height: int, width: int, grid: Grid, most: float, sigma: float, slope: float, least_clear: float = 1.2, around: int = 3
) -> DataFrame:
    """plane, frame, dy, dx and peaks (arrays, a value for each block); planes without a reference give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, stack, template in _slices(batches, height, width, grid, sigma, slope):
            found = (lists(a) for a in template.offsets(stack, most, least_clear, around))
            yield pa.RecordBatch.from_arrays([rows.column("plane"), rows.column("frame"), *found], ["plane", "frame", "dy", "dx", "peaks"])

    return _by_plane(frames, references, plane, frame, values).mapInArrow(run, "plane long, frame long, dy array<double>, dx array<double>, peaks array<double>")


def corrected(
    frames: DataFrame, references: DataFrame, plane: str, frame: str, values: str, height: int, width: int, grid: Grid, most: float, sigma: float, slope: float, least_clear: float = 1.2, around: int = 3
) -> DataFrame:
    """plane, frame and pixels: each frame sampled along the field between its blocks' offsets, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, stack, template in _slices(batches, height, width, grid, sigma, slope):
            dy, dx, _ = template.offsets(stack, most, least_clear, around)
            out = warped(stack, grid.spread(dy, height, width), grid.spread(dx, height, width))
            yield pa.RecordBatch.from_arrays([rows.column("plane"), rows.column("frame"), lists(out)], ["plane", "frame", "pixels"])

    return _by_plane(frames, references, plane, frame, values).mapInArrow(run, "plane long, frame long, pixels array<double>")
