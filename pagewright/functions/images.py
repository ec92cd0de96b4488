"""Page images as numpy arrays: gray, scale, denoise, contrast, skew. One call an image, inside a pandas UDF."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import THUMBNAIL_MAX, THUMBNAIL_MIN, THUMBNAIL_WIDTH
from ..session import with_code

# The parameters of the kernels.
SKEW_RANGE, SKEW_STEP = 10.0, 0.25
INK_MIN, INK_MAX, PEAK = 0.0002, 0.60, 1.25


def gray(image: np.ndarray) -> np.ndarray:
    """Blue, green, red (and alpha) to gray; gray passes through."""
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def downscaled(image: np.ndarray, max_edge: int) -> np.ndarray:
    """The longest edge at most max_edge, by area means; never larger than before."""
    ratio = max_edge / max(image.shape)
    if ratio >= 1:
        return image

    def means(a: np.ndarray, n: int) -> np.ndarray:
        edge = np.linspace(0, len(a), n + 1)
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=float)])
        low = np.floor(edge).astype(int)
        part = (edge - low).reshape(-1, *[1] * (a.ndim - 1))
        at = sums[low] + part * (sums[np.minimum(low + 1, len(a))] - sums[low])
        return np.diff(at, axis=0) / (len(a) / n)

    h, w = (max(1, round(n * ratio)) for n in image.shape)
    return np.clip(np.rint(means(means(image.astype(float), h).T, w).T), 0, 255).astype(np.uint8)


def denoised(image: np.ndarray, size: int = 5, sigma: float = 50.0) -> np.ndarray:
    """Bilateral filter: near pixels of like brightness."""
    r, src = size // 2, image.astype(float)
    padded = np.pad(src, r, mode="reflect")
    total, weight = np.zeros_like(src), np.zeros_like(src)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                near = padded[r + dy : r + dy + src.shape[0], r + dx : r + dx + src.shape[1]]
                w = np.exp(-(dy * dy + dx * dx) / (2 * sigma**2) - (near - src) ** 2 / (2 * sigma**2))
                total += w * near
                weight += w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def contrasted(image: np.ndarray, mode: str = "clahe") -> np.ndarray:
    if mode == "none":
        return image
    if mode == "clahe":
        return clahe(image)
    if mode == "adaptive_threshold":
        return adaptive_threshold(image)
    raise ValueError(f"no such contrast: {mode!r}")


def clahe(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Equalise the histogram of each tile, clipped, and blend between tile centres."""
    h, w = image.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            tile = image[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(tile.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * tile.size / 256)
            spare = np.maximum(hist - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, limit) + spare / 256) * 255 / max(1, tile.size)
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(fy.astype(int), tiles - 2 if tiles > 1 else 0), np.minimum(fx.astype(int), tiles - 2 if tiles > 1 else 0)
    ty, tx = (fy - y0)[:, None], (fx - x0)[None, :]
    y, x = y0[:, None], x0[None, :]
    top = maps[y, x, image] * (1 - tx) + maps[y, np.minimum(x + 1, tiles - 1), image] * tx
    low = maps[np.minimum(y + 1, tiles - 1), x, image] * (1 - tx) + maps[np.minimum(y + 1, tiles - 1), np.minimum(x + 1, tiles - 1), image] * tx
    return np.clip(np.rint(top * (1 - ty) + low * ty), 0, 255).astype(np.uint8)


def adaptive_threshold(image: np.ndarray, size: int = 31, offset: float = 10.0) -> np.ndarray:
    """White where a pixel is brighter than the Gaussian mean around it less an offset."""
    r = size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()

    def blur(a: np.ndarray) -> np.ndarray:
        padded = np.pad(a, ((r, r), (0, 0)), mode="edge")
        return sum(k * padded[i : i + len(a)] for i, k in enumerate(kernel))

    return np.where(image > blur(blur(image.astype(float)).T).T - offset, 255, 0).astype(np.uint8)


def rotated(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """About the centre, counter-clockwise, size kept, bilinear."""
    h, w = image.shape
    angle = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(angle) * (x - cx) - np.sin(angle) * (y - cy) + cx
    sy = np.sin(angle) * (x - cx) + np.cos(angle) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    tx, ty = sx - x0, sy - y0

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return np.where(inside, image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], fill).astype(float)

    value = (at(y0, x0) * (1 - tx) + at(y0, x0 + 1) * tx) * (1 - ty) + (at(y0 + 1, x0) * (1 - tx) + at(y0 + 1, x0 + 1) * tx) * ty
    return np.clip(np.rint(value), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    hist = np.bincount(image.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), spread, 0)))


def skew(image: np.ndarray) -> float:
    """The tilt of the page in degrees, 0 where it can't be told. The sharpest profile of ink rows decides."""
    small = downscaled(image, 800)
    ink = small <= otsu(small)
    if not INK_MIN <= ink.mean() <= INK_MAX:
        return 0.0
    y, x = np.nonzero(ink)
    y, x = y - (small.shape[0] - 1) / 2, x - (small.shape[1] - 1) / 2
    angles = np.arange(-SKEW_RANGE, SKEW_RANGE + SKEW_STEP / 2, SKEW_STEP)
    reach = int(np.hypot(*small.shape)) // 2 + 2
    sharp = []
    for degrees in angles:
        a = np.deg2rad(degrees)
        rows = np.floor(y * np.cos(a) - x * np.sin(a)).astype(int) + reach
        sharp.append(float((np.diff(np.bincount(rows, minlength=2 * reach + 1).astype(float)) ** 2).sum()))
    best = int(np.argmax(sharp))
    return float(angles[best]) if sharp[best] >= PEAK * np.median(sharp) else 0.0


def preprocessed(image: np.ndarray, max_edge: int = 1600, denoise: bool = True, deskew: bool = True, contrast: str = "clahe") -> tuple[np.ndarray, float, list[str]]:
    """The page made ready, its tilt, and the steps that were applied."""
    steps, out, tilt = ["gray"], gray(image), 0.0
    if denoise:
        out = denoised(out)
        steps.append("denoise")
    if deskew and (tilt := skew(out)):
        out = rotated(out, tilt)
        steps.append("deskew")
    if max(out.shape) > max_edge:
        out = downscaled(out, max_edge)
        steps.append("downscale")
    if contrast != "none":
        out = contrasted(out, contrast)
        steps.append(contrast)
    return out, tilt, steps


RESULT = "struct<height:int,width:int,data:binary,tilt:double,steps:array<string>,pixel_ratio:double>"


def preprocessed_images(images: DataFrame, **options) -> DataFrame:
    """The image source's rows (height, width, nChannels, data) with a struct ``page`` beside them."""
    with_code(images.sparkSession)

    @F.pandas_udf(RESULT)
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for h, w, c, raw in zip(height, width, channels, data, strict=True):
            source = np.frombuffer(raw, np.uint8).reshape((h, w, c) if c > 1 else (h, w))
            page, tilt, steps = preprocessed(source, **options)
            rows.append((page.shape[0], page.shape[1], page.tobytes(), tilt, steps, page.size / (h * w)))
        return pd.DataFrame(rows, columns=["height", "width", "data", "tilt", "steps", "pixel_ratio"])

    return images.withColumn("page", run("height", "width", "nChannels", "data"))


def png(image: np.ndarray) -> bytes:
    """Gray or blue-green-red 8-bit pixels as a PNG file."""
    kind, pixels = (0, image) if image.ndim == 2 else (2, image[..., 2::-1])
    height, width = image.shape[:2]
    rows = np.hstack([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels).reshape(height, -1)])

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def thumbnail(image: np.ndarray, width: int) -> np.ndarray:
    """At most ``width`` pixels wide in the image's own proportions, colours kept, alpha dropped, never enlarged."""
    colours = image if image.ndim == 2 else image[..., :3]
    height, wide = colours.shape[:2]
    if wide <= width:
        return colours
    edge = max(width, round(height * width / wide))
    planes = [colours] if colours.ndim == 2 else [colours[..., c] for c in range(3)]
    small = [downscaled(plane, edge) for plane in planes]
    return small[0] if colours.ndim == 2 else np.dstack(small)


def thumbnails(images: DataFrame, width: int = THUMBNAIL_WIDTH) -> DataFrame:
    """The image source's rows with a PNG ``thumbnail`` beside them; an image that couldn't be read (no pixels) is an error."""
    if not THUMBNAIL_MIN <= width <= THUMBNAIL_MAX:
        raise ValueError(f"a thumbnail is {THUMBNAIL_MIN} to {THUMBNAIL_MAX} pixels wide")
    with_code(images.sparkSession)

    @F.pandas_udf("binary")
    def run(height: pd.Series, wide: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, c, raw in zip(height, wide, channels, data, strict=True):
            if h <= 0 or not raw:
                raise ValueError("an image that can't be read")
            out.append(png(thumbnail(np.frombuffer(raw, np.uint8).reshape((h, w, c) if c > 1 else (h, w)), width)))
        return pd.Series(out, dtype=object)

    return images.withColumn("thumbnail", run("height", "width", "nChannels", "data"))
