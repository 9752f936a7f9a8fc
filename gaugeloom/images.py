"""Image steps on NumPy arrays, and their use over tables. Decoding files needs an image library, if there is one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polygon_mask(polygons: list[list[float]], width: int, height: int) -> np.ndarray:
    """Pixels whose centre lies inside an odd number of a polygon's edges, over all polygons; under three points is nothing."""
    mask = np.zeros((height, width), bool)
    x = np.arange(width) + 0.5
    for flat in polygons or []:
        p = np.asarray(flat, float).reshape(-1, 2)
        if len(p) < 3:
            continue
        q = np.roll(p, -1, axis=0)
        for row in range(height):
            y = row + 0.5
            cross = (p[:, 1] <= y) != (q[:, 1] <= y)
            if cross.any():
                a, b = p[cross], q[cross]
                at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
                mask[row] |= (x[:, None] > at[None, :]).sum(1) % 2 == 1
    return mask


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest-neighbour scaling."""
    rows = np.minimum((np.arange(height) + 0.5) * image.shape[0] / height, image.shape[0] - 1).astype(int)
    cols = np.minimum((np.arange(width) + 0.5) * image.shape[1] / width, image.shape[1] - 1).astype(int)
    return image[rows][:, cols]


def longest_side(image: np.ndarray, most: int) -> np.ndarray:
    """Scaled down so that no side passes ``most``; smaller images stay."""
    h, w = image.shape[:2]
    k = most / max(h, w)
    return image if k >= 1 else resize(image, max(1, round(w * k)), max(1, round(h * k)))


def letterbox(image: np.ndarray, size: int, fill: int = 255) -> np.ndarray:
    """Scaled into a square of that size, the rest filled."""
    h, w = image.shape[:2]
    k = size / max(h, w)
    small = resize(image, max(1, round(w * k)), max(1, round(h * k)))
    out = np.full((size, size, *image.shape[2:]), fill, image.dtype)
    top, left = (size - small.shape[0]) // 2, (size - small.shape[1]) // 2
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def crop_instance(image: np.ndarray, bbox_xyxy: list[float], polygons: list[list[float]] | None = None, pad: float = 0.1, size: int = 336, fill: int = 255) -> np.ndarray | None:
    """Padded crop of a box, pixels outside the polygons filled, in a square; None for a box without pixels."""
    h, w = image.shape[:2]
    x0, y0, x1, y1 = bbox_xyxy
    px, py = (x1 - x0) * pad, (y1 - y0) * pad
    x0, y0, x1, y1 = max(0, int(x0 - px)), max(0, int(y0 - py)), min(w, int(np.ceil(x1 + px))), min(h, int(np.ceil(y1 + py)))
    if x1 <= x0 or y1 <= y0:
        return None
    out = image[y0:y1, x0:x1].copy()
    if polygons:
        shifted = [[v - (x0 if i % 2 == 0 else y0) for i, v in enumerate(p)] for p in polygons]
        out[~polygon_mask(shifted, x1 - x0, y1 - y0)] = fill
    return letterbox(out, size, fill)


def option_grid(tiles: list[np.ndarray], columns: int = 4, size: int = 336, gap: int = 8, fill: int = 255) -> np.ndarray:
    """Tiles in reading order."""
    rows = -(-len(tiles) // columns)
    depth = tiles[0].shape[2:] if tiles else ()
    out = np.full((rows * size + (rows + 1) * gap, columns * size + (columns + 1) * gap, *depth), fill, np.uint8)
    for i, t in enumerate(tiles):
        y, x = gap + (i // columns) * (size + gap), gap + (i % columns) * (size + gap)
        out[y : y + size, x : x + size] = letterbox(t, size, fill)
    return out


def side_by_side(left: np.ndarray, right: np.ndarray, most_height: int = 1024) -> np.ndarray:
    h = min(most_height, max(left.shape[0], right.shape[0]))
    fit = lambda a: resize(a, max(1, round(a.shape[1] * h / a.shape[0])), h)
    return np.concatenate([fit(left), fit(right)], axis=1)


def pixel_hash(image: np.ndarray) -> str:
    """First 16 hex digits of the SHA-256 of the pixel bytes."""
    return hashlib.sha256(np.ascontiguousarray(image).tobytes()).hexdigest()[:16]


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def data_url(content: Column, kind: str = "png") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(content))


def decode(content: bytes) -> np.ndarray:
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding images needs Pillow") from e
    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))


def map_images(df: DataFrame, step: Callable[[np.ndarray], np.ndarray | None], reader: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, height, width, pixels) of each image of (path, content) after a step; images the step drops are left out."""

    def run(frames):
        for pdf in frames:
            out = [(p, step(reader(bytes(c)))) for p, c in zip(pdf["path"], pdf["content"])]
            kept = [(p, a.shape[0], a.shape[1], a.tobytes()) for p, a in out if a is not None]
            import pandas as pd

            yield pd.DataFrame(kept, columns=["path", "height", "width", "pixels"])

    return df.select("path", "content").mapInPandas(run, "path string, height int, width int, pixels binary")


def grid_manifest(items: DataFrame, item: str, options: str, root: str) -> DataFrame:
    """(item, path, labels, option_paths): where the grid of each item's options lies, and what it shows in reading order."""
    listed = F.filter(F.array_compact(options), lambda o: o["path"].isNotNull())
    name = F.regexp_replace(F.col(item), r"[^A-Za-z0-9._-]", "_")
    return items.select(item, F.concat(F.lit(root.rstrip("/") + "/"), name, F.lit(".png")).alias("path"), F.transform(listed, lambda o: o["option_id"]).alias("labels"), F.transform(listed, lambda o: o["path"]).alias("option_paths"))


def with_grids(items: DataFrame, manifest: DataFrame, item: str, own: Column | None = None) -> DataFrame:
    """items with grid_path: their own path, else the manifest's of the same item, else null."""
    paths = manifest.groupBy(item).agg(F.min("path").alias("_path"))
    joined = items.join(paths, item, "left")
    return joined.withColumn("grid_path", F.coalesce(own, F.col("_path")) if own is not None else F.col("_path")).drop("_path")
