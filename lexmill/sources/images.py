"""Image sources: decoding and recognition are injected, preparation is here, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Recognises a prepared image: its text and a confidence of 0 to 1.
Engine = Callable[[np.ndarray], tuple[str, float]]
#: Bytes of an image file to an array of (height, width[, 3]); None if they are none.
Decoder = Callable[[bytes], "np.ndarray | None"]
MAX_SKEW = 30.0


def zoom(dpi: float) -> float:
    """The scale at which a page is drawn: its own unit is 1/72 of an inch."""
    return dpi / 72


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def denoised(image: np.ndarray) -> np.ndarray:
    """Median of each 3 x 3 neighbourhood."""
    wide = np.pad(image, 1, mode="edge")
    return np.median([wide[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)], axis=0)


def skew(image: np.ndarray) -> float:
    """Degrees by which dark pixels lean, by their principal axis; 0 if that is over MAX_SKEW."""
    y, x = np.nonzero(image < image.mean())
    if len(x) < 2:
        return 0.0
    spread = np.cov(x, y)
    angle = 0.5 * np.degrees(np.arctan2(2 * spread[0, 1], spread[0, 0] - spread[1, 1]))
    return float(angle) if abs(angle) <= MAX_SKEW else 0.0


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre, nearest pixels, edges repeated."""
    h, w = image.shape
    y, x = np.indices(image.shape)
    t = np.radians(degrees)
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2, np.cos(t) * dx - np.sin(t) * dy + (w - 1) / 2
    return image[np.clip(np.rint(sy), 0, h - 1).astype(int), np.clip(np.rint(sx), 0, w - 1).astype(int)]


def thresholded(image: np.ndarray, block: int = 31, offset: float = 11.0) -> np.ndarray:
    """White where a pixel is above the mean of its block less ``offset``, else black."""
    r = block // 2
    sums = np.pad(np.pad(image, r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = image.shape
    mean = (sums[block : block + h, block : block + w] - sums[:h, block : block + w] - sums[block : block + h, :w] + sums[:h, :w]) / block**2
    return np.where(image > mean - offset, 255, 0).astype(np.uint8)


def prepared(image: np.ndarray) -> np.ndarray:
    """Gray, without noise, upright, in black and white."""
    plain = denoised(gray(image))
    lean = skew(plain)
    return thresholded(turned(plain, lean) if lean else plain)


def read_images(spark: SparkSession, path: str, decode: Decoder, engines: list[tuple[str, Engine]]) -> DataFrame:
    """(doc_id, page_number, engine, engine_order, text, confidence, warning) of image files by every
    engine; a file that can't be decoded has an empty text of confidence 0 and a warning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                image = decode(bytes(content))
                if image is None:
                    rows.append((name, 1, "none", 0, "", 0.0, "could not decode image file"))
                    continue
                ready = prepared(image)
                rows += [(name, 1, engine, k, *read(ready), None) for k, (engine, read) in enumerate(engines)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "engine", "engine_order", "text", "confidence", "warning"])

    shape = "doc_id string, page_number int, engine string, engine_order int, text string, confidence double, warning string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, shape)
