"""Signatures as grey images, each compared with the first of its signer: structural similarity and a perceptual hash.

Images are rows (id, signer, width, height, pixels binary: a byte each, row by row). A signer's first image is found by an
aggregate that is combined before the shuffle, and joined back; pictures are then compared in tasks,
all of one size at once. Windows of the structural similarity are sums over summed-area tables, so their cost doesn't depend on their size.

Defined results: rows without an id, signer or pixels, or whose pixels aren't width times height bytes, are left out;
images under WINDOW in width or height after resizing have no similarity (null, verdict null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 7
#: Constants of the measure for 8-bit images; fixed values.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
PASS, SUSPECT = 0.85, 0.70
#: Side of the picture that is transformed, and of the low frequencies that are kept.
SIDE, LOW = 32, 8


def weights(n_from: int, n_to: int) -> np.ndarray:
    """n_to x n_from: linear interpolation between the centres of pixels; widened to an average where the picture shrinks."""
    scale = n_from / n_to
    reach = max(scale, 1.0)
    centre = (np.arange(n_to) + 0.5) * scale - 0.5
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(n_from)[None, :] - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def resized(images: np.ndarray, width: int, height: int) -> np.ndarray:
    """Images (n, height, width) at another size, in grey levels."""
    n, h, w = images.shape
    if (h, w) == (height, width):
        return images.astype(np.float64)
    return np.rint(weights(h, height) @ images @ weights(w, width).T)


def window_means(images: np.ndarray) -> np.ndarray:
    """Mean over every WINDOW x WINDOW window that lies inside."""
    table = np.zeros((images.shape[0], images.shape[1] + 1, images.shape[2] + 1))
    np.cumsum(np.cumsum(images, 1), 2, out=table[:, 1:, 1:])
    k = WINDOW
    return (table[:, k:, k:] - table[:, :-k, k:] - table[:, k:, :-k] + table[:, :-k, :-k]) / k**2


def structural_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean over the windows of each pair of images, with sample variances."""
    n = WINDOW**2
    ma, mb = window_means(a), window_means(b)
    va, vb, cov = ((window_means(x) - m) * n / (n - 1) for x, m in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    s = (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
    return s.mean((1, 2))


def perceptual_hash(images: np.ndarray) -> np.ndarray:
    """64 bits: which of the LOW x LOW lowest frequencies of the cosine transform are above their median."""
    k = np.arange(SIDE)
    cosine = 2 * np.cos(np.pi * (2 * k[None, :] + 1) * k[:LOW, None] / (2 * SIDE))
    low = (cosine @ resized(images, SIDE, SIDE) @ cosine.T).reshape(len(images), LOW * LOW)
    above = np.round(low, 6) > np.median(np.round(low, 6), 1, keepdims=True)
    return np.packbits(above, axis=1).view(">u8").astype(np.uint64).ravel()


def sound() -> Column:
    return F.col("id").isNotNull() & F.col("signer").isNotNull() & (F.octet_length("pixels") == F.col("width") * F.col("height")) & (F.col("width") > 0)


def _by_size(batch: pd.DataFrame, prefix: str = "") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and images of the rows of each size."""
    for (w, h), own in batch.groupby([f"{prefix}width", f"{prefix}height"], sort=False).indices.items():
        pixels = np.frombuffer(b"".join(batch[f"{prefix}pixels"].iloc[own]), np.uint8)
        yield own, pixels.reshape(len(own), h, w).astype(np.float64)


def _scored(width: int | None, height: int | None):
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            similarity, hashes, firsts = np.full(len(batch), np.nan), np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            for own, images in _by_size(batch):
                hashes[own] = perceptual_hash(images)
                rows = batch.iloc[own].reset_index(drop=True)
                to = (width or images.shape[2], height or images.shape[1])
                for part, first in _by_size(rows, "first_"):
                    firsts[own[part]] = perceptual_hash(first)
                    if min(to) >= WINDOW:
                        similarity[own[part]] = structural_similarity(resized(images[part], *to), resized(first, *to))
            differ = np.bitwise_count(hashes ^ firsts).astype(np.int32)
            yield pd.DataFrame({"id": batch["id"], "signer": batch["signer"], "first_id": batch["first_id"], "similarity": similarity, "hash": [f"{h:016x}" for h in hashes.tolist()], "hash_distance": differ})

    return scored


def compared(images: DataFrame, width: int | None = 128, height: int | None = 64, high: float = PASS, low: float = SUSPECT) -> DataFrame:
    """id, signer, first_id, similarity, hash (16 hex digits), hash_distance (to the first one's, 0 to 64), verdict (pass, suspect, forged) for every image but the first (least id) of its signer.

    Both are brought to width x height before windows are compared; None: the current image's own size.
    """
    rows = images.where(sound())
    cols = ("width", "height", "pixels")
    first = rows.groupBy("signer").agg(F.min_by(F.struct(*cols), "id").alias("f"), F.min("id").alias("first_id"))
    first = first.select("signer", "first_id", *[F.col(f"f.{c}").alias(f"first_{c}") for c in cols])
    pairs = rows.select("id", "signer", *cols).join(first, "signer").where("id <> first_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = pairs.mapInPandas(_scored(width, height), f"id {kinds['id']}, signer {kinds['signer']}, first_id {kinds['id']}, similarity double, hash string, hash_distance int")
    s = F.nanvl("similarity", F.lit(None).cast("double"))
    return made.withColumn("similarity", s).withColumn("verdict", F.when(F.col("similarity") >= high, "pass").when(F.col("similarity") >= low, "suspect").when(F.col("similarity").isNotNull(), "forged"))
