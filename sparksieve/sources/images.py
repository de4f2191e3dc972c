"""Text in images: a pluggable reader, and the pure parts of an OCR pipeline."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import IMAGE, finish
from ..operators.layers import ByteScanner
from .payload import inline_images

SUFFIX = "/from-image"


def detect_images(payloads: DataFrame, id_col: str, text_col: str, ocr: Callable[[bytes], str]) -> DataFrame:
    """Findings of the built-in rules in the texts that ``ocr`` reads from inline images.

    The recognised text is scanned one level down; findings are anchored on
    the image's data and their ids get a suffix. Images that are no base64 or
    that the reader raises on are skipped, like unreadable ones.
    """
    kind = payloads.schema[id_col].dataType.simpleString()
    src = payloads.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.contains("text", F.lit("image/"))).select("id", "text", F.explode(inline_images(F.col("text"))).alias("data"))
    src = src.select("id", F.octet_length(F.expr("substring(text, 1, instr(text, data) - 1)")).alias("at"), "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = ByteScanner()
        for pdf in batches:
            rows = []
            for i, at, data in zip(pdf["id"], pdf["at"], pdf["data"]):
                try:
                    text = ocr(base64.b64decode(data + "=" * (-len(data) % 4)))
                except (binascii.Error, ValueError, OSError):
                    continue
                for n, (_, _, rule, cat, sev, _) in enumerate(scanner.scan(text.encode(), 1)):
                    rows.append((i, rule + SUFFIX, cat, sev, int(at), int(at) + len(data), data, IMAGE, n))
            yield pd.DataFrame(rows, columns=["id", "rule_id", "category", "severity", "off", "end", "raw", "source", "rule"])

    out = src.mapInPandas(run, f"id {kind}, rule_id string, category string, severity string, off long, end long, raw string, source int, rule long")
    none = F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(b"").alias("bytes"))
    return finish(out.withColumnRenamed("id", id_col).withColumn("ctx", none), id_col).withColumn("identity", F.lit(""))


def load_vocab(lines: list[str]) -> list[str]:
    """Output symbols of a recogniser: blank first, the lines, a space last."""
    return ["", *lines, " "]


def ctc_text(logits: np.ndarray, vocab: list[str]) -> str:
    """Greedy decoding of [T, V] scores: best symbol per step, repeats collapsed, blanks dropped."""
    best = logits.argmax(axis=1)
    keep = (best != 0) & np.r_[True, best[1:] != best[:-1]]
    return "".join(vocab[k] for k in best[keep] if k < len(vocab))


def component_boxes(heat: np.ndarray, threshold: float = 0.3, least: int = 1) -> list[tuple[int, int, int, int]]:
    """(x0, y0, x1, y1) of the 4-connected regions above a threshold with at least so many pixels."""
    on = heat > threshold
    label = np.where(on, np.arange(on.size).reshape(on.shape), -1)
    while True:  # the smallest label floods each region; rows and columns are swept in both directions
        before = label.copy()
        for axis in (0, 1):
            for flip in (False, True):
                v = np.flip(label, axis) if flip else label
                v = v if axis == 0 else v.T
                for k in range(1, v.shape[0]):
                    both = (v[k] >= 0) & (v[k - 1] >= 0)
                    v[k][both] = np.minimum(v[k][both], v[k - 1][both])
        if (label == before).all():
            break
    out = []
    for k in np.unique(label[label >= 0]):
        ys, xs = np.nonzero(label == k)
        if len(ys) >= least:
            out.append((int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())))
    return reading_order(out)


def reading_order(boxes: list[tuple], row: int = 10) -> list[tuple]:
    """Boxes from top to bottom in rows of so many pixels, from left to right within one."""
    out: list[tuple] = []
    line: list[tuple] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        if line and b[1] - line[0][1] > row:
            out += sorted(line)
            line = []
        line.append(b)
    return out + sorted(line)


def resize_nearest(img: np.ndarray, height: int, width: int) -> np.ndarray:
    ys, xs = np.arange(height) * img.shape[0] // height, np.arange(width) * img.shape[1] // width
    return img[ys][:, xs]


def to_tensor(img: np.ndarray, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5)) -> np.ndarray:
    """An RGB image as a normalised [1, 3, H, W] float tensor."""
    x = (img.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)
    return x.transpose(2, 0, 1)[None]


def crop(img: np.ndarray, box: tuple, margin: int = 0) -> np.ndarray:
    x0, y0, x1, y1 = box
    return img[max(0, y0 - margin) : y1 + 1 + margin, max(0, x0 - margin) : x1 + 1 + margin]


def rotate_180(img: np.ndarray) -> np.ndarray:
    return img[::-1, ::-1]
