"""File sinks: one file a key, overwritten by key, so a repeated task leaves the same files. Writers get small rows only."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import hex_colour, ink_text


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image (h, w, 4)."""
    h, w = rgba.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def stencil_pngs(kept: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, layer, png: kept pixels opaque in the layer's colour, cut ones transparent."""
    used = kept.join(palette.select("image_id", F.col("label").alias("layer"), "r", "g", "b"), ["image_id", "layer"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, 4), np.uint8)
        own = pdf[pdf["keep"]]
        out[own["y"], own["x"]] = np.stack([own["r"], own["g"], own["b"], np.full(len(own), 255)], 1)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "layer": [pdf["layer"].iloc[0]], "png": [png(out)]})

    return used.groupBy("image_id", "layer").applyInPandas(run, f"image_id {used.schema['image_id'].dataType.simpleString()}, layer int, png binary")


def preview_pngs(preview: DataFrame) -> DataFrame:
    """image_id, png: opaque pixels r, g, b."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, 4), 255, np.uint8)
        out[pdf["y"], pdf["x"], :3] = np.stack([pdf["r"], pdf["g"], pdf["b"]], 1)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "png": [png(out)]})

    return preview.groupBy("image_id").applyInPandas(run, f"image_id {preview.schema['image_id'].dataType.simpleString()}, png binary")


def palette_table(palette: DataFrame) -> DataFrame:
    """layer, rgb_hex and cmyk, as the palette file lists them."""
    return palette.select("image_id", F.col("label").alias("layer"), hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("rgb_hex"), ink_text(*(F.col(f"ink_{c}") for c in "cmyk")).alias("cmyk"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_text(df: DataFrame, path: str, by: list[str], value: str = "svg") -> None:
    """A folder for each key with one text file; any store that Spark writes to."""
    df.select(*by, value).write.mode("overwrite").partitionBy(*by).text(path)


def palette_files(palette: DataFrame) -> DataFrame:
    """image_id and the text of its palette file, darkest layer first."""
    rows = palette_table(palette).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("layer", "rgb_hex", "cmyk"))).alias("rows"))
    line = lambda r: F.concat_ws("\t", r["layer"].cast("string"), r["rgb_hex"], r["cmyk"])
    return rows.select("image_id", F.concat(F.lit("layer\trgb_hex\tcmyk\n"), F.array_join(F.transform("rows", line), "\n"), F.lit("\n")).alias("text"))


def named(df: DataFrame, prefix: str, many: bool, part=None, ending: str = "") -> DataFrame:
    """df with name: the prefix, the image's own name where there are many, and what tells its files apart."""
    own = F.regexp_extract(F.col("image_id").cast("string"), r"([^/]*?)(\.[^./]*)?$", 1)
    return df.withColumn("name", F.concat_ws("_", F.lit(prefix), *([own] if many else []), *([part] if part is not None else []), *([F.lit(ending)] if ending else [])))


def write_local(df: DataFrame, folder: str, name: str, value: str, suffix: str) -> None:
    """Single files on a folder that all executors share: <name>.<suffix>, written aside and renamed; a task that runs twice leaves the same files."""

    def run(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            data = r[value].encode() if isinstance(r[value], str) else bytes(r[value])
            path = os.path.join(folder, f"{r[name]}.{suffix}")
            aside = f"{path}.{os.getpid()}.part"
            with open(aside, "wb") as f:
                f.write(data)
            os.replace(aside, path)

    df.select(name, value).foreachPartition(run)
