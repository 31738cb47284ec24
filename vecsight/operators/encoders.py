"""Pluggable encoders and decoders (K1, K2, K3, K5, K6).

An encoder is a ``make_fn`` that builds the model once per Python worker and
returns a batch function (numpy in, n x d numpy out); ``predict_batch_udf`` runs
it over Arrow batches.  Real model libraries are not installed here, so the
defaults are deterministic stand-ins with the same interface:

* ``hashing_text_encoder`` - signed feature hashing of lower-cased word tokens,
  then L2 normalisation (the whole text is encoded, never a prefix);
* ``projection_image_encoder`` - resize + centre crop (K6), then a fixed
  seeded random projection, then L2 normalisation.
"""

from __future__ import annotations

import io
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\w+", re.UNICODE)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return (m / np.maximum(n, 1e-12)).astype(np.float32)


def hashing_text_encoder(dim: int = 64):
    def make():
        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for r, t in enumerate(texts):
                if t is None:
                    continue
                for tok in _TOKEN.findall(str(t).lower()):
                    h = zlib.crc32(tok.encode("utf-8"))
                    out[r, h % dim] += 1.0 if (h >> 31) & 1 else -1.0
            return _unit(out)
        return encode
    return make


def resize_weights(old: int, new: int) -> np.ndarray:
    """``new`` x ``old`` weights of linear interpolation along one axis; when the axis gets shorter the
    triangle is as much wider, so that every pixel counts (no aliasing)."""
    scale = old / new
    gap = np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * scale
    w = np.maximum(0.0, 1 - np.abs(gap) / max(scale, 1.0))
    return w / w.sum(axis=1, keepdims=True)


def resize_center_crop(img: np.ndarray, size: int) -> np.ndarray:
    """K6: bilinear resize of the shorter side to ``size``, then a centre crop.  Images of (h, w) or
    (h, w, channels); one matrix product per axis."""
    h, w = img.shape[:2]
    scale = size / min(h, w)
    nh, nw = max(size, int(round(h * scale))), max(size, int(round(w * scale)))
    top, left = (nh - size) // 2, (nw - size) // 2
    rows, cols = resize_weights(h, nh)[top:top + size], resize_weights(w, nw)[left:left + size]
    return np.moveaxis(np.tensordot(cols, np.tensordot(rows, img, (1, 0)), (1, 1)), 0, 1)


def projection_image_encoder(dim: int = 64, size: int = 16, seed: int = 0):
    def make():
        proj = np.random.default_rng(seed).standard_normal((size * size, dim))

        def encode(images: np.ndarray) -> np.ndarray:
            flat = np.stack([resize_center_crop(np.asarray(im, dtype=np.float64), size).reshape(-1)
                             for im in images])
            return _unit(flat @ proj)
        return encode
    return make


def flat_image_encoder(size: int):
    """Resize and crop (K6), then the pixels themselves at length 1, in double precision."""
    def make():
        def encode(images: list) -> np.ndarray:
            flat = np.stack([resize_center_crop(np.asarray(im, dtype=np.float64), size).reshape(-1) for im in images])
            return flat / np.maximum(np.sqrt((flat * flat).sum(axis=1, keepdims=True)), 1e-12)
        return encode
    return make


def encode_images(files: DataFrame, make_fn, decoder=None, content_col: str = "content",
                  out_col: str = "embedding", batch_size: int = 64) -> DataFrame:
    """K1 + K6: stored image bytes -> vectors.  Images of any shape are decoded and encoded
    ``batch_size`` at a time inside the task; missing bytes give a missing vector."""
    keep = [c for c in files.columns if c not in (content_col, out_col)]
    schema = T.StructType([*[files.schema[c] for c in keep], T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    read = decoder or npy_decoder

    def run(batches):
        model = make_fn()
        for pdf in batches:
            for lo in range(0, len(pdf), batch_size):
                some = pdf.iloc[lo:lo + batch_size]
                there = some[content_col].notna()
                out = some[keep].copy()
                out[out_col] = None
                if there.any():
                    vecs = model([read(bytes(c)) for c in some.loc[there, content_col]])
                    out.loc[there, out_col] = pd.Series(list(vecs), index=out.index[there])
                yield out

    return files.select(*keep, content_col).mapInPandas(run, schema)


def encode(df: DataFrame, col: str, make_fn, out_col: str = "vec", batch_size: int = 256) -> DataFrame:
    """K1/K2: run a pluggable encoder over a column with Arrow batches."""
    udf = predict_batch_udf(make_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out_col, udf(F.col(col)))


def npy_decoder(content: bytes) -> np.ndarray:
    """Default K5 decoder: a ``.npy`` payload."""
    return np.load(io.BytesIO(content), allow_pickle=False)


def npy_bytes(image: np.ndarray) -> bytes:
    """An array as ``.npy`` payload."""
    buf = io.BytesIO()
    np.save(buf, image)
    return buf.getvalue()


def decode(files: DataFrame, decoder=npy_decoder) -> DataFrame:
    """K5: (path, content) -> (path, shape, pixels) with a pluggable decoder, per Arrow batch."""
    schema = T.StructType([T.StructField("path", T.StringType()),
                           T.StructField("shape", T.ArrayType(T.IntegerType())),
                           T.StructField("pixels", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            shapes, pixels = [], []
            for c in pdf["content"]:
                a = np.asarray(decoder(bytes(c)), dtype=np.float64)
                shapes.append(list(a.shape))
                pixels.append(a.reshape(-1))
            yield pd.DataFrame({"path": pdf["path"], "shape": shapes, "pixels": pixels})

    return files.select("path", "content").mapInPandas(run, schema)


def write_npy_files(df: DataFrame, root: str, folder_col: str, name_col: str, array_col: str,
                    shape: tuple[int, ...]) -> None:
    """Write one ``.npy`` file per row below ``root/<folder>/<name>.npy`` (tasks write in
    parallel through pyarrow's filesystem layer, which resolves the URI scheme)."""
    def write(rows):
        from pyarrow import fs as pafs
        fsys, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root)
        for r in rows:
            d = f"{base}/{r[folder_col]}"
            fsys.create_dir(d, recursive=True)
            buf = io.BytesIO()
            np.save(buf, np.asarray(r[array_col], dtype=np.float64).reshape(shape))
            with fsys.open_output_stream(f"{d}/{r[name_col]}.npy") as out:
                out.write(buf.getvalue())

    df.select(folder_col, name_col, array_col).foreachPartition(write)


def best_label(scores: DataFrame, key: str, score_col: str = "cosine_similarity") -> DataFrame:
    """Per key the label with the highest score (ties to the smaller label)."""
    order = F.struct(F.col(score_col), (-F.col("label")))
    return scores.groupBy(key).agg(F.max_by("label", order).alias("label"),
                                   F.max(score_col).alias(score_col))
