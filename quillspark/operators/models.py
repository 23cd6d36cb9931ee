"""Model calls as batches: any embedder or tagger over Arrow batches, with deterministic offline ones."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def hashed_embedding(text: str, size: int = 64) -> list[float]:
    """A vector of hashed words, of length one; the same on every run."""
    out = np.zeros(size, np.float32)
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % size] += 1.0 if h >> 63 else -1.0
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).tolist()


def capital_tags(text: str) -> list[str]:
    """Capitalised runs of words inside sentences: an offline stand-in for a tagger."""
    return re.findall(r"(?<=[a-z,] )(?:[A-Z]\w+)(?: [A-Z]\w+)*", text)


def call_model(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list], kind: str) -> DataFrame:
    """(key, result, error): the model over batches, order kept; if a batch fails, its texts are tried one by one, and a text that fails tells its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            results, errors = [], []
            try:
                results, errors = model(texts), [None] * len(texts)
            except Exception:  # noqa: BLE001  a text that the model rejects must not lose the others
                for t in texts:
                    try:
                        results.append(model([t])[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        results.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results), pa.array(errors, pa.string())], names=[key, "result", "error"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, result {kind}, error string")


def embed(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    return call_model(df, key, text, lambda texts: [hashed_embedding(t, size) for t in texts], "array<double>")


def tag(df: DataFrame, key: str, text: str) -> DataFrame:
    return call_model(df, key, text, lambda texts: [capital_tags(t) for t in texts], "array<string>")
