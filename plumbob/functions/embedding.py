"""Text embedding: providers, a deterministic stand-in, token estimates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.errors import NotFound, ValidationError

MOST_TEXTS = 32


class Provider(Protocol):
    """What turns texts into vectors; it is sent to the tasks."""

    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashProvider:
    """Vectors that depend on a text's hash alone: equal texts have equal
    vectors, others nearly orthogonal ones."""

    name: str = "mock"
    dimension: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        import hashlib

        return np.stack([np.random.default_rng(int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest())).uniform(-1, 1, self.dimension) for t in texts])


class OnnxProvider:
    """An ONNX encoder and its tokenizer, both files that every executor can
    read; masked mean pooling."""

    def __init__(self, model: str, tokenizer: str, dimension: int, most_tokens: int = 512, name: str = "onnx"):
        self.model, self.tokenizer, self.dimension, self.most_tokens, self.name = model, tokenizer, dimension, most_tokens, name
        self._session = None

    def __getstate__(self):
        return self.__dict__ | {"_session": None, "_tokens": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            self._session = onnxruntime.InferenceSession(self.model)
            self._tokens = Tokenizer.from_file(self.tokenizer)
            self._tokens.enable_truncation(self.most_tokens)
            self._tokens.enable_padding()
        encoded = self._tokens.encode_batch(texts)
        ids, mask = (np.array([getattr(e, k) for e in encoded], np.int64) for k in ("ids", "attention_mask"))
        named = {i.name for i in self._session.get_inputs()}
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = self._session.run(None, {k: v for k, v in feed.items() if k in named})[0]
        weight = mask[:, :, None]
        return (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def embed(docs: DataFrame, key: str, text: str, provider: Provider = HashProvider(), model: str | None = None, normalize: bool = True, batch: int = MOST_TEXTS) -> DataFrame:
    """``(key, embedding)`` in batches of ``batch`` texts; null texts give null."""
    if model is not None and model != provider.name:
        raise NotFound(f"model {model} not found")
    if not 1 <= batch <= MOST_TEXTS:
        raise ValidationError(f"a batch has 1 to {MOST_TEXTS} texts")
    rows = docs.select(key, F.col(text).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list = [None] * len(f)
            some = [i for i, t in enumerate(f._text) if t is not None]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                v = provider.embed([f._text.iloc[i] for i in part])
                for i, x in zip(part, unit(v) if normalize else v):
                    out[i] = x.astype(np.float32)
            yield pd.DataFrame({key: f[key], "embedding": out})

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def model_info(provider: Provider) -> dict:
    """Name and dimension, and whether the provider gives vectors of it."""
    return {"model": provider.name, "dimension": provider.dimension, "healthy": provider.embed(["ok"]).shape == (1, provider.dimension)}


def word_count(text: Column) -> Column:
    """Words between white space, 1 at least."""
    return F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)), F.lit(1))


def token_estimate(docs: DataFrame, text: str) -> DataFrame:
    """``(total_tokens)``: a quarter of the bytes of each text, and one a text
    at least over all."""
    part = F.floor(F.octet_length(F.col(text)) / 4).cast("long")
    return docs.agg(F.greatest(F.coalesce(F.sum(part), F.lit(0)), F.count("*")).alias("total_tokens"))
