"""Byte-level BPE from a public vocabulary file, for the operators that encode texts."""

from __future__ import annotations

import base64
import os
import sys

import numpy as np
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where the vocabulary files lie on the driver; it ships them to the executors.
FOLDER = os.environ.get("WEBQUIRE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# The pre-tokenisation pattern of the vocabularies, and the id that they leave free for the end of a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256


class Encoder:
    """Encodes texts; ``lengths[id]`` is the number of bytes of a token."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self._bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, disallowed_special=())

    def decode(self, tokens: np.ndarray) -> str:
        return self._bpe.decode(tokens.tolist())


def ship(spark: SparkSession, path: str | None = None):
    """The vocabulary file (about 1 MB) as a broadcast of its bytes; ``path`` defaults to ``FOLDER/VOCABULARY``."""
    with open(path or os.path.join(FOLDER, VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read())
