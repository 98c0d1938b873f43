"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are, and which one counts. Both are parameters of every operator that counts tokens.
TOKENIZER_DIR = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"

#: Longer texts are encoded in stretches of about this many characters, so that one of them never fills a worker's memory.
STRETCH = 200_000
EDGE = re.compile(r"(?<=\S)[ \n\t]")


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def stretches(text: str) -> list[str]:
    """A text in stretches, each but the first beginning with white space that follows something else.

    The byte-level pre-tokenizer lets a word hold white space only as its first character, so it ends a word at every such
    place whatever stands around it, and the token count stays the same. Where there is no such place the text is not cut.
    """
    out, start = [], 0
    while len(text) - start > STRETCH and (edge := EDGE.search(text, start + STRETCH)):
        out.append(text[start : edge.start()])
        start = edge.start()
    return [*out, text[start:]]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text, whatever its length."""
    tokenizer = load(path)
    cut = type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and tokenizer.normalizer is None
    parts = [stretches(t) if cut else [t] for t in texts]
    flat = tokenizer.encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False)
    sizes, i = [], 0
    for ps in parts:
        sizes.append(sum(len(e) for e in flat[i : i + len(ps)]))
        i += len(ps)
    return sizes


def _counter(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.tolist()
            sizes: list[int] = []
            for i in range(0, len(values), 256):
                sizes += count_tokens([t or "" for t in values[i : i + 256]], path)
            yield pd.Series(sizes, dtype="int64")

    return F.pandas_udf(run, "bigint")


_sent: set[tuple[str, str]] = set()


def with_tokens(df: DataFrame, text: str, path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text``; null and empty texts have none. The vocabulary file of the driver is sent along."""
    sc, source = df.sparkSession.sparkContext, path or f"{TOKENIZER_DIR}/{TOKENIZER}"
    if os.path.exists(source) and (sc.applicationId, source) not in _sent:
        sc.addFile(source)
        _sent.add((sc.applicationId, source))
    return df.withColumn(name, _counter(path or f"{TOKENIZER_DIR}/{TOKENIZER}")(F.col(text)))
