"""Token counts of texts and the figures derived from them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv

Counter = Callable[[Column], Column]


def heuristic_tokens(text: Column) -> Column:
    """Four characters per token, rounded down; the default counter."""
    chars = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    return F.floor(chars / fv.CHARS_PER_TOKEN).cast("bigint")


_ENCODERS: dict = {}


def _encoder(vocab_file: str, split_pattern: str):
    key = (vocab_file, split_pattern)
    if key not in _ENCODERS:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        _ENCODERS[key] = tiktoken.Encoding(
            name="local",
            pat_str=split_pattern,
            mergeable_ranks=load_tiktoken_bpe(vocab_file),
            special_tokens={},
        )
    return _ENCODERS[key]


def bpe_tokens(vocab_file: str, split_pattern: str) -> Counter:
    """Exact BPE counter from a vocabulary file that every executor can read.

    Texts cross to Python in Arrow batches; the encoder is built once per
    Python worker. Special-token text is counted as ordinary text.
    """

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(vocab_file, split_pattern)
        return texts.map(
            lambda t: len(enc.encode(t, disallowed_special=())) if t else 0
        )

    return lambda text: F.coalesce(count(text), F.lit(0)).cast("bigint")


def saved(original: Column, compressed: Column) -> Column:
    return original - compressed


def compression_ratio(original: Column, compressed: Column) -> Column:
    return F.when(original == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - compressed / original
    )


def cost_usd(input_tokens: Column, input_price: Column, output_tokens=None,
             output_price=None) -> Column:
    cost = input_tokens / F.lit(1e6) * input_price
    if output_tokens is None:
        return cost
    return cost + output_tokens / F.lit(1e6) * output_price
