"""The text operators on streams. All are functions of one row, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.tokenizer import WordTokenizer
from lexforge.operators.tables import explode_tokens


def token_stream(stream: DataFrame, text: str = "text", keys: list[str] | None = None, tokenizer: WordTokenizer | None = None) -> DataFrame:
    """keys, pos, kind, text for each token; append mode."""
    return explode_tokens(stream, text, keys, tokenizer)


def windowed_counts(stream: DataFrame, time: str, text: str = "text", width: str = "10 minutes", late: str = "10 minutes", tokenizer: WordTokenizer | None = None) -> DataFrame:
    """Tokens counted in tumbling windows by event time: start, kind, text, n. Rows later than ``late`` are dropped."""
    tokens = explode_tokens(stream.withWatermark(time, late), text, [time], tokenizer)
    return tokens.groupBy(F.window(time, width).alias("w"), "kind", "text").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "text", "n")
