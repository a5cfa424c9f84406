"""Counts over whole texts that the quality operators share, one pass in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.llm.common import SPACES, give_back, row, to_python

#: What is counted, all longs. Lines are the text's parts between \n that hold a word.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_caps_words",
    "n_lines", "n_ended_lines", "n_upper", "n_digits", "n_exclaims", "n_stops",
)
SYMBOLS = b"#*$%&|<>"
ENDINGS = (".", "!", "?", "\"", "'", ")", ":", "…", "。", "”", "»")
#: Characters whose number is taken by what their deletion shortens.
CLASSES = {"n_symbols": SYMBOLS, "n_upper": bytes(range(65, 91)), "n_digits": b"0123456789", "n_exclaims": b"!", "n_stops": b".,;:?"}
BATCH_BYTES = 8 << 20


def repeated_words(words: list[bytes], window: int = 3) -> tuple[int, int]:
    """(words in windows found twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(words) <= window:
        return 0, len(ids)
    codes, base = row[: len(row) - window + 1], len(ids)
    for i in range(1, window):
        if int(codes.max()) >= (1 << 62) // base:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * base + row[i : len(row) - window + 1 + i]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, len(ids)
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(row), bool)
    for i in range(window):
        inside[i : len(row) - window + 1 + i] |= twice
    return int(inside.sum()), len(ids)


def count(text: str | None) -> list[int]:
    """The numbers of COUNTS for a whole text; null and empty texts have none of anything."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    repeats, distinct = repeated_words(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    found = {
        "n_words": len(words), "word_chars": len(text) - sum(map(text.count, SPACES)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats,
        "n_distinct_words": distinct, "n_caps_words": sum(map(bytes.isupper, words)), "n_lines": len(lines), "n_ended_lines": sum(x.rstrip(SPACES).endswith(ENDINGS) for x in lines),
    }
    found |= {name: len(data) - len(data.translate(None, chars)) for name, chars in CLASSES.items()}
    return [found[name] for name in COUNTS]


def counted(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and the COUNTS of each whole text of ``docs``; no shuffle. What is carried must not be named as a count."""
    wanted = docs.select(*carry, F.col("text").alias("counted_text"))
    return _counted(wanted, carry, lambda batch: batch.column("counted_text"))


def counted_rows(docs: DataFrame, more: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(row, COUNTS): every row of ``docs`` as one struct, its text sent to Python once, with its counts.

    ``more`` names further doubles, each made of a batch's counts by the same worker: a function in Spark would take a second one beside it in every task.
    """
    return _counted(docs.select(row(docs)), ["row"], lambda batch: batch.column("row").field("text"), more)


def _counted(wanted: DataFrame, carried: list[str], texts: Callable[[pa.RecordBatch], pa.Array], more: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    more = more or {}
    schema = T.StructType([*(wanted.schema[c] for c in carried), *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                counts = np.array([count(x.as_py()) for x in texts(some)], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in carried), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), *(pa.array(make(counts), pa.float64()) for make in more.values())], schema.names)
            give_back()

    return to_python(wanted).mapInArrow(run, schema)
