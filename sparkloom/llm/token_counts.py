"""Token counts by public tokenizers: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

#: Letters of which every version of Unicode says so (Latin, kana, Chinese characters, Hangul).
_LETTER = r"A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Behind a letter, these always start a new pre-token of the byte-level pattern: a space before a letter, a digit, and
#: punctuation of East Asian texts. No special token holds one.
SAFE = re.compile(rf"(?<=[{_LETTER}])(?= [{_LETTER}]|[0-9\u3001\u3002\u300c-\u300f\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f])")
PIECE_CHARS, BATCH_BYTES = 1 << 16, 1 << 20


def tokenizer_path(name: str) -> str:
    """name itself if it is a path, else that of the public tokenizer file so called."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts_like_bytes(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that SAFE is for: the byte-level pattern and nothing before it."""
    before = settings.get("pre_tokenizer") or {}
    return not settings.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")


@functools.cache
def counter(name: str):
    """(a function from a list of texts to the list of their token counts, whether long texts may be cut); one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's task slots are the parallelism
    path = str(tokenizer_path(name))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        known.no_truncation()
        known.no_padding()
        return lambda texts: [len(x) for x in known.encode_batch_fast(texts, add_special_tokens=False)], _cuts_like_bytes(json.loads(known.to_str()))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(x) for x in encoding.encode_ordinary_batch(texts, num_threads=1)], True


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about `most` characters, cut at safe boundaries only; a text without any stays whole."""
    at = 0
    while len(text) - at > most:
        found = SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def lengths(texts: list[str | None], count, split: bool) -> list[int]:
    """Token counts of texts, encoded in batches of about BATCH_BYTES."""
    totals = [0] * len(texts)
    batch: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for owner, n in zip(owners, count(batch), strict=True):
            totals[owner] += n
        batch.clear()
        owners.clear()
        held = 0

    for k, text in enumerate(texts):
        for part in (pieces(text) if split else (text,)) if text else ():
            batch.append(part)
            owners.append(k)
            held += len(part.encode())
            if held >= BATCH_BYTES:
                flush()
    if batch:
        flush()
    return totals


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, in one pass without a shuffle.

    Counts are those of the tokenizer's own library, without begin, end or added special tokens. Tokenizers whose
    settings are byte-level get long texts in parts, cut where a pre-token must start; all others get whole texts. Batches
    are balanced by bytes. Null and empty texts have no bytes and no tokens; equal rows give equal rows; null ids
    stay null; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, split = counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = lengths(part.column(2).to_pylist(), count, split)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    counted = rows.mapInArrow(per_batch, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
