"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Texts longer than this are encoded in parts, which bounds the memory of one call.
PART = 400_000
#: Where a part may end: before a blank or line feed behind a sign, since no piece of the tokenizer's own pattern goes on there.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(kept: dict) -> tiktoken.Encoding:
    """Encoding of ranks and pattern, made once per worker process and kept with them."""
    if "encoding" not in kept:
        kept["encoding"] = tiktoken.Encoding("own", pat_str=kept["pattern"], mergeable_ranks=kept["ranks"], special_tokens={})
    return kept["encoding"]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The whole text in parts of at least `size` signs but the last, that give the same tokens as the whole."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of docs (doc_id bigint, text string), by the rank file at path; a NULL text has no tokens."""
    import public_tokenizers

    with open(path or vocabulary(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "pattern": public_tokenizers.PATTERN})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        for batch in batches:
            n = [sum(len(encode(p)) for p in parts(text)) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")
