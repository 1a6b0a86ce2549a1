"""Token counts of whole texts, without keeping a token.

Texts are cut at ASCII white space. That is safe for tokenizers that drop white space and never join across it (each
piece's pre-tokens, Unicode normal form and special strings lie inside it), which `check_safe` demands of the
tokenizer's file. Distinct pieces are encoded once a task, in batches of equal bytes, and only the lengths are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import docs_of
from .textvec import Words, row_sums, slices

TOKENIZER = "word_bpe_49k.json"
#: Bytes of pieces in one call of the encoder.
BATCH_BYTES = 256 << 10
#: Pieces whose lengths a task remembers, then it begins anew, and the bytes of the longest of them (some 90 MB; 150 MB at most).
REMEMBERED, LONGEST = 600_000, 64


def check_safe(spec: dict) -> None:
    """White space must end pieces: it is matched by no pre-token and by no added token."""
    steps = spec["pre_tokenizer"]["pretokenizers"]
    split = next(s for s in steps if s["type"] == "Split")
    if not split["invert"] or split["behavior"] != "Removed" or any(" " in t["content"] for t in spec["added_tokens"]):
        raise ValueError("this tokenizer joins across white space; texts can't be cut there")


def counts(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    with open(path) as f:
        check_safe(json.load(f))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[bytes, int] = {}
    for batch in slices(batches):
        words = Words(batch.column("text"), lower=False)
        distinct, each = words.distinct()
        distinct = distinct.to_pylist()
        fresh = [w for w in distinct if w not in known]
        own = dict(zip(fresh, encode(tokenizer, fresh), strict=True))
        lengths = np.fromiter((own[w] if w in own else known[w] for w in distinct), np.int64, len(distinct))
        remember(known, own)
        n = row_sums(lengths[each], words.first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(words.offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )


def remember(known: dict[bytes, int], own: dict[bytes, int]) -> None:
    """Adds to what is known; long pieces, such as texts without white space, hardly come again and would fill the memory."""
    if len(known) + len(own) > REMEMBERED:
        known.clear()
    known.update((w, n) for w, n in own.items() if len(w) <= LONGEST)


def encode(tokenizer, words: list[bytes]) -> list[int]:
    """Token counts of the pieces, encoded in batches of equal bytes."""
    out: list[int] = []
    batch = np.cumsum([len(w) for w in words]) // BATCH_BYTES
    ends = np.searchsorted(batch, np.unique(batch), "right").tolist() if words else []
    for lo, hi in zip([0, *ends], ends, strict=False):
        texts = [w.decode("utf-8", "replace") for w in words[lo:hi]]
        out += [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs.

    Null or empty text: 0 bytes, 0 tokens. Rows are independent, so repeated rows, equal texts and null ids stay as they
    are, and there are no ties; an empty table gives an empty one; other columns, whatever their names, are ignored. Very
    long texts are cut into pieces like any other; a text without white space is a single piece.
    """
    import os

    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return counts(batches, path, limit)

    return docs_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
