"""Problem 7: the whole corpus as ids of a public byte-level BPE.

Words (pre-tokens) are found once per document, numbered within a block of documents, and
only each block's distinct words are shuffled by word; there every word of the corpus is
encoded once, or once per WORD_BLOCKS blocks that hold it, so that no word's rows meet without
bound in one task. Its ids travel back to the blocks, where documents are put together by
position. A word that makes up a third of the corpus costs one row per block.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.sources.tables import materialised

TOKENIZER_FOLDER = os.environ.get("CODEXWEAVE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of this vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: UTF-8 bytes of text in one block; a longer document is a block by itself.
BLOCK_BYTES = 2 << 20
#: Blocks whose rows of one word meet in one task.
WORD_BLOCKS = 2048
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
BLOCKS = "block long, doc_ids array<long>, lens array<int>, slots binary, words array<string>"


def rank_table(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=rank_table(path), special_tokens={})


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, blank or other, as the pattern sees them."""
    import regex

    points = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, points):
            table[[ord(c) for c in run.group()]] = cls
    return table


def word_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Offsets at which a word of the pattern begins, over documents laid end to end.

    ``codes`` are code points, ``doc_starts`` the offset of each non-empty document.
    """
    n = len(codes)
    cls = char_classes()[codes]
    fresh = np.zeros(n, bool)  # first character of a document
    fresh[doc_starts] = True
    last = np.zeros(n, bool)  # last character of a document
    last[doc_starts[1:] - 1] = True
    last[n - 1] = True
    start = fresh.copy()
    start[1:] |= cls[1:] != cls[:-1]
    blank = cls == BLANK
    # a run of blanks before something else gives up its last character
    ends_run = blank & ~last
    ends_run[:-1] &= ~blank[1:]
    start |= ends_run
    # which, if it is a plain space, goes with what follows
    glued = ends_run & (codes == 0x20)
    start[1:] &= ~(glued[:-1] & ~fresh[1:])
    # contractions where an apostrophe begins a word
    for at in np.flatnonzero((codes == 0x27) & start):
        tail = []
        for k in (at + 1, at + 2):
            if k >= n or fresh[k]:
                break
            tail.append(chr(codes[k]))
        pair = "".join(tail)
        size = 1 if pair[:1] in ("s", "t", "m", "d") and pair else 2 if pair in ("re", "ve", "ll") else 0
        if size:
            start[at + 1 : at + 1 + size] = False
            after = at + 1 + size
            if after < n:
                start[after] = True if not (cls[after] == BLANK) else start[after]
    return np.flatnonzero(start)


def _block(block: int, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row of BLOCKS: documents (no null, offset 0) as slots into the block's distinct words."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[: offsets[-1]] if offsets[-1] else b""
    codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = np.ones(len(codes), np.int32)
    for limit in (0x80, 0x800, 0x10000):
        width += codes >= limit
    at_byte = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(width, out=at_byte[1:])
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    if len(codes):
        begins = at_byte[word_starts(codes, np.searchsorted(at_byte, filled))]
    else:
        begins = np.zeros(0, np.int64)
    bounds = np.append(begins, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data))
    coded = words.dictionary_encode()
    lens = np.diff(np.searchsorted(begins, offsets)).astype(np.int32)
    slots = np.asarray(coded.indices, np.int32).tobytes()
    columns = [
        pa.array([block], pa.int64()),
        pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())),
        pa.array([lens], pa.list_(pa.int32())),
        pa.array([slots], pa.binary()),
        pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "lens", "slots", "words"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    for batch in batches:
        doc_ids, texts = batch.column(0), batch.column(1)
        size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
        at = 0
        while at < len(texts):
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + BLOCK_BYTES, "right")))
            part = pa.array(texts.slice(at, end - at).fill_null("").to_pylist(), pa.string())
            yield _block(block, doc_ids.slice(at, end - at), part)
            block += 1
            at = end


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary  # a word by itself is one word of the pattern
        word, ids = None, []
        for batch in batches:
            out = []
            for value in batch.column("word").to_pylist():
                if value != word:
                    word, ids = value, encode(value)
                out.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("slot"), pa.array(out, pa.list_(pa.int32()))], ["block", "slot", "ids"]
            )

    return run


def _assemble(documents: pa.Table, coded: pa.Table) -> pa.Table:
    """The documents of one block, from their slots and the ids of the block's words."""
    doc_ids, out = [], []
    slot = np.asarray(coded.column("slot").combine_chunks(), np.int32)
    ids = coded.column("ids").combine_chunks()
    row_of = np.zeros(len(slot), np.int32)
    row_of[slot] = np.arange(len(slot), dtype=np.int32)
    for row in range(documents.num_rows):
        lens = np.asarray(documents.column("lens")[row].values, np.int64)
        slots = np.frombuffer(documents.column("slots")[row].as_py(), np.int32)
        taken = ids.take(pa.array(row_of[slots])) if len(slots) else pa.array([], ids.type)
        ends = np.asarray(taken.offsets, np.int64)
        bounds = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=bounds[1:])
        doc_ids.append(documents.column("doc_ids")[row].values)
        out.append(pa.ListArray.from_arrays(pa.array((ends - ends[0])[bounds].astype(np.int32)), taken.flatten()))
    if not out:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    return pa.table({"doc_id": pa.concat_arrays(doc_ids), "ids": pa.concat_arrays(out)})


def corpus_ids(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id bigint, ids array<int>`` of every row of ``documents`` by byte_bpe_50k.

    No special tokens: their strings are ordinary text. Empty and null texts give an empty
    list. One row out for each row in; a null doc_id stays null.
    """
    path = os.path.join(folder or TOKENIZER_FOLDER, RANKS)
    blocks = materialised(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks, BLOCKS), "token-blocks")
    words = blocks.select("block", F.posexplode("words").alias("slot", "word"))
    groups = -(-blocks.count() // WORD_BLOCKS)  # from the files' footers
    spread = words.repartition("word") if groups <= 1 else words.repartition("word", F.pmod(F.xxhash64("block"), F.lit(groups)))
    coded = (
        spread
        .sortWithinPartitions("word")
        .mapInArrow(_encode_words(path), "block long, slot int, ids array<int>")
    )
    bodies = blocks.select("block", "doc_ids", "lens", "slots")
    return bodies.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_table(path)
        table = pa.array([token for token, _ in sorted(ranks.items(), key=lambda x: x[1])], pa.binary())
        for batch in batches:
            ids = batch.column("ids")
            texts = []
            for row in range(len(ids)):
                tokens = table.take(ids[row].values) if ids[row].is_valid else None
                texts.append(None if tokens is None else b"".join(tokens.to_pylist()).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded(ids: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, text``: id lists joined, in place, to the fixed table of token bytes.

    The table has as many rows as the vocabulary (50,256) at any corpus size. An empty list
    gives an empty text, a null list null, an id outside the table an error.
    """
    path = os.path.join(folder or TOKENIZER_FOLDER, RANKS)
    return ids.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, text string")
