"""Token ids on disk: frequency-ranked, byte-aligned, with control bytes apart from data bytes.

An id is replaced by its rank in the corpus (most frequent first) and written in one to four
bytes, least significant first. Two bits of a control byte say how many, four ids to a byte. A
reader turns control bytes into lengths by one table lookup and gathers the data bytes.

A data set is a folder with two tables. ``ranks``: the ids by rank, one row. ``blocks``: part
(increasing with doc_id), block (position in the part), doc_ids, doc_lengths, n_ids, control
and data. Documents are in ascending doc_id order by (part, block, position). Parts are cut at
quantiles of doc_id; blocks hold up to BLOCK_IDS ids, more only for a single longer document.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 18
#: Bounds of a task's memory: words encoded at a time, words remembered.
BATCH_WORDS = 5_000
CACHED_WORDS = 400_000

#: Bytes of each of the four ids of a control byte.
_SIZES = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2 ** 32."""
    ranks = np.asarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of these bytes."""
    sizes = _SIZES[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    source = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    out = np.zeros(n, dtype=np.uint32)
    for byte in range(4):
        wide = np.flatnonzero(sizes > byte) if byte else slice(None)
        out[wide] |= source[starts[wide] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out

#: Between a letter or digit and a full stop or comma.
_MARK = re.compile(rb"(?<=[a-z0-9])(?=[.,])")
#: Lower-case letters of ASCII and Latin-1 in UTF-8: composed, and the same in lower case.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Characters that stand for the bytes of a word in the vocabulary, where they are not those of Latin-1.
_PLAIN_BYTES = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN_BYTES)}


class _Encoder:
    """Ids by word. White space never reaches the vocabulary, so a text's ids are those of its words.

    Words are cut at ASCII white space only; everything else in them is left to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(Path(path).read_text(encoding="utf-8"))
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _cut(text: str) -> bytes:
        """The text with fewer distinct words by what the vocabulary does anyway: lower case, a cut between letter and mark."""
        data = text.encode("utf-8", "surrogatepass")
        if b"<|" in data:  # special tokens are matched before lower-casing
            return data
        return _MARK.sub(b" ", data.lower())

    def _known_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, unseen ones learnt first."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        ids = list(map(self.words.get, words))
        unseen = [k for k, found in enumerate(ids) if found is None]
        fresh = []
        # lower-case Latin letters are one piece of text to the vocabulary, as it stands but for the names of bytes
        split_word, whole = self.tokenizer.model.tokenize, _LETTERS.fullmatch
        for k in unseen:
            word = words[k]
            if word in self.older:
                self.words[word] = self.older[word]
            elif whole(word):
                text = word.decode("latin-1")
                if not text.isascii():
                    text = text.translate(_BYTE_NAMES)
                self.words[word] = array("I", [t.id for t in split_word(text)]).tobytes()
            else:
                fresh.append(word)
        for at in range(0, len(fresh), BATCH_WORDS):
            some = fresh[at : at + BATCH_WORDS]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            self.words.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, found, strict=True))
        for k in unseen:
            ids[k] = self.words[words[k]]
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null or empty: none. Only distinct words are handled one by one."""
        cut = pa.array([self._cut(t) if t else b"" for t in texts], pa.large_binary())
        split = pc.ascii_split_whitespace(cut.view(pa.large_string()))  # bytes that are no valid text stay as they are
        flat = split.flatten()
        full = pc.not_equal(pc.binary_length(flat), 0)
        bounds = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy()]  # words before each text
        words = flat.filter(full).dictionary_encode()
        code = words.indices.to_numpy()
        ids = self._known_words(words.dictionary.view(pa.large_binary()).to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        begin = (np.cumsum(size) - size)[code]
        size = size[code]
        ends = np.cumsum(size)
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        at = np.repeat(begin - ends + size, size)
        at += np.arange(len(at))
        found = pool[at]
        cuts = np.append(0, ends)[bounds].tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _pieces(values: list, size, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of values whose sizes add up to about ``most``."""
    at = 0
    while at < len(values):
        to, total = at, 0
        while to < len(values) and (to == at or total < most):
            total += size(values[to])
            to += 1
        yield at, to
        at = to


def _encode_rows(path: str, bounds: list[int]):
    edges = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, pack_row = _encoder(path), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for a, b in _pieces(texts, lambda t: len(t or ""), 4_000_000):
                ids = [np.append(x, np.uint32(END_ID)) for x in encoder.encode(texts[a:b])]
                rows = batch.iloc[a:b]
                yield pd.DataFrame({
                    "part": np.searchsorted(edges, rows["doc_id"].to_numpy(dtype=np.int64), "right").astype(np.int32),
                    "doc_id": rows["doc_id"].to_numpy(dtype=np.int64),
                    "n_ids": [len(x) for x in ids],
                    "ids": [pack_row(x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes()) for x in ids],
                    "wide": [bool(x.max() >= 1 << 16) for x in ids],
                })

    return run


def _ids(packed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), dtype="<u4" if wide else "<u2").astype(np.uint32)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ids and counts, one for each id and task."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for packed, wide in zip(batch["ids"], batch["wide"], strict=True):
            part = np.bincount(_ids(packed, wide), minlength=len(total))
            part[: len(total)] += total
            total = part
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"id": seen.astype(np.int64), "n": total[seen]})


def _write_blocks(ranks: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block = None, 0
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            ids = np.concatenate([x for _, x in held])
            control, data = pack(ranks[ids])
            return pd.DataFrame([(part, block, [d for d, _ in held], [len(x) for _, x in held], len(ids), control, data)], columns=_BLOCK_COLUMNS)

        size = 0
        for batch in batches:
            for p, doc, packed, wide in zip(batch["part"], batch["doc_id"], batch["ids"], batch["wide"], strict=True):
                if held and (p != part or size >= BLOCK_IDS):
                    yield flush()
                    held, block, size = [], block + 1, 0
                if p != part:
                    part, block = p, 0
                held.append((doc, _ids(packed, wide)))
                size += len(held[-1][1])
        if held:
            yield flush()

    return run


_BLOCK_COLUMNS = ["part", "block", "doc_ids", "doc_lengths", "n_ids", "control", "data"]
_BLOCK_SCHEMA = "part int, block int, doc_ids array<bigint>, doc_lengths array<bigint>, n_ids bigint, control binary, data binary"


def write(docs: DataFrame, folder: str, work: str, path: str | None = None, parts: int | None = None) -> None:
    """Encode every whole text and write the data set to ``folder``; ``work`` gets the encoded rows, which can go afterwards.

    ``docs``: doc_id, text; other columns are ignored. Null and empty texts give the end id
    alone. Rows without doc_id are left out, as the order knows no place for them. Rows that
    repeat a doc_id are all written, shorter first, then by their bytes. An empty table gives a
    data set without blocks. ``parts``: number of files by doc_id, by default four for each of
    the session's shuffle partitions.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER)
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # quantiles come from a sketch of fixed size
    cuts = rows.select("doc_id").agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    encoded = rows.mapInPandas(_encode_rows(path, sorted(set(cuts))), "part int, doc_id bigint, n_ids bigint, ids binary, wide boolean")
    encoded.write.option("compression", "none").parquet(work)
    staged = spark.read.schema(encoded.schema).parquet(work)
    # one row for each id that occurs, bounded by the vocabulary
    counts = staged.select("ids", "wide").mapInPandas(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = [int(r[0]) for r in counts.orderBy(F.col("n").desc(), "id").select("id").collect()]
    ranks = np.zeros(max(by_rank, default=0) + 1, dtype=np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    staged.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n_ids", "ids").mapInPandas(
        _write_blocks(ranks), _BLOCK_SCHEMA
    ).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.range(1, numPartitions=1).select(F.split(F.lit(",".join(map(str, by_rank))), ",").alias("ids")).write.parquet(f"{folder}/ranks")


def _read_blocks(by_rank: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = by_rank[unpack(row.control, row.data, row.n_ids)]
                ends = np.cumsum(row.doc_lengths)
                yield pd.DataFrame({
                    "part": row.part, "block": row.block, "place": np.arange(len(ends)), "doc_id": row.doc_ids,
                    "offset": ends - row.doc_lengths, "ids": [ids[e - n : e] for e, n in zip(ends, row.doc_lengths, strict=True)],
                })

    return run


def _ranks(spark: SparkSession, folder: str) -> np.ndarray:
    listed = spark.read.parquet(f"{folder}/ranks").first()[0]
    return np.array([int(x) for x in listed if x], dtype=np.uint32)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a data set: part, block, place, doc_id, offset (ids before it in its block), ids.

    Every block is decoded where it is read; the table of ranks is bounded by the vocabulary.
    """
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    return blocks.mapInPandas(
        _read_blocks(_ranks(spark, folder)), "part int, block int, place int, doc_id long, offset long, ids array<bigint>"
    )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read back from its files: doc_id, start, n_tokens and ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is taken over the ids as
    little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    by_rank = _ranks(spark, folder)
    decode = _read_blocks(by_rank)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in decode(batches):
            yield pd.DataFrame({
                "part": docs["part"], "block": docs["block"], "doc_id": docs["doc_id"], "offset": docs["offset"],
                "n_tokens": [len(x) for x in docs["ids"]], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in docs["ids"]],
            })

    docs = blocks.mapInPandas(run, "part int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    # ids before a block: those of earlier parts (one row for each part) and of earlier blocks of its part
    sizes = blocks.select("part", "block", "n_ids")
    before_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part")
    )
    before_block = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before_block", F.coalesce(F.sum("n_ids").over(before_block), F.lit(0))).join(before_part, "part")
    return docs.join(starts.select("part", "block", (F.col("before_part") + F.col("before_block")).alias("before")), ["part", "block"]).select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
