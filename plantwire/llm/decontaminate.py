"""Benchmark passages in training texts, found in an FM-index of every shard.

A task cuts its documents into shards of about ``SHARD_WORDS`` words. Words that no test phrase has
cannot be part of an occurrence, so they and the ends of documents only separate runs; the words
in between are indexed. Test phrases are searched backwards, all at once, their occurrences are
located by sampled positions, and overlapping ones merge to spans that can be cut out.
Documents are never shuffled. Phrases reach the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .fm_index import FMIndex
from .staging import Stages

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
SHARD_WORDS = 1 << 20
#: Pairs of phrase and item that are sent to the tasks at once.
BLOCK = 1 << 17
_SLICE = 1 << 23

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of words; those of characters beyond ASCII all are.
_IN_WORD = np.array([chr(b) in "0123456789" + _UPPER + _LOWER or b > 127 for b in range(256)])

FOUND = StructType([
    StructField("n_words", LongType()), StructField("n_hit", LongType()),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("items", ArrayType(StringType())),
])


def _phrases(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (phrase, item): windows of ``width`` words, or all words of a shorter item."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    rows = benchmark.select(item.alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("phrase")).distinct()


class _Block:
    """Phrases of one block as rows of symbols, with their items."""

    def __init__(self, phrases: list[list[str]], items: list[str]):
        number: dict[tuple, int] = {}
        self.of = np.array([number.setdefault(tuple(p), len(number)) for p in phrases])
        split = list(number)
        self.words = sorted({w for p in split for w in p})
        at = {w: n + 1 for n, w in enumerate(self.words)}
        self.lengths = np.array([len(p) for p in split])
        self.symbols = np.zeros((len(split), int(self.lengths.max())), dtype=np.int64)
        for row, p in zip(self.symbols, split):
            row[: len(p)] = [at[w] for w in p]
        order = np.argsort(self.of, kind="stable")
        self.names, named = np.unique(np.array(items, dtype=object), return_inverse=True)
        self.items, self.bounds = named[order], np.searchsorted(self.of[order], np.arange(len(split) + 1))

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence in ``text``, symbols of words or 0."""
        index, found = FMIndex(text, len(self.words) + 1), []
        for length in np.unique(self.lengths).tolist():
            which = np.flatnonzero(self.lengths == length)
            low, high = index.ranges(self.symbols[which, :length])
            size = high - low
            total = int(size.sum())
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
            found.append((np.repeat(which, size), index.locate(rows)))
        return tuple(np.concatenate(part) for part in zip(*found))

    def items_of(self, doc: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) of distinct (document, phrase)."""
        pairs = np.unique(doc * len(self.lengths) + phrase)
        doc, phrase = pairs // len(self.lengths), pairs % len(self.lengths)
        size = self.bounds[phrase + 1] - self.bounds[phrase]
        at = np.repeat(self.bounds[phrase] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(int(size.sum()))
        pairs = np.unique(np.repeat(doc, size) * len(self.names) + self.items[at])
        return pairs // len(self.names), pairs % len(self.names)


def _words(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, ...]:
    """Words of texts: symbol (0: not in ``known``), document, and start and end in code points."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _IN_WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_FOLD[data[inside]])])
    symbol = pc.fill_null(pc.index_in(tokens, known), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    origin = points[bounds[doc]]
    return symbol, doc, points[starts] - origin, points[ends] - origin


def _found(block: _Block, parts: list[tuple], n_docs: int, before: list | None) -> pa.Array:
    """Column of results for the documents of one shard; ``before``: what earlier blocks found."""
    symbol, doc, start, end = (np.concatenate(p) for p in zip(*parts))
    known = symbol > 0
    fresh = known.copy()
    fresh[1:] &= ~(known[:-1] & (doc[1:] == doc[:-1]))
    at = np.flatnonzero(known)
    run = np.cumsum(fresh[at]) - 1
    cover = np.zeros(len(symbol) + 1, dtype=np.int64)
    owners = names = np.zeros(0, dtype=np.int64)
    if len(at):
        place = np.arange(len(at)) + run
        text = np.zeros(len(at) + int(run[-1]) + 1, dtype=np.int64)
        text[place] = symbol[at]
        phrase, where = block.occurrences(text)
        first = at[np.searchsorted(place, where)]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + block.lengths[phrase], -1)
        owners, names = block.items_of(doc[first], phrase)
    base = np.searchsorted(doc, np.arange(n_docs + 1))
    lists = [[] for _ in range(n_docs)]
    for d, name in zip(owners.tolist(), names.tolist()):
        lists[d].append(str(block.names[name]))
    if before is not None:
        for d, old in enumerate(before):
            lists[d] = sorted({*lists[d], *old["items"]})
            for span in old["spans"]:
                low, high = (base[d] + np.searchsorted(start[base[d] : base[d + 1]], span[s]) for s in ("start", "end"))
                cover[low] += 1
                cover[high] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    opens, closes = hit.copy(), hit.copy()
    same = doc[1:] == doc[:-1]
    opens[1:] &= ~(hit[:-1] & same)
    closes[:-1] &= ~(hit[1:] & same)
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
    spans = pa.ListArray.from_arrays(
        np.concatenate([[0], np.cumsum(np.bincount(doc[opens], minlength=n_docs))]).astype(np.int32),
        pa.StructArray.from_arrays([pa.array(start[opens]), pa.array(end[closes])], ["start", "end"]),
    )
    counts = [np.bincount(d, minlength=n_docs).astype(np.int64) for d in (doc, doc[hit])]
    return pa.StructArray.from_arrays([*map(pa.array, counts), spans, pa.array(lists, pa.list_(pa.string()))], FOUND.names)


def _search(blocks, text: str, out: str, columns: list[str], shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks.value
        known = pa.array([w.encode() for w in block.words], pa.large_binary())
        rows, parts, n_docs, n_words = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            before = table[out].to_pylist() if out in table.schema.names else None
            found = _found(block, parts, n_docs, before)
            kept = [c for c in columns if c != out]
            arrays = [pa.concat_arrays(table[c].chunks) if table[c].num_chunks else pa.array([], table[c].type) for c in kept]
            return pa.RecordBatch.from_arrays([*arrays, found], [*kept, out])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE, "right")))
                part = batch.slice(at, stop - at)
                symbol, doc, start, end = _words(part[text], known)
                rows.append(part.drop_columns([text]) if text not in columns else part)
                parts.append((symbol, doc + n_docs, start, end))
                n_docs, n_words, at = n_docs + part.num_rows, n_words + len(symbol), stop
                if n_words >= shard_words:
                    yield flush()
                    rows, parts, n_docs, n_words = [], [], 0, 0
        if rows:
            yield flush()

    return run


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", keep: list[str] | None = None,
    width: int = WIDTH, block: int = BLOCK, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with the column ``out``: n_words, n_hit, spans to remove and items found.

    ``benchmark``: item_id, text; other columns are ignored. A phrase is ``width`` consecutive
    words of an item, or all words of a shorter one. n_hit counts the words of a document inside
    occurrences; ``spans`` are their merged runs, in code points from the first word's start to
    the last one's end; ``items`` are the distinct ids, as sorted strings, of items with an
    occurring phrase. A null id counts as empty text. Null and empty texts have no words, nothing
    is found in or for them. All columns of ``docs`` stay, or those in ``keep``; one of the name
    ``out`` is replaced. Repeated rows each get their result. Very long texts make one shard of
    their own size. An empty table gives no rows, an empty benchmark no finds. Benchmarks with more than
    ``block`` pairs of phrase and item are searched in several passes.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "leaks")
    phrases = stages.write(_phrases(benchmark, width), "phrases")
    n_blocks = max(1, -(-phrases.count() // block))
    number = F.pmod(F.xxhash64("phrase", "item"), F.lit(n_blocks))
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    rows = docs.select(*dict.fromkeys([*names, text]))
    done = False
    for b in range(n_blocks):
        # about ``block`` short rows
        pairs = phrases.filter(number == b).select("phrase", "item").toArrow().to_pydict()
        if not pairs["item"]:
            continue
        sent = spark.sparkContext.broadcast(_Block(pairs["phrase"], pairs["item"]))
        left = names if b == n_blocks - 1 else list(dict.fromkeys([*names, text]))
        shape = StructType([*[rows.schema[c] for c in left], StructField(out, FOUND)])
        rows, done = rows.mapInArrow(_search(sent, text, out, [*left, out], shard_words), shape), True
    if not done:
        count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
        none = F.struct(count.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(FOUND["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"))
        rows = rows.withColumn(out, none)
    return rows.select(*names, out)


def cut(text: str = "text", leaks: str = "leaks") -> Column:
    """The text without the spans found in it; a null text stays null."""
    spans = F.col(leaks)["spans"]
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, stops, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.col(text).isNotNull(), F.array_join(kept, ""))


ORACLE = f"""WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
item AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, w[s : s + {WIDTH - 1}] AS phrase FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS s FROM (
      SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark) WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM item),
gram AS (
  SELECT rid, s, n, w[s : s + n - 1] AS phrase FROM (
    SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, s, n, item FROM gram JOIN item USING (phrase)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
names AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN places USING (rid) LEFT JOIN names USING (rid)"""
