"""SentencePiece encoding and decoding by suffix-array matching.

A batch of unseen words is laid out as one text and its suffixes are sorted. Binary search
finds, for every piece of the vocabulary, the range of suffixes that begin with it; each
occurrence is an edge from its start to its end. Edges are sorted by end position and relaxed
from left to right, all words of the batch in step.

The vocabulary is a merge model: its encoding takes the best-ranked pair first. Such an
encoding is the only path of edges on which every two neighbours stay apart when merged
afresh, so relaxing keeps the one edge whose piece is stable behind the last piece of the
prefix before it. Stability of a pair is decided by undoing its merges in reverse order.

Words begin at a space, at a full stop or comma, and at or behind a line feed or other unknown
character, where no piece crosses (read from the model), so each distinct word is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .staging import give_back

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bounds of what a task holds: characters in one suffix array, of text handled at a time, words remembered.
BLOCK_CHARS = 250_000
TEXT_CHARS = 3_000_000
CACHED_WORDS = 200_000
#: Rows whose texts, or whose ids, are handled at a time.
ROWS = 1024
ID_ROWS = 256
_PAIR_SLOTS = 1 << 21


class PieceModel:
    """Vocabulary, merge table and word cache of one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.longest = max(map(len, self.ids))
        self.score = {i: model.get_score(i) for i in normal}
        inside = [p for p in self.ids if SPACE in p.lstrip(SPACE) or not set(p) <= self.chars]
        runs = [p for p in self.ids if p[:2] == SPACE * 2 and p.strip(SPACE)]
        if inside or runs:
            raise ValueError(f"pieces cross word borders: {(inside + runs)[:3]}")
        # marks that words end in: a cut before them is safe except behind characters that share a piece with them
        self.marks = {m: sorted({p[k] for p in self.ids for k in range(len(p) - 1) if p[k + 1] == m}) for m in ".,"}
        self._runs: dict[int, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._merges()
        order = sorted(p for p in self.ids if not (len(p) > 1 and p[0] == p[-1] == SPACE))
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted(self.chars))}
        coded, wide = [self._code(p) for p in order], 2 * self.longest
        self.coded = np.array(coded, dtype=f"S{wide}")
        self.coded_end = np.array([p.ljust(wide, b"\xff") for p in coded], dtype=f"S{wide}")
        self.order = np.array([self.ids[p] for p in order], dtype=np.int32)
        ends = np.array([[self.alphabet[c] for c in (p[0], p[:2][-1], p[-2:][0], p[-1])] for p in order])
        self.single = np.array([len(p) == 1 for p in order])
        self.first_two, self.last_two = self._meeting(ends[:, 0], ends[:, 1]), self._meeting(ends[:, 2], ends[:, 3])
        self.lengths = np.array([len(p) for p in order], dtype=np.int32)
        output = [b"" if not (i in self.score or model.is_byte(i)) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.output_pool = np.frombuffer(b"".join(output), dtype=np.uint8)
        self.output_size = np.array([len(p) for p in output])
        self.output_begin = np.cumsum(self.output_size) - self.output_size
        self._known = np.full(_PAIR_SLOTS, -1, dtype=np.int64)
        self._verdict = np.zeros(_PAIR_SLOTS, dtype=bool)
        self._alone = np.zeros(n, dtype=bool)
        for i in self.order:
            self._alone[i] = self.plain(self.pieces[i]) == [i]

    @staticmethod
    def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of 16 bits for pairs of characters."""
        return (a * 40_503 + b * 9_973) & 0xFFFF

    def _code(self, piece: str) -> bytes:
        return np.array([self.alphabet[c] for c in piece], dtype=">u2").tobytes()

    def plain(self, text: str) -> list[int]:
        """Merge pair by pair, best score first, leftmost on ties: for single pieces and runs of spaces."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.score[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids]
            if not scored:
                break
            k = min(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def _merges(self) -> None:
        """Rank of each piece, the pair it was merged from last, and the table of such pairs."""
        n = len(self.pieces)
        multi = sorted((i for i in self.score if len(self.pieces[i]) > 1), key=lambda i: (-self.score[i], i))
        self.rank = np.full(n, -1, dtype=np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for r, i in enumerate(multi):
            self.rank[i] = r
        pairs = []
        for i in multi:
            parts = self._last_pair(self.pieces[i])
            if parts:
                self.left[i], self.right[i] = parts
                pairs.append((parts[0] * n + parts[1], self.rank[i]))
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], dtype=np.int64)

    def _last_pair(self, piece: str) -> tuple[int, int] | None:
        """The two symbols whose merge gives the whole piece; None if merging does not give it."""
        parts = list(piece)
        while len(parts) > 2:
            scored = [(-self.score[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids]
            if not scored:
                return None
            k = min(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def _stable(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether pieces stay apart when their texts are merged as one, by undoing merges latest first."""
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        out, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        n = len(self.pieces)
        while len(live):
            x, y = a[live], b[live]
            keys = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            met = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < limit[live])
            out[live[met]] = False
            live = live[~met]
            x, y = a[live], b[live]
            rx, ry = self.rank[x], self.rank[y]
            done = (rx < 0) & (ry < 0)
            live, x, y, rx, ry = live[~done], x[~done], y[~done], rx[~done], ry[~done]
            # on equal ranks the left piece, being leftmost, was merged first, so the right one is undone first
            undo = rx > ry
            limit[live] = np.where(undo, rx, ry + 1)
            a[live] = np.where(undo, self.right[x], x)
            b[live] = np.where(undo, y, self.left[y])
        return out

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``_stable`` with a table of pairs already decided."""
        keys = first.astype(np.int64) * len(self.pieces) + second
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        new = np.flatnonzero(self._known[slots] != keys)
        out = self._verdict[slots]
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            verdict = self._stable(fresh // len(self.pieces), fresh % len(self.pieces))
            out[new] = verdict[back]
            self._known[slots[new]] = keys[new]
            self._verdict[slots[new]] = self._last_write(slots[new], verdict[back])
        return out

    @staticmethod
    def _last_write(slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values such that equal slots hold the value of the last key written to them."""
        last = np.zeros(len(slots), dtype=np.int64)
        order = np.argsort(slots, kind="stable")
        ends = np.flatnonzero(np.append(slots[order][1:] != slots[order][:-1], True))
        runs = np.diff(np.append(-1, ends))
        last[order] = np.repeat(order[ends], runs)
        return values[last]

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every occurrence of a piece in the coded text."""
        width = self.longest
        padded = np.concatenate([codes, np.zeros(width, dtype=codes.dtype)]).astype(">u2")
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)]
        # suffixes compare by their first ``longest`` characters; ranks double their reach in each round
        rank, reach = codes.astype(np.int64), 1
        while True:
            keys = rank * (int(rank.max(initial=0)) + 1)
            keys[: max(len(rank) - reach, 0)] += rank[reach:]
            suffixes = np.argsort(keys)
            if 2 * reach >= width:
                break
            ordered = keys[suffixes]
            rank[suffixes] = np.cumsum(np.append(1, ordered[1:] != ordered[:-1]))
            reach *= 2
        suffixes = suffixes.astype(np.int32)
        table = np.ascontiguousarray(windows[suffixes]).view(f"S{2 * width}").ravel()
        # pieces whose first or last two characters never meet here have no range to search for
        met = np.zeros(1 << 16, dtype=bool)
        met[self._meeting(codes[:-1], codes[1:])] = True
        sought = np.flatnonzero(self.single | (met[self.first_two] & met[self.last_two]))
        low = np.searchsorted(table, self.coded[sought], "left")
        count = np.searchsorted(table, self.coded_end[sought], "right") - low
        piece = np.repeat(sought.astype(np.int32), count)
        at = np.arange(len(piece), dtype=np.int32) + np.repeat((low - np.cumsum(count) + count).astype(np.int32), count)
        return suffixes[at], self.lengths[piece], self.order[piece]

    def _encode_block(self, words: list[str]) -> list[bytes]:
        """Ids of words made of known characters only."""
        codes = np.zeros(sum(map(len, words)) + len(words), dtype=np.int64)
        at, begins = 0, np.zeros(len(words), dtype=np.int64)
        points = np.frombuffer("\x00".join(words).encode("utf-32-le"), dtype="<u4")
        lookup = np.zeros(int(points.max()) + 1, dtype=np.int64)
        for c, k in self.alphabet.items():
            if ord(c) < len(lookup):
                lookup[ord(c)] = k
        codes[: len(points)] = lookup[points]
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begins[1:] = np.cumsum(lens[:-1] + 1)
        start, length, piece = self._edges(codes)
        begin = np.repeat(begins.astype(np.int32), lens + 1)
        step = start - begin[start] + length
        # numbers of 16 bits are sorted by radix; longer words are rare
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        start, length, piece, step = start[order], length[order], piece[order], step[order]
        last = np.full(len(codes) + 1, -1, dtype=np.int32)  # last piece of the prefix that ends before a position
        bounds = np.searchsorted(step, np.arange(1, int(step.max(initial=0)) + 2))
        for a, b in zip(bounds, bounds[1:]):
            s, p, n = start[a:b], piece[a:b], length[a:b]
            first = step[a:b] == n
            good = np.zeros(b - a, dtype=bool)
            good[first] = self._alone[p[first]]
            rest = np.flatnonzero(~first & (last[s] >= 0))
            rest = rest[self._alone[p[rest]]]
            good[rest] = self._compatible(last[s[rest]], p[rest])
            last[s[good] + n[good]] = p[good]
        size = np.zeros(len(self.pieces), dtype=np.int64)
        size[self.order] = self.lengths
        # walk back from the ends of all words in step
        ends = begins + lens
        open_words = np.arange(len(words))
        steps = []
        while len(open_words):
            pieces = last[ends[open_words]]
            if (pieces < 0).any():
                raise AssertionError("a word has no path of pieces")
            steps.append((open_words, pieces))
            ends[open_words] -= size[pieces]
            open_words = open_words[ends[open_words] > begins[open_words]]
        owner = np.concatenate([w for w, _ in steps]) if steps else np.zeros(0, dtype=np.int64)
        found = np.concatenate([p for _, p in steps]) if steps else np.zeros(0, dtype=np.int64)
        order = np.argsort(owner[::-1], kind="stable")
        found, counts = found[::-1][order].astype("<u4"), np.bincount(owner, minlength=len(words))
        data, cuts = found.tobytes(), np.append(0, 4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> None:
        """Put unseen words into the cache, block by block."""
        block, size = [], 0
        for word in words:
            block.append(word)
            size += len(word) + 1
            if size >= BLOCK_CHARS:
                self._words.update(zip(block, self._encode_block(block)))
                block, size = [], 0
        if block:
            self._words.update(zip(block, self._encode_block(block)))

    def _run(self, spaces: int) -> bytes:
        if spaces not in self._runs:
            # twice the longest run merges on its own, so longer runs repeat the longest piece
            self._runs[spaces] = np.array(self.plain(SPACE * spaces), dtype="<u4").tobytes()
        return self._runs[spaces]

    def _split(self, text: str) -> str:
        """Words with their leading space and single unknown characters, in order, with blanks between."""
        text = SPACE + text.replace(" ", SPACE)
        text = text.replace(SPACE, " " + SPACE)
        found = set(text)
        for c in found - self.chars - {" "}:
            text = text.replace(c, f" {c} ")
        for mark, before in self.marks.items():
            text = text.replace(mark, " " + mark)
            for c in before:
                while c in found and f"{c} {mark}" in text:
                    text = text.replace(f"{c} {mark}", c + mark)
        return text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null or empty: none."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size < TEXT_CHARS):
                size += len(texts[to] or "")
                to += 1
            out += self._encode_some(texts[at:to])
            at = to
        return out

    def _known_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, unseen ones learnt first."""
        if len(self._words) > CACHED_WORDS:  # words that are used again come back from the older half
            self._words, self._older = {}, self._words
        unseen = [w for w in words if w not in self._words]
        self._words.update({w: self._older[w] for w in unseen if w in self._older})
        unseen = [w for w in unseen if w not in self._older]
        self._words.update({c: np.array([self.bytes[b] for b in c.encode()], dtype="<u4").tobytes() for c in unseen if c[0] not in self.chars})
        self._learn([w for w in unseen if w[0] in self.chars])
        return list(map(self._words.__getitem__, words))

    def _encode_some(self, texts: list[str | None]) -> list[np.ndarray]:
        split = pc.split_pattern(pa.array([self._split(t) if t else "" for t in texts], pa.large_string()), " ")
        flat = split.flatten()
        full = pc.not_equal(flat, "")
        bounds = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy()]  # words before each text
        words = flat.filter(full).dictionary_encode()
        known, code = words.dictionary.to_pylist(), words.indices.to_numpy()
        ids = self._known_words(known)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        begin = np.cumsum(size) - size
        begin, size = begin[code], size[code]
        if SPACE in known:
            self._join_spaces(np.flatnonzero(code == known.index(SPACE)), bounds, ids, begin, size)
        pool = np.frombuffer(b"".join(ids), dtype="<i4")
        ends = np.cumsum(size)
        found = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)]
        cuts = np.append(0, ends)[bounds].tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:])]

    def _join_spaces(self, spaces: np.ndarray, bounds: np.ndarray, ids: list[bytes], begin: np.ndarray, size: np.ndarray) -> None:
        """Merge runs of lone spaces, and a space that the word behind a run left alone.

        ``spaces``: positions of such words; ``bounds``: words before each text. The ids of
        runs are put behind ``ids``; ``begin`` and ``size`` of the words are changed to them.
        """
        lone = self.ids[SPACE]
        pool = np.frombuffer(b"".join(ids), dtype="<i4")
        of = np.searchsorted(bounds, spaces, "right")
        heads = np.flatnonzero(np.append(True, (np.diff(spaces) > 1) | (np.diff(of) > 0)))
        first, length = spaces[heads], np.diff(np.append(heads, len(spaces)))
        behind = first + length
        inside = np.flatnonzero(behind < bounds[of[heads]])
        tails = inside[pool[begin[behind[inside]]] == lone]
        length[tails] += 1
        begin[behind[tails]] += 1
        size[behind[tails]] -= 1
        size[spaces] = 0
        at = len(pool)
        for n in np.unique(length).tolist():
            run = self._run(n)
            begin[first[length == n]], size[first[length == n]] = at, len(run) // 4
            ids.append(run)
            at += len(run) // 4

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, without the space put before it."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Text of each run of ids between two bounds, without the space put before it."""
        size = self.output_size[ids]
        ends = np.append(0, np.cumsum(size))
        data = self.output_pool[np.arange(ends[-1]) + np.repeat(self.output_begin[ids] - ends[:-1], size)].tobytes()
        cuts = ends[bounds].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text in the array column ``out``.

    All other columns stay; one of the name ``out`` is replaced. Null and empty texts get an
    empty array. The ids are those of the model's own library; spaces and the mark that stands
    for them in pieces are the same to it. Repeated rows get equal ids, an empty table no rows.
    """
    path = path or public_tokenizers.path(MODEL)

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        for texts in batches:
            # ids go out slice by slice, as those of a whole batch take several times the memory of its texts
            for at in range(0, len(texts), ROWS):
                found = model.encode(texts.slice(at, ROWS).to_pylist())
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()))
                del found
            give_back()

    return docs.withColumn(out, ids(text))


def decode(docs: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """``docs`` with the text of the ids in column ``out``; a null array gives a null text.

    Bytes that are no valid text become replacement characters. Unknown and control ids give nothing.
    """
    path = path or public_tokenizers.path(MODEL)

    @F.arrow_udf(StringType())
    def texts(arrays: pa.Array) -> pa.Array:
        model, parts = load(path), [pa.array([], pa.string())]
        for at in range(0, len(arrays), ID_ROWS):
            some = arrays.slice(at, ID_ROWS)
            bounds = some.offsets.to_numpy()
            values = pc.fill_null(some.values.slice(bounds[0], bounds[-1] - bounds[0]), 0).to_numpy()
            parts.append(pa.array(model.decode_all(values, bounds - bounds[0]), pa.string(), mask=some.is_null().to_numpy(zero_copy_only=False)))
        return pa.concat_arrays(parts)

    return docs.withColumn(out, texts(ids))

