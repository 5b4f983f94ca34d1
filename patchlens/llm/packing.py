"""Hierarchical multi-length packing.

Documents become token ids plus an end id. A document longer than the longest tier gives full windows of that tier and
a rest; each rest is routed to the shortest tier (a power of two) that holds it. The tiers are packed from the longest
to the shortest: every piece of a tier opens a sequence, and its gap is filled by the largest pieces of shorter tiers
that fit, then, if a gap is left, by the front of one that is cut. What remains of a shorter tier is packed into
sequences of that tier. Sequences of a tier form step groups with the same number of tokens; within a window they are
dealt in snake order of their attention cost (the sum of squared piece lengths), so the groups cost about the same.

It runs in one pass over each input partition, without a shuffle, in windows of a bounded number of tokens; what does
not fill a sequence is carried into the next window, so at most one sequence of each partition is padded. A lost task is
redone from its input split alone and yields the same rows.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of a window and of a step group.
WINDOW_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
#: Pieces of text whose ids a worker remembers, about 50 bytes each.
CACHE_PIECES = 500_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step_id", pa.int64())])
DDL = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint, tier bigint, step_id bigint"


class WordTokenizer:
    """Ids of texts: those that the library's encode(text, add_special_tokens=False) gives.

    The vocabulary file cuts a lower-cased text into runs of letters, digits, English endings after an apostrophe and runs of
    other marks, and none of these joins another. So a column of texts is cut here, by Arrow where its characters are ASCII
    or Latin letters; each distinct piece is encoded once, and any number of pieces is one call to the library, as each ends with
    the one id that has the mark of a word's end. What the cutting rules of Python and the library may see otherwise (special
    tokens, numerals that aren't digits, separators U+001C to U+001F, capital sigma, dotted I, text that isn't composed, characters
    that Python doesn't know)
    goes to the library whole.
    """

    AT_ONCE = 512
    _MARKS = r"('(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x09-\x0d\x20a-zß-öø-ÿ0-9]+)"
    _ANY = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.whole.get_vocab(False).items() if token.endswith("</w>")]] = True
        numerals = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))
        special = "".join("|" + re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        self.odd = re.compile(f"[\x1c-\x1fΣİ{numerals}]{special}")
        self.assigned: set[str] = set()
        self.not_simple = r"[^\x00-\x1b\x20-\x7fÀ-ÿ]" + special
        self.known, self.again = pa.array([], pa.string()), np.zeros(0, bool)
        self.pool, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, and how many each has."""
        got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([*itertools.chain.from_iterable(got)], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, pieces: list[str]) -> None:
        parts = [pieces[at: at + self.AT_ONCE] for at in range(0, len(pieces), self.AT_ONCE)]
        ids, n = [], []
        for some, got in zip(parts, self.whole.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            own = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.ends[own]) + 1
            own, length = (own, np.diff(ends, prepend=0)) if len(ends) == len(some) else self._encoded(some)
            ids.append(own)
            n.append(length)
        self.known = pa.concat_arrays([self.known, pa.array(pieces, pa.string())])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])
        length = np.concatenate(n)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.pool, self.length = np.concatenate([self.pool, *ids]), np.concatenate([self.length, length])

    def _forget(self) -> None:
        """What wasn't met again since the last time goes."""
        keep = np.flatnonzero(self.again)
        n = self.length[keep]
        after = np.cumsum(n)
        self.pool = self.pool[np.repeat(self.start[keep] - (after - n), n) + np.arange(n.sum())]
        self.known, self.start, self.length, self.again = self.known.take(pa.array(keep)), after - n, n, np.zeros(len(keep), bool)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces are in what is known."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        self.again[at[~new]] = True
        if new.any():
            at[new] = len(self.known) + np.arange(new.sum())
            self._learn(pieces.filter(pa.array(new)).to_pylist())
        return at

    def _ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has."""
        n = self.length[places]
        after = np.cumsum(n)
        return self.pool[np.repeat(self.start[places] - (after - n), n) + np.arange(n.sum())], n

    def _assigned(self, text: str) -> bool:
        """Whether Python knows each character: of those of a later Unicode it can't tell the class or the composition."""
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.assigned |= new
        return True

    def _other(self, text: str) -> np.ndarray:
        if self.odd.search(text) or not self._assigned(text) or not unicodedata.is_normalized("NFC", text):
            return self._encoded([text])[0]
        coded = pa.array(self._ANY.findall(text.lower()), pa.string()).dictionary_encode()
        return self._ids(self._places(coded.dictionary)[coded.indices.to_numpy()])[0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (uint32), and where each text's end. A null is an empty text."""
        texts = pc.fill_null(texts, "")
        simple = pc.invert(pc.match_substring_regex(texts, self.not_simple))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(simple, texts, "")), self._MARKS, r" \1 "))
        coded = lists.flatten().dictionary_encode()
        flat, n = self._ids(self._places(coded.dictionary)[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(n)])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        others = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        if len(others):
            more, parts, at = np.zeros(len(texts), np.int64), [], 0
            for i in others:
                ids = self._other(texts[int(i)].as_py())
                parts += [flat[at: ends[i]], ids]
                at, more[i] = ends[i], len(ids)
            flat, ends = np.concatenate([*parts, flat[at:]]), ends + np.cumsum(more)
        return flat, ends


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tier_of(length: int, tiers=TIERS) -> int:
    return tiers[bisect_left(tiers, length)]


class _Pool:
    """Pieces (length, key, start) of one tier or more, by length."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []

    def add(self, piece):
        insort(self.items, piece)

    def largest_at_most(self, room: int):
        at = bisect_right(self.items, (room, float("inf"), 0))
        return self.items.pop(at - 1) if at else None


def plan(lengths: list[tuple[int, int, int]], tiers=TIERS, last=True) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Sequences (tier, [(key, start, length)]) of pieces (key, start, length), and the pieces that are left over.

    Every sequence is filled to its tier, save for one at the end if last; otherwise its pieces are left over.
    """
    top, out = tiers[-1], []
    pools = {t: _Pool() for t in tiers}
    for key, start, n in lengths:
        while n >= top:
            out.append((top, [(key, start, top)]))
            start, n = start + top, n - top
        if n:
            pools[tier_of(n, tiers)].add((n, key, start))
    for k in range(len(tiers) - 1, -1, -1):
        tier, own = tiers[k], pools[tiers[k]]
        below = [pools[t] for t in reversed(tiers[:k])]
        while own.items:
            n, key, start = own.items.pop()
            sequence, room = [(key, start, n)], tier - n
            while room:
                got = next((x for p in below if (x := p.largest_at_most(room))), None) or own.largest_at_most(room)
                if got is None:  # nothing fits whole: cut the shortest piece that is longer than the gap
                    source = next((p for p in [*reversed(below), own] if p.items), None)
                    if source is None:
                        break
                    n, key, start = source.items.pop(0)
                    rest = n - room
                    pools[tier_of(rest, tiers)].add((rest, key, start + room))
                    got = (room, key, start)
                sequence.append((got[1], got[2], got[0]))
                room -= got[0]
            if room and not last:
                return out, sequence
            if room and last:
                out.extend(_rest(sequence, tiers))
            else:
                out.append((tier, sequence))
    return out, []


def _rest(sequence, tiers):
    """What doesn't fill a tier goes to full sequences of shorter tiers as far as it can; the last is padded."""
    out, now, total = [], [], sum(n for _, _, n in sequence)
    room = size = next((t for t in reversed(tiers) if t <= total), tiers[-1])
    queue = list(reversed(sequence))
    while queue:
        key, start, n = queue.pop()
        take = min(n, room)
        now.append((key, start, take))
        room, total = room - take, total - take
        if take < n:
            queue.append((key, start + take, n - take))
        if not room or not queue:
            out.append((size if not room else tiers[-1], now))
            now = []
            room = size = next((t for t in reversed(tiers) if t <= total), tiers[-1])
    return out


def step_groups(sequences, step_tokens=STEP_TOKENS) -> list[int]:
    """A group for each sequence: tiers apart, as many sequences as give step_tokens, dealt in snake order of cost."""
    groups, first = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}, reverse=True):
        own = sorted((i for i, s in enumerate(sequences) if s[0] == tier), key=lambda i: -sum(n * n for _, _, n in sequences[i][1]))
        n = -(-len(own) // max(1, step_tokens // tier))
        for rank, i in enumerate(own):
            lap, at = divmod(rank, n)
            groups[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack(docs: DataFrame, tokenizer_path: str, tiers=TIERS, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of documents in sequences, with their ids (little-endian uint32).

    A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed as often as they occur. An
    empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    tiers = tuple(sorted(tiers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, base = tokenizer(tokenizer_path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        end = np.array([end_id], "<u4").tobytes()
        held: dict[int, tuple] = {}  # key: doc_id, ids
        pieces: list[tuple[int, int, int]] = []
        key = tokens = sequence_id = step_id = 0

        def flush(last: bool):
            nonlocal pieces, held, tokens, sequence_id, step_id
            sequences, pieces = plan(pieces, tiers, last)
            groups, columns, size = step_groups(sequences, step_tokens), [[] for _ in SCHEMA], 0
            for (tier, content), group in zip(sequences, groups):
                at = 0
                for k, start, n in content:
                    doc_id, ids = held[k]
                    for c, v in zip(columns, (doc_id, start, n, ids[4 * start: 4 * (start + n)], len(ids) // 4, base + sequence_id, at, tier, base + step_id + group)):
                        c.append(v)
                    at, size = at + n, size + n
                sequence_id += 1
                if size > 1 << 20:
                    yield common.emit(SCHEMA, columns)
                    columns, size = [[] for _ in SCHEMA], 0
            if columns[0]:
                yield common.emit(SCHEMA, columns)
            step_id += max(groups, default=-1) + 1
            held = {k: held[k] for k, _, _ in pieces}
            tokens = sum(n for _, _, n in pieces)

        for batch in common.parts(batches):
            ids, ends = tok.ids(batch.column(1))
            at = 0
            for doc_id, to in zip(batch.column(0).to_pylist(), ends.tolist()):
                held[key] = (doc_id, ids[at: to].tobytes() + end)
                pieces.append((key, 0, to - at + 1))
                key, tokens, at = key + 1, tokens + to - at + 1, to
                if tokens >= window_tokens:
                    yield from flush(False)
        yield from flush(True)

    return common.small_batches(docs).select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(common.tidy(run), DDL)
