"""Quality rules: base counts, and divergence from language references.

Each document has a histogram of character classes and one of common words (each listed word, and all others together).
A language's reference is the mean of its documents' histograms, over every document that passes the length guards
and has at least DISTINCT_PER_ROOT times the root of its length in distinct words. A document fails if the Jensen-Shannon distance (the root of the divergence, logarithms to base 2: 0 to 1)
of a histogram to its language's reference is over a limit. A histogram counts only from a minimum length on: under it,
its distance is null and passes. A document of a language without a reference is held to the nearest of all references;
without any reference the distances are null.

Two passes over the documents: the first leaves a vector of fixed size for each language and task, the second maps rows.
The number of languages that get a reference of their own is bounded by COMMON_WORDS; all others share one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie nach bei aus wie hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec elle ou son".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si sin".split(),
}
OTHER = "other"
#: Lower-case letters, capitals, digits, space, line feed, sentence marks, brackets and quotes, symbols, other ASCII, letters beyond ASCII.
N_CLASSES = 10
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Length guards and limits of the distances.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.27
MIN_COMMON_WORDS, MAX_WORD_DISTANCE = 100, 0.285
DISTINCT_PER_ROOT = 4
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    out = np.full(256, 8, np.int64)
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" ", 3), (b"\n", 4), (b".,;:!?'-", 5), (b"()[]{}\"", 6), (b"#*$%&|<>@\\^_`~+=/", 7)):
        out[list(chars)] = k
    out[0x80:0xC0] = N_CLASSES  # continuation bytes: dropped
    out[0xC0:] = 9
    return out


_CLASS_OF_BYTE = _classes()
_WORD_AT = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}


def char_histogram(raw: bytes) -> np.ndarray:
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(_CLASS_OF_BYTE, counts, N_CLASSES + 1)[:N_CLASSES]


def word_histogram(counts: Counter, lang: str) -> np.ndarray:
    """Of each listed word, alone or before a comma or full stop, and of all others at the end.

    A language without a list of its own counts the words of none.
    """
    at = _WORD_AT.get(lang, {})
    out = np.zeros(len(at) + 1)
    for w, i in at.items():
        out[i] = counts.get(w, 0) + counts.get(w + b",", 0) + counts.get(w + b".", 0)
    out[-1] = sum(counts.values()) - out[:-1].sum()
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, each scaled to sum to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(min(1.0, max(0.0, d / 2))))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n)
    keys = np.sort((h[:-2] * 0x1B873593 + h[1:-1]) * 0x27D4EB2F + h[2:])
    if not (keys[1:] == keys[:-1]).any():  # no two windows even have equal hashes
        return 0
    counts = Counter(zip(words, words[1:], words[2:]))
    found, reach = 0, 0
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if counts[window] > 1:
            found += i + 3 - max(i, reach)
            reach = i + 3
    return found


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    dup, lines = 0, text.split("\n")
    if len(lines) > len(set(lines)):
        seen: set[str] = set()
        for line in lines:
            if line.strip(common.SPACES):
                dup += line in seen
                seen.add(line)
    spaces = len(raw) - sum(map(len, words))  # each is one byte and one code point
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def _counts(text: str) -> tuple[np.ndarray, Counter]:
    raw = text.encode("utf-8", "surrogatepass")
    return char_histogram(raw), Counter(raw.lower().split())


def _language(lang: str | None) -> str:
    return lang if lang in COMMON_WORDS else OTHER


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The mean histograms of each language, over all documents that pass the length guards and don't repeat few words."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("chars", pa.list_(pa.float64())), ("words", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for text, lang in common.rows(batches, "text", "lang"):
            if not text or len(text) < MIN_CHARS:
                continue
            c, counts = _counts(text)
            w = word_histogram(counts, lang := _language(lang))
            if (n := w.sum()) < MIN_COMMON_WORDS or len(counts) < DISTINCT_PER_ROOT * n**0.5:
                continue
            s = sums.setdefault(lang, [0, 0, 0])
            s[0], s[1], s[2] = s[0] + 1, s[1] + c / c.sum(), s[2] + w / w.sum()
        if sums:
            yield common.emit(schema, [list(sums), [s[0] for s in sums.values()], [s[1].tolist() for s in sums.values()], [s[2].tolist() for s in sums.values()]])

    parts = docs.select("text", "lang").mapInArrow(common.tidy(run), "lang string, n bigint, chars array<double>, words array<double>")
    # One row for each language and task is summed on the executors; at most len(COMMON_WORDS) + 1 rows reach the driver.
    n_words = max(map(len, COMMON_WORDS.values())) + 1
    total = parts.groupBy("lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(N_CLASSES)]).alias("chars"), F.array(*[F.sum(F.get("words", F.lit(i))) for i in range(n_words)]).alias("words"))
    out = {}
    for r in total.collect():
        k = len(COMMON_WORDS.get(r["lang"], ())) + 1
        out[r["lang"]] = (np.array(r["chars"]) / r["n"], np.array(r["words"][:k], float) / r["n"])
    return out


def distances(text: str | None, lang: str | None, refs: dict) -> tuple[float | None, float | None]:
    """Distances of the characters and the common words; null where the guards or the references don't allow one."""
    if not text or not refs:
        return None, None
    own, best = _language(lang), (None, None)
    c, counts = _counts(text)
    for k in [own] if own in refs and own != OTHER else list(refs):
        w = word_histogram(counts, k)
        got = (js_distance(c, refs[k][0]) if len(text) >= MIN_CHARS and c.sum() else None, js_distance(w, refs[k][1]) if k != OTHER and w.sum() >= MIN_COMMON_WORDS else None)
        if best == (None, None) or sum(x or 0 for x in got) < sum(x or 0 for x in best):
            best = got
    return best


SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])
DDL = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, refs: dict | None = None, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """A verdict for each row of docs (doc_id, text, lang).

    A null or empty text has no words and fails the base rules; a null or unknown language is held to the nearest
    reference. Repeated rows get a row each; an empty table gives none. Other columns are ignored.
    """
    refs = references(docs) if refs is None else refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in SCHEMA]
        for doc_id, text, lang in common.rows(batches, "doc_id", "text", "lang"):
            base = base_counts(text)
            failed = base_failed(base[0], base[4])
            far = (None, None) if failed else distances(text, lang, refs)
            kept = not failed and (far[0] or 0) <= max_char_distance and (far[1] or 0) <= max_word_distance
            for c, v in zip(columns, (doc_id, *base, failed, kept, *far)):
                c.append(v)
            if len(columns[0]) == 4096:
                yield common.emit(SCHEMA, columns)
                columns = [[] for _ in SCHEMA]
        yield common.emit(SCHEMA, columns)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text", "lang").mapInArrow(common.tidy(run), DDL)
