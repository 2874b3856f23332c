"""Spelling variants: one-edit neighbourhoods of words in a reduced alphabet, joined with the vocabulary and verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.shared import discard, stored, text_parts

#: Production parameters: letters of a word, its least length and occurrences, how much more frequent a form must be.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = re.compile(r"[A-Za-zÀ-ÿ]{7,}")
LEAST_LENGTH = 7
LEAST_TIMES = 2
LEAST_RATIO = 10
#: One run in so many, by hash, loses a letter.
DAMAGED = 31
#: Symbols of the alphabets, coarse to fine. The last has a symbol for each letter, so its candidates are the near words.
ALPHABETS = (4, 16, len(LETTERS))
#: A word with more candidates than this is looked up in the next finer alphabet instead.
MOST_CANDIDATES = 1024

#: Distinct words a task holds before it hands their counts on; neighbours it makes at a time.
HELD_WORDS = 1 << 18
AT_ONCE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(doc_id: str, data: bytes) -> Counter[str]:
    """The words of one UTF-8 text with their occurrences; a run whose hash says so has lost a letter."""
    out: Counter[str] = Counter()
    own = zlib.crc32(f"{doc_id}:".encode())
    for part in text_parts(data):
        # bytes.lower knows ASCII only, as the definition asks; a run under seven letters cannot become a word.
        for run, times in Counter(RUN.findall(part.lower().decode("utf-8", "replace"))).items():
            h = zlib.crc32(run.encode(), own)
            if h % DAMAGED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
            out[run] += times
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that occur twice or more in all texts. Tasks hand on counts, so a frequent word is no hot key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def emit() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                counts.update(words_of(doc_id.as_py(), text.as_py()))
                if len(counts) > HELD_WORDS:
                    yield emit()
                    counts.clear()
        yield emit()

    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    )
    counted = rows.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _symbol(letter: str, symbols: int) -> int:
    """The symbol a letter stands for: by hash, or its own where there are enough."""
    if symbols >= len(LETTERS):
        return LETTERS.index(letter)
    return (ord(letter) * 0x9E3779B1 >> 13) % symbols


def _reduced(word: Column, symbols: int) -> Column:
    """The word in the reduced alphabet; its symbols are the first letters of the alphabet."""
    if symbols >= len(LETTERS):
        return word
    return F.translate(word, LETTERS, "".join(LETTERS[_symbol(x, symbols)] for x in LETTERS))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their places in the list, and their symbols' numbers from 1, a row each."""
    codes = np.array([ord(x) for x in LETTERS], dtype=np.uint32)
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        # Rows are bounded in letters, so that very long words come one by one.
        for at in range(0, len(places), max(1, AT_ONCE // (int(length) + 1))):
            chosen = places[at : at + max(1, AT_ONCE // (int(length) + 1))]
            flat = np.frombuffer("".join(words[i] for i in chosen).encode("utf-32-le"), dtype=np.uint32)
            yield chosen, (np.searchsorted(codes, flat) + 1).astype(np.uint64).reshape(len(chosen), length)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, dtype=np.uint64))])


def _keys(symbols: np.ndarray) -> np.ndarray:
    """A polynomial of the symbols modulo 2**64 for each row; an edit changes it in a way that needs no new pass."""
    return (symbols * _powers(symbols.shape[1])[: symbols.shape[1]]).sum(1, dtype=np.uint64)


def neighbour_keys(symbols: np.ndarray, alphabet: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every word within one edit of each row, itself included: in blocks of places, unique within a block."""
    rows, length = symbols.shape
    powers = _powers(length + 1)
    before = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(symbols * powers[:length], axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    letters = np.arange(1, alphabet + 1, dtype=np.uint64)
    step = max(1, AT_ONCE // (rows * (2 * alphabet + 1)))
    for a in range(0, length + 1, step):
        b, c = min(a + step, length), min(a + step, length + 1)
        deleted = before[:, a:b] + (whole - before[:, a + 1 : b + 1]) * _INVERSE
        replaced = whole[:, :, None] + (letters - symbols[:, a:b, None]) * powers[a:b, None]
        inserted = (before[:, a:c] + (whole - before[:, a:c]) * _BASE)[:, :, None] + letters * powers[a:c, None]
        block = np.concatenate([deleted, replaced.reshape(rows, -1), inserted.reshape(rows, -1)], axis=1)
        block.sort(axis=1)
        fresh = np.ones(block.shape, dtype=bool)
        fresh[:, 1:] = block[:, 1:] != block[:, :-1]
        yield np.nonzero(fresh)[0], block[fresh]


def _with_keys(words: DataFrame, reduced: Column) -> DataFrame:
    """(word, n, reduced, key) of the words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(len(batch), dtype=np.uint64)
            for places, symbols in _by_length(batch.column("reduced").to_pylist()):
                key[places] = _keys(symbols)
            yield pa.record_batch({**{c: batch.column(c) for c in ("word", "n", "reduced")}, "key": pa.array(key.view(np.int64))})

    rows = words.select("word", "n", reduced.alias("reduced"))
    return rows.mapInArrow(add, "word string, n bigint, reduced string, key bigint")


def _neighbourhoods(alphabet: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_numpy()
            for places, symbols in _by_length(batch.column("reduced").to_pylist()):
                # As many rows at a time as their neighbours allow.
                some = max(1, AT_ONCE // (symbols.shape[1] * 2 * alphabet))
                for at in range(0, len(places), some):
                    for row, key in neighbour_keys(symbols[at : at + some], alphabet):
                        yield pa.record_batch({"key": pa.array(own[places[at : at + some][row]]), "near": pa.array(key.view(np.int64))})

    return near


def near_words(words: DataFrame, alphabets: tuple[int, ...] = ALPHABETS, most: int = MOST_CANDIDATES) -> DataFrame:
    """(word, n_near, best: struct(fewer: minus its n, word)) for every word of (word, n) with words one edit away.

    Every word is looked up against the whole vocabulary, in one alphabet: the coarsest in which the classes of its
    neighbourhood hold at most `most` words. So no two large classes ever meet; in the last alphabet a class is a word.
    """
    waiting, found = words, []
    for level, alphabet in enumerate(alphabets):
        keyed = stored(_with_keys(words, _reduced(F.col("word"), alphabet)), "keyed")
        sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("size")), "sizes")
        own = keyed if level == 0 else keyed.join(waiting.select("word"), "word", "left_semi")
        classes = own.select("reduced", "key").distinct()
        edges = classes.select("key", "reduced").mapInArrow(_neighbourhoods(alphabet), "key bigint, near bigint")
        # Two reduced words with one key are one class here: that adds candidates and loses none.
        edges = edges.join(sizes.withColumnRenamed("key", "near"), "near").distinct()
        edges = stored(edges.select("key", "near", "size"), "edges")
        asked = own
        if level + 1 < len(alphabets):
            mass = stored(edges.groupBy("key").agg((F.sum("size") > most).alias("hot")), "mass")
            asked = own.join(mass.where("not hot"), "key")
            waiting = stored(own.join(mass.where("hot"), "key").select("word"), "waiting")
        candidates = (
            asked.select("word", "key").join(edges.select("key", "near"), "key")
            .join(keyed.select(F.col("key").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n")), "near")
        )
        near = candidates.where(
            (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
        )
        best = F.min(F.struct((-F.col("other_n")).alias("fewer"), F.col("other").alias("word"))).alias("best")
        found.append(stored(near.groupBy("word").agg(F.count("*").alias("n_near"), best), "near"))
        for done in (sizes, edges, keyed):
            discard(done)
        if level + 1 == len(alphabets) or waiting.limit(1).count() == 0:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last form of the chain. A form is ten times as frequent as its word, so
    chains are short and have no circles; every round doubles the steps."""
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                     F.col("next").isNotNull().alias("moved")), "roots")
        discard(current)
        current = after
        if current.where("moved").limit(1).count() == 0:
            return current.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words come from the runs of the letters `[A-Za-z\\u00C0-\\u00FF]` of whole texts, A-Z in lower case; a run whose hash
    with the id is divisible by 31 loses one letter. Words have seven letters or more and occur twice or more. `form` is
    the most frequent word one edit away (the first in code-point order of equals) if it is ten times as frequent, and
    `root` the last form of the chain, the word itself without one. Null or empty texts have no words, a null id is
    hashed as an empty one, repeated rows count again, other columns are ignored, and an empty table gives an empty one.
    """
    words = stored(vocabulary(docs, id_col, text_col), "vocabulary")
    near = stored(near_words(words), "best")
    joined = words.join(near, "word", "left")
    takes = -F.col("best.fewer") >= LEAST_RATIO * F.col("n")
    known = stored(joined.select(
        "word", F.when(takes, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("best.fewer")).alias("form_n"),
    ), "forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
