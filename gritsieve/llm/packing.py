"""Best-fit packing of tokenised documents into sequences: minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm.shared import stored, text_parts

#: Production parameters.
CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

#: Pieces of one length that are ranked in one task, about.
RUN = 250
#: Words whose ids a Python worker remembers at most; beyond, it starts anew. Memory only: results do not depend on it.
REMEMBERED = 1_000_000
#: Texts up to this many bytes are looked up together.
TOGETHER = 1 << 20


class WordIds:
    """Token ids of words, as little-endian unsigned 32-bit numbers, found once per distinct word.

    The tokenizer splits at white space before anything else, so a text's ids are those of its words in a row. Three
    changes keep the ids and make words fewer: cutting before a dot or comma that follows an ASCII letter, where a token
    always ends; lower-casing ASCII letters, which it does itself (not where combining marks could compose otherwise,
    and not where "<|" could make a special token).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stop = re.compile(rb"(?<=[a-z])[.,]")

    def split(self, data: bytes) -> list[bytes]:
        if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
            return data.split()
        return self.stop.sub(rb" \g<0>", data.lower()).split()

    def look_up(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = list(map(self.known.get, words))
        if None in found:
            new = [i for i, ids in enumerate(found) if ids is None]
            self.learn({words[i] for i in new})
            for i in new:
                found[i] = self.known[words[i]]
        return found

    def learn(self, words: set[bytes]) -> None:
        """Words of letters up to U+024F are one token sequence that ends a word, so many are encoded in a row and cut apart."""
        plain, other = [], []
        for word in words:
            letters = word.isalpha()  # of bytes: ASCII letters only
            if not letters:
                text = word.decode()
                letters = text.isalpha() and max(text) < "\u0250"
            (plain if letters else other).append(word)
        runs = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        texts = [b" ".join(run).decode() for run in runs]
        for run, encoding in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoding.ids, dtype="<u4")
            bounds = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(bounds) != len(run):
                other.extend(run)
                continue
            data = ids.tobytes()
            self.known.update(zip(run, map(data.__getitem__, map(slice, [0, *bounds], bounds))))
        texts = [word.decode() for word in other]
        for word, encoding in zip(other, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = encoding.ids
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _texts_ids(texts: Iterable[bytes | None], words: WordIds) -> Iterator[Iterator[bytes]]:
    """For each text its ids in parts. Short texts are looked up together, long ones part by part."""
    run: list[list[bytes]] = []
    size = 0

    def done() -> Iterator[Iterator[bytes]]:
        found = words.look_up([w for ws in run for w in ws])
        at = 0
        for ws in run:
            yield iter([b"".join(found[at : at + len(ws)])])
            at += len(ws)
        run.clear()

    for text in texts:
        data = text or b""
        if len(data) > TOGETHER:
            yield from done()
            size = 0
            yield (b"".join(words.look_up(words.split(part))) for part in text_parts(data, TOGETHER))
            continue
        run.append(words.split(data))
        size += len(data)
        if size > TOGETHER:
            yield from done()
            size = 0
    yield from done()


def token_pieces(
    docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer: str, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and ids if asked: every text's ids and `end_id`, cut at `capacity`."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _word_ids(tokenizer)
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

        def row(name: object, number: int, data: bytes) -> tuple:
            out = (name, number, number * capacity, len(data) // 4, zlib.crc32(data))
            return (*out, np.frombuffer(data, dtype="<u4").astype(np.int32)) if with_ids else out

        for batch in batches:
            rows = []
            for name, parts in zip(batch["doc_id"], _texts_ids(batch["t"], words)):
                waiting, number = bytearray(), 0
                for part in parts:
                    waiting += part
                    cut = (len(waiting) - 1) // step * step  # the last id stays, as the end follows it
                    for at in range(0, max(cut, 0), step):
                        rows.append(row(name, number, bytes(waiting[at : at + step])))
                        number += 1
                    del waiting[: max(cut, 0)]
                waiting += end
                for at in range(0, len(waiting), step):
                    rows.append(row(name, number, bytes(waiting[at : at + step])))
                    number += 1
                if len(rows) > 2000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return rows.mapInPandas(pieces, schema)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How often to use each length so that the sum is the largest that fits in `room`.

    A bit set holds the sums that can be reached; lengths come from long to short, counts in powers of two, and the
    search ends when the room is filled to the last token. Going back through the steps names the lengths.
    """
    reached, mask, steps = 1, (1 << room + 1) - 1, []
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reached))
            reached |= reached << times * length & mask
            left -= times
            times *= 2
        if reached >> room:
            break
    total, used = reached.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= times * length
    return used


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of equal sequences, times each length stands in one): minimum bin slack.

    Each sequence takes the longest length left and the fullest combination of the rest with it. Doing so again gives
    the same combination until one of its lengths has too few left, so a step fills all those sequences. That length
    then has under half as many as before, and fewer than fit in one sequence: a distinct length ends 13 steps at most,
    however many pieces there are.
    """
    left, out = {length: n for length, n in counts.items() if n}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        used = fullest(left, lengths, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= bins * n
        lengths = [length for length in lengths if left[length]]
        out.append((bins, used))
    return out


def _places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Per step and length: length, first rank, times per sequence, first sequence, first offset; by length and rank."""
    rows, next_rank, sequence = [], {}, 0
    for bins, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            rank = next_rank.get(length, 0)
            rows.append((length, rank, used[length], sequence, offset))
            next_rank[length] = rank + bins * used[length]
            offset += length * used[length]
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `tokenizer` is the path of a vocabulary file, the same on every machine. A null, empty or blank text is one piece
    of length 1. Rows with equal or null ids are packed like any others. An empty table gives an empty one. The plan
    needs only the histogram of lengths, `capacity` numbers at most; ranks inside a length come from counts of runs, so
    a frequent length is dealt over many tasks.
    """
    pieces = stored(token_pieces(docs, id_col, text_col, capacity, end_id, tokenizer, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan_bins(counts, capacity))
    sizes = docs.sparkSession.createDataFrame(
        [(length, -(-n // RUN)) for length, n in counts.items()], "length long, runs long"
    )
    content = [c for c in pieces.columns if c != "ids"]
    rows = pieces.join(F.broadcast(sizes), "length").withColumn("run", F.pmod(F.xxhash64(*content), "runs")).drop("runs")
    runs = rows.groupBy("length", "run").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("length").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("length", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    order = W.partitionBy("length", "run").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.join(runs, ["length", "run"]).withColumn("rank", F.col("ahead") + F.row_number().over(order) - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = places[:, 0] << 45 | places[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            at = places[np.searchsorted(keys, length << 45 | rank, side="right") - 1]
            turn = rank - at[:, 1]
            batch["sequence_id"] = at[:, 3] + turn // at[:, 2]
            batch["offset"] = at[:, 4] + turn % at[:, 2] * length
            yield batch

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return ranked.select(*pieces.columns, "rank").mapInPandas(place, ", ".join([*columns, "sequence_id long", "offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from `pack(..., with_ids=True)`; a sequence holds `capacity` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
