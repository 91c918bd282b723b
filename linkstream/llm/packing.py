"""Packing by shortest-pack-first over the length histogram.

Documents become token ids with an end id, cut into full sequences and one
remainder each.  Only the histogram of piece lengths (one row per length) goes
to the driver.  Lengths are placed longest first into the pack that is
shortest so far, whole groups of equal packs at a time: a *pattern* is a list
of lengths with the number of packs that have it.  A pattern takes the pieces
of a length by their rank, so pieces find their sequence from (length, rank)
alone, and the text is tokenized once and never shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstream.llm.common import dense_slots

SEQUENCE = 4096
END_ID = 2
#: Words whose ids a task remembers, and the longest such word.
CACHED_WORDS, CACHED_LENGTH = 600_000, 64
#: Marks behind a word that are tokens of their own.
CLOSING = ".,;:!?#$%&*)"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit bytes.

    The tokenizer (a byte-level BPE with word ends) never joins text across a
    blank or a line feed, so ids of a text are those of its words in turn.  It
    lower-cases, and it parts a letter or digit from the marks behind it, so a
    word not seen yet is looked up in lower case and without closing marks
    (unless its last letter becomes more than one: the second may be a mark).  A
    word of Latin letters is one pre-token, so its bytes go straight to the
    model; all others take the whole way.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # byte-level alphabet: printable bytes stand for themselves, the others for 256 onwards
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(CLOSING)
        if stem and stem != word and stem[-1].isalnum() and len(stem[-1].lower()) == 1:
            ids = self[stem] + self[word[len(stem):]]
        elif word.isalpha() and max(word) < "\u0130":
            if (low := word.lower()) != word:
                ids = self[low]
            else:
                piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
                ids = np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_TABLES: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _TABLES:
        _TABLES[path] = WordIds(path)
    return _TABLES[path]


def cut(df: DataFrame, id_col: str, text_col: str, path: str, sequence: int = SEQUENCE,
        end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full pieces, then the rest."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (words.text(text) if text else b"") + end
                total = len(data) // 4
                for start in range(0, total, sequence):
                    piece = data[4 * start:4 * (start + sequence)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), total, piece)
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [batch.schema.field(0).type] + [pa.int64()] * 4 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids)


def patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: (packs, [(length, how often), ...]) of each pattern.

    Packs with the same room that get the next length one each are a group;
    a new pack is opened only if the length fits nowhere, and takes as many
    of it as it holds, which is where shortest-first would put them.
    """
    rooms: dict[int, list] = {}
    heap: list[int] = []

    def put(room: int, packs: int, pattern: tuple | None) -> None:
        if room not in rooms or not rooms[room]:
            rooms[room] = rooms.get(room, [])
            heapq.heappush(heap, -room)
        rooms[room].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not rooms[-heap[0]]:
                heapq.heappop(heap)
            room = -heap[0] if heap else -1
            if room >= length:
                packs, pattern = rooms[room].pop()
                n = min(packs, left)
                if packs > n:
                    put(room, packs - n, pattern)
                put(room - length, n, (pattern, length, 1))
                left -= n
            else:
                each = sequence // length
                if full := left // each:
                    put(sequence - each * length, full, (None, length, each))
                if rest := left % each:
                    put(sequence - rest * length, 1, (None, length, rest))
                left = 0
    out = []
    for room in sorted(rooms):
        for packs, pattern in rooms[room]:
            lengths: list[tuple[int, int]] = []
            while pattern:
                pattern, length, times = pattern
                if lengths and lengths[-1][0] == length:
                    lengths[-1] = (length, lengths[-1][1] + times)
                else:
                    lengths.append((length, times))
            out.append((packs, lengths[::-1]))
    return out


def placements(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, packs, first sequence, offset), sorted: ranks
    [first, first + packs * times) of a length go to the pattern's packs in turn."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for packs, lengths in found:
        offset = 0
        for length, times in lengths:
            first = rank.get(length, 0)
            rows.append((length, first, packs, sequence, offset))
            rank[length] = first + packs * times
            offset += length * times
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        at_length = {int(k): np.flatnonzero(table[:, 0] == k) for k in np.unique(table[:, 0])}
        firsts = {k: table[v, 1] for k, v in at_length.items()}
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            row = np.zeros(len(length), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                row[mine] = at_length[int(k)][np.searchsorted(firsts[int(k)], rank[mine], side="right") - 1]
            _, first, packs, sequence, offset = table[row].T
            turn, pack = np.divmod(rank - first, np.maximum(packs, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence + pack), pa.array(offset + turn * length)],
                [*batch.schema.names, "sequence_id", "offset"])
    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """-> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    A null or empty text is the end id alone.  A document longer than a
    sequence is cut into full ones and a rest.  Equal rows are pieces of their
    own.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = df.sparkSession
    pieces = cut(df, id_col, text_col, path or tokenizer_path(), sequence, end_id).checkpoint()
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row a length
    shared = spark.sparkContext.broadcast(placements(patterns(histogram, sequence)))
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    ranked = dense_slots(pieces, ["length"], keys, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_placer(shared), schema).select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_ids(df: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, offset, ids): the ids of every placed piece as little-endian
    32-bit bytes, for writing sequences.  Equal pieces have equal ids, so a
    placement needs any one of them."""
    ids = cut(df, id_col, text_col, path or tokenizer_path(), sequence, end_id, with_ids=True)
    one = ids.groupBy("doc_id", "start", "ids_crc32", "doc_tokens").agg(F.first("ids").alias("ids"))
    p = placed.select(F.col(id_col).alias("_d"), F.col("start").alias("_s"), F.col("ids_crc32").alias("_c"),
                      F.col("doc_tokens").alias("_t"), "sequence_id", "offset")
    return one.join(p, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("start") == F.col("_s"))
                    & (F.col("ids_crc32") == F.col("_c")) & (F.col("doc_tokens") == F.col("_t"))) \
              .select("sequence_id", "offset", "ids")
