"""Fill-in-middle transformation by displacement scatter.

A text is cut twice at token borders into prefix, middle and suffix, which are
written with sentinels in one of two orders (``psm``, ``spm``), or the text
stays as it is (``plain``).  A batch of texts is one byte buffer:

* a scan over its bytes marks token starts, numbers them, and so finds the
  byte of each cut;
* each segment's move is a step in a difference array, whose cumulative sum is
  the shift of every byte, and one scatter writes all outputs of the batch;
* ``restore`` finds the sentinels in the outputs, and the same sums the other
  way round are the gather that rebuilds the texts.

Draws come from a hash of the seed and the row's id alone, so a task that runs
again gives the same rows.  Buffers are walked in windows of ``WINDOW`` bytes:
beside its input and output a task holds a few arrays of that size, however
long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstream.llm.common import free_name

# The sentinels (a letter between angle brackets), and the shares in percent.
SENTINELS = ("<P>", "<S>", "<M>")
INFILL_PERCENT, SPM_PERCENT = 90, 20
#: Bytes of texts that become one buffer (one text, if it is longer), and of one window.
BUFFER_BYTES, WINDOW = 8 << 20, 1 << 20

_P, _S, _M = (ord(s[1]) for s in SENTINELS)
_OPEN, _CLOSE = ord("<"), ord(">")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _windows(size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, size, WINDOW):
        yield a, min(a + WINDOW, size)


def _scan(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, token starts, code point starts) of each window."""
    filled = offsets[:-1][np.diff(offsets) > 0]  # a text starts a token
    for a, b in _windows(len(data)):
        point = (data[a:b] & 0xC0) != 0x80
        letter = _LETTER[data[max(a - 1, 0):b]]
        if a == 0:
            letter = np.concatenate([[False], letter])
        start = point & ~(letter[1:] & letter[:-1])
        start[filled[np.searchsorted(filled, a):np.searchsorted(filled, b)] - a] = True
        yield a, b, start, point


def _before(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token starts and code points before each offset."""
    tokens, points = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
    n_tokens = n_points = 0
    for a, b, start, point in _scan(data, offsets):
        here = slice(np.searchsorted(offsets, a), np.searchsorted(offsets, b))
        t, p = _before(start), _before(point)
        tokens[here], points[here] = n_tokens + t[offsets[here] - a], n_points + p[offsets[here] - a]
        n_tokens, n_points = n_tokens + t[-1], n_points + p[-1]
    end = slice(np.searchsorted(offsets, len(data)), None)
    tokens[end], points[end] = n_tokens, n_points
    return tokens, points


def _find(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and code point of the token starts with the (rising) numbers ``wanted``."""
    at, point_at = np.full(len(wanted), len(data)), np.zeros(len(wanted), np.int64)
    n_tokens = n_points = 0
    for a, _, start, point in _scan(data, offsets):
        starts, points = np.flatnonzero(start), _before(point)
        here = slice(np.searchsorted(wanted, n_tokens), np.searchsorted(wanted, n_tokens + len(starts)))
        found = starts[wanted[here] - n_tokens]
        at[here], point_at[here] = a + found, n_points + points[found]
        n_tokens, n_points = n_tokens + len(starts), n_points + points[-1]
    return at, point_at


def _sentinels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, text) of each sentinel that lies in one text, in order."""
    out = []
    for a, b in _windows(max(len(data) - 2, 0)):
        hit = np.flatnonzero((data[a:b] == _OPEN) & (data[a + 2:b + 2] == _CLOSE)) + a
        out.append(hit[np.isin(data[hit + 1], (_P, _S, _M))])
    at = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.searchsorted(offsets, at, side="right") - 1
    whole = at + 3 <= offsets[of + 1]
    return at[whole], of[whole]


def _shifts(starts: np.ndarray, targets: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, place of each byte elsewhere): segments begin at the rising
    ``starts`` and go to ``targets``.  Each is a step in a difference array;
    empty segments share a start, and their steps add up."""
    shift = targets - starts
    step = np.diff(shift, prepend=0)
    carry = 0
    for a, b in _windows(size):
        here = slice(np.searchsorted(starts, a), np.searchsorted(starts, b))
        difference = np.zeros(b - a, np.int64)
        np.add.at(difference, starts[here] - a, step[here])
        difference[0] += carry
        moved = np.cumsum(difference)
        carry = moved[-1]
        yield a, b, moved + np.arange(a, b)


def scatter(texts: pa.Array, draws: np.ndarray) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of a batch; ``draws`` is (4, rows)."""
    data, offsets = _buffer(texts)
    begin, end = offsets[:-1], offsets[1:]
    tokens, points = _counts(data, offsets)
    n = np.diff(tokens)
    cuts = np.sort(draws[:2] % (n + 1), axis=0)
    at, point_at = _find(data, offsets, (tokens[:-1] + cuts).T.reshape(-1))
    at, point_at = at.reshape(-1, 2).T, point_at.reshape(-1, 2).T
    at, point_at = np.where(cuts == n, end, at), np.where(cuts == n, points[1:], point_at)

    plain = (begin == end) | (draws[2] % 100 >= INFILL_PERCENT)
    plain[_sentinels(data, offsets)[1]] = True
    spm = ~plain & (draws[3] % 100 < SPM_PERCENT)
    at = np.where(plain, end, at)  # a plain text is all prefix

    prefix, middle, suffix = at[0] - begin, at[1] - at[0], end - at[1]
    out_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + np.where(plain, 0, 9))])
    base = out_offsets[:-1]
    to_prefix = base + np.where(plain, 0, np.where(spm, suffix + 6, 3))
    to_suffix = base + np.where(spm, 3, prefix + 6)
    to_middle = base + prefix + suffix + 9
    out = np.empty(out_offsets[-1], np.uint8)
    for a, b, to in _shifts(np.stack([begin, *at]).T.reshape(-1), np.stack([to_prefix, to_middle, to_suffix]).T.reshape(-1), len(data)):
        out[to] = data[a:b]
    for letter, place in ((_P, to_prefix), (_S, to_suffix), (_M, to_middle)):
        place = place[~plain]
        out[place - 3], out[place - 2], out[place - 1] = _OPEN, letter, _CLOSE

    chars = np.stack([point_at[0] - points[:-1], point_at[1] - point_at[0]])
    forms = np.array(["plain", "psm", "spm"], object)[np.where(plain, 0, 1 + spm)]
    return [pa.array(n), pa.array(forms, pa.string()), pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain),
            _strings(out, out_offsets)]


def gather(outputs: pa.Array, forms: np.ndarray) -> pa.Array:
    """The texts behind outputs, from these and their forms."""
    data, offsets = _buffer(outputs)
    begin, end = offsets[:-1], offsets[1:]
    moved, spm = forms != "plain", forms == "spm"
    at, of = _sentinels(data, offsets)
    at = at[moved[of]]
    if len(at) != 3 * moved.sum() or not np.array_equal(of[moved[of]][::3], np.flatnonzero(moved)):
        raise ValueError("an infilling output has one sentinel of each kind")
    marks = np.zeros((3, len(begin)), np.int64)
    marks[:, moved] = at.reshape(-1, 3).T
    first, second, third = marks
    one, two, three = second - first - 3, third - second - 3, end - third - 3  # lengths as they stand
    prefix = np.where(moved, np.where(spm, two, one), end - begin)
    suffix = np.where(moved, np.where(spm, one, two), 0)
    middle = np.where(moved, three, 0)
    back = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    starts = np.stack([back[:-1], back[:-1] + prefix, back[:-1] + prefix + middle])
    sources = np.stack([np.where(moved, np.where(spm, second + 3, first + 3), begin), third + 3,
                        np.where(spm, first + 3, second + 3)])
    text = np.empty(back[-1], np.uint8)
    for a, b, source in _shifts(starts.T.reshape(-1), sources.T.reshape(-1), len(text)):
        text[a:b] = data[source]
    return _strings(text, back)


def _pieces(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts fit one buffer."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + BUFFER_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def draws(seed: str, id_col: str, names: list[str]) -> list[Column]:
    """Four unsigned numbers of a row: the first 8-digit groups of the hex sha256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("bigint").alias(c) for i, c in enumerate(names)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """-> (id, n, form, prefix_chars, middle_chars, output), a row per row.

    ``n`` counts tokens (runs of ASCII letters, any other code point alone).  A
    null text is an empty one; an empty text, and one that holds a sentinel,
    stays plain.  Rows of equal id and text get equal results, a null id draws
    as an empty string.  Other columns are not read.
    """
    names = [f"h{i}" for i in range(1, 5)]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     *draws(seed, id_col, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 1):
                hashes = np.stack([c.to_numpy(zero_copy_only=False) for c in piece.columns[2:]])
                yield pa.RecordBatch.from_arrays([piece.column(0), *scatter(piece.column(1).cast(pa.string()), hashes)],
                                                 ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("id", id_col)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows of ``df`` with the text rebuilt from output and form as
    ``restored`` (leading underscores, if the name is taken).  A null output is
    an empty one and a null form is plain."""
    out, = free_name(df, "restored")
    place, form = df.columns.index(output_col), df.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, place):
                forms = piece.column(form).fill_null("plain").to_numpy(zero_copy_only=False)
                text = gather(piece.column(place).fill_null("").cast(pa.string()), forms)
                yield pa.RecordBatch.from_arrays([*piece.columns, text], [*piece.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``transform``'s rows: sha256 of each output, and of the text that ``restore`` rebuilds from it."""
    return restore(made).select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                F.sha2("restored", 256).alias("restored_sha256"))
