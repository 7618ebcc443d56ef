"""Fill-in-the-middle: texts are cut in three at token borders and put together in another order.

The kernel works on the Arrow buffers of a whole batch, without a loop over rows: a lookup table says which bytes are
white space, a mask of adjacent bytes marks where tokens end, its cumulative sum, taken from each text's own start,
numbers them, and searchsorted turns all cuts of all rows into byte positions at once. One gather then writes all outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space is U+0020 and U+0009 to U+000D, all of them single bytes of UTF-8.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = PREFIX + SUFFIX + MIDDLE
FORMS = np.array(["plain", "psm", "spm"], object)

#: Rows are taken together up to so many bytes of text; a longer text is alone. The kernel needs some 20 times as many.
MOST_BYTES = 4 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts and ends in them. A null row is empty."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(at[0]), int(at[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    start, end = at[:-1] - first, at[1:] - first
    if column.null_count:
        end = np.where(np.asarray(column.is_valid()), end, start)
    return data, start, end


def marked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each row holds one of the marks."""
    out = np.zeros(len(start), bool)
    if len(data) < 3:
        return out
    at = np.flatnonzero((data[:-2] == MARKS[0]) & (data[2:] == MARKS[2]))
    at = at[np.isin(data[at + 1], np.frombuffer(MARKS, np.uint8)[1::3])]
    row = np.searchsorted(start, at, "right") - 1  # of rows that start here the last, which is the one that is not empty
    out[row[at + 3 <= end[row]]] = True
    return out


def token_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many tokens end at or before each byte: a token ends before white space that follows another byte, and with the text."""
    space = SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[end[end > start] - 1] = True
    return np.cumsum(ends, dtype=np.int32)


def before(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What a cumulative sum has reached before position `at`."""
    return np.where(at > 0, total[np.maximum(at, 1) - 1], 0).astype(np.int64) if len(total) else np.zeros(len(at), np.int64)


def rearranged(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: list[np.ndarray], rate: int, spm: int) -> dict[str, np.ndarray]:
    """All rows of a batch: n, form (an index of FORMS), prefix_chars, middle_chars, and the outputs' bytes and offsets."""
    total = token_ends(data, start, end)
    base = before(total, start)
    n = np.where(end > start, before(total, end) - base, 0)
    one, two = h[0] % (n + 1), h[1] % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        return np.where(k > 0, np.searchsorted(total, base + k) + 1, start)

    first, second = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    form = np.where(h[3] % 100 < spm, 2, 1)
    form[(end <= start) | (h[2] % 100 >= rate) | marked(data, start, end)] = 0
    del total
    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
    to = [before(chars, at) for at in (start, first, second)]
    del chars
    p, s, m = len(data), len(data) + 3, len(data) + 6  # the marks stand behind the texts
    plain, psm = form == 0, form == 1
    pieces = np.empty((len(start), 6, 2), np.int64)  # where each piece of an output begins and ends, in order
    for k, (of_psm, of_spm) in enumerate((((p, p + 3), (s, s + 3)), ((start, first), (second, end)), ((s, s + 3), (p, p + 3)), ((second, end), (start, first)), ((m, m + 3), (m, m + 3)), ((first, second), (first, second)))):
        for side in (0, 1):
            pieces[:, k, side] = np.where(plain, (start, end)[side] if k == 0 else 0, np.where(psm, of_psm[side], of_spm[side]))
    begin, size = pieces[..., 0].ravel(), (pieces[..., 1] - pieces[..., 0]).ravel()
    there = np.cumsum(size)
    source = np.arange(there[-1] if len(there) else 0)
    source += np.repeat(begin - there + size, size)
    out = np.concatenate([data, np.frombuffer(MARKS, np.uint8)])[source]
    return {"n": n, "form": form, "prefix_chars": to[1] - to[0], "middle_chars": to[2] - to[1], "out": out, "offsets": np.concatenate([[0], there[5::6]])}


def portions(start: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + most, "right")))
        yield at, stop
        at = stop


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (code points; null if plain), output, and the columns in `keep`.

    A token is a run of other characters with the white space before it, or white space at the end. The four numbers
    that choose a row's cuts and form are taken from the hash of `seed` and the id, so a row's output depends on
    nothing else and is the same however rows are batched or tasks repeated; rows of one id and text are equal.
    A null or empty text, and one that holds a mark, stays plain; a null id hashes like an empty one; an empty table
    gives no rows. Other columns are not read. `rate` and `spm` are per cent.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, *drawn, F.col(text_col).alias("text"))
    kept = [f for f in rows.schema.fields if f.name in ("doc_id", *keep)]
    made = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, start, end = flat(batch.column("text"))
            for low, high in portions(start, np.maximum.accumulate(end), MOST_BYTES):
                rows = batch.slice(low, high - low)
                h = [np.asarray(rows.column(f"h{k}")).astype(np.int64) for k in (1, 2, 3, 4)]
                got = rearranged(*flat(rows.column("text")), h, rate, spm)
                plain = got["form"] == 0
                output = pa.StringArray.from_buffers(len(plain), pa.py_buffer(got["offsets"].astype(np.int32)), pa.py_buffer(got["out"]))
                columns = [rows.column(f.name) for f in kept]
                columns += [pa.array(got["n"]), pa.array(FORMS[got["form"]], pa.string()), *(pa.array(got[k], mask=plain) for k in ("prefix_chars", "middle_chars")), output]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in (*kept, *made)])

    return rows.mapInArrow(run, T.StructType([*kept, *made]))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output was made from. Its pieces hold no mark, and no mark can overlap another, so each is where it first occurs."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))

    def between(left: str, right: str | None) -> Column:
        tail = F.substring_index(out, left, -1)
        return tail if right is None else F.substring_index(tail, right, 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)
