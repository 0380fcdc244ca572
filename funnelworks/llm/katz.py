"""Language-model scores by Katz backoff.

Tokens are words (ASCII letters in lower case) and one end per text.  For every
order up to ``ORDER`` the counts of the training texts' n-grams give

    P(w | h) = d(c) c(hw) / c(h)        if hw was seen, c = c(hw)
             = alpha(h) P(w | h')       else, h' without its oldest token

with Good-Turing discounts d(c) for c up to ``CUTOFF`` from the counts of
counts of that order, and alpha(h) what the discounts left, divided by the
lower order's probability of all tokens not seen after h, summed exactly over
the seen ones.  A history that the discounts leave nothing gets a total larger
by one; a history never seen has alpha 1.  At the lowest order the mass that
is left is that of all unknown tokens together, so every P(. | h) sums to 1.

The model is a stored table, partitioned by order and range: a row a range,
holding its n-grams, their counts and their histories' sums.  Words are known
by 64-bit hashes to the lowest order's table only, which numbers them; a
longer n-gram is the number of its history, an n-gram of the order below, and
that of its last token.  Texts are dealt by groups; order by order a group asks
each range once for each distinct n-gram, however often it occurs, and gets
numbers, probabilities and backoff weights in the order of its question, from
which each token is evaluated recursively.  An n-gram's range is that of its
history, so that a history's sum is formed in one place; histories of a large
share of all tokens are split over several ranges, and their sums (a bounded
number) completed on the driver.  All that moves is packed: sorted numbers, as
differences, and compressed.

Different words with equal hashes (one in 2**64 a pair) would count as one.

Defined results: a null text counts as empty (the end alone); without training
texts every token has probability 1 as the one unknown token; equal texts have
equal scores; repeated rows are scored, and counted, each; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import table
from funnelworks.llm.importance import lower
from funnelworks.llm.words import blocks, mix, text_bytes, words
from funnelworks.session import remove_at_end, scratch_path

ORDER = 2
#: Counts up to this are discounted.
CUTOFF = 5
#: Bytes of text of a group or range: within these bounds, such that a group's
#: question to a range takes about ``PAYLOAD`` bytes.
LEAST_BYTES, MOST_BYTES, PAYLOAD = 4 << 20, 32 << 20, 16 << 10
#: A history of more than this share of all tokens is split, or of a quarter of
#: a range if that is more.
SPLIT_SHARE = 1e-5

END = np.uint64(0x0E4D_0E4D_0E4D_0E4D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a word's number; 0 is every unknown word.
_WORD_BITS = np.uint64(40)
_ZSTD = pa.Codec("zstd", 1)
_TABLE = "order int, r int, keys binary, histories binary, runs binary, counts binary, hist binary, low binary, stats array<long>"


# -- arrays as bytes


def ints(values: np.ndarray) -> bytes:
    """Whole numbers from 0, compressed by bytes of equal weight."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T)
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def from_ints(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[9:], width * n, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def rising(values: np.ndarray, runs: np.ndarray) -> bytes:
    """Numbers that rise within runs (from ``runs``), as differences."""
    step = np.diff(values, prepend=0)
    step[runs] = values[runs]
    return ints(step)


def from_rising(data: bytes, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(from_ints(data))
    ends = np.cumsum(sizes)
    return total - np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), sizes) if len(sizes) else total


def floats(values: np.ndarray) -> bytes:
    """Doubles as the distinct ones and their numbers."""
    distinct, number = np.unique(values, return_inverse=True)
    return len(distinct).to_bytes(8, "little") + distinct.tobytes() + ints(number)


def from_floats(data: bytes) -> np.ndarray:
    stop = 8 + 8 * int.from_bytes(data[:8], "little")
    return np.frombuffer(data[8:stop])[from_ints(data[stop:])]


def _joined(column: pa.ChunkedArray, read) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and how many each row has."""
    parts = [read(x) for x in column.to_pylist()]
    return np.concatenate(parts or [np.zeros(0, np.int64)]), np.array([len(p) for p in parts], np.int64)


# -- n-grams of a block of texts


@dataclass
class Tokens:
    """Tokens of some texts one after the other, ``first``: where each begins (and the end)."""

    tokens: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: pa.ChunkedArray | pa.Array) -> Tokens:
        parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
            data, offsets = text_bytes(chunk)
            for lo, hi in blocks(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                found = words(lower(data[offsets[lo] : offsets[hi]]), own, 0, hi - lo)
                parts.append(np.insert(found.hashes, found.first[1:], END))
                sizes.append(np.diff(found.first) + 1)
        return Tokens(np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64))


@dataclass
class Hot:
    """Histories split over ranges: their numbers in order, the number of parts
    and, once their table is there, their totals and backoff weights."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total: np.ndarray | None = None
    alpha: np.ndarray | None = None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are hot, and the place of each in ``self.keys``."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[place] == keys, place


@dataclass
class Grams:
    """The distinct n-grams of a block by range, history and key.  ``at``:
    places in the tokens that end one; ``which``: its number; ``keys``: hashes
    of words at the lowest order (history 0), else the words' numbers."""

    at: np.ndarray
    which: np.ndarray
    keys: np.ndarray
    history: np.ndarray
    ranges: np.ndarray

    @staticmethod
    def of_words(text: Tokens, ranges: int) -> Grams:
        keys, which = np.unique(text.tokens, return_inverse=True)
        r = _range(keys, ranges)  # mixed hashes are in the order of their ranges
        by = np.lexsort((keys, r))
        return Grams(np.arange(len(which)), _back(by)[which], keys[by], np.zeros(len(keys), np.int64), r[by])

    @staticmethod
    def of(history: np.ndarray, word: np.ndarray, hot: Hot, ranges: int) -> Grams:
        """By place in the tokens the number of the n-gram of the order below
        that ends before it (0: none), and the word's number (0: unknown)."""
        at = np.flatnonzero(history)
        histories, own = np.unique(history[at], return_inverse=True)
        pairs, which = np.unique(own.astype(np.uint64) << _WORD_BITS | word[at].astype(np.uint64), return_inverse=True)
        own, word = (pairs >> _WORD_BITS).astype(np.int64), (pairs & ((np.uint64(1) << _WORD_BITS) - np.uint64(1))).astype(np.int64)
        is_hot, place = hot.find(histories)
        part = np.where(is_hot, hot.parts[place], 1) if len(hot.keys) else np.ones(len(histories), np.int64)
        dealt = histories.astype(np.uint64)[own] + (word % part[own]).astype(np.uint64) * _STEP
        r = _range(mix(dealt), ranges)
        by = np.argsort(r, kind="stable")
        return Grams(at, _back(by)[which], word[by], histories[own][by], r[by])

    def runs(self) -> np.ndarray:
        """Where a history's n-grams in a range begin."""
        return _run_starts(self.ranges, self.history)

    def by_range(self) -> Iterator[tuple[int, slice, bytes, bytes, bytes]]:
        """(range, its n-grams, and packed: keys, histories, sizes of their runs)."""
        runs = self.runs()
        size = np.diff(np.append(runs, len(self.keys)))
        there, begin = np.unique(self.ranges, return_index=True)
        cut = np.searchsorted(runs, np.append(begin, len(self.keys)))
        for i, (r, a, b) in enumerate(zip(there.tolist(), begin, np.append(begin[1:], len(self.keys)))):
            run = slice(cut[i], cut[i + 1])
            yield r, slice(a, b), *packed_keys(self.keys[a:b], self.history[runs[run]], size[run])


def packed_keys(keys: np.ndarray, histories: np.ndarray, size: np.ndarray) -> tuple[bytes, bytes, bytes]:
    begin = np.cumsum(size) - size
    own = keys.tobytes() if keys.dtype == np.uint64 else rising(keys, begin)
    return own, rising(histories, np.zeros(1, np.int64)), ints(size)


def unpacked_keys(order: int, keys: bytes, histories: bytes, size: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = from_ints(size)
    own = np.frombuffer(keys, np.uint64) if order == 1 else from_rising(keys, size)
    return own, from_ints(histories).cumsum(), size


def _range(mixed: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _back(by: np.ndarray) -> np.ndarray:
    """The place that each number of a permutation goes to."""
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by))
    return out


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns)})


# -- the model


@dataclass
class Level:
    """Of one order: discounts (0 to CUTOFF, and 1 beyond), the split
    histories, how many n-grams the ranges before each range hold, and the
    lowest order's total and what is left for unknown words."""

    discount: np.ndarray
    hot: Hot
    before: np.ndarray
    total: float = 1.0
    left: float = 1.0

    def mass(self, counts: np.ndarray) -> np.ndarray:
        return self.discount[np.minimum(counts, CUTOFF + 1)] * counts

    def history(self, hist: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals and backoff weights of histories.  ``hist``: per history the
        number of n-grams of count 1 to CUTOFF, and the counts beyond added up."""
        sizes = np.arange(1, CUTOFF + 1)
        total = hist[:, :CUTOFF] @ sizes + hist[:, CUTOFF]
        kept = hist[:, :CUTOFF] @ (self.discount[1 : CUTOFF + 1] * sizes) + hist[:, CUTOFF]
        total = np.where(kept < total, total, total + 1).astype(float)
        return total, (total - kept) / total / np.maximum(1.0 - low, 2.0**-52)


@dataclass
class Model:
    """``levels``: by order from 1; ``tables``: the stored rows; ``tokens``,
    ``distinct``: of the training texts."""

    order: int
    ranges: int
    levels: list[Level]
    tables: DataFrame
    tokens: int
    distinct: int


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount factors from the counts of counts 1 to CUTOFF + 1;
    1 where those give none between 0 and 1."""
    out = np.ones(CUTOFF + 2)
    beyond = (CUTOFF + 1) * n[CUTOFF] / n[0] if n[0] else 1.0
    for r in range(1, CUTOFF + 1):
        if n[r - 1] and beyond < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - beyond) / (1 - beyond)
            out[r] = d if 0 < d < 1 else 1.0
    return out


_SENT = [(c, pa.int32() if c == "r" else pa.binary()) for c in ("r", "keys", "histories", "runs", "counts", "low", "of")]
_SENT_SQL = "r int, keys binary, histories binary, runs binary, counts binary, low binary, of binary"


def _counted(found: Grams, low: np.ndarray, of: np.ndarray) -> pa.Table:
    """Rows of a block's n-grams for their ranges; ``low``, ``of``: by place in
    the tokens the lower order's count and its history's total."""
    counts = np.bincount(found.which, minlength=len(found.keys))
    lower = np.zeros((2, len(found.keys)), np.int64)
    lower[:, found.which] = low[found.at], of[found.at]
    return _rows([(r, *packed, ints(counts[s]), ints(lower[0, s]), ints(lower[1, s])) for r, s, *packed in found.by_range()], _SENT)


def _merge(order: int, below: Level | None):
    """One row of the table from all rows sent to a range; ``below``: the
    level of the lower order."""

    def merge(sent: pa.Table) -> pa.Table:
        parts = [unpacked_keys(order, *row) for row in zip(*(sent[c].to_pylist() for c in ("keys", "histories", "runs")))]
        keys = np.concatenate([k for k, _, _ in parts])
        history = np.concatenate([np.repeat(h, size) for _, h, size in parts])
        counts, low, of = (_joined(sent[c], from_ints)[0] for c in ("counts", "low", "of"))
        if order == 1:
            _, begin, which = np.unique(keys, return_index=True, return_inverse=True)
        else:
            own = np.unique(history, return_inverse=True)[1].astype(np.uint64) << _WORD_BITS
            _, begin, which = np.unique(own | keys.astype(np.uint64), return_index=True, return_inverse=True)
        total = np.zeros(len(begin), np.int64)
        np.add.at(total, which, counts)
        keys, history = keys[begin], history[begin]
        low = below.mass(low[begin]) / of[begin] if below else np.zeros(len(begin))
        runs = _run_starts(history)
        hist = np.stack([np.add.reduceat(np.where(total > CUTOFF, total, 0) if r > CUTOFF else total == r, runs, dtype=np.int64) for r in range(1, CUTOFF + 2)], 1)
        n = [int((total == r).sum()) for r in range(1, CUTOFF + 2)]
        packed = packed_keys(keys, history[runs], np.diff(np.append(runs, len(keys))))
        sums = ints(hist.T.ravel()), floats(np.add.reduceat(low, runs))
        row = (order, sent["r"][0].as_py(), *packed, ints(total), *sums, [*n, int(total.sum()), len(keys)])
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]
        names = ["order", "r", "keys", "histories", "runs", "counts", "hist", "low", "stats"]
        return _rows([row], list(zip(names, kinds)))

    return merge


def _hist(data: bytes) -> np.ndarray:
    return from_ints(data).reshape(CUTOFF + 1, -1).T


def _hot_rows(tables: DataFrame, before: np.ndarray, more_than: int) -> DataFrame:
    """Numbers and counts of the n-grams of more than so many occurrences."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = from_ints(counts)
                some = np.flatnonzero(counts > more_than)
                yield pa.RecordBatch.from_arrays([pa.array(some + 1 + before[r]), pa.array(counts[some])], names=["key", "n"])

    return tables.select("r", "counts").mapInArrow(find, "key long, n long")


def _hot_sums(tables: DataFrame, hot: Hot) -> DataFrame:
    """The sums of split histories, a row for each range that has some of it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, history, hist, low in zip(*(c.to_pylist() for c in batch.columns)):
                some, place = hot.find(from_ints(history).cumsum())
                arrays = [place[some], np.full(some.sum(), r, np.int64), from_floats(low)[some]]
                sums = pa.array(_hist(hist)[some].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), sums], names=["place", "r", "low", "hist"])

    return tables.select("r", "histories", "hist", "low").mapInArrow(find, "place long, r long, low double, hist array<long>")


@contextmanager
def _shuffles_released(spark: SparkSession):
    """Queries that end in here remove their shuffle files at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def piece_bytes(texts: DataFrame) -> tuple[int, int]:
    """Bytes of text, and those of a group or range."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size, min(max(math.isqrt(PAYLOAD * size), LEAST_BYTES), MOST_BYTES)


def _dealt(docs: DataFrame, columns: list[str]) -> DataFrame:
    """g, a group by a hash of id and text, and rows: some of the group's rows,
    compressed, as the texts move to their group several times."""
    size, piece = piece_bytes(docs)
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // piece)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            by = np.argsort(g, kind="stable")
            there, begin = np.unique(g[by], return_index=True)
            packed = []
            for rows in np.split(by, begin[1:]) if len(there) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.take(pa.array(rows)))
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(packed, pa.binary())], names=["g", "rows"])

    return docs.select(group.alias("g"), *columns).mapInArrow(pack, "g int, rows binary")


def _unpacked(group: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in group["rows"]])


def learn(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of the texts of ``docs`` (doc_id, text), stored until the
    driver's process ends."""
    spark = docs.sparkSession
    size, piece = piece_bytes(docs)
    ranges = 1 + size // piece
    path = scratch_path(spark, "katz")
    remove_at_end(spark, path)
    dealt = _dealt(docs, ["text"])
    model = Model(0, ranges, [], spark.createDataFrame([], _TABLE), 0, 0)
    for k in range(1, order + 1):
        hot = Hot()
        if k == 1:

            def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    text = Tokens.of(batch.column(0))
                    nothing = np.zeros(len(text.tokens), np.int64)
                    yield from _counted(Grams.of_words(text, ranges), nothing, nothing).to_batches()

            sent = docs.select("text").mapInArrow(words_of, _SENT_SQL)
        else:
            # at most 1 / SPLIT_SHARE of them
            share = max(1, int(max(model.tokens / (4 * ranges), SPLIT_SHARE * model.tokens)))
            below = model.tables.where(F.col("order") == k - 1)
            found = sorted((r["key"], -(-r["n"] // share)) for r in _hot_rows(below, model.levels[-1].before, share).collect())
            hot = Hot(*(np.array([r[i] for r in found], np.int64) for i in (0, 1)))
            told = _answers(dealt, model, k - 1, k - 1)
            sent = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_count_group(model, hot), _SENT_SQL)
        with _shuffles_released(spark):
            sent.groupBy("r").applyInArrow(_merge(k, model.levels[-1] if k > 1 else None), _TABLE).write.mode("append").partitionBy("order").parquet(path)
        model = _with_level(model, spark.read.schema(_TABLE).parquet(path), k, hot)
    return model


def _with_level(model: Model, tables: DataFrame, k: int, hot: Hot) -> Model:
    own = tables.where(F.col("order") == k)
    sums = np.zeros((model.ranges, CUTOFF + 3), np.int64)
    for r in own.select("r", "stats").collect():  # a row a range
        sums[r["r"]] = r["stats"]
    *n, total, distinct = sums.sum(0).tolist()
    level = Level(discounts(n), hot, np.cumsum(sums[:, -1]) - sums[:, -1])
    if k == 1:
        big = total - sum((r + 1) * n[r] for r in range(CUTOFF))
        whole, left = level.history(np.array([[*n[:CUTOFF], big]]), np.zeros(1))
        level.total, level.left = float(whole[0]), float(left[0])
    elif len(hot.keys):
        hist, low = np.zeros((len(hot.keys), CUTOFF + 1), np.int64), np.zeros(len(hot.keys))
        for r in sorted(_hot_sums(own, hot).collect(), key=lambda r: (r["place"], r["r"])):
            hist[r["place"]] += np.array(r["hist"], np.int64)
            low[r["place"]] += r["low"]
        hot.total, hot.alpha = level.history(hist, low)
    tokens, types = (total, distinct) if k == 1 else (model.tokens, model.distinct)
    return Model(k, model.ranges, [*model.levels, level], tables, tokens, types)


# -- questions and answers


_ASKED = [("k", pa.int32()), ("r", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("histories", pa.binary()), ("runs", pa.binary())]
_ASKED_SQL = "k int, r int, g int, keys binary, histories binary, runs binary"
_TOLD = [(c, pa.int32() if len(c) == 1 else pa.binary()) for c in ("g", "k", "r", "counts", "numbers", "totals", "alpha")]
_TOLD_SQL = "g int, k int, r int, counts binary, numbers binary, totals binary, alpha binary"


def _asked(k: int, g: int, found: Grams) -> pa.Table:
    return _rows([(k, r, g, *packed) for r, _, *packed in found.by_range()], _ASKED)


def _answer(k: int, level: Level, numbered: bool):
    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        if held.num_rows:
            row = held.to_pylist()[0]
            keys, histories, size = unpacked_keys(k, row["keys"], row["histories"], row["runs"])
            counts = from_ints(row["counts"])
            total, alpha = level.history(_hist(row["hist"]), from_floats(row["low"]))
            hot, place = level.hot.find(histories)
            if hot.any():
                total[hot], alpha[hot] = level.hot.total[place[hot]], level.hot.alpha[place[hot]]
            if k == 1:
                total[:] = level.total
            else:
                keys = np.repeat(np.arange(len(size)), size).astype(np.uint64) << _WORD_BITS | keys.astype(np.uint64)
        rows = []
        for g, r, *packed in zip(*(asked[c].to_pylist() for c in ("g", "r", "keys", "histories", "runs"))):
            wanted, before, size = unpacked_keys(k, *packed)
            begin = np.cumsum(size) - size
            n, t, a = np.zeros(len(wanted), np.int64), np.ones(len(before), np.int64), np.ones(len(before))
            numbers = np.zeros(0, np.int64)
            if held.num_rows:
                if k > 1:
                    run = np.minimum(np.searchsorted(histories, before), len(histories) - 1)
                    there = histories[run] == before
                    a[there], t[there] = alpha[run[there]], total[run[there]]
                    known = np.repeat(there, size) & (wanted > 0)
                    wanted = np.repeat(run, size).astype(np.uint64) << _WORD_BITS | wanted.astype(np.uint64)
                else:
                    known = np.ones(len(wanted), bool)
                    t[:] = int(level.total)
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                there = known & (keys[place] == wanted)
                n[there] = counts[place[there]]
                if numbered:
                    numbers = place[there] + 1 + level.before[r]
            hot, place = level.hot.find(before)
            if hot.any():
                a[hot] = level.hot.alpha[place[hot]]
            a = a[np.add.reduceat(n == 0, begin, dtype=np.int64) > 0]  # where something has to back off
            rows.append((g, k, r, ints(n), rising(numbers, np.zeros(min(1, len(numbers)), np.int64)), ints(t), a.tobytes()))
        return _rows(rows, _TOLD)

    return answer


@dataclass
class Answers:
    """To a group's question at one order, by number of the n-gram: counts,
    numbers (0 if not seen, or where no longer n-gram needs them), their histories' totals and, for n-grams not
    seen, their histories' backoff weights."""

    counts: np.ndarray
    numbers: np.ndarray
    total: np.ndarray
    alpha: np.ndarray

    @staticmethod
    def of(told: pa.Table, k: int, found: Grams) -> Answers:
        told = told.filter(pc.equal(told["k"], k)).sort_by("r")
        counts, total = (_joined(told[c], from_ints)[0] for c in ("counts", "totals"))
        numbers = np.zeros(len(counts), np.int64)
        told_numbers = np.concatenate([np.zeros(0, np.int64), *(from_ints(x).cumsum() for x in told["numbers"].to_pylist())])
        if len(told_numbers):
            numbers[counts > 0] = told_numbers
        runs = found.runs()
        size = np.diff(np.append(runs, len(found.keys)))
        alpha = np.ones(len(runs))
        if len(runs):
            alpha[np.add.reduceat(counts == 0, runs, dtype=np.int64) > 0] = _joined(told["alpha"], np.frombuffer)[0]
        return Answers(counts, numbers, np.repeat(total, size), np.repeat(alpha, size))


class Reading:
    """A group's texts, and order by order what was answered."""

    def __init__(self, group: pa.Table, levels: list[Level], ranges: int):
        self.rows, self.levels, self.ranges = _unpacked(group), levels, ranges
        self.text = Tokens.of(self.rows["text"])
        self.word = self.number = self.count = self.total = self.chance = None

    def grams(self, k: int, hot: Hot) -> Grams:
        if k == 1:
            return Grams.of_words(self.text, self.ranges)
        history = np.concatenate([[0], self.number[:-1]])
        history[self.text.first[:-1]] = 0
        return Grams.of(history, self.word, hot, self.ranges)

    def take(self, told: pa.Table, orders: int) -> None:
        """Read the answers up to an order: by place in the tokens ``chance``,
        the probability, backing off where the n-gram was not seen; ``count``
        and ``number`` of the n-gram, 0 if not seen, and ``total``, its history's."""
        size = len(self.text.tokens)
        for k in range(1, orders + 1):
            level = self.levels[k - 1]
            found = self.grams(k, level.hot)
            own = Answers.of(told, k, found)
            self.number, self.count, self.total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, np.int64)
            for mine, theirs in ((self.number, own.numbers), (self.count, own.counts), (self.total, own.total)):
                mine[found.at] = theirs[found.which]
            seen = level.mass(self.count) / self.total
            if k == 1:
                self.word, self.known = self.number, self.count
                self.chance = np.where(self.count > 0, seen, level.left)
            else:
                at = found.at
                self.chance[at] = np.where(self.count[at] > 0, seen[at], own.alpha[found.which] * self.chance[at])


def _ask_words(model: Model):
    levels, ranges = model.levels, model.ranges

    def ask(group: pa.Table) -> pa.Table:
        return _asked(1, group["g"][0].as_py(), Reading(group, levels, ranges).grams(1, levels[0].hot))

    return ask


def _ask(k: int, model: Model):
    levels, ranges = model.levels, model.ranges

    def ask(group: pa.Table, told: pa.Table) -> pa.Table:
        reading = Reading(group, levels, ranges)
        reading.take(told, k - 1)
        return _asked(k, group["g"][0].as_py(), reading.grams(k, levels[k - 1].hot))

    return ask


def _answers(dealt: DataFrame, model: Model, orders: int, numbered: int) -> DataFrame:
    """Per group, order (up to ``orders``) and range the answers to its
    questions, which at each order are in numbers answered at the one before.
    Numbers are told up to the order ``numbered``."""
    told = None
    for k in range(1, orders + 1):
        groups = dealt.groupBy("g")
        if k == 1:
            asked = groups.applyInArrow(_ask_words(model), _ASKED_SQL)
        else:
            asked = groups.cogroup(told.groupBy("g")).applyInArrow(_ask(k, model), _ASKED_SQL)
        held = model.tables.where(F.col("order") == k)
        own = asked.groupBy("r").cogroup(held.groupBy("r")).applyInArrow(_answer(k, model.levels[k - 1], k <= numbered), _TOLD_SQL)
        told = own if told is None else told.unionByName(own)
    return told


def _count_group(model: Model, hot: Hot):
    levels, ranges, order = model.levels, model.ranges, model.order + 1

    def rows(group: pa.Table, told: pa.Table) -> pa.Table:
        reading = Reading(group, levels, ranges)
        reading.take(told, order - 1)
        return _counted(reading.grams(order, hot), reading.count, reading.total)

    return rows


def _score_group(model: Model):
    levels, ranges, order, tokens, distinct = model.levels, model.ranges, model.order, model.tokens, model.distinct

    def score(group: pa.Table, told: pa.Table) -> pa.Table:
        reading = Reading(group, levels, ranges)
        reading.take(told, order)
        base = np.log10((reading.known + 0.1) / (tokens + 0.1 * (distinct + 1)))
        first = reading.text.first
        return pa.table(
            {
                "doc_id": reading.rows["doc_id"],
                "n_tokens": np.diff(first),
                "n_known": np.add.reduceat((reading.known > 0).astype(np.int64), first[:-1]),
                "base_score": np.add.reduceat(base, first[:-1]),
                "score": np.add.reduceat(np.log10(reading.chance), first[:-1]),
            }
        )

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row."""
    dealt = _dealt(docs, ["doc_id", "text"])
    told = _answers(dealt, model, model.order, model.order - 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(
        _score_group(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def op12_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
