"""Importance resampling of documents towards a target distribution.

Features of a text are all runs of one and two consecutive words, counted in
``BUCKETS`` hash buckets (CRC-32).  A bucket's gain is the log ratio of its
smoothed share in the target texts and in all documents, a document's weight
the floored mean of its features' gains, taken from an array of all gains.
Weight plus Gumbel noise from a hash of the id is the score; the documents of
the highest scores are the draw, which samples without replacement in
proportion to the exponential of the weights.

The cutoff is found by bracketing: a quantile sketch of the scores gives a
bracket around it, exact counts of the rows above and inside tell whether the
cutoff is inside (else the bracket moves and doubles), and only the rows of
the bracket are sorted.

Counts are one array of fixed size a task and text column; no text is
shuffled.

Defined results: a null or empty text has no features and weight 0; a null
doc_id has the noise of an empty id and comes last among equal scores; rows of
equal doc_id and score are drawn in any order; repeated rows are documents of
their own; empty target texts give every bucket the same treatment (no count);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import stored, table, with_position
from funnelworks.llm.words import blocks, text_bytes

BUCKETS = 10_000
LEAST_WORDS = 20
#: Of the documents with enough words, in percent.
SHARE = 25
SEED = "7"
#: Half the share of the rows that the first bracket spans.
AROUND = 0.005
#: Words up to this many bytes are hashed all at a time.
SHORT = 64

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()
_START = 0xFFFFFFFF


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: starts and ends of the words, and per text (and
    once more at the end) the number of its first word.  ``offsets`` begin at 0."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def crc_after(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC registers ``state`` after the bytes of each span."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size, starts, out = size[order], starts[order], state[order]
    long = int(np.searchsorted(-size, -SHORT))  # the first of them are longer
    for i in range(long):
        word = data[starts[i] : starts[i] + size[i]].tobytes()
        out[i] = zlib.crc32(word, int(out[i]) ^ _START) ^ _START
    size, starts, rest = size[long:], starts[long:], out[long:]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # longer than j
        part = rest[:n]
        rest[:n] = _CRC[(part ^ data[starts[:n] + j]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, and of the pairs; per text (and once more at the
    end) the number of its first word, and of its first pair."""
    data = lower(data)
    starts, ends, first = word_spans(data, offsets)
    alone = crc_after(data, starts, ends, np.full(len(starts), _START, np.uint32))
    second = np.ones(len(starts), bool)
    second[first[:-1][np.diff(first) > 0]] = False
    second = np.flatnonzero(second)
    before = alone[second - 1]
    spaced = _CRC[(before ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (before >> np.uint32(8))
    pairs = crc_after(data, starts[second], ends[second], spaced)
    bucket = lambda state: ((state ^ np.uint32(_START)) % np.uint32(BUCKETS)).astype(np.int64)
    return bucket(alone), bucket(pairs), first, np.searchsorted(second, first)


def _text_blocks(column: pa.Array):
    """(bytes, offsets from 0) of some whole texts of the column at a time."""
    data, offsets = text_bytes(column)
    for lo, hi in blocks(offsets):
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often the features of the one column of ``texts`` fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in _text_blocks(batch.column(0)):
                for found in features(*block)[:2]:
                    total += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    counted = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every bucket, in thousandths of a nat, floored."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in pairs], np.int64)


def noise(key: object, seed: str = SEED) -> int:
    """Gumbel noise of an id, in thousandths, floored."""
    told = f"{seed}:{'' if key is None else key}"
    h = int(hashlib.sha256(told.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of ``docs``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, words, pairs = [], [], []
            for block in _text_blocks(batch.column(1)):
                *found, first_word, first_pair = features(*block)
                totals = [np.concatenate([[0], np.cumsum(gain[f])]) for f in found]
                sums.append(np.diff(totals[0][first_word]) + np.diff(totals[1][first_pair]))
                words.append(np.diff(first_word))
                pairs.append(np.diff(first_pair))
            none = [np.zeros(0, np.int64)]
            n_words = np.concatenate(none + words)
            n = n_words + np.concatenate(none + pairs)
            weight = np.concatenate(none + sums) // np.maximum(n, 1)
            drawn = weight + np.array([noise(k, seed) for k in batch.column(0).to_pylist()], np.int64)
            arrays = [batch.column(0), *(pa.array(a.astype(np.int64)) for a in (n_words, n, weight, drawn))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight", "score"])

    asked = docs.select("doc_id", "text")
    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def bracket(scores: DataFrame, wanted: int, rows: int, around: float = AROUND) -> tuple[int, int, int]:
    """(low, high, rows above high): the ``wanted``-th highest score is in low
    to high.  ``scores``: a column score of ``rows`` rows."""
    middle = 1 - wanted / rows
    asked = [max(0.0, middle - around), min(1.0, middle + around)]
    sketch = F.percentile_approx("score", asked, round(4 / around))
    low, high = scores.agg(sketch.alias("q")).first()["q"]
    wide = max(high - low, 1)
    while True:
        above, inside = F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))
        n_above, n_inside = scores.agg(above.alias("a"), inside.alias("i")).first()
        if n_above < wanted <= n_above + n_inside:
            return low, high, n_above
        if n_above >= wanted:
            low, high = high + 1, high + wide
        else:
            low, high = low - wide, low - 1
        wide *= 2


def draw(scores: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """``scores`` (doc_id, n_words, score and others) plus rank: 1, 2, ... of
    the drawn rows from the highest score (ties: the smaller doc_id), else null."""
    # the row number spreads equal rows over the sorted ranges
    rows = stored(scores.withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    wanted = share * n // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.drop("_row").select("*", undrawn)
    low, high, above = bracket(able.select("score"), wanted, n)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    inside = with_position(able.where(F.col("score").between(low, high)).select("score", "doc_id", "_row"), *order, name="bracket")
    last = inside.where(F.col("position") == wanted - above - 1).first()
    equal = F.col("score") == last["score"]
    key = F.lit(last["doc_id"])
    sooner = F.lit(last["doc_id"] is None) | F.coalesce(F.col("doc_id") < key, F.lit(False))
    tied = F.col("doc_id").eqNullSafe(key) & (F.col("_row") <= last["_row"])
    in_draw = (F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | (equal & (tied | (sooner & ~F.col("doc_id").eqNullSafe(key)))))
    ranked = with_position(rows.where(in_draw), *order, name="drawn").withColumn("rank", F.col("position") + 1).drop("position")
    return ranked.unionByName(rows.where(~in_draw).select("*", undrawn)).drop("_row")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gain = gains(bucket_counts(docs.select("text")), bucket_counts(table(spark, sf_dir, "benchmark").select("text")))
    return draw(scored(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")


def _sql_features(name: str, source: str, key: str) -> str:
    """CTEs: words, and all features, of the rows of a table."""
    return f"""
{name}_words AS (
  SELECT row_number() OVER () AS r, {key} AS id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source}
), {name}_features AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {name}_words
)"""


OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS k)
), {_sql_features("doc", "documents", "doc_id")}, {_sql_features("bench", "benchmark", "item_id")},
asked AS (SELECT DISTINCT f FROM (SELECT f FROM doc_features UNION ALL SELECT f FROM bench_features)),
crc AS (
  SELECT f, hex(encode(f)) AS bytes, 0 AS i, 4294967295::BIGINT AS c FROM asked
  UNION ALL
  SELECT f, bytes, i + 1, xor(c >> 8, v) FROM crc JOIN crc_table
    ON k = xor(c & 255, 16 * (strpos('0123456789ABCDEF', bytes[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', bytes[2 * i + 2]) - 1)
  WHERE 2 * i < length(bytes)
), bucket AS (SELECT f, xor(c, 4294967295) % {BUCKETS} AS b FROM crc WHERE 2 * i = length(bytes)),
corpus AS (SELECT b, count(*) AS n FROM doc_features JOIN bucket USING (f) GROUP BY b),
target AS (SELECT b, count(*) AS n FROM bench_features JOIN bucket USING (f) GROUP BY b),
gain AS (
  SELECT u.b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM corpus) + {BUCKETS}))::DOUBLE
                   / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM target) + {BUCKETS}))::DOUBLE))::BIGINT AS g
  FROM (SELECT unnest(range({BUCKETS})) AS b) u LEFT JOIN corpus s USING (b) LEFT JOIN target t USING (b)
), sums AS (SELECT r, sum(g) AS g, count(*) AS n FROM doc_features JOIN bucket USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT d.r, d.id AS doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features,
         coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296)))::BIGINT AS noise
  FROM doc_words d LEFT JOIN sums USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER () AS able
  FROM scored WHERE n_words >= {LEAST_WORDS}
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
       CASE WHEN place <= {SHARE} * able // 100 THEN place::BIGINT END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
