"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes is learned from labelled texts: the
node of a context (up to ``ORDER`` bytes before a position) counts the bytes
that followed it there.  A byte seen after the context in a language has
probability count / (total + distinct); else the language pays the escape
distinct / (total + distinct) and asks the context one byte shorter, at last a
uniform distribution over the 256 bytes (method C).  The tree is of variable
order: a context is kept only when it was seen ``LEAST_COUNT`` times, in at
most ``NODES`` nodes a language (its most frequent ones).  Statistics are frozen after
learning, so a text's exact code length is a sum of table entries, kept in
2**-16 bits as integers: equal texts score equal in any batch.

The prediction is the language with the shortest code (ties: the first by
name); ``score`` is its posterior probability under equal priors.  Other
columns than the text are never read for a prediction.

The training sample is bounded: about ``SAMPLE_BYTES`` of whole texts a
language, chosen by a hash of text and id, after one pass that sums the bytes
of each language.  Every language that occurs is learned, each with its own
nodes, so one with few texts has the same share of the model as a large one; the
model grows with the number of languages, not with the texts.

Defined results: a text of any length is read whole, piece by piece; a null text, or one without a letter, gives ``und`` with score
0; so does every text when nothing could be learned; repeated rows are scored
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from funnelworks.llm.common import stored, table
from funnelworks.llm.words import blocks, text_bytes

ORDER = 4
SAMPLE_BYTES = 4 << 20
LEAST_COUNT = 24
#: Contexts of a language.
NODES = 4_096
#: Shares of up to this many languages are broadcast (a name and a number each).
BROADCAST_LANGUAGES = 10_000
PIECE_BYTES = 1 << 18
#: Code lengths are counted in this part of a bit.
UNIT = 1 << 16
UNKNOWN = "und"


@dataclass
class Model:
    """``symbol``: byte to symbol (0: never seen in training, or the text's
    start); ``child``: node and symbol before it to the longer context's node,
    the last row where there is none; ``cost``: node and next symbol to code
    length; ``languages``: names in order; ``roots``: each one's empty context."""

    languages: list[str]
    roots: np.ndarray
    symbol: np.ndarray
    child: np.ndarray
    cost: np.ndarray
    order: int

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text and language the code length in 1/UNIT bits, as int64."""
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        for lo, hi in blocks(offsets, PIECE_BYTES):
            if hi == lo + 1:  # perhaps a long text: piece by piece, each after the bytes before it
                first, stop = offsets[lo], offsets[hi]
                for at in range(first, stop, PIECE_BYTES):
                    end = min(at + PIECE_BYTES, stop)
                    before = self.symbol[data[max(first, at - self.order) : at]]
                    padded = np.zeros(self.order + end - at, np.int32)
                    padded[self.order - len(before) : self.order] = before
                    padded[self.order :] = self.symbol[data[at:end]]
                    out[lo] += self._costs(padded).sum(0, dtype=np.int64)
                continue
            # symbol 0 before every text, so that no context reaches back into another
            sizes = np.diff(offsets[lo : hi + 1])
            starts = offsets[lo:hi] - offsets[lo] + self.order * np.arange(1, hi - lo + 1)
            padded = np.zeros(int(sizes.sum()) + self.order * (hi - lo), np.int32)
            place = np.arange(sizes.sum()) + np.repeat(self.order * np.arange(1, hi - lo + 1), sizes)
            padded[place] = self.symbol[data[offsets[lo] : offsets[hi]]]
            some = np.flatnonzero(sizes)
            if len(some):
                costs = np.vstack([self._costs(padded), np.zeros((1, len(self.languages)), np.int32)])
                from_ = starts[some] - self.order  # costs start after the first padding
                cuts = np.stack([from_, from_ + sizes[some]], 1).ravel()
                out[lo + some] = np.add.reduceat(costs, cuts, axis=0, dtype=np.int64)[::2]
        return out

    def _costs(self, padded: np.ndarray) -> np.ndarray:
        """The cost of every symbol but the first ``order``, which are context only."""
        n, width = len(padded) - self.order, np.int32(self.child.shape[1])
        child, cost, stopped = self.child.ravel(), self.cost.ravel(), len(self.child) - 1
        out = np.empty((n, len(self.roots)), np.int32)
        for j, root in enumerate(self.roots):
            at = node = np.full(n, root, np.int32)
            for k in range(1, self.order + 1):
                at = child[at * width + padded[self.order - k : self.order - k + n]]
                node = np.where(at != stopped, at, node)
            out[:, j] = cost[node * width + padded[self.order :]]
        return out


def sampled(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """About ``sample_bytes`` of whole texts for each language: lang, text.
    ``docs`` has doc_id, text, lang; rows without text or lang are left out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    share = F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest(F.col("bytes"), F.lit(1)))
    chosen = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    shares = stored(sizes.select("lang", share.alias("share")), "language-shares")
    if shares.count() <= BROADCAST_LANGUAGES:
        shares = F.broadcast(shares)
    return rows.join(shares, "lang").where(chosen).select("lang", "text")


def context_counts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, context (bytes before, oldest first), next byte, count, for all orders."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_bytes(batch.column(1))
            for lang in sorted(set(langs)):
                found: dict[int, list] = {k: [] for k in range(order + 1)}
                for d in np.flatnonzero(langs == lang):
                    text = data[offsets[d] : offsets[d + 1]].astype(np.uint64)
                    for k in range(min(order, len(text) - 1) + 1):
                        gram = np.zeros(len(text) - k, np.uint64)
                        for j in range(k + 1):
                            gram = (gram << np.uint64(8)) | text[j : len(text) - k + j]
                        found[k].append(gram)
                for k, grams in found.items():
                    values, counts = np.unique(np.concatenate(grams or [np.zeros(0, np.uint64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(values), pa.string()),
                            pa.array(np.full(len(values), k, np.int32)),
                            pa.array(values.astype(np.int64)),
                            pa.array(counts.astype(np.int64)),
                        ],
                        names=["lang", "k", "gram", "n"],
                    )

    counted = sample.mapInArrow(count, "lang string, k int, gram long, n long")
    return counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER, least: int = LEAST_COUNT, nodes: int = NODES) -> Model:
    """The model of the labelled ``docs`` (doc_id, text, lang)."""
    counts = stored(context_counts(sampled(docs, sample_bytes), order), "context-counts")
    # each language's contexts worth a node, by their count
    context = F.shiftright("gram", 8).alias("context")
    seen = counts.groupBy("lang", "k", context).agg(F.sum("n").alias("total")).where((F.col("total") >= least) & (F.col("k") > 0))
    order_of = Window.partitionBy("lang").orderBy(F.col("total").desc(), "k", "context")
    kept = seen.withColumn("rank", F.row_number().over(order_of)).where(F.col("rank") <= nodes).select("lang", "k", "context")
    wanted = counts.withColumn("context", F.shiftright("gram", 8)).join(kept, ["lang", "k", "context"])
    rows = wanted.select("lang", "k", "gram", "n").unionByName(counts.where("k = 0").select("lang", "k", "gram", "n")).toArrow()
    return build(*(rows[c].to_numpy() for c in ("lang", "k", "gram", "n")), order)


def build(langs, ks, grams, ns, order: int = ORDER) -> Model:
    """The model of counts, given as columns: language, number k of context
    bytes, the k + 1 bytes as a number (oldest first, the one that followed
    last), and how often they were seen."""
    languages, lang = np.unique(np.asarray(langs, object).astype(str), return_inverse=True)
    ks, grams, ns = (np.asarray(c, np.int64) for c in (ks, grams, ns))
    symbol = np.zeros(256, np.int32)
    known = np.unique(grams[ks == 0] & 255)
    symbol[known] = np.arange(1, len(known) + 1)
    width = len(known) + 1
    # a context is its language, length and bytes; a child comes after its parent, the context one byte shorter
    keys = lang.astype(np.int64) << 35 | ks << 32 | grams >> 8
    contexts = np.unique(keys)
    number = {int(c): i for i, c in enumerate(contexts)}
    by_context = np.argsort(keys, kind="stable")
    starts = np.append(np.searchsorted(keys[by_context], contexts), len(keys))
    n = len(contexts)
    child = np.full((n + 1, width), n, np.int32)
    bits = np.full((n, width), 8.0)
    for i, c in enumerate(contexts.tolist()):
        k, own = c >> 32 & 7, c & 0xFFFFFFFF
        parent = number.get(c >> 35 << 35 | (k - 1) << 32 | own & ((1 << 8 * (k - 1)) - 1)) if k else None
        if k and parent is None:
            continue  # cannot be reached
        rows = by_context[starts[i] : starts[i + 1]]
        counts = ns[rows]
        whole = np.log2(counts.sum() + len(rows))
        bits[i] = whole - np.log2(len(rows)) + (bits[parent] if k else 8.0)  # escape, and the shorter context
        bits[i, symbol[grams[rows] & 255]] = whole - np.log2(counts)
        if k:
            child[parent, symbol[own >> 8 * (k - 1)]] = i
    roots = np.array([number[j << 35] for j in range(len(languages))], np.int32)
    return Model(languages.tolist(), roots, symbol, child, np.round(bits * UNIT).astype(np.int32), order)


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """The given ``columns`` of ``docs`` (all without them) plus lang_pred,
    score and bits_per_byte (of the best language; null for ``und``).  Columns
    of ``docs`` with one of these three names are replaced."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    keep = [c for c in (docs.columns if columns is None else columns) if c not in {f.name for f in added}]
    text = F.when(F.rlike("text", F.lit(r"\p{L}")), F.col("text"))
    asked = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_read"))
    schema = T.StructType([*asked.schema.fields[:-1], *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by NODES and the languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            known = np.array(column.is_valid().to_numpy(zero_copy_only=False)) & bool(model.languages)
            data, offsets = text_bytes(column)
            lengths = np.diff(offsets)
            best = np.zeros(len(known), np.int64)
            post, rate = np.zeros(len(known)), np.zeros(len(known))
            if model.languages:
                code = model.code_lengths(data, offsets)
                best = code.argmin(1)
                least = code.min(1)
                post = 1.0 / np.exp2((least[:, None] - code) / UNIT).sum(1)
                rate = least / UNIT / np.maximum(lengths, 1)
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            rates = pa.array(rate, pa.float64(), mask=~known)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(known, post, 0.0)), rates],
                names=[*keep, "lang_pred", "score", "bits_per_byte"],
            )

    return asked.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(asked, model, ["doc_id", "held_out"])
