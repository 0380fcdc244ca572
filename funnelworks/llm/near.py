"""Near-duplicate classes by improved consistent weighted sampling.

A text's features are its distinct shingles of ``SHINGLE`` words (a shorter text
is one shingle), weighted by TF-IDF: (1 + ln tf) * idf.  The idf is taken from
the exact number of documents that hold the shingle, for every shingle in more
than ``RARE`` of them (see ``idf``); rarer ones weigh 1.  ``IDF_SHARE`` of a
weight follows the logarithm down to ``COMMON`` of the documents, and all of it
beyond; so the texts of a group of copies that holds up to a third of all rows
stay near.  Two texts are near when their weighted Jaccard similarity is
``THRESHOLD`` or more.

Sampling: improved consistent weighted sampling draws for every shingle and
hash function r, c from Gamma(2, 1) and b uniform, and takes the shingle with
the least a = c exp(-r (t - b + 1)), t = floor(ln w / r + b).  Drawn in another
order the same law reads: E, F, G exponential; c = E + F, r = ln(c / E) + G,
b = 1 - ln(c / E) / r.  Then a = E and t = 0 for the weight 1, which most
shingles have, so most of the work is one integer hash and a maximum.  Samples
(shingle, t) agree with a probability close to the weighted Jaccard similarity;
``BANDS`` bands of ``ROWS`` of them find a pair at the threshold with
probability 0.9996.

Candidates are verified by their exact weighted Jaccard similarity.  Every text
of a bucket is compared with the bucket's first text; where a bucket still holds
several classes, the first text of each goes on to finer buckets, which share a
second band as well, and is compared with the first text there.  What then is
left, the texts of buckets of several classes, is joined exactly by prefixes:
with the shingles of each text in one order, rare ones first, the first shingle
that two near texts share leaves both enough weight for the overlap that the
threshold asks for.  So a text is looked up by its leading shingles only, which
a passage shared by many texts that are not near is not part of: a row for each,
at most a fifth of the text.  Shingles that lead the same texts are one set of
texts, so a passage that some texts share is looked at once and not shingle by
shingle; a text of a set of several classes gets a row there for each class of
weights among them that it can be near to.  Texts that meet are compared with
the first one of theirs, round by round over the classes found, until nothing
new appears, then with every text of another class.  Pairs inside a class are
never made.  Classes are the connected components of the verified links.  Only
distinct texts take part; copies join their text's class.

Defined results: a null text counts as empty; texts without words are in one
class with their exact copies only; repeated rows are returned each; a null
doc_id comes last, and a class of nothing but nulls has a null class_id (its
class_no still tells it apart); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import discard, stored, table, with_position
from funnelworks.llm.words import Words, blocks, inside_text, mix, run_hashes, text_bytes, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
COMMON = 1 / 3
#: Shingles in more than this share of the documents are counted one by one and
#: weighted by their own count.
RARE = 1 / 256
#: The part of a weight that the idf of shingles in ``COMMON`` or less scales.
IDF_SHARE = 0.15
#: Shingles are first counted in so many cells; only those of cells that reach
#: the rare count are counted one by one.
CELLS = 1 << 18
#: Shingles are put in order by the counts of so many cells (4 bytes each).
ORDER_CELLS = 1 << 20
#: Classes of weights by which prefixes are cut: so many from a text's weight to
#: the greatest of a near text.
WEIGHT_CLASSES = 8
_BLOCK = 1 << 18

_KEYS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Common:
    """Shingles in more than ``RARE`` of the documents, sorted, and their idf."""

    keys: np.ndarray
    idf: np.ndarray


@dataclass
class Features:
    """Distinct shingles of a block of texts, text by text and sorted within
    each: ``first`` has each text's start (and the end)."""

    keys: np.ndarray
    weights: np.ndarray
    first: np.ndarray


def shingles(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle's hash and its text's number, by text."""
    starts, doc = inside_text(block.first, SHINGLE)
    keys = run_hashes(block.hashes, SHINGLE)[starts]
    counts = np.diff(block.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            whole[has] = mix(whole[has] * np.uint64(31) + block.hashes[block.first[short[has]] + k])
        keys, doc = np.concatenate([keys, whole]), np.concatenate([doc, short])
    return keys, doc


def features(block: Words, common: Common | None = None) -> Features:
    keys, doc = shingles(block)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(keys)))
    keys, doc = keys[at], doc[at]
    weights = 1.0 + np.log(count)
    if common is not None and len(common.keys):
        place = np.minimum(np.searchsorted(common.keys, keys), len(common.keys) - 1)
        weights *= np.where(common.keys[place] == keys, common.idf[place], 1.0)
    return Features(keys, weights, np.searchsorted(doc, np.arange(block.n_docs + 1)))


def _uniform(z: np.ndarray) -> np.ndarray:
    """In (0, 1), from the leading bits."""
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def samples(f: Features) -> np.ndarray:
    """The consistent weighted samples of each text that has shingles: one
    uint64 naming (shingle, t) per hash function."""
    some = np.flatnonzero(np.diff(f.first))
    starts = f.first[some]
    out = np.zeros((len(some), len(_KEYS)), np.uint64)
    if not len(some):
        return out
    odd = np.flatnonzero(f.weights != 1.0)
    text_of_odd = np.searchsorted(starts, odd, "right") - 1
    log_weight = np.log(f.weights[odd])
    for k, key in enumerate(_KEYS):
        z = (f.keys ^ key) * (key | np.uint64(1))
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        drawn = z[odd]
        z[odd] = 0  # the least E is the greatest z
        best = np.maximum.reduceat(z, starts)
        name = mix(best)
        if len(odd):
            with np.errstate(divide="ignore"):
                least = np.where(best > 0, -np.log(_uniform(best)), np.inf)
            e = -np.log(_uniform(drawn))
            c = e - np.log(_uniform(mix(drawn ^ np.uint64(1))))
            x = np.log(c / e)
            r = x - np.log(_uniform(mix(drawn ^ np.uint64(2))))
            b = 1.0 - x / r
            t = np.floor(log_weight / r + b)
            a = c * np.exp(-r * (t - b + 1.0))
            order = np.lexsort((a, text_of_odd))
            head = order[np.concatenate([[True], np.diff(text_of_odd[order]) > 0])]
            texts = text_of_odd[head]
            wins = a[head] < least[texts]
            named = mix(drawn[head]) + t[head].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            name[texts[wins]] = named[wins]
        out[:, k] = name
    return out


def band_keys(f: Features) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their band keys as int64)."""
    drawn = samples(f).reshape(-1, BANDS, ROWS)
    keys = np.zeros(drawn.shape[:2], np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + drawn[:, :, r])
    return np.flatnonzero(np.diff(f.first)), keys.view(np.int64)


def weighted_jaccard(a: Features, i: int, b: Features, j: int) -> float:
    sa, sb = slice(a.first[i], a.first[i + 1]), slice(b.first[j], b.first[j + 1])
    ka, wa, kb, wb = a.keys[sa], a.weights[sa], b.keys[sb], b.weights[sb]
    if not len(ka) or not len(kb):
        return 0.0
    place = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[place] == ka
    shared = np.minimum(wa[both], wb[place[both]]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def _column_features(column: pa.Array, common: Common | None) -> Iterator[tuple[int, Features]]:
    data, offsets = text_bytes(column)
    for lo, hi in blocks(offsets, _BLOCK):
        yield lo, features(words(data, offsets, lo, hi), common)


def common_shingles(docs: DataFrame) -> Common:
    """The shingles of more than ``RARE`` of all documents.  Both collected
    lists are bounded: with s distinct shingles a document on average, at most
    s / RARE cells or shingles can reach that count."""
    texts = docs.select("text")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, f in _column_features(batch.column(0), None):
                total += np.bincount((f.keys % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["cell", "n"]
        )

    counted = stored(texts.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "shingle-cells")
    n_docs = counted.where("cell = -1").first()
    n_docs = n_docs["n"] if n_docs else 0
    floor = RARE * n_docs
    heavy = counted.where((F.col("cell") >= 0) & (F.col("n") > floor)).select("cell").toArrow()["cell"].to_numpy()
    discard(counted)
    if not len(heavy):
        return Common(np.zeros(0, np.uint64), np.zeros(0))
    wanted = np.zeros(CELLS, bool)
    wanted[heavy] = True

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.keys[wanted[(f.keys % np.uint64(CELLS)).astype(np.int64)]] for _, f in _column_features(batch.column(0), None)]
            keys, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    each = texts.mapInArrow(exact, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > floor)
    rows = each.toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Common(keys[order], idf(rows["n"].to_numpy()[order], n_docs))


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The weights of shingles in ``df`` of ``n_docs`` documents, each more than
    ``RARE`` of them: ln(1 + n_docs / df), scaled to 1 at ``RARE`` and weighing
    in by ``IDF_SHARE``; beyond ``COMMON`` also scaled as a whole."""
    rarity = np.log1p(n_docs / df)
    share = 1.0 - IDF_SHARE + IDF_SHARE * rarity / np.log1p(1 / RARE)
    return share * np.minimum(rarity / np.log1p(1 / COMMON), 1.0)


def signatures(docs: DataFrame, common: Common) -> DataFrame:
    """doc_id, t1, t2 (the text's 128-bit name), bands (null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, known = [np.zeros((0, BANDS), np.int64)], np.zeros(batch.num_rows, bool)
            for lo, f in _column_features(batch.column("text"), common):
                some, mine = band_keys(f)
                known[lo + some] = True
                keys.append(mine)
            offsets = np.concatenate([[0], np.cumsum(known * BANDS)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys).ravel()))
            rest = [batch.column(c) for c in ("doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*rest, lists], names=["doc_id", "t1", "t2", "bands"])

    return _named(docs).mapInArrow(sign, "doc_id long, t1 long, t2 long, bands array<long>")


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text")
    )


def verified(pairs: DataFrame, texts: DataFrame, common: Common) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are near; ``texts`` has node, text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            left, right = text_bytes(batch.column("ta")), text_bytes(batch.column("tb"))
            for lo, hi in blocks(left[1] + right[1], _BLOCK):
                a = features(words(*left, lo, hi), common)
                b = features(words(*right, lo, hi), common)
                for i in range(hi - lo):
                    near[lo + i] = weighted_jaccard(a, i, b, i) >= THRESHOLD
            links = batch.select(["a", "b"]).filter(pa.array(near))
            yield links

    first = joined(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = joined(first, texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def joined(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Both tables dealt out by their keys, however small.  They grow with the
    documents; as a broadcast each would be built as a hash table in the
    driver, a hundred and more of them in a run."""
    return left.join(right.hint("merge"), on, how)


def components(links: DataFrame) -> DataFrame:
    """node, class (its least node) of every node of the links (a, b).

    Each round every node takes the least class among its neighbours' and then
    that class's own class, so classes reach along paths of doubling length.
    """
    ways = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ("ab", "ba", "aa", "bb")]  # a node hears itself too
    edges = stored(links.select(F.inline(F.array(*ways))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("class")), "labels")
    while True:
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("class")))
        heard = joined(edges, labels.withColumnRenamed("node", "b"), "b")
        nearer = heard.groupBy(F.col("a").alias("node")).agg(F.min("class").alias("class"), own.alias("old"))
        further = labels.select(F.col("node").alias("class"), F.col("class").alias("jump"))
        jumped = joined(nearer, further, "class").select("node", F.col("jump").alias("class"), (F.col("jump") != F.col("old")).alias("new"))
        moved = stored(jumped, "labels")
        discard(labels)
        labels = moved
        if moved.where("new").isEmpty():
            discard(edges)
            return moved.select("node", "class")


def cell_counts(texts: DataFrame) -> np.ndarray:
    """In how many of ``texts`` the shingles of each of ``ORDER_CELLS`` cells are, all together."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_CELLS, np.int64)
        for batch in batches:
            for _, f in _column_features(batch.column(0), None):
                total += np.bincount((f.keys % np.uint64(ORDER_CELLS)).astype(np.int64), minlength=ORDER_CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "n"])

    counted = texts.select("text").mapInArrow(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counted.where("n > 1").select("cell", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.ones(ORDER_CELLS, np.int32)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def leading(f: Features, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, its weight, its weight from that shingle on): the leading
    shingles of each text, as far as any near text asks for."""
    doc = np.repeat(np.arange(len(f.first) - 1), np.diff(f.first))
    number = counts[(f.keys % np.uint64(len(counts))).astype(np.int64)]
    order = np.lexsort((f.keys, number, doc))
    keys, weights, number = f.keys[order], f.weights[order], number[order]
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    weight = (sums[f.first[1:]] - sums[f.first[:-1]])[doc]
    rest = sums[f.first[1:]][doc] - sums[:-1]
    shared = number > 1  # a shingle alone in its cell is in no other text
    leads = np.flatnonzero(shared & (rest >= needed(weight, THRESHOLD * weight)))
    return keys[leads], doc[leads], weight[leads], rest[leads]


def class_keys(
    name: np.ndarray, weight: np.ndarray, rest: np.ndarray, lightest: np.ndarray, heaviest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(key, which of the rows): for each row, a text under the ``name`` of a
    leading shingle or a set of them, and each class of weights of the other
    text that it still leads for, from the ``lightest`` to the ``heaviest`` text
    under that name."""
    step = -np.log(THRESHOLD) / WEIGHT_CLASSES
    mine, low, high = (np.floor(np.log(w) / step).astype(np.int64) for w in (weight, lightest, heaviest))
    found = []
    for d in range(-WEIGHT_CLASSES - 1, WEIGHT_CLASSES + 2):
        least = np.maximum(np.exp((mine + d) * step), THRESHOLD * weight)
        leads = np.flatnonzero((low <= mine + d) & (mine + d <= high) & (rest >= needed(weight, least)))
        code = (np.minimum(mine, mine + d)[leads] * 64 + abs(d)).astype(np.uint64)
        found.append((mix(name[leads] + mix(code)).view(np.int64), leads))
    return tuple(np.concatenate(c) for c in zip(*found))


def prefixes(f: Features, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, its weight, its weight from that shingle on): a row for each
    leading shingle of each text and each class of weights of the other text.
    Two texts that are near share the key of their first common shingle, and
    there the weights left to both reach the overlap the threshold asks for."""
    shingle, doc, weight, rest = leading(f, counts)
    others = (np.full(len(weight), w) for w in (weight.min(initial=np.inf), weight.max(initial=0)))
    key, at = class_keys(shingle, weight, rest, *others)
    return key, doc[at], weight[at], rest[at]


def needed(a, b):
    """The least overlap of two near texts of the given weights, less rounding."""
    return (a + b) * (THRESHOLD / (1 + THRESHOLD) * (1 - 1e-7))


def leads(texts: DataFrame, common: Common) -> DataFrame:
    """shingle, node, class, weight, rest: the leading shingles of ``texts``
    (node, class, text)."""
    counts = cell_counts(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own = batch.column("node").to_numpy(), batch.column("class").to_numpy()
            for lo, f in _column_features(batch.column("text"), common):
                shingle, doc, weight, rest = leading(f, counts)
                columns = [shingle.view(np.int64), node[lo + doc], own[lo + doc], weight, rest]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "class", "weight", "rest"])

    return texts.select("node", "class", "text").mapInArrow(cut, "shingle long, node long, class long, weight double, rest double")


def of_several_classes(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """The ``rows`` whose ``key`` has texts of several classes, and ``more`` of the key's rows."""
    mixed = rows.groupBy(key).agg(F.min("class").alias("lo"), F.max("class").alias("hi"), *more).where("lo < hi").drop("lo", "hi")
    return joined(rows, mixed, key)


def postings(sets: DataFrame) -> DataFrame:
    """key, node, class, weight, rest: a row for each text of ``sets`` and each
    class of weights of the other texts there that it can be near to."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, *weights = (batch.column(c).to_numpy() for c in ("set", "weight", "rest", "lightest", "heaviest"))
            key, at = class_keys(name.view(np.uint64), *weights)
            kept = batch.select(["node", "class", "weight", "rest"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(key), *kept.columns], names=["key", *kept.schema.names])

    return sets.mapInArrow(spread, "key long, node long, class long, weight double, rest double")


def _can_be_near(a: str, b: str) -> Column:
    wa, wb = F.col(f"{a}.weight"), F.col(f"{b}.weight")
    return F.least(f"{a}.rest", f"{b}.rest") >= needed(wa, wb)


def _in_order(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def sets(rows: DataFrame, key: str) -> DataFrame:
    """set, node, class, weight, rest, lightest, heaviest: the texts that meet
    under a ``key``, for the keys whose texts are of several classes, and the
    weights of the lightest and the heaviest of them.  Keys with the same texts
    are one set, where each text has the most weight left that one of the keys
    leaves it; so two texts with many shingles in common meet a few times, not
    once for each.  Sets that share a name by chance are looked at together."""
    names = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    texts = [F.xxhash64(*names, F.count("*")).alias("set"), F.min("weight").alias("lightest"), F.max("weight").alias("heaviest")]
    found = of_several_classes(rows, key, *texts)
    most = [F.max(c).alias(c) for c in ("class", "weight", "rest", "heaviest")]
    return found.groupBy("set", "node").agg(*most, F.min("lightest").alias("lightest"))


def _classed(df: DataFrame, label: DataFrame) -> DataFrame:
    return joined(df, label, "node", "left").withColumn("class", F.coalesce("class", "node"))


def joined_exactly(links: DataFrame, label: DataFrame, texts: DataFrame, left: DataFrame, common: Common) -> DataFrame:
    """The classes of ``links`` and of what else it takes to join every near pair
    of the nodes ``left``; ``label`` has the classes of ``links``."""
    led = stored(leads(_classed(joined(texts, left, "node", "left_semi"), label), common), "leads")
    # shingles of the same texts are one set before a row is made per class of weights
    mixed = stored(sets(led, "shingle"), "mixed-leads")
    discard(led)
    met = stored(sets(postings(mixed), "key").select("set", "node", "weight", "rest"), "sets")
    discard(mixed)
    while True:
        classed = of_several_classes(_classed(met, label), "set")
        rows = stored(classed.select("set", "class", F.struct("node", "weight", "rest").alias("t")), "mixed-sets")
        discard(met)
        met = rows.select("set", "t.*")  # pairs of one class need no further look
        met._stored_at = rows._stored_at
        heads = rows.groupBy("set").agg(F.min(F.struct("t", "class")).alias("h"))
        first = joined(rows, heads, "set").where(F.col("class") != F.col("h.class")).where(_can_be_near("t", "h.t"))
        pairs = stored(first.select(*_in_order("t.node", "h.t.node")).distinct(), "pairs")
        more = stored(verified(pairs, texts, common), "links")
        discard(pairs)
        if more.isEmpty():
            break
        links = stored(links.unionByName(more), "links")
        label = components(links)
    one = rows.select("set", "class", F.col("t").alias("x"))
    other = rows.select("set", F.col("class").alias("class2"), F.col("t").alias("y"))
    both = joined(one, other, "set").where("class < class2").where(_can_be_near("x", "y"))
    pairs = stored(both.select(*_in_order("x.node", "y.node")).distinct(), "pairs")
    more = stored(verified(pairs, texts, common), "links")
    for done in (rows, pairs):
        discard(done)
    return label if more.isEmpty() else components(links.unionByName(more))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as doc_id, t1, t2, bands, and their distinct texts: node, t1, t2,
    least (the first doc_id), bands, class_no (the least node of its class)."""
    docs = docs.select("doc_id", "text")
    common = common_shingles(docs)
    signed = stored(signatures(docs, common), "signatures")
    distinct = signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    ordered = with_position(distinct, F.col("least").asc_nulls_last(), F.col("t1"), F.col("t2"), position="node", name="texts")
    nodes = stored(ordered, "nodes")  # read some times below, each time with the positions' join else
    discard(ordered)
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(joined(banded, buckets, ["band", "key"]), "bucket-members")
    met = members.select("node").distinct()
    chosen = joined(nodes, met, "node").select("node", "t1", "t2", "least")
    named = _named(docs)
    same = (named["t1"] == chosen["t1"]) & (named["t2"] == chosen["t2"]) & named["doc_id"].eqNullSafe(chosen["least"])
    texts = stored(joined(named, chosen, same).select("node", "text").dropDuplicates(["node"]), "candidate-texts")

    pairs = stored(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(verified(pairs, texts, common), "links")
    label = components(links)
    now = _classed(members.select("band", "key", "node"), label)
    heads = now.groupBy("band", "key", "class").agg(F.min("node").alias("node"))
    mixed = heads.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    apart = stored(joined(heads, mixed, ["band", "key"]), "mixed-heads")  # asked for twice below
    split = (
        joined(apart, nodes.select("node", "bands"), "node")
        .select("band", "key", "class", "node", F.posexplode("bands").alias("band2", "key2"))
        .where("band2 <> band")
    )
    finer = ["band", "key", "band2", "key2"]
    first = split.groupBy(*finer).agg(F.min(F.struct("node", "class")).alias("first"), F.count("*").alias("n")).where("n > 1")
    across = joined(split, first.drop("n"), finer).where(F.col("class") != F.col("first.class"))
    fresh = across.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct()
    fresh = stored(joined(fresh, pairs, ["a", "b"], "left_anti"), "pairs")
    discard(apart)
    more = stored(verified(fresh, texts, common), "links")
    links = links.unionByName(more)
    if not more.isEmpty():
        label = components(links)
    now = _classed(members.select("band", "key", "node"), label)
    mixed = now.groupBy("band", "key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
    left = stored(joined(members, mixed, ["band", "key"], "left_semi").select("node").distinct(), "mixed-buckets")
    if not left.isEmpty():
        label = joined_exactly(links, label, texts, left, common)
    discard(left)
    discard(texts)
    discard(members)
    return signed, joined(nodes, label, "node", "left").withColumn("class_no", F.coalesce("class", "node")).drop("class")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, class_id, class_no, first_t1, first_t2: every row of
    ``docs`` with its class: the least doc_id in it, and the text that has it."""
    signed, nodes = distinct_texts(docs)
    heads = nodes.where("node = class_no").select(
        "class_no", F.col("least").alias("class_id"), F.col("t1").alias("first_t1"), F.col("t2").alias("first_t2")
    )
    found = joined(nodes.select("t1", "t2", "class_no"), heads, "class_no")
    named_classes = found.select("t1", "t2", "class_id", "class_no", "first_t1", "first_t2")
    return signed.select("doc_id", "t1", "t2").join(named_classes, ["t1", "t2"])  # copies in number: Spark may broadcast


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their class: a row with
    the class's least doc_id and its text."""
    heads = distinct_texts(docs)[1].where("node = class_no").select("t1", "t2", "least")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"), "doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")
    )
    same = (rows["t1"] == heads["t1"]) & (rows["t2"] == heads["t2"]) & rows["doc_id"].eqNullSafe(heads["least"])
    kept = joined(rows, heads, same, "left_semi").dropDuplicates(["t1", "t2", "doc_id"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_no")
