"""Substring dedup by seed and extend.

Words are runs of characters other than space and ``\\x09``-``\\x0D``.  A repeat
is ``LEAST`` or more consecutive words that also stand in a document with a
smaller doc_id; every word of a document inside such a repeat is removed.

Seeds: of the ``LEAST - SEED + 1`` runs of ``SEED`` words in each ``LEAST``-word
window, the one with the least hash is the window's anchor (winnowing), so
equal windows have equal anchors while a text keeps about one anchor in five
words.  Documents are joined on anchors.  Extension: a window around an anchor
that two documents share reaches to its full length both ways, and windows are
joined on all their words with the least doc_id that has them; windows that
overlap merge into maximal repeats.

Everything moves packed, by groups of rows (a hash of id and text, about
``GROUP_BYTES`` of text each; so rows without an id, or of one id, spread) and by ranges of hashes: a group sends each
anchor or window once, however many of its documents hold it, so a passage that
every document shares costs one entry per group, and no task gathers the
documents of one key.

Hashes have 64 bits; different windows with equal hashes (one in 2**64 a pair)
would count as equal.

Defined results: a null text has no words; rows of one doc_id do not remove each
other's words; a null doc_id counts as smaller than any other; repeated rows are
returned each; a text of fewer than ``LEAST`` words stays whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import table
from funnelworks.llm.words import Words, column_words, inside_text, mix, run_hashes

LEAST = 13
SEED = 5
GROUP_BYTES = 4 << 20
#: Of texts whose anchors or windows share a range of hashes.
RANGE_BYTES = 16 << 20

_FIRST = np.iinfo(np.int64).min


def _doc_ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(int(_FIRST)).to_numpy(zero_copy_only=False)


def _blocks(texts: pa.ChunkedArray):
    """(index of its first text, words) of the blocks of a group's texts."""
    at = 0
    for chunk in texts.chunks:
        for lo, block in column_words(chunk):
            yield at + lo, block
        at += len(chunk)


def _window_anchors(block: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window inside a text: its first word, its text, its anchor."""
    starts, doc = inside_text(block.first, LEAST)
    if not len(starts):
        return starts, doc, np.zeros(0, np.uint64)
    least, have = run_hashes(block.hashes, SEED), 1
    while have < LEAST - SEED + 1:  # least of so many neighbours, doubling
        step = min(have, LEAST - SEED + 1 - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return starts, doc, mix(least[starts])  # least hashes are small: mixed, they fill their ranges evenly


def _changes(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a run of equal values in one text begins."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(new)


def _least_and_shared(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the least doc of each, whether two docs have it."""
    if not len(keys):
        return keys, docs, np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    least, most = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    return keys[first], least, most > least


def _by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """Slices of sorted 64-bit ``keys`` for equal ranges of their leading bits."""
    bounds = np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)
    cuts = [*np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [(r, slice(a, b)) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns)})


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All packed arrays of a column behind each other, and their lengths."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts or [np.zeros(0, dtype)]), np.array([len(p) for p in parts], np.int64)


def _anchors_of_group(ranges: int):
    def find(group: pa.Table) -> pa.Table:
        ids = _doc_ids(group["doc_id"])
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, block in _blocks(group["text"]):
            _, doc, anchor = _window_anchors(block)
            new = _changes(anchor, doc)
            keys.append(anchor[new])
            docs.append(ids[at + doc[new]])
        anchors, _, shared = _least_and_shared(np.concatenate(keys), np.concatenate(docs))
        g = group["g"][0].as_py()
        rows = [(r, g, anchors[s].tobytes(), shared[s].tobytes()) for r, s in _by_range(anchors, ranges)]
        return _table(rows, [("r", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("shared", pa.binary())])

    return find


def _shared_anchors(sent: pa.Table) -> pa.Table:
    """For each group the anchors of one range that another document has as well."""
    keys, lengths = _joined(sent["keys"], np.uint64)
    shared, _ = _joined(sent["shared"], bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.diff(np.append(first, len(ordered)))
    known = np.empty(len(keys), bool)
    known[order] = np.repeat((count > 1) | np.logical_or.reduceat(shared[order], first), count)
    ends = np.cumsum(lengths)
    rows = [(g, keys[b - n : b][known[b - n : b]].tobytes()) for g, n, b in zip(sent["g"].to_pylist(), lengths, ends)]
    return _table([r for r in rows if r[1]], [("g", pa.int32()), ("keys", pa.binary())])


def _windows_of_group(ranges: int):
    schema = [("r", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("shared", pa.binary())]

    def find(group: pa.Table, shared: pa.Table) -> pa.Table:
        wanted = np.sort(_joined(shared["keys"], np.uint64)[0])
        if not len(wanted) or not group.num_rows:
            return _table([], schema)
        ids = _doc_ids(group["doc_id"])
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, block in _blocks(group["text"]):
            starts, doc, anchor = _window_anchors(block)
            if not len(starts):
                continue
            new = _changes(anchor, doc)
            place = np.minimum(np.searchsorted(wanted, anchor[new]), len(wanted) - 1)
            hit = np.repeat(wanted[place] == anchor[new], np.diff(np.append(new, len(anchor))))
            keys.append(run_hashes(block.hashes, LEAST)[starts[hit]])
            docs.append(ids[at + doc[hit]])
        windows, least, several = _least_and_shared(np.concatenate(keys), np.concatenate(docs))
        g = group["g"][0].as_py()
        rows = [(r, g, windows[s].tobytes(), least[s].tobytes(), several[s].tobytes()) for r, s in _by_range(windows, ranges)]
        return _table(rows, schema)

    return find


def _earliest(sent: pa.Table) -> pa.Table:
    """For each group the windows of one range that a smaller doc_id has than
    some document of the group, with the least doc_id of all."""
    keys, lengths = _joined(sent["keys"], np.uint64)
    docs, _ = _joined(sent["docs"], np.int64)
    several, _ = _joined(sent["shared"], bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[order], first), np.diff(np.append(first, len(ordered))))
    told = several | (least < docs)
    rows = []
    for g, n, b in zip(sent["g"].to_pylist(), lengths, np.cumsum(lengths)):
        mine = slice(b - n, b)
        rows.append((g, keys[mine][told[mine]].tobytes(), least[mine][told[mine]].tobytes()))
    return _table([r for r in rows if r[1]], [("g", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])


def _kept(block: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes, and offsets per text."""
    sizes = np.where(keep, block.ends - block.starts + 1, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    offsets = ends[block.first]
    words = np.flatnonzero(keep)
    shift = np.repeat(block.starts[words] - ends[words], sizes[words])
    source = np.append(block.data, np.uint8(32))
    taken = np.arange(ends[-1]) + shift
    taken[ends[words + 1] - 1] = len(block.data)  # the space after every word
    joined = source[taken]
    # no space after a text's last kept word
    last = offsets[1:][np.diff(offsets) > 0] - 1
    whole = np.ones(len(joined), bool)
    whole[last] = False
    return joined[whole], offsets - np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])


def _cut_group(group: pa.Table, told: pa.Table) -> pa.Table:
    ids = _doc_ids(group["doc_id"])
    keys, docs = _joined(told["keys"], np.uint64)[0], _joined(told["docs"], np.int64)[0]
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    mask = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)  # spares most windows the search
    maybe[(keys & mask).astype(np.int64)] = True
    n_words, n_removed = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    parts, lengths = [], [np.zeros(0, np.int64)]
    for at, block in _blocks(group["text"]):
        keep = np.ones(len(block.hashes), bool)
        starts, doc = inside_text(block.first, LEAST)
        if len(keys) and len(starts):
            window = run_hashes(block.hashes, LEAST)[starts]
            some = np.flatnonzero(maybe[(window & mask).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, window[some]), len(keys) - 1)
            gone = some[(keys[place] == window[some]) & (docs[place] < ids[at + doc[some]])]
            cover = np.zeros(len(keep) + 1, np.int64)
            np.add.at(cover, starts[gone], 1)
            np.add.at(cover, starts[gone] + LEAST, -1)
            keep = np.cumsum(cover)[:-1] == 0
        here = slice(at, at + block.n_docs)
        n_words[here] = np.diff(block.first)
        n_removed[here] = np.diff(np.concatenate([[0], np.cumsum(~keep)])[block.first])
        data, offsets = _kept(block, keep)
        parts.append(data)
        lengths.append(np.diff(offsets))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
    data = np.concatenate(parts or [np.zeros(0, np.uint8)])
    kept = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
    return pa.table({"doc_id": group["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept": kept})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of every row that no earlier
    document repeats, joined by one space."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, ranges = 1 + size // GROUP_BYTES, 1 + size // RANGE_BYTES
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")
    grouped = docs.select(F.col("doc_id").cast("long"), "text", group.alias("g"))
    anchors = grouped.groupBy("g").applyInArrow(_anchors_of_group(ranges), "r int, g int, keys binary, shared binary")
    shared = anchors.groupBy("r").applyInArrow(_shared_anchors, "g int, keys binary")
    windows = grouped.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(
        _windows_of_group(ranges), "r int, g int, keys binary, docs binary, shared binary"
    )
    told = windows.groupBy("r").applyInArrow(_earliest, "g int, keys binary, docs binary")
    return grouped.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(
        _cut_group, "doc_id long, n_words long, n_removed long, kept string"
    )


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), wins AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM docs, unnest(range(1, len(w) - 11)) u(i)
), earliest AS (SELECT k, min(doc_id) AS least FROM wins GROUP BY k),
gone AS (
  SELECT DISTINCT r, i + j AS p FROM wins JOIN earliest USING (k), unnest(range(0, 13)) v(j) WHERE least < doc_id
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT r, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) u(p)) ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
