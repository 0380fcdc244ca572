"""The pipeline against a brute-force version of every stage."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from funnelworks.llm import decontaminate, language
from tests.conftest import SF_SMALL
from tests.llm.test_near import brute_classes

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*")


def redacted(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[redacted]"
        at = max(at, b)
    return out + text[at:]


def symbols(toks):
    out = []
    for before, t in zip([None, *toks], toks):
        number = before is not None and before[0].isdigit()
        out.append("#" if t[0].isdigit() else "@" if t[0] != t[0].lower() else "%" if number and t in decontaminate.UNITS else t)
    return out


def leaks(text, items):
    """Whether a window of an item stands in the text with consistent slots."""
    toks = TOKEN.findall(text)
    mine = symbols(toks)
    for other in items:
        theirs, n = symbols(other), min(13, len(other))
        if n < 5:
            continue
        wanted = {}
        for j in range(len(other) - n + 1):
            wanted.setdefault(tuple(theirs[j : j + n]), []).append(other[j : j + n])
        for i in range(len(toks) - n + 1):
            for values in wanted.get(tuple(mine[i : i + n]), ()):
                here = toks[i : i + n]
                pairs = {(b, d) for b, d, s in zip(values, here, mine[i : i + n]) if s in "#@%"}
                slots = sum(s in "#@%" for s in mine[i : i + n])
                one_to_one = len(pairs) == len({b for b, _ in pairs}) == len({d for _, d in pairs})
                if here == values or (one_to_one and slots * 2 <= n):
                    return True
    return False


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first()["text"]
    odd = [(9001, None, "en", "s", 1), (9002, "12 34 %%", "en", "s", 2), (9003, "", None, "s", 0), (9008, "совсем другой язык " * 5, "en", "s", 1)]
    odd += [(9005, "password = abcdef123456 and token: 'zzzzzz' " + "0123456789abcdef" * 3, None, "s", 3), (9006, f"words before {bench} words after", "en", "s", 3)]
    return table.unionByName(spark.createDataFrame(odd, table.schema))


def test_stages_against_brute_force(spark, docs):
    bench = [TOKEN.findall(r["text"] or "") for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = docs.collect()
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, SF_SMALL).cache()
        if name != "pack":
            assert after.columns == docs.columns
        if name == "language":
            model = language.learn(docs.where(~language.held_out(docs["doc_id"])))
            bits = {r["doc_id"]: r["bits_per_byte"] for r in language.predict(docs, model).collect()}
            rows = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"]) and bits[r["doc_id"]] < 14]
            assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in rows} == {9001, 9002, 9003, 9008}
            want = {r["doc_id"]: r["text"] for r in rows}
        elif name == "near_duplicates":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in rows])
            want = {r["doc_id"]: r["text"] for r in rows if classes[r["doc_id"]] == r["doc_id"]}
        elif name == "decontaminate":
            want = {d: t for d, t in want.items() if not leaks(t, bench)}
            assert 9006 not in want
        elif name == "secrets":
            want = {d: redacted(t) for d, t in want.items()}
            assert want[9005] == "[redacted] and [redacted]' [redacted]"
        if name != "pack":
            got = after.collect()
            assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(want), name
            assert all(r["lang"] is not None for r in got)
            if name == "secrets":
                assert all(r["n_chars"] == len(r["text"]) for r in got)
        at = after
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: len(reference.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    pieces = Counter()
    for r in at.collect():
        assert r["doc_tokens"] == tokens[r["doc_id"]]
        pieces[r["doc_id"]] += r["length"]
    assert pieces == tokens


def test_run_equals_the_stages(spark):
    at = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF_SMALL)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == sorted(map(tuple, at.collect()))


def test_empty_table_and_clashing_columns(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    for schema in (names, names + ", score double, row string, found int, blob_id int, _t1 string, symbols int, bands int"):
        at = spark.createDataFrame([], schema)
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF_SMALL)
            assert at.count() == 0
    at = spark.createDataFrame([(1, "the words of a text stay here", "en", "s", 29, 0.5, "r", 1, 2, "t", 3, 4)], schema)
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF_SMALL)
        assert at.columns == columns and [tuple(r)[5:] for r in at.collect()] == [(0.5, "r", 1, 2, "t", 3, 4)], name
