"""The registered queries: SQL where there is some, direct versions elsewhere; and the pipeline."""

import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from compare import compare, connect

import corpus_pipeline
from folioframe.llm import queries  # noqa: F401
from folioframe.llm.registry import ORACLES, QUERIES
from folioframe.llm.token_counts import counter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(llm, name):
    assert compare(QUERIES[name](llm, SF), connect(SF), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op10_packing"}))
def test_query_has_a_row_per_document(llm, name):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    out = QUERIES[name](llm, SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())


def test_counts_equal_whole_texts(llm):
    count = counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = {r["doc_id"]: r for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_token_counts"](llm, SF).collect():
        d = docs[r["doc_id"]]
        h = zlib.crc32(str(r["doc_id"]).encode())
        at = h % (len(d["text"]) + 1)
        text = d["text"][:at] + f" {d['source']}, " + d["text"][at + h % 64 :]
        text = text[h % 16 :] + f"\n{d['lang']}"
        assert (r["tokens_before"], r["tokens_after"], r["chars"], r["text_crc32"]) == (*count([d["text"], text]), len(text), zlib.crc32(text.encode()))


def test_pipeline_stages(llm, odd_docs):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact dedup", "near dedup", "mixing", "packing"]
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(llm, before, SF)
        assert after.columns == docs.columns
        old, new = (Counter((r["doc_id"], r["text"]) for r in df.collect()) for df in (before, after))
        assert set(new) <= set(old)
        if name == "exact dedup":
            plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
            assert sorted(plain(t) for _, t in new) == sorted({plain(t) for _, t in old})
        if name in ("language", "near dedup"):
            assert len(new) >= 0.9 * len(old) and max(new.values()) == 1
        before = after
    pieces = corpus_pipeline.packed(llm, before, SF).collect()
    words = sum(len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"])) for r in before.collect())
    assert sum(r["n_tokens"] for r in pieces) == words


def test_pipeline_runs_on_odd_rows(llm, odd_docs):
    docs = odd_docs
    for _, step in corpus_pipeline.STAGES:
        docs = step(llm, docs, SF)
    assert docs.count() > 0


def test_run(llm):
    assert corpus_pipeline.run(llm, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
