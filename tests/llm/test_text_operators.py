"""BPE codec, token counts, secret scans and exact dedup against the plain forms."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from ripplegraph.llm import bpe, exact_dedup, secret_scan, token_counts
from ripplegraph.llm.queries import queries

from .conftest import SMALL

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def plain_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library_and_round_trips(odd_docs, small_docs):
    enc = plain_encoding()
    for docs in (odd_docs, small_docs):
        texts = Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
        rows = bpe.round_trip(docs, RANKS, P.PATTERN).collect()
        assert len(rows) == sum(texts.values())
        of = dict(texts.keys())
        for r in rows:
            assert r.ids == enc.encode_ordinary(of[r.doc_id])
            assert bytes(r.decoded) == of[r.doc_id].encode()


@pytest.mark.parametrize("text", [" " * 100_000, "a " * 50_000, "a" * 40_000 + " " * 70_000 + "\nb" * 40_000, "　" * 40_000 + " x", "7" * 100_000])
def test_codec_cuts_only_at_safe_places(text):
    c, enc = bpe.Codec(RANKS, P.PATTERN), plain_encoding()
    assert c.encode(text) == enc.encode_ordinary(text)
    assert c.decode(c.encode(text)) == text.encode()


def test_codec_survives_what_overflows_the_matcher():
    c = bpe.Codec(RANKS, P.PATTERN)
    for text in (" " * 3_000_000, "\n" * 3_000_000 + "x", "a" * 1_000_000):
        assert c.decode(c.encode(text)) == text.encode()


def test_decode_alone(spark):
    df = spark.createDataFrame([(1, [0, 1, 255]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, RANKS, P.PATTERN).collect()}
    enc = plain_encoding()
    assert got == {1: enc.decode_bytes([0, 1, 255]), 2: b"", 3: b""}


def test_token_counts_equal_library(spark, odd_docs, small_docs):
    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    cache = token_counts.DigestCache(spark)
    for docs in (odd_docs, small_docs, odd_docs):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path, cache).collect())
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            t = r.text or ""
            want[(r.doc_id, len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids))] += 1
        assert got == want
    stored = cache.counts(token_counts.tokenizer_version(path))
    assert stored.count() == stored.select("content").distinct().count()


def test_token_counts_of_whole_text_tokenizers(spark, small_docs):
    import sentencepiece

    docs = small_docs.limit(20)
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, token_counts.DigestCache(spark)).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}


def plain_entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def plain_base(text: str) -> list[str]:
    found = []
    key = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate([("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)]):
        found += [(m.start(), k + 1, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x[2] for x in sorted(found)]


def test_secret_scan(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        of = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        rows = secret_scan.scan(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "entropy"] == plain_base(of[r.doc_id])
            assert r.spans == sorted(r.spans, key=lambda s: (s.start, secret_scan.KINDS.index(s.kind)))
    assert any(s.kind == "entropy" for r in secret_scan.scan(odd_docs).collect() for s in r.spans)


def test_entropy_windows_equal_recount():
    run = "q8Xv2LmN9pRt4KwZ7sYb3JcHd6aaaaaaaaaaaaaaaaaaaaaaaaaaq8Xv2LmN9pRt4KwZ7sYb3"
    w = secret_scan.WINDOW
    hit = set()
    for i in range(len(run) - w + 1):
        if plain_entropy(run[i : i + w]) >= 3.8 - 1e-9:
            hit |= set(range(i, i + w))
    assert {i for a, b in secret_scan.windows(run, 3.8) for i in range(a, b)} == hit
    # Windows that overlap a listed string are out, those beside it are not.
    assert secret_scan.entropy_spans("EXAMPLEq8Xv2LmN9pRt4KwZ7s") == []
    assert secret_scan.entropy_spans("key=EXAMPLEq8Xv2LmN9pRt4KwZ7sYb3Jc") == [(11, 34)]
    assert secret_scan.entropy_spans("q8Xv2LmN9pRt4KwZ7sYb3JcHd6wwwq8Xv2LmN9pRt4KwZ7sYb3JcHd6") == [(0, 26), (29, 55)]


def test_secret_query_equals_brute_force(spark, small_docs):
    rows = {r.doc_id: r for r in queries()["op5_secret_scan"](spark, SMALL).collect()}
    for d in small_docs.collect():
        base, r = plain_base(d.text or ""), rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == base
    assert len(rows) == small_docs.count()


def test_bpe_query_equals_library(spark, small_docs):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    whole = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in queries()["op1_bpe_codec"](spark, SMALL).collect()}
    for d in small_docs.collect():
        ids, r = whole.encode_ordinary(d.text or ""), rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_token_query_equals_library(spark, small_docs):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op6_token_counts"](spark, SMALL).collect()}
    want = {}
    for d in small_docs.collect():
        n = len(whole.encode(d.text or "", add_special_tokens=False).ids)
        want[d.doc_id] = (len((d.text or "").encode()), n, n > 512)
    assert rows == want


def test_token_counts_of_words_that_differ(spark):
    import pyarrow as pa

    path = P.path("byte_bpe_50k.json")
    whole, counter = Tokenizer.from_file(path), token_counts.TokenCounter(path)
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    words = ["".join(c[b] for b in bits[:n]) for n in (512, 1024, 2048) for c in ("ab", "ba")]
    assert counter.count(pa.array(words)).tolist() == [len(whole.encode(w, add_special_tokens=False).ids) for w in words]


def test_a_second_run_encodes_nothing(spark, small_docs, monkeypatch):
    path, cache = P.path("byte_bpe_50k.json"), token_counts.DigestCache(spark)
    first = token_counts.count_tokens(small_docs, path, cache).collect()
    encoded = []
    real = token_counts.stored
    monkeypatch.setattr(token_counts, "stored", lambda df, name: (out := real(df, name), encoded.append(out.count()) if name == "encoded" else None)[0])
    again = token_counts.count_tokens(small_docs, path, token_counts.DigestCache(spark, cache.path))
    assert sorted(again.collect()) == sorted(first) and encoded == [0]
    # Two runs that appended the same digest leave two rows; readers take one.
    version = token_counts.tokenizer_version(path)
    cache.append(cache.counts(version).limit(5), version)
    assert sorted(token_counts.count_tokens(small_docs, path, cache).collect()) == sorted(first)


def test_exact_dedup(spark, odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")) for r in docs.select("doc_id", "text").collect()]
        groups: dict[str, list] = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        got = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark)).collect()
        first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == Counter((i, first[t], len(groups[t]), hashlib.sha256(t.encode()).digest()) for i, t in rows)
        assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_against_stored_index(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    one = spark.createDataFrame([(5, "a  b"), (6, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "d")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.deduplicate(one, index).collect() if r.kept} == {5, 6}
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(two, index).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert index.read().count() == 3


def test_empty_tables(spark, no_docs):
    assert bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0
    assert secret_scan.scan(no_docs).count() == 0
    assert token_counts.count_tokens(no_docs, P.path("byte_bpe_50k.json"), token_counts.DigestCache(spark)).count() == 0
    assert exact_dedup.deduplicate(no_docs, exact_dedup.DigestIndex(spark)).count() == 0


@pytest.mark.parametrize("name", ["op1_bpe_codec", "op5_secret_scan", "op6_token_counts", "op10_exact_dedup"])
def test_query_has_a_row_for_each_document(spark, small_docs, name):
    assert queries()[name](spark, SMALL).select("doc_id").distinct().count() == small_docs.count()
