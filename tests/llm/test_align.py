"""Lockstep merging against byte sets, and the corpus figures against plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nearwell.llm import align
from nearwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  two  gaps \n\n end ", "it's <|endoftext|> <s> <0x41>", "a▁b", "日本語 и ещё",
       "é" * 40, "x\0y", "﻿mark", "12 345,678", " ".join(f"w{i}" for i in range(3000)),
       "日本" * 700, "tab\tand\rreturn\x0b\x0c", "Má ﬁ ½ 𝒳 👍🏽", "a" * 5000]


def plain(texts):
    """Per text (a_ids, b_ids, links, groups) by comparing byte ranges."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = {c: b for b, c in _byte_chars().items()}
    out = []
    for text in texts:
        none = ([], [], [], [])
        if not text:
            out.append(none)
            continue
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = piece.encode(text)
        av = [bytes(chars[c] for c in tok.id_to_token(i)) for i in a]
        bv = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i)
              else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(av) == b"".join(bv) == (" " + text).encode():
            out.append(none)
            continue
        ae, be = np.cumsum([len(v) for v in av]), np.cumsum([len(v) for v in bv])
        both = sorted(set(ae.tolist()) & set(be.tolist()))
        groups = [(int(np.searchsorted(ae, e)) + 1, int(np.searchsorted(be, e)) + 1) for e in both]
        links, j = [], 0
        for i in range(len(a)):
            lo = ae[i] - len(av[i])
            j = int(np.searchsorted(be, lo, "right"))
            while j < len(b) and be[j] - len(bv[j]) < ae[i]:
                links.append((i, j))
                j += 1
        out.append((a, b, links, groups))
    return out


def _byte_chars():
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 600))
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


def plain_summaries(texts):
    rows = plain(texts)
    docs = Counter(p for a, b, links, _ in rows for p in {(a[i], b[j]) for i, j in links})
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, links, groups in rows:
        spans = zip([(0, 0), *groups], groups)
        text = ";".join(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}"
                        for (i, j), (k, m) in spans)
        counts = [docs[a[i], b[j]] for i, j in links]
        out.append((len(a), len(b), len(groups), len(links),
                    sum(n == best[a[i]] for n, (i, _) in zip(counts, links)), sum(counts),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_merge(lane):
    rng = np.random.default_rng(lane)
    for _ in range(30):
        sizes = rng.integers(0, 60, 6)
        ends = [[np.unique(np.append(rng.integers(1, n + 1, n // k), n)) if n else np.empty(0, int)
                 for n in sizes] for k in (2, 3)]
        base = np.cumsum(sizes) - sizes
        a_end, b_end = (np.concatenate([e + o for e, o in zip(x, base)]).astype(int) for x in ends)
        a_bounds, b_bounds = (np.concatenate(([0], np.cumsum([len(e) for e in x]))) for x in ends)
        got = align.merge(a_end, b_end, a_bounds, b_bounds, lane)
        a_start, b_start = (np.append(0, e[:-1])[:len(e)] for e in (a_end, b_end))
        want = [(i, j) for i in range(len(a_end)) for j in range(len(b_end))
                if a_start[i] < b_end[j] and b_start[j] < a_end[i]]
        assert list(zip(got[0].tolist(), got[1].tolist())) == want
        both = np.intersect1d(a_end, b_end)
        assert a_end[got[2]].tolist() == b_end[got[3]].tolist() == both.tolist()


def test_piece_units_match_whole_texts(texts):
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    own = align.PieceTokens(B)
    some = [t for t in [*ODD, *texts.values()] if t]
    ids, bounds = own.encode(pa.array([" " + t for t in some]))
    assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == piece.encode(some)


def test_alignments(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in align.alignments(df, A, B).collect()}
    for i, want in enumerate(plain(ODD)):
        r = rows[i]
        got = (r["a_ids"], r["b_ids"], [tuple(x) for x in r["links"]], [tuple(x) for x in r["groups"]])
        assert got == want, ODD[i]


def test_query(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_cross_tokenizer_alignment"](spark, SF).collect()}
    assert got == dict(zip(texts, plain_summaries(texts.values())))


def test_odd_documents(spark, odd_documents, no_documents, monkeypatch):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)] * 2, "doc_id long, text string")
    both = odd_documents.unionByName(extra, allowMissingColumns=True).repartition(3)
    rows = both.select("doc_id", "text").collect()
    got = sorted(tuple(r)[1:] for r in align.summaries(both, A, B).collect())
    assert got == sorted(plain_summaries([r["text"] for r in rows]))
    assert align.summaries(no_documents, A, B).count() == 0
    assert align.link_counts(no_documents, A, B).count() == 0
