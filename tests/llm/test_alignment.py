"""Cross-tokenizer alignment against both tokenizers on whole texts, and the laws of the monoid."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tessera.llm import alignment
from tessera.llm.bpe_bytes import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    a_all, b_all = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_all.encode_special_tokens = True
    value = {c: b for b, c in enumerate(byte_characters())}

    def groups(text):
        raw = (" " + (text or "")).encode()
        if not text:
            return []
        a, b = a_all.encode(" " + text, add_special_tokens=False).ids, b_all.encode(text)
        a_bytes = [bytes(value[c] for c in a_all.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_all.id_to_piece(i)[3:5], 16)]) if b_all.is_byte(i) else b_all.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return []

        def ends(tokens):
            at, out = 0, []
            for t in tokens:
                at += len(t)
                out.append(at)
            return out

        a_ends, b_ends, out, low = ends(a_bytes), ends(b_bytes), [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            out.append(([x for x, e in zip(a, a_ends) if low < e <= end], [x for x, e in zip(b, b_ends) if low < e <= end]))
            low = end
        return out

    return groups


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["the", " ", "  ", "\n", "\t", " \n ", "don't", "x's", "<|endoftext|>", "<s>", "</s>", "<0x41>", "naïve", "日本語", "😀", "1234567", " ", "　", "\x00", "\x1c", "á", "…", "===", "réeuxment", "ﬁ", "word", "Word,", "-", "x.", "é, ", "².", "a|b", "end.\n", "ß!", "w)"]
    out = [None, "", " ", "  ", "\n", " a", "a ", "▁", "a ▁ b", "a b", "a" * 300, "ab " * 50, "a\u0085b c", "a \x1c b", "<|endoftext|> <s> </s>"]
    for _ in range(250):
        out.append("".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 40))))
    return out


def test_words_by_themselves_are_tokenised_as_in_the_whole_text(texts, brute):
    own = alignment.Aligner(A, B)
    for text in texts:
        got = own.whole(text)
        assert got.groups == written(brute(text)), text
        assert (got.n_a, got.n_b, got.n_groups) == (sum(len(a) for a, _ in brute(text)), sum(len(b) for _, b in brute(text)), len(brute(text)))
        assert got.pairs.tolist() == [a[-1] << 32 | b[-1] for a, b in brute(text)]


def as_tuple(f):
    return f.head, f.tail, f.closed.groups, f.closed.n_a, f.closed.n_b, f.closed.n_groups, f.closed.pairs.tolist(), f.closed.valid


def test_composition_is_associative_and_independent_of_the_ranges(texts):
    own, rng = alignment.Aligner(A, B), random.Random(8)
    for text in filter(None, texts):
        whole = as_tuple(own.fragment(text))
        for _ in range(3):
            cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))
            parts = [own.fragment(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
            assert as_tuple(functools.reduce(own.compose, parts)) == whole
            assert as_tuple(functools.reduce(lambda right, left: own.compose(left, right), reversed(parts))) == whole
        neutral = own.fragment("")
        assert as_tuple(own.compose(neutral, own.fragment(text))) == as_tuple(own.compose(own.fragment(text), neutral)) == whole


def test_a_full_cache_starts_anew(texts, monkeypatch):
    own = alignment.Aligner(A, B)
    wanted = [own.whole(t).groups for t in texts]
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 3)
    small = alignment.Aligner(A, B)
    assert [small.whole(t).groups for t in texts] == wanted
    assert len(small._newest) <= 6 and len(small._older) <= 6


def test_query_against_whole_texts(spark, texts, brute, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "RANGE", 40)
    monkeypatch.setattr(alignment, "FAN", 3)
    rng = random.Random(4)
    long = [" ".join(rng.choice(["alpha", "beta", "gam\nma", "don't", "x" * 90]) for _ in range(400)) for _ in range(2)]
    rows = [(i, t) for i, t in enumerate([*texts, *long])] + [(30, texts[30]), (None, long[0]), ((1 << 60) + 1, "a b"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    links, each = Counter(), []
    for _, text in rows:
        each.append(brute(text))
        links.update((a[-1], b[-1]) for a, b in each[-1])
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    wanted = []
    for (doc_id, _), own in zip(rows, each):
        pairs = [(a[-1], b[-1]) for a, b in own]
        n_best = sum(links[p] == best[p[1]] for p in pairs)
        digest = hashlib.sha256(written(own).encode()).hexdigest() if own else ""
        n_a, n_b = sum(len(a) for a, _ in own), sum(len(b) for _, b in own)
        wanted.append((doc_id, n_a, n_b, len(own), len(pairs), n_best, sum(links[p] for p in pairs), digest))
    got = alignment.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_empty_table_and_other_columns(spark):
    schema = "doc_id long, text string, row int, block int, pairs int"
    assert alignment.digests(spark.createDataFrame([], schema), A, B).count() == 0
    got = alignment.digests(spark.createDataFrame([(1, "one two", 5, 6, 7)], schema), A, B).collect()
    assert [(r["doc_id"], r["n_groups"], r["n_links"]) for r in got] == [(1, 2, 2)]
