"""The operators on small fixtures: brute force, round trips, held-out accuracy, and odd input."""

import base64
import collections
import hashlib
import html
import io
import random
import re
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_bytes, html_wrappers, language_id, line_dedup, media, packing, pii, simhash
from tessera.llm.components import components

tokenizers = pytest.importorskip("public_tokenizers")
WORDS, RANKS = tokenizers.path("word_bpe_49k.json"), tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\n", "a", "Á É 　x\x1c\x85y", "it's DON'T 12,345 😀😀 日本語\x00", "<|endoftext|> &amp;", "word " * 3000, "x" * 20000, "1 " * 9000]


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, ties, an id that comes twice."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "no id", None, None, None), (None, None, None, None, None), (4, "another text", "en", "s", 3)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


# 1: packing


def check_plan(histogram, capacity):
    plan = packing.plan_packing(dict(histogram), capacity)
    runs = plan.arrays()
    held = collections.defaultdict(list)
    for length, count, each, sequence, offset in zip(*(runs[k] for k in ("length", "count", "each", "sequence", "offset"))):
        for i in range(count):
            held[sequence + i // each].append((offset + i % each * length, length))
    assert sorted(n for s in held.values() for _, n in s) == sorted(k for k, v in histogram.items() for _ in range(v))
    assert sorted(held) == list(range(plan.sequences))
    for sequence in held.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= capacity
    return plan.sequences


def test_plans():
    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.choice([10, 50, 200])
        check_plan(collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300))), capacity)
    assert check_plan({60: 50, 40: 50}, 100) == 50
    assert check_plan({100: 7, 1: 3}, 100) == 8
    many = collections.Counter(min(4096, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(20000))
    lower = -(-sum(k * v for k, v in many.items()) // 4096)
    assert check_plan(many, 4096) <= 1.002 * lower + 1


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)  # as it comes
    odd = odd.unionByName(documents(spark, ["a <|endoftext|> b", "<|startoftext|>Tea<|ENDOFTEXT|>", "x<|endoftext|>" * 700], 700))
    rows = packing.pack_documents(odd, WORDS, 1024).collect()
    want = collections.Counter()
    for r in odd.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 1024)):
            part = ids[at : at + 1024]
            want[(r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for sequence in held.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none, WORDS).count() == 0


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A file with other steps is not done word by word: here the normalizer keeps capitals."""
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(WORDS))
    spec["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w"))
    own = Tokenizer.from_file(path)
    texts = ["The TEA is Hot, it's 25 C", "", "plain words here"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokens(path).encode(texts)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in texts] != []
    assert packing.WordTokens(WORDS)._by_words and not packing.WordTokens(path)._by_words


def test_word_cache_restarts(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 3)
    own, fresh = packing.WordTokens(WORDS), packing.WordTokens(WORDS)
    texts = ["one two three four", "five two " + "long" * 40, "six"]
    assert own.encode(texts) + own.encode(texts) == fresh.encode(texts) * 2


# 2: media


def png(width=2):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 28


def test_sniffing(spark):
    assert media.sniff(png()) == [("png", 0, len(png()))]
    assert media.sniff(GIF) == [("gif", 0, len(GIF))] and media.sniff(JPEG) == [("jpeg", 0, len(JPEG))]
    assert media.sniff(BMP[:58]) == [("bmp", 0, 58)]
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken)) == [] and media.sniff(b"BM and GIF89a and RIFF in a text") == []
    mixed = b"head" + png() + b"RIFF" + media.to_wav(b"\1\2\3\4") + JPEG + b"tail"
    rows = [(1, png(), "gif"), (2, mixed, "bin"), (3, b"text", "png"), (4, None, "x"), (5, b"", None)]
    df = media.sniff_media(spark.createDataFrame(rows, "i int, content binary, told string"), "content", "told")
    got = {r.i: (r.media_type, r.corrected, [(e.type, e.offset) for e in r.embedded]) for r in df.collect()}
    assert got[1] == ("png", True, []) and got[3] == (None, True, []) and got[4] == ("x", False, []) and got[5] == (None, False, [])
    assert [t for t, _ in got[2][2]] == ["png", "wav", "jpeg"] and got[2][:2] == ("bin", False)
    carved = {r.carved_type: bytes(r.carved) for r in media.carve_media(df).collect()}
    assert carved == {"png": png(), "wav": media.to_wav(b"\1\2\3\4"), "jpeg": JPEG}


def test_media_inside_media(spark):
    inner = b"....." + png() + b"xx" + GIF
    whole = media.to_wav(inner)
    rows = [(1, whole, "wav", "a"), (2, media.to_wav(whole), "gif", "b"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "_seen int, content binary, _one string, carved string")
    seen = media.sniff_media(df, "content", "_one")
    got = {r["_seen"]: r for r in seen.collect()}
    assert seen.columns == [*df.columns, "media_type", "embedded", "corrected"]
    assert (got[1].media_type, got[1].corrected, got[2].media_type, got[2].corrected) == ("wav", False, "wav", True)
    assert [e.type for e in got[1].embedded] == ["png", "gif"] and [e.type for e in got[2].embedded] == ["wav", "png", "gif"]
    carved = media.carve_media(seen.select("_seen", "content", "embedded", "carved"))
    assert carved.columns == ["_seen", "content", "embedded", "carved_type", "carved"]
    pieces = {(r["_seen"], r.carved_type): bytes(r.carved) for r in carved.collect()}
    assert pieces == {(i, t): d for i in (1, 2) for t, d in (("png", png()), ("gif", GIF))} | {(2, "wav"): whole}
    assert media.carve_media(seen.limit(0)).count() == 0


def test_sniffing_against_brute_force():
    """Every offset at which a validator confirms a medium, whatever stands around it."""
    rng = random.Random(3)
    parts = [png(), GIF, JPEG, BMP[:58], media.to_wav(b"ab" * 9), b"BM", b"RIFF", b"\xff\xd8\xff", b"GIF89a", bytes(rng.randbytes(40)), media.to_wav(png())]
    for _ in range(60):
        data = b"".join(rng.choices(parts, k=rng.randint(0, 8)))
        if rng.random() < 0.5 and data:
            at = rng.randrange(len(data))
            data = data[:at] + rng.randbytes(2) + data[at + 2 :]
        want = [(v[0], at, v[1]) for at in range(len(data)) for name, magic in media.SIGNATURES.items() if data.startswith(magic, at) and (v := media.VALIDATORS[name](data, at))]
        assert media.sniff(data) == sorted(want, key=lambda x: (x[1], -x[2]))


def test_stored_text(spark, odd, none):
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None and r.doc_id != 4}
    stored = media.store_text(odd)
    for r in stored.collect():
        with wave.open(io.BytesIO(bytes(r.media))) as w:  # another reader gives the same bytes
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            if r.doc_id in texts:
                assert w.readframes(w.getnframes()) == media.pad(texts[r.doc_id].encode())
    assert stored.columns == ["doc_id", "n_bytes", "media", "declared"] == media.store_text(odd.withColumn("media", F.lit(1))).columns
    rows = media.read_media(stored).collect()
    assert all(r.media_type == "wav" and r.corrected for r in rows)
    assert len(rows) == odd.count() and media.read_media(media.store_text(none)).count() == 0
    for r in rows:
        if r.doc_id in texts:
            payload = media.pad(texts[r.doc_id].encode())
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest())
            assert r.payload_bytes % 192 == 0 and r.payload_bytes > 0 and r.tail_crc32 == zlib.crc32(payload[-16:])
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


# 3: main text

PAGE = (
    "<html><head><title>T</title></head><body><div class='menu'><a href=/>Home</a></div><div id=cookie>We use cookies</div>"
    "<div class='content'><h1>{0}</h1><p>One {1} long text<p>two &lt;b&gt; {1}&nbsp; x<br>y</div><div class='comments'><p>nice</p></div>"
    "<form>Search <input></form><div>All rights reserved</div></body>"
)


def test_main_text(spark):
    pages = [(i, f"http://h.com/{i}", PAGE.format(f"Title {i}", i)) for i in range(5)]
    pages += [(10, "http://one.com/", PAGE.format("Single", "z")), (11, None, None), (12, "x", ""), (13, "http://p.com", "plain  text"), (14, "u", "<div>" * 5000 + "deep")]
    pages += [(15, "http://a.com", "<nav>n</nav><article><header><h1>H</h1></header><p>a<aside>side</aside><ul><li>1<li>2</ul><script>'<p>no'</script></article><p>out</p><footer>f</footer>")]
    pages += [(16, "http://a.com", "<article><p>b</p><article class=comment>c</article></article> <!-- x --> <article")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_wrappers.main_text(df).collect()}
    for i in range(5):
        assert got[i][0] == f"Title {i}\nOne {i} long text\ntwo <b> {i} x y"
    assert got[10][0].startswith("Single\nOne z long text") and got[11] == ("", 0) and got[12] == ("", 0)
    assert got[13] == ("plain text", 10) and got[14] == ("deep", 4)
    assert got[15] == ("H\na\n1\n2", 7) and got[16] == ("b", 1)
    assert html_wrappers.main_text(df.limit(0)).count() == 0


def test_wrappers_fold_repeats():
    a, _ = html_wrappers.expression("<ul><li>1<li>2<li>3</ul>")
    b, blocks = html_wrappers.expression("<ul><li>1<li>2</ul>")
    assert a == b and [s for s, _, _ in blocks] == [0, 0]
    c, blocks = html_wrappers.expression("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>")
    assert [s for s, _, _ in blocks] == [0, 1, 0, 1]


# 4: near-duplicates


def brute_components(codes):
    codes, parent = sorted(codes), {}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for c in codes:
        parent[c] = c
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {c: root(c) for c in codes}


def brute_code(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_codes(n):
    rng = random.Random(3)
    base, codes = [rng.getrandbits(64) for _ in range(40)], {0, (1 << 64) - 1, 1 << 63}
    while len(codes) < n:
        code = base[0] if rng.random() < 0.5 else rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            code ^= 1 << rng.randint(0, 63)
        codes.add(code)
    return codes


def test_index_search_finds_all_pairs():
    codes = np.array(sorted(near_codes(700), key=lambda c: gray(c)), np.uint64)
    q, n = simhash.search(codes, codes)
    want = {(i, j) for i, a in enumerate(codes) for j, b in enumerate(codes) if int(a ^ b).bit_count() <= 2}
    assert set(zip(q.tolist(), n.tolist())) == want


def gray(code):
    for shift in (1, 2, 4, 8, 16, 32):
        code ^= code >> shift
    return code


@pytest.mark.parametrize("limit", [5, 768])
def test_linked_codes(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash.upper_nodes, "__defaults__", (limit,))
    codes = near_codes(400)
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "code long")
    got = {r.node: r.component for r in components(simhash.linked_codes(df)).collect()}
    groups = collections.defaultdict(list)
    for c, r in brute_components(codes).items():
        groups[r].append(simhash._signed(c))
    assert got == {c: min(g) for g in groups.values() if len(g) > 1 for c in g}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(5, 5), (40, 41), (41, 40), (None, 3), (50, None)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40}
    assert components(links.limit(0)).count() == 0


def test_near_duplicates(spark, odd, none):
    base = "the quick brown fox jumps over the lazy dog again and again until night falls " * 40
    texts = [base, base.upper(), base + "end", "entirely different words here " * 30, base]
    df = documents(spark, texts, 100).unionByName(odd)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    text_of = collections.defaultdict(set)
    for r in df.collect():
        text_of[r.doc_id].add(f"{brute_code(r.text or ''):016x}")
    assert all(r.fingerprint in text_of[r.doc_id] for r in rows)
    parents, least = brute_components({int(r.fingerprint, 16) for r in rows}), {}
    for r in rows:
        if r.doc_id is not None:
            c = parents[int(r.fingerprint, 16)]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(parents[int(r.fingerprint, 16)]) for r in rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len({parents[int(r.fingerprint, 16)] for r in rows})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# 5: byte-level BPE


def test_byte_bpe(spark, odd, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe_bytes.decode_documents(bpe_bytes.encode_documents(odd.withColumn("ids", F.lit("clash")), RANKS, tokenizers.PATTERN), RANKS, tokenizers.PATTERN).collect()
    for r in rows:
        want = library.encode_ordinary(r.text or "")
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want)
        assert bytes(r.decoded).decode() == (r.text or "")
    digests = bpe_bytes.digests(odd, RANKS, tokenizers.PATTERN).collect()
    assert sorted(r.ids_sha256 for r in digests) == sorted(hashlib.sha256(bytes(r.ids)).hexdigest() for r in rows)
    assert bpe_bytes.digests(none, RANKS, tokenizers.PATTERN).count() == 0


# 9: language


def test_language(spark, none):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "eit", "ber"], "cc": ["eau", "ille", "oux", "ré"]}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    rows += [(900, None, "aa", None, None), (901, "123 !!", None, None, None), (902, "", "bb", None, None), (None, "kato mira", None, None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = language_id.identify(df).withColumn("held", language_id.held_out()).collect()
    tested = [r for r in got if r.held and r.doc_id < 300]
    assert len(tested) > 60 and sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" for i in (900, 901, 902)) and by_id[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(none).count() == 0
    unlabelled = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("languages", [1, 2, 4, 30])
def test_foreign_texts_are_rejected_whatever_is_learnt(languages):
    rng = random.Random(languages)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñßабвгдежзиклмнопрстуфхцчшщыья漢字語日本人大学生先年月"

    def text(seed, n):
        own = random.Random(seed)
        syllables = ["".join(own.choices(letters, k=own.randint(2, 3))) for _ in range(40)]
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))

    rows = [(text(k, rng.randint(20, 90)), f"l{k}") for k in range(languages) for _ in range(40)]
    model = language_id.fit([t for t, _ in rows], [x for _, x in rows])

    def judged(texts):
        best, score, familiar = language_id.judge(model, texts)
        assert (score >= 0).all() and (score <= 1).all()
        return [model.languages[b] for b in best], familiar < language_id.LEAST_FAMILIAR

    own = [(text(k, 40), f"l{k}") for k in range(languages) for _ in range(5)]
    names, gone = judged([t for t, _ in own])
    assert names == [x for _, x in own] and not gone.any()
    _, gone = judged([text(1000 + k, 40) for k in range(40)] + ["ωψχ φυτσρ " * 30])
    assert gone.all()


def test_kernel_against_brute_force(monkeypatch):
    """Presence kernel over whole texts of any script and length, with long texts in pieces."""
    monkeypatch.setattr(language_id, "PIECE", 50)
    rng = random.Random(12)
    letters = "abcÉ ß日本語学漢字Жω😀\x00"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(60)] + ["", "x" * 3000]

    def sets(t):
        t = t.lower()
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if "\x00" not in t[i : i + n]}

    model = language_id.fit(texts[:40], [f"l{i % 3}" for i in range(40)])
    chosen = [i for name in model.languages for i in range(40) if f"l{i % 3}" == name]
    known = set().union(*(sets(texts[i]) for i in chosen))
    values = language_id.kernel(model, texts)
    for i, t in enumerate(texts):
        own = sets(t) & known
        want = [len(own & sets(texts[j])) / (max(1, len(own)) * len(sets(texts[j]))) ** 0.5 for j in chosen]
        assert np.allclose(values[i], want, atol=1e-5)


# 10: personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "card":
            total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return True

    found = {k: [m for m in re.finditer(p, text) if valid(k, m.group())] for k, p in BASE.items()}
    return {k: len(v) for k, v in found.items()}, ",".join(f"{k}:{m.start()}:{m.end()}" for k, v in found.items() for m in v)


def test_base_spans(spark, odd, none):
    rng = random.Random(10)
    texts = ["😀é a@b.co, 1.2.3.4.5.6.7.8 000255.1.1.256", "a@b.c_d@e.f x@y@z.com a@ @b. +", "4111 1111-1111 1111 +1 (988) 555-2485-- x", "1" * 30000, "a.b@" * 5000 + "c.d", "9.9.9.9 " * 3000]
    texts += ["".join(rng.choice("a14.@+- (") for _ in range(rng.randint(0, 70))) for _ in range(1500)]
    df = documents(spark, texts, 100).unionByName(odd)
    text_of = collections.defaultdict(set)
    for r in df.collect():
        text_of[r.doc_id].add(brute_spans(r.text or "")[1])
    rows = pii.report(df).collect()
    assert len(rows) == df.count() and pii.report(none).count() == 0
    for r in rows:
        assert r.spans in text_of[r.doc_id] and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == (r.spans.count(",") + 1 if r.spans else 0)


def disclosing(spark):
    rng = random.Random(11)
    fill = lambda: " ".join(f"w{rng.randint(0, 400)}" for _ in range(8))
    rows = [(i, f"{fill()} Zorgblat mail joe@example.org {fill()}") for i in range(6)]
    rows += [(10 + i, f"{fill()} mail {fill()}") for i in range(200)] + [(500, "of ZORGBLAT again"), (501, "Zorgblatter")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    rows = {r.doc_id: r.spans for r in pii.report(disclosing(spark)).collect()}
    assert rows[500] == "term:3:11" and rows[501] == ""
    assert all("email:" in rows[i] and rows[i].count("term:") == 1 for i in range(6))
    assert all(rows[10 + i] == "" for i in range(200))


def brute_terms(texts):
    """Disclosing terms by plain counting over all texts."""
    word, contexts = re.compile(r"[^\W_]+"), {}
    for text in dict.fromkeys(texts):
        for kind in BASE:
            matches = list(re.finditer(BASE[kind], text))
            for n, m in enumerate(matches):
                if not any(f"{kind}:{m.start()}:{m.end()}" == s for s in brute_spans(text)[1].split(",")):
                    continue
                left = text[matches[n - 1].end() if n else 0 : m.start()]
                right = text[m.end() : matches[n + 1].start() if n + 1 < len(matches) else len(text)]
                size = pii.WINDOW_CHARACTERS
                left = [w.group() for w in word.finditer(left) if w.start() > len(left) - size - 1 or len(left) <= size]
                right = [w.group() for w in word.finditer(right) if w.end() <= size or len(right) <= size]
                near = [w.lower() for w in [*left[::-1][:6], *right[:6]]]
                value = m.group().lower()
                entities = [f"{kind}:{value}", kind]
                if kind == "email":
                    owner = re.sub("[^a-z]+", " ", value.split("@")[0]).strip()
                    entities += ["at:" + value.split("@")[-1], *(["of:" + owner] if owner else [])]
                for entity in entities:
                    contexts.setdefault((entity, tuple(near)), set(near))
    entities = collections.Counter(e for e, _ in contexts)
    pairs = collections.Counter((e, w) for (e, _), near in contexts.items() for w in near)
    held = collections.Counter(w for t in dict.fromkeys(texts) for w in {x.lower() for x in word.findall(t)})
    out = set()
    for (entity, term), n in pairs.items():
        if n < 3 or entities[entity] < 3:
            continue
        posterior = min(1.0, n / held[term])
        if posterior >= 0.5 and np.log2(posterior / (entities[entity] / len(texts))) >= 4:
            out.add(term)
    return out


def test_terms_against_brute_force(spark):
    rng = random.Random(21)
    texts = []
    for i in range(400):
        entity = rng.choice(["ann@ex.org", "bob@ex.org", "10.0.0.7", "+1 988 555 2485"])
        secret = {"ann@ex.org": "marlow", "bob@ex.org": "quillby", "10.0.0.7": "basement", "+1 988 555 2485": "carousel"}[entity]
        fill = lambda n: " ".join(rng.choice(["x" * 170, *[f"w{k}" for k in range(60)]]) if rng.random() < 0.05 else f"w{rng.randint(0, 60)}" for _ in range(n))
        here = rng.random() < 0.2
        parts = [fill(rng.randint(1, 9)), secret if rng.random() < (0.8 if here else 0.02) else "", entity if here else "", fill(rng.randint(1, 9))]
        texts.append(" ".join(p for p in parts if p) if rng.random() < 0.9 else rng.choice(texts or ["a"]))
    want = brute_terms(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term:")] for r in pii.report(df).collect()}
    found = {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])].lower() for i, x in spans.items() for s in x}
    assert found == want and len(want) >= 3
    for i, text in enumerate(texts):  # each place of a term, outside of base spans, is a span
        places = [m for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in want]
        assert len(spans[i]) == len(places)


def test_terms_that_disclose_a_kind_are_generalised(spark):
    """Values that never repeat: cards, phones, addresses of one domain and of one owner, each with a word of its own."""
    rng = random.Random(31)
    fill = lambda: " ".join(f"w{rng.randint(0, 900)}" for _ in range(6))
    made = {
        "swiftpay": lambda i: f"+1 ({i + 100}) 555-{i + 1000}",
        "guildhall": lambda i: f"{rng.choice('abcdef')}{i}@guild.example.org",
        "marlowe": lambda i: f"kit.marlowe{i}@h{i}.example.org",
    }
    rows, place = [], {}
    for word, value in made.items():
        for i in range(12):
            place[len(rows)] = word
            rows.append(f"{fill()} {word} {value(i)} {fill()}")
    rows += [fill() for _ in range(900)] + ["of Swiftpay, guildhall and MARLOWE"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    caught = sum(f"term:{rows[i].index(w)}:{rows[i].index(w) + len(w)}" in spans[i].split(",") for i, w in place.items())
    assert caught == len(place) == 36
    assert sum("term:" in spans[i] for i in range(36, 936)) == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[936] == "of [PHONE TERM], [EMAIL TERM] and [TERM]"
    levels = {(r.term, r.entity) for r in pii.disclosing_terms(df, pii.with_base(df).withColumn("text_hash", F.xxhash64("text"))).collect()}
    assert ("swiftpay", "phone") in levels and ("guildhall", "at:guild.example.org") in levels and ("marlowe", "of:kit marlowe") in levels


def test_sanitised_text(spark, odd):
    clean = {r.doc_id: r.text for r in pii.sanitise(disclosing(spark)).collect()}
    assert clean[500] == "of [TERM] again" and "[TERM] mail [EMAIL] w" in clean[0] and "joe@" not in clean[0]
    kept = pii.sanitise(odd)
    assert kept.columns == odd.columns and sorted(str(r.text) for r in kept.collect()) == sorted(str(r.text) for r in odd.collect())
    one = pii.sanitise(documents(spark, ["a@1.2.3.4 and 4111111111111111"])).first()
    assert one.text == "[EMAIL] and [CARD]" and one.n_chars == 18


def test_entities_of_html():
    assert html_wrappers.parse("<p>&amp;am &copy;")[1][0][1] == html.unescape("&amp;am &copy;")


def test_columns_of_any_name_come_through(spark):
    names = ["removed", "_id", "_maybe", "_p", "_chunks", "terms", "_m", "_hash", "a.b", "score", "kept", "_lines", "term", "removed_chunks", "code", "component"]
    df = documents(spark, ["one text here\nand there", "one text here\nand there", "mail a@b.co now"])
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(f"v{i}"))
    for function, gone in ((line_dedup.dedup_lines, {"removed_chunks"}), (simhash.keep_one, set()), (pii.sanitise, set()), (language_id.identify, {"score"})):
        out = function(df)
        assert [c for c in out.columns if c in df.columns and c not in gone] == [c for c in df.columns if c not in gone]
        row = out.first().asDict()
        assert all(row[name] == f"v{i}" for i, name in enumerate(names) if name not in gone)
