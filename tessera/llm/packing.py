"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are integers up to the capacity, so the histogram of lengths holds all that the plan depends on and has at
most `capacity` entries at any size of the corpus. The plan is made on the driver from that histogram alone:

1. Large lengths, in descending order, are cut into groups of equal cardinality and rounded up to their group's
   largest. Few sizes remain; configurations for them are found by column generation (a linear program whose pricing
   step is a knapsack) and their copies are rounded down.
2. The actual pieces take the places of the rounded ones, longest first, which frees room.
3. What is left over, and all small pieces, go best-fit, in descending order, into the fullest sequence that has room.

Sequences that hold the same lengths are handled as one run, so each step costs by runs and not by pieces. The plan
maps (length, rank within that length) to a place; Spark numbers the pieces within each length and looks places up.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_bytes import byte_characters
from tessera.llm.common import bounded_batches, bucket_count, gapless_rank, stage, table

CAPACITY = 4096
END_ID = 1
#: Schemes that are tried: lengths over capacity / part are large, and they make so many groups. The plan with the
#: fewest sequences is taken.
SCHEMES = ((3, 48), (3, 16), (4, 16))
#: Entries of a worker's cache of tokenised words; beyond it the cache starts anew. It changes speed only.
CACHE_ENTRIES = 500_000
CACHED_LENGTH = 64
#: Characters of the texts that are done word by word at a time.
TOGETHER = 1 << 20


#: The steps of a tokenizer that never merges over white space, which it drops, and that has lower case.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _is_word_by_word(spec: dict) -> bool:
    """Whether a tokenizer's file asks for just those steps, so that a text's ids are those of its words."""
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first = (splitter.get("pretokenizers") or [{}])[0]
    others = [p.get("type") for p in (splitter.get("pretokenizers") or [])[1:]]
    return (
        normalizer.get("normalizers") == WORD_NORMALIZERS
        and first.get("pattern") == {"Regex": WORD_PATTERN}
        and (first.get("behavior"), first.get("invert"), others) == ("Removed", True, ["ByteLevel"])
        and not splitter["pretokenizers"][1].get("add_prefix_space")
        and not any(t.get("normalized") for t in spec.get("added_tokens") or [])
        and spec.get("post_processor") is None
    )


class WordTokens:
    """Ids of a text by a tokenizer file, without adding special tokens.

    A text is done word by word, cached, where the file's steps allow that and no added token stands in the text; all
    other texts go to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as lines:
            spec = json.load(lines)
        self._by_words = _is_word_by_word(spec)
        self._added = [t["content"] for t in spec.get("added_tokens") or []]
        self._cache: dict[bytes, bytes] = {}
        self._characters = dict(enumerate(byte_characters()))

    def _learn(self, words: list[bytes]) -> None:
        """Plain words go to the tokenizer's merges directly: its other steps leave them as they are."""
        texts = [w.decode() for w in words]
        others = [(w, t) for w, t in zip(words, texts) if not _is_plain(t)]
        encoded = self._tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)
        self._cache.update((w, np.array(e.ids, "<u4").tobytes()) for (w, _), e in zip(others, encoded))
        merges, characters = self._tokenizer.model.tokenize, self._characters
        for w, t in zip(words, texts):
            if _is_plain(t):
                ids = [token.id for token in merges(w.decode("latin-1").translate(characters))]
                self._cache[w] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        some: list[str] = []
        held = 0
        for text in texts:
            if not self._by_words or any(a in text for a in self._added):
                out += self._encode_by_words(some)
                out.append(np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                some, held = [], 0
                continue
            some.append(text)
            held += len(text)
            if held > TOGETHER:
                out += self._encode_by_words(some)
                some, held = [], 0
        return out + self._encode_by_words(some)

    def _encode_by_words(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = [_folded(t).split() for t in texts]
        words = set().union(*split)
        if len(self._cache) + len(words) > CACHE_ENTRIES:
            self._cache.clear()
        found = self._cache
        missing = list(words.difference(found))
        parts = [_parts(w) for w in missing]
        self._learn(list(set().union(*parts).difference(found)))
        found.update((w, b"".join([found[x] for x in p])) for w, p in zip(missing, parts) if len(p) > 1)
        out = [b"".join([found[w] for w in words]) for words in split]
        for w in missing:
            if len(w) > CACHED_LENGTH:
                del found[w]
        return out


def _folded(text: str) -> bytes:
    """The text's bytes, with A-Z in lower case where that gives the tokenizer nothing else to compose.

    It composes characters before it lower-cases them; a text that is composed already, both ways, comes out the same.
    """
    raw = text.encode()
    low = raw.lower()
    if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low.decode()):
        return low
    return raw


def _is_plain(text: str) -> bool:
    """Letters below U+0250 in lower case: one word to the tokenizer, composed already, with nothing left to fold."""
    return text.isalpha() and max(text) < "\u0250" and text == text.lower()


def _parts(word: bytes) -> tuple[bytes, ...]:
    """The word, cut before punctuation that follows an ASCII letter or digit at its end: no token spans that place."""
    core = word.rstrip(_PUNCTUATION)
    if core and len(core) < len(word) and core[-1:].isalnum():
        return core, word[len(core) :]
    return (word,)


_PUNCTUATION = b".,;:!?%*#$&)"
_PER_WORKER: dict[str, WordTokens] = {}


def tokens_of(tokenizer_path: str) -> WordTokens:
    if tokenizer_path not in _PER_WORKER:
        _PER_WORKER[tokenizer_path] = WordTokens(tokenizer_path)
    return _PER_WORKER[tokenizer_path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids and END_ID, cut every `capacity` ids; `ids` keeps them as bytes."""
    bounded_batches(documents.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, end = tokens_of(tokenizer_path), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch["doc_id"], own.encode([t or "" for t in batch["text"]])):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: 6 if ids else 5])
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if ids else 5])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents.select("doc_id", "text").mapInPandas(cut, PIECES + (", ids binary" if ids else ""))


class Plan:
    """Where the pieces of each length go: runs of (length, first rank, pieces, per sequence, sequence, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sequences = 0
        self._runs: list[tuple[int, int, int, int, int, int]] = []
        self._used: dict[int, int] = defaultdict(int)
        #: Runs of sequences with equal room: room -> list of (first sequence, sequences).
        self._open: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def place(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self._runs.append((length, self._used[length], count, each, sequence, offset))
        self._used[length] += count

    def fresh(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self._open[room].append((sequence, count))

    def _fill(self, length: int, count: int, room: int, sequence: int, sequences: int) -> int:
        """Put pieces into a run of sequences with equal room; returns how many found a place."""
        each, offset = room // length, self.capacity - room
        full = min(sequences, count // each)
        if full:
            self.place(length, full * each, each, sequence, offset)
            self.leave(room - each * length, sequence, full)
        rest = min(count - full * each, each) if full < sequences else 0
        if rest:
            self.place(length, rest, rest, sequence + full, offset)
            self.leave(room - rest * length, sequence + full, 1)
        used = full + (rest > 0)
        self.leave(room, sequence + used, sequences - used)
        return full * each + rest

    def best_fit(self, length: int, count: int) -> None:
        for room in sorted(r for r in self._open if r >= length):
            runs = self._open.pop(room)
            while runs and count:
                sequence, sequences = runs.pop()
                count -= self._fill(length, count, room, sequence, sequences)
            if runs:
                self._open[room].extend(runs)
            if not count:
                return
        if count:
            each = self.capacity // length
            sequences = -(-count // each)
            self._fill(length, count, self.capacity, self.fresh(sequences), sequences)

    def arrays(self) -> dict[str, np.ndarray]:
        runs = np.array(sorted(self._runs), np.int64).reshape(-1, 6)
        return dict(zip(("length", "rank", "count", "each", "sequence", "offset"), runs.T))


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Columns of the cutting-stock linear program with their copies, rounded down.

    Column generation: the basis starts with one size a column; the knapsack for the dual prices gives the column to
    enter, until none is worth more than a sequence.
    """
    n = len(sizes)
    columns = [np.array([capacity // s if i == j else 0 for j in range(n)], float) for i, s in enumerate(sizes)]
    basis = np.array(columns).T
    need = np.array(demand, float)
    for _ in range(40 * n):
        try:
            amounts = np.linalg.solve(basis, need)
            prices = np.linalg.solve(basis.T, np.ones(n))
        except np.linalg.LinAlgError:
            break
        worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):  # unbounded knapsack, one size at a time, by the number of its copies
            if prices[i] <= 1e-12:
                continue
            for start in range(size, capacity + 1, size):
                end = min(start + size, capacity + 1)
                better = worth[start - size : end - size] + prices[i]
                gain = better > worth[start:end] + 1e-12
                worth[start:end][gain] = better[gain]
                pick[start:end][gain] = i
        if worth.max() <= 1 + 1e-7:
            break
        entering, room = np.zeros(n), int(worth.argmax())
        while room > 0 and worth[room] > 0:
            if pick[room] < 0:
                room -= 1
                continue
            entering[pick[room]] += 1
            room -= sizes[pick[room]]
        direction = np.linalg.solve(basis, entering)
        grows = direction > 1e-9
        if not grows.any():
            break
        ratio = np.where(grows, np.maximum(amounts, 0) / np.where(grows, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = entering
    amounts = np.linalg.solve(basis, need)
    return [(tuple(int(x) for x in basis[:, j]), int(amounts[j] + 1e-6)) for j in range(n) if amounts[j] >= 1]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple = SCHEMES) -> Plan:
    """The plan for `histogram` (pieces by length, each 1 to capacity)."""
    return min((_plan(histogram, capacity, *scheme) for scheme in schemes), key=lambda plan: plan.sequences)


def _plan(histogram: dict[int, int], capacity: int, part: int, groups: int) -> Plan:
    plan, left = Plan(capacity), dict(histogram)
    if left.get(capacity):
        plan.place(capacity, left[capacity], 1, plan.fresh(left[capacity]), 0)
        left[capacity] = 0
    large = sorted((x for x in left if x > capacity // part and left[x]), reverse=True)
    total = sum(left[x] for x in large)
    if total:
        # Members of each group in descending order: lists of [length, pieces], cut so that groups have equal counts.
        members: list[list[list[int]]] = []
        bounds = [total * (g + 1) // groups for g in range(groups)]
        seen, group = 0, []
        for length in large:
            rest = left[length]
            while rest:
                while bounds[len(members)] <= seen:
                    members.append(group)
                    group = []
                take = min(rest, bounds[len(members)] - seen)
                group.append([length, take])
                seen, rest = seen + take, rest - take
        members.append(group)
        members = [m for m in members if m]
        merged: list[list[list[int]]] = []
        for m in members:  # groups of one and the same largest length are one size
            if merged and merged[-1][0][0] == m[0][0]:
                merged[-1].extend(m)
            else:
                merged.append(m)
        sizes, demand = [m[0][0] for m in merged], [sum(c for _, c in m) for m in merged]
        for column, copies in configurations(sizes, demand, capacity):
            slots = [i for i, k in enumerate(column) for _ in range(k)]
            while copies:
                taken = []
                for i in slots:
                    while merged[i] and not merged[i][0][1]:
                        merged[i].pop(0)
                heads = {i: column[i] for i in set(slots)}
                if any(not merged[i] for i in heads):
                    break
                # As many copies as can take the same lengths: a slot's head piece run feeds all slots of its size.
                run = min([copies, *(merged[i][0][1] // k for i, k in heads.items())])
                if run == 0:  # a run ends within one sequence: fill one copy piece by piece
                    for i in slots:
                        while merged[i] and not merged[i][0][1]:
                            merged[i].pop(0)
                        if merged[i]:
                            merged[i][0][1] -= 1
                            taken.append(merged[i][0][0])
                    run = 1
                else:
                    for i in slots:
                        merged[i][0][1] -= run
                        taken.append(merged[i][0][0])
                sequence, offset = plan.fresh(run), 0
                for length in taken:
                    plan.place(length, run, 1, sequence, offset)
                    left[length] -= run
                    offset += length
                plan.leave(capacity - offset, sequence, run)
                copies -= run
    for length in sorted(left, reverse=True):
        if left[length]:
            plan.best_fit(length, left[length])
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of `pieces`, plus sequence_id and offset: which sequence holds the piece, and where.

    `pieces` has doc_id, piece and length (1 to capacity) and must give the same rows each time it is read. Offsets in
    a sequence start at 0 without gaps. Repeated rows are packed each on its own; no piece gives no sequence.
    """
    spark = pieces.sparkSession
    bounded_batches(spark)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_packing(histogram, capacity).arrays()
    shared = spark.sparkContext.broadcast(runs)
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece"], "_rank", bucket_count(sum(histogram.values())))

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        keys = own["length"] << 40 | own["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            within = rank - own["rank"][at]
            batch["sequence_id"] = own["sequence"][at] + within // own["each"][at]
            batch["offset"] = own["offset"][at] + within % own["each"][at] * length
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*pieces.columns, "_rank").mapInPandas(looked_up, fields + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of whole documents with their places: see pieces_of, pack_pieces and the module.

    Null and empty texts are END_ID alone. Very long texts are cut every `capacity` ids. Repeated rows, and rows of one
    doc_id with several texts, are packed each on its own; rows without doc_id too. An empty table gives no rows. Only
    doc_id and text are read, whatever else there is. Pieces of equal length may take each other's places.
    """
    return pack_pieces(stage(pieces_of(documents, tokenizer_path, capacity)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
