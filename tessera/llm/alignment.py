"""Alignment of two tokenizers over the same bytes, by an associative monoid of fragments.

A text stands for its bytes after a space. Between some neighbours both tokenizers end a token wherever they stand: before a
single blank or line feed between two characters that are no white space, and between a letter and a mark such as a comma.
A's pattern matches nothing across these, and of B's pieces none holds them side by side, which is looked up in its
vocabulary. Such places are cuts; what lies between two cuts is tokenised by itself, once for each distinct part that a
worker meets, and its groups are closed.

A byte range of a text is a Fragment: an open head before its first cut, closed groups, an open tail after its last cut. Two
neighbours compose: the tail of the one and the head of the other are joined, cut anew and closed. Composition is
associative, so a very long text's fragments, made by many tasks, are reduced as a tree, in any grouping.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe_bytes import byte_characters
from tessera.llm.common import bounded_batches, release, stage, table

#: Code points of a byte range; longer texts are dealt out in ranges. Fragments that one step of the tree composes.
RANGE, FAN = 1 << 16, 16
#: Entries of each of the two generations of a worker's cache of parts, and the longest part in it; they change speed only.
CACHE_ENTRIES, CACHED_LENGTH = 200_000, 64
#: Letters after which, and marks before which, a text may be cut, if no piece of B joins them.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ",.;:!?*$&#%|)"
NONE: tuple[str, ...] = ()


@dataclass
class Closed:
    """Groups in order: numbers of tokens and of groups, their text, and the linked pairs (A id << 32 | B id)."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: False where the bytes of tokens differ from the text's.
    valid: bool = True

    def then(self, *others: Closed) -> Closed:
        all_ = [self, *others]
        return Closed(
            sum(c.n_a for c in all_),
            sum(c.n_b for c in all_),
            sum(c.n_groups for c in all_),
            ";".join(c.groups for c in all_ if c.groups),
            np.concatenate([c.pairs for c in all_]),
            all(c.valid for c in all_),
        )


@dataclass
class Fragment:
    """A part of a text. Without a tail it holds no cut, and all of it is head."""

    head: str
    closed: Closed = field(default_factory=Closed)
    tail: str | None = None


class Aligner:
    """Two tokenizers, and the groups of words."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self._a = tokenizers.Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = [b""] * self._a.get_vocab_size()
        for token, i in self._a.get_vocab().items():
            self.a_bytes[i] = bytes(value[c] for c in token)
        pieces = [(self._b.id_to_piece(i), self._b.is_byte(i)) for i in range(len(self._b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces]
        plain = [p.replace("▁", " ") for p, raw in pieces if not raw]
        self._newest: dict[str, tuple] = {}
        self._older: dict[str, tuple] = {}
        cuts = []
        if not any(re.search("[^ ] ", p) for p in plain):
            feed = "" if any("\n" in p for p in plain) else "\n"
            cuts.append(rf"(?<=\S)(?=[ {feed}]\S)")
            # A part that begins with neither is tokenised after a line feed, which B joins with nothing.
            apart = "".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in plain))
            if feed and apart:
                cuts.append(f"(?<=[{LETTERS}])(?=[{re.escape(apart)}])")
        self.cut = re.compile("|".join(cuts) or r"(?!)").split
        self._a_text, self._b_text = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]

    def _groups(self, part: str, a: list[int], b: list[int]) -> tuple:
        """(tokens of A, of B, groups, text, pairs, valid) of a part."""
        raw, a_bytes, b_bytes = part.encode(), self.a_bytes, self.b_bytes
        if b"".join([a_bytes[i] for i in a]) != raw or b"".join([b_bytes[i] for i in b]) != raw:
            return 0, 0, 0, "", NONE, False
        a_text, b_text = self._a_text, self._b_text
        texts, pairs, own_a, own_b, ahead, j = [], [], [], [], 0, 0
        for token in a:
            own_a.append(a_text[token])
            ahead += len(a_bytes[token])
            while ahead > 0:
                other = b[j]
                own_b.append(b_text[other])
                ahead -= len(b_bytes[other])
                j += 1
            if not ahead:
                texts.append(f"{','.join(own_a)}|{','.join(own_b)}")
                pairs.append(token << 32 | other)
                own_a, own_b = [], []
        return len(a), len(b), len(texts), ";".join(texts), tuple(pairs), True

    def _tokens_of_b(self, parts: list[str]) -> list[list[int]]:
        """B puts a space before what it is given: that of a part, or one before a line feed; both are taken away again."""
        some = [p[1:] if p[0] == " " else p if p[0] == "\n" else "\n" + p for p in parts]
        return [ids if p[0] == " " else ids[1 if p[0] == "\n" else 2 :] for p, ids in zip(parts, self._b.encode(some, out_type=int, num_threads=1))]

    def _found(self, parts: list[str]) -> list[tuple]:
        newest, older = self._newest, self._older
        met = {p: newest.get(p) or older.get(p) for p in dict.fromkeys(parts)}
        missing = [p for p, g in met.items() if g is None]
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            a = self._a.encode_batch_fast(some, add_special_tokens=False)
            met.update((p, self._groups(p, x.ids, y)) for p, x, y in zip(some, a, self._tokens_of_b(some)))
        newest.update((p, g) for p, g in itertools.islice(met.items(), CACHE_ENTRIES) if len(p) <= CACHED_LENGTH)
        if len(newest) >= CACHE_ENTRIES:
            self._newest, self._older = {}, newest
        return [met[p] for p in parts]

    def close(self, parts: list[str]) -> Closed:
        """The groups of whole parts."""
        if not parts:
            return Closed()
        n_a, n_b, n_groups, texts, pairs, valid = zip(*self._found(parts))
        count = sum(n_groups)
        linked = np.fromiter(itertools.chain.from_iterable(pairs), np.int64, count)
        return Closed(sum(n_a), sum(n_b), count, ";".join(filter(None, texts)), linked, all(valid))

    def fragment(self, text: str) -> Fragment:
        """A range of a text, closed between its cuts. The empty range is neutral in composition."""
        first, *others = self.cut(text)
        return Fragment(first, self.close(others[:-1]), others[-1]) if others else Fragment(first)

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        seam = self.cut((left.head if left.tail is None else left.tail) + right.head)
        head, closed, tail = left.head, left.closed, right.tail
        if left.tail is None:
            head, *seam = seam
        if right.tail is None:
            tail = seam.pop() if seam else None
        return Fragment(head, closed.then(self.close(seam), right.closed), tail)

    def whole(self, text: str | None) -> Closed:
        """The groups of a text."""
        return self.finish(self.fragment(" " + text if text else ""))

    def finish(self, fragment: Fragment) -> Closed:
        """The groups of a fragment that is a whole text after a space. An empty text has none."""
        if not fragment.head and fragment.tail is None:
            return Closed()
        tail = [] if fragment.tail is None else [fragment.tail]
        whole = self.close([fragment.head]).then(fragment.closed, self.close(tail))
        return whole if whole.valid else Closed()


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a_path, b_path)


FRAGMENT = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("n_a", pa.int64()),
    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("valid", pa.bool_()),
])
ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("block", pa.int64()),
])
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>, block long"
_FRAGMENT = "doc_id long, row long, k long, head string, tail string, n_a long, n_b long, n_groups long, groups string, pairs array<long>, valid boolean"
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_counted = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum([len(a) for a in arrays], dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])).cast(kind))


def _aligned(doc_id: pa.Array, found: list[Closed], blocks: list[int]) -> pa.RecordBatch:
    counted = [np.unique(c.pairs, return_counts=True) for c in found]
    columns = [doc_id, *[pa.array([getattr(c, x) for c in found], ALIGNED.field(x).type) for x in ("n_a", "n_b", "n_groups", "groups")]]
    columns += [_lists([p for p, _ in counted], pa.int64()), _lists([t for _, t in counted], pa.int32()), pa.array(blocks, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=ALIGNED)


def _fragments(doc_id: pa.Array, row: pa.Array, k: pa.Array, found: list[Fragment]) -> pa.RecordBatch:
    own = {"head": [f.head for f in found], "tail": [f.tail for f in found]}
    own |= {x: [getattr(f.closed, x) for f in found] for x in ("n_a", "n_b", "n_groups", "groups", "valid")}
    columns = {"doc_id": doc_id, "row": row, "k": k, "pairs": _lists([f.closed.pairs for f in found], pa.int64())}
    columns |= {x: pa.array(v, FRAGMENT.field(x).type) for x, v in own.items()}
    return pa.RecordBatch.from_arrays([columns[f.name] for f in FRAGMENT], schema=FRAGMENT)


def _read(rows: pa.RecordBatch | pa.Table) -> Iterator[Fragment]:
    pairs = rows["pairs"].combine_chunks() if isinstance(rows, pa.Table) else rows["pairs"]
    pairs = pairs.combine_chunks() if isinstance(pairs, pa.ChunkedArray) else pairs
    for i, r in enumerate(rows.drop_columns(["pairs"]).to_pylist()):
        closed = Closed(r["n_a"], r["n_b"], r["n_groups"], r["groups"], pairs[i].values.to_numpy(), r["valid"])
        yield Fragment(r["head"], closed, r["tail"])


def _reduce(fragments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Fragments of FAN neighbours each composed into one."""

    def composed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        whole = functools.reduce(aligner(a_path, b_path).compose, _read(rows))
        first = rows.slice(0, 1)
        up = pa.array([first["k"][0].as_py() // FAN], pa.int64())
        return pa.Table.from_batches([_fragments(first["doc_id"].combine_chunks(), first["row"].combine_chunks(), up, [whole])])

    return fragments.groupBy("row", F.expr(f"k div {FAN}").alias("up")).applyInArrow(composed, _FRAGMENT)


def _long(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """align() of texts longer than a byte range: dealt out as ranges, made fragments, reduced as a tree."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                text = " " + text.as_py()
                for k, at in enumerate(range(0, len(text), RANGE)):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id.as_py(), "row": row.as_py(), "k": k, "text": text[at : at + RANGE]}], ranges)

    def begun(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            yield _fragments(batch["doc_id"], batch["row"], batch["k"], [own.fragment(t) for t in batch["text"].to_pylist()])

    def ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            yield _aligned(batch["doc_id"], [own.finish(f) for f in _read(batch)], [-1 - r for r in batch["row"].to_pylist()])

    ranges = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int64()), ("text", pa.string())])
    numbered = documents.withColumn("row", F.monotonically_increasing_id())
    parts = stage(numbered.mapInArrow(split, "doc_id long, row long, k long, text string"))
    longest = parts.agg(F.max("k")).head()[0]
    fragments = stage(parts.repartition("row", "k").mapInArrow(begun, _FRAGMENT))
    release(parts)
    while longest:
        last, fragments, longest = fragments, stage(_reduce(fragments, a_path, b_path)), longest // FAN
        release(last)
    return fragments.mapInArrow(ended, _ALIGNED)


def align(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`), pairs and times (linked ids, how often), and a block.

    Null and empty texts, and those whose tokens' bytes differ from theirs, have no tokens: zeros and an empty text. Texts
    longer than RANGE are dealt over tasks; a stretch without a cut is tokenised in one piece, however long. Equal texts
    give equal values, repeated rows stay, an empty table gives no rows; only doc_id and text are read. A block holds the
    rows of one batch, or one long text, so what is gathered by block is bounded by a batch's bytes.
    """
    bounded_batches(documents.sparkSession)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task = aligner(a_path, b_path), TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            found = [own.whole(t) for t in batch["text"].to_pylist()]
            yield _aligned(batch["doc_id"], found, [task << 32 | number] * len(found))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > RANGE
    return rows.where(~is_long).mapInArrow(whole, _ALIGNED).union(_long(rows.where(is_long), a_path, b_path))


def count_links(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows of align(): pairs of each block with their number, and of all blocks (`count`), the highest of its B id marked."""
    each = aligned.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    blocks = stage(each.groupBy("block", "pair").agg(F.sum("n").alias("n")))
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("count"))
    # At most as many rows for a B id as there are ids of A.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return blocks, counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def digests(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each document its tokens, groups and links, how often its links occur in all documents, and a digest of its groups."""
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = align(documents, a_path, b_path).withColumn("groups", hashed).withColumnRenamed("groups", "groups_sha256")
    aligned = stage(rows)
    blocks, counts = count_links(aligned)
    found = blocks.join(counts, "pair").select("block", "pair", "count", "best")

    def looked_up(docs: pa.Table, links: pa.Table) -> pa.Table:
        pair = links["pair"].to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], links["count"].to_numpy()[order], links["best"].to_numpy()[order].astype(np.int64)
        n_links, n_best, sums = [], [], []
        for pairs, times in zip(docs["pairs"], docs["times"]):
            at = np.searchsorted(pair, pairs.values.to_numpy())
            own = times.values.to_numpy().astype(np.int64)
            n_links.append(int(own.sum()))
            n_best.append(int((own * best[at]).sum()))
            sums.append(int((own * count[at]).sum()))
        made = {"n_links": n_links, "n_best": n_best, "count_sum": sums}
        return pa.table([docs[f.name] if f.name not in made else pa.array(made[f.name], pa.int64()) for f in _COUNTED], schema=_COUNTED)

    return aligned.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(looked_up, _counted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
