"""From note files to notes and chunks.

Files are read by expressions. The lines of a note are folded in one pass in a worker, which carries the open block, the
heading path and the open section; a fold never spans more than one note.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import squeeze, text_hash, unquoted, value_hash, without_md

#: What splits lines: all that Unicode calls a line end.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: White space as Unicode has it.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_HEADING = re.compile(rf"(#{{1,6}}){SPACE}+(.*?){SPACE}*$")
_LIST_ITEM = re.compile(rf"(?:[-*+]|\d+\.){SPACE}+")
_BREAKS = ("---", "***", "___")
_INLINE_LABEL = re.compile(r"([A-Za-z0-9][A-Za-z0-9/&()'., \-]{0,80}): *(.*)$")
WIKILINK = r"\[\[([^\]]+)\]\]"
DATE = r"^\d{4}-?\d{2}-?\d{2}$"
#: Notes whose chunks are a batch.
NOTES = 128


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def journal_title(date: Column) -> Column:
    """A date as a title, null where it is none."""
    digits = F.regexp_replace(date, "-", "")
    return F.date_format(F.when(date.rlike(DATE), F.try_to_date(digits, "yyyyMMdd")), "MMMM dd, yyyy")


def frontmatter(files: DataFrame) -> DataFrame:
    """files with note_id, lines and end: the place of the line that ends the frontmatter, 0 for none."""
    named = files.withColumn("note_id", F.concat_ws("::", "root_label", "relative_path"))
    lines = named.withColumn("lines", F.split("raw_text", LINE_END, -1))
    fence = F.transform("lines", lambda l: _stripped(l) == "---")
    second = F.array_position(F.transform(F.slice("_fence", 2, 1 << 30), lambda f: f), True)
    opened = F.startswith(F.col("raw_text"), F.lit("---")) & F.get("_fence", F.lit(0))
    return lines.withColumn("_fence", fence).withColumn("end", F.when(opened & (second > 0), second + 1).otherwise(0).cast("int")).drop("_fence")


def properties(files: DataFrame) -> DataFrame:
    """(note_id, name, is_list, values) of the frontmatter: `key: value`, or `key:` and `- item` lines.

    Of a key given twice the last counts. An item belongs to the key line before it, and only where that key has no
    value of its own; a line that is neither ends the key.
    """
    rows = files.where("end > 2").select("note_id", F.posexplode(F.expr("slice(lines, 2, end - 2)")).alias("pos", "line"))
    rows = rows.withColumn("s", _stripped(F.col("line"))).where("s <> ''")
    name, value = _stripped(F.substring_index("line", ":", 1)), _stripped(F.expr("substring(line, instr(line, ':') + 1)"))
    after = Window.partitionBy("note_id").orderBy("pos")
    looks_item = F.startswith(F.col("s"), F.lit("- "))
    keyed = F.contains(F.col("line"), F.lit(":")) & (name != "")
    marked = rows.withColumn("_key", F.when(~looks_item, F.when(keyed, F.struct(name.alias("name"), value.alias("value"), "pos")).otherwise(F.struct(F.lit("").alias("name"), F.lit("").alias("value"), "pos"))))
    held = marked.withColumn("key", F.last("_key", ignorenulls=True).over(after)).where("key.name <> ''")
    last = held.withColumn("_last", F.max("key.pos").over(Window.partitionBy("note_id", "key.name"))).where("key.pos = _last")
    item = F.when(looks_item, F.struct("pos", unquoted(_stripped(F.expr("substring(s, 3)"))).alias("v")))
    grouped = last.groupBy("note_id", F.col("key.name").alias("name")).agg(F.max("key.value").alias("value"), F.array_sort(F.collect_list(item)).alias("items"))
    is_list = F.col("value") == ""
    values = F.when(is_list, F.transform("items", lambda i: i["v"])).otherwise(F.array(unquoted(F.col("value"))))
    return grouped.select("note_id", "name", is_list.alias("is_list"), values.alias("values"))


def tags(values: Column) -> Column:
    clean = F.transform(values, lambda t: F.regexp_replace(squeeze(t), "^#+", ""))
    return F.array_distinct(F.filter(F.coalesce(clean, F.array().cast("array<string>")), lambda t: t != ""))


def links(body: Column) -> Column:
    """Distinct wikilinks: raw text, target note, heading and alias."""

    def one(raw: Column) -> Column:
        target = F.trim(F.substring_index(raw, "|", 1))
        alias = F.when(F.contains(raw, F.lit("|")), F.trim(F.expr("null").cast("string")))
        rest = F.split(raw, r"\|", 2)
        alias = F.nullif(F.trim(F.get(rest, F.lit(1))), F.lit(""))
        parts = F.split(target, "#", 2)
        note = without_md(F.trim(F.get(parts, F.lit(0))))
        heading = F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))
        return F.struct(raw.alias("raw"), target.alias("target_raw"), note.alias("target_note"), heading.alias("target_heading"), alias.alias("alias"))

    raw = F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), lambda r: F.trim(r))
    return F.array_distinct(F.filter(F.transform(raw, one), lambda l: l["target_note"] != ""))


def notes(files: DataFrame) -> DataFrame:
    """note_id, note_seq, roots and paths, note_title, is_journal, tags, links, note_hash, body lines."""
    parsed = frontmatter(files)
    props = properties(parsed)
    wide = props.groupBy("note_id").agg(
        F.max(F.when((F.col("name") == "journal_entry_date") & ~F.col("is_list"), F.get("values", F.lit(0)))).alias("_date"),
        F.max(F.when(F.col("name") == "tags", F.col("values"))).alias("_tags"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("is_list", "values"))))).alias("frontmatter"),
    )
    joined = parsed.join(wide, "note_id", "left")
    body = F.expr("slice(lines, end + 1, greatest(size(lines) - end, 0))")
    stem = F.translate(F.regexp_replace(F.regexp_extract("relative_path", "([^/]*)$", 1), r"\.md$", ""), "_", " ")
    title = journal_title(F.col("_date"))
    return joined.withColumn("body", body).select(
        "note_id",
        "note_seq",
        "root_label",
        "root_path",
        "relative_path",
        F.coalesce(title, stem).alias("note_title"),
        title.isNotNull().alias("is_journal"),
        "frontmatter",
        tags(F.col("_tags")).alias("tags"),
        links(F.array_join("body", "\n")).alias("links"),
        text_hash(F.col("raw_text")).alias("note_hash"),
        "body",
    )


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _label(text: str | None) -> str | None:
    """As section_label."""
    return None if text is None else _squeezed(text).removesuffix(":").rstrip(" ")


def blocks(body: list[str]) -> Iterator[tuple[int, str, int | None, str]]:
    """(pos, kind, level, text) of a note's lines: headings, list items and paragraphs in order.

    A blank line, a heading or a break ends a block; so does a list item, which takes the lines after it, breaks too.
    """
    at, kind, lines = 0, "", []
    for pos, line in enumerate([*body, ""]):
        s = line.strip()
        heading = _HEADING.match(s)
        item = not heading and _LIST_ITEM.match(s)
        ends = not s or heading or item or (s in _BREAKS and kind != "list_item")
        if lines and ends:
            if text := _squeezed(" ".join(lines)):
                yield at, kind, None, text
            kind, lines = "", []
        if heading:
            yield pos, "heading", len(heading[1]), _label(heading[2])
        elif item or s and not ends:
            if not lines:
                at, kind = pos, "list_item" if item else "paragraph"
            lines.append(s)


def _chunks_of(note: dict) -> Iterator[tuple]:
    """pos, section_id, label, kind, path, occurrence, level, ordinal, text and hash of a note's chunks, by one pass."""
    path: list[str | None] = [None] * 6
    state, bare, headings, section, ordinal = "none", False, 0, None, 0
    seen: dict[tuple, int] = {}
    for pos, kind, level, text in blocks(note["body"] or []):
        opens, own, before = None, [p for p in path if p is not None], bare
        bare = False
        if kind == "heading":
            headings += 1
            if headings == 1 and note["is_journal"] and text == note["note_title"]:
                state = "none"
                continue
            # A heading ends those of its level and deeper ones.
            path[level - 1 :] = [text] + [None] * (6 - level)
            state, opens, own = "heading", "heading", [p for p in path if p is not None]
        elif kind == "paragraph" and (labelled := _INLINE_LABEL.match(text)):
            state, opens, own, text = "inline_label", "inline_label", [*own, _label(labelled[1])], _squeezed(labelled[2])
        elif state == "none":
            bare = True
            if not before:
                opens, own = "body", own or [note["note_title"]]
        if opens:
            names = [_label(p) for p in own]
            occurrence = seen[opens, *names] = seen.get((opens, *names), 0) + 1
            identity = {"kind": opens, "note_id": note["note_id"], "occurrence": occurrence, "path": names}
            deepest = max((i + 1 for i, p in enumerate(path) if p is not None), default=None)
            section, ordinal = (f"section-{value_hash(identity)[:16]}", names[-1], opens, names, occurrence, deepest), 0
        if kind != "heading" and text:
            ordinal += 1
            yield pos, *section, ordinal, text, hashlib.sha256(text.encode()).hexdigest()


def chunks(parsed: DataFrame) -> DataFrame:
    """The chunks of notes: sections with their path and occurrence, paragraphs with their ordinal, ids and hashes.

    A note's lines are folded where its row lies: no line is shuffled.
    """
    facts = ["note_id", "note_seq", "root_label", "relative_path", "note_title"]
    made = ["chunk_seq", "section_id", "section_label", "section_kind", "section_path", "section_occurrence", "heading_level", "paragraph_ordinal", "paragraph_text", "chunk_hash"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, NOTES):
                part = batch.slice(low, NOTES)
                rows = [(i, *c) for i, note in enumerate(part.select(["note_id", "note_title", "is_journal", "body"]).to_pylist()) for c in _chunks_of(note)]
                columns = list(zip(*rows)) or [()] * (1 + len(made))
                of = part.select(facts).take(pa.array(columns[0], pa.int32()))
                yield pa.RecordBatch.from_arrays([*of.columns, *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=[*facts, *made])

    types = {c: parsed.schema[c].dataType.simpleString() for c in facts}
    own = ["int", "string", "string", "string", "array<string>", "int", "int", "int", "string", "string"]
    schema = ", ".join([f"{c} {types[c]}" for c in facts] + [f"{c} {t}" for c, t in zip(made, own)])
    rows = parsed.select(*facts, "is_journal", "body").mapInArrow(folded, schema)
    return rows.select(
        F.concat(F.col("note_id"), F.lit("::"), F.col("section_id"), F.format_string("::p%04d", "paragraph_ordinal")).alias("chunk_id"),
        "note_id",
        "note_seq",
        "chunk_seq",
        "root_label",
        "relative_path",
        "note_title",
        "section_id",
        "section_label",
        "section_kind",
        "section_path",
        "section_occurrence",
        "heading_level",
        "paragraph_ordinal",
        "paragraph_text",
        "chunk_hash",
    )


def embedding_text() -> Column:
    return F.concat_ws(" | ", "note_title", "relative_path", "section_label", "paragraph_text")
