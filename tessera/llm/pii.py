"""Personal data: pattern spans, and terms that give protected entities away, in DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers. What they reveal is protected at several levels: the value
itself, its owner (the name in an address), the domain of an address, and the kind, so that a term which stands beside ever
new card numbers counts as one that stands beside the same number. Over the corpus it is counted in how many distinct
contexts a term stands near each of these entities, and in how many texts the term occurs at all. A term discloses an entity
as far as it makes it likely: p(entity | term), and log2 of that over p(entity), the bits that it gives away. Terms over both
thresholds are spans as well, wherever they occur. One that discloses a value or an owner is removed; one that discloses no
more than a kind or a domain is generalised to the kind.

The patterns are written so that Java's matcher neither recurses nor scans a run twice: possessive where nothing could
be given back, and starting only where a run starts. They match the same spans as the plain forms in BASE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import put_back, salted_lookup, set_apart, stage, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?=[{_LOCAL}])(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a match to be possible.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: Words on either side of an entity that are its context, as far as they lie wholly within so many characters.
WINDOW_WORDS, WINDOW_CHARACTERS = 6, 160
#: A term is judged on so many distinct contexts at least.
LEAST_CONTEXTS = 3
#: Disclosure thresholds: p(entity | term), and bits gained about the entity.
LEAST_POSTERIOR, LEAST_BITS = 0.5, 4.0
WORD = r"[\p{L}\p{N}]+"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str) -> str:
    """SQL for the check of a match, over s.v."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return f"s.v RLIKE {_literal(rf'^{part}(?:[.]{part}){{3}}$')}"
    digits = "regexp_replace(s.v, '[^0-9]', '')"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "card":
        doubled = "if(i % 2 = 0, d, if(d > 4, 2 * d - 9, 2 * d))"
        values = f"transform(split(reverse({digits}), ''), x -> cast(x AS int))"
        total = f"aggregate(transform({values}, (d, i) -> {doubled}), 0, (a, b) -> a + b)"
        return f"length({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0"
    return "true"


def _starts(widths: str, block: int = 512) -> str:
    """SQL for the sums of the elements before each element of the array column `widths`, block by block.

    Appending to an array copies it, so one fold over a long array would cost its square.
    """
    empty = "struct(0 AS at, cast(array() AS array<int>) AS out)"
    fold = f"{empty}, (acc, x) -> struct(acc.at + x AS at, concat(acc.out, array(acc.at)) AS out)"
    blocks = f"transform(sequence(0, cast((size({widths}) - 1) / {block} AS int)), b -> slice({widths}, b * {block} + 1, {block}))"
    inner = f"transform({blocks}, a -> aggregate(a, {fold}))"
    # Twice in one expression, so that no lambda looks into it.
    outer = f"aggregate(transform({inner}, i -> i.at), {fold}).out"
    return f"if(size({widths}) > 0, flatten(zip_with({inner}, {outer}, (i, s) -> transform(i.out, x -> x + s))), {empty}.out)"


def _located(df: DataFrame, text: str, patterns: dict[str, str], needed: dict[str, str]) -> DataFrame:
    """All columns, plus for each name of `patterns` (SQL for a pattern): array of (v, start, end, before, after).

    The matches, and the text between them; places are sums of lengths in code points.
    """
    empty = "cast(array() AS array<string>)"
    matched = {f"_m_{n}": F.expr(f"if({needed[n]}, regexp_extract_all({text}, {p}, 0), {empty})") for n, p in patterns.items()}
    parted = {f"_g_{n}": F.expr(f"if(size(_m_{n}) > 0, split({text}, {p}, -1), {empty})") for n, p in patterns.items()}
    widths = {f"_w_{n}": F.expr(f"zip_with(_m_{n}, slice(_g_{n}, 1, size(_m_{n})), (v, b) -> length(v) + length(b))") for n in patterns}
    starts = {f"_s_{n}": F.expr(_starts(f"_w_{n}")) for n in patterns}
    found = {}
    for n in patterns:
        m, g = f"_m_{n}", f"_g_{n}"
        pairs = f"zip_with(zip_with({m}, slice({g}, 1, size({m})), (v, b) -> struct(v, b)), slice({g}, 2, size({m})), (x, a) -> struct(x.v AS v, x.b AS b, a AS a))"
        one = f"struct(x.v AS v, s + length(x.b) AS start, s + length(x.b) + length(x.v) AS end, right(x.b, {WINDOW_CHARACTERS + 1}) AS before, left(x.a, {WINDOW_CHARACTERS + 1}) AS after)"
        found[f"_{n}"] = F.expr(f"zip_with({pairs}, _s_{n}, (x, s) -> {one})")
    return df.withColumns(matched).withColumns(parted).withColumns(widths).withColumns(starts).withColumns(found).drop(*matched, *parted, *widths, *starts)


def with_base(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns, plus for each kind _<kind>: array of (v, start, end, before, after) in order.

    start and end count code points from 0, end exclusive; before and after are the characters next to the match.
    """
    out = documents.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    needed = {k: f"contains(_t, {_literal(NEEDED[k])})" for k in KINDS}
    out = _located(out, "_t", {k: _literal(p) for k, p in PATTERNS.items()}, needed)
    return out.withColumns({f"_{k}": F.expr(f"filter(_{k}, s -> {_valid(k)})") for k in KINDS}).drop("_t")


def _each(kind: str, of) -> Column:
    """of(span) for each span of a kind."""
    return F.transform(f"_{kind}", lambda s: of(s))


def _named(kind: str) -> Column:
    return _each(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _base_list() -> Column:
    """kind:start:end of the base spans, by kind and then start."""
    return F.concat(*[_named(kind) for kind in KINDS])


def _of_kind(kind: str) -> Column:
    return _each(kind, lambda s: s.withField("kind", F.lit(kind)))


def _entities(kind: Column, value: Column) -> Column:
    """What a span of lower-case `value` reveals: its value and its kind, and of an address its domain and its owner."""
    owner = F.trim(F.regexp_replace(F.substring_index(value, "@", 1), "[^a-z]+", " "))
    more = F.array(F.concat(F.lit("at:"), F.substring_index(value, "@", -1)), F.when(owner != "", F.concat(F.lit("of:"), owner)))
    plain = F.array(F.concat_ws(":", kind, value), kind)
    return F.array_compact(F.when(kind == "email", F.concat(plain, more)).otherwise(plain))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)))


def _with_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term): the distinct terms of `terms` in each text, with what else `terms` has.

    `terms` is staged, so the planner knows its bytes and broadcasts it only where they are few. The outer form of
    explode keeps the planner from making the words once more for a test of their number.
    """
    text = F.coalesce("text", F.lit(""))
    words = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode_outer(_words(text)).alias("term"))
    return words.join(terms, "term")


def disclosing_terms(documents: DataFrame, based: DataFrame) -> DataFrame:
    """(term, entity, posterior, bits) over the thresholds, from counts over all documents.

    Copies do not add to the evidence: contexts are distinct by their words, texts by their hash.
    """
    each = based.select("text_hash", F.explode(F.concat(*[_of_kind(k) for k in KINDS])).alias("s"))
    # One character more than the window was kept: a word that reaches it may go on, and is no word of the context.
    inside = F.lit(WINDOW_CHARACTERS)
    before = F.when(F.length("s.before") > inside, F.regexp_replace("s.before", f"^{WORD}", "")).otherwise(F.col("s.before"))
    after = F.when(F.length("s.after") > inside, F.regexp_replace("s.after", f"{WORD}$", "")).otherwise(F.col("s.after"))
    near = F.concat(
        F.slice(F.reverse(F.regexp_extract_all(F.lower(before), F.lit(f"({WORD})"), F.lit(1))), 1, WINDOW_WORDS),
        F.slice(F.regexp_extract_all(F.lower(after), F.lit(f"({WORD})"), F.lit(1)), 1, WINDOW_WORDS),
    )
    contexts = each.select(F.explode(_entities(F.col("s.kind"), F.lower("s.v"))).alias("entity"), near.alias("near"), "text_hash")
    contexts = stage(contexts.withColumn("context", F.xxhash64("near")).dropDuplicates(["entity", "context"]))
    entities = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= LEAST_CONTEXTS)
    terms = contexts.select("entity", "text_hash", F.explode(F.array_distinct("near")).alias("term"))
    # Counted before it is joined: all cards or all phones are one entity.
    pairs = terms.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= LEAST_CONTEXTS)
    pairs = salted_lookup(pairs, stage(entities), "entity", F.col("term"))
    # A term occurs in no fewer texts than it has texts near any entity: what that rules out need not be counted.
    around = terms.groupBy("term").agg(F.countDistinct("text_hash").alias("n_near"))
    pairs = pairs.join(around, "term").where(F.col("n_et") >= LEAST_POSTERIOR * F.col("n_near"))
    pairs = stage(pairs.drop("n_near"))
    counted = _with_terms(documents, stage(pairs.select("term").distinct())).select("term", "text_hash").distinct()
    counted = counted.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    texts = documents.count()
    judged = pairs.join(counted, "term").select(
        "term", "entity", F.least(F.lit(1.0), F.col("n_et") / F.col("n_t")).alias("posterior"), (F.col("n_e") / F.lit(max(1, texts))).alias("prior")
    )
    judged = judged.withColumn("bits", F.log2(F.col("posterior") / F.col("prior")))
    return judged.where((F.col("posterior") >= LEAST_POSTERIOR) & (F.col("bits") >= LEAST_BITS)).select("term", "entity", "posterior", "bits")


def _flagged(documents: DataFrame, based: DataFrame) -> DataFrame:
    """(_id, _hash, terms): the disclosing terms of each text that has any, with the tags that they are replaced by."""
    # The most telling entity of a term: a value or an owner before a domain or a kind, then the likeliest.
    own = F.col("entity").contains(":") & ~F.col("entity").startswith("at:")
    most = F.max(F.struct(own.alias("own"), "posterior", "entity"))
    kind = F.when(F.col("m.entity").startswith("at:"), "email").otherwise(F.col("m.entity"))
    tag = F.when(F.col("m.own"), TAGS["term"]).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit(" TERM]")))
    terms = stage(disclosing_terms(documents, based).groupBy("term").agg(most.alias("m")).select("term", tag.alias("tag")))
    held = _with_terms(documents, terms)
    each = F.sort_array(F.collect_set(F.struct("term", "tag"))).alias("terms")
    return stage(held.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(each))


def find(documents: DataFrame) -> DataFrame:
    """All columns, plus _email, _ip, _card, _phone (see with_base) and _term: the spans of disclosing terms.

    Null text counts as empty. A term inside a base span is no span of its own. Repeated rows get equal spans.
    """
    based = with_base(documents)
    # Staged before it is filtered: the planner would push the test below the steps that make the spans, once for each.
    entities = stage(based.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), *[f"_{k}" for k in KINDS]))
    entities = entities.where(" OR ".join(f"size(_{k}) > 0" for k in KINDS))
    flagged = _flagged(documents, entities)
    text = F.coalesce("text", F.lit(""))
    same = based["doc_id"].eqNullSafe(flagged["_id"]) & (F.xxhash64(text) == flagged["_hash"])
    joined = based.join(flagged, same, "left").drop("_id", "_hash")
    pattern = "concat('(?iu)(?<![\\\\p{L}\\\\p{N}])(?:', array_join(terms.term, '|'), ')(?![\\\\p{L}\\\\p{N}])')"
    joined = joined.withColumn("_p", F.expr(f"if(terms IS NULL, null, {pattern})"))
    joined = _located(joined, "text", {"term": "_p"}, {"term": "_p IS NOT NULL"})
    apart = " AND ".join(f"NOT exists(_{k}, b -> b.start < s.end AND s.start < b.end)" for k in KINDS)
    tagged = f"named_struct('v', s.v, 'start', s.start, 'end', s.end, 'tag', coalesce(element_at(map_from_entries(terms), lower(s.v)), '{TAGS['term']}'))"
    return joined.withColumn("_term", F.expr(f"transform(filter(_term, s -> {apart}), s -> {tagged})")).drop("terms", "_p")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of `documents`.

    Null and empty texts have no spans; texts of any length are read whole; repeated rows get equal values; an empty
    table gives no rows. Only doc_id and text are read, whatever else there is. Terms that reach a threshold exactly count.
    """
    base = _base_list()
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    listed = F.array_join(base, ",")
    return find(documents.select("doc_id", "text")).select(
        "doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), F.array_join(F.concat(base, _named("term")), ",").alias("spans")
    )


def _tagged(kind: str) -> Column:
    tag = lambda s: s["tag"] if kind == "term" else F.lit(TAGS[kind])
    return _each(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), tag(s).alias("tag")))


def sanitise(documents: DataFrame) -> DataFrame:
    """All rows and columns of `documents`, with each span of the text replaced by its tag.

    Null and empty texts stay, as they have no spans; texts of any length are read whole; repeated rows are rewritten alike,
    an empty table gives none, and columns of any name come through. Of overlapping spans the one that starts first is replaced, and of those the longest. Texts without spans stay as
    they are; n_chars, where there is one, is brought up to date.
    """
    spans = F.array_sort(F.concat(*[_tagged(kind) for kind in (*KINDS, "term")]))
    used = ("doc_id", "text", "n_chars")
    found = find(set_apart(documents, used)).withColumn("_s", spans)
    step = """if(s.start >= acc.at, struct(-s.minus AS at, concat(acc.out, array(substring(text, acc.at + 1, s.start - acc.at), s.tag)) AS out), acc)"""
    folded = f"aggregate(_s, struct(0 AS at, cast(array() AS array<string>) AS out), (acc, s) -> {step}, acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"
    out = found.withColumn("_new", F.expr(f"if(size(_s) > 0, {folded}, text)"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_s") > 0, F.length("_new")).otherwise(F.col("n_chars")).cast(kind))
    return put_back(out.withColumn("text", F.col("_new")), documents.columns, used)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
