"""Personal data and the terms that give it away, in DataFrame functions only.

Four kinds of protected entities are found by pattern (:data:`KINDS`). What
stands around them can disclose them even when they are cut out, so the
corpus says how much: for every term near entities of a kind,

    disclosure = PMI(term; kind) / IC(kind)
               = log2(n(term, kind) N / (n(term) n(kind))) / log2(N / n(kind))

over documents, where n(term, kind) counts documents with the term next to
such an entity and n(term) all documents with the term. It is 1 for a term
that never occurs without the entity and 0 for an unrelated one. A term whose
disclosure reaches the threshold, with enough different entities seen beside
it (copies of one document prove nothing), is sanitised next to entities of
that kind: generalised to its kind, or removed if the disclosure is complete.

The counts cover the whole corpus. Terms are counted with map-side partial
sums before the shuffle; only the contexts of entities, not texts, are kept
between the steps.

The patterns are written with possessive repetitions: they match what the
plain ones match (no part can take over a character of the next), but Java
neither recurses nor backtracks on very long runs. An email's local part is
tried at the first character of a run only (or where the last match ended),
which is where the leftmost match would begin.

Defined results: a null or empty text has no spans (and stays null or empty);
repeated rows get the same spans; of overlapping spans, the first by start
and kind is replaced and the rest of the overlap goes with it; an empty table
gives an empty result; extra columns are kept by :func:`sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import unused_name

#: Kinds in their order among spans of one start; "term" is what the corpus adds.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind; far cheaper than the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: A term is a run of letters.
TERM_PATTERN = r"\p{L}++"

#: Code points on either side of an entity in which terms count as near it.
CONTEXT = 40
#: Code points of a wide entity. A kind's entities don't overlap and the shortest have five code points, so that
#: fewer than ``(WIDE + CONTEXT) / 2`` narrow ones of all kinds start within ``WIDE + CONTEXT`` code points.
WIDE = 256
#: Spans of a text from which on their terms are looked for span by span in the neighbourhood only.
MANY = 512
#: Code points in a block of a text with many spans.
BLOCK = 4096
MIN_ENTITIES = 5
DISCLOSURE = 0.8
REMOVE_AT = 0.99

_SPAN = "array<struct<start:int,end:int,value:string>>"


#: Matches placed in one go: running places are built up in chunks, so that a text's matches cost little more than linear time.
CHUNK = 256


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches_of(text: Column, pattern: str, possible: Column) -> Column:
    """Start, end (code points, exclusive) and value of every match, in order.
    Spark hands out matched strings, not places; the pieces between them, cut
    by the same pattern, give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.zip_with(gaps, found, lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("n"),
                                                                value.alias("value")))

    def placed(chunk: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(
            chunk, start,
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + p["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"),
                                                      (acc["at"] + p["gap"] + p["n"]).alias("end"),
                                                      p["value"].alias("value")))).alias("out")),
            lambda acc: acc["out"])

    def firsts(chunks: Column) -> Column:
        """Where each chunk's first gap begins."""
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + p["gap"] + p["n"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])

    def chunked(all_pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / CHUNK).cast("int"))
        return F.transform(numbers, lambda i: F.slice(all_pairs, i * CHUNK + 1, F.lit(CHUNK)))

    spans = bound(pairs, lambda p: F.when(F.size(p) <= CHUNK, placed(p, F.lit(0))).otherwise(bound(
        chunked(p), lambda chunks: F.flatten(F.zip_with(chunks, firsts(chunks), placed)))))
    return F.when(possible & F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _byte(part: Column) -> Column:
    """True for a number of at most 255, whatever its leading zeros."""
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) > 3, False).otherwise(F.concat(F.lit("0"), plain).cast("int") <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\.", -1), _byte),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def entity_spans(text: Column) -> Column:
    """All valid entities of a non-null text: ``start, rank, end, kind, value`` by start, then kind."""
    digits = F.regexp_like(text, F.lit("[0-9]"))

    def of_kind(rank: int, kind: str) -> Column:
        possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else digits
        if kind != "email":
            possible = possible & digits
        found = F.filter(matches_of(text, PATTERNS[kind], possible), lambda s: VALID[kind](s["value"]))
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), s["value"].alias("value")))

    return F.array_sort(F.concat(*(of_kind(rank, kind) for rank, kind in enumerate(KINDS))))


def nearby_terms(text: Column, spans: Column, context: int = CONTEXT) -> Column:
    """``kind, value, term, start, end`` of every whole term within ``context``
    code points of an entity that is not inside an entity itself."""

    def around(span: Column, others: Column, total: Column, cut) -> Column:
        low = F.greatest(F.lit(0), span["start"] - context)

        def in_part(part: Column) -> Column:
            inside = F.length(part)
            whole = F.filter(matches_of(part, TERM_PATTERN, F.lit(True)),
                             lambda t: ((t["start"] > 0) | (low == 0)) & ((t["end"] < inside) | (low + inside == total)))
            return F.transform(whole, lambda t: F.struct(
                span["kind"].alias("kind"), span["value"].alias("value"), F.lower(t["value"]).alias("term"),
                (low + t["start"]).alias("start"), (low + t["end"]).alias("end")))

        placed = bound(cut(low, span["end"] + context), in_part)
        return bound(others, lambda near: F.filter(
            placed, lambda t: ~F.exists(near, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))))

    def from_text(low: Column, high: Column) -> Column:
        return F.substr(text, low + 1, high - low)

    def near(all_spans: Column, total: Column, blocks: Column) -> Column:
        """Of very many spans, the wide ones and the neighbours in order are all
        that a narrow one's terms can meet; the text is at hand in blocks, as
        finding a place in it takes time in proportion to the place."""
        is_wide = lambda s: s["end"] - s["start"] > WIDE
        reach = (WIDE + context) // 2

        def from_blocks(low: Column, high: Column) -> Column:
            first = F.floor(low / BLOCK).cast("int")
            count = F.floor((F.least(high, total) - 1) / BLOCK).cast("int") - first + 1
            return F.substr(F.array_join(F.slice(blocks, first + 1, count), ""), low - first * BLOCK + 1, high - low)

        return bound(F.filter(all_spans, is_wide), lambda wide: F.transform(all_spans, lambda s, i: around(
            s, F.when(is_wide(s), all_spans).otherwise(F.concat(wide, F.slice(
                all_spans, F.greatest(F.lit(1), i + 1 - reach), F.lit(2 * reach + 1)))), total, from_blocks)))

    blocks_of = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return F.flatten(bound(F.length(text), lambda total: F.when(
        F.size(spans) <= MANY, F.transform(spans, lambda s: around(s, spans, total, from_text))).otherwise(
        bound(blocks_of, lambda blocks: bound(spans, lambda own: near(own, total, blocks))))))


def disclosing_terms(docs: DataFrame, contexts: DataFrame, text_col: str = "text", min_entities: int = MIN_ENTITIES,
                     disclosure: float = DISCLOSURE) -> DataFrame:
    """``kind, term, disclosure`` of the terms that give entities of a kind
    away. ``contexts``: ``content, n`` (a text's hash and how many documents
    have it), ``kind, value, term`` of every term near an entity."""
    n_docs = docs.count()
    of_kind = (contexts.select("content", "n", "kind").distinct()
               .groupBy("kind").agg(F.sum("n").alias("n_kind")))
    beside = (contexts.groupBy("kind", "term").agg(F.countDistinct("value").alias("entities"))
              .where(F.col("entities") >= min_entities))
    joint = (contexts.select("content", "n", "kind", "term").distinct()
             .groupBy("kind", "term").agg(F.sum("n").alias("n_both")))
    candidates = beside.join(joint, ["kind", "term"]).select("kind", "term", "n_both").checkpoint()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(F.col(text_col).cast("string")), F.lit(TERM_PATTERN), F.lit(0)))).alias("term"))
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term"))
    information = F.log2(F.lit(float(n_docs)) / F.col("n_kind"))
    pmi = F.log2(F.col("n_both") * float(n_docs) / (F.col("n_term") * F.col("n_kind")))
    scored = (n_term.join(candidates, "term").join(of_kind, "kind")
              .select("kind", "term", F.when(information > 0, pmi / information).otherwise(0.0).alias("disclosure")))
    return scored.where(F.col("disclosure") >= disclosure)


def entity_contexts(docs: DataFrame, text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """``content, n, kind, value, term, start, end``: the terms near entities of
    every different text, with the number of documents that have this text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(text.alias("text")).select("text", entity_spans(F.col("text")).alias("spans"))
    near = (found.where(F.size("spans") > 0)
            .select(F.md5("text").alias("content"), nearby_terms(F.col("text"), F.col("spans"), context).alias("near")))
    once = near.groupBy("content").agg(F.count("*").alias("n"), F.first("near").alias("near"))
    return once.select("content", "n", F.inline("near"))


def term_spans(docs: DataFrame, text_col: str = "text", context: int = CONTEXT, min_entities: int = MIN_ENTITIES,
               disclosure: float = DISCLOSURE) -> DataFrame:
    """``content, terms``: for every text (by its MD5) with a disclosing term,
    the spans ``start, rank, end, kind, value`` of these; ``value`` names the
    kind disclosed, or is empty where the disclosure is complete."""
    contexts = entity_contexts(docs, text_col, context).checkpoint()
    flagged = disclosing_terms(docs, contexts, text_col, min_entities, disclosure)
    hits = contexts.join(flagged, ["kind", "term"])
    by_place = hits.groupBy("content", "start", "end").agg(F.max(F.struct("disclosure", "kind")).alias("top"))
    span = F.struct(
        F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.lit(TERM).alias("kind"),
        F.when(F.col("top.disclosure") >= REMOVE_AT, F.lit("")).otherwise(F.col("top.kind")).alias("value"))
    return by_place.groupBy("content").agg(F.collect_list(span).alias("terms"))


def with_spans(docs: DataFrame, into: str, text_col: str = "text", context: int = CONTEXT,
               min_entities: int = MIN_ENTITIES, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with a column ``into``: all spans of the text, by start, then kind."""
    terms = term_spans(docs, text_col, context, min_entities, disclosure)
    own, key, extra, content = (unused_name(docs, n) for n in ("own_spans", "text_key", "more_spans", "content_key"))
    terms = terms.withColumnsRenamed({"terms": extra, "content": content})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.withColumn(own, entity_spans(text))
    # a text without entities has no terms: its key is its own row's, so that no shuffle key gathers them all
    base = base.withColumn(key, F.when(F.size(own) > 0, F.md5(text)).otherwise(
        F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    joined = base.join(terms, F.col(key) == F.col(content), "left")
    spans = F.when(F.col(extra).isNull(), F.col(own)).otherwise(F.array_sort(F.concat(own, extra)))
    return joined.select(*docs.columns, spans.alias(into))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: how many entities of each kind, a digest of their places, and all spans."""
    found = with_spans(docs.select(id_col, text_col), "spans", text_col)
    base = F.filter("spans", lambda s: s["kind"] != TERM)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"),
                        joined_spans(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; a
    disclosing term by the kind it discloses, or by nothing."""
    label = lambda s: F.when(s["kind"] != TERM, F.concat(F.lit("<"), s["kind"], F.lit(">"))).when(
        s["value"] == "", "").otherwise(F.concat(F.lit("<"), s["value"], F.lit(" context>")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), label(s))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def sanitise(docs: DataFrame, text_col: str = "text", context: int = CONTEXT, min_entities: int = MIN_ENTITIES,
             disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with the spans of its texts replaced, all other columns as they were."""
    into = unused_name(docs, "all_spans")
    found = with_spans(docs, into, text_col, context, min_entities, disclosure)
    text = F.when(F.size(into) > 0, redacted(F.col(text_col).cast("string"), F.col(into))).otherwise(F.col(text_col))
    return found.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
