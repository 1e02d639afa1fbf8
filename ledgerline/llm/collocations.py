"""Phrases that stick together, mined from stripes of next-word counts.

A *stripe* belongs to a prefix of up to three words and counts the words that
follow it (or the end of its piece). Stripes are held as sorted columns
``lang, w1, w2, w3, w4, n``: the rows that share the first k words are the
stripe of that prefix, their sum is how often the prefix occurs, and their
first differing word runs through its extensions. So one structure gives the
counts of phrases, of their extensions and of all their prefixes.

Every slice of texts builds its stripes, with equal rows already added up,
and sends them to the bucket of their first word; a bucket merges stripes by
adding them up word by word and keeps the phrases that are frequent. Word
bytes travel with every message, so nothing depends on a hash being unique.
Buckets number with the text, and each is merged by itself. A first word that
would fill a good part of a bucket sends its stripe by two words, or three, or
all four, and its own count is put together from the buckets' parts. Which
prefixes do is estimated from a sample of rows; that decides where rows go,
never what is counted, and their number is at most 24 times the buckets'.

The frequent phrases become a table; scores, subsumption and ranks are joins
and groupings over it. Ranks are cut in two steps, so no language lies in one
task whole.

Defined results: a null or empty text has no words; a null language is
``und``; repeated rows count again; ties rank by count, then by the phrase's
bytes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_A, MIX_B, corpus_bytes, mix, slices_of, texts_as_bytes, word_hashes

LONGEST = 4
LEAST_COUNT = 30
#: A phrase goes if one that holds it occurs at least this many times in a hundred of its own.
SUBSUMED = 80
SCALE = 2_000_000
TOP = 2000
#: Characters that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"
#: Text bytes per bucket, and of the sample per bucket, about.
PER_BUCKET, SAMPLED_PER_BUCKET = 6 << 20, 20_000
LEAST_BUCKETS = 32
SLICE_BYTES = 4 << 20
#: Groups in which a language's phrases are ranked first.
RANK_GROUPS = 64

#: A byte that no UTF-8 text holds: stands for the end of a piece.
END = b"\xff"
_LINES = bytes.maketrans(BREAKS, b"\n" * len(BREAKS))
COLUMNS = ("lang", "w1", "w2", "w3", "w4")


class Stripes:
    """Rows ``lang, w1..w4`` (numbers; word 0: the piece's end) with counts,
    and how many words decided each row's bucket."""

    def __init__(self, langs: list[str], words: list[bytes], columns: list[np.ndarray], counts: np.ndarray,
                 depth: np.ndarray):
        self.langs, self.words, self.columns, self.counts, self.depth = langs, words, columns, counts, depth

    @classmethod
    def of(cls, texts: list[bytes], langs: list[str]) -> Stripes:
        """One row for every word of the texts."""
        number: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            number.setdefault(lang, []).append(i)
        flat, sizes = [], []
        for own in number.values():
            joined = b"\n".join([texts[i] for i in own] + [b""]).lower().translate(_LINES).replace(b"\n", b" " + END + b" ")
            words = joined.split()
            flat += words
            sizes.append(len(words))
        places = {END: 0}
        for w in dict.fromkeys(flat):
            places.setdefault(w, len(places))
        ids = np.fromiter(map(places.__getitem__, flat), np.int32, len(flat))
        at = np.flatnonzero(ids)
        columns, alive = [np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[at]], np.ones(len(at), bool)
        padded = np.concatenate([ids, np.zeros(LONGEST, np.int32)])
        for k in range(LONGEST):
            word = np.where(alive, padded[at + k], 0).astype(np.int32)
            alive = word > 0
            columns.append(word)
        return cls(list(number), list(places), columns, np.ones(len(at), np.int64), np.ones(len(at), np.uint8))

    def prefix_hashes(self) -> list[np.ndarray]:
        """Hashes of the first 1, 2, 3 and 4 words with the language."""
        words = word_hashes(self.words)
        out, h = [], word_hashes([lang.encode("utf-8", "surrogatepass") for lang in self.langs])[self.columns[0]]
        for column in self.columns[1:]:
            h = mix(h * MIX_A + words[column] * MIX_B)
            out.append(h)
        return out

    def taken(self, at: np.ndarray) -> Stripes:
        return Stripes(self.langs, self.words, [c[at] for c in self.columns], self.counts[at], self.depth[at])

    def starts(self, n_words: int) -> np.ndarray:
        """Where, in sorted rows, the stripes of prefixes of so many words begin."""
        new = np.zeros(len(self.counts), bool)
        new[:1] = True
        for c in self.columns[:1 + n_words]:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def added_up(self) -> Stripes:
        """Neighbouring equal rows as one."""
        start = self.starts(LONGEST)
        if not len(start):
            return self
        out = self.taken(start)
        out.counts = np.add.reduceat(self.counts, start)
        return out

    def dealt(self, n_buckets: int, split: np.ndarray) -> tuple[Stripes, np.ndarray]:
        """Rows ordered by bucket with equal ones added up, and the bucket of
        each; ``split``: hashes of the prefixes whose stripes are spread."""
        hashes = self.prefix_hashes()
        chosen, spread = hashes[0].copy(), np.arange(len(self.counts))
        for k in range(LONGEST - 1):
            spread = spread[np.isin(hashes[k][spread], split)]
            chosen[spread], self.depth[spread] = hashes[k + 1][spread], k + 2
        bucket = chosen % np.uint64(n_buckets)
        # equal rows come together: by bucket, then by bits of the hashes of one, two and all words
        key = bucket << np.uint64(36) | hashes[0] >> np.uint64(50) << np.uint64(22) | \
            hashes[1] >> np.uint64(53) << np.uint64(11) | hashes[3] >> np.uint64(53)
        order = np.argsort(key)
        rows = self.taken(order)
        return rows.added_up(), bucket[order][rows.starts(LONGEST)].astype(np.int64)

    def merged(self) -> Stripes:
        """All rows sorted by language and words, equal ones added up."""
        word_bits = np.uint64(max(1, (len(self.words) - 1).bit_length()))
        if int(word_bits) * 2 + max(1, (len(self.langs) - 1).bit_length()) <= 64:
            c = [x.astype(np.uint64) for x in self.columns]
            order = np.lexsort((c[3] << word_bits | c[4], (c[0] << word_bits | c[1]) << word_bits | c[2]))
        else:
            order = np.lexsort(self.columns[::-1])
        return self.taken(order).added_up()


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else "u1").astype(np.int64)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))


def _stripes(part: pa.RecordBatch) -> Stripes:
    return Stripes.of(texts_as_bytes(part.column("text")), part.column("lang").to_pylist())


def spread_prefixes(docs: DataFrame, n_bytes: int, n_buckets: int, text_col: str = "text",
                    lang_col: str = "lang") -> np.ndarray:
    """Hashes, sorted, of the prefixes of one to three words that hold more
    than about an eighth of a bucket, by a sample of rows; at most ``24 n_buckets``."""
    out = pa.schema([("depth", pa.int32()), ("prefix", pa.int64()), ("n", pa.int64())])

    def heavy(batches):
        for batch in batches:
            for part in slices_of(batch, "text", SLICE_BYTES):
                rows = _stripes(part)
                total = len(rows.counts)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0]), pa.array([total])], schema=out)
                for depth, hashes in enumerate(rows.prefix_hashes()[:LONGEST - 1], 1):
                    found, n = np.unique(hashes, return_counts=True)
                    # what is heavy over all slices is so in one of them, and keeps half of its count this way
                    found, n = found[16 * n_buckets * n > total], n[16 * n_buckets * n > total]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), depth, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], schema=out)

    share = min(1.0, SAMPLED_PER_BUCKET * n_buckets / max(1, n_bytes))
    rows = _rows(docs, text_col, lang_col)
    found = ((rows if share == 1.0 else rows.sample(share, 12)).mapInArrow(heavy, "depth int, prefix long, n long")
             .groupBy("depth", "prefix").agg(F.sum("n").alias("n")).checkpoint())
    total = found.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    hot = found.where((F.col("depth") > 0) & (F.col("n") * 8 * n_buckets >= total))
    return np.sort(np.array([r[0] for r in hot.select("prefix").collect()], np.int64).view(np.uint64))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT,
                     per_bucket: int = PER_BUCKET) -> DataFrame:
    """``lang, phrase, f``: every phrase of one to four words that occurs at
    least ``least`` times in a language; under a null phrase all its words."""
    n_bytes = corpus_bytes(docs, text_col)
    n_buckets = max(LEAST_BUCKETS, n_bytes // per_bucket)
    split = spread_prefixes(docs, n_bytes, n_buckets, text_col, lang_col)
    names = (*COLUMNS, "counts", "depth")
    sent = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("langs", pa.list_(pa.string())), ("words", pa.binary()),
                      *((c, pa.binary()) for c in names)])

    def send(batches):
        for batch in batches:
            for part in slices_of(batch, "text", SLICE_BYTES):
                rows, bucket = _stripes(part).dealt(n_buckets, split)
                words = np.array(rows.words, object)
                bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
                messages = []
                for a, b in zip(bounds, bounds[1:]) if len(bucket) else ():
                    used, own = np.unique(np.concatenate([[0], *(c[a:b] for c in rows.columns[1:])]), return_inverse=True)
                    own = own[1:].reshape(LONGEST, b - a)
                    messages.append({
                        "bucket": int(bucket[a]), "n": b - a, "langs": rows.langs, "words": b" ".join(words[used].tolist()),
                        "lang": narrow(rows.columns[0][a:b]), **{c: narrow(w) for c, w in zip(COLUMNS[1:], own)},
                        "counts": narrow(rows.counts[a:b]), "depth": rows.depth[a:b].tobytes()})
                yield pa.RecordBatch.from_pylist(messages, schema=sent)

    out = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def merge(group):
        langs: dict[str, int] = {}
        words: dict[bytes, int] = {}
        parts = []
        for batch in group.to_batches(max_chunksize=16):
            for r in batch.to_pylist():
                lang_of = np.array([langs.setdefault(x, len(langs)) for x in r["langs"]], np.int32)
                word_of = np.array([words.setdefault(w, len(words)) for w in r["words"].split(b" ")], np.int32)
                parts.append([lang_of[widened(r["lang"], r["n"])], *(word_of[widened(r[c], r["n"])] for c in COLUMNS[1:]),
                              widened(r["counts"], r["n"]), np.frombuffer(r["depth"], np.uint8)])
        *columns, counts, depth = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        names_of = list(langs)
        found = [(lang, None, n) for lang, n in zip(names_of, np.bincount(columns[0], counts).astype(np.int64).tolist()) if n]
        # a first word whose stripes are all here and too rare begins no frequent phrase
        begins = (np.bincount(columns[1], counts)[columns[1]] >= least) | (depth > 1)
        rows = Stripes(names_of, list(words), columns, counts, depth).taken(begins).merged()
        for k in range(1, LONGEST + 1) if len(rows.counts) else ():
            start = rows.starts(k)
            f = np.add.reduceat(rows.counts, start)
            own = (rows.columns[k][start] > 0) & ((f >= least) | (rows.depth[start] > k))
            numbers = np.column_stack([c[start[own]] for c in rows.columns[:1 + k]]).tolist()
            found += [(names_of[lang], b" ".join([rows.words[w] for w in own_words]).decode("utf-8", "replace"), n)
                      for (lang, *own_words), n in zip(numbers, f[own].tolist())]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), out.types)], schema=out)

    messages = _rows(docs, text_col, lang_col).mapInArrow(
        send, "bucket long, n long, langs array<string>, words binary, " + ", ".join(f"{c} binary" for c in names))
    parts = messages.groupBy("bucket").applyInArrow(merge, "lang string, phrase string, f long")
    # the parts of a spread stripe's prefix meet here
    return (parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
            .where(F.col("phrase").isNull() | (F.col("f") >= least)))


def _joined(words, first, n):
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score``: phrases of several words with the
    cut that scores lowest. ``phrases``: a table of :func:`frequent_phrases`."""
    known = phrases.where("phrase is not null")
    words = F.split("phrase", " ")
    several = known.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.size(words).alias("k")).where("k > 1")
    cuts = several.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _joined(F.col("words"), F.lit(1), F.col("cut")).alias("first"),
                       _joined(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    # both parts of a frequent phrase are frequent, so neither join loses a cut
    both = (cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "k", "a", "low.l", "low.r", "low.score")


def without_subsumed(candidates: DataFrame, phrases: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """The candidates that no longer frequent phrase holds nearly whenever they occur."""
    words = F.split("phrase", " ")
    longer = phrases.select("lang", "f", words.alias("words"), F.size(words).alias("k")).where("k > 2")
    inner = F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), "
                   "i -> array_join(slice(words, i, n), ' '))))")
    held = (longer.select("lang", "f", F.explode(inner).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("f").alias("most")))
    hundred = F.lit(100).cast("decimal(10,0)") * F.coalesce("most", F.lit(0)).cast("decimal(19,0)")
    return (candidates.join(held, ["lang", "phrase"], "left")
            .where(hundred < F.lit(share).cast("decimal(10,0)") * F.col("a").cast("decimal(19,0)")).drop("most"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT,
                 top: int = TOP, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: every language's best phrases."""
    phrases = frequent_phrases(docs, text_col, lang_col, least, per_bucket).checkpoint()
    kept = without_subsumed(scored(phrases), phrases)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*best))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    ranked = first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    totals = phrases.where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The table of :func:`collocations` over ``documents``, in plain SQL.
ORACLE_SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
grams AS (SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS k FROM starts),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= {LEAST_COUNT}),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w
  FROM f WHERE k > 1 AND f >= {LEAST_COUNT}),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
low AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i
  FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2)),
held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM inner_ GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN held USING (lang, phrase)
  WHERE most IS NULL OR 100::HUGEINT * most < {SUBSUMED}::HUGEINT * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
