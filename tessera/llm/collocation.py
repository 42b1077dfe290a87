"""Phrase collocations by Apriori passes: frequent phrases level by level, then the weakest cut of each.

Pass k reads the whole texts again and counts phrases of k words, but only where both phrases of k - 1 words in them are
frequent.  What tasks get for that is a filter of bits by the hashes of the frequent phrases of k - 1 words: it has
MOST_BITS at most, whatever the corpus.  It lets all frequent phrases through and few others; counts are by the phrases
themselves, so a phrase let through by chance is only counted in vain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import blocks, codes, kinds, words_of
from .common import join_counted, materialize, small_batches

#: Blanks lie between words, marks and line ends between pieces.
KINDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
LONGEST, LEAST, TOP, COVERED = 4, 30, 2_000, 80
#: Bits of a filter: 16 a frequent phrase, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _PRIME
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


def _first(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase of one word in its language."""
    return _mixed(lang * _PRIME ^ word)


def _longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with a further word."""
    return _mixed(phrase * np.uint64(0xD6E8FEB86659FD93) + word)


def _places(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    last = np.uint64(n_bits - 1)
    return h & last, h >> np.uint64(32) & last


def _member(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = (bits[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1) for x in _places(h, len(bits) * 64))
    return (a & b).astype(bool)


def frequent_filter(frequent: DataFrame) -> np.ndarray:
    """The filter of a table (lang, phrase): phrases of one number of words."""
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * frequent.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = pc.split_pattern(batch.column("phrase").cast(pa.binary()), b" ")
            width = len(words[0])
            table = _word_hashes(words.flatten()).reshape(-1, width)
            h = _first(_word_hashes(batch.column("lang").cast(pa.binary())), table[:, 0])
            for k in range(1, width):
                h = _longer(h, table[:, k])
            places = np.unique(np.concatenate(_places(h, n_bits)))
            slot, at = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), at)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def level_counts(docs: DataFrame, k: int, bits: np.ndarray | None) -> DataFrame:
    """(lang, phrase, n): phrases of k words whose two phrases of k - 1 words pass the filter.

    For k = 1 all words, and each language's number of words with a null phrase.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bits) if k > 1 else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, "text"):
            words, ids, row, piece = words_of(rows.column("text"), KINDS)
            (langs,), lang = codes(rows.column("lang"))
            lang = lang[row]
            if k == 1:
                width = np.int64(max(1, len(words)))
                cells, n = np.unique(lang * width + ids, return_counts=True)
                of, every = np.unique(lang, return_counts=True)
                phrase = pa.concat_arrays([words.take(pa.array(cells % width)).cast(pa.binary()).cast(pa.string()), pa.nulls(len(of), pa.string())])
                of, n = np.concatenate([cells // width, of]), np.concatenate([n, every])
            else:
                hashes = _word_hashes(words)[ids] if len(ids) else np.zeros(0, np.uint64)
                seeds = _word_hashes(langs.cast(pa.binary()))
                h = _first(seeds[lang], hashes)
                for j in range(1, k - 1):
                    h = _longer(h[:-1], hashes[j:])
                starts = max(0, len(ids) - k + 1)
                good = _member(shared.value, h)
                inside = piece[:starts] == piece[k - 1 : k - 1 + starts]
                at = np.flatnonzero(inside & good[:starts] & good[1 : 1 + starts])
                # numbers of the phrases themselves, so that no two fall together
                code = lang[at] * np.int64(max(1, len(words))) + ids[at]
                for j in range(1, k):
                    code = np.unique(code, return_inverse=True)[1] * np.int64(max(1, len(words))) + ids[at + j]
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                at = at[first]
                of = lang[at]
                parts = [words.take(pa.array(ids[at + j])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()).cast(pa.string())
            if len(of):
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(of)), phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])

    return docs.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1, 2, ... words that occur at least least times.

    The first also has each language's number of words, with a null phrase.
    """
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        bits = frequent_filter(levels[-1].where("phrase IS NOT NULL")) if levels else None
        levels.append(materialize(level_counts(docs, k, bits).where((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases{k}"))
    return levels


def _score(a: str, of: str):
    """floor(2,000,000 * a / of) in decimals, as the product may pass 64 bits."""
    return F.call_function("div", F.col(a).cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)"), F.col(of).cast("decimal(19,0)"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of 2 to longest words.

    Texts are lower-cased (A-Z) and cut at marks and line ends; a phrase lies within a piece.  The cut of a phrase that
    scores least counts, the first of equals.  A phrase within a longer candidate that occurs covered percent as often
    is dropped.  Null texts are empty, a null language is `und`; repeated rows count each; a language without a
    candidate and an empty table give no rows.  Further columns are not read.
    """
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    levels = frequent_levels(docs, longest, least)
    totals = levels[0].where("phrase IS NULL").select("lang", "n")
    known = reduce(DataFrame.unionByName, levels).where("phrase IS NOT NULL").select("lang", "phrase", F.col("n").alias("f"))
    candidates = reduce(DataFrame.unionByName, levels[1:]).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    within = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = candidates.where("size(w) > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", "a", "w", cut).select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("right"))
    cuts = materialize(cuts, "cuts")
    total = cuts.count()
    for side, value in (("left", "l"), ("right", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count("*").alias("uses"))
        parts = known.select("lang", F.col("phrase").alias(side), F.col("f").alias(value)).join(uses, ["lang", side])
        cuts = join_counted(cuts, parts, ["lang", side], "uses", total)
    scored = cuts.withColumn("of", F.col("l") + F.col("r")).select("lang", "phrase", F.struct(_score("a", "of").alias("score"), "cut", "a", "l", "r").alias("s"))
    best = scored.groupBy("lang", "phrase").agg(F.min("s").alias("s")).select("lang", "phrase", "s.*")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The rows of op12 by DuckDB.
SQL = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) AS x(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT lang, a, m, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM c, range(2, {LONGEST}) AS x(m) WHERE m < k),
o AS (SELECT lang, phrase, max(a) AS longer FROM s GROUP BY ALL),
u AS (SELECT c.lang, c.phrase, a, cut, array_to_string(w[1:cut], ' ') AS p, array_to_string(w[cut + 1:], ' ') AS q FROM c LEFT JOIN o USING (lang, phrase), range(1, {LONGEST}) AS x(cut) WHERE cut < k AND (longer IS NULL OR 100 * longer < {COVERED} * a)),
z AS (SELECT u.lang, u.phrase, a, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score, cut FROM u JOIN f l ON l.lang = u.lang AND l.phrase = p JOIN f r ON r.lang = u.lang AND r.phrase = q),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= {TOP}"""
