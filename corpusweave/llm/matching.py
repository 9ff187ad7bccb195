"""Matching entities across sources without keys: loopy belief propagation over candidate pairs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.runtime import Staging

#: Log-odds of evidence; a pair without any evidence has the prior.
PRIOR = -4.0
AUTHOR = {"shared": 4.0, "unknown": 0.0, "different": -8.0}
YEAR = {"same": 1.0, "next": 0.5, "unknown": 0.0, "apart": -8.0}
TITLE = {"same": 6.0, "noise": 5.0, "one word": 3.0, "two words": 0.0, "other": -6.0}
SEQUEL = -12.0
#: Log-odds by which a further record of one source is held back, since a source seldom lists a paper twice.
REPEAT = 1.0
#: Two titles may agree only if they have (SHARED[0] / SHARED[1]) of the shorter one's distinct words in one spelling,
#: and if the shorter one has half of the longer one's words at least.
SHARED = (3, 5)
#: Words and surnames in more than this share of all rows have their counts known to every task: at most 1/share times
#: the words of a row. They order words by rarity and bound the rows of a key; any order finds the same pairs.
KNOWN_SHARE = 1 / 5000
#: Stored rows of a key that one task is meant to hold; keys that may have more are split by salt.
KEY_ROWS = 20_000

_MARKUP = re.compile(r"<[^>]*>")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?|[${}]")
_WORD = re.compile(r"[^\W_]+")
#: How a title says that it continues another.
_ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}
_ORDINAL = {"second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9}


def fold(text: str) -> str:
    """Lower-case text without accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.lower()


def title_words(title: str | None) -> list[str]:
    """Words of a title without markup, case, accents and punctuation; `&` is `and`."""
    text = _COMMAND.sub("", _MARKUP.sub(" ", title or ""))
    return _WORD.findall(fold(text.replace("&", " and ")))


def name_keys(authors: str | None) -> list[str]:
    """`surname|initial` of each name of a list in any of the usual writings; the initial may be missing."""
    text = re.sub(r"\bet\s+al\b\.?", "", fold(authors or ""))
    out = []
    if ";" in text or re.search(r"\band\b", text):
        parts = re.split(r";|\band\b", text)
    elif re.match(r"^\s*[a-z]\.", text):
        parts = text.split(",")
    else:
        parts = [text] if text.count(",") <= 1 else re.findall(r"[^,]+,[^,]+", text)
    for part in parts:
        if "," in part:
            last, _, first = part.partition(",")
        else:
            *given, last = part.split() or [""]
            first = given[0] if given else ""
        last, first = "".join(_WORD.findall(last)), "".join(_WORD.findall(first))
        if last:
            out.append(f"{last}|{first[:1]}")
    return sorted(set(out))


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether at most `most` insertions, deletions, changes or swaps of neighbours turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _like(a: str, b: str) -> bool:
    """Whether b may be a misspelt; words that differ in more letters than two edits can change are told at once."""
    if a == b:
        return True
    most = 1 if len(b) < 5 else 2
    return abs(len(a) - len(b)) <= most and len(set(a) ^ set(b)) <= 2 * most and within_edits(a, b, most)


def strip_marks(words: list[str]) -> tuple[list[str], int]:
    """(words without a note on the form of the record, number of the sequel or 1)."""
    words = list(words)
    if words and _like(words[0], "preprint"):
        words = words[1:]
    if len(words) > 2 and _like(words[-1], "abstract") and any(_like(w, "extended") for w in words[-3:-1]):
        cut = -2 if _like(words[-2], "extended") else -3
        words = words[:cut]
    if len(words) > 2:
        if words[-1] in _ROMAN:
            return words[:-1], _ROMAN[words[-1]]
        if words[-1].isdigit() and _like(words[-2], "part"):
            return words[:-2], int(words[-1])
        if _like(words[-1], "report"):
            for name, number in _ORDINAL.items():
                if words[-2] == name or (len(words[-2]) > 4 and within_edits(words[-2], name, 1)):
                    return words[:-2], number
    return words, 1


def least_shared(shorter: int) -> int:
    """Words that two titles must have in one spelling, given the distinct words of the shorter."""
    return -(-SHARED[0] * shorter // SHARED[1])


def title_evidence(a: list[str], b: list[str]) -> float:
    """Log-odds from two titles. Order, slips of the pen and a part that is missing at one end do not count against."""
    (a, na), (b, nb) = strip_marks(a), strip_marks(b)
    return SEQUEL if na != nb else _agreement(a, b)


def _agreement(a: list[str], b: list[str]) -> float:
    """Log-odds from the words of two titles without marks of form and sequel."""
    if a == b and a:
        return TITLE["same"]
    if len(a) > len(b):
        a, b = b, a
    left = list(b)
    extra = []
    for w in a:
        if w in left:
            left.remove(w)
        else:
            extra.append(w)
    rest: list[str] = []
    if len(set(a) & set(b)) < least_shared(min(len(set(a)), len(set(b)))):
        return TITLE["other"]
    for w in extra:
        if len(rest) > 2:
            return TITLE["other"]
        like = next((x for x in left if _like(w, x)), None)
        if like is None:
            rest.append(w)
        else:
            left.remove(like)
    found = len(a) - len(rest)
    if found < max(3, 0.5 * len(b)):
        return TITLE["other"]
    tail = list(left)
    for w in reversed(b):
        if w not in tail:
            break
        tail.remove(w)
    inner = len(tail)
    for w in b:
        if inner == 0 or w not in tail or len(tail) < len(left):
            break
        tail.remove(w)
        inner = len(tail)
    changed = max(len(rest), inner)
    return TITLE[("noise", "one word", "two words")[changed]] if changed < 3 else TITLE["other"]


def _sorted(side: DataFrame) -> DataFrame:
    """side, to be joined by sorting. Sides that grow with the tables must not reach the driver, but the planner would
    broadcast them by the size of their compressed files, which is a small part of what they take in memory."""
    return side.hint("merge")


def _described(rows: DataFrame, keep: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(keep, words, sequel, names, year, *more): each row's title without marks, its place in a series, its names."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [strip_marks(title_words(t)) for t in batch.column("title").to_pylist()]
            text = pa.array([" ".join(w) for w, _ in marked], pa.string())
            sequel = pa.array([n for _, n in marked], pa.int32())
            names = pa.array([name_keys(a) for a in batch.column("authors").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(keep), text, sequel, names, batch.column("year"), *(batch.column(c) for c in more)],
                [keep, "words", "sequel", "names", "year", *more],
            )

    year = F.col("year").cast("int")
    got = rows.select(keep, "title", "authors", F.when(year.between(1, 9998), year).alias("year"), *more)
    schema = f"{keep} {kinds[keep]}, words string, sequel int, names array<string>, year int" + "".join(f", {c} {kinds[c]}" for c in more)
    return got.where(F.col("title").isNotNull() & F.col(keep).isNotNull()).mapInArrow(run, schema).where("words <> ''")


@dataclass(frozen=True)
class Counts:
    """Rows of both tables with each frequent word and each frequent surname."""

    words: dict[str, int]
    names: dict[str, int]


def _counts(a: DataFrame, b: DataFrame) -> Counts:
    rows = a.select("words", "names").unionByName(b.select("words", "names"))
    word = F.transform(F.array_distinct(F.split("words", " ")), lambda w: F.struct(F.lit(True).alias("is_word"), w.alias("v")))
    surname = F.array_distinct(F.transform("names", lambda n: F.substring_index(n, "|", 1)))
    name = F.transform(surname, lambda n: F.struct(F.lit(False).alias("is_word"), n.alias("v")))
    per = rows.select(F.explode(F.concat(word, name)).alias("x")).select("x.*").groupBy("is_word", "v").agg(F.count(F.lit(1)).alias("n"))
    found = per.where(F.col("n") > KNOWN_SHARE * rows.count()).collect()
    return Counts({r.v: r.n for r in found if r.is_word}, {r.v: r.n for r in found if not r.is_word})


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _keys(rows: DataFrame, row: str, counts: Counts, stored: bool) -> DataFrame:
    """(key, row, low, high, meta): the keys by which a row meets those whose title may agree with its own.

    Words are ordered by rarity. Of n words, o of which are shared, one is among the first n - o + 1 of either title, so
    a row is keyed by that many of its words: `short` are those that do if its title is the shorter one, all keys do if
    it is the longer one and the other has but half its words. A key is such a word with the place in a series and a
    surname; rows without a name, and those of the other table for their sake, are keyed without a surname as well.
    `low` and `high` have a bit set for each word, by which most rows of a key that share too few words are told at
    once; `meta` holds the number of words, the year or 0, and `short` in its last bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        unnamed = {True: ("+records", "+stored"), False: ("+records",)}[stored]
        for batch in batches:
            ids = batch.column(row).to_numpy(zero_copy_only=False)
            word_hash, word_count, word_short, n_keys, n_words, low, high = [], [], [], [], [], [], []
            tag_hash, tag_count, n_tags = [], [], []
            for text, sequel, names in zip(batch.column("words").to_pylist(), batch.column("sequel").to_pylist(), batch.column("names").to_pylist()):
                words = set(text.split())
                surnames = {x.rpartition("|")[0] for x in names}
                for w in (words | surnames).difference(known):
                    known[w] = _hash(w)
                n = len(words)
                order = sorted(words, key=lambda w: (counts.words.get(w, 0), known[w]))[: n - least_shared(-(-n // 2)) + 1]
                short = n - least_shared(n) + 1
                word_hash += [(known[w] + sequel) % 2**64 for w in order]
                word_count += [counts.words.get(w, 0) for w in order]
                word_short += [k < short for k in range(len(order))]
                n_keys.append(len(order))
                n_words.append(n)
                b = 0
                for w in words:
                    b |= 1 << (known[w] >> 20) % 126
                low.append(b & (1 << 63) - 1)
                high.append(b >> 63)
                tags = ("+records" if stored else "+stored",) if names else unnamed
                tag_hash += [known[x] for x in surnames] + [len(t) for t in tags]
                tag_count += [counts.names.get(x, 0) for x in surnames] + [2**62] * len(tags)
                n_tags.append(len(surnames) + len(tags))
            wide, deep = np.array(n_keys, np.int64), np.array(n_tags, np.int64)
            each = wide * deep
            at = np.repeat(np.arange(len(ids)), each)
            place = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            w = (np.cumsum(wide) - wide)[at] + place % wide[at]
            t = (np.cumsum(deep) - deep)[at] + place // wide[at]
            most = np.minimum(np.array(word_count, np.int64)[w], np.array(tag_count, np.int64)[t])
            salts = np.maximum(1, -(-most // KEY_ROWS)).astype(np.uint64)
            key = _scrambled(np.array(word_hash, np.uint64)[w] ^ _scrambled(np.array(tag_hash, np.uint64)[t]))
            if stored:
                salt = _scrambled(ids.astype(np.int64).view(np.uint64))[at] % salts
            else:
                copies = salts.astype(np.int64)
                salt = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                key, at, w = np.repeat(key, copies), np.repeat(at, copies), np.repeat(w, copies)
            key = _scrambled(key + salt.astype(np.uint64))
            year = batch.column("year").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            meta = (np.array(n_words, np.int64) << 16 | year << 1)[at] | np.array(word_short, np.int64)[w]
            columns = [pa.array(x) for x in (key.view(np.int64), ids[at], np.array(low, np.int64)[at], np.array(high, np.int64)[at], meta)]
            yield pa.RecordBatch.from_arrays(columns, ["key", row, "low", "high", "meta"])

    return rows.select(row, "words", "sequel", "names", "year").mapInArrow(run, f"key long, {row} long, low long, high long, meta long")


def candidates(a: DataFrame, b: DataFrame, counts: Counts) -> DataFrame:
    """(record_id, stored): every two rows that share a surname, where both have names, whose years are next to each
    other, where both are known, and whose titles share as many words as least_shared demands - and some that do not."""
    ka = _keys(a, "record_id", counts, False)
    kb = _keys(b, "stored", counts, True)
    kb = kb.select("key", "stored", *(F.col(c).alias(f"{c}_b") for c in ("low", "high", "meta")))
    n, n_b = (F.shiftright(c, 16) for c in ("meta", "meta_b"))
    year, year_b = (F.shiftright(c, 1).bitwiseAND(F.lit(0x7FFF)) for c in ("meta", "meta_b"))
    shorter = F.least(n, n_b)
    needed = F.floor((SHARED[0] * shorter + SHARED[1] - 1) / SHARED[1])
    missing = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    met = ka.join(_sorted(kb), "key").where(
        (F.col("meta").bitwiseOR(F.col("meta_b")).bitwiseAND(F.lit(1)) == 1)
        & ((year == 0) | (year_b == 0) | (F.abs(year - year_b) <= 1))
        & (2 * shorter >= F.greatest(n, n_b))
        & (missing("low", "low_b") + missing("high", "high_b") <= n - needed)
        & (missing("low_b", "low") + missing("high_b", "high") <= n_b - needed)
    )
    return met.select("record_id", "stored").distinct()


def _title_scores(pairs: DataFrame) -> DataFrame:
    """pairs (..., wa, wb) with the log-odds of their titles in place of the words."""
    keep = [f for f in pairs.schema if f.name not in ("wa", "wb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [_agreement(x.split(), y.split()) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist())]
            names = [f.name for f in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(w, pa.float64())], [*names, "title"])

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", title double")


def _shared(a: Column, b: Column) -> Column:
    """Whether two lists of `surname|initial` have a name in common; a missing initial agrees with any."""
    def parts(x: Column) -> tuple[Column, Column]:
        return F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)

    def same(x: Column, y: Column) -> Column:
        (sx, ix), (sy, iy) = parts(x), parts(y)
        return (sx == sy) & ((ix == iy) | (ix == "") | (iy == ""))

    return F.exists(a, lambda x: F.exists(b, lambda y: same(x, y)))


def propagate(edges: DataFrame, most_rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """(i, j, confidence): marginal probability of each candidate pair of edges (i, j, source, w), w its log-odds.

    Factors: a record i has one paper j at most; of one source a paper has one record, each further one being held back
    by REPEAT. A pair without a rival in either factor has its marginal at once; the others exchange messages. In a
    round every pair gets the messages of both factors, which are sums over its rivals: a partial aggregate per factor,
    joined back and less the pair's own share, so that no factor is gathered in a task. Rounds end when no marginal
    moves by `tolerance`; after the first few, messages are damped. State is written each round.
    """
    staging = Staging(edges.sparkSession)
    odds = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("w"))))
    source = F.coalesce("source", F.lit("")) if "source" in edges.columns else F.lit("")
    each = edges.select("i", "j", source.alias("s"), odds.alias("o"))
    of_i = each.groupBy("i").agg(F.count(F.lit(1)).alias("ni"))
    of_j = each.groupBy("j", "s").agg(F.count(F.lit(1)).alias("nj"))
    known = staging.write(each.join(_sorted(of_i), "i").join(_sorted(of_j), ["j", "s"]).withColumn("alone", F.expr("ni = 1 and nj = 1")), "pairs")
    settled = known.where("alone").select("i", "j", (F.col("o") / (1 + F.col("o"))).alias("confidence"))
    state = known.where("not alone").select("i", "j", "s", "o", F.lit(1.0).alias("from_j"), F.lit(0.0).alias("confidence"))
    held = float(np.exp(-REPEAT))
    for turn in range(most_rounds):
        to_i = state.withColumn("t", F.col("o") * F.col("from_j"))
        sum_i = to_i.groupBy("i").agg(F.sum("t").alias("si"))
        with_i = to_i.join(_sorted(sum_i), "i").withColumn("from_i", 1 / (1 + F.greatest(F.lit(0.0), F.col("si") - F.col("t"))))
        to_j = with_i.select("i", "j", "s", "o", "from_j", "confidence", "from_i", (F.col("o") * F.col("from_i")).alias("t"))
        sum_j = to_j.groupBy("j", "s").agg(F.sum("t").alias("sj"))
        rivals = F.greatest(F.lit(0.0), F.col("sj") - F.col("t"))
        fresh = (1 + held * rivals) / (1 + rivals)
        message = fresh if turn < 4 else F.sqrt(fresh * F.col("from_j"))
        belief = F.col("o") * F.col("from_i") * F.col("m")
        after = to_j.join(_sorted(sum_j), ["j", "s"]).withColumn("m", message).select(
            "i", "j", "s", "o", F.col("m").alias("from_j"), (belief / (1 + belief)).alias("confidence"),
            F.abs(belief / (1 + belief) - F.col("confidence")).alias("moved"),
        )
        after = staging.write(after, "messages")
        moved = after.agg(F.max("moved")).first()[0]
        staging.drop(state)
        state = after.drop("moved")
        state._staged_path = after._staged_path
        if moved is None or moved < tolerance:
            break
    return settled.unionByName(state.select("i", "j", "confidence"))


def scored_pairs(records: DataFrame, store: DataFrame) -> DataFrame:
    """(record_id, source, paper_id, stored_title, w): candidate pairs with the log-odds of all their evidence.

    Records and stored rows meet by keys of surname and word (see _keys); all pairs are never formed."""
    staging = Staging(records.sparkSession)
    if "source" not in records.columns:
        records = records.withColumn("source", F.lit(""))
    a = staging.write(_described(records, "record_id", ("source",)), "records")
    b = _described(store, "paper_id").withColumn("stored", F.xxhash64("paper_id", "words", "sequel", "names", F.coalesce("year", F.lit(0))))
    b = staging.write(b.dropDuplicates(["stored"]), "stored")
    pairs = candidates(a, b, _counts(a, b))

    left = a.select("record_id", "source", F.col("words").alias("wa"), F.col("sequel").alias("qa"), F.col("names").alias("na"), F.col("year").alias("ya"))
    right = b.select("stored", "paper_id", F.col("words").alias("wb"), F.col("sequel").alias("qb"), F.col("names").alias("nb"), F.col("year").alias("yb"))
    unknown = (F.size("na") == 0) | (F.size("nb") == 0)
    author = F.when(unknown, AUTHOR["unknown"]).when(_shared(F.col("na"), F.col("nb")), AUTHOR["shared"]).otherwise(AUTHOR["different"])
    gap = F.abs(F.col("ya") - F.col("yb"))
    year = F.when(gap.isNull(), YEAR["unknown"]).when(gap == 0, YEAR["same"]).when(gap == 1, YEAR["next"]).otherwise(YEAR["apart"])
    sa, sb = F.array_distinct(F.split("wa", " ")), F.array_distinct(F.split("wb", " "))
    shorter = F.least(F.size(sa), F.size(sb))
    enough = SHARED[1] * F.size(F.array_intersect(sa, sb)) >= SHARED[0] * shorter
    both = pairs.join(_sorted(left), "record_id").join(_sorted(right), "stored").where((F.col("qa") == F.col("qb")) & enough)
    both = both.select("record_id", "source", "paper_id", F.xxhash64("wb", "qb").alias("stored_title"), (author + year).alias("rest"), "wa", "wb")
    return staging.write(_title_scores(both).select("record_id", "source", "paper_id", "stored_title", (PRIOR + F.col("rest") + F.col("title")).alias("w")), "scored")


def match_records(records: DataFrame, store: DataFrame, least: float = 0.5) -> DataFrame:
    """(record_id, paper_id, confidence): the pairs of a record and a stored paper that are the same paper.

    Belief propagation runs over all candidate pairs between records and distinct stored titles, so copies of a paper in
    the store do not compete. A record of two titles within reach goes to the likelier one, and a doubtful record of a
    source that has a better one of the same paper to none. A matched record is given every stored row of the title whose
    own evidence is for it. Rows without a title or an id match nothing; repeated rows match as one; empty inputs give
    an empty result; other columns are ignored.
    """
    rows = scored_pairs(records, store)
    edges = rows.groupBy(F.col("record_id").alias("i"), F.col("stored_title").alias("j"), "source").agg(F.max("w").alias("w"))
    belief = propagate(edges).where(F.col("confidence") >= least)
    kept = belief.select(F.col("i").alias("record_id"), F.col("j").alias("stored_title"), "confidence")
    out = rows.where("w > 0").join(_sorted(kept), ["record_id", "stored_title"])
    return out.groupBy("record_id", "paper_id").agg(F.max("confidence").alias("confidence"))
