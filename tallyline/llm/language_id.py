"""Language identification as inference of a mixture of languages.

Training counts hashed letter n-grams of each language over all its documents. A document is a bag of words, each
written in one of the languages; expectation-maximisation estimates the proportions, and of the best one, two, ...
languages, up to all, the set with the highest likelihood after a penalty per language is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm._bytes import LOWER, byte_class, ragged, slices, words
from tallyline.llm._frames import short_batches, table

#: Slots of a language's table of n-gram counts: 128 KB a language.
BITS = 15
SLOTS = 1 << BITS
#: Estimation ends when no proportion moves by this, or after so many rounds; the penalty for a language, in units of half
#: the logarithm of the number of words, as in the Bayesian information criterion.
TOLERANCE, ROUNDS, PENALTY = 1e-3, 50, 2.0
#: Likelihoods are scaled down by this, as neighbouring n-grams overlap.
DAMP = 0.5
UNKNOWN = "und"
_LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_BLANKED = np.where(_LETTER == 1, LOWER, 0x20).astype(np.uint32)


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the n-grams around all bytes of words, words' offsets among them, and texts' offsets among the words.

    A word is a run of letters; an n-gram is a byte of it with those before and after, lower-cased where they are A-Z
    and blank where they belong to no word.
    """
    s, e, o = words(buf, offsets, _LETTER)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(1, np.int64), o
    text = np.full(len(buf) + 2, 0x20, np.uint32)
    text[1:-1] = _BLANKED[buf]
    h = (text[:-2] << np.uint32(16) | text[1:-1] << np.uint32(8) | text[2:]) * np.uint32(0x9E3779B1)
    inside = _LETTER[buf].view(bool)
    slots = (h >> np.uint32(32 - BITS))[inside].astype(np.int32)
    return slots, np.concatenate([[0], np.cumsum(e - s)]), o


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per language and slot that a partition holds."""
    have: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, z, buf, offsets in slices(batch.column("text")):
            slots, begin, o = ngrams(buf, offsets)
            of = begin[o]
            index: dict[str, list[int]] = {}
            for i, lang in enumerate(langs[a:z]):
                index.setdefault(lang, []).append(i)
            for lang, rows in index.items():
                which = slots[ragged(of[rows], of[np.array(rows) + 1] - of[rows])]
                have[lang] = have.get(lang, np.zeros(SLOTS, np.int64)) + np.bincount(which, minlength=SLOTS)
    for lang, c in have.items():
        slot = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(c[slot])], ["lang", "slot", "n"])


def language_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and the log likelihood of each slot (languages, SLOTS), from all rows of (lang, text)."""
    counts = docs.mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("cells")).collect()  # SLOTS numbers a language at most
    packed.sort(key=lambda r: r["lang"].encode())
    logs = np.zeros((len(packed), SLOTS))
    for j, r in enumerate(packed):
        c = np.full(SLOTS, 0.5)
        c[[x["slot"] for x in r["cells"]]] += [x["n"] for x in r["cells"]]
        logs[j] = np.log(c / c.sum())
    return [r["lang"] for r in packed], (logs * DAMP).astype(np.float32)


def _estimated(like: np.ndarray, o: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (languages, texts), log likelihoods, and how far these are below the best at most, of texts with words.

    like: of words, relative to the best. As the likelihood is concave in the proportions, its slope towards a language
    bounds what is left to gain.
    """
    part = (allowed / allowed.sum(axis=0)).astype(np.float32)
    live, words_, at = np.arange(len(o) - 1), like, o
    for _ in range(rounds):
        count = np.diff(at)
        joint = np.repeat(part[:, live], count, axis=1)
        joint *= words_
        joint /= np.maximum(joint.sum(axis=0), np.float32(1e-37))
        new = (np.add.reduceat(joint, at[:-1], axis=1, dtype=np.float64) / count).astype(np.float32)
        moves = np.abs(new - part[:, live]).max(axis=0) >= TOLERANCE
        part[:, live] = new
        if not moves.any():
            break
        if moves.mean() < 0.8:
            words_ = words_[:, ragged(at[:-1][moves], count[moves])]
            live, at = live[moves], np.concatenate([[0], np.cumsum(count[moves])])
    count = np.diff(o)
    total = np.repeat(part, count, axis=1)
    total *= like
    total = np.maximum(total.sum(axis=0), np.float32(1e-37))
    slope = np.where(allowed > 0, np.add.reduceat(like / total, o[:-1], axis=1, dtype=np.float64), 0).max(axis=0)
    return part, np.add.reduceat(np.log(total), o[:-1], dtype=np.float64), np.maximum(slope - count, 0)


def mixtures(like: np.ndarray, o: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (languages, texts) of the set that penalised likelihood chooses, for texts that all have words.

    Sets grow by the language with the next largest proportion among all. No set does better than all languages
    together, so a text for which that can't pay the price of more languages is settled without trying them.
    """
    k, texts = like.shape[0], len(o) - 1
    price = penalty * 0.5 * np.log(np.maximum(np.diff(o), 2))
    part, bound, short = _estimated(like, o, np.ones((k, texts), np.float32), rounds)
    bound = bound + short
    rank = np.argsort(np.argsort(-part, axis=0, kind="stable"), axis=0)
    best, ll, _ = _estimated(like, o, (rank < 1).astype(np.float32), 0)
    score = ll - price
    for m in range(2, k + 1):
        open_ = np.flatnonzero(score < bound - m * price)
        if not len(open_):
            break
        count = (o[1:] - o[:-1])[open_]
        p, ll, _ = _estimated(like[:, ragged(o[open_], count)], np.concatenate([[0], np.cumsum(count)]), (rank[:, open_] < m).astype(np.float32), rounds)
        take = ll - m * price[open_] > score[open_]
        best[:, open_[take]] = p[:, take]
        score[open_[take]] = (ll - m * price[open_])[take]
    return best


def predictor(model: object, rounds: int, penalty: float, text_at: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        for batch in batches:
            letters = np.asarray(batch.column("letters"))
            text = batch.column("text") if text_at is None else pc.struct_field(batch.column("row"), [text_at])
            for a, z, buf, offsets in slices(text):
                slots, begin, o = ngrams(buf, offsets)
                if langs and len(begin) > 1:
                    ll = np.stack([np.add.reduceat(x[slots], begin[:-1]) for x in logs])
                    ll -= ll.max(axis=0)
                    full = np.diff(o) > 0
                    part = np.zeros((z - a, len(langs)))
                    part[full] = mixtures(np.exp(np.maximum(ll, -80)), np.append(o[:-1][full], o[-1]), rounds, penalty).T
                else:
                    part = np.zeros((z - a, max(1, len(langs))))
                known = letters[a:z] & (np.diff(o) > 0) & bool(langs)
                first = part.argmax(axis=1)
                pred = [langs[j] if k else UNKNOWN for j, k in zip(first.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(part[np.arange(z - a), first], 0, 1), 0.0)
                shares = [[(langs[j], float(p)) for j, p in enumerate(row) if p > 0] if k else [] for row, k in zip(part, known.tolist(), strict=True)]
                cols = [batch.column("doc_id").slice(a, z - a), batch.column("held_out").slice(a, z - a), pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
                names = ["doc_id", "held_out", "lang_pred", "score", "proportions"]
                if text_at is not None:
                    cols, names = [*cols, batch.column("row").slice(a, z - a)], [*names, "row"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, penalty: float = PENALTY, carry: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred, score (its proportion), proportions (of the chosen set).

    Learns from all rows that have text and language and are not held out; the table has 128 KB a language. A null text,
    or one without any letter, or any text if nothing could be learned, is `und` with score 0. Ties go to the language
    first by code point. Repeated rows are predicted alike; an empty table gives an empty result; other columns are
    ignored. carry: with a struct `row` of all columns of docs, whatever their names.
    """
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.col(text_col)
    held, letters = F.coalesce(held_out, F.lit(False)), F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    learned = docs.filter(~held & text.isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text.alias("text"))
    model = spark.sparkContext.broadcast(language_model(learned))
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row") if carry else text.alias("text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), letters.alias("letters"), whole)
    out = T._parse_datatype_string("doc_id long, held_out boolean, lang_pred string, score double, proportions map<string, double>")
    at = docs.schema["row"].dataType.names.index(text_col) if carry else None
    return docs.mapInArrow(predictor(model, rounds, penalty, at), T.StructType([*out, *([docs.schema["row"]] if carry else [])]))


def held_out_fifth(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), held_out_fifth()).select("doc_id", "held_out", "lang_pred", "score")
