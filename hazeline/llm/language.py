"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily against each
automaton into phrases, each the longest match that the labelled text holds followed by a fresh start;
the language that needs the fewest normalised phrases a symbol wins. A phrase points into the labelled text and names the symbol
that ends it, so it counts as the logarithms of that text's length and of the alphabet: a language with little labelled
text needs more phrases, each of which says less.

Fitting: labelled texts are cut into pieces of PIECE characters, from their first to their last; of each
language the PIECES distinct pieces with the least digests are the sample. It comes from everywhere in long texts,
copies count once, and its size is bounded whatever the corpus; an automaton has three moves a symbol at most. Languages are
dealt into models of BLOCK languages, which are broadcast one after the other. Prediction reads every whole text. With one model
it is narrow: no shuffle, so hot sources or groups of copies cannot gather in one task; with more, each gives its best language for a
document and text, and the best of them is taken.

Texts are lower-cased and letters become symbols, every run of other characters one separator; letters
that no sample holds end a phrase. Parsing restarts at every SEGMENT symbols, which adds one phrase at
most for each and lets numpy step many segments at once.

Defined cases: null text and text without a letter are `und` with score 0; ties go to the smaller
language name; rows with null lang, or of the held-out fold, are never learned from; without any labelled
row every text is `und`; an empty table gives an empty result. Repeated rows give equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, stored, table, texts

UNKNOWN = "und"
#: Characters of a piece of labelled text and pieces of a language: the bounds of the sample.
PIECE, PIECES = 1_000, 60
#: Languages of a model, which each task holds whole (1.3 MB a language).
BLOCK = 100
SEGMENT = 256
#: In the code table: 0 is the separator, 1 an unknown letter.
_SEPARATOR, _OTHER = 0, 1
_PLANE = 0x110000


@dataclass
class Automaton:
    """Moves of a suffix automaton with the rows of all states laid over each other: the move of state s on symbol
    c stands at base[s] + c if owner there is s, and is to. start: the state after c from the start, or 0."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    start: np.ndarray


@dataclass
class Model:
    """languages; letters: their code points in code order from 2; an automaton for each language and what one of its phrases
    counts; how many languages there are in all models."""

    languages: list[str]
    letters: np.ndarray
    automata: list[Automaton]
    weight: np.ndarray
    n_languages: int


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_PLANE)])


def _symbols(text: str, codes: np.ndarray) -> np.ndarray:
    """Symbols of lower-cased text, runs of separators as one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = codes[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _SEPARATOR) | (s[:-1] != _SEPARATOR)
    return s[keep]


def _codes(letters: np.ndarray) -> np.ndarray:
    codes = np.where(_is_letter(), _OTHER, _SEPARATOR).astype(np.uint8 if len(letters) < 250 else np.uint16)
    codes[letters] = np.arange(2, 2 + len(letters))
    return codes


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings (Blumer et al. 1985); state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if depth[to] == depth[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                depth.append(depth[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves


def overlaid(moves: list[dict[int, int]], n_codes: int) -> Automaton:
    """The states with several moves are fitted first, each where its moves meet free places; the others fill the
    places left."""
    used = bytearray(2 * sum(map(len, moves)) + 4 * n_codes)
    base = np.zeros(len(moves), np.int64)
    low = n_codes  # so that no base is negative
    for state in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        codes = sorted(moves[state])
        if len(codes) < 2:
            break
        gaps = [c - codes[0] for c in codes]
        at, tries = low, 0
        while any(used[at + g] for g in gaps):
            at, tries = used.find(0, at + 1), tries + 1
            if at < 0 or at + 2 * n_codes > len(used):
                at = len(used) - n_codes if at < 0 else at
                used.extend(bytes(len(used)))
        for g in gaps:
            used[at + g] = 1
        base[state] = at - codes[0]
        if tries > 32:  # crowded up to here
            low = used.find(0, low + 1)
    single = [s for s, m in enumerate(moves) if len(m) == 1]
    free = np.flatnonzero(np.frombuffer(used, np.uint8) == 0)
    free = np.r_[free[free >= n_codes], len(used) + np.arange(len(single))][: len(single)]
    base[single] = free - np.array([next(iter(moves[s])) for s in single], np.int64)
    size = int(base.max(initial=0)) + n_codes
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
    at = base[state] + np.array([c for m in moves for c in m], np.int64)
    owner[at], to[at] = state, [t for m in moves for t in m.values()]
    start = np.zeros(n_codes, np.int32)
    start[list(moves[0])] = list(moves[0].values())
    return Automaton(base.astype(np.int32), owner, to, start)


def _automaton(symbols: np.ndarray, n_codes: int) -> Automaton:
    return overlaid(suffix_automaton(symbols.tolist()), n_codes)


def sample(labelled: DataFrame) -> DataFrame:
    """lang, at and piece: the distinct pieces of labelled text (text, lang) with the least digests by language."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    cut = F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    pieces_of = rows.select("lang", cut.alias("piece")).withColumn("at", F.xxhash64("piece"))
    ids = pieces_of.select("lang", "at").distinct()
    # First within each of many hash ranges, then over them: no task sorts the digests of a language.
    salted = Window.partitionBy("lang", F.pmod("at", F.lit(61))).orderBy("at")
    few = ids.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= PIECES)
    by_lang = Window.partitionBy("lang").orderBy("at")
    few = few.withColumn("n", F.row_number().over(by_lang)).filter(F.col("n") <= PIECES).drop("n")
    # PIECES rows a language at most.
    return pieces_of.join(few, ["lang", "at"]).groupBy("lang", "at").agg(F.first("piece").alias("piece"))


def fit(labelled: DataFrame) -> Iterator[Model]:
    """Models of labelled (text, lang), BLOCK languages each, from a bounded sample of each language."""
    found = stored(sample(labelled), "language-sample")
    names = [r["lang"] for r in found.select("lang").distinct().orderBy("lang").collect()]  # a name a language
    for start in range(0, len(names), BLOCK):
        per: dict[str, list[str]] = {}
        for r in found.filter(F.col("lang").isin(names[start : start + BLOCK])).orderBy("lang", "at").collect():
            per.setdefault(r["lang"], []).append(r["piece"])
        yield model({lang: "\n".join(xs) for lang, xs in sorted(per.items())}, len(names))


def model(samples: dict[str, str], n_languages: int) -> Model:
    """The model of a sample of each language, ascending, of n_languages in all."""
    letters = np.array(sorted({ord(c) for x in samples.values() for c in x.lower() if c.isalpha()}), np.int64)
    codes = _codes(letters)
    symbols = [_symbols(x, codes) for x in samples.values()]
    weight = np.array([np.log(len(x) + 1.0) + np.log(len(np.unique(x)) + 1.0) for x in symbols])
    return Model(list(samples), letters, [_automaton(x, 2 + len(letters)) for x in symbols], weight, n_languages)


def phrase_counts(symbols: np.ndarray, sizes: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Phrases of each of the segments that lie end to end in symbols."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = sizes[order]
    base, owner, to, start = automaton.base, automaton.owner, automaton.to, automaton.start
    state, ended = np.zeros(n, np.int32), np.ones(n, np.int64)
    active = n
    for k in range(int(longest[0]) if n else 0):
        while active and longest[active - 1] <= k:
            active -= 1
        symbol = symbols[starts[:active] + k]
        at = base[state[:active]] + symbol
        miss = owner[at] != state[:active]
        ended[:active] += miss
        state[:active] = np.where(miss, start[symbol], to[at])
    out = np.empty(n, np.int64)
    out[order] = ended
    return out


def _predict(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    codes = _codes(model.letters)
    names = np.array([*model.languages, UNKNOWN], object)
    for batch in batches:
        for part in pieces(batch, "text"):
            rows = [_symbols(x, codes) for x in texts(part, "text")]
            n = np.array([len(x) for x in rows], np.int64)
            lettered = np.array([bool((x != _SEPARATOR).any()) for x in rows])
            segments = -(-n // SEGMENT)
            sizes = np.full(int(segments.sum()), SEGMENT, np.int64)
            last = np.cumsum(segments)[segments > 0] - 1
            sizes[last] = n[segments > 0] - (segments[segments > 0] - 1) * SEGMENT
            owner = np.repeat(np.arange(len(rows)), segments)
            joined = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
            phrases = np.array([np.bincount(owner, phrase_counts(joined, sizes, a), len(rows)) for a in model.automata])
            cost = phrases * model.weight[:, None]
            best, least = cost.argmin(axis=0), cost.min(axis=0)
            # The logarithm of a language's share: more, the more symbols a normalised phrase covers.
            rate = np.log1p(model.n_languages) * _FULL * np.maximum(n, 1) / np.maximum(cost, 1e-9)
            top = rate.max(axis=0)
            total = top + np.log(np.exp(rate - top).sum(axis=0))
            score = np.where(lettered, np.exp(top - total), 0.0)
            yield pa.record_batch(
                [
                    *(part.column(c) for c in _KEPT),
                    pa.array(names[np.where(lettered, best, -1)], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(np.where(lettered, phrases[best, np.arange(len(rows))], 0).astype(np.int64)),
                    pa.array(np.where(lettered, least, np.inf)),
                    pa.array(total),
                ],
                names=[*_KEPT, "lang_pred", "score", "n_phrases", "cost", "total"],
            )


#: What a phrase of a full sample over some thirty letters counts.
_FULL = np.log(PIECE * PIECES) + np.log(32)
_KEPT = ("doc_id", "held_out", "text_key")


def predict(docs: DataFrame, models: Iterable[Model], held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and n_phrases for each row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, text_key long, lang_pred string, score double, n_phrases long, cost double, total double"
    rows = docs.select("doc_id", held_out.alias("held_out"), F.xxhash64("text").alias("text_key"), "text")
    out = ["doc_id", "held_out", "lang_pred", "score", "n_phrases"]
    parts: list[DataFrame] = []
    for m in models:
        shared = docs.sparkSession.sparkContext.broadcast(m)
        found = rows.mapInArrow(partial(_predict, shared), schema)
        if len(m.languages) == m.n_languages:
            return found.select(*out)
        parts.append(stored(found, "languages"))
        shared.unpersist()
    if not parts:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_phrases"))
    # Rows that repeat have equal results; one of them is enough.
    key = ["doc_id", "held_out", "text_key"]
    best = F.min(F.struct("cost", "lang_pred", "score", "n_phrases", "total")).alias("b")
    per = reduce(DataFrame.union, parts).dropDuplicates([*key, "lang_pred"]).groupBy(*key).agg(best, F.collect_list("total").alias("totals"))
    shares = F.transform("totals", lambda x: F.exp(x - F.array_max("totals")))
    per = per.withColumn("all", F.array_max("totals") + F.log(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))
    return rows.drop("text").join(per.withColumnsRenamed({k: f"_{k}" for k in key}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).select(
        "doc_id", "held_out", "b.lang_pred", (F.col("b.score") * F.exp(F.col("b.total") - F.col("all"))).alias("score"), "b.n_phrases"
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs, fit(docs.filter(~held_out).select("text", "lang")), held_out)
