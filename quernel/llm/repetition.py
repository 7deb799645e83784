"""How much of a document repeats what the same document said before.

The share is exact: a place is repeated if the run of ``run`` units that starts there has occurred before in the text;
the units that such runs cover, over all units. Runs are told apart by dense ranks of pairs, pairs of pairs and so on
(doubling), for all texts of a batch at once, so a text of any length takes O(n log n).

Most texts need no such measure. The *score* of a text is the same share with runs told apart by a hash into a table
only, in one pass without a sort: collisions can only add to it, so it is never below the share. ``screened`` measures
the texts whose score reaches the cutoff of their stratum.

Cutoffs on the score are chosen under risk control: for a labelled holdout, per stratum, the exact upper binomial bound
of the share of good documents that a cutoff would take for bad ones must stay below a limit, for all strata and cutoffs
together (Bonferroni). The lowest cutoff that does is the stratum's. Labels come from the exact measure of whole texts.
A cutoff is never above the share that is asked for, which the score bounds from above, so none loses a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.functions.arrow import text_parts
from quernel.plans.shape import spread

#: Units of a run, in texts of words and in texts of Han or kana letters.
WORD_RUN, LETTER_RUN = 4, 8
#: Text of the rows that are measured at once.
PART_BYTES = 1 << 20
#: Slots of the score's table for each unit.
SLOTS = 32
#: Odd multipliers of the units of a run.
_FACTORS = np.random.default_rng(0).integers(1, 2**62, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Lengths in code points from which a text is of middle size, and long.
MIDDLE, LONG = 400, 2000
_words = regex.compile(r"\p{L}+").findall
_han_kana = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+").findall


class _Numbers(dict):
    """A number for each word, from 0."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def units(text: str) -> tuple[bool, list[str] | str]:
    """(whether each letter is a unit, the units of ``text`` in lower case)."""
    words = _words(text.lower())
    if not text.isascii():
        letters = "".join(words)
        if 2 * sum(map(len, _han_kana(letters))) > len(letters):
            return True, letters
    return False, words


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]


def covered(ids: np.ndarray, lengths: np.ndarray, run: int) -> np.ndarray:
    """For each text (its unit ids stand end to end in ``ids``), the units covered by repeated runs; run is 2**m."""
    out = np.zeros(len(lengths), np.int64)
    if len(ids) < run:
        return out
    doc = np.repeat(np.arange(len(lengths)), lengths)
    code, step = np.unique(ids, return_inverse=True)[1], 1
    while step < run:
        code = _dense(code[:-step], code[step:])
        step *= 2
    same_text = doc[: len(code)] == doc[run - 1 :]
    at = np.flatnonzero(same_text)
    key = doc[at] * (int(code.max()) + 1) + code[at]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(at), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    return _spans(at[later], run, doc, len(lengths))


_table = np.empty(0, np.int32)


def scored(ids: np.ndarray, lengths: np.ndarray, run: int) -> np.ndarray:
    """An upper bound of ``covered``: runs of one slot of a hash table count as equal."""
    global _table
    out = np.zeros(len(lengths), np.int64)
    if len(ids) < run:
        return out
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(doc[: len(ids) - run + 1] == doc[run - 1 :])
    if not len(at):
        return out
    bits = max(10, int(SLOTS * len(at) - 1).bit_length())
    if len(_table) < 1 << bits:
        _table = np.empty(1 << bits, np.int32)
    units, h = ids.astype(np.uint64), doc[at].astype(np.uint64) * _FACTORS[8]
    for j in range(run):
        h += units[at + j] * _FACTORS[j % 8]
        h ^= h >> np.uint64(29)
        h *= _FACTORS[(j + 3) % 8]
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    place = np.arange(len(at), dtype=np.int32)
    _table[slot[::-1]] = place[::-1]  # the last write of a slot is its first place; slots not written are not read
    return _spans(at[_table[slot] != place], run, doc, len(lengths))


def _spans(starts: np.ndarray, run: int, doc: np.ndarray, n: int) -> np.ndarray:
    """Units of each text that lie in runs from ``starts``."""
    depth = np.zeros(len(doc) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + run, -1)
    return np.bincount(doc[np.cumsum(depth[:-1]) > 0], minlength=n)


def stratum_of(n_chars: int, by_letter: bool) -> str:
    """One of six strata: texts of words or of letters, by length."""
    return f"{'letters' if by_letter else 'words'}-{'short' if n_chars < MIDDLE else 'middle' if n_chars < LONG else 'long'}"


STRATA = tuple(stratum_of(n, by_letter) for by_letter in (False, True) for n in (0, MIDDLE, LONG))


def measure_texts(texts: Sequence[str | None], cutoffs: Mapping[str, float] | None = None) -> dict[str, np.ndarray]:
    """n_units, n_repeated and by_letter of each text; no units where it is NULL or has no letters.

    With ``cutoffs`` also n_scored, and n_repeated is -1 where n_scored / n_units is below the stratum's cutoff.
    """
    n_units, repeated, by_letter = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    score = np.zeros(len(texts), np.int64)
    numbers = _Numbers()
    found: dict[bool, tuple[list[int], list[np.ndarray]]] = {False: ([], []), True: ([], [])}
    for i, text in enumerate(texts):
        if not text:
            continue
        letters, parts = units(text)
        ids = np.frombuffer(parts.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) if letters else np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts))
        n_units[i], by_letter[i] = len(ids), letters
        found[letters][0].append(i)
        found[letters][1].append(ids)
    for letters, run in ((False, WORD_RUN), (True, LETTER_RUN)):
        at, ids = np.array(found[letters][0], np.int64), found[letters][1]
        if not len(at):
            continue
        lengths = np.array([len(x) for x in ids])
        joined = np.concatenate(ids)
        if cutoffs is None:
            repeated[at] = covered(joined, lengths, run)
            continue
        score[at] = scored(joined, lengths, run)
        least = np.array([cutoffs[stratum_of(len(texts[i]), letters)] for i in at])
        take = score[at] >= least * lengths
        repeated[at] = -1
        if take.any():
            repeated[at[take]] = covered(joined[np.repeat(take, lengths)], lengths[take], run)
    return {"n_units": n_units, "n_repeated": repeated, "by_letter": by_letter, "n_scored": score}


def _measured(df: DataFrame, id_columns: Sequence[str], text: str, cutoffs: Mapping[str, float] | None) -> DataFrame:
    names = ("n_units", "n_repeated", "by_letter", *(("n_scored",) if cutoffs is not None else ()))
    kinds = {"by_letter": T.BooleanType()}
    schema = T.StructType([*(df.schema[c] for c in id_columns), T.StructField("n_chars", T.LongType()), *(T.StructField(n, kinds.get(n, T.LongType())) for n in names)])
    arrow_schema = to_arrow_schema(schema)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, len(id_columns), PART_BYTES):
                texts = part.column(part.num_columns - 1)
                found = measure_texts(texts.to_pylist(), cutoffs)
                arrays = [*part.columns[: len(id_columns)], pc.utf8_length(texts), *(pa.array(found[n]) for n in names)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow_schema, strict=True)], schema=arrow_schema)

    return spread(df.select(*id_columns, F.col(text).alias("_text"))).mapInArrow(measured, schema)


def _share(of: str) -> Column:
    return F.when(F.col("n_units") > 0, F.col(of) / F.col("n_units")).otherwise(F.lit(0.0))


def repetition(df: DataFrame, id_columns: Sequence[str], text: str) -> DataFrame:
    """``id_columns``, n_chars, n_units, n_repeated, by_letter and share of each row.

    n_chars is in code points, NULL for NULL; the share is 0 for a text without units (NULL, empty, blank, no letters).
    Rows come out as often as they go in. One pass without a shuffle; other columns are not read.
    """
    return _measured(df, id_columns, text, None).withColumn("share", _share("n_repeated"))


def screened(df: DataFrame, id_columns: Sequence[str], text: str, cutoffs: Mapping[str, float]) -> DataFrame:
    """Like ``repetition``, with stratum and score; share and n_repeated are NULL where the score is below the stratum's cutoff.

    ``cutoffs`` has all of ``STRATA``. The score is at least the share: a share that reaches the cutoff is always there.
    """
    size = F.when(F.coalesce("n_chars", F.lit(0)) < MIDDLE, "short").when(F.col("n_chars") < LONG, "middle").otherwise("long")
    found = _measured(df, id_columns, text, dict(cutoffs)).withColumns({"stratum": F.concat(F.when(F.col("by_letter"), "letters-").otherwise("words-"), size), "score": _share("n_scored")})
    return found.withColumn("n_repeated", F.when(F.col("n_repeated") >= 0, F.col("n_repeated"))).withColumn("share", F.when(F.col("n_repeated").isNotNull(), _share("n_repeated"))).drop("n_scored")


def upper_bound(k: int, n: int, risk: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a binomial share with ``k`` of ``n`` seen, at confidence 1 - risk."""
    if n == 0 or k >= n:
        return 1.0

    def tail(p: float) -> float:  # P(X <= k)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid >= 1 or tail(mid) <= risk:
            high = mid
        else:
            low = mid
    return high


@dataclass(frozen=True)
class Cutoff:
    """A stratum's cutoff, the good documents of the holdout behind it, and the bound of the share of them that it takes for bad ones."""

    cutoff: float
    n_good: int
    bound: float


def risk_controlled_cutoffs(holdout: Mapping[str, Sequence[tuple[float, bool]]], grid: Sequence[float], limit: float, alpha: float = 0.02, delta: float = 0.05) -> dict[str, Cutoff]:
    """A cutoff on the score for each stratum of ``holdout``: (score, whether the document is good) by stratum.

    The lowest of ``grid`` at which at most ``alpha`` of good documents are taken for bad ones (score >= cutoff), with
    confidence 1 - ``delta`` for all strata and cutoffs together. Cutoffs above ``limit`` are not tried: ``limit`` is
    the cutoff of a stratum in which none is certain enough, with the bound that it has.
    """
    tried = sorted({c for c in grid if c < limit} | {limit})
    risk = delta / max(1, len(tried) * len(holdout))
    chosen = {}
    for stratum, rows in holdout.items():
        good = np.sort([score for score, is_good in rows if is_good])
        bounds = [upper_bound(len(good) - int(np.searchsorted(good, c)), len(good), risk) for c in tried]
        i = next((i for i, b in enumerate(bounds) if b <= alpha), len(tried) - 1)
        chosen[stratum] = Cutoff(tried[i], len(good), bounds[i])
    return chosen


def _order(id_column: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_column)


def holdout_ids(documents: DataFrame, id_column: str, size: int, seed: int = 0) -> DataFrame:
    """Rows of ``documents`` in the holdout: ``size`` or half of them at most, those of the lowest seeded hashes of their ids.

    Rows are counted first, so that only those of a low hash are put in order.
    """
    n = documents.count()
    size = min(size, n // 2)
    order = F.pmod(_order(id_column, seed), F.lit(1 << 40))
    low = documents.where(order < int((1 << 40) * min(1.0, 1.2 * size / max(1, n)) + 1)) if size > 1000 else documents
    return low.orderBy(order, id_column).limit(size)


def labelled_holdout(documents: DataFrame, id_column: str, text: str, least_share: float, size: int, seed: int = 0) -> dict[str, list[tuple[float, bool]]]:
    """(score, good) by stratum for ``size`` documents at most, drawn by a seeded hash from texts that have any.

    A document is good if the exact share of its whole text is below ``least_share``. Only ``size`` scores and labels
    come to the driver.
    """
    drawn = holdout_ids(documents.where(F.length(text) > 0).select(id_column, text), id_column, size, seed)
    measured = screened(drawn, [id_column], text, dict.fromkeys(STRATA, 0.0))
    out: dict[str, list[tuple[float, bool]]] = {}
    for r in measured.select("stratum", "score", "share").collect():
        out.setdefault(r["stratum"], []).append((r["score"], r["share"] < least_share))
    return out


def cutoff_report(documents: DataFrame, id_column: str, text: str, cutoffs: Mapping[str, Cutoff], least_share: float, size: int, seed: int = 0) -> DataFrame:
    """What the cutoffs do to the documents outside the holdout, a row per stratum, by the exact measure of all of them.

    Columns: stratum, cutoff, n_good_holdout, bound (1 without a holdout), n_good, n_good_taken, n_bad, n_bad_taken.
    """
    rows = documents.where(F.length(text) > 0).select(id_column, text)
    held = holdout_ids(rows, id_column, size, seed).select(F.col(id_column).alias("_held"))
    others = rows.join(F.broadcast(held), F.col(id_column) == F.col("_held"), "left_anti")  # size rows of one column
    measured = screened(others, [id_column], text, dict.fromkeys(STRATA, 0.0))
    table = [(s, c.cutoff, c.n_good, c.bound) for s, c in cutoffs.items()]
    known = documents.sparkSession.createDataFrame(table, "stratum string, cutoff double, n_good_holdout long, bound double")
    taken, good = F.col("score") >= F.col("cutoff"), F.col("share") < least_share
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).alias(n)
    counted = measured.join(F.broadcast(known), "stratum").groupBy("stratum").agg(count(good, "n_good"), count(good & taken, "n_good_taken"), count(~good, "n_bad"), count(~good & taken, "n_bad_taken"))
    return known.join(counted, "stratum", "left").fillna(0, ["n_good", "n_good_taken", "n_bad", "n_bad_taken"])


def repeats_by_definition(text: str | None, least_chars: int = 80, least_share: float = 0.35) -> bool:
    """Whether a text is one that mostly repeats itself, straight from the definition; slow, for labels and tests."""
    if text is None or len(text) < least_chars:
        return False
    letters, parts = units(text)
    run = LETTER_RUN if letters else WORD_RUN
    seen, hit = set(), [False] * len(parts)
    for i in range(len(parts) - run + 1):
        key = tuple(parts[i : i + run])
        if key in seen:
            hit[i : i + run] = [True] * run
        seen.add(key)
    return bool(parts) and sum(hit) / len(parts) >= least_share
