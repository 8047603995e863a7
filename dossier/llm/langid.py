"""Language identification with one interpolated Kneser-Ney character model per language.

Training counts character n-grams inside letter words (the word is framed by blanks, contexts stop at its start) over a
bounded sample of labelled rows: of each of the ``MAX_LANGS`` most frequent languages at most ``rows_per_lang`` different rows,
those with the least hashes of id and text. Four fifths of the sample fit the models, the rest calibrates them; where the rest
has fewer than ``HELD`` rows, each fifth is measured under models of the other four instead. The models are kept as sorted hash arrays, one for each order, with a column of
log-probabilities and of back-off weights for each language, so one binary search serves all languages.

A text gets the language of the lowest cross-entropy per character. ``score`` is a softmax of the length-normalised
cross-entropies whose temperature is fitted on the calibration rows. A text is rejected when it has no letter, or when its
cross-entropy is above the limit of its language and length. Limits come from the calibration rows, which are cut into pieces
of each class of ``LENGTHS`` letters: a limit is the quantile of the pieces' cross-entropies that the share ``REJECT`` of them
exceeds. Between classes, a text takes the limit of the longest class that it reaches, so it is judged as a shorter one.

Defined results: null, empty or letterless text (letters are what Unicode calls so: no digits, fractions or circled numbers):
``und``, score 0, rejected. No labelled row at all: every text is ``und``. Rows without an id, or of one id, are told apart by
their texts; rows equal in both count once in the sample. Repeated rows and extra columns pass through unchanged; whole texts are read, whatever their length; of languages that fit
equally well the first by name is taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import mix64, table

_WORD = re.compile(r"[^\W\d_]+")
ORDER, ROWS_PER_LANG, REJECT, MAX_LANGS, HELD, FOLDS = 5, 300, 0.001, 256, 20, 5
#: Classes of length, in letters and word ends: cross-entropies vary less the longer the text.
LENGTHS = (1, 8, 16, 32, 64, 128, 256, 512)
SCHEMA = "lang string, score double, cross_entropy double, n_letters long, rejected boolean"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """langs: the columns of the arrays. keys[m], logp[m], loglam[m]: order m + 1; NaN where a language lacks the n-gram."""

    langs: list[str] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    loglam: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LENGTHS))))
    temperature: float = 1.0


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def _letters(words) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the framed words in a row, and where each word starts."""
    text = " " + "  ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, np.cumsum(sizes) - sizes


def _grams(codes: np.ndarray, starts: np.ndarray, order: int):
    """For each order, the hash of the n-gram that ends at each place, and whether it lies inside one word."""
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    h = np.zeros(len(codes), np.uint64)
    for m in range(1, order + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[m - 1 :] = codes[: max(0, len(codes) - m + 1)]
        h = h + (shifted + np.uint64(1)) * _BASE ** np.uint64(m)
        yield m, mix64(h + np.uint64(m)), place


def _kneser_ney(words: list[str], weights: np.ndarray, order: int):
    """(sorted keys, log-probability, log back-off weight) for each order of one language, and its log floor."""
    codes, starts = _letters(words)
    w = np.repeat(weights, np.diff(np.append(starts, len(codes)))).astype(np.float64)
    tables, previous = [], None
    for m, h, place in _grams(codes, starts, order):
        inside = (place >= m - 1) & (place >= 1)
        at = np.flatnonzero(inside)
        keys, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
        i = at[first]
        tables.append(
            {
                "keys": keys,
                "raw": np.bincount(inverse, w[at], len(keys)),
                "start": place[i] == m - 1,
                "context": previous[i - 1] if m > 1 else np.zeros(len(i), np.uint64),
                "suffix": previous[i] if m > 1 else None,
            }
        )
        previous = h
    floor = -np.log(len(tables[0]["keys"]) + 1.0)
    out, below = [], None
    for m, t in enumerate(tables, 1):
        count = t["raw"]
        if m < order:  # types of one more letter to the left, except where a word starts
            longer = tables[m]
            kinds = np.bincount(np.searchsorted(t["keys"], longer["suffix"]), minlength=len(t["keys"])).astype(float)
            count = np.where(t["start"] | (kinds == 0), count, kinds)
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        contexts, group = np.unique(t["context"], return_inverse=True)
        total, types = np.bincount(group, count), np.bincount(group)
        lam = discount * types / total
        lower = np.exp(floor) if m == 1 else np.exp(below[np.searchsorted(tables[m - 2]["keys"], t["suffix"])])
        below = np.log(np.maximum(count - discount, 0) / total[group] + lam[group] * lower)
        out.append((t["keys"], below, contexts, np.log(lam)))
    return out, floor + out[0][3][0]


def _stack(parts: dict[str, tuple], order: int) -> Model:
    """One sorted array of keys for each order, languages as columns."""
    langs = sorted(parts)
    model = Model(langs, floor=np.array([parts[x][1] for x in langs]))
    for m in range(order):
        tables = [parts[x][0][m] for x in langs]
        after = [parts[x][0][m + 1] if m + 1 < order else None for x in langs]
        keys = np.unique(np.concatenate([t[0] for t in tables] + [a[2] for a in after if a is not None]))
        logp, loglam = (np.full((len(keys), len(langs)), np.nan, np.float32) for _ in range(2))
        for c, (t, a) in enumerate(zip(tables, after, strict=True)):
            logp[np.searchsorted(keys, t[0]), c] = t[1]
            if a is not None:
                loglam[np.searchsorted(keys, a[2]), c] = a[3]
        model.keys.append(keys)
        model.logp.append(logp)
        model.loglam.append(loglam)
    return model


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Natural-log probability of each word (its end included) under each language."""
    codes, starts = _letters(words)
    total = np.repeat(model.floor[None, :], len(codes), 0)
    back = None
    for m, h, place in _grams(codes, starts, len(model.keys)):
        keys = model.keys[m - 1]
        if not len(keys):  # the sample has no word so long
            break
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        found = (keys[at] == h) & (place >= m - 1)
        if m > 1:  # the context is the n-gram of the order below that ends one place before
            lam = np.vstack([np.zeros((1, len(model.langs)), np.float32), back[:-1]])
            total = total + np.where((place >= m - 1)[:, None], lam, 0)
        logp = np.where(found[:, None], model.logp[m - 1][at], np.nan)
        total = np.where(np.isnan(logp), total, logp)
        back = np.where(found[:, None], np.nan_to_num(model.loglam[m - 1][at]), 0)
    total[starts] = 0  # the blank in front is given
    return np.add.reduceat(total, starts, axis=0)


def entropies(model: Model, texts: list[str | None], chunk: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in nats a letter (word ends count) for each text and language, and the letters and word ends of each text."""
    ce, letters = np.full((len(texts), max(1, len(model.langs))), np.inf), np.zeros(len(texts), np.int64)
    rows, found, size = [], [], 0

    def flush() -> None:
        nonlocal rows, found, size
        if found:
            ids, unique = pd.factorize(np.array([w for ws in found for w in ws], object))
            scores, sizes = word_scores(model, list(unique)), np.fromiter(map(len, unique), np.int64, len(unique)) + 1
            starts = np.cumsum([0, *map(len, found)])[:-1]
            n = np.add.reduceat(sizes[ids], starts)
            ce[rows] = -np.add.reduceat(scores[ids], starts, axis=0) / n[:, None]
            letters[rows] = n
        rows, found, size = [], [], 0

    for i, text in enumerate(texts):
        if text and model.langs and (ws := letter_words(text)):
            rows.append(i)
            found.append(ws)
            size += len(text)
            if size >= chunk:
                flush()
    flush()
    return ce, letters


def length_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(LENGTHS), np.maximum(n, 1), "right") - 1


def decide(model: Model, texts: list[str | None]) -> pd.DataFrame:
    """The columns of SCHEMA for each text."""
    ce, n = entropies(model, texts)
    best = ce.argmin(1)
    some = n > 0
    logits = np.where(some[:, None], -model.temperature * ce * np.sqrt(np.maximum(n, 1))[:, None], 0.0) if model.langs else np.zeros_like(ce)
    top = 1 / np.exp(logits - logits.max(1, keepdims=True)).sum(1)
    least = ce[np.arange(len(ce)), best]
    far = some & (least > model.limit[best, length_class(n)]) if model.langs else ~some
    return pd.DataFrame(
        {
            "lang": [model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)],
            "score": np.where(some, top, 0.0),
            "cross_entropy": pd.Series(np.where(some, least, 0.0)).where(some, None),
            "n_letters": n,
            "rejected": ~some | far,
        }
    )


def pieces(text: str, size: int) -> list[str]:
    """The words of a text in consecutive pieces of at least `size` letters and word ends."""
    out, now, n = [], [], 0
    for w in letter_words(text):
        now.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(" ".join(now))
            now, n = [], 0
    return out


def calibrate(model: Model, parts: list[tuple[Model, list[str], list[str]]], reject: float = REJECT) -> Model:
    """Sets the temperature, and the limits of each language and length. parts: texts and their languages, and models that have not seen them."""
    model.limit = np.full((len(model.langs), len(LENGTHS)), np.inf)
    logits, truth = [], []
    for other, texts, langs in parts:
        ce, n = entropies(other, texts)
        rows = np.flatnonzero((n > 0) & np.isin(np.array(langs, object), other.langs))
        scaled = np.full((len(rows), len(model.langs)), np.inf)
        scaled[:, [model.langs.index(x) for x in other.langs]] = ce[rows] * np.sqrt(n[rows])[:, None]
        logits.append(-scaled)
        truth += [model.langs.index(langs[i]) for i in rows]
    if not truth:
        return model
    every, loss = np.concatenate(logits), {}
    for t in 0.05 * 2.0 ** np.arange(12):
        z = t * every
        z = z - z.max(1, keepdims=True)
        loss[t] = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean()
    model.temperature = float(min(loss, key=loss.get))
    for c, lang in enumerate(model.langs):
        for k, size in enumerate(LENGTHS):
            found = np.concatenate([entropies(other, [p for t, x in zip(texts, langs, strict=True) if x == lang for p in pieces(t, size)])[0][:, other.langs.index(lang)] for other, texts, langs in parts if lang in other.langs] or [np.zeros(0)])
            if len(found) * reject >= 1:
                model.limit[c, k] = np.quantile(found, 1 - reject, method="higher")
            elif k:  # too few pieces to know the quantile: judged as shorter ones
                model.limit[c, k] = model.limit[c, k - 1]
            elif len(found):
                model.limit[c, k] = found.max()
    return model


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_lang: int = ROWS_PER_LANG) -> pd.DataFrame:
    """(lang, place, text): at most rows_per_lang rows of each of at most MAX_LANGS languages, in the order of their hashes."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("place"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("different")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return pd.DataFrame(columns=["lang", "place", "text"])
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 3 * rows_per_lang / r["different"])))])
    near = rows.where(F.pmod("place", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)  # about three times as many as needed
    ranked = near.select("lang", "place").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1_000_000)), "place")))
    chosen = ranked.where(F.col("rank") <= rows_per_lang).drop("rank")
    found = near.join(F.broadcast(chosen), ["lang", "place"]).groupBy("lang", "place").agg(F.first("text").alias("text"))  # MAX_LANGS times rows_per_lang rows
    return found.toPandas().sort_values(["lang", "place"], ignore_index=True)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_lang: int = ROWS_PER_LANG, order: int = ORDER, reject: float = REJECT) -> Model:
    """Fit on a bounded sample of labelled rows, read whole."""
    found = sample(labelled, id_col, text_col, lang_col, rows_per_lang)
    fold_ = found["place"].to_numpy(np.int64) // 7 % FOLDS

    def model_of(rows: pd.DataFrame) -> Model:
        parts = {}
        for lang, own in rows.groupby("lang"):
            words = pd.Series([w for t in own["text"] for w in letter_words(t)], dtype=object).value_counts(sort=False).sort_index()
            if len(words):
                parts[lang] = _kneser_ney(list(words.index), words.to_numpy(), order)
        return _stack(parts, order) if parts else Model()

    def part(i: int, other: Model) -> tuple[Model, list[str], list[str]]:
        own = found[fold_ == i]
        return other, own["text"].tolist(), own["lang"].tolist()

    if (fold_ == 0).sum() >= HELD:
        model = model_of(found[fold_ != 0])
        return calibrate(model, [part(0, model)], reject) if model.langs else model
    model = model_of(found)
    return calibrate(model, [part(i, other) for i in range(FOLDS) if (other := model_of(found[fold_ != i])).langs], reject) if model.langs else model


def identify(model: Model, text: Column, spark) -> Column:
    """Struct column (SCHEMA) for a text column; the model is broadcast, its size bounded by the training sample."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return decide(shared.value, texts.tolist())

    return predict(text)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2), "doc_id", "text", "lang")
    found = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), identify(model, F.col("text"), spark).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.col("r.cross_entropy").alias("cross_entropy"), F.col("r.rejected").alias("rejected"))
