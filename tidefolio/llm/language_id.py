"""Language identification by interpolated Kneser-Ney character models.

One model of four symbols per language (see ``charlm``) is learned from the rows that
``learn`` selects: four-gram counts of whole texts are added up in the tasks, then over
all of them. All languages' log probabilities lie in one sorted hash array, so a four-gram
is looked up once. The language with the lowest cross-entropy per symbol is chosen. Its score is a
softmax over the languages' cross-entropies times a temperature and the square root of the
length; the temperature is the one of a fixed grid under which the learned rows' own languages
are likeliest. Rejection is calibrated on the learned rows too: a prediction is marked ``rejected`` below the
least score from which on they are wrong at most ``error`` of the time, and where its cross-entropy is more than
a quarter above what all but ``error`` of them keep to (they surprise the models they taught less than others
do), as that of texts in languages that were not learned is.
Below ``reject`` the answer is ``und``.

Scale: two reads of the texts, and counts of at most 64**4 four-grams a language in between:
that bounds what is gathered and sent to the tasks, whatever the corpus. Memory in a task
is bounded by slices of a few megabytes of text, or one text.

Defined results: null texts, and texts without letters, are ``und`` with score 0; so is
everything if nothing can be learned. Rows with a null language teach nothing; a null id counts
as empty text in the fold. Repeated rows are judged alike. Extra columns do not matter;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.charlm import KneserNey, Models, counted, grams, symbols
from tidefolio.llm.common import stored
from tidefolio.llm.words import slices

BUFFER = 4_000_000
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
UNKNOWN = "und"


class _Sums:
    """Counts of n-grams, merged when the buffer is full."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > BUFFER and len(self.keys) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, counts = counted(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return keys, counts


def text_grams(texts: list[str]) -> np.ndarray:
    """The four-grams of all symbols of the texts."""
    code, begin, end = symbols(texts)
    inside = np.zeros(len(code) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    return grams(code)[np.cumsum(inside[:-1]) > 0]


def gram_counts(documents: DataFrame, label: str, text: str) -> DataFrame:
    """``label, gram, n`` over whole texts."""
    kind = documents.schema[label].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, _Sums] = {}
        arrow = None
        for whole in batches:
            arrow = whole.column(0).type
            for batch in slices(whole, 1):
                by_label: dict[object, list[str]] = {}
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if t:
                        by_label.setdefault(k, []).append(t)
                for k, texts in by_label.items():
                    sums.setdefault(k, _Sums()).add(*counted(text_grams(texts)))
        for k, held in sums.items():
            keys, counts = held.merge()
            for low in range(0, len(keys), 50_000):
                part = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(keys[part]), arrow), pa.array(keys[part].astype(np.int64)),
                     pa.array(counts[part].astype(np.int64))], names=[label, "gram", "n"])

    return (documents.select(label, text).mapInArrow(count, f"`{label}` {kind}, gram long, n long")
            .groupBy(label, "gram").agg(F.sum("n").alias("n")))


def learn(documents: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], Models | None]:
    """Languages in order, and their models; gathers the bounded counts."""
    counts = stored(gram_counts(documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), lang, text), "grams")
    table = counts.toArrow()
    names = np.array(table.column(lang).to_pylist(), dtype=object)
    keys, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    langs, models = sorted(set(names.tolist())), []
    for k in langs:
        mine = names == k
        order = np.argsort(keys[mine])
        models.append(KneserNey(keys[mine][order], n[mine][order]))
    return langs, Models(models) if models else None


def entropies(texts: list[str], models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy per symbol by text and language, number of symbols, and whether there is a letter."""
    code, begin, end = symbols(texts)
    logs = models.log_probabilities(grams(code))
    size = end - begin
    out = np.zeros((len(texts), logs.shape[1]))
    rows = np.flatnonzero(size > 0)
    if len(rows):
        edges = np.column_stack([begin[rows], end[rows]]).ravel()
        logs = np.vstack([logs, np.zeros((1, logs.shape[1]), logs.dtype)])
        out[rows] = -np.add.reduceat(logs, edges, axis=0, dtype=np.float64)[::2] / size[rows][:, None]
    # marks count as letters in the model, but a text of marks alone has none
    return out, size, np.array([any(map(str.isalpha, t)) for t in texts], bool)


def identify(documents: DataFrame, learned: Column, held_out: Column, reject: float = 0.0, key: str = "doc_id",
             text: str = "text", lang: str = "lang", error: float = 0.001) -> DataFrame:
    """``key, held_out, lang_pred, score, cross_entropy, rejected`` for every row; starts jobs.

    ``learned`` says which rows teach; no other use is made of ``lang`` or the id.
    """
    langs, models = learn(documents.filter(learned), lang, text)
    if models is None:
        return documents.select(key, held_out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
                                F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    sent = documents.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("struct<h:array<double>,n:int>")
    def judged(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            parts = []
            for part in slices(pa.RecordBatch.from_arrays([array], names=["t"]), 0):
                h, size, letter = entropies([t or "" for t in part.column(0).to_pylist()], sent.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel()))
                size = pa.array(np.where(letter, size, 0), pa.int32())
                parts.append(pa.StructArray.from_arrays([lists, size], names=["h", "n"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(
                [("h", pa.list_(pa.float64())), ("n", pa.int32())]))

    rows = stored(documents.select(F.col(key).alias("_id"), held_out.alias("held_out"), learned.alias("_learned"),
                                   F.col(lang).alias("_lang"), judged(F.col(text)).alias("_j"))
                  .select("_id", "held_out", "_learned", "_lang", "_j.h", "_j.n"), "entropies")
    # least first; array_min of pairs gives the language too
    best = F.array_min("h")
    sharpness = lambda t: F.lit(t) * F.sqrt(F.col("n"))
    top = lambda t: 1 / F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(-(x - best) * sharpness(t)))
    own = F.element_at("h", F.array_position(F.array(*map(F.lit, langs)), F.col("_lang")).cast("int"))
    fits = rows.filter(F.col("_learned") & F.col("_lang").isNotNull() & (F.col("n") > 0)).agg(
        *(F.avg(F.log(top(t)) - (own - best) * sharpness(t)).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    fitted = [(-1e300 if x is None else x) for x in fits]
    chosen = TEMPERATURES[int(np.argmax(fitted))]
    score = F.when(F.col("n") > 0, top(chosen)).otherwise(0.0)
    named = F.element_at(F.array(*map(F.lit, langs)), F.array_position("h", best).cast("int"))
    known = (F.col("n") > 0) & (score >= reject)
    out = rows.select(F.col("_id").alias(key), "held_out", F.when(known, named).otherwise(UNKNOWN).alias("lang_pred"),
                      score.alias("score"), F.when(F.col("n") > 0, best).alias("cross_entropy"), "_learned", "_lang", "n")
    floor, ceiling = _calibrated(out.filter(F.col("_learned") & F.col("_lang").isNotNull() & (F.col("n") > 0)), error)
    rejected = (F.col("n") == 0) | (F.col("score") < floor) | (F.col("cross_entropy") > ceiling)
    return out.select(key, "held_out", "lang_pred", "score", "cross_entropy", F.coalesce(rejected, F.lit(True)).alias("rejected"))


GRID = tuple(i / 100 for i in range(100))
MARGIN = 1.25
LEAST_SYMBOLS = 100  # shorter texts vary too much to set the bound of the cross-entropy


def _calibrated(taught: DataFrame, error: float) -> tuple[float, float]:
    """The least score from which on learned rows are wrong at most ``error`` of the time, and the bound of the cross-entropy."""
    wrong = F.col("lang_pred") != F.col("_lang")
    row = taught.agg(F.percentile_approx(F.when(F.col("n") >= LEAST_SYMBOLS, F.col("cross_entropy")), 1 - error, 100_000).alias("ceiling"),
                     *(F.count_if(F.col("score") >= g).alias(f"n{i}") for i, g in enumerate(GRID)),
                     *(F.count_if((F.col("score") >= g) & wrong).alias(f"w{i}") for i, g in enumerate(GRID))).first()
    good = [g for i, g in enumerate(GRID) if row[f"w{i}"] <= error * row[f"n{i}"]]
    return min(good, default=1.0), float("inf") if row.ceiling is None else MARGIN * float(row.ceiling)
