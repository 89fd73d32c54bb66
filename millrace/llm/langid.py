"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to the longest
character n-grams of it that are known (with word boundaries), 5 down to 1. A document's scores
are summed over its words; the softmax over languages gives the prediction's score.

The model is fitted on a sample of labelled rows with a documented bound for each language, so a
rare language is learnt from as many rows as it has and the model's size is bounded whatever the
corpus; only then is it broadcast. Every word and n-gram of the sample counts. Every document is
scored whole.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import texts
from .common import crc_fold, kept, saved

WORD = re.compile(r"[^\W\d_]+")
#: Bound of the fit: labelled rows of each language (expected).
ROWS_PER_LANGUAGE = 2_000
LONGEST = 5
#: Bytes of blank-free tokens that a worker remembers with their scores; a full memo is emptied.
MEMO_BYTES = 64_000_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. What else the pattern takes for word characters (fractions, superscripts) parts words."""
    out = []
    for w in WORD.findall(text.lower()):
        out += [w] if w.isalpha() else ["".join(run) for letters, run in groupby(w, str.isalpha) if letters]
    return out


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]  # their rows in the first table
    grams: list[dict[str, int]]  # by length - 1; their rows in the other tables
    tables: list[np.ndarray]

    def word(self, w: str) -> np.ndarray:
        at = self.words.get(w)
        if at is not None:
            return self.tables[0][at]
        marked = f"^{w}$"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            known = self.grams[n - 1]
            found = [r for i in range(len(marked) - n + 1) if (r := known.get(marked[i : i + n])) is not None]
            if found:
                return self.tables[n][found].mean(axis=0)
        return np.zeros(len(self.langs))


def log_frequencies(table: np.ndarray) -> np.ndarray:
    """Log relative frequency in each language (a column) with half a count added, centred over languages."""
    logs = np.log((table + 0.5) / (table + 0.5).sum(axis=0))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def sampled(df: DataFrame, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """text, lang: distinct labelled texts, about ``per_language`` at most of each language, chosen by a hash."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # A row for each language.
    shares = saved(rows.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count(F.lit(1))).alias("share")), "shares")
    dealt = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))
    return rows.join(F.broadcast(shares), "lang").filter(dealt < F.col("share") * (1 << 30)).select("text", "lang").distinct()


def fit(train: DataFrame) -> Model | None:
    """train: text, lang of the bounded sample. None without a labelled word."""

    def count(batches):
        import pyarrow as pa

        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            for data, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for w in words_of(data.decode("utf-8", "replace")):
                    total[w, lang] = total.get((w, lang), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "lang", "n"])

    rows = train.select("text", "lang").mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    if not len(rows):
        return None
    listed, lang, n = rows.column("word").to_pylist(), rows.column("lang").to_pylist(), rows.column("n").to_numpy()
    langs = sorted(set(lang))
    words = {w: i for i, w in enumerate(sorted(set(listed)))}
    counts = np.zeros((len(words), len(langs)))
    counts[[words[w] for w in listed], [langs.index(x) for x in lang]] = n
    grams, tables = [], [log_frequencies(counts)]
    for size in range(1, LONGEST + 1):
        known: dict[str, int] = {}
        at, of = [], []
        for i, w in enumerate(words):
            marked = f"^{w}$"
            for k in range(len(marked) - size + 1):
                at.append(known.setdefault(marked[k : k + size], len(known)))
                of.append(i)
        table = np.stack([np.bincount(at, counts[of, c], minlength=len(known)) for c in range(len(langs))], axis=1) if at else np.zeros((0, len(langs)))
        grams.append(known)
        tables.append(log_frequencies(table))
    return Model(langs, words, grams, tables)


class Scorer:
    """Sums word scores over whole texts, with a memo of tokens."""

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.langs) + 1
        self.reset()

    def reset(self) -> None:
        self.rows, self.held, self.at, self.table = 0, 0, {}, np.zeros((4096, self.width))

    def row(self, token: bytes) -> int:
        words = words_of(token.decode("utf-8", "replace"))
        if self.rows == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        r = self.table[self.rows]
        for w in words:
            r[:-1] += self.model.word(w)
        r[-1] = len(words)
        self.at[token] = self.rows
        self.rows += 1
        self.held += len(token) + 150 + 8 * self.width
        return self.rows - 1

    def score(self, data: bytes) -> tuple[str, float]:
        if self.held > MEMO_BYTES:
            self.reset()
        tokens, at = data.split(), self.at
        index = [at[t] if t in at else self.row(t) for t in tokens]
        total = self.table[index].sum(axis=0) if index else np.zeros(self.width)
        if not total[-1]:
            return UNKNOWN, 0.0
        logs = total[:-1]
        best = int(np.argmax(logs))
        return self.model.langs[best], float(1.0 / np.exp(logs - logs[best]).sum())


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Learns from rows whose CRC-32 of the id as text is not 0 modulo 5 (a null id counts as held
    out) and whose language is not null. Text that is null or has no letter is ``und`` with
    score 0, and so is all text where no labelled word exists. Of a text with several languages
    each counts. Ties go to the language that sorts first. Repeated rows get equal results. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    held = crc_fold(F.col(id_col)) == 0
    model = fit(sampled(df.filter(~held), text_col, lang_col, per_language))
    shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = StructType([*df.select(F.col(id_col), held.alias("held_out")).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        import pyarrow as pa

        scorer = kept("language", token, lambda: Scorer(shared.value)) if shared.value else None
        for batch in batches:
            out = [scorer.score(data) if scorer else (UNKNOWN, 0.0) for data in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                                             names=[id_col, "held_out", "lang_pred", "score"])

    return df.select(F.col(id_col), held.alias("held_out"), F.col(text_col)).mapInArrow(run, schema)
