"""Language identification with words first and shorter and shorter n-grams behind them."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm.common import TwoGenerations, checkpointed, held_out, map_batches, table

#: The model is fitted on about so many labelled rows at most.
FIT_ROWS = 10_000
LONGEST_GRAM = 5
#: What a language loses for a word or n-gram that it never showed.
PENALTY = 7.0
#: Bytes of one generation of a worker's memo.
MEMO_BYTES = 52 << 20
#: Costs are kept as integers, in so many parts of one.
SCALE = 1 << 20
UNDETERMINED = "und"
#: A letter, and what letters and their marks follow it; numerals and digits are no letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SEGMENT = 1 << 20


def words(text: str) -> Iterator[list[str]]:
    """Lower-case words of a whole text, a segment at a time; a segment ends where no word does."""
    start = 0
    while start < len(text):
        end = min(len(text), start + SEGMENT)
        while end < len(text) and unicodedata.category(text[end])[0] in "LM":
            end += 1
        yield WORD.findall(text[start:end].lower())
        start = end


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


LANE = 64
LANE_MASK = (1 << LANE) - 1


def pack(costs) -> int:
    """Costs as one integer, a lane of 64 bits for each language, so that sums of costs are exact in any order."""
    return sum(round(float(c) * SCALE) << LANE * i for i, c in enumerate(costs))


def mean(packed: list[int], languages: int) -> int:
    """The mean of packed costs, lane by lane, to the nearest."""
    n, total = len(packed), sum(packed)
    if n == 1:
        return total
    return sum(((total >> LANE * i & LANE_MASK) + n // 2) // n << LANE * i for i in range(languages))


class Units(dict):
    """Packed costs of the words, or of the n-grams of one length. A language that never showed a unit has the penalty there.
    Few costs differ, so units share them, also in a worker: a model of many units is little more than their names."""

    def __init__(self, units: list[str], at: np.ndarray, values: list[int]):
        super().__init__(zip(units, map(values.__getitem__, at.tolist()), strict=True))

    @staticmethod
    def of(units: list[str], langs: np.ndarray, costs: np.ndarray, languages: int) -> "Units":
        unseen, most, packed = pack([PENALTY] * languages), round(PENALTY * SCALE), {}
        for unit, lang, cost in zip(units, langs.tolist(), np.rint(costs * SCALE).astype(np.int64).tolist(), strict=True):
            packed[unit] = packed.get(unit, unseen) - (most - cost << LANE * lang)
        place: dict[int, int] = {}
        at = np.fromiter((place.setdefault(v, len(place)) for v in packed.values()), np.int32, len(packed))
        return Units(list(packed), at, list(place))

    def __reduce__(self):
        place: dict[int, int] = {}
        at = np.fromiter((place.setdefault(v, len(place)) for v in self.values()), np.int32, len(self))
        return Units, (list(self), at, list(place))


class Model:
    """languages: in order; costs: Units by their length in characters (0: words)."""

    def __init__(self, languages: list[str], costs: list[Units]):
        self.languages, self.costs = languages, costs
        self.memo = TwoGenerations(self.cost, MEMO_BYTES)
        self.unheard = pack([PENALTY] * len(languages))

    def __reduce__(self):
        return Model, (self.languages, self.costs)

    def cost(self, word: str) -> int:
        """Known words cost their negative log frequency; else the longest known n-grams' mean; packed."""
        known = self.costs[0].get(word)
        if known is not None:
            return known
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            of = self.costs[n]
            found = [of[g] for g in grams(word, n) if g in of]
            if found:
                return mean(found, len(self.languages))
        return self.unheard

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = 0, 0
        for part in words(text or ""):
            n += len(part)
            total += sum(map(self.memo.__getitem__, part))
        if not n or not self.languages:
            return UNDETERMINED, 0.0
        mean = np.frombuffer(total.to_bytes(8 * len(self.languages), "little"), "<u8") / (SCALE * n)
        best = int(np.argmin(mean))
        # The languages' shares if a word's costs were drawn from the mean, in base 10 as the costs are.
        return self.languages[best], float(1 / np.sum(10.0 ** np.clip(mean[best] - mean, -300, 0)))


def train(labelled: DataFrame, row_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows (columns row_id, text, lang), drawn by a hash of row_id."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    known = known.where(F.pmod(F.xxhash64(F.lit(5), row_id), F.lit(max(n, 1))) < fit_rows).select("text", "lang")

    def units(batch: pa.RecordBatch):
        said: dict[str, Counter[str]] = {}
        for text, lang in zip(batch["text"], batch["lang"].to_pylist(), strict=True):
            for part in words(text.as_py()):
                said.setdefault(lang, Counter()).update(part)
        for lang, of_words in said.items():
            yield {"lang": [lang] * len(of_words), "n": [0] * len(of_words), "unit": list(of_words), "k": list(of_words.values())}
            for n in range(1, LONGEST_GRAM + 1):
                of_grams: Counter[str] = Counter()
                for word, k in of_words.items():
                    for gram in grams(word, n):
                        of_grams[gram] += k
                yield {"lang": [lang] * len(of_grams), "n": [n] * len(of_grams), "unit": list(of_grams), "k": list(of_grams.values())}

    counted = map_batches(known, units, "lang string, n int, unit string, k long").groupBy("lang", "n", "unit").agg(F.sum("k").alias("k"))
    totals = counted.groupBy("lang", "n").agg(F.sum("k").alias("total"))
    cost = F.least(F.lit(PENALTY), -F.log10(F.col("k") / F.col("total"))).alias("cost")
    # As large as the bounded sample's texts make it: nothing of them is left out.
    kept = checkpointed(counted.join(F.broadcast(totals), ["lang", "n"]).select("lang", "n", "unit", cost))
    languages = [r["lang"] for r in kept.select("lang").distinct().orderBy("lang").collect()]
    place = {lang: i for i, lang in enumerate(languages)}
    costs = []
    for n in range(LONGEST_GRAM + 1):
        part = kept.where(F.col("n") == n).drop("n").toArrow()
        langs = np.array([place[x] for x in part["lang"].to_pylist()], np.int32)
        costs.append(Units.of(part["unit"].to_pylist(), langs, part["cost"].to_numpy(), len(languages)))
    return Model(languages, costs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, lang_pred, score: one row for each row of docs.

    A null text, and one without a letter, is `und` with score 0. Equal costs go to the first language
    in the alphabet. Words are runs of letters and their marks; whole texts are read, a segment at a time. Repeated
    rows are each predicted. Extra columns are left out. An empty table gives an empty result; a model
    that learned no language says `und` of everything.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch):
        said = [shared.value.predict(x.as_py()) for x in batch["text"]]
        yield {"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]}

    id_type = docs.schema[id_col].dataType.simpleString()
    found = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), predict, f"doc_id {id_type}, lang_pred string, score double")
    return found.withColumnRenamed("doc_id", id_col)


def op3_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 3, 1)))
    said = identify(docs, model)
    return said.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_word_backoff": op3_word_backoff}
ORACLES: dict[str, str] = {}
