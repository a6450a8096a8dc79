"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with text of that language. A text is encoded with every
dictionary, and the language whose dictionary makes it smallest is chosen. The margin is the share that the best saves
against the second best; a text with a narrow margin is rejected.

What is encoded are all words of the text, its letters in lower case, as often as they occur: capitals, marks and digits
say nothing about the language. Blocks are short and encoded by themselves, as within a block a word that comes back is a
copy at the same size under every dictionary. Equal sizes are told apart by a finer and slower encoding. Dictionaries are
filled with different words only.

Learning takes at most SAMPLE different texts per language, those with the smallest digests, and SHARE characters of
each, up to SIZE bytes per dictionary; the dictionaries are the whole model and travel with the tasks.

Defined cases: a text that is null or has no letter is `und` with score 0 and is rejected; rows without a label are not
learned from; without any learned language everything is `und`; with a single one there is no margin to be narrow. Ties
that remain go to the language with more labelled rows. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 64
SHARE = 800
SIZE = 1 << 15
#: Margins below this are narrow.
NARROW = 0.005
#: Bytes encoded at once.
BLOCK = 1 << 9
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def all_words(text: str) -> str:
    """The letters of a text in lower case, its words one space apart."""
    return _OTHER.sub(" ", text.lower()).strip()


def different_words(text: str) -> str:
    """The letters of a text in lower case, each different word once, in order."""
    return " ".join(dict.fromkeys(all_words(text).split()))


@dataclass(frozen=True)
class Model:
    """Dictionary contents by language, the most frequent first."""

    contents: dict[str, bytes]


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows that have both a text and a language."""
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text <> ''")
    # A stable order that no other column decides, longer texts first; copies count once.
    rows = rows.withColumn("rank", F.struct((F.length("text") < SHARE).alias("short"), F.xxhash64("text").alias("digest")))
    per_language = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("lang").orderBy("rank")
    chosen = rows.groupBy("lang", "rank").agg(F.lit(1)).withColumn("nth", F.row_number().over(order))
    # At most SAMPLE rows per language from here on.
    chosen = chosen.where(F.col("nth") <= SAMPLE).select("lang", "rank", "nth")
    sample = (
        rows.join(F.broadcast(chosen), ["lang", "rank"])
        .groupBy("lang", "nth")
        .agg(F.min(F.substring("text", 1, 4 * SHARE)).alias("text"))
        .join(per_language, "lang")
        .collect()
    )
    parts: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for row in sample:
        parts.setdefault((-row["rows"], row["lang"]), []).append((row["nth"], row["text"]))
    return Model(
        {
            key[1]: " ".join(different_words(x)[:SHARE] for _, x in sorted(parts[key])).encode()[:SIZE]
            for key in sorted(parts)
        }
    )


class _Encoders:
    """Sizes of a text under the dictionary of every language."""

    def __init__(self, contents: list[bytes]):
        import zstandard

        def encoders(**settings):
            found = []
            for content in contents:
                parameters = zstandard.ZstdCompressionParameters(
                    window_log=18, write_content_size=0, write_dict_id=0, write_checksum=0, **settings
                )
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=parameters)
                found.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
            return found

        greedy = dict(strategy=zstandard.STRATEGY_GREEDY, hash_log=15, chain_log=15, min_match=4, search_log=3)
        fine = dict(
            strategy=zstandard.STRATEGY_BTOPT, hash_log=16, chain_log=17, min_match=3, search_log=4, target_length=32
        )
        self._main, self._fine = encoders(**greedy), encoders(**fine)

    @staticmethod
    def _sizes(encoders, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(x.compress(block)) for block in blocks) for x in encoders]

    def best(self, data: bytes) -> tuple[int, float]:
        """Place of the best dictionary, and the margin to the second best."""
        sizes = self._sizes(self._main, data)
        if len(sizes) == 1:
            return 0, 1.0
        first, second = sorted(sizes)[:2]
        places = [i for i, x in enumerate(sizes) if x == first]
        if len(places) > 1:
            finer = self._sizes(self._fine, data)
            places.sort(key=lambda i: (finer[i], i))
        return places[0], 1 - first / second


PREDICTION = "lang_pred string, score double, rejected boolean"


def prediction(model: Model, text: str = "text", narrow: float = NARROW) -> Column:
    """A struct of the language, its score (the margin, 0 to 1) and whether the text is rejected."""
    names, contents = list(model.contents), list(model.contents.values())

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = _Encoders(contents)
        for texts in batches:
            rows = []
            for value in texts:
                words = all_words(value) if value else ""
                if not names or not any(map(str.isalpha, words)):
                    rows.append((UNKNOWN, 0.0, True))
                else:
                    place, margin = encoders.best(words.encode())
                    rows.append((names[place], margin, margin < narrow))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return predict(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC of its id as text is a multiple of 5; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from the labelled ones that are not held out."""
    docs = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(docs.where("doc_id IS NOT NULL AND NOT held_out"))
    found = docs.select("doc_id", "held_out", prediction(model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
