"""Language identification by compression.

One zstandard raw-content dictionary per language; a text (its lower-cased words) is compressed with each of them, in blocks so
that the dictionary matters for long texts too, and the smallest total names the language. The score
grows with the relative margin to the second smallest; narrow margins are marked as rejected.

The dictionaries are made of at most ``DICTIONARY`` bytes from at most ``SAMPLE_DOCS`` labelled documents
of each language, chosen by a hash of their id; everything else covers all rows and whole texts.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is everything when no
language could be learned; with one language every margin is 1; labels that are null or of empty texts
are not learned from; ties go to the first name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 64
DICTIONARY = 96 << 10
BLOCK = 4096
LEVEL = 3
NARROW = 0.01
HALF_SCORE = 0.02
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def letters(text: str) -> bytes:
    """The words of the whole text in lower case, without punctuation and digits."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, use: Column) -> dict[str, bytes]:
    """Dictionary of each language, from the documents for which ``use`` holds."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = docs.where(use & F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    # texts are fetched for the chosen ids only
    chosen = rows.select("lang", "doc_id").withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)
    found = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang", "rank")), ["doc_id", "lang"])
    texts: dict[str, list[bytes]] = {}
    for row in found.orderBy("lang", "rank").toLocalIterator():
        texts.setdefault(row["lang"], []).append(letters(row["text"]))
    made = {}
    for lang, own in sorted(texts.items()):
        share = max(DICTIONARY // len(own), 1)
        # a middle part of each, so that one long text does not fill the dictionary
        made[lang] = b"\n".join(t[max(0, (len(t) - share) // 2):][:share] for t in own)
    return made


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not self.names or LETTER.search(text) is None:
            return "und", 0.0, 0.0, True
        data = letters(text)
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], float)
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        margin = float((rest.min() - sizes[best]) / rest.min()) if len(rest) else 1.0
        return self.names[best], margin / (margin + HALF_SCORE) if margin else 0.0, margin, margin < NARROW


def predicted(text: Column, dictionaries: dict[str, bytes]) -> Column:
    made: list[Classifier] = []

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Classifier(dictionaries))
        return pd.DataFrame([made[0](t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return run(text)


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, margin, rejected."""
    out = held_out(F.col("doc_id"))
    made = learn(docs, ~out)
    return docs.select("doc_id", out.alias("held_out"), predicted(F.col("text"), made).alias("p")).select("doc_id", "held_out", "p.*")
