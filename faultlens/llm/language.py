"""Language of texts by compression.

For every language a bounded sample of its texts is the content of a zstandard
dictionary. A text is lower-cased, its letters are kept with one blank between
words, and it is encoded in windows of a few hundred bytes once for each
dictionary. The language whose dictionary leaves the fewest bytes over all
windows is chosen; a lead below ``MARGIN`` counts as rejected. Windows keep a
text's own repetitions from outweighing the dictionary, and cover all of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import slices
from faultlens.llm.toxicity import held_out

#: Languages learned, the most frequent first; texts of each, and the characters taken from each text.
LANGUAGES, SAMPLE, SAMPLE_CHARS = 256, 64, 2000
DICTIONARY_BYTES, WINDOW_BYTES, LEVEL = 1 << 15, 512, 12
#: Least lead over the second language, as a share of the encoded bytes.
MARGIN = 0.01
UNKNOWN = "und"
#: Characters that are normalised at a time.
_PART = 1 << 16
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased letters with one blank between words; longer texts go through in parts."""
    found = "".join(_NO_LETTERS.sub(" ", text[k : k + _PART].lower()) for k in range(0, len(text), _PART))
    return found.strip().encode()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Languages(NamedTuple):
    """The learned languages, the most frequent first, and the dictionary of each."""

    names: list[str]
    dictionaries: list[bytes]

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.dictionaries:
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(content), source_size=WINDOW_BYTES, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary))
        return made


def encoded_bytes(text: str, encoders: list[zstandard.ZstdCompressor], window: int = WINDOW_BYTES) -> np.ndarray:
    """Bytes that the whole text takes with each encoder."""
    data = letters(text)
    parts = [data[k : k + window] for k in range(0, len(data), window)]
    return np.array([sum(len(e.compress(p)) for p in parts) for e in encoders], np.int64)


def decision(sizes: np.ndarray) -> tuple[int, float, float]:
    """The chosen language, its share of 2^-bytes over all languages, and its lead over the second.

    Equal sizes go to the language that comes first, the more frequent one.
    """
    best = int(sizes.argmin())
    share = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 1000).astype(float)).sum())
    rest = np.delete(sizes, best)
    return best, share, float((rest.min() - sizes[best]) / sizes[best]) if len(rest) else 1.0


def learned(documents: DataFrame, languages: int = LANGUAGES, size: int = SAMPLE) -> Languages:
    """Dictionaries from ``size`` different texts of each of the ``languages`` most frequent values of lang.

    Rows that are held out, have no doc_id, no lang or no letter teach
    nothing. Texts are taken in the order of a hash of theirs, so copies count
    once however many there are; of each a stretch of ``SAMPLE_CHARS``
    characters at a place that the hash tells. Languages are thinned one by
    one, so a rare one keeps all it needs.
    """
    rows = documents.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id")))
    rows = rows.filter(F.col("text").rlike("\\p{L}")).select("lang", "text", F.xxhash64("text").alias("hash__"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("hash__").alias("texts"))
    counts = counts.orderBy(F.desc("rows"), "lang").limit(languages).collect()
    if not counts:
        return Languages([], [])
    border = F.create_map(*chain(*[(F.lit(r["lang"]), _border(r["texts"], 16 * size)) for r in counts]))
    thin = rows.filter(F.col("hash__") <= F.try_element_at(border, F.col("lang")))
    place = F.pmod(F.xxhash64("hash__"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    thin = thin.select("lang", "hash__", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("piece"))
    thin = thin.groupBy("lang", "hash__").agg(F.min("piece").alias("piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash__"))
    # languages * size pieces at most.
    pieces: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    chosen = thin.withColumn("place__", place).filter(F.col("place__") <= size).collect()
    for row in sorted(chosen, key=lambda r: (r["lang"], r["place__"])):
        pieces[row["lang"]].append(letters(row["piece"]))
    joined = {name: b" ".join(p for p in found if p)[:DICTIONARY_BYTES] for name, found in pieces.items()}
    names = [name for name, content in joined.items() if content]
    return Languages(names, [joined[name] for name in names])


def _border(count: int, wanted: int) -> Column:
    """The greatest hash of the least ``wanted`` of ``count`` different ones, about."""
    share = min(1.0, wanted / max(count, 1))
    return F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))


def identified(documents: DataFrame, languages: Languages, margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of every row of ``documents``.

    Only the text decides. ``rejected`` tells that the lead is below
    ``margin``; lang_pred is the best language all the same. A text that is
    null, empty or without a letter is ``und`` with score 0 and rejected, and
    so is every text where no language is learned. Repeated rows give repeated
    results, a null doc_id stays null, an empty table gives none; other columns
    of ``documents`` are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = languages.encoders()
        for batch in slices(batches, "text", 1 << 20):
            found = []
            for text in batch.column(2):
                text = text.as_py()
                if not encoders or not text or not has_letter(text):
                    found.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                best, share, lead = decision(encoded_bytes(text, encoders))
                found.append((languages.names[best], share, lead, lead < margin))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def languages_of(documents: DataFrame) -> DataFrame:
    """Learn from the rows of ``documents`` that are not held out, then identify all of them."""
    return identified(documents, learned(documents))
