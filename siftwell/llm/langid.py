"""Language identification by compression with per-language Zstandard dictionaries.

Each language's dictionary is raw text of that language. A text is cut into
blocks; every block is compressed with each dictionary, and the language with
the smallest sum of compressed sizes wins. Where the runner-up is nearly as
small, the row is marked as rejected.

Defined results: a null text, and one without any letter, gives ``und`` with
score 0, rejected; with no labelled text to learn from, every row does. Ties go
to the alphabetically first language. Very long texts are scored whole, block by
block. Rows are scored one by one, so repeated ids and repeated rows are no matter;
other columns of the input are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-cased words: what is not a letter (of ASCII) parts them."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def learn_dictionaries(docs: DataFrame, docs_per_language: int = 400, longest: int = 20_000, dictionary_bytes: int = 1 << 17) -> dict[str, bytes]:
    """Raw-content dictionaries from ``docs(text, lang)``.

    The sample is bounded: of each language the ``docs_per_language`` texts that come
    first by a hash of the text, of each the first ``longest`` characters, cut evenly
    to ``dictionary_bytes``. Rows with a null language or text teach nothing.
    """
    usable = docs.filter("lang is not null and length(text) > 0").select(F.xxhash64("text").alias("h"), F.substring("text", 1, longest).alias("text"), "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * docs_per_language / n))])
    first = usable.filter((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < share[F.col("lang")])
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= docs_per_language)
    texts: dict[str, list[bytes]] = {}
    for r in ranked.orderBy("lang", "r").collect():
        texts.setdefault(r["lang"], []).append(plain(r["text"]))
    out = {}
    for lang, own in sorted(texts.items()):
        each = max(64, dictionary_bytes // len(own))
        spare = dictionary_bytes
        parts = []
        for text in sorted(own, key=len):
            parts.append(text[: max(each, spare // (len(own) - len(parts)))])
            spare -= len(parts[-1])
        out[lang] = b" ".join(parts)[-dictionary_bytes:]
    return out


class Compressors:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, block: int = 8192):
        self.langs, self.block, self.all = sorted(dictionaries), block, []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.all.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.all]

    def best(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected: score is the lead over the runner-up, as a share, times five, at most 1."""
        if not self.langs or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0, False
        lead = 1 - sizes[order[0]] / sizes[order[1]]
        return self.langs[order[0]], min(1.0, 5 * lead), lead < margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str] | None, margin: float = 0.002) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score and rejected, from the text alone; a kept column of such a name gives way.

    Without ``keep`` all columns come as one struct, ``row``, whatever their names.
    """
    kept = [k for k in keep if k.lower() not in ("lang_pred", "score", "rejected")] if keep is not None else [F.struct("*").alias("row")]
    inputs = docs.select(*kept, F.col("text").cast("string").alias("__text"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*inputs.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries)
        for b in batches:
            found = [compressors.best(t.as_py(), margin) for t in b.column(b.num_columns - 1)]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return map_arrow(inputs, run, schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))
