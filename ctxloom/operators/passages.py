"""Overlapping passages of a text, and a cache of embeddings by content.

A passage is SIZE words of a text as they stand, with the white space between them; the next one begins SIZE - OVERLAP words later. A
last passage that the one before holds whole is left out. Everything is made inside the row by built-in expressions, in proportion to a text.
Words are `[^\\x20\\x09-\\x0D]+`. Null texts and texts without words have no passages; a text of SIZE words or fewer has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.batches import Batches
from .chunk import _before, _sums

SIZE, OVERLAP = 400, 80
_SPACE = r"\x20\x09-\x0D"


def passages_of(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<first, last, text>>: the passages with their offsets in characters, `last` being the offset behind the last word."""
    if not 0 <= overlap < size:
        raise ValueError("a passage is longer than its overlap, which is not negative")
    step = size - overlap

    def cut(words: Column) -> Column:
        def passage(i: Column, sums: Column) -> Column:
            def placed(raw: Column) -> Column:
                text = F.regexp_replace(raw, f"^[{_SPACE}]+", "")
                end = _before(sums, F.least(i + size, F.size(words)))
                return F.struct((end - F.length(text)).alias("first"), end.alias("last"), text.alias("text"))
            return X.let(F.array_join(F.slice(words, i + 1, F.lit(size)), ""), placed)
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(step))
        return X.let(_sums(F.transform(words, lambda w: F.length(w))), lambda sums: F.transform(starts, lambda i: passage(i, sums)))
    # every word comes with the white space before it, so lengths add up to offsets
    return X.let(F.regexp_extract_all(c, F.lit(f"[{_SPACE}]*[^{_SPACE}]+"), F.lit(0)), lambda words: F.when(F.size(words) > 0, cut(words)))


def passages(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a passage: id, passage, first, last, hash (SHA-256 of the text), text."""
    rows = docs.select(id_col, F.posexplode(passages_of(F.col(text_col), size, overlap)).alias("passage", "p"))
    return rows.select(id_col, "passage", "p.first", "p.last", F.sha2("p.text", 256).alias("hash"), "p.text")


class EmbeddingCache(Batches):
    """Embeddings of one model in a shared folder, by the hash of what was embedded. Each call of `add` is a batch, which counts once it is
    written whole: a call that fails leaves nothing behind, and of two calls that take one number the second fails."""

    SCHEMA = "hash string, embedding array<float>, batch int"

    def _known(self) -> DataFrame:
        return self._read("docs", self.SCHEMA).where("embedding is not null")

    def stored(self) -> DataFrame:
        """hash, embedding, batch: one row a hash, the earliest where two calls at one time embedded the same text."""
        return self._known().groupBy("hash").agg(F.min_by(F.struct("embedding", "batch"), "batch").alias("x")).select("hash", "x.*")

    def unseen(self, texts: DataFrame) -> DataFrame:
        """hash, text: one row for each hash of texts (hash, text) that is not stored. Copies meet in each task before they are shuffled, so a
        text that very many rows share is no hot key; the anti join finds both sides dealt by hash."""
        new = texts.where("hash is not null").groupBy("hash").agg(F.first("text").alias("text"))
        return new.join(self._known().select("hash").distinct(), "hash", "left_anti")

    def add(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> int:
        """Embeds what of texts (hash, text) is not stored: `embed` gets (hash, text) and gives `embedding` with it, null where it
        failed; a later call tries those again. Returns how many were embedded. (Nulls are written and left out when read: a filter before
        the write would be pushed below the projection, and call the model twice a text.)"""
        number = self._batches()[1]
        self._write(embed(self.unseen(texts)).select("hash", F.col("embedding").cast("array<float>").alias("embedding")), "docs", number)
        return self.spark.read.parquet(f"{self.path}/docs/batch={number}").where("embedding is not null").count()

    def embedded(self, texts: DataFrame) -> DataFrame:
        """texts with `embedding` and `batch`, which are null for what is not stored."""
        return texts.join(self.stored(), "hash", "left")
