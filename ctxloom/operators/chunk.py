"""Document chunking: structural chunks, forced splits, heading chunks, and the document rollup.

Everything is made inside the row by built-in expressions: no shuffle, no Python worker, and time in proportion to a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MOST, LEAST = 1200, 200
#: Stands between pieces of a text while it is cut; noncharacters, which texts don't hold.
_CUT = "\ufffe\uffff"
_STEP = 256


def packs(c: Column, most: int = MOST) -> Column:
    """The words of a text with one space behind each, cut behind the first word that ends beyond `most` characters, again and again."""
    spaced = F.concat(F.array_join(X.split_words(c), " "), F.lit(" "))
    whole = "".join(["(?s:.{1000})"] * (most // 1000)) + f"(?s:.{{{most % 1000}}})"
    found = F.regexp_extract_all(spaced, F.lit(f"{whole}[^ ]* |(?s:.+)"), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.rtrim(p)), lambda p: p != "")


def force_split(c: Column, start: Column, most: int = MOST) -> Column:
    """array<struct<title, text>> of a text's packs; they are called by the place where the text starts."""
    return F.transform(packs(c, most), lambda p: F.struct(F.concat(F.lit("Segment @ "), start.cast("string")).alias("title"), p.alias("text")))


def _sums(sizes: Column) -> Column:
    """What `_before` needs of a list of sizes, made once for the list: the sums of its blocks of _STEP, and of these sums' blocks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def by_step(list_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(list_) / _STEP).cast("int")), lambda b: total(F.slice(list_, b * _STEP + 1, F.lit(_STEP))))
    return X.let(by_step(sizes), lambda one: F.struct(sizes.alias("sizes"), one.alias("one"), by_step(one).alias("two")))


def _before(sums: Column, i: Column) -> Column:
    """The sum of the first i sizes, of three short slices however long the list is."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    b = F.floor(i / _STEP).cast("int")
    c = F.floor(i / _STEP**2).cast("int")
    return total(F.slice(sums["two"], F.lit(1), c)) + total(F.slice(sums["one"], c * _STEP + 1, b % _STEP)) + total(F.slice(sums["sizes"], b * _STEP + 1, i % _STEP))


def chunks_of(c: Column, most: int = MOST, least: int = LEAST) -> Column:
    """array<struct<title, text>>: a text cut before blank lines and headings of one to three #. Pieces of more than `most` characters are
    split by force; inner ones of `least` characters or fewer are dropped."""
    def of(pieces: Column) -> Column:
        return X.let(_sums(F.transform(pieces, lambda p: F.length(p))), lambda sums: cut(pieces, sums))

    def cut(pieces: Column, sums: Column) -> Column:
        last = F.size(pieces) - 1

        def chunk(raw: Column, i: Column) -> Column:
            def by_size(body: Column) -> Column:
                size = F.when(i < last, F.length(raw)).otherwise(F.length(body))
                start = _before(sums, i)
                plain = F.array(F.struct(X.title(body).alias("title"), body.alias("text")))
                return F.when(size > most, force_split(F.when(i < last, raw).otherwise(body), start, most)).when(F.length(body) > F.when(i < last, least).otherwise(0), plain).otherwise(F.slice(plain, 1, 0))
            return X.let(X.strip(raw), by_size)
        return F.flatten(F.transform(pieces, chunk))
    return X.let(F.split(F.regexp_replace(c, r"(?U)(\n#{1,3}\s|\n\n)", _CUT + "$1"), _CUT), of)


def smart_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk: id, chunk, title, text."""
    return docs.select(id_col, F.posexplode(chunks_of(F.col(text_col))).alias("chunk", "c")).select(id_col, "chunk", "c.title", "c.text")


def split_documents(docs: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a pack of a whole text split by force: id, chunk, title, text."""
    return docs.select(id_col, F.posexplode(force_split(F.col(text_col), F.lit(0), most)).alias("chunk", "c")).select(id_col, "chunk", "c.title", "c.text")


def compressed_chunks(chunks: DataFrame, level: str = "L0") -> DataFrame:
    """Chunks are compressed at any level but L0."""
    return chunks.withColumn("compressed", _compressed(F.col("text"), level))


def _compressed(c: Column, level: str) -> Column:
    return c if level == "L0" else X.compress(c, level)


def document_rollup(docs: DataFrame, level: str = "L0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a chunk: the compressed chunks joined by blank lines, lengths, and token counts of the summed lengths."""
    d = docs.select(id_col, F.transform(chunks_of(F.col(text_col)), lambda c: F.struct(c["text"].alias("t"), _compressed(c["text"], level).alias("z"))).alias("c")).where("size(c) > 0")
    total = lambda field: F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x[field]))
    d = d.select(id_col, F.array_join(F.transform("c", lambda x: x["z"]), "\n\n").alias("text"), F.size("c").cast("long").alias("chunk_count"), total("t").alias("raw_length"), total("z").alias("compressed_length"))
    before, after = F.floor(F.col("raw_length") / 4), F.floor(F.col("compressed_length") / 4)
    return d.withColumn("input_tokens", before).withColumn("output_tokens", after).withColumn("compression_ratio", X.ratio(before, after))


def heading_chunks(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """path, source (path#Lline), content: a chunk begins at every heading of one to three #, and at the first line."""
    parts = F.split(F.regexp_replace(text_col, r"(?U)\n(?=#{1,3}[^\S\n])", _CUT), _CUT)
    lines = lambda p: F.size(F.split(p, "\n"))
    found = X.let(parts, lambda p: X.let(_sums(F.transform(p, lines)), lambda n: F.transform(p, lambda x, i: F.struct((_before(n, i) + 1).alias("line"), X.strip(x).alias("content")))))
    rows = files.select(path_col, F.explode(found).alias("c"))
    source = F.concat(F.col(path_col), F.lit("#L"), F.col("c.line").cast("string"))
    return rows.select(path_col, source.alias("source"), F.col("c.content").alias("content")).where("content != ''")
