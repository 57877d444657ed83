"""The distiller: items are typed, routed, compressed and gathered by request; statistics roll up by any key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Compressors of a level beside the deterministic ones; register with `use_model`.
_MODELS: dict[str, Callable[[Column], Column]] = {}
MODEL_CHARACTERS = {"L2": 1800, "L3": 16000}


def use_model(level: str, compressor: Callable[[Column], Column] | None) -> None:
    """Put a column function (such as a pandas UDF over a model) before a level's fallback; None takes it away."""
    if compressor is None:
        _MODELS.pop(level, None)
    else:
        _MODELS[level] = compressor


#: Readers of items that are not texts, by type; register with `use_reader`.
_READERS: dict[str, Callable[[Column], Column]] = {}


def use_reader(kind: str, reader: Callable[[Column], Column] | None) -> None:
    """Read document, image, audio or video items by a column function (such as a pandas UDF) that gives their text, which is then compressed; None takes
    it away, and items of the type pass as they are."""
    if reader is None:
        _READERS.pop(kind, None)
    else:
        _READERS[kind] = reader


def compressed(c: Column, level: str, rate: float | None = None) -> Column:
    """By the level's model where one is registered and gives a result, else by the deterministic compressor."""
    plain = X.compress(c, level, rate)
    if level not in _MODELS:
        return plain
    most = MODEL_CHARACTERS.get(level)
    return F.coalesce(_MODELS[level](F.substring(c, 1, most) if most else c), plain)


def route(item: Column, level: Column, backend: Column, gpu: Column, semantic: bool = False) -> Column:
    kind = X.resolve_type(item, semantic)
    return (
        F.when(kind == "text", X.route_text(level)).when(kind == "document", X.route_document(backend, gpu))
        .when(kind == "image", X.route_vision(gpu)).when(kind == "audio", "audio/stt").otherwise("video/frames")
    )


def plain_html(c: Column) -> Column:
    """Tags, scripts and styles to spaces, white space to one space."""
    unseen = F.regexp_replace(c, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(unseen, r"<[^>]*>", " "), r"\s+", " "))


def requests(rows: DataFrame) -> DataFrame:
    """rows (request_id, data array<string>) -> request_id, pos, item."""
    return rows.select("request_id", F.posexplode("data").alias("pos", "item"))


def distill(items: DataFrame, profile: str = "balanced", rate: float = 0.4, semantic: bool = False) -> DataFrame:
    """items (request_id, pos, item) with type, content and token counts. Texts are compressed, and what `use_reader` reads; other
    items pass as they are and have no counts."""
    level = X.PROFILE_LEVEL.get(profile, "L2")
    typed = items.withColumn("type", X.resolve_type(F.col("item"), semantic))
    read = F.when(F.col("type") == "text", F.col("item"))
    for kind, reader in _READERS.items():
        read = read.when(F.col("type") == kind, reader(F.col("item")))
    out = typed.withColumn("__read", read)
    out = out.withColumn("content", F.coalesce(compressed(F.col("__read"), level, rate), F.col("item")))
    return out.withColumn("input_tokens", X.tokens(F.col("__read"))).withColumn("output_tokens", F.when(F.col("__read").isNotNull(), X.tokens(F.col("content")))).drop("__read")


def results(distilled: DataFrame) -> DataFrame:
    """One row a request: prompt (array of type and content in order) and the token statistics of its items."""
    prompt = F.transform(F.array_sort(F.collect_list(F.struct("pos", "type", "content"))), lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return distilled.groupBy("request_id").agg(prompt.alias("prompt"), *sums).withColumn("compression_ratio", X.ratio(F.col("input_tokens"), F.col("output_tokens")))


# Pictures that a vision model takes as they are.
PIXEL = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")


def attachments(files: DataFrame, mode: Column) -> DataFrame:
    """files (pos, path, ...) with `handling`: `pixel` for pictures in pixel mode, which go to the model, else `distill`."""
    picture = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in PIXEL) + r")\z")
    return files.withColumn("handling", F.when(picture & (mode == "pixel"), "pixel").otherwise("distill"))


def level_stats(docs: DataFrame, level: str, by: list[str]) -> DataFrame:
    """Token counts and the compression ratio of a level by keys; sums are partial before the shuffle."""
    t = docs.select(*by, X.tokens(F.col("text")).alias("i"), X.tokens(compressed(F.col("text"), level)).alias("o"))
    out = t.groupBy(*by).agg(F.count("*").alias("n"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))
    return out.withColumn("compression_ratio", F.round(X.ratio(F.col("input_tokens"), F.col("output_tokens")), 6))


def compare_levels(docs: DataFrame, by: str) -> DataFrame:
    """level_stats of all levels in one pass."""
    each = [F.struct(F.lit(level).alias("level"), X.tokens(compressed(F.col("text"), level)).alias("o")) for level in ("L0", "L1", "L2", "L3")]
    t = docs.select(by, X.tokens(F.col("text")).alias("i"), F.explode(F.array(*each)).alias("x"))
    out = t.groupBy(by, F.col("x.level").alias("level")).agg(F.count("*").alias("n"), F.sum("i").alias("input_tokens"), F.sum("x.o").alias("output_tokens"))
    return out.withColumn("compression_ratio", F.round(X.ratio(F.col("input_tokens"), F.col("output_tokens")), 6))
