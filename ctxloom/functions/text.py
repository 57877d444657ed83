"""Text functions as columns: cleaning, sentence selection, truncation, token estimates, type detection and routing.

Everything here is a built-in expression, so it runs in the JVM and needs no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"

# Stop words, file suffixes and the characters that cleaning keeps.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for")
AUDIO = (".mp3", ".wav", ".flac", ".m4a", ".ogg", ".wma", ".aac", ".opus")
VIDEO = (".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv", ".wmv", ".m4v", ".ts")
IMAGE = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tiff", ".tif")
DOCUMENT = (".pdf", ".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt", ".csv", ".html", ".htm", ".rtf", ".md", ".txt", ".epub", ".odt")
URL_IMAGE = (".png", ".jpg", ".jpeg", ".webp")
DROPPED = r"(?U)[^\w\s一-鿿.,!?;:]"
SENTENCE_END = r"(?U)(?<=[.!?。！？])\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """The estimate of a quarter of the code points."""
    return F.floor(F.length(c) / 4)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def l0_clean(c: Column) -> Column:
    """White space to one space, other symbols dropped, stop words dropped."""
    plain = F.regexp_replace(F.regexp_replace(c, SPACE, " "), DROPPED, "")
    return F.array_join(F.filter(F.split(F.trim(plain), SPACE), lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS)), " ")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda s: strip(s)), lambda s: s != "")


def diversity(s: Column) -> Column:
    """The share of distinct words of a sentence."""
    return F.size(F.array_distinct(F.split(F.lower(s), SPACE))) / F.size(F.split(s, SPACE))


def l1_select(c: Column, reduce_ratio: float = 0.5, score: Callable[[Column], Column] = diversity) -> Column:
    """The share 1 - reduce_ratio (one at least) of the sentences with the largest score, in text order. The score is a function of
    columns that works inside a lambda; scores of a model are taken by `l1_by_scores`.

    Ties go to the earlier sentence; a repeated sentence is placed where it occurs first. Without a sentence, the text.
    """
    def pick(s: Column) -> Column:
        scored = F.transform(s, lambda x, i: F.struct((-score(x)).alias("d"), i.alias("i"), x.alias("x")))
        count = F.greatest(F.lit(1), F.floor(F.size(s) * F.lit(1 - reduce_ratio)).cast("int"))
        top = F.slice(F.array_sort(scored), F.lit(1), count)
        unique = F.size(F.array_distinct(s)) == F.size(s)
        place = lambda x: F.when(unique, x["i"].cast("long")).otherwise(F.array_position(s, x["x"]) - 1)
        ordered = F.array_sort(F.transform(top, lambda x: F.struct(place(x).alias("p"), x["i"].alias("i"), x["x"].alias("x"))))
        return F.array_join(F.transform(ordered, lambda x: x["x"]), " ")

    return let(sentences(c), lambda s: F.when(F.size(s) == 0, c).otherwise(pick(s)))


def l1_by_scores(sentences_: Column, scores: Column, reduce_ratio: float = 0.5) -> Column:
    """l1_select over sentences whose scores are there already, such as those of a pandas UDF over `sentences`; ties go to the earlier one."""
    count = F.greatest(F.lit(1), F.floor(F.size(sentences_) * F.lit(1 - reduce_ratio)).cast("int"))
    ranked = F.array_sort(F.transform(F.arrays_zip(sentences_.alias("x"), scores.alias("v")), lambda z, i: F.struct((-z["v"]).alias("d"), i.alias("i"), z["x"].alias("x"))))
    ordered = F.array_sort(F.transform(F.slice(ranked, F.lit(1), count), lambda z: F.struct(z["i"].alias("i"), z["x"].alias("x"))))
    return F.array_join(F.transform(ordered, lambda z: z["x"]), " ")


def preview(c: Column, most: int = 200) -> Column:
    """The first characters of a text, for listings."""
    return F.substring(c, 1, most)


def l2_truncate(c: Column, rate: float = 0.4) -> Column:
    return F.substring(c, F.lit(1), F.floor(F.length(c) * F.lit(rate)).cast("int"))


def l3_lead(c: Column) -> Column:
    """The first fifth (one at least) of the parts between ideographic full stops."""
    return let(F.split(c, "。"), lambda s: F.concat(F.array_join(F.slice(s, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(s) / 5).cast("int"))), "。"), F.lit("。")))


def compress(c: Column, level: str, rate: float | None = None) -> Column:
    """The deterministic compressor of a level; an unknown level is L0."""
    if level == "L1":
        return l1_select(c)
    if level == "L2":
        return l2_truncate(c, 0.4 if rate is None else rate)
    return l3_lead(c) if level == "L3" else l0_clean(c)


def ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, 1 - after / before).otherwise(F.lit(0.0))


def _ends(c: Column, suffixes: tuple[str, ...]) -> Column:
    return c.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")


def detect_type(c: Column, semantic: bool = False) -> Column:
    """data_uri, url, audio, video, image (document in semantic mode), document or text; first match wins."""
    low = F.lower(c)
    return (
        F.when(c.startswith("data:"), "data_uri").when(c.startswith("http://") | c.startswith("https://"), "url")
        .when(_ends(low, AUDIO), "audio").when(_ends(low, VIDEO), "video")
        .when(_ends(low, IMAGE), "document" if semantic else "image").when(_ends(low, DOCUMENT), "document").otherwise("text")
    )


def resolve_type(c: Column, semantic: bool = False) -> Column:
    """detect_type with data URIs as images and URLs by their suffix (nothing is downloaded)."""
    kind = detect_type(c, semantic)
    by_url = F.when(_ends(F.lower(c), URL_IMAGE), "document" if semantic else "image").otherwise("text")
    return F.when(kind == "data_uri", "image").when(kind == "url", by_url).otherwise(kind)


def route_text(level: Column) -> Column:
    return F.when(level == "L1", "text/selective").when(level == "L2", "text/lingua").when(level == "L3", "text/summary").otherwise("text/regex")


def route_document(backend: Column, gpu: Column) -> Column:
    return (
        F.when(backend.isin("markitdown", "pymupdf"), "document/native").when((backend == "docling") & gpu, "document/docling")
        .when(backend == "vlm", "document/vlm").when(backend == "deepseek", "document/ocr").otherwise("document/native")
    )


def route_vision(gpu: Column) -> Column:
    return F.when(gpu, "vision/roi").otherwise("vision/dedup")


#: Levels of the profiles; others are balanced.
PROFILE_LEVEL = {"speed": "L0", "selective": "L1", "balanced": "L2", "accuracy": "L3"}


def profile_level(profile: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PROFILE_LEVEL.items() for x in kv])
    return F.coalesce(known[profile], F.lit(PROFILE_LEVEL["balanced"]))


def title(c: Column) -> Column:
    """The first line, cut to 50 characters and `...`."""
    line = strip(F.substring_index(c, "\n", 1))
    return F.when(F.length(line) > 50, F.concat(F.substring(line, 1, 50), F.lit("..."))).otherwise(line)


def search_terms(c: Column) -> Column:
    """Case-folded terms without diacritics: runs of letters and digits. Texts of ASCII alone take a shorter way."""
    marked = F.split(F.lower(F.translate(c, _MARKED, _BASES)), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.when(c.rlike(r"[^\x00-\x7F]"), marked).otherwise(F.split(F.lower(c), "[^a-z0-9]+")), "")


#: Characters that `plain_characters` knows: Latin letters, combining marks, general punctuation. Letters stay as long in UTF-8.
_PLAIN = (range(0x234), range(0x300, 0x370), range(0x2000, 0x2070))


def search_text(c: Column) -> Column:
    """A text whose runs of letters and digits are the terms of `search_terms`, once `plain_characters` has been applied to it: the text itself, or
    where it has other characters, its terms one space apart."""
    known = "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in _PLAIN)
    # anchored and possessive: a search for another character takes ten times as long
    return F.when(c.rlike(rf"\A[\x00-\x7F]*+[{known}]*+\z"), c).otherwise(F.array_join(search_terms(c), " "))


def plain_characters() -> list[int]:
    """For each code point below the end of _PLAIN what `search_terms` makes of it: a letter or digit, a space for what parts terms, or -1 for what goes. Code
    points between the ranges of _PLAIN stay, and so do all behind them."""
    bases, out = dict(zip(_MARKED, _BASES, strict=False)), list(range(_PLAIN[-1].stop))
    for r in _PLAIN:
        for i in r:
            c = bases.get(chr(i), "" if chr(i) in _MARKED else chr(i)).lower()
            out[i] = (ord(c) if c.isalnum() and unicodedata.category(c)[0] in "LN" else 32) if c else -1
    return out


def _marks() -> tuple[str, str]:
    """Letters with marks and their bases, by canonical decomposition; behind them the marks themselves, which go."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in pairs)


_MARKED, _BASES = _marks()
