"""Addresses, messages, captions, prompts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grammar of video addresses. Fixed patterns.
HOST = r"(?i)^(https?://)?(www\.|m\.|music\.)?(youtube\.com|youtube-nocookie\.com|youtu\.be)/"
ID_PATTERNS = [r"(?:v=|/videos/|embed/|shorts/|live/)([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})"]

#: What a tag says in a caption; None says nothing. Fixed values.
TAG_PHRASES = {
    "neutral": None,
    "slight_smile": "slight smile",
    "confident_smile": "confident smile",
    "big_smile": "big smile",
    "laughing": "laughing",
    "serious": "serious expression",
    "focused": "focused expression",
    "surprised": "surprised expression",
    "mouth_open": "mouth open",
    "talking": "talking",
    "looking_down": "looking down",
    "looking_up": "looking up",
    "eyes_left": "looking left",
    "eyes_right": "looking right",
    "eyes_closed": "eyes closed",
    "raised_eyebrows": "raised eyebrows",
    "frowning": "frowning",
}

#: Palette of clothing colours, RGB. Fixed values.
PALETTE = {
    "black": (10, 10, 10),
    "white": (245, 245, 245),
    "gray": (128, 128, 128),
    "red": (200, 30, 30),
    "blue": (30, 60, 200),
    "green": (40, 140, 60),
    "yellow": (220, 200, 40),
    "orange": (230, 130, 30),
    "purple": (130, 50, 160),
    "pink": (230, 140, 170),
    "brown": (110, 70, 40),
}


def video_id(url: Column) -> Column:
    """The 11-character id of a video's address, null if there is none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in ID_PATTERNS))


def is_video_url(url: Column) -> Column:
    """Whether an address is a video's, by its form alone; null is not."""
    trimmed = F.regexp_replace(url, r"^\s+|\s+$", "")
    return F.coalesce(trimmed.rlike(HOST) & video_id(trimmed).isNotNull(), F.lit(False))


def error_class(message: Column) -> Column:
    """The name of the error in sievewright.errors that a fetcher's message means; the first rule that fits. Phrases are fixed values."""
    m = F.lower(message)
    has = m.contains
    return (
        F.when(has("private video"), "SourceUnavailable")
        .when(has("sign in to confirm your age") | (has("age") & has("restrict")), "SourceUnavailable")
        .when(has("video unavailable") | has("has been removed"), "SourceUnavailable")
        .when(has("unsupported url"), "InvalidSource")
        .otherwise("FetchFailed")
    )


def _lookup(table: dict, key: Column) -> Column:
    items = [F.lit(x) for kv in table.items() for x in kv if kv[1] is not None]
    return F.try_element_at(F.create_map(*items), key)


def tag_phrase(tag: Column) -> Column:
    return _lookup(TAG_PHRASES, tag)


def caption(trigger: Column, tags: Column, colour: Column | None = None) -> Column:
    """The trigger word, what the tags say, and the shirt's colour if it is known, with commas between."""
    parts = F.concat(F.array(trigger), F.coalesce(F.filter(F.transform(tags, tag_phrase), lambda x: x.isNotNull()), F.array().cast("array<string>")))
    if colour is not None:
        parts = F.concat(parts, F.when(colour.isNotNull(), F.array(F.concat(colour, F.lit(" shirt")))).otherwise(F.array().cast("array<string>")))
    return F.array_join(parts, ", ")


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """Name of the palette's nearest colour, the earlier one in ties; null without a colour."""
    far = lambda c: (r - c[0]) * (r - c[0]) + (g - c[1]) * (g - c[1]) + (b - c[2]) * (b - c[2])
    ranked = F.array(*(F.struct(far(c).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(PALETTE.items())))
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.array_min(ranked)["n"])


def candidate_id(frame: Column, b: Column) -> Column:
    return F.format_string("f%08d_%d_%d_%d_%d", frame, b["x"], b["y"], b["w"], b["h"])


def stem(frame: Column, cid: Column) -> Column:
    """A file's stem. The whole id, not its tail: equal boxes in a frame would share a tail."""
    return F.concat(F.format_string("frame_%08d_", frame), cid)


def short_stem(frame: Column, cid: Column) -> Column:
    return F.concat(F.format_string("frame_%08d_", frame), F.right(cid, F.lit(8)))


def label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def safe_filename(name: Column, most: int = 150) -> Column:
    """Letters, digits and -_.() and blanks of a name, trimmed, at most `most` of them."""
    return F.substring(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}\-_.() ]", "")), 1, most)
