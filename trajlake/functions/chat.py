"""Content lists of chats, and media marks among token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys and types by which an element names an image or a video.
MEDIA = ("image", "image_url", "video")


def elements(content: Column) -> Column:
    """The elements of a message's content, a JSON list of objects, each as a map of its values as text; a content that is plain text has none."""
    return F.coalesce(F.from_json(F.when(F.ltrim(content).startswith("["), content), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))


def _has(element: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out |= F.map_contains_key(element, n)
    return out


def media(content: Column) -> Column:
    """kind (image or video) and source of the elements that name media, in order.  An element counts if it has the key of a medium or a type of
    one; with such a type and no source it fails."""
    some = F.filter(elements(content), lambda e: _has(e, *MEDIA) | F.coalesce(F.try_element_at(e, F.lit("type")).isin(*MEDIA), F.lit(False)))

    def read(e: Column) -> Column:
        value = lambda n: F.try_element_at(e, F.lit(n))
        kind = F.when(_has(e, "image", "image_url"), "image").when(_has(e, "video"), "video").otherwise(F.raise_error(F.lit("an element of content has a type of medium and no source")).cast("string"))
        return F.struct(kind.alias("kind"), F.coalesce(value("image"), value("image_url"), value("video")).alias("source"))

    return F.transform(some, read)


def media_counts(ids: Column, start: int, image: int, video: int) -> list[Column]:
    """images, videos of a sequence of token ids: marks right after a start mark; before the first comes the last."""
    before = lambda i: F.get(ids, F.when(i == 0, F.size(ids) - 1).otherwise(i - 1))
    after = lambda mark: F.size(F.filter(ids, lambda x, i: (x == mark) & (before(i) == start))).cast("long")
    return [after(image).alias("images"), after(video).alias("videos")]
