"""Text, paths, names and parsing of small values."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are unescaped, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that count as white space.
SPACES = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space, and texts whose characters are the bytes of valid UTF-8.
BLANKS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
UTF8_AS_LATIN1 = r"^(?:[\x00-\x7F]++|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})*+$"
TRUE_WORDS, FALSE_WORDS = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def unescape(x: Column) -> Column:
    """The commonest entities, without leaving the JVM; clean_lines() knows all."""
    out = x
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(x.contains("&"), out).otherwise(x)


def _unescaped_twice(lines: pd.Series) -> pd.Series:
    return lines.map(lambda v: None if v is None else [s if s is None else html.unescape(html.unescape(s)) for s in v])


def unescaped(lines: Column) -> Column:
    """Texts with every entity that HTML knows unescaped, twice: only lists in which there is an ampersand leave the JVM."""
    some = F.exists(lines, lambda s: s.contains("&"))
    return F.coalesce(F.pandas_udf(_unescaped_twice, "array<string>")(F.when(some, lines)), lines)


def clean_lines(lines: Column, suspect: Column | None = None) -> Column:
    """As clean() of each of a list of texts, with every entity that HTML knows."""
    whole = F.transform(lines, lambda s: repaired(s) if suspect is None else F.when(suspect, repaired(s)).otherwise(s))
    return F.transform(unescaped(whole), strip)


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(SPACES))


def clean(x: Column, suspect: Column | None = None) -> Column:
    """Repaired, unescaped twice, and stripped; suspect: whether there may be anything to repair (see may_be_broken)."""
    return strip(unescape(unescape(repaired(x) if suspect is None else F.when(suspect, repaired(x)).otherwise(x))))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, BLANKS, " "))


def may_be_broken(x: Column) -> Column:
    """Cheap, and true of every text of which a part is to be repaired."""
    return x.rlike(r"[\xC2-\xF4][\x80-\xBF]")


def repaired(x: Column) -> Column:
    """UTF-8 that was read as Latin-1 as it was meant; a text that is not such as a whole stays as it is."""
    broken = may_be_broken(x) & x.rlike(UTF8_AS_LATIN1)
    return F.when(broken, F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")).otherwise(x)


def canonical(x: Column, keep: str = "") -> Column:
    """Underscores as blanks, without punctuation, lower case, single blanks; keep: a separator that stays, whatever it is made of."""
    drop = "".join(c for c in PUNCTUATION if c != "_")
    bare = lambda part: F.translate(F.translate(part, "_", " "), drop, "")
    text = F.array_join(F.transform(F.split(x, re.escape(keep)), bare), keep) if keep else bare(x)
    return collapse(F.lower(text))


def lines(x: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != "")


def lines_or_fail(x: Column, name: Column) -> Column:
    """As lines(); fails with the name of a text that has none, or is missing."""
    found = lines(x)
    lacking = F.raise_error(F.concat(F.lit("no line in "), name.cast("string"))).cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(lacking)


def kept_lines(x: Column) -> Column:
    """Lines that have any character, blanks too."""
    return F.filter(F.split(x, "\n"), lambda s: s != "")


def mode_name(x: Column) -> Column:
    return F.translate(F.lower(strip(x)), "-", "_")


def integers(x: Column) -> Column:
    """"6, 13" as [6, 13]; blank parts are dropped."""
    return F.transform(F.filter(F.split(x, ","), lambda s: strip(s) != ""), lambda s: strip(s).cast("int"))


def boolean(x: Column) -> Column:
    """Fails on other words than the known ones."""
    low = F.lower(strip(x))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))


def number(x: Column) -> Column:
    """A number written in any way, "1e-5" as well; null if it is none."""
    return strip(x).try_cast("double")


def padded(prefix: str, i: Column, width: int) -> Column:
    """The number filled up with zeros at the left; longer ones stay whole."""
    digits = i.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def relative(path: Column, root: Column) -> Column:
    """The path below a root; fails on a path outside it."""
    below = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(below), F.substring(path, F.length(below) + 1, F.length(path))).otherwise(F.raise_error(F.concat(path, F.lit(" is not below "), root)).cast("string"))


def with_extension(path: Column, extension: str) -> Column:
    """The path with another extension; one without gets it."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(extension))


def moved(path: Column) -> Column:
    """.../task/variant/sub/file as .../split/task/sub/file: a variant whose name ends in clean is the clean split, others are randomized."""
    split = F.when(F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).endswith("clean"), "clean").otherwise("randomized")
    parts = [F.regexp_extract(path, r"^(.*/)?([^/]+)/[^/]+/([^/]+/[^/]+)$", k) for k in (1, 2, 3)]
    return F.when(path.rlike(r"^(.*/)?[^/]+/[^/]+/[^/]+/[^/]+$"), F.concat(parts[0], split, F.lit("/"), parts[1], F.lit("/"), parts[2]))


def filled(text: Column, mark: str, counts: Column, token: str) -> Column:
    """Each mark becomes as many tokens as its own count says; marks beyond the counts become none."""
    parts = F.split(text, mark.replace("<", "\\<"))
    return F.array_join(F.transform(parts, lambda part, i: F.concat(F.when(i > 0, F.repeat(F.lit(token), F.coalesce(F.get(counts, i - 1), F.lit(0)))).otherwise(""), part)), "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def instruction_texts(json: Column) -> Column:
    """The texts of an instruction file in any of its shapes: a list of texts, a list of {caption: text or texts}, {captions: texts},
    {caption: text or texts}, {seen: texts}."""
    many, one = "array<string>", "string"

    def caption(x: Column) -> Column:
        value = F.get_json_object(x, "$.caption")
        return F.when(value.startswith("["), F.from_json(value, many)).when(value.isNotNull(), F.array(value))

    items = F.from_json(json, many)
    listed = F.flatten(F.transform(items, lambda x: F.when(x.startswith("{"), F.coalesce(caption(x), F.array().cast(many))).otherwise(F.array(x.cast(one)))))
    own = F.coalesce(F.from_json(F.get_json_object(json, "$.captions"), many), caption(json), F.from_json(F.get_json_object(json, "$.seen"), many))
    return F.when(F.ltrim(json, F.lit(SPACES)).startswith("["), listed).otherwise(F.coalesce(own, F.array().cast(many)))
