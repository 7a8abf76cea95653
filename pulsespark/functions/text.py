"""Column functions for text: normalisers, token filters, emoticons, timed lyrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EMOJI = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{2600}-\x{2B55}]"
SPACES = "[　​ ]"
DASHES = "-|_|——|－"
MARK = r"\[[0-9]{2}:[0-9]{2}[:.]*[0-9]{0,3}\]"
GLUE = "空"


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def emoticons(text: Column, characters: str, least: int = 5) -> Column:
    """Distinct runs of at least five of the characters in lower-cased text, without letters and digits and without a character thrice."""
    inside = "".join(f"\\x{{{ord(c):X}}}" for c in dict.fromkeys(characters) if c not in "\n！")
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[{inside}]{{{least},}}"), F.lit(0))
    often = lambda r: F.exists(F.array_distinct(F.split(r, "")), lambda c: F.length(r) - F.length(F.replace(r, c, F.lit(""))) >= 3)
    return F.array_distinct(F.filter(runs, lambda r: ~r.rlike("[0-9a-z]") & ~often(r)))


def replace_each(text: Column, found: Column, by: str) -> Column:
    return F.aggregate(found, text, lambda acc, x: F.replace(acc, x, F.lit(by)))


def strip_marks(text: Column, marks: Sequence[str]) -> Column:
    """text without the marks, removed one after another in their order; runs of single characters go at once."""
    singles: list[str] = []
    for m in [*marks, None]:
        if m is not None and len(m) == 1:
            singles.append(m)
            continue
        if singles:
            text = F.translate(text, "".join(singles), "")
            singles = []
        if m:
            text = F.replace(text, F.lit(m), F.lit(""))
    return text


def glue_latin(text: Column) -> Column:
    """GLUE in the place of each space between two of a-z, which replacing ([a-z]+) ([a-z]+) twice comes to."""
    return F.regexp_replace(text, "(?<=[a-z]) (?=[a-z])", GLUE)


def normalise_short(text: Column, marks: Sequence[str]) -> Column:
    return strip_marks(F.regexp_replace(strip_emoji(text), SPACES, " "), marks)


def normalise(text: Column, marks: Sequence[str], characters: str) -> Column:
    text = strip_emoji(text)
    text = replace_each(text, emoticons(text, characters), "kaomoji")
    text = F.regexp_replace(F.regexp_replace(text, DASHES, ""), SPACES, " ")
    return glue_latin(strip_marks(text, marks))


def tokens(text: Column) -> Column:
    """The default tokenizer: runs of letters and runs of numbers, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


def says(w: Column, stop: Sequence[str] = (), skip: str = "", marks: Sequence[str] = ("第",)) -> Column:
    """Whether a lower-cased word says something: two characters or more, not one character repeated, not a number, no dot, no
    stop word or mark, and no skip character in words of two."""
    ok = (F.length(w) >= 2) & ~w.isin(list(stop)) & ~F.contains(w, F.lit("."))
    for m in marks:
        ok &= ~F.contains(w, F.lit(m))
    if skip:
        ok &= ~((F.length(w) == 2) & F.exists(F.split(w, ""), lambda c: c.isin(list(skip))))
    return ok & ~w.rlike(r"^(?:[0-9]+|(?s:(.)\1*))$")


def filter_tokens(words: Column, stop: Sequence[str] = (), skip: str = "", marks: Sequence[str] = ("第",)) -> Column:
    """The lower-cased words that say something."""
    return F.filter(F.transform(words, F.lower), lambda w: says(w, stop, skip, marks))


def sentences(text: Column, least: int = 3) -> Column:
    """Sentences between 。 ？ ... …… and ~, of at least three words each."""
    return F.filter(F.transform(F.split(text, r"。|？|\.\.\.|……|~"), tokens), lambda s: F.size(s) >= least)


def lines(text: Column) -> Column:
    """Lines as they are, without a last empty one."""
    return F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")


def bigrams(words: Column, stop: Sequence[str] = (), script: str = r"\p{IsHan}", below: int = 6) -> Column:
    """Adjacent words joined: with a letter of the script, of other letters each, no stop words, and short."""
    stops = list(stop)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(
        F.array().cast("array<struct<a:string,b:string>>")
    )
    letters = lambda w: F.array_sort(F.array_distinct(F.split(w, "")))

    def keep(p: Column) -> Column:
        joined = F.concat(p["a"], p["b"])
        ok = F.length(joined) < below  # what costs least and rules out most goes first
        if stops:
            ok &= ~p["a"].isin(stops) & ~p["b"].isin(stops)
        return ok & joined.rlike(script) & (letters(p["a"]) != letters(p["b"]))

    return F.transform(F.filter(pairs, keep), lambda p: F.concat(p["a"], p["b"]))


def lyric_lines(text: Column) -> Column:
    """(mark, text) of timed lyrics by mark, a line with several marks once each; without any mark the lines as they are, marks null."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    marked = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.transform(
        F.regexp_extract_all(line, F.lit(MARK), F.lit(0)), lambda m: F.struct(m.alias("mark"), strip(F.regexp_extract(line, r"\]([^\[\]]+)", 1)).alias("text"))
    )))
    plain = F.transform(F.split(text, "\n"), lambda line: F.struct(F.lit(None).cast("string").alias("mark"), strip(line).alias("text")))
    return F.when(text.rlike(MARK), F.array_sort(marked)).otherwise(plain)


def longest_matches(text: Column, words: Sequence[str]) -> Column:
    """Dictionary segmentation: at each place the longest word of the lexicon, else a run of letters or numbers."""
    import re

    known = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.lower(text), F.lit((known + "|" if known else "") + r"\p{L}+|\p{N}+"), F.lit(0))
