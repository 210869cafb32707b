"""Folding, tokens and keyword matching as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKS = "[\\u0300-\\u036f]+"
_WORD = "[A-Za-z0-9_]"
_SPACES = "\\s\\x1c-\\x1f\\u1680\\u2000-\\u2006\\u2008-\\u200a\\u2028\\u2029\\u205f\\u3000"
# A word boundary over ASCII word characters, spelled out because the regex shorthand is
# Unicode-aware on some Java versions and not on others.
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Accented letters and their plain forms, derived from the Unicode decomposition rule.

    Covers every letter of the basic plane that decomposes to one character plus combining marks
    in U+0300..U+036F.
    """
    accented, plain = [], []
    for point in range(0x80, 0x10000):
        letter = chr(point)
        parts = [c for c in unicodedata.normalize("NFD", letter) if not 0x300 <= ord(c) <= 0x36F]
        if len(parts) == 1 and parts[0] != letter:
            accented.append(letter)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


def is_blank(text: Column) -> Column:
    """Empty or whitespace of any script. A text that starts with a visible ASCII character needs no pattern."""
    return ~((text >= F.lit("!")) & (text < F.lit("\x7f"))) & text.rlike(f"^[{_SPACES}]*$")


def stripped(text: Column) -> Column:
    """Without surrounding whitespace of any script."""
    return F.regexp_replace(text, f"^[{_SPACES}]+|[{_SPACES}]+$", "")


def trimmed(text: Column) -> Column:
    """Without surrounding spaces and control characters."""
    return F.btrim(text, F.lit("".join(map(chr, range(0x21)))))


def fold(text: Column) -> Column:
    """Lower case without accents. Plain ASCII text skips the letter table."""
    accented, plain = _plain_letters()
    unaccented = F.regexp_replace(
        F.translate(text, accented, plain), _MARKS, ""
    )
    return F.lower(F.when(text.rlike("[^\\x00-\\x7F]"), unaccented).otherwise(text))


def words(folded: Column) -> Column:
    """Distinct maximal runs of ASCII word characters in folded text."""
    return F.array_distinct(
        F.filter(F.split(folded, "[^A-Za-z0-9_]+"), lambda w: w != F.lit(""))
    )


def odd_characters(folded: Column) -> Column:
    """Distinct characters that are neither word characters nor whitespace."""
    return F.array_distinct(
        F.filter(
            F.split(F.regexp_replace(folded, "[A-Za-z0-9_\\s]+", ""), ""), lambda c: c != F.lit("")
        )
    )


def singular(token: Column) -> Column:
    """Drop a regular plural ending, sparing short words."""
    size = F.length(token)
    return (
        F.when((size > 4) & token.endswith("es"), F.substring(token, F.lit(1), size - 2))
        .when((size > 3) & token.endswith("s"), F.substring(token, F.lit(1), size - 1))
        .otherwise(token)
    )


def stems(keyword: Column) -> Column:
    """Folded, singular tokens of a keyword, in order."""
    tokens = F.filter(F.split(fold(keyword), "\\s+"), lambda t: t != F.lit(""))
    return F.transform(tokens, singular)


def _quoted(token: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def plural_forms(stem: Column) -> Column:
    return F.array(stem, F.concat(stem, F.lit("s")), F.concat(stem, F.lit("es")))


def keyword_phrase(keyword: Column) -> Column:
    """The name of what is looked for: its stems; null where nothing can be found. Keywords with one
    name are found in the same texts."""
    name = F.array_join(stems(keyword), " ")
    return F.when(name != "", name)


def keyword_term(keyword: Column) -> Column:
    """Everything needed to look for one keyword in texts.

    A keyword of plain words is found by its words alone. One with other characters has a ``pattern``,
    tried where a text has its ``run``: its words one after another, whatever stands between them. If it
    has no word, that is its first character behind a ``#``.
    """
    parts = stems(keyword)
    joined = F.array_join(parts, " ")
    plain = F.forall(parts, lambda p: p.rlike(f"^{_WORD}+$"))
    inner = F.regexp_extract_all(joined, F.lit(f"({_WORD}+)"))
    # At its start a keyword's own character tells which kind of edge that is. It is looked at behind the
    # first stem, so that a pattern begins with plain text, which is found much faster.
    first = _quoted(F.get(parts, F.lit(0)))
    before = F.when(joined.rlike(f"^{_WORD}"), f"(?<!{_WORD}").otherwise(f"(?<={_WORD}")
    others = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.lit("\\s+"), _quoted(p), F.lit("(?:es|s)?"))
    )
    pattern = F.concat(first, before, first, F.lit(")(?:es|s)?"), F.array_join(others, ""), F.lit(_EDGE))
    run = F.when(F.size(inner) > 0, F.array_join(inner, " ")).otherwise(odd_key(F.substring(joined, 1, 1)))
    return F.struct(
        keyword_phrase(keyword).alias("phrase"),
        parts.alias("parts"),
        F.when(~plain, pattern).alias("pattern"),
        F.when(plain, joined).otherwise(run).alias("run"),
        F.size(inner).alias("length"),
    )


def odd_key(character: Column) -> Column:
    return F.concat(F.lit("#"), character)


def run_rows(texts: DataFrame, folded: Column, lengths: list[int], *keep: str, across: bool = False) -> DataFrame:
    """Runs of so many words as rows of ``run`` and ``run_key``, beside the columns to keep, with nothing but
    whitespace between the words, or anything (``across``). A run that a text has several times comes as often.
    Lambdas are not compiled, so there are none: each word is laid beside those that follow it."""
    # What is neither word nor whitespace stands alone, and nothing runs over it.
    apart = F.split(F.regexp_replace(folded, "[^A-Za-z0-9_\\s]+", " # "), "\\s+")
    tokens = F.split(folded, "[^A-Za-z0-9_]+") if across else apart
    most = max(lengths)
    rest = [F.slice("_tokens", place + 1, F.size("_tokens")).alias(f"w{place}") for place in range(1, most)]
    rows = texts.select(*keep, tokens.alias("_tokens"))
    rows = rows.select(*keep, F.explode(F.arrays_zip(F.col("_tokens").alias("w0"), *rest)).alias("_at"))
    word = [F.nullif(F.nullif(F.col(f"_at.w{place}"), F.lit("")), F.lit("#")) for place in range(most)]
    rows = rows.select(*keep, *[w.alias(f"_w{place}") for place, w in enumerate(word)])
    rows = rows.filter(F.col("_w0").isNotNull())

    def joined(words: list[Column]) -> Column:
        return F.concat(words[0], *[part for w in words[1:] for part in (F.lit(" "), w)])

    def one(length: int) -> Column:
        own = [F.col(f"_w{place}") for place in range(length)]
        key = F.xxhash64(joined([F.rtrim(w, F.lit("es")) for w in own]))
        return F.struct(joined(own).alias("run"), key.alias("run_key"))

    runs = rows.select(*keep, F.inline(F.array(*[one(n) for n in lengths])))
    return runs.filter(F.col("run").isNotNull())


def odd_runs(texts: DataFrame, folded: Column, lengths: list[int], *keep: str) -> DataFrame:
    """What texts have of the runs that keywords with other characters are looked for by. Those of no word
    are looked for by a character."""
    counted = [n for n in lengths if n]
    found = run_rows(texts, folded, counted, *keep, across=True) if counted else None
    if 0 not in lengths:
        return found
    single = texts.select(*keep, F.explode(F.transform(odd_characters(folded), odd_key)).alias("run"))
    single = single.withColumn("run_key", run_key(F.col("run")))
    return found.unionByName(single) if counted else single


def run_key(run: Column) -> Column:
    """A hash that is the same for a run of words and each run of their forms: ``s`` and ``e`` at the end
    of a word don't count. Others may share it."""
    one = F.rtrim(run, F.lit("es"))
    return F.xxhash64(F.when(F.instr(run, " ") == 0, one).otherwise(F.regexp_replace(run, "[es]+(?= |$)", "")))


def is_run_of(run: Column, parts: Column) -> Column:
    """Whether the words of a run are forms of these stems, one for one."""
    found = F.split(run, " ")
    forms = F.zip_with(found, parts, lambda w, p: (w == p) | (w == F.concat(p, F.lit("s"))) | (w == F.concat(p, F.lit("es"))))
    return (F.size(found) == F.size(parts)) & F.forall(forms, lambda f: f)


def sentence(template: str, *values: Column) -> Column:
    """``format_string`` for texts (``%s``) and whole numbers (``%d``) alone, put together without a formatter."""
    pieces = [piece.replace("%%", "%") for piece in re.split("(?<!%)%[sd]", template)]
    if len(pieces) != len(values) + 1:
        raise ValueError(f"{len(values)} values for {template}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [F.coalesce(value.cast("string"), F.lit("null")), F.lit(piece)]
    return F.concat(*parts)


def quoted_payload(payload: Column, limit: int, empty: str) -> Column:
    """A payload for a report: stripped, and cut with its length when long."""
    body = stripped(payload)
    size = F.length(body)
    return (
        F.when(payload.isNull() | (body == ""), F.lit(empty))
        .when(size <= limit, body)
        .otherwise(
            F.concat(
                F.substring(body, 1, limit),
                F.lit("... <truncated, "),
                size.cast("string"),
                F.lit(" chars>"),
            )
        )
    )
