"""Text functions of the retrieval engine as Column expressions: everything stays in the JVM.

Two paths run side by side on one text: Latin words (lower case, accents removed, split at letter-digit borders, single
characters dropped) and overlapping pairs of Chinese and Japanese characters of the compatibility-normalised text.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlake.session import stripped

#: Han, kana and the three marks that stand inside words.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々〆"
#: The same as one class that looks up the script of no character before the first Han one, as most are.
CJK_FAST = rf"[\x{{2E80}}-\x{{10FFFF}}&&[{CJK}]]"
#: Ranges that are this near to each other are first asked for as one.
NEAR = 64


@functools.lru_cache(1)
def _fold_tables() -> tuple[str, str]:
    """Letters that decompose to one base character and marks, and their bases; đ is a letter of its own."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for c in range(0xC0, 0x10000):
        ch = chr(c)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 or parts != ch:
            base = [p for p in parts if unicodedata.category(p) != "Mn"]
            if len(base) == 1 and base[0] != ch:
                source.append(ch)
                target.append(base[0].translate({0x111: "d", 0x110: "D"}))
    return "".join(source), "".join(target)


def _ranges(letters: list[str], near: int = 1) -> str:
    """Characters as the inside of a Java character class, those at most near apart as one range with all between them."""
    points = sorted({ord(c) for c in letters})
    starts = [p for i, p in enumerate(points) if i == 0 or points[i - 1] < p - near]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] > p + near]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


def _is_cjk(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith(("CJK UNIFIED", "HIRAGANA LETTER", "KATAKANA LETTER")) or ch in "ー々〆〇"


@functools.lru_cache(1)
def _compatibility_tables() -> tuple[str, str, list[tuple[str, str]], str]:
    """Characters whose compatibility form is one character, longer forms with what they stand for, and a class of all of them.

    Only forms that hold a CJK character count; half-width kana with a voicing mark are pairs.
    """
    source, target, longer = [], [], []
    for c in range(0x2000, 0x30000):
        ch = chr(c)
        form = unicodedata.normalize("NFKC", ch) if not 0xD800 <= c < 0xE000 else ch
        if form != ch and any(map(_is_cjk, form)):
            if len(form) == 1:
                source.append(ch)
                target.append(form)
            else:
                longer.append((ch, form))
    all_ = [*source, *"ﾞﾟ゙゚", *(a for a, _ in longer)]
    pairs = [(a + mark, form) for a in source for mark in "ﾞﾟ" if len(form := unicodedata.normalize("NFKC", a + mark)) == 1]
    pairs += [(a + mark, form) for a in map(chr, range(0x3041, 0x30FB)) for mark in "ﾞﾟ゙゚" if len(form := unicodedata.normalize("NFKC", a + mark)) == 1]
    return "".join(source), "".join(target), pairs + longer, f"[{_ranges(all_, NEAR)}&&[{_ranges(all_)}]]"


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """text with the first of each pair replaced by the second, in order: one expression however many pairs there are."""
    table = F.split(F.lit("\n".join(f"{a}\t{b}" for a, b in pairs)), "\n")
    return F.aggregate(table, text, lambda done, pair: F.replace(done, F.substring_index(pair, "\t", 1), F.substring_index(pair, "\t", -1)))


def remove_accents(text: Column) -> Column:
    """Without accents, đ as d; case stays; null as empty."""
    source, target = _fold_tables()
    plain = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), source, target)
    return F.coalesce(F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text), F.lit(""))


@functools.lru_cache(1)
def _compositions() -> list[tuple[str, str]]:
    """Lower-case vowels with marks, as (letter and mark, letter), inner marks first."""
    pairs = []
    for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(c)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and ch == ch.lower() and unicodedata.normalize("NFD", ch)[0] in "aeiouy":
            pairs.append((len(unicodedata.normalize("NFD", ch)), chr(int(parts[0], 16)) + chr(int(parts[1], 16)), ch))
    return [(a, b) for _, a, b in sorted(pairs)]


def composed(text: Column) -> Column:
    """Lower-case text with vowels and separate marks put together; other texts pass untouched."""
    return F.when(text.rlike(r"\p{Mn}"), _replaced(text, _compositions())).otherwise(text)


def normalise(text: Column) -> Column:
    """Lower case, then without accents."""
    return remove_accents(F.lower(text))


def compatibility(text: Column) -> Column:
    """The compatibility form as far as it concerns CJK characters; other texts pass unchanged and untouched."""
    source, target, longer, all_ = _compatibility_tables()
    return F.when(text.rlike(all_), F.translate(_replaced(text, longer), source, target)).otherwise(text)


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalise(text), F.lit("[a-z]{2,}+|[0-9]{2,}+"), 0)


def cjk_bigrams(text: Column) -> Column:
    runs = F.regexp_extract_all(compatibility(text), F.lit(f"{CJK_FAST}+"), 0)
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    return F.coalesce(F.flatten(pairs), F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Latin tokens, then CJK pairs; null and blank texts give an empty array."""
    some = F.coalesce(text, F.lit(""))
    return F.concat(latin_tokens(some), cjk_bigrams(some))


def contains_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK_FAST), F.lit(False))


def normalise_lang(lang: Column) -> Column:
    """Trimmed and in lower case; blank as null, which means no language."""
    return F.nullif(F.lower(stripped(lang)), F.lit(""))


def case_lang(lang: Column, default: str = "vi") -> Column:
    """The language of a question or chunk: as `normalise_lang`, blank as the default."""
    return F.coalesce(normalise_lang(lang), F.lit(default))


def has_accents(text: Column) -> Column:
    return normalise(text) != F.lower(text)


def slug(name: Column) -> Column:
    """A name as part of a file name."""
    return F.translate(name, ":/", "--")


def redact(url: Column) -> Column:
    """A connection address without its password."""
    return F.regexp_replace(url, r"://([^:/@]+):[^@]*@", "://$1:***@")


def percent(hits: Column, n: Column) -> Column:
    """Such as `81.1% (30/37)`."""
    return F.format_string("%.1f%% (%d/%d)", 100.0 * hits / n, hits, n)


# The same in DuckDB, for the oracle queries.
SQL_WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WHITE}+|{SQL_WHITE}+$', '', 'g')"


def sql_normalise(x: str) -> str:
    return f"replace(strip_accents(lower(coalesce({x}, ''))), 'đ', 'd')"


def sql_lang(x: str) -> str:
    return f"nullif(lower({sql_strip(x)}), '')"


def sql_tokens(x: str) -> str:
    latin = f"list_filter(string_split_regex(regexp_replace(regexp_replace({sql_normalise(x)}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '[^a-z0-9]+'), lambda t: length(t) > 1)"
    runs = f"regexp_extract_all(nfc_normalize(coalesce({x}, '')), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}ー々〆]+')"
    pairs = f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"
    return f"list_concat({latin}, coalesce({pairs}, []))"
