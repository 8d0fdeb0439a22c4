"""Text functions, Column to Column. Each rule list is a fixed value that other modules may extend or replace.

Patterns keep to what Java's and RE2's dialects share, so the same rule runs in Spark and in an
SQL oracle. Every function maps a null to a null.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) in the order of application. A group is written \1.
OCR_RULES = ((r"\bl\b", "I"), (r"\bO\b", "0"), (r"\bGO\s+([A-Z])", r"GO \1"))
#: Rewrites every "rn"; it spoils words such as "government", so it is off by default.
OCR_RN_RULE = (r"rn", "m")
HYPHEN_RULES = ((r"(\w+)-\s*\n\s*(\w+)", r"\1\2"),)
UNICODE_RULES = (("[“”„]", '"'), ("[‘’‚]", "'"), ("[–—]", "-"), ("…", "..."))
PAGE_RULES = ((r"\n\s*[-–—]\s*\d+\s*[-–—]\s*\n", "\n"), (r"(?i)\nPage \d+\s*\n", "\n"), (r"(?i)\n\d+\s*of\s*\d+\s*\n", "\n"))
GO_RULES = tuple((f"(?i){p}", "GO MS No. ") for p in (r"G\.O\.Ms\.No\.?\s*", r"G-O-Ms-No\.?\s*", r"GO\s+MS\s+No\.?\s*", r"G\.O\.\s*\(Ms\)\s*No\.?\s*"))
DATE_RULES = ((r"\b(\d{1,2})[-.](\d{1,2})[-.](\d{4})\b", r"\1/\2/\3"),)
SECTION_RULES = ((r"(?i)Sec\.?\s+", "Section "), (r"Section-", "Section "), (r"§\s*", "Section "))
ARTIFACT_RULES = tuple((f"(?i){p}", "") for p in (r"\[Image: .*?\]", r"\[Chart: .*?\]", r"\[Graph: .*?\]", r"<.*?>"))
SPACE_RULES = ((r" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r"(?m)^ +", ""), (r"(?m) +$", ""), (r"^\s+", ""), (r"\s+$", ""))
SPECIAL_KEEP = ((r"[^\w\s.,;:!?()\[\]{}\"'/-]", ""),)
SPECIAL_DROP = ((r"[^\w\s]", ""),)
#: Strings that are looked for at most before a pattern is.
MOST_NEEDED = 8
COMPARE_RULES = ((r"\s+", " "), (r"[^\w\s\-.,;:!?]", ""), (r"^\s+", ""), (r"\s+$", ""))
#: The ASCII characters that they drop, one by one: Java looks these up in a table, where it tries the parts of a negated class in turn.
_DROPPED = "[" + "".join(rf"\x{i:02x}" for i in range(128) if re.match(COMPARE_RULES[1][0], chr(i), re.A)) + "]"


def rewrite(c: Column, rules) -> Column:
    """Applies the rules one after the other."""
    for pattern, to in rules:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(_java(to)))
    return c


def _java(to: str) -> str:
    out = to.replace("$", r"\$")
    for i in range(1, 10):
        out = out.replace(f"\\{i}", f"${i}")
    return out


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case strings one of which every match of a pattern holds; empty where none are found.

    Patterns match other letters than their own by ASCII case alone, so the lower-case text holds the string.
    """

    def best(items) -> frozenset:
        found, run = [], ""
        for kind, arg in [*items, (None, None)]:
            if kind is op.LITERAL and arg < 128:
                run += chr(arg).lower()
            elif kind is not op.AT:
                found.append(frozenset([run]))
                run = ""
                if kind is op.SUBPATTERN:
                    found.append(best(arg[3]))
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                    found.append(best(arg[2]))
                elif kind is op.BRANCH:
                    each = [best(x) for x in arg[1]]
                    every = frozenset().union(*each) if all(each) else frozenset()
                    found.append(frozenset(x for x in every if not any(y != x and y in x for y in every)))
        found = [f for f in found if f and min(map(len, f)) > 1 and len(f) <= MOST_NEEDED]
        return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=frozenset())

    try:
        return tuple(sorted(best(parser.parse(pattern))))
    except parser.error:  # what only the other dialects know
        return ()


def may_match(c: Column, pattern: str) -> Column:
    """False only where a text has no match, by plain search for what a match holds, which costs a fraction of the pattern's."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(x) for x in needed(pattern)]) if needed(pattern) else F.lit(True)


def fix_ocr(c: Column, rewrite_rn: bool = False) -> Column:
    return rewrite(c, (*OCR_RULES[:2], OCR_RN_RULE, *OCR_RULES[2:]) if rewrite_rn else OCR_RULES)


def fix_hyphenation(c: Column) -> Column:
    return rewrite(c, HYPHEN_RULES)


def normalize_unicode(c: Column) -> Column:
    """Curly quotes, dashes and the ellipsis become plain ones (the intended behaviour)."""
    return rewrite(c, UNICODE_RULES)


def remove_page_furniture(c: Column) -> Column:
    return rewrite(c, PAGE_RULES)


def standardize_orders(c: Column) -> Column:
    return rewrite(c, GO_RULES)


def standardize_dates(c: Column) -> Column:
    return rewrite(c, DATE_RULES)


def standardize_sections(c: Column) -> Column:
    return rewrite(c, SECTION_RULES)


def remove_artifacts(c: Column) -> Column:
    return rewrite(c, ARTIFACT_RULES)


def normalize_whitespace(c: Column) -> Column:
    return rewrite(c, SPACE_RULES)


def remove_special(c: Column, keep_punctuation: bool = True) -> Column:
    return rewrite(c, SPECIAL_KEEP if keep_punctuation else SPECIAL_DROP)


#: The steps of ``clean`` in order.
CLEAN_RULES = (*OCR_RULES, *HYPHEN_RULES, *UNICODE_RULES, *PAGE_RULES, *GO_RULES, *DATE_RULES, *SECTION_RULES, *ARTIFACT_RULES, *SPACE_RULES)


def clean(c: Column, aggressive: bool = False) -> Column:
    return rewrite(F.coalesce(c, F.lit("")), (*CLEAN_RULES, *SPECIAL_DROP) if aggressive else CLEAN_RULES)


def for_comparison(c: Column) -> Column:
    """The form in which texts are compared for duplicates: lower case, single spaces, plain punctuation."""
    return F.trim(rewrite(F.lower(F.coalesce(c, F.lit(""))), (COMPARE_RULES[0], (r"[^\x00-\x7F]+", ""), (_DROPPED, ""))))


def content_hash(c: Column) -> Column:
    return F.md5(for_comparison(c))


def let(c: Column, body) -> Column:
    """``body(c)`` with c evaluated once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def char_shingles(c: Column, size: int = 5, normalized: bool = False) -> Column:
    """Distinct character shingles of the comparison form (``normalized``: c is in it); a shorter text is one shingle."""

    def body(n: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(n) - (size - 1))), lambda i: F.substr(n, i, F.lit(size))))
        return F.when(F.length(n) < size, F.array(n)).otherwise(many)

    return let(c if normalized else for_comparison(c), body)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(c: Column) -> Column:
    """Lower-case words: letters of any script, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def split_words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(split_words(F.lower(a))), F.array_distinct(split_words(F.lower(b))))


def first_number(c: Column) -> Column:
    """The first number of a text, thousands commas removed; null without one."""
    return F.regexp_replace(F.regexp_extract(c, r"\d+(?:,\d+)*(?:\.\d+)?", 0), ",", "").try_cast("double")


def spelling(c: Column, table: dict[str, str]) -> Column:
    """Replaces whole tokens by a dictionary; the case class (upper, capitalised, lower) stays."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def one(w: Column) -> Column:
        new = F.element_at(m, F.lower(w))
        return F.when(new.isNull(), w).when(w == F.upper(w), F.upper(new)).when(F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 20))).otherwise(new)

    return F.array_join(F.transform(F.split(c, " "), one), " ")


def expand_acronyms(c: Column, table: dict[str, str]) -> Column:
    """``X`` becomes ``X (expansion)``, the longest acronym first; what an expansion adds is scanned again."""
    for k in sorted(table, key=lambda k: (-len(k), k)):
        c = F.regexp_replace(c, F.lit(acronym_pattern(k)), F.lit(f"$1 ({table[k]})"))
    return c


def acronym_pattern(acronym: str) -> str:
    """The acronym as a whole word; one that ends in a sign ends there."""
    return r"(?i)\b(" + "".join(x if x.isalnum() else "\\" + x for x in acronym) + ")" + (r"\b" if acronym[-1].isalnum() else "")


def canonical_names(c: Column, aliases: dict[str, str]) -> Column:
    for k, v in aliases.items():
        c = F.regexp_replace(c, F.lit(rf"(?i)\b{k}\b"), F.lit(v))
    return c
