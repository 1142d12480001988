"""Lexicon labelling as native Column expressions.

The reference labels each comment with a Python loop per row (a substring
test per keyword).  Here one projection does it:

1. ``matches``: the distinct terms the text contains, found in ONE pass by
   ``regexp_extract_all(text, '(?=(t1|t2|...))', 1)`` (the alternation is
   factored into a trie of common prefixes).  The zero-width
   lookahead is tried at every position, so overlapping occurrences ("dry
   shampoo" and "shampoo") are all found.  At one position only the first
   matching alternative is captured, so terms are split into groups in
   which no term is a prefix of another (one regex per group; the lexicon
   here needs one).  The result equals a ``contains`` test per term.
2. per category, ``size(array_intersect(matches, keywords))`` = the number
   of distinct keywords contained; the scores go into an array of
   ``struct(s = score, r = -category rank, c = category)`` and the winner
   is its ``array_max`` (ties go to the higher ``r``: the earlier
   category).  A sentinel ``(0, +1, 'unlabeled')`` wins when nothing scored.
3. brands: ``array_intersect(brand list, matches)`` keeps list order.

All of it is codegen-friendly and compact (no per-keyword unrolling, which
would push the stage's generated method past the JVM's 64 KB limit, and no
lambdas, whose outer references Spark 4.1's constraint inference mishandles
across joins).  No UDF, no join, no shuffle.  Expressions are passed as
SQL strings built from the fixed values (one JVM call each).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import BRANDS, CATEGORY_KEYWORDS, NO_BRAND, UNLABELED


def sql_string(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(words: list[str]) -> str:
    return "array(" + ", ".join(sql_string(w) for w in words) + ")"


def _ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _regex_literal(word: str) -> str:
    """Java-regex literal: every non-alphanumeric character escaped."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in word)


def prefix_free_groups(words: list[str]) -> list[list[str]]:
    """Split terms into groups in which no term is a prefix of another."""
    remaining = list(dict.fromkeys(words))
    groups = []
    while remaining:
        group = [w for w in remaining if not any(o != w and o.startswith(w) for o in remaining)]
        groups.append(group)
        remaining = [w for w in remaining if w not in group]
    return groups


#: Branches of a trie node that are tried one by one; more are told apart by
#: a class of their first characters.
_BRANCHES = 4


def trie_pattern(words: list[str], space: str | None = None) -> str:
    """Alternation of ``words`` factored by common prefixes, so the regex
    engine tests one branch per next character instead of every word (2.7x
    faster than the flat alternation on the test text).  ``words`` must be
    prefix-free: the trie then has no word ending at an inner node.
    ``space``: the pattern that stands for a space of a word."""
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})

    def emit(node: dict) -> str:
        chars = sorted(node)
        alts = [(space if space and ch == " " else _regex_literal(ch)) + emit(node[ch]) for ch in chars]
        if not alts:
            return ""
        if len(alts) > _BRANCHES and not (space and " " in node):
            cuts = [slice(i, i + _BRANCHES) for i in range(0, len(alts), _BRANCHES)]
            alts = ["(?=[" + "".join(map(_regex_literal, chars[c])) + "])(?:" + "|".join(alts[c]) + ")" for c in cuts]
        return alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"

    return emit(root)


def term_matches(text_lower: str, terms: list[str]) -> Column:
    """array<string>: the distinct ``terms`` contained in the text (null for
    a null text), found with one lookahead regex per prefix-free group."""
    parts = [F.regexp_extract_all(F.col(text_lower), F.lit("(?=(" + trie_pattern(group) + "))"), F.lit(1))
             for group in prefix_free_groups(terms)]
    return F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts))


#: What ``normalize_text`` turns into one space.
_OTHER = "[^a-z0-9]+"


def loose_matches(text_lower: str, terms: list[str]) -> Column:
    """array<string>: the distinct passages that are one of the ``terms``, or
    become one when the text is normalized (any run of other characters in
    place of a space).  Of one scan come the terms that the text contains
    (passages equal to a term) and those that its normalized form contains
    (``normalized_matches``): runs of a-z0-9 are the same in both.

    Terms are grouped so that in their normalized form none is a prefix of
    another: at one position a group then has one passage at most."""
    remaining = {w: re.sub(_OTHER, " ", w) for w in dict.fromkeys(terms)}
    parts = []
    while remaining:
        group = {}
        for w, plain in sorted(remaining.items(), key=lambda x: -len(x[1])):
            if not any(o.startswith(plain) or plain.startswith(o) for o in group.values()):
                group[w] = plain
        parts.append(F.regexp_extract_all(F.col(text_lower), F.lit("(?=(" + trie_pattern(list(group), _OTHER) + "))"), F.lit(1)))
        remaining = {w: plain for w, plain in remaining.items() if w not in group}
    return F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts))


def normalized_matches(matches: str) -> Column:
    """The passages of ``loose_matches`` as they stand in the normalized text
    (those of terms with other characters become no term)."""
    return F.expr(f"array_distinct(transform({_ref(matches)}, x -> regexp_replace(x, {sql_string(_OTHER)}, ' ')))")


def _count_sql(matches: str, words: list[str]) -> str:
    return f"coalesce(size(array_intersect({_ref(matches)}, {sql_array(list(dict.fromkeys(words)))})), 0)"


def score_structs(matches: str, lexicon: dict | None = None) -> Column:
    """array<struct<s:int, r:int, c:string>> in lexicon order."""
    lexicon = lexicon or CATEGORY_KEYWORDS
    parts = [f"named_struct('s', {_count_sql(matches, words)}, 'r', {-rank}, 'c', {sql_string(cat)})"
             for rank, (cat, words) in enumerate(lexicon.items())]
    return F.expr("array(" + ", ".join(parts) + ")")


def _sentinel(default: str) -> str:
    return f"named_struct('s', 0, 'r', 1, 'c', {sql_string(default)})"


def label_of(scores: str, default: str = UNLABELED) -> Column:
    """Winning category of a score array; ``default`` when nothing scored."""
    return F.expr(f"array_max(concat({_ref(scores)}, array({_sentinel(default)}))).c")


def first_hit_of(scores: str, default: str = UNLABELED) -> Column:
    """Alternative scorer: first category (lexicon order) with any hit."""
    return F.expr(f"coalesce(try_element_at(filter({_ref(scores)}, x -> x.s > 0), 1).c, {sql_string(default)})")


def score_of(scores: str, index: int) -> Column:
    return F.expr(f"{_ref(scores)}[{index}].s")


def winner_share_of(scores: str) -> Column:
    """Lexicon confidence: hits of the winning category / all hits (null
    when nothing hit).  Our definition; the reference's is a model score."""
    return F.expr(f"if(aggregate({_ref(scores)}, 0, (acc, x) -> acc + x.s) > 0, "
                  f"cast(array_max({_ref(scores)}).s AS DOUBLE) / aggregate({_ref(scores)}, 0, (acc, x) -> acc + x.s), "
                  "NULL)")


def brand_list(matches: str, brands: list[str] | None = None, default: str = NO_BRAND) -> Column:
    """Brands contained in the text, in list order; none -> [default]."""
    found = f"array_intersect({sql_array(brands or BRANDS)}, {_ref(matches)})"
    return F.expr(f"if(coalesce(size({found}), 0) = 0, array({sql_string(default)}), {found})")


def relevance_terms(extra_terms: list[str] | None = None, lexicon: dict | None = None,
                    brands: list[str] | None = None) -> list[str]:
    lexicon = lexicon or CATEGORY_KEYWORDS
    terms: list[str] = []
    for w in [w for words in lexicon.values() for w in words] + list(brands or BRANDS) + list(extra_terms or []):
        if w not in terms:
            terms.append(w)
    return terms


def keyword_relevant(matches: str) -> Column:
    """Keyword relevance (our rule for the prose-only step 3): any of the
    matched terms (lexicon keywords, brands, extra terms) is present."""
    return F.expr(f"coalesce(size({_ref(matches)}), 0) > 0")


def category_found(matches: str, lexicon: dict | None = None) -> Column:
    """Whether any category's keyword is among the matches (its label is not
    the default)."""
    words = [w for words in (lexicon or CATEGORY_KEYWORDS).values() for w in words]
    return F.expr(_count_sql(matches, words) + " > 0")


def argmax_index(arr: Column) -> Column:
    """0-based index of the first maximum of a numeric array."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
